"""Names and identities: content hashes, hex, legal names, paths and globs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(data: Column) -> Column:
    """SHA-256 of the plain bytes, in lower-case hex. Null for null."""
    return F.sha2(data, 256)


def to_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def from_hex(text: Column) -> Column:
    """The 32 bytes that text spells; an error if it spells anything else."""
    raw = F.unhex(text)
    return F.when(F.octet_length(raw) == 32, raw).otherwise(F.raise_error(F.concat(F.lit("not a 32-byte hex id: "), F.coalesce(text, F.lit("null")))).cast("binary"))


def is_hex_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def legal_entry_name(name: Column) -> Column:
    """A tree entry's name: not empty, no slash, neither "." nor ".."."""
    return F.coalesce((name != "") & ~name.contains("/") & ~name.isin(".", ".."), F.lit(False))


def legal_blob_name(name: Column) -> Column:
    """A blob's name: not empty, relative, and without a ".." component."""
    return F.coalesce((name != "") & ~name.startswith("/") & ~F.array_contains(F.split(name, "/"), ".."), F.lit(False))


def pack_name(pack_id: Column) -> Column:
    return F.concat(F.lit("packs/"), pack_id, F.lit(".pack"))


def pack_id_of(name: Column) -> Column:
    """The id in a pack's name; null for foreign names."""
    return F.nullif(F.regexp_extract(name, r"^packs/([0-9a-f]{64})\.pack$", 1), F.lit(""))


def join_path(prefix: Column, name: Column) -> Column:
    return F.when(prefix == "", name).otherwise(F.concat_ws("/", prefix, name))


def glob_pattern(glob: str) -> str:
    """A Java pattern for the glob: * and ? also match a slash, [!x] is [^x]."""
    out, i = "", 0
    while i < len(glob):
        c, i = glob[i], i + 1
        end = glob.find("]", i + 1 + glob[i : i + 1].count("!")) if c == "[" else -1
        if end > 0:
            body = glob[i:end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&").replace("^", r"\^")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end + 1
        else:
            out += {"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or c in "_/ " else "\\" + c)
    return f"(?s)^{out}$"


def matches_glob(path: Column, globs: list[str]) -> Column:
    """Whether the whole path, or its last component, matches any of the globs."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_pattern(g)) | base.rlike(glob_pattern(g))
    return F.coalesce(hit, F.lit(False))


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether the path or a folder that holds it matches a glob, so that whole subtrees go."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.coalesce(F.exists(prefixes, lambda p: matches_glob(p, globs)), F.lit(False))
