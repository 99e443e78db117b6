"""Every engine operator as a query over the sample tables.

A row of documents is a file: doc_id its name, text its content, source the run that brought it.
conversations are files cut into ordered chunks. region, nation and customer are folders, folders
in them, and files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, identity
from ..operators import chunking, gc, index, packing, restore, snapshots, tree, verify
from ..operators.state import cut
from ..sources import files as source_files
from .cycles import backup_snapshots, prune_cycle, restore_cycle, restore_damaged, restore_path, scan_folder  # noqa: F401

#: Small packs, so that small tables fill many.
PACK_TARGET = 20_000
FORGOTTEN = 3
GLOBS = ["/de/*", "*/8?", "[1-3]??", "[!0-5]*"]
KEY = bytes(range(32))
SMALL = chunking.Params(least=256, average=1024, most=4096, hard=0x0000D90003030000, easy=0x0000000003030000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.encode("text", "UTF-8").alias("content"))


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file that isn't empty as a single chunk."""
    return files(spark, sf_dir).where(F.octet_length("content") > 0).select("doc_id", "source", identity.chunk_id(F.col("content")).alias("chunk_id"), F.octet_length("content").cast("long").alias("length"), "content")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct chunks, in the order in which they first come."""
    return whole(spark, sf_dir).groupBy("chunk_id").agg(F.min("doc_id").alias("first_doc"), F.max("length").alias("length"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.assign(stored(spark, sf_dir), ["first_doc"], target=PACK_TARGET)


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index: chunk_id, pack_id, offset, length; a pack is named by its chunks in order."""
    own = cut(packed(spark, sf_dir))
    placed = F.transform(F.sort_array(F.collect_list(F.struct("first_doc", "chunk_id"))), lambda x: x["chunk_id"])
    names = own.groupBy("pack_no").agg(F.sha2(F.array_join(placed, ""), 256).alias("pack_id"))
    return own.join(names, "pack_no").select("chunk_id", "pack_id", "offset", "length")


def blobs_of(entries: DataFrame) -> DataFrame:
    own = packing.directory(entries)
    return own.select("pack_id", identity.pack_name(F.col("pack_id")).alias("name"), "size")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot for each source: made when its last document came."""
    own = table(spark, sf_dir, "documents").groupBy("source").agg(F.max("doc_id").cast("double").alias("created"), F.count(F.lit(1)).alias("files"), F.sum(F.octet_length(F.encode("text", "UTF-8"))).cast("long").alias("bytes_read"))
    return own.select(F.substring(F.sha2("source", 256), 1, 16).alias("id"), "created", F.col("source").alias("source_path"), "files", "bytes_read")


def kept_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = runs(spark, sf_dir)
    return snapshots.forget(every, snapshots.listed(every).limit(FORGOTTEN))


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = kept_runs(spark, sf_dir).select(F.col("source_path").alias("source"))
    return whole(spark, sf_dir).join(kept, "source", "left_semi").select("chunk_id").distinct()


def chunk_identity(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", identity.chunk_id(F.col("content")).alias("chunk_id"))


def hex_ids(spark, sf_dir):
    """Ids as raw bytes and back, and which strings are ids."""
    own = files(spark, sf_dir).select("doc_id", "source", identity.chunk_id(F.col("content")).alias("chunk_id")).where(F.col("chunk_id").isNotNull())
    raw = identity.from_hex(F.col("chunk_id"))
    return own.select("doc_id", identity.to_hex(raw).alias("read_back"), F.octet_length(raw).cast("long").alias("bytes"), identity.is_hex_id(F.col("chunk_id")).alias("own"), identity.is_hex_id(F.upper("chunk_id")).alias("upper_case"), identity.is_hex_id(F.col("source")).alias("other"))


def index_remove(spark, sf_dir):
    return index.remove(located(spark, sf_dir), live(spark, sf_dir))


def cdc(spark, sf_dir, params=chunking.Params()):
    return chunking.chunk(files(spark, sf_dir), params=params).select("doc_id", "source", "seq", "offset", "length", "chunk_id")


def cdc_chunks(spark, sf_dir):
    return cdc(spark, sf_dir).drop("source")


def cdc_chunks_small(spark, sf_dir):
    return cdc(spark, sf_dir, SMALL).drop("source")


def small_file_chunks(spark, sf_dir):
    small = files(spark, sf_dir).where(F.octet_length("content").between(1, chunking.LEAST))
    return chunking.chunk(small).select("doc_id", "seq", "offset", "length", "chunk_id")


def dedup_report(spark, sf_dir):
    return index.dedup_report(cdc(spark, sf_dir), "source")


def new_chunks_per_run(spark, sf_dir):
    return index.running(whole(spark, sf_dir), "source")


def dedup_hits(spark, sf_dir):
    """Files whose content an earlier run has stored."""
    own = whole(spark, sf_dir).select("doc_id", "source", "chunk_id")
    first = own.groupBy("chunk_id").agg(F.min("source").alias("pack_id")).withColumns({"offset": F.lit(0), "length": F.lit(0)})
    return index.locate(own, first).where(F.col("pack_id") < F.col("source")).select("doc_id", "source", F.col("pack_id").alias("first_source"))


def fresh_chunks(spark, sf_dir):
    """What the last run would store if all earlier ones were indexed."""
    own = whole(spark, sf_dir)
    last = F.lit(own.agg(F.max("source")).first()[0])
    new = own.where(F.col("source") == last).select("chunk_id", "doc_id", "length")
    return index.fresh(new, own.where(F.col("source") < last).select("chunk_id").distinct(), ["doc_id"])


def chunk_offsets(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("length"))
    return packing.offsets(own, ["conv_id"], "turn", F.col("length")).select("conv_id", "turn", "offset", "length")


def file_hash(spark, sf_dir):
    return chunking.content_hash(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text")


def pack_assignment(spark, sf_dir):
    return packed(spark, sf_dir).select("chunk_id", "pack_no", "offset", "length")


def pack_directory(spark, sf_dir):
    return packing.directory(located(spark, sf_dir))


def index_last_wins(spark, sf_dir):
    own = whole(spark, sf_dir).select("chunk_id", F.col("doc_id").alias("batch"), F.col("source").alias("pack_id"), "length")
    return index.last_wins(own, "batch")


def locate(spark, sf_dir):
    return index.locate(whole(spark, sf_dir).select("doc_id", "chunk_id"), located(spark, sf_dir)).select("doc_id", "pack_id", "offset", "length")


def exclude_glob(spark, sf_dir):
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    own = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return own.select("page_id", "path", identity.matches_glob(F.col("path"), GLOBS).alias("matched"))


def tree_entries(spark, sf_dir):
    region, nation, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    nations = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("folder"))
    none = F.lit(None)
    meta = lambda kind, size: F.struct(none.alias("gid"), none.alias("link_target"), none.alias("mode"), none.alias("mtime_ns"), size.alias("size"), F.lit(kind).alias("type"), none.alias("uid")).cast(tree.META).alias("meta")
    nothing = (F.lit(None).cast("array<string>").alias("chunks"), none.cast("string").alias("file_hash"), F.lit("").alias("content"))
    content = F.concat_ws("|", "c_name", "c_mktsegment")
    own = customer.join(nations, customer.c_nationkey == nations.n_nationkey)
    sha = F.sha2(content, 256)
    leaves = own.select(F.concat_ws("/", "folder", "c_name").alias("path"), meta("file", F.octet_length(content)), F.array(sha).alias("chunks"), sha.alias("file_hash"), content.alias("content"))
    dirs = region.select(F.col("r_name").alias("path")).unionAll(nations.select(F.col("folder").alias("path")))
    return leaves.unionAll(dirs.select("path", meta("dir", none), *nothing))


def _tree(spark, sf_dir):
    nodes, root = tree.build(tree_entries(spark, sf_dir).drop("content"))
    return cut(tree.entries_of(nodes)), root, nodes


def tree_nodes(spark, sf_dir):
    nodes, _ = tree.build(tree_entries(spark, sf_dir).drop("content"))
    return nodes.select("node_id", F.octet_length("payload").cast("long").alias("bytes"))


def walk_paths(spark, sf_dir):
    entries, root, _ = _tree(spark, sf_dir)
    return tree.walk(entries, root).select("path", F.col("depth").cast("long").alias("depth"), F.col("meta.type").alias("type"), "status")


def navigate_path(spark, sf_dir):
    entries, root, _ = _tree(spark, sf_dir)
    path = tree_entries(spark, sf_dir).where(F.col("meta.type") == "file").agg(F.min("path")).first()[0]
    return tree.navigate(entries, root.first().node_id, path).select("name", F.col("meta.size").alias("size"), "file_hash")


def reachable_ids(spark, sf_dir):
    entries, root, _ = _tree(spark, sf_dir)
    top = entries.join(root, "node_id", "left_semi").orderBy("name").limit(2).select(F.col("tree").alias("node_id"))
    return tree.reachable(entries, top)


def _damaged(spark, sf_dir):
    """The tree's entries with nodes lost (ids that end in 0 to 3) and broken (4 or 5), but for the root; and the root."""
    nodes, root = tree.build(tree_entries(spark, sf_dir).drop("content"))
    root = cut(root)
    last, top = F.substring("node_id", -1, 1), F.col("node_id") == root.first().node_id
    left = nodes.where(top | ~last.isin("0", "1", "2", "3")).withColumn("payload", F.when(~top & last.isin("4", "5"), F.lit('{"entries":')).otherwise(F.col("payload")))
    return cut(tree.entries_of(left)), root


def check_nodes(spark, sf_dir):
    entries, root = _damaged(spark, sf_dir)
    return tree.faults(entries, tree.reachable_nodes(entries, root))


def snapshot_list(spark, sf_dir):
    return snapshots.listed(runs(spark, sf_dir))


def snapshot_latest(spark, sf_dir):
    return snapshots.latest(runs(spark, sf_dir))


def resolve_prefix(spark, sf_dir):
    refs = spark.range(16).select(identity.to_hex(F.col("id")).alias("ref"))
    return snapshots.matches(runs(spark, sf_dir), refs)


def forget(spark, sf_dir):
    return kept_runs(spark, sf_dir)


def gc_live_dead(spark, sf_dir):
    return gc.live_dead(located(spark, sf_dir), live(spark, sf_dir))


def gc_plan(spark, sf_dir):
    entries = cut(located(spark, sf_dir))
    return gc.plan(entries, live(spark, sf_dir), blobs_of(entries))


def _known(spark, sf_dir):
    """All entries, and those of the packs that hold a chunk of the latest run."""
    entries = cut(located(spark, sf_dir))
    last = whole(spark, sf_dir).join(snapshots.latest(runs(spark, sf_dir)).select(F.col("source_path").alias("source")), "source", "left_semi").select("chunk_id").distinct()
    return entries, entries.join(index.has(entries, last).select("pack_id").distinct(), "pack_id", "left_semi").select(*entries.columns)


def gc_orphans(spark, sf_dir):
    """The plan if no pack were indexed but those that hold a chunk of the latest run."""
    entries, known = _known(spark, sf_dir)
    return gc.plan(known, live(spark, sf_dir), blobs_of(entries), entries)


def gc_stats(spark, sf_dir):
    return gc.stats(gc_plan(spark, sf_dir))


def _kept_index(spark, sf_dir):
    """All entries, and those of the live chunks."""
    entries = cut(located(spark, sf_dir))
    return entries, index.has(entries, live(spark, sf_dir))


def check_missing(spark, sf_dir):
    _, kept = _kept_index(spark, sf_dir)
    return verify.missing_chunks(whole(spark, sf_dir), kept)


def check_orphans(spark, sf_dir):
    entries, known = _known(spark, sf_dir)
    return verify.orphan_packs(known, blobs_of(entries))


def _short(blobs: DataFrame) -> DataFrame:
    """Packs that lost their last tenth."""
    return blobs.withColumn("size", F.floor(F.col("size") * 9 / 10).cast("long"))


def check_geometry(spark, sf_dir):
    entries, _ = _kept_index(spark, sf_dir)
    return verify.bad_geometry(entries, _short(blobs_of(entries))).select("chunk_id", "pack_id", "offset", "length", "size")


def check_missing_packs(spark, sf_dir):
    entries, known = _known(spark, sf_dir)
    return verify.missing_packs(entries, blobs_of(known))


def check_report(spark, sf_dir):
    """With short packs, and with those whose id begins with 0 lost."""
    entries, kept = _kept_index(spark, sf_dir)
    return verify.report(whole(spark, sf_dir), kept, _short(blobs_of(entries)).where(~F.col("pack_id").startswith("0")))


def aead_roundtrip(spark, sf_dir):
    key = F.lit(KEY)
    own = whole(spark, sf_dir)
    sealed = cut(own.select("doc_id", "chunk_id", "length", codec.seal(F.col("content"), key, F.col("chunk_id").cast("binary")).alias("blob")))
    plain = codec.unseal(F.col("blob"), key, F.col("chunk_id").cast("binary"))
    return sealed.select(
        "doc_id",
        identity.chunk_id(plain).alias("chunk_id"),
        (F.octet_length("blob") - F.col("length")).cast("long").alias("overhead"),
        codec.unseal(F.col("blob"), key, F.lit(b"other")).isNull().alias("other_aad_fails"),
    )


def frame_roundtrip(spark, sf_dir):
    framed = cut(files(spark, sf_dir).select("doc_id", "content", codec.compress(F.col("content")).alias("frame")))
    plain = codec.decompress(F.col("frame"))
    return framed.select("doc_id", identity.chunk_id(plain).alias("chunk_id"), (F.octet_length("frame") <= F.octet_length("content") + 1).alias("bounded"))


def deep_check(spark, sf_dir):
    """Every stored chunk as it should be, and damaged in each way that a deep check tells apart."""
    key, own = F.lit(KEY), whole(spark, sf_dir).dropDuplicates(["chunk_id"]).select("chunk_id", "content")
    ident = F.col("chunk_id").cast("binary")
    frame = codec.compress(F.col("content"))
    sealed = cut(own.select("chunk_id", codec.seal(frame, key, ident).alias("good"), codec.seal(frame, key, F.lit(b"other")).alias("other"), codec.seal(F.lit(b"\x07x"), key, ident).alias("frame"), codec.seal(F.concat(F.lit(b"\x00!"), F.col("content")), key, ident).alias("wrong")))
    kinds = {
        "good": F.col("good"),
        "other_aad": F.col("other"),
        "truncated": F.substring("good", 1, 20),
        "bad_frame": F.col("frame"),
        "other_content": F.col("wrong"),
        "absent": F.lit(None).cast("binary"),
    }
    rows = sealed.select("chunk_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("blob")) for k, v in kinds.items()])).alias("x")).select("chunk_id", "x.*")
    return rows.select("chunk_id", "kind", verify.deep_status(F.col("blob"), key, F.col("chunk_id")).alias("status"))


def _pack_files(spark, sf_dir):
    """Where each chunk lies, with its pack's id as bytes tell, and the pack files (name, content)."""
    own = packed(spark, sf_dir).join(whole(spark, sf_dir).dropDuplicates(["chunk_id"]).select("chunk_id", F.col("content").alias("blob")), "chunk_id")
    own = cut(own.select("pack_no", "offset", "length", "chunk_id", "blob"))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("offset", "chunk_id", "blob"))), lambda x: F.struct(x["chunk_id"], x["blob"]))
    built = own.groupBy("pack_no").agg(entries.alias("e")).select("pack_no", source_files.pack_bytes(F.col("e")).alias("content"))
    built = cut(built.withColumn("pack_id", F.sha2("content", 256)))
    return own.drop("blob").join(built.select("pack_no", "pack_id"), "pack_no"), built.select(identity.pack_name(F.col("pack_id")).alias("name"), "content")


def rebuild_index(spark, sf_dir):
    """Pack files are written as bytes and read back from their headers alone."""
    return source_files.pack_entries(_pack_files(spark, sf_dir)[1]).select("chunk_id", "offset", "length", "status")


def range_reads(spark, sf_dir):
    """Every chunk by its place in its pack file, and by one that ends beyond the file."""
    at, packs = _pack_files(spark, sf_dir)
    read = source_files.read_ranges(at.select("chunk_id", "pack_id", "offset", "length"), packs)
    beyond = source_files.read_ranges(at.select("chunk_id", "pack_id", (F.col("offset") + 1_000_000_000).alias("offset"), "length"), packs)
    both = read.select("chunk_id", "blob").join(beyond.select("chunk_id", F.col("blob").isNull().alias("beyond_is_null")), "chunk_id")
    return both.select("chunk_id", identity.chunk_id(F.col("blob")).alias("read_id"), "beyond_is_null")


def restore_file(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), F.encode("text", "UTF-8").alias("data"))
    expected = chunking.content_hash(own, ["conv_id"], "seq", "data").join(own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_chunks")), "conv_id")
    return restore.reassemble(own, ["conv_id"], expected).select("conv_id", F.octet_length("content").cast("long").alias("bytes"), "file_hash", "status")


def restore_tree(spark, sf_dir):
    entries, root, _ = _tree(spark, sf_dir)
    walked = cut(tree.walk(entries, root))
    store = tree_entries(spark, sf_dir).where(F.col("content") != "").select(F.sha2("content", 256).alias("chunk_id"), F.col("content").cast("binary").alias("data")).dropDuplicates(["chunk_id"])
    parts = tree.file_chunks(walked).join(store, "chunk_id", "left").select("path", "seq", "data")
    expected = walked.where(F.col("meta.type") == "file").select("path", "file_hash", F.size("chunks").alias("n_chunks"))
    return restore.reassemble(parts, ["path"], expected).select("path", F.col("content").cast("string").alias("content"), "status")


def restore_report(spark, sf_dir):
    """What a restore of the damaged tree would report, with chunks lost (ids that end in 6) and changed (7)."""
    entries, root = _damaged(spark, sf_dir)
    walked = cut(tree.walk(entries, root))
    content = F.when(F.col("chunk_id").endswith("7"), F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    store = tree_entries(spark, sf_dir).where(F.col("content") != "").select(F.sha2("content", 256).alias("chunk_id"), "content").where(~F.col("chunk_id").endswith("6"))
    store = store.dropDuplicates(["chunk_id"]).select("chunk_id", content.cast("binary").alias("data"))
    parts = tree.file_chunks(walked).join(store, "chunk_id", "left").select("path", "seq", "data")
    is_file = (F.col("status") == "OK") & (F.col("meta.type") == "file")
    done = restore.reassemble(parts, ["path"], walked.where(is_file).select("path", "file_hash", F.size("chunks").alias("n_chunks")))
    none = F.lit(None).cast("string").alias("warning")
    rest = walked.where(~is_file).select("path", F.col("meta.type").alias("type"), F.lit(0).cast("long").alias("bytes"), "status", none)
    return restore.report(done.select("path", F.lit("file").alias("type"), F.octet_length("content").cast("long").alias("bytes"), "status", none).unionByName(rest))


def scan_report(spark, sf_dir):
    """Documents as files; those in Spanish as links, and those under 100 characters as files that can't be read."""
    own = table(spark, sf_dir, "documents")
    kind, reason = F.when(F.col("lang") == "es", "symlink").otherwise("file"), F.when(F.coalesce("n_chars", F.lit(0)) < 100, F.lit("no permission"))
    leaf = own.select(kind.alias("type"), F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("size"), reason.alias("reason"))
    dirs = own.select("source").distinct().select(F.lit("dir").alias("type"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("reason"))
    return source_files.report(leaf.unionAll(dirs))


def blob_names(spark, sf_dir):
    """Which of the pages' paths are legal blob names and entry names, and what packs would be called."""
    own = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).alias("path"))
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    pack = identity.pack_name(F.sha2("path", 256))
    return own.select("page_id", identity.legal_blob_name(F.col("path").substr(F.lit(2), F.length("path"))).alias("blob"), identity.legal_entry_name(base).alias("entry"), identity.pack_id_of(pack).alias("pack_id"), identity.pack_id_of(F.col("path")).isNull().alias("foreign"))


NAMES = """
chunk_identity hex_ids small_file_chunks cdc_chunks cdc_chunks_small dedup_report new_chunks_per_run dedup_hits fresh_chunks
chunk_offsets file_hash pack_assignment pack_directory index_last_wins index_remove locate exclude_glob tree_nodes walk_paths
navigate_path reachable_ids snapshot_list snapshot_latest resolve_prefix forget gc_live_dead gc_plan gc_orphans gc_stats
check_missing check_orphans check_geometry check_missing_packs check_report check_nodes aead_roundtrip frame_roundtrip deep_check
rebuild_index range_reads restore_file restore_tree restore_report scan_report blob_names
backup_snapshots restore_cycle restore_path restore_damaged prune_cycle scan_folder
""".split()
QUERIES = {name: globals()[name] for name in NAMES}
