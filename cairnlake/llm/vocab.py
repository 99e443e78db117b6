"""Vocabulary files of byte-pair tokenizers, as plain tables.

A file is read once on the driver, at a path that the caller gives, and its bytes go to the
executors in one broadcast (a vocabulary has a fixed size of a few MB); each Python worker
parses them once. Nothing here trains a tokenizer.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

NO_RANK = np.iinfo(np.int32).max


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    out |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in out)}
    return [out[b] for b in range(256)]


def latin(pattern: str) -> re.Pattern:
    """The pattern for texts of Latin-1 characters alone, which the plain engine scans faster."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind)
    sets = {r"\p{L}": of("L"), r"\p{N}": of("N"), r"\s": r"\t\n\v\f\r \x85\xa0"}
    out, inside = "", False
    for piece in re.findall(r"\\p\{.\}|\\.|.", pattern):
        if piece in sets:
            piece = sets[piece] if inside else f"[{sets[piece]}]"
        elif piece == r"\S":
            piece = f"[^{sets[chr(92) + 's']}]"
        inside = piece == "[" or inside and piece != "]"
        out += piece
    return re.compile(out)


class Vocabulary:
    """What a tokenizer file says: ids, merges by rank, special strings, splitting pattern."""

    #: Fixed value: the usual splitting pattern of byte-level tokenizers.
    BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, blob: bytes):
        said = json.loads(blob)
        self._said, self._tokenizer = blob.decode(), None
        model = said["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.folds = "Lowercase" in json.dumps(said.get("normalizer"))
        splits = [p["pattern"]["Regex"] for p in (said["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.latin = latin(splits[0] if splits else self.BYTE_LEVEL)
        symbols = byte_symbols()
        self.first = np.array([self.vocab[s] for s in symbols], np.int32)
        self.last = np.array([self.vocab[s + self.suffix] for s in symbols], np.int32)
        self._back = back = {s: b for b, s in enumerate(symbols)}
        self.bytes_of = [b""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for s, i in self.vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in s.removesuffix(self.suffix))
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        keys = np.array([a * len(self.bytes_of) + b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        ranked = np.array(list(self.pairs.values()), np.int64).reshape(-1, 2)
        self.ranks, self.merged = ranked[order, 0].astype(np.int32), ranked[order, 1].astype(np.int32)

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings, normalised as the file says.

        Texts of Latin-1 characters are composed already, and lower case one by one; for any
        other text the library's own normalizer and splitter follow its Unicode version.
        """
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            library = self._library()
            if library.normalizer:
                text = library.normalizer.normalize_str(text)
            back = self._back
            return [bytes(back[c] for c in w).decode() for w, _ in library.pre_tokenizer.pre_tokenize_str(text)]
        return self.latin.findall(text.lower() if self.folds else text)

    def _library(self):
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_str(self._said)
        return self._tokenizer

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of adjacent pairs, NO_RANK if they don't merge, and what they merge to."""
        want = left.astype(np.int64) * len(self.bytes_of) + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        known = self.keys[at] == want
        return np.where(known, self.ranks[at], NO_RANK), self.merged[at]


@lru_cache(maxsize=4)
def parsed(blob: bytes) -> Vocabulary:
    return Vocabulary(blob)


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def groups(texts: list, most: int = 1 << 21):
    """Runs of texts of about `most` characters, so that lists of tokens stay small."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run
