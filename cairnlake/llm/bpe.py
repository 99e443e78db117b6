"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A leaf of the tree is a pair of neighbours, with its rank and place as one integer; an inner
node is the lesser of its children, so that the root is the leftmost pair of the lowest rank.
A merge links the right neighbour out, and updates at most three leaves, each on its way to
the root. The work ends when the root holds no rank. n bytes take O(n log n) steps even if
the whole text is a single pre-token. The trees of all pre-tokens of a batch that weren't met
lately are kept as numpy arrays, and merged in step; the tree of a pre-token of more than LONG
bytes, which would be nearly alone in its step, is worked on by itself.

Decoding joins the bytes of the ids and reads them as UTF-8, with U+FFFD for what isn't.

Cases: a null or empty text has no ids and decodes to an empty text; special strings inside
a text are their own id; repeated rows are encoded alike; other columns pass through, and
ones named like an output are replaced; memory is bounded by the longest text and CACHE.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workers import let_workers_import
from . import vocab as V
from .common import hex_sha256, table

CACHE = 700_000
LONG = 512


class Trees:
    """The segment trees of many pre-tokens of similar length, worked on in step.

    Row w of each array is one pre-token: tree[w, 1] is its root, tree[w, wide + i] the leaf of
    the pair that begins at symbol i. Every round merges the root's pair in each row whose root
    holds one.
    """

    def __init__(self, words: list[bytes], v: V.Vocabulary):
        self.v, size = v, np.array([len(w) for w in words])
        most = int(size.max())
        self.wide = wide = 1 << (most - 2).bit_length() if most > 2 else 1
        flat = np.frombuffer(b"".join(words), np.uint8)
        row, ends = np.repeat(np.arange(len(words)), size), np.cumsum(size) - 1
        symbols = v.first[flat]
        symbols[ends] = v.last[flat[ends]]
        # Column wide + 1 stands for "no neighbour", at either side.
        self.ids = np.full((len(words), wide + 2), -1, np.int64)
        self.ids[row, np.arange(len(flat)) - (ends - size + 1)[row]] = symbols
        places = np.arange(wide + 2)
        self.after = np.where(places < size[:, None] - 1, places + 1, wide + 1)
        self.before = np.where(places > 0, places - 1, wide + 1) + np.zeros_like(self.after)
        self.none = np.int64(V.NO_RANK) * (wide + 1)
        self.tree = np.full((len(words), 2 * wide), self.none)
        self.merged = np.zeros((len(words), wide), np.int64)
        for i in range(wide):
            rows = np.flatnonzero(size > i + 1)
            self._pair(rows, np.full(len(rows), i), np.full(len(rows), i + 1))
        k = wide
        while k > 1:
            self.tree[:, k // 2 : k] = np.minimum(self.tree[:, k : 2 * k : 2], self.tree[:, k + 1 : 2 * k : 2])
            k //= 2

    def _pair(self, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Sets the leaf of symbol i, whose right neighbour is j, without its way to the root."""
        left, right = self.ids[rows, i], self.ids[rows, j]
        rank, merged = self.v.rank(np.maximum(left, 0), np.maximum(right, 0))
        there = (left >= 0) & (right >= 0) & (rank != V.NO_RANK)
        self.tree[rows, self.wide + i] = np.where(there, rank.astype(np.int64) * (self.wide + 1) + i, self.none)
        self.merged[rows, i] = merged

    def run(self) -> None:
        rows = np.arange(len(self.tree))
        while len(rows := rows[self.tree[rows, 1] < self.none]):
            i = self.tree[rows, 1] % (self.wide + 1)
            j = self.after[rows, i]
            k = self.after[rows, j]
            h = self.before[rows, i]
            self.ids[rows, i] = self.merged[rows, i]
            self.ids[rows, j] = -1
            self.after[rows, i] = k
            self.before[rows, k] = i
            self.before[rows, self.wide + 1] = self.wide + 1
            inner = np.flatnonzero(j < self.wide)  # the last symbol has no leaf
            self.tree[rows[inner], self.wide + j[inner]] = self.none
            back = np.flatnonzero(h <= self.wide)
            both, at = np.concatenate([rows, rows[back]]), np.concatenate([i, h[back]])
            self._pair(both, at, np.concatenate([k, i[back]]))
            r, at = np.concatenate([both, rows[inner]]), self.wide + np.concatenate([at, j[inner]])
            level = self.wide
            while level > 1:
                at >>= 1
                self.tree[r, at] = np.minimum(self.tree[r, 2 * at], self.tree[r, 2 * at + 1])
                level //= 2

    def encoded(self) -> list[bytes]:
        """The ids of each row, as the bytes of 32-bit integers."""
        left = self.ids >= 0
        flat = self.ids[left].astype(np.int32).tobytes()
        ends = (np.cumsum(left.sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def merge_long(word: bytes, v: V.Vocabulary) -> bytes:
    """The ids that one long word is merged to, by its own tree."""
    n = len(word)
    symbols = v.first[np.frombuffer(word, np.uint8)]
    symbols[-1] = v.last[word[-1]]
    wide = 1 << (n - 2).bit_length()
    none = V.NO_RANK * wide
    ranks, merged = v.rank(symbols[:-1], symbols[1:])
    whole = np.full(2 * wide, none, np.int64)
    whole[wide : wide + n - 1] = np.where(ranks == V.NO_RANK, none, ranks.astype(np.int64) * wide + np.arange(n - 1))
    k = wide
    while k > 1:
        whole[k // 2 : k] = np.minimum(whole[k : 2 * k : 2], whole[k + 1 : 2 * k : 2])
        k //= 2
    tree, ids, to = array("q", whole.tobytes()), array("q", symbols.astype(np.int64).tobytes()), array("q", np.r_[merged, 0].astype(np.int64).tobytes())
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    pairs = v.pairs

    def put(at: int, key: int) -> None:
        at += wide
        tree[at] = key
        while at > 1:
            other = tree[at ^ 1]
            at >>= 1
            low = key if key < other else other
            if tree[at] == low:
                return  # nothing changes further up
            tree[at] = key = low

    while (root := tree[1]) < none:
        i = root % wide
        j = after[i]
        k = after[j]
        ids[i], ids[j], after[i] = to[i], -1, k
        if j < n - 1:
            put(j, none)
        if k < n:
            before[k] = i
            found = pairs.get((ids[i], ids[k]))
            if found:
                to[i] = found[1]
            put(i, found[0] * wide + i if found else none)
        else:
            put(i, none)
        h = before[i]
        if h >= 0:
            found = pairs.get((ids[h], ids[i]))
            if found:
                to[h] = found[1]
            put(h, found[0] * wide + h if found else none)
    out = np.frombuffer(ids, np.int64)
    return out[out >= 0].astype(np.int32).tobytes()


def merge_all(words: list[bytes], v: V.Vocabulary) -> list[bytes]:
    """The ids that each word, not empty, is merged to; words of like length share trees."""
    out: list[bytes] = [b""] * len(words)
    by: dict[int, list[int]] = {}
    for n, w in enumerate(words):
        if len(w) > LONG:
            out[n] = merge_long(w, v)
            continue
        by.setdefault(max(len(w) - 2, 0).bit_length(), []).append(n)
    for width, own in by.items():
        step = max(1, (1 << 20) >> width)  # bounds the arrays
        for at in range(0, len(own), step):
            some = own[at : at + step]
            trees = Trees([words[n] for n in some], v)
            trees.run()
            for n, ids in zip(some, trees.encoded(), strict=True):
                out[n] = ids
    return out


class Codec:
    def __init__(self, blob: bytes):
        self.v = V.parsed(blob)
        self.own = {s: np.array([i], np.int32).tobytes() for s, i in self.v.special.items()}
        self.known = self.own.copy()

    def _words(self, text: str) -> list[str]:
        """Pre-tokens and special strings; no pre-token equals a special string, which has both letters and marks."""
        if "<|" not in text:
            return self.v.words(text)
        parts = self.v.special_split.split(text)
        return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self.v.words(p))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self._words(t) for t in texts]
        met = set().union(*cut)
        fresh = [*met.difference(self.known)]
        if len(self.known) + len(fresh) > CACHE:
            self.known = self.own.copy()
            fresh = [*met.difference(self.known)]
        if fresh:
            self.known.update(zip(fresh, merge_all([w.encode() for w in fresh], self.v), strict=True))
        of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(of, words)), np.int32) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.v.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, tokenizer_path: str, keep: tuple[str, ...] = ("doc_id",), decode: bool = True) -> DataFrame:
    """The columns in keep, ids (array<int>) and, with decode, decoded (the text read back from the ids)."""
    let_workers_import(docs.sparkSession)
    blob = docs.sparkSession.sparkContext.broadcast(V.read(tokenizer_path))
    kept = [c for c in keep if c not in ("ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(blob.value)
        for batch in batches:
            done, texts = 0, batch.column("__text").to_pylist()
            for group in V.groups(texts):
                ids = codec.encode(group)
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                own = [batch.column(c).slice(done, len(group)) for c in kept]
                done += len(group)
                read = [pa.array([codec.decode(x) for x in ids], pa.string())] if decode else []
                yield pa.RecordBatch.from_arrays([*own, lists, *read], [*kept, "ids", *["decoded"] * decode])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    sent = docs.select(*[f"`{c}`" for c in kept], F.col("text").alias("__text"))
    return sent.mapInArrow(run, ", ".join([*kinds, "ids array<int>", *["decoded string"] * decode]))


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, the number of ids, and digests of the ids and of the decoded text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), hex_sha256(F.col("decoded")).alias("decoded_sha256"))


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
