"""Token counts by rank-synchronous merging of ragged numpy arrays.

The pre-tokens of a batch of texts that weren't met lately lie end to end in one array of
symbols. Each round finds the rank of every adjacent pair, the lowest rank of each
pre-token, and merges every pair of that rank in all pre-tokens at once (in a run of equal
symbols every other pair, from the left). When no pair is left, the symbols that survive in
each pre-token are its tokens. As a pair's merge is always learnt after the pair's own
parts, merging all pairs of the lowest rank together equals merging them one by one.

A pre-token of more than LONG bytes has too many ranks for rounds over all its symbols. There
the places of each rank are kept in lists, and a round only touches the pairs that it merges
and their neighbours; the ranks rise from round to round by the same argument.

Cases: a null or empty text has 0 bytes and 0 tokens; special strings inside a text are one
token each; repeated rows are counted alike; other columns are ignored; memory is bounded by
the longest text and by CACHE pre-tokens.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workers import let_workers_import
from . import vocab as V
from .common import table

CACHE = 700_000
LIMIT, LONG = 2048, 512


def count_merged(words: list[bytes], v: V.Vocabulary) -> np.ndarray:
    """How many tokens each word, not empty, is merged to."""
    length = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(length) - 1
    symbol = v.first[flat]
    symbol[ends] = v.last[flat[ends]]
    owner = np.repeat(np.arange(len(words)), length)
    count = np.ones(len(words), np.int64)
    while len(symbol) > 1:
        rank, merged = v.rank(symbol[:-1], symbol[1:])
        rank = np.where(owner[:-1] == owner[1:], rank, V.NO_RANK)
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        size = np.diff(np.r_[start, len(owner)])
        lowest = np.minimum.reduceat(np.r_[rank, V.NO_RANK], start)
        going = lowest != V.NO_RANK
        count[owner[start]] = size
        if not going.any():
            break
        at = np.flatnonzero((rank == np.repeat(lowest, size)[:-1]) & (rank != V.NO_RANK))
        new_run = np.r_[True, np.diff(at) != 1]
        run_start = np.flatnonzero(new_run)
        offset = np.arange(len(at)) - np.repeat(run_start, np.diff(np.r_[run_start, len(at)]))
        at = at[offset % 2 == 0]
        symbol[at] = merged[at]
        stays = np.repeat(going, size)  # pre-tokens without a mergeable pair are done
        stays[at + 1] = False
        count[owner[start[going]]] = 0
        symbol, owner = symbol[stays], owner[stays]
    if len(symbol):
        np.maximum(count, np.bincount(owner, minlength=len(words)), out=count)
    return count


def count_long(word: bytes, v: V.Vocabulary) -> int:
    """How many tokens a long word is merged to: rank by rank, over lists of places."""
    n = len(word)
    symbol = v.first[np.frombuffer(word, np.uint8)]
    symbol[-1] = v.last[word[-1]]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    rank, merged = v.rank(symbol[:-1], symbol[1:])
    rank, merged = np.r_[rank, V.NO_RANK], np.r_[merged, 0]
    places: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def note(at: np.ndarray) -> None:
        """Lists the places by their rank."""
        own = rank[at]
        at = at[own != V.NO_RANK]
        if not len(at):
            return
        order = np.argsort(rank[at], kind="stable")
        at = at[order]
        own = rank[at]
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for r, lo, hi in zip(own[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
            if r not in places:
                places[r] = []
                heapq.heappush(ranks, r)
            places[r].append(at[lo:hi])

    note(np.arange(n - 1))
    left = n
    while ranks:
        r = heapq.heappop(ranks)
        listed = places.pop(r)
        at = np.unique(np.concatenate(listed)) if len(listed) > 1 else listed[0]
        at = at[rank[at] == r]  # others were merged away, or changed, since they were listed
        if not len(at):
            continue
        new_run = np.r_[True, after[at[:-1]] != at[1:]]
        run_start = np.flatnonzero(new_run)
        offset = np.arange(len(at)) - np.repeat(run_start, np.diff(np.r_[run_start, len(at)]))
        at = at[offset % 2 == 0]
        gone = after[at]
        symbol[at] = merged[at]
        rank[gone] = V.NO_RANK
        far = after[gone]
        after[at] = far
        inner = far < n
        before[far[inner]] = at[inner]
        left -= len(at)
        back = before[at]
        touched = np.unique(np.r_[at, back[back >= 0]])
        right = after[touched]
        open_ = right < n
        rank[touched[~open_]] = V.NO_RANK
        touched, right = touched[open_], right[open_]
        rank[touched], merged[touched] = v.rank(symbol[touched], symbol[right])
        note(touched)
    return left


class Counter:
    def __init__(self, blob: bytes):
        self.v, self.known = V.parsed(blob), {}

    def words(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and the number of special strings in it."""
        if "<|" not in text:
            return self.v.words(text), 0
        parts = self.v.special_split.split(text)
        return [w for p in parts[::2] for w in self.v.words(p)], len(parts) // 2

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.words(t) for t in texts]
        met = set().union(*[words for words, _ in cut])
        fresh = [*met.difference(self.known)]
        if len(self.known) + len(fresh) > CACHE:
            self.known, fresh = {}, [*met]
        if fresh:
            spelled = {w: w.encode() for w in fresh}
            short = [w for w, b in spelled.items() if len(b) <= LONG]
            if short:
                self.known.update(zip(short, count_merged([spelled[w] for w in short], self.v).tolist(), strict=True))
            self.known.update((w, count_long(b, self.v)) for w, b in spelled.items() if len(b) > LONG)
        return [sum(map(self.known.__getitem__, words)) + special for words, special in cut]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    let_workers_import(docs.sparkSession)
    blob = docs.sparkSession.sparkContext.broadcast(V.read(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(blob.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [c for g in V.groups(texts) for c in counter.counts(g)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text", n_bytes.alias("n_bytes")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
