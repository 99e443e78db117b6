"""Benchmark decontamination by a seed join and greedy string tiling.

Words, in lower case, are 64-bit hashes. A document and an item that share a seed, a run of LEAST
words, are a candidate pair. For a pair, windows of a search length are hashed by running
Karp-Rabin on both sides; equal windows are compared word by word and drawn out to maximal
matches of words not yet marked; the longest are marked first, without overlap; then the search
length falls, down to LEAST. The share of the item's words that the marked tiles cover tells a
leak, whatever the order of the pieces: from COVERAGE on, the document is contaminated.

1. The seeds of all items set bits in a map of MAP_BITS bits, 8 MB whatever the size of the
   benchmark, which is broadcast.
2. One pass over the documents keeps, of each, the runs of words whose seeds are in the map, with
   a 0 where words were left out. Tiles can lie nowhere else. Documents without such a run are
   done; the texts themselves never move.
3. The documents' seeds are joined to the items' seeds, rare ones first: seeds are counted over
   the documents, and each item is found by its rarest seeds alone. Tiles that cover enough of
   an item of n words hold at least k = ceil(COVERAGE n / LEAST) of its seeds' places (a tile of
   t words holds t - LEAST + 1, never less than t / LEAST), so that all but the k - 1 most
   frequent places decide.
   Hot seeds are thus not joined, and those that are left are split where they are skewed.
4. Pairs meet the runs of their document: each document's runs are sent once, its items come
   one by one, and only the part of the runs that shares seeds with the item is tiled.

Nothing is collected, and the plan is the same for any benchmark. Map bits that two seeds share
only make a run longer; seeds are compared in full by the join and words by the tiling.

Cases: null or empty texts match nothing; items of fewer than LEAST words can't be told from
common speech and match nothing; every row of either table counts by itself, so that repeated
documents and items are reported as often as they stand there; an empty benchmark or table gives
no rows; other columns are ignored, or passed through by `screen`, which judges rows equal in
doc_id and text alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workers import let_workers_import
from .common import WordHashes, cut, joined_anew, table

LEAST, COVERAGE = 5, 0.6
#: Bits of the map of seeds, and of one row of it.
MAP_BITS, ROW_BITS = 1 << 26, 1 << 15
#: So many contaminated documents, 40 MB at most, are broadcast by `screen`; more are joined by a shuffle.
MANY = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
_WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


class Rolling:
    """Karp-Rabin sums of an array, modulo 2^64: the hash of any window of any length."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE)], dtype=np.uint64)
            # Scaling each word by its own power makes the running sum a plain one.
            self.total = np.r_[np.uint64(0), np.cumsum(ids.astype(np.uint64) * self.power[:n], dtype=np.uint64)]

    def windows(self, size: int, span: int) -> np.ndarray:
        """Hashes of all windows of the size, brought to the same power `span`."""
        n = len(self.total) - size
        with np.errstate(over="ignore"):
            scale = np.cumprod(np.r_[np.uint64(1), np.full(span, BASE)], dtype=np.uint64)
            return (self.total[size:] - self.total[:n]) * scale[span - np.arange(n)]


def _whole(free: np.ndarray, size: int) -> np.ndarray:
    """Where a window of the size is free throughout."""
    run = np.r_[0, np.cumsum(free)]
    return run[size:] - run[:-size] == size if len(free) >= size else np.zeros(0, bool)


def tile(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length) of greedy string tiling. Word 0 matches nothing."""
    tiles: list[tuple[int, int, int]] = []
    if len(item) < least or len(text) < least:
        return tiles
    free_i, free_t = item != 0, text != 0
    span = max(len(item), len(text))
    roll_i, roll_t = Rolling(item), Rolling(text)
    size = max(least, min(len(item), 32))
    while True:
        at_i, at_t = np.flatnonzero(_whole(free_i, size)), np.flatnonzero(_whole(free_t, size))
        found: list[tuple[int, int, int]] = []
        if len(at_i) and len(at_t):
            hash_i, hash_t = roll_i.windows(size, span)[at_i], roll_t.windows(size, span)[at_t]
            order = np.argsort(hash_i, kind="stable")
            lo, hi = (np.searchsorted(hash_i[order], hash_t, side) for side in ("left", "right"))
            for t, a, b in zip(at_t[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for i in at_i[order[a:b]].tolist():
                    if i and t and free_i[i - 1] and free_t[t - 1] and item[i - 1] == text[t - 1]:
                        continue  # the match that begins one word before holds this one
                    most = min(len(item) - i, len(text) - t)
                    same = (item[i : i + most] == text[t : t + most]) & free_i[i : i + most] & free_t[t : t + most]
                    n = most if same.all() else int(same.argmin())
                    if n >= size:
                        found.append((-n, i, t))
        longest = -min(found)[0] if found else 0
        if longest > 2 * size:
            size = longest
            continue
        for n, i, t in sorted(x for x in found if -x[0] == longest):
            if free_i[i : i - n].all() and free_t[t : t - n].all():
                free_i[i : i - n] = free_t[t : t - n] = False
                tiles.append((i, t, -n))
        if found:
            continue  # shorter matches may be partly covered by now, and are found anew
        if size == least:
            return sorted(tiles)
        size = max(least, size // 2)


def seeds_of(ids: np.ndarray, least: int) -> np.ndarray:
    """The hash of every window of `least` words."""
    n = max(len(ids) - least + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(least if n else 0):
            out = out * BASE + ids[k : k + n]
        out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)


def place_of(seed: np.ndarray) -> np.ndarray:
    """The bit of a seed in the map."""
    return (seed >> np.uint64(64 - (MAP_BITS - 1).bit_length())).astype(np.int64)


def runs_of(ids: np.ndarray, hit: np.ndarray, least: int) -> np.ndarray:
    """The words that lie in hit windows, with a 0 before each run."""
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + least, -1)
    inside = np.cumsum(cover[:-1]) > 0
    starts = inside & ~np.r_[False, inside[:-1]]
    place = np.flatnonzero(inside)
    return np.insert(ids[place], np.flatnonzero(starts[place]), np.uint64(0))


def items_of(benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """item (a number for each row), item_id, words and places (the seed of each window) of items that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            own = [words.of(words_of(t)) for t in batch.column("text").to_pylist()]
            found = [seeds_of(w, least).view(np.int64) for w in own]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([w.tobytes() for w in own], pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["item_id", "words", "places"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    made = benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, words binary, places array<bigint>")
    return cut(made.where(F.size("places") > 0).withColumn("item", F.monotonically_increasing_id()))


def seed_map(items: DataFrame) -> np.ndarray:
    """The map of all items' seeds, made in rows of ROW_BITS by the executors: 8 MB at most come to the driver."""
    place = F.shiftrightunsigned("seed", 64 - (MAP_BITS - 1).bit_length())
    rows = items.select(F.explode("places").alias("seed")).select(place.alias("p"))
    # Buckets of positive numbers count from 1, and so do their first numbers.
    rows = rows.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for r in rows.collect():
        at = (r.row - 1) * ROW_BITS // 8
        out[at : at + ROW_BITS // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def suspects(docs: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """doc (a number for each row), doc_id, text_hash, runs and seeds (distinct) of documents with a seed in the map."""
    sent = docs.sparkSession.sparkContext.broadcast(seed_map(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = WordHashes(), sent.value
        for batch in batches:
            rows, runs, seeds = [], [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                ids = words.of(words_of(text))
                every = seeds_of(ids, least)
                place = place_of(every)
                hit = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0
                if hit.any():
                    rows.append(n)
                    runs.append(runs_of(ids, hit, least).tobytes())
                    seeds.append(np.unique(every[hit]).view(np.int64))
            if rows:
                kept = batch.select(["doc_id", "text_hash"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(runs, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))], ["doc_id", "text_hash", "runs", "seeds"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", text_hash().alias("text_hash"), "text")
    made = own.mapInArrow(run, f"doc_id {kind}, text_hash binary, runs binary, seeds array<bigint>")
    return cut(made.withColumn("doc", F.monotonically_increasing_id()))


def text_hash():
    return F.unhex(F.md5(F.encode("text", "UTF-8")))


def candidates(found: DataFrame, items: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The distinct (doc, item) that share one of the item's rarest seeds."""
    said = found.select("doc", F.explode("seeds").alias("seed"))
    often = said.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    places = items.select("item", (F.octet_length("words") / 8).cast("int").alias("n_words"), F.posexplode("places").alias("at", "seed"))
    counted = joined_anew(places, often, ["seed"])  # seeds that no document holds are rarest, and find nothing
    k = F.greatest(F.ceil(F.ceil(F.col("n_words") * coverage - 1e-9) / least).cast("int"), F.lit(1))
    rarest = Window.partitionBy("item").orderBy("n", "seed", "at")
    absent = F.col("n_words") - (least - 1) - F.count(F.lit(1)).over(Window.partitionBy("item"))
    index = counted.withColumns({"r": F.row_number().over(rarest), "absent": absent, "k": k})
    index = index.where(F.col("r") + F.col("absent") <= F.col("n_words") - (least - 1) - (F.col("k") - 1)).select("seed", "item").distinct()
    return joined_anew(said, index, ["seed"]).select("doc", "item").distinct()


class Held:
    """The runs of one document, with their seeds in order."""

    def __init__(self, runs: bytes, least: int):
        self.ids, self.least = np.frombuffer(runs, np.uint64), least
        seeds = seeds_of(self.ids, least)
        at = np.flatnonzero(_whole(self.ids != 0, least))
        order = at[np.argsort(seeds[at], kind="stable")]
        self.at, self.seeds = order, seeds[order]

    def part(self, item: np.ndarray) -> np.ndarray:
        """The words that lie in windows that the item has too."""
        own = np.unique(seeds_of(item, self.least))
        lo, hi = (np.searchsorted(self.seeds, own, side) for side in ("left", "right"))
        hit = np.zeros(max(len(self.ids) - self.least + 1, 0), bool)
        for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            hit[self.at[a:b]] = True
        return runs_of(self.ids, hit, self.least)


def tiled_pairs(pairs: DataFrame, found: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """doc, item, n_tiles, n_covered and n_item_words of the contaminated pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held = None, None
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for d, i, blob in zip(*(batch.column(c).to_pylist() for c in ("doc", "item", "words")), strict=True):
                if i < 0:  # a document's runs come before its items
                    doc, held = d, Held(blob, least)
                    continue
                assert d == doc
                item = np.frombuffer(blob, np.uint64)
                part = held.part(item)
                if np.count_nonzero(part) < coverage * len(item):
                    continue  # tiles don't overlap in the text either
                tiles = tile(item, part, least)
                covered = sum(t[2] for t in tiles)
                if covered >= coverage * len(item):
                    out.append((d, i, len(tiles), covered, len(item)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 5)], ["doc", "item", "n_tiles", "n_covered", "n_item_words"])

    asked = joined_anew(pairs, items.select("item", "words"), ["item"])
    first = found.select("doc", F.lit(-1).cast("long").alias("item"), F.col("runs").alias("words")).join(pairs.select("doc").distinct(), "doc", "left_semi")
    both = first.unionByName(asked.select("doc", "item", "words"))
    return both.repartition("doc").sortWithinPartitions("doc", "item").mapInArrow(run, "doc long, item long, n_tiles long, n_covered long, n_item_words long")


def leaks(docs: DataFrame, benchmark: DataFrame, least: int, coverage: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contaminated pairs, suspects, items)."""
    let_workers_import(docs.sparkSession)
    items = items_of(benchmark, least)
    found = suspects(docs, items, least)
    pairs = cut(candidates(found, items, least, coverage))
    return cut(tiled_pairs(pairs, found, items, least, coverage)), found, items


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document and benchmark item that it holds, with how much of the item."""
    bad, found, items = leaks(docs, benchmark, least, coverage)
    named = bad.join(found.select("doc", "doc_id"), "doc").join(items.select("item", "item_id"), "item")
    return named.select("doc_id", "item_id", "n_tiles", "n_covered", "n_item_words", (F.col("n_covered") / F.col("n_item_words")).alias("coverage"))


def screen(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    bad, found, _ = leaks(docs, benchmark, least, coverage)
    gone = found.join(bad.select("doc").distinct(), "doc", "left_semi").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__g")).distinct()
    gone = cut(gone)
    gone = F.broadcast(gone) if gone.count() <= MANY else gone
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__d")) & (text_hash() == F.col("__g")), "left_anti")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
