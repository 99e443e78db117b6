"""Packs: runs of chunks in order, closed once they hold the target size.

The rule is a fold: a pack's size starts at the header, each chunk adds its entry header and its
length, and the chunk that brings the size to the target or beyond closes the pack. `assign`
works it out without a single writer. Rows are range-partitioned by the order, and every
partition reports, for each size that a pack may already have when the partition begins, how
many packs end in it and what size it leaves open. That answer only depends on the place of
the first cut, of which there are at most as many as chunks fit in one pack; first cuts that
come to the same end, as most do once a few packs are closed, are one line of the report. The
driver chains the reports in order, one at a time, and keeps two numbers for each partition, its
start; the partitions then fold on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workers import let_workers_import
from ..schemas import ENTRY_HEADER, PACK_HEADER
from .state import cut

TARGET = 64 << 20


def fold(lengths: np.ndarray, target: int, size: int = PACK_HEADER) -> tuple[np.ndarray, int]:
    """The number of the pack, within the fold, of each chunk, and the size left open."""
    if not len(lengths):
        return np.zeros(0, np.int64), size
    total = np.cumsum(lengths + ENTRY_HEADER)
    cuts, base = [], 0
    while True:
        k = int(np.searchsorted(total, target - size + base))
        if k >= len(total):
            break
        cuts.append(k)
        base, size = int(total[k]), PACK_HEADER
    pack = np.zeros(len(lengths), np.int64)
    pack[[k + 1 for k in cuts if k + 1 < len(pack)]] = 1
    return np.cumsum(pack), size + int(total[-1]) - base


def report(lengths: np.ndarray, target: int) -> tuple[list[int], list[int], list[int]]:
    """For each possible first cut: bytes up to it, packs ended in all, and the size left open."""
    n = len(lengths)
    total = np.cumsum(lengths + ENTRY_HEADER)
    packs, left = np.zeros(n + 1, np.int64), np.full(n + 1, PACK_HEADER, np.int64)
    after = np.searchsorted(total, target - PACK_HEADER + np.r_[0, total])
    for i in range(n - 1, -1, -1):  # a pack that begins at chunk i is cut after chunk after[i]
        k = int(after[i])
        if k < n:
            packs[i], left[i] = packs[k + 1] + 1, left[k + 1]
        else:
            left[i] = PACK_HEADER + total[-1] - (total[i - 1] if i else 0)
    firsts = np.arange(n)[: int(np.searchsorted(total, target - PACK_HEADER)) + 1]
    ended, rest = packs[firsts + 1] + 1, left[firsts + 1]
    # Of first cuts in a row with one outcome, the last stands for all.
    last = np.flatnonzero(np.r_[(np.diff(ended) != 0) | (np.diff(rest) != 0), np.ones(min(len(firsts), 1), bool)])
    return total[firsts][last].tolist(), ended[last].tolist(), rest[last].tolist()


def assign(chunks: DataFrame, order: list[str], length: str = "length", target: int = TARGET) -> DataFrame:
    """chunks with pack_no (gapless from 0) and the blob's offset in its pack, by the fold over order.

    order must be unique. Null lengths count as 0. An empty table gives no rows.
    """
    let_workers_import(chunks.sparkSession)
    sized = chunks.withColumn("__n", F.coalesce(F.col(length).cast("long"), F.lit(0).cast("long")))
    parts = cut(sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__place", 33).cast("int")))
    slim = parts.select("__part", "__place", "__n").repartition("__part").sortWithinPartitions("__part", "__place")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Whole parts, one after the other: 16 bytes a chunk."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            some = [b.column(c).to_numpy(zero_copy_only=False) for c in ("__part", "__place", "__n")]
            edges = np.flatnonzero(np.diff(some[0])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(some[0])], strict=True):
                if held and lo < hi and held[0][0][0] != some[0][lo]:
                    yield int(held[0][0][0]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
                    held = []
                if lo < hi:
                    held.append(tuple(x[lo:hi] for x in some))
        if held:
            yield int(held[0][0][0]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])

    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, n in runs(batches):
            upto, packs, left = report(n, target)
            total = int((n + ENTRY_HEADER).sum())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total], pa.int64()), *[pa.array([x], pa.list_(pa.int64())) for x in (upto, packs, left)]], ["part", "total", "upto", "packs", "left"])

    starts, pack, size = {}, 0, PACK_HEADER
    said = slim.mapInArrow(reports, "part int, total long, upto array<long>, packs array<long>, left array<long>")
    for r in cut(said).orderBy("part").toLocalIterator():
        starts[r.part] = (pack, size)
        k = int(np.searchsorted(r.upto, target - size)) if r.upto else 0
        if r.upto and k < len(r.upto):
            pack, size = pack + r.packs[k], r.left[k]
        else:
            size += r.total

    def folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, place, n in runs(batches):
            first, open_size = starts[part]
            number, _ = fold(n, target, open_size)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(number + first)], ["__place", "pack_no"])

    numbered = slim.mapInArrow(folds, "__place long, pack_no long")
    packed = parts.join(numbered, "__place")
    before = Window.partitionBy("pack_no").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    offset = PACK_HEADER + ENTRY_HEADER + F.coalesce(F.sum(F.col("__n") + ENTRY_HEADER).over(before), F.lit(0))
    return packed.withColumn("offset", offset.cast("long")).drop("__n", "__part", "__place")


def directory(entries: DataFrame, pack: str = "pack_id") -> DataFrame:
    """pack, its number of entries, bytes of blobs, and size as written."""
    return entries.groupBy(pack).agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum("length").cast("long").alias("blob_bytes"),
        F.max(F.col("offset") + F.col("length")).cast("long").alias("size"),
    )


def offsets(parts: DataFrame, keys: list[str], order: str, length: Column) -> DataFrame:
    """parts with the running sum of the lengths before each in its group."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))
