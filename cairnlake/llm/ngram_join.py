"""N-gram Jaccard self-join by MinHash banding, with full verification.

A document's set is its runs of N words (all its words if it has fewer). Documents with equal
sets are one class, whatever their number, and only classes are compared.

1. Signatures: minima of hashed n-grams, in bands of some rows each. `banding` picks both: for
   each number of rows the least number of bands whose chance to miss a pair at the threshold is
   below 1 - recall, and of these the most rows, thus the fewest false candidates, that HASHES
   minima pay for.
2. Shuffle on band hashes. Buckets of one member are dropped; of buckets with the very same
   members only the first is kept, as two such classes have the same pairs.
3. A bucket of more than BLOCK members or BLOCK_BYTES of sets is cut by the sets' sizes into levels
   whose bounds grow by 1 / threshold, so that links only join a level to itself and to the next,
   and each level by hash into blocks within both bounds. Every two blocks of a level or of
   neighbouring ones (and each block by itself) are a task's unit: a bucket of any size spreads
   over many tasks, no task holds more than two blocks, and no set is sent to meet sets that are
   too short or too long for it. A set goes to as many units as its own and the neighbouring
   levels have blocks.
4. In a unit the full n-gram sets are intersected: pair by pair in small units, as products of
   incidence matrices in large ones. A pair is looked at only in the first bucket that it
   shares, and leaves only sums: for each class the number of documents that it links to, and
   one edge to its group inside the unit. Pairs themselves are never emitted.
5. Edges are joined to groups by star contraction, with every step cut at a checkpoint.

The result has a row for each document: class_id, the least doc_id of its group, and n_links,
the number of other documents whose similarity is at least the threshold.

Cases: null texts and texts without a word are linked to nothing and are their own group;
equal texts are linked; repeated rows count as documents; a group whose doc_ids are all null
has a null class_id; an empty table gives no rows; other columns are ignored or passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workers import let_workers_import
from .common import WordHashes, cut, joined_anew, table

N, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.9999, 80
BLOCK, BLOCK_BYTES, SEED = 256, 4 << 20, 7
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def banding(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows) that find a pair at the threshold with chance recall; one row if so few hashes allow no more."""
    bands = lambda rows: max(1, int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows)))))
    rows = max([r for r in range(1, hashes + 1) if r * bands(r) <= hashes], default=1)
    return bands(rows), rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """The n-gram sets of texts, as sorted arrays of 64-bit hashes."""

    def __init__(self, n: int = N):
        self.n, self.known = n, WordHashes()

    def of(self, text: str | None) -> np.ndarray:
        words = _WORDS.findall(text or "")
        if not words:
            return np.zeros(0, np.uint64)
        ids = self.known.of(words)
        n = min(self.n, len(ids))
        with np.errstate(over="ignore"):
            out = np.full(len(ids) - n + 1, n, np.uint64)
            for k in range(n):
                out = (out * np.uint64(0x9E3779B97F4A7C15)) + ids[k : k + len(out)]
            return np.unique(_mix(out))


class MinHash:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(SEED)
        self.a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def bands_of(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(grams), 2048):  # bounds the matrix
                h = grams[at : at + 2048, None] * self.a + self.b
                h ^= h >> np.uint64(32)
                np.minimum(least, h.min(axis=0), out=least)
            out = np.arange(1, self.bands + 1, dtype=np.uint64)
            for column in least.reshape(self.bands, self.rows).T:
                out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
        return out.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, set_id (null without words), n_grams and the band hashes of each row."""
    let_workers_import(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, hashes = Shingles(n), MinHash(bands, rows)
        for batch in batches:
            ids, sizes, found = [], [], []
            for text in batch.column("text").to_pylist():
                own = grams.of(text)
                sizes.append(len(own))
                ids.append(blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                found.append(hashes.bands_of(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "set_id", "n_grams", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", text_hash().alias("text_hash"), "text")
    return own.mapInArrow(run, f"doc_id {kind}, text_hash binary, set_id binary, n_grams int, bands array<bigint>")


def text_hash():
    return F.unhex(F.md5(F.encode("text", "UTF-8")))


def units(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The units of comparison: (bucket, i, j) and a member class in block own, with the band of the bucket."""
    members = classes.select("set_id", "n_grams", F.posexplode("bands").alias("band", "bucket"))
    h1, h2, size = F.xxhash64("set_id"), F.xxhash64("set_id", F.lit(1)), 8 * F.col("n_grams").cast("long")
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.min("band").alias("band"), F.bit_xor(h1).alias("x"), F.bit_xor(h2).alias("y"))
    kept = buckets.where("n > 1").groupBy("n", "bytes", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("b"))
    kept = kept.select(F.col("b.bucket").alias("bucket"), ((F.col("n") > block) | (F.col("bytes") > block_bytes)).alias("large"))
    own = cut(members.join(kept, "bucket"))
    small = own.where("not large").select("bucket", "band", "set_id", *[F.lit(0).alias(c) for c in ("own", "i", "j")])
    # The step is a hair wider, so that rounding never parts sizes at the threshold by two levels.
    large = own.where("large").withColumn("level", F.floor(F.log(F.col("n_grams")) / (-np.log(threshold) * (1 + 1e-9))).cast("int"))
    count = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(size) / block_bytes)).cast("int")
    levels = large.groupBy("bucket", "level").agg(count.alias("blocks")).groupBy("bucket").agg(F.collect_list(F.struct("level", "blocks")).alias("levels"))
    placed = joined_anew(large, levels, ["bucket"])
    blocks = lambda which: F.aggregate(F.filter("levels", which), F.lit(0), lambda a, x: a + x["blocks"])
    at = F.col("level")
    first, mine = blocks(lambda x: x["level"] < at), blocks(lambda x: x["level"] == at)
    lower, upper = blocks(lambda x: x["level"] == at - 1), blocks(lambda x: x["level"] == at + 1)
    placed = placed.select("bucket", "band", "set_id", (first + F.pmod(h1, mine)).cast("int").alias("own"), F.explode(F.sequence(first - lower, first + mine + upper - 1)).alias("other"))
    return small.unionByName(placed.select("bucket", "band", "set_id", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))


def _links(a: list[np.ndarray], b: list[np.ndarray] | None, wanted: np.ndarray, threshold: float) -> np.ndarray:
    """Which wanted pairs (rows a, columns b, or a again) have at least the threshold."""
    size_a = np.array([len(x) for x in a])
    size_b = size_a if b is None else np.array([len(x) for x in b])
    wanted = wanted & (np.minimum(size_a[:, None], size_b) >= threshold * np.maximum(size_a[:, None], size_b) - 1e-9)
    if not wanted.any():
        return wanted
    if len(wanted) * wanted.shape[1] <= 1024:
        common = np.zeros(wanted.shape)
        for i, j in zip(*np.nonzero(wanted), strict=True):
            common[i, j] = len(np.intersect1d(a[i], (a if b is None else b)[j], assume_unique=True))
    else:
        common = _products(a, b, wanted)
    union = size_a[:, None] + size_b - common
    return wanted & (common >= threshold * union - 1e-9)


def _products(a: list[np.ndarray], b: list[np.ndarray] | None, wanted: np.ndarray) -> np.ndarray:
    """Sizes of all intersections, as products of incidence matrices, some n-grams at a time."""
    every = a if b is None else [*a, *b]
    flat = np.concatenate(every)
    row = np.repeat(np.arange(len(every)), [len(x) for x in every])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, width = np.zeros(wanted.shape, np.float32), 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        x = np.zeros((len(every), width), np.float32)
        x[row[lo:hi], column[lo:hi] - at] = 1
        out += x[: len(a)] @ (x if b is None else x[len(a) :]).T
    return out


def _compare(unit: pd.DataFrame, threshold: float) -> pd.DataFrame | None:
    """For each class with a link in the unit: the documents it links to, and its group's first class."""
    i, j, band = int(unit["i"].iloc[0]), int(unit["j"].iloc[0]), int(unit["band"].iloc[0])
    own = unit["own"].to_numpy()
    left = np.flatnonzero(own == i)
    right = left if i == j else np.flatnonzero(own == j)
    if not len(left) or not len(right) or i == j and len(left) < 2:
        return None
    bands = np.stack(unit["bands"].to_numpy()).reshape(len(unit), band)
    wanted = np.ones((len(left), len(right)), bool)
    for k in range(band):  # a pair that shares an earlier bucket was looked at there
        wanted &= bands[left, k][:, None] != bands[right, k]
    if i == j:
        wanted = np.triu(wanted, 1)
    grams = [np.frombuffer(x, np.uint64) for x in unit["grams"]]
    linked = _links([grams[k] for k in left], None if i == j else [grams[k] for k in right], wanted, threshold)
    at_l, at_r = np.nonzero(linked)
    if not len(at_l):
        return None
    a, b = left[at_l], right[at_r]
    weight = unit["n_docs"].to_numpy()
    links = np.bincount(a, weights=weight[b], minlength=len(unit)) + np.bincount(b, weights=weight[a], minlength=len(unit))
    root = np.arange(len(unit))
    while True:  # least label over links, with jumps; a few rounds
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = np.unique(np.concatenate([a, b]))
    ids = unit["set_id"].to_numpy()
    return pd.DataFrame({"set_id": ids[some], "root": ids[root[some]], "links": links[some].astype("int64")})


def _verify(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        out: list[pd.DataFrame] = []
        key = ["bucket", "i", "j"]

        def flush(whole: pd.DataFrame) -> None:
            values = whole[key].to_numpy()
            cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(whole)], strict=True):
                if hi - lo > 1 and (got := _compare(whole.iloc[lo:hi], threshold)) is not None:
                    out.append(got)

        for batch in batches:
            if not len(batch):
                continue
            values, last = batch[key].to_numpy(), batch[key].iloc[-1].to_numpy()
            tail = int((values == last).all(axis=1)[::-1].argmin()) if not (values == last).all() else len(batch)
            if tail == len(batch) and (not rest or (rest[-1][key].iloc[-1].to_numpy() == last).all()):
                rest.append(batch)
                continue
            flush(pd.concat([*rest, batch.iloc[: len(batch) - tail]]))
            rest = [batch.iloc[len(batch) - tail :]]
            if out:
                yield pd.concat(out)
                out.clear()
        if rest:
            flush(pd.concat(rest))
        if out:
            yield pd.concat(out)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node's least node of its connected component, from edges (a, b).

    Large-star then small-star: each round links every node's neighbours to the least of them.
    Minima are sums that are taken before the shuffle; nothing gathers a node's neighbours, so
    that a star of any size is only a hot key of a join, which is split.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # Large star: neighbours above a node go to the least of its neighbourhood.
        large = joined_anew(both.where("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node's neighbours below it, and it, go to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        new = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(low.select("a", F.col("m").alias("b"))).distinct())
        same = new.count() == now.count() and new.join(now, ["a", "b"], "left_anti").isEmpty()
        now = new
        if same:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def link(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text_hash, set_id, root (the group's least set) and n_links of every row of docs."""
    signed = cut(signatures(docs, n, *banding(threshold, recall, hashes)))
    known = signed.where(F.col("set_id").isNotNull())
    classes = cut(known.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc_id", "text_hash")).alias("first"), F.any_value("n_grams").alias("n_grams"), F.any_value("bands").alias("bands")))
    pairs = cut(units(classes, threshold, block, block_bytes))
    used = pairs.select("set_id").distinct().join(classes, "set_id").select("set_id", "n_docs", "bands", "first.*")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Shingles(n)
        for batch in batches:
            own = pa.array([grams.of(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("set_id", "n_docs", "bands")] + [own], ["set_id", "n_docs", "bands", "grams"])

    # Rows that are equal in both are one text: any of them spells the class.
    texts = docs.select(F.col("doc_id").alias("__d"), text_hash().alias("__h"), "text")
    spelled = used.join(texts, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h")))
    spelled = spelled.select("set_id", "n_docs", "bands", "text").mapInArrow(spell, "set_id binary, n_docs bigint, bands array<bigint>, grams binary").dropDuplicates(["set_id"])
    # Only the bands before a bucket's own tell whether a pair was looked at before.
    ready = pairs.join(spelled, "set_id").withColumn("bands", F.slice("bands", 1, F.col("band"))).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "set_id")
    found = cut(ready.mapInPandas(_verify(threshold), "set_id binary, root binary, links bigint"))
    groups = components(found.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    summed = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    own = classes.select("set_id", "n_docs").join(summed, "set_id", "left").join(groups.withColumnRenamed("node", "set_id"), "set_id", "left")
    own = own.select("set_id", F.coalesce("root", "set_id").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"))
    return joined_anew(signed.select("doc_id", "text_hash", "set_id"), own, ["set_id"], "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))


def near_groups(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id and n_links of every row of docs."""
    linked = cut(link(docs, **how))
    first = linked.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("class_id"))
    out = joined_anew(linked, first, ["root"], "left")
    return out.select("doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "n_links")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group, the one of the least doc_id (nulls last), then text hash."""
    linked = cut(link(docs, **how))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    first = linked.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(order).alias("o"))
    gone = joined_anew(linked, first, ["root"]).where(order != F.col("o")).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).distinct()
    rest = docs.withColumn("__h", text_hash())
    at = lambda df: df["doc_id"].eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__g"))
    left = rest.join(gone.withColumnRenamed("__h", "__g"), at(rest), "left_anti")
    # Rows equal in doc_id and text may still come twice; the texts move again only if there are any.
    twice = linked.where(F.col("root").isNotNull()).groupBy("doc_id", "text_hash").count().where("count > 1")
    twice = cut(twice.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__g")))
    if twice.isEmpty():
        return left.drop("__h")
    once = left.join(twice, at(left), "left_anti").drop("__h")
    thinned = left.join(twice, at(left), "left_semi").dropDuplicates(["doc_id", "__h"]).drop("__h")
    return once.unionAll(thinned)


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
