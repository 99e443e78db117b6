"""The chunk index: which chunk lies where. All joins are on the chunk's id.

Sides are left to the optimizer: it broadcasts what it has measured to be small and shuffles
what isn't, and skewed keys are split at run time. Only probed columns go into a join.

Null ids match nothing: they are never had, always missing, located nowhere and removed by
nothing; where ids are grouped, null is an id of its own. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def has(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """The chunks that the index holds."""
    return chunks.join(index.select("chunk_id"), "chunk_id", "left_semi")


def missing(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """The chunks that it does not."""
    return chunks.join(index.select("chunk_id"), "chunk_id", "left_anti")


def locate(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """The chunks with their place; nulls where the index has none."""
    return chunks.join(index.select("chunk_id", "pack_id", "offset", "length"), "chunk_id", "left")


def fresh(chunks: DataFrame, index: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row of each chunk that the index lacks: what a put would store.

    Copies are merged before the join. With order the first of them stays, nulls before all, else any.
    """
    if order is None:
        return missing(chunks.dropDuplicates(["chunk_id"]), index)
    rest = [c for c in chunks.columns if c != "chunk_id" and c not in order]
    first = chunks.groupBy("chunk_id").agg(F.min(F.struct(*order, *rest)).alias("f")).select("chunk_id", "f.*")
    return missing(first.select(*chunks.columns), index)


def upsert(index: DataFrame, added: DataFrame, batch: str = "batch") -> DataFrame:
    """One location for each chunk: that of the latest batch. added carries the batch's number."""
    both = index.withColumn(batch, F.lit(-1).cast("long")).unionByName(added.withColumn(batch, F.col(batch).cast("long")))
    return last_wins(both, batch).drop(batch)


def last_wins(entries: DataFrame, batch: str) -> DataFrame:
    """The entry of the latest batch of each chunk; ties go to the greatest pack, then offset.

    A maximum, not a window: copies are merged before the shuffle, however hot a chunk is.
    """
    rest = [c for c in entries.columns if c not in ("chunk_id", batch)]
    best = entries.groupBy("chunk_id").agg(F.max(F.struct(batch, *rest)).alias("m"))
    return best.select("chunk_id", "m.*").select(*entries.columns)


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without the chunks in ids."""
    return index.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def clear(index: DataFrame) -> DataFrame:
    """An empty index of the same columns."""
    return index.where(F.lit(False))


def dedup_report(chunks: DataFrame, by: str) -> DataFrame:
    """For each group: chunks, distinct chunks, bytes and distinct bytes. A null group is one; null lengths count as nothing."""
    once = chunks.groupBy(by, "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.max("length").cast("long").alias("length"))
    return once.groupBy(by).agg(
        F.sum("n").cast("long").alias("chunks"),
        F.count(F.lit(1)).alias("unique_chunks"),
        F.sum(F.col("n") * F.col("length")).cast("long").alias("bytes"),
        F.sum("length").cast("long").alias("unique_bytes"),
    )


def new_per_run(chunks: DataFrame, run: str) -> DataFrame:
    """For each run, in order, the chunks that no earlier run has stored, and their bytes.

    Chunks of a null run come from nowhere: they belong to another run that has them, else to none.
    """
    chunks = chunks.where(F.col(run).isNotNull())
    first = chunks.groupBy("chunk_id").agg(F.min(run).alias(run), F.max("length").cast("long").alias("length"))
    own = first.groupBy(run).agg(F.count(F.lit(1)).alias("new_chunks"), F.sum("length").cast("long").alias("new_bytes"))
    every = chunks.select(run).distinct().join(own, run, "left")
    return every.select(run, F.coalesce("new_chunks", F.lit(0)).cast("long").alias("new_chunks"), F.coalesce("new_bytes", F.lit(0)).cast("long").alias("new_bytes"))


def running(chunks: DataFrame, run: str) -> DataFrame:
    """new_per_run with the bytes stored so far. The window has one row for each run, and no more."""
    at = Window.orderBy(run).rowsBetween(Window.unboundedPreceding, 0)
    return new_per_run(chunks, run).withColumn("stored_bytes", F.sum("new_bytes").over(at))
