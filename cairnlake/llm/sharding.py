"""Contiguous shards of near equal bytes, by global prefix sums.

Rows are put in one order over the whole table by range partitioning; each partition gives
one total; the totals, one row for each partition, are summed up to offsets; a row's offset
plus its running sum inside its partition is its place in the whole table's bytes, and the
shard is the place's share of the total. No task ever sees more than its own partition, and
only the totals are broadcast: as many rows as there are partitions.

Order: by doc_id, nulls first, then crc32 and size of the text, so that ties are settled by
content; rows equal in all three are interchangeable. Cases: a null or empty text has size
1; an empty table gives no rows; other columns are ignored; one shard holds everything if
shards=1. A shard differs from the target by less than the largest document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    # The partition and the place in it are fixed here once; later steps only read them.
    placed = cut(
        sized.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("place", 33).cast("int"))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("byte_offset"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("row_offset"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy("place")
    run = placed.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.join(F.broadcast(offsets), "part")
    middle = F.col("byte_offset") + F.col("upto") - F.col("size") / 2
    cutup = cut(
        run.select(
            "doc_id",
            "size",
            "text_crc32",
            F.least(F.floor(middle * shards / F.col("all_bytes")), F.lit(shards - 1)).cast("int").alias("shard"),
            (F.col("row_offset") + F.col("place") - F.shiftleft(F.col("part").cast("long"), 33)).alias("row"),
        )
    )
    first = cutup.groupBy("shard").agg(F.min("row").alias("first"))  # one row for each shard
    return cutup.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
