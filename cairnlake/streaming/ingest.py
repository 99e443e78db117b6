"""Structured Streaming ingest: an extension that the batch operators carry over to streams.

Each micro-batch is chunked, chunks that are stored already are left out by an anti join, and the
rest is appended. Batches are idempotent: a batch that is run again after a failure overwrites
its own folder, so that chunks are stored exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking, index

STORED = "chunk_id string, length int, data binary, batch bigint"


def ingest(stream: DataFrame, store: str, checkpoint: str, params: chunking.Params = chunking.Params(), **trigger) -> StreamingQuery:
    """Stores the distinct chunks of a stream with a binary column content below store."""

    def batch(files: DataFrame, number: int) -> None:
        spark = files.sparkSession
        try:
            known = spark.read.schema(STORED).parquet(store).where(F.col("batch") != number)
        except Exception as e:  # noqa: BLE001  the first batch finds nothing there
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], STORED)
        new = index.fresh(chunking.chunk(files.select("content"), params=params).select("chunk_id", "length", "data"), known)
        new.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def watch_folder(spark, path: str) -> DataFrame:
    """A stream of the files that come to a folder: path, length and content."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
