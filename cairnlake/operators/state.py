"""Cutting lineage, and room for files, in the folder that the cluster shares."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The checkpoint folder that the session names in spark.checkpoint.dir.

    Only on a local master, where one machine is all there is, may none be named.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "cairnlake-checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder."""
    shared(df.sparkSession)
    return df.checkpoint()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """The path of a new folder in the shared one, for files; what was read from it must be cut before it goes."""
    at = urlsplit(shared(spark))
    if at.scheme not in ("", "file"):
        raise RuntimeError(f"files need a mounted folder, and spark.checkpoint.dir is in a store ({at.scheme})")
    path = os.path.join(unquote(at.path), f"scratch-{uuid.uuid4().hex}")
    os.makedirs(path)
    try:
        yield path
    finally:
        shutil.rmtree(path, ignore_errors=True)
