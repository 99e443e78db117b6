"""A corpus pipeline from documents to token ids.

Stages: quality rules, line dedup, n-gram near-duplicates (one document of each group stays),
benchmark decontamination, BPE encoding. Each takes (spark, docs, sf_dir) and returns a
DataFrame; all but the last return the columns of documents, and other columns as they came.

Cases, in every stage: an empty table gives no rows; columns may be null and may be named like
those that an operator works with. Texts that are null or empty are rejected by the first stage;
given to a later one by itself, they are kept by line dedup, near duplicates and decontamination
(they repeat nothing and hold nothing), and have no tokens. Rows equal in doc_id and text are
judged alike, but that near duplicates keep one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.bpe import encode_decode
from cairnlake.llm.common import cut, table
from cairnlake.llm.decontaminate import screen
from cairnlake.llm.line_dedup import line_dedup_stage
from cairnlake.llm.ngram_join import keep_one
from cairnlake.llm.quality import quality_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass every quality rule."""
    return quality_stage(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later copies of repeated line runs out of the texts; drops documents of which nothing is left."""
    return line_dedup_stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that n-gram similarity links, that of the least doc_id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return screen(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids of each document."""
    import public_tokenizers

    encoded = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "lang", "source"), decode=False)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: Tiling and BPE have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)  # what a stage keeps is made once, however often the next one reads it
    return docs
