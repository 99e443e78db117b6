"""Helpers that the text operators share."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import cut  # noqa: F401  the operators take it from here

#: Bytes that part words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
_LEAST = {"tinyint": -(1 << 7), "smallint": -(1 << 15), "int": -(1 << 31), "bigint": -(1 << 63)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def joined_anew(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """left joined to right on the names, with both sides dealt for this join.

    A side that was just summed by the keys lies by them already, and is not dealt again; then
    the other side's hot keys can't be split at run time. Spelling the right side's keys as
    expressions of the same value makes both sides move, and lets a hot key of the left be
    split. Keys are whole numbers, strings or binaries. No key may be null on the right; nulls
    on the left match nothing.
    """
    kinds = dict(right.dtypes)
    spelled = {f"__k{i}": _spelled(n, kinds[n]) for i, n in enumerate(names)}
    same = [left[n] == F.col(k) for n, k in zip(names, spelled, strict=True)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return left.join(right.withColumns(spelled).drop(*names), on, how).drop(*spelled)


def _spelled(name: str, kind: str) -> Column:
    """The column by an expression that gives every value of its type but null back."""
    if kind in ("string", "binary"):
        return F.substring(name, 1, (1 << 31) - 1)
    return F.greatest(F.col(name), F.lit(_LEAST[kind]).cast(kind))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns so named, in any case."""
    low = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low])


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def hex_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


class WordHashes(dict):
    """64-bit hashes of words, none of them 0; those met lately are kept, MOST at a time."""

    MOST = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        out = self[word] = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little") or 1
        return out

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
