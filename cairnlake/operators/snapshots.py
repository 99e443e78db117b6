"""Snapshots: a list by time, references to one, and what they keep alive.

Snapshots that have no time come first in lists and are the latest only if no other has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SnapshotError(LookupError):
    """A reference to a snapshot that names none, or more than one."""


def listed(snapshots: DataFrame) -> DataFrame:
    """All snapshots, the oldest first; equal times by id."""
    return snapshots.orderBy("created", "id")


def latest(snapshots: DataFrame) -> DataFrame:
    """The snapshot made last; ties go to the greatest id. No rows from no rows."""
    return snapshots.orderBy(F.desc("created"), F.desc("id")).limit(1)


def matches(snapshots: DataFrame, refs: DataFrame) -> DataFrame:
    """Each distinct ref with the number of ids that it is a prefix of, its status, and the id if it is one.

    An equality join on the ids' prefixes. Null refs and null ids match nothing; an empty ref
    is a prefix of every id.
    """
    prefixes = F.transform(F.sequence(F.lit(0), F.length("id")), lambda n: F.substring("id", F.lit(1), n))
    every = snapshots.where(F.col("id").isNotNull()).select("id", F.explode(prefixes).alias("ref"))
    counted = refs.select("ref").distinct().join(every, "ref", "left").groupBy("ref").agg(F.count("id").alias("n"), F.min("id").alias("id"))
    status = F.when(F.col("n") == 0, "not_found").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    return counted.select("ref", "n", status.alias("status"), F.when(F.col("n") == 1, F.col("id")).alias("id"))


def resolve(snapshots: DataFrame, ref: str) -> str:
    """The id that ref means: "latest", an id, or the prefix of just one id."""
    if ref == "latest":
        found = latest(snapshots).select("id").collect()
    else:
        found = snapshots.where(F.col("id").startswith(ref)).select("id").limit(2).collect()
    if not found:
        raise SnapshotError(f"no snapshot matches {ref!r}")
    if len(found) > 1:
        raise SnapshotError(f"{ref!r} is ambiguous")
    return found[0].id


def forget(snapshots: DataFrame, ids: DataFrame) -> DataFrame:
    """snapshots without those in ids. Nothing else is removed; a null id removes nothing."""
    return snapshots.join(ids.select("id"), "id", "left_anti")
