"""``primary``, or ``other`` where primary has no rows, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def when_empty(primary: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` if primary has none, else nothing: a join with a table of one row or none.

    The join stands below whatever follows, so adaptive execution knows that table first and leaves out the reading
    of ``rows``, sorts and all, where primary has a row."""
    none = primary.limit(1).agg(F.count("*").alias("_n")).where("_n = 0").drop("_n").withColumn("_empty", F.lit(True))
    return rows.join(F.broadcast(none)).drop("_empty")  # one row at most


def or_else(primary: DataFrame, other: DataFrame) -> DataFrame:
    """Union of primary with other guarded by primary's emptiness."""
    return primary.unionByName(when_empty(primary, other))


def or_else_per_key(primary: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """For each key: its primary rows, or its rows of other where it has none."""
    return primary.unionByName(other.join(primary.select(key).distinct(), key, "left_anti"))
