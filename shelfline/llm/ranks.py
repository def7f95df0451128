"""Ranks of rows within groups of any size: no group, and no run of equal rows, meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def prefix(df: DataFrame) -> str:
    """Underscores with which no column begins."""
    out = "__"
    while any(c.startswith(out) for c in df.columns):
        out += "_"
    return out


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], rank: str, count: str) -> DataFrame:
    """df as a table with `rank`, from 0 in the order of `order` among the rows of equal keys (null is a key), and `count`,
    their number. Without keys all rows are one group. df must not have columns of these names.

    Rows are dealt by ranges of keys and order, and sorted there; rows equal in both are told apart by their place in df,
    which should be a stored table, so that a task that runs again finds the same places. The number of each group's rows
    in each range, a few numbers a task, gives the ranks.
    """
    p = prefix(df)
    at = df.withColumn(f"{p}salt", F.monotonically_increasing_id())
    by = [F.col(f"`{k}`") for k in keys] + [F.col(f"`{c}`") if isinstance(c, str) else c for c in order] + [F.col(f"{p}salt")]
    dealt = at.repartitionByRange(*by).sortWithinPartitions(*by).drop(f"{p}salt")
    numbered = written(dealt.withColumn(f"{p}part", F.spark_partition_id()).withColumn(f"{p}at", F.monotonically_increasing_id()), "ranked")
    names = [f"{p}k{i}" for i in range(len(keys))]
    parts = numbered.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], F.col(f"{p}part").alias(f"{p}p")).agg(F.min(f"{p}at").alias(f"{p}first"), F.count("*").alias(f"{p}c"))
    own = Window.partitionBy(*names)
    before = F.coalesce(F.sum(f"{p}c").over(own.orderBy(f"{p}p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*names, f"{p}p", (before - F.col(f"{p}first")).alias(f"{p}shift"), F.sum(f"{p}c").over(own).alias(count))
    on = F.col(f"{p}part") == F.col(f"{p}p")
    for k, n in zip(keys, names, strict=True):
        on &= F.col(f"`{k}`").eqNullSafe(F.col(n))
    return numbered.join(parts, on).withColumn(rank, F.col(f"{p}at") + F.col(f"{p}shift")).drop(f"{p}at", f"{p}part", f"{p}p", f"{p}shift", *names)
