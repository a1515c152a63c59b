"""Numbers and carried values within groups of any size: a group that holds most rows is spread over many tasks.

A window over a whole group sorts it in one task, which is right where every group is known to fit: the largest is measured
by a count. Beyond that rows are range-partitioned by group and order, numbered within their partition, and the totals
of the partitions before (a few rows a group) are added. Both ways give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioweave.session import cut


#: Rows of one group that a task may sort by itself.
MOST_IN_TASK = 2_000_000


def _fits(df: DataFrame, keys: list[str]) -> bool:
    """Whether no group has more rows than a task may sort: a count combined before its shuffle."""
    counts = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("n_"))
    return (counts.agg(F.max("n_")).first()[0] or 0) <= MOST_IN_TASK


def _placed(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` in range partitions by keys and order, with the partition's number; kept, so that it stays the same."""
    return cut(df.repartitionByRange(*[F.col(f"`{k}`") for k in keys], *order).withColumn("part_", F.spark_partition_id()))


def numbered(df: DataFrame, keys: list[str], order: list[Column], into: str) -> DataFrame:
    """``df`` with the number of each row within its keys, from 1, in the given total order; null keys are a group."""
    if _fits(df, keys):
        return df.withColumn(into, F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order)).cast("long"))
    rows = _placed(df, keys, order)
    totals = rows.groupBy(*keys, "part_").agg(F.count("*").alias("n_"))
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0))).drop("n_")
    inside = rows.withColumn("in_", F.row_number().over(Window.partitionBy(*keys, "part_").orderBy(*order)))
    return _joined(inside, totals, keys).withColumn(into, F.col("in_") + F.col("before_")).drop("in_", "before_", "part_")


def carried(df: DataFrame, keys: list[str], order: list[Column], value: Column, into: str) -> DataFrame:
    """``df`` with the last ``value`` that isn't null up to each row within its keys."""
    if _fits(df, keys):
        whole = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(into, F.last(value, ignorenulls=True).over(whole))
    rows = _placed(df.withColumn(into, value), keys, order)
    upto = Window.partitionBy(*keys, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("in_", F.last(into, ignorenulls=True).over(upto)).drop(into)
    lasts = _ends(rows, keys, order, into)
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.withColumn("before_", F.last("end_", ignorenulls=True).over(before)).drop("end_")
    return _joined(inside, lasts, keys).withColumn(into, F.coalesce("in_", "before_")).drop("in_", "before_", "part_")


def _ends(rows: DataFrame, keys: list[str], order: list[Column], into: str) -> DataFrame:
    """The last value, not null, of each group in each partition; null where it has none."""
    w = Window.partitionBy(*keys, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("end_", F.last(into, ignorenulls=True).over(w)).groupBy(*keys, "part_").agg(F.first("end_").alias("end_"))


def _joined(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    right = totals.select(*[F.col(f"`{k}`").alias(f"{k}_r_") for k in keys], F.col("part_").alias("part_r_"), "before_")
    same = F.col("part_") == F.col("part_r_")
    for k in keys:
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`{k}_r_`"))
    return rows.join(right, same).drop("part_r_", *[f"{k}_r_" for k in keys])
