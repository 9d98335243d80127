"""Ranks over a whole table without ordering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.shared import written


def ranked(rows: DataFrame, order: list[Column], rank: str = "rank", weight: str | None = None) -> DataFrame:
    """Adds `rank` from 1 in the given order, which must be total; with `weight`, a row takes
    that many ranks and gets the last of them.

    Rows are dealt by ranges of the order and written; the ranges are counted, and a row's rank
    is its place in its range after the counts of the ranges before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    one = F.col(weight) if weight else F.lit(1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = ranged.groupBy("_range").agg(F.sum(one).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_place", F.sum(one).over(inside)).join(sums.select("_range", "_before"), "_range")
    return placed.withColumn(rank, (F.col("_before") + F.col("_place")).cast("long")).drop("_range", "_before", "_place")
