"""Counts per day and month without gaps, running totals, totals of totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def days_spine(spark: SparkSession, last: str, days: int) -> DataFrame:
    seq = F.expr(f"sequence(date'{last}' - INTERVAL {days - 1} DAYS, date'{last}', INTERVAL 1 DAY)")
    return spark.range(1).select(F.explode(seq).alias("day"))


def months_spine(spark: SparkSession, last: str, months: int) -> DataFrame:
    seq = F.expr(f"sequence(add_months(trunc(date'{last}', 'MM'), {1 - months}), trunc(date'{last}', 'MM'), INTERVAL 1 MONTH)")
    return spark.range(1).select(F.explode(seq).alias("first")).select(F.date_format("first", "yyyy-MM").alias("month"))


def per_day(rows: DataFrame, day: Column, spine: DataFrame, **counts: Column) -> DataFrame:
    """A row per day of the spine; counts of the conditions, 0 where there are none; rows without a day are left out."""
    found = rows.groupBy(day.alias("day")).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return F.broadcast(spine).join(found, "day", "left").select("day", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts])


def cumulative(rows: DataFrame, day: Column, spine: DataFrame, first: str, name: str = "total") -> DataFrame:
    """Running count: what lies before the first day is the base."""
    base = rows.agg(F.count_if(day < F.lit(first).cast("date")).alias("base"))
    daily = per_day(rows, day, spine, daily=F.lit(True)).crossJoin(F.broadcast(base))
    # The spine has a fixed number of days, so one window over it is small whatever the rows.
    running = F.sum("daily").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    return daily.select("day", "daily", (F.col("base") + running).alias(name))


def monthly_cumulative(rows: DataFrame, month: Column, spine: DataFrame, first: str) -> DataFrame:
    base = rows.agg(F.count_if(month < first).alias("base"))
    found = rows.groupBy(month.alias("month")).agg(F.count("*").alias("n"))
    dense = F.broadcast(spine).join(found, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n")).crossJoin(F.broadcast(base))
    return dense.select("month", "n", (F.col("base") + F.sum("n").over(W.orderBy("month").rowsBetween(W.unboundedPreceding, 0))).alias("total"))


def grid_cumulative(rows: DataFrame, key: str, day: Column, keys: DataFrame, spine: DataFrame, first: str) -> DataFrame:
    """Running counts per key on a full grid of keys and days; the row of all keys has a null key."""
    start = F.lit(first).cast("date")
    daily = rows.where(day >= start).groupBy(key, day.alias("day")).agg(F.count("*").alias("n"))
    before = rows.groupBy(key).agg(F.count_if(day < start).alias("base"))
    grid = keys.select(key).crossJoin(F.broadcast(spine)).join(daily, [key, "day"], "left").join(before, key, "left")
    running = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy(key).orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    each = grid.select(key, "day", (F.coalesce("base", F.lit(0)) + running).alias("total"))
    return each.groupingSets([["day", key], ["day"]], F.col("day"), F.col(key)).agg(F.sum("total").alias("total")).select(key, "day", "total")
