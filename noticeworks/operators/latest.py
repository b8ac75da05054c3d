"""Latest rows, first rows, top rows and joins against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1, place: str = "place") -> DataFrame:
    """The first n rows of each group in an order, with their place."""
    return rows.withColumn(place, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n)


def max_version_rows(rows: DataFrame, key: str, ver: str) -> DataFrame:
    """All rows that have the largest version of their key, as a join back would give: ties stay."""
    return rows.join(rows.groupBy(key).agg(F.max(ver).alias(ver)), [key, ver])


def latest_by(rows: DataFrame, keys: list[str], value: str, *by: str, name: str) -> DataFrame:
    """The value of each group's latest row."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*by)).alias(name))


def latest_with_fallback(rows: DataFrame, key: str, ver: str, value: str) -> DataFrame:
    """Latest version, its value, or else that of the latest version that has one, and whether that is an older one."""
    out = rows.groupBy(key).agg(F.max(ver).alias("ver"), F.max_by(value, ver).alias("current"), F.max(F.when(F.col(value).isNotNull(), F.col(ver))).alias("value_ver"), F.max_by(value, F.when(F.col(value).isNotNull(), F.col(ver))).alias("fallback"))
    outdated = F.col("current").isNull() & F.col("fallback").isNotNull()
    return out.select(key, "ver", F.coalesce("current", "fallback").alias(value), outdated.alias("outdated"))


def quota_pick(rows: DataFrame, keys: list[str], section: str, quotas: dict[str, int], order: list[Column], limit: int) -> DataFrame:
    """Each section's first rows up to its quota, then the first `limit` of them, per key."""
    quota = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    inside = top_per(rows, [*keys, section], order, max(quotas.values()), "section_place").where(F.col("section_place") <= F.element_at(quota, F.col(section)))
    return top_per(inside, keys, order, limit, "place")


def not_in(rows: DataFrame, column: str, excluded: DataFrame, other: str) -> DataFrame:
    """SQL's NOT IN: one null among the excluded leaves nothing, a null in the column fails unless nothing is excluded."""
    stats = excluded.agg(F.count("*").alias("_n"), F.count_if(F.col(other).isNull()).alias("_nulls"))
    kept = rows.join(excluded.select(F.col(other).alias(column)).where(F.col(column).isNotNull()).distinct(), column, "left_anti").join(F.broadcast(stats))
    return kept.where((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(column).isNotNull())).drop("_n", "_nulls")
