"""Writes as frames: what a table is after an append, an upsert, a replacement or an expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.operators import dedup


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose keys are not there yet, the first of each key."""
    return dedup.first_of(incoming, keys, order).join(existing.select(*keys).distinct(), keys, "left_anti")


def get_or_create(existing: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """The dimension with new names behind the largest key; new keys follow the order of hashed buckets, and of names in them."""
    from pyspark.sql import Window as W

    fresh = names.select(name).where(F.col(name).isNotNull()).distinct().join(existing.select(name), name, "left_anti")
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))
    bucket = F.pmod(F.xxhash64(name), F.lit(1024))
    counts = fresh.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    before = counts.select("b", F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("b").orderBy(name))
    numbered = fresh.withColumn("b", bucket).withColumn("place", place).join(F.broadcast(before), "b").crossJoin(F.broadcast(top))
    return existing.select(key, name).unionByName(numbered.select((F.col("top") + F.col("before") + F.col("place")).alias(key), name))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace those of the same keys."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def replaced(existing: DataFrame, keep: Column, fresh: DataFrame) -> DataFrame:
    """Rows worth keeping (such as those set by hand) and the fresh ones in place of the rest."""
    return existing.where(keep).unionByName(fresh)


def expired(notices: DataFrame, now: Column, date_text: Column, closed_days: int = 3, undated_days: int = 60) -> DataFrame:
    """Notices closed for some days, and those without an end whose date text lies before the text of a limit."""
    limit = F.date_format(now - F.expr(f"INTERVAL {undated_days} DAYS"), "yyyy-MM-dd")
    ended = F.col("close_dt") < now - F.expr(f"INTERVAL {closed_days} DAYS")
    undated = F.col("close_dt").isNull() & (date_text < limit)
    return notices.where(F.coalesce(ended, F.lit(False)) | F.coalesce(undated, F.lit(False)))


def collection_window(runs: DataFrame, now: Column, lookback_days: int = 60, overlap_hours: int = 1) -> DataFrame:
    """Per source, from where to collect: an hour before the last good run, and never further back than the look-back."""
    last = runs.groupBy("source_id").agg(F.max(F.when(F.col("status") == "ok", F.col("run_at"))).alias("last_ok"))
    floor = now - F.expr(f"INTERVAL {lookback_days} DAYS")
    return last.select("source_id", F.greatest(F.coalesce(F.col("last_ok") - F.expr(f"INTERVAL {overlap_hours} HOURS"), floor), floor).alias("begin"), now.alias("end"))
