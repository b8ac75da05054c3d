"""Stages of one notice found and pointed to the one that counts; events that repeat within a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAP_DAYS = 400
WINDOWS = {"view": 300, "click": 5}


def clean_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"\s+", " "))


def clusters(rows: DataFrame, keys: list[str], anchor: Column, gap_days: int = GAP_DAYS) -> DataFrame:
    """cluster number within each group: a new one begins where two rows in a row lie more than so many whole days apart."""
    w = W.partitionBy(*keys).orderBy("anchor", "id")
    rows = rows.withColumn("anchor", anchor)
    seconds = F.unix_timestamp(F.col("anchor").cast("timestamp")) - F.unix_timestamp(F.lag("anchor").over(w).cast("timestamp"))
    fresh = F.coalesce(F.floor(seconds / 86400) > gap_days, F.lit(False)).cast("int")
    return rows.withColumn("fresh", fresh).withColumn("cluster", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("fresh")


def superseded(rows: DataFrame, keys: list[str], anchor: Column, dated: Column, gap_days: int = GAP_DAYS) -> DataFrame:
    """id, superseded_by: the survivor of its cluster (dated before undated, then latest, then largest id), null for the survivor itself."""
    found = clusters(rows.where(F.col(keys[0]).isNotNull()), keys, anchor, gap_days)
    inside = W.partitionBy(*keys, "cluster")
    last = F.max_by("id", F.struct(dated, F.col("anchor"), F.col("id"))).over(inside)
    return found.withColumn("last", last).select("id", F.when(F.col("last") != F.col("id"), F.col("last")).alias("superseded_by"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of `after` whose pointer differs from the one before, nulls counting as a value."""
    old = before.select("id", F.col("superseded_by").alias("old"))
    return after.join(old, "id", "left").where(~F.col("superseded_by").eqNullSafe(F.col("old"))).drop("old")


def accepted_events(events: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Events that do not follow the last accepted one of their keys within so many seconds.

    An event further than that from the one before it is always accepted, so a key's history is cut there; the runs between are walked in order of time over
    sorted partitions, and no more than the last accepted time is held.
    """
    most, columns = seconds * 1_000_000, events.columns
    order = [F.col("ts").asc_nulls_last(), F.col("event_id")]
    history = W.partitionBy(*keys).orderBy(*order)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.withColumn("_at", at).withColumn("_fresh", (F.row_number().over(history) == 1) | F.coalesce(F.col("_at") - F.lag("_at").over(history) > most, F.lit(False)))
    rows = rows.withColumn("_run", F.sum(F.col("_fresh").cast("long")).over(history.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.repartition(*keys, "_run").sortWithinPartitions(*keys, "_run", *order)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            kept = []
            for fresh, micros in zip(batch["_fresh"].tolist(), batch["_at"].tolist(), strict=True):
                accepted = fresh or (last is not None and micros - last > most)
                kept.append(accepted)
                last = micros if accepted else last
            yield batch.loc[kept, columns]

    return rows.mapInPandas(keep, events.schema)


def accepted_by_type(events: DataFrame, keys: list[str]) -> DataFrame:
    """Accepted events of every type of WINDOWS, each with its own window, per keys and type."""
    found = [accepted_events(events.where(F.col("event_type") == kind), keys, seconds) for kind, seconds in WINDOWS.items()]
    return reduce(DataFrame.unionByName, found)


def state_changes(events: DataFrame, keys: list[str], state: str, order: list[str]) -> DataFrame:
    """Events that change the state of their keys; repeats of a state are left out."""
    before = F.lag(state).over(W.partitionBy(*keys).orderBy(*order))
    return events.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col(state))).drop("before")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).where("place = 1").drop("place")
