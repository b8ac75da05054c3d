"""One pass of collection: mapped items in, notices, scores and counts after it out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import ingest
from noticeworks.operators import dedup, keywords, staging, upkeep

NOTICE = ("id", "url", "title", "org_id", "open_dt", "close_dt", "created_at")


@dataclass
class Pass:
    """Tables after a pass and one row of counts."""

    notices: DataFrame
    orgs: DataFrame
    scores: DataFrame
    counts: DataFrame


def judged(items: DataFrame, statuses: tuple[str, ...], begin: Column, now: Column) -> DataFrame:
    """Mapped items with the reason why they are not taken; null if they are."""
    reason = ingest.reject_reason(F.col("status"), statuses, F.col("open_dt"), begin, F.col("close_dt"), now)
    return items.withColumn("reason", F.when(~ingest.complete(), "incomplete").otherwise(reason))


def with_orgs(fresh: DataFrame, orgs: DataFrame) -> DataFrame:
    """org_id by name; of several organisations with one name the smallest."""
    known = orgs.where("org_name is not null").groupBy("org_name").agg(F.min("org_id").alias("org_id"))
    return fresh.join(known, "org_name", "left")


def collect(items: DataFrame, notices: DataFrame, orgs: DataFrame, scores: DataFrame, rules: DataFrame, statuses: tuple[str, ...], begin: Column, now: Column) -> Pass:
    """Judges items (url, title, org_name, open_dt, close_dt, status, item_no), adds organisations and notices that are new, scores all that were taken,
    points notices of one organisation and title to the one that counts, and deletes expired notices after their scores.

    Items of one url are one notice, from the item with the smallest number; every one of them is scored, also where the notice was there before, so repeated scores stay.
    Notices without an organisation take no part in de-duplication.  Undated notices expire by the day they were made.  Empty tables pass through."""
    items = staging.written(judged(items, statuses, begin, now), "judged")
    taken = items.where("reason is null")
    orgs = staging.written(upkeep.get_or_create(orgs, taken, "org_id", "org_name"), "orgs")
    fresh = with_orgs(upkeep.new_rows(taken, notices, ["url"], ["item_no"]), orgs)
    numbers = upkeep.get_or_create(notices.select("id", "url"), fresh, "id", "url")
    # Numbers of new notices are given once, then read.
    added = staging.written(fresh.join(numbers, "url").withColumn("created_at", now).select(*NOTICE), "added")
    every = notices.select(*NOTICE).unionByName(added)

    found = keywords.presence_scores(taken.select(F.col("item_no").alias("id"), "title"), rules)
    by_item = found.select(F.col("id").alias("item_no"), "topic", "score").join(taken.select("item_no", "url"), "item_no")
    fresh_scores = staging.written(by_item.join(every.select("url", F.col("id").alias("notice_id")), "url").select("notice_id", "topic", "score"), "scored")

    dated = F.col("open_dt").isNotNull()
    cleaned = every.withColumn("name", dedup.clean_title(F.col("title")))
    last = dedup.superseded(cleaned, ["org_id", "name"], F.coalesce("open_dt", "created_at"), dated)
    marked = staging.written(every.join(last, "id", "left"), "marked")
    gone = upkeep.expired(marked, now, F.date_format("created_at", "yyyy-MM-dd")).select("id")
    kept_scores = scores.select("notice_id", "topic", "score").unionByName(fresh_scores).join(gone.withColumnRenamed("id", "notice_id"), "notice_id", "left_anti")
    kept = marked.join(gone, "id", "left_anti")

    told = items.agg(F.count("*").alias("fetched"), F.count_if(F.col("reason").isin("incomplete", "status")).alias("skipped"), F.count_if(F.col("reason") == "out_of_window").alias("out_of_window"), F.count_if(F.col("reason") == "already_closed").alias("already_closed"))
    pointed = marked.agg(F.count_distinct("superseded_by").alias("groups_with_duplicates"), F.count("superseded_by").alias("superseded"))
    counts = told
    for one in (added.agg(F.count("*").alias("inserted")), fresh_scores.agg(F.count("*").alias("scored")), pointed, gone.agg(F.count("*").alias("expired"))):
        counts = counts.crossJoin(F.broadcast(one))  # one row each
    return Pass(kept, orgs, kept_scores, counts)
