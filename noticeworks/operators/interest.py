"""Notices that interest customers: one plan scores every customer at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import scoring
from noticeworks.operators import keywords, latest

QUOTAS = {"prenotice": 10, "active": 20}


def open_still(now: Column) -> Column:
    """No end, or not ended: what the hard filter asks of a notice whoever the customer is."""
    return F.col("close_dt").isNull() | (F.col("close_dt") >= now)


def hard_filter(price_min: Column, lead_days: Column, now: Column, default_lead: int = 7) -> Column:
    """Still open, at or above the price floor (an unknown price fails it), and far enough from its end."""
    close, price = F.col("close_dt"), F.col("est_price")
    priced = price_min.isNull() | F.coalesce(price >= price_min, F.lit(False))
    ahead = close.isNull() | (close >= now + F.make_interval(days=F.coalesce(lead_days, F.lit(default_lead))))
    return open_still(now) & priced & ahead


def topic_strengths(scores: DataFrame) -> DataFrame:
    """The largest score of each notice and topic, at least 0; repeated rows make no difference."""
    return scores.groupBy("notice_id", "topic").agg(F.greatest(F.max("l2"), F.lit(0)).alias("l2"))


def dealt(scores: DataFrame, *more: str) -> DataFrame:
    """Scores dealt by notice once, so that what is collected by notice after their topics stays where it is; more names columns that come along."""
    return scores.select("notice_id", "topic", "l2", *more).repartition("notice_id")


def rule_scores(notices: DataFrame, scores: DataFrame, profiles: DataFrame, now: Column, least: int = scoring.MIN_SCORE) -> DataFrame:
    """customer, id, score, topics for each profile (customer, priorities: map of topics, terms, org_ids, price_min, lead_days) and notice.

    Topics are matched by an equi-join on the topic; terms and followed organisations add the notices no topic led to."""
    notices = notices.where(open_still(now))
    wanted = profiles.select("customer", F.explode("priorities").alias("topic", "level"))
    points = F.create_map(*[F.lit(x) for pair in scoring.PRIORITY_POINTS.items() for x in pair])
    chance = F.element_at(points, F.col("level")) * scoring.strength(F.col("l2")) / 100
    by_topic = topic_strengths(dealt(scores)).join(wanted, "topic").withColumn("chance", chance).withColumn("strength", scoring.strength(F.col("l2")))
    by_topic = by_topic.groupBy("customer", F.col("notice_id").alias("id")).agg(F.array_sort(F.collect_list("chance")).alias("chances"), F.array_sort(F.collect_list(F.struct("topic", "strength"))).alias("topics"))
    terms = profiles.select("customer", F.explode("terms").alias("term")).withColumn("term", F.trim("term")).where("term != ''")
    by_term = keywords.containing(notices.select("id", "title"), terms, "title").select("customer", "id").distinct().withColumn("by_term", F.lit(scoring.TERM_POINTS))
    followed = profiles.select("customer", F.explode("org_ids").alias("org_id"))
    by_org = notices.select("id", "org_id").join(followed, "org_id").select("customer", "id").distinct().withColumn("by_org", F.lit(scoring.ORG_POINTS))
    parts = by_topic.join(by_term, ["customer", "id"], "full").join(by_org, ["customer", "id"], "full")
    topic_points = F.coalesce(scoring.noisy_or(F.col("chances")) * 100, F.lit(0.0))
    total = scoring.whole(F.least(F.lit(100.0), topic_points + F.coalesce("by_term", F.lit(0)) + F.coalesce("by_org", F.lit(0))))
    limits = profiles.select("customer", "price_min", "lead_days")
    scored = parts.withColumn("score", total).where(F.col("score") >= least).join(limits, "customer").join(notices, "id")
    return scored.where(hard_filter(F.col("price_min"), F.col("lead_days"), now)).drop("price_min", "lead_days", "chances", "by_term", "by_org")


def order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("close_dt"), F.asc("id")]


def top_matches(scored: DataFrame, quotas=QUOTAS, limit: int = 30) -> DataFrame:
    """The report of each customer: the first of each section up to its quota, in order of score."""
    return latest.quota_pick(scored, ["customer"], "section", quotas, order(), limit)


def with_signals(scored: DataFrame, signals: dict[str, DataFrame]) -> DataFrame:
    """Adds each signal (id, value, possibly per customer; one row per key) as a column of its name; null where it says nothing.

    Signals of the same keys are stacked and turned into columns by one aggregation, so there is one join for each set of keys."""
    for keys in (["customer", "id"], ["id"]):
        found = {name: values for name, values in signals.items() if ("customer" in values.columns) == ("customer" in keys)}
        if found:
            stacked = reduce(DataFrame.unionByName, [values.select(*keys, F.lit(name).alias("signal"), F.col("value").cast("double").alias("value")) for name, values in found.items()])
            wide = stacked.groupBy(*keys).agg(*[F.max(F.when(F.col("signal") == name, F.col("value"))).alias(name) for name in found])
            scored = scored.join(wide, keys, "left")
    return scored
