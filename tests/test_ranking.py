"""Ranked customers: the rows of the full plan, from few pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from noticeworks.functions import scoring
from noticeworks.operators import interest, latest, ranking, staging
from noticeworks.plans import QUERIES
from noticeworks.plans import scoring as plans

VARIANTS = {"or": scoring.combine_noisy_or, "mean": scoring.combine_average, "low": lambda s: scoring.combine_noisy_or(s, {"like": 0.5, "type": 0.5})}
NOTICES, CUSTOMERS = 3000, 60
FIELDS = "customer int, priorities map<bigint, string>, terms array<string>, org_ids array<bigint>, price_min double, lead_days int"


@pytest.fixture(scope="module")
def frames(spark):
    dice = random.Random(3)
    day = lambda: dice.choice([None, *[f"2000-0{1 + dice.randrange(4)}-{1 + dice.randrange(28):02} 0{dice.randrange(9)}:30:00"] * 4])
    notices = [(i, dice.randrange(50), dice.choice(["red anvil", "ring", "hot pipe", None]), day(), dice.choice([None, 0.5, 1.0, 2.0 ** dice.randrange(20), dice.random() * 1e6]), dice.choice([None, 0.6, -0.6, 0.0])) for i in range(NOTICES)]
    scores = [(i, dice.choice([1, 1, 1, 2, 3, 4, 5, 6]), dice.choice([None, -3, 0, *range(13)])) for i in range(NOTICES) for _ in range(dice.randrange(5))]
    levels = ["high", "normal", "low", "none"]
    profiles = [(c, {t: dice.choice(levels) for t in dice.sample(range(1, 8), dice.randrange(5))}, dice.choice([[], [" "], ["anvil"]]) if c % 9 == 0 else [], [c] if c % 7 == 0 else [], dice.choice([None, 0.0, 1.0, 1024.0, 5e5, 2e6]), dice.choice([None, 0, -1, 7, 30, 300])) for c in range(CUSTOMERS)]
    likes = {(dice.randrange(CUSTOMERS), dice.randrange(NOTICES)): dice.choice([0.85, 0.1, -0.5]) for _ in range(400)}
    return (
        spark.createDataFrame(notices, "id long, org_id long, title string, close string, est_price double, type double").withColumn("close_dt", F.col("close").cast("timestamp_ntz")),
        spark.createDataFrame(scores, "notice_id long, topic long, l2 int"),
        spark.createDataFrame(profiles, FIELDS),
        spark.createDataFrame([(*k, v) for k, v in likes.items()], "customer int, id long, value double"),
    )


def of(rows):
    return sorted((r.variant, r.customer, r.id, r.score, r.place) for r in rows.collect())


@pytest.mark.parametrize("n", [1, 20])
def test_best_are_those_of_all_pairs(spark, frames, n):
    notices, scores, profiles, likes = frames
    now = F.lit("2000-01-10 12:00:00").cast("timestamp_ntz")
    scores = scores.fillna(0)
    pairs = interest.rule_scores(notices, scores, profiles, now, 0).withColumn("rule", F.col("score") / 100)
    pairs = interest.with_signals(pairs, {"like": likes})
    each = F.array(*[F.struct(F.lit(name).alias("variant"), f({"rule": F.col("rule"), "type": F.col("type"), "like": F.col("like")}).alias("score")) for name, f in VARIANTS.items()])
    every = pairs.select("customer", "id", "close_dt", F.inline(each))
    wanted = latest.top_per(every, ["variant", "customer"], interest.order(), n)
    args = (notices, scores, profiles, ["type"], {"like": likes}, VARIANTS, now)
    found = ranking.best(*args, n=n)
    assert of(found) == of(wanted)
    # Most pairs are never made; only customers whose filters leave too few provable notices need all of theirs.
    assert ranking.candidates(*args, n=1).count() < 0.35 * every.count()


def test_empty_tables(spark, frames):
    notices, scores, profiles, likes = frames
    now = F.lit("2000-01-10 12:00:00").cast("timestamp_ntz")
    for k in range(3):
        args = [f.limit(0) if i == k else f for i, f in enumerate((notices, scores, profiles))]
        found = ranking.best(*args, ["type"], {"like": likes}, VARIANTS, now)
        assert (found.count() > 0) == (k == 1)


def test_scores_are_compiled_by_the_jvm(spark, frames, capsys):
    """Methods of more than 8,000 bytes are interpreted by the JVM; scores of all variants in one method had over twice that."""
    notices, scores, profiles, likes = frames
    now = F.lit("2000-01-10 12:00:00").cast("timestamp_ntz")
    shared, own = ["work_type", "sllm", "a3"], ["liked", "clicked", "viewed"]
    known = notices.select("*", *[F.col("type").alias(name) for name in shared])
    variants = {"or": scoring.combine_noisy_or, "low": lambda s: scoring.combine_noisy_or(s, plans.LOW), "floor": lambda s: scoring.combine_noisy_or(s | {"sllm": scoring.floored(s["sllm"], 0.05)}), "mean": scoring.combine_average}
    customers = spark.createDataFrame([(1, {1: 40, 2: 30}, 1.0, 7, 3)], "customer int, points map<bigint, int>, price_min double, lead_days int, private long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a plan that adapts shows its code only after it has run
    try:
        bounds = ranking.lower_bounds(ranking.facts(known, scores, shared).cache(), customers, shared, own, variants, now, 20)
        pairs = ranking.candidates(known, scores, profiles, shared, dict.fromkeys(own, likes), variants, now)
        for plan in (bounds, pairs):
            plan.explain(mode="codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.fixture
def tables(monkeypatch):
    """Intermediate tables by label, as they are handed over to be written."""
    seen, put = {}, staging.written
    monkeypatch.setattr(staging, "written", lambda df, label: put(seen.setdefault(label, df), label))
    return seen


def test_bounds_of_all_variants_read_counts_of_like_notices(spark, frames, tables):
    notices, scores, profiles, likes = frames
    now = F.lit("2000-01-10 12:00:00").cast("timestamp_ntz")
    rows = staging.written(ranking.facts(notices.unionByName(notices.withColumn("id", F.col("id") + NOTICES)), scores.unionByName(scores.withColumn("notice_id", F.col("notice_id") + NOTICES)), ["type"]), "facts")
    customers = spark.createDataFrame([(1, {1: 40, 2: 30}, 1.0, 7, 3)], "customer int, points map<bigint, int>, price_min double, lead_days int, private long")
    bounds = ranking.lower_bounds(rows, customers, ["type"], ["like"], VARIANTS, now, 20)
    assert bounds.inputFiles() and not any("facts-" in f for f in bounds.inputFiles())
    shown = rows.select(F.explode("strengths").alias("topic", "s")).where("topic IN (1, 2)").count()
    assert tables["alike"].agg(F.sum("n")).first()[0] == shown > 1.9 * tables["alike"].count()


def test_signals_of_strangers_leave_before_they_are_grouped(spark, frames, tables):
    notices, scores, profiles, likes = frames
    now = F.lit("2000-01-10 12:00:00").cast("timestamp_ntz")
    grouped = likes.groupBy("customer", "id").agg(F.max("value").alias("value"))
    ranking.candidates(notices, scores, profiles.where("customer < 3"), ["type"], {"like": grouped}, VARIANTS, now)
    plan = tables["private"]._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.rindex("max(value") < plan.rindex("LeftSemi")


def test_a_breakdown_scores_its_own_variant_only(spark, tables):
    QUERIES["SCO_14_signal_breakdown"](spark, "/root/testdata/sf0.001")
    assert {r.variant for r in tables["limits"].select("variant").distinct().collect()} == {"current"}


def test_strengths_are_those_of_topics_grouped_alone(spark, frames):
    notices, scores, _, _ = frames
    wanted = interest.topic_strengths(scores).select("notice_id", "topic", scoring.strength(F.col("l2")).alias("strength"))
    found = ranking.facts(notices, scores, []).select("id", F.explode("strengths"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_topics_that_no_customer_asks_for_leave_before_they_are_dealt(spark, frames, tables):
    notices, scores, profiles, likes = frames
    now = F.lit("2000-01-10 12:00:00").cast("timestamp_ntz")
    few = profiles.limit(0).union(spark.createDataFrame([(1, {1: "high", 2: "low"}, [], [], None, 0), (2, {2: "low", 5: "none"}, ["anvil"], [], None, 0)], FIELDS))
    unnamed = scores.limit(1).select("notice_id", F.lit(None).cast("long").alias("topic"), "l2")
    args = (["type"], {"like": likes}, VARIANTS, now)
    found = ranking.best(notices, scores.unionByName(unnamed), few, *args)
    plan = tables["facts"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (topic" in plan[plan.index("RepartitionByExpression") :]
    facts = tables["facts"].select("most", F.explode("strengths").alias("topic", "strength"), F.size("strengths").alias("n"))
    assert {r.topic for r in facts.select("topic").distinct().collect()} == {1, 2, 5}
    # What a topic can give is what a customer gives it, not the highest level.
    assert facts.where("n = 1 AND topic = 2 AND most > 0.15").count() == 0 < facts.where("n = 1 AND topic = 2 AND most = 0.15").count()
    assert facts.where("n = 1 AND topic = 5 AND most > 0").count() == 0
    pairs = interest.with_signals(interest.rule_scores(notices, scores.fillna(0), few, now, 0).withColumn("rule", F.col("score") / 100), {"like": likes})
    each = F.array(*[F.struct(F.lit(name).alias("variant"), f({"rule": F.col("rule"), "type": F.col("type"), "like": F.col("like")}).alias("score")) for name, f in VARIANTS.items()])
    assert of(found) == of(latest.top_per(pairs.select("customer", "id", "close_dt", F.inline(each)), ["variant", "customer"], interest.order(), 20))
