"""The best notices of every customer under several ways to combine signals, without all pairs of customers and notices.

Two bounds decide which pairs are made at all.  Below: notices are counted in a cube of topic, level, score by that topic alone, price and lead; the score that
enough notices of one topic reach is a score that a customer's n-th best notice has at least.  Above: the score that a notice would have for a customer who gives
all its topics the highest level that any customer gives them.  Customers meet only notices whose upper bound lies in a band at or above their lower one, and a pair leaves the join
only if its exact score reaches it.  Pairs with a signal of their own (likes, clicks), a term or a followed organisation are few and are scored directly.

Null prices fail a floor, null ends never end, null strengths count as 0; a topic of an unknown level leads to notices without points; ties go to the earlier end, then the smaller id; a customer without
enough provable notices has the lower bound 0, so all its pairs are made, as its answer may need them; empty tables give an empty answer."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeworks.functions import scoring
from noticeworks.operators import interest, keywords, latest, staging

#: Scores are put into bands of so many points.
BAND = 5
#: Topics and levels beyond so many are not broadcast.
LOOKUP = 100_000
#: A way to combine signals of 0 to 1 (null: says nothing) to 0 to 100; it must not fall when the rule's signal rises.
Combine = Callable[[Mapping[str, Column]], Column]


def _bits(value: Column) -> Column:
    """Length of a whole number above 0 in binary; 0 for the rest."""
    return F.when(value >= 1, F.length(F.bin(value.cast("long")))).otherwise(0)


def facts(notices: DataFrame, scores: DataFrame, shared: list[str], asked: DataFrame | None = None) -> DataFrame:
    """A row for each notice with what ranking needs, its signals that hold for all customers, its strengths by topic and the most that its rule's signal can be.

    asked (topic, worth): the topics that any customer asks for and the most points one gives; scores of other topics leave before they are dealt.  Without it all stay, at the highest level."""
    highest = F.lit(max(scoring.PRIORITY_POINTS.values()))
    scores = scores.withColumn("worth", highest) if asked is None else scores.join(asked, "topic")
    # One list for each notice, in order of topic and strength, of which the last of a topic stays: no second grouping by topic.
    told = F.struct("topic", scoring.strength(F.greatest("l2", F.lit(0))).alias("strength"), "worth")
    listed = interest.dealt(scores, "worth").groupBy(F.col("notice_id").alias("id")).agg(F.sort_array(F.collect_list(told)).alias("told"))
    last = lambda x, i: ~F.get("told", i + 1)["topic"].eqNullSafe(x["topic"])
    # Behind the list's end there is null, which a topic without a name must not take for its like.
    kept = F.filter("told", lambda x, i: (i == F.size("told") - 1) | last(x, i))
    rows = notices.select("id", "org_id", "title", "close_dt", "est_price", *[F.col(name).cast("double").alias(name) for name in shared])
    # Lists are worked on after the join, where only those of the notices at hand are left.
    rows = rows.join(listed, "id", "left").withColumn("told", kept)
    strengths = F.map_from_entries(F.transform("told", lambda x: F.struct(x["topic"], x["strength"])))
    most = _rule(F.transform("told", lambda x: x["strength"] * x["worth"] / 100), F.lit(0))
    return rows.select(*rows.columns[:-1], strengths.alias("strengths"), most.alias("most"))


def _rule(chances: Column, added: Column, only: Column | None = None) -> Column:
    """The rule's signal, in whole hundredths.  only: the chance if there is but one, which needs no walk over an array; else null."""
    chance = scoring.noisy_or(F.sort_array(chances))
    chance = chance if only is None else F.coalesce(1 - (1 - only), chance)
    return scoring.whole(F.least(F.lit(100.0), F.coalesce(chance * 100, F.lit(0.0)) + added)) / 100


def _bound(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is worked out once: conditions on it are not pushed through a generator, where they would repeat the value."""
    return rows.withColumn(f"{name}_", F.array(value)).select(*rows.columns, F.explode(f"{name}_").alias(name))


def _by_variant(variants: Mapping[str, Combine], rows: Callable[[str, Combine], DataFrame]) -> DataFrame:
    """The rows of each variant one below the other.  Scores of all variants in one row make a method that the JVM does not compile, which takes ten times as long as reading the rows for each."""
    return reduce(DataFrame.unionByName, [rows(name, combine).withColumn("variant", F.lit(name)) for name, combine in variants.items()])


def _common(strengths: Column, points: Column) -> Column:
    """Topics that a notice and a customer share."""
    return F.array_intersect(F.map_keys(strengths), F.map_keys(points))


def lower_bounds(rows: DataFrame, customers: DataFrame, shared: list[str], own: list[str], variants: Mapping[str, Combine], now: Column, n: int) -> DataFrame:
    """variant, customer, least: a score that n notices of the customer reach at least, shown by one topic; customers without one are left out.

    The cube grows with topics, not with notices or customers; customers who want the same are looked up as one."""
    silent = {name: F.lit(None).cast("double") for name in own}
    asked = customers.select(F.explode("points").alias("topic", "points")).where("points > 0").distinct()
    # As many rows as topics times levels, if the topics are a dictionary as they should be; counted all the same.
    asked = F.broadcast(asked) if asked.limit(LOOKUP + 1).count() <= LOOKUP else asked
    days = F.timestamp_diff("DAY", now, F.col("close_dt"))
    met = (
        rows.where("strengths is not null")
        .withColumn("price", _bits(F.coalesce("est_price", F.lit(0.0)))).withColumn("ahead", F.when(F.col("close_dt").isNull(), 99).otherwise(_bits(days)))
        .select("price", "ahead", *shared, F.explode("strengths").alias("topic", "strength"))
        .join(asked, "topic")
        .withColumn("rule", scoring.whole(F.col("points") * F.col("strength")) / 100)
    )
    # Notices alike in all that the variants look at are counted once, so the variants read the counts and not the notices.
    met = staging.written(met.groupBy("topic", "points", "rule", *shared, "price", "ahead").agg(F.count("*").alias("n")), "alike")
    signals = {"rule": F.col("rule"), **{s: F.col(s) for s in shared}, **silent}
    cells = _by_variant(variants, lambda _, combine: met.select("topic", "points", combine(signals).alias("score"), "price", "ahead", "n"))
    cells = cells.groupBy("variant", "topic", "points", "score", "price", "ahead").agg(F.sum("n").alias("n"))
    # A class of k bits starts at 2^(k-1), so one more bit than the customer's limit has is surely enough.
    lead = F.coalesce("lead_days", F.lit(7))
    wants = customers.select(
        "customer", F.explode("points").alias("topic", "points"), F.when(F.col("price_min").isNull(), 0).otherwise(_bits(F.greatest(F.ceil("price_min"), F.lit(1))) + 1).alias("from_price"),
        F.when(lead <= 0, 0).otherwise(_bits(lead) + 1).alias("from_ahead"), _bits(F.col("private") + F.lit(n)).alias("bits"),
    )
    same = ["topic", "points", "from_price", "from_ahead", "bits"]
    met = wants.select(same).distinct().join(cells, ["topic", "points"]).where("price >= from_price and ahead >= from_ahead")
    per_score = met.groupBy("variant", *same, "score").agg(F.sum("n").alias("n"))
    reached = F.sum("n").over(W.partitionBy("variant", *same).orderBy(F.desc("score")))
    proven = per_score.withColumn("reached", reached).where(F.col("reached") >= F.pow(F.lit(2), F.col("bits"))).groupBy("variant", *same).agg(F.max("score").alias("least"))
    return wants.join(proven, same).groupBy("variant", "customer").agg(F.max("least").alias("least"))


def candidates(notices: DataFrame, scores: DataFrame, profiles: DataFrame, shared: list[str], own: Mapping[str, DataFrame], variants: Mapping[str, Combine], now: Column, n: int = 20) -> DataFrame:
    """variant, customer, id, score and signals of all pairs that may be among a customer's n best; profiles as in `interest.rule_scores`.

    shared names columns of notices; own signals are (customer, id, value), one row per pair."""
    said = {s: F.col(s) for s in shared}
    level = F.create_map(*[F.lit(x) for pair in scoring.PRIORITY_POINTS.items() for x in pair])
    points = F.transform_values(F.coalesce("priorities", F.create_map().cast("map<bigint,string>")), lambda _, p: F.coalesce(F.try_element_at(level, p), F.lit(0)))
    asked = profiles.select(F.explode(points).alias("topic", "worth")).groupBy("topic").agg(F.max("worth").alias("worth"))
    asked = F.broadcast(asked) if asked.limit(LOOKUP + 1).count() <= LOOKUP else asked
    rows = staging.written(facts(notices.where(interest.open_still(now)), scores, shared, asked), "facts")

    terms = profiles.select("customer", F.explode("terms").alias("term")).withColumn("term", F.trim("term")).where("term != ''")
    by_term = keywords.containing(rows.select("id", "title"), terms, "title").select("customer", "id", F.lit("term").alias("signal"), F.lit(float(scoring.TERM_POINTS)).alias("value"))
    follows = profiles.select("customer", F.explode("org_ids").alias("org_id"))
    by_org = rows.select("id", "org_id").join(follows, "org_id").select("customer", "id", F.lit("org").alias("signal"), F.lit(float(scoring.ORG_POINTS)).alias("value"))
    # Signals of other customers leave where they are read, before anything is grouped.
    asking = profiles.select("customer").distinct()
    asking = F.broadcast(asking) if asking.limit(LOOKUP + 1).count() <= LOOKUP else asking
    found = [values.join(asking, "customer", "left_semi").select("customer", "id", F.lit(name).alias("signal"), F.col("value").cast("double").alias("value")) for name, values in own.items()]
    stacked = reduce(DataFrame.unionByName, [by_term, by_org, *found])
    private = stacked.groupBy("customer", "id").agg(*[F.max(F.when(F.col("signal") == name, F.col("value"))).alias(name) for name in ("term", "org", *own)])
    private = staging.written(private.join(asking, "customer", "left_semi"), "private")

    told = private.where(F.coalesce(*[F.col(name) for name in own]).isNotNull()).groupBy("customer").agg(F.count("*").alias("private")) if own else None
    customers = profiles.select("customer", points.alias("points"), "price_min", "lead_days")
    customers = customers.join(told, "customer", "left").fillna(0, ["private"]) if own else customers.withColumn("private", F.lit(0))
    bounds = lower_bounds(rows, customers, shared, list(own), variants, now, n)
    names = F.array(*[F.lit(name) for name in variants])
    limits = customers.select("*", F.explode(names).alias("variant")).join(bounds, ["variant", "customer"], "left").fillna(0, ["least"]).drop("private")
    limits = staging.written(limits, "limits")

    allowed = interest.hard_filter(F.col("price_min"), F.col("lead_days"), now)
    chances = F.transform(_common(F.col("strengths"), F.col("points")), lambda t: F.element_at("points", t) * F.element_at("strengths", t) / 100)

    # Pairs that only topics lead to.  A bound is raised by one point against noise of the last digit.
    silent = {name: F.lit(None).cast("double") for name in own}
    wanted = limits.select("*", F.explode("points").alias("topic", "worth")).select("*", F.explode(F.sequence(F.floor(F.col("least") / BAND), F.lit(101 // BAND).cast("long"))).alias("band"))
    both = F.transform("both", lambda t: F.element_at("points", t) * F.element_at("strengths", t) / 100)
    only = F.when(F.size("both") == 1, F.col("worth") * F.col("strength") / 100)

    # One number a variant: notices that reach no customer's bound leave before their topics are told apart.
    floors = {r.variant: r.least for r in wanted.groupBy("variant").agg(F.min("least").alias("least")).collect()}

    def led_by(name: str, combine: Combine) -> DataFrame:
        reach = rows.where("strengths is not null").withColumn("bound", combine({"rule": F.col("most"), **said, **silent}) + 1)
        reach = reach.where(F.col("bound") >= F.lit(floors.get(name)))
        reach = reach.select("bound", F.floor(F.col("bound") / BAND).alias("band"), F.explode("strengths").alias("topic", "strength"), "id", "close_dt", "est_price", "strengths", *shared)
        pairs = reach.join(wanted.where(F.col("variant") == name).drop("variant"), ["topic", "band"]).where((F.col("bound") >= F.col("least")) & allowed)
        pairs = _bound(pairs, "both", _common(F.col("strengths"), F.col("points"))).where(F.col("topic") == F.array_min("both"))
        pairs = _bound(pairs, "rule", _rule(both, F.lit(0), only))
        return _bound(pairs, "score", combine({"rule": F.col("rule"), **said, **silent})).where(F.col("score") >= F.col("least"))

    led = _by_variant(variants, led_by).join(private.select("customer", "id"), ["customer", "id"], "left_anti")

    # Pairs with something of their own.
    added = F.coalesce("term", F.lit(0.0)) + F.coalesce("org", F.lit(0.0))
    rule = _rule(F.coalesce(chances, F.array().cast("array<double>")), added)
    led_to = (added > 0) | (F.size(F.coalesce(_common(F.col("strengths"), F.col("points")), F.array().cast("array<bigint>"))) > 0)
    paired = private.join(rows, "id").join(customers.drop("private"), "customer").where(led_to & allowed)
    paired = staging.written(paired.withColumn("rule", rule), "paired")

    def direct_by(name: str, combine: Combine) -> DataFrame:
        least = limits.where(F.col("variant") == name).select("customer", "least")
        scored = _bound(paired, "score", combine({"rule": F.col("rule"), **said, **{s: F.col(s) for s in own}}))
        return scored.join(least, "customer").where(F.col("score") >= F.col("least"))

    direct = _by_variant(variants, direct_by)

    strong = F.array_sort(F.transform(F.coalesce(_common(F.col("strengths"), F.col("points")), F.array().cast("array<bigint>")), lambda t: F.struct(t.alias("topic"), F.element_at("strengths", t).alias("strength"))))
    out = ["variant", "customer", "id", "score", "close_dt", "rule", *shared]
    return led.select(*out, *[value.alias(name) for name, value in silent.items()], strong.alias("topics")).unionByName(direct.select(*out, *own, strong.alias("topics")))


def best(*args, n: int = 20, **named) -> DataFrame:
    """The n best of each variant and customer, with their place, signals and topics; arguments as for `candidates`."""
    return latest.top_per(candidates(*args, n=n, **named), ["variant", "customer"], interest.order(), n)
