"""Keyword scores, customer matches, signals, vectors, requirements and eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import labels, scoring
from noticeworks.operators import dedup, interest, keywords, ranking, upkeep, vectors
from noticeworks.plans.listings import GOV, base
from noticeworks.plans.registry import query
from noticeworks.sources.fixtures import Frames
from noticeworks.streaming import engagement

RULES = ((1, 1, "red", 4), (2, 1, "Hot", 2), (3, 2, "widget", 2), (4, 2, "ring", 1), (5, 3, "old", -5), (6, 3, "anvil", 4), (7, 4, "l", 1), (8, 4, "ge", 1))
RULES_SQL = "rules(rule_id, topic, term, weight) AS (VALUES " + ", ".join(f"({i}, {t}, '{w}', {p})" for i, t, w, p in RULES) + ")"
#: Profiles of customers: topics with priorities, terms, followed organisations, price floor, lead days.
PROFILES = (
    (1, {1: "high", 4: "normal", 9: "low"}, ["gizmo", " "], [5, 6, 7], 20_000.0, None),
    (2, {2: "high", 3: "high", 5: "high", 11: "high"}, [], [], None, 0),
    (3, {7: "low"}, ["Cold Ring"], [10, 20, 30, 40], 100_000.0, 30),
    (4, {}, ["anvil"], [], None, 7),
)
PROFILES_SQL = """
    topics(customer, topic, points) AS (VALUES (1, 1, 40), (1, 4, 30), (1, 9, 15), (2, 2, 40), (2, 3, 40), (2, 5, 40), (2, 11, 40), (3, 7, 15)),
    terms(customer, term) AS (VALUES (1, 'gizmo'), (3, 'cold ring'), (4, 'anvil')),
    follows(customer, org_id) AS (VALUES (1, 5), (1, 6), (1, 7), (3, 10), (3, 20), (3, 30), (3, 40)),
    limits(customer, price_min, lead) AS (VALUES (1, 20000.0, 7), (2, NULL, 0), (3, 100000.0, 30), (4, NULL, 7)),
    strengths AS (SELECT notice_id, topic, greatest(0.15, least(1.0, greatest(max(l2), 0) / 10.0)) AS strength FROM scores GROUP BY 1, 2),
    by_topic AS (SELECT customer, notice_id AS id, (1 - product(1 - points * strength / 100.0)) * 100 AS points FROM strengths JOIN topics USING (topic) GROUP BY 1, 2),
    by_term AS (SELECT DISTINCT customer, id, 25 AS points FROM notices JOIN terms ON contains(lower(title), term)),
    by_org AS (SELECT customer, id, 20 AS points FROM notices JOIN follows USING (org_id)),
    added AS (SELECT customer, id, round_even(least(100, round(sum(points), 9)), 0)::INTEGER AS score FROM (SELECT * FROM by_topic UNION ALL SELECT * FROM by_term UNION ALL SELECT * FROM by_org) GROUP BY 1, 2),
    passed AS MATERIALIZED (SELECT a.customer, a.score, s.* FROM added a JOIN limits l USING (customer) JOIN statused s USING (id)
        WHERE score >= 30 AND (close_dt IS NULL OR (close_dt >= TIMESTAMP '2000-01-01' AND close_dt >= TIMESTAMP '2000-01-01' + to_days(lead))) AND (price_min IS NULL OR coalesce(est_price >= price_min, false)))
"""
SECTION_SQL = "CASE WHEN stage = 'P' OR (channel = 'ASIA' AND bid_status IN ('upcoming', 'unscheduled')) THEN 'prenotice' ELSE 'active' END"
MATCHES_SQL = f"""
    WITH {PROFILES_SQL}, sectioned AS (SELECT *, {SECTION_SQL} AS section FROM passed),
    a AS (SELECT *, row_number() OVER (PARTITION BY customer, section ORDER BY score DESC, close_dt ASC NULLS LAST, id) AS n FROM sectioned),
    b AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY score DESC, close_dt ASC NULLS LAST, id) AS place FROM a WHERE n <= CASE section WHEN 'prenotice' THEN 10 ELSE 20 END)
"""


def rules(t: Frames) -> DataFrame:
    return t.spark.createDataFrame([*RULES], "rule_id int, topic int, term string, weight int")


def profiles(t: Frames) -> DataFrame:
    return t.spark.createDataFrame([*PROFILES], "customer int, priorities map<bigint, string>, terms array<string>, org_ids array<bigint>, price_min double, lead_days int")


def matches(t: Frames, least: int = scoring.MIN_SCORE) -> DataFrame:
    scored = interest.rule_scores(base(t), t.scores, profiles(t), t.now, least)
    return scored.withColumn("section", labels.section(F.col("stage"), labels.notice_type(F.col("channel"), GOV), F.col("bid_status"), "P"))


@query("AGG_18_JOIN_15_keyword_presence", f"""
    WITH {RULES_SQL} SELECT id, topic, sum(weight)::BIGINT AS score, string_agg(term, ',' ORDER BY rule_id) AS terms FROM notices JOIN rules ON contains(lower(title), lower(term)) GROUP BY 1, 2 HAVING sum(weight) >= 2""")
def agg_18(t: Frames) -> DataFrame:
    return keywords.presence_scores(t.notices, rules(t))


FREQ_SQL = f"""
    WITH {RULES_SQL}, d AS (SELECT l_orderkey AS id, string_agg(p_name, ' ' ORDER BY l_linenumber, l_partkey) AS text FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    x AS (SELECT n.id, topic, rule_id, term, (length(lower(coalesce(title, ''))) - length(replace(lower(coalesce(title, '')), lower(term), ''))) // length(term) + (length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), lower(term), ''))) // length(term) AS times, weight * (5 * ((length(lower(coalesce(title, ''))) - length(replace(lower(coalesce(title, '')), lower(term), ''))) // length(term)) + (length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), lower(term), ''))) // length(term)) AS s
        FROM notices n LEFT JOIN d ON d.id = n.id CROSS JOIN rules),
    f AS (SELECT id, topic, sum(s)::BIGINT AS score, min(rule_id) AS first_rule, string_agg(term || '×' || times::BIGINT::VARCHAR, ',' ORDER BY rule_id) AS terms FROM x WHERE s <> 0 GROUP BY 1, 2)
"""


def frequencies(t: Frames) -> DataFrame:
    lines = t.table("lineitem").join(t.table("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    texts = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))).alias("p"))
    docs = t.notices.select("id", "title").join(texts.select("id", F.array_join("p.p_name", " ").alias("text")), "id", "left")
    return keywords.frequency_scores(docs, rules(t))


@query("AGG_19_keyword_frequency", FREQ_SQL + "SELECT id, topic, score, terms FROM f")
def agg_19(t: Frames) -> DataFrame:
    return frequencies(t).select("id", "topic", "score", "terms")


@query("WIN_10_SNK_05_document_topics", FREQ_SQL + "SELECT id, topic, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, first_rule) AS n FROM f) WHERE n <= 3 AND id >= 0")
def win_10(t: Frames) -> DataFrame:
    return keywords.top_topics(frequencies(t)).select("id", "topic", "score")


@query("SNK_04_SCO_25_26_new_pairs", f"""
    WITH {RULES_SQL}, p AS (SELECT id AS notice_id, topic FROM notices JOIN rules ON contains(lower(title), lower(term)) GROUP BY 1, 2 HAVING sum(weight) >= 2)
    SELECT notice_id, topic FROM p WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.notice_id = p.notice_id AND s.topic = p.topic)""")
def snk_04(t: Frames) -> DataFrame:
    pairs = keywords.presence_scores(t.notices, rules(t)).select(F.col("id").alias("notice_id"), F.col("topic").cast("long").alias("topic"))
    return pairs.join(t.scores.select("notice_id", "topic").distinct(), ["notice_id", "topic"], "left_anti")


@query("SCO_01_02_strength", "SELECT notice_id, topic, l2, greatest(0.15, least(1.0, l2 / 10.0))::DOUBLE AS strength, CASE WHEN greatest(0.15, least(1.0, l2 / 10.0)) >= 0.66 THEN '강한 일치' WHEN greatest(0.15, least(1.0, l2 / 10.0)) >= 0.33 THEN '보통 일치' ELSE '약한 일치' END AS label FROM scores")
def sco_01(t: Frames) -> DataFrame:
    strength = scoring.strength(F.col("l2"))
    return t.scores.select("notice_id", "topic", "l2", strength.alias("strength"), labels.strength_label(strength).alias("label"))


@query("SCO_03_04_FLT_14_rule_scores", f"WITH {PROFILES_SQL} SELECT customer, id, score FROM passed")
def sco_03(t: Frames) -> DataFrame:
    return matches(t).select("customer", "id", "score")


@query("Q_11_WIN_08_SRT_06_customer_matches", MATCHES_SQL + "SELECT customer, id, score, section, place::INTEGER AS place FROM b WHERE place <= 30")
def q_11(t: Frames) -> DataFrame:
    return interest.top_matches(matches(t)).select("customer", "id", "score", "section", "place")


@query("Q_13_SNK_11_report_snapshot", MATCHES_SQL + "SELECT customer, count(*) AS total, count(*) FILTER (close_dt BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-01-08') AS closing, max(score) AS top, string_agg(id::VARCHAR || ':' || score::VARCHAR, ',' ORDER BY place) AS notices FROM b WHERE place <= 30 GROUP BY 1")
def q_13(t: Frames) -> DataFrame:
    picked = interest.top_matches(matches(t))
    soon = F.col("close_dt").between(t.now, t.now + F.expr("INTERVAL 7 DAYS"))
    rows = picked.groupBy("customer").agg(F.count("*").alias("total"), F.count_if(soon).alias("closing"), F.max("score").alias("top"), F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("n"))
    return rows.select("customer", "total", "closing", "top", F.array_join(F.transform("n", lambda x: F.concat_ws(":", x["id"].cast("string"), x["score"].cast("string"))), ",").alias("notices"))


@query("SRT_13_SNK_19_letter", MATCHES_SQL + "SELECT customer, section, count(*) AS n, min(place)::INTEGER AS first FROM b WHERE place <= 20 GROUP BY 1, 2")
def srt_13(t: Frames) -> DataFrame:
    return interest.top_matches(matches(t), limit=20).groupBy("customer", "section").agg(F.count("*").alias("n"), F.min("place").alias("first"))


SIGNALS_SQL = f"""
    WITH {PROFILES_SQL.replace('score >= 30 AND', '')},
    liked AS (SELECT customer_id AS customer, notice_id AS id FROM (SELECT customer_id, notice_id, arg_max(event_type, (ts, event_id)) AS state FROM evs WHERE event_type IN ('like', 'unlike') GROUP BY 1, 2) WHERE state = 'like'),
    clicked AS (SELECT DISTINCT customer_id AS customer, notice_id AS id FROM evs WHERE event_type = 'click'), viewed AS (SELECT DISTINCT customer_id AS customer, notice_id AS id FROM evs WHERE event_type = 'view'),
    conf AS (SELECT notice_id AS id, max(priority) AS value FROM scores GROUP BY 1), a3 AS (SELECT notice_id AS id FROM (SELECT notice_id, arg_max(step, ver) AS step FROM analyses GROUP BY 1) WHERE step = 'assistant'),
    sig AS MATERIALIZED (SELECT p.customer, p.id, p.close_dt, p.score / 100.0 AS rule, CASE biz_type WHEN '1-URGENT' THEN 0.6 WHEN '5-LOW' THEN -0.6 END AS work_type, conf.value AS sllm, CASE WHEN a3.id IS NOT NULL THEN 0.9 END AS a3,
        CASE WHEN liked.id IS NOT NULL THEN 0.85 END AS liked, CASE WHEN clicked.id IS NOT NULL THEN 0.5 END AS clicked, CASE WHEN viewed.id IS NOT NULL THEN 0.55 END AS viewed
        FROM passed p LEFT JOIN liked ON liked.customer = p.customer AND liked.id = p.id LEFT JOIN clicked ON clicked.customer = p.customer AND clicked.id = p.id
        LEFT JOIN viewed ON viewed.customer = p.customer AND viewed.id = p.id LEFT JOIN conf ON conf.id = p.id LEFT JOIN a3 ON a3.id = p.id)
"""


def _or_sql(names: dict[str, float], floor: float = 0) -> str:
    value = lambda n: f"CASE WHEN abs({n}) >= {floor} THEN {n} END" if floor and n == "sllm" else n
    up = " * ".join(f"(1 - coalesce(CASE WHEN {value(n)} >= 0 THEN least(1.0, {w} * {value(n)}) END, 0))" for n, w in names.items())
    down = " * ".join(f"(1 - coalesce(CASE WHEN {value(n)} < 0 THEN least(1.0, {w} * abs({value(n)})) END, 0))" for n, w in names.items())
    return f"round_even(round((1 - {up}) * ({down}) * 100, 9), 0)::INTEGER"


def _average_sql(names: dict[str, float]) -> str:
    total = " + ".join(f"coalesce({w} * {n}, 0)" for n, w in names.items())
    weights = " + ".join(f"CASE WHEN {n} IS NULL THEN 0.0 ELSE {w} END" for n, w in names.items())
    return f"round_even(round(greatest(0, least(1, ({total}) / ({weights}))) * 100, 9), 0)::INTEGER"


def signal_frames(t: Frames) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Signals (value) of notices, and of customers and notices."""
    of = lambda kind: t.events.where(F.col("event_type").isin(*kind)).select(F.col("customer_id").alias("customer"), F.col("notice_id").alias("id"), "event_type", "ts", "event_id")
    state = of(("like", "unlike")).groupBy("customer", "id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    fixed = lambda rows, value: rows.select("customer", "id").distinct().withColumn("value", F.lit(value))
    last = t.analyses.groupBy(F.col("notice_id").alias("id")).agg(F.max_by("step", "ver").alias("step"))
    told = {"sllm": t.scores.groupBy(F.col("notice_id").alias("id")).agg(F.max("priority").alias("value")), "a3": last.where("step = 'assistant'").select("id", F.lit(0.9).alias("value"))}
    return told, {"liked": fixed(state.where("state = 'like'"), 0.85), "clicked": fixed(of(("click",)), 0.5), "viewed": fixed(of(("view",)), 0.55)}


def signals(t: Frames) -> DataFrame:
    """Every candidate of every customer with its signals; null means that a signal says nothing."""
    rows = matches(t, 0).withColumn("rule", F.col("score") / 100)
    prefs = F.create_map(F.lit("1-URGENT"), F.lit("positive"), F.lit("5-LOW"), F.lit("negative"))
    rows = rows.withColumn("work_type", scoring.work_type_signal(prefs, F.lit(None).cast("string"), F.col("biz_type")))
    told, own = signal_frames(t)
    return interest.with_signals(rows, told | own)


EXTRA = ("work_type", "sllm", "a3", "liked", "clicked", "viewed")


@query("SCO_05_to_09_signals", SIGNALS_SQL + "SELECT customer, id, rule::DOUBLE AS rule, work_type::DOUBLE AS work_type, sllm::DOUBLE AS sllm, a3::DOUBLE AS a3, liked::DOUBLE AS liked, clicked::DOUBLE AS clicked, viewed::DOUBLE AS viewed FROM sig")
def sco_05(t: Frames) -> DataFrame:
    return signals(t).select("customer", "id", "rule", *EXTRA)


PRESETS = {"rule": (), **{f"rule_{n}": (n,) for n in EXTRA}}


@query("SCO_11_14_15_presets", SIGNALS_SQL + " UNION ALL ".join(f"SELECT '{name}' AS preset, customer, id, {_or_sql({n: 1.0 for n in ('rule', *extra)})} AS score FROM sig" for name, extra in PRESETS.items()))
def sco_11(t: Frames) -> DataFrame:
    rows = signals(t)
    each = [F.struct(F.lit(name).alias("preset"), scoring.combine_noisy_or({n: F.col(n) for n in ("rule", *extra)}).alias("score")) for name, extra in PRESETS.items()]
    return rows.select("customer", "id", F.inline(F.array(*each))).select("preset", "customer", "id", "score")


LOW = {"rule": 1.0, **dict.fromkeys(EXTRA, 0.5)}
FULL = dict.fromkeys(("rule", *EXTRA), 1.0)
VARIANTS_SQL = " UNION ALL ".join(f"SELECT '{name}' AS variant, customer, id, close_dt, {expr} AS score FROM sig" for name, expr in (("current", _or_sql(FULL)), ("low_weight", _or_sql(LOW)), ("floor", _or_sql(FULL, 0.05)), ("average", _average_sql(FULL))))


BEST_SQL = SIGNALS_SQL + f", v AS ({VARIANTS_SQL}), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, customer ORDER BY score DESC, close_dt ASC NULLS LAST, id) AS place FROM v) WHERE place <= 20) "


def best(t: Frames, customers: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """The 20 best notices of each customer by each way to combine all signals, or by one of them only."""
    floor = lambda s: s | {"sllm": scoring.floored(s["sllm"], 0.05)}
    variants = {
        "current": scoring.combine_noisy_or, "low_weight": lambda s: scoring.combine_noisy_or(s, LOW),
        "floor": lambda s: scoring.combine_noisy_or(floor(s)), "average": scoring.combine_average,
    }
    variants = {only: variants[only]} if only else variants
    told, own = signal_frames(t)
    prefs = F.create_map(F.lit("1-URGENT"), F.lit("positive"), F.lit("5-LOW"), F.lit("negative"))
    rows = t.notices.withColumn("work_type", scoring.work_type_signal(prefs, F.lit(None).cast("string"), F.col("biz_type")))
    rows = interest.with_signals(rows, told)
    return ranking.best(rows, t.scores, profiles(t) if customers is None else customers, ["work_type", *told], own, variants, t.now)


@query("SCO_12_13_16_17_Q_12_variants", BEST_SQL + "SELECT variant, customer, id, score, place::INTEGER AS place FROM best")
def sco_16(t: Frames) -> DataFrame:
    return best(t).select("variant", "customer", "id", "score", "place")


@query("SCO_14_signal_breakdown", BEST_SQL + """
    SELECT customer, id, best.score, place::INTEGER AS place, sig.rule::DOUBLE AS rule, work_type::DOUBLE AS work_type, sllm::DOUBLE AS sllm, a3::DOUBLE AS a3, liked::DOUBLE AS liked, clicked::DOUBLE AS clicked, viewed::DOUBLE AS viewed,
           (SELECT string_agg(topic || ':' || round(strength, 2), ',' ORDER BY topic) FROM strengths s JOIN topics p USING (topic) WHERE s.notice_id = id AND p.customer = best.customer) AS topics
    FROM best JOIN sig USING (customer, id) WHERE variant = 'current'""")
def sco_14(t: Frames) -> DataFrame:
    """The ranking with what each signal says of a notice; null means that it says nothing."""
    topics = F.nullif(F.array_join(F.transform("topics", lambda x: F.concat_ws(":", x["topic"], F.round(x["strength"], 2))), ","), F.lit(""))
    return best(t, only="current").select("customer", "id", "score", "place", "rule", *EXTRA, topics.alias("topics"))


@query("SCO_17_Q_12_compared", BEST_SQL + f"""
    SELECT variant AS profile, customer, id, score, place::INTEGER AS place FROM best
    UNION ALL SELECT 'live', customer, id, score, place::INTEGER FROM ({MATCHES_SQL} SELECT * FROM b) WHERE place <= 30""")
def sco_17(t: Frames) -> DataFrame:
    """The live report of each customer beside the rankings of every variant."""
    live = interest.top_matches(matches(t)).select(F.lit("live").alias("profile"), "customer", "id", "score", "place")
    return live.unionByName(best(t).select(F.col("variant").alias("profile"), "customer", "id", "score", "place"))


@query("SCO_10_18_SRT_09_cosine", """
    WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0),
    s AS (SELECT vec_id, label, greatest(0.0, 1 - (1 - list_dot_product(embedding::DOUBLE[], qe::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(qe::DOUBLE[], qe::DOUBLE[])))) / 2) AS sim FROM embeddings, q)
    SELECT vec_id, label, round(100 * sim, 6) AS score FROM s ORDER BY sim DESC, vec_id LIMIT 20""", False)
def sco_10(t: Frames) -> DataFrame:
    wanted = t.table("embeddings").where("vec_id = 0").select(F.col("embedding").alias("wanted")).limit(1)
    rows = t.table("embeddings").crossJoin(F.broadcast(wanted)).withColumn("sim", scoring.similarity(F.col("embedding"), F.col("wanted")))
    return rows.orderBy(F.desc("sim"), "vec_id").limit(20).select("vec_id", "label", F.round(100 * F.col("sim"), 6).alias("score"))


NEAREST_SQL = """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round((1 + list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)))) / 2, 12) AS similarity FROM v q CROSS JOIN v WHERE q.vec_id % 100 = 0)
    SELECT query_id, id, place::INTEGER AS place, round(100 * similarity, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place FROM s) WHERE place <= 20
"""


def _vectors(t: Frames) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the stated queries: those whose number is divisible by 100."""
    rows = t.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rows, rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")


@query("SCO_10_nearest_exact", NEAREST_SQL, False)
def sco_10_exact(t: Frames) -> DataFrame:
    return vectors.nearest_exact(*_vectors(t)).select("query_id", "id", "place", F.round(100 * F.col("similarity"), 6).alias("score"))


@query("SCO_18_SRT_09_nearest_by_index", NEAREST_SQL, False)
def sco_18_index(t: Frames) -> DataFrame:
    """The same through the inverted file, completed by the cells that may hold a nearer vector."""
    rows, asked = _vectors(t)
    return vectors.nearest(vectors.indexed(rows), asked, complete=True).select("query_id", "id", "place", F.round(100 * F.col("similarity"), 6).alias("score"))


@query("SCO_10_weighted_pair", "SELECT id, coalesce(0.6 * a + 0.4 * b, a, b) AS value FROM (SELECT id, CASE WHEN id % 3 <> 0 THEN est_price END AS a, CASE WHEN id % 5 <> 0 THEN org_id::DOUBLE END AS b FROM notices)")
def sco_10_pair(t: Frames) -> DataFrame:
    a, b = F.when(F.col("id") % 3 != 0, F.col("est_price")), F.when(F.col("id") % 5 != 0, F.col("org_id").cast("double"))
    return t.notices.select("id", scoring.weighted_pair(a, b).alias("value"))


@query("SCO_19_requirements", """
    WITH r AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'gte' WHEN 1 THEN 'lte' WHEN 2 THEN 'eq' WHEN 3 THEN 'contains' ELSE 'manual' END AS op,
        CASE WHEN p_size % 7 = 0 THEN 'about ' || p_size WHEN p_size % 5 = 3 THEN left(p_name, 3) ELSE '1,00' || (p_size % 10) END AS value, CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_size % 5 = 3 THEN upper(p_name) ELSE '100' || (p_partkey % 10) END END AS product,
        CASE WHEN p_partkey % 3 = 0 THEN ' kg' ELSE '' END AS unit, CASE WHEN p_partkey % 6 = 0 THEN 'kg' ELSE 'g' END AS product_unit FROM part),
    n AS (SELECT *, try_cast(replace(value, ',', '') AS DOUBLE) AS theirs, try_cast(replace(product, ',', '') AS DOUBLE) AS mine FROM r)
    SELECT p_partkey, CASE WHEN product IS NULL OR op = 'manual' THEN 'unknown' WHEN unit <> '' AND trim(unit) <> product_unit THEN 'unknown'
        WHEN op = 'contains' THEN CASE WHEN contains(lower(trim(product)), lower(trim(value))) THEN 'ok' ELSE 'no' END
        WHEN op = 'eq' THEN CASE WHEN CASE WHEN mine IS NOT NULL AND theirs IS NOT NULL THEN mine = theirs ELSE lower(trim(product)) = lower(trim(value)) END THEN 'ok' ELSE 'no' END
        WHEN mine IS NULL OR theirs IS NULL THEN 'unknown' WHEN op = 'gte' THEN CASE WHEN mine >= theirs THEN 'ok' ELSE 'no' END ELSE CASE WHEN mine <= theirs THEN 'ok' ELSE 'no' END END AS verdict FROM n""", False)
def sco_19(t: Frames) -> DataFrame:
    size, key, name = F.col("p_size"), F.col("p_partkey"), F.col("p_name")
    op = F.element_at(F.array(*map(F.lit, ("gte", "lte", "eq", "contains", "manual"))), (size % 5 + 1).cast("int"))
    value = F.when(size % 7 == 0, F.concat(F.lit("about "), size.cast("string"))).when(size % 5 == 3, F.left(name, F.lit(3))).otherwise(F.concat(F.lit("1,00"), (size % 10).cast("string")))
    product = F.when(key % 11 != 0, F.when(size % 5 == 3, F.upper(name)).otherwise(F.concat(F.lit("100"), (key % 10).cast("string"))))
    verdict = scoring.requirement_verdict(value, op, product, F.when(key % 3 == 0, " kg").otherwise(""), F.when(key % 6 == 0, "kg").otherwise("g"))
    return t.table("part").select("p_partkey", verdict.alias("verdict"))


ELIGIBLE_SQL = """
    WITH axes AS (SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN [] ELSE [biz_type, '2-HIGH'] END AS sizes, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 3 = 1 END AS institute,
        CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN [] ELSE [stage] END AS codes, CASE WHEN id % 7 = 0 THEN ['ISO ' || stage, 'gs'] ELSE [] END AS certs FROM notices),
    v AS (SELECT id, CASE WHEN sizes IS NULL THEN 'unknown' WHEN len(sizes) = 0 THEN 'ok' WHEN list_contains(sizes, '1-URGENT') THEN 'ok' ELSE 'no' END AS size, CASE WHEN institute IS NULL THEN 'unknown' WHEN NOT institute THEN 'ok' ELSE 'unknown' END AS lab,
        CASE WHEN codes IS NULL THEN 'unknown' WHEN len(codes) = 0 THEN 'ok' WHEN list_has_any(codes, ['F', 'O']) THEN 'ok' ELSE 'no' END AS code,
        CASE WHEN len(certs) = 0 THEN 'ok' WHEN contains(lower(certs[1]), 'iso o') THEN 'ok' ELSE 'no' END AS cert FROM axes),
    w AS (SELECT *, CASE WHEN 'no' IN (size, lab, code, cert) THEN 'no' WHEN 'unknown' IN (size, lab, code, cert) THEN 'unknown' ELSE 'ok' END AS verdict FROM v)
"""


def eligibility(t: Frames) -> DataFrame:
    c, none = F.col("id"), F.array().cast("array<string>")
    sizes = F.when(c % 4 == 0, None).when(c % 4 == 1, none).otherwise(F.array("biz_type", F.lit("2-HIGH")))
    institute = F.when(c % 3 == 0, None).otherwise(c % 3 == 1)
    codes = F.when(c % 5 == 0, None).when(c % 5 == 1, none).otherwise(F.array("stage"))
    certs = F.when(c % 7 == 0, F.array(F.concat(F.lit("ISO "), "stage"), F.lit("gs"))).otherwise(none)
    rows = t.notices.select(
        "*", scoring.size_verdict(sizes, F.lit("1-URGENT")).alias("size"), scoring.flag_verdict(institute, F.lit(None).cast("boolean")).alias("lab"),
        scoring.codes_verdict(codes, F.array(F.lit("F"), F.lit("O"))).alias("code"), scoring.certificates_verdict(certs, F.array(F.lit(" iso o"), F.lit("GS mark"))).alias("cert"),
    )
    return rows.withColumn("verdict", scoring.overall(F.col("size"), F.col("lab"), F.col("code"), F.col("cert")))


@query("SCO_20_AGG_30_eligibility", ELIGIBLE_SQL + "SELECT id, size, lab, code, cert, verdict FROM w")
def sco_20(t: Frames) -> DataFrame:
    return eligibility(t).select("id", "size", "lab", "code", "cert", "verdict")


@query("SCO_21_Q_02_list_by_verdict", ELIGIBLE_SQL + "SELECT id, verdict FROM w JOIN notices USING (id) WHERE verdict = 'ok' AND (close_dt IS NULL OR close_dt >= TIMESTAMP '2000-01-08') ORDER BY est_price DESC, id LIMIT 21")
def sco_21(t: Frames) -> DataFrame:
    from noticeworks.operators.listing import NoticeFilter, filtered, page

    f = NoticeFilter(tab="all", sort="est_price")
    return page(filtered(eligibility(t).where("verdict = 'ok'"), f, t.now), f).select("id", "verdict")


@query("SCO_22_extracted_axes", "SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 0 WHEN id % 4 = 2 AND id % 8 = 2 THEN NULL ELSE CASE WHEN stage = 'F' THEN 2 ELSE 1 END END::VARCHAR AS n_values, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'false' WHEN id % 6 = 2 THEN NULL ELSE 'true' END AS flag FROM notices")
def sco_22(t: Frames) -> DataFrame:
    c = F.col("id")
    restricted = F.when(c % 4 == 0, None).otherwise(c % 4 != 1)
    values = scoring.axis_values(restricted, F.array("stage", F.lit("F2"), F.lit(" "), F.when(F.col("stage") == "F", F.lit("O"))), F.when((c % 8 == 2), " ").otherwise("p. 3"), ("F", "O", "P"))
    flag = scoring.axis_flag(F.when(c % 3 == 0, None).otherwise(c % 3 == 2), F.when(c % 6 == 2, "").otherwise("p. 1"))
    return t.notices.select("id", F.when(values.isNotNull(), F.size(values)).cast("string").alias("n_values"), flag.cast("string").alias("flag"))


@query("SCO_23_capped_items", "SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 49) || '…' ELSE text END AS item FROM documents WHERE trim(source) <> '' AND lang IN ('en', 'de')", False)
def sco_23(t: Frames) -> DataFrame:
    return t.table("documents").where((F.trim("source") != "") & F.col("lang").isin("en", "de")).select("doc_id", scoring.capped(F.col("text"), 50).alias("item"))


@query("SCO_23_valid_items", """
    WITH items AS (
        SELECT p_partkey, n, CASE WHEN (p_partkey + n) % 5 <> 0 THEN p_type || ' ' || p_name || ' ' || p_type || ' ' || p_name END AS category, p_name AS text, CASE WHEN (p_size + n) % 7 = 0 THEN NULL ELSE p_brand END AS cite,
            ['gte', 'lte', 'eq', 'contains', 'manual', 'near'][1 + (p_size + n) % 6] AS op, CASE WHEN p_size % 2 = 0 THEN repeat(p_name, 9) END AS value, repeat(p_brand, n) AS unit FROM part, (VALUES (1), (2), (3)) v(n)
    ), judged AS (SELECT *, category IS NOT NULL AND cite IS NOT NULL AND op <> 'near' AS good FROM items)
    SELECT p_partkey, n::VARCHAR AS task_ref, CASE WHEN length(category) > 50 THEN left(category, 49) || '…' ELSE category END AS category, CASE WHEN length(value) > 100 THEN left(value, 99) || '…' ELSE value END AS req_value,
        CASE WHEN length(unit) > 20 THEN left(unit, 19) || '…' ELSE unit END AS req_unit, op, (SELECT count(*) FROM judged k WHERE k.p_partkey = j.p_partkey AND NOT good)::INTEGER AS skipped FROM judged j WHERE good""", False)
def sco_23_items(t: Frames) -> DataFrame:
    """Items taken out of texts, three of each part, with white space around their fields; those without category, citation or known operator are counted."""
    key, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    ops = F.array(*map(F.lit, (*scoring.OPERATORS, "near")))
    blank = lambda condition, text: F.when(condition, F.concat(F.lit(" \t"), text, F.lit("\u3000\n"))).otherwise(" ")

    def item(n: int):
        category = blank((key + n) % 5 != 0, F.concat_ws(" ", "p_type", name, "p_type", name))
        cite, value = blank((size + n) % 7 != 0, F.col("p_brand")), F.when(size % 2 == 0, F.repeat(name, F.lit(9)))
        return F.struct(
            category.alias("category"), name.alias("req_text"), value.alias("req_value"), F.repeat("p_brand", F.lit(n)).alias("req_unit"),
            F.element_at(ops, ((size + n) % 6 + 1).cast("int")).alias("op"), cite.alias("cite"), F.lit(str(n)).alias("task_ref"),
        )

    found = t.table("part").select("p_partkey", scoring.valid_items(F.array(*map(item, (1, 2, 3)))).alias("r"))
    return found.select("p_partkey", "r.skipped", F.inline("r.valid")).select("p_partkey", "task_ref", "category", "req_value", "req_unit", "op", "skipped")


@query("SCO_24_grounded_and_unique", """
    WITH c AS (SELECT conv_id, turn, left(text, 30) AS cite, regexp_replace(left(text, 20), '\\s+', '', 'g') AS bare FROM conversations), s AS (SELECT conv_id, text AS source FROM conversations WHERE turn = 0),
    g AS (SELECT c.*, cite <> '' AND contains(regexp_replace(source, '\\s+', '', 'g'), regexp_replace(cite, '\\s+', '', 'g')) AS good FROM c JOIN s USING (conv_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, bare ORDER BY turn) AS n FROM g WHERE good)
    SELECT conv_id, (SELECT count(*) FROM k WHERE k.conv_id = g.conv_id AND n = 1) AS kept, count(*) FILTER (NOT good) AS rejected, (SELECT count(*) FROM k WHERE k.conv_id = g.conv_id AND n > 1) AS repeated FROM g GROUP BY 1""", False)
def sco_24(t: Frames) -> DataFrame:
    from pyspark.sql import Window as W

    rows = t.table("conversations")
    source = rows.where("turn = 0").select("conv_id", F.col("text").alias("source"))
    good = scoring.grounded(F.left("text", F.lit(30)), F.col("source"))
    rows = rows.join(source, "conv_id").select("conv_id", "turn", F.regexp_replace(F.left("text", F.lit(20)), r"\s+", "").alias("bare"), good.alias("good"))
    place = F.row_number().over(W.partitionBy("conv_id", "good", "bare").orderBy("turn"))
    rows = rows.withColumn("place", place)
    return rows.groupBy("conv_id").agg(F.count_if(F.col("good") & (F.col("place") == 1)).alias("kept"), F.count_if(~F.col("good")).alias("rejected"), F.count_if(F.col("good") & (F.col("place") > 1)).alias("repeated"))


@query("SCO_27_annotations", "SELECT n.id, coalesce(a.summary, '') AS note FROM notices n LEFT JOIN (SELECT notice_id, arg_max(summary, ver) FILTER (summary IS NOT NULL) AS summary FROM analyses GROUP BY 1) a ON a.notice_id = n.id WHERE stage = 'P'")
def sco_27(t: Frames) -> DataFrame:
    notes = t.analyses.where("summary is not null").groupBy(F.col("notice_id").alias("id")).agg(F.max_by("summary", "ver").alias("summary"))
    return t.notices.where("stage = 'P'").join(notes, "id", "left").select("id", F.coalesce("summary", F.lit("")).alias("note"))


@query("SCO_28_SNK_10_expired", "SELECT id FROM notices WHERE coalesce(close_dt < TIMESTAMP '2000-01-01' - INTERVAL 3 DAY, false) OR (close_dt IS NULL AND coalesce(strftime(open_dt, '%Y-%m-%d') < strftime(TIMESTAMP '2000-01-01' - INTERVAL 60 DAY, '%Y-%m-%d'), false))")
def sco_28(t: Frames) -> DataFrame:
    return upkeep.expired(t.notices, t.now, F.date_format("open_dt", "yyyy-MM-dd")).select("id")


STREAM_SQL = """
    WITH RECURSIVE ranked AS (SELECT customer_id, event_id, ts, row_number() OVER (PARTITION BY customer_id ORDER BY ts, event_id) AS n FROM evs WHERE event_type = 'view'),
    walk AS (SELECT customer_id, event_id, ts, n, ts AS last, true AS kept FROM ranked WHERE n = 1
        UNION ALL SELECT r.customer_id, r.event_id, r.ts, r.n, CASE WHEN epoch_us(r.ts) - epoch_us(w.last) > 86400000000 THEN r.ts ELSE w.last END, epoch_us(r.ts) - epoch_us(w.last) > 86400000000 FROM walk w JOIN ranked r ON r.customer_id = w.customer_id AND r.n = w.n + 1)
    SELECT customer_id, event_id FROM walk WHERE kept
"""


@query("STR_01_SNK_12_accepted_events", STREAM_SQL.replace("WITH RECURSIVE", "WITH"))
def str_01(t: Frames) -> DataFrame:
    views = t.events.where("event_type = 'view'")
    return dedup.accepted_events(views, ["customer_id"], 86_400).select("customer_id", "event_id")


@query("STR_01_accepted_by_a_stream", STREAM_SQL.replace("WITH RECURSIVE", "WITH"))
def str_01_stream(t: Frames) -> DataFrame:
    """The same events through the stateful stream, worked off and read back."""
    spark = t.spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = engagement.work_folder(spark)
    # A pattern, because a stream takes a plain path for a folder.
    files = spark.readStream.schema(t.table("events").schema).parquet(f"{t.sf_dir}/events[.]parquet")
    views = files.where("event_type = 'view'").select("event_id", F.col("user_id").alias("customer_id"), F.col("ts").cast("timestamp").alias("ts"))
    engagement.run_available(engagement.accepted(views, ["customer_id"], 86_400), f"{folder}/out", f"{folder}/state")
    return spark.read.schema("event_id long, customer_id long, ts timestamp").parquet(f"{folder}/out").select("customer_id", "event_id")


@query("STR_06_CASE_06_jobs_that_time_out", """
    WITH followed AS (
        SELECT source_id, run_id, run_at, status, first_value(CASE WHEN status <> 'running' THEN run_at END IGNORE NULLS) OVER o AS ended,
               first_value(CASE WHEN status <> 'running' THEN status END IGNORE NULLS) OVER o AS outcome, max(run_at) OVER () - INTERVAL 1 HOUR AS known
        FROM runs WINDOW o AS (PARTITION BY source_id ORDER BY run_at, run_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
    )
    SELECT source_id, run_id, CASE WHEN ended <= run_at + INTERVAL 60 MINUTE THEN CASE outcome WHEN 'fail' THEN 'failed' ELSE 'done' END ELSE 'timed_out' END AS state,
           epoch_us(CASE WHEN ended <= run_at + INTERVAL 60 MINUTE THEN ended ELSE run_at + INTERVAL 60 MINUTE END) AS at
    FROM followed WHERE status = 'running' AND (ended IS NOT NULL OR run_at + INTERVAL 60 MINUTE < known)
""")  # fmt: skip
def str_06_stream(t: Frames) -> DataFrame:
    """Started jobs followed by a stateful stream: an outcome ends one, a timer ends one that got none in an hour."""
    spark = t.spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = engagement.work_folder(spark)
    files = spark.readStream.schema(t.table("events").schema).parquet(f"{t.sf_dir}/events[.]parquet")
    # The statuses of the domain frame.
    status = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "running").when(F.col("event_type") == "view", "warn").otherwise("ok")
    runs = files.select((F.col("user_id") % 27).alias("source_id"), F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))
    engagement.run_available(engagement.job_outcomes(runs, 3_600), f"{folder}/out", f"{folder}/state")
    return spark.read.schema("source_id long, run_id long, state string, at timestamp").parquet(f"{folder}/out").withColumn("at", F.unix_micros("at"))


@query("STR_01_SNK_12_views_and_clicks", """
    WITH ranked AS (
        SELECT customer_id, notice_id, event_type, event_id, ts, CASE event_type WHEN 'view' THEN 300000000 ELSE 5000000 END AS most,
               row_number() OVER (PARTITION BY customer_id, notice_id, event_type ORDER BY ts, event_id) AS n
        FROM evs WHERE event_type IN ('view', 'click')
    )
    SELECT event_id, customer_id, notice_id, event_type FROM (
        SELECT *, list_reduce(list_transform(list(epoch_us(ts)) OVER (PARTITION BY customer_id, notice_id, event_type ORDER BY n), lambda t: [t, 1]),
                              lambda a, b: CASE WHEN b[1] - a[1] > most THEN b ELSE [a[1], 0] END)[2] = 1 AS kept
        FROM ranked
    ) WHERE kept
""")  # fmt: skip
def str_01_views_and_clicks(t: Frames) -> DataFrame:
    return dedup.accepted_by_type(t.events, ["customer_id", "notice_id"]).select("event_id", "customer_id", "notice_id", "event_type")


@query("SNK_13_toggles", "SELECT event_id, customer_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY customer_id, notice_id ORDER BY ts, event_id) AS before FROM evs WHERE event_type IN ('like', 'unlike')) WHERE event_type IS DISTINCT FROM before")
def snk_13(t: Frames) -> DataFrame:
    likes = t.events.where(F.col("event_type").isin("like", "unlike"))
    return dedup.state_changes(likes, ["customer_id", "notice_id"], "event_type", ["ts", "event_id"]).select("event_id", "customer_id")


#: Days of January 2024 (midnight) at which a feed is polled; the last one is asked for twice.
POLLS = (8, 20, 29, 29)


def _micros(day: int) -> int:
    from datetime import UTC, datetime

    return int(datetime(2024, 1, day, tzinfo=UTC).timestamp()) * 1_000_000


@query("STR_02_05_SRC_02_16_polled_feed", "WITH polls(day, before) AS (VALUES (8, 1), (20, 8), (29, 20)) SELECT day, count(*) AS added, count(DISTINCT event_id) AS events, min(event_id) AS first_event FROM events, polls WHERE ts >= make_timestamp(2024, 1, before, 0, 0, 0) AND ts < make_timestamp(2024, 1, day, 0, 0, 0) GROUP BY 1", False)
def str_02_feed(t: Frames) -> DataFrame:
    """Events as a feed that is polled: each poll reads an hour back, and what is there already is not added again."""
    folder, schema = engagement.work_folder(t.spark), "event_id long, ts timestamp_ntz, event_type string"
    engagement.poll(t.spark, f"{t.sf_dir}/events.parquet", schema, f"{folder}/table", ["event_id"], f"{folder}/state", [_micros(day) for day in POLLS], _micros(1), budget=float("inf"))
    there = t.spark.read.schema(f"{schema}, polled long").parquet(f"{folder}/table")
    day = F.dayofmonth(F.timestamp_micros("polled").cast("timestamp_ntz")).cast("long")
    return there.groupBy(day.alias("day")).agg(F.count("*").alias("added"), F.count_distinct("event_id").alias("events"), F.min("event_id").alias("first_event"))
