"""Aggregates, latest rows, time series and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeworks.functions import labels
from noticeworks.operators import dedup, latest, series
from noticeworks.plans.registry import query
from noticeworks.sources.fixtures import Frames

LAST_DAY, DAYS = "2024-01-30", 14
FIRST_DAY = "2024-01-17"
SPINE = "spine AS (SELECT unnest(generate_series(DATE '2024-01-17', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day)"


def kst(column: str = "ts"):
    return labels.kst_date(F.col(column))


@query("AGG_01_priority", "SELECT notice_id, max(priority) AS priority FROM scores GROUP BY 1")
def agg_01(t: Frames) -> DataFrame:
    return t.scores.groupBy("notice_id").agg(F.max("priority").alias("priority"))


@query("AGG_02_last_run", "SELECT source_id, max(run_id) AS run_id, arg_max(status, run_id) AS status FROM runs GROUP BY 1")
def agg_02(t: Frames) -> DataFrame:
    return t.runs.groupBy("source_id").agg(F.max("run_id").alias("run_id"), F.max_by("status", "run_id").alias("status"))


@query("AGG_03_JOIN_07_latest_summary", "SELECT a.notice_id, a.ver, a.summary FROM analyses a JOIN (SELECT notice_id, max(ver) AS ver FROM analyses WHERE summary IS NOT NULL GROUP BY 1) m USING (notice_id, ver)")
def agg_03(t: Frames) -> DataFrame:
    return latest.max_version_rows(t.analyses.where("summary is not null"), "notice_id", "ver").select("notice_id", "ver", "summary")


@query("AGG_04_topic_scores", "SELECT notice_id, topic, greatest(max(l2), 0) AS l2 FROM scores GROUP BY 1, 2")
def agg_04(t: Frames) -> DataFrame:
    from noticeworks.operators.interest import topic_strengths

    return topic_strengths(t.scores)


@query("AGG_05_SCO_06_confidence", "SELECT id, greatest(max(priority), 0) AS confidence FROM notices LEFT JOIN scores ON notice_id = id AND topic IN (1, 4, 9) GROUP BY 1")
def agg_05(t: Frames) -> DataFrame:
    found = t.scores.where(F.col("topic").isin(1, 4, 9)).groupBy(F.col("notice_id").alias("id")).agg(F.greatest(F.max("priority"), F.lit(0.0)).alias("confidence"))
    # The largest of nothing is nothing; zero is only a floor for what is there.
    return t.notices.select("id").join(found, "id", "left").select("id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


@query("AGG_08_distinct_customers", "SELECT count(DISTINCT customer_id) AS customers FROM evs WHERE event_type = 'like'")
def agg_08(t: Frames) -> DataFrame:
    return t.events.where("event_type = 'like'").agg(F.count_distinct("customer_id").alias("customers"))


@query("AGG_09_10_Q_06_monthly", """
    WITH spine AS (SELECT strftime(unnest(generate_series(DATE '1998-03-01', DATE '1998-08-01', INTERVAL 1 MONTH)), '%Y-%m') AS month),
    m AS (SELECT strftime(created_at, '%Y-%m') AS month FROM notices), c AS (SELECT month, count(*) AS n FROM m GROUP BY 1)
    SELECT month, coalesce(n, 0) AS n, ((SELECT count(*) FROM m WHERE month < '1998-03') + sum(coalesce(n, 0)) OVER (ORDER BY month))::BIGINT AS total FROM spine LEFT JOIN c USING (month)""")
def agg_09(t: Frames) -> DataFrame:
    return series.monthly_cumulative(t.notices, F.date_format("created_at", "yyyy-MM"), series.months_spine(t.spark, "1998-08-01", 6), "1998-03")


@query("AGG_11_daily_kst", f"WITH {SPINE}, d AS (SELECT (ts + INTERVAL 9 HOUR)::DATE AS day, count(*) AS n FROM evs GROUP BY 1) SELECT day::VARCHAR AS day, coalesce(n, 0) AS n FROM spine LEFT JOIN d USING (day)")
def agg_11(t: Frames) -> DataFrame:
    return series.per_day(t.events, kst(), series.days_spine(t.spark, LAST_DAY, DAYS), n=F.lit(True)).withColumn("day", F.col("day").cast("string"))


@query("AGG_12_15_cumulative", f"""
    WITH {SPINE}, e AS (SELECT (ts + INTERVAL 9 HOUR)::DATE AS day FROM evs WHERE event_type = 'view'), d AS (SELECT day, count(*) AS n FROM e GROUP BY 1)
    SELECT day::VARCHAR AS day, coalesce(n, 0) AS daily, ((SELECT count(*) FROM e WHERE day < DATE '{FIRST_DAY}') + sum(coalesce(n, 0)) OVER (ORDER BY day))::BIGINT AS total FROM spine LEFT JOIN d USING (day)""")
def agg_12(t: Frames) -> DataFrame:
    return series.cumulative(t.events.where("event_type = 'view'"), kst(), series.days_spine(t.spark, LAST_DAY, DAYS), FIRST_DAY).withColumn("day", F.col("day").cast("string"))


GRID = f"""
    WITH {SPINE}, e AS (SELECT source_id, (run_at + INTERVAL 9 HOUR)::DATE AS day FROM runs), grid AS (SELECT source_id, day FROM sources CROSS JOIN spine),
    d AS (SELECT source_id, day, count(*) AS n FROM e GROUP BY 1, 2), b AS (SELECT source_id, count(*) FILTER (day < DATE '{FIRST_DAY}') AS base FROM e GROUP BY 1),
    x AS (SELECT g.source_id, g.day, (coalesce(base, 0) + sum(coalesce(n, 0)) OVER (PARTITION BY g.source_id ORDER BY g.day))::BIGINT AS total FROM grid g LEFT JOIN d USING (source_id, day) LEFT JOIN b ON b.source_id = g.source_id)
    SELECT source_id, day::VARCHAR AS day, total FROM x UNION ALL SELECT NULL, day::VARCHAR, sum(total)::BIGINT FROM x GROUP BY 2"""


@query("AGG_13_14_Q_07_per_source_and_total", GRID)
def agg_13(t: Frames) -> DataFrame:
    return series.grid_cumulative(t.runs, "source_id", kst("run_at"), t.sources, series.days_spine(t.spark, LAST_DAY, DAYS), FIRST_DAY).withColumn("day", F.col("day").cast("string"))


@query("AGG_16_Q_08_ops_series", f"WITH {SPINE}, d AS (SELECT (run_at + INTERVAL 9 HOUR)::DATE AS day, count(*) FILTER (status IN ('ok', 'warn')) AS good, count(*) FILTER (status = 'fail') AS bad FROM runs GROUP BY 1) SELECT day::VARCHAR AS day, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM spine LEFT JOIN d USING (day)")
def agg_16(t: Frames) -> DataFrame:
    return series.per_day(t.runs, kst("run_at"), series.days_spine(t.spark, LAST_DAY, DAYS), good=F.col("status").isin("ok", "warn"), bad=F.col("status") == "fail").withColumn("day", F.col("day").cast("string"))


@query("AGG_17_Q_09_Q_18_usage", """
    WITH u AS (SELECT 'structure' AS part, count(*) AS calls, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM analyses WHERE step = 'assistant' AND tokens > 0
      UNION ALL SELECT 'profile', count(*) FILTER (balance > 0), coalesce(sum(org_id) FILTER (balance > 0), 0)::BIGINT FROM orgs
      UNION ALL SELECT 'strategy', count(*), coalesce(sum(notice_id), 0)::BIGINT FROM evs WHERE event_type = 'like' AND ts >= TIMESTAMP '2024-01-15')
    SELECT part, calls, tokens FROM u UNION ALL SELECT 'total', sum(calls)::BIGINT, sum(tokens)::BIGINT FROM u""")
def agg_17(t: Frames) -> DataFrame:
    def part(rows: DataFrame, name: str, keep, tokens: str) -> DataFrame:
        return rows.agg(F.count_if(keep).alias("calls"), F.coalesce(F.sum(F.when(keep, F.col(tokens))), F.lit(0)).cast("long").alias("tokens")).select(F.lit(name).alias("part"), "calls", "tokens")

    parts = part(t.analyses, "structure", (F.col("step") == "assistant") & (F.col("tokens") > 0), "tokens")
    parts = parts.unionByName(part(t.orgs, "profile", F.col("balance") > 0, "org_id"))
    parts = parts.unionByName(part(t.events, "strategy", (F.col("event_type") == "like") & (F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")), "notice_id"))
    return parts.rollup("part").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens")).select(F.coalesce("part", F.lit("total")).alias("part"), "calls", "tokens")


DEDUP_SQL = """
    WITH a AS (SELECT id, org_id, biz_type, open_dt, created_at AS anchor, lag(created_at) OVER w AS prev FROM notices WINDOW w AS (PARTITION BY org_id, biz_type ORDER BY created_at, id)),
    c AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND date_sub('day', prev, anchor) > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY org_id, biz_type ORDER BY anchor, id) AS cluster FROM a),
    s AS (SELECT *, first_value(id) OVER (PARTITION BY org_id, biz_type, cluster ORDER BY open_dt IS NOT NULL DESC, anchor DESC, id DESC) AS last FROM c)
"""


def marked(t: Frames) -> DataFrame:
    return dedup.superseded(t.notices, ["org_id", "biz_type"], F.col("created_at"), F.col("open_dt").isNotNull())


@query("WIN_05_06_Q_14_superseded", DEDUP_SQL + "SELECT id, CASE WHEN last <> id THEN last END AS superseded_by FROM s")
def win_05(t: Frames) -> DataFrame:
    return marked(t)


@query("AGG_20_SNK_09_dedup_counts", DEDUP_SQL + "SELECT count(DISTINCT last) FILTER (last <> id) AS groups_with_duplicates, count(*) FILTER (last <> id) AS updated FROM s")
def agg_20(t: Frames) -> DataFrame:
    before = t.notices.select("id", F.lit(None).cast("long").alias("superseded_by"))
    return dedup.changed(before, marked(t)).agg(F.count_distinct("superseded_by").alias("groups_with_duplicates"), F.count("*").alias("updated"))


@query("AGG_21_pending_counts", "SELECT least(count(*), 200) AS pending FROM notices WHERE close_dt IS NULL")
def agg_21(t: Frames) -> DataFrame:
    """No more rows are counted than are reported."""
    return t.notices.where("close_dt is null").limit(200).agg(F.count("*").alias("pending"))


@query("AGG_23_report_summary", "SELECT org_id, count(*) AS total, count(*) FILTER (close_dt BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-01-08') AS closing, max(est_price) AS top FROM notices GROUP BY 1")
def agg_23(t: Frames) -> DataFrame:
    soon = F.col("close_dt").between(t.now, t.now + F.expr("INTERVAL 7 DAYS"))
    return t.notices.groupBy("org_id").agg(F.count("*").alias("total"), F.count_if(soon).alias("closing"), F.max("est_price").alias("top"))


@query("AGG_24_attributions", "SELECT org_id, string_agg(DISTINCT biz_type, '|' ORDER BY biz_type) AS texts FROM notices GROUP BY 1")
def agg_24(t: Frames) -> DataFrame:
    return t.notices.groupBy("org_id").agg(F.concat_ws("|", F.array_sort(F.collect_set("biz_type"))).alias("texts"))


@query("AGG_27_any_ok", "SELECT notice_id, CASE WHEN count(*) = 0 OR bool_or(step = 'assistant' AND tokens > 40) THEN 'done' ELSE 'failed' END AS status FROM analyses GROUP BY 1")
def agg_27(t: Frames) -> DataFrame:
    good = F.bool_or((F.col("step") == "assistant") & (F.col("tokens") > 40))
    return t.analyses.groupBy("notice_id").agg(F.when(good, "done").otherwise("failed").alias("status"))


@query("AGG_28_concatenated_text", "SELECT notice_id, left(string_agg('[' || step || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY ver), 120000) AS text FROM analyses GROUP BY 1")
def agg_28(t: Frames) -> DataFrame:
    part = F.concat(F.lit("["), "step", F.lit("]\n"), "text")
    texts = F.array_sort(F.collect_list(F.struct("ver", part.alias("part"))))
    return t.analyses.groupBy("notice_id").agg(texts.alias("parts")).select("notice_id", F.substring(F.array_join(F.col("parts.part"), "\n\n"), 1, 120_000).alias("text"))


@query("AGG_29_org_categories", "SELECT category, count(*) AS n FROM orgs GROUP BY 1")
def agg_29(t: Frames) -> DataFrame:
    return t.orgs.groupBy("category").agg(F.count("*").alias("n"))


@query("WIN_01_02_latest_version", "SELECT notice_id, ver, step FROM (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY ver DESC, tokens DESC) AS n FROM analyses) WHERE n = 1")
def win_01(t: Frames) -> DataFrame:
    return latest.top_per(t.analyses, ["notice_id"], [F.desc("ver"), F.desc("tokens")]).select("notice_id", "ver", "step")


@query("WIN_03_Q_17_with_fallback", """
    WITH l AS (SELECT notice_id, max(ver) AS ver, max(ver) FILTER (summary IS NOT NULL) AS sver, arg_max(summary, ver) FILTER (summary IS NOT NULL) AS summary FROM analyses GROUP BY 1)
    SELECT notice_id, ver, summary, summary IS NOT NULL AND sver < ver AS outdated FROM l""")
def win_03(t: Frames) -> DataFrame:
    return latest.latest_with_fallback(t.analyses, "notice_id", "ver", "summary")


@query("WIN_04_current_like", "SELECT customer_id, notice_id, arg_max(event_type, (ts, event_id)) AS state FROM evs WHERE event_type IN ('like', 'unlike') GROUP BY 1, 2")
def win_04(t: Frames) -> DataFrame:
    return latest.latest_by(t.events.where(F.col("event_type").isin("like", "unlike")), ["customer_id", "notice_id"], "event_type", "ts", "event_id", name="state")


@query("WIN_10_top_topics", "SELECT notice_id, topic, l2 FROM (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY l2 DESC, topic) AS n FROM (SELECT notice_id, topic, max(l2) AS l2 FROM scores GROUP BY 1, 2)) WHERE n <= 3")
def win_10(t: Frames) -> DataFrame:
    best = t.scores.groupBy("notice_id", "topic").agg(F.max("l2").alias("l2"))
    return latest.top_per(best, ["notice_id"], [F.desc("l2"), F.asc("topic")], 3).select("notice_id", "topic", "l2")


@query("WIN_11_first_of_equal_texts", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY regexp_replace(text, '\\s+', '', 'g') ORDER BY doc_id) AS n FROM documents) WHERE n = 1", False)
def win_11(t: Frames) -> DataFrame:
    rows = t.table("documents").select("doc_id", F.sha2(F.regexp_replace("text", r"\s+", ""), 256).alias("bare"))
    return rows.groupBy("bare").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("WIN_12_next_version", "SELECT notice_id, max(ver) + 1 AS next_ver FROM analyses GROUP BY 1")
def win_12(t: Frames) -> DataFrame:
    return t.analyses.groupBy("notice_id").agg((F.max("ver") + 1).alias("next_ver"))


@query("JOIN_01_02_base", "SELECT id, org_name, source_name, channel, bid_status FROM statused")
def join_01(t: Frames) -> DataFrame:
    from noticeworks.plans.listings import base

    return base(t).select("id", "org_name", "source_name", "channel", "bid_status")


@query("JOIN_08_09_SCO_07_match", "WITH l AS (SELECT notice_id, arg_max(step, ver) AS step FROM analyses GROUP BY 1) SELECT notice_id AS id, 0.9::DOUBLE AS value FROM l WHERE step = 'assistant'")
def join_08(t: Frames) -> DataFrame:
    last = latest.latest_by(t.analyses, ["notice_id"], "step", "ver", name="step")
    return last.where("step = 'assistant'").select(F.col("notice_id").alias("id"), F.lit(0.9).alias("value"))


@query("JOIN_10_17_sends", "SELECT org_id, org_name, count(event_id) AS sends, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY ts DESC, event_id DESC), '') AS ids FROM orgs LEFT JOIN evs ON customer_id = org_id AND event_type = 'like' GROUP BY 1, 2")
def join_10(t: Frames) -> DataFrame:
    sends = t.events.where("event_type = 'like'").groupBy(F.col("customer_id").alias("org_id")).agg(F.count("*").alias("sends"), F.sort_array(F.collect_list(F.struct("ts", "event_id")), False).alias("e"))
    return t.orgs.join(sends, "org_id", "left").select("org_id", "org_name", F.coalesce("sends", F.lit(0)).alias("sends"), F.coalesce(F.concat_ws(",", F.col("e.event_id").cast("array<string>")), F.lit("")).alias("ids"))


@query("JOIN_11_pending", "WITH l AS (SELECT notice_id, arg_max(step, ver) AS step, max(ver) AS ver FROM analyses GROUP BY 1) SELECT id, ver FROM notices JOIN l ON notice_id = id WHERE step = 'user' ORDER BY id LIMIT 200")
def join_11(t: Frames) -> DataFrame:
    last = latest.top_per(t.analyses, ["notice_id"], [F.desc("ver")]).where("step = 'user'").select(F.col("notice_id").alias("id"), "ver")
    return t.notices.join(last, "id").orderBy("id").limit(200).select("id", "ver")


@query("JOIN_12_not_in_with_null", "SELECT id FROM notices WHERE id NOT IN (SELECT CASE WHEN ver = 0 THEN NULL ELSE notice_id END FROM analyses)")
def join_12(t: Frames) -> DataFrame:
    return latest.not_in(t.notices.select("id"), "id", t.analyses.select(F.when(F.col("ver") != 0, F.col("notice_id")).alias("notice_id")), "notice_id")


@query("JOIN_13_Q_16_in_and_not_in", "SELECT id FROM notices WHERE id IN (SELECT notice_id FROM scores WHERE topic = 3) AND id NOT IN (SELECT notice_id FROM analyses)")
def join_13(t: Frames) -> DataFrame:
    some = t.notices.select("id").join(t.scores.where("topic = 3").select(F.col("notice_id").alias("id")), "id", "left_semi")
    return latest.not_in(some, "id", t.analyses, "notice_id")


@query("JOIN_14_top_keywords", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 8", False)
def join_14(t: Frames) -> DataFrame:
    return latest.top_per(t.table("part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 8).select("p_brand", "p_partkey")


@query("JOIN_16_cross_of_arrays", "WITH a AS (SELECT org_id, list(DISTINCT biz_type) AS days, list(DISTINCT stage) AS times FROM notices GROUP BY 1) SELECT org_id, len(days) * len(times) AS pairs FROM a")
def join_16(t: Frames) -> DataFrame:
    rows = t.notices.groupBy("org_id").agg(F.collect_set("biz_type").alias("days"), F.collect_set("stage").alias("times"))
    pairs = F.flatten(F.transform("days", lambda d: F.transform("times", lambda m: F.struct(d.alias("day"), m.alias("time")))))
    return rows.select("org_id", F.size(pairs).cast("long").alias("pairs"))


@query("JOIN_18_task_fallback", "SELECT a.notice_id, a.ver, CASE WHEN b.notice_id IS NOT NULL THEN b.step WHEN c.n = 1 THEN 'only' ELSE 'common' END AS task FROM analyses a LEFT JOIN analyses b ON b.notice_id = a.notice_id AND b.ver = a.ver + 1 JOIN (SELECT notice_id, count(*) AS n FROM analyses GROUP BY 1) c ON c.notice_id = a.notice_id")
def join_18(t: Frames) -> DataFrame:
    tasks = t.analyses.select("notice_id", (F.col("ver") - 1).alias("ver"), F.col("step").alias("task"))
    counts = t.analyses.groupBy("notice_id").agg(F.count("*").alias("n"))
    rows = t.analyses.select("notice_id", "ver").join(tasks, ["notice_id", "ver"], "left").join(counts, "notice_id")
    return rows.select("notice_id", "ver", F.when(F.col("task").isNotNull(), F.col("task")).when(F.col("n") == 1, "only").otherwise("common").alias("task"))


@query("JOIN_19_overlap", "SELECT customer_id, notice_id, count(*) OVER (PARTITION BY notice_id) > 1 AS shared FROM (SELECT DISTINCT customer_id, notice_id FROM evs)")
def join_19(t: Frames) -> DataFrame:
    pairs = t.events.select("customer_id", "notice_id").distinct()
    return pairs.withColumn("shared", F.count("*").over(W.partitionBy("notice_id")) > 1)


@query("JOIN_20_without_rules", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)", False)
def join_20(t: Frames) -> DataFrame:
    return t.table("supplier").join(t.table("lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_anti").select("s_suppkey")


SETS = "a AS (SELECT notice_id FROM scores WHERE topic = 1), b AS (SELECT notice_id FROM scores WHERE topic = 2)"


@query("SET_union", f"WITH {SETS} SELECT notice_id FROM a UNION SELECT notice_id FROM b")
def set_union(t: Frames) -> DataFrame:
    return t.scores.where("topic = 1").select("notice_id").union(t.scores.where("topic = 2").select("notice_id")).distinct()


@query("SET_intersect", f"WITH {SETS} SELECT notice_id FROM a INTERSECT SELECT notice_id FROM b")
def set_intersect(t: Frames) -> DataFrame:
    return t.scores.where("topic = 1").select("notice_id").intersect(t.scores.where("topic = 2").select("notice_id"))


@query("SET_except", f"WITH {SETS} SELECT notice_id FROM a EXCEPT SELECT notice_id FROM b")
def set_except(t: Frames) -> DataFrame:
    return t.scores.where("topic = 1").select("notice_id").subtract(t.scores.where("topic = 2").select("notice_id"))
