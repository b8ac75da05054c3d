"""Lists of notices: filters, life cycle, sorts, pages, chips, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import labels
from noticeworks.operators import listing
from noticeworks.operators.listing import NoticeFilter
from noticeworks.plans.registry import query
from noticeworks.sources.fixtures import Frames

GOV = ("ASIA",)
NOW = "TIMESTAMP '2000-01-01'"
LEAD = f"(close_dt IS NULL OR close_dt >= {NOW} + INTERVAL 7 DAY)"


def base(t: Frames) -> DataFrame:
    """Notices with their organisation and source, status, and largest priority."""
    priority = t.scores.groupBy(F.col("notice_id").alias("id")).agg(F.max("priority").alias("priority"))
    rows = t.notices.join(t.orgs.drop("balance"), "org_id", "left").join(F.broadcast(t.sources.drop("active")), "source_id", "left").join(priority, "id", "left")
    rows = rows.withColumn("bid_status", labels.bid_status(F.col("open_dt"), F.col("close_dt"), t.now))
    return rows.withColumn("notice_date", F.date_format("open_dt", "yyyy-MM-dd"))


BASE_SQL = "WITH prio AS (SELECT notice_id, max(priority) AS priority FROM scores GROUP BY 1), listed AS (SELECT s.*, priority, strftime(open_dt, '%Y-%m-%d') AS notice_date FROM statused s LEFT JOIN prio ON notice_id = id) "


def _filter_query(name: str, f: NoticeFilter, where: str) -> None:
    @query(name, BASE_SQL + f"SELECT id, bid_status, est_price FROM listed WHERE {where}")
    def run(t: Frames) -> DataFrame:
        return listing.filtered(base(t), f, t.now, t.scores).select("id", "bid_status", "est_price")


ALL = {"tab": "all", "lead_days": 0}
_filter_query("FLT_02_lead_days", NoticeFilter(tab="all"), LEAD)
for _tab in listing.TABS[1:]:
    _filter_query(f"FLT_03_tab_{_tab}", NoticeFilter(tab=_tab, lead_days=0), f"bid_status = '{_tab}'")
_filter_query("FLT_03_closed_tab_with_lead_is_empty", NoticeFilter(tab="closed"), f"bid_status = 'closed' AND {LEAD}")
_filter_query("FLT_04_title_contains", NoticeFilter(**ALL, q="a_e"), "title ILIKE '%a_e%'")
_filter_query("FLT_05_title_excludes", NoticeFilter(**ALL, exclude_words=("blue", " ", "Red")), "title NOT ILIKE '%blue%' AND title NOT ILIKE '%Red%'")
_filter_query("FLT_06_topic_exists", NoticeFilter(**ALL, topics=(3, 7)), "EXISTS (SELECT 1 FROM scores x WHERE x.notice_id = listed.id AND topic IN (3, 7))")
_filter_query("FLT_07_org_or_category", NoticeFilter(**ALL, org_ids=(1, 2, 3), org_categories=("BUILDING",)), "org_id IN (1, 2, 3) OR category IN ('BUILDING')")
_filter_query("FLT_08_source_in", NoticeFilter(**ALL, source_ids=(1, 5, 9)), "source_id IN (1, 5, 9)")
_filter_query("FLT_09_price_bounds", NoticeFilter(**ALL, price_min=50_000, price_max=200_000), "est_price BETWEEN 50000 AND 200000")
_filter_query("FLT_10_stage_and_type_in", NoticeFilter(**ALL, stages=("O", "P"), biz_types=("1-URGENT", "2-HIGH")), "stage IN ('O', 'P') AND biz_type IN ('1-URGENT', '2-HIGH')")
_filter_query("FLT_11_closing_within", NoticeFilter(**ALL, closing_within_days=90), f"close_dt BETWEEN {NOW} AND {NOW} + INTERVAL 90 DAY")
_filter_query("FLT_12_status_open", NoticeFilter(**ALL, status="open"), f"close_dt IS NULL OR close_dt >= {NOW}")
_filter_query("FLT_12_status_closed", NoticeFilter(**ALL, status="closed"), f"close_dt < {NOW}")


@query("FLT_01_not_superseded", "WITH marked AS (SELECT *, lead(id) OVER (PARTITION BY org_id, biz_type, stage ORDER BY created_at, id) AS nxt FROM notices) SELECT id, stage FROM marked WHERE nxt IS NULL")
def flt_01(t: Frames) -> DataFrame:
    from pyspark.sql import Window as W

    nxt = F.lead("id").over(W.partitionBy("org_id", "biz_type", "stage").orderBy("created_at", "id"))
    return listing.filtered(t.notices.withColumn("superseded_by", nxt), NoticeFilter(**ALL), t.now).select("id", "stage")


@query("FLT_13_has_eligibility", "SELECT id FROM notices WHERE EXISTS (SELECT 1 FROM analyses a WHERE a.notice_id = id AND summary IS NOT NULL)")
def flt_13(t: Frames) -> DataFrame:
    return t.notices.join(t.analyses.where("summary is not null").select(F.col("notice_id").alias("id")), "id", "left_semi").select("id")


@query("FLT_15_candidate_pool", "SELECT id, stage FROM notices WHERE stage <> 'P'")
def flt_15(t: Frames) -> DataFrame:
    return t.notices.where("stage <> 'P'").select("id", "stage")


@query("FLT_16_lockout", "SELECT customer_id, count(*) AS failures, count(*) >= 5 AS locked FROM evs WHERE event_type = 'unlike' AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY GROUP BY 1")
def flt_16(t: Frames) -> DataFrame:
    recent = t.events.where((F.col("event_type") == "unlike") & (F.col("ts") >= t.events_now - F.expr("INTERVAL 10 DAYS")))
    return recent.groupBy("customer_id").agg(F.count("*").alias("failures"), (F.count("*") >= 5).alias("locked"))


@query("FLT_17_agency_search", "SELECT org_id, org_name FROM orgs WHERE (org_name ILIKE '%00%1%' OR category ILIKE 'MACH%') AND source_id = 3")
def flt_17(t: Frames) -> DataFrame:
    return t.orgs.where((F.col("org_name").ilike("%00%1%") | F.col("category").ilike("MACH%")) & (F.col("source_id") == 3)).select("org_id", "org_name")


@query("FLT_18_excluded_names", "SELECT p_partkey, contains(lower(regexp_replace(p_name, '\\s+', '', 'g')), 'redgreen') OR contains(lower(regexp_replace(p_name, '\\s+', '', 'g')), 'ab') AS skipped FROM part", False)
def flt_18(t: Frames) -> DataFrame:
    from noticeworks.operators.keywords import excluded_name

    return t.table("part").select("p_partkey", excluded_name(F.col("p_name"), ("Red green", "ab")).alias("skipped"))


@query("FLT_19_due_schedules", "SELECT event_id, list_contains(['09:00', '13:30', '18:05'], strftime(ts, '%H:%M')) OR (isodow(ts) = 1 AND hour(ts) = 9) AS due FROM events", False)
def flt_19(t: Frames) -> DataFrame:
    schedule = F.array(*[F.struct(F.lit(d).alias("day"), F.lit(h).alias("hour")) for d, h in ((1, 9),)])
    weekday = F.weekday("ts") + 1
    due = F.array_contains(F.array(*map(F.lit, ("09:00", "13:30", "18:05"))), F.date_format("ts", "HH:mm")) | F.exists(schedule, lambda e: (e["day"] == weekday) & (e["hour"] == F.hour("ts")))
    return t.table("events").select("event_id", due.alias("due"))


@query("FLT_20_channel_filter", "SELECT source_id, source_name FROM sources WHERE channel = 'EUROPE'")
def flt_20(t: Frames) -> DataFrame:
    return t.sources.where("channel = 'EUROPE'").select("source_id", "source_name")


@query("FLT_21_first_gate_passes_all", "SELECT id, true AS passed FROM notices")
def flt_21(t: Frames) -> DataFrame:
    return t.notices.select("id", F.lit(True).alias("passed"))


@query("FLT_23_in_snapshot", "WITH snap AS (SELECT customer_id, list(DISTINCT notice_id) AS ids FROM evs WHERE event_type = 'like' GROUP BY 1) SELECT customer_id, list_contains(ids, 42) AS allowed FROM snap")
def flt_23(t: Frames) -> DataFrame:
    snapshot = t.events.where("event_type = 'like'").groupBy("customer_id").agg(F.collect_set("notice_id").alias("ids"))
    return snapshot.select("customer_id", F.exists("ids", lambda n: n == 42).alias("allowed"))


SORTS = {
    "SRT_01_notice_date": ("notice_date", "notice_date DESC NULLS LAST, id"),
    "SRT_02_close": ("close_dt", "close_dt ASC NULLS LAST, id"),
    "SRT_03_open": ("open_dt", "open_dt DESC NULLS LAST, id"),
    "SRT_04_price": ("est_price", "est_price DESC NULLS LAST, id"),
    "SRT_05_priority": ("priority", "priority DESC NULLS LAST, close_dt ASC NULLS LAST, id"),
}


def _sort_query(name: str, sort: str, keys: str) -> None:
    @query(name, BASE_SQL + f"SELECT id, bid_status, est_price FROM listed WHERE {LEAD} AND bid_status = 'in_progress' ORDER BY {keys} LIMIT 21 OFFSET 42")
    def run(t: Frames) -> DataFrame:
        f = NoticeFilter(sort=sort, page=3)
        return listing.page(listing.filtered(base(t), f, t.now), f).select("id", "bid_status", "est_price")


for _name, (_sort, _keys) in SORTS.items():
    _sort_query(_name, _sort, _keys)

LABELLED = """
    SELECT id, bid_status, CASE WHEN channel = 'ASIA' THEN '정부지원' ELSE '공공입찰' END AS notice_type,
           CASE WHEN channel = 'ASIA' THEN CASE bid_status WHEN 'closed' THEN '접수마감' WHEN 'in_progress' THEN '접수중' ELSE '접수예정' END
                WHEN stage IN ('P') THEN stage WHEN bid_status = 'closed' THEN '입찰마감' ELSE '입찰공고' END AS status_label,
           CASE WHEN channel = 'ASIA' THEN '개발' ELSE coalesce(nullif(biz_type, ''), '미상') END AS work_label
"""


def labelled(rows: DataFrame) -> DataFrame:
    kind = labels.notice_type(F.col("channel"), GOV)
    return rows.withColumn("notice_type", kind).withColumn("status_label", labels.status_label(F.col("notice_type"), F.col("stage"), F.col("bid_status"), ("P",))).withColumn("work_label", labels.work_type_label(F.col("notice_type"), F.col("biz_type")))


@query("CASE_01_to_04_labels", LABELLED + "FROM statused")
def case_01(t: Frames) -> DataFrame:
    return labelled(base(t)).select("id", "bid_status", "notice_type", "status_label", "work_label")


@query("Q_01_notice_list", BASE_SQL + LABELLED + f", est_price, priority FROM listed WHERE {LEAD} AND bid_status = 'in_progress' AND est_price >= 100000 AND category IN ('BUILDING', 'MACHINERY') ORDER BY est_price DESC NULLS LAST, id LIMIT 21 OFFSET 21")
def q_01(t: Frames) -> DataFrame:
    f = NoticeFilter(price_min=100_000, org_categories=("BUILDING", "MACHINERY"), sort="est_price", page=2)
    return labelled(listing.page(listing.filtered(base(t), f, t.now), f)).select("id", "bid_status", "notice_type", "status_label", "work_label", "est_price", "priority")


@query("Q_01_total_AGG_06", f"SELECT count(*) AS total FROM statused WHERE {LEAD} AND bid_status = 'in_progress'")
def q_01_total(t: Frames) -> DataFrame:
    return listing.filtered(base(t), NoticeFilter(), t.now).agg(F.count("*").alias("total"))


@query("Q_03_tab_counts_AGG_07", "SELECT count(*) AS \"all\", " + ", ".join(f"count(*) FILTER (bid_status = '{b}') AS {b}" for b in listing.TABS[1:]) + f" FROM statused WHERE {LEAD}")
def q_03(t: Frames) -> DataFrame:
    return listing.tab_counts(t.notices, t.now)


@query("JOIN_03_topic_chips", f"""
    WITH paged AS (SELECT id FROM statused WHERE {LEAD} AND bid_status = 'in_progress' ORDER BY est_price DESC NULLS LAST, id LIMIT 21)
    SELECT id, count(notice_id) AS n_chips, coalesce(sum(l2), 0)::BIGINT AS l2 FROM paged LEFT JOIN scores ON notice_id = id GROUP BY 1""")
def join_03(t: Frames) -> DataFrame:
    f = NoticeFilter(sort="est_price")
    topics = t.spark.range(20).select(F.col("id").alias("topic"), F.concat(F.lit("topic "), F.col("id")).alias("topic_name"))
    rows = listing.with_chips(listing.page(listing.filtered(base(t), f, t.now), f), t.scores, topics)
    chips = F.coalesce("chips", F.array().cast("array<struct<topic:bigint,l2:int,topic_name:string>>"))
    return rows.select("id", F.size(chips).cast("long").alias("n_chips"), F.aggregate(chips, F.lit(0).cast("long"), lambda a, c: a + c["l2"]).alias("l2"))


@query("WIN_07_neighbours", BASE_SQL + f"SELECT id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM listed WHERE {LEAD} AND bid_status = 'in_progress' WINDOW w AS (ORDER BY est_price DESC NULLS LAST, id)")
def win_07(t: Frames) -> DataFrame:
    return listing.neighbours(listing.filtered(base(t), NoticeFilter(), t.now), "est_price")


@query("Q_05_notice_detail", BASE_SQL + f", near AS (SELECT id AS near_id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM listed WHERE {LEAD} AND bid_status = 'upcoming' WINDOW w AS (ORDER BY close_dt ASC NULLS LAST, id))"
    + LABELLED + ", org_name, source_name, datediff('day', TIMESTAMP '2000-01-01', close_dt) AS days, prev_id, next_id FROM statused LEFT JOIN near ON near_id = id WHERE stage = 'O'")
def q_05(t: Frames) -> DataFrame:
    """Notices with those before and after them in the list they are opened from; none for a notice that the list does not have."""
    near = listing.neighbours(listing.filtered(base(t), NoticeFilter(tab="upcoming", sort="close_dt"), t.now), "close_dt")
    rows = labelled(base(t).where("stage = 'O'")).join(near, "id", "left")
    return rows.select("id", "bid_status", "notice_type", "status_label", "work_label", "org_name", "source_name", F.datediff("close_dt", t.now).cast("long").alias("days"), "prev_id", "next_id")


@query("Q_04_filter_options_AGG_25_26", """
    SELECT 'stage' AS kind, stage AS value, '' AS ids FROM notices GROUP BY 2 UNION ALL SELECT 'biz_type', biz_type, '' FROM notices WHERE biz_type IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'category', category, '' FROM orgs WHERE category IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'channel', channel, string_agg(source_id::VARCHAR, ',' ORDER BY source_id) FROM sources GROUP BY 2""")
def q_04(t: Frames) -> DataFrame:
    def values(rows: DataFrame, column: str, kind: str) -> DataFrame:
        return rows.where(F.col(column).isNotNull()).select(F.lit(kind).alias("kind"), F.col(column).alias("value"), F.lit("").alias("ids")).distinct()

    channels = t.sources.groupBy("channel").agg(F.array_sort(F.collect_list("source_id")).alias("ids"))
    channels = channels.select(F.lit("channel").alias("kind"), F.col("channel").alias("value"), F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))
    return values(t.notices, "stage", "stage").unionByName(values(t.notices, "biz_type", "biz_type")).unionByName(values(t.orgs, "category", "category")).unionByName(channels)


@query("CASE_05_to_07_JOIN_04_05_06_sources", """
    WITH lastrun AS (SELECT source_id, max(run_id) AS run_id FROM runs GROUP BY 1), counted AS (SELECT source_id, count(*) AS n FROM orgs GROUP BY 1)
    SELECT s.source_id, s.source_name, r.run_id, CASE WHEN NOT active THEN 'inactive' WHEN r.status IS NULL THEN 'no_run_yet' WHEN r.status = 'running' AND r.run_at < TIMESTAMP '2024-01-31' - INTERVAL 60 MINUTE THEN 'fail' ELSE r.status END AS status,
           r.run_at IS NULL OR r.run_at < TIMESTAMP '2024-01-31' - INTERVAL 90 DAY AS overdue, coalesce(n, 0) AS n_orgs
    FROM sources s LEFT JOIN lastrun l USING (source_id) LEFT JOIN runs r ON r.run_id = l.run_id LEFT JOIN counted c ON c.source_id = s.source_id""")
def case_05(t: Frames) -> DataFrame:
    last = t.runs.groupBy("source_id").agg(F.max_by(F.struct("run_id", "status", "run_at"), "run_id").alias("r"))
    counted = t.orgs.groupBy("source_id").agg(F.count("*").alias("n"))
    rows = t.sources.join(last, "source_id", "left").join(counted, "source_id", "left")
    r = F.col("r")
    return rows.select(
        "source_id", "source_name", r["run_id"].alias("run_id"), labels.source_status(F.col("active"), r["status"], r["run_at"], t.events_now).alias("status"),
        labels.compliance_overdue(r["run_at"], t.events_now).alias("overdue"), F.coalesce("n", F.lit(0)).alias("n_orgs"),
    )


@query("Q_10_agencies_SRT_07", """
    WITH lastrun AS (SELECT source_id, arg_max(status, run_id) AS status FROM runs GROUP BY 1)
    SELECT org_id, org_name, CASE WHEN s.source_id IS NULL THEN 'no_source' WHEN NOT active THEN 'inactive' WHEN l.status IS NULL THEN 'no_run_yet' ELSE l.status END AS status
    FROM orgs o LEFT JOIN sources s ON s.source_id = o.source_id LEFT JOIN lastrun l ON l.source_id = o.source_id
    ORDER BY CASE WHEN regexp_matches(org_name, '^[가-힣]') THEN 0 ELSE 1 END, org_name LIMIT 50 OFFSET 50""")
def q_10(t: Frames) -> DataFrame:
    last = t.runs.groupBy("source_id").agg(F.max_by("status", "run_id").alias("status"))
    rows = t.orgs.join(F.broadcast(t.sources.select("source_id", "active", F.lit(True).alias("has"))), "source_id", "left").join(last, "source_id", "left")
    status = labels.agency_status(F.when(F.col("has"), F.col("source_id")), F.col("active"), F.col("status"))
    hangul = F.when(F.col("org_name").rlike("^[가-힣]"), 0).otherwise(1)
    return rows.orderBy(hangul, "org_name").offset(50).limit(50).select("org_id", "org_name", status.alias("status"))


@query("Q_19_lookups", "SELECT org_id, org_name FROM orgs WHERE balance > 0 ORDER BY org_name, org_id")
def q_19(t: Frames) -> DataFrame:
    return t.orgs.where("balance > 0").orderBy("org_name", "org_id").select("org_id", "org_name")


@query("SRT_11_14_15_recent", "SELECT event_id, customer_id FROM evs WHERE event_type = 'like' ORDER BY ts DESC, event_id DESC LIMIT 5")
def srt_11(t: Frames) -> DataFrame:
    return t.events.where("event_type = 'like'").orderBy(F.desc("ts"), F.desc("event_id")).limit(5).select("event_id", "customer_id")


@query("SRT_12_work_queue", "SELECT id FROM notices WHERE close_dt IS NULL ORDER BY id LIMIT 200")
def srt_12(t: Frames) -> DataFrame:
    return t.notices.where("close_dt is null").orderBy("id").limit(200).select("id")
