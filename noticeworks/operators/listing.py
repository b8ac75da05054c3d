"""The filtered, sorted and paged list of notices."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeworks.functions import labels
from noticeworks.operators import staging

PAGE_SIZE, LEAD_DAYS = 21, 7
TABS = ("all", "unscheduled", "upcoming", "in_progress", "closed")


@dataclass(frozen=True)
class NoticeFilter:
    """What a list is narrowed to; empty fields do not narrow.  The lead days hold on every tab, so the closed tab is empty unless they are 0."""

    tab: str = "in_progress"
    q: str = ""
    exclude_words: tuple[str, ...] = ()
    topics: tuple[int, ...] = ()
    org_ids: tuple[int, ...] = ()
    org_categories: tuple[str, ...] = ()
    source_ids: tuple[int, ...] = ()
    price_min: float | None = None
    price_max: float | None = None
    regions: tuple[str, ...] = ()
    stages: tuple[str, ...] = ()
    biz_types: tuple[str, ...] = ()
    work_types: tuple[str, ...] = ()
    closing_within_days: int | None = None
    status: str | None = None
    lead_days: int = LEAD_DAYS
    sort: str = "notice_date"
    page: int = 1
    size: int = PAGE_SIZE
    extra: tuple[Column, ...] = field(default=(), compare=False)


def lead_time(close: Column, now: Column, days: int) -> Column:
    """Ends unknown or at least so many days ahead; 0 days switch the test off."""
    return F.lit(True) if days <= 0 else close.isNull() | (close >= now + F.expr(f"INTERVAL {days} DAYS"))


def tab(start: Column, close: Column, now: Column, name: str) -> Column:
    return F.lit(True) if name == "all" else labels.bid_status(start, close, now) == name


def conditions(f: NoticeFilter, now: Column) -> list[Column]:
    c = F.col
    out = [lead_time(c("close_dt"), now, f.lead_days), tab(c("open_dt"), c("close_dt"), now, f.tab), *f.extra]
    if f.q:
        out.append(c("title").ilike(f"%{f.q}%"))  # per cent and underscore in q are wildcards
    out += [~c("title").ilike(f"%{w.strip()}%") for w in f.exclude_words if w.strip()]
    if f.org_ids or f.org_categories:
        out.append(c("org_id").isin(*f.org_ids) | c("category").isin(*f.org_categories))
    for name, values in (("source_id", f.source_ids), ("region", f.regions), ("stage", f.stages), ("biz_type", f.biz_types), ("work_type", f.work_types)):
        if values:
            out.append(c(name).isin(*values))
    if f.price_min is not None:
        out.append(c("est_price") >= f.price_min)
    if f.price_max is not None:
        out.append(c("est_price") <= f.price_max)
    if f.closing_within_days is not None:
        out.append(c("close_dt").between(now, now + F.expr(f"INTERVAL {f.closing_within_days} DAYS")))
    if f.status == "open":
        out.append(c("close_dt").isNull() | (c("close_dt") >= now))
    elif f.status == "closed":
        out.append(c("close_dt") < now)
    return out


def filtered(notices: DataFrame, f: NoticeFilter, now: Column, scores: DataFrame | None = None) -> DataFrame:
    """Notices that are not superseded and fit the filter; topics are tested by a semi join."""
    if "superseded_by" in notices.columns:
        notices = notices.where(F.col("superseded_by").isNull())
    for condition in conditions(f, now):
        notices = notices.where(condition)
    if f.topics and scores is not None:
        wanted = scores.where(F.col("topic").isin(*f.topics)).select(F.col("notice_id").alias("id"))
        notices = notices.join(wanted, "id", "left_semi")
    return notices


def order(sort: str) -> list[Column]:
    """Sort keys; each order ends in the id, and unknown values stand last."""
    keys = {
        "notice_date": [F.desc_nulls_last("notice_date")],
        "close_dt": [F.asc_nulls_last("close_dt")],
        "open_dt": [F.desc_nulls_last("open_dt")],
        "est_price": [F.desc_nulls_last("est_price")],
        "priority": [F.desc_nulls_last("priority"), F.asc_nulls_last("close_dt")],
    }
    return [*keys.get(sort, keys["notice_date"]), F.asc("id")]


def page(rows: DataFrame, f: NoticeFilter) -> DataFrame:
    return rows.orderBy(*order(f.sort)).offset((f.page - 1) * f.size).limit(f.size)


def neighbours(rows: DataFrame, sort: str) -> DataFrame:
    """id with the ids before and after it in the list's order: ranges of the sort keys are put in order each, and trade the ids at their ends."""
    keys = [k for k in ("notice_date", "close_dt", "open_dt", "est_price", "priority") if k in rows.columns]
    # Drawn ranges differ from run to run, so a row's range is written down.
    dealt = staging.written(rows.select("id", *keys).repartitionByRange(*order(sort)).withColumn("range", F.spark_partition_id()), "ranges")
    w = W.partitionBy("range").orderBy(*order(sort))
    near = staging.written(dealt.select("id", "range", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id")), "in-ranges")
    ends = near.groupBy("range").agg(F.max(F.when(F.col("prev_id").isNull(), F.col("id"))).alias("first"), F.max(F.when(F.col("next_id").isNull(), F.col("id"))).alias("last"))
    ends = sorted(ends.collect())  # one row for each range
    trades = [(r.range, ends[k - 1].last if k else None, ends[k + 1].first if k + 1 < len(ends) else None) for k, r in enumerate(ends)]
    trades = rows.sparkSession.createDataFrame(trades, "range int, before long, after long")
    return near.join(F.broadcast(trades), "range").select("id", F.coalesce("prev_id", "before").alias("prev_id"), F.coalesce("next_id", "after").alias("next_id"))


def tab_counts(rows: DataFrame, now: Column, lead_days: int = LEAD_DAYS) -> DataFrame:
    """All tabs in one pass."""
    rows = rows.where(lead_time(F.col("close_dt"), now, lead_days))
    return rows.agg(*[F.count_if(tab(F.col("open_dt"), F.col("close_dt"), now, name)).alias(name) for name in TABS])


def with_chips(paged: DataFrame, scores: DataFrame, topics: DataFrame) -> DataFrame:
    """Topic chips of the rows of a page, joined after the limit; repeated scores stay repeated."""
    chips = scores.join(topics, "topic").select(F.col("notice_id").alias("id"), F.struct("topic", "l2", "topic_name").alias("chip"))
    chips = chips.join(F.broadcast(paged.select("id")), "id").groupBy("id").agg(F.array_sort(F.collect_list("chip")).alias("chips"))
    return paged.join(chips, "id", "left")
