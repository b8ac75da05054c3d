"""Domain frames over the star-schema tables: which table plays which role."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2000-01-01 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"


def instant(text: str):
    return F.lit(text).cast("timestamp_ntz")


class Frames:
    """Lazily read frames of one scale: notices, orgs, sources, scores, events, analyses and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.now, self.events_now = instant(NOW), instant(EVENTS_NOW)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def sources(self) -> DataFrame:
        """Nations as sources: id, name, channel (their region)."""
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").cast("long").alias("source_id"), F.col("n_name").alias("source_name"), F.col("r_name").alias("channel"), (F.col("n_nationkey") % 5 != 4).alias("active")
        )

    @cached_property
    def orgs(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("org_id"), F.col("c_name").alias("org_name"), F.col("c_mktsegment").alias("category"), F.col("c_nationkey").cast("long").alias("source_id"), F.col("c_acctbal").alias("balance")
        )

    @cached_property
    def notices(self) -> DataFrame:
        """Orders as notices; the last shipping date ends them, the first line's part gives the title."""
        orders, part = self.table("orders"), self.table("part").select("p_partkey", "p_name")
        first = F.min(F.col("l_linenumber").cast("long") * F.lit(1_000_000_000) + F.col("l_partkey")) % 1_000_000_000
        lines = self.table("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("close_dt"), first.alias("p_partkey"))
        lines = lines.join(part, "p_partkey", "left").select(F.col("l_orderkey").alias("id"), "close_dt", F.col("p_name").alias("title"))
        rows = orders.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("org_id"), F.col("o_orderstatus").alias("stage"), F.col("o_orderpriority").alias("biz_type"), F.col("o_totalprice").alias("est_price"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderdate")).alias("open_dt"), F.col("o_orderdate").alias("created_at"),
        )
        return rows.join(lines, "id", "left")

    @cached_property
    def scores(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("notice_id"), (F.col("l_suppkey") % 20).alias("topic"), F.floor(F.col("l_quantity") / 4).cast("int").alias("l2"), (F.col("l_discount") + F.lit(0.0)).alias("priority"), F.col("l_linenumber").alias("line")
        )

    @cached_property
    def events(self) -> DataFrame:
        """Clicks, views, likes (purchases) and unlikes (errors) of users about notices."""
        kind = F.col("event_type")
        kind = F.when(kind == "purchase", "like").when(kind == "error", "unlike").when(kind.isin("view", "click"), kind)
        rows = self.table("events").select("event_id", "ts", F.col("user_id").alias("customer_id"), F.get_json_object("props", "$.k").cast("long").alias("notice_id"), kind.alias("event_type"), "value")
        return rows.where(F.col("event_type").isNotNull())

    @cached_property
    def runs(self) -> DataFrame:
        """Events as collection runs of sources."""
        status = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "running").when(F.col("event_type") == "view", "warn").otherwise("ok")
        return self.table("events").select(F.col("event_id").alias("run_id"), (F.col("user_id") % 27).alias("source_id"), F.col("ts").alias("run_at"), status.alias("status"), "value")

    @cached_property
    def analyses(self) -> DataFrame:
        """Turns of conversations as versions of analyses; an answer that is long has a summary."""
        summary = F.when(F.col("role") == "assistant", F.col("text"))
        return self.table("conversations").select(F.col("conv_id").alias("notice_id"), F.col("turn").alias("ver"), F.col("role").alias("step"), summary.alias("summary"), "text", F.length("text").alias("tokens"))
