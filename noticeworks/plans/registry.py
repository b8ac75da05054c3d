"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noticeworks.sources.fixtures import Frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The domain frames in SQL.
VIEWS = r"""
sources AS (
    SELECT n_nationkey::BIGINT AS source_id, n_name AS source_name, r_name AS channel, n_nationkey % 5 <> 4 AS active
    FROM nation JOIN region ON n_regionkey = r_regionkey
), orgs AS (
    SELECT c_custkey AS org_id, c_name AS org_name, c_mktsegment AS category, c_nationkey::BIGINT AS source_id, c_acctbal AS balance FROM customer
), line_ends AS (
    SELECT l_orderkey, max(l_shipdate) AS close_dt, min(l_linenumber::BIGINT * 1000000000 + l_partkey) % 1000000000 AS p_partkey FROM lineitem GROUP BY 1
), notices AS (
    SELECT o_orderkey AS id, o_custkey AS org_id, o_orderstatus AS stage, o_orderpriority AS biz_type, o_totalprice AS est_price,
           CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderdate END AS open_dt, o_orderdate AS created_at, close_dt, p_name AS title
    FROM orders LEFT JOIN line_ends ON l_orderkey = o_orderkey LEFT JOIN part USING (p_partkey)
), scores AS (
    SELECT l_orderkey AS notice_id, l_suppkey % 20 AS topic, floor(l_quantity / 4)::INTEGER AS l2, l_discount + 0.0 AS priority, l_linenumber AS line FROM lineitem
), evs AS (
    SELECT event_id, ts, user_id AS customer_id, json_extract_string(props, '$.k')::BIGINT AS notice_id,
           CASE event_type WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'unlike' ELSE event_type END AS event_type, value
    FROM events WHERE event_type <> 'signup'
), runs AS (
    SELECT event_id AS run_id, user_id % 27 AS source_id, ts AS run_at,
           CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'running' WHEN 'view' THEN 'warn' ELSE 'ok' END AS status, value FROM events
), analyses AS (
    SELECT conv_id AS notice_id, turn AS ver, role AS step, CASE WHEN role = 'assistant' THEN text END AS summary, text, length(text)::INTEGER AS tokens FROM conversations
), statused AS (
    SELECT n.*, o.org_name, o.category, s.source_id, s.source_name, s.channel,
           CASE WHEN close_dt <= TIMESTAMP '2000-01-01' THEN 'closed' WHEN open_dt IS NULL THEN 'unscheduled' WHEN open_dt > TIMESTAMP '2000-01-01' THEN 'upcoming' ELSE 'in_progress' END AS bid_status
    FROM notices n LEFT JOIN orgs o USING (org_id) LEFT JOIN sources s ON s.source_id = o.source_id
)
"""


def query(name: str, sql: str | None = None, with_views: bool = True):
    """Registers a function of the domain frames; the SQL may use the frames by name."""

    def put(f: Callable[[Frames], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Frames(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {VIEWS} {', ' + sql.strip()[5:] if sql.strip().upper().startswith('WITH ') else sql}" if with_views else sql
        return f

    return put
