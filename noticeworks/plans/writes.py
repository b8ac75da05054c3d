"""Tables changed in place, bucket by bucket, and the whole pass of collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import ingest
from noticeworks.operators import collection, staging
from noticeworks.operators.buckets import BucketedTable
from noticeworks.plans.registry import query
from noticeworks.sources.fixtures import Frames, instant


def with_rewritten(table: BucketedTable, before: DataFrame) -> DataFrame:
    """Rows of a table, and whether the files of their bucket are others than before."""
    same = table.files().join(before, ["bucket", "file"], "left_semi").select("bucket").distinct().withColumn("same", F.lit(True))
    return table.read().join(F.broadcast(same), "bucket", "left").withColumn("rewritten", F.col("same").isNull()).drop("same")  # one row a bucket


def compared(before: str, after: str, keys: str, bucket: str, buckets: int) -> str:
    """SQL for the rows after a change and whether their bucket holds any difference."""
    return f"""d AS (SELECT {bucket} % {buckets} AS bucket FROM ((SELECT * FROM {before} EXCEPT SELECT * FROM {after}) UNION ALL (SELECT * FROM {after} EXCEPT SELECT * FROM {before})))
        SELECT {keys}, ({bucket} % {buckets})::INTEGER AS bucket, {bucket} % {buckets} IN (SELECT bucket FROM d) AS rewritten FROM {after}"""


@query("SNK_07_09_upserted_buckets", f"""
    WITH o AS (SELECT c_custkey AS key, c_name AS value FROM customer),
    u AS (SELECT c_custkey AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 32 IN (3, 7) AND c_acctbal < 2000 UNION ALL SELECT c_custkey + 32000000, c_name FROM customer WHERE c_custkey % 32 = 5 UNION ALL SELECT key, value FROM o WHERE key % 32 > 20),
    up AS (SELECT * FROM u UNION ALL SELECT * FROM o WHERE key NOT IN (SELECT key FROM u)),
    a AS (SELECT key, CASE WHEN key % 32 = 11 THEN 'set' ELSE value END AS value FROM up), {compared("o", "a", "key, value", "key", 32)}""", False)
def snk_07_buckets(t: Frames) -> DataFrame:
    """An upsert (some rows other, some new, most the same), then a conditional update; only buckets with a difference are written."""
    customer, key = t.table("customer"), F.col("c_custkey")
    rows = customer.select(key.alias("key"), F.col("c_name").alias("value"))
    table = BucketedTable.create(rows, staging.folder(t.spark, "settings"), ["key"], 32, F.pmod("key", F.lit(32)))
    before = staging.written(table.files(), "files")
    other = customer.where((key % 32).isin(3, 7) & (F.col("c_acctbal") < 2000)).select(key.alias("key"), F.col("c_mktsegment").alias("value"))
    new = customer.where(key % 32 == 5).select((key + 32000000).alias("key"), F.col("c_name").alias("value"))
    table.upsert(other.unionByName(new).unionByName(rows.where("key % 32 > 20")))
    table.update(customer.where(key % 32 == 11).select(key.alias("key"), F.lit("set").alias("value")).unionByName(rows.select((-F.col("key")).alias("key"), "value")))
    return with_rewritten(table, before)


@query("SNK_05_06_replaced_buckets", f"""
    WITH o AS (SELECT notice_id, topic, max(l2) AS l2, min(line) % 3 AS rule_ver FROM scores GROUP BY 1, 2), kept AS (SELECT * FROM o WHERE NOT (rule_ver <> 0 AND notice_id % 16 IN (2, 9))),
    a AS (SELECT * FROM kept UNION ALL SELECT id, 5, 7, 1 FROM notices WHERE stage = 'P' AND id % 16 IN (2, 9) AND NOT EXISTS (SELECT 1 FROM kept WHERE notice_id = id AND topic = 5)), {compared("o", "a", "notice_id, topic, l2, rule_ver", "notice_id", 16)}""")
def snk_05_buckets(t: Frames) -> DataFrame:
    """Rule rows of some notices replaced, rows set by hand (version 0) kept."""
    rows = t.scores.groupBy("notice_id", "topic").agg(F.max("l2").alias("l2"), (F.min("line") % 3).alias("rule_ver"))
    table = BucketedTable.create(rows, staging.folder(t.spark, "topics"), ["notice_id", "topic"], 16, F.pmod("notice_id", F.lit(16)))
    before = staging.written(table.files(), "files")
    mine = lambda c: (F.col(c) % 16).isin(2, 9)
    fresh = t.notices.where((F.col("stage") == "P") & mine("id")).select(F.col("id").alias("notice_id"), F.lit(5).cast("long").alias("topic"), F.lit(7).alias("l2"), F.lit(1).alias("rule_ver"))
    table.replace((F.col("rule_ver") != 0) & mine("notice_id"), fresh)
    return with_rewritten(table, before)


PASS_RULES = ((1, 1, "urgent", 3), (2, 1, "-", 1), (3, 2, "LOW", 2), (4, 3, "medium", 1))
PASS_MAP = (
    ("title", "$.name", None), ("org_name", "$.org", None), ("url", "urlfmt:https://notices.example/{url}", None),
    ("open_dt", "$.open", "%Y%m%d%H%M"), ("close_dt", "$.close", "%Y.%m.%d"), ("extra:status", "$.status", None),
)
PASS_SQL = f"""
    WITH rules AS (SELECT * FROM (VALUES {", ".join(map(str, PASS_RULES))}) r(rule_id, topic, term, weight)), t0 AS (SELECT TIMESTAMP '1997-06-01' AS now, TIMESTAMP '1996-06-01' AS start),
    m AS (SELECT o_orderkey AS item_no, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS title, CASE WHEN o_orderkey % 9 <> 0 THEN 'Org ' || o_custkey % 40 END AS org_name, 'https://notices.example/' || o_orderkey // 3 AS url,
        CASE WHEN o_orderkey % 8 <> 0 THEN date_trunc('minute', o_orderdate) END AS open_dt, CASE WHEN o_orderkey % 5 <> 0 THEN date_trunc('day', o_orderdate) + INTERVAL 200 DAY END AS close_dt, o_orderstatus AS status FROM orders),
    j AS (SELECT m.*, CASE WHEN title IS NULL OR org_name IS NULL THEN 'incomplete' WHEN status NOT IN ('O', 'F') THEN 'status' WHEN open_dt < start THEN 'out_of_window' WHEN close_dt < now THEN 'already_closed' END AS reason FROM m, t0),
    taken AS (SELECT * FROM j WHERE reason IS NULL), known AS (SELECT 'Org ' || c_custkey AS org_name, c_custkey AS org_id FROM customer WHERE c_custkey < 20),
    before AS (SELECT o_orderkey AS id, 'https://notices.example/' || o_orderkey // 3 AS url, o_orderpriority AS title, 'Org ' || (o_custkey % 15 + 1) AS org_name, o_orderdate AS open_dt, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 400 DAY END AS close_dt, o_orderdate AS created_at FROM orders WHERE o_orderkey % 12 = 0),
    added AS (SELECT NULL::BIGINT AS id, url, title, org_name, open_dt, close_dt, now AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY item_no) AS n FROM taken WHERE url NOT IN (SELECT url FROM before)), t0 WHERE n = 1),
    every AS (SELECT *, coalesce(open_dt, created_at) AS anchor FROM (SELECT * FROM before UNION ALL SELECT * FROM added)),
    hit AS (SELECT item_no, topic FROM taken JOIN rules ON contains(lower(title), lower(term)) GROUP BY 1, 2 HAVING sum(weight) >= 2), scored AS (SELECT url, topic FROM hit JOIN taken USING (item_no)),
    gaps AS (SELECT *, lag(anchor) OVER w AS prev FROM every WHERE org_name IS NOT NULL WINDOW w AS (PARTITION BY org_name, title ORDER BY anchor)),
    c AS (SELECT org_name, title, sum(CASE WHEN prev IS NOT NULL AND date_sub('day', prev, anchor) > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY org_name, title ORDER BY anchor ROWS UNBOUNDED PRECEDING) AS cluster FROM gaps),
    sizes AS (SELECT count(*) AS n FROM c GROUP BY org_name, title, cluster), gone AS (SELECT url FROM every, t0 WHERE close_dt < now - INTERVAL 3 DAY OR (close_dt IS NULL AND strftime(created_at, '%Y-%m-%d') < strftime(now - INTERVAL 60 DAY, '%Y-%m-%d')))
"""


def collected(t: Frames) -> collection.Pass:
    """Orders as items of a source, three to an address; each twelfth is a notice already."""
    o, key = t.table("orders"), F.col("o_orderkey")
    item = F.to_json(F.struct(
        F.when(key % 17 != 0, F.col("o_orderpriority")).alias("name"), F.when(key % 9 != 0, F.concat(F.lit("Org "), F.col("o_custkey") % 40)).alias("org"), F.floor(key / 3).cast("string").alias("url"),
        F.when(key % 8 != 0, F.date_format("o_orderdate", "yyyyMMddHHmm")).alias("open"), F.when(key % 5 != 0, F.date_format(F.date_add("o_orderdate", 200), "yyyy.MM.dd")).alias("close"), F.col("o_orderstatus").alias("status"),
    ))
    ingest.validate(PASS_MAP)
    rows = o.select(key.alias("item_no"), *ingest.compiled(item, PASS_MAP)).withColumn("status", F.try_element_at("extra", F.lit("status"))).drop("extra")
    orgs = t.table("customer").where("c_custkey < 20").select(F.col("c_custkey").alias("org_id"), F.concat(F.lit("Org "), "c_custkey").alias("org_name"))
    there = o.where(key % 12 == 0).select(
        key.alias("id"), F.concat(F.lit("https://notices.example/"), F.floor(key / 3).cast("string")).alias("url"), F.col("o_orderpriority").alias("title"), (F.col("o_custkey") % 15 + 1).alias("org_id"),
        F.col("o_orderdate").alias("open_dt"), F.when(key % 2 == 0, F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")).alias("close_dt"), F.col("o_orderdate").alias("created_at"),
    )
    rules = t.spark.createDataFrame([*PASS_RULES], "rule_id int, topic int, term string, weight int")
    none = t.spark.createDataFrame([], "notice_id long, topic int, score long")
    return collection.collect(rows, there, orgs, none, rules, ("O", "F"), instant("1996-06-01"), instant("1997-06-01"))


@query("Q_15_collected_counts", PASS_SQL + """
    SELECT count(*) AS fetched, count(*) FILTER (reason IN ('incomplete', 'status')) AS skipped, count(*) FILTER (reason = 'out_of_window') AS out_of_window, count(*) FILTER (reason = 'already_closed') AS already_closed, (SELECT count(*) FROM added) AS inserted,
        (SELECT count(*) FROM scored) AS scored, (SELECT count(*) FROM sizes WHERE n > 1) AS groups_with_duplicates, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM sizes) AS superseded, (SELECT count(*) FROM gone) AS expired FROM j""", False)
def q_15_counts(t: Frames) -> DataFrame:
    return collected(t).counts


@query("Q_15_collected_notices", PASS_SQL + """, n AS (SELECT url, count(*) AS n FROM scored GROUP BY 1)
    SELECT url, title, org_name, coalesce(n, 0) AS n_scores FROM every LEFT JOIN n USING (url) WHERE url NOT IN (SELECT url FROM gone)""", False)
def q_15_notices(t: Frames) -> DataFrame:
    """Notices that stand after a pass, with their organisation and how many scores they have."""
    done = collected(t)
    n = done.scores.groupBy(F.col("notice_id").alias("id")).agg(F.count("*").alias("n"))
    return done.notices.join(n, "id", "left").join(done.orgs, "org_id", "left").select("url", "title", "org_name", F.coalesce("n", F.lit(0)).alias("n_scores"))
