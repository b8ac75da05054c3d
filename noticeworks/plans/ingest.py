"""Ingest: items to records, masks, rejects, attachments, appends; text columns and formats."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import ingest, labels
from noticeworks.operators import staging, upkeep
from noticeworks.plans.registry import query
from noticeworks.sources import captures, pages
from noticeworks.sources.fixtures import Frames

FIELD_MAP = (
    ("title", "$.body.name", None),
    ("org_name", "const:Agency", None),
    ("url", "urlfmt:https://notices.example/{key}?c={cust}", None),
    ("open_dt", "$.open", "%Y%m%d%H%M"),
    ("close_dt", "$.close", "%Y.%m.%d"),
    ("est_price", "$.price", None),
    ("extra:status", "$.status", None),
)


def items(t: Frames) -> DataFrame:
    """Orders as captured JSON items: some ends are the sentinel of year 9999, some keys are missing, prices have commas."""
    o = t.table("orders")
    key = F.col("o_orderkey")
    item = F.to_json(
        F.struct(
            F.struct(F.when(key % 17 != 0, F.col("o_orderpriority")).alias("name")).alias("body"), key.cast("string").alias("key"), F.when(key % 13 != 0, F.col("o_custkey").cast("string")).alias("cust"),
            F.date_format("o_orderdate", "yyyyMMddHHmm").alias("open"), F.when(key % 5 == 0, "9999.12.31").when(key % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy.MM.dd")).alias("close"),
            F.when(key % 11 == 0, "n/a").otherwise(F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit(","), F.lpad((F.floor("o_totalprice") % 1000).cast("string"), 3, "0"), F.lit(".7 "))).alias("price"), F.col("o_orderstatus").alias("status"),
        )
    )
    return o.select("o_orderkey", item.alias("item"))


MAP_SQL = """
    WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS title, 'Agency' AS org_name, CASE WHEN o_orderkey % 13 <> 0 THEN 'https://notices.example/' || o_orderkey || '?c=' || o_custkey END AS url,
        date_trunc('minute', o_orderdate) AS open_dt, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN date_trunc('day', o_orderdate) END AS close_dt, CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice)::BIGINT END AS est_price, o_orderstatus AS status FROM orders)
"""


def mapped(t: Frames) -> DataFrame:
    ingest.validate(FIELD_MAP)
    rows = items(t)
    return rows.select("o_orderkey", *ingest.compiled(F.col("item"), FIELD_MAP)).withColumn("status", F.try_element_at("extra", F.lit("status"))).drop("extra")


@query("MAP_01_to_06_mapped_items", MAP_SQL + "SELECT o_orderkey, title, org_name, url, strftime(open_dt, '%Y-%m-%d %H:%M') AS opened, strftime(close_dt, '%Y-%m-%d') AS closed, est_price::VARCHAR AS price, status FROM m", False)
def map_01(t: Frames) -> DataFrame:
    return mapped(t).select("o_orderkey", "title", "org_name", "url", F.date_format("open_dt", "yyyy-MM-dd HH:mm").alias("opened"), F.date_format("close_dt", "yyyy-MM-dd").alias("closed"), F.col("est_price").cast("string").alias("price"), "status")


@query("MAP_07_required_gate", MAP_SQL + "SELECT title IS NOT NULL AND url IS NOT NULL AS complete, count(*) AS n FROM m GROUP BY 1", False)
def map_07(t: Frames) -> DataFrame:
    return mapped(t).groupBy(ingest.complete().alias("complete")).agg(F.count("*").alias("n"))


@query("MAP_10_AGG_22_STR_04_reject_reasons", MAP_SQL + "SELECT CASE WHEN status NOT IN ('O', 'F') THEN 'status' WHEN open_dt < TIMESTAMP '1995-01-01' THEN 'out_of_window' WHEN close_dt < TIMESTAMP '1997-06-01' THEN 'already_closed' ELSE 'taken' END AS reason, count(*) AS n FROM m GROUP BY 1", False)
def map_10(t: Frames) -> DataFrame:
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    reason = ingest.reject_reason(F.col("status"), ("O", "F"), F.col("open_dt"), at("1995-01-01"), F.col("close_dt"), at("1997-06-01"))
    return mapped(t).groupBy(F.coalesce(reason, F.lit("taken")).alias("reason")).agg(F.count("*").alias("n"))


PATHS = {"deep": "$.a[*].b", "nested": "$.rows[*].cells[*]", "inner": "$.rows[*].cells[*].v", "late": "$.a[*].only", "whole": "$.a[*]", "one": "$.a[1].b", "none": "$.missing[*].b", "plain": "$.kind"}


@query("MAP_01_first_matches", """
    SELECT event_id, event_id::VARCHAR AS deep, '{"v":"' || event_type || '"}' AS nested, event_type AS inner, CASE WHEN event_id % 2 = 0 THEN 'last' END AS late, '{"c":0}' AS whole, event_id::VARCHAR AS one, NULL::VARCHAR AS none, event_type AS plain FROM events""", False)
def map_01_first(t: Frames) -> DataFrame:
    """The first of several matches of a path; some lead nowhere, some only in a later element."""
    body = F.expr("""concat('{"kind":"', event_type, '","a":[{"c":0},{"b":', event_id, '},{"b":7', if(event_id % 2 = 0, ',"only":"last"', ''), '}],"rows":[{"cells":[]},{"cells":[{"v":"', event_type, '"},{"v":"x"}]}]}')""")
    return t.table("events").select("event_id", body.alias("body")).select("event_id", *(ingest.resolve(F.col("body"), path).alias(name) for name, path in PATHS.items()))


@query("MAP_09_masked_map", "SELECT event_id, '[개인정보 마스킹됨]' AS telno, props AS deptnm FROM events", False)
def map_09(t: Frames) -> DataFrame:
    bag = ingest.masked(F.create_map(F.lit("telNo"), F.col("event_type"), F.lit("deptNm"), F.col("props")))
    return t.table("events").select("event_id", bag["telNo"].alias("telno"), bag["deptNm"].alias("deptnm"))


#: A body with personal keys over objects, arrays and scalars at several depths, one in a string, names that are allowed, and the event's own properties.
BODY = (
    '{{"manager":{{"name":"{kind}","no":[{n}]}},"telNo":["010-{n}",{{"x":1}}],"a":[{{"b":{{"eMail":{{"x":"k@x.kr"}}}},"v":{n}}},{{"props":{props},"charger":null}}],'
    '"note":"say \\"telNo\\": 5","orgNm":"{kind}","deptNm":{{"mbrId":true,"in":[[{{"연락처":{n}}}]]}},"n":null}}'
)
BODY_SQL = "'" + BODY.replace("{{", "{").replace("}}", "}").replace("{kind}", "' || event_type || '").replace("{n}", "' || event_id || '").replace("{props}", "' || props || '") + "'"
MASKED_SQL = f"""
    WITH bodies AS (SELECT event_id, event_type, ({BODY_SQL})::JSON AS body FROM events)
    SELECT event_id, event_type, json_object('manager', m, 'telNo', m, 'a', json_array(json_object('b', json_object('eMail', m), 'v', body->'$.a[0].v'), json_object('props', body->'$.a[1].props', 'charger', m)),
        'note', body->'$.note', 'orgNm', body->'$.orgNm', 'deptNm', json_object('mbrId', m, 'in', json_array(json_array(json_object('연락처', m)))), 'n', body->'$.n')::VARCHAR AS body
    FROM bodies, (SELECT '[개인정보 마스킹됨]' AS m)
"""


def bodies(t: Frames) -> DataFrame:
    return t.table("events").select("event_id", "event_type", F.expr(BODY_SQL.replace("\\", "\\\\")).alias("body"))


@query("MAP_09_masked_json", f"SELECT event_id, body FROM ({MASKED_SQL})", False)
def map_09_json(t: Frames) -> DataFrame:
    return bodies(t).select("event_id", ingest.masked_json(F.col("body")).alias("body"))


@query("SRC_05_envelopes", "SELECT event_id, CASE event_type WHEN 'error' THEN 'LIMIT' WHEN 'view' THEN 'bad' END AS error FROM events", False)
def src_05(t: Frames) -> DataFrame:
    body = F.when(F.col("event_type") == "error", '{"OpenAPI_ServiceResponse":{"cmmMsgHeader":{"errMsg":"x","returnAuthMsg":"LIMIT"}}}').when(F.col("event_type") == "view", '{"response":{"header":{"resultCode":"08","resultMsg":"bad"}}}')
    body = body.when(F.col("event_type") == "click", '{"response":{"header":{"resultCode":"03","resultMsg":"none"}}}').otherwise('{"items":[]}')
    return t.table("events").select("event_id", captures.envelope_error(body).alias("error"))


@query("SRC_04_xml_items", "SELECT s_suppkey, 1 + s_suppkey % 2 AS n_items, s_name AS first FROM supplier", False)
def src_04(t: Frames) -> DataFrame:
    item = F.concat(F.lit("<item><nm>"), "s_name", F.lit("</nm></item>"))
    text = F.concat(F.lit("<body><items>"), item, F.when(F.col("s_suppkey") % 2 == 1, item).otherwise(""), F.lit("</items></body>"))
    found = captures.from_xml(text, "items struct<item: array<struct<nm: string>>>")
    return t.table("supplier").select("s_suppkey", F.size(found["items"]["item"]).cast("long").alias("n_items"), found["items"]["item"][0]["nm"].alias("first"))


@query("SRC_04_xml_any_shape", """
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name ELSE NULL END AS plain, CASE s_suppkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 END::BIGINT AS n_items, CASE WHEN s_suppkey % 4 IN (1, 2) THEN s_name || ' & ' || s_suppkey END AS first,
        CASE s_suppkey % 4 WHEN 2 THEN '["00","1"]' WHEN 1 THEN '"00"' END AS codes FROM supplier""", False)
def src_04_any(t: Frames) -> DataFrame:
    """Texts of three shapes in one column: a leaf, one item, several items beside a repeated name; each fourth is damaged."""
    key, item = F.col("s_suppkey"), F.concat(F.lit("<item no='7'><nm>"), "s_name", F.lit(" &amp; "), F.col("s_suppkey").cast("string"), F.lit("</nm></item>"))
    one = F.concat(F.lit("<r><code>00</code><items>"), item, F.lit("</items></r>"))
    more = F.concat(F.lit("<r><code>00</code><items>"), item, F.lit("<item/></items><code>1</code></r>"))
    leaf = F.concat(F.lit("<r><![CDATA["), "s_name", F.lit("]]></r>"))
    text = F.when(key % 4 == 0, leaf).when(key % 4 == 1, one).when(key % 4 == 2, more).otherwise(F.concat(F.lit("<r>"), "s_name"))
    rows = t.table("supplier").select("s_suppkey", captures.xml_value(text).alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    # Of an object the root is no text.
    root = get("$.r", "variant")
    plain = F.when(F.schema_of_variant(root) == "STRING", get("$.r", "string"))
    codes = F.to_json(get("$.r.code", "variant"))
    return rows.select("s_suppkey", plain.alias("plain"), F.size(get("$.r.items.item", "array<variant>")).cast("long").alias("n_items"), get("$.r.items.item[0].nm", "string").alias("first"), codes.alias("codes"))


@query("SRC_04_05_answers", """
    SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'LIMIT ' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'bad' END AS error, s_suppkey % 6 <> 5 AS readable, CASE WHEN s_suppkey % 6 = 2 THEN s_name END AS name FROM supplier""", False)
def src_04_answers(t: Frames) -> DataFrame:
    """Answers to a request for XML: a gateway's error in JSON, an error and items in XML, and pages that are neither."""
    key = F.col("s_suppkey")
    gate = F.concat(F.lit('{"OpenAPI_ServiceResponse":{"cmmMsgHeader":{"returnAuthMsg":"LIMIT '), key.cast("string"), F.lit('"}}}'))
    bad = F.lit("<response><header><resultCode>08</resultCode><resultMsg>bad</resultMsg></header></response>")
    good = F.concat(F.lit("<response><header><resultCode>00</resultCode></header><body><items><item><nm>"), "s_name", F.lit("</nm></item></items></body></response>"))
    text = F.when(key % 3 == 0, gate).when(key % 3 == 1, bad).when(key % 6 == 2, good).otherwise("<html><p>Down for service")
    rows = t.table("supplier").select("s_suppkey", captures.answered(text).alias("body"))
    return rows.select("s_suppkey", captures.envelope_error(F.col("body")).alias("error"), F.col("body").isNotNull().alias("readable"), F.get_json_object("body", "$.response.body.items.item[0].nm").alias("name"))


@query("SRC_06_07_table_rows", "SELECT s_suppkey, s_name AS name, 'https://a.example/v?id=' || s_suppkey || '&t=x+y' AS url FROM supplier", False)
def src_06(t: Frames) -> DataFrame:
    cells = F.concat(F.lit("<table class='x tbl01'><tr><th>n</th><th>m</th></tr><tr><td>"), "s_name", F.lit("</td><td><a href=\"javascript:view('"), F.col("s_suppkey").cast("string"), F.lit("','x y')\">go</a></td></tr><tr><td>odd</td></tr></table>"))
    rows = pages.table_rows(t.table("supplier").select("s_suppkey", cells.alias("html")), "html", "tbl01", ["name", "go"])
    return rows.select("s_suppkey", "name", pages.detail_url("https://a.example/v", ["id", "t"], pages.call_arguments(F.col("href"), "view")).alias("url"))


@query("SRC_08_links", "SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS n_links FROM pages", False)
def src_08(t: Frames) -> DataFrame:
    return t.table("pages").select("page_id", F.size(pages.text_and_links("html")["links"]).cast("long").alias("n_links"))


@query("SRC_09_crawl", """
    WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 100 AS dst FROM lineitem), s0 AS (SELECT 1 AS url, 0 AS step), s1 AS (SELECT DISTINCT dst AS url, 1 AS step FROM e JOIN s0 ON src = url WHERE dst NOT IN (SELECT url FROM s0)),
    s2 AS (SELECT DISTINCT dst AS url, 2 AS step FROM e JOIN s1 ON src = url WHERE url % 2 = 0 AND dst NOT IN (SELECT url FROM s0 UNION SELECT url FROM s1))
    SELECT url::BIGINT AS url, step FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) ORDER BY step, url LIMIT 30""", False)
def src_09(t: Frames) -> DataFrame:
    links = t.table("lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst")).distinct()
    return pages.crawl(links, t.spark.range(1, 2).select(F.col("id").alias("url")), stop=(F.col("step") > 0) & (F.col("url") % 2 == 1))


@query("SRC_13_attachments", """
    SELECT p_partkey, '규격서1' AS name, 'https://f.example/' || p_partkey AS place FROM part UNION ALL SELECT p_partkey, p_name, 'https://f.example/n/' || p_partkey FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, '규격항목2', p_type FROM part""", False)
def src_13(t: Frames) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    item = F.to_json(F.struct(F.concat(F.lit("https://f.example/"), key).alias("specDocFileUrl1"), F.concat(F.lit("https://f.example/n/"), key).alias("ntceSpecDocUrl3"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("ntceSpecFileNm3"), F.col("p_type").alias("specItemCntnts2")))
    return t.table("part").select("p_partkey", F.inline(captures.attachments(item))).select("p_partkey", "name", F.coalesce("url", "text").alias("place"))


@query("SRC_14_15_latest_item", "SELECT user_id AS key, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1".replace("max_by", "arg_max"), False)
def src_14(t: Frames) -> DataFrame:
    body = F.to_json(F.struct(F.array(F.to_json(F.struct("user_id", "event_id"))).alias("items")))
    found = captures.items(t.table("events").select(F.col("ts").alias("fetched_at"), body.alias("body")))
    last = captures.latest_items(found, F.get_json_object("item", "$.user_id").cast("long"))
    return last.select("key", F.get_json_object("item", "$.event_id").cast("long").alias("event_id"))


@query("SRC_16_STR_05_windows", "SELECT source_id, strftime(greatest(coalesce(max(run_at) FILTER (status = 'ok') - INTERVAL 1 HOUR, TIMESTAMP '2024-01-31' - INTERVAL 60 DAY), TIMESTAMP '2024-01-31' - INTERVAL 60 DAY), '%Y-%m-%d %H:%M:%S') AS begins FROM runs GROUP BY 1")
def src_16(t: Frames) -> DataFrame:
    return upkeep.collection_window(t.runs, t.events_now).select("source_id", F.date_format("begin", "yyyy-MM-dd HH:mm:ss").alias("begins"))


@query("SRC_17_links_by_pattern", "SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS n FROM pages", False)
def src_17(t: Frames) -> DataFrame:
    return t.table("pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("n"))


@query("SRC_09_link_targets", """
    WITH hrefs AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, unnest(regexp_extract_all(html, 'href="(/[^"#]*)', 1)) AS href FROM pages)
    SELECT page_id, count(DISTINCT href) AS n, min(root || href) AS first FROM hrefs GROUP BY 1""", False)
def src_09_targets(t: Frames) -> DataFrame:
    rows = t.table("pages").select("page_id", F.explode(pages.linked(F.col("url"), pages.text_and_links("html")["links"])).alias("target"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n"), F.min("target").alias("first"))


@query("SRC_17_attachments_or_body", """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '.hwp' WHEN p_partkey % 3 = 1 THEN p_name || chr(10) || p_brand || chr(10) || p_type END AS place FROM part""", False)
def src_17_body(t: Frames) -> DataFrame:
    """Attachments of a page by pattern; a page without any gives the text of its content element, and none at all a null."""
    file = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("<a onclick=\"f_down('1','2','"), "p_name", F.lit(".hwp')\">")))
    body = F.when(F.col("p_partkey") % 3 < 2, F.concat(F.lit("<div class='view se-contents'><p>"), "p_name", F.lit("</p><div>"), "p_brand", F.lit("</div>"), "p_type", F.lit("</div>")))
    html = F.concat(F.lit("<div>head</div>"), F.coalesce(file, F.lit("")), F.coalesce(body, F.lit("")), F.lit("<div>foot</div>"))
    rows = t.table("part").select("p_partkey", html.alias("html"))
    names = F.regexp_extract_all("html", F.lit(r"f_down\('[^']*','[^']*','([^']*)'\)"), F.lit(1))
    return rows.select("p_partkey", F.coalesce(F.nullif(F.array_join(names, ","), F.lit("")), pages.text_within(F.col("html"), "se-contents")).alias("place"))


TARGETS = ("title", "manager_tel", "extra:deptNm", "extra:managerName", "extra:Email", "extra:status", "content", "body", "extra:담당자", "est_price")


@query("MAP_08_refused_targets", f"""
    WITH targets AS (SELECT unnest({list(TARGETS)}) AS target)
    SELECT n_nationkey, target, list_contains({sorted(ingest.BANNED)}, target) OR (starts_with(target, 'extra:') AND NOT list_contains({list(ingest.PII_ALLOWED)}, lower(target[7:])) AND regexp_matches(target[7:], '{ingest.PII_KEYS}'))
        OR (n_nationkey % 2 = 0 AND list_contains({sorted(ingest.BANNED_TIER_B)}, target)) AS refused FROM nation, targets""", False)
def map_08(t: Frames) -> DataFrame:
    """Maps of sources of two legal tiers, a row for each target."""
    tier = F.when(F.col("n_nationkey") % 2 == 0, "B").otherwise("A")
    rows = t.table("nation").select("n_nationkey", tier.alias("tier"), F.explode(F.array(*map(F.lit, TARGETS))).alias("target"))
    return rows.select("n_nationkey", "target", ingest.refused(F.col("target"), F.col("tier")).alias("refused"))


@query("SNK_02_03_new_rows", "WITH e AS (SELECT user_id AS url, min(event_id) AS event_id FROM events GROUP BY 1) SELECT url, event_id FROM e WHERE url NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", False)
def snk_02(t: Frames) -> DataFrame:
    incoming = t.table("events").select(F.col("user_id").alias("url"), "event_id")
    there = t.table("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("url"))
    return upkeep.new_rows(incoming, there, ["url"], ["event_id"]).select("url", "event_id")


@query("SNK_03_get_or_create", """
    WITH fresh AS (SELECT DISTINCT p_name FROM part WHERE p_name NOT IN (SELECT org_name FROM orgs WHERE org_name IS NOT NULL)), top AS (SELECT max(org_id) AS top FROM orgs)
    SELECT org_id, org_name AS kept_name, NULL::BIGINT AS names FROM orgs
    UNION ALL SELECT top + n, NULL, 1 FROM top, (SELECT row_number() OVER () AS n FROM fresh)""")
def snk_03(t: Frames) -> DataFrame:
    """Every key with the name it had, and how many names each new key has; which new name has which new key is left open."""
    names = t.table("part").select(F.col("p_name").alias("org_name"))
    rows = upkeep.get_or_create(t.orgs, names, "org_id", "org_name")
    known = t.orgs.select("org_id", F.col("org_name").alias("kept_name"))
    counted = rows.groupBy("org_id").agg(F.count_distinct("org_name").alias("names")).join(known, "org_id", "left")
    return counted.select("org_id", "kept_name", F.when(F.col("kept_name").isNull(), F.col("names")).alias("names"))


@query("SNK_05_06_replace", "SELECT notice_id, topic FROM scores WHERE line = 1 UNION ALL SELECT id, 99 FROM notices WHERE stage = 'P'")
def snk_05(t: Frames) -> DataFrame:
    fresh = t.notices.where("stage = 'P'").select(F.col("id").alias("notice_id"), F.lit(99).cast("long").alias("topic"), F.lit(0).alias("line"))
    return upkeep.replaced(t.scores.select("notice_id", "topic", "line"), F.col("line") == 1, fresh).select("notice_id", "topic")


@query("SNK_07_upsert", "SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0", False)
def snk_07(t: Frames) -> DataFrame:
    rows = t.table("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    fresh = t.table("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return upkeep.upsert(rows, fresh, ["key"])


@query("SNK_15_16_views", "SELECT notice_id, count(*) AS views, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM evs WHERE event_type = 'view' GROUP BY 1")
def snk_15(t: Frames) -> DataFrame:
    return t.events.where("event_type = 'view'").groupBy("notice_id").agg(F.count("*").alias("views"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"))


def chain(rules, text: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({text}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in rules) + " END"


TITLES = ("2026 시스템 유지보수", "서버 임대 및 구축", "R&D 과제", "포털 고도화 개발", "청사 신설", "정보시스템 감리", "OO대학교병원 운영", "none")
NAMES = ("OO대학교병원", "충청남도 예산군", "한국수자원공사", "서울 도", "상하수도사업소", "특허청", "신용보증기금", "누리 재단")


@query("CASE_08_work_type", f"WITH x AS (SELECT p_partkey, {list(TITLES)}[1 + p_partkey % 8] AS title FROM part) SELECT p_partkey, {chain(labels.WORK_TYPE_RULES, 'title')} AS work_type FROM x", False)
def case_08(t: Frames) -> DataFrame:
    title = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return t.table("part").select("p_partkey", labels.work_type(title).alias("work_type"))


@query("CASE_09_org_category", f"""WITH x AS (SELECT p_partkey, {list(NAMES)}[1 + p_partkey % 8] AS name FROM part)
    SELECT p_partkey, coalesce({chain(labels.ORG_RULES, 'name')}, CASE WHEN length(string_split(name, ' ')[-1]) >= 2 AND right(name, 1) IN ('도', '시', '군', '구') THEN '지방행정' END) AS category FROM x""", False)
def case_09(t: Frames) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return t.table("part").select("p_partkey", labels.org_category(name).alias("category"))


@query("CASE_10_channel_name", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'IRIS' WHEN c_custkey % 4 = 1 THEN c_mktsegment ELSE c_name END AS channel FROM customer", False)
def case_10(t: Frames) -> DataFrame:
    name = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("IRIS "), "c_name")).otherwise(F.col("c_name"))
    return t.table("customer").select("c_custkey", labels.channel_name(name, F.when(F.col("c_custkey") % 4 == 1, F.col("c_mktsegment")).when(F.col("c_custkey") % 4 == 2, "")).alias("channel"))


@query("CASE_11_sections", "SELECT id, CASE WHEN stage = 'F' THEN 'plan' WHEN stage = 'P' OR (channel = 'ASIA' AND bid_status IN ('upcoming', 'unscheduled')) THEN 'prenotice' ELSE 'active' END AS section FROM statused")
def case_11(t: Frames) -> DataFrame:
    from noticeworks.plans.listings import GOV, base

    return base(t).select("id", labels.section(F.col("stage"), labels.notice_type(F.col("channel"), GOV), F.col("bid_status"), "P", "F").alias("section"))


@query("CASE_13_price_label", "SELECT id, CASE WHEN id % 9 = 0 THEN '미공개' WHEN est_price * 997 / 100000000 >= 1 THEN printf('%.1f', est_price * 997 / 100000000) || '억원' ELSE printf('%.0f', est_price * 997 / 10000) || '만원' END AS label FROM notices")
def case_13(t: Frames) -> DataFrame:
    return t.notices.select("id", labels.price_label(F.when(F.col("id") % 9 != 0, F.col("est_price") * 997)).alias("label"))


@query("CASE_14_days_left", """
    WITH d AS (SELECT id, datediff('day', (TIMESTAMP '2000-01-01' + INTERVAL 9 HOUR)::DATE, (close_dt + INTERVAL 9 HOUR)::DATE) AS days FROM notices)
    SELECT id, CASE WHEN days = 0 THEN 'D-Day' WHEN days > 0 THEN 'D-' || days END AS label, coalesce(days BETWEEN 0 AND 3, false) AS urgent FROM d""")
def case_14(t: Frames) -> DataFrame:
    days = labels.days_left(F.col("close_dt"), t.now)
    return t.notices.select("id", labels.dday_label(F.col("close_dt"), t.now).alias("label"), F.coalesce(days <= 3, F.lit(False)).alias("urgent"))


@query("CASE_15_period", """
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'soon' WHEN 1 THEN trim(CASE WHEN p_size >= 12 THEN (p_size // 12) || '년 ' ELSE '' END || CASE WHEN p_size % 12 > 0 THEN (p_size % 12) || '개월' ELSE '' END)
        WHEN 2 THEN '2년' ELSE CASE WHEN p_size % 12 = 0 THEN (1 + p_size // 12) || '년' ELSE (1 + p_size // 12) || '년 ' || (p_size % 12) || '개월' END END AS label FROM part""", False)
def case_15(t: Frames) -> DataFrame:
    size = F.col("p_size").cast("string")
    raw = F.when(F.col("p_size") % 4 == 0, "soon").when(F.col("p_size") % 4 == 1, F.concat(size, F.lit("개월(당해 9개월)"))).when(F.col("p_size") % 4 == 2, "2 년").otherwise(F.concat(F.lit("1년 "), size, F.lit(" 개월")))
    return t.table("part").select("p_partkey", labels.period_label(raw).alias("label"))


@query("CASE_16_notice_date", "SELECT id, CASE WHEN id % 3 = 0 THEN biz_type WHEN id % 3 = 1 THEN stage ELSE strftime(open_dt, '%Y-%m-%d') END AS notice_date FROM notices")
def case_16(t: Frames) -> DataFrame:
    extra = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("ancmDe"), F.col("biz_type"))).when(F.col("id") % 3 == 1, F.create_map(F.lit("nticeDt"), F.col("stage")))
    return t.notices.select("id", labels.notice_date(extra, F.col("open_dt")).alias("notice_date"))


@query("CASE_17_embedding_text", "SELECT id, concat_ws(' · ', nullif(title, ''), stage) || CASE WHEN id % 2 = 0 THEN chr(10) || chr(10) || biz_type ELSE '' END AS text FROM notices")
def case_17(t: Frames) -> DataFrame:
    return t.notices.select("id", labels.embedding_text(F.col("title"), F.lit(""), F.col("stage"), attachment=F.when(F.col("id") % 2 == 0, F.col("biz_type"))).alias("text"))


@query("CASE_18_board_like", "SELECT page_id, regexp_matches(regexp_replace(url, '^[^:]*://[^/?#]*', ''), '(?i)(board|bbs|notice|news|article|list|feed)') AS board FROM pages".replace("|feed", ""), False)
def case_18(t: Frames) -> DataFrame:
    return t.table("pages").select("page_id", labels.board_like(F.regexp_replace("url", "#.*$", "")).alias("board"))


@query("CASE_19_file_kind", "SELECT p_partkey, ['pdf', 'hwpx', 'hwp', 'zip', 'other'][1 + p_partkey % 5] AS kind, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'f' END AS name FROM part", False)
def case_19(t: Frames) -> DataFrame:
    name = F.concat(F.col("p_name"), F.element_at(F.array(*map(F.lit, (".PDF", ".hwpx", ".hwp", ".Zip", ".doc"))), (F.col("p_partkey") % 5 + 1).cast("int")))
    header = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("attachment; filename*=UTF-8''"), F.url_encode("p_name")))
    return t.table("part").select("p_partkey", labels.file_kind(name).alias("kind"), F.coalesce(labels.disposition_name(header, F.lit("f")), F.lit("f")).alias("name"))


@query("CASE_20_cost", "SELECT notice_id, sum(round(tokens / 1e6 * CASE step WHEN 'user' THEN 1.0 ELSE 5.0 END, 9)) AS cost FROM analyses GROUP BY 1")
def case_20(t: Frames) -> DataFrame:
    prices = t.spark.createDataFrame([("user", 1.0), ("assistant", 5.0), ("system", 5.0)], "step string, price double")
    rows = t.analyses.join(F.broadcast(prices), "step", "left")
    return rows.groupBy("notice_id").agg(F.sum(F.round(F.col("tokens") / 1e6 * F.coalesce("price", F.lit(5.0)), 9)).alias("cost"))


@query("STR_07_changed_hashes", "SELECT page_id, sha256(html) <> sha256(CASE WHEN page_id % 4 = 0 THEN html || '!' ELSE html END) AS changed FROM pages", False)
def str_07(t: Frames) -> DataFrame:
    before = F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    return t.table("pages").select("page_id", (~F.sha2("html", 256).eqNullSafe(F.sha2(before, 256))).alias("changed"))


@query("SRC_01_18_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_returnflag = 'R'", False)
def src_01(t: Frames) -> DataFrame:
    return t.table("lineitem").where((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_quantity")


@query("SNK_01_masked_captures", f"""
    WITH raw AS (SELECT event_type AS endpoint, ({BODY_SQL})::JSON AS body FROM events),
    walked AS (SELECT endpoint, key IS NOT NULL AND regexp_matches(key, '(?i)(ofcl|manager|charger|picnm|pic_?tel|refrnc|telno|celno|mbr|담당자|연락처|휴대폰|이메일|e-?mail)') AND lower(key) NOT IN ('deptnm', 'orgnm') AS personal FROM raw, json_tree(body))
    SELECT endpoint, count(*) FILTER (personal) AS masked, (SELECT count(*) FROM events WHERE event_type = endpoint) AS n FROM walked GROUP BY 1""", False)
def snk_01(t: Frames) -> DataFrame:
    """Captures are appended masked; read back, each has one mask for every personal key, none of which stands below another here."""
    path = staging.folder(t.spark, "captures")
    bodies(t).select(F.col("event_type").alias("endpoint"), ingest.masked_json(F.col("body")).alias("body")).write.mode("append").parquet(path)
    masks = F.size(F.split("body", re.escape(ingest.MASK))) - 1
    return t.spark.read.schema("endpoint string, body string").parquet(path).groupBy("endpoint").agg(F.sum(masks).alias("masked"), F.count("*").alias("n"))


@query("SNK_08_claims", "SELECT customer_id, notice_id, min(event_id) AS event_id FROM evs WHERE event_type = 'click' AND (customer_id, notice_id) NOT IN (SELECT (customer_id, notice_id) FROM evs WHERE event_type = 'like') GROUP BY 1, 2")
def snk_08(t: Frames) -> DataFrame:
    claims = t.events.where("event_type = 'click'").select("customer_id", "notice_id", "event_id")
    return upkeep.new_rows(claims, t.events.where("event_type = 'like'"), ["customer_id", "notice_id"], ["event_id"]).select("customer_id", "notice_id", "event_id")


@query("SNK_14_run_log", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'running' AND run_at < TIMESTAMP '2024-01-30 22:00:00' - INTERVAL 60 MINUTE THEN 'fail' ELSE status END AS status FROM runs) GROUP BY 1")
def snk_14(t: Frames) -> DataFrame:
    status = labels.source_status(F.lit(True), F.col("status"), F.col("run_at"), F.lit("2024-01-30 22:00:00").cast("timestamp_ntz"))
    return t.runs.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SNK_17_18_manual_topics", "SELECT DISTINCT notice_id, topic, CASE WHEN topic = 5 AND NOT EXISTS (SELECT 1 FROM scores s WHERE s.notice_id = x.notice_id AND s.topic = 5) THEN 99 ELSE 0 END AS l2 FROM (SELECT notice_id, topic FROM scores WHERE topic <> 6 UNION SELECT id, 5 FROM notices WHERE stage = 'P') x")
def snk_18(t: Frames) -> DataFrame:
    there = t.scores.select("notice_id", "topic").distinct()
    wanted = t.notices.where("stage = 'P'").select(F.col("id").alias("notice_id"), F.lit(5).cast("long").alias("topic"))
    added = upkeep.new_rows(wanted, there, ["notice_id", "topic"], ["topic"]).withColumn("l2", F.lit(99))
    return there.where("topic <> 6").withColumn("l2", F.lit(0)).unionByName(added)


@query("SNK_20_triage", "SELECT event_id, CASE WHEN event_type = 'like' AND value < 10 THEN 'needs categories' WHEN event_type = 'unlike' AND notice_id % 2 = 0 THEN 'needs a reason' ELSE 'taken' END AS outcome FROM evs")
def snk_20(t: Frames) -> DataFrame:
    kind = F.col("event_type")
    outcome = F.when((kind == "like") & (F.col("value") < 10), "needs categories").when((kind == "unlike") & (F.col("notice_id") % 2 == 0), "needs a reason").otherwise("taken")
    return t.events.select("event_id", outcome.alias("outcome"))


@query("SRT_08_code_point_order", "SELECT category, row_number() OVER (ORDER BY category)::INTEGER AS place FROM (SELECT DISTINCT category FROM orgs WHERE category IS NOT NULL)")
def srt_08(t: Frames) -> DataFrame:
    found = t.orgs.where("category is not null").agg(F.array_sort(F.collect_set("category")).alias("c"))
    return found.select(F.posexplode("c").alias("pos", "category")).select("category", (F.col("pos") + 1).alias("place"))


@query("Q_15_ingest_pass", MAP_SQL + """, taken AS (SELECT *, row_number() OVER (PARTITION BY title, date_trunc('month', open_dt) ORDER BY o_orderkey) AS n FROM m
        WHERE title IS NOT NULL AND url IS NOT NULL AND status IN ('O', 'F') AND NOT coalesce(open_dt < TIMESTAMP '1995-01-01', false) AND NOT coalesce(close_dt < TIMESTAMP '1997-06-01', false))
    SELECT o_orderkey, title, url FROM taken WHERE n = 1 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)""", False)
def q_15(t: Frames) -> DataFrame:
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    rows = mapped(t).where(ingest.complete()).withColumn("reason", ingest.reject_reason(F.col("status"), ("O", "F"), F.col("open_dt"), at("1995-01-01"), F.col("close_dt"), at("1997-06-01")))
    rows = rows.where("reason is null").withColumn("month", F.date_trunc("month", F.col("open_dt").cast("timestamp")))
    first = upkeep.new_rows(rows, t.spark.createDataFrame([], "title string, month timestamp"), ["title", "month"], ["o_orderkey"])
    there = t.table("lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return first.join(there, "o_orderkey", "left_anti").select("o_orderkey", "title", "url")
