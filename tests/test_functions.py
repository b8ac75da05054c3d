"""Rules on literals: labels, parsing, scores, verdicts."""

import datetime as dt
import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeworks.functions import ingest, labels, scoring
from noticeworks.operators import dedup, interest, keywords, latest, listing, vectors
from noticeworks.operators.listing import NoticeFilter, filtered
from tests.compare import DATA


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def at(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    ("start", "close", "status"),
    [("2000-01-02", "2000-01-03", "upcoming"), ("1999-12-01", "2000-01-01", "closed"), (None, "2000-01-02", "unscheduled"), (None, None, "unscheduled"), ("1999-12-01", None, "in_progress"), ("2000-01-01", "2000-01-02", "in_progress")],
)
def test_life_cycle(spark, start, close, status):
    assert one(spark, labels.bid_status(at(start), at(close), at("2000-01-01"))) == status


def test_labels(spark):
    assert one(spark, labels.org_category(F.lit("OO대학교병원"))) == "보건의료"
    assert one(spark, labels.org_category(F.lit("충청남도 예산군"))) == "지방행정"
    assert one(spark, labels.org_category(F.lit("누리 재단"))) is None
    assert one(spark, labels.work_type(F.lit("시스템 구축 및 유지보수"))) == "유지보수"
    assert one(spark, labels.period_label(F.lit("43개월(당해 9개월)"))) == "3년 7개월"
    assert one(spark, labels.price_label(F.lit(250_000_000))) == "2.5억원"
    assert one(spark, labels.price_label(F.lit(None).cast("double"))) == "미공개"
    assert one(spark, labels.dday_label(at("2000-01-03 16:00:00"), at("2000-01-01"))) == "D-3"


def test_prices_are_rounded_as_in_sql(spark):
    """Ties go to even and the exact binary value decides, also where the shortest decimal looks like a tie."""
    draw = random.Random(4)
    values = [1.25, 1.35, 1.45, 2.75, 1.05, 1.15, 9.95, 1.0, 99.95, *(k / 20 for k in range(21, 400, 2)), *(draw.uniform(1, 1000) for _ in range(200))]
    values += [math.nextafter(v, side) for v in values[:50] for side in (1, 1000)]
    prices = [v * 1e8 for v in values] + [5_000.0, 15_000.0, 25_000.0, 24_999.999, 0.0]
    frame = spark.createDataFrame([(v,) for v in prices], "v double")
    sql = "SELECT CASE WHEN v / 100000000 >= 1 THEN printf('%.1f', v / 100000000) || '억원' ELSE printf('%.0f', v / 10000) || '만원' END FROM (SELECT unnest(?::DOUBLE[]) AS v)"
    assert [r[0] for r in frame.select(labels.price_label(F.col("v"))).collect()] == [r[0] for r in duckdb.execute(sql, [prices]).fetchall()]
    assert one(spark, labels.tenths(F.lit(1.05))) == "1.1" and one(spark, labels.tenths(F.lit(1.25))) == "1.2"


def test_parsing(spark):
    assert one(spark, ingest.parse_price(F.lit("512,000,000.9 "))) == 512_000_000
    assert one(spark, ingest.parse_price(F.lit("none"))) is None
    assert one(spark, ingest.parse_date(F.lit("9999.12.31"), "%Y.%m.%d")) is None
    assert one(spark, ingest.parse_date(F.lit(20260903), "%Y%m%d")) == dt.datetime(2026, 9, 3)
    with pytest.raises(ValueError, match="manager_tel"):
        ingest.validate([("manager_tel", "$.x", None)])
    with pytest.raises(ValueError, match="full_text"):
        ingest.validate([("full_text", "$.x", None)], "B")
    ingest.validate([("full_text", "$.x", None)])


def test_two_full_topics_make_58_and_weak_ones_6(spark):
    assert round(one(spark, scoring.noisy_or(F.array(F.lit(0.4), F.lit(0.3))) * 100)) == 58
    assert one(spark, scoring.whole(40 * scoring.strength(F.lit(12)))) == 40
    assert one(spark, scoring.whole(30 * scoring.strength(F.lit(2)))) == 6


def test_combiners(spark):
    none = F.lit(None).cast("double")
    assert one(spark, scoring.combine_noisy_or({"a": F.lit(0.5), "b": none})) == 50
    assert one(spark, scoring.combine_noisy_or({"a": none, "b": F.lit(-0.6)})) == 0
    assert one(spark, scoring.combine_noisy_or({"a": F.lit(0.5), "b": F.lit(-0.6)})) == 20
    assert one(spark, scoring.combine_average({"a": F.lit(1.0), "b": F.lit(-0.6)})) == 20
    assert one(spark, scoring.combine_average({"a": none})) == 0


@pytest.mark.parametrize(
    ("value", "op", "product", "unit", "product_unit", "verdict"),
    [("10", "gte", "12", None, None, "ok"), ("10", "gte", "1,0", "kg", "g", "unknown"), ("about 10", "lte", "9", None, None, "unknown"), ("1,000", "eq", "1000", None, None, "ok"), ("Blue", "contains", "dark blue", None, None, "ok"), ("10", "manual", "10", None, None, "unknown"), ("10", "eq", None, None, None, "unknown"), ("10", "near", "10", None, None, "unknown")],
)
def test_requirements(spark, value, op, product, unit, product_unit, verdict):
    s = lambda x: F.lit(x).cast("string")
    assert one(spark, scoring.requirement_verdict(s(value), s(op), s(product), s(unit), s(product_unit))) == verdict


def test_null_and_empty_requirements_differ(spark):
    empty, null = F.array().cast("array<string>"), F.lit(None).cast("array<string>")
    own = F.array(F.lit("A"))
    assert one(spark, scoring.codes_verdict(null, own)) == "unknown"
    assert one(spark, scoring.codes_verdict(empty, own)) == "ok"
    assert one(spark, scoring.codes_verdict(F.array(F.lit("B")), own)) == "no"
    assert one(spark, scoring.codes_verdict(F.array(F.lit("B")), empty)) == "unknown"
    assert one(spark, scoring.certificates_verdict(F.array(F.lit("ISO 9001")), F.array(F.lit("iso")))) == "ok"
    assert one(spark, scoring.overall(F.lit("ok"), F.lit("unknown"), F.lit("no"))) == "no"


def test_not_in_follows_sql(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    some, none, nothing = (spark.createDataFrame(x, "k long") for x in ([(2,)], [(2,), (None,)], []))
    assert [r.id for r in latest.not_in(left, "id", some, "k").collect()] == [1]
    assert latest.not_in(left, "id", none, "k").count() == 0
    assert latest.not_in(left, "id", nothing, "k").count() == 3


def test_events_chain_is_judged_by_the_last_accepted_one(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 0, 0, s), k) for k, s in enumerate((0, 4, 8, 9))]
    events = spark.createDataFrame(rows, "customer_id long, ts timestamp_ntz, event_id long")
    kept = dedup.accepted_events(events, ["customer_id"], 5)
    assert sorted(r.event_id for r in kept.collect()) == [0, 2]


def test_events_of_a_large_key_are_walked_without_one_group(spark):
    import random

    draw = random.Random(1)
    rows = [(draw.choice((1, 1, None, 2)), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=draw.randrange(4000)), k, draw.choice(("view", "click"))) for k in range(900)]
    events = spark.createDataFrame(rows, "customer_id long, ts timestamp_ntz, event_id long, event_type string")

    def plain(chosen, seconds):
        last, out = {}, set()
        for c, ts, k, _ in sorted(chosen, key=lambda r: (r[1], r[2])):
            if c not in last or (ts - last[c]).total_seconds() > seconds:
                last[c] = ts
                out.add(k)
        return out

    found = dedup.accepted_events(events, ["customer_id"], 5)
    assert {r.event_id for r in found.collect()} == plain(rows, 5)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    by_type = {r.event_id for r in dedup.accepted_by_type(events, ["customer_id"]).collect()}
    assert by_type == plain([r for r in rows if r[3] == "view"], 300) | plain([r for r in rows if r[3] == "click"], 5)


def test_overlapping_terms_are_counted_once(spark):
    assert one(spark, keywords.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2


def test_quota_pick_fills_sections_in_order_of_score(spark):
    rows = spark.createDataFrame([(1, i, 90 - i, "prenotice" if i < 12 else "active", None) for i in range(40)], "customer int, id long, score int, section string, close_dt timestamp_ntz")
    picked = interest.top_matches(rows, limit=25).collect()
    assert sum(r.section == "prenotice" for r in picked) == 10
    assert len(picked) == 25


def test_superseded_rows_are_not_listed(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, 1, "b")], "id long, superseded_by long, title string").withColumn("open_dt", at("1999-01-01")).withColumn("close_dt", at(None))
    assert [r.id for r in filtered(rows, NoticeFilter(), at("2000-01-01")).collect()] == [1]


def test_masks_of_whole_subtrees(spark):
    bodies = {
        '{"manager":{"name":"Kim","no":"010-1"},"telNo":["010-2"],"a":[{"b":{"email":{"x":"k@x.kr"}}}]}': '{"manager":"M","telNo":"M","a":[{"b":{"email":"M"}}]}',
        '{"note":"a \\"telNo\\": 5, {\\"email\\":1}","orgNm":{"mbr":1}}': '{"note":"a \\"telNo\\": 5, {\\"email\\":1}","orgNm":{"mbr":"M"}}',
        '{"\\u0074elNo":"010"}': '{"telNo":"M"}',
        '[{"celNo":null},[[{"deptNm":"d","OFCLnm":false}]]]': '[{"celNo":"M"},[[{"deptNm":"d","OFCLnm":"M"}]]]',
        '{"x": 1.50, "y" : "kept as written"}': '{"x": 1.50, "y" : "kept as written"}',
        '"a text with telNo"': '"a text with telNo"',
        '{"telNo": broken': '"M"',
        "[" * 100_000 + '{"email":1}' + "]" * 100_000: '"M"',
        "": "",
    }
    rows = spark.createDataFrame([(k, b) for k, b in enumerate([*bodies, None])], "k int, b string").select("k", ingest.masked_json(F.col("b")).alias("m")).collect()
    wanted = [v.replace('"M"', f'"{ingest.MASK}"') for v in bodies.values()] + [None]
    assert {r.k: r.m for r in rows} == dict(enumerate(wanted))


def test_keyword_automaton_finds_what_a_plain_search_finds(spark, monkeypatch):
    draw = random.Random(4)
    terms = sorted({"".join(draw.choice("abAB ") for _ in range(draw.randrange(1, 5))) for _ in range(60)} | {"aa", "AAA", "한글", "İx"})
    rules = [(k, k % 7, t, draw.choice((-5, 1, 2, 4))) for k, t in enumerate(terms)] + [(900, 1, "", 4), (901, 2, terms[0], 3)]
    docs = [(k, *("".join(draw.choice("abAB 한글İx") for _ in range(draw.randrange(n))) for n in (12, 60))) for k in range(80)] + [(80, None, None), (81, "", "aaaaa")]
    frames = spark.createDataFrame(docs, "id long, title string, text string"), spark.createDataFrame(rules, "rule_id int, topic int, term string, weight int")
    wanted = {}
    for k, title, text in docs:
        for rule, topic, term, weight in rules:
            in_title, in_text = ((x or "").lower().count(term.lower()) if term else 0 for x in (title, text))
            if in_title + in_text:
                score, hits = wanted.setdefault((k, topic), (0, []))
                wanted[k, topic] = score + weight * (5 * in_title + in_text), [*hits, f"{term}×{in_title + in_text}"]
    wanted = {(k, t, s, ",".join(h)) for (k, t), (s, h) in wanted.items()}
    automaton = {(r.id, r.topic, r.score, r.terms) for r in keywords.frequency_scores(*frames).collect()}
    assert automaton == wanted
    monkeypatch.setattr(keywords, "MOST_RULES", 3)  # beyond it, rules are joined
    assert {(r.id, r.topic, r.score, r.terms) for r in keywords.frequency_scores(*frames).collect()} == wanted
    assert keywords.frequency_scores(frames[0], frames[1].limit(0)).count() == 0


def test_many_keyword_rules(spark):
    rules = spark.range(100_000).select(F.col("id").cast("int").alias("rule_id"), F.lit(1).alias("topic"), F.concat(F.lit("word"), "id", F.lit(";")).alias("term"), F.lit(2).alias("weight"))
    docs = spark.range(2_000).select("id", F.concat(F.lit("Word"), F.col("id") * 49, F.lit("; word1; WORD")).alias("title"))
    found = {r.id: r.terms for r in keywords.presence_scores(docs, rules).collect()}
    assert len(found) == 2_000 and found[3] == "word1;,word147;"


def test_neighbours_cross_the_borders_of_ranges(spark):
    draw = random.Random(5)
    rows = [(k, draw.choice((None, 1.0, 2.0, draw.random()))) for k in draw.sample(range(5_000), 400)]
    frame = spark.createDataFrame(rows, "id long, est_price double").repartition(7)
    order = [k for k, p in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    found = {r.id: (r.prev_id, r.next_id) for r in listing.neighbours(frame, "est_price").collect()}
    assert found == {k: (order[n - 1] if n else None, order[n + 1] if n + 1 < len(order) else None) for n, k in enumerate(order)}
    assert listing.neighbours(frame.limit(1), "est_price").collect()[0][1:] == (None, None)
    assert listing.neighbours(frame.limit(0), "est_price").count() == 0


def test_nearest_vectors(spark, monkeypatch):
    """Both modes against numpy, with blocks smaller than cells; nulls, zeros and equal vectors; recall of the index alone."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 100)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 7)
    draw = np.random.default_rng(6)
    heart = draw.normal(size=(12, 16))
    data = np.round(heart[draw.integers(0, 12, 1500)] + 0.35 * draw.normal(size=(1500, 16)), 6)
    data[40:60] = data[40]
    rows = [(k, v.tolist()) for k, v in enumerate(data)] + [(9001, None), (9002, [0.0] * 16)]
    frame = spark.createDataFrame(rows, "id long, vector array<float>")
    asked = frame.where("id % 50 = 0 or id > 9000").withColumnRenamed("id", "query_id")
    unit = data.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    wanted = {}
    for q in range(0, 1500, 50):
        similar = np.round((1 + unit @ unit[q]) / 2, vectors.DECIMALS)
        wanted[q] = sorted(range(1500), key=lambda k: (-similar[k], k))[:20]  # noqa: B023
    lists = lambda found: {q: [r.id for r in sorted(g, key=lambda r: r.place)] for q, g in itertools.groupby(sorted(found.collect(), key=lambda r: r.query_id), lambda r: r.query_id)}
    assert lists(vectors.nearest_exact(frame, asked)) == wanted
    index = vectors.indexed(frame)
    assert index.rows.count() == 1500 and len(index.centres) == 38
    assert lists(vectors.nearest(index, asked, probes=1, complete=True)) == wanted
    some = lists(vectors.nearest(index, asked))
    assert sum(len(set(some[q]) & set(wanted[q])) for q in wanted) >= 0.9 * 20 * len(wanted)
    few = vectors.indexed(frame.where("id < 5"))
    assert {q: len(ids) for q, ids in lists(vectors.nearest(few, asked.where("query_id < 100"), probes=1, complete=True)).items()} == {0: 5, 50: 5}
    assert vectors.nearest(vectors.indexed(frame.where("id > 9000")), asked).count() == 0


def test_recall_of_the_vector_index(spark):
    """Every vector whose number is divisible by 100 against all of the test table, by the index alone; these vectors point anywhere, so it takes most cells."""
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    pairs = lambda found: {(r.query_id, r.id) for r in found.collect()}
    exact = pairs(vectors.nearest_exact(rows, asked))
    assert len(pairs(vectors.nearest(vectors.indexed(rows), asked, probes=18)) & exact) >= 0.9 * len(exact)
