"""Writes that touch only what changed, and the pass of collection on odd input."""

from pathlib import Path

from pyspark.sql import functions as F

from noticeworks.functions import ingest
from noticeworks.operators import collection
from noticeworks.operators.buckets import BucketedTable
from noticeworks.sources.fixtures import instant


def made(spark, folder, rows, buckets=4):
    frame = spark.createDataFrame(rows, "key int, owner string, value double")
    return BucketedTable.create(frame, str(folder / "table"), ["key", "owner"], buckets, F.pmod("key", F.lit(buckets)))


def held(table):
    return sorted(((r.key, r.owner, r.value) for r in table.read().collect()), key=str)


def stamps(folder):
    return {p.name: p.stat().st_mtime_ns for p in Path(folder / "table").glob("bucket=*/*.parquet")}


ROWS = [(1, "a", 1.0), (2, "a", None), (3, None, 3.0), (None, "n", 4.0), (5, "b", 5.0)]


def test_only_buckets_with_a_difference_are_written(spark, tmp_path):
    table = made(spark, tmp_path, ROWS)
    before = stamps(tmp_path)
    changes = table.upsert(spark.createDataFrame([(2, "a", None), (3, None, 3.0), (5, "b", 6.0), (9, "c", 7.0)], "key int, owner string, value double"))
    assert sorted((r.key, r.change) for r in changes.collect()) == [(5, "updated"), (9, "inserted")]
    after = stamps(tmp_path)
    kept = {r.file for r in table.files().where("bucket <> 1").collect()}
    assert kept and all(after[f] == before[f] for f in kept)
    assert not set(before) & {r.file for r in table.files().where("bucket = 1").collect()}
    assert held(table) == sorted([(1, "a", 1.0), (2, "a", None), (3, None, 3.0), (None, "n", 4.0), (5, "b", 6.0), (9, "c", 7.0)], key=str)


def test_same_rows_change_no_file(spark, tmp_path):
    table = made(spark, tmp_path, ROWS)
    before = stamps(tmp_path)
    assert table.upsert(table.read().drop("bucket")).count() == 0
    assert stamps(tmp_path) == before


def test_null_keys_are_equal_and_the_greatest_of_repeated_rows_counts(spark, tmp_path):
    table = made(spark, tmp_path, ROWS)
    table.upsert(spark.createDataFrame([(None, "n", 8.0), (None, "n", 9.0), (3, None, None)], "key int, owner string, value double"))
    assert held(table) == sorted([(1, "a", 1.0), (2, "a", None), (3, None, None), (None, "n", 9.0), (5, "b", 5.0)], key=str)


def test_update_takes_no_new_keys(spark, tmp_path):
    table = made(spark, tmp_path, ROWS)
    changes = table.update(spark.createDataFrame([(1, "a", 2.0), (7, "z", 1.0)], "key int, owner string, value double"))
    assert [(r.key, r.change) for r in changes.collect()] == [(1, "updated")]
    assert len(held(table)) == 5


def test_replaced_rows_go_and_an_empty_bucket_is_removed(spark, tmp_path):
    table = made(spark, tmp_path, ROWS)
    changes = table.replace(F.col("value") >= 3, spark.createDataFrame([(3, None, 3.0), (1, "a", 9.0)], "key int, owner string, value double"))
    # Row 1 is outside the condition: it stays and keeps the fresh one out; row 3 is the same.
    assert sorted((r.key or 0, r.change) for r in changes.collect()) == [(0, "deleted"), (5, "deleted")]
    assert held(table) == sorted([(1, "a", 1.0), (2, "a", None), (3, None, 3.0)], key=str)
    table.replace(F.lit(True), spark.createDataFrame([], "key int, owner string, value double"))
    assert held(table) == [] and not stamps(tmp_path)


def test_empty_table_takes_rows(spark, tmp_path):
    table = made(spark, tmp_path, [])
    Path(tmp_path / "table").mkdir(exist_ok=True)
    table.upsert(spark.createDataFrame(ROWS, "key int, owner string, value double"))
    assert held(table) == sorted(ROWS, key=str)


ITEM = "item_no long, title string, org_name string, url string, open_dt timestamp_ntz, close_dt timestamp_ntz, status string"
NOTICE = "id long, url string, title string, org_id long, open_dt timestamp_ntz, close_dt timestamp_ntz, created_at timestamp_ntz"


def passed(spark, items, notices, scores=()):
    frames = spark.createDataFrame([*items], ITEM), spark.createDataFrame([*notices], NOTICE), spark.createDataFrame([(4, "A")], "org_id long, org_name string")
    rules = spark.createDataFrame([(1, 1, "road", 2)], "rule_id int, topic int, term string, weight int")
    return collection.collect(*frames, spark.createDataFrame([*scores], "notice_id long, topic int, score long"), rules, ("open",), instant("2024-01-01"), instant("2024-02-01"))


def test_pass_over_empty_tables(spark):
    done = passed(spark, [], [])
    assert done.counts.first().asDict() == dict.fromkeys(done.counts.columns, 0)
    assert done.notices.count() == done.scores.count() == 0


def test_pass_by_hand(spark):
    import datetime as dt

    day = lambda m, d: dt.datetime(2024, m, d)
    items = [
        (1, "Road  works", "A", "u1", day(1, 5), None, "open"), (2, "Road works", "A", "u1", day(1, 6), None, "open"), (3, "road works", "B", "u2", None, day(3, 1), None),
        (4, None, "A", "u3", None, None, "open"), (5, "x", "A", "u4", None, None, "shut"), (6, "x", "A", "u5", day(1, 1) - dt.timedelta(days=1), None, "open"), (7, "x", "A", "u6", None, day(1, 31), "open"),
        (8, "Bridge", "A", "u7", None, None, "open"),
    ]
    notices = [(10, "u7", "Bridge", 4, None, None, day(1, 1)), (11, "u8", "Road works", 4, day(1, 9), day(5, 1), day(1, 9)), (12, "u9", "Old", 4, None, None, dt.datetime(2023, 1, 1)), (13, "u10", "Shut", 4, None, day(1, 20), day(1, 1))]
    done = passed(spark, items, notices, [(12, 1, 5), (11, 1, 5)])
    assert done.counts.first().asDict() == {"fetched": 8, "skipped": 2, "out_of_window": 1, "already_closed": 1, "inserted": 2, "scored": 3, "groups_with_duplicates": 1, "superseded": 1, "expired": 2}
    found = {r.url: r for r in done.notices.collect()}
    assert set(found) == {"u1", "u2", "u7", "u8"} and found["u1"].superseded_by == 11 and found["u1"].title == "Road  works"
    assert min(found["u1"].id, found["u2"].id) > 13 and found["u1"].id != found["u2"].id
    names = {r.org_name: r.org_id for r in done.orgs.collect()}
    assert set(names) == {"A", "B"} and found["u2"].org_id == names["B"] > 4
    scores = sorted(r.notice_id for r in done.scores.collect())
    assert scores == sorted([11, found["u1"].id, found["u1"].id, found["u2"].id])
    assert ingest.REQUIRED == ("title", "org_name", "url")
