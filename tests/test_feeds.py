"""Polled feeds: windows that overlap, late rows, repeats and a budget."""

from noticeworks.sources.feeds import PolledWindows, within
from noticeworks.streaming import engagement

SCHEMA = "id long, ts timestamp_ntz"
HOUR = 3_600_000_000


def test_polls_add_late_rows_once(spark, tmp_path):
    path, table = str(tmp_path / "feed"), str(tmp_path / "table")

    def arrive(*rows):
        micros = ", ".join(f"({n}, {'null' if at is None else f'timestamp_micros({at})'})" for n, at in rows)
        spark.sql(f"SELECT CAST(n AS long) AS id, CAST(at AS timestamp_ntz) AS ts, 'x' AS more FROM VALUES {micros} AS v(n, at)").write.mode("append").parquet(path)

    def poll(*times, budget=60.0):
        return engagement.poll(spark, f"file://{path}", SCHEMA, table, ["id"], str(tmp_path / "state"), [t * HOUR for t in times], HOUR, budget=budget)

    def there():
        return sorted((r.id, r.polled // HOUR) for r in spark.read.parquet(table).collect())

    arrive((1, HOUR), (2, 3 * HOUR - 1), (3, 3 * HOUR), (4, None), (5, HOUR - 1))
    assert poll(3, 9, budget=0) == [3 * HOUR, 9 * HOUR]
    assert poll(3) == []
    # Times before the start, of later windows and null are left out.
    assert there() == [(1, 3), (2, 3)]
    arrive((6, 2 * HOUR), (7, 2 * HOUR - 1), (2, 3 * HOUR - 1))
    assert poll(4, 4) == []
    # Late by up to the overlap is found, later than that is not, and repeats add nothing.
    assert there() == [(1, 3), (2, 3), (3, 4), (6, 4)]


def test_windows_of_a_poll():
    feed = PolledWindows({"begin": "0", "until": "10000000", "overlap": "2"}).streamReader(None)
    spans = lambda a, b: [(w.begin // 1_000_000, w.until // 1_000_000) for w in feed.partitions({"until": a * 1_000_000}, {"until": b * 1_000_000})]
    assert feed.initialOffset() == {"until": 0} and feed.latestOffset() == {"until": 10_000_000}
    assert spans(0, 7) == [(0, 7)] and spans(7, 10) == [(5, 10)] and spans(1, 2) == [(0, 2)]
    assert spans(10, 10) == [] and spans(10, 9) == []
    (only,) = feed.partitions({"until": 0}, {"until": 7})
    assert list(feed.read(only)) == [(0, 7)]


def test_window_and_fields_reach_the_scan(spark):
    plan = within(spark, "/root/testdata/sf0.001/events.parquet", "event_id long, ts timestamp_ntz", "ts", 1_704_067_200_000_000, 1_704_153_600_000_001)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-01T00:00)" in plan and "LessThan(ts,2024-01-02T00:00:00.000001)" in plan and "props" not in plan
