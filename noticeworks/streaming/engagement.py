"""Engagement events as a stream: repeats within a time are dropped, increments are appended."""

from __future__ import annotations

from collections.abc import Iterator
from time import monotonic

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from noticeworks.operators import staging
from noticeworks.sources import feeds


#: How late a row may be.
LATE = "1 hour"


def forget(handle: StatefulProcessorHandle) -> None:
    """Takes back the timers of the current key."""
    for at in list(handle.listTimers()):
        handle.deleteTimer(at)


def milliseconds(at: pd.Timestamp, seconds: int) -> int:
    """The first whole millisecond that is more than so many seconds after a time (of UTC)."""
    return (at.value // 1_000 + 1_000_000 * seconds) // 1_000 + 1


class Accepted(StatefulProcessor):
    """Keeps, per key, the time of the last accepted event; an event within so many seconds of it is dropped.  A timer ends the state with that time."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(rows).sort_values(["ts", "event_id"])
        last = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None
        kept = []
        for at in batch["ts"]:
            fresh = last is None or (at - last).total_seconds() > self.seconds
            kept.append(fresh)
            last = at if fresh else last
        self.last.update((last.to_pydatetime(),))
        forget(self.handle)
        self.handle.registerTimer(milliseconds(last, self.seconds))
        yield batch[kept]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def accepted(events: DataFrame, keys: list[str], seconds: int, late: str = LATE) -> DataFrame:
    """Events of a stream (ts timestamp, event_id) that do not repeat the last accepted one of their keys.

    Rows of a key must come in order of time across batches; those later than the watermark are dropped, and a key's state ends when the watermark has passed its time."""
    schema = events.schema.simpleString()[7:-1].replace(":", " ")
    return events.withWatermark("ts", late).groupBy(*keys).transformWithStateInPandas(Accepted(seconds), schema, "append", "eventTime")


class Jobs(StatefulProcessor):
    """Follows jobs that were started, per key, until an outcome comes or their time is up."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.started = handle, handle.getListState("started", "run_id long, at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(rows).sort_values(["ts", "run_id"])
        held, out = self._held(), []
        for run_id, at, status in zip(batch["run_id"], batch["ts"], batch["status"], strict=True):
            held = self._timed_out(key, held, at, out)
            if status == "running":
                held.append((int(run_id), at))
            else:
                out += [(*key, n, "failed" if status == "fail" else "done", at) for n, _ in held]
                held = []
        self._keep(held)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list[tuple] = []
        # A timer set now would only fire in the next batch, so all whose time the watermark has passed go at once.
        now = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        self._keep(self._timed_out(key, self._held(), now, out))
        yield self._frame(out)

    def _held(self) -> list:
        return [(n, pd.Timestamp(at)) for n, at in self.started.get()] if self.started.exists() else []

    def _timed_out(self, key, held: list, now: pd.Timestamp, out: list) -> list:
        """Those of the held jobs that still have time; the others go to out, as of the end of their time."""
        end = pd.Timedelta(seconds=self.seconds)
        out += [(*key, n, "timed_out", at + end) for n, at in held if now - at > end]
        return [(n, at) for n, at in held if now - at <= end]

    def _keep(self, held: list) -> None:
        forget(self.handle)
        if held:
            self.started.put([(n, at.to_pydatetime()) for n, at in held])
            self.handle.registerTimer(milliseconds(min(at for _, at in held), self.seconds))
        else:
            self.started.clear()

    @staticmethod
    def _frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["source_id", "run_id", "state", "at"]).astype({"at": "datetime64[us]"})

    def close(self) -> None:
        pass


def job_outcomes(runs: DataFrame, seconds: int, late: str = LATE) -> DataFrame:
    """source_id, run_id, state (done, failed or timed_out) and time of every started job of a stream (source_id, run_id, ts, status).

    The next outcome of its source ends a job; without one it times out when the watermark has passed its time, and nothing of it is kept."""
    return runs.withWatermark("ts", late).groupBy("source_id").transformWithStateInPandas(Jobs(seconds), "source_id long, run_id long, state string, at timestamp", "append", "eventTime")


def work_folder(spark: SparkSession) -> str:
    """A new folder for a stream's output and state, removed at the end of the application."""
    return staging.folder(spark, "stream")


def run_available(rows: DataFrame, folder: str, checkpoint: str) -> None:
    """Works off what is there and stops."""
    rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def add_new(rows: DataFrame, table: str, keys: list[str]) -> None:
    """Appends rows whose keys the table lacks, one of each key."""
    spark, fresh = rows.sparkSession, rows.dropDuplicates(keys)
    try:
        there = spark.read.schema(rows.schema).parquet(table).select(*keys)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        there = None
    if there is not None:
        fresh = fresh.join(there, keys, "left_anti").select(*rows.columns)
    fresh.write.mode("append").parquet(table)


def append_new(rows: DataFrame, table: str, keys: list[str], checkpoint: str) -> None:
    """Appends rows of a stream whose keys the table lacks, batch by batch; a batch that is repeated adds nothing."""
    rows.writeStream.foreachBatch(lambda batch, _: add_new(batch, table, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per day and type, closed once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def poll(spark: SparkSession, path: str, schema: str, table: str, keys: list[str], checkpoint: str, polls: list[int], begin: int, time: str = "ts", overlap: int = 3_600, budget: float = 300.0) -> list[int]:
    """Polls a feed at each of the given times (microseconds), one after the other, and appends what is new; gives the times that the budget in seconds left over.

    Each poll goes on where the checkpoint ends, so a left-over time may be asked for later, and one that was done adds nothing.  A poll that has begun is
    finished; `polled` tells which poll brought a row."""
    spark.dataSource.register(feeds.PolledWindows)

    def add(windows: DataFrame, _: int) -> None:
        for w in windows.collect():  # the one window of a poll, or none
            rows = feeds.within(windows.sparkSession, path, schema, time, w.begin, w.until)
            add_new(rows.withColumn("polled", F.lit(w.until)), table, keys)

    began = monotonic()
    for k, until in enumerate(polls):
        if monotonic() - began >= budget:
            return polls[k:]
        options = {"begin": str(begin), "until": str(until), "overlap": str(overlap)}
        windows = spark.readStream.format("polled_windows").options(**options).load()
        windows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return []
