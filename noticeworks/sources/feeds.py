"""A table that others append to, polled as a stream whose offsets are times and whose windows overlap."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Window(InputPartition):
    """From one time up to before another, in microseconds."""

    def __init__(self, begin: int, until: int):
        self.begin, self.until = begin, until


class PolledWindows(DataSource):
    """Streams the window of each poll, one row; its rows are read by `within`, through Spark's own reader and file systems.

    Options: begin and until (microseconds since 1970: where the first poll starts, and the time of this poll) and overlap (seconds: how far each poll reads back, for rows
    that came late).  A poll's window goes from the overlap before the last poll's time up to its own; a poll that is not later than the last one has none.
    Rows come again in the overlap, so the sink must know its keys (`engagement.add_new`)."""

    @classmethod
    def name(cls) -> str:
        return "polled_windows"

    def schema(self) -> str:
        return "begin long, until long"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Polls(self.options)


class _Polls(DataSourceStreamReader):
    def __init__(self, options):
        self.begin, self.until, self.overlap = int(options["begin"]), int(options["until"]), int(options["overlap"]) * 1_000_000

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": self.begin}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": self.until}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        first = max(self.begin, start["until"] - self.overlap)
        return [Window(first, end["until"])] if start["until"] < end["until"] else []

    def read(self, partition: Window) -> Iterator[tuple]:
        yield partition.begin, partition.until


def within(spark: SparkSession, path: str, schema: str, time: str, begin: int, until: int) -> DataFrame:
    """Parquet rows of a window by a time without zone; the window and the fields of the schema reach the scan. Rows without a time are in no window."""
    at = lambda micros: F.lit(str(datetime(1970, 1, 1) + timedelta(microseconds=micros))).cast("timestamp_ntz")
    return spark.read.schema(schema).parquet(path).where((F.col(time) >= at(begin)) & (F.col(time) < at(until)))
