"""URL rules by a sort-merge range join.

The labels of a host in reverse order, each closed by a separator, make a key under which a rule's host and all of its subdomains are one
interval.  Rules and URLs are sorted together by that key; a sweep keeps the stack of rules whose interval is open, nested ones on top, and
judges each URL by the longest rule on the stack whose path starts the URL's path.

Ranges are cut by key and a salt, so a hot host spreads over tasks.  A range that begins inside open intervals is given
those rules before it starts: they are the rules of the ancestors of its first host, found by a join with the boundaries.

Cases: a null URL or one without `://` has an empty host and path and fits no rule; a path is empty unless the URL has one, and then no rule
fits, because each rule's path begins with a slash; among equally long rules the one with the longer host wins, then the smaller path and
verdict; very long URLs are read whole; repeated rows are judged each; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm import common

#: Closes the labels of a key; one inside a label is written as two other characters, so that labels stay apart.
SEPARATOR, ESCAPE = "\x01", "\x02"
#: Verdict of a URL that no rule fits.
DEFAULT = "allow"
#: The rules that the query applies: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
JUDGED = "page_id long, host string, path string, rule string, verdict string"


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([*rules], "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    """What stands after the first :// up to a slash, question mark, number sign or the end, with A-Z in lower case."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """The labels of a host in reverse order, each closed by the separator."""
    safe = F.replace(F.replace(host, F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(SEPARATOR), F.lit(ESCAPE + "a"))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(safe, r"\.", -1)), SEPARATOR), F.lit(SEPARATOR)))


def host_in(key: str) -> str:
    """The host of a key."""
    return ".".join(reversed(key.split(SEPARATOR)[:-1])).replace(ESCAPE + "a", SEPARATOR).replace(ESCAPE + "b", ESCAPE)


def ancestors(key: Column) -> Column:
    """Keys of the host itself and of all its parents."""
    labels = F.split(key, SEPARATOR, -1)
    depth = F.size(labels) - 1
    parents = F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), SEPARATOR), F.lit(SEPARATOR)))
    return F.when(depth > 0, parents).otherwise(F.array().cast("array<string>"))


class OpenRules:
    """The stack of rules whose interval is open at the present key; one level per host, nested levels on top."""

    def __init__(self):
        self.levels: list[tuple[str, dict[str, str], list[int]]] = []

    def advance(self, key: str) -> None:
        while self.levels and not key.startswith(self.levels[-1][0]):
            self.levels.pop()

    def open(self, key: str, path: str, verdict: str) -> None:
        if not self.levels or self.levels[-1][0] != key:
            self.levels.append((key, {}, []))
        _, paths, lengths = self.levels[-1]
        paths[path] = min(verdict, paths.get(path, verdict))
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def longest(self, path: str) -> tuple[str, str] | None:
        best = None
        for key, paths, lengths in reversed(self.levels):
            for n in lengths:
                if n <= len(path) and path[:n] in paths:
                    host = host_in(key)
                    rank = (len(host) + n, len(host))
                    if best is None or rank > best[0]:
                        best = (rank, host, path[:n], paths[path[:n]])
                    break
        if best is None:
            return None
        return best[1] + best[2], best[3]


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a range in order: rules open intervals, URLs are judged.  A new range starts with an empty stack."""
    stack, at = OpenRules(), None
    for batch in batches:
        out = []
        for piece, key, is_url, page_id, host, path, verdict in zip(*(batch[c] for c in ("piece", "key", "is_url", "page_id", "host", "path", "verdict")), strict=True):
            if piece != at:
                stack, at = OpenRules(), piece
            stack.advance(key)
            if not is_url:
                stack.open(key, path, verdict)
                continue
            found = stack.longest(path) if key else None
            out.append((page_id, host, path, *(found or (None, DEFAULT))))
        result = pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])
        result["page_id"] = result["page_id"].astype("Int64")
        yield result


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    common.small_batches(pages.sparkSession)
    url = F.col("url")
    points = pages.select(F.lit(True).alias("is_url"), F.col("page_id").cast("long"), host_of(url).alias("host"), path_of(url).alias("path"), F.lit(None).cast("string").alias("verdict"))
    starts = rules.select(F.lit(False).alias("is_url"), F.lit(None).cast("long").alias("page_id"), F.lower("host").alias("host"), "path", "verdict").distinct()
    salt = F.when(F.col("is_url"), F.pmod(F.xxhash64("page_id", "path"), F.lit(1 << 20))).otherwise(F.lit(-1))
    both = points.unionByName(starts).withColumn("key", host_key(F.col("host"))).withColumn("salt", salt)
    ranges = max(1, common.partitions_of(pages.sparkSession))
    cut = common.written(both.repartitionByRange(ranges, "key", "salt").withColumn("piece", F.spark_partition_id()), "ranges")
    first = cut.groupBy("piece").agg(F.min(F.struct("key", "salt")).alias("first"))
    first = first.select("piece", F.explode(ancestors(F.col("first.key"))).alias("key"))
    opened = cut.where(~F.col("is_url")).select("key", "host", "path", "verdict", F.col("piece").alias("home"))
    # Rules that begin in an earlier range and are still open where this one starts.
    carried = first.join(opened, "key").where("home < piece")
    carried = carried.select(F.lit(False).alias("is_url"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict", "key", F.lit(-1).cast("long").alias("salt"), "piece")
    ordered = cut.unionByName(carried).repartition(ranges, "piece").sortWithinPartitions("piece", "key", "is_url", "salt")
    return ordered.select("piece", "key", "is_url", "page_id", "host", "path", "verdict").mapInPandas(sweep, JUDGED)
