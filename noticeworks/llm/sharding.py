"""Shards by a Feistel permutation of global row numbers.

Rows get a global number 0 to N-1 that depends on the rows alone (their order under a keyed hash), never on how Spark has
dealt them.  A keyed Feistel network permutes a grid a x b of at least N cells (a is the root of N, rounded up); numbers that leave
0 to N-1 walk on along their cycle until they are back (it visits each of the fewer than a spare cells once at most).  Position p then gives shard p mod S and slot p div S.

The law that holds is `rows`: shard sizes differ by one at most, slots are gapless from 0.

Cases: a null text has size 1 and checksum 0; very long texts are only measured, never moved; rows that are equal in every way are interchangeable and get numbers of their own;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeworks.llm import common

ROUNDS = 4
#: Steps of a walk that are tried before the rest of its bound.
FEW_STEPS = 16
#: Buckets of the keyed hash; their row counts are the only thing that is ordered in one place.
BUCKETS = 4096


def feistel(position: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network over the grid of a x b cells: a bijection on 0 to a*b-1."""
    left, right = F.call_function("div", position, F.lit(b).cast("long")), F.pmod(position, F.lit(b).cast("long"))
    cell = F.struct(left.alias("l"), right.alias("r"))
    for k in range(ROUNDS):
        cell = _round(cell, a, b, seed, k)
    return cell["l"] * F.lit(b).cast("long") + cell["r"]


def _round(cell: Column, a: int, b: int, seed: int, k: int) -> Column:
    """Adds a keyed hash of one half to the other, on either side in turn.  A one-element transform keeps the cell from being written out twice."""

    def turn(c: Column) -> Column:
        left = F.pmod(c["l"] + F.pmod(F.xxhash64(c["r"], F.lit(seed), F.lit(2 * k)), F.lit(a).cast("long")), F.lit(a).cast("long"))
        right = F.pmod(c["r"] + F.pmod(F.xxhash64(left, F.lit(seed), F.lit(2 * k + 1)), F.lit(b).cast("long")), F.lit(b).cast("long"))
        return F.struct(left.alias("l"), right.alias("r"))

    return F.element_at(F.transform(F.array(cell), turn), 1)


def permuted(number: Column, n: int, seed: int) -> Column:
    """Position of a global row number under the keyed permutation of 0 to n-1."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))
    # A walk visits each of the a*b-n spare cells once at most.  Few are on their way after some steps; those go to the end of the bound.
    spare = a * b - n
    found = feistel(number, a, b, seed)
    for steps in (min(spare, FEW_STEPS), spare - FEW_STEPS):
        if steps > 0:
            walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), found, lambda p, _: F.when(p < n, p).otherwise(feistel(p, a, b, seed)))
            found = F.when(found < n, found).otherwise(walked)
    return found


def numbered(rows: DataFrame, keys: list[str], seed: int, name: str) -> tuple[DataFrame, int]:
    """rows with a global number 0 to N-1 in the order of a keyed hash of keys; and N."""
    hashed = rows.withColumn("_h", F.xxhash64(*keys, F.lit(seed))).withColumn("_bucket", F.shiftrightunsigned("_h", 52).cast("int"))
    kept = common.written(hashed, "numbered")
    counts = kept.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # At most BUCKETS rows: a fixed bound, whatever the input.
    before = counts.withColumn("_before", F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = W.partitionBy("_bucket").orderBy("_h", *keys)
    out = kept.withColumn("_in", F.row_number().over(inside)).join(F.broadcast(before), "_bucket")
    return out.withColumn(name, F.col("_before") + F.col("_in") - 1).drop("_h", "_bucket", "_in", "_before"), kept.count()


def shard(docs: DataFrame, shards: int = 16, seed: int = 20240229) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    ranked, n = numbered(rows, ["doc_id", "text_crc32", "size"], seed, "number")
    placed = ranked.withColumn("position", permuted(F.col("number"), n, seed))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        F.call_function("div", F.col("position"), F.lit(shards).cast("long")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
