"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so the question is containment: which share of an item's shingles a document has.  Items are partitioned by
their number of shingles; the signature of an item is its k smallest shingle hashes, with k chosen per size class as one more than an item of
that size may lack at the threshold.  A document that holds the threshold share of an item therefore holds at least one hash of
the signature: the search loses nothing.  All documents are probed with the hashes of signatures alone; the shingles themselves are
spelled out only for the candidates found, whose containment is then counted exactly.

Words are runs of letters and digits in lower case, shingles have five of them.  An item of fewer words is one shingle of all its words, and documents are probed at
every width that an item has, so a short item is found wherever its words stand in a row.

Cases: null or empty items and items without a word match nothing; a null or empty document has no shingles; rows of the same number (or of none) and
different texts are different documents, each with its own pairs; rows that repeat number and text give their pairs once; very long texts are searched whole;
equal items each give their own pair; empty tables give an empty result; extra columns are ignored by the query and kept by the stage of the pipeline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.llm import common

WIDTH, THRESHOLD = 5, 0.8
#: Items of up to this many shingles form a size class; larger ones the next, and so on.
SIZE_BOUNDS = (1, 4, 8, 16, 32, 64, 128, 512, 4096)


def words(text: Column) -> Column:
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(found, lambda w: w != "")


def over_shingles(w: Column, width: Column | int, make) -> Column:
    """What `make` makes of every shingle of an array of words; fewer words than the width give none."""
    width = F.lit(width) if isinstance(width, int) else width
    starts = F.when(F.size(w) >= width, F.sequence(F.lit(1), F.size(w) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: make(F.slice(w, i, width)))


def hashes(w: Column, width: Column | int) -> Column:
    return over_shingles(w, width, F.xxhash64)


def spelled(w: Column, width: Column | int) -> Column:
    return over_shingles(w, width, lambda s: F.array_join(s, " "))


def at_widths(make, w: Column, widths: list[int]) -> Column:
    return F.flatten(F.array(*(make(w, k) for k in widths))) if len(widths) > 1 else make(w, *widths)


def size_class(n: Column) -> Column:
    """The largest number of shingles in the class of items of n shingles."""
    bound = F.lit(None).cast("int")
    for most in reversed(SIZE_BOUNDS):
        bound = F.when(n <= most, F.lit(most)).otherwise(bound)
    return F.coalesce(bound, n)


def signature_size(n: Column, threshold: float) -> Column:
    """One more than an item of the size class may lack: no document at the threshold misses all of that many hashes."""
    return F.floor(size_class(n) * (1 - threshold) + 1e-9).cast("int") + 1


def item_shingles(benchmark: DataFrame, width: int, threshold: float) -> DataFrame:
    """item_id, width, shingles (distinct), n and signature (the smallest hashes) of every item with a word."""
    items = benchmark.select(F.col("item_id").cast("long"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("width", F.least(F.lit(width), F.size("w")))
    cut = [F.array_distinct(make(F.col("w"), F.col("width"))) for make in (spelled, hashes)]
    items = items.select("item_id", "width", cut[0].alias("shingles"), F.array_sort(cut[1]).alias("hashes"))
    items = items.distinct().withColumn("n", F.size("shingles"))
    signature = F.slice("hashes", F.lit(1), F.least(F.size("hashes"), signature_size(F.col("n"), threshold)))
    return items.select("item_id", "width", "shingles", "n", signature.alias("signature"))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment of every pair at the threshold or above."""
    items = common.written(item_shingles(benchmark, width, threshold), "items")
    signed = common.written(items.select("item_id", F.explode("signature").alias("h")), "signatures")
    wanted = common.written(items.select("item_id", "n", F.explode("shingles").alias("shingle")), "item-shingles")
    n_wanted = wanted.count()
    # At most `width` of them.
    widths = sorted(r.width for r in items.select("width").distinct().collect()) or [width]
    number, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    rows = docs.select(number.alias("doc_id"), text.alias("text"), F.sha2(F.concat_ws("\x01", F.coalesce(number.cast("string"), F.lit("")), text), 256).alias("name"))
    # Words are a column of their own: inside the expression of the shingles they would be split anew for each of them.
    probes = rows.select("name", words(F.col("text")).alias("w")).select("name", F.explode(at_widths(hashes, F.col("w"), widths)).alias("h"))
    candidates = common.written(probes.join(common.maybe_broadcast(signed, n_wanted), "h").select("name", "item_id").distinct(), "candidates")
    named = common.written(candidates.select("name").distinct(), "candidate-rows")
    # Only candidates are spelled out.  Repeated rows have one name, so they fall together with their shingles.
    held = rows.join(common.maybe_broadcast(named, named.count()), "name", "left_semi")
    held = held.select("doc_id", "name", words(F.col("text")).alias("w"))
    pieces = held.select("doc_id", "name", F.explode(F.array_distinct(at_widths(spelled, F.col("w"), widths))).alias("shingle"))
    met = pieces.join(common.maybe_broadcast(wanted, n_wanted), "shingle").distinct()
    shared = met.groupBy("doc_id", "name", "item_id", "n").agg(F.count("*").alias("shared")).where(F.col("shared") >= F.lit(threshold) * F.col("n") - 1e-9)
    verified = shared.join(candidates, ["name", "item_id"], "left_semi")
    return verified.select("doc_id", "item_id", "shared", F.col("n").alias("item_shingles"), (F.col("shared") / F.col("n")).alias("containment"))
