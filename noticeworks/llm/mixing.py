"""A mix of sources to target weights, drawn by Efraimidis-Spirakis sampling.

Every document has an exponential key, -ln(u) over its quality weight, u a keyed number of its id and text: in the order of the keys, documents come as if drawn one by
one with chances by weight.  A source's target of words is met by complete epochs first, which take every document, and then by the documents of
smallest keys, whose sizes are summed up to what is left of the target; the last one is taken in part.

Sums run over cells of the keys, coarse ones first, then the cells of that coarse one in which the target ends; only documents of that last cell are put in order,
so no source is sorted in one task.  Rows that are equal in every way are counted there and dealt out again.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share a given multiple of all words.  A source stops at a given multiple of its own
words; the excess goes to the others by weight.  With sources in the order of limit over weight, one is at its limit exactly if the share of those before it is.

Cases: a null or empty text has no words and takes none; a null source is a source of its own; ties of keys go by number, then size; repeated rows are taken each;
a source without words has target 0; very long texts are only counted; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeworks.llm import common

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix over all words, and words of a source in the mix over its own.
SHARE, MOST = 1.5, 2.0
#: Coarse cells to one unit of a key, and fine cells to one coarse one.
COARSE, FINE = 64, 4096
#: Rows that are equal in every way are dealt out in lots of so many.
LOT = 10_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def quality(words: Column) -> Column:
    """0.1 to 1: the share of different pairs among all pairs of neighbouring words, which is low where a text repeats itself, at any length."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n > 1, F.lit(0.1) + F.lit(0.9) * (F.size(F.array_distinct(pairs)).cast("double") / (n - 1))).otherwise(F.lit(1.0))


def exponential_key(weight: Column, seed: str) -> Column:
    """-ln(u) / weight; u is made of the first 52 bits of a digest of seed, number and text."""
    named = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    bits = F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 1) / float(1 << 52)) / weight


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source_key, source, source_size with target; one row per source comes in, so these windows order sources, not documents."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    before = W.orderBy(F.col("limit") / F.col("weight"), "source_key").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    rows = rows.withColumn("words", F.sum("source_size").over(everything) * float(share)).withColumn("all_weight", F.sum("weight").over(everything))
    left, weigh = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("limit", "weight"))
    level = (F.col("words") - left) / (F.col("all_weight") - weigh)
    rows = rows.withColumn("full", level > F.col("limit") / F.col("weight"))
    spent, spent_weight = (F.coalesce(F.sum(F.when(F.col("full"), F.col(c))).over(everything), F.lit(0.0)) for c in ("limit", "weight"))
    share_of = F.col("weight") * ((F.col("words") - spent) / (F.col("all_weight") - spent_weight))
    return rows.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", share_of)))


def _with_sources(rows: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """rows with what is known of their source; sources are broadcast only if their count allows it."""
    return rows.join(F.broadcast(found), "source_key") if n <= common.BROADCAST_ROWS else common.join_hot(rows, found, ["source_key"])


def _last_cell(cells: DataFrame, name: str) -> DataFrame:
    """The cell of every source in which its budget ends; before: words of the cells before it."""
    upto = W.partitionBy("source_key").orderBy(name)
    summed = cells.withColumn("upto", F.sum("words").over(upto)).withColumn("before", F.col("upto") - F.col("words"))
    return summed.where((F.col("before") < F.col("budget")) & (F.col("upto") >= F.col("budget")))


def mix(docs: DataFrame, weight: Column | None = None, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix ") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, quality of every document.  weight: a quality weight over 0, by default that of quality()."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "source", "text", *([] if weight is None else [weight.cast("double").alias("quality")]))
    rows = rows.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    # Counted and weighed in one place, so that a text is split once.
    both = F.transform(F.array(words_of(F.col("text"))), lambda w: F.struct(F.size(w).cast("long").alias("size"), quality(w).alias("quality")))[0]
    rows = rows.withColumn("_w", both).withColumn("size", F.col("_w.size"))
    rows = rows if weight is not None else rows.withColumn("quality", F.col("_w.quality"))
    rows = rows.withColumn("key", exponential_key(F.col("quality"), seed)).withColumn("fine", F.floor(F.least("key", F.lit(float(1 << 40))) * (COARSE * FINE)).cast("long"))
    rows = common.written(rows.select("doc_id", "source", "source_key", "size", "quality", "key", "fine"), "mixing-keys")

    sizes = rows.groupBy("source_key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    found = targets(sizes, weights, share, most).select("source_key", "source_size", "target")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    found = found.withColumn("epochs", epochs)
    found = found.withColumn("budget", F.least("source_size", F.greatest(F.lit(0).cast("long"), F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))))
    found = common.written(found, "mixing-sources")
    n = found.count()

    coarse = F.call_function("div", F.col("fine"), F.lit(FINE).cast("long")).alias("coarse")
    cells = rows.groupBy("source_key", coarse).agg(F.sum("size").alias("words")).join(found.select("source_key", "budget"), "source_key")
    ended = _last_cell(cells, "coarse").select("source_key", F.col("coarse").alias("last_coarse"), F.col("before").alias("coarse_before"), "budget")
    inside = _with_sources(rows, ended, n).where(coarse == F.col("last_coarse"))
    cells = inside.groupBy("source_key", "fine").agg(F.sum("size").alias("words"), F.min("coarse_before").alias("coarse_before"), F.min("budget").alias("budget"))
    cells = cells.withColumn("budget", F.col("budget") - F.col("coarse_before"))
    ended = _last_cell(cells, "fine").select("source_key", F.col("fine").alias("last_fine"), (F.col("budget") - F.col("before")).alias("rest"))
    found = common.written(found.join(ended, "source_key", "left"), "mixing-ends")

    told = _with_sources(rows, found, n)
    whole = F.col("epochs") * F.col("size")
    # Without a last cell there is no budget beyond the epochs.
    sure = told.where(F.col("last_fine").isNull() | (F.col("fine") != F.col("last_fine")))
    sure = sure.withColumn("taken", whole + F.when(F.col("fine") < F.col("last_fine"), F.col("size")).otherwise(F.lit(0).cast("long")))
    out = ["doc_id", "source", "size", "source_size", "target", "taken", "quality"]
    return sure.select(out).unionByName(_ordered(told.where(F.col("fine") == F.col("last_fine")), whole).select(out))


def _ordered(rows: DataFrame, whole: Column) -> DataFrame:
    """Documents of the last cell of their source, taken in the order of their keys until the rest is used up."""
    same = ["source_key", "source", "source_size", "target", "epochs", "rest", "key", "doc_id", "size", "quality"]
    counted = rows.groupBy(*same).agg(F.count("*").alias("n"))
    upto = W.partitionBy("source_key").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    counted = counted.withColumn("left", F.col("rest") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(upto), F.lit(0).cast("long")))
    lots = F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("n") - 1, F.lit(LOT).cast("long")))).alias("lot")
    one = F.explode(F.sequence(F.col("lot") * LOT, F.least("n", (F.col("lot") + 1) * LOT) - 1)).alias("copy")
    each = counted.select(*same, "n", "left", lots).select(*same, "left", one)
    part = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("left") - F.col("copy") * F.col("size")))
    return each.withColumn("taken", whole + part)
