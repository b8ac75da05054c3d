"""A corpus pipeline of five of the training-data operators: quality rules, near-duplicates, benchmark leaks, personal data, packing.

Every stage takes all that its predecessor kept, as written Parquet.  All but the last return the columns of documents.

Cases, for every stage: rows are told apart by number and text, so rows without a number are judged like any other; a null text counts as an empty one, and
the quality rules drop both (a later stage given such a row keeps it, as one group of near-duplicates, without leaks, unchanged by redaction, packed as its end id); a null
language, source or length takes part as it is; very long texts are read whole; of repeated rows the near-duplicate stage keeps one, and ties of
a group go to the smallest number, then the smallest hash of the text; extra columns of any name are left out of the result, which has the columns of documents; empty
tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm import common, decontaminate, packing, pii, quality, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicate stages on word shingles take five words.
SHINGLE, SIMILARITY = 5, 0.8


def texts_of(docs: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """Documents whose number (null counts as one) and text stand, or do not stand, in chosen (chosen_id, chosen_text)."""
    same = F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (simhash.text_hash(F.col("text")) == F.col("chosen_text"))
    return docs.select(COLUMNS).join(chosen, same, how).select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality rules keep."""
    kept = quality.rate(docs).where("kept").select(F.col("doc_id").alias("chosen_id"), F.col("text_hash").alias("chosen_text")).distinct()
    return texts_of(docs, kept, "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near-duplicates: the one with the smallest doc_id, then the smallest hash of its text."""
    rows = common.written(simhash.similar(docs, SHINGLE, SIMILARITY), "components")
    counted = rows.groupBy("component", "doc_id", "node").agg(F.count("*").alias("repeats"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node", "repeats"))
    best = counted.groupBy("component").agg(first.alias("r"))
    chosen = common.written(best.select(F.col("r.doc_id").alias("chosen_id"), F.col("r.node").alias("chosen_text"), "r.repeats"), "representatives")
    once, again = (texts_of(docs, chosen.where(c), "left_semi") for c in ("repeats = 1", "repeats > 1"))
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; equal texts are searched as one."""
    texts = docs.select(simhash.text_hash(F.col("text")).alias("doc_id"), "text")
    found = common.written(decontaminate.leaks(texts, common.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leaking")).distinct(), "leaking")
    leaking = common.maybe_broadcast(found, found.count())
    return docs.select(COLUMNS).join(leaking, simhash.text_hash(F.col("text")) == F.col("leaking"), "left_anti").select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates for personal data; n_chars follows the new text."""
    changed, _ = pii.redact(docs.select(COLUMNS))
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack_sequences),
]

#: SQL cannot express the tokenisers' vocabularies, fingerprints or surrogates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, f"pipeline-{name}")
    return docs
