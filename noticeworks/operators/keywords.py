"""Keyword rules against titles and documents.

Terms are compiled to one Aho-Corasick automaton, which goes to every worker once and is walked once over each text, however many rules there are.
Only hits leave the walk, so nothing that is shuffled carries a text.  Rules beyond what one worker may hold meet texts by an equi-join on their first letters."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TITLE_FACTOR, PROMOTE = 5, 2
#: Rules are a list kept by hand; up to so many, and so many letters of their terms, a worker holds them in an automaton (some 100 bytes a letter).
MOST_RULES, MOST_LETTERS = 200_000, 4_000_000
#: Beyond that, a term is looked up by its first letters, at most this many.
ANCHOR = 3
HITS = "array<struct<term:int,times:array<int>>>"
_AUTOMATA: dict[str, ahocorasick.Automaton | None] = {}


def compiled(terms: list[str]) -> ahocorasick.Automaton | None:
    """The automaton of distinct terms in lower case; none of no terms."""
    automaton = ahocorasick.Automaton()
    for n, term in enumerate(terms):
        automaton.add_word(term, (n, len(term)))
    automaton.make_automaton()
    return automaton if terms else None


def walked(automaton: ahocorasick.Automaton, texts: tuple[str | None, ...]) -> list[dict]:
    """Terms that stand in the texts with their times in each, without overlap of a term with itself."""
    found: dict[int, list[int]] = {}
    for place, text in enumerate(texts):
        last: dict[int, int] = {}
        for end, (n, length) in automaton.iter(text or ""):
            if last.get(n, -1) <= end - length:
                last[n] = end
                found.setdefault(n, [0] * len(texts))[place] += 1
    return [{"term": n, "times": times} for n, times in sorted(found.items())]


def hits(terms: Broadcast, *texts: Column) -> Column:
    """Terms of a broadcast list (by place) that stand in the columns, in lower case, with their times in each."""
    name = uuid.uuid4().hex  # a worker keeps the automaton from task to task

    @F.pandas_udf(HITS)
    def walk(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        if name not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[name] = compiled(terms.value)
        automaton = _AUTOMATA[name]
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            yield pd.Series([walked(automaton, row) if automaton else [] for row in zip(*columns, strict=True)])

    return walk(*map(F.lower, texts))


def listed(rules: DataFrame) -> list[str] | None:
    """The distinct terms in lower case, none empty; nothing if they are more than a worker may hold."""
    terms = rules.select(F.lower("term").alias("t")).where("t != ''").distinct()
    found = sorted(r.t for r in terms.limit(MOST_RULES + 1).collect())
    return found if len(found) <= MOST_RULES and sum(map(len, found)) <= MOST_LETTERS else None


def numbered(rules: DataFrame, terms: list[str]) -> DataFrame:
    """rules with the place of their term in the list."""
    places = rules.sparkSession.createDataFrame(list(enumerate(terms)) or [(0, "")], "_place int, _low string")
    return rules.withColumn("_low", F.lower("term")).join(F.broadcast(places), "_low").drop("_low")


def times_met(rows: DataFrame, rules: DataFrame, texts: list[str]) -> DataFrame:
    """id, every rule with a term in one of the texts, letter case aside, and `times`, an array by text.  One row comes out for each id and rule met."""
    terms = listed(rules)
    if terms is None:
        return _times_by_anchor(rows, rules, texts)
    found = rows.select("id", F.explode(hits(rows.sparkSession.sparkContext.broadcast(terms), *map(F.col, texts))).alias("_hit"))
    found = found.select("id", F.col("_hit.term").alias("_place"), F.col("_hit.times").alias("times"))
    # At most MOST_RULES rules, or as many more as share a term.
    return found.join(numbered(rules, terms), "_place").drop("_place")


def occurrences(text: Column, term: Column) -> Column:
    """Times a term stands in a text without overlap."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.greatest(F.length(term), F.lit(1))).cast("int")


def anchors(text: Column, sizes: list[int]) -> Column:
    """The distinct runs of letters of a text in the sizes given."""

    def runs(n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))

    return F.array_distinct(F.concat(*map(runs, sizes))) if sizes else F.array().cast("array<string>")


def _times_by_anchor(rows: DataFrame, rules: DataFrame, texts: list[str]) -> DataFrame:
    """The same by joins: first letters lead to the pairs, whose texts are joined again and counted."""
    rules = rules.withColumn("_term", F.lower("term")).where(F.col("_term") != "").withColumn("_anchor", F.substring("_term", 1, ANCHOR))
    sizes = sorted(r.n for r in rules.select(F.length("_anchor").alias("n")).distinct().collect())  # at most ANCHOR numbers
    low = rows.select("id", *(F.lower(F.coalesce(t, F.lit(""))).alias(f"_{k}") for k, t in enumerate(texts)))
    starts = F.array_distinct(F.concat(*(anchors(F.col(f"_{k}"), sizes) for k in range(len(texts)))))
    met = low.select("id", F.explode(starts).alias("_anchor")).join(rules, "_anchor").join(low, "id")
    times = F.array(*(occurrences(F.col(f"_{k}"), F.col("_term")) for k in range(len(texts))))
    met = met.withColumn("times", times).where(F.exists("times", lambda n: n > 0))
    return met.drop("_term", "_anchor", *(f"_{k}" for k in range(len(texts))))


def containing(rows: DataFrame, rules: DataFrame, text: str) -> DataFrame:
    """id with every rule whose term (not empty) stands in the text, letter case aside."""
    return times_met(rows, rules, [text]).drop("times")


def presence_scores(notices: DataFrame, rules: DataFrame, text: str = "title", least: int = PROMOTE) -> DataFrame:
    """id, topic, score (sum of weights), terms in the order of the rules; scores under the threshold are left out."""
    found = containing(notices, rules, text).groupBy("id", "topic").agg(F.sum("weight").alias("score"), F.array_sort(F.collect_list(F.struct("rule_id", "term"))).alias("hits"))
    return found.where(F.col("score") >= least).select("id", "topic", "score", F.concat_ws(",", F.col("hits.term")).alias("terms"))


def frequency_scores(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """id, topic, score (weight times (5 x times in the title + times in the text)), terms (`term×times` in the order of the rules)."""
    joined = times_met(docs, rules, ["title", "text"])
    in_title, in_text = (F.element_at("times", k).cast("long") for k in (1, 2))
    label = F.concat("term", F.lit("×"), (in_title + in_text).cast("string")).alias("label")
    scored = joined.groupBy("id", "topic").agg(
        F.sum(F.col("weight") * (TITLE_FACTOR * in_title + in_text)).alias("score"),
        F.min("rule_id").alias("first_rule"),
        F.array_sort(F.collect_list(F.struct("rule_id", label))).alias("hits"),
    )
    return scored.select("id", "topic", "score", "first_rule", F.array_join("hits.label", ",").alias("terms"))


def top_topics(scores: DataFrame, n: int = 3) -> DataFrame:
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "first_rule"))
    return scores.withColumn("place", place).where(F.col("place") <= n)


def excluded_name(name: Column, words) -> Column:
    """Whether a file name has one of the words, white space and letter case aside."""
    bare = F.lower(F.regexp_replace(name, r"\s+", ""))
    out = F.lit(False)
    for w in words:
        out |= bare.contains("".join(w.split()).lower())
    return out
