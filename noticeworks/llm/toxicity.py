"""Toxicity by a weighted grammar of finite-state transducers.

A word transducer turns the words of a clause into symbols: insult and threat words, targets (you, they, ...), negations and reporting
verbs.  Small transducers are composed behind it.  One composed machine reads a clause from its start and marks what follows a negation, what stands behind a
reporting verb and what is aimed at a target before it; another reads what the first put out from the clause's end and marks what a reporting verb or a target
follows.  A clause scores the sum of the weights of its matches, each under the factor of its pattern (insult or threat, with its marks), and a document
1 - exp(-sum over its clauses).

Both the words and the factors are learnt from labelled documents.  The machines read every word of them as a possible match.  A word is an insult if its occurrences
that are neither negated nor reported stand in several different contexts of toxic documents and hardly ever in clean ones; it is a threat if that holds
for those aimed at a target only.  So a word that clean documents deny or quote is learnt all the same.  The factor of a pattern is the share of toxic documents among
matches with that pattern, drawn towards a prior for patterns that are rare.  Contexts rather than documents are counted, so copies of a document teach no more than one.
The labelled sample is bounded by TOXIC_ROWS and CLEAN_ROWS, and what is learnt by the words of that sample.

Cases: null or empty texts score 0; without labels only the fixed threats count; several labels of a document count as their largest; repeated rows are
scored each; very long texts are read whole; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.llm import common

#: Bounds of the labelled sample.
TOXIC_ROWS, CLEAN_ROWS = 20_000, 20_000
#: A word learnt stands in at least so many contexts, and so purely in toxic documents.
LEAST_CONTEXTS, LEAST_PURITY = 4, 0.75
#: Words of at least this weight teach the factors of patterns.
SURE = 0.8
#: Prior factors of the marks, the matches that they count for, the purity of an unmarked match, and the largest factor.
PRIOR, PRIOR_MATCHES, PURE, MOST_FACTOR = {"n": 0.35, "r": 0.4, "t": 1.0}, 10, 0.95, 1.0
#: Weight of the fixed threats, and how far a negation or a target reaches, in words.
THREAT, REACH = 0.6, 4
# Words of the grammar in the languages of the corpus.
THREATS = "kill hurt destroy beat shoot burn stab umbringen töten schlagen tuer frapper matar golpear".split()
TARGETS = "you your he she they them him her his du dich ihr euch sie er tu vous toi il elle ils tú usted vosotros ellos él ella".split()
NEGATIONS = "not never no isn't aren't don't won't nicht nie kein keine pas jamais ne nunca jamás".split()
REPORTS = "said says told called claimed wrote quoted reported sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split()
WORD = re.compile(r"[\w']+")
CLAUSE_END = re.compile(r"[.!?;:\n]")
#: Patterns: a kind of match and the marks n (negated), r (reported), t (aimed at a target).
PATTERNS = [kind + "".join(m for m, on in zip("nrt", marks) if on) for kind in ("insult-", "threat-") for marks in product((False, True), repeat=3)]
FUNCTION = {w: "negation" for w in NEGATIONS} | {w: "report" for w in REPORTS} | {w: "target" for w in TARGETS}
SYMBOLS = (*PATTERNS, "word", "negation", "report", "target")
OCCURRENCE = "toxic int, word string, marks string, context long"
Machine = dict[tuple[str, str], tuple[str, str]]


def marked(pattern: str, mark: str) -> str:
    kind, marks = pattern.split("-")
    return kind + "-" + "".join(m for m in "nrt" if m in marks or m == mark)


def marking(trigger: str, mark: str, reach: int) -> Machine:
    """A transducer that copies symbols and, for `reach` words after a trigger (0: up to the clause's end), marks matches."""
    last = reach or 1
    machine: Machine = {}
    for state in range(last + 1):
        lasts = state if not reach else max(0, state - 1)
        for symbol in SYMBOLS:
            out = marked(symbol, mark) if state and symbol in PATTERNS else symbol
            machine[str(state), symbol] = (str(last if symbol == trigger else lasts), out)
    return machine


def compose(first: Machine, second: Machine) -> Machine:
    """The transducer that feeds what the first puts out to the second."""
    machine: Machine = {}
    states = {s for s, _ in second}
    for (a, symbol), (a_next, middle) in first.items():
        for b in states:
            if (b, middle) in second:
                b_next, out = second[b, middle]
                machine[f"{a}|{b}", symbol] = (f"{a_next}|{b_next}", out)
    return machine


class Grammar:
    """The two composed machines, from the start and from the end of a clause."""

    def __init__(self):
        report, target = marking("report", "r", 0), marking("target", "t", REACH)
        self.forward = compose(compose(marking("negation", "n", REACH), report), target)
        self.backward = compose(marking("report", "r", REACH), target)

    def read(self, symbols: list[str]) -> list[str]:
        """Symbols of a clause with the marks of both readings."""
        state, middle, out = "0|0|0", [], []
        for symbol in symbols:
            state, symbol = self.forward[state, symbol]
            middle.append(symbol)
        state = "0|0"
        for symbol in reversed(middle):
            state, symbol = self.backward[state, symbol]
            out.append(symbol)
        out.reverse()
        return out


@dataclass
class Model:
    """Weighted words and factors of patterns."""

    insults: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, THREAT))
    factors: dict[str, float] = field(default_factory=lambda: {p: prior(p) for p in PATTERNS})


def prior(pattern: str) -> float:
    """The factor of a pattern before anything is learnt; a threat needs someone it is aimed at."""
    kind, marks = pattern.split("-")
    return math.prod(PRIOR[m] for m in marks) * (kind == "insult" or "t" in marks)


class Scorer:
    """Scores whole texts."""

    def __init__(self, model: Model):
        self.weights = model.threats | model.insults
        self.symbols = FUNCTION | dict.fromkeys(model.threats, "threat-") | dict.fromkeys(model.insults, "insult-")
        self.factors, self.grammar = model.factors, Grammar()

    def clause(self, words: list[str]) -> float:
        read = self.grammar.read([self.symbols.get(w, "word") for w in words])
        return sum(self.weights[w] * self.factors[s] for w, s in zip(words, read, strict=True) if w in self.weights)

    def score(self, text: str | None) -> float:
        text = (text or "").lower()
        if self.weights.keys().isdisjoint(WORD.findall(text)):
            return 0.0
        clauses = (WORD.findall(c) for c in CLAUSE_END.split(text))
        return 1 - math.exp(-sum(self.clause(c) for c in clauses if not self.weights.keys().isdisjoint(c)))


def in_fold(doc_id: Column) -> Column:
    """Whether a document is held out: the checksum of its number as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float, float]:
    """A bounded sample (text, toxic) of labelled documents that are not held out, and the shares of toxic and of clean ones that it holds."""
    named = labels.where(F.col("toxic").isNotNull() & ~in_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r.toxic): r.n for r in named.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shares = min(1.0, TOXIC_ROWS / max(1, counts.get(1, 0))), min(1.0, CLEAN_ROWS / max(1, counts.get(0, 0)))
    share = F.when(F.col("toxic") == 1, shares[0]).otherwise(shares[1])
    drawn = named.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < share * 1_000_000)
    n = min(TOXIC_ROWS, counts.get(1, 0)) + min(CLEAN_ROWS, counts.get(0, 0))
    return docs.select("doc_id", "text").join(common.maybe_broadcast(drawn, n), "doc_id").select("text", F.col("toxic").cast("int")), *shares


def _occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every word of labelled texts, read as a possible match, where it first has its marks: the marks and its neighbours' hash."""
    grammar = Grammar()
    for batch in batches:
        rows = []
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            seen = set()
            for clause in CLAUSE_END.split(text.lower()):
                words = WORD.findall(clause)
                read = grammar.read([FUNCTION.get(w, "insult-") for w in words])
                for at, (word, symbol) in enumerate(zip(words, read, strict=True)):
                    marks = symbol.partition("-")[2]
                    if word not in FUNCTION and (word, marks) not in seen:
                        seen.add((word, marks))
                        context = xxhash.xxh64_intdigest(f"{words[at - 1] if at else ''} {words[at + 1] if at + 1 < len(words) else ''}") >> 1
                        rows.append((toxic, word, marks, context))
        yield pd.DataFrame(rows, columns=["toxic", "word", "marks", "context"])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Insults and threats with weights from 0 to 1, and factors of patterns."""
    common.small_batches(docs.sparkSession)
    rows, of_toxic, of_clean = training_rows(docs, labels)
    rows = common.written(rows.where("text is not null"), "toxicity-sample")
    found = common.written(rows.mapInPandas(_occurrences, OCCURRENCE), "occurrences")
    bad = F.col("toxic") == 1
    # First by word, marks and context, then by word: a toxic text counts by its first context alone, so copies of it count once.
    usable = found.where(~F.col("marks").contains("n") & ~F.col("marks").contains("r")).withColumn("aimed", F.col("marks") == "t")
    parts = usable.groupBy("word", "aimed", "context").agg(F.max(bad).alias("in_toxic"), F.count_if(~bad).alias("b"))
    kinds = parts.groupBy("word", "aimed").agg(F.count_if("in_toxic").alias("a"), F.sum("b").alias("b"))
    of = lambda c, aimed: F.coalesce(F.sum(F.when(F.col("aimed") | F.lit(not aimed), F.col(c))), F.lit(0)).alias(f"{c}_{'aimed' if aimed else 'all'}")
    kinds = kinds.groupBy("word").agg(*[of(c, aimed) for c in "ab" for aimed in (False, True)])
    # Shares of all labelled documents, not of the sample; one clean context more stands for those not seen.
    a, b = (lambda k: F.col(f"a_{k}") / of_toxic), (lambda k: (F.col(f"b_{k}") + 1) / of_clean)
    pure = lambda k: F.when(F.col(f"a_{k}") >= LEAST_CONTEXTS, a(k) / (a(k) + b(k)))
    kinds = kinds.select("word", pure("all").alias("insult"), pure("aimed").alias("threat")).where((F.col("insult") >= LEAST_PURITY) | (F.col("threat") >= LEAST_PURITY))
    kinds = common.written(kinds, "learnt-words")
    # Words of the bounded sample that stand in several contexts.  One at the least purity does not make a document toxic; two do.
    learnt = kinds.collect()
    insults = {r.word: 2 * r.insult - 1 for r in learnt if (r.insult or 0) >= LEAST_PURITY}
    threats = dict.fromkeys(THREATS, THREAT) | {r.word: 2 * r.threat - 1 for r in learnt if r.word not in insults}
    threats = {w: x for w, x in threats.items() if w not in insults}
    sure = [(w, kind) for kind, group in (("insult-", insults), ("threat-", threats)) for w, x in group.items() if x >= SURE or w in THREATS]
    table = docs.sparkSession.createDataFrame(sure, "word string, kind string")
    matched = found.join(common.maybe_broadcast(table, len(sure)), "word")
    matched = matched.groupBy(F.concat("kind", "marks").alias("pattern")).agg(F.count_if(bad).alias("a"), F.count_if(~bad).alias("b"))
    scale = min(of_toxic, of_clean)
    counts = {r.pattern: (r.a * scale / of_toxic, r.b * scale / of_clean) for r in matched.collect()}  # at most 16 patterns
    return Model(insults, threats, {p: factor(p, *counts.get(p, (0, 0))) for p in PATTERNS})


def factor(pattern: str, toxic: float, clean: float) -> float:
    """How much a match of a pattern counts: twice the share of toxic documents over one half, drawn towards the prior."""
    purity = (toxic + PRIOR_MATCHES * (1 + PURE * min(1.0, prior(pattern))) / 2) / (toxic + clean + PRIOR_MATCHES)
    return min(MOST_FACTOR, max(0.0, 2 * purity - 1) / PURE)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    common.small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        scorer = Scorer(model)
        return pd.Series([scorer.score(t) for t in texts], dtype="float64")

    rows = docs.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), scored("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
