"""Quality rules, with tokeniser fertility against a public vocabulary.

Base counts look at words, symbols, repeated lines and repeated word windows.  Fertility encodes every word with a public piece vocabulary that
falls back to bytes: characters per token, share of byte tokens, and entropy of the tokens over the logarithm of their number.
Bands are centred on the medians of each language, those of entropy also of each length class, which doubles the tokens of the one before, because entropy
depends on length.  Every median is drawn towards that of the next wider set as if PRIOR_DOCS documents stood there: a language towards its script, a script towards the
whole table, a length class towards the level of its language brought to the document's length by the power law of entropy.  So every document is judged by the same rule,
in sparse classes and small tables as well (a lone document is its own median).  A document is rejected outside a band, or if its shortfalls in
characters per token and entropy add up to too much.  Medians hold against any minority of bad rows and are taken over all documents.
The bands are a row per language or script and length class; they are broadcast if their counted rows are few, so a language with most rows is not
gathered in one task.

Cases: a null or empty text has no words and fails the base rules; a null language falls back to the script of the
text; very long texts are measured whole; repeated rows are judged each; an empty table gives an empty result; extra columns are
ignored by the query and kept by the stage of the pipeline.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.llm import common

#: Words with pieces that a worker remembers.
CACHE_ENTRIES = 250_000
#: Symbols that count, and the ASCII white space between words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Bands around the medians, in shares of them, and the largest sum of both shortfalls.
CHARS_PER_TOKEN_LOW, CHARS_PER_TOKEN_HIGH = 0.75, 1.60
ENTROPY_LOW = 0.80
MOST_SHORTFALL = 0.09
#: Share of byte tokens over the median share.
MOST_BYTE_SHARE_OVER = 0.10
#: Documents that the next wider set counts for in a median.
PRIOR_DOCS = 20
#: Entropy falls with this power of the tokens (as the medians of length classes do in tables of 0.1).
FALL = 0.1
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, byte_share double, chars_per_token double, token_entropy double, script string"
#: Letters of four wide groups of scripts.
CJK, CYRILLIC_GREEK, LATIN = re.compile("[\u1100-\u11ff\u3040-\u30ff\u3131-\u318e\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7a3\uf900-\ufaff\U00020000-\U0003ffff]"), re.compile("[\u0370-\u03ff\u0400-\u052f\u1f00-\u1fff]"), re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff]")


class Fertility:
    """Pieces of words under a public vocabulary with byte fallback, remembered in a bounded cache."""

    def __init__(self, path: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.pieces.get_piece_size()
        self.is_byte = np.fromiter((self.pieces.is_byte(i) for i in range(size)), dtype=bool, count=size)
        self.known: dict[bytes, bytes] = {}

    def ids(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the distinct words, and how often each id counts."""
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            if len(known) + len(new) > CACHE_ENTRIES:
                known.clear()
                new = list(words)
            for word, ids in zip(new, self.pieces.encode([w.decode() for w in new], num_threads=1), strict=True):
                known[word] = np.array(ids, dtype=np.uint16).tobytes()
        parts = [known[w] for w in words]
        ids = np.frombuffer(b"".join(parts), dtype=np.uint16)
        return ids, np.repeat(np.fromiter(words.values(), dtype=np.int64, count=len(words)), [len(p) // 2 for p in parts])


@lru_cache(maxsize=2)
def fertility(path: str) -> Fertility:
    return Fertility(path)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three that occur twice or more, first ones included."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = bytearray(len(words))
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered[at : at + 3] = b"\1\1\1"
    return sum(covered)


def measure(text: str, model: Fertility) -> tuple:
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    counts = Counter(words)
    chars = len(text) - sum(map(text.count, SPACES))
    n_tokens, byte_share, per_token, entropy = 0, 0.0, 0.0, 0.0
    if words:
        ids, weights = model.ids(counts)
        seen = np.bincount(ids, weights=weights, minlength=len(model.is_byte))
        n_tokens = int(seen.sum())
        if n_tokens:
            byte_share = float(seen[model.is_byte].sum() / n_tokens)
            per_token = chars / n_tokens
            share = seen[seen > 0] / n_tokens
            entropy = float(-(share * np.log(share)).sum() / math.log(n_tokens)) if n_tokens > 1 else 0.0
    return (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), n_tokens, byte_share, per_token, entropy, script(text))


def script(text: str) -> str:
    """The first script of four wide groups that the text has letters of."""
    if not text.isascii():
        if CJK.search(text):
            return "cjk"
        if CYRILLIC_GREEK.search(text):
            return "cyrillic-greek"
    return "latin" if LATIN.search(text) else "other"


def measured(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with a struct of FEATURES behind theirs."""
    common.small_batches(docs.sparkSession)
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    @F.pandas_udf(FEATURES)
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FEATURES.split(", ")]
        model = fertility(path)
        for batch in texts:
            yield pd.DataFrame([measure(t or "", model) for t in batch], columns=names)

    return docs.withColumn("measures", features(F.col("text")))


def judge(features: DataFrame) -> DataFrame:
    """Adds base_failed and kept to rows with lang, script and measures; bands come from all rows that pass the base rules."""
    m = F.col("measures")
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * m["n_words"])
    rows = features.withColumn("base_failed", failed).withColumn("length_class", F.floor(F.log2(F.greatest(m["n_tokens"], F.lit(1))))).withColumn("every", F.lit(1)).withColumn("script", m["script"])
    usable = rows.where(~F.col("base_failed"))

    length = F.greatest(m["n_tokens"], F.lit(1)).cast("double")
    values = {c: m[c] for c in ("chars_per_token", "byte_share", "token_entropy")} | {"level": m["token_entropy"] * F.pow(length, F.lit(FALL))}

    def bands(keys: list[str], name: str, *features: str) -> DataFrame:
        middle = [F.percentile_approx(values[c], 0.5, 1000).alias(c) for c in features]
        found = usable.groupBy(*keys).agg(F.count("*").alias("n"), *middle)
        found = common.written(found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct("n", *features).alias(name)), name)
        return common.maybe_broadcast(found, found.count())

    for key in ("lang", "script", "every"):
        spread = [([key, "length_class"], f"{key}_spread", ("token_entropy",))] if key != "every" else []
        for keys, name, features in (([key], f"{key}_rate", ("chars_per_token", "byte_share", "level")), *spread):
            same = [F.col(k) == F.col(f"_{k}") for k in keys]
            rows = rows.join(bands(keys, name, *features), same, "left").drop(*[f"_{k}" for k in keys])

    def drawn(name: str, feature: str, wider: Column) -> Column:
        """A median drawn towards that of a wider set; the wider one alone where the set has no document."""
        band = F.col(name)
        return F.coalesce((band["n"] * band[feature] + PRIOR_DOCS * wider) / (band["n"] + PRIOR_DOCS), wider)

    rate = {f: drawn("lang_rate", f, drawn("script_rate", f, F.col("every_rate")[f])) for f in ("chars_per_token", "byte_share", "level")}
    usual = drawn("lang_spread", "token_entropy", drawn("script_spread", "token_entropy", rate["level"] * F.pow(length, F.lit(-FALL))))
    per_token, entropy = m["chars_per_token"] / rate["chars_per_token"], m["token_entropy"] / usual
    inside = per_token.between(CHARS_PER_TOKEN_LOW, CHARS_PER_TOKEN_HIGH) & (entropy >= ENTROPY_LOW)
    inside &= (1 - per_token) + (1 - entropy) <= MOST_SHORTFALL
    inside &= m["byte_share"] <= rate["byte_share"] + MOST_BYTE_SHARE_OVER
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return rows.withColumn("kept", kept).drop("lang_rate", "script_rate", "every_rate", "lang_spread", "script_spread", "length_class", "every", "script")


def rate(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text_hash, lang and the base counts, fertility, base_failed and kept of every document."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    slim = measured(slim, path).select("doc_id", F.xxhash64(text).alias("text_hash"), "lang", "measures")
    rows = judge(common.written(slim, "fertility"))
    return rows.select("doc_id", "text_hash", "lang", "measures.*", "base_failed", "kept")
