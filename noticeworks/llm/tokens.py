"""Token counts with a whole-token shortcut.

Before any document is read, every vocabulary string is encoded alone; those that come back as a single
token are proven whole.  A document is split into pre-tokens; a pre-token that is proven whole counts
one, and only the rest goes through the merges (remembered in a bounded cache).

Cases: a null or empty text has 0 tokens; texts of any length are counted whole; repeated rows are
counted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import islice

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.llm import common

#: Pre-tokens remembered beside the whole tokens; a full cache starts again.
CACHE_ENTRIES = 250_000
#: White space as Unicode defines it (Python's own class has U+001C to U+001F as well).
SPACE = r"\t-\r\x20\x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(tokenizer, pattern) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and that the tokenizer encodes alone as exactly that token."""
    alphabet = byte_alphabet()
    strings = []
    for token, number in tokenizer.get_vocab().items():
        try:
            strings.append((bytes(alphabet[c] for c in token).decode(), number))
        except (KeyError, UnicodeDecodeError):
            continue
    encoded = tokenizer.encode_batch_fast([s for s, _ in strings], add_special_tokens=False)
    return frozenset(s for (s, number), e in zip(strings, encoded, strict=True) if e.ids == [number] and pattern.fullmatch(s))


class WholeTokenCounter:
    """Counts the tokens of whole texts for a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(PRE_TOKEN)
        self.whole = whole_tokens(self.tokenizer, self.split)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cost = _Costs(self.whole, self._merge)

    def _merge(self, pre_token: str) -> int:
        return len(self.tokenizer.encode(pre_token, add_special_tokens=False).ids)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts, found = [text], 0
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            found = len(parts) - 1
        for part in parts:
            found += sum(map(self.cost.__getitem__, self.split.findall(part)))
        return found


class _Costs(dict):
    """Tokens of each pre-token: one for whole tokens, merged at first sight for others."""

    def __init__(self, whole: frozenset[str], merge: Callable[[str], int]):
        super().__init__(dict.fromkeys(whole, 1))
        self.merge, self.most = merge, len(whole) + CACHE_ENTRIES

    def __missing__(self, pre_token: str) -> int:
        n = self.merge(pre_token)
        if len(self) >= self.most:
            for old in list(islice(reversed(self), CACHE_ENTRIES)):
                del self[old]
        if len(pre_token) <= 64:
            self[pre_token] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> WholeTokenCounter:
    return WholeTokenCounter(path)


def token_count(text: Column, path: str) -> Column:
    """Column of whole-text token counts under the tokenizer file at path."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        count = counter(path).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    common.small_batches(docs.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    n = token_count(F.col("text"), path)
    return docs.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        n.alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
