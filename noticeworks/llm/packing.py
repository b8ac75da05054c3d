"""Packing of documents into training sequences by first-fit decreasing.

Every document becomes its ids and an end id.  Full sequences are cut off the front of long documents; what
remains is shorter than a sequence and is packed by first-fit decreasing, largest first, each piece into the
first open sequence with room.  A tournament tree over the free room of the sequences finds that one
in logarithmic time.  Pieces are dealt at random into groups of bounded expected size that are packed independently, so no group grows with the input.
The group is a keyed hash of the piece itself and of its place among equal pieces, so it does not depend on how Spark has dealt the rows.

Cases: a null or empty text is the end id alone; ties of length go by doc_id, start and checksum; repeated rows are counted, dealt in small lots and
packed each; very long documents span many sequences; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.llm import common
from noticeworks.llm.tokens import SPACE, byte_alphabet

SEQUENCE = 4096
#: Documents of a packing group, on average.
GROUP_DOCS = 2_000
#: Equal pieces that are dealt together.
REPEATS = 32
#: Words remembered with their ids, some 200 bytes each.
CACHE_ENTRIES = 600_000
#: Fixed value: the pattern that the tokenizer file gives for splitting text, its parts grouped by first letter; and what it comes to in ASCII texts.
WORD = rf"\p{{L}}+|\p{{N}}|'(?:[stmd]|re|ve|ll)|[^{SPACE}\p{{L}}\p{{N}}]+"
ASCII_WORD = r"[a-z]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\t-\r a-z0-9]+"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_length long"


class WordIds:
    """Ids of whole texts, word by word, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merges = self.library.model
        self.special = {t.content: int(i).to_bytes(4, "little") for i, t in self.library.get_added_tokens_decoder().items()}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.letter = {b: c for c, b in byte_alphabet().items()}
        self.words, self.ascii_words = regex.compile(WORD), re.compile(ASCII_WORD)
        self.known = _Known(self._ids)

    def _ids(self, word: str) -> bytes:
        spelled = word if word.isascii() and word.isprintable() else "".join(map(self.letter.__getitem__, word.encode()))
        return b"".join(t.id.to_bytes(4, "little") for t in self.merges.tokenize(spelled))

    def ids(self, text: str) -> bytes:
        if not text.isascii() and newer_letters(text):
            return b"".join(i.to_bytes(4, "little") for i in self.library.encode(text, add_special_tokens=False).ids)
        out = []
        for part in self.marks.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                words = self.ascii_words if part.isascii() else self.words
                out.extend(map(self.known.__getitem__, words.findall(normal(part))))
        return b"".join(out)


class _Known(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        ids = self.make(word)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


#: Letters of the first planes' beginning that this Python knows; texts within them need no further look.
FAMILIAR = frozenset(chr(c) for c in range(0x3000) if unicodedata.category(chr(c)) != "Cn")


def newer_letters(text: str) -> bool:
    """Whether a text has code points that this Python does not know but the library may; the library then reads the text itself."""
    return not FAMILIAR.issuperset(text) and any(unicodedata.category(c) == "Cn" for c in set(text))


def normal(text: str) -> str:
    """Composed and in lower case letter by letter (the end form of a Greek sigma is not looked for)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def first_fit_decreasing(lengths: list[int], room: int = SEQUENCE) -> list[int]:
    """The sequence of each length, given in decreasing order; a tournament tree holds the free room."""
    leaves = 1 << max(0, (len(lengths) - 1).bit_length())
    tree = [room] * (2 * leaves)
    placed = []
    for length in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        placed.append(node - leaves)
        tree[node] -= length
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return placed


def padded(tokens: int, room: int = SEQUENCE) -> int:
    """Length of a sequence: filled to the full length unless its tokens are a power of two already."""
    return tokens if tokens & (tokens - 1) == 0 else room


def pieces(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Pieces of at most a sequence of every document, with the checksum of their ids."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = word_ids(path).ids
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = ids_of(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, SEQUENCE):
                    part = ids[4 * start : 4 * (start + SEQUENCE)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, PIECE_SCHEMA)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 2, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    spark = docs.sparkSession
    common.small_batches(spark)
    groups = max(1, math.ceil(docs.count() / group_docs))

    def packed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.loc[group.index.repeat(group["n"])]
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32", "doc_tokens"], ascending=[False, True, True, True, True], ignore_index=True)
        group["bin"] = first_fit_decreasing(group["length"].tolist())
        in_bin = group.groupby("bin")["length"]
        group["offset"] = in_bin.cumsum() - group["length"]
        group["sequence_tokens"] = in_bin.transform("sum")
        group["sequence_length"] = [padded(n) for n in group["sequence_tokens"].tolist()]
        group["sequence_id"] = (int(key[0]) << 32) + group["bin"]
        return group[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "sequence_length"]]

    dealt = pieces(docs, path or public_tokenizers.path("word_bpe_49k.json"), end_id)
    columns = dealt.columns
    counted = dealt.groupBy(*columns).agg(F.count("*").alias("times"))
    lots = F.explode(F.sequence(F.lit(0), F.expr(f"(times - 1) div {REPEATS}")))
    counted = counted.select(*columns, "times", lots.alias("place")).withColumn("n", F.least(F.lit(REPEATS), F.col("times") - REPEATS * F.col("place")))
    counted = counted.withColumn("lot", F.pmod(F.xxhash64(*columns, "place", F.lit("packing")), F.lit(groups)))
    return counted.select(*columns, "n", "lot").groupBy("lot").applyInPandas(packed, PACKED_SCHEMA)
