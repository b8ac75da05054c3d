"""Periodic runs of words, found by dyadic catchers of squares while a text is read.

Every completed block of 2^k words that starts at a multiple of 2^k is a catcher: it waits for its own words to come again q words later, for q from 2^k to
2^(k+1) - 1.  So each appended word advances one comparison per level: the suffix of 2^k words that it completes, against the one block whose turn it is.
Suffixes are compared by hashes of doubled windows.  Two blocks in a row caught at the same distance are a square, which is then read exactly, to both
sides, and merged into the stretch of its period; a stretch of period q and length 4 q holds two such blocks, so no run is missed.  Words are appended in segments,
and a segment advances all its words at once.  Squares inside a known stretch whose period divides theirs are no news and are left out, which keeps the work at n log n.

Cases: a null text has no words; an empty one likewise; very long texts are read whole, segment by segment; repeated rows are read each; an empty table gives an
empty result; extra columns are ignored; a row without a number keeps its null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.llm import common

#: Words appended at once.
SEGMENT = 1 << 16
#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_POWER = 6, 4
#: What a word is, for the query; bytes.split() cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"
RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
#: Odd factors, one per level, for the hashes of windows.
FACTORS = np.random.default_rng(20240229).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Catchers:
    """Runs of a sequence of numbers that grows; runs() gives those of what was appended so far."""

    def __init__(self, least_words: int = LEAST_WORDS, least_power: int = LEAST_POWER):
        if least_power < 4:
            raise ValueError("two blocks in a row are certain only from four periods on")
        self.least_words, self.least_power = least_words, least_power
        self.words, self.n = np.empty(64, dtype=np.int64), 0
        self.windows: list[tuple[int, np.ndarray]] = []  # per level: number of the first window kept, hashes
        self.closed: list[list[int]] = []  # stretches [start, end of the equal words, period]: words x and x + period are equal from start to end
        self.open: list[list[int]] = []  # those that reach the end of the words, or are new
        self.latest: dict[int, list[int]] = {}  # by period

    def append(self, words: np.ndarray) -> None:
        before, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            self.words = np.concatenate((self.words[:before], np.empty(max(self.n, 2 * before) - before, dtype=np.int64)))
        self.words[before : self.n] = words
        for stretch in self.open:
            stretch[1] = self._right(stretch[1], stretch[2])
        for k in range(self.n.bit_length()):
            self._advance(k, 1 << k, words)
        self.closed += [s for s in self.open if s[1] + s[2] < self.n]
        self.open = [s for s in self.open if s[1] + s[2] == self.n]

    def _advance(self, k: int, size: int, words: np.ndarray) -> None:
        """Compares the suffixes of size words that the new words complete with the blocks whose turn it is."""
        if k == len(self.windows):
            self.windows.append((0, np.empty(0, dtype=np.uint64)))
        base, kept = self.windows[k]
        first, last = base + len(kept), self.n - size + 1
        if k == 0:
            new = words.astype(np.uint64) * FACTORS[0]
        else:
            low, halves = self.windows[k - 1]
            new = halves[first - low : last - low] * FACTORS[k] + halves[first - low + size // 2 : last - low + size // 2]
        # Blocks lie within three sizes of a suffix, so older windows can go.
        spare = max(0, len(kept) - 3 * size)
        base += spare
        hashes = np.concatenate((kept[spare:], new)) if len(kept) else new
        self.windows[k] = (base, hashes)
        suffix = np.arange(max(first, 2 * size), last)
        if not len(suffix):
            return
        block = (suffix // size - 1) * size
        caught = np.flatnonzero(hashes[suffix - base] == hashes[block - base])
        if not len(caught):
            return
        suffix, block = suffix[caught], block[caught]
        twice = hashes[suffix - size - base] == hashes[block - size - base]
        suffix, block = suffix[twice], block[twice]
        # Closed stretches end before the new suffixes.
        for start, end, period in [s for s in self.open if s[1] + s[2] - s[0] >= 3 * size]:
            if len(suffix):
                a, b = np.searchsorted(suffix, (start, end + period - size + 1))
                part, at = suffix[a:b], block[a:b]
                known = (at - size >= start) & ((part - at) % period == 0)
                if known.any():
                    fresh = np.ones(len(suffix), dtype=bool)
                    fresh[a:b] = ~known
                    suffix, block = suffix[fresh], block[fresh]
        for start, period in zip((block - size).tolist(), (suffix - block).tolist(), strict=True):
            known = self.latest.get(period)
            if known is None or start >= known[1]:
                self._report(start, period, size)

    def _report(self, start: int, period: int, size: int) -> None:
        """Reads a caught square exactly and keeps the whole stretch of its period."""
        end = self._right(start, period)
        if end - start >= 2 * size:
            self.latest[period] = [self._left(start, period), end, period]
            self.open.append(self.latest[period])

    def _right(self, x: int, period: int) -> int:
        """End of the words from x on that equal those a period later."""
        step = 64
        while (most := min(step, self.n - period - x)) > 0:
            differ = self.words[x : x + most] != self.words[x + period : x + period + most]
            if (at := int(differ.argmax())) or differ[0]:
                return x + at
            x, step = x + most, 2 * step
        return x

    def _left(self, x: int, period: int) -> int:
        """Start of the words before x that equal those a period later."""
        step = 64
        while (most := min(step, x)) > 0:
            differ = (self.words[x - most : x] != self.words[x - most + period : x + period])[::-1]
            if (at := int(differ.argmax())) or differ[0]:
                return x - at
            x, step = x - most, 2 * step
        return x

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period), by start and period.  Of stretches of the same words the smallest period counts."""
        found: dict[tuple[int, int], int] = {}
        for start, end, period in self.closed + self.open:
            length = end + period - start
            if length >= max(self.least_words, self.least_power * period):
                found[start, length] = min(period, found.get((start, length), period))
        return sorted((start, length, period) for (start, length), period in found.items())


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """Runs of a list of words."""
    if len(words) < LEAST_WORDS:
        return []
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return []
    catchers = Catchers()
    for k in range(0, len(ids), SEGMENT):
        catchers.append(ids[k : k + SEGMENT])
    return catchers.runs()


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that repeat a run's first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, all runs by start and period, and the text with every run cut down to its first period."""
    common.small_batches(docs.sparkSession)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = (text or "").encode().split()
                runs = runs_of(words)
                rows.append((len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], collapsed(words, runs).decode()))
            out = pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64"))
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(found, RESULT)


def with_tail(text: Column, doc_id: Column) -> Column:
    """The query's texts: in every tenth document, by a checksum of its number, the words from some place on repeat a period."""
    draw = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(draw / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1).cast("long") + F.call_function("div", n - a, F.lit(3) + g % 8)
        ends = F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda c: F.array_join(
            F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < c["a"], i).otherwise(c["a"] + (i - c["a"]) % c["p"]).cast("int"))), " "
        ))
        return F.when(n > 0, ends[0]).otherwise(text)

    # A one-element transform keeps the words from being split anew for each of them.
    changed = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), repeated)[0]
    return F.when(draw % 10 == 0, changed).otherwise(text)


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest one, and checksums of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("at"), (-r["period"]).alias("by"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = rows.withColumn("_best", best)
    length, period = F.col("_best.length"), -F.col("_best.by")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.at")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.call_function("div", F.lit(1000).cast("long") * length, period).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
