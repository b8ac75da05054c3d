"""Tables, links, calls and text in HTML columns, by the standard library's parser inside Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIPPED = frozenset(("script", "style"))


class _Text(HTMLParser):
    """Visible text and links of a page."""

    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self.links: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in SKIPPED
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


class _Within(HTMLParser):
    """Lines of text inside div elements of a class."""

    def __init__(self, wanted: str):
        super().__init__()
        self.wanted, self.open = wanted, []
        self.lines: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "div":
            self.open.append(self.wanted in (dict(attrs).get("class") or "").split())

    def handle_endtag(self, tag):
        if tag == "div" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if any(self.open) and data.strip():
            self.lines.append(data.strip())


class _Table(HTMLParser):
    """Data cells of the rows of tables with a class, each with its first link."""

    def __init__(self, wanted: str):
        super().__init__()
        self.wanted, self.inside = wanted, 0
        self.rows: list[list[dict]] = []
        self.cell: dict | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.inside += 1 if self.inside or self.wanted in (a.get("class") or "").split() else 0
        elif self.inside and tag == "tr":
            self.rows.append([])
        elif self.inside and tag == "td" and self.rows:
            self.cell = {"text": "", "href": None}
            self.rows[-1].append(self.cell)
        elif self.cell is not None and tag == "a" and self.cell["href"] is None:
            self.cell["href"] = a.get("href")

    def handle_endtag(self, tag):
        if tag == "table" and self.inside:
            self.inside -= 1
        elif tag == "td":
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"] = " ".join(f"{self.cell['text']} {data}".split())


def read_page(page: str | None) -> tuple[str, list[str]]:
    parser = _Text()
    parser.feed(page or "")
    return " ".join(parser.parts), parser.links


def text_and_links(html: Column) -> Column:
    """Struct of the visible text and the links of a page."""

    @F.pandas_udf("text string, links array<string>")
    def read(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_page(p) for p in pages], columns=["text", "links"])

    return read(html)


def read_rows(page: str | None, wanted: str, width: int) -> list[dict]:
    """Rows of a page's tables of a class that have so many data cells: their texts and their first link."""
    parser = _Table(wanted)
    parser.feed(page or "")
    return [{"cells": [c["text"] for c in r], "href": next((c["href"] for c in r if c["href"]), None)} for r in parser.rows if len(r) == width]


def table_rows(pages: DataFrame, html: str, wanted: str, columns: list[str]) -> DataFrame:
    """A row for each table row with as many data cells as there are columns; header rows and others drop out."""

    @F.pandas_udf("array<struct<cells: array<string>, href: string>>")
    def rows_of(values: pd.Series) -> pd.Series:
        return pd.Series([read_rows(v, wanted, len(columns)) for v in values])

    found = pages.withColumn("r", F.explode(rows_of(F.col(html))))
    others = [c for c in pages.columns if c != html]
    return found.select(*others, *[F.col("r.cells")[k].alias(c) for k, c in enumerate(columns)], F.col("r.href").alias("href"))


def text_within(html: Column, wanted: str) -> Column:
    """Text of the div elements of a class, a line for each piece; null if there is none."""

    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            parser = _Within(wanted)
            parser.feed(page or "")
            out.append("\n".join(parser.lines) or None)
        return pd.Series(out, dtype="object")

    return read(html)


def linked(base: Column, hrefs: Column) -> Column:
    """Addresses that the links of a page lead to on the page's own host, without fragments, in order and once each."""

    @F.pandas_udf("array<string>")
    def read(bases: pd.Series, links: pd.Series) -> pd.Series:
        out = []
        for at, found in zip(bases, links, strict=True):
            host, kept = urlsplit(at or "").netloc, {}
            for href in found if found is not None else ():
                target = urldefrag(urljoin(at or "", href)).url
                parts = urlsplit(target)
                if parts.scheme in ("http", "https") and parts.netloc == host:
                    kept[target] = None
            out.append(list(kept))
        return pd.Series(out, dtype="object")

    return read(base, hrefs)


def call_arguments(href: Column, function: str) -> Column:
    """The quoted arguments of a script call in a link."""
    inside = F.regexp_extract(href, rf"{function}\s*\(([^)]*)\)", 1)
    return F.regexp_extract_all(inside, F.lit(r"'([^']*)'"), F.lit(1))


def detail_url(base: str, names: list[str], arguments: Column) -> Column:
    """A URL with the arguments under names; null if there are too few."""
    parts = [F.concat(F.lit(f"{n}="), F.url_encode(F.try_element_at(arguments, F.lit(k + 1)))) for k, n in enumerate(names)]
    return F.when(F.size(arguments) >= len(names), F.concat(F.lit(f"{base}?"), F.concat_ws("&", *parts)))


def crawl(links: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 30, stop: Column | None = None) -> DataFrame:
    """Pages reached from seeds (url) over links (src, dst) in so many steps; pages at which to stop are visited but not left.  `most` is a feature: the first pages by step and url."""
    seen = seeds.select("url", F.lit(0).alias("step")).distinct()
    front = seen
    for step in range(1, depth + 1):
        leave = front if stop is None else front.where(~stop)
        front = links.join(leave.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        front = front.join(seen.select("url"), "url", "left_anti").withColumn("step", F.lit(step))
        seen = seen.unionByName(front)
    return seen.orderBy("step", "url").limit(most)
