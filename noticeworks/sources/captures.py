"""Captured answers of APIs: pages as a data source, envelopes, items, attachments."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

OK_CODES = ("00", "03")


class PagedCapture(DataSource):
    """Reads `path` with {page} put in, one partition a page, up to max_pages; a page that is missing or has no items is the end.

    Pages are captured answers, read through Spark's own file systems by `items`; this source is for local captures in tests and tools."""

    @classmethod
    def name(cls) -> str:
        return "paged_capture"

    def schema(self) -> str:
        return "page int, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options)


class _Pages(DataSourceReader):
    def __init__(self, options):
        self.path, self.pages = options["path"], int(options.get("max_pages", "10"))
        self.items = options.get("items_path", "items").split(".")

    def partitions(self):
        return [InputPartition(page) for page in range(1, self.pages + 1)]

    def read(self, partition) -> Iterator[tuple]:
        try:
            with open(self.path.format(page=partition.value), encoding="utf-8") as file:
                found = json.load(file)
        except FileNotFoundError:
            return
        for key in self.items:
            found = (found or {}).get(key) or []
        for item in found:
            yield partition.value, json.dumps(item, ensure_ascii=False)


def items(captures: DataFrame, body: str = "body", path: str = "$.items") -> DataFrame:
    """A row for each item of captured JSON bodies."""
    array = F.from_json(F.get_json_object(body, path), "array<string>")
    return captures.withColumn("item", F.explode(array)).drop(body)


def pages_read(captures: DataFrame, page: str = "page", body: str = "body", path: str = "$.items", max_pages: int = 10, total_path: str | None = None) -> DataFrame:
    """Captured answers of a paged source, up to the page before the first empty one, to a limit of pages, and to the number of pages that the first answer with one gives."""
    n = F.coalesce(F.json_array_length(F.get_json_object(body, path)), F.lit(0))
    total = F.get_json_object(body, total_path).try_cast("int") if total_path else F.lit(None).cast("int")
    told = (n > 0) & total.isNotNull()
    # One row: the first empty page, and the last page by the total (the page that tells it is read in any case).
    end = captures.agg(F.min(F.when(n == 0, F.col(page))).alias("_end"), F.greatest(F.min_by(F.when(told, total), F.when(told, F.col(page))), F.min(F.when(told, F.col(page)))).alias("_last"))
    read = (F.col("_end").isNull() | (F.col(page) < F.col("_end"))) & (F.col("_last").isNull() | (F.col(page) <= F.col("_last")))
    return captures.where(F.col(page) <= max_pages).join(F.broadcast(end), read, "left_semi")


def envelope_error(body: Column) -> Column:
    """The message of an error answer; null for good and for legally empty ones."""
    code = F.get_json_object(body, "$.response.header.resultCode")
    gateway = F.coalesce(F.get_json_object(body, "$.OpenAPI_ServiceResponse.cmmMsgHeader.returnAuthMsg"), F.get_json_object(body, "$.OpenAPI_ServiceResponse.cmmMsgHeader.errMsg"))
    return F.coalesce(gateway, F.when(~code.isin(*OK_CODES), F.coalesce(F.get_json_object(body, "$.response.header.resultMsg"), code)))


def latest_items(found: DataFrame, key: Column, fetched: str = "fetched_at") -> DataFrame:
    """The newest captured item of each key."""
    place = F.row_number().over(W.partitionBy("key").orderBy(F.desc(fetched), F.desc("item")))
    return found.withColumn("key", key).where(F.col("key").isNotNull()).withColumn("place", place).where("place = 1").drop("place")


def from_xml(text: Column, schema: str) -> Column:
    """XML to a struct; item elements declared as an array stay one, even alone."""
    return F.from_xml(text, schema)


class _Nested:
    """A reader that closes each element into a value: its text if it has no elements, or else its elements by name."""

    def __init__(self):
        self.open: list[tuple[dict[str, list], list[str]]] = [({}, [])]

    def start(self, name, attributes):
        self.open.append(({}, []))

    def text(self, data):
        self.open[-1][1].append(data)

    def end(self, name):
        inner, text = self.open.pop()
        value = {k: _one_or_list(k, v) for k, v in inner.items()} if inner else "".join(text) or None
        self.open[-1][0].setdefault(f"{{{name}" if "}" in name else name, []).append(value)


def _one_or_list(name: str, values: list):
    if name == "item":
        return values
    # Of repeated elements an empty first one does not count.
    return values[0] if len(values) == 1 else values[values[0] is None :]


def read_xml(text: str | None) -> str | None:
    """XML as JSON text under the name of its root; null if it is not well formed, or too deep to be written. Attributes are left out, names of a namespace stand behind it in braces."""
    if text is None:
        return None
    reader, parser = _Nested(), expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = reader.start, reader.end, reader.text
    try:
        parser.Parse(text, True)
        return json.dumps({name: root for name, (root,) in reader.open[0][0].items()}, ensure_ascii=False, separators=(",", ":"))
    except (expat.ExpatError, ValueError, RecursionError):
        return None


def xml_json(text: Column) -> Column:
    """XML of any shape as JSON text: `item` is always an array, other names where they repeat, all values are strings or null."""

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([read_xml(x) for x in texts], dtype="object")

    return read(text)


def answered(text: Column) -> Column:
    """An answer in XML as JSON text; gateways answer in JSON even then, which is taken as it is, and anything else is null."""
    return F.coalesce(xml_json(text), F.when(F.try_parse_json(text).isNotNull(), text))


def xml_value(text: Column) -> Column:
    """The same as a VARIANT, so that documents of different shapes stand in one column."""
    return F.try_parse_json(xml_json(text))


#: Numbered fields of an item that name attachments or hold their text.
ATTACHED = (
    *(f"{name}{k}" for name, count in (("ntceSpecDocUrl", 10), ("ntceSpecFileNm", 10), ("sptDscrptDocUrl", 5), ("specDocFileUrl", 5), ("specItemCntnts", 5), ("specItemNm", 5)) for k in range(1, count + 1)),
    *("stdNtceDocUrl", "specCntnts"),
)


def attachments(item: Column) -> Column:
    """Attachments named in the numbered fields of an item: array of (name, url, inline text)."""
    # Read once and bound to a name, as every use of an expression would read the item again.
    read = F.from_json(F.when(F.ltrim(item).startswith("{"), item), ", ".join(f"{key} string" for key in ATTACHED))
    return F.transform(F.array(read), _attached)[0]


def _attached(fields: Column) -> Column:
    get = lambda key: F.nullif(fields[key], F.lit(""))

    def named(url: Column, fallback: str) -> Column:
        query = lambda key: F.nullif(F.try_url_decode(F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1)), F.lit(""))
        return F.coalesce(query("fileNm"), query("fileName"), F.lit(fallback))

    def entry(name: Column, url: Column, text: Column, good: Column) -> Column:
        return F.when(good, F.struct(name.alias("name"), url.cast("string").alias("url"), text.cast("string").alias("text")))

    none, out = F.lit(None).cast("string"), []
    for k in range(1, 11):
        url, name = get(f"ntceSpecDocUrl{k}"), get(f"ntceSpecFileNm{k}")
        out.append(entry(name, url, none, url.isNotNull() & name.isNotNull()))
    for prefix, count, fallback in (("sptDscrptDocUrl", 5, "현장설명서"), ("specDocFileUrl", 5, "규격서")):
        for k in range(1, count + 1):
            url = get(f"{prefix}{k}")
            out.append(entry(named(url, f"{fallback}{k}"), url, none, url.isNotNull()))
    url = get("stdNtceDocUrl")
    out.append(entry(named(url, "표준공고서"), url, none, url.isNotNull()))
    text = get("specCntnts")
    out.append(entry(F.lit("규격내용"), none, text, text.isNotNull()))
    for k in range(1, 6):
        text = get(f"specItemCntnts{k}")
        out.append(entry(F.coalesce(get(f"specItemNm{k}"), F.lit(f"규격항목{k}")), none, text, text.isNotNull()))
    return F.filter(F.array(*out), lambda a: a.isNotNull())
