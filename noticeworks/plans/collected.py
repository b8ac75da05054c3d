"""Collected answers and files, queues, pages of lists and running totals."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeworks.functions import labels
from noticeworks.plans.registry import query
from noticeworks.sources import captures, files
from noticeworks.sources.fixtures import Frames


@query("SRC_02_03_paged_answers", "SELECT n_nationkey + 1 AS page, n_regionkey + 1::BIGINT AS n FROM nation WHERE n_nationkey < 14", False)
def src_02(t: Frames) -> DataFrame:
    """Nations as captured pages of an API; page 15 is empty and ends the source, though later pages have items."""
    found = F.when(F.col("n_nationkey") == 14, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.col("n_regionkey")))
    answers = t.table("nation").select((F.col("n_nationkey") + 1).alias("page"), F.to_json(F.struct(found.alias("items"))).alias("body"))
    return captures.items(captures.pages_read(answers, max_pages=20)).groupBy("page").agg(F.count("*").alias("n"))


def _archive(**parts: str | bytes) -> bytes:
    """An archive of parts; __ in a name stands for a slash, _dot_ for a dot."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in parts.items():
            archive.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


#: Files by ending, made of a title and a brand: what an office program writes, a damaged file, and one of a format that is not read.
OFFICE = {
    "txt": lambda title, brand: f"{title}\n{brand}".encode(),
    "docx": lambda title, brand: _archive(word__document_dot_xml=f'<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>{title[:3]}</w:t></w:r><w:r><w:t>{title[3:]}</w:t></w:r></w:p><w:p/><w:p><w:t>{brand}</w:t></w:p></w:body></w:document>'),
    "pptx": lambda title, brand: _archive(ppt__slides__slide2_dot_xml=f'<p:sld xmlns:p="p" xmlns:a="a"><a:t>{brand}</a:t></p:sld>', ppt__slides__slide1_dot_xml=f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:t>{title}</a:t></a:p></p:sld>'),
    "xlsx": lambda title, brand: _archive(xl__sharedStrings_dot_xml=f'<sst xmlns="s"><si><r><t>{title[:2]}</t></r><r><t>{title[2:]}</t></r></si></sst>', xl__worksheets__sheet1_dot_xml=f'<worksheet xmlns="s"><c t="inlineStr"><is><t>{brand}</t></is></c></worksheet>'),
    "hwp": lambda title, brand: _archive(Contents__section0_dot_xml=f'<hs:sec xmlns:hs="s" xmlns:hp="p"><hp:p><hp:t>{title.replace(' ', '<hp:lineBreak/>')}</hp:t></hp:p><hp:p><hp:t>{brand}</hp:t></hp:p></hs:sec>'),
    "hwpx": lambda title, brand: b"PK damaged",
    "pdf": lambda title, brand: b"%PDF",
}


@query("SRC_03_pages_by_total", "SELECT n_nationkey + 1 AS page, n_regionkey + 1::BIGINT AS n FROM nation WHERE n_nationkey < 9", False)
def src_03(t: Frames) -> DataFrame:
    """Pages whose first answers tell how many there are; later pages have items and are not read."""
    answers = t.table("nation").select((F.col("n_nationkey") + 1).alias("page"), F.to_json(F.struct(F.sequence(F.lit(0), F.col("n_regionkey")).alias("items"), F.when(F.col("n_nationkey") > 0, F.lit("9")).alias("pages"))).alias("body"))
    return captures.items(captures.pages_read(answers, max_pages=20, total_path="$.pages")).groupBy("page").agg(F.count("*").alias("n"))


@query("SRC_10_11_extracted_files", """
    SELECT p_partkey, CASE WHEN p_partkey % 7 < 5 THEN p_name || chr(10) || p_brand ELSE '' END AS text, ['txt', 'docx', 'pptx', 'xlsx', 'hwpx', 'hwpx', 'pdf'][1 + p_partkey % 7] AS method,
           p_partkey % 7 < 5 AS ok, ['txt', 'docx', 'pptx', 'xlsx', 'hwpx', 'hwpx', ''][1 + p_partkey % 7] AS attempted FROM part""", False)
def src_10(t: Frames) -> DataFrame:
    endings = list(OFFICE)

    @F.pandas_udf("binary")
    def written(kind: pd.Series, title: pd.Series, brand: pd.Series) -> pd.Series:
        return pd.Series([OFFICE[k](a, b) for k, a, b in zip(kind, title, brand, strict=True)])

    kind = F.element_at(F.array(*map(F.lit, endings)), (F.col("p_partkey") % 7 + 1).cast("int"))
    found = files.extracted(F.concat(F.lit("f."), kind), written(kind, F.col("p_name"), F.col("p_brand")))
    return t.table("part").select("p_partkey", found.alias("x")).select("p_partkey", "x.text", "x.method", "x.ok", F.array_join("x.attempted", ",").alias("attempted"))


def _nested_archive() -> bytes:
    """Archives five deep, of which four are opened, and a damaged one."""
    fifth = _archive(e_dot_txt="12345")
    fourth = _archive(d_dot_txt="1234", last_dot_zip=fifth)
    third = _archive(c_dot_txt="123", more_dot_zip=fourth)
    second = _archive(deep__b_dot_txt="12", more_dot_zip=third)
    return _archive(a_dot_txt="1", more_dot_zip=second, bad_dot_zip=b"damaged")


@query("SRC_12_archive_entries", f"""
    SELECT n_nationkey, name, size FROM nation, (VALUES ('a.txt', 1::BIGINT), ('more.zip :: deep/b.txt', 2), ('more.zip :: more.zip :: c.txt', 3), ('more.zip :: more.zip :: more.zip :: d.txt', 4),
        ('more.zip :: more.zip :: more.zip :: last.zip', {len(_archive(e_dot_txt="12345"))}), ('bad.zip', 7)) AS e(name, size) WHERE n_nationkey % 2 = 0""", False)
def src_12(t: Frames) -> DataFrame:
    content = F.when(F.col("n_nationkey") % 2 == 0, F.lit(_nested_archive())).otherwise(F.lit(b"no archive"))
    rows = t.table("nation").select("n_nationkey", content.alias("archive"))
    return rows.lateralJoin(files.ZipEntries(F.col("archive").outer())).select("n_nationkey", "name", "size")


@query("CASE_12_strength_label", "SELECT notice_id, line, CASE WHEN priority * 10 >= 0.66 THEN '강한 일치' WHEN priority * 10 >= 0.33 THEN '보통 일치' ELSE '약한 일치' END AS label FROM scores")
def case_12(t: Frames) -> DataFrame:
    return t.scores.select("notice_id", "line", labels.strength_label(F.col("priority") * 10).alias("label"))


@query("WIN_09_running_totals", """
    WITH d AS (SELECT source_id, (run_at + INTERVAL 9 HOUR)::DATE AS day, count(*) AS n FROM runs GROUP BY 1, 2)
    SELECT source_id, day::VARCHAR AS day, n, (sum(n) OVER (PARTITION BY source_id ORDER BY day ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM d""")
def win_09(t: Frames) -> DataFrame:
    days = t.runs.groupBy("source_id", labels.kst_date(F.col("run_at")).alias("day")).agg(F.count("*").alias("n"))
    so_far = W.partitionBy("source_id").orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    return days.select("source_id", F.col("day").cast("string").alias("day"), "n", F.sum("n").over(so_far).alias("total"))


@query("SRT_10_second_page", "SELECT id, stage FROM notices ORDER BY open_dt DESC NULLS LAST, id DESC LIMIT 21 OFFSET 21")
def srt_10(t: Frames) -> DataFrame:
    return t.notices.orderBy(F.desc_nulls_last("open_dt"), F.desc("id")).offset(21).limit(21).select("id", "stage")


@query("STR_03_pending_batch", "SELECT id FROM notices WHERE id NOT IN (SELECT notice_id FROM analyses) ORDER BY id LIMIT 200")
def str_03(t: Frames) -> DataFrame:
    """The next rows of a queue: those that lack a mark, oldest first; the batch's size is the feature."""
    marked = t.analyses.select(F.col("notice_id").alias("id"))
    return t.notices.select("id").join(marked, "id", "left_anti").orderBy("id").limit(200)


@query("STR_06_job_states", """
    SELECT source_id, CASE arg_max(status, run_id) WHEN 'running' THEN 'running' WHEN 'fail' THEN 'failed' ELSE 'done' END AS state FROM runs GROUP BY 1
    UNION ALL SELECT s.source_id, 'queued' FROM sources s WHERE s.source_id NOT IN (SELECT source_id FROM runs)""")
def str_06(t: Frames) -> DataFrame:
    """The state of each source's last job; a job without one waits."""
    last = t.runs.groupBy("source_id").agg(F.max_by("status", "run_id").alias("status"))
    rows = last.join(t.sources.select("source_id"), "source_id", "full")
    state = F.when(F.col("status").isNull(), "queued").when(F.col("status") == "running", "running").when(F.col("status") == "fail", "failed").otherwise("done")
    return rows.select("source_id", state.alias("state"))
