"""Sources and streams on small files."""

import datetime as dt
import io
import json
import zipfile

from pyspark.sql import functions as F

from noticeworks.sources import captures, files
from noticeworks.streaming import engagement


def archive(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


def test_paged_capture_stops_at_missing_pages(spark, tmp_path):
    for page, n in ((1, 2), (2, 1)):
        (tmp_path / f"p{page}.json").write_text(json.dumps({"response": {"items": [{"k": i} for i in range(n)]}}))
    spark.dataSource.register(captures.PagedCapture)
    rows = spark.read.format("paged_capture").option("path", f"{tmp_path}/p{{page}}.json").option("items_path", "response.items").option("max_pages", 4).load()
    assert sorted((r.page, r.item) for r in rows.collect()) == [(1, '{"k": 0}'), (1, '{"k": 1}'), (2, '{"k": 0}')]


def test_nested_archives_to_a_limit(spark):
    fifth = archive(e_dot_txt="v")
    inner = archive(a_dot_txt="x", deep_dot_zip=archive(b_dot_txt="y", deeper_dot_zip=archive(c_dot_txt="z", last_dot_zip=fifth)))
    found = dict(files.entries(archive(top_dot_txt="t", in_dot_zip=inner, broken_dot_zip="no zip")))
    assert set(found) == {"top.txt", "in.zip :: a.txt", "in.zip :: deep.zip :: b.txt", "in.zip :: deep.zip :: deeper.zip :: c.txt", "in.zip :: deep.zip :: deeper.zip :: last.zip", "broken.zip"}
    assert dict(files.entries(archive(a_dot_txt="1", Read__me_dot_txt="2"), ("READ/ ME",))) == {"a.txt": b"1"}
    spark.udtf.register("zip_entries", files.ZipEntries)
    spark.createDataFrame([(archive(top_dot_txt="t"),), (b"no zip",)], "c binary").createOrReplaceTempView("zips")
    assert [r.name for r in spark.sql("SELECT e.name FROM zips, LATERAL zip_entries(c) e").collect()] == ["top.txt"]


def test_names_without_a_mark_are_read_as_korean():
    plain = archive(AAAA_dot_txt="x")
    assert [n for n, _ in files.entries(plain.replace(b"AAAA", "한글".encode("cp949")))] == ["한글.txt"]
    assert [n for n, _ in files.entries(plain.replace(b"AAAA", b"\xff\xffAA"))][0].endswith("AA.txt")


def test_documents_by_kind(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(archive(word__document_dot_xml="<w:d xmlns:w='w'><w:p><w:r><w:t>one &amp; two</w:t></w:r></w:p><w:p><w:t>three</w:t></w:p></w:d>"))
    (tmp_path / "b.txt").write_bytes("한글".encode("cp949"))
    (tmp_path / "c.hwp").write_bytes(archive(Contents__section0_dot_xml="<s xmlns:hp='p'><hp:p><hp:t>han<hp:tab/>gul</hp:t></hp:p></s>"))
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.xlsx").write_bytes(archive(xl__sharedStrings_dot_xml="<sst><si><t>Name</t></si><si><r><t>Pr</t></r><r><t>ice</t></r></si></sst>", xl__worksheets__sheet1_dot_xml="<w><is><t>inline</t></is></w>"))
    (tmp_path / "g.pptx").write_bytes(archive(ppt__slides__slide1_dot_xml="<s><t>a</t><x><t>b</t></x></s>", ppt__slides__slide2_dot_xml="<s><t>c</t></s>"))
    (tmp_path / "h.hwp").write_bytes(b"\xd0\xcf\x11\xe0old")
    rows = {r.name: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.docx"].text == "one & two\nthree"
    assert rows["b.txt"].text == "한글"
    assert rows["c.hwp"].text == "han gul" and rows["c.hwp"].method == "hwpx" and rows["c.hwp"].attempted == ["hwpx"]
    assert rows["f.xlsx"].text == "Name\nPrice\ninline" and rows["g.pptx"].text == "a b\nc"
    assert not rows["d.docx"].ok and not rows["e.pdf"].ok and rows["e.pdf"].error == "unsupported" and rows["h.hwp"].attempted == []


def test_damaged_archives_are_rows_not_errors(spark):
    good = archive(word__document_dot_xml="<d><p><t>" + "some text " * 500 + "</t></p></d>")
    compressed = io.BytesIO()
    with zipfile.ZipFile(compressed, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("word/document.xml", "<d><p><t>" + "some text " * 500 + "</t></p></d>")
    data = compressed.getvalue()
    start = data.index(b"document.xml") + 12
    broken = data[:start] + b"\xff" * 20 + data[start + 20 :]
    locked = bytearray(good)
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.index(mark) + at] |= 1
    assert files.extract("a.docx", good)[2]
    for content in (broken, bytes(locked), good[:60], data[:-30], b"PK", b""):
        text, method, ok, error, attempted = files.extract("a.docx", content)
        assert (text, method, ok, attempted) == ("", "docx", False, ["docx"]) and error is not None
        inner = dict(files.entries(archive(a_dot_txt="x", in_dot_zip=content)))
        assert inner == {"a.txt": b"x", "in.zip": content}
    rows = spark.createDataFrame([(k, c) for k, c in enumerate((broken, bytes(locked), good))], "k int, c binary")
    assert [r.name for r in rows.lateralJoin(files.ZipEntries(F.col("c").outer())).select("name").collect()] == ["word/document.xml"]


def test_stream_drops_repeats(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 0, 0, s), k) for k, s in enumerate((0, 4, 8, 9))]
    spark.createDataFrame(rows, "customer_id long, ts timestamp, event_id long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("customer_id long, ts timestamp, event_id long").parquet(f"{tmp_path}/in")
    engagement.run_available(engagement.accepted(stream, ["customer_id"], 5), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 2]


def test_state_ends_with_its_time(spark, tmp_path):
    """A stream in batches, days apart: what the first left is gone, and a job without an outcome has timed out."""
    at = lambda day, minute=0: dt.datetime(2024, 1, day, 0, minute)
    batches = ([(1, at(1), 1, "running"), (2, at(1), 2, "running"), (2, at(1, 30), 3, "ok"), (3, at(1), 4, "fail")], [(4, at(3), 5, "running"), (4, at(3, 20), 6, "fail"), (5, at(3, 30), 7, "running")], [(6, at(5), 8, "ok")])
    schema = "source_id long, ts timestamp, event_id long, status string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        engagement.run_available(engagement.accepted(stream, ["source_id"], 600), f"{tmp_path}/out", f"{tmp_path}/cp")
        engagement.run_available(engagement.job_outcomes(stream.withColumnRenamed("event_id", "run_id"), 3_600), f"{tmp_path}/jobs", f"{tmp_path}/jobs-cp")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 8
    state = spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "last").load()
    assert [r.key.source_id for r in state.collect()] == [6]
    jobs = {(r.source_id, r.run_id, r.state, r.at) for r in spark.read.parquet(f"{tmp_path}/jobs").collect()}
    assert jobs == {(1, 1, "timed_out", dt.datetime(2024, 1, 1, 1)), (2, 2, "done", at(1, 30)), (4, 5, "failed", at(3, 20)), (5, 7, "timed_out", dt.datetime(2024, 1, 3, 1, 30))}


def test_stream_appends_only_new_keys(spark, tmp_path):
    schema = "url string, v long"
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], schema).write.parquet(f"{tmp_path}/in")
    for run in ("one", "two"):
        engagement.append_new(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/table", ["url"], f"{tmp_path}/{run}")
    assert sorted(r.url for r in spark.read.parquet(f"{tmp_path}/table").collect()) == ["a", "b"]


def test_xml_of_any_shape_becomes_nested_values():
    import json

    from noticeworks.sources import captures

    def read(text):
        found = captures.read_xml(text)
        return None if found is None else next(iter(json.loads(found).values()))

    assert read("<r><item><a>1</a></item></r>") == {"item": [{"a": "1"}]}
    assert read("<r><b>1</b><c/><b>2</b><item/><b>3</b></r>") == {"b": ["1", "2", "3"], "c": None, "item": [None]}
    assert read("<r><b/><b>2</b></r>") == {"b": ["2"]} and read("<r><b>2</b><b/></r>") == {"b": ["2", None]}
    assert read("<r x='1'>text<b>2</b>tail</r>") == {"b": "2"}
    assert read("<r> 007 &lt;<!-- no -->x</r>") == " 007 <x" and read('<a:r xmlns:a="u"><a:b>1</a:b></a:r>') == {"{u}b": "1"}
    assert [captures.read_xml(x) for x in (None, "", "<r>", "plain", "<r/>trailing")] == [None] * 5
    assert captures.read_xml("<r/>") == '{"r":null}' and captures.read_xml("<item><a>1</a></item>") == '{"item":{"a":"1"}}'
    assert captures.read_xml('<a:r xmlns:a="u"/>') == '{"{u}r":null}' and captures.read_xml("<a>" * 100000 + "</a>" * 100000) is None
    deep = read("<r>" + "<item>" * 200 + "x" + "</item>" * 200 + "</r>")
    for _ in range(200):
        deep = deep["item"][0] if isinstance(deep, dict) else deep
    assert deep == "x"


def test_attachments_read_an_item_once(spark):
    item = spark.createDataFrame([('{"specDocFileUrl1": "https://f/?fileNm=a%20b", "ntceSpecDocUrl3": "u", "ntceSpecFileNm3": "n", "specItemCntnts2": {"x": [1, "y"]}, "specCntnts": 5, "stdNtceDocUrl": ""}',), ("[1]",), ('[{"specCntnts": "x"}]',), ("{",), (None,)], "item string")
    found = item.select(captures.attachments(F.col("item")).alias("a"))
    assert [[tuple(a) for a in r.a] for r in found.collect()] == [[("n", "u", None), ("a b", "https://f/?fileNm=a%20b", None), ("규격내용", None, "5"), ("규격항목2", None, '{"x":[1,"y"]}')], [], [], [], []]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "get_json_object" not in plan
