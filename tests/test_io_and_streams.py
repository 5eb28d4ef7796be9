"""Files, payloads, sinks and streams."""

from __future__ import annotations

import datetime as dt
import io
import json
import zipfile

from chronoweave.operators.intervals import periods_and_gaps
from chronoweave.sources import formats, payload, sinks
from chronoweave.streaming import state


def _zip(**members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return data.getvalue()


SHEET = '<worksheet xmlns="m"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c></row><row><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>'
XLSX = _zip(xl__sharedStrings_xml='<sst xmlns="m"><si><t>День</t></si></sst>', xl__worksheets__sheet1_xml=SHEET)
ODS = _zip(mimetype="x", content_xml='<o xmlns:t="t" xmlns:x="x"><t:table><t:table-row><t:table-cell t:number-columns-repeated="2"><x:p>a</x:p></t:table-cell><t:table-cell t:number-columns-repeated="1000"/></t:table-row></t:table></o>')
DOCX = _zip(word__document_xml='<d xmlns:w="w"><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></d>')


def test_sniff():
    assert formats.sniff(b"%PDF-1.7", "a.xlsx") == "pdf"
    assert [formats.sniff(x) for x in (XLSX, ODS, DOCX, b"<!doctype html>", b"{}", b"a;b;c", b"hello", b"\xff\xfe\x00", None, b"")] == ["xlsx", "ods", "docx", "html", "json", "csv", "txt", "binary", "empty", "empty"]
    assert formats.sniff(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "x.doc") == "doc"
    assert formats.sniff(b"PK\x03\x04broken") == "binary"


def test_texts_of_any_encoding_and_length():
    text = "Расписание занятий; группа; ауд. 5\n" * 300
    for pad in ("", "x"):
        assert formats.sniff((pad + text).encode()) == "csv"
        assert formats.sniff(('["' + pad + "ы" * 5000 + '"]').encode()) == "json"
        assert formats.sniff((pad + "ы" * 5000).encode()) == "txt"
    for encoding in ("utf-8", "utf-8-sig", "utf-16", "cp1251", "koi8-r", "cp866"):
        assert formats.decoded(text.encode(encoding)) == text
    assert formats.sniff(b" " * 20_000 + b"<table>") == "html"
    assert formats.decoded(bytes(range(256))) is None
    assert formats.candidates(b"a;b;c", "x.html")[:2] == ["csv", "html"]


def test_all_tries(spark):
    rows = formats.attempts(spark.createDataFrame([("a.csv", bytearray(b"<table><tr><td>1<tr><td>2</table>")), ("b.xlsx", bytearray(b"PK"))], "path string, content binary")).collect()
    assert [(r.parser, len(r.cells)) for r in rows if r.doc == "a.csv"][:2] == [("html", 2), ("csv", 1)]
    assert {r.warnings for r in rows if r.parser == "docx"} == {1}


def test_sheets_rows_and_paragraphs(spark):
    two = _zip(xl__worksheets__sheet1_xml=SHEET.replace(' t="s"', ""), xl__worksheets__sheet2_xml='<worksheet><c r="A1"><v>7</v></c></worksheet>')
    rows = formats.file_grids(spark.createDataFrame([("a.xlsx", bytearray(two))], "path string, content binary"), every_sheet=True).collect()
    assert {r.doc for r in rows} == {"a.xlsx#1", "a.xlsx#2"}
    ods = _zip(mimetype="x", content_xml='<o xmlns:t="t"><t:table><t:table-row t:number-rows-repeated="2"><t:c><t:p>a</t:p></t:c></t:table-row><t:table-row t:number-rows-repeated="9"/><t:table-row><t:c><t:p>b</t:p></t:c></t:table-row></t:table></o>')
    assert formats._ods(ods) == [(0, 0, "a"), (1, 0, "a"), (11, 0, "b")]
    doc = _zip(word__document_xml='<d xmlns:w="w"><w:p><w:t>head</w:t></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:t>1</w:t></w:p></w:tc><w:tc><w:p><w:t>2</w:t></w:p></w:tc></w:tr></w:tbl><w:p><w:t>tail</w:t></w:p></d>')
    assert formats._READERS["docx"](doc) == [(0, 0, "head"), (1, 0, "1"), (1, 1, "2"), (2, 0, "tail")]


def test_grids(spark):
    files = [("a.xlsx", bytearray(XLSX)), ("b.ods", bytearray(ODS)), ("c.docx", bytearray(DOCX)), ("d.csv", bytearray("﻿q;w\n;e".encode())), ("e.pdf", bytearray(b"%PDF-1")), ("f.html", bytearray(b"<table><tr><td>1"))]
    rows = formats.file_grids(spark.createDataFrame(files, "path string, content binary")).collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r.doc, []).append((r.row, r.col, r.text))
    assert got == {
        "a.xlsx": [(0, 0, "День"), (0, 1, "5"), (1, 0, "День"), (1, 1, "x")], "b.ods": [(0, 0, "a"), (0, 1, "a")], "c.docx": [(0, 0, "1"), (0, 1, "2")],
        "d.csv": [(0, 0, "q"), (0, 1, "w"), (1, 1, "e")], "e.pdf": [(None, None, "unsupported format pdf")], "f.html": [(0, 0, "1")],
    }


def test_payload(spark, tmp_path):
    event = {"id": "e", "date": "2026-10-06", "start": "9:00", "end": "12:25", "discipline": "Лекция Химия", "groups": ["101-102"], "stream": "Поток А", "type": "лекция"}
    courses = {"1": {"specialty": "31.05.01", "events": [event, event | {"date": ""}, {"scheduleMode": "weekly-block", "weekNumber": 5, "time": "13:30-16:55", "subject": "X", "group": "413"}]}, "x": {"events": []}}
    (tmp_path / "p.json").write_text(json.dumps({"schemaVersion": 7, "generatedAt": "x", "courses": courses}), encoding="utf-8")
    frame = payload.read_payloads(spark, str(tmp_path / "p.json"))
    rows = payload.payload_events(frame).orderBy("group_code", "start_time").collect()
    assert [(r.group_code, r.start_time, r.end_time, r.double_part, r.subject, r.lesson_type, r.stream_code) for r in rows] == [
        (g, a, z, part, "Химия", "lecture", "A") for g in ("101", "102") for a, z, part in (("09:00", "10:35", 1), ("10:50", "12:25", 2))
    ]
    block = payload.weekly_blocks(frame).first()
    assert (block.group_code, block.week_number, block.start_time) == ("413", 5, "13:30")
    assert {r.issue for r in payload.payload_issues(frame).collect()} == {"strange course"}
    (tmp_path / "q.json").write_text("{}", encoding="utf-8")
    assert {r.level for r in payload.payload_issues(payload.read_payloads(spark, str(tmp_path / "q.json"))).collect()} == {"error"}


def test_publish_and_keep(spark, tmp_path):
    at = str(tmp_path / "out")
    sinks.publish(spark.createDataFrame([(1,)], "a int"), at)
    sinks.publish(spark.createDataFrame([(2,)], "a int"), at)
    assert [r.a for r in spark.read.json(at).collect()] == [2]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    parts = str(tmp_path / "parts")
    make = lambda *rows: spark.createDataFrame(rows, "program_code string, course int, v string")
    sinks.publish_parts(make(("p", 1, "a"), ("p", 2, "b")), parts, ["program_code", "course"])
    report = sinks.publish_parts(make(("p", 1, "c")), parts, ["program_code", "course"], make(("p", 2, "")))
    assert {(r.course, r.rows, r.status) for r in report.collect()} == {(1, 1, "written"), (2, 0, "kept")}
    assert {r.v for r in spark.read.parquet(parts).collect()} == {"c", "b"}
    assert payload.snapshot_part(spark, parts, "p", 2).first().v == "b"


def test_fingerprint_and_diff(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(2, None), (1, "x")], "k int, v string")
    mark = lambda df: tuple(sinks.fingerprint(df, ["k", "v"]).first())
    assert mark(a) == mark(b) != mark(a.limit(1))
    assert sinks.table_diff(a, b).count() == 0
    assert {(r.k, r.side) for r in sinks.table_diff(a, b.where("k = 1").union(b.where("k = 1"))).collect()} == {(2, "removed"), (1, "added")}


def _run(spark, frame, name):
    query = frame.writeStream.format("memory").queryName(name).outputMode("update").start()
    try:
        query.processAllAvailable()
        return spark.sql(f"SELECT * FROM {name}").collect()
    finally:
        query.stop()


def test_streams(spark, tmp_path):
    d = lambda n: dt.date(2026, 9, 1) + dt.timedelta(n)
    rows = [("x", d(0), d(3)), ("x", d(10), d(12)), ("y", d(1), d(1)), ("x", d(4), d(5))]
    schema = "e string, a date, z date"
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    live = _run(spark, state.live_periods(stream, "e", "a", "z"), "periods")
    whole = {tuple(r) for r in periods_and_gaps(spark.createDataFrame(rows, schema), ["e"], "a", "z").collect()}
    assert whole <= {tuple(r) for r in live}

    at = lambda s: dt.datetime(2026, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)
    spark.createDataFrame([("u", at(s)) for s in (10, 30, 69, 70, 71)] + [("v", at(0))], "k string, t timestamp").coalesce(1).write.parquet(str(tmp_path / "hits"))
    hits = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "hits"))
    got = sorted((r.key, r.hit, r.allowed) for r in _run(spark, state.rate_windows(hits, "k", "t", 2), "rates"))
    assert got == [("u", 1, True), ("u", 1, True), ("u", 2, True), ("u", 2, True), ("u", 3, False), ("v", 1, True)]
    batch = spark.read.parquet(str(tmp_path / "hits"))
    assert sum(r.n for r in state.tumbling(batch, "t", ["k"], "1 minute").collect()) == 6
    assert {(r.k, r.n) for r in state.sessions(batch, "t", ["k"], "25 seconds").collect()} == {("u", 2), ("u", 3), ("v", 1)}


def test_versions(spark, tmp_path):
    from chronoweave.streaming.batches import keep_versions, newest_version

    source, out, marks = (str(tmp_path / n) for n in ("source", "out", "marks"))
    assert newest_version(out, spark) is None

    def deliver(*values):
        spark.createDataFrame([(v,) for v in values], "v int").coalesce(1).write.mode("append").parquet(source)
        keep_versions(spark.readStream.schema("v int").parquet(source), out, marks, lambda df: df.where("v > 0")).awaitTermination()

    deliver(1, 2)
    assert sorted(r.v for r in newest_version(out, spark).collect()) == [1, 2]
    deliver(3)
    assert [r.v for r in newest_version(out, spark, ["v"]).collect()] == [3]
    deliver(-1)  # nothing good came: the last good version stays
    assert [r.v for r in newest_version(out, spark).collect()] == [3]
