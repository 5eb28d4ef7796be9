"""Readers of tables, fill-down over ranges, merged lessons, series and checks: golden cases, odd rows and brute force."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import temporal, text
from chronoweave.operators import coverage, dedupe, geometry, islands, joins, recurrence, rows, scope
from chronoweave.sources import pdf
from chronoweave.streaming.batches import newest_rows

GRID = "doc string, row int, col int, text string"


def _grid(spark, lines, doc="d"):
    return spark.createDataFrame([(doc, r, c, t) for r, line in enumerate(lines) for c, t in enumerate(line) if t], GRID)


def test_row_parser(spark):
    lines = [["Расписание", "", "", ""], ["День", "Время", "401", "402"], ["Понедельник", "9:20 - 10:45", "Биология (2-4) КПК, ауд. 101 Гистология (5-8) ЦДТИ, ауд. 2", "Химия (5-8)"], ["", "11:00-12:00 13:00–14:00", "", "Право"], ["Вт", "", "", ""]]
    got = rows.row_lessons(_grid(spark, lines)).collect()
    assert {r.group_code for r in got} == {"401", "402"}
    assert {(r.subject, r.week_number, r.place) for r in got if r.group_code == "401"} == {("Биология", w, "КПК, ауд. 101") for w in (2, 3, 4)} | {("Гистология", w, "ЦДТИ, ауд. 2") for w in (5, 6, 7, 8)}
    assert {(r.start_time, r.end_time, r.week_number) for r in got if r.subject == "Право"} == {("11:00", "12:00", None), ("13:00", "14:00", None)}
    assert {r.weekday for r in got} == {0}
    lecture = rows.row_lessons(_grid(spark, [["Среда"], ["10:00-11:30", "Этика (1, 3) НИИ, зал 2"], ["12:00-13:00", "x"]]), "lecture").collect()
    assert [(r.weekday, r.group_code, r.subject, r.week_number, r.place) for r in lecture] == [(2, "ALL", "Этика", w, "НИИ, зал 2") for w in (1, 3)]
    assert rows.row_lessons(_grid(spark, [])).count() == 0


def test_pages_carry_groups_and_days(spark):
    page = lambda n, lines: [("d", n, r, c, t) for r, line in enumerate(lines) for c, t in enumerate(line) if t]
    cells = page(1, [["", "", "401", "402"], ["Среда", "9:00-10:35 9:20-10:55", "Химия (1) Солнечное", "Право (2) КПК"]]) + page(2, [["", "11:00-12:00", "Этика (3)", "без недель"]]) + page(3, [["", "", "402"], ["", "13:00-14:00", "Логика (4)"]])
    got = {(r.page, r.group_code, r.weekday, r.start_time, r.subject, r.week_number) for r in rows.paged_lessons(spark.createDataFrame(cells, "doc string, page int, row int, col int, text string"), "4").collect()}
    assert got == {(1, "401", 2, "09:00", "Химия", 1), (1, "402", 2, "09:20", "Право", 2), (2, "401", 2, "11:00", "Этика", 3), (3, "402", 2, "13:00", "Логика", 4)}


@pytest.mark.parametrize(
    ("cell", "wanted"),
    [("Терапия КПК, ауд. 5", ("Терапия", "КПК, ауд. 5")), ("ЛРК, ауд. 5.20 Хирургия", ("Хирургия", "ЛРК, ауд. 5.20")), ("Химия", ("Химия", "")), ("Этика Институт мозга", ("Этика", "Институт мозга")), ("ауд. 5", ("ауд. 5", "")), ("  ", (None, "")), (None, (None, ""))],
)
def test_matrix_cells(cell, wanted):
    assert rows.matrix_cell(cell) == wanted


def test_matrix_carries_cells(spark):
    lines = [["", *map(str, range(1, 10))], ["101", "", "Химия ауд. 1", "", "", "Право"], ["x", "нет"], ["102"]]
    got = {(r.group_code, r.week_number, r.subject, r.place) for r in rows.matrix_lessons(_grid(spark, lines)).collect()}
    assert got == {("101", w, "Химия", "ауд. 1") for w in (2, 3, 4)} | {("101", w, "Право", "") for w in range(5, 10)}
    issues = rows.reading_issues(rows.row_lessons(_grid(spark, [["пн", "9:00-10:00", "██"]]), "lecture"), spark.createDataFrame([("d", "ALL"), ("d", "1"), ("e", "1")], "doc string, group_code string"), "weekly-matrix")
    assert {(r.doc, r.issue) for r in issues.collect()} == {("d", "missing groups"), ("d", "garbled subject"), ("d", "matrix with weekdays"), ("e", "no lessons")}


def test_fill_down_over_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rnd = random.Random(3)
        data = [("hot" if k < 900 else rnd.choice(["a", None, "b"]), k, rnd.choice([None, None, None, None, f"v{k}"]), rnd.choice([None, k]), k % 97 == 0) for k in range(1200)]
        data[0:300] = [(g, k, None, None, False) for g, k, *_ in data[0:300]]
        frame = spark.createDataFrame(data, "g string, k int, v string, n int, fresh boolean").repartition(6)
        for reset in (None, F.col("fresh")):
            wanted, last = {}, {}
            for g, k, v, n, fresh in sorted(data, key=lambda r: (r[0] or "", r[1])):
                if reset is not None and fresh:
                    last.pop(g, None)
                before = last.get(g, (None, None))
                last[g] = (v if v is not None else before[0], n if n is not None else before[1])
                wanted[k] = last[g]
            got = islands.fill_down(frame, ["g"], ["k"], ["v", "n"], reset)
            assert got.columns == frame.columns
            assert {r.k: (r.v, r.n) for r in got.collect()} == wanted
        assert islands.fill_down(frame.limit(0), ["g"], ["k"], ["v"]).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


LESSON = "event_id string, group_code string, half string, teacher string, location_text string, lesson_type string, subject string, start_time string, end_time string, merged boolean"
KEY = ["group_code", "half", "teacher", "location_text", "lesson_type", "subject"]


def test_merged_lessons(spark):
    def run(*changes):
        base = {"event_id": "a", "group_code": "1", "half": None, "teacher": "т", "location_text": "л", "lesson_type": "x", "subject": "Химия", "start_time": "09:00", "end_time": "10:35", "merged": False}
        frame = spark.createDataFrame([tuple((base | c).values()) for c in changes], LESSON)
        return sorted((r.event_id, r.end_time, r.merged_slot_count, r.org_merged) for r in islands.merge_lessons(frame, KEY, "event_id", F.col("merged")).collect())

    second = {"event_id": "b", "start_time": "10:50", "end_time": "12:25"}
    assert run({"subject": "Основы Российской государственности"}, second | {"subject": "ОРГ"}) == [("a", "12:25", 2, True)]
    assert run({}, second | {"subject": " химия"}) == [("a", "12:25", 2, False)]
    assert run({"half": "1/2"}, second | {"half": "1/2"}) == [("a", "12:25", 2, False)]
    for other in ({"half": "2/2"}, {"group_code": "2"}, {"teacher": "у"}):
        assert len(run({}, second | other)) == 2
    assert run({"end_time": "12:25", "merged": True}) == [("a", "12:25", 2, False)]
    assert run({"end_time": "12:25"}) == [("a", "12:25", None, None)]
    assert run({"start_time": None}, {"event_id": "c", "end_time": "x"}) == [("a", "10:35", None, None), ("c", "x", None, None)]


def test_series_changes(spark):
    data = [("o", s, n, "weekly", f"{s}{n}") for s in ("s", "t", None) for n in range(4)]
    frame = spark.createDataFrame(data, "owner_id string, series_id string, occurrence_index int, frequency string, clash string")
    change = lambda *c: {r.clash: (r.series_id, r.occurrence_index, r.frequency) for r in recurrence.change_series(frame, spark.createDataFrame(c, "owner_id string, series_id string, at_index int, scope string, new_series_id string, delete boolean")).collect()}
    got = change(("o", "s", 1, "single", "n", False), ("o", "t", 2, "following", "n", False))
    assert len(got) == 12
    assert (got["s1"], got["s2"], got["t1"], got["t3"]) == (("s", 1, None), ("s", 2, "weekly"), ("t", 1, "weekly"), ("n", 1, "weekly"))
    assert len(change(("o", "s", 1, "following", "n", True))) == 9
    assert len(change(("other", "s", 1, "series", "n", True))) == 12


def test_payloads(spark):
    names = "id int, title string, start_at string, end_at string, time_zone string, status string, privacy string, frequency string, repeat_interval int, until_date string, description string, category string, location string, meeting_url string, attendees array<string>"
    row = (1, " t ", "2026-10-08T18:00:00+0200", "2026-10-08T19:30:00+02:00", None, None, None, "weekly", None, None, None, " ", None, None, [" a", " ", "b"])
    frame = spark.createDataFrame([row, (2, None, "2026-10-08T18:00:00", "bad", "X/Y", "?", "?", "never", 99, "2026-13-01", *[None] * 5)], names)
    assert {(r.id, r.issue) for r in recurrence.payload_issues(frame, "id", ["UTC"]).collect()} == {(2, x) for x in ("no title", "no instant", "unknown frequency", "strange interval", "strange end of the series", "unknown status", "unknown privacy", "unknown zone")}
    good = recurrence.normal_payloads(frame.where("id = 1")).first()
    assert (good.title, good.start_at.hour, good.category, good.status, good.privacy, good.attendees) == ("t", 16, "personal", "planned", "private", ["a", "b"])


def test_checks(spark):
    rule = "rule_id long, program_code string, course int, weeks_spec string, weekday int, start_time string, end_time string, subject string, groups_list array<string>"
    base = ("p", 1, "1-2", 1, "09:00", "10:00", "s", ["101"])
    frame = spark.createDataFrame([(1, *base), (2, *base), (3, "p", 1, "20", 0, "10:00", "09:00", "s", ["999"]), (4, "p", 1, None, None, "x", None, None, None)], rule)
    groups = spark.createDataFrame([("p", 1, " 101")], "program_code string, course int, group_code string")
    got = {(r.rule_id, r.issue) for r in coverage.rule_issues(frame, groups, 1, 16).collect()}
    assert got == {(2, "repeats an earlier rule"), (3, "ends before it starts"), (3, "weekday not 1 to 7"), (3, "weeks outside the window"), (3, "unknown group"), (4, "no clock"), (4, "weekday not 1 to 7")}
    places = spark.createDataFrame([("КПК, ауд. 1", ""), ("КПК", "x"), ("ауд. 5", None), ("Химия", ""), (None, None), ("СПБирь", "")], "s string, p string")
    assert [r[0] for r in places.select(coverage.is_place_only(F.col("s"), F.col("p"))).collect()] == [True, False, True, False, False, False]


def test_joins_and_scopes(spark):
    weeks = spark.createDataFrame([("a", 1, dt.date(2026, 9, 1), dt.date(2026, 9, 6)), ("b", 1, dt.date(2026, 9, 7), dt.date(2026, 9, 13))], "c string, week_number int, from_date date, to_date date")
    blocks = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("z", 1, 1), (None, 1, 1)], "c string, week_number int, weekday int")
    good, bad = joins.resolve_days(blocks, weeks, calendar=["c"])
    assert {(r.c, r.event_date.day) for r in good.collect()} == {("a", 1), ("b", 8)}
    assert bad.count() == 2
    assert {(r.c, r.week_from and r.week_from.day) for r in joins.with_week_ranges(blocks, weeks, calendar=["c"]).collect()} == {("a", 1), ("b", 7), ("z", None), (None, None)}
    slots = spark.createDataFrame([("s", "1", "x")] * 5 + [("s", "2", "y"), ("s", "3", None), ("t", "1", None), ("t", "2", "")], "slot string, id string, c string")
    assert {(r.slot, r.conflicts) for r in joins.slot_conflicts(slots, ["slot"], ["c"], ["id"]).collect()} == {("s", 2)}
    ranks = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("k", 1, "c"), (None, 3, "n"), ("z", None, "q")], "k string, r int, v string")
    assert {r.v for r in dedupe.keep_lowest_rank(ranks, ["k"], F.col("r")).collect()} == {"a", "c", "n"}
    prefixes = joins.prefix_of(spark.createDataFrame([(1, "Химия и жизнь"), (1, "Химия и жизнь"), (2, None), (3, "Химиями")], "i int, t string"), "t", spark.createDataFrame([("химия",), ("Химия и",), (None,), ("хи",)], "n string"), "n")
    assert [(r.i, r.found) for r in prefixes.collect()] == [(1, "химия и")] * 2
    parents, kids = spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", None)], "p string, ok boolean")
    assert {(r.k, r.good) for r in joins.all_hold(parents, kids, "k", "p", F.col("ok"), "good").collect()} == {("a", True), ("b", False), ("c", False)}
    assert {(r.k, len(r.kids)) for r in joins.nested(parents, kids.withColumnRenamed("p", "k"), "k", "kids", ["ok"]).collect()} == {("a", 2), ("b", 2), ("c", 0)}
    both = scope.both_kinds(spark.createDataFrame([("a", "x")], "id string, category string"), spark.createDataFrame([("b", None, "done")], "id string, category string, status string"))
    assert {(r.id, r.kind) for r in scope.with_defaults(both, "planned").collect()} == {("a", "schedule")}
    assert newest_rows(spark.createDataFrame([("u", k) for k in range(9)], "u string, t int"), ["u"], "t", ["t"], 3).agg(F.min("t")).first()[0] == 6


def test_texts_and_days(spark):
    row = spark.range(1).select(
        text.semantic_text(F.lit("Ёлка, №5 (a/b)")), text.colour_key(F.lit(" ＡＢ  Й №")), text.resource_type(F.lit(""), F.lit("http://x/a.PDF?q=b.zip#c")), text.is_colour(F.lit("#12aBcD")), text.is_web_address(F.lit(None)), text.label(F.lit("gia"), "period"),
        text.without_footer(F.lit("ауд. 5 ,каб 6 Заведующий Отделом организации учебного процесса И.")), text.material_scope(F.lit("p"), F.lit(1), F.lit(" 101А ")), temporal.day_in_words(F.lit(dt.date(2026, 10, 6))), temporal.accepted_year_starts(F.lit(dt.date(2026, 6, 30))),
        F.date_format(temporal.local_to_instant(F.to_timestamp(F.lit("2026-10-25 02:30")), "Europe/Zurich"), "HH:mm"), F.date_format(temporal.local_to_instant(F.to_timestamp(F.lit("2026-03-29 02:30")), "Europe/Zurich"), "HH:mm"),
    ).first()
    assert tuple(row) == ("елка 5 a b", "ab й no", "pdf", True, False, "Учебный период", "ауд. 5, каб 6", "p:1:101а", "вторник, 6 октября", [2025, 2026], "01:30", "01:30")


def test_drawn_and_written_matrices(spark):
    cells = spark.createDataFrame([("d", 1, 10.0, 29.5, 0.0, 60.0), ("d", 2, 30.0, 39.0, 30.0, 60.0)], "doc string, cell int, x0 double, x1 double, y0 double, y1 double")
    bands = spark.createDataFrame([("d", w, 10.0 * w, 10.0 * w + 10) for w in (1, 2, 3)], "doc string, week_number int, a double, b double")
    groups = spark.createDataFrame([("d", "101", 15.0), ("d", "102", 45.0)], "doc string, group_code string, y double")
    assert {(r.cell, r.group_code, r.week_number) for r in geometry.cell_lessons(cells, bands, groups).collect()} == {(1, g, w) for g in ("101", "102") for w in (1, 2)} | {(2, "102", 3)}
    weeks = spark.createDataFrame([("d", w, 50.0 * w) for w in range(1, 6)], "doc string, week_number int, x double")
    words = spark.createDataFrame([("d", 80.0, 95.0, 10.0, "Химия"), ("d", 80.0, 220.0, 16.0, "ауд. 1"), ("d", 190.0, 205.0, 45.0, "Право"), ("d", 190.0, 205.0, 46.0, "101")], "doc string, x0 double, x1 double, y double, text string")
    blocks = geometry.matrix_blocks(words, weeks, groups)
    assert {(r.group_code, r.text, r.week_number) for r in geometry.weeks_of_blocks(blocks, weeks).collect()} == {("101", "Химия ауд. 1", w) for w in (2, 3, 4)} | {("102", "Право", 4)}


def test_pdf(spark):
    content = rb"BT /F 10 Tf 14 TL 1 0 0 1 50 700 Tm (A\(b\)\101) Tj T* [(c) -300 (d)] TJ (e) ' ET"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /MediaBox [0 0 500 800] /Resources << /Font << /F 4 0 R >> >> /Contents [5 0 R] >>", b"<< /Type /Font /Subtype /Type1 /FirstChar 65 /Widths [600] >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content)]
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in enumerate(objects, 1))
    got = pdf.pdf_texts(data)
    assert [(p, x, y, t) for p, x, y, _, t in got] == [(1, 50.0, 100.0, "A(b)A"), (1, 50.0, 114.0, "c d"), (1, 50.0, 128.0, "e")]
    assert got[0][3] == pytest.approx(27.0)
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"%PDF broken 1 0 obj << /Type /Catalog /Pages 1 0 R >>")), ("c", None)], "path string, content binary")
    assert {r.doc for r in pdf.pdf_tokens(files).collect()} == {"a"}
