"""The operators against golden cases and brute force."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronoweave.functions.temporal import days_spanned, minutes_between
from chronoweave.operators import components, coverage, dedupe, geometry, grid, islands, joins, recurrence, scope

EVENT = "event_id string, program_code string, course int, group_code string, stream_code string, event_date date, start_time string, end_time string, subject string, location_text string, teacher string, lesson_type string, half string, confidence double, weeks_spec string"
BASE = {"event_id": "1", "program_code": "31.05.01", "course": 1, "group_code": "123", "stream_code": "B", "event_date": dt.date(2026, 10, 6), "start_time": "09:00", "end_time": "10:35", "subject": "Химия", "location_text": "ауд. 1", "teacher": "Иванов", "lesson_type": "practice", "half": None, "confidence": 0.5, "weeks_spec": None}


@pytest.fixture
def events(spark):
    names = [c.split()[0] for c in EVENT.split(", ")]
    return lambda *changes: spark.createDataFrame([tuple((BASE | c)[n] for n in names) for c in changes], EVENT)


def test_scope(events):
    mine = lambda c, group, stream: scope.in_scope(events(c), "31.05.01", 1, group, stream).count()
    common = {"group_code": "ALL", "stream_code": "A"}
    assert (mine(common, "123", "B"), mine(common, "110", "A"), mine(common, "110", None)) == (0, 1, 1)
    assert (mine({"stream_code": "A"}, "123", "B"), mine({"stream_code": "A"}, "123", None)) == (0, 1)
    assert mine({"group_code": None}, "123", "B") == 0
    assert mine({"group_code": "Общая", "stream_code": None}, "123", "B") == 1


def test_agenda(events):
    rows = events({"event_id": "a"}, {"event_id": "b", "group_code": "110"}, {"event_id": "c", "event_date": dt.date(2026, 10, 13)}, {"event_id": "d", "event_date": None})
    found = scope.agenda_week(rows, "31.05.01", 1, "123", "B", dt.date(2026, 10, 5))
    assert [r.event_id for r in found.collect()] == ["a"]
    assert scope.agenda_week(rows, "31.05.01", 1, "123", "B", dt.date(2026, 10, 5), kind="lecture").count() == 0


def test_scope_join_equals_filter(spark, events):
    rnd = random.Random(1)
    rows = events(*[{"event_id": str(k), "group_code": rnd.choice(["123", "110", "ALL", "ВСЕ", None, " 123"]), "stream_code": rnd.choice(["A", "B", None])} for k in range(200)])
    groups = spark.createDataFrame([("31.05.01", 1, "123", "B"), ("31.05.01", 1, "110", "A"), ("31.05.01", 2, "123", "B"), ("31.05.01", 1, "123", "B")], "program_code string, course int, group_code string, stream_code string")
    joined = {(r.event_id, r.to_group) for r in scope.scope_join(rows, groups).collect()}
    wanted = {(r.event_id, g) for g, s in (("123", "B"), ("110", "A")) for r in scope.in_scope(rows, "31.05.01", 1, g, s).collect()}
    assert joined == wanted


def test_dedupe(events):
    twice = events({"event_id": "a", "confidence": 0.4}, {"event_id": "b", "confidence": 0.9, "subject": " химия *"}, {"event_id": "c", "confidence": 0.9})
    kept = dedupe.keep_best(twice, dedupe.event_key(), F.col("confidence"), ["event_id"])
    assert [r.event_id for r in kept.collect()] == ["b"]
    assert dedupe.keep_best(kept, dedupe.event_key(), F.col("confidence"), ["event_id"]).collect() == kept.collect()
    assert dedupe.keep_first(twice, dedupe.event_key(), ["event_id"]).first().event_id == "a"
    halves = events({"half": "1/2"}, {"half": "2/2"})
    assert dedupe.keep_first(halves, dedupe.event_key(), ["event_id"]).count() == 2
    assert tuple(dedupe.duplicates(twice, dedupe.event_key()).first()) == (2, 1)
    assert tuple(dedupe.duplicates(twice.limit(0), dedupe.event_key()).first()) == (0, 0)
    assert dedupe.keep_best(twice.limit(0), dedupe.event_key(), F.col("confidence"), ["event_id"]).count() == 0


def test_union_first_wins(spark):
    a, b = spark.createDataFrame([(1, "x"), (None, "n")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z"), (None, "m")], "k int, v string")
    assert {r.v for r in dedupe.union_first_wins(a, b, ["k"]).collect()} == {"x", "n", "z"}


def test_runs(spark):
    run = lambda rows: sorted(tuple(r) for r in islands.merge_runs(spark.createDataFrame(rows, "g string, a int, z int"), ["g"], "a", "z").collect())
    assert run([("1", 540, 635), ("1", 650, 745)]) == [("1", 540, 745, 2)]
    assert run([("1", 540, 635), ("2", 650, 745)]) == [("1", 540, 635, 1), ("2", 650, 745, 1)]
    assert run([("1", 540, 635), ("1", 656, 745)]) == [("1", 540, 635, 1), ("1", 656, 745, 1)]
    assert run([("1", 540, 800), ("1", 810, 900)]) == [("1", 540, 800, 1), ("1", 810, 900, 1)]
    assert run([(None, 0, 50), (None, 60, 120)]) == [(None, 0, 120, 2)]
    assert len(run([("1", 0, 50), ("1", 60, 120), ("1", 130, 200)])) == 1


def test_split_and_merge_are_inverse(events):
    rows = events({"end_time": "12:25"}, {"event_id": "2", "start_time": "13:30", "end_time": "16:35"}, {"event_id": "3", "start_time": "x"}, {"event_id": "4", "end_time": "12:26"})
    parts = islands.split_double(rows, F.lit(False))
    assert parts.count() == 6
    minutes = parts.where("start_time <> 'x'").selectExpr("event_id", "double_part", "int(substr(start_time, 1, 2)) * 60 + int(substr(start_time, 4, 2)) a", "int(substr(end_time, 1, 2)) * 60 + int(substr(end_time, 4, 2)) z")
    back = {(r.event_id, r.a, r.z, r.joined) for r in islands.merge_pairs(minutes, ["event_id"], "double_part", "a", "z").collect()}
    assert back == {("1", 540, 745, True), ("2", 810, 995, True), ("4", 540, 746, False)}


def test_fill_down_with_reset(spark):
    rows = spark.createDataFrame([("d", 0, "Mon", None), ("d", 1, None, "1.9"), ("d", 2, None, None), ("d", 3, "Tue", None), ("d", 4, None, None)], "doc string, row int, day string, date string")
    out = islands.fill_down(rows, ["doc"], ["row"], ["day", "date"], F.col("day").isNotNull()).orderBy("row").collect()
    assert [(r.day, r.date) for r in out] == [("Mon", None), ("Mon", "1.9"), ("Mon", "1.9"), ("Tue", None), ("Tue", None)]


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(3)
    make = lambda n: [(k, rnd.choice(["x", "y", None]), a := rnd.randrange(500), a + rnd.choice([0, 1, 5, 50, 400])) for k in range(n)]
    left, right = make(80), make(80)
    l = spark.createDataFrame(left, "i int, g string, a int, z int")  # noqa: E741
    r = spark.createDataFrame(right, "j int, g string, b int, y int")
    for closed in (False, True):
        got = sorted((x.i, x.j) for x in joins.overlapping(l, r, ["g"], ("a", "z", "b", "y"), 37, closed).collect())
        hit = (lambda a, z, b, y: a <= y and b <= z) if closed else (lambda a, z, b, y: a < y and b < z)
        assert got == sorted((i, j) for i, g, a, z in left for j, h, b, y in right if g == h and hit(a, z, b, y))


def test_active_counts(spark):
    d = lambda n: dt.date(2026, 1, 1) + dt.timedelta(n)
    intervals = spark.createDataFrame([("p", d(0), d(5)), ("p", d(5), d(5)), ("p", d(9), d(3)), ("p", None, d(4)), ("q", d(0), d(1))], "k string, f date, t date")
    points = spark.createDataFrame([("p", d(5)), ("p", d(6)), ("p", d(0)), ("q", d(2)), ("p", None), ("p", d(5))], "k string, day date")
    assert {(r.k, r.day, r.active) for r in joins.active_counts(points, intervals, ["k"], "day", "f", "t").collect()} == {("p", d(5), 2), ("p", d(6), 0), ("p", d(0), 1), ("q", d(2), 0)}


def test_next_after(spark):
    events = spark.createDataFrame([("g", 5, "b"), ("g", 5, "a"), ("g", 9, "c"), ("h", 1, "d")], "g string, at int, x string")
    probes = spark.createDataFrame([("g", 5), ("g", 4), ("g", 9), ("i", 1)], "g string, t int")
    assert {(r.g, r.t, r.next_start, r.next_x) for r in joins.next_after(probes, events, ["g"], "t", "at", "x").collect()} == {("g", 5, 9, "c"), ("g", 4, 5, "a"), ("g", 9, None, None), ("i", 1, None, None)}


def test_patches(spark):
    base, patch = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string"), spark.createDataFrame([(2, "B"), (None, "N")], "k int, v string")
    assert {r.v for r in joins.upsert(base, patch, ["k"]).collect()} == {"a", "B", "N"}
    fresh, old = spark.createDataFrame([(1, "new", "s")], "k int, v string, src string"), spark.createDataFrame([(1, "old", "f"), (2, "kept", "f"), (3, "gone", "s")], "k int, v string, src string")
    failed = spark.createDataFrame([("f",)], "src string")
    assert {r.v for r in joins.last_good(fresh, old, failed, "src", ["k"]).collect()} == {"new", "kept"}
    diff = joins.missing_and_extra(base, patch, ["k"]).collect()
    assert {(r.k, r.side) for r in diff} == {(1, "missing")}


def test_resolve_days(spark):
    weeks = spark.createDataFrame([(1, dt.date(2026, 9, 1), dt.date(2026, 9, 6)), (2, dt.date(2026, 9, 7), dt.date(2026, 9, 13))], "week_number int, from_date date, to_date date")
    blocks = spark.createDataFrame([("a", 1, 1), ("b", 1, 0), ("c", 2, 0), ("d", 9, 0), ("e", 2, None)], "id string, week_number int, weekday int")
    good, bad = joins.resolve_days(blocks, weeks)
    assert {(r.id, r.event_date.day) for r in good.collect()} == {("a", 1), ("c", 7)}
    assert {r.id for r in bad.collect()} == {"b", "d", "e"}


def _series(first, frequency, interval, weekdays, until):
    """The same rule by walking through the days."""
    days, cursor, n = [], first, 0
    while cursor <= until and n < 2000:
        gone = (cursor - first).days
        if frequency == "daily":
            take = gone % interval == 0
        elif frequency == "weekly":
            take = gone // 7 % interval == 0 and (cursor.isoweekday() % 7) in (weekdays or [first.isoweekday() % 7])
        elif frequency == "monthly":
            take = ((cursor.year - first.year) * 12 + cursor.month - first.month) % interval == 0 and cursor.day == first.day
        else:
            take = (cursor.year - first.year) % interval == 0 and (cursor.month, cursor.day) == (first.month, first.day)
        if take:
            days.append(cursor)
            n += 1
        if frequency in ("daily", "weekly"):
            cursor += dt.timedelta(1)
            continue
        step = 1 if frequency == "monthly" else 12
        month = cursor.month - 1 + step
        year, month = cursor.year + month // 12, month % 12 + 1
        last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)).day
        cursor = dt.date(year, month, min(cursor.day, last))
    return days


def test_recurrence_equals_enumeration(spark):
    cases = [(f, q, n, w) for f in (dt.date(2026, 1, 31), dt.date(2028, 2, 29), dt.date(2026, 10, 8), dt.date(2026, 2, 28)) for q in ("daily", "weekly", "monthly", "yearly") for n in (1, 2, 3) for w in ([], [4], [0, 3])]
    rows = [(k, f, q, n, w, f + dt.timedelta(800)) for k, (f, q, n, w) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "k int, f date, q string, n int, w array<int>, u date")
    got = frame.select("k", recurrence.occurrence_days(*[F.col(c) for c in "fqnwu"]).alias("days")).collect()
    for r in got:
        _, f, q, n, w, u = rows[r.k]
        assert r.days == _series(f, q, n, w, u), rows[r.k]


def test_expand_and_change_series(spark):
    at = dt.datetime(2026, 10, 8, 16, 0)
    series = spark.createDataFrame([("s", at, at + dt.timedelta(minutes=90), "Europe/Zurich", "weekly", 1, [4], dt.date(2026, 10, 29))], "series_id string, start_at timestamp, end_at timestamp, time_zone string, frequency string, repeat_interval int, weekdays array<int>, until_date date")
    rows = recurrence.expand(series)
    hours = [r[0] for r in rows.orderBy("occurrence_index").select(F.date_format("start_at", "dd HH:mm")).collect()]
    assert hours == ["08 16:00", "15 16:00", "22 16:00", "29 17:00"]  # the wall time stays, the clock goes back
    left = lambda kind, n: sorted(r.occurrence_index for r in recurrence.drop_occurrences(rows, "s", n, kind).collect())
    assert (left("single", 1), left("following", 2), left("series", 0)) == ([0, 2, 3], [0, 1], [])
    assert recurrence.change_occurrences(rows, "s", 1, "single", rows.where("occurrence_index = 1")).count() == 4
    assert recurrence.expand(series.withColumn("until_date", F.lit(dt.date(2026, 1, 1)))).count() == 0


def test_days_and_minutes(spark):
    a, z = F.to_timestamp(F.lit("2026-10-08 21:00")), F.to_timestamp(F.lit("2026-10-09 22:30"))
    row = spark.range(1).select(days_spanned(a, z, "Europe/Zurich"), minutes_between(a, z), minutes_between(z, a)).first()
    assert [d.day for d in row[0]] == [8, 9, 10]
    assert (row[1], row[2]) == (1530, 0)


def test_coverage_and_issues(spark, events):
    roster = spark.createDataFrame([("31.05.01", 1, "B", "123"), ("31.05.01", 1, "A", "110"), ("31.05.01", 1, "A", None)], "program_code string, course int, stream_code string, group_code string")
    rows = events({}, {"group_code": "ALL", "stream_code": None, "lesson_type": "lecture"}, {"subject": "", "event_date": None, "start_time": "12:00", "end_time": "11:00"}).withColumn("duration_minutes", F.lit(95))
    counts = {r.group_code: (r.lecture, r.practice, r.own_lecture, r.own_practice) for r in coverage.kinds_per_group(roster, rows).collect()}
    assert counts == {"123": (1, 2, 0, 2), "110": (1, 0, 0, 0)}
    status = {(r.level, r.group_code): r.status for r in coverage.coverage(roster, rows).collect()}
    assert (status["group", "123"], status["group", "110"], status["course", None]) == ("full", "partial", "partial")
    issues = {r.issue for r in coverage.issues(rows, "event_id", coverage.event_rules()).collect()}
    assert issues == {"no day", "ends before it starts", "no subject", "duration differs"}
    good, bad = coverage.split_good(rows, F.col("event_date").isNull())
    assert (good.count(), bad.count()) == (2, 1)
    assert {(r.column_name, r.blank_rows) for r in coverage.blanks(rows, ["subject", "teacher"]).collect()} == {("subject", 1), ("teacher", 0)}


def test_components_equal_union_find(spark):
    rnd = random.Random(5)
    edges = [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(40)] + [(f"p{k}", f"p{k + 1}") for k in range(50)] + [(None, "n1"), ("z", "z")]
    parent: dict[str, str] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


HTML = "<table><tr><th rowspan=2>День</th><th colspan='2'>Группы</th></tr><tr><td>401</td><td>402</td></tr><tr><td>Пн</td><td>A &amp; B<br>x<td>C</tr></table>"


def test_html_grid(spark):
    cells = {(r.row, r.col): r.text for r in grid.html_grid(spark.createDataFrame([("d", HTML), ("e", None), ("f", "no table")], "doc string, html string"), "doc", "html").collect()}
    assert cells == {(0, 0): "День", (1, 0): "День", (0, 1): "Группы", (0, 2): "Группы", (1, 1): "401", (1, 2): "402", (2, 0): "Пн", (2, 1): "A & B x", (2, 2): "C"}


def test_the_largest_table_and_tables_in_cells():
    assert grid.html_cells("<table><tr><td>a</table><table><tr><td>b<tr><td>c</table>") == [(0, 0, "b"), (1, 0, "c")]
    assert grid.html_cells("<table><tr><td>x<table><tr><td>in</table>y</td><td>z</tr><tr><td rowspan=9>w</table>") == [(0, 0, "xy"), (0, 1, "z"), (1, 0, "w")]
    assert grid.html_cells("<tr><td>1<tr><td>2") == [(0, 0, "1"), (1, 0, "2")]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("КПК, ауд. 101 Гистология", ("КПК, ауд. 101", "Гистология")),
        ("ЦДТИ Право", ("ЦДТИ", "Право")),
        ("ауд.4 Химия", ("ауд.4", "Химия")),
        ("каб 12 / зал «Малый» Этика", ("каб 12 / зал «Малый»", "Этика")),
        ("База практической подготовки", ("База практической подготовки", "")),
        ("НИИ, Ромашка Химия", ("НИИ, Ромашка", "Химия")),
        ("Базальные ядра", ("", "Базальные ядра")),
        ("Аудит и право", ("", "Аудит и право")),
    ],
)
def test_places(text, wanted):
    assert grid._after_place(text) == wanted


@pytest.mark.parametrize(
    ("cell", "wanted"),
    [
        ("Биология (2-4) КПК, ауд. 101 Гистология (5-8) ЦДТИ, ауд. 2", [("Биология", [2, 3, 4], "КПК, ауд. 101"), ("Гистология", [5, 6, 7, 8], "ЦДТИ, ауд. 2")]),
        ("Биология (2-4) КПК, ауд. 101 (5-8) КПК, ауд. 202", [("Биология", [2, 3, 4], "КПК, ауд. 101"), ("Биология", [5, 6, 7, 8], "КПК, ауд. 202")]),
        ("ЛРК, ауд. 5.20 Общая хирургия (14) База практической подготовки", [("Общая хирургия", [14], "ЛРК, ауд. 5.20; База практической подготовки")]),
        ("Химия", [("Химия", [], "")]),
        ("  ", []),
        (None, []),
    ],
)
def test_cells(cell, wanted):
    assert grid.cell_records(cell) == wanted


def _grid(spark, rows):
    return spark.createDataFrame([("d", r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row) if t], "doc string, row int, col int, text string")


def test_group_columns_and_rows(spark):
    by_column = _grid(spark, [["Расписание"], ["День", "Время", "401", "402"], ["Понедельник", "09:20-10:45", "Биология (2-4)", "Химия"], ["", "11:00-12:00", "", "Физика"]])
    assert {(r.group_code, r.weekday, r.clock, r.text) for r in grid.lessons_by_group_column(by_column).collect()} == {("401", 0, "09:20-10:45", "Биология (2-4)"), ("402", 0, "09:20-10:45", "Химия"), ("402", 0, "11:00-12:00", "Физика")}
    assert grid.header_rows(by_column).first().header_row == 1
    by_row = _grid(spark, [["Группа", "Пн", "Вт"], ["123", "Химия", "Физика"], ["124", "Право", ""]])
    assert {(r.group_code, r.weekday, r.text) for r in grid.lessons_by_group_row(by_row).collect()} == {("123", 0, "Химия"), ("123", 1, "Физика"), ("124", 0, "Право")}
    lessons = grid.split_cells(by_column.where("text LIKE 'Био%'").select("doc", "text"), "text").collect()
    assert [r.week_number for r in lessons] == [2, 3, 4]


def test_merges(spark):
    merges = spark.createDataFrame([("d", 0, 1, 0, 0), ("d", 0, 0, 1, 2)], "doc string, r0 int, r1 int, c0 int, c1 int")
    out = {(r.row, r.col): r.text for r in grid.expand_merges(_grid(spark, [["ПН", "Время"], ["", "x"]]), merges).collect()}
    assert out == {(0, 0): "ПН", (1, 0): "ПН", (0, 1): "Время", (0, 2): "Время", (1, 1): "x"}


def test_layout(spark):
    rows = spark.createDataFrame([(15, 8, 0, 0, 0.0), (0, 2, 5, 3, 0.0), (0, 0, 1, 1, 0.0), (0, 0, 0, 0, 1.0)], "weeks int, groups int, days int, clocks int, vector double")
    assert [r.layout for r in grid.layout(rows).collect()] == ["weekly-matrix", "daily-grid", "daily-list", "unknown"]


def test_geometry(spark):
    words = spark.createDataFrame([("d", 1, 10.0, 100.0, "a"), ("d", 1, 30.0, 102.0, "b"), ("d", 1, 5.0, 104.0, "c"), ("d", 1, 200.0, 100.0, "z")], "doc string, page int, x double, y double, text string")
    assert [r.text for r in geometry.lines(words).orderBy("line").collect()] == ["a b z", "c"]
    columns = spark.createDataFrame([("d", "1", 10.0), ("d", "2", 40.0)], "doc string, name string, x double")
    assert {(r.text, r.column_name) for r in geometry.to_columns(words, columns).collect()} == {("a", "1"), ("c", "1"), ("b", "2")}
    values = F.array(*[F.lit(v) for v in (1.0, 2.0, 10.0, 3.2, 11.0)])
    row = spark.range(1).select(geometry.running_clusters(values, 2.5), geometry.upper_median(values), geometry.running_clusters(F.array().cast("array<double>"), 1.0)).first()
    assert (row[0], row[1], row[2]) == ([pytest.approx(2.066667), 10.5], 3.2, [])
    numbers = spark.createDataFrame([("d", 1, float(20 * k), 50.0 + k % 2, str(k)) for k in range(1, 11)] + [("d", 1, 5.0, 90.0, "3")], "doc string, page int, x double, y double, text string")
    band = geometry.week_bands(numbers).first()
    assert (band.band, band.weeks) == (50.0, 10)
    cells = spark.createDataFrame([("d", 1, 0.0, 25.0), ("d", 2, 10.0, 10.5)], "doc string, cell int, x0 double, x1 double")
    bands = spark.createDataFrame([("d", 1, 0.0, 10.0), ("d", 2, 10.0, 20.0), ("d", 3, 24.5, 40.0)], "doc string, week_number int, a double, b double")
    assert {(r.cell, r.week_number) for r in geometry.weeks_of_cells(cells, bands).collect()} == {(1, 1), (1, 2)}


def test_documents(spark):
    from chronoweave.operators import documents as docs

    page = "<h2>Лечебное дело</h2><a href='/files/4k_ld_b.pdf#x'>Расписание занятий семинарского типа, поток А</a><a href='/files/4k_ld_b.pdf'>again</a><h3>Прочее</h3><a href='kug.pdf'>КУГ педиатрия</a><a>none</a>"
    found = docs.links(spark.createDataFrame([("https://h/p/", page), ("https://h/q/", None)], "page string, html string"), "page", "html")
    assert {(r.url, r.heading) for r in found.collect()} == {("https://h/files/4k_ld_b.pdf", "Лечебное дело"), ("https://h/p/kug.pdf", "Прочее")}
    (row,) = docs.timetable_links(found).collect()
    assert (row.program, row.course_number, row.stream, row.kind, row.mismatch) == ("31.05.01", 4, "A", "practice", True)  # the heading goes first
    fallback = spark.createDataFrame([("p", 1, "f1"), ("p", 2, "f2")], "program string, course int, url string")
    candidates = spark.createDataFrame([("p", 1, "old", -1), ("p", 1, "new", 1), ("p", 2, "old", -1)], "program string, course int, url string, points int")
    best = docs.best_or_fallback(candidates, fallback, ["program", "course"], F.col("points"), ["url"])
    assert {(r.course, r.url, r.origin) for r in best.collect()} == {(1, "new", "found"), (2, "f2", "fallback")}
    attempts = spark.createDataFrame([("a", 1, "pdf", 0, 0), ("a", 2, "xlsx", 2, 3), ("a", 3, "html", 2, 3)], "doc string, attempt_no int, parser string, events int, warnings int")
    assert docs.best_attempt(attempts, ["doc"]).first().parser == "xlsx"


def test_listed_lessons(spark):
    from chronoweave.operators import documents as docs

    rows = spark.createDataFrame([("d", k, t) for k, t in enumerate(["Поток А", "Понедельник", "9:00 – 10:35 Биология", "КПК, ауд. 101", "10:50-12:25", "Химия", "Вт", "9:00-10:35 Физика"])], "doc string, line int, text string")
    got = [(r.weekday, r.clock, r.text) for r in docs.listed_lessons(rows).orderBy("line").collect()]
    assert got == [(0, "9:00 – 10:35", "Биология КПК, ауд. 101"), (0, "10:50-12:25", "Химия"), (1, "9:00-10:35", "Физика")]
    assert docs.preview(rows, 2).first().text == "Поток А\nПонедельник"
    clocks = spark.createDataFrame([("9:00-10:35 9:20-10:55", "Солнечное"), ("9:00-10:35 9:20-10:55", "КПК"), ("9:00-10:35", "КПК"), ("", "КПК")], "t string, p string")
    assert [r[0] for r in clocks.select(docs.clock_for_place(F.col("t"), F.col("p"))).collect()] == ["9:00-10:35", "9:20-10:55", "9:00-10:35", None]
    parts = spark.createDataFrame([("ЛРК, ауд. 5.20 Общая хирургия",), (None,), ("Химия",)], "t string").select(docs.split_leading_place("t").alias("s")).collect()
    assert [tuple(r.s) for r in parts] == [("ЛРК, ауд. 5.20", "Общая хирургия"), (None, None), ("", "Химия")]
    assert spark.range(1).select(docs.repaired(F.lit("Эндокрино логия"), {"эндокрино логия": "Эндокринология"})).first()[0] == "Эндокринология"
