"""Golden values of the text and time functions."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import clock, temporal, text


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (text.clean_subject, "  Химия  * ", "Химия"),
        (text.clean_subject, "Лекция Химия - семинар", "Химия"),
        (text.clean_subject, "дисциплина: Практикум", "Практикум"),
        (text.clean_teacher, "доцент:  Иванов И.И.", "Иванов И.И."),
        (text.clean_teacher, "Иванов ;Петров", "Иванов, Петров"),
        (text.clean_location, "ауд 3.17/3.18", "ауд. 3.17 / 3.18"),
        (text.clean_location, "ЦДТИ, ауд. 4.2.11", "ЦДТИ,ауд. 4.2.11"),
        (text.clean_text, " a​\r\n b\t", "a b"),
        (text.stream_code, "Поток Б", "B"),
        (text.stream_code, "А", "A"),
        (text.stream_code, "C", None),
        (text.group_code, "Группа 101 а", "101А"),
        (text.group_list, "101-103", ["101", "102", "103"]),
        (text.group_list, "150, 160К; 101К-102К", ["150", "160К", "101К", "102К"]),
        (text.group_list, None, []),
        (text.half_code, "1/2", "1/2"),
        (text.half_code, "знаменатель", "2/2"),
        (text.course_number, "курс 4", 4),
        (text.course_number, "41", None),
        (text.week_list, "нед. 2-4, 7", [2, 3, 4, 7]),
        (text.week_list, "1/2", []),
        (text.week_list, "2/2", []),
        (text.week_list, "50-60", [50, 51, 52]),
        (text.week_list, None, []),
        (text.page_address, "http://a/b#c", "http://a/b"),
        (text.redacted, "see https://x.y/z token=abc", "see [url] token=[redacted]"),
        (text.ics_text, "a,b;c\nd", "a\\,b\\;c\\nd"),
        (temporal.read_date, "2026-02-30", None),
        (temporal.read_date, "1.2.2026", dt.date(2026, 2, 1)),
        (temporal.read_date, "bad", None),
        (temporal.read_clock, "9:00", "09:00"),
        (temporal.read_clock, "09.20", "09:20"),
        (temporal.read_clock, "33:99", None),
        (clock.seconds_of_day, " 08:30:00", 30600),
        (clock.seconds_of_day, "8.30", 30600),
        (clock.seconds_of_day, "24:00", None),
        (clock.clock_identity, "x", "?x"),
    ],
)
def test_values(one, f, given, wanted):
    assert one(f, given) == wanted


def test_clock_ranges(one):
    assert tuple(one(temporal.read_clock_range, "09:00 – 10:35")) == ("09:00", "10:35")
    assert tuple(one(temporal.read_clock_range, "9.00 до 10.35")) == ("09:00", "10:35")
    assert one(temporal.read_clock_range, "9.00 10.35") is None
    assert one(temporal.read_clock_range, "10:35-09:00") is None
    assert one(temporal.read_clock_range, None) is None


def test_kinds(spark):
    rows = spark.createDataFrame([("", "Лекция по химии"), ("lab", "x"), (None, "зачет"), ("практика", ""), (None, None)], "a string, b string")
    assert [r[0] for r in rows.select(text.lesson_kind(F.col("a"), F.col("b"))).collect()] == ["lecture", "lab", "assessment", "practice", "other"]


def test_weeks_and_days(spark):
    d = F.lit(dt.date(2026, 10, 6))
    row = spark.range(1).select(temporal.monday_of(d), temporal.week_number(d), temporal.monday_of_week(F.lit(6)), temporal.day_in_week(F.lit(dt.date(2026, 9, 1)), F.lit(dt.date(2026, 9, 6)), F.lit(0))).first()
    assert tuple(row) == (dt.date(2026, 10, 5), 6, dt.date(2026, 10, 5), None)
    views = spark.range(1).select(*[F.size(temporal.view_days(d, v)) for v in ("day", "workweek", "week", "month")]).first()
    assert tuple(views) == (1, 6, 7, 35)
    with pytest.raises(ValueError, match="no such view"):
        temporal.view_days(d, "decade")


@pytest.mark.parametrize(("local", "zone", "utc"), [("2026-07-01 10:00", "Europe/Zurich", "2026-07-01 08:00"), ("2026-01-15 10:00", "Europe/Zurich", "2026-01-15 09:00"), ("2026-10-08 18:00", "America/New_York", "2026-10-08 22:00")])
def test_zones(spark, local, zone, utc):
    out = spark.range(1).select(F.date_format(temporal.local_to_instant(F.to_timestamp(F.lit(local)), zone), "yyyy-MM-dd HH:mm")).first()[0]
    assert out == utc


def test_lesson_parts(spark):
    parts = lambda a, z, whole=False: [tuple(p) for p in spark.range(1).select(temporal.lesson_parts(F.lit(a), F.lit(z), F.lit(whole))).first()[0]]
    assert parts(540, 745) == [(1, 540, 635), (2, 650, 745)]
    assert parts(540, 746) == [(None, 540, 746)]
    assert parts(540, 745, True) == [(None, 540, 745)]


def test_palette_is_stable(one):
    a = one(lambda c: text.palette_index(c), "химия")
    assert a == one(lambda c: text.palette_index(c), "химия")
    assert 0 <= a < 8


def test_countdown_and_mentions(spark):
    assert [r[0] for r in spark.createDataFrame([(1500,), (61,), (5,)], "m int").select(temporal.countdown(F.col("m"))).collect()] == ["1 д 1 ч", "1 ч 1 мин", "5 мин"]
    row = spark.range(1).select(text.mentions(" ХИМИЯ ", F.lit("Общая химия"), F.lit(None)), text.mentions("", F.lit("x")), text.mentions("100%", F.lit("100 x"))).first()
    assert tuple(row) == (True, True, False)
