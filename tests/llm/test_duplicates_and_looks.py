"""Copies by formatting, and look-alike characters."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter

import pytest

from chronoweave.llm.duplicates import copies, distinct_records
from chronoweave.llm.lookalikes import canonical_values, odd_rows, one_form

COPY = "raw_id long, kind string, a string, b string, c string, rep string"


def _bare(text):
    if text is None:
        return None
    low, out = text.lower(), []
    for k, c in enumerate(low):
        if c.isspace() or unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cc") or c in "\u200b\u2060\ufeff":
            continue
        sign = unicodedata.category(c).startswith("P") or c in "$+<=>^`|~"
        between = 0 < k < len(low) - 1 and low[k - 1].isdigit() and low[k + 1].isdigit()
        if not sign or between:
            out.append(c)
    return "".join(out)


def _groups(rows):
    out = {}
    for r in rows:
        if r[0] is not None:
            out.setdefault((r[1], tuple(sorted(map(repr, map(_bare, r[2:5]))))), set()).add(r[0])
    return {n: min(g) for g in out.values() for n in g}


def test_copies_equal_brute_force(spark):
    rnd = random.Random(1)
    words = ["Химия, часть 1", "химия часть 1", "ХИМИЯ,\r\nчасть 1…", "Химия, часть 2", "ауд. 4.11", "ауд 4.11", "ауд. 41.1", "«Ауд.  4.11»", "", "—", None, "Иванов И.И.", "иванов и и", "a/b", "1.2.3", "12.3"]
    rows = [(n if rnd.random() > 0.02 else None, rnd.choice(["x", None]), *rnd.choices(words, k=3), "clash") for n in range(1500)]
    rows += [(2000 + n, "hot", "Одно " + "!" * (n % 5), "и", None, "") for n in range(1500)]  # half of all rows are copies of one
    rows += rows[:30]  # rows that are there twice
    frame = spark.createDataFrame(rows, COPY).repartition(6)
    got = copies(frame, "raw_id", ["kind"], ["a", "b", "c"])
    pairs = [(r.id, r.rep) for r in got.collect()]
    assert len(pairs) == len(set(pairs))
    assert dict(pairs) == _groups(rows)
    counts = {r.rep: r.copies for r in distinct_records(frame, "raw_id", ["kind"], ["a", "b", "c"]).collect()}
    assert counts == Counter(_groups(rows).values())


def test_runs_over_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(n, "x", "same", None, None, "") for n in range(5000)] + [(9000 + n, "x", f"w{n}", None, None, "") for n in range(50)]
        out = copies(spark.createDataFrame(rows, COPY).repartition(8), "raw_id", ["kind"], ["a", "b", "c"])
        assert {(r.id, r.rep) for r in out.collect()} == {(n, 0) for n in range(5000)} | {(9000 + n, 9000 + n) for n in range(50)}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("parts", ["4", "16", "64"])
def test_rows_and_borders_are_of_one_partitioning(spark, parts):
    settings = {"spark.sql.exchange.reuse": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": parts}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = [(n, "x", f"слово {n // 7}", None, None, "") for n in range(3000)]
        out = copies(spark.createDataFrame(rows, COPY).repartition(5), "raw_id", ["kind"], ["a", "b", "c"])
        assert {(r.id, r.rep) for r in out.collect()} == {(n, n // 7 * 7) for n in range(3000)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_values_do_not_run_into_each_other(spark):
    rows = [(1, "x\u0001|=y", "a", None, None, ""), (2, "x", "a", None, None, ""), (3, "x\u0001", "a", None, None, ""), (4, "x\u0001\u0001", "a", None, None, "")]
    out = copies(spark.createDataFrame(rows, COPY), "raw_id", ["kind"], ["a", "b", "c"])
    assert {(r.id, r.rep) for r in out.collect()} == {(n, n) for n in (1, 2, 3, 4)}


def test_no_copies(spark):
    assert copies(spark.createDataFrame([], COPY), "raw_id", ["kind"], ["a", "b", "c"]).count() == 0
    long = spark.createDataFrame([(1, "x", "слово " * 200_000, None, None, ""), (2, "x", "СЛОВО, " * 200_000, None, None, "")], COPY)
    assert {(r.id, r.rep) for r in copies(long, "raw_id", ["kind"], ["a", "b", "c"]).collect()} == {(1, 1), (2, 1)}


LOOKS = "event_id string, subject string, field string"
PLAIN = ["Химия и КТ", "Химия (ECMO)", "Учёт и отчёт", "Йод № 5", "ауд. 4.28В", "химия  и  КТ", "Учет"]
ODD = {
    "Хими\u200bя и КТ": "Химия и КТ",
    "Xимия и KT": "Химия и КТ",
    "Химия (ЕСМО)": "Химия (ECMO)",
    "Уче\u0308т и отче\u0308т": "Учёт и отчёт",
    "И\u0306од № 5": "Йод № 5",
    "Йод № \uff15": "Йод № 5",
    "Химия\u00a0и КТ": "Химия и КТ",
    "ауд. 4.28B": "ауд. 4.28В",
    "\u03a7имия и КТ": "Химия и КТ",
    "\uff25\uff23\uff2d\uff2f": "ECMO",
    "\U0001d400": "А",
    "ХИMИЯ": "ХИМИЯ",
    "\u2060": "",
}


def test_canonical_forms(spark):
    rows = [(f"p{k}", v, "x") for k, v in enumerate(PLAIN * 5)] + [(f"o{k}", v, "x") for k, v in enumerate(ODD)] + [("n", None, "x"), ("e", "", "x"), ("a", "А", "x"), ("a2", "А", "x")]
    frame = spark.createDataFrame(rows, LOOKS)
    got = {r.value: r.canonical for r in canonical_values(frame, ["subject"]).collect()}
    assert got == ODD
    assert {r.event_id for r in odd_rows(frame, "event_id", ["subject"]).collect()} == {f"o{k}" for k in range(len(ODD))}
    whole = one_form(frame, ["subject"])
    assert whole.count() == len(rows)
    assert canonical_values(whole, ["subject"]).count() == 0
    assert canonical_values(frame.limit(0), ["subject"]).count() == 0


def test_a_field_keeps_its_own_script(spark):
    frame = spark.createDataFrame([("A", "А")] * 9 + [("А", "A")], "stream_code string, location_text string")
    got = {(r.field, r.value): r.canonical for r in canonical_values(frame, ["stream_code", "location_text"]).collect()}
    assert got == {("stream_code", "А"): "A", ("location_text", "A"): "А"}


def test_very_long_value(spark):
    long = "Химия и " * 20_000
    frame = spark.createDataFrame([("1", long + "KT"), ("2", "КТ"), ("3", "КТ")], "event_id string, subject string")
    (row,) = canonical_values(frame, ["subject"]).collect()
    assert row.canonical == long + "КТ"
    assert re.fullmatch(r"[А-Яа-я ]+", row.canonical)
