"""Names: parsing, the segment join against all pairs, and linking."""

from __future__ import annotations

import random

import pytest

from chronoweave.llm.names import EDITS, near_names, parse_name, people


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Фирсупайева Людмила Эдуардовна", ("фирсупайева", "л", "э")),
        ("Людммила Эдуардовна Фирсупайева", ("фирсупайева", "л", "э")),
        ("проф. фирсупайева люда", ("фирсупайева", "л", "")),
        ("Велмивертева, Екатерина Але.", ("велмивертева", "е", "а")),
        ("ЗЛАТИТОЛЕВ Г.Л.", ("златитолев", "г", "л")),
        ("Д.Г. Пелгаланенко", ("пелгаланенко", "д", "г")),
        ("к.м.н.СаврефроваТ.М.", ("саврефрова", "т", "м")),
        ("ст.преп.СавривертенкоК.И.", ("савривертенко", "к", "и")),
        ("д.м.н., проф. Гордегоров Ваня", ("гордегоров", "и", "")),
        ("доцент: Д.А. Чембупайов", ("чембупайов", "д", "а")),
        ("Рая Пелгошекева", ("пелгошекева", "р", "")),
        ("Фёдор Леонидович Росымин", ("росымин", "ф", "л")),
        ("доц Петров ИИ", ("петров", "и", "и")),
        ("к.м.н. Юрядимева Ира", ("юрядимева", "и", "")),
        ("ГОРДЕГОРОВ", ("гордегоров", "", "")),
        (None, None),
        ("", None),
        ("—", None),
        ("вакансия", None),
        ("по назначению", None),
        ("преподаватель кафедры", None),
    ],
)
def test_parsing(text, wanted):
    assert parse_name(text) == wanted


def _edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_segment_join_finds_all_pairs(spark):
    rnd = random.Random(7)

    def typo(name):
        letters = list(name)
        for _ in range(rnd.randrange(EDITS + 2)):
            k = rnd.randrange(len(letters) + 1)
            rnd.choice([lambda: letters.insert(k, rnd.choice("абвг")), lambda: letters.pop(min(k, len(letters) - 1)), lambda: letters.__setitem__(min(k, len(letters) - 1), rnd.choice("абвг"))])()
            letters = letters or ["а"]
        return "".join(letters)

    base = ["".join(rnd.choices("абвг", k=rnd.randrange(3, 14))) for _ in range(25)]
    names = sorted({typo(n) for n in base for _ in range(6)})
    frame = spark.createDataFrame([(b, n) for n in names for b in ("x", "y")], "owner string, surname string")
    allowed = lambda a, b: min(EDITS, min(len(a), len(b)) // 3)
    wanted = {(b, m, n, _edits(m, n)) for b in ("x", "y") for m in names for n in names if m != n and _edits(m, n) <= allowed(m, n)}
    got = [tuple(r) for r in near_names(frame).collect()]
    assert len(got) == len(set(got))
    assert set(got) == wanted


RULE = "rule_id long, chair string, teacher string, person string"


def _linked(spark, rows):
    out = {}
    for r in people(spark.createDataFrame([(*r, "clash") for r in rows], RULE), "rule_id", "chair", "teacher").collect():
        out.setdefault(r.person, set()).add(r.rule_id)
    return sorted(map(sorted, out.values()))


def test_linking(spark):
    a = ["Фирсупайева Людмила Эдуардовна", "Л.Э. Фирсяупайева", "фирсупайева л.э.", "проф. Люда Фирсупайева", "Фирсупайева", "Фирсупайева Л.Э."]
    rows = [(k, "c1", t) for k, t in enumerate(a)]
    rows += [(10, "c1", "Чембонцов А.Н."), (11, "c1", "Чембонцова И.В."), (12, "c1", "Чембонцов"), (13, "c1", "Чембонцова Ира")]  # nearly equal surnames
    rows += [(20, "c2", "Фирсупайева Л.Э."), (21, None, "Фирсупайева Л.Э."), (22, "c1", None), (23, "c1", ""), (24, "c1", "вакансия"), (None, "c1", "Фирсупайева Л.Э.")]
    rows += [(30, "c3", "Савривертова Р. С."), (31, "c3", "Савривертова Л. О."), (32, "c3", "Савривертова")]  # equal surnames: the bare one stays alone
    assert _linked(spark, rows) == [[0, 1, 2, 3, 4, 5], [10, 12], [11, 13], [20], [30], [31], [32]]
    assert _linked(spark, []) == []


def test_a_hot_chair(spark):
    rows = [(k, "hot", "Росчаресина Ю.П.") for k in range(500)] + [(1000 + k, "hot", f"{'Бвгджз'[k % 6]}{'абвгдежз'[k // 6]}лмивертева Е.А.") for k in range(30)]
    assert _linked(spark, rows)[0] == list(range(500))
