"""Text read in a wrong encoding."""

from __future__ import annotations

import pytest

from chronoweave.llm.mojibake import garbled, garbled_forms, restore, restored

CLEAN = ["Методист опубликовал порядок пересдачи в понедельник.", "Лаборант проверил доступ к файлу, связь слабая.", "The planner’s cache was stale at 37 °C.", "Кафедра перенесла лекцию на неделю."]
FOREIGN = ["Les élèves, salle Â22. À l’accueil, dès 26.01.", "Nemendur þurfa að skila. Ðað er prentvilla.", "Ғылыми үйірме жаңа кестемен жұмыс істейді.", "Ђаци предају извештај.", "A REUNIÃO NÃO SERÁ NA SALA 13. Atenção.", "пОСЛЕ ОБНОВЛЕНИЯ", "ghbdtn руддщ", "??????? что?", "课程表 😀 é"]


def spoil(text, stored, read, errors="strict"):
    return text.encode(stored).decode(read, errors)


SPOILT = {
    "utf-8>cp1251": spoil(CLEAN[0], "utf-8", "cp1251"),
    "utf-8>latin-1": spoil(CLEAN[1], "utf-8", "latin-1"),
    "cp1251>latin-1": spoil(CLEAN[1], "cp1251", "latin-1"),
    "koi8-r>cp1251": "Методист опубликовал " + spoil("порядок пересдачи в понедельник", "koi8-r", "cp1251"),
    "cp866>cp1251": spoil(CLEAN[3], "cp866", "cp1251", "replace"),
    "cp1251>mac": spoil(CLEAN[1], "cp1251", "mac-cyrillic"),
    "lost": spoil(CLEAN[2], "utf-8", "cp1252", "replace"),
    "twice": spoil(spoil(CLEAN[3], "utf-8", "cp1251", "ignore"), "utf-8", "cp1251", "ignore"),
    "a single sign": CLEAN[2].replace("’", spoil("’", "utf-8", "cp1251")),
}


@pytest.fixture(scope="module")
def docs(spark):
    texts = CLEAN * 4 + FOREIGN + list(SPOILT.values()) + [None, "", "   ", "x" * 100_000]
    return spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, chain string"), len(CLEAN) * 4 + len(FOREIGN)


def test_found(docs):
    frame, first = docs
    found, hits = garbled(frame, "doc_id", "text")
    assert {r.doc for r in found.collect()} == set(range(first, first + len(SPOILT)))
    assert hits.count() > len(SPOILT)
    assert garbled(frame.limit(0), "doc_id", "text")[0].count() == 0


def test_restored(docs):
    frame, first = docs
    got = {r.doc_id: r.restored for r in restored(frame, "doc_id", "text").collect()}
    names = list(SPOILT)
    whole = {"utf-8>cp1251": CLEAN[0], "utf-8>latin-1": CLEAN[1], "cp1251>latin-1": CLEAN[1], "koi8-r>cp1251": CLEAN[0].rstrip("."), "cp1251>mac": CLEAN[1], "lost": CLEAN[2], "a single sign": CLEAN[2]}
    assert {n: got[first + names.index(n)] for n in whole} == whole


def test_caps_and_layout_are_no_cases(spark):
    # A garbled text in capitals looks like small letters, whose garbled form is the caps lock text of others.
    caps = ["пРЕПОДАВАТЕЛЬ сТАРШАЯ", "пРЕПОДАВАТЕЛЬ ytltkю сТАРШАЯ", "ytltkю"]
    twins = [spoil("пРЕПОДАВАТЕЛЬ", "cp1251", "koi8-r"), spoil("сТАРШАЯ", "cp1251", "koi8-r"), "ytltkþ"]
    frame = spark.createDataFrame(list(enumerate(caps + twins)), "doc_id long, text string")
    assert not {0, 1, 2} & {r.doc for r in garbled(frame, "doc_id", "text")[0].collect()}


def test_forms():
    forms = dict(garbled_forms("тема"))
    assert forms["ÔÅÍÁ"] == "koi8-r>cp1252"
    assert forms["òåìà"] == "cp1251>cp1252"
    assert forms["С‚РµРјР°"] == "utf-8>cp1251"
    assert "тема" not in forms
    assert {"Р�", "Р?", "Р"} <= {f for f, _ in garbled_forms("И")}  # the byte that cp1251 lacks


def test_clean_words_stay():
    assert restore("Кнопка «Сегодня» ПФДЕМ работает", {"ПФДЕМ": "отдел"}, "koi8-r>cp1251") == "Кнопка «Сегодня» отдел работает"
