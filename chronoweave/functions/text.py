"""Cleaning and reading of texts typed by people: subjects, teachers, places, groups, streams, weeks.

All are column expressions. Word boundaries are spelled out with letters and digits of any script, and letter case is
ignored for any script, so that Cyrillic words are treated like Latin ones. Null in, null out, unless said otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The edge of a word in any script.
HEAD, TAIL = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
# Dashes read as a hyphen.
_DASH = "[–—−]"
# Kinds of lessons that people write into a subject, and titles they write before a teacher.
_KINDS = "лекция|практическое занятие|практика|пз|лабораторная работа|лабораторная|семинарское занятие|семинар"
_TITLES = r"старший преподаватель|преподаватель|преп\.|доцент|профессор|ассистент"
# Names of the groups that stand for everybody.
EVERYBODY = ("ALL", "*", "ОБЩИЕ", "ОБЩАЯ", "ВСЕ")


def _sub(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, pattern, by)


def clean_text(text: Column) -> Column:
    """One space for any run of blanks (no-break ones and line ends included), none at the ends, no zero-width characters."""
    text = _sub(text, r"[\x{200B}-\x{200D}\x{FEFF}]")
    return F.trim(_sub(text, r"[\s\x{A0}]+", " "))


def clean_subject(text: Column) -> Column:
    """A subject without the kind of lesson, a leading label, trailing asterisks and signs at its ends."""
    text = _sub(clean_text(text), _DASH, "-")
    text = _sub(text, r"\s*\*+\s*$")
    text = _sub(text, r"(?iu)^дисциплина\s*[:.-]?\s*")
    text = _sub(text, rf"(?iu){HEAD}(?:{_KINDS}){TAIL}", " ")
    text = _sub(_sub(text, r"\s+([,.;:])", "$1"), r"\s{2,}", " ")
    return F.trim(_sub(text, r"^[ ,.;:|/\-]+|[ ,.;:|/\-]+$"))


def clean_teacher(text: Column) -> Column:
    """A teacher's name without a leading title; lists are separated by a comma and a space."""
    text = _sub(clean_text(text), rf"(?iu)^(?:{_TITLES})\s*:?\s*")
    return F.trim(_sub(_sub(text, r"\s*[,;|]+\s*", ", "), r"\s+", " "))


def clean_location(text: Column) -> Column:
    """A place with ``ауд.`` and ``лит.`` in one form and slashes between blanks. The blank before ``ауд`` goes with it."""
    text = _first(clean_text(text), r"(?:^|\s)ауд(?:итория)?\.?\s*", "ауд. ")
    text = _sub(_sub(text, r"\s*,\s*,+", ","), r"\s*/\s*", " / ")
    return _first(text, rf"{HEAD}лит\.?\s*", "лит. ")


def without_footer(text: Column) -> Column:
    """A place without the signature line that follows it at the foot of a page, and without signs at its ends."""
    text = F.regexp_replace(clean_text(text), rf"(?iu){HEAD}Заведующий\s+Отделом\s+организации\s+учебного\s+процесса{TAIL}.*$", "")
    text = _sub(_sub(text, r"\"?_+\"?\s*\d{4}\s*г\.?$"), r"\s*,\s*", ", ")
    return _sub(text, "^[ ,/;]+|[ ,/;]+$")


def _first(text: Column, pattern: str, by: str) -> Column:
    """Replace the first match only."""
    return F.regexp_replace(text, rf"(?isu)^(.*?){pattern}", f"$1{by}")


def group_code(text: Column) -> Column:
    """A group's code in capitals without blanks and the word for group."""
    return _sub(F.upper(_sub(clean_text(text), r"(?iu)^(?:учебная\s+)?группа\s*")), r"\s+")


def is_everybody(group: Column) -> Column:
    """Whether a group code stands for all groups."""
    return group_code(group).isin(*EVERYBODY)


def group_list(text: Column) -> Column:
    """The codes of a list such as ``101-103, 205К``; a range of more than 200 groups stays one text. Null gives an empty list."""
    parts = F.filter(F.transform(F.split(_sub(clean_text(text), _DASH, "-"), r"[,;/|]+"), lambda p: F.trim(p)), lambda p: p != "")
    ends = r"(?iu)^(\d{3,4})([А-ЯA-Z]{0,3})\s*-\s*(\d{3,4})([А-ЯA-Z]{0,3})$"
    token = r"(?iu)(?<![0-9А-ЯA-Z])[0-9]{3,4}[А-ЯA-Z]{0,3}(?![0-9А-ЯA-Z])"

    def of(part: Column) -> Column:
        low, high = (F.regexp_extract(part, ends, k).cast("int") for k in (1, 3))
        a, b = (F.upper(F.regexp_extract(part, ends, k)) for k in (2, 4))
        suffix = F.when(a == b, a).otherwise(F.lit(""))
        spread = F.transform(F.sequence(low, F.greatest(low, high)), lambda n: F.concat(n.cast("string"), suffix))
        plain = F.transform(F.regexp_extract_all(part, F.lit(token), F.lit(0)), group_code)
        return F.when(part.rlike(ends), F.when((low <= high) & (high - low <= 200), spread).otherwise(F.array(group_code(part)))).otherwise(plain)

    return F.coalesce(F.array_distinct(F.flatten(F.transform(parts, of))), F.array().cast("array<string>"))


def stream_code(text: Column) -> Column:
    """``A`` or ``B`` of a stream written in either script, with or without the word; else null."""
    plain = F.translate(F.upper(clean_text(text)), "ЁАБ", "ЕAB")
    named = lambda x: plain.rlike(rf"^(?:ПОТОК\s*)?{x}$|ПОТОК\s*{x}")
    return F.when(named("A"), "A").when(named("B"), "B")


def half_code(text: Column) -> Column:
    """``1/2`` or ``2/2`` (numerator and denominator weeks), else null."""
    low = F.lower(clean_text(text))
    return F.when(low.rlike(r"1\s*/\s*2|числител"), "1/2").when(low.rlike(r"2\s*/\s*2|знаменател"), "2/2")


def course_number(text: Column) -> Column:
    """The first number from 1 to 6 that stands alone, else null."""
    return F.nullif(F.regexp_extract(clean_text(text), rf"{HEAD}([1-6]){TAIL}", 1), F.lit("")).cast("int")


def lesson_kind(kind: Column, subject: Column) -> Column:
    """lecture, lab, assessment, practice or other, by the first of these that the kind or the subject names."""
    low = F.lower(F.concat_ws(" ", clean_text(kind), clean_text(subject)))
    word = lambda w: rf"{HEAD}(?:{w}){TAIL}"
    return (
        F.when(low.rlike(f"лекц|{word('lecture|lem')}"), "lecture")
        .when(low.rlike(f"лаб|{word('lab|laboratory')}"), "lab")
        .when(low.rlike(f"экзам|зач[её]т|аттест|контрол|коллоквиум|дифференц|{word('exam|assessment')}"), "assessment")
        .when(low.rlike(f"пз|практи|семинар|{word('practice|seminar')}"), "practice")
        .otherwise("other")
    )


def week_list(text: Column) -> Column:
    """The weeks of a text such as ``нед. 2-4, 7``, from 1 to 52, in order, each once; halves (1/2) are no weeks. Null gives an empty list."""
    plain = _sub(_sub(clean_text(text), _DASH, "-"), rf"{HEAD}[12]\s*/\s*2{TAIL}", " ")
    span = rf"{HEAD}(\d{{1,2}})\s*-\s*(\d{{1,2}}){TAIL}"
    lows, highs = (F.regexp_extract_all(plain, F.lit(span), F.lit(k)).cast("array<int>") for k in (1, 2))
    spans = F.flatten(F.zip_with(lows, highs, lambda a, b: F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array(a, b))))
    single = F.regexp_extract_all(plain, F.lit(rf"{HEAD}\d{{1,2}}{TAIL}"), F.lit(0)).cast("array<int>")
    weeks = F.filter(F.array_sort(F.array_distinct(F.concat(spans, single))), lambda n: (n >= 1) & (n <= 52))
    return F.coalesce(weeks, F.array().cast("array<int>"))


def redacted(text: Column, most: int = 500) -> Column:
    """Without addresses and secrets, cut at a length: for logs."""
    text = _sub(text, r"(?i)https?://\S+", "[url]")
    text = _sub(text, r"(?i)(token|secret|password|key|auth)\s*[=:]\s*\S+", "$1=[redacted]")
    return F.substring(text, 1, most)


def page_address(url: Column) -> Column:
    """An address without its fragment."""
    return _sub(url, "(?s)#.*$")


def short_id(*parts: Column, digits: int = 14) -> Column:
    """The first hexadecimal digits of the SHA-1 of parts joined by bars; nulls count as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, digits)


def palette_index(text: Column, colours: int = 8, seed: int = 0) -> Column:
    """A stable colour for a text: a 31-fold rolling hash of its characters in 32 bits, modulo the palette."""
    codes = F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.ascii(c)))
    return F.pmod(F.aggregate(codes, F.lit(seed).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(2**32))), F.lit(colours)).cast("int")


# How the subject about the state's foundations is named.
ORG = r"(?iu)(?<![\p{L}\p{N}_])ОРГ(?![\p{L}\p{N}_])|основы\s+российской\s+государственности"


def is_org_subject(subject: Column) -> Column:
    """Whether a subject is the one whose long blocks stay whole. Null counts as no."""
    return F.coalesce(clean_text(subject).rlike(ORG), F.lit(False))


def semantic_text(text: Column) -> Column:
    """Small letters with ё as е; everything but letters and digits is one blank."""
    return F.trim(_sub(F.replace(F.lower(text), F.lit("ё"), F.lit("е")), r"[^\p{L}\p{N}]+", " "))


def group_number(group: Column) -> Column:
    """A group's code as a number to sort by; null if it isn't one."""
    return F.when(group.rlike(r"^\d{1,9}$"), group.cast("int"))


@F.pandas_udf(T.StringType())
def colour_key(texts: pd.Series) -> pd.Series:
    """A subject as key of its colour: compatibility forms composed, small letters, single blanks, at most 180 characters."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t.strip()).lower().split())[:180])


def is_web_address(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)^https?://"), F.lit(False))


def is_colour(text: Column) -> Column:
    """Whether a text is ``#`` and six hexadecimal digits."""
    return F.coalesce(text.rlike("(?i)^#[0-9a-f]{6}$"), F.lit(False))


def is_data_address(text: Column, most: int = 1_200_000) -> Column:
    """Whether a text is data in base64, shorter than ``most`` characters."""
    return F.coalesce((F.length(text) < most) & text.rlike("(?i)^data:[a-z0-9.+/-]+;base64,[a-z0-9+/=]+$"), F.lit(False))


# Endings of files and what they are.
RESOURCES = (("pdf", r"\.pdf$"), ("docx", r"\.docx?$"), ("xlsx", r"\.xlsx?$"), ("pptx", r"\.pptx?$"), ("zip", r"\.zip$"), ("image", r"\.(?:jpg|jpeg|png)$"))
# What kinds of periods, states of tasks and priorities are called, and what anything else is.
LABELS = {
    "period": ({"study": "Обучение", "assessment": "Аттестация", "practice": "Практика", "vacation": "Каникулы", "session": "Сессия"}, "Учебный период"),
    "status": ({"todo": "К выполнению", "in_progress": "В процессе"}, "Завершено"),
    "priority": ({"high": "Высокий", "low": "Низкий"}, "Средний"),
}


def resource_type(name: Column, url: Column) -> Column:
    """What a file is by the ending of its name, or of its address if it has no name; ``link`` for anything else."""
    low = F.regexp_extract(F.lower(F.coalesce(F.nullif(name, F.lit("")), url, F.lit(""))), "^[^?#]*", 0)
    out = F.lit("link")
    for kind, ending in reversed(RESOURCES):
        out = F.when(low.rlike(ending), kind).otherwise(out)
    return out


def label(code: Column, kind: str) -> Column:
    """What people read for a code."""
    names, other = LABELS[kind]
    out = F.lit(other)
    for c, name in names.items():
        out = F.when(code == c, name).otherwise(out)
    return out


def material_scope(program: Column, course: Column, group: Column) -> Column:
    """The key under which materials of a group are kept."""
    return F.concat_ws(":", program, course.cast("string"), F.lower(F.trim(group)))


def ics_text(text: Column) -> Column:
    """A text as calendar files want it: backslashes, commas, semicolons and line ends escaped."""
    return _sub(_sub(text, r"([\\,;])", r"\\$1"), r"\r?\n", r"\\n")


def searchable(*columns: Column) -> Column:
    """What a search looks in: the columns in small letters, nulls as nothing."""
    return F.lower(F.concat_ws(" ", *columns))


def mentions(query: str, *columns: Column) -> Column:
    """Whether the cleaned query occurs literally in the columns, whatever the letter case. An empty query is everywhere."""
    wanted = " ".join(query.replace(" ", " ").split()).lower()
    return F.lit(True) if not wanted else searchable(*columns).contains(wanted)
