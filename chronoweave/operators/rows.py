"""Timetables laid out as tables, read by what stands in their cells: days, clocks, groups, weeks and lessons.

A grid is in long form: ``doc``, ``row``, ``col`` (from 0), ``text``; tables that go over pages have a ``page``, too.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.temporal import read_clock_range
from chronoweave.functions.text import clean_text
from chronoweave.operators.dedupe import keep_first
from chronoweave.operators.documents import clock_for_place
from chronoweave.operators.grid import _after_place, _begins_with_place, _Places, split_cells, weekday_of

_CLOCKS = r"(?<!\d)\d{1,2}\s*[:.]\s*\d{2}\s*[-–—]\s*\d{1,2}\s*[:.]\s*\d{2}(?!\d)"
#: So many clock ranges of a row count, so many groups make a header, and so many week numbers a row of weeks.
MOST_RANGES, HEADER_GROUPS, HEADER_WEEKS = 4, 3, 8


def _ranges(text: Column) -> Column:
    """The valid clock ranges of a text in order, as structs."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_CLOCKS), F.lit(0)), read_clock_range)
    return F.slice(F.filter(found, lambda r: r.isNotNull()), 1, MOST_RANGES)


def _row_lines(grid: DataFrame, keys: list[str]) -> DataFrame:
    """One row per table row: its cells joined (``line``), its first cell, and the weekday filled down."""
    cells = F.array_sort(F.collect_list(F.struct("col", clean_text(F.col("text")).alias("t"))))
    lines = grid.groupBy("doc", *keys).agg(cells.alias("cells")).withColumn("cells", F.filter("cells", lambda c: c["t"] != ""))
    lines = lines.where(F.size("cells") > 0).withColumn("line", F.array_join(F.transform("cells", lambda c: c["t"]), " | "))
    down = Window.partitionBy("doc").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("weekday", F.last(weekday_of(F.col("line")), ignorenulls=True).over(down))


def group_places(grid: DataFrame, course: str = "") -> DataFrame:
    """The column of each group: three-digit cells (of a course, if given) from the top down to the first row by which at least
    three groups are there, each group where it came first: ``doc``, ``group_code``, ``col`` (G4)."""
    code = clean_text(F.col("text"))
    cells = grid.where(code.rlike(rf"^{course[:1] or '[0-9]'}[0-9]{{2}}$"))
    firsts = cells.groupBy("doc", code.alias("group_code")).agg(F.min(F.struct("row", "col")).alias("at"))
    upto = F.count("*").over(Window.partitionBy("doc").orderBy("at.row").rangeBetween(Window.unboundedPreceding, 0))
    cut = F.min(F.when(F.col("n") >= HEADER_GROUPS, F.col("at.row"))).over(Window.partitionBy("doc"))
    placed = firsts.withColumn("n", upto).withColumn("cut", cut)
    return placed.where(F.col("cut").isNull() | (F.col("at.row") <= F.col("cut"))).select("doc", "group_code", F.col("at.col").alias("col"))


_OUT = ("doc", "row", "weekday", "start_time", "end_time", "group_code", "subject", "week_number", "place", "lesson_type")


def row_lessons(grid: DataFrame, kind: str = "practice", course: str = "") -> DataFrame:
    """The lessons of tables of any layout (G23): ``doc``, ``row``, ``weekday``, ``start_time``, ``end_time``, ``group_code``,
    ``subject``, ``week_number`` (null where a cell names none), ``place``, ``lesson_type``.

    A row that begins with a weekday sets the day for itself and the rows below; a row with up to four clock ranges holds lessons,
    each of them at each range. Of practice the cells in the columns of groups are read; without such columns, and for lectures,
    the whole row is one lesson text for everybody. A cell may hold several lessons with weeks and places. Rows before the first
    day, empty cells and texts without a subject give nothing.
    """
    rows = _row_lines(grid, ["row"]).withColumn("ranges", _ranges(F.col("line"))).where(F.col("weekday").isNotNull() & (F.size("ranges") > 0))
    places = group_places(grid, course) if kind == "practice" else None
    bare = lambda c: clean_text(F.regexp_replace(c, _CLOCKS, ""))
    body = F.filter(F.transform("cells", lambda c: F.regexp_replace(bare(c["t"]), r"^[ /|]+|[ /|]+$", "")), lambda t: (t != "") & ~t.rlike(r"^\d{3}$") & weekday_of(t).isNull())
    whole = rows if places is None else rows.join(places.select("doc").distinct(), "doc", "left_anti")
    texts = whole.select("doc", "row", "weekday", "ranges", F.lit("ALL").alias("group_code"), F.array_join(body, " ").alias("text"), F.lit("lecture").alias("lesson_type"))
    if places is not None:
        cells = grid.select("doc", "row", "col", clean_text(F.col("text")).alias("text")).where("text <> ''").join(places, ["doc", "col"])
        own = cells.join(rows.select("doc", "row", "weekday", "ranges"), ["doc", "row"])
        texts = texts.unionByName(own.select("doc", "row", "weekday", "ranges", "group_code", "text", F.lit("practice").alias("lesson_type")))
    lessons = split_cells(texts.withColumn("r", F.explode("ranges")).drop("ranges"), "text").where(F.length("subject") >= F.when(F.col("lesson_type") == "lecture", 2).otherwise(1))
    return lessons.withColumns({"start_time": F.col("r.start_time"), "end_time": F.col("r.end_time")}).select(*_OUT)


def paged_lessons(cells: DataFrame, course: str = "") -> DataFrame:
    """The lessons of a daily grid that goes over pages (``page``; G21): day in the first column, clocks in the second, a column per
    group. Group columns are read anew on every page that names groups of the course and carried on to those that don't; the
    day is carried over pages. Of two clocks in a row the lesson's place tells which one counts. Lessons without weeks are left out.
    ``doc``, ``page``, ``row``, ``weekday``, ``start_time``, ``end_time``, ``group_code``, ``subject``, ``week_number``, ``place``.
    """
    text = clean_text(F.col("text"))
    named = cells.where(text.rlike(rf"^{course[:1] or '[0-9]'}[0-9]{{2}}$")).groupBy("doc", "page", text.alias("group_code")).agg(F.max_by("col", "row").alias("col"))
    pages = cells.select("doc", "page").distinct().join(named.select("doc", "page", F.col("page").alias("own")).distinct(), ["doc", "page"], "left")
    carried = F.last("own", ignorenulls=True).over(Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    columns = pages.withColumn("own", carried).join(named.withColumnRenamed("page", "own"), ["doc", "own"]).select("doc", "page", "group_code", "col")

    at = lambda k: F.max(F.when(F.col("col") == k, text))
    down = Window.partitionBy("doc").orderBy("page", "row").rowsBetween(Window.unboundedPreceding, 0)
    side = cells.groupBy("doc", "page", "row").agg(at(0).alias("d"), at(1).alias("clocks"), F.max("col").alias("width"))
    side = side.withColumn("weekday", F.last(F.when(F.col("width") > 0, weekday_of(F.col("d"))), ignorenulls=True).over(down)).where("weekday IS NOT NULL").where(F.col("clocks").rlike(_CLOCKS))
    own = cells.select("doc", "page", "row", "col", text.alias("text")).where("text <> ''").join(columns, ["doc", "page", "col"]).join(side.select("doc", "page", "row", "weekday", "clocks"), ["doc", "page", "row"])
    lessons = split_cells(own.drop("col"), "text").where("week_number IS NOT NULL")
    lessons = lessons.withColumn("r", read_clock_range(clock_for_place(F.col("clocks"), F.col("place")))).where("r IS NOT NULL")
    return lessons.select("doc", "page", "row", "weekday", "r.start_time", "r.end_time", "group_code", "subject", "week_number", "place")


# Words with which a place begins in a cell of a week matrix, besides the buildings.
MARKERS = ("обл", "гб", "база", "родильный", "менделеевская", "ул", "просп", "звездная", "ногина", "поленов", "вредена", "больница", "госпиталь", "лоптд", "гптд")
PHRASES = (("с", "использованием", "дот"), ("институт", "мозга"))


def matrix_cell(text: str | None) -> tuple[str | None, str]:
    """A cell without weeks cut into subject and place: at its leading place if it begins with one and a subject follows, else
    where the first place begins (G11). A null or blank cell has no subject."""
    text = " ".join((text or "").split())
    if not text:
        return None, ""
    if _begins_with_place(text):
        place, subject = _after_place(text)
        if len(subject) > 1 and subject[0].isupper():
            return subject, place
    found = _Places(text)
    starts = [a for a, _ in found.spans]
    words = [w.strip(".") for w in found.words]
    starts += [m.start() for m, w in zip(found.parts, words, strict=True) if w in MARKERS]
    starts += [found.parts[k].start() for k in range(len(words)) for p in PHRASES if tuple(words[k : k + len(p)]) == p]
    subject = text[: min(starts)].strip(" ,.-") if starts else ""
    return (subject, text[min(starts) :].strip(" ,/;")) if subject else (text, "")


@F.pandas_udf(T.StructType([T.StructField("subject", T.StringType()), T.StructField("place", T.StringType())]))
def split_matrix_cells(texts: pd.Series) -> pd.DataFrame:
    """The same for a column."""
    return pd.DataFrame([matrix_cell(t) for t in texts], columns=["subject", "place"])


def matrix_lessons(grid: DataFrame) -> DataFrame:
    """The lessons of week matrices (G20): a row of week numbers among the first ten (at least eight), below it a row per group
    (three digits in one of the first two columns), and a cell that stands for the weeks right of it, too, up to the next one.
    ``doc``, ``group_code``, ``week_number``, ``subject``, ``place``, each once. Weeks before the first cell have none."""
    cells = grid.select("doc", "row", "col", clean_text(F.col("text")).alias("text")).where("text <> ''")
    number = cells.where(F.col("text").rlike("^(?:[1-9]|[1-4][0-9]|5[0-2])$"))
    head = number.where("row < 10").groupBy("doc", "row").agg(F.count("*").alias("n")).where(F.col("n") >= HEADER_WEEKS).groupBy("doc").agg(F.min("row").alias("head"))
    weeks = number.join(head, "doc").where("row = head").select("doc", "head", "col", F.col("text").cast("int").alias("week_number"))
    groups = cells.where(F.col("col").isin(0, 1) & F.col("text").rlike("^[0-9]{3}$")).groupBy("doc", "row").agg(F.min_by("text", "col").alias("group_code"))
    places = groups.join(weeks, "doc").where("row > head")
    carried = F.last("text", ignorenulls=True).over(Window.partitionBy("doc", "row").orderBy("week_number").rowsBetween(Window.unboundedPreceding, 0))
    filled = places.join(cells, ["doc", "row", "col"], "left").withColumn("text", carried).where("text IS NOT NULL")
    parts = filled.select("doc", "row", "group_code", "week_number", split_matrix_cells("text").alias("p")).select("doc", "row", "group_code", "week_number", "p.subject", "p.place").where("subject IS NOT NULL")
    key = [F.col(c) for c in ("doc", "group_code", "week_number", "subject", "place")]
    return keep_first(parts, key, ["row"]).drop("row")


def lesson_union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Lessons of several readers of one table, each once: where two readers give the same lesson the first reader's row stays."""
    ranked = reduce(DataFrame.unionByName, [df.withColumn("__reader", F.lit(n)) for n, df in enumerate((first, *others))])
    key = [F.col(c) for c in ("doc", "group_code", "weekday", "start_time", "end_time", "subject", "week_number", "place") if c in first.columns]
    return keep_first(ranked, key, ["__reader"]).drop("__reader")


def reading_issues(lessons: DataFrame, expected: DataFrame, layout: str) -> DataFrame:
    """Why what a reader made of a document must not be taken over (G25): ``doc``, ``issue``. ``expected`` has the groups of each
    document (``doc``, ``group_code``). Documents without lessons, with groups missing, with empty or garbled subjects or no
    clocks, and week matrices with weekdays are named; a document without an issue gives no row."""
    seen = lessons.groupBy("doc").agg(
        F.count("*").alias("n"),
        F.max(F.coalesce(F.trim("subject"), F.lit("")) == "").alias("no_subject"),
        F.max(F.col("start_time").isNull() | F.col("end_time").isNull()).alias("no_clock"),
        F.max(F.coalesce(F.col("subject").rlike(r"[█�]|(?:^|\s)I{3,}(?:\s|$)"), F.lit(False))).alias("garbled"),
        F.max(F.col("weekday").isNotNull()).alias("dated"),
    )
    lost = expected.select("doc", "group_code").distinct().join(lessons.select("doc", "group_code").distinct(), ["doc", "group_code"], "left_anti").groupBy("doc").agg(F.count("*").alias("lost"))
    docs = expected.select("doc").distinct().join(seen, "doc", "left").join(lost, "doc", "left")
    rules = {
        "no lessons": F.col("n").isNull(), "missing groups": F.col("n").isNotNull() & F.col("lost").isNotNull(), "missing field": F.col("no_subject") | F.col("no_clock"), "garbled subject": F.col("garbled"),
        "matrix with weekdays": F.col("dated") & F.lit(layout == "weekly-matrix"),
    }
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return docs.select("doc", F.explode(found).alias("issue"))


def best_reading(files: DataFrame, attempts: DataFrame, kind: str = "practice") -> DataFrame:
    """Every file's lessons by the reader that got most out of it (S8): ten points a lesson, less one a warning, the first of equals.
    ``attempts``: doc, attempt_no, parser, cells, warnings, as ``formats.attempts`` gives them. Files with no lesson by any reader
    come out with one row of nulls. Out: ``doc``, ``parser``, and the columns of ``row_lessons``."""
    tried = attempts.withColumn("try", F.concat_ws("#", "doc", "attempt_no"))
    grid = tried.select(F.col("try").alias("doc"), F.explode("cells").alias("c")).select("doc", "c.row", "c.col", "c.text")
    lessons = row_lessons(grid, kind).withColumnRenamed("doc", "try")
    counts = tried.join(lessons.groupBy("try").agg(F.count("*").alias("events")), "try", "left").fillna(0, ["events"])
    score = F.col("events") * 10 - F.col("warnings")
    best = counts.groupBy("doc").agg(F.max_by(F.struct("parser", "try", "events"), F.struct(score, -F.col("attempt_no"))).alias("b"))
    best = best.select("doc", F.when(F.col("b.events") > 0, F.col("b.parser")).alias("parser"), F.col("b.try").alias("try"))
    return files.select(F.col("path").alias("doc")).join(best, "doc", "left").join(lessons, "try", "left").drop("try")
