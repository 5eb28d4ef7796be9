"""From tables as people lay them out to rows: merged cells, headers, group and day columns, cells with several lessons.

A grid is in long form: ``doc``, ``row``, ``col`` (from 0), ``text``. Only cells with text need be there.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.text import clean_text

# Words of a header row, weekday names in order, and names of buildings that end a place.
HEADER = "день|недел|время|групп|дисцип|предмет|место|ауд|препод"
WEEKDAYS = ("понедельник|пн", "вторник|вт", "среда|ср", "четверг|чт", "пятница|пт", "суббота|сб", "воскресенье|вс")
BUILDINGS = ("ЦДТИ", "АСЦ", "ШКОЛА", "Башня", "КПК", "Солнечное", "Пархоменко", "ПЦ", "МНТК", "КВД", "ЛРК", "ИМО", "ДЛРК", "РНХИ", "СПБ", "НМИЦ", "НИИ", "ФГБНУ")
GROUP = r"^\d{3,4}[А-ЯA-Z]{0,3}$"


class _Tables(HTMLParser):
    """Every table of a page as rows of cells with their spans; a table inside a cell is one of its own. Rows that stand in no
    table make one together."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.open: list[dict] = []

    def _begin(self) -> None:
        self.tables.append([])
        self.open.append({"rows": self.tables[-1], "text": None, "span": (1, 1)})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table" or (tag in ("tr", "td", "th") and not self.open):
            self._begin()
        now = self.open[-1] if self.open else None
        if tag == "tr":
            self._end_cell()
            now["rows"].append([])
        elif tag in ("td", "th"):
            self._end_cell()
            named = dict(attrs)
            size = lambda k: max(1, int(m.group())) if (m := re.match(r"\d+", named.get(k) or "")) else 1
            now["span"], now["text"] = (size("rowspan"), size("colspan")), []
        elif tag == "br" and now and now["text"] is not None:
            now["text"].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._end_cell()
        if tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["text"] is not None:
            self.open[-1]["text"].append(data)

    def _end_cell(self) -> None:
        if self.open and (now := self.open[-1])["text"] is not None:
            if not now["rows"]:
                now["rows"].append([])
            now["rows"][-1].append((" ".join("".join(now["text"]).split()), *now["span"]))
            now["text"] = None

    def finish(self) -> None:
        self.close()
        while self.open:
            self._end_cell()
            self.open.pop()


def html_cells(html: str) -> list[tuple[int, int, str]]:
    """The grid of the table with most rows, the first of equals: a cell with spans fills all its places; later cells go around them."""
    page = _Tables()
    page.feed(html)
    page.finish()
    rows = max(page.tables, key=len, default=[])
    grid: dict[tuple[int, int], str] = {}
    for r, cells in enumerate(rows):
        c = 0
        for text, down, across in cells:
            while (r, c) in grid:
                c += 1
            for dr in range(min(down, len(rows) - r)):
                for dc in range(across):
                    grid.setdefault((r + dr, c + dc), text)
            c += across
    return sorted((r, c, text) for (r, c), text in grid.items())


def html_grid(pages: DataFrame, doc: str, html: str) -> DataFrame:
    """The grid of each page's largest table: ``doc``, ``row``, ``col``, ``text``. Null pages and pages without rows give none."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = [(d, *cell) for d, h in zip(batch["doc"], batch["html"], strict=True) if h for cell in html_cells(h)]
            yield pd.DataFrame(cells, columns=["doc", "row", "col", "text"])

    kind = pages.schema[doc].dataType
    schema = T.StructType([T.StructField("doc", kind), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("text", T.StringType())])
    return pages.select(F.col(doc).alias("doc"), F.col(html).alias("html")).where("html IS NOT NULL").mapInPandas(run, schema)


def expand_merges(grid: DataFrame, merges: DataFrame) -> DataFrame:
    """Merged ranges (``doc``, ``r0``, ``r1``, ``c0``, ``c1``) filled from their top left cell, where cells are empty."""
    top = merges.join(grid.select("doc", F.col("row").alias("r0"), F.col("col").alias("c0"), "text"), ["doc", "r0", "c0"])
    rows = top.select("doc", F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1", "text")
    filled = rows.select("doc", "row", F.explode(F.sequence("c0", "c1")).alias("col"), F.col("text").alias("fill"))
    filled = filled.groupBy("doc", "row", "col").agg(F.first("fill").alias("fill"))
    own = F.when(F.trim("text") != "", F.col("text"))
    return grid.join(filled, ["doc", "row", "col"], "full").select("doc", "row", "col", F.coalesce(own, "fill", "text").alias("text"))


def header_rows(grid: DataFrame, among: int = 8) -> DataFrame:
    """The header of each grid: of its first rows that with most header words, the upper one if equal: ``doc``, ``header_row``, ``words``."""
    scored = grid.where(F.col("row") < among).groupBy("doc", "row").agg(F.count_if(F.lower("text").rlike(HEADER)).alias("n"))
    return scored.groupBy("doc").agg(F.max_by("row", F.struct("n", -F.col("row"))).alias("header_row"), F.max("n").alias("words"))


def group_columns(grid: DataFrame, least: int = 2, among: int = 12) -> DataFrame:
    """The columns of groups: in the first row (of the first ``among``) with at least ``least`` group codes: ``doc``, ``header_row``, ``col``, ``group_code``."""
    cells = grid.where((F.col("row") < among) & F.upper(clean_text(F.col("text"))).rlike(GROUP))
    strong = cells.groupBy("doc", "row").agg(F.count_distinct("text").alias("n")).where(F.col("n") >= least)
    first = strong.groupBy("doc").agg(F.min("row").alias("header_row"))
    found = cells.join(first, "doc").where("row = header_row")
    return found.groupBy("doc", "header_row", F.upper(clean_text(F.col("text"))).alias("group_code")).agg(F.min("col").alias("col"))


def weekday_of(text: F.Column) -> F.Column:
    """0 (Monday) to 6 for a text that begins with a weekday's name, else null."""
    out = F.lit(None).cast("int")
    for k, names in reversed(list(enumerate(WEEKDAYS))):
        out = F.when(F.lower(clean_text(text)).rlike(rf"^(?:{names})(?![\p{{L}}])"), F.lit(k)).otherwise(out)
    return out


def lessons_by_group_column(grid: DataFrame, day_col: int = 0, time_col: int = 1) -> DataFrame:
    """Grids with a column per group, days and clocks going down: ``doc``, ``row``, ``weekday``, ``clock``, ``group_code``, ``text``.
    Days are filled down; rows before the first day and empty cells give nothing."""
    down = Window.partitionBy("doc").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    side = grid.groupBy("doc", "row").agg(F.max(F.when(F.col("col") == day_col, F.col("text"))).alias("d"), F.max(F.when(F.col("col") == time_col, F.col("text"))).alias("clock"))
    side = side.withColumn("weekday", F.last(weekday_of(F.col("d")), ignorenulls=True).over(down))
    cells = grid.join(group_columns(grid), ["doc", "col"]).where(F.col("row") > F.col("header_row"))
    out = cells.join(side.select("doc", "row", "weekday", "clock"), ["doc", "row"])
    return out.where((F.trim("text") != "") & F.col("weekday").isNotNull()).select("doc", "row", "weekday", "clock", "group_code", "text")


def lessons_by_group_row(grid: DataFrame) -> DataFrame:
    """Grids with a row per group and a column per day: ``doc``, ``group_code``, ``weekday``, ``text``; only if the header has two days at least."""
    days = grid.withColumn("weekday", weekday_of(F.col("text"))).where("weekday IS NOT NULL")
    head = days.groupBy("doc", "row").agg(F.count("*").alias("n")).where("n >= 2").groupBy("doc").agg(F.min("row").alias("header_row"))
    columns = days.join(head, "doc").where("row = header_row").select("doc", "col", "weekday", "header_row")
    groups = grid.where((F.col("col") == 0) & F.upper(clean_text(F.col("text"))).rlike(GROUP)).select("doc", "row", F.upper(clean_text(F.col("text"))).alias("group_code"))
    return grid.join(columns, ["doc", "col"]).where("row > header_row").join(groups, ["doc", "row"]).where(F.trim("text") != "").select("doc", "group_code", "weekday", "text")


_WEEKS = re.compile(r"\(\s*(?:нед\.?\s*)?(\d{1,2}(?:\s*[-–—,;]\s*\d{1,2})*)\s*(?:нед\.?\s*)?\)", re.IGNORECASE)
_EDGE = " ,/;"
# Words before the number of a room, and the name of a place of several words.
ROOMS, HALL = ("ауд", "аудитория", "каб", "кабинет"), "зал"
BASE = ("база", "практической", "подготовки")
_PARTS = re.compile(r"[«\"“][^»\"”]+[»\"”]|[\w./№-]+|[^\w\s]")
_KNOWN = {b.lower() for b in BUILDINGS}


class _Places:
    """A small grammar of places over the parts of a text (words, quoted names, signs):

    place = base | building [ "," (room | part) ] | room;  room = room word and number | hall and its name.
    """

    def __init__(self, text: str) -> None:
        self.parts = list(_PARTS.finditer(text))
        self.words = [m.group().lower() for m in self.parts]
        self.spans: list[tuple[int, int]] = []
        k = 0
        while k < len(self.words):
            end = self._place(k)
            if end > k:
                self.spans.append((self.parts[k].start(), self.parts[end - 1].end()))
            k = max(end, k + 1)

    def _named(self, k: int) -> bool:
        """Whether a word or a quoted name stands here."""
        return k < len(self.words) and (self.words[k][0].isalnum() or self.words[k][0] in "«\"“_./№-")

    def _room(self, k: int) -> int:
        """Where a room that begins here ends; k if none does."""
        word = self.words[k]
        stem, dot, number = word.partition(".")
        if stem in ROOMS:
            return k + 1 if number else k + 2 if self._named(k + 1) else k
        if any(word.startswith(r) and word[len(r)].isdigit() for r in ROOMS if len(word) > len(r)):
            return k + 1
        return k + 2 if word == HALL and self._named(k + 1) else k

    def _place(self, k: int) -> int:
        if tuple(self.words[k : k + 3]) == BASE:
            return k + 3
        if self.words[k] not in _KNOWN:
            return self._room(k)
        if k + 2 < len(self.words) and self.words[k + 1] == "," and self._named(k + 2):
            return max(self._room(k + 2), k + 3)
        return k + 1


def _after_place(text: str) -> tuple[str, str]:
    """A text cut after its last place: (up to it, what follows)."""
    spans = _Places(text).spans
    return (text[: spans[-1][1]].strip(_EDGE), text[spans[-1][1] :].strip(_EDGE)) if spans else ("", text.strip(_EDGE))


def _begins_with_place(text: str) -> bool:
    spans = _Places(text).spans
    return bool(spans) and spans[0][0] == 0


def _week_numbers(spec: str) -> list[int]:
    out: set[int] = set()
    for part in re.split(r"[,;]", spec):
        ends = [int(n) for n in re.findall(r"\d+", part)]
        out |= set(range(ends[0], ends[-1] + 1)) if len(ends) == 2 else set(ends)
    return sorted(n for n in out if 1 <= n <= 52)


def cell_records(text: str | None) -> list[tuple[str, list[int], str]]:
    """The lessons of a cell ``Subject (weeks) place Subject (weeks) place …``: (subject, weeks, place).

    What stands between two week specifications is the place of the first and the subject of the second, cut after the
    last place; if only a place stands there, the subject goes on. A place before a subject goes to that lesson, too.
    A text without weeks is one subject; a null or blank text none.
    """
    text = " ".join((text or "").replace(" ", " ").split())
    if not text:
        return []
    specs = list(_WEEKS.finditer(text))
    if not specs:
        return [(text, [], "")]
    out: list[tuple[str, list[int], str]] = []
    ahead = text[: specs[0].start()].strip(_EDGE)
    before, subject = _after_place(ahead) if _begins_with_place(ahead) else ("", ahead)
    if not subject:
        subject, before = ahead, ""
    for k, spec in enumerate(specs):
        tail = text[spec.end() : specs[k + 1].start() if k + 1 < len(specs) else len(text)].strip(_EDGE)
        place, following = (tail, "") if k + 1 == len(specs) else _after_place(tail)
        if subject:
            out.append((subject, _week_numbers(spec.group(1)), "; ".join(x for x in (before, place) if x)))
        before, subject = "", following or subject
    return out


_RECORDS = T.ArrayType(T.StructType([T.StructField("subject", T.StringType()), T.StructField("weeks", T.ArrayType(T.IntegerType())), T.StructField("place", T.StringType())]))


@F.pandas_udf(_RECORDS)
def _records(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"subject": s, "weeks": w, "place": p} for s, w, p in cell_records(t)] for t in texts], dtype=object)


def split_cells(rows: DataFrame, text: str) -> DataFrame:
    """Each lesson of each cell as a row of its own: the other columns, ``subject``, ``week_number`` (null where none is given) and ``place``."""
    rest = [c for c in rows.columns if c != text]
    lessons = rows.withColumn("__r", F.explode(_records(F.col(text))))
    return lessons.select(*rest, F.col("__r.subject").alias("subject"), F.explode_outer("__r.weeks").alias("week_number"), F.col("__r.place").alias("place"))


def layout(signals: DataFrame) -> DataFrame:
    """The layout of documents (fixed weights and bounds) from counts (``weeks``, ``groups``, ``days``, ``clocks``) and the share of lines ``vector``:
    ``grid_score``, ``layout`` and ``confidence``."""
    part = lambda c, most: F.least(F.lit(1.0), F.col(c) / most)
    week, group, day = part("weeks", 15), part("groups", 8), part("days", 5)
    score = F.least(F.lit(1.0), week * 0.45 + group * 0.35 + F.col("vector") * 0.2)
    matrix = (score >= 0.58) & (F.col("weeks") >= 8)
    timed = (F.col("days") > 0) & (F.col("clocks") > 0)
    kind = F.when(matrix, "weekly-matrix").when(timed & (F.col("groups") >= 2), "daily-grid").when(timed, "daily-list").otherwise("unknown")
    sure = F.when(matrix, F.least(F.lit(0.99), 0.55 + week * 0.35 + group * 0.1)).when(timed & (F.col("groups") >= 2), F.least(F.lit(0.97), 0.55 + day * 0.25 + group * 0.2)).when(timed, 0.78).otherwise(0.35)
    return signals.select("*", F.round(score, 6).alias("grid_score"), kind.alias("layout"), F.round(sure, 6).alias("confidence"))
