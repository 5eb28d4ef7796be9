"""Tables, files and pages as queries: timetables are written from whole tables in the layouts that people use, and read back.

The SQL twins know nothing of layouts: they say what was written.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.text import clean_text
from chronoweave.operators import documents, geometry, grid, rows
from chronoweave.sources import formats, pdf
from chronoweave.sources.tables import table

_DAYS = ("Понедельник", "Вторник", "Среда", "Четверг", "Пятница", "Суббота", "Воскресенье")


def _pick(names: tuple[str, ...], k: F.Column) -> F.Column:
    return F.try_element_at(F.array(*map(F.lit, names)), k + 1)


def _cell() -> F.Column:
    """``Subject (weeks) place``; without weeks the subject alone."""
    weeks = F.concat("subject", F.lit(" ("), F.trim("weeks_spec"), F.lit(") "), F.coalesce("location_text", F.lit("")))
    return clean_text(F.coalesce(weeks, "subject"))


def _rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules of days and groups with the row that each has in its chair's sheet, by day and number, and whether it is the day's first."""
    r = table(spark, d, "manual_rule").where("weekday BETWEEN 0 AND 6 AND subject IS NOT NULL AND chair_code IS NOT NULL")
    r = r.withColumn("groups", F.filter(F.array_distinct("groups_list"), lambda g: g.rlike("^[0-9]{3}$"))).where(F.size("groups") > 0)
    order = Window.partitionBy("chair_code").orderBy("weekday", "rule_id")
    return r.withColumn("row", F.row_number().over(order)).withColumn("first", F.coalesce(F.lag("weekday").over(order) != F.col("weekday"), F.lit(True)))


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    """A sheet for each chair: groups in the first row, the day in the first column where it begins, clocks in the second."""
    r = _rules(spark, d).select("chair_code", "row", "first", "weekday", F.concat_ws("-", "start_time", "end_time").alias("clocks"), _cell().alias("cell"), "groups")
    each = r.withColumn("g", F.explode("groups"))
    groups = each.select("chair_code", "g").distinct().withColumn("col", F.row_number().over(Window.partitionBy("chair_code").orderBy("g")) + 1)
    one = lambda df, row, col, text: df.select(F.col("chair_code").alias("doc"), row.cast("int").alias("row"), col.cast("int").alias("col"), text.alias("text"))
    out = one(groups, F.lit(0), F.col("col"), F.col("g")).unionByName(one(each.join(groups, ["chair_code", "g"]), F.col("row"), F.col("col"), F.col("cell")))
    return out.unionByName(one(r.where("first"), F.col("row"), F.lit(0), _pick(_DAYS, F.col("weekday")))).unionByName(one(r, F.col("row"), F.lit(1), F.col("clocks")))


_LESSON = ("doc", "weekday", "start_time", "end_time", "group_code", "subject", "week_number", "place")


def sheet_lessons(spark: SparkSession, d: str) -> DataFrame:
    """Each chair's rules as a sheet with a column per group, read by the generic row parser."""
    return rows.row_lessons(_sheet(spark, d)).select(*_LESSON)


def lecture_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Rules for everybody as sheets without columns of groups, read by the generic row parser."""
    r = table(spark, d, "manual_rule").where("weekday BETWEEN 0 AND 6 AND chair_code IS NOT NULL AND length(trim(subject)) > 1 AND audience = 'ALL'")
    r = r.withColumn("row", F.row_number().over(Window.partitionBy("chair_code").orderBy("weekday", "rule_id")))
    cells = F.array(_pick(_DAYS, F.col("weekday")), F.concat_ws("-", "start_time", "end_time"), F.lit("101"), _cell())
    sheet = r.select(F.col("chair_code").alias("doc"), "row", F.posexplode(cells).alias("col", "text"))
    return rows.row_lessons(sheet, "lecture").select(*_LESSON)


def paged_sheets(spark: SparkSession, d: str) -> DataFrame:
    """The same sheets over pages of 25 rows, groups printed on every second page only, two clocks in every row."""
    s = _sheet(spark, d)
    page = F.floor((F.col("row") - 1) / 25).cast("int")
    body = s.where("row > 0").select("doc", page.alias("page"), "row", "col", F.when(F.col("col") == 1, F.concat(F.lit("23:00-23:30 "), "text")).otherwise(F.col("text")).alias("text"))
    even = body.where("page % 2 = 0").select("doc", "page").distinct()
    heads = s.where("row = 0").join(even, "doc").select("doc", "page", F.lit(-1).alias("row"), "col", "text")
    return rows.paged_lessons(body.unionByName(heads)).select(*_LESSON)


def cells_by_group(spark: SparkSession, d: str) -> DataFrame:
    """The same sheets read by their columns of groups, cells whole."""
    return grid.lessons_by_group_column(_sheet(spark, d)).select("doc", "row", "weekday", "clock", "group_code", "text")


def reading_issues(spark: SparkSession, d: str) -> DataFrame:
    """What forbids taking over what was read of a sheet: groups of a chair that no lesson was read of."""
    expected = table(spark, d, "manual_rule").where("chair_code IS NOT NULL").select(F.col("chair_code").alias("doc"), F.explode("groups_list").alias("group_code"))
    return rows.reading_issues(rows.row_lessons(_sheet(spark, d)), expected, "daily-grid")


def two_readers(spark: SparkSession, d: str) -> DataFrame:
    """Lessons of the row parser and of the page parser together, each once."""
    pages = paged_sheets(spark, d)
    return rows.lesson_union(pages, sheet_lessons(spark, d))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    """A week matrix for each program, course and stream: the first capture of a group's week that has no place for its subject, and its
    room; empty where there is none."""
    r = table(spark, d, "raw_event").where("group_code RLIKE '^[0-9]{3}$' AND week_number BETWEEN 1 AND 30 AND subject NOT RLIKE '(?iu)ауд|каб|база|зал'")
    room = F.concat(F.lit(" ауд. "), F.nullif(F.regexp_extract("location_text", r"(\d+[.]\d+)", 1), F.lit("")))
    text = F.concat(clean_text(F.col("subject")), F.coalesce(room, F.lit("")))
    doc = F.concat_ws("|", "program_code", "course", F.coalesce("stream_code", F.lit("-")))
    return r.groupBy(doc.alias("doc"), "group_code", "week_number").agg(F.min_by(text, "raw_id").alias("text"))


def matrix_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Week matrices read back, cells standing for the weeks right of them."""
    m = _matrix(spark, d)
    line = F.dense_rank().over(Window.partitionBy("doc").orderBy("group_code"))
    body = m.withColumn("row", line)
    heads = m.select("doc").distinct().select("doc", F.lit(0).alias("row"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("w"))
    cells = body.select("doc", "row", (F.col("week_number") + 1).alias("col"), "text").unionByName(heads.select("doc", "row", (F.col("w") + 1).alias("col"), F.col("w").cast("string").alias("text")))
    cells = cells.unionByName(body.select("doc", "row", F.lit(0).alias("col"), F.col("group_code").alias("text")).distinct())
    return rows.matrix_lessons(cells)


def merged_cells(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of periods printed once for rows that follow each other with the same kind, the cells merged, filled again (G1)."""
    p = table(spark, d, "study_period").where("period_kind IS NOT NULL")
    order = Window.partitionBy("plan_code").orderBy("period_id")
    rows_ = p.select(F.col("plan_code").alias("doc"), (F.row_number().over(order) - 1).alias("row"), "period_kind", F.coalesce(F.lag("period_kind").over(order) != F.col("period_kind"), F.lit(True)).alias("first"))
    runs = rows_.withColumn("run", F.sum(F.col("first").cast("int")).over(Window.partitionBy("doc").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)))
    merges = runs.groupBy("doc", "run").agg(F.min("row").alias("r0"), F.max("row").alias("r1")).select("doc", "r0", "r1", F.lit(0).alias("c0"), F.lit(1).alias("c1"))
    cells = rows_.where("first").select("doc", "row", F.lit(0).alias("col"), F.col("period_kind").alias("text"))
    return grid.expand_merges(cells, merges)


def headers_found(spark: SparkSession, d: str) -> DataFrame:
    """The header of each chair's list of rules, which begins in one of the first rows."""
    r = table(spark, d, "manual_rule").where("chair_code IS NOT NULL")
    at = F.length("chair_code") % 4 + F.substring("chair_code", -1, 1).cast("int") % 3
    body = r.select("chair_code", F.row_number().over(Window.partitionBy("chair_code").orderBy("rule_id")).alias("n"), "subject", "location_text", at.cast("int").alias("at"))
    body = body.select(F.col("chair_code").alias("doc"), (F.col("n") - 1 + (F.col("n") > F.col("at")).cast("int")).alias("row"), F.posexplode(F.array("subject", "location_text")).alias("col", "text"))
    heads = r.select(F.col("chair_code").alias("doc"), at.cast("int").alias("row")).distinct().select("doc", "row", F.posexplode(F.array(*map(F.lit, ("День недели", "Время", "Группа", "Предмет")))).alias("col", "text"))
    return grid.header_rows(body.unionByName(heads))


def group_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sheets with a row per group and a column per day."""
    r = table(spark, d, "raw_event").where("group_code RLIKE '^[0-9]{3}[А-Я]?$' AND weekday BETWEEN 0 AND 6 AND trim(subject) <> ''")
    doc = F.concat_ws("|", "program_code", "course")
    cells = r.groupBy(doc.alias("doc"), "group_code", "weekday").agg(F.min_by("subject", "raw_id").alias("text"))
    cells = cells.withColumn("row", F.dense_rank().over(Window.partitionBy("doc").orderBy("group_code")))
    out = cells.select("doc", "row", (F.col("weekday") + 1).alias("col"), "text").unionByName(cells.select("doc", "row", F.lit(0).alias("col"), F.col("group_code").alias("text")).distinct())
    heads = cells.select("doc").distinct().select("doc", F.lit(0).alias("row"), F.posexplode(F.array(*map(F.lit, _DAYS))).alias("k", "text")).select("doc", "row", (F.col("k") + 1).alias("col"), "text")
    return grid.lessons_by_group_row(out.unionByName(heads))


def places_ahead(spark: SparkSession, d: str) -> DataFrame:
    """Places written before subjects, taken off."""
    r = table(spark, d, "manual_rule").where("subject IS NOT NULL")
    return r.select("rule_id", documents.split_leading_place(clean_text(F.concat_ws(" ", "location_text", "subject"))).alias("s")).select("rule_id", "s.place", "s.subject")


def listed(spark: SparkSession, d: str) -> DataFrame:
    """Each chair's rules as a list: a weekday's name, then for each lesson its clocks and subject, and its place in the next line."""
    r = _rules(spark, d)
    parts = F.array(F.when(F.col("first"), _pick(_DAYS, F.col("weekday"))), F.concat(F.concat_ws(" – ", "start_time", "end_time"), F.lit(" "), "subject"), F.col("location_text"))
    lines = r.select(F.col("chair_code").alias("doc"), "row", F.posexplode(parts).alias("k", "text")).where("text IS NOT NULL").select("doc", (F.col("row") * 3 + F.col("k")).alias("line"), "text")
    return documents.listed_lessons(lines)


def previews(spark: SparkSession, d: str) -> DataFrame:
    """The beginning of every document."""
    lines = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return documents.preview(lines)


def best_links(spark: SparkSession, d: str) -> DataFrame:
    """For each program and course the newest link to a study plan, or else the fallback."""
    s = documents.classify(table(spark, d, "source_provenance").where("url LIKE '%/kug_%'").select("url").distinct().withColumn("title", F.lit("")), "title", "url")
    year = F.regexp_extract("url", r"/(\d{4})/", 1).cast("int")
    fallback = table(spark, d, "group_ref").select("program_code", "course").distinct().select(F.col("program_code").alias("program"), F.col("course").alias("course_number"), F.concat_ws("/", F.lit("fallback"), "program_code", "course").alias("url"))
    return documents.best_or_fallback(s.where("program IS NOT NULL AND course_number IS NOT NULL"), fallback, ["program", "course_number"], year - 2026, ["url"])


def _member(z: zipfile.ZipFile, name: str, text: str) -> None:
    z.writestr(zipfile.ZipInfo(name), text)


def _packed(kind: str, lines: list[list[str]]) -> bytes:
    """A small file of an office format with one table."""
    out, cell = io.BytesIO(), lambda x: escape(x or "")
    with zipfile.ZipFile(out, "w") as z:
        if kind == "xlsx":
            body = "".join("<row>" + "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{cell(x)}</t></is></c>' for c, x in enumerate(line)) + "</row>" for r, line in enumerate(lines, 1))
            _member(z, "xl/worksheets/sheet1.xml", f'<worksheet xmlns="m"><sheetData>{body}</sheetData></worksheet>')
            _member(z, "xl/worksheets/sheet2.xml", '<worksheet xmlns="m"><sheetData/></worksheet>')
        elif kind == "ods":
            body = "".join("<t:table-row>" + "".join(f"<t:table-cell><x:p>{cell(x)}</x:p></t:table-cell>" for x in line) + "</t:table-row>" for line in lines)
            _member(z, "mimetype", "x")
            _member(z, "content.xml", f'<o xmlns:t="t" xmlns:x="x"><t:table>{body}</t:table></o>')
        else:
            body = "".join("<tr>" + "".join(f"<tc><p><r><t>{cell(x)}</t></r></p></tc>" for x in line) + "</tr>" for line in lines)
            _member(z, "word/document.xml" if kind == "docx" else "ppt/slides/slide1.xml", f"<d><tbl>{body}</tbl></d>")
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def _file(kinds: pd.Series, lines: pd.Series) -> pd.Series:
    return pd.Series([_packed(k, [list(x) for x in rows_]) for k, rows_ in zip(kinds, lines, strict=True)])


_LINES = "chair_code IS NOT NULL"


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Each chair's rules as lines of three texts, in order, and a number that decides on the chair's format."""
    r = table(spark, d, "manual_rule").where(_LINES)
    line = F.array(F.col("rule_id").cast("string"), clean_text(F.coalesce("subject", F.lit(""))), clean_text(F.coalesce("location_text", F.lit(""))))
    lists = r.groupBy("chair_code").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_id", line.alias("l")))), lambda x: x["l"]).alias("lines"))
    return lists.withColumn("k", F.substring("chair_code", -1, 1).cast("int"))


def office_files(spark: SparkSession, d: str) -> DataFrame:
    """Each chair's rules as a file of one of four office formats, found out by its content and read back."""
    kind = F.element_at(F.array(*map(F.lit, ("xlsx", "ods", "docx", "pptx"))), F.col("k") % 4 + 1)
    files = _lists(spark, d).select(F.concat("chair_code", F.lit(".bin")).alias("path"), _file(kind, "lines").alias("content"))
    return formats.file_grids(files)


def text_files(spark: SparkSession, d: str) -> DataFrame:
    """The same as files with semicolons in UTF-8 or UTF-16, or as pages, with names that say something else."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    csv = F.array_join(F.transform("lines", lambda l: F.array_join(F.transform(l, quoted), ";")), "\r\n")
    html = F.concat(F.lit("<table><tr><td>small</td></tr></table><table>"), F.array_join(F.transform("lines", lambda l: F.concat(F.lit("<tr><td>"), F.array_join(F.transform(l, esc), "</td><td>"), F.lit("</td></tr>"))), ""), F.lit("</table>"))
    content = F.when(F.col("k") % 3 == 0, F.encode(csv, "UTF-8")).when(F.col("k") % 3 == 1, F.encode(csv, "UTF-16")).otherwise(F.encode(html, "UTF-8"))
    return formats.file_grids(_lists(spark, d).select(F.concat("chair_code", F.when(F.col("k") % 3 == 2, ".xlsx").otherwise(".csv")).alias("path"), content.alias("content"))).where("text <> ''")


def _pdf(lines: list[list[str]], packed: bool) -> bytes:
    """A small PDF: forty lines a page, each text of a line shown on its own, codes that only the font's map makes letters."""
    out: list[bytes] = [b"%PDF-1.5\n"]
    pages = [lines[k : k + 40] for k in range(0, len(lines), 40)]

    def add(number: int, head: str, body: bytes | None = None) -> None:
        if body is not None:
            body = zlib.compress(body) if packed else body
            head = f"<< /Length {len(body)} {'/Filter /FlateDecode ' if packed else ''}>>"
        out.append(f"{number} 0 obj\n{head}\n".encode() + (b"stream\n" + body + b"\nendstream\n" if body is not None else b"") + b"endobj\n")

    add(1, "<< /Type /Catalog /Pages 2 0 R >>")
    add(2, f"<< /Type /Pages /Kids [{' '.join(f'{10 + 2 * k} 0 R' for k in range(len(pages)))}] /Count {len(pages)} /MediaBox [0 0 600 800] /Resources << /Font << /F1 3 0 R >> >> >>")
    add(3, "<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 4 0 R /DescendantFonts [<< /DW 500 >>] >>")
    add(4, "", b"1 beginbfrange <0000> <FFFF> <0000> endbfrange")
    for k, page in enumerate(pages):
        show = lambda t: f"<{t.encode('utf-16-be').hex()}> Tj"
        body = "q 1 0 0 1 0 0 cm BT /F1 9 Tf 12 TL " + " ".join(f"1 0 0 1 {30 + 150 * c} {780 - 15 * r} Tm {show(t)}" for r, line in enumerate(page) for c, t in enumerate(line) if t) + " ET Q"
        add(10 + 2 * k, f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >>")
        add(11 + 2 * k, "", body.encode())
    return b"".join([*out, b"trailer << /Root 1 0 R >>\n%%EOF"])


@F.pandas_udf(T.BinaryType())
def _pdf_file(packed: pd.Series, lines: pd.Series) -> pd.Series:
    return pd.Series([_pdf([list(x) for x in rows_], p) for p, rows_ in zip(packed, lines, strict=True)])


def pdf_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each chair's rules as a PDF, packed or not, its texts read with their places and brought into lines."""
    files = _lists(spark, d).select(F.concat("chair_code", F.lit(".pdf")).alias("path"), _pdf_file(F.col("k") % 2 == 0, "lines").alias("content"))
    return geometry.lines(pdf.pdf_tokens(files)).select("doc", "page", "line", "text")


def file_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Formats of files made of documents, by their content."""
    k = F.col("doc_id") % 6
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    start = F.when(k == 0, F.lit("%PDF-1.7")).when(k == 1, F.lit("<HTML><body>")).when(k == 2, F.lit(' {"a": 1}')).when(k == 4, F.lit("{\\rtf1")).otherwise(F.lit(""))
    data = F.when(k == 3, F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1")), body)).otherwise(F.concat(F.encode(start, "UTF-8"), body))
    name = F.when(k == 3, F.when(F.col("doc_id") % 4 == 1, "a.DOC").otherwise("a.xls")).when(k <= 1, "a.xlsx").otherwise("a")
    return table(spark, d, "documents").select("doc_id", formats.sniffed(data, name).alias("kind"))


def best_readings(spark: SparkSession, d: str) -> DataFrame:
    """Each chair's sheet as a page with a name that says something else: every reader tries, the one with most lessons wins."""
    s = _sheet(spark, d)
    lines = s.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("cs"), F.max("col").alias("w"))
    at = F.map_from_entries("cs")
    tds = F.transform(F.sequence(F.lit(0), F.col("w")), lambda k: F.concat(F.lit("<td>"), F.coalesce(at[k], F.lit("")), F.lit("</td>")))
    pages = lines.select("doc", "row", F.concat(F.lit("<tr>"), F.array_join(tds, ""), F.lit("</tr>")).alias("tr")).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "tr"))), lambda x: x["tr"]), "").alias("t"))
    files = pages.select(F.concat("doc", F.lit(".csv")).alias("path"), F.encode(F.concat(F.lit("<table>"), "t", F.lit("</table>")), "UTF-8").alias("content"))
    return rows.best_reading(files, formats.attempts(files)).select("parser", *_LESSON)


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Words placed on pages brought into lines; words of a line don't stand at quite the same height."""
    r = table(spark, d, "manual_rule").where("weekday IS NOT NULL AND chair_code IS NOT NULL")
    words = r.select(F.col("chair_code").alias("doc"), F.col("course").alias("page"), (F.col("rule_id") % 50 * 10).cast("double").alias("x"), (F.col("weekday") * 20 + F.col("rule_id") % 3).cast("double").alias("y"), F.col("rule_id").cast("string").alias("text"))
    return geometry.lines(words)


def word_columns(spark: SparkSession, d: str) -> DataFrame:
    """Words placed on pages given to the columns between whose bounds they lie."""
    r = table(spark, d, "manual_rule").where("chair_code IS NOT NULL")
    words = r.select(F.col("chair_code").alias("doc"), "rule_id", (F.col("rule_id") % 700).cast("double").alias("x"))
    columns = r.select(F.col("chair_code").alias("doc")).distinct().select("doc", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n")).select("doc", F.concat(F.lit("c"), "n").alias("name"), (F.col("n") * F.col("n") * 10 + 50).cast("double").alias("x"))
    return geometry.to_columns(words, columns)


def week_rows(spark: SparkSession, d: str) -> DataFrame:
    """The line of week numbers on a calendar's page, among other numbers."""
    w = table(spark, d, "academic_week").where("week_number BETWEEN 1 AND 52").select("calendar_code", "week_number").distinct()
    word = lambda y, n: w.select(F.col("calendar_code").alias("doc"), F.lit(1).alias("page"), (F.col("week_number") * 12).cast("double").alias("x"), y.cast("double").alias("y"), n.cast("string").alias("text"))
    return geometry.week_bands(word(F.lit(101) + F.col("week_number") % 2, F.col("week_number")).unionByName(word(F.lit(200), F.col("week_number") % 5 + 1)))


def drawn_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Cells drawn over several weeks and groups of a matrix, each with all of them."""
    w = table(spark, d, "academic_week").where("week_number BETWEEN 1 AND 52").select(F.col("calendar_code").alias("doc"), "week_number").distinct()
    bands = w.select("doc", "week_number", (F.col("week_number") * 10).cast("double").alias("a"), (F.col("week_number") * 10 + 10).cast("double").alias("b"))
    groups = w.select("doc").distinct().select("doc", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("g")).select("doc", F.concat(F.lit("10"), "g").alias("group_code"), (F.col("g") * 30 + 15).cast("double").alias("y"))
    n = F.col("week_number")
    cells = w.select("doc", n.alias("cell"), (n * 10 + F.when(n % 4 == 0, 4.8).otherwise(0.5)).alias("x0"), (n * 10 + F.when(n % 4 == 0, 5.3).otherwise(9.5 + n % 3 * 10)).alias("x1"), (n % 3 * 30).cast("double").alias("y0"), (n % 3 * 30 + 30 + n % 2 * 30).cast("double").alias("y1"))
    return geometry.cell_lessons(cells, bands, groups)


def text_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A matrix without drawn lines: texts that reach over the columns of their weeks, in rows of two lines."""
    r = _rules(spark, d).where("weeks_spec RLIKE '^нед[.] [0-9]+-[0-9]+$'")
    a, z = (F.regexp_extract("weeks_spec", r"(\d+)-(\d+)", k).try_cast("int") for k in (1, 2))
    r = r.select(F.col("chair_code").alias("doc"), F.col("rule_id").cast("string").alias("group_code"), (F.col("row") * 100).cast("double").alias("y"), a.alias("a"), z.alias("z"), clean_text(F.col("subject")).alias("s")).where("a BETWEEN 1 AND 30 AND z BETWEEN a AND 30")
    weeks = r.select("doc").distinct().select("doc", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("week_number")).select("doc", "week_number", (F.col("week_number") * 50).cast("double").alias("x"))
    word = lambda dy, x0, x1, text: r.select("doc", x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), (F.col("y") + dy).alias("y"), F.lit(text).alias("text") if isinstance(text, str) else text.alias("text"))
    left, right = F.col("a") * 50 - 20, F.col("z") * 50 + 20
    words = word(-4, left, left + 15, F.col("s")).unionByName(word(-4, right - 10, right, "конец")).unionByName(word(6, left, left + 10, "ауд. 1"))
    blocks = geometry.matrix_blocks(words, weeks, r.select("doc", "group_code", "y"))
    return geometry.weeks_of_blocks(blocks, weeks).select("doc", "group_code", "text", "week_number")


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of each chair that lie close together, as averages (G15), and the upper median."""
    r = table(spark, d, "manual_rule").where("weekday BETWEEN 0 AND 6 AND chair_code IS NOT NULL")
    values = r.groupBy("chair_code").agg(F.collect_set((F.col("weekday") * 100 + F.col("rule_id") % 3).cast("double")).alias("vs"))
    return values.select("chair_code", F.explode(geometry.running_clusters(F.col("vs"), 3.0)).alias("middle"), geometry.upper_median(F.col("vs")).alias("median"))


QUERIES = {
    f.__name__: f
    for f in (
        sheet_lessons, lecture_sheets, paged_sheets, cells_by_group, reading_issues, two_readers, matrix_sheets, merged_cells, headers_found, group_rows, places_ahead, listed, previews, best_links,
        office_files, text_files, pdf_lines, file_kinds, best_readings, page_lines, word_columns, week_rows, drawn_matrix, text_matrix, clusters,
    )
}

_C = lambda c: f"trim(regexp_replace(replace({c}, chr(160), ' '), '\\s+', ' ', 'g'))"
_Z = lambda c: f"trim(regexp_replace({c}, '[\\s\\p{{Z}}]+', ' ', 'g'))"
_RULES = f"""
r AS (SELECT *, row_number() OVER w AS row, COALESCE(lag(weekday) OVER w <> weekday, TRUE) AS first FROM (
  SELECT *, list_filter(list_distinct(groups_list), lambda g: regexp_full_match(g, '[0-9]{{3}}')) AS gs FROM manual_rule WHERE weekday BETWEEN 0 AND 6 AND subject IS NOT NULL AND chair_code IS NOT NULL) WHERE len(gs) > 0 WINDOW w AS (PARTITION BY chair_code ORDER BY weekday, rule_id)),
e AS (SELECT *, unnest(gs) AS g FROM r)"""
_WEEKS = """list_filter(list_distinct(list_concat(flatten(list_transform(regexp_extract_all(s, '\\d{1,2}\\s*-\\s*\\d{1,2}'), lambda p: range(CAST(regexp_extract(p, '^\\d+') AS BIGINT), CAST(regexp_extract(p, '\\d+$') AS BIGINT) + 1))),
  list_transform(regexp_extract_all(s, '\\d{1,2}'), lambda p: CAST(p AS BIGINT)))), lambda w: w BETWEEN 1 AND 52)"""
_READ = f"""
x AS (SELECT chair_code AS doc, weekday, start_time, end_time, g AS group_code, trim({_C("subject")}, ' ,/;') AS subject, regexp_replace(weeks_spec, '[–—−]', '-', 'g') AS s, trim({_C("location_text")}, ' ,/;') AS place FROM e),
y AS (SELECT * EXCLUDE (s), {_WEEKS} AS ws FROM x),
l AS (SELECT doc, weekday, start_time, end_time, group_code, subject, unnest(CASE WHEN ws IS NULL OR len(ws) = 0 THEN [NULL] ELSE ws END)::INT AS week_number, CASE WHEN ws IS NULL THEN '' ELSE COALESCE(place, '') END AS place FROM y)"""
_ALL = _READ.replace("FROM e)", "FROM (SELECT *, 'ALL' AS g FROM manual_rule WHERE weekday BETWEEN 0 AND 6 AND chair_code IS NOT NULL AND length(trim(subject)) > 1 AND audience = 'ALL'))")
_CELL = f"trim({_C('subject')} || COALESCE(' (' || trim(weeks_spec) || ') ' || COALESCE({_C('location_text')}, ''), ''))"
_TEXT_CELL = "CASE c WHEN 0 THEN CAST(rule_id AS VARCHAR) WHEN 1 THEN COALESCE({0}, '') ELSE COALESCE({1}, '') END".format(_C("subject"), _C("location_text"))
_LISTED = f"SELECT *, right(chair_code, 1)::INT AS k, CAST(rn - 1 AS INT) AS row, c AS col, {_TEXT_CELL} AS text FROM (SELECT *, row_number() OVER (PARTITION BY chair_code ORDER BY rule_id) AS rn FROM manual_rule WHERE chair_code IS NOT NULL), (VALUES (0), (1), (2)) v(c)"
ORACLE = {
    "sheet_lessons": f"WITH {_RULES}, {_READ} SELECT * FROM l",
    "lecture_sheets": f"WITH {_ALL} SELECT * FROM l",
    "paged_sheets": f"WITH {_RULES}, {_READ} SELECT * FROM l WHERE week_number IS NOT NULL",
    "cells_by_group": f"WITH {_RULES} SELECT chair_code AS doc, CAST(row AS INT) AS row, weekday, start_time || '-' || end_time AS clock, g AS group_code, {_CELL} AS text FROM e",
    "reading_issues": f"WITH {_RULES} SELECT DISTINCT chair_code AS doc, CASE WHEN chair_code IN (SELECT chair_code FROM e) THEN 'missing groups' ELSE 'no lessons' END AS issue FROM (SELECT chair_code, unnest(groups_list) AS g FROM manual_rule WHERE chair_code IS NOT NULL) q WHERE (chair_code, g) NOT IN (SELECT chair_code, g FROM e)",
    "two_readers": f"WITH {_RULES}, {_READ} SELECT DISTINCT * FROM l",
    "matrix_sheets": f"""
WITH m AS (SELECT concat_ws('|', program_code, course, COALESCE(stream_code, '-')) AS doc, group_code, week_number AS w, arg_min(ROW(trim({_Z("subject")}, ' ,.-'), {_Z("subject")}, nullif(regexp_extract(location_text, '(\\d+[.]\\d+)', 1), '')), raw_id) AS t FROM raw_event
  WHERE regexp_full_match(group_code, '[0-9]{{3}}') AND week_number BETWEEN 1 AND 30 AND NOT regexp_matches(subject, 'ауд|каб|база|зал', 'i') GROUP BY ALL),
f AS (SELECT doc, group_code, w, last_value(m.t IGNORE NULLS) OVER (PARTITION BY doc, group_code ORDER BY w ROWS UNBOUNDED PRECEDING) AS t FROM (SELECT DISTINCT doc, group_code FROM m) CROSS JOIN (SELECT CAST(range AS INT) AS w FROM range(1, 31)) LEFT JOIN m USING (doc, group_code, w))
SELECT doc, group_code, w AS week_number, CASE WHEN t[3] IS NULL THEN t[2] ELSE t[1] END AS subject, COALESCE('ауд. ' || t[3], '') AS place FROM f WHERE t IS NOT NULL""",
    "merged_cells": "SELECT plan_code AS doc, CAST(row_number() OVER (PARTITION BY plan_code ORDER BY period_id) - 1 AS INT) AS row, c AS col, period_kind AS text FROM study_period, (VALUES (0), (1)) v(c) WHERE period_kind IS NOT NULL AND c = 0 UNION ALL SELECT plan_code, CAST(row_number() OVER (PARTITION BY plan_code ORDER BY period_id) - 1 AS INT), 1, period_kind FROM study_period WHERE period_kind IS NOT NULL",
    "headers_found": "SELECT chair_code AS doc, CAST(LEAST(length(chair_code) % 4 + right(chair_code, 1)::INT % 3, 99) AS INT) AS header_row, 4 AS words FROM manual_rule WHERE chair_code IS NOT NULL GROUP BY ALL",
    "group_rows": "SELECT concat_ws('|', program_code, course) AS doc, group_code, weekday, arg_min(subject, raw_id) AS text FROM raw_event WHERE regexp_full_match(group_code, '[0-9]{3}[А-Я]?') AND weekday BETWEEN 0 AND 6 AND trim(subject) <> '' GROUP BY ALL",
    "places_ahead": f"""
SELECT rule_id, CASE WHEN p THEN {_C("location_text")} ELSE '' END AS place, CASE WHEN p THEN trim({_C("subject")}, ' ,/;') ELSE trim({_C("concat_ws(' ', location_text, subject)")}, ' ,/;') END AS subject
FROM (SELECT *, COALESCE(regexp_matches(location_text, 'ауд[.] [0-9A-Za-zА-Я.]+$'), FALSE) AS p FROM manual_rule WHERE subject IS NOT NULL)""",
    "listed": f"WITH {_RULES} SELECT chair_code AS doc, CAST(row * 3 + 1 AS INT) AS line, weekday, start_time || ' – ' || end_time AS clock, {_C("concat_ws(' ', subject, location_text)")} AS text FROM r",
    "previews": "SELECT doc_id AS doc, substr(array_to_string(string_split(text, chr(10))[1:100], chr(10)), 1, 30000) AS text FROM documents WHERE text IS NOT NULL",
    "best_links": """
WITH s AS (SELECT CASE WHEN contains(url, '370501') THEN '37.05.01' WHEN contains(url, '310502') THEN '31.05.02' WHEN contains(url, '310501') THEN '31.05.01' END AS program, CAST(nullif(regexp_extract(url, '_([1-6])k_', 1), '') AS INT) AS c, url, CAST(regexp_extract(url, '/(\\d{4})/', 1) AS INT) AS y FROM source_provenance WHERE url LIKE '%/kug_%'),
b AS (SELECT program, c, arg_max(url, ROW(y, url)) AS url FROM s WHERE y >= 2026 GROUP BY ALL)
SELECT g.program_code AS program, g.course AS course_number, COALESCE(b.url, concat_ws('/', 'fallback', g.program_code, g.course)) AS url, CASE WHEN b.url IS NULL THEN 'fallback' ELSE 'found' END AS origin FROM (SELECT DISTINCT program_code, course FROM group_ref) g LEFT JOIN b ON b.program = g.program_code AND b.c = g.course""",
    "office_files": f"SELECT chair_code || '.bin' AS doc, ['xlsx', 'ods', 'docx', 'pptx'][k % 4 + 1] AS format, row, col, text FROM ({_LISTED}) WHERE text <> ''",
    "text_files": f"SELECT chair_code || CASE WHEN k % 3 = 2 THEN '.xlsx' ELSE '.csv' END AS doc, CASE WHEN k % 3 = 2 THEN 'html' ELSE 'csv' END AS format, row, col, text FROM ({_LISTED}) WHERE text <> ''",
    "pdf_lines": f"SELECT chair_code || '.pdf' AS doc, row // 40 + 1 AS page, row % 40 AS line, string_agg(text, ' ' ORDER BY col) AS text FROM ({_LISTED}) WHERE text <> '' GROUP BY ALL",
    "file_kinds": """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 3 THEN CASE WHEN doc_id % 4 = 1 THEN 'doc' ELSE 'xls' END WHEN 4 THEN 'rtf'
  ELSE CASE WHEN doc_id % 6 = 1 OR regexp_matches(t, '<\\s*(!doctype\\s+html|html\\b|table\\b|tr\\b|td\\b|th\\b)', 'i') THEN 'html' WHEN doc_id % 6 = 2 OR substr(ltrim(t, ' ' || chr(65279) || chr(13) || chr(10) || chr(9)), 1, 1) IN ('{', '[') THEN 'json' WHEN t = '' THEN 'empty'
    WHEN length(t) - length(replace(t, ',', '')) >= 2 OR length(t) - length(replace(t, ';', '')) >= 2 OR length(t) - length(replace(t, chr(9), '')) >= 2 THEN 'csv' ELSE 'txt' END END AS kind
FROM (SELECT doc_id, COALESCE(text, '') AS t FROM documents)""",
    "best_readings": f"WITH {_RULES}, {_READ} SELECT 'html' AS parser, doc || '.csv' AS doc, * EXCLUDE (doc) FROM l",
    "page_lines": "SELECT chair_code AS doc, course AS page, CAST(dense_rank() OVER (PARTITION BY chair_code, course ORDER BY weekday) - 1 AS INT) AS line, string_agg(CAST(rule_id AS VARCHAR), ' ' ORDER BY rule_id % 50, CAST(rule_id AS VARCHAR)) AS text FROM manual_rule WHERE weekday IS NOT NULL AND chair_code IS NOT NULL GROUP BY chair_code, course, weekday",
    "word_columns": """
WITH c AS (SELECT n, 'c' || n AS name, n * n * 10 + 50 AS x FROM range(1, 7) t(n)), b AS (SELECT name, COALESCE((x + lag(x) OVER (ORDER BY n)) / 2.0, x - 40) AS lo, COALESCE((x + lead(x) OVER (ORDER BY n)) / 2.0, x + 40) AS hi FROM c)
SELECT chair_code AS doc, rule_id, CAST(rule_id % 700 AS DOUBLE) AS x, name AS column_name FROM manual_rule JOIN b ON rule_id % 700 >= lo AND rule_id % 700 < hi WHERE chair_code IS NOT NULL""",
    "week_rows": "SELECT calendar_code AS doc, 1 AS page, 100.0::DOUBLE AS band, count(*) AS weeks, CAST((max(w) - min(w)) * 12 AS DOUBLE) AS span FROM (SELECT DISTINCT calendar_code, week_number AS w FROM academic_week WHERE week_number BETWEEN 1 AND 52) GROUP BY calendar_code HAVING count(*) >= 8",
    "drawn_matrix": """
WITH w AS (SELECT DISTINCT calendar_code AS doc, week_number AS n FROM academic_week WHERE week_number BETWEEN 1 AND 52),
c AS (SELECT doc, n AS cell, n * 10 + CASE WHEN n % 4 = 0 THEN 4.8 ELSE 0.5 END AS x0, n * 10 + CASE WHEN n % 4 = 0 THEN 5.3 ELSE 9.5 + n % 3 * 10 END AS x1, n % 3 * 30 AS y0, n % 3 * 30 + 30 + n % 2 * 30 AS y1 FROM w)
SELECT c.doc, c.cell, '10' || g AS group_code, w.n AS week_number FROM c JOIN range(0, 5) t(g) ON g * 30 + 15 BETWEEN y0 AND y1 JOIN w ON w.doc = c.doc AND ((c.cell % 4 = 0 AND w.n = c.cell) OR (c.cell % 4 <> 0 AND w.n BETWEEN c.cell AND c.cell + c.cell % 3))""",
    "text_matrix": f"WITH {_RULES}, x AS (SELECT *, CAST(regexp_extract(weeks_spec, '(\\d+)-', 1) AS INT) AS a, CAST(regexp_extract(weeks_spec, '-(\\d+)', 1) AS INT) AS z FROM r WHERE regexp_full_match(weeks_spec, 'нед[.] [0-9]+-[0-9]+')) SELECT chair_code AS doc, CAST(rule_id AS VARCHAR) AS group_code, {_C('subject')} || ' конец ауд. 1' AS text, CAST(unnest(range(a, z + 1)) AS INT) AS week_number FROM x WHERE a BETWEEN 1 AND 30 AND z BETWEEN a AND 30",
    "clusters": """
WITH v AS (SELECT DISTINCT chair_code, weekday, CAST(weekday * 100 + rule_id % 3 AS DOUBLE) AS v FROM manual_rule WHERE weekday BETWEEN 0 AND 6 AND chair_code IS NOT NULL), m AS (SELECT chair_code, list_sort(list(v)) AS vs FROM v GROUP BY ALL)
SELECT chair_code, round(avg(v), 6) AS middle, any_value(vs[CAST(len(vs) // 2 + 1 AS BIGINT)]) AS median FROM v JOIN m USING (chair_code) GROUP BY chair_code, weekday""",
}
