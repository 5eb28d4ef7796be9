"""Words placed on pages (``doc``, ``page``, ``x``, ``y``, ``text``) brought into lines, columns and week bands."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_clusters(values: Column, tolerance: float) -> Column:
    """The averages of clusters of an array of numbers: in order, a number within ``tolerance`` of the last cluster's average joins it."""
    empty = F.array().cast("array<struct<total:double,n:int>>")

    def step(done: Column, v: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = F.abs(v - last["total"] / last["n"]) <= tolerance
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct((last["total"] + v).alias("total"), (last["n"] + 1).cast("int").alias("n"))))
        fresh = F.concat(done, F.array(F.struct(v.cast("double").alias("total"), F.lit(1).alias("n"))))
        return F.when(F.coalesce(joins, F.lit(False)), grown).otherwise(fresh).cast("array<struct<total:double,n:int>>")

    return F.transform(F.aggregate(F.array_sort(values), empty, step), lambda c: F.round(c["total"] / c["n"], 6))


def lines(words: DataFrame, tolerance: float = 3.2) -> DataFrame:
    """Words of a page in lines: a word joins the line if it lies within ``tolerance`` of the line's first word.
    ``doc``, ``page``, ``line``, ``text`` (words from left to right)."""
    word = F.struct("y", "x", "text")
    pages = words.groupBy("doc", "page").agg(F.array_sort(F.collect_list(word)).alias("ws"))
    start = F.array().cast("array<struct<y:double,ws:array<struct<x:double,text:string>>>>")

    def step(done: Column, w: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        own = F.array(F.struct(w["x"].cast("double").alias("x"), w["text"].alias("text")))
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["y"].alias("y"), F.concat(last["ws"], own).alias("ws"))))
        fresh = F.concat(done, F.array(F.struct(w["y"].cast("double").alias("y"), own.alias("ws"))))
        near = F.abs(w["y"] - last["y"]) <= tolerance
        return F.when(F.coalesce(near, F.lit(False)), grown).otherwise(fresh).cast("array<struct<y:double,ws:array<struct<x:double,text:string>>>>")

    found = pages.select("doc", "page", F.posexplode(F.aggregate("ws", start, step)).alias("line", "l"))
    return found.select("doc", "page", "line", F.array_join(F.transform(F.array_sort("l.ws"), lambda w: w["text"]), " ").alias("text"))


def column_bounds(columns: DataFrame, outer: float = 40.0) -> DataFrame:
    """Columns (``doc``, ``name``, ``x``) with the bounds halfway to their neighbours, and ``outer`` beyond the first and last: ``low``, ``high``."""
    order = Window.partitionBy("doc").orderBy("x", "name")
    low = F.coalesce((F.col("x") + F.lag("x").over(order)) / 2, F.col("x") - outer)
    high = F.coalesce((F.col("x") + F.lead("x").over(order)) / 2, F.col("x") + outer)
    return columns.select("doc", "name", "x", low.alias("low"), high.alias("high"))


def to_columns(words: DataFrame, columns: DataFrame) -> DataFrame:
    """Each word with the column between whose bounds it lies; words outside all columns are left out."""
    bounds = column_bounds(columns).select(F.col("doc").alias("__d"), "name", "low", "high")
    return words.join(bounds, (F.col("doc") == F.col("__d")) & (F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).select(*words.columns, F.col("name").alias("column_name"))


def week_bands(words: DataFrame, least: int = 8, step: float = 5.0) -> DataFrame:
    """The line of week numbers on each page: of the bands of ``step`` height with at least ``least`` different numbers the
    one with most, then the widest: ``doc``, ``page``, ``band``, ``weeks``, ``span``."""
    numbers = words.where(F.col("text").rlike(r"^\d{1,2}$") & F.col("text").cast("int").between(1, 52))
    bands = numbers.groupBy("doc", "page", (F.round(F.col("y") / step) * step).alias("band")).agg(F.count_distinct("text").alias("weeks"), (F.max("x") - F.min("x")).alias("span"))
    best = F.struct("weeks", "span", -F.col("band"), "band")
    return bands.where(F.col("weeks") >= least).groupBy("doc", "page").agg(F.max(best).alias("b")).select("doc", "page", "b.band", "b.weeks", "b.span")


def weeks_of_cells(cells: DataFrame, bands: DataFrame, least: float = 0.75) -> DataFrame:
    """The weeks whose band a cell overlaps by more than ``least``, or whose centre lies in it if it overlaps none.
    ``cells``: doc, cell, x0, x1; ``bands``: doc, week_number, a, b. Out: doc, cell, week_number."""
    b = bands.select(F.col("doc").alias("__d"), "week_number", "a", "b")
    met = cells.join(b, (F.col("doc") == F.col("__d")) & (F.col("x0") <= F.col("b")) & (F.col("x1") >= F.col("a")))
    overlap = F.least("x1", "b") - F.greatest("x0", "a")
    centre = (F.col("a") + F.col("b")) / 2
    met = met.withColumn("good", overlap > least).withColumn("centred", centre.between(F.col("x0"), F.col("x1")))
    any_ = F.max("good").over(Window.partitionBy("doc", "cell"))
    return met.withColumn("any", any_).where(F.col("good") | (~F.col("any") & F.col("centred"))).select("doc", "cell", "week_number")


def cell_lessons(cells: DataFrame, bands: DataFrame, groups: DataFrame, least: float = 0.75) -> DataFrame:
    """The weeks and groups that the drawn cells of a week matrix stand for (G18): ``doc``, ``cell``, ``group_code``, ``week_number``.

    ``cells``: doc, cell, x0, x1, y0, y1; ``bands``: doc, week_number, a, b; ``groups``: doc, group_code, y (the middle of its row).
    A cell merged over several rows holds for every group whose row's middle lies in it, one merged over several columns for
    every week as in ``weeks_of_cells``.
    """
    weeks = weeks_of_cells(cells, bands, least)
    rows = groups.select(F.col("doc").alias("__d"), "group_code", "y")
    inside = cells.join(rows, (F.col("doc") == F.col("__d")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))).select("doc", "cell", "group_code")
    return inside.join(weeks, ["doc", "cell"]).select("doc", "cell", "group_code", "week_number")


_BLOCKS = "doc string, group_code string, x0 double, x1 double, text string"


def _row_blocks(words: pd.DataFrame) -> list[tuple[str, str, float, float, str]]:
    """The words of one group's row as blocks: lines of words of like height, and lines joined that overlap and lie close."""
    blocks: list[list] = []  # x0, x1, y, text
    for w in words.sort_values(["y", "x0", "text"]).itertuples():
        if blocks and abs(w.y - blocks[-1][2]) <= 4:
            last = blocks[-1]
            last[0], last[1], last[3] = min(last[0], w.x0), max(last[1], w.x1), f"{last[3]} {w.text}"
        else:
            blocks.append([w.x0, w.x1, w.y, w.text])
    joined: list[list] = []
    for b in blocks:
        if joined and abs(b[2] - joined[-1][2]) <= 18 and b[0] < joined[-1][1] + words["spacing"].iloc[0] * 0.35:
            last = joined[-1]
            last[0], last[1], last[2], last[3] = min(last[0], b[0]), max(last[1], b[1]), (last[2] + b[2]) / 2, f"{last[3]} {b[3]}"
        else:
            joined.append(b)
    return [(words["doc"].iloc[0], words["group_code"].iloc[0], b[0], b[1], b[3]) for b in joined]


def matrix_blocks(words: DataFrame, weeks: DataFrame, groups: DataFrame) -> DataFrame:
    """The text blocks in each group's row of a week matrix without drawn lines (G19): ``doc``, ``group_code``, ``x0``, ``x1``, ``text``.

    ``words``: doc, x0, x1, y, text; ``weeks``: doc, week_number, x (middles of columns); ``groups``: doc, group_code, y (middles of
    rows). Rows reach halfway to their neighbours, 40 beyond the first and last; the table three quarters of a column beyond its
    weeks. A row of a page is one group of bounded size.
    """
    rows = column_bounds(groups.select("doc", F.col("group_code").alias("name"), F.col("y").alias("x")), 20.0).select(F.col("doc").alias("__d"), F.col("name").alias("group_code"), "low", "high")
    span = week_spacing(weeks).select(F.col("doc").alias("__e"), "spacing", (F.col("first") - F.col("spacing") * 0.75).alias("left"), (F.col("last") + F.col("spacing") * 0.75).alias("right"))
    middle = (F.col("x0") + F.col("x1")) / 2
    inside = words.join(rows, (F.col("doc") == F.col("__d")) & (F.col("y") > F.col("low") + 1) & (F.col("y") < F.col("high") - 1))
    inside = inside.join(span, F.col("doc") == F.col("__e")).where((middle > F.col("left") + 1) & (middle < F.col("right") - 1) & ~F.col("text").rlike("^[0-9]{3}$"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_row_blocks(frame), columns=["doc", "group_code", "x0", "x1", "text"])

    return inside.select("doc", "group_code", "x0", "x1", "y", "text", "spacing").groupBy("doc", "group_code").applyInPandas(run, _BLOCKS)


def week_spacing(weeks: DataFrame) -> DataFrame:
    """The usual distance of the columns of weeks (upper median), and where the first and last are: ``doc``, ``spacing``, ``first``, ``last``."""
    xs = weeks.groupBy("doc").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    steps = F.transform(F.sequence(F.lit(2), F.size("xs")), lambda k: F.element_at("xs", k) - F.element_at("xs", k - 1))
    spacing = F.coalesce(F.when(F.size("xs") > 1, upper_median(steps)), F.lit(1.0))
    return xs.select("doc", spacing.alias("spacing"), F.array_min("xs").alias("first"), F.array_max("xs").alias("last"))


def weeks_of_blocks(blocks: DataFrame, weeks: DataFrame) -> DataFrame:
    """The weeks that text blocks stand for: of a block about as wide as a column the weeks within half a column of the nearest
    middle, of a wider one all whose middle it covers: the columns of ``blocks`` and ``week_number``."""
    numbered = blocks.join(week_spacing(weeks).select(F.col("doc").alias("__d"), "spacing"), F.col("doc") == F.col("__d")).drop("__d")
    middles = weeks.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("x", "week_number"))).alias("ws")).withColumnRenamed("doc", "__e")
    met = numbered.join(middles, F.col("doc") == F.col("__e"))
    centre = (F.col("x0") + F.col("x1")) / 2
    nearest = F.array_min(F.transform("ws", lambda w: F.struct(F.abs(w["x"] - centre).alias("far"), w["x"].alias("x"))))["x"]
    wide = F.col("x1") - F.col("x0") > F.col("spacing") * 0.95
    covered = lambda w: (w["x"] >= F.col("x0") - F.col("spacing") * 0.12) & (w["x"] <= F.col("x1") + F.col("spacing") * 0.12)
    found = F.filter("ws", lambda w: F.when(wide, covered(w)).otherwise(F.abs(w["x"] - F.col("__near")) <= F.col("spacing") * 0.51))
    return met.withColumn("__near", nearest).select(*blocks.columns, F.explode(F.array_distinct(F.transform(found, lambda w: w["week_number"]))).alias("week_number"))


def upper_median(values: Column) -> Column:
    """The middle number of an array in order, the upper one of two."""
    return F.try_element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)
