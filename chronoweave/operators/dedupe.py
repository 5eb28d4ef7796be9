"""Duplicates by a key: kept first, kept best, or reported."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.text import clean_location, clean_subject, clean_teacher, group_code, semantic_text
from chronoweave.operators.references import packed_key


def event_key(teacher: bool = True) -> list[Column]:
    """The parts of an event's meaning: two events with equal parts are one lesson. Halves (1/2, 2/2) always stay apart."""
    low = lambda c: F.lower(c)
    parts = [F.col("program_code"), F.col("course"), group_code(F.col("group_code")), F.col("stream_code"), F.col("event_date"), F.col("start_time"), F.col("end_time")]
    parts += [low(clean_subject(F.col("subject"))), low(clean_location(F.col("location_text")))]
    return [*parts, *([low(clean_teacher(F.col("teacher")))] if teacher else []), F.col("lesson_type"), F.col("half")]


def keep_best(df: DataFrame, key: Sequence[Column], best: Column, order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the largest ``best`` (null counts as 0), the first by ``order`` among equals.

    It is an aggregation with a combine before the shuffle, not a window: a key with a third of all rows costs one row per
    task. Rows are grouped by a 128-bit digest of the key instead of its many texts. Nulls in the key are equal to each other.
    """
    columns = df.columns
    # Smaller wins: the largest ``best`` first, then the order.
    rank = F.struct((-F.coalesce(best, F.lit(0.0))).alias("b"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)])
    row = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)])
    grouped = df.groupBy(F.md5(packed_key(*key)).alias("__key")).agg(F.min_by(row, rank).alias("__row"))
    return grouped.select(*[F.col(f"__row.c{k}").alias(c) for k, c in enumerate(columns)])


def keep_first(df: DataFrame, key: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order``."""
    return keep_best(df, key, F.lit(0.0), order)


def duplicates(df: DataFrame, key: Sequence[Column]) -> DataFrame:
    """How many rows more than one each key has, and how many keys there are with any: ``extra_rows``, ``keys``."""
    counted = df.groupBy(*[k.alias(f"__k{n}") for n, k in enumerate(key)]).agg((F.count("*") - 1).alias("extra"))
    return counted.where("extra > 0").agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("extra_rows"), F.count("*").alias("keys"))


def keep_lowest_rank(rows: DataFrame, key: Sequence[str], rank: Column) -> DataFrame:
    """All rows whose rank is the lowest of their key: several sources, of which for each key the first that has it wins.
    Rows without a rank are left out; null keys are equal."""
    marked = rows.where(rank.isNotNull()).withColumns({"__key": F.md5(packed_key(*[F.col(k) for k in key])), "__rank": rank})
    best = marked.groupBy("__key").agg(F.min("__rank").alias("__best"))
    return marked.join(best, "__key").where("__rank = __best").drop("__key", "__rank", "__best")


def semantic_key() -> list[Column]:
    """The older meaning of an event: texts of letters and digits only, ё as е, and the parts of a double block apart."""
    return [F.col("event_date"), F.col("start_time"), F.col("end_time"), semantic_text(F.col("subject")), semantic_text(F.coalesce("location_text", F.lit(""))), F.col("lesson_type")]


def union_first_wins(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows of the first table, and those of the second whose key the first doesn't have. Null keys are equal."""
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return first.unionByName(second.alias("a").join(first.select(*key).distinct().alias("b"), condition, "left_anti").select("a.*"))
