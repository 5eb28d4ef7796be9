"""The queries for training data over whole tables, and SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.bpe import token_counts, token_ids
from chronoweave.llm.duplicates import copies, distinct_records
from chronoweave.llm.lookalikes import canonical_values, odd_rows
from chronoweave.llm.mixing import mix
from chronoweave.llm.mojibake import garbled, restored
from chronoweave.llm.names import people, person_rows
from chronoweave.sources.tables import table

EXACT = ["program_code", "course", "group_code", "stream_code", "week_number", "weekday", "start_time", "end_time", "lesson_type", "half"]
FREE = ["subject", "location_text", "teacher"]
LOOKS = ["subject", "location_text", "stream_code"]


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Every copy of a lesson with the smallest raw_id of its copies."""
    rows = copies(table(spark, directory, "raw_event"), "raw_id", EXACT, FREE)
    return rows.where("id <> rep").select(F.col("rep").alias("raw_id_a"), F.col("id").alias("raw_id_b"))


def p3_lessons(spark: SparkSession, directory: str) -> DataFrame:
    """Each lesson once, with the number of its copies."""
    return distinct_records(table(spark, directory, "raw_event"), "raw_id", EXACT, FREE).withColumnRenamed("rep", "raw_id")


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Values of schedule_event that are not plain."""
    return odd_rows(table(spark, directory, "schedule_event"), "event_id", LOOKS).select("event_id", "field_name").distinct()


def p5_forms(spark: SparkSession, directory: str) -> DataFrame:
    """Every value that is not in its one form, with that form."""
    return canonical_values(table(spark, directory, "schedule_event"), LOOKS)


def p6_people(spark: SparkSession, directory: str) -> DataFrame:
    """Every rule that names a person, with the person and the number of other rules linked to it."""
    rows = people(table(spark, directory, "manual_rule"), "rule_id", "chair_code", "teacher")
    size = rows.groupBy("person").agg((F.count("*") - 1).alias("links"))
    return rows.join(size, "person").select("rule_id", "chair_code", "person", "links")


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    """Every pair of rules of a chair that mean the same person."""
    rows = person_rows(table(spark, directory, "manual_rule"), "rule_id", "chair_code", "teacher")
    one = rows.select("person", F.col("rule_id").alias("rule_id_a"))
    other = rows.select("person", F.col("rule_id").alias("rule_id_b"))
    return one.join(other, "person").where("rule_id_a < rule_id_b").select("rule_id_a", "rule_id_b")


def p7_ids(spark: SparkSession, directory: str) -> DataFrame:
    """Every document with the ids of its whole text by byte_bpe_50k."""
    return token_ids(table(spark, directory, "documents"), "text", ["doc_id"])


def _mixed(spark: SparkSession, directory: str, total: int | str | None = None) -> tuple[DataFrame, DataFrame]:
    counted = token_counts(table(spark, directory, "documents"), "text", ["doc_id", "source"])
    return mix(counted, "doc_id", "source", "tokens", table(spark, directory, "mix_target"), total)


def p8_mix(spark: SparkSession, directory: str) -> DataFrame:
    """The documents that make up the mixture, with their repeats."""
    return _mixed(spark, directory)[0]


def p8_shares(spark: SparkSession, directory: str) -> DataFrame:
    """What each source holds in the mixture, against its target."""
    return _mixed(spark, directory)[1]


def p8_shares_of_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """The same for a mixture as large as the corpus, in which scarce sources fall short of their targets."""
    return _mixed(spark, directory, "available")[1]


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents whose text was read in a wrong encoding, wholly or in part."""
    return garbled(table(spark, directory, "documents"), "doc_id", "text")[0].select(F.col("doc").alias("doc_id"))


def p9_restored(spark: SparkSession, directory: str) -> DataFrame:
    """The garbled documents with their text brought back as far as it can be."""
    return restored(table(spark, directory, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p3_found, p3_lessons, p5_found, p5_forms, p6_people, p6_found, p7_ids, p8_mix, p8_shares, p8_shares_of_corpus, p9_found, p9_restored)}


def _bare_sql(c: str) -> str:
    """RE2 has no lookaround: signs between digits are wrapped first (twice, as neighbours share a digit), the rest dropped, and the wrapping taken off."""
    sign = "[\\p{P}$+<=>^`|~]"
    wrap = f"regexp_replace(lower({c}), '(\\p{{Nd}})({sign})(\\p{{Nd}})', '\\1\x02\\2\x03\\3', 'g')"
    wrap = f"regexp_replace({wrap}, '(\\p{{Nd}})({sign})(\\p{{Nd}})', '\\1\x02\\2\x03\\3', 'g')"
    kept = f"regexp_replace({wrap}, '\x02({sign})\x03|[\\s\\p{{Z}}\\x{{0}}-\\x{{1}}\\x{{4}}-\\x{{1f}}\\x{{7f}}-\\x{{9f}}\\x{{200b}}\\x{{2060}}\\x{{feff}}]|{sign}', '\\1', 'g')"
    return f"COALESCE('=' || {kept}, '0')"


_P3 = f"""
WITH k AS (SELECT raw_id, {", ".join(EXACT)}, list_sort([{", ".join(map(_bare_sql, FREE))}]) AS free FROM raw_event WHERE raw_id IS NOT NULL)
SELECT raw_id, min(raw_id) OVER (PARTITION BY {", ".join(EXACT)}, free) AS rep FROM k"""

ORACLE = {
    "p3_found": f"SELECT rep AS raw_id_a, raw_id AS raw_id_b FROM ({_P3}) WHERE rep <> raw_id",
    "p3_lessons": f"SELECT rep AS raw_id, count(*) AS copies FROM ({_P3}) GROUP BY rep",
}
