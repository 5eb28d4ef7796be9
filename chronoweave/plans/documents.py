"""The operators on documents as queries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import documents as docs
from chronoweave.sources.tables import table


def plan_periods(spark: SparkSession, d: str) -> DataFrame:
    """Each plan's periods written as text and read back."""
    p = table(spark, d, "study_period").where("from_date <= to_date")
    day = lambda c: F.date_format(c, "dd.MM.yyyy")
    line = F.concat_ws(" ", day("from_date"), F.lit("–"), day("to_date"), F.coalesce("period_label", F.lit("")))
    texts = p.groupBy("plan_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("period_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return docs.study_periods(texts, "plan_code", "text")


def week_lists_read(spark: SparkSession, d: str) -> DataFrame:
    """Each calendar's weeks written as text and read back."""
    w = table(spark, d, "academic_week").where("from_date <= to_date")
    day = lambda c: F.date_format(c, "dd.MM.yyyy")
    line = F.concat_ws(" ", F.col("week_number").cast("string"), day("from_date"), F.lit("-"), day("to_date"))
    row = F.struct("week_number", "from_date", "to_date", line.alias("l"))
    texts = w.groupBy("calendar_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["l"]), "; ").alias("text"))
    return docs.week_calendar(texts, "calendar_code", "text")


def date_label_audit(spark: SparkSession, d: str) -> DataFrame:
    """Years of the dates printed in documents."""
    return docs.date_labels(table(spark, d, "documents"), "doc_id", "text", 2026)


def source_links(spark: SparkSession, d: str) -> DataFrame:
    """Source pages written as pages of links, one for each month, and read back: links to timetables with what they are about
    (S2, S3, P16, F12). Half of them stand under a heading, each is there twice, and links to debts are left out."""
    s = table(spark, d, "source_provenance").select("url", F.date_format("first_seen_on", "yyyy-MM").alias("month")).distinct()
    link = lambda url, text: F.concat(F.lit("<li><a href='"), url, F.lit("#top'>"), F.lit(text), F.lit("</a></li>"))
    under = F.when(F.length("url") % 2 == 0, F.lit("<h2>Педиатрия, поток Б</h2>")).otherwise(F.lit("<h3>Расписание</h3>"))
    item = F.concat(under, link(F.col("url"), "файл"), link(F.col("url"), "ещё раз"), link(F.concat("url", F.lit(".old")), "график ликвидации задолженностей"))
    pages = s.groupBy(F.concat(F.lit("https://hub.example/"), F.coalesce("month", F.lit(""))).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("html"))
    found = docs.timetable_links(docs.links(pages, "page", "html"))
    return found.select("page", "url", "title", "heading", "program", "course_number", "stream", "kind", "mismatch")


def provenance_checks(spark: SparkSession, d: str) -> DataFrame:
    """Broken provenance of sources counted."""
    out = docs.provenance_issues(table(spark, d, "source_provenance"), "url", F.lit("2026-12-01 00:00:00").cast("timestamp"), "2026/2027")
    return out.groupBy("issue").agg(F.count("*").alias("sources"))


QUERIES = {f.__name__: f for f in (plan_periods, week_lists_read, date_label_audit, source_links, provenance_checks)}

_LOW = "lower(regexp_replace({0}, '\\s+', ' ', 'g'))"
ORACLE = {
    "plan_periods": """
SELECT DISTINCT plan_code AS doc, from_date, to_date, label, kind FROM (
  SELECT *, CASE WHEN contains(lower(label), 'праздничные дни') THEN NULL WHEN regexp_matches(lower(label), 'обучение|дискретная') THEN 'study' WHEN regexp_matches(lower(label), 'итоговая аттестация|промежуточная аттестация|сессия') THEN 'assessment'
    WHEN regexp_matches(lower(label), 'каникул') THEN 'vacation' WHEN regexp_matches(lower(label), 'практик') THEN 'practice' END AS kind
  FROM (SELECT *, regexp_replace(regexp_replace(trim(regexp_replace(COALESCE(period_label, ''), '\\s+', ' ', 'g'), ' '), '^\\d{1,2}\\s+семестр\\s*', '', 'i'), '\\s+\\d{1,2}\\s+семестр.*$', '', 'i') AS label FROM study_period WHERE from_date <= to_date)) WHERE kind IS NOT NULL""",
    "week_lists_read": """
WITH w AS (SELECT calendar_code AS doc, week_number, max({'a': from_date, 'z': to_date}) AS w FROM academic_week WHERE from_date <= to_date AND week_number >= 1 GROUP BY ALL)
SELECT doc, week_number, w.a AS from_date, w.z AS to_date, count(*) OVER (PARTITION BY doc) >= 20 AND count(*) OVER (PARTITION BY doc) = max(week_number) OVER (PARTITION BY doc) AS complete FROM w""",
    "date_label_audit": """
WITH x AS (SELECT doc_id, list_filter(regexp_extract_all(' ' || regexp_replace(text, '(\\d)', '\\1', 'g'), '\\d[\\d.]*\\d'), lambda p: regexp_full_match(p, '\\d{1,2}\\.\\d{1,2}\\.(\\d{4}|\\d{2})')) AS ls FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, list_filter(ls, lambda p: CAST(split_part(p, '.', 1) AS INT) BETWEEN 1 AND 31 AND CAST(split_part(p, '.', 2) AS INT) BETWEEN 1 AND 12) AS ls FROM x),
y AS (SELECT doc_id, len(ls) AS labels, ls[1:40] AS samples, list_sort(list_distinct(list_transform(ls, lambda p: CAST(CASE WHEN length(split_part(p, '.', 3)) = 2 THEN '20' || split_part(p, '.', 3) ELSE split_part(p, '.', 3) END AS INT)))) AS years FROM g)
SELECT doc_id AS doc, years, list_filter(years, lambda v: v < 2026 OR v > 2027) AS conflicting_years, samples, CAST(labels AS INT) AS labels FROM y""",
    "source_links": """
WITH u AS (SELECT DISTINCT url, 'https://hub.example/' || COALESCE(strftime(first_seen_on, '%Y-%m'), '') AS page, CASE WHEN length(url) % 2 = 0 THEN 'Педиатрия, поток Б' ELSE 'Расписание' END AS heading FROM source_provenance)
SELECT page, url, 'файл' AS title, heading, CASE WHEN heading <> 'Расписание' THEN '31.05.02' WHEN contains(url, '370501') THEN '37.05.01' WHEN contains(url, '310502') THEN '31.05.02' WHEN contains(url, '310501') THEN '31.05.01' END AS program,
  CAST(nullif(regexp_extract(url, '_([1-6])k_', 1), '') AS INT) AS course_number, CASE WHEN heading <> 'Расписание' THEN 'B' END AS stream, CASE WHEN contains(url, '/lec_') THEN 'lecture' WHEN contains(url, '/prak_') THEN 'practice' END AS kind, FALSE AS mismatch
FROM u WHERE regexp_matches(url, '/(lec|prak)_') AND NOT regexp_matches(url, 'likvid|zadolzh|kug')""",
    "provenance_checks": """
SELECT issue, count(*) AS sources FROM (
  SELECT 'no digest' AS issue FROM source_provenance WHERE NOT COALESCE(regexp_matches(sha256, '^[0-9a-f]{64}$'), FALSE)
  UNION ALL SELECT 'too small' FROM source_provenance WHERE COALESCE(content_bytes, 0) < 500
  UNION ALL SELECT 'stale' FROM source_provenance WHERE checked_at IS NULL OR date_diff('second', checked_at, TIMESTAMP '2026-12-01') > 36 * 3600
  UNION ALL SELECT 'from the future' FROM source_provenance WHERE date_diff('second', checked_at, TIMESTAMP '2026-12-01') < -300
  UNION ALL SELECT 'other year' FROM source_provenance WHERE academic_year_in_document IS DISTINCT FROM '2026/2027') GROUP BY issue""",
}
