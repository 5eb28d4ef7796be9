"""The general data-processing queries over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.intervals import periods_and_gaps
from chronoweave.operators.references import orphan_rows, packed_key, report, unheld_references
from chronoweave.operators.snapshots import snapshot_changes
from chronoweave.sources.tables import table

CONTENT = ["program_code", "course", "group_code", "stream_code", "event_date", "start_time", "end_time", "subject", "location_text", "teacher", "lesson_type"]
CLOCKS = ["start_time", "end_time"]


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Events added, removed or changed in each delivered snapshot."""
    return snapshot_changes(table(spark, directory, "event_snapshot"), "event_id", "snapshot_no", CONTENT, CLOCKS)


def p1_changes_per_snapshot(spark: SparkSession, directory: str) -> DataFrame:
    """How many events came in, went out or changed per delivery."""
    return p1_found(spark, directory).groupBy("snapshot_no", "change_kind").agg(F.count("*").alias("events"))


def _references(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """All references in one table (kind-prefixed key, day, where from), and all targets alike."""
    groups = packed_key(F.lit("group"), F.col("program_code"), F.col("course"), F.upper(_bare("group_code")))
    urls = packed_key(F.lit("url"), F.substring_index("source_url", "#", 1))
    asked = []
    for name, row_key, day in (("schedule_event", "event_id", "ingested_on"), ("roster", "roster_id", "listed_on")):
        rows = table(spark, directory, name)
        a_group = F.col("group_code").isNotNull() & (F.upper(_bare("group_code")) != "ALL")
        fields = F.array(
            F.when(a_group, F.struct(F.lit("group_code").alias("ref_field"), groups.alias("key"))),
            F.when(F.col("source_url").isNotNull(), F.struct(F.lit("source_url").alias("ref_field"), urls.alias("key"))),
        )
        asked.append(
            rows.select(F.lit(name).alias("table_name"), F.col(row_key).cast("string").alias("row_key"), F.col(day).alias("day"), F.explode(F.array_compact(fields)).alias("f"))
            .select("table_name", "row_key", "day", F.col("f.ref_field").alias("ref_field"), F.col("f.key").alias("key"))
        )
    held = table(spark, directory, "group_ref").where(F.col("group_code").isNotNull()).select(groups.alias("key"), F.col("opened_on").alias("first"), F.col("closed_on").alias("last"))
    pages = table(spark, directory, "source_provenance").where(F.col("url").isNotNull())
    pages = pages.select(packed_key(F.lit("url"), F.substring_index("url", "#", 1)).alias("key"), F.col("first_seen_on").alias("first"), F.col("withdrawn_on").alias("last"))
    return asked[0].unionByName(asked[1]), held.unionByName(pages)


# All blanks of Unicode.
_BLANKS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _bare(name: str) -> F.Column:
    """Without blanks of any kind around it."""
    return F.trim(F.col(name), F.lit(_BLANKS))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """References to groups and source pages that did not hold on their day."""
    asked, held = _references(spark, directory)
    missed = unheld_references(asked, held, "key", "day", "key", "first", "last")
    month = F.date_format("day", "yyyy-MM").alias("ref_month")
    return orphan_rows(asked, missed, "key", "day").select("table_name", "row_key", "ref_field", "reason", month).distinct()


def p2_report(spark: SparkSession, directory: str) -> DataFrame:
    """Orphan references counted per table, field, reason and month."""
    return report(p2_found(spark, directory))


def _intervals(spark: SparkSession, directory: str) -> DataFrame:
    parts = [
        table(spark, directory, name).select(F.lit(name).alias("table_name"), F.col(code).alias("entity_code"), "from_date", "to_date")
        for name, code in (("study_period", "plan_code"), ("academic_week", "calendar_code"))
    ]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Continuous periods of study plans and week calendars, and the gaps between them."""
    return periods_and_gaps(_intervals(spark, directory), ["table_name", "entity_code"], "from_date", "to_date")


def p4_days_per_entity(spark: SparkSession, directory: str) -> DataFrame:
    """Covered and free days of every entity."""
    days = F.datediff(F.col("to_day").cast("date"), F.col("from_day").cast("date")) + 1
    return p4_found(spark, directory).groupBy("table_name", "entity_code").agg(
        F.sum(F.when(F.col("piece") == "period", days).otherwise(0)).alias("covered_days"), F.sum(F.when(F.col("piece") == "gap", days).otherwise(0)).alias("free_days")
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_changes_per_snapshot, p2_found, p2_report, p4_found, p4_days_per_entity)}


def _clock_sql(c: str) -> str:
    hour, minute, second = (f"TRY_CAST(regexp_extract({c}, '^\\s*(\\d{{1,2}})[:.](\\d{{2}})(?:[:.](\\d{{2}}))?\\s*$', {k}) AS INT)" for k in (1, 2, 3))
    return f"CASE WHEN {hour} < 24 AND {minute} < 60 AND COALESCE({second}, 0) < 60 THEN CAST({hour} * 3600 + {minute} * 60 + COALESCE({second}, 0) AS VARCHAR) ELSE '?' || trim({c}) END"


_P1 = f"""
WITH content AS (
  SELECT DISTINCT event_id, snapshot_no,
    hash(ROW(program_code, course, group_code, stream_code, event_date, {_clock_sql("start_time")}, {_clock_sql("end_time")}, subject, location_text, teacher, lesson_type)) AS h
  FROM event_snapshot WHERE event_id IS NOT NULL AND snapshot_no IS NOT NULL),
one AS (SELECT event_id, snapshot_no, list_sort(list(DISTINCT h)) AS hs FROM content GROUP BY ALL),
d AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT snapshot_no FROM event_snapshot WHERE snapshot_no IS NOT NULL)),
pairs AS (SELECT * FROM d WHERE before IS NOT NULL)
SELECT CAST(p.snapshot_no AS INT) AS snapshot_no, n.event_id, CASE WHEN o.event_id IS NULL THEN 'added' ELSE 'changed' END AS change_kind
FROM pairs p JOIN one n ON n.snapshot_no = p.snapshot_no LEFT JOIN one o ON o.snapshot_no = p.before AND o.event_id = n.event_id
WHERE o.event_id IS NULL OR o.hs <> n.hs
UNION ALL
SELECT CAST(p.snapshot_no AS INT), o.event_id, 'removed'
FROM pairs p JOIN one o ON o.snapshot_no = p.before LEFT JOIN one n ON n.snapshot_no = p.snapshot_no AND n.event_id = o.event_id
WHERE n.event_id IS NULL"""

_P2 = """
WITH rows AS (
  SELECT 'schedule_event' AS table_name, event_id AS row_key, program_code, course, group_code, source_url, ingested_on AS day FROM schedule_event
  UNION ALL SELECT 'roster', CAST(roster_id AS VARCHAR), program_code, course, group_code, source_url, listed_on FROM roster),
refs AS (
  SELECT table_name, row_key, 'group_code' AS ref_field, ROW('g', program_code, CAST(course AS VARCHAR), upper(trim(group_code))) AS k, day
  FROM rows WHERE group_code IS NOT NULL AND upper(trim(group_code)) <> 'ALL'
  UNION ALL SELECT table_name, row_key, 'source_url', ROW('u', split_part(source_url, '#', 1), NULL, NULL), day FROM rows WHERE source_url IS NOT NULL),
targets AS (
  SELECT ROW('g', program_code, CAST(course AS VARCHAR), upper(trim(group_code))) AS k, opened_on AS a, closed_on AS z FROM group_ref
  UNION ALL SELECT ROW('u', split_part(url, '#', 1), NULL, NULL), first_seen_on, withdrawn_on FROM source_provenance),
asked AS (SELECT DISTINCT k, day FROM refs),
judged AS (
  SELECT q.k, q.day,
    CASE WHEN count(t.k) = 0 THEN 'missing' WHEN bool_or(t.z <= q.day) THEN 'deleted' ELSE 'late' END AS reason,
    COALESCE(bool_or(t.k IS NOT NULL AND COALESCE(t.a <= q.day, TRUE) AND (t.z IS NULL OR t.z > q.day)), FALSE) AS holds
  FROM asked q LEFT JOIN targets t ON t.k IS NOT DISTINCT FROM q.k GROUP BY q.k, q.day)
SELECT DISTINCT r.table_name, r.row_key, r.ref_field, j.reason, strftime(r.day, '%Y-%m') AS ref_month
FROM refs r JOIN judged j ON j.k IS NOT DISTINCT FROM r.k AND j.day IS NOT DISTINCT FROM r.day
WHERE NOT j.holds AND (j.day IS NOT NULL OR j.reason = 'missing')"""

_P4 = """
WITH x AS (
  SELECT 'study_period' AS table_name, plan_code AS entity_code, from_date AS a, to_date AS z FROM study_period WHERE from_date <= to_date
  UNION ALL SELECT 'academic_week', calendar_code, from_date, to_date FROM academic_week WHERE from_date <= to_date),
marked AS (
  SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY table_name, entity_code ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM x),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY table_name, entity_code ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS run FROM marked),
periods AS (SELECT table_name, entity_code, min(a) AS a, max(z) AS z FROM numbered GROUP BY table_name, entity_code, run),
spans AS (SELECT *, lead(a) OVER (PARTITION BY table_name, entity_code ORDER BY a) AS later FROM periods)
SELECT table_name, entity_code, 'period' AS piece, strftime(a, '%Y-%m-%d') AS from_day, strftime(z, '%Y-%m-%d') AS to_day FROM periods
UNION ALL SELECT table_name, entity_code, 'gap', strftime(CAST(z + 1 AS DATE), '%Y-%m-%d'), strftime(CAST(later - 1 AS DATE), '%Y-%m-%d') FROM spans WHERE later IS NOT NULL"""

ORACLE = {
    "p1_found": _P1,
    "p1_changes_per_snapshot": f"SELECT snapshot_no, change_kind, count(*) AS events FROM ({_P1}) GROUP BY ALL",
    "p2_found": _P2,
    "p2_report": f'SELECT table_name, ref_field, reason, ref_month, count(*) AS "references" FROM ({_P2}) GROUP BY ALL',
    "p4_found": _P4,
    "p4_days_per_entity": f"""SELECT table_name, entity_code,
  CAST(sum(CASE WHEN piece = 'period' THEN CAST(to_day AS DATE) - CAST(from_day AS DATE) + 1 ELSE 0 END) AS BIGINT) AS covered_days,
  CAST(sum(CASE WHEN piece = 'gap' THEN CAST(to_day AS DATE) - CAST(from_day AS DATE) + 1 ELSE 0 END) AS BIGINT) AS free_days
FROM ({_P4}) GROUP BY ALL""",
}
