"""Reports over events, rules and periods, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import temporal, text
from chronoweave.functions.clock import minutes_of_day
from chronoweave.operators import dedupe, joins
from chronoweave.plans.timetable import _clean, _minutes
from chronoweave.sources.tables import table


def subject_badges(spark: SparkSession, d: str) -> DataFrame:
    """How many typed rules there are for each subject of events, letter case ignored."""
    key = lambda: F.lower(text.clean_text(F.col("subject"))).alias("subject_key")
    rules = table(spark, d, "manual_rule").where("subject IS NOT NULL").groupBy(key()).agg(F.count("*").alias("rules"))
    return table(spark, d, "schedule_event").where("subject IS NOT NULL").select(key()).distinct().join(rules, "subject_key", "left").fillna(0, ["rules"])


def all_subjects_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The different subjects of events and typed rules in the order of the Russian alphabet, empty ones left out."""
    found = _subjects(spark, d, "schedule_event").distinct().unionByName(_subjects(spark, d, "manual_rule").distinct())
    return found.where("subject <> ''").distinct().orderBy(F.collate("subject", "ru"), "subject")


def _subjects(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name).where("subject IS NOT NULL").select(text.clean_text(F.col("subject")).alias("subject"))


def merged_periods(spark: SparkSession, d: str) -> DataFrame:
    """Plan periods, with assessments added only where the plan has none of the same days."""
    p = table(spark, d, "study_period").select("plan_code", "from_date", "to_date", "period_kind")
    curated, extra = p.where("period_kind <> 'assessment'"), p.where("period_kind = 'assessment'")
    return dedupe.union_first_wins(curated, extra, ["plan_code", "from_date", "to_date"])


def period_slots(spark: SparkSession, d: str) -> DataFrame:
    """Weeks of the calendars that plan periods of the same academic year overlap, closed on both sides (P6, P7): counted per plan and kind."""
    year = "academic_year"
    days = lambda c: F.unix_date(c)
    weeks = table(spark, d, "academic_week").where("from_date <= to_date").select(year, "week_number", days("from_date").alias("wa"), days("to_date").alias("wz")).distinct()
    plans = table(spark, d, "study_period").where("from_date <= to_date").select("plan_code", "period_kind", year, days("from_date").alias("a"), days("to_date").alias("z")).distinct()
    met = joins.overlapping(plans, weeks, [year], ("a", "z", "wa", "wz"), width=28, closed=True)
    return met.groupBy("plan_code", "period_kind").agg(F.count_distinct("week_number").alias("weeks"))


def day_board(spark: SparkSession, d: str) -> DataFrame:
    """Per program and course: events on a day, in its week, and after it."""
    day = F.lit("2026-11-16").cast("date")
    when = F.col("event_date")
    week = when.between(temporal.monday_of(day), F.date_add(temporal.monday_of(day), 6))
    return table(spark, d, "schedule_event").groupBy("program_code", "course").agg(
        F.count_if(when == day).alias("today"), F.count_if(week).alias("this_week"), F.count_if(when > day).alias("later"), F.count("*").alias("total")
    )


def days_in_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Whether the day of an event lies in one of the weeks that it names, counted from the anchor (V4): per course."""
    e = table(spark, d, "schedule_event").where("event_date IS NOT NULL AND weeks_spec IS NOT NULL")
    fits = F.array_contains(text.week_list(F.col("weeks_spec")), temporal.week_number(F.col("event_date")))
    return e.groupBy("program_code", "course").agg(F.count_if(fits).alias("inside"), F.count_if(~fits).alias("outside"))


def room_tails(spark: SparkSession, d: str) -> DataFrame:
    """Places with a word after the room, which may be a subject that ran into them (V5): raw_event, each text once with its number."""
    tail = r"(?iu)(?:(?:^|[^\p{L}])(?:ауд|каб)\.?\s*[a-zа-я0-9./№-]+|(?:^|[,;]\s*)[a-zа-я]?[0-9]+[./][a-zа-я0-9./№-]+)\s+[а-яёa-z][а-яёa-z-]+(?:\s+[а-яёa-z-]{2,}){0,8}$"
    e = table(spark, d, "raw_event").where(text.clean_text(F.col("location_text")).rlike(tail))
    return e.groupBy("location_text").agg(F.count("*").alias("rows_hit"))


def long_days(spark: SparkSession, d: str) -> DataFrame:
    """The ten group days with most minutes of lessons: a top-k report."""
    length = minutes_of_day(F.col("end_time")) - minutes_of_day(F.col("start_time"))
    e = table(spark, d, "schedule_event").where("event_date IS NOT NULL AND group_code IS NOT NULL").select("program_code", "group_code", "event_date", "event_id", length.alias("m")).distinct()
    sums = e.groupBy("program_code", "group_code", "event_date").agg(F.sum("m").alias("minutes"))
    return sums.orderBy(F.desc("minutes"), "program_code", "group_code", "event_date").limit(10)


def capture_lag(spark: SparkSession, d: str) -> DataFrame:
    """Per parser: captures, distinct sources, and the upper median of weeks."""
    r = table(spark, d, "raw_event")
    weeks = r.groupBy("parser_name", "week_number").agg(F.count("*").alias("n"))

    order = Window.partitionBy("parser_name").orderBy("week_number")
    upto = weeks.select("parser_name", "week_number", "n", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy("parser_name")).alias("all"))
    middle = upto.where("upto - n <= all div 2 AND upto > all div 2").select("parser_name", F.col("week_number").alias("median_week"))
    counts = r.groupBy("parser_name").agg(F.count("*").alias("captures"), F.count_distinct("source_url").alias("sources"))
    return counts.join(middle, "parser_name", "left")


QUERIES = {f.__name__: f for f in (subject_badges, all_subjects_in_order, merged_periods, period_slots, day_board, days_in_weeks, room_tails, long_days, capture_lag)}

ORACLE = {
    "subject_badges": f"""
WITH e AS (SELECT DISTINCT lower({_clean("subject")}) AS k FROM schedule_event WHERE subject IS NOT NULL), r AS (SELECT lower({_clean("subject")}) AS k, count(*) AS n FROM manual_rule WHERE subject IS NOT NULL GROUP BY 1)
SELECT e.k AS subject_key, COALESCE(r.n, 0) AS rules FROM e LEFT JOIN r USING (k)""",
    "all_subjects_in_order": f"""
SELECT subject FROM (SELECT {_clean('subject')} AS subject FROM schedule_event WHERE subject IS NOT NULL UNION SELECT {_clean('subject')} FROM manual_rule WHERE subject IS NOT NULL) WHERE subject <> ''""",
    "merged_periods": """
SELECT plan_code, from_date, to_date, period_kind FROM study_period WHERE period_kind <> 'assessment'
UNION ALL SELECT plan_code, from_date, to_date, period_kind FROM study_period a WHERE period_kind = 'assessment' AND NOT EXISTS (
  SELECT 1 FROM study_period b WHERE b.period_kind <> 'assessment' AND b.plan_code IS NOT DISTINCT FROM a.plan_code AND b.from_date IS NOT DISTINCT FROM a.from_date AND b.to_date IS NOT DISTINCT FROM a.to_date)""",
    "period_slots": """
WITH w AS (SELECT DISTINCT academic_year, week_number, from_date, to_date FROM academic_week WHERE from_date <= to_date), p AS (SELECT DISTINCT plan_code, period_kind, academic_year, from_date, to_date FROM study_period WHERE from_date <= to_date)
SELECT plan_code, period_kind, count(DISTINCT week_number) AS weeks FROM p JOIN w ON p.academic_year IS NOT DISTINCT FROM w.academic_year AND p.from_date <= w.to_date AND w.from_date <= p.to_date GROUP BY ALL HAVING count(*) > 0""",
    "day_board": """
SELECT program_code, course, count(*) FILTER (event_date = DATE '2026-11-16') AS today, count(*) FILTER (event_date BETWEEN DATE '2026-11-16' AND DATE '2026-11-22') AS this_week, count(*) FILTER (event_date > DATE '2026-11-16') AS later, count(*) AS total FROM schedule_event GROUP BY ALL""",
    "days_in_weeks": f"""
WITH e AS (SELECT *, CAST(floor((date_trunc('week', event_date)::DATE - DATE '2026-08-31') / 7) + 1 AS INT) AS w, regexp_replace(weeks_spec, '[–—−]', '-', 'g') AS s FROM schedule_event WHERE event_date IS NOT NULL AND weeks_spec IS NOT NULL),
x AS (SELECT *, w BETWEEN 1 AND 52 AND list_contains(list_concat(flatten(list_transform(regexp_extract_all(s, '\\d{{1,2}}\\s*-\\s*\\d{{1,2}}'), lambda p: range(CAST(regexp_extract(p, '^\\d+') AS BIGINT), CAST(regexp_extract(p, '\\d+$') AS BIGINT) + 1))), list_transform(regexp_extract_all(s, '\\d{{1,2}}'), lambda p: CAST(p AS BIGINT))), w) AS fits FROM e)
SELECT program_code, course, count(*) FILTER (fits) AS inside, count(*) FILTER (NOT fits) AS outside FROM x GROUP BY ALL""",
    "room_tails": f"""
SELECT location_text, count(*) AS rows_hit FROM raw_event WHERE regexp_matches({_clean("location_text")}, '(?:(?:^|[^\\p{{L}}])(?:ауд|каб)\\.?\\s*[a-zа-я0-9./№-]+|(?:^|[,;]\\s*)[a-zа-я]?[0-9]+[./][a-zа-я0-9./№-]+)\\s+[а-яёa-z][а-яёa-z-]+(?:\\s+[а-яёa-z-]{{2,}}){{0,8}}$', 'i') GROUP BY ALL""",
    "long_days": f"""
SELECT program_code, group_code, event_date, sum(m)::BIGINT AS minutes FROM (SELECT DISTINCT program_code, group_code, event_date, event_id, {_minutes("end_time")} - {_minutes("start_time")} AS m FROM schedule_event WHERE event_date IS NOT NULL AND group_code IS NOT NULL)
GROUP BY ALL ORDER BY minutes DESC, program_code, group_code, event_date LIMIT 10""",
    "capture_lag": """
SELECT parser_name, count(*) AS captures, count(DISTINCT source_url) AS sources, list_sort(list(week_number))[CAST(count(week_number) // 2 + 1 AS BIGINT)] AS median_week FROM raw_event GROUP BY parser_name""",
}
