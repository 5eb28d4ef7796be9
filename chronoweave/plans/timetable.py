"""The operators of the core as queries over whole tables, each with its SQL twin."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import temporal, text
from chronoweave.functions.clock import minutes_of_day
from chronoweave.operators import coverage, dedupe, grid, islands, joins, recurrence, scope
from chronoweave.sources import sinks
from chronoweave.sources.tables import table
from chronoweave.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Callable], Callable]:
    """Register a query by its name, with its SQL twin if SQL can say it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# The text functions in RE2, which has no lookaround and takes \b for ASCII only.
def _clean(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g'), '[\\s\\x{{0B}}\\x{{A0}}]+', ' ', 'g'), ' ')"


def _subject(c: str) -> str:
    x = f"regexp_replace({_clean(c)}, '[–—−]', '-', 'g')"
    x = f"regexp_replace({x}, '\\s*\\*+\\s*$', '')"
    x = f"regexp_replace({x}, '^дисциплина\\s*[:.-]?\\s*', '', 'i')"
    x = f"regexp_replace({x}, '(^|[^\\p{{L}}\\p{{N}}_])(?:лекция|практическое занятие|практика|пз|лабораторная работа|лабораторная|семинарское занятие|семинар)($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\2', 'gi')"
    x = f"regexp_replace(regexp_replace({x}, '\\s+([,.;:])', '\\1', 'g'), '\\s{{2,}}', ' ', 'g')"
    return f"trim(regexp_replace({x}, '^[ ,.;:|/\\-]+|[ ,.;:|/\\-]+$', '', 'g'), ' ')"


def _teacher(c: str) -> str:
    x = f"regexp_replace({_clean(c)}, '^(?:старший преподаватель|преподаватель|преп\\.|доцент|профессор|ассистент)\\s*:?\\s*', '', 'i')"
    return f"trim(regexp_replace(regexp_replace({x}, '\\s*[,;|]+\\s*', ', ', 'g'), '\\s+', ' ', 'g'), ' ')"


def _location(c: str) -> str:
    x = f"regexp_replace({_clean(c)}, '(?:^|\\s)ауд(?:итория)?\\.?\\s*', 'ауд. ', 'i')"
    x = f"regexp_replace(regexp_replace({x}, '\\s*,\\s*,+', ',', 'g'), '\\s*/\\s*', ' / ', 'g')"
    return f"regexp_replace({x}, '(^|[^\\p{{L}}\\p{{N}}_])лит\\.?\\s*', '\\1лит. ', 'i')"


def _group(c: str) -> str:
    return f"regexp_replace(upper(regexp_replace({_clean(c)}, '^(?:учебная\\s+)?группа\\s*', '', 'i')), '\\s+', '', 'g')"


def _everybody(c: str) -> str:
    return f"{_group(c)} IN ('ALL', '*', 'ОБЩИЕ', 'ОБЩАЯ', 'ВСЕ')"


def _minutes(c: str) -> str:
    return f"(CAST(substr({c}, 1, 2) AS INT) * 60 + CAST(substr({c}, 4, 2) AS INT))"


def _clock(m: str) -> str:
    return f"lpad(CAST({m} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({m} % 60 AS VARCHAR), 2, '0')"


@query(f"""
SELECT event_id, {_subject("subject")} AS subject_clean, {_location("location_text")} AS location_clean, {_teacher("teacher")} AS teacher_clean, {_group("group_code")} AS group_clean,
  CASE WHEN regexp_matches(translate(upper({_clean("stream_code")}), 'ЁАБ', 'ЕAB'), '^(?:ПОТОК\\s*)?A$') THEN 'A' WHEN regexp_matches(translate(upper({_clean("stream_code")}), 'ЁАБ', 'ЕAB'), '^(?:ПОТОК\\s*)?B$') THEN 'B' END AS stream_clean,
  CASE WHEN regexp_matches(lower({_clean("half")}), '1\\s*/\\s*2|числител') THEN '1/2' WHEN regexp_matches(lower({_clean("half")}), '2\\s*/\\s*2|знаменател') THEN '2/2' END AS half_clean,
  CASE WHEN regexp_matches(low, 'лекц|lecture') THEN 'lecture' WHEN regexp_matches(low, 'лаб|(^|[^a-zа-я])lab($|[^a-zа-я])') THEN 'lab'
       WHEN regexp_matches(low, 'экзам|зач[её]т|аттест|контрол|коллоквиум|дифференц|exam|assessment') THEN 'assessment' WHEN regexp_matches(low, 'пз|практи|семинар|practice|seminar') THEN 'practice' ELSE 'other' END AS kind
FROM (SELECT *, lower(concat_ws(' ', {_clean("lesson_type")}, {_clean("subject")})) AS low FROM schedule_event)""")
def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every event's texts cleaned."""
    e = table(spark, d, "schedule_event")
    c = F.col
    return e.select(
        "event_id", text.clean_subject(c("subject")).alias("subject_clean"), text.clean_location(c("location_text")).alias("location_clean"), text.clean_teacher(c("teacher")).alias("teacher_clean"),
        text.group_code(c("group_code")).alias("group_clean"), text.stream_code(c("stream_code")).alias("stream_clean"), text.half_code(c("half")).alias("half_clean"), text.lesson_kind(c("lesson_type"), c("subject")).alias("kind"),
    )


@query(f"""
SELECT event_id, event_date, start_time, subject FROM schedule_event
WHERE program_code = '31.05.01' AND course = 1 AND ({_everybody("group_code")} OR {_group("group_code")} = '141') AND (stream_code IS NULL OR stream_code = 'A')
  AND event_date BETWEEN DATE '2026-10-05' AND DATE '2026-10-11' AND contains(lower(concat_ws(' ', subject, location_text, teacher, stream_code, weeks_spec)), 'корпус')""")
def agenda_week(spark: SparkSession, d: str) -> DataFrame:
    """One group's week, searched and in order."""
    found = scope.agenda_week(table(spark, d, "schedule_event"), "31.05.01", 1, "141", "A", dt.date(2026, 10, 5), search=" Корпус ")
    return found.select("event_id", "event_date", "start_time", "subject")


@query(f"""
SELECT g.program_code, g.course, g.group_code AS to_group, count(*) AS events, count(DISTINCT ROW(e.event_id, {_group("e.group_code")}, e.stream_code)) AS different
FROM schedule_event e JOIN (SELECT DISTINCT program_code, course, group_code, stream_code FROM group_ref) g ON g.program_code = e.program_code AND g.course = e.course
  AND ({_everybody("e.group_code")} OR {_group("e.group_code")} = {_group("g.group_code")}) AND (e.stream_code IS NULL OR g.stream_code IS NULL OR e.stream_code = g.stream_code)
GROUP BY ALL""")
def scope_events(spark: SparkSession, d: str) -> DataFrame:
    """The events that concern each group, counted (J5, J6, J21): counted per group and stream before they meet the groups."""
    e = table(spark, d, "schedule_event").withColumn("group_code", text.group_code(F.col("group_code")))
    each = e.groupBy("program_code", "course", "group_code", "stream_code", "event_id").agg(F.count("*").alias("n"))
    counted = each.groupBy("program_code", "course", "group_code", "stream_code").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    met = scope.scope_join(counted, table(spark, d, "group_ref"))
    return met.groupBy("program_code", "course", "to_group").agg(F.sum("n").alias("events"), F.sum("m").alias("different"))


_KEY_SQL = f"program_code, course, {_group('group_code')}, stream_code, event_date, start_time, end_time, lower({_subject('subject')}), lower({_location('location_text')})"


@query(f"""
SELECT event_id, confidence, ingested_on FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY_SQL}, lower({_teacher("teacher")}), lesson_type, half ORDER BY COALESCE(confidence, 0) DESC, event_id, ingested_on NULLS FIRST) AS rn FROM schedule_event) WHERE rn = 1""")
def dedupe_best(spark: SparkSession, d: str) -> DataFrame:
    """One event per meaning, the most confident."""
    rows = dedupe.keep_best(table(spark, d, "schedule_event"), dedupe.event_key(), F.col("confidence"), ["event_id", "ingested_on"])
    return rows.select("event_id", "confidence", "ingested_on")


@query(f"""
SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY_SQL}, lesson_type, half ORDER BY event_id, ingested_on NULLS FIRST) AS rn FROM schedule_event) WHERE rn = 1""")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """One event per meaning without the teacher, the first."""
    return dedupe.keep_first(table(spark, d, "schedule_event"), dedupe.event_key(teacher=False), ["event_id", "ingested_on"]).select("event_id")


@query(f"""
SELECT COALESCE(sum(n - 1), 0)::BIGINT AS extra_rows, count(*) AS keys FROM (SELECT count(*) AS n FROM schedule_event GROUP BY {_KEY_SQL}, lower({_teacher("teacher")}), lesson_type, half HAVING count(*) > 1)""")
def duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    """How many events are there more than once."""
    return dedupe.duplicates(table(spark, d, "schedule_event"), dedupe.event_key())


@query("""
SELECT DISTINCT rule_id, w AS week_number FROM (
  SELECT rule_id, unnest(list_concat(
    flatten(list_transform(regexp_extract_all(s, '\\d{1,2}\\s*-\\s*\\d{1,2}'), lambda p: range(CAST(regexp_extract(p, '^\\d+') AS BIGINT), CAST(regexp_extract(p, '\\d+$') AS BIGINT) + 1))),
    list_transform(regexp_extract_all(s, '\\d{1,2}'), lambda p: CAST(p AS BIGINT)))) AS w
  FROM (SELECT rule_id, regexp_replace(weeks_spec, '[–—−]', '-', 'g') AS s FROM manual_rule)) WHERE w BETWEEN 1 AND 52""")
def week_lists(spark: SparkSession, d: str) -> DataFrame:
    """The weeks of every rule."""
    return table(spark, d, "manual_rule").select("rule_id", F.explode(text.week_list(F.col("weeks_spec")).cast("array<bigint>")).alias("week_number"))


@query("SELECT DISTINCT rule_id, regexp_replace(upper(trim(g)), '\\s+', '', 'g') AS group_code FROM (SELECT rule_id, unnest(groups_list) AS g FROM manual_rule) WHERE regexp_matches(upper(trim(g)), '^[0-9]{3,4}[А-ЯA-Z]{0,3}$')")
def group_lists(spark: SparkSession, d: str) -> DataFrame:
    """The groups of every rule, read from one text."""
    return table(spark, d, "manual_rule").select("rule_id", F.explode(text.group_list(F.array_join("groups_list", ", "))).alias("group_code"))


_SPLIT_SQL = f"""
SELECT e.*, {_minutes("start_time")} AS a, {_minutes("end_time")} AS z FROM schedule_event e"""


@query(f"""
SELECT event_id, start_time, {_clock("(a + (z - a - 15) // 2)")} AS end_time, 1 AS double_part FROM ({_SPLIT_SQL}) WHERE z - a IN (185, 205)
UNION ALL SELECT event_id, {_clock("(a + (z - a - 15) // 2 + 15)")}, end_time, 2 FROM ({_SPLIT_SQL}) WHERE z - a IN (185, 205)
UNION ALL SELECT event_id, start_time, end_time, NULL FROM ({_SPLIT_SQL}) WHERE z - a NOT IN (185, 205)""")
def split_double(spark: SparkSession, d: str) -> DataFrame:
    """Double blocks as two lessons."""
    e = table(spark, d, "schedule_event")
    return islands.split_double(e, text.is_org_subject(F.col("subject"))).select("event_id", "start_time", "end_time", "double_part")


_SAME = ["program_code", "course", "group_code", "stream_code", "event_date", "lesson_type", "subject", "location_text", "teacher", "half"]
_SAME_SQL = ", ".join(_SAME)


@query(f"""
WITH r AS (SELECT {_SAME_SQL}, {_minutes("start_time")} AS start_min, {_minutes("end_time")} AS end_min FROM schedule_event),
f AS (SELECT *, end_min - start_min BETWEEN 45 AND 130 AS fits FROM r),
n AS (SELECT *, CASE WHEN fits AND lag(fits) OVER w AND start_min - lag(end_min) OVER w BETWEEN 0 AND 20 THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY {_SAME_SQL} ORDER BY start_min, end_min)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY {_SAME_SQL} ORDER BY start_min, end_min ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT {_SAME_SQL}, min(start_min) AS start_min, max(end_min) AS end_min, count(*) AS slots FROM k GROUP BY {_SAME_SQL}, run""")
def merge_runs(spark: SparkSession, d: str) -> DataFrame:
    """Lessons that follow each other as one."""
    e = table(spark, d, "schedule_event").select(*_SAME, minutes_of_day(F.col("start_time")).alias("start_min"), minutes_of_day(F.col("end_time")).alias("end_min"))
    return islands.merge_runs(e, _SAME, "start_min", "end_min")


@query(f"SELECT event_id, COALESCE({_minutes('start_time')}, 0) AS start_min, {_minutes('end_time')} AS end_min, {_minutes('end_time')} - {_minutes('start_time')} IN (185, 205) AS joined FROM (SELECT DISTINCT event_id, start_time, end_time FROM schedule_event)")
def split_and_join(spark: SparkSession, d: str) -> DataFrame:
    """Double blocks cut and put together again come out as they were."""
    e = islands.split_double(table(spark, d, "schedule_event").select("event_id", "start_time", "end_time").distinct(), F.lit(False))
    parts = e.select("event_id", "double_part", minutes_of_day(F.col("start_time")).alias("start_min"), minutes_of_day(F.col("end_time")).alias("end_min"))
    return islands.merge_pairs(parts, ["event_id"], "double_part", "start_min", "end_min").select("event_id", "start_min", "end_min", "joined")


@query("""
SELECT raw_id, last_value(teacher IGNORE NULLS) OVER (PARTITION BY program_code, course, group_code, week_number ORDER BY weekday, raw_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS teacher FROM raw_event""")
def fill_down(spark: SparkSession, d: str) -> DataFrame:
    """Teachers filled down within a group's week."""
    return islands.fill_down(table(spark, d, "raw_event"), ["program_code", "course", "group_code", "week_number"], ["weekday", "raw_id"], ["teacher"]).select("raw_id", "teacher")


@query("SELECT week_number, monday, count(*) AS events FROM (SELECT CAST(floor((date_trunc('week', event_date)::DATE - DATE '2026-08-31') / 7) + 1 AS INT) AS week_number, date_trunc('week', event_date)::DATE AS monday FROM schedule_event WHERE event_date IS NOT NULL) GROUP BY ALL")
def week_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Events per academic week."""
    e = table(spark, d, "schedule_event").where("event_date IS NOT NULL")
    return e.groupBy(temporal.week_number(F.col("event_date")).alias("week_number"), temporal.monday_of(F.col("event_date")).alias("monday")).agg(F.count("*").alias("events"))


def _calendar(spark: SparkSession, d: str) -> DataFrame:
    """The weeks of six calendars, one for each course: the first six of the year by code."""
    weeks = table(spark, d, "academic_week").where("academic_year = '2026/2027' AND from_date <= to_date")
    codes = weeks.select("calendar_code").distinct().orderBy("calendar_code").limit(6)
    return weeks.join(codes.select("calendar_code", F.row_number().over(Window.orderBy("calendar_code")).alias("course")), "calendar_code")


_CAL_SQL = """
codes AS (SELECT calendar_code, row_number() OVER (ORDER BY calendar_code) AS course FROM (SELECT DISTINCT calendar_code FROM academic_week WHERE academic_year = '2026/2027' AND from_date <= to_date)),
cal AS (SELECT course, week_number, w.a AS a, w.z AS z FROM (SELECT course, week_number, min({'a': from_date, 'z': to_date}) AS w FROM academic_week JOIN codes USING (calendar_code) WHERE course <= 6 AND academic_year = '2026/2027' AND from_date <= to_date GROUP BY ALL))"""
_DAY_SQL = f"""
WITH {_CAL_SQL},
placed AS (SELECT r.*, c.a, c.z, CAST(c.a + CAST((r.weekday - (isodow(c.a) - 1) + 7) % 7 AS INT) AS DATE) AS day FROM raw_event r LEFT JOIN cal c USING (course, week_number))"""


@query(f"{_DAY_SQL} SELECT raw_id, day AS event_date FROM placed WHERE weekday BETWEEN 0 AND 6 AND day <= z")
def calendar_days(spark: SparkSession, d: str) -> DataFrame:
    """The days of captured lessons by academic week and weekday, each course with a calendar of its own."""
    return joins.resolve_days(table(spark, d, "raw_event"), _calendar(spark, d), calendar=["course"])[0].select("raw_id", "event_date")


@query(f"{_DAY_SQL} SELECT raw_id FROM placed WHERE NOT COALESCE(weekday BETWEEN 0 AND 6 AND day <= z, FALSE)")
def calendar_unresolved(spark: SparkSession, d: str) -> DataFrame:
    """Captured lessons that get no day."""
    return joins.resolve_days(table(spark, d, "raw_event"), _calendar(spark, d), calendar=["course"])[1].select("raw_id")


@query(f"{_DAY_SQL} SELECT raw_id, a AS week_from, z AS week_to FROM placed")
def week_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Captured lessons with the days of their academic week, without a day of their own."""
    return joins.with_week_ranges(table(spark, d, "raw_event"), _calendar(spark, d), calendar=["course"]).select("raw_id", "week_from", "week_to")


@query(f"""
WITH {_CAL_SQL},
wk AS (SELECT DISTINCT rule_id, week_number FROM ({ORACLE["week_lists"]})),
gr AS (SELECT rule_id, course, weekday, unnest(CASE WHEN audience = 'ALL' OR groups_list IS NULL OR len(groups_list) = 0 THEN ['ALL'] ELSE list_distinct(groups_list) END) AS group_code FROM manual_rule),
x AS (SELECT g.rule_id, g.group_code, c.z AS z, CAST(c.a + CAST((g.weekday - 1 - (isodow(c.a) - 1) + 7) % 7 AS INT) AS DATE) AS day FROM gr g JOIN wk USING (rule_id) JOIN cal c USING (course, week_number) WHERE g.weekday BETWEEN 1 AND 7)
SELECT rule_id, group_code, count(*) AS days, min(day) AS first_day, max(day) AS last_day FROM x WHERE day <= z GROUP BY ALL""")
def rules_expanded(spark: SparkSession, d: str) -> DataFrame:
    """Typed rules spread over their weeks and groups."""
    r = table(spark, d, "manual_rule")
    everybody = (F.col("audience") == "ALL") | F.col("groups_list").isNull() | (F.size("groups_list") == 0)
    groups = F.when(F.coalesce(everybody, F.lit(False)), F.array(F.lit("ALL"))).otherwise(F.array_distinct("groups_list"))
    rows = r.select("rule_id", "course", (F.col("weekday") - 1).alias("weekday"), F.explode(text.week_list(F.col("weeks_spec"))).alias("week_number"), groups.alias("g"))
    days = joins.resolve_days(rows, _calendar(spark, d), calendar=["course"])[0].select("rule_id", "event_date", F.explode("g").alias("group_code"))
    return days.groupBy("rule_id", "group_code").agg(F.count("*").alias("days"), F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"))


_FREQ = "CASE rule_id % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' ELSE 'yearly' END"


@query(f"""
WITH s AS (SELECT rule_id, CAST(DATE '2026-08-31' + CAST(rule_id % 180 AS INT) AS DATE) AS f, {_FREQ} AS q, 1 + rule_id % 3 AS n, {_minutes("start_time")} AS m, weekday FROM manual_rule WHERE weekday IS NOT NULL),
daily AS (SELECT rule_id, m, CAST(f + CAST(k AS INT) AS DATE) AS day FROM s, range(0, 366) t(k) WHERE q = 'daily' AND k % n = 0),
weekly AS (SELECT rule_id, m, CAST(f + CAST(k AS INT) AS DATE) AS day FROM s, range(0, 366) t(k) WHERE q = 'weekly' AND (k // 7) % n = 0 AND (isodow(CAST(f + CAST(k AS INT) AS DATE)) % 7) IN (weekday % 7, (weekday + 2) % 7)),
steps AS (SELECT rule_id, m, f, n, q, k, CAST(f + to_months(CAST(k * CASE q WHEN 'monthly' THEN 1 ELSE 12 END AS INT)) AS DATE) AS day FROM s, range(0, 13) t(k) WHERE q IN ('monthly', 'yearly')),
cut AS (SELECT rule_id, min(k) AS c FROM steps WHERE day(day) <> day(f) GROUP BY rule_id),
months AS (SELECT rule_id, m, day FROM steps LEFT JOIN cut USING (rule_id) WHERE k < COALESCE(c, 99) AND k % n = 0 AND day <= f + 365),
everything AS (SELECT * FROM daily UNION ALL SELECT * FROM weekly UNION ALL SELECT * FROM months)
SELECT rule_id, count(*) AS occurrences, min(day + to_minutes(CAST(m - 180 AS BIGINT))) AS first_start, max(day + to_minutes(CAST(m - 180 + 95 AS BIGINT))) AS last_end FROM everything GROUP BY rule_id""")
def recurrences(spark: SparkSession, d: str) -> DataFrame:
    """Every rule as a series that repeats for a year: daily, weekly, monthly or yearly."""
    r = table(spark, d, "manual_rule").where("weekday IS NOT NULL")
    first = F.date_add(F.lit(dt.date(2026, 8, 31)), (F.col("rule_id") % 180).cast("int"))
    start = temporal.local_to_instant(F.timestamp_micros(F.unix_micros(first.cast("timestamp")) + minutes_of_day(F.col("start_time")).cast("long") * 60_000_000), "Europe/Moscow")
    days = F.array((F.col("weekday") % 7).cast("int"), ((F.col("weekday") + 2) % 7).cast("int"))
    series = r.select("rule_id", start.alias("start_at"), F.timestamp_micros(F.unix_micros(start) + 95 * 60_000_000).alias("end_at"), F.lit("Europe/Moscow").alias("time_zone"), F.expr(_FREQ).alias("frequency"),
                      (F.col("rule_id") % 3 + 1).cast("int").alias("repeat_interval"), days.alias("weekdays"), F.date_add(first, 365).alias("until_date"))
    out = recurrence.expand(series).groupBy("rule_id").agg(F.count("*").alias("occurrences"), F.min("start_at").cast("timestamp_ntz").alias("first_start"), F.max("end_at").cast("timestamp_ntz").alias("last_end"))
    return out


@query(f"""
WITH e AS (SELECT DISTINCT event_id, teacher, event_date, {_minutes("start_time")} AS a, {_minutes("end_time")} AS z FROM schedule_event WHERE teacher IS NOT NULL AND event_date IS NOT NULL)
SELECT l.event_id, count(*) AS overlaps FROM e l JOIN e r ON l.teacher = r.teacher AND l.event_date = r.event_date AND l.event_id <> r.event_id AND l.a < r.z AND r.a < l.z GROUP BY l.event_id""")
def overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Other events of the same teacher that overlap."""
    e = table(spark, d, "schedule_event").where("teacher IS NOT NULL AND event_date IS NOT NULL")
    e = e.select("event_id", "teacher", "event_date", minutes_of_day(F.col("start_time")).alias("a"), minutes_of_day(F.col("end_time")).alias("z")).distinct()
    other = e.select("teacher", "event_date", F.col("event_id").alias("other_id"), F.col("a").alias("b"), F.col("z").alias("y"))
    met = joins.overlapping(e, other, ["teacher", "event_date"], ("a", "z", "b", "y"), width=240)
    return met.where("event_id <> other_id").groupBy("event_id").agg(F.count("*").alias("overlaps"))


@query("""
WITH p AS (SELECT DISTINCT program_code, course, event_date FROM schedule_event WHERE event_date IS NOT NULL)
SELECT p.program_code, p.course, p.event_date, count(s.period_id) AS active FROM p LEFT JOIN study_period s ON s.program_code = p.program_code AND s.course = p.course AND s.from_date <= p.event_date AND s.to_date >= p.event_date GROUP BY ALL""")
def period_overlay(spark: SparkSession, d: str) -> DataFrame:
    """How many plan periods cover each day with events."""
    return joins.active_counts(table(spark, d, "schedule_event"), table(spark, d, "study_period"), ["program_code", "course"], "event_date", "from_date", "to_date")


_SLOT = ["program_code", "course", "group_code", "stream_code", "event_date", "start_time"]


@query(f"""
SELECT {", ".join(_SLOT)}, count(*) AS conflicts FROM (
  SELECT *, first_value(ROW(COALESCE(lesson_type, ''), COALESCE(subject, ''), COALESCE(location_text, ''))) OVER (PARTITION BY {", ".join(_SLOT)} ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS f FROM schedule_event)
WHERE f <> ROW(COALESCE(lesson_type, ''), COALESCE(subject, ''), COALESCE(location_text, '')) GROUP BY ALL""")
def slot_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Events that differ from the first one in their slot."""
    return joins.slot_conflicts(table(spark, d, "schedule_event"), _SLOT, ["lesson_type", "subject", "location_text"], ["event_id"])


@query("""
WITH p AS (SELECT DISTINCT program_code, course, group_code, subject, ingested_on FROM schedule_event WHERE ingested_on IS NOT NULL),
x AS (SELECT p.*, min({'t': e.event_date, 'x': e.event_id}) AS n FROM p LEFT JOIN schedule_event e ON e.program_code = p.program_code AND e.course = p.course AND e.group_code = p.group_code AND e.subject = p.subject AND e.event_date > p.ingested_on GROUP BY ALL)
SELECT program_code, course, group_code, subject, ingested_on, n.t AS next_start, n.x AS next_event_id FROM x WHERE group_code IS NOT NULL AND subject IS NOT NULL""")
def next_lesson(spark: SparkSession, d: str) -> DataFrame:
    """The next lesson of a group's subject after each day of delivery."""
    e = table(spark, d, "schedule_event").where("group_code IS NOT NULL AND subject IS NOT NULL")
    on = ["program_code", "course", "group_code", "subject"]
    probes = e.where("ingested_on IS NOT NULL").select(*on, "ingested_on").distinct()
    return joins.next_after(probes, e.where("event_date IS NOT NULL"), on, "ingested_on", "event_date", "event_id")


_MET_SQL = f"""
WITH g AS (SELECT DISTINCT program_code, course, stream_code, {_group("group_code")} AS group_code FROM roster WHERE group_code IS NOT NULL),
m AS (SELECT g.*, e.lesson_type AS k, NOT ({_everybody("e.group_code")}) AS own FROM g LEFT JOIN schedule_event e ON e.program_code = g.program_code AND e.course = g.course
  AND ({_everybody("e.group_code")} OR {_group("e.group_code")} = g.group_code) AND (e.stream_code IS NULL OR g.stream_code IS NULL OR e.stream_code = g.stream_code)),
c AS (SELECT program_code, course, stream_code, group_code, {", ".join(f"count(*) FILTER (k = '{k}') AS {k}, count(*) FILTER (k = '{k}' AND own) AS own_{k}" for k in coverage.KINDS)} FROM m GROUP BY program_code, course, stream_code, group_code)"""


@query(f"{_MET_SQL} SELECT * FROM c")
def kinds_per_group(spark: SparkSession, d: str) -> DataFrame:
    """Events of each kind per roster group."""
    return coverage.kinds_per_group(table(spark, d, "roster"), table(spark, d, "schedule_event"))


@query(f"""{_MET_SQL}, f AS (SELECT program_code, course, COALESCE(stream_code, '-') AS stream, group_code, CAST(lecture > 0 AND practice > 0 AS INT) AS full_, CAST(lecture = 0 AND practice = 0 AS INT) AS none_ FROM c),
r AS (SELECT grouping_id(program_code, course, stream, group_code) AS g, program_code, course, stream, group_code, count(*) AS expected, sum(full_)::BIGINT AS covered, sum(none_) AS nothing FROM f GROUP BY ROLLUP (program_code, course, stream, group_code))
SELECT CASE g WHEN 0 THEN 'group' WHEN 1 THEN 'stream' WHEN 3 THEN 'course' WHEN 7 THEN 'program' ELSE 'all' END AS level, program_code, course, stream, group_code, expected, covered, CASE WHEN covered = expected THEN 'full' WHEN nothing = expected THEN 'missing' ELSE 'partial' END AS status FROM r""")
def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Coverage from groups up to streams, courses and programs."""
    return coverage.coverage(table(spark, d, "roster"), table(spark, d, "schedule_event"))


@query(f"""
WITH e AS (SELECT DISTINCT program_code, course, {_group("group_code")} AS group_code FROM group_ref), a AS (SELECT DISTINCT program_code, course, {_group("group_code")} AS group_code FROM schedule_event WHERE NOT ({_everybody("group_code")}))
SELECT *, 'missing' AS side FROM (SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM a EXCEPT SELECT * FROM e)""")
def missing_and_extra(spark: SparkSession, d: str) -> DataFrame:
    """Groups without events, and events of unknown groups."""
    code = text.group_code(F.col("group_code")).alias("group_code")
    expected = table(spark, d, "group_ref").select("program_code", "course", code)
    actual = table(spark, d, "schedule_event").where(~text.is_everybody(F.col("group_code"))).select("program_code", "course", code)
    return joins.missing_and_extra(expected, actual, ["program_code", "course", "group_code"])


_PATCH = ["program_code", "course", "group_code", "week_number", "weekday", "start_time", "end_time"]
_PATCH_SQL = " AND ".join(f"b.{k} IS NOT DISTINCT FROM a.{k}" for k in _PATCH)


@query(f"""
WITH base AS (SELECT * FROM raw_event WHERE captured_at < TIMESTAMP '2027-01-15'), patch AS (SELECT * FROM raw_event WHERE captured_at >= TIMESTAMP '2027-01-15')
SELECT raw_id FROM base a WHERE NOT EXISTS (SELECT 1 FROM patch b WHERE {_PATCH_SQL}) UNION ALL SELECT raw_id FROM patch""")
def overrides(spark: SparkSession, d: str) -> DataFrame:
    """Later captures in place of earlier ones of the same slot."""
    r = table(spark, d, "raw_event")
    cut = F.lit("2027-01-15").cast("timestamp_ntz")
    return joins.upsert(r.where(F.col("captured_at").cast("timestamp_ntz") < cut), r.where(F.col("captured_at").cast("timestamp_ntz") >= cut), _PATCH).select("raw_id")


@query(f"""
WITH fresh AS (SELECT * FROM raw_event WHERE captured_at >= TIMESTAMP '2027-01-15'), old AS (SELECT * FROM raw_event WHERE captured_at < TIMESTAMP '2027-01-15')
SELECT raw_id FROM fresh UNION ALL SELECT raw_id FROM old a WHERE a.source_url IN (SELECT url FROM source_provenance WHERE withdrawn_on IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM fresh b WHERE {_PATCH_SQL})""")
def last_good(spark: SparkSession, d: str) -> DataFrame:
    """Rows of failed sources kept from before."""
    r = table(spark, d, "raw_event")
    at, cut = F.col("captured_at").cast("timestamp_ntz"), F.lit("2027-01-15").cast("timestamp_ntz")
    failed = table(spark, d, "source_provenance").where("withdrawn_on IS NOT NULL").select(F.col("url").alias("source_url"))
    return joins.last_good(r.where(at >= cut), r.where(at < cut), failed, "source_url", _PATCH).select("raw_id")


_PARSERS = ("pdf-grid", "pdf-text", "xlsx", "html", "universal")


@query(f"""
WITH r AS (SELECT *, list_position([{", ".join(f"'{p}'" for p in _PARSERS)}], parser_name) AS rank FROM raw_event)
SELECT raw_id, parser_name FROM (SELECT *, min(rank) OVER (PARTITION BY {", ".join(_PATCH)}) AS best FROM r WHERE rank > 0) WHERE rank = best""")
def parser_union(spark: SparkSession, d: str) -> DataFrame:
    """All parsers' lessons, for each slot those of the first parser that has it."""
    rank = F.nullif(F.array_position(F.array(*map(F.lit, _PARSERS)), F.col("parser_name")), F.lit(0))
    return dedupe.keep_lowest_rank(table(spark, d, "raw_event"), _PATCH, rank).select("raw_id", "parser_name")


@query("""
WITH k AS (SELECT DISTINCT lower(subject) AS s FROM manual_rule WHERE subject IS NOT NULL AND length(subject) >= 3)
SELECT r.raw_id, max({'l': length(k.s), 's': k.s}).s AS found FROM raw_event r JOIN k ON starts_with(lower(r.subject) || ' ', k.s || ' ') GROUP BY r.raw_id""")
def known_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """The longest known subject that a captured subject begins with."""
    return joins.prefix_of(table(spark, d, "raw_event").select("raw_id", "subject"), "subject", table(spark, d, "manual_rule"), "subject").select("raw_id", "found")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) FILTER (COALESCE(trim(CAST({c} AS VARCHAR)), '') = '') AS blank_rows FROM schedule_event" for c in ("teacher", "location_text", "subject", "group_code", "source_url", "confidence")))
def blank_counts(spark: SparkSession, d: str) -> DataFrame:
    """Missing teachers, places and the like."""
    return coverage.blanks(table(spark, d, "schedule_event"), ["teacher", "location_text", "subject", "group_code", "source_url", "confidence"])


_RULES_SQL = {
    "no day": "event_date IS NULL",
    "no clock": "NOT COALESCE(regexp_matches(start_time, '^\\s*([01]?\\d|2[0-3])[:.][0-5]\\d([:.][0-5]\\d)?\\s*$') AND regexp_matches(end_time, '^\\s*([01]?\\d|2[0-3])[:.][0-5]\\d([:.][0-5]\\d)?\\s*$'), FALSE)",
    "ends before it starts": "z <= a",
    "longer than four hours": "z - a > 240",
    "duration differs": "duration_minutes <> z - a",
    "no subject": "COALESCE(trim(subject), '') = ''",
    "no location": "COALESCE(trim(location_text), '') = ''",
    "strange group": f"NOT ({_everybody('group_code')}) AND NOT regexp_matches({_group('group_code')}, '^[0-9]{{3}}[А-Я]?$')",
    "address in the subject": "regexp_matches(subject, '(^|[^а-яё])(ауд|ул|каб)\\.', 'i')",
}


@query("SELECT issue, count(*) AS rows_hit FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS issue FROM ({_SPLIT_SQL}) WHERE {v}" for k, v in _RULES_SQL.items()) + ") GROUP BY issue")
def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules counted over all events (V2)."""
    return coverage.issues(table(spark, d, "schedule_event"), "event_id", coverage.event_rules()).groupBy("issue").agg(F.count("*").alias("rows_hit"))


@query("""
SELECT chair_code, subject, n AS times FROM (SELECT chair_code, subject, count(*) AS n, row_number() OVER (PARTITION BY chair_code ORDER BY count(*) DESC, min(rule_id)) AS rn FROM manual_rule WHERE subject IS NOT NULL GROUP BY chair_code, subject) WHERE rn = 1""")
def most_common(spark: SparkSession, d: str) -> DataFrame:
    """Each chair's most common subject, the first of equals."""
    return coverage.first_most_common(table(spark, d, "manual_rule"), ["chair_code"], "subject", "rule_id")


@query("SELECT event_id, event_date, start_time FROM (SELECT DISTINCT event_id, event_date, start_time FROM schedule_event WHERE event_date >= DATE '2026-11-01') ORDER BY event_date, start_time, event_id LIMIT 5")
def upcoming(spark: SparkSession, d: str) -> DataFrame:
    """The five next events from a day on, by day, start and id: a top-k report (O8; the orders O1 to O6 are in ``operators.orders``)."""
    e = table(spark, d, "schedule_event").where("event_date >= DATE '2026-11-01'").select("event_id", "event_date", "start_time").distinct()
    return e.orderBy("event_date", "start_time", "event_id").limit(5)


@query("SELECT CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS local_day, event_type, count(*) AS n FROM events GROUP BY ALL")
def local_days(spark: SparkSession, d: str) -> DataFrame:
    """Events per local day of another zone."""
    e = table(spark, d, "events")
    return e.groupBy(temporal.instant_to_local(F.col("ts").cast("timestamp_ntz").cast("timestamp"), "America/New_York").cast("date").alias("local_day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """A field of JSON properties, nothing where it can't be read."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT doc_id, substr(sha1(concat_ws('|', COALESCE(CAST(doc_id AS VARCHAR), ''), COALESCE(source, ''))), 1, 14) AS short_id, sha256(text) AS digest, split_part(source_url, '#', 1) AS page FROM documents")
def digests(spark: SparkSession, d: str) -> DataFrame:
    """Short ids, digests and page addresses."""
    return table(spark, d, "documents").select("doc_id", text.short_id(F.col("doc_id"), F.col("source")).alias("short_id"), F.sha2("text", 256).alias("digest"), text.page_address(F.col("source_url")).alias("page"))


_ARRIVAL = ("snapshot_no", "received_at")


@query(f"""
WITH n AS (SELECT max(snapshot_no) AS z, max(snapshot_no) FILTER (snapshot_no < (SELECT max(snapshot_no) FROM event_snapshot)) AS a FROM event_snapshot),
b AS (SELECT * EXCLUDE ({", ".join(_ARRIVAL)}) FROM event_snapshot WHERE snapshot_no = (SELECT a FROM n)), c AS (SELECT * EXCLUDE ({", ".join(_ARRIVAL)}) FROM event_snapshot WHERE snapshot_no = (SELECT z FROM n))
SELECT *, 'removed' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM c) UNION ALL SELECT *, 'added' FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM b)""")
def delivery_diff(spark: SparkSession, d: str) -> DataFrame:
    """Rows that only one of the last two deliveries has, by every column but number and time of arrival."""
    s = table(spark, d, "event_snapshot")
    last = [r[0] for r in s.where("snapshot_no IS NOT NULL").select("snapshot_no").distinct().orderBy(F.desc("snapshot_no")).limit(2).collect()]  # two numbers, which the scans are filtered by
    of = lambda k: s.where(F.col("snapshot_no") == last[k]) if k < len(last) else s.limit(0)
    return sinks.table_diff(of(1), of(0), ignore=_ARRIVAL)


# The columns are for SQL only: the query takes those that a table has.
_TABLES = {
    "academic_week": "calendar_code academic_year week_number from_date to_date",
    "documents": "doc_id text lang source n_chars source_url program_code course published_on",
    "event_snapshot": "snapshot_no received_at event_id program_code course group_code stream_code event_date start_time end_time subject location_text teacher lesson_type",
    "events": "event_id ts user_id event_type value props",
    "group_ref": "program_code course group_code stream_code opened_on closed_on",
    "manual_rule": "rule_id chair_code program_code course weeks_spec weekday start_time end_time subject location_text teacher groups_list audience",
    "mix_target": "source target_share max_repeats",
    "raw_event": "raw_id program_code course group_code stream_code week_number weekday start_time end_time subject location_text teacher lesson_type half parser_name source_url captured_at",
    "roster": "roster_id program_code course stream_code group_code listed_on source_url",
    "schedule_event": "event_id program_code course group_code stream_code event_date start_time end_time subject location_text teacher lesson_type half is_double duration_minutes weeks_spec source_url source_kind confidence ingested_on",
    "source_provenance": "url sha256 content_bytes checked_at academic_year_in_document date_label_count first_seen_on withdrawn_on",
    "study_period": "period_id plan_code program_code course academic_year from_date to_date period_label period_kind source_url",
}


def _hashes_sql(name: str) -> str:
    as_text = lambda c: f"CAST(to_json({c}) AS VARCHAR)" if c == "groups_list" else f"CAST({c} AS VARCHAR)"
    values = ", ".join(f"COALESCE('=' || {as_text(c)}, '0')" for c in _TABLES[name].split())
    return f"SELECT count(*) AS n, sum(CAST('0x' || substr(x, 1, 8) AS BIGINT)) AS a, sum(CAST('0x' || substr(x, 9, 8) AS BIGINT)) AS b, '{name}' AS table_name FROM (SELECT sha256(concat_ws(chr(1), {values})) AS x FROM {name})"


@query(f"""
WITH f AS (SELECT table_name, n AS total_rows, substr(sha256(concat_ws('|', n, a, b)), 1, 16) AS fingerprint FROM ({" UNION ALL ".join(map(_hashes_sql, _TABLES))}))
SELECT *, substr(sha256(string_agg(table_name || '=' || fingerprint, '|' ORDER BY table_name) OVER (ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 1, 16) AS all_tables FROM f""")
def table_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """A fingerprint of every table by all its columns, and one of all tables together, in order of their names (K7)."""
    tables = [(name, table(spark, d, name)) for name in _TABLES]
    marks = reduce(DataFrame.unionByName, [sinks.fingerprint(df, df.columns).select(F.lit(name).alias("table_name"), "total_rows", "fingerprint") for name, df in tables])
    each = F.array_sort(F.collect_list(F.concat_ws("=", "table_name", "fingerprint")).over(Window.partitionBy()))  # one row per table
    return marks.withColumn("all_tables", F.substring(F.sha2(F.array_join(each, "|"), 256), 1, 16))


@query("SELECT program_code, course, group_code, event_date, list_transform(list_sort(list(DISTINCT {'s': start_time, 'e': event_id})), lambda x: x.e) AS event_ids FROM schedule_event WHERE event_date IS NOT NULL GROUP BY ALL")
def by_day(spark: SparkSession, d: str) -> DataFrame:
    """The events of each group's day in order."""
    return scope.by_day(table(spark, d, "schedule_event"), ["program_code", "course", "group_code"])


_ESC = lambda c: f"regexp_replace(regexp_replace({c}, '([\\\\,;])', '\\\\\\1', 'g'), '\\r?\\n', '\\\\n', 'g')"
_STAMP = lambda c: f"strftime(CAST(event_date AS TIMESTAMP) + to_minutes({_minutes(c)} - 180), '%Y%m%dT%H%M%SZ')"


@query(f"""
SELECT event_id, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || event_id, 'DTSTART:' || {_STAMP("start_time")}, 'DTEND:' || {_STAMP("end_time")}, 'SUMMARY:' || {_ESC("subject")}, 'LOCATION:' || {_ESC("COALESCE(location_text, '')")}, 'END:VEVENT') AS entry
FROM schedule_event WHERE event_date IS NOT NULL""")
def calendar_entries(spark: SparkSession, d: str) -> DataFrame:
    """Events as calendar entries."""
    return sinks.ics_entries(table(spark, d, "schedule_event"))


@query("SELECT chair_code AS doc, CAST(rn - 1 AS INT) AS row, c AS col, CASE c WHEN 0 THEN CAST(rule_id AS VARCHAR) WHEN 1 THEN COALESCE(trim(regexp_replace(subject, '\\s+', ' ', 'g')), '') ELSE COALESCE(trim(regexp_replace(location_text, '\\s+', ' ', 'g')), '') END AS text FROM (SELECT *, row_number() OVER (PARTITION BY chair_code ORDER BY rule_id) AS rn FROM manual_rule), (VALUES (0), (1), (2)) v(c)")
def html_tables(spark: SparkSession, d: str) -> DataFrame:
    """Each chair's rules written as an HTML table and read back."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = F.concat(F.lit("<tr><td>"), F.col("rule_id").cast("string"), F.lit("</td><td class=x>"), esc("subject"), F.lit("</td><th>"), esc("location_text"), F.lit("</th></tr>"))
    pages = table(spark, d, "manual_rule").groupBy("chair_code").agg(F.array_sort(F.collect_list(F.struct("rule_id", row.alias("tr")))).alias("rows"))
    html = F.concat(F.lit("<table>"), F.array_join(F.transform("rows", lambda r: r["tr"]), "\n"), F.lit("</table>"))
    return grid.html_grid(pages.select("chair_code", html.alias("html")), "chair_code", "html")


@query("""
WITH t AS (SELECT doc_id, lower(COALESCE(text, '')) AS x FROM documents),
s AS (SELECT doc_id, len(list_distinct(regexp_extract_all(x, 'недел[ияюь]\\s+(\\d{1,2})', 1))) AS weeks, len(list_distinct(regexp_extract_all(x, 'групп[аыу]\\s+(\\d{3})', 1))) AS groups,
  len(regexp_extract_all(x, 'понедельник|вторник|сред[ау]|четверг|пятниц[ау]|суббот[ау]')) AS days, len(regexp_extract_all(x, '\\d{1,2}:\\d{2}')) AS clocks, CASE WHEN x = '' THEN 0.0 ELSE len(list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[|\\t│]')))::DOUBLE / len(string_split(x, chr(10))) END AS vector FROM t),
g AS (SELECT *, least(1.0, least(1.0, weeks / 15.0) * 0.45 + least(1.0, groups / 8.0) * 0.35 + vector * 0.2) AS score FROM s)
SELECT doc_id, round(score, 6) AS grid_score, CASE WHEN score >= 0.58 AND weeks >= 8 THEN 'weekly-matrix' WHEN days > 0 AND clocks > 0 AND groups >= 2 THEN 'daily-grid' WHEN days > 0 AND clocks > 0 THEN 'daily-list' ELSE 'unknown' END AS layout,
  round(CASE WHEN score >= 0.58 AND weeks >= 8 THEN least(0.99, 0.55 + least(1.0, weeks / 15.0) * 0.35 + least(1.0, groups / 8.0) * 0.1) WHEN days > 0 AND clocks > 0 AND groups >= 2 THEN least(0.97, 0.55 + least(1.0, days / 5.0) * 0.25 + least(1.0, groups / 8.0) * 0.2) WHEN days > 0 AND clocks > 0 THEN 0.78 ELSE 0.35 END, 6) AS confidence FROM g""")
def layouts(spark: SparkSession, d: str) -> DataFrame:
    """The layout that a document's words and the share of its lines with column signs speak for."""
    x = F.lower(F.coalesce("text", F.lit("")))
    found = lambda p, k=0: F.regexp_extract_all(x, F.lit(p), F.lit(k))
    signals = table(spark, d, "documents").select(
        "doc_id", F.size(F.array_distinct(found(r"недел[ияюь]\s+(\d{1,2})", 1))).alias("weeks"), F.size(F.array_distinct(found(r"групп[аыу]\s+(\d{3})", 1))).alias("groups"),
        F.size(found("понедельник|вторник|сред[ау]|четверг|пятниц[ау]|суббот[ау]")).alias("days"), F.size(found(r"\d{1,2}:\d{2}")).alias("clocks"), F.when(x == "", 0.0).otherwise(F.size(F.filter(F.split(x, "\n"), lambda v: v.rlike(r"[|\t│]"))) / F.size(F.split(x, "\n"))).alias("vector"),
    )
    return grid.layout(signals).select("doc_id", "grid_score", "layout", "confidence")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hits per hour and type; the same function runs on streams (M6)."""
    out = state.tumbling(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz").cast("timestamp")), "ts", ["event_type"], "1 hour")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM k GROUP BY user_id, s""")
def visits(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users with pauses under half an hour; the same function runs on streams."""
    out = state.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz").cast("timestamp")), "ts", ["user_id"], "30 minutes")
    return out.select(F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "user_id", "n")


@query(f"SELECT date_part('month', event_date)::INT AS month, CASE WHEN date_part('month', event_date) >= 8 THEN 2026 ELSE 2027 END AS inferred_year, count(*) AS n, sum({_minutes('end_time')} - {_minutes('start_time')})::BIGINT AS minutes FROM schedule_event WHERE event_date IS NOT NULL GROUP BY ALL")
def months(spark: SparkSession, d: str) -> DataFrame:
    """Events and minutes per month, with the year a month without one would get."""
    e = table(spark, d, "schedule_event").where("event_date IS NOT NULL")
    month = F.month("event_date")
    length = minutes_of_day(F.col("end_time")) - minutes_of_day(F.col("start_time"))
    return e.groupBy(month.alias("month"), temporal.academic_year_of(month).alias("inferred_year")).agg(F.count("*").alias("n"), F.sum(length).alias("minutes"))
