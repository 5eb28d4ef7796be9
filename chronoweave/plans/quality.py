"""Checks, joins and changes of rows as queries over whole tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions.clock import minutes_of_day
from chronoweave.operators import coverage, dedupe, islands, joins, orders, recurrence, scope
from chronoweave.sources import payload
from chronoweave.sources.tables import table
from chronoweave.streaming.batches import newest_rows, usable

_IDENTITY = ["program_code", "course", "group_code", "stream_code", "event_date", "lesson_type", "subject", "location_text", "teacher", "source_url", "half"]


def lesson_issues(spark: SparkSession, d: str) -> DataFrame:
    """Broken structural rules of captured lessons, counted (V3)."""
    r = table(spark, d, "raw_event")
    return coverage.issues(r, "raw_id", coverage.lesson_rules()).groupBy("issue").agg(F.count("*").alias("rows_hit"))


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Captured lessons that are there more than once, letter by letter, per program and course."""
    key = ["lesson_type", "stream_code", "group_code", "week_number", "weekday", "start_time", "end_time", "subject", "location_text", "program_code", "course"]
    return coverage.exact_duplicates(table(spark, d, "raw_event"), key, ["program_code", "course"])


def set_aside(spark: SparkSession, d: str) -> DataFrame:
    """Captured lessons whose subject is an address and that have no place: set aside, and the good rest (V10). Places are moved into the
    subject of every eleventh row, to have some."""
    r = table(spark, d, "raw_event")
    moved = F.col("raw_id") % 11 == 0
    r = r.withColumns({"subject": F.when(moved, F.concat(F.lit("ауд. "), F.coalesce("location_text", F.lit("")))).otherwise(F.col("subject")), "location_text": F.when(moved & (F.col("raw_id") % 2 == 0), F.lit(" ")).otherwise(F.col("location_text"))})
    good, bad = coverage.split_good(r, coverage.is_place_only(F.col("subject"), F.col("location_text")))
    mark = lambda df, name: df.groupBy("parser_name").agg(F.count("*").alias("lessons")).withColumn("part", F.lit(name))
    return mark(good, "good").unionByName(mark(bad, "set aside"))


def rule_issues(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with typed rules."""
    return coverage.rule_issues(table(spark, d, "manual_rule"), table(spark, d, "group_ref"), 1, 16)


def few_events(spark: SparkSession, d: str) -> DataFrame:
    """Group days with suspiciously few lectures and practices (A4)."""
    return coverage.few_events(table(spark, d, "schedule_event").where("event_date IS NOT NULL"), ["program_code", "course", "event_date"])


def readiness(spark: SparkSession, d: str) -> DataFrame:
    """Whether the events of each program and course can be published."""
    e = table(spark, d, "schedule_event")
    return coverage.readiness(e, ["program_code", "course"], ["program_code", "course", "group_code", "stream_code", "event_date", "start_time"], ["lesson_type", "subject", "location_text"])


def lessons_merged(spark: SparkSession, d: str) -> DataFrame:
    """Equal lessons that follow each other as one, those marked as merged before counting twice, every seventh subject the one that
    stays whole under two spellings (W2, F14)."""
    e = table(spark, d, "schedule_event").dropDuplicates(["event_id"])
    e, org = e.withColumn("o", F.length("subject") % 7 == 0), F.col("o")
    e = e.withColumn("subject", F.when(org & (F.col("start_time") < "12"), "Основы  российской государственности").when(org, "ОРГ").otherwise(F.col("subject"))).withColumn("event_date", F.when(org, F.trunc("event_date", "month")).otherwise(F.col("event_date")))
    e = e.withColumns({"teacher": F.when(org, F.lit("Т")).otherwise(F.col("teacher")), "location_text": F.when(org, F.lit("Л")).otherwise(F.col("location_text")), "source_url": F.lit("u"), "lesson_type": F.when(org, F.lit("lecture")).otherwise(F.col("lesson_type"))})
    merged = islands.merge_lessons(e.drop("o"), _IDENTITY, "event_id", F.col("is_double") & (F.col("duration_minutes") > 130))
    return merged.select("event_id", "start_time", "end_time", "merged_slot_count", "merged_minutes", "org_merged", "merged_consecutive")


def filled_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Teachers and places filled down within a group's week, a new weekday beginning anew."""
    r = table(spark, d, "raw_event")
    order = Window.partitionBy("program_code", "course", "group_code", "week_number").orderBy("weekday", "raw_id")
    marked = r.withColumn("fresh", F.coalesce(F.lag("weekday").over(order) != F.col("weekday"), F.lit(True)))
    out = islands.fill_down(marked, ["program_code", "course", "group_code", "week_number"], ["weekday", "raw_id"], ["teacher", "half"], F.col("fresh"))
    return out.select("raw_id", "teacher", "half")


def older_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Events by the older meaning, the first of each."""
    e = table(spark, d, "schedule_event").where("event_date IS NOT NULL AND trim(subject) <> ''")
    return dedupe.keep_first(e, dedupe.semantic_key(), ["event_id", "ingested_on"]).select("event_id")


def block_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Weekly blocks by week and slot (U3) and by what a parser compares (U6, U7), the first of each."""
    r = table(spark, d, "raw_event")
    keys = {"block": ["program_code", "course", "group_code", "stream_code", "week_number", "start_time", "end_time", "subject", "location_text"], "parser": ["group_code", "week_number", "weekday", "subject", "location_text", "start_time", "end_time"]}
    first = lambda name: dedupe.keep_first(r, [F.col(c) for c in keys[name]], ["raw_id"]).select("raw_id", F.lit(name).alias("rule"))
    return first("block").unionByName(first("parser"))


def period_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Periods of a plan that are equal in days, kind and label, the first of each (U8)."""
    p = table(spark, d, "study_period")
    return dedupe.keep_first(p, [F.col(c) for c in ("plan_code", "from_date", "to_date", "period_kind", "period_label")], ["period_id"]).select("period_id")


def period_sources(spark: SparkSession, d: str) -> DataFrame:
    """Periods with the first source of their program and course, or, for one program, of the course alone."""
    p = table(spark, d, "study_period").select("period_id", "program_code", "course")
    s = table(spark, d, "source_provenance").where("url LIKE '%/kug_%'").select("url", "sha256", F.regexp_extract("url", "_([1-6])k_", 1).try_cast("int").alias("course"), F.regexp_extract("url", "_(3[17]05)0([12])_", 1).alias("a"), F.regexp_extract("url", "_3[17]050([12])_", 1).alias("b"))
    s = s.withColumn("program_code", F.concat(F.substring("a", 1, 2), F.lit(".05.0"), "b"))
    return joins.first_or_fallback(p, s.where("program_code <> '31.05.01'"), s, ["program_code", "course"], ["course"], F.col("program_code") == "31.05.01", "url", ["url", "sha256"])


def resolved_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources all of whose captured lessons lie in a week of the calendar."""
    days, _ = joins.resolve_days(table(spark, d, "raw_event"), table(spark, d, "academic_week").where("academic_year = '2026/2027' AND from_date <= to_date").groupBy("week_number").agg(F.min("from_date").alias("from_date"), F.max("to_date").alias("to_date")))
    every = table(spark, d, "raw_event").join(days.select("raw_id", "event_date"), "raw_id", "left").select("source_url", "event_date")
    return joins.all_hold(table(spark, d, "source_provenance").select("url").distinct(), every, "url", "source_url", F.col("event_date").isNotNull(), "resolved")


def now_and_next(spark: SparkSession, d: str) -> DataFrame:
    """Per group what goes on at an instant and what comes next (P10)."""
    e = table(spark, d, "schedule_event").where("event_date IS NOT NULL")
    at = lambda c: F.timestamp_micros(F.unix_micros(F.col("event_date").cast("timestamp")) + minutes_of_day(F.col(c)).cast("long") * 60_000_000)
    e = e.select("program_code", "course", "group_code", "event_id", at("start_time").alias("a"), at("end_time").alias("z"))
    return joins.now_and_next(e, ["program_code", "course", "group_code"], "a", "z", "event_id", F.lit("2026-11-16 10:00:00").cast("timestamp"))


def owned_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits whose user belongs to one owner (J14, P11), per user with their types nested in order."""
    e = table(spark, d, "events")
    users = e.select("user_id").distinct().withColumn("owner", F.concat(F.lit("owner"), (F.col("user_id") % 3).cast("string")))
    counts = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    mine = joins.owned(counts, users, "user_id", "owner", "owner1")
    found = joins.nested(users, mine, "user_id", "types", ["event_type"])
    return found.select("user_id", "owner", F.array_join(F.transform("types", lambda t: F.concat_ws("=", t["event_type"], t["n"].cast("string"))), ",").alias("types"))


def older_scope(spark: SparkSession, d: str) -> DataFrame:
    """Rules that concern a group by the older rule: without groups only if they are for all."""
    r = table(spark, d, "manual_rule").select("rule_id", F.element_at(F.when(F.size("groups_list") > 0, F.col("groups_list")), 1).alias("group_code"), "audience", F.when(F.col("rule_id") % 3 == 0, "A").when(F.col("rule_id") % 3 == 1, "B").alias("stream_code"))
    return scope.unscoped_in_scope(r, "163", "A").select("rule_id")


def complete_lessons(spark: SparkSession, d: str) -> DataFrame:
    """Captured lessons with everything that is required, of one program's course (P12, P13), of one kind (P3), in order of week (O3), their texts as one."""
    r = table(spark, d, "raw_event")
    found = scope.complete_rows(r, ["subject", "teacher", "start_time", "end_time"], "31.05.01", 2).where("lesson_type = 'lecture'")
    shape = F.to_json(F.struct(F.col("raw_id").alias("id"), F.col("group_code").alias("group"), F.col("week_number").alias("week")))
    return found.select("raw_id", "week_number", "start_time", "subject", shape.alias("api")).orderBy(*orders.by_week(), "raw_id")


def listing_places(spark: SparkSession, d: str) -> DataFrame:
    """The place of each captured lesson in its parser's list by week, weekday, start, group and subject, nulls as the list wants them."""
    r = table(spark, d, "raw_event").withColumns({"week_number": F.when(F.col("raw_id") % 13 == 0, None).otherwise(F.col("week_number")), "weekday": F.when(F.col("raw_id") % 7 == 0, None).otherwise(F.col("weekday"))})
    order = Window.partitionBy("parser_name", "program_code", "course").orderBy(*orders.by_week_and_group(), "raw_id")
    return r.select("raw_id", F.row_number().over(order).alias("place"))


def deadlines(spark: SparkSession, d: str) -> DataFrame:
    """Each chair's three next deadlines, tasks without one last, the newest first of equals."""
    r = table(spark, d, "manual_rule").where("chair_code IS NOT NULL").select("chair_code", "rule_id", F.when(F.col("rule_id") % 4 > 0, F.date_add(F.lit("2026-11-01").cast("date"), (F.col("rule_id") % 17).cast("int"))).alias("due"), F.col("rule_id").alias("created_at"))
    order = Window.partitionBy("chair_code").orderBy(*orders.by_due(), "rule_id")
    return r.withColumn("place", F.row_number().over(order)).where("place <= 3").select("chair_code", "place", "rule_id", "due")


def newest_hits(spark: SparkSession, d: str) -> DataFrame:
    """The thirty newest hits of each user (M7)."""
    return newest_rows(table(spark, d, "events"), ["user_id"], "ts", ["event_id"], 30).select("event_id", "user_id")


def usable_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Which delivery of each program and course is to be shown at an instant."""
    s = table(spark, d, "event_snapshot").groupBy("program_code", "course", "snapshot_no").agg(F.max("received_at").alias("cached_at"), F.count("*").alias("events"))
    s = s.withColumns({"pipeline_version": F.when(F.col("snapshot_no") % 2 == 0, "1").otherwise("2"), "cached_at": F.col("cached_at").cast("timestamp_ntz").cast("timestamp")})
    both = s.withColumn("now", F.max("cached_at").over(Window.partitionBy()))  # one row per part and delivery
    return usable(both, ["program_code", "course"], F.col("now"), "2", 6, 400)


def both_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Official events and hits of users in one table (U9), filtered with defaults (P5), counted."""
    e = table(spark, d, "schedule_event").select("event_id", F.col("lesson_type").alias("category"), "event_date")
    h = table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_type") == "error", None).otherwise(F.col("event_type")).alias("category"), F.when(F.col("user_id") % 2 == 0, "completed").alias("status"))
    both = scope.both_kinds(e, h)
    kept = scope.with_defaults(both, status="planned")
    return kept.groupBy("kind", "read_only", F.coalesce("category", F.lit("personal")).alias("category")).agg(F.count("*").alias("n"), F.count("event_date").alias("dated"))


def payload_issues(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with hits handed in as events."""
    return recurrence.payload_issues(_payloads(spark, d), "event_id", ["UTC", "Europe/Moscow"])


def payloads_taken(spark: SparkSession, d: str) -> DataFrame:
    """Events handed in as they are kept: instants, trimmed texts, defaults, few attendees."""
    good = _payloads(spark, d).join(payload_issues(spark, d).select("event_id").distinct(), "event_id", "left_anti")
    p = recurrence.normal_payloads(good)
    return p.select("event_id", "title", F.col("start_at").cast("timestamp_ntz").alias("start_at"), F.col("end_at").cast("timestamp_ntz").alias("end_at"), "category", "status", "privacy", F.size("attendees").alias("attendees"), F.element_at("attendees", -1).alias("last"))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n, at = F.col("event_id"), F.col("ts").cast("timestamp_ntz").cast("timestamp")
    iso = lambda x, zone: F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), zone)
    zone = F.when(n % 10 == 0, "").when(n % 2 == 0, "Z").otherwise("+03:00")
    end = F.timestamp_micros(F.unix_micros(at) + F.when(n % 17 == 0, -60).otherwise(3600).cast("long") * 10**6)
    return e.select(
        "event_id", F.when(n % 23 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type")).alias("title"), iso(at, zone).alias("start_at"), iso(end, zone).alias("end_at"), F.when(n % 19 == 0, "Mars/Base").alias("time_zone"),
        F.when(n % 29 == 0, "someday").alias("status"), F.when(n % 31 == 0, "secret").alias("privacy"), F.when(n % 3 == 0, F.when(n % 9 == 0, "hourly").otherwise("weekly")).alias("frequency"),
        (n % 40).cast("int").alias("repeat_interval"), F.when(n % 37 == 0, "2026-02-30").alias("until_date"), F.lit(None).cast("string").alias("description"), F.when(n % 5 == 0, " ").alias("category"), F.lit("x" * 600).alias("location"), F.lit("").alias("meeting_url"),
        F.transform(F.sequence(F.lit(1), F.lit(150)), lambda k: F.concat(F.lit(" a"), k.cast("string"))).alias("attendees"),
    )


def changed_series(spark: SparkSession, d: str) -> DataFrame:
    """Every user's hits as a series, one change to each: one occurrence, the following ones or all changed, or removed."""
    e = table(spark, d, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select("event_id", (F.col("user_id") % 2).cast("string").alias("owner_id"), F.concat(F.lit("s"), "user_id").alias("series_id"), (F.row_number().over(order) - 1).alias("occurrence_index"), F.lit("daily").alias("frequency"))
    users = e.select("user_id").distinct()
    changes = users.select(F.when(F.col("user_id") % 11 == 0, "other").otherwise((F.col("user_id") % 2).cast("string")).alias("owner_id"), F.concat(F.lit("s"), "user_id").alias("series_id"), F.lit(5).alias("at_index"), F.element_at(F.array(*map(F.lit, ("single", "following", "series"))), (F.col("user_id") % 3 + 1).cast("int")).alias("scope"), F.concat(F.lit("n"), "user_id").alias("new_series_id"), (F.col("user_id") % 5 == 0).alias("delete"))
    return recurrence.change_series(rows, changes)


def owner_range(spark: SparkSession, d: str) -> DataFrame:
    """One user's hits as events within a range that they overlap half-open, in order, of a limited list."""
    e = table(spark, d, "events")
    at = F.col("ts").cast("timestamp_ntz").cast("timestamp")
    rows = e.select("event_id", F.col("user_id").cast("string").alias("owner_id"), F.col("event_type").alias("title"), at.alias("start_at"), F.timestamp_micros(F.unix_micros(at) + F.lit(7200 * 10**6)).alias("end_at"), F.lit("planned").alias("status"))
    first = e.agg(F.min("user_id")).first()[0]
    found = recurrence.in_range(rows, str(first), "2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z", status="planned")
    return found.limit(5000).select("event_id", F.col("start_at").cast("timestamp_ntz").alias("start_at"), "title")


def source_roles(spark: SparkSession, d: str) -> DataFrame:
    """Which roles of sources each program and course needs and has: sources by their address, else the fallback; roles of neither are missing."""
    s = table(spark, d, "source_provenance").select("url").distinct()
    kind = F.when(F.col("url").contains("/lec_"), "lecture").when(F.col("url").contains("/prak_"), "practice")
    have = s.select(F.regexp_extract("url", "_([1-6])k_", 1).try_cast("int").alias("course"), F.regexp_extract("url", "_(3[17]050[12])_", 1).alias("p"), kind.alias("role")).where("role IS NOT NULL")
    have = have.select(F.concat(F.substring("p", 1, 2), F.lit("."), F.substring("p", 3, 2), F.lit("."), F.substring("p", 5, 2)).alias("program_code"), "course", "role").distinct()
    need = table(spark, d, "group_ref").select("program_code", "course").distinct().withColumn("role", F.explode(F.array(*map(F.lit, ("lecture", "practice", "calendar")))))
    fallback = need.where("role = 'practice'").select("program_code", "course", "role")
    found = need.join(have.withColumn("a", F.lit(True)), ["program_code", "course", "role"], "left").join(fallback.withColumn("b", F.lit(True)), ["program_code", "course", "role"], "left")
    return found.select("program_code", "course", "role", F.when(F.col("a"), "found").when(F.col("b"), "fallback").otherwise("missing").alias("origin"))


def payload_lessons(spark: SparkSession, d: str) -> DataFrame:
    """Events as delivered, a JSON payload for each group's day with aliases, read by the payload's shape and flattened."""
    e = table(spark, d, "schedule_event").where("event_date IS NOT NULL AND group_code RLIKE '^[0-9]{3}[А-Я]?$'")
    day, odd = F.date_format("event_date", "d.M.yyyy"), F.col("course") % 2 == 1
    event = F.struct(F.col("event_id").alias("id"), F.when(odd, day).alias("date"), F.when(~odd, day).alias("dateHint"), F.concat_ws(" - ", "start_time", "end_time").alias("time"), F.when(odd, F.lit("Предмет")).alias("discipline"), F.when(~odd, F.lit("Предмет")).alias("name"), F.array("group_code").alias("groups"))
    one = e.dropDuplicates(["event_id", "group_code", "event_date"]).groupBy("program_code", "course", "group_code", "event_date").agg(F.collect_list(event).alias("events"))
    text = F.to_json(F.struct(F.lit(7).alias("schemaVersion"), F.lit("x").alias("generatedAt"), F.col("program_code").alias("specialty"), F.create_map(F.concat("course", F.lit(" курс")), F.struct("events")).alias("courses")))
    payloads = one.select(F.from_json(text, payload.PAYLOAD).alias("p")).select("p.*")
    good = payloads.where("schemaVersion IS NOT NULL")
    return payload.payload_events(good).select("event_id", "program_code", "course", "group_code", "event_date", "start_time", "end_time", "double_part", "subject")


QUERIES = {
    f.__name__: f
    for f in (
        lesson_issues, exact_duplicates, set_aside, rule_issues, few_events, readiness, lessons_merged, filled_blocks, older_duplicates, block_duplicates, period_duplicates, period_sources, resolved_sources, now_and_next, owned_hits, older_scope,
        complete_lessons, listing_places, deadlines, newest_hits, usable_snapshots, both_kinds, payload_issues, payloads_taken, changed_series, owner_range, source_roles, payload_lessons,
    )
}

_MIN = lambda c: f"(CAST(substr({c}, 1, 2) AS INT) * 60 + CAST(substr({c}, 4, 2) AS INT))"
_SEM = lambda c: f"trim(regexp_replace(replace(lower({c}), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_NO_NULL = "COALESCE(location_text, '')"
_GROUP = "regexp_replace(upper(trim(group_code)), '\\s+', '', 'g')"
_LESSON_RULES = {
    "unknown kind": "lesson_type IS NULL OR lesson_type NOT IN ('lecture', 'practice', 'lab', 'assessment', 'other')",
    "no stream": "course <> 6 AND (stream_code IS NULL OR stream_code NOT IN ('A', 'B'))",
    "stream in the last course": "course = 6 AND COALESCE(stream_code, '') <> ''",
    "practice of no group": f"lesson_type = 'practice' AND NOT COALESCE(regexp_full_match({_GROUP}, '[0-9]{{3}}[А-Я]?'), FALSE)",
    "lecture of one group": f"lesson_type = 'lecture' AND NOT COALESCE({_GROUP} IN ('ALL', '*', 'ОБЩИЕ', 'ОБЩАЯ', 'ВСЕ'), FALSE)",
    "strange weekday": "weekday NOT BETWEEN 0 AND 6",
    "no weekday": "weekday IS NULL AND lesson_type <> 'practice'",
    "late practice without weekday": "weekday IS NULL AND lesson_type = 'practice' AND course IN (4, 5, 6)",
    "clock not canonical": "NOT COALESCE(regexp_full_match(start_time, '[0-9]{2}:[0-9]{2}') AND regexp_full_match(end_time, '[0-9]{2}:[0-9]{2}'), FALSE)",
    "no duration": f"COALESCE(regexp_full_match(start_time, '[0-9]{{2}}:[0-9]{{2}}') AND regexp_full_match(end_time, '[0-9]{{2}}:[0-9]{{2}}'), FALSE) AND NOT COALESCE({_MIN('end_time')} - {_MIN('start_time')} BETWEEN 1 AND 240, FALSE)",
    "strange week": "week_number IS NULL OR week_number NOT BETWEEN 1 AND 52",
    "no subject": "COALESCE(trim(subject), '') = ''",
    "place in the subject": "regexp_matches(trim(subject), '^((ЦДТИ|АСЦ|ШКОЛА|Башня|КПК|Солнечное|Пархоменко|ПЦ|МНТК|КВД|ЛРК|ИМО|ДЛРК|РНХИ|СПБ|НМИЦ|НИИ|ФГБНУ|База)($|[^\\p{L}\\p{N}_])|(ауд|каб)[.]?\\s|зал\\s|ул[.]\\s|прос?п?[.]?\\s)', 'i')",
}
_PLACE_ONLY = "COALESCE(trim(location_text), '') = '' AND COALESCE(" + _LESSON_RULES["place in the subject"] + ", FALSE)"
_WEEKS = """list_filter(list_distinct(list_concat(flatten(list_transform(regexp_extract_all(s, '\\d{1,2}\\s*-\\s*\\d{1,2}'), lambda p: range(CAST(regexp_extract(p, '^\\d+') AS BIGINT), CAST(regexp_extract(p, '\\d+$') AS BIGINT) + 1))),
  list_transform(regexp_extract_all(s, '\\d{1,2}'), lambda p: CAST(p AS BIGINT)))), lambda w: w BETWEEN 1 AND 52)"""
_PAYLOAD = """
WITH p AS (SELECT event_id AS n, event_id, event_type, ts, CASE WHEN event_id % 17 = 0 THEN ts - INTERVAL 1 MINUTE ELSE ts + INTERVAL 1 HOUR END AS z FROM events),
bad AS (
  SELECT event_id, 'no title' AS issue FROM p WHERE n % 23 = 0 UNION ALL SELECT event_id, 'no instant' FROM p WHERE n % 10 = 0 UNION ALL SELECT event_id, 'ends before it starts' FROM p WHERE n % 17 = 0 AND n % 10 <> 0
  UNION ALL SELECT event_id, 'unknown frequency' FROM p WHERE n % 9 = 0 UNION ALL SELECT event_id, 'strange interval' FROM p WHERE n % 3 = 0 AND n % 40 NOT BETWEEN 1 AND 31
  UNION ALL SELECT event_id, 'strange end of the series' FROM p WHERE n % 3 = 0 AND n % 37 = 0 UNION ALL SELECT event_id, 'unknown status' FROM p WHERE n % 29 = 0 UNION ALL SELECT event_id, 'unknown privacy' FROM p WHERE n % 31 = 0 UNION ALL SELECT event_id, 'unknown zone' FROM p WHERE n % 19 = 0)"""
ORACLE = {
    "lesson_issues": "SELECT issue, count(*) AS rows_hit FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS issue FROM raw_event WHERE {v}" for k, v in _LESSON_RULES.items()) + ") GROUP BY issue",
    "exact_duplicates": "SELECT program_code, course, sum(n - 1)::BIGINT AS extra FROM (SELECT program_code, course, count(*) AS n FROM raw_event GROUP BY lesson_type, stream_code, group_code, week_number, weekday, start_time, end_time, subject, location_text, program_code, course HAVING count(*) > 1) GROUP BY ALL",
    "set_aside": f"""
WITH r AS (SELECT parser_name, CASE WHEN raw_id % 11 = 0 THEN 'ауд. ' || COALESCE(location_text, '') ELSE subject END AS subject, CASE WHEN raw_id % 22 = 0 THEN ' ' ELSE location_text END AS location_text FROM raw_event)
SELECT parser_name, CASE WHEN {_PLACE_ONLY} THEN 'set aside' ELSE 'good' END AS part, count(*) AS lessons FROM r GROUP BY ALL""",
    "rule_issues": f"""
WITH r AS (SELECT * EXCLUDE (s), {_WEEKS} AS ws FROM (SELECT *, regexp_replace(weeks_spec, '[–—−]', '-', 'g') AS s FROM manual_rule)),
g AS (SELECT *, unnest(list_distinct(groups_list)) AS g FROM r), w AS (SELECT *, unnest(ws) AS w FROM g),
k AS (SELECT rule_id, min(rule_id) OVER (PARTITION BY program_code, course, g, w, weekday, start_time, end_time, subject) AS first FROM w)
SELECT rule_id, 'no clock' AS issue FROM r WHERE start_time IS NULL OR end_time IS NULL UNION ALL SELECT rule_id, 'ends before it starts' FROM r WHERE {_MIN("end_time")} <= {_MIN("start_time")}
UNION ALL SELECT rule_id, 'weekday not 1 to 7' FROM r WHERE NOT COALESCE(weekday BETWEEN 1 AND 7, FALSE) UNION ALL SELECT rule_id, 'weeks outside the window' FROM r WHERE list_max(ws) > 16
UNION ALL SELECT DISTINCT rule_id, 'unknown group' FROM g WHERE NOT EXISTS (SELECT 1 FROM group_ref f WHERE f.program_code = g.program_code AND f.course = g.course AND regexp_replace(upper(trim(f.group_code)), '\\s+', '', 'g') = regexp_replace(upper(trim(g.g)), '\\s+', '', 'g'))
UNION ALL SELECT DISTINCT rule_id, 'repeats an earlier rule' FROM k WHERE rule_id <> first""",
    "few_events": "WITH c AS (SELECT program_code, course, event_date, count(*) FILTER (lesson_type = 'lecture') AS lecture, count(*) FILTER (lesson_type = 'practice') AS practice FROM schedule_event WHERE event_date IS NOT NULL GROUP BY ALL) SELECT program_code, course, event_date, 'lecture' AS kind, lecture AS events FROM c WHERE lecture < 3 UNION ALL SELECT program_code, course, event_date, 'practice', practice FROM c WHERE practice < 3",
    "readiness": f"""
WITH a AS (SELECT program_code, course, count(*) AS events, count(*) FILTER (COALESCE(trim(group_code), '') = '' OR COALESCE(lesson_type, '') = '' OR start_time IS NULL OR end_time IS NULL OR event_date IS NULL) AS missing, count(*) FILTER ({_PLACE_ONLY}) AS set_aside FROM schedule_event GROUP BY ALL),
b AS (SELECT program_code, course, sum(n - 1)::BIGINT AS duplicates FROM (SELECT program_code, course, count(*) AS n FROM schedule_event GROUP BY program_code, course, group_code, stream_code, event_date, start_time, end_time, lesson_type, subject, location_text) GROUP BY ALL),
f AS (SELECT program_code, course, ROW(COALESCE(lesson_type, ''), COALESCE(subject, ''), COALESCE(location_text, '')) AS r, first_value(ROW(COALESCE(lesson_type, ''), COALESCE(subject, ''), COALESCE(location_text, ''))) OVER (PARTITION BY program_code, course, group_code, stream_code, event_date, start_time ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS f FROM schedule_event),
c AS (SELECT program_code, course, count(*) AS conflicts FROM f WHERE f <> r GROUP BY ALL)
SELECT program_code, course, events, missing, COALESCE(duplicates, 0) AS duplicates, COALESCE(conflicts, 0) AS conflicts, set_aside, CASE WHEN missing + COALESCE(duplicates, 0) + COALESCE(conflicts, 0) + set_aside > 0 THEN 'not-ready' ELSE 'ready' END AS status FROM a LEFT JOIN b USING (program_code, course) LEFT JOIN c USING (program_code, course)""",
    "lessons_merged": f"""
WITH e AS (SELECT DISTINCT ON (event_id) *, length(subject) % 7 = 0 AS o, {_MIN("start_time")} AS a, {_MIN("end_time")} AS z FROM schedule_event),
k AS (SELECT *, ROW(program_code, course, group_code, COALESCE(stream_code, ''), CASE WHEN o THEN date_trunc('month', event_date)::DATE ELSE event_date END, CASE WHEN o THEN 'lecture' ELSE lesson_type END, CASE WHEN o THEN 'org' ELSE '=' || lower(trim(regexp_replace(replace(subject, chr(160), ' '), '\\s+', ' ', 'g'))) END,
  CASE WHEN o THEN 'л' ELSE COALESCE(lower(trim(regexp_replace(replace(location_text, chr(160), ' '), '\\s+', ' ', 'g'))), '') END, CASE WHEN o THEN 'т' ELSE COALESCE(lower(teacher), '') END, COALESCE(half, '')) AS id,
  z > a AND (z - a BETWEEN 45 AND 130 OR (COALESCE(is_double AND duration_minutes > 130, FALSE) AND z - a > 130)) AS fits, CASE WHEN COALESCE(is_double AND duration_minutes > 130, FALSE) THEN 2 ELSE 1 END AS c FROM e),
n AS (SELECT *, CASE WHEN fits AND lag(fits) OVER w AND a - lag(z) OVER w BETWEEN 0 AND 20 THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY id ORDER BY a, z, event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY a, z, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n),
m AS (SELECT arg_min(ROW(event_id, start_time, end_time, a, fits, o), ROW(a, z, event_id)) AS f, arg_max(ROW(end_time, z), ROW(a, z, event_id)) AS l, sum(c) AS c FROM r GROUP BY id, run)
SELECT f[1] AS event_id, f[2] AS start_time, CASE WHEN c >= 2 AND f[5] THEN l[1] ELSE f[3] END AS end_time, CASE WHEN c >= 2 AND f[5] THEN CAST(c AS INT) END AS merged_slot_count, CASE WHEN c >= 2 AND f[5] THEN l[2] - f[4] END AS merged_minutes, CASE WHEN c >= 2 AND f[5] THEN f[6] END AS org_merged, CASE WHEN c >= 2 AND f[5] THEN NOT f[6] END AS merged_consecutive FROM m""",
    "filled_blocks": """
SELECT raw_id, last_value(teacher IGNORE NULLS) OVER w AS teacher, last_value(half IGNORE NULLS) OVER w AS half FROM raw_event WINDOW w AS (PARTITION BY program_code, course, group_code, week_number, weekday ORDER BY raw_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "older_duplicates": f"SELECT min(event_id) AS event_id FROM schedule_event WHERE event_date IS NOT NULL AND trim(subject) <> '' GROUP BY event_date, start_time, end_time, {_SEM('subject')}, {_SEM(_NO_NULL)}, lesson_type",
    "block_duplicates": "SELECT min(raw_id) AS raw_id, 'block' AS rule FROM raw_event GROUP BY program_code, course, group_code, stream_code, week_number, start_time, end_time, subject, location_text UNION ALL SELECT min(raw_id), 'parser' FROM raw_event GROUP BY group_code, week_number, weekday, subject, location_text, start_time, end_time",
    "period_duplicates": "SELECT min(period_id) AS period_id FROM study_period GROUP BY plan_code, from_date, to_date, period_kind, period_label",
    "period_sources": """
WITH s AS (SELECT url, sha256, CAST(nullif(regexp_extract(url, '_([1-6])k_', 1), '') AS INT) AS course, CASE WHEN contains(url, '_370501_') THEN '37.05.01' WHEN contains(url, '_310502_') THEN '31.05.02' WHEN contains(url, '_310501_') THEN '31.05.01' END AS program_code FROM source_provenance WHERE url LIKE '%/kug_%'),
a AS (SELECT program_code, course, arg_min(ROW(url, sha256), url) AS f FROM s WHERE program_code <> '31.05.01' GROUP BY ALL), b AS (SELECT course, arg_min(ROW(url, sha256), url) AS f FROM s GROUP BY ALL)
SELECT p.period_id, p.program_code, p.course, CASE WHEN a.f IS NOT NULL THEN a.f[1] WHEN p.program_code = '31.05.01' THEN b.f[1] END AS found_url, CASE WHEN a.f IS NOT NULL THEN a.f[2] WHEN p.program_code = '31.05.01' THEN b.f[2] END AS found_sha256
FROM study_period p LEFT JOIN a ON a.program_code = p.program_code AND a.course = p.course LEFT JOIN b ON b.course = p.course""",
    "resolved_sources": """
WITH w AS (SELECT week_number, min(from_date) AS a, max(to_date) AS z FROM academic_week WHERE academic_year = '2026/2027' AND from_date <= to_date GROUP BY ALL),
r AS (SELECT source_url, COALESCE(weekday BETWEEN 0 AND 6 AND CAST(a + CAST((weekday - (isodow(a) - 1) + 7) % 7 AS INT) AS DATE) <= z, FALSE) AS good FROM raw_event LEFT JOIN w USING (week_number))
SELECT url, COALESCE((SELECT bool_and(good) FROM r WHERE source_url = url), FALSE) AS resolved FROM (SELECT DISTINCT url FROM source_provenance)""",
    "now_and_next": f"""
WITH e AS (SELECT program_code, course, group_code, event_id, CAST(event_date AS TIMESTAMP) + to_minutes({_MIN("start_time")}) AS a, CAST(event_date AS TIMESTAMP) + to_minutes({_MIN("end_time")}) AS z FROM schedule_event WHERE event_date IS NOT NULL),
x AS (SELECT program_code, course, group_code, min(ROW(a, event_id)) FILTER (a <= TIMESTAMP '2026-11-16 10:00:00' AND z > TIMESTAMP '2026-11-16 10:00:00') AS c, min(ROW(a, event_id)) FILTER (a > TIMESTAMP '2026-11-16 10:00:00') AS f FROM e GROUP BY ALL)
SELECT program_code, course, group_code, c[2] AS "current", f[2] AS "following" FROM x WHERE c IS NOT NULL OR f IS NOT NULL""",
    "owned_hits": """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT u.user_id, 'owner' || (u.user_id % 3) AS owner, COALESCE((SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) FROM c WHERE c.user_id = u.user_id AND u.user_id % 3 = 1), '') AS types FROM (SELECT DISTINCT user_id FROM events) u""",
    "older_scope": "SELECT rule_id FROM manual_rule WHERE rule_id % 3 <> 1 AND CASE WHEN groups_list IS NULL OR len(groups_list) = 0 OR trim(COALESCE(groups_list[1], '')) = '' THEN COALESCE(audience = 'ALL', FALSE) ELSE upper(trim(groups_list[1])) IN ('163', 'ALL', '*', 'ОБЩИЕ', 'ОБЩАЯ', 'ВСЕ') END",
    "complete_lessons": """
SELECT raw_id, week_number, start_time, subject, CAST(json_object('id', raw_id, 'group', group_code, 'week', week_number) AS VARCHAR) AS api FROM raw_event WHERE program_code = '31.05.01' AND course = 2 AND lesson_type = 'lecture' AND trim(subject) <> '' AND trim(teacher) <> '' AND start_time <> '' AND end_time <> '' AND group_code IS NOT NULL""",
    "listing_places": """
SELECT raw_id, CAST(row_number() OVER (PARTITION BY parser_name, program_code, course ORDER BY CASE WHEN raw_id % 13 = 0 OR COALESCE(week_number, 0) = 0 THEN 999 ELSE week_number END, CASE WHEN raw_id % 7 = 0 THEN 99 ELSE COALESCE(weekday, 99) END, COALESCE(start_time, ''), COALESCE(group_code, ''), COALESCE(subject, ''), raw_id) AS INT) AS place FROM raw_event""",
    "deadlines": """
WITH r AS (SELECT chair_code, rule_id, CASE WHEN rule_id % 4 > 0 THEN CAST(DATE '2026-11-01' + CAST(rule_id % 17 AS INT) AS DATE) END AS due FROM manual_rule WHERE chair_code IS NOT NULL)
SELECT chair_code, CAST(place AS INT) AS place, rule_id, due FROM (SELECT *, row_number() OVER (PARTITION BY chair_code ORDER BY due ASC NULLS LAST, rule_id DESC) AS place FROM r) WHERE place <= 3""",
    "newest_hits": "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 30",
    "usable_snapshots": """
WITH s AS (SELECT program_code, course, snapshot_no, max(received_at) AS t FROM event_snapshot GROUP BY ALL), n AS (SELECT max(t) AS now FROM s), g AS (SELECT s.*, epoch(now) - epoch(t) AS age FROM s, n WHERE snapshot_no % 2 = 1)
SELECT program_code, course, b.no AS snapshot_no, CASE WHEN b.age <= 6 * 3600 THEN 'fresh' ELSE 'cache' END AS status FROM (SELECT program_code, course, arg_max({'no': snapshot_no, 'age': age}, ROW(-age, snapshot_no)) AS b FROM g WHERE age <= 400 * 86400 GROUP BY ALL)""",
    "both_kinds": """
SELECT kind, read_only, category, count(*) AS n, count(d) AS dated FROM (
  SELECT 'schedule' AS kind, TRUE AS read_only, COALESCE(lesson_type, 'personal') AS category, event_date AS d FROM schedule_event
  UNION ALL SELECT 'personal', FALSE, CASE WHEN event_type = 'error' THEN 'personal' ELSE event_type END, NULL FROM events WHERE user_id % 2 <> 0) GROUP BY ALL""",
    "payload_issues": f"{_PAYLOAD} SELECT event_id, issue FROM bad",
    "payloads_taken": f"""{_PAYLOAD}
SELECT event_id, trim(event_type) AS title, CASE WHEN n % 2 = 0 THEN ts ELSE ts - INTERVAL 3 HOUR END AS start_at, CASE WHEN n % 2 = 0 THEN z ELSE z - INTERVAL 3 HOUR END AS end_at, 'personal' AS category, 'planned' AS status, 'private' AS privacy, 100 AS attendees, 'a100' AS last FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts, date_trunc('second', z) AS z) FROM p) WHERE event_id NOT IN (SELECT event_id FROM bad)""",
    "changed_series": """
WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS i FROM events),
h AS (SELECT *, user_id % 11 <> 0 AND CASE user_id % 3 WHEN 0 THEN i = 5 WHEN 1 THEN i >= 5 ELSE TRUE END AS hit FROM r)
SELECT event_id, CAST(user_id % 2 AS VARCHAR) AS owner_id, CASE WHEN hit AND user_id % 3 > 0 THEN 'n' ELSE 's' END || user_id AS series_id, CASE WHEN hit AND user_id % 3 = 1 THEN i - 5 ELSE i END AS occurrence_index, CASE WHEN hit AND user_id % 3 = 0 THEN NULL ELSE 'daily' END AS frequency FROM h WHERE NOT (hit AND user_id % 5 = 0)""",
    "owner_range": "SELECT event_id, ts AS start_at, event_type AS title FROM events WHERE user_id = (SELECT min(user_id) FROM events) AND ts + INTERVAL 2 HOUR > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'",
    "payload_lessons": f"""
WITH e AS (SELECT DISTINCT event_id, program_code, course, group_code, event_date, start_time, end_time, {_MIN("start_time")} AS a, {_MIN("end_time")} AS z FROM schedule_event WHERE event_date IS NOT NULL AND regexp_full_match(group_code, '[0-9]{{3}}[А-Я]?')),
c AS (SELECT *, unnest(CASE WHEN z - a IN (185, 205) THEN [1, 2] ELSE [0] END) AS p, (z - a - 15) // 2 AS half FROM e WHERE a < z),
t AS (SELECT *, CASE WHEN p = 2 THEN a + half + 15 ELSE a END AS s, CASE WHEN p = 1 THEN a + half ELSE z END AS f FROM c)
SELECT concat_ws('-', event_id, CAST(event_date AS VARCHAR), group_code, p) AS event_id, program_code, course, group_code, event_date, lpad((s // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS start_time, lpad((f // 60)::VARCHAR, 2, '0') || ':' || lpad((f % 60)::VARCHAR, 2, '0') AS end_time, CASE WHEN p > 0 THEN CAST(p AS INT) END AS double_part, 'Предмет' AS subject FROM t""",
    "source_roles": """
WITH h AS (SELECT DISTINCT CASE WHEN contains(url, '_370501_') THEN '37.05.01' WHEN contains(url, '_310502_') THEN '31.05.02' WHEN contains(url, '_310501_') THEN '31.05.01' END AS p, CAST(nullif(regexp_extract(url, '_([1-6])k_', 1), '') AS INT) AS c, CASE WHEN contains(url, '/lec_') THEN 'lecture' WHEN contains(url, '/prak_') THEN 'practice' END AS role FROM source_provenance)
SELECT n.program_code, n.course, n.role, CASE WHEN h.p IS NOT NULL THEN 'found' WHEN n.role = 'practice' THEN 'fallback' ELSE 'missing' END AS origin FROM (SELECT program_code, course, unnest(['lecture', 'practice', 'calendar']) AS role FROM (SELECT DISTINCT program_code, course FROM group_ref)) n LEFT JOIN h ON h.p = n.program_code AND h.c = n.course AND h.role = n.role""",
}
