"""Column functions as queries over whole tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import temporal, text
from chronoweave.functions.clock import minutes_of_day
from chronoweave.operators.documents import clock_for_place, repaired
from chronoweave.sources.tables import table


def written_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of study periods written in three ways, one of them no day, and read back, alone and as ranges."""
    p = table(spark, d, "study_period")
    dotted = lambda c: F.date_format(c, "d.M.yyyy")
    written = F.when(F.col("period_id") % 3 == 0, F.col("from_date").cast("string")).when(F.col("period_id") % 3 == 1, dotted("from_date")).otherwise(F.concat(dotted("from_date"), F.lit(".")))
    spans = temporal.read_date_range(F.concat(F.lit("с "), dotted("from_date"), F.lit(" — "), F.col("to_date").cast("string")))
    return p.select("period_id", temporal.read_date(F.concat(F.lit(" "), written)).alias("day"), spans["from_date"].alias("range_from"), spans["to_date"].alias("range_to"))


def written_clocks(spark: SparkSession, d: str) -> DataFrame:
    """Clocks of captured lessons written as ranges in four ways and read back; reversed ranges and ranges without a colon or hyphen are none."""
    r = table(spark, d, "raw_event")
    short = lambda c: F.regexp_replace(F.replace(c, F.lit(":"), F.lit(".")), "^0", "")
    kind = F.col("raw_id") % 4
    written = F.when(kind == 0, F.concat("start_time", F.lit("–"), "end_time")).when(kind == 1, F.concat(short(F.col("start_time")), F.lit(" до "), short(F.col("end_time"))))
    written = written.when(kind == 2, F.concat("end_time", F.lit("-"), "start_time")).otherwise(F.concat(short(F.col("start_time")), F.lit(" "), short(F.col("end_time"))))
    found = temporal.read_clock_range(written)
    return r.select("raw_id", temporal.read_clock(written).alias("first_clock"), found["start_time"].alias("range_start"), found["end_time"].alias("range_end"))


def wall_times(spark: SparkSession, d: str) -> DataFrame:
    """Hits whose instants are read as wall times of a zone with summer time, brought to instants (the later one in the repeated hour) and back."""
    e = table(spark, d, "events")
    wall = F.col("ts").cast("timestamp_ntz").cast("timestamp")
    instant = temporal.local_to_instant(wall, "Europe/Zurich")
    autumn = F.timestamp_micros(F.unix_micros(F.lit("2026-10-25 00:00:00").cast("timestamp")) + F.pmod(F.unix_micros(wall), F.lit(6 * 3600 * 10**6)))
    hour = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", hour(instant).alias("instant"), hour(temporal.instant_to_local(instant, "Europe/Zurich")).alias("wall"), hour(temporal.local_to_instant(autumn, "Europe/Zurich")).alias("autumn_instant"))


def day_spans(spark: SparkSession, d: str) -> DataFrame:
    """The local days that periods touch as events of another zone, and their minutes."""
    p = table(spark, d, "study_period").where("from_date IS NOT NULL AND to_date IS NOT NULL")
    at = lambda c, hours: F.timestamp_micros(F.unix_micros(F.col(c).cast("timestamp")) + F.lit(hours * 3600 * 10**6))
    a, z = at("from_date", 20), at("to_date", 23)
    days = temporal.days_spanned(a, z, "Europe/Moscow")
    return p.select("period_id", F.size(days).alias("days"), F.try_element_at(days, F.lit(1)).alias("first_day"), F.try_element_at(days, F.lit(-1)).alias("last_day"), temporal.minutes_between(a, z).cast("long").alias("minutes"))


def views(spark: SparkSession, d: str) -> DataFrame:
    """For every day with events, what the views of it show (T14), the day in words (T22), and the academic years accepted then."""
    e = table(spark, d, "schedule_event").where("event_date IS NOT NULL").select("event_date").distinct()
    day = F.col("event_date")
    month, work = temporal.view_days(day, "month"), temporal.view_days(day, "workweek")
    years = temporal.accepted_year_starts(day)
    return e.select("event_date", F.size(month).alias("month_days"), F.array_min(month).alias("month_from"), F.array_max(work).alias("work_to"), F.size(temporal.view_days(day, "week")).alias("week_days"), temporal.day_in_words(day).alias("words"), years[0].alias("year"), years[1].alias("next_year"))


def block_days(spark: SparkSession, d: str) -> DataFrame:
    """Slots of weekly blocks read as days of their week, where that is asked for."""
    w = table(spark, d, "academic_week")
    slots = F.array((F.col("week_number") % 9).cast("int"), F.lit(2), F.lit(-1))
    return w.select("calendar_code", "week_number", "from_date", "to_date", F.explode(temporal.matrix_days(F.col("from_date"), slots)).alias("day")).distinct()


def holidays_left_out(spark: SparkSession, d: str) -> DataFrame:
    """The weekdays of academic weeks as days, two holidays left out."""
    import datetime as dt

    free = (dt.date(2026, 11, 4), dt.date(2027, 1, 7))
    w = table(spark, d, "academic_week").where("from_date <= to_date").select("from_date", "to_date").distinct()
    days = w.select("from_date", "to_date", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
    return days.select("from_date", "to_date", "weekday", temporal.day_in_week(F.col("from_date"), F.col("to_date"), F.col("weekday"), free).alias("day")).where("day IS NOT NULL")


def remaining(spark: SparkSession, d: str) -> DataFrame:
    """Countdowns to the begin of each event from a fixed instant, in words."""
    e = table(spark, d, "schedule_event").where("event_date >= DATE '2026-11-16'")
    minutes = F.datediff("event_date", F.lit("2026-11-16").cast("date")) * 1440 + minutes_of_day(F.col("start_time"))
    return e.select("event_id", temporal.countdown(minutes).alias("countdown")).distinct()


def official_instants(spark: SparkSession, d: str) -> DataFrame:
    """Instants of events, whose clocks are those of Moscow."""
    e = table(spark, d, "schedule_event").where("event_date IS NOT NULL")
    at = lambda c: temporal.local_to_instant(F.timestamp_micros(F.unix_micros(F.col("event_date").cast("timestamp")) + minutes_of_day(F.col(c)).cast("long") * 60_000_000), "Europe/Moscow")
    return e.select("event_id", at("start_time").cast("timestamp_ntz").alias("start_at"), at("end_time").cast("timestamp_ntz").alias("end_at")).distinct()


def subject_colours(spark: SparkSession, d: str) -> DataFrame:
    """The colour of every subject of typed rules: a rolling hash of its key over a palette of eight."""
    s = table(spark, d, "manual_rule").where("subject IS NOT NULL").select("subject").distinct()
    return s.select("subject", text.colour_key("subject").alias("colour_key")).select("subject", "colour_key", text.palette_index(F.col("colour_key")).alias("colour"))


def meanings(spark: SparkSession, d: str) -> DataFrame:
    """Captured texts by the older meaning, letters and digits only (U13), and whether they name the subject that stays whole."""
    r = table(spark, d, "raw_event")
    return r.select("raw_id", text.semantic_text(F.col("subject")).alias("meaning"), text.is_org_subject(F.concat("subject", F.when(F.col("raw_id") % 5 == 0, " (ОРГ)").otherwise(" ОРГан"))).alias("org"))


def logged_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts and addresses of documents as logs may hold them."""
    line = F.concat_ws(" ", "source_url", F.concat(F.lit("token = "), F.col("doc_id").cast("string")), "text")
    return table(spark, d, "documents").select("doc_id", text.redacted(line).alias("line"))


def resources(spark: SparkSession, d: str) -> DataFrame:
    """Source pages by type of file, with checks of addresses and colours made of digests, and the label of a kind."""
    s = table(spark, d, "source_provenance").select("url", "sha256").distinct()
    colour = F.concat(F.lit("#"), F.substring("sha256", 1, 6))
    return s.select("url", text.resource_type(F.lit(None).cast("string"), F.concat("url", F.lit("?v=1.zip"))).alias("type"), text.is_web_address(F.col("url")).alias("web"), text.is_web_address(F.col("sha256")).alias("digest_web"), text.is_colour(colour).alias("colour"), text.is_data_address(F.concat(F.lit("data:text/plain;base64,"), F.col("sha256"))).alias("data"))


def period_labels(spark: SparkSession, d: str) -> DataFrame:
    """What kinds of periods are called."""
    return table(spark, d, "study_period").groupBy("period_kind", text.label(F.col("period_kind"), "period").alias("label")).agg(F.count("*").alias("periods"))


def scopes(spark: SparkSession, d: str) -> DataFrame:
    """Under which key each listed group's materials are kept (F27, S21), with the number of its code (O13) and its course read from a text."""
    g = table(spark, d, "roster").where("group_code IS NOT NULL")
    course = text.course_number(F.concat(F.lit("курс "), F.col("course").cast("string"), F.lit(", группа "), "group_code"))
    return g.select("roster_id", text.material_scope(F.col("program_code"), F.col("course"), F.concat(F.lit(" "), "group_code")).alias("scope"), text.group_number(F.col("group_code")).alias("number"), course.alias("course_read")).distinct()


def two_clocks(spark: SparkSession, d: str) -> DataFrame:
    """Of two clocks in a row the one for the lesson's place."""
    e = table(spark, d, "schedule_event")
    clocks = F.concat_ws(" ", F.concat_ws("-", "start_time", "end_time"), F.lit("9:20-10:55"))
    return e.select("event_id", clock_for_place(clocks, F.col("location_text"), "озёрн").alias("clock")).distinct()


def repaired_words(spark: SparkSession, d: str) -> DataFrame:
    """Subjects with words broken by a blank made whole (F13), and places without the signature at the foot of a page."""
    r = table(spark, d, "manual_rule").where("subject IS NOT NULL")
    broken = F.regexp_replace("subject", "^(.{3})(.*)$", "$1 $2")
    fixed = repaired(broken, {"не врология": "Неврология", "Хир ургия": "Хирургия", "Нев рология": "Неврология", "Анатом ия": "Анатомия", "Ана томия": "Анатомия"})
    footer = F.concat("location_text", F.lit(" , Заведующий  отделом организации учебного процесса ___ 2026 г."))
    return r.select("rule_id", fixed.alias("subject"), text.without_footer(footer).alias("place"))


QUERIES = {f.__name__: f for f in (written_days, written_clocks, wall_times, day_spans, views, block_days, holidays_left_out, remaining, official_instants, subject_colours, meanings, logged_texts, resources, period_labels, scopes, two_clocks, repaired_words)}

_DAY = lambda c: f"strftime({c}, '%-d.%-m.%Y')"
_MIN = lambda c: f"(CAST(substr({c}, 1, 2) AS INT) * 60 + CAST(substr({c}, 4, 2) AS INT))"
_WIDE = "".join(chr(0xFF01 + k) for k in range(94)) + " "
_NARROW = "".join(chr(0x21 + k) for k in range(94)).replace("'", "''") + " "
ORACLE = {
    "written_days": """
SELECT period_id, CASE WHEN period_id % 3 = 2 THEN NULL ELSE from_date END AS day, CASE WHEN to_date IS NULL THEN NULL ELSE from_date END AS range_from, CASE WHEN from_date IS NULL THEN NULL ELSE to_date END AS range_to FROM study_period""",
    "written_clocks": """
SELECT raw_id, CASE WHEN raw_id % 4 = 2 THEN end_time ELSE start_time END AS first_clock, CASE WHEN raw_id % 4 <= 1 AND start_time < end_time THEN start_time END AS range_start, CASE WHEN raw_id % 4 <= 1 AND start_time < end_time THEN end_time END AS range_end FROM raw_event""",
    "wall_times": """
WITH x AS (SELECT event_id, ts AS wall, TIMESTAMP '2026-10-25 00:00:00' + to_microseconds(epoch_us(ts) % 21600000000) AS autumn FROM events)
SELECT event_id, strftime(timezone('UTC', timezone('Europe/Zurich', wall)), '%Y-%m-%d %H:%M:%S') AS instant, strftime(timezone('Europe/Zurich', timezone('Europe/Zurich', wall)), '%Y-%m-%d %H:%M:%S') AS wall, strftime(timezone('UTC', timezone('Europe/Zurich', autumn)), '%Y-%m-%d %H:%M:%S') AS autumn_instant FROM x""",
    "day_spans": """
WITH x AS (SELECT period_id, from_date AS a, CAST(to_date + 1 AS DATE) AS z, GREATEST(0, (to_date - from_date) * 1440 + 180) AS minutes FROM study_period WHERE from_date IS NOT NULL AND to_date IS NOT NULL)
SELECT period_id, CAST(CASE WHEN a > z THEN 0 ELSE LEAST(z - a + 1, 370) END AS INT) AS days, CASE WHEN a <= z THEN a END AS first_day, CASE WHEN a <= z THEN LEAST(z, CAST(a + 369 AS DATE)) END AS last_day, minutes FROM x""",
    "views": """
WITH e AS (SELECT DISTINCT event_date AS v FROM schedule_event WHERE event_date IS NOT NULL), m AS (SELECT v, date_trunc('week', date_trunc('month', v))::DATE AS a, CAST(date_trunc('week', last_day(v))::DATE + 6 AS DATE) AS z FROM e)
SELECT v AS event_date, CAST(z - a + 1 AS INT) AS month_days, a AS month_from, CAST(date_trunc('week', v)::DATE + 5 AS DATE) AS work_to, 7 AS week_days,
  ['понедельник', 'вторник', 'среда', 'четверг', 'пятница', 'суббота', 'воскресенье'][isodow(v)] || ', ' || day(v) || ' ' || ['января', 'февраля', 'марта', 'апреля', 'мая', 'июня', 'июля', 'августа', 'сентября', 'октября', 'ноября', 'декабря'][month(v)] AS words,
  CAST(CASE WHEN month(v) >= 7 THEN year(v) ELSE year(v) - 1 END AS INT) AS year, CAST(CASE WHEN month(v) >= 7 THEN year(v) + 1 ELSE year(v) END AS INT) AS next_year FROM m""",
    "block_days": """
SELECT DISTINCT calendar_code, week_number, from_date, to_date, CAST(from_date + CAST(n AS INT) AS DATE) AS day FROM (SELECT *, unnest([week_number % 9, 2]) AS n FROM academic_week) WHERE n BETWEEN 0 AND 6""",
    "holidays_left_out": """
SELECT DISTINCT from_date, to_date, CAST(isodow(x) - 1 AS INT) AS weekday, x AS day FROM (SELECT from_date, to_date, CAST(from_date + CAST(n AS INT) AS DATE) AS x FROM academic_week, range(0, 7) t(n) WHERE from_date <= to_date) WHERE x <= to_date AND x NOT IN (DATE '2026-11-04', DATE '2027-01-07')""",
    "remaining": f"""
WITH x AS (SELECT DISTINCT event_id, (event_date - DATE '2026-11-16') * 1440 + {_MIN("start_time")} AS m FROM schedule_event WHERE event_date >= DATE '2026-11-16')
SELECT event_id, CASE WHEN m >= 1440 THEN (m // 1440) || ' д ' || (m % 1440 // 60) || ' ч' WHEN m >= 60 THEN (m // 60) || ' ч ' || (m % 60) || ' мин' ELSE m || ' мин' END AS countdown FROM x""",
    "official_instants": f"""
SELECT DISTINCT event_id, CAST(event_date AS TIMESTAMP) + to_minutes({_MIN("start_time")} - 180) AS start_at, CAST(event_date AS TIMESTAMP) + to_minutes({_MIN("end_time")} - 180) AS end_at FROM schedule_event WHERE event_date IS NOT NULL""",
    "subject_colours": f"""
WITH k AS (SELECT DISTINCT subject, substr(trim(regexp_replace(lower(replace(translate(nfc_normalize(subject), '{_WIDE}', '{_NARROW}'), '№', 'No')), '\\s+', ' ', 'g')), 1, 180) AS colour_key FROM manual_rule WHERE subject IS NOT NULL)
SELECT subject, colour_key, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(colour_key, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) % 8 AS INT) AS colour FROM k""",
    "meanings": """
SELECT raw_id, trim(regexp_replace(replace(lower(subject), 'ё', 'е'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS meaning, raw_id % 5 = 0 AND subject IS NOT NULL AS org FROM raw_event""",
    "logged_texts": """
SELECT doc_id, substr(regexp_replace(regexp_replace(concat_ws(' ', source_url, 'token = ' || doc_id, text), 'https?://[^\\s\\x0b]+', '[url]', 'gi'), '(token|secret|password|key|auth)[\\s\\x0b]*[=:][\\s\\x0b]*[^\\s\\x0b]+', '\\1=[redacted]', 'gi'), 1, 500) AS line FROM documents""",
    "resources": """
WITH s AS (SELECT DISTINCT url, sha256, regexp_extract(lower(url), '[.]([a-z]+)$', 1) AS e FROM source_provenance)
SELECT url, CASE WHEN e IN ('pdf', 'zip') THEN e WHEN e IN ('doc', 'docx') THEN 'docx' WHEN e IN ('xls', 'xlsx') THEN 'xlsx' WHEN e IN ('ppt', 'pptx') THEN 'pptx' WHEN e IN ('jpg', 'jpeg', 'png') THEN 'image' ELSE 'link' END AS type,
  starts_with(lower(url), 'http') AS web, FALSE AS digest_web, COALESCE(regexp_full_match(lower(sha256[1:6]), '[0-9a-f]{6}'), FALSE) AS colour, COALESCE(regexp_full_match(lower(sha256), '[a-z0-9+/=]+'), FALSE) AS data FROM s""",
    "period_labels": """
SELECT period_kind, COALESCE(map {'study': 'Обучение', 'assessment': 'Аттестация', 'practice': 'Практика', 'vacation': 'Каникулы', 'session': 'Сессия'}[period_kind], 'Учебный период') AS label, count(*) AS periods FROM study_period GROUP BY ALL""",
    "scopes": """
SELECT DISTINCT roster_id, program_code || ':' || course || ':' || lower(trim(group_code)) AS scope, TRY_CAST(CASE WHEN regexp_full_match(group_code, '[0-9]+') THEN group_code END AS INT) AS number, course AS course_read FROM roster WHERE group_code IS NOT NULL""",
    "two_clocks": """
SELECT DISTINCT event_id, CASE WHEN contains(lower(location_text), 'озёрн') THEN start_time || '-' || end_time ELSE '9:20-10:55' END AS clock FROM schedule_event""",
    "repaired_words": """
WITH b AS (SELECT rule_id, CASE WHEN length(subject) >= 3 AND NOT contains(subject, chr(10)) THEN substr(subject, 1, 3) || ' ' || substr(subject, 4) ELSE subject END AS s, location_text FROM manual_rule WHERE subject IS NOT NULL)
SELECT rule_id, regexp_replace(regexp_replace(regexp_replace(s, 'хир ургия', 'Хирургия', 'gi'), 'нев рология', 'Неврология', 'gi'), 'ана томия', 'Анатомия', 'gi') AS subject,
  trim(regexp_replace(trim(regexp_replace(replace(location_text, chr(160), ' '), '\\s+', ' ', 'g')), '\\s*,\\s*', ', ', 'g'), ' ,/;') AS place FROM b""",
}
