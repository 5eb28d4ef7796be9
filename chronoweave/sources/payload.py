"""Published timetables as JSON: courses, their groups and events, nested as they are delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.clock import render_minutes
from chronoweave.functions.temporal import lesson_parts, read_clock_range, read_date
from chronoweave.functions.text import clean_location, clean_subject, clean_teacher, course_number, group_list, half_code, lesson_kind, short_id, stream_code

_TEXT = T.StringType()
_EVENT = T.StructType(
    [T.StructField(n, _TEXT) for n in ("id", "program", "date", "dateHint", "weekDate", "start", "end", "time", "subject", "discipline", "name", "location", "teacher", "type", "half", "group", "stream", "sourceUrl", "scheduleMode")]
    + [T.StructField("groups", T.ArrayType(_TEXT)), T.StructField("weekNumber", T.IntegerType()), T.StructField("weekday", T.IntegerType()), T.StructField("mergedConsecutive", T.BooleanType()), T.StructField("orgMerged", T.BooleanType())]
)
_COURSE = T.StructType([T.StructField("specialty", _TEXT), T.StructField("groups", T.ArrayType(_TEXT)), T.StructField("streams", T.MapType(_TEXT, T.ArrayType(_TEXT))), T.StructField("events", T.ArrayType(_EVENT))])
#: The shape of a payload; fields that aren't named here are not read.
PAYLOAD = T.StructType([T.StructField("schemaVersion", T.IntegerType()), T.StructField("generatedAt", _TEXT), T.StructField("specialty", _TEXT), T.StructField("courses", T.MapType(_TEXT, _COURSE))])


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payloads with an explicit schema, one per file; broken files give nulls."""
    return spark.read.schema(PAYLOAD).json(path, multiLine=True)


def payload_issues(payloads: DataFrame) -> DataFrame:
    """What is wrong with the envelopes: ``level`` (error, warning) and ``issue``."""
    rule = lambda level, text, bad: F.when(bad, F.struct(F.lit(level).alias("level"), F.lit(text).alias("issue")))
    strange = F.exists(F.map_keys(F.coalesce("courses", F.create_map().cast(PAYLOAD["courses"].dataType))), lambda k: course_number(k).isNull())
    found = F.array_compact(F.array(
        rule("error", "no schemaVersion", F.col("schemaVersion").isNull()), rule("error", "no generatedAt", F.col("generatedAt").isNull()),
        rule("error", "no courses", F.col("courses").isNull()), rule("warning", "strange course", strange),
    ))
    return payloads.select(F.explode(found).alias("i")).select("i.*")


def payload_events(payloads: DataFrame) -> DataFrame:
    """The normalized dated events of payloads, one row per group, day and lesson of a double block.

    Aliases are coalesced (date, dateHint, weekDate; subject, discipline, name; groups, group), lists of groups spread, an
    event without a group but with a stream is for everybody of it. Events without a day, a clock range or a subject give no
    row: no day is ever made up.
    """
    course = payloads.select("specialty", F.explode("courses").alias("key", "c")).select(course_number(F.col("key")).alias("course"), F.coalesce("c.specialty", "specialty").alias("specialty"), F.explode("c.events").alias("e"))
    day = F.coalesce(*[read_date(F.col(f"e.{n}")) for n in ("date", "dateHint", "weekDate")])
    times = F.coalesce(read_clock_range(F.concat_ws(" ", "e.start", "e.end")), read_clock_range(F.col("e.time")))
    listed = F.when(F.size(F.coalesce("e.groups", F.array().cast("array<string>"))) > 0, F.array_join("e.groups", ",")).otherwise(F.col("e.group"))
    groups, stream = group_list(listed), stream_code(F.col("e.stream"))
    groups = F.when(F.size(groups) > 0, groups).when(F.upper(F.trim(listed)) == "ALL", F.array(F.lit("ALL"))).when(stream.isNotNull(), F.array(F.lit("ALL"))).otherwise(groups)
    subject = clean_subject(F.coalesce("e.subject", "e.discipline", "e.name"))
    whole = F.coalesce(F.col("e.mergedConsecutive"), F.lit(False)) | F.coalesce(F.col("e.orgMerged"), F.lit(False))
    rows = course.select(
        F.col("e.id").alias("raw_id"), F.coalesce("e.program", "specialty").alias("program_code"), "course", day.alias("event_date"), times.alias("t"), groups.alias("g"), stream.alias("stream_code"),
        subject.alias("subject"), clean_location(F.col("e.location")).alias("location_text"), clean_teacher(F.col("e.teacher")).alias("teacher"), lesson_kind(F.col("e.type"), subject).alias("lesson_type"),
        half_code(F.col("e.half")).alias("half"), F.col("e.sourceUrl").alias("source_url"), whole.alias("whole"),
    )
    rows = rows.where("course IS NOT NULL AND event_date IS NOT NULL AND t IS NOT NULL AND subject <> ''").withColumn("group_code", F.explode("g"))
    minutes = lambda c: F.substring(c, 1, 2).cast("int") * 60 + F.substring(c, 4, 2).cast("int")
    rows = rows.withColumn("p", F.explode(lesson_parts(minutes(F.col("t.start_time")), minutes(F.col("t.end_time")), F.col("whole"))))
    event_id = F.concat_ws("-", F.coalesce("raw_id", short_id(F.col("subject"), F.col("t.start_time"))), F.col("event_date").cast("string"), "group_code", F.coalesce(F.col("p.part"), F.lit(0)).cast("string"))
    return rows.select(
        event_id.alias("event_id"), "program_code", "course", "group_code", "stream_code", "event_date", render_minutes(F.col("p.start")).alias("start_time"), render_minutes(F.col("p.end")).alias("end_time"),
        "subject", "location_text", "teacher", "lesson_type", "half", F.col("p.part").alias("double_part"), "source_url",
    )


def weekly_blocks(payloads: DataFrame) -> DataFrame:
    """The blocks known only by academic week: never with a day or weekday."""
    course = payloads.select("specialty", F.explode("courses").alias("key", "c")).select(course_number(F.col("key")).alias("course"), F.coalesce("c.specialty", "specialty").alias("program_code"), F.explode("c.events").alias("e"))
    times = F.coalesce(read_clock_range(F.concat_ws(" ", "e.start", "e.end")), read_clock_range(F.col("e.time")))
    rows = course.where("e.scheduleMode = 'weekly-block' AND e.weekNumber BETWEEN 1 AND 52").withColumn("t", times)
    rows = rows.withColumn("subject", clean_subject(F.coalesce("e.subject", "e.discipline", "e.name"))).where("t IS NOT NULL AND subject <> ''")
    return rows.select("program_code", "course", F.explode(group_list(F.col("e.group"))).alias("group_code"), stream_code(F.col("e.stream")).alias("stream_code"), F.col("e.weekNumber").alias("week_number"), "t.start_time", "t.end_time", "subject", clean_location(F.col("e.location")).alias("location_text"))


def snapshot_part(spark: SparkSession, path: str, program: str, course: int) -> DataFrame:
    """One program's course of a snapshot kept by (program_code, course): only its folder is read."""
    return spark.read.parquet(path).where((F.col("program_code") == program) & (F.col("course") == course))
