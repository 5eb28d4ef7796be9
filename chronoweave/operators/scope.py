"""Whom an event concerns, and the agenda of a group's week."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.text import group_code, is_everybody, mentions


def applies(event_group: Column, event_stream: Column, group: Column, stream: Column) -> Column:
    """Whether an event of a group (or of everybody) concerns a group: the codes are equal or the event is for everybody,
    and the streams don't differ where both are known."""
    streams = event_stream.isNull() | stream.isNull() | (event_stream == stream)
    return (is_everybody(event_group) | (group_code(event_group) == group_code(group))) & streams


def in_scope(events: DataFrame, program: str, course: int, group: str, stream: str | None = None) -> DataFrame:
    """The events that concern one group. Events with a null group concern nobody."""
    mine = (F.col("program_code") == program) & (F.col("course") == course)
    return events.where(mine & applies(F.col("group_code"), F.col("stream_code"), F.lit(group), F.lit(stream).cast("string")))


def scope_join(events: DataFrame, groups: DataFrame) -> DataFrame:
    """Every event with every group it concerns; columns of ``groups`` (program_code, course, group_code, stream_code) come as
    ``to_group`` and ``to_stream``.

    The either-or condition would need a nested loop. It is rewritten as a union of two equi-joins: own events by (program,
    course, group), and events for everybody by (program, course), whose other side is one row per group.
    """
    to = groups.select(F.col("program_code").alias("__p"), F.col("course").alias("__c"), F.col("group_code").alias("to_group"), F.col("stream_code").alias("to_stream"), group_code(F.col("group_code")).alias("__g")).distinct()
    place = (F.col("program_code") == F.col("__p")) & (F.col("course") == F.col("__c"))
    streams = F.col("stream_code").isNull() | F.col("to_stream").isNull() | (F.col("stream_code") == F.col("to_stream"))
    common = is_everybody(F.col("group_code"))
    own = events.where(~common).withColumn("__own", group_code(F.col("group_code"))).join(to, place & (F.col("__own") == F.col("__g")) & streams).drop("__own")
    everybody = events.where(common).join(to, place & streams)
    return own.unionByName(everybody).drop("__p", "__c", "__g")


def agenda_week(events: DataFrame, program: str, course: int, group: str, stream: str | None, monday: dt.date, kind: str = "all", search: str = "") -> DataFrame:
    """A group's events from Monday to Sunday, of one kind or all, that mention the search text, in order of day, start and
    subject (Russian alphabet)."""
    days = F.col("event_date").between(F.lit(monday), F.date_add(F.lit(monday), 6))
    found = in_scope(events, program, course, group, stream).where(days)
    if kind != "all":
        found = found.where(F.col("lesson_type") == kind)
    found = found.where(mentions(search, *[F.col(c) for c in ("subject", "location_text", "teacher", "stream_code", "weeks_spec")]))
    return found.orderBy("event_date", "start_time", F.collate("subject", "ru"), "event_id")


def by_day(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The events of each day (and key ``by``, whose events of one day are in one row) as an ordered array of ids."""
    item = F.struct("start_time", "event_id")
    return events.where("event_date IS NOT NULL").groupBy(*by, "event_date").agg(F.transform(F.array_sort(F.collect_set(item)), lambda x: x["event_id"]).alias("event_ids"))


def unscoped_in_scope(events: DataFrame, group: str, stream: str | None) -> DataFrame:
    """The older rule (P18): an event without a group concerns everybody only if its ``audience`` is ALL; else its group must be the
    viewer's. Streams must not differ where both are known."""
    nobody = F.coalesce(F.trim("group_code"), F.lit("")) == ""
    mine = (nobody & (F.col("audience") == "ALL")) | (~nobody & applies(F.col("group_code"), F.lit(None).cast("string"), F.lit(group), F.lit(None).cast("string")))
    streams = F.col("stream_code").isNull() | F.lit(stream is None) | (F.col("stream_code") == F.lit(stream))
    return events.where(F.coalesce(mine, F.lit(False)) & streams)


def with_defaults(events: DataFrame, status: str = "all", category: str = "all") -> DataFrame:
    """Events of a status and a category; those without count as planned and personal (P5)."""
    out = events
    for column, wanted, default in (("status", status, "planned"), ("category", category, "personal")):
        if wanted != "all":
            out = out.where(F.coalesce(F.col(column), F.lit(default)) == wanted)
    return out


def complete_rows(rows: DataFrame, required: Sequence[str], program: str | None = None, course: int | None = None) -> DataFrame:
    """Rows that have something in every required column and, if asked, are of a program's course."""
    out = rows.where(" AND ".join(f"coalesce(trim(CAST(`{c}` AS STRING)), '') <> ''" for c in required))
    return out if program is None else out.where((F.col("program_code") == program) & (F.col("course") == course))


def both_kinds(official: DataFrame, personal: DataFrame) -> DataFrame:
    """Official and personal events in one table, with ``kind`` (schedule, personal) and ``read_only``; columns that one of them
    hasn't are null (U9). Every row of both stays."""
    mark = lambda df, kind: df.withColumns({"kind": F.lit(kind), "read_only": F.lit(kind == "schedule")})
    return mark(official, "schedule").unionByName(mark(personal, "personal"), allowMissingColumns=True)
