"""Repeating events: their occurrences, and changes to a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.temporal import instant_to_local, local_to_instant
from chronoweave.operators.orders import by_instant

#: Without an end a series goes on for so many days; no series has more occurrences than MOST.
HORIZON, MOST = 730, 2000


def occurrence_days(first: Column, frequency: Column, interval: Column, weekdays: Column, until: Column) -> Column:
    """The days of a series, in order.

    ``daily`` and ``weekly`` count whole intervals from the first day; a week of the series begins on the first day's
    weekday; ``weekdays`` (0 is Sunday) default to the first day's, and the first day itself is left out if its weekday isn't
    among them. ``monthly`` and ``yearly`` step month by month and year by year with the day cut to the month's length, and
    keep the cut day from then on: so a series on the 31st ends before the first shorter month, one on February 29th before
    the first other year. Without a frequency there is the first day only.
    """
    last = F.coalesce(until, F.date_add(first, HORIZON))
    step = F.greatest(F.coalesce(interval, F.lit(1)), F.lit(1))
    span = F.greatest(F.datediff(last, first), F.lit(-1))
    add = lambda k: F.date_add(first, k)
    daily = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(span, F.lit(0)), step), lambda k: k <= span), add)
    # A week of the series begins on the first day's weekday: weekdays are offsets from it.
    begins = F.dayofweek(first) - 1
    wanted = F.when(F.size(F.coalesce(weekdays, F.array().cast("array<int>"))) > 0, weekdays).otherwise(F.array(begins.cast("int")))
    offsets = F.array_sort(F.array_distinct(F.transform(F.filter(wanted, lambda w: w.between(0, 6)), lambda w: F.pmod(w - begins, F.lit(7)))))
    weeks = F.sequence(F.lit(0), F.greatest(F.floor(span / 7), F.lit(0)).cast("int"), step)
    weekly = F.transform(F.filter(F.flatten(F.transform(weeks, lambda w: F.transform(offsets, lambda o: (w * 7 + o).cast("int")))), lambda k: k <= span), add)

    def by_months(size: int) -> Column:
        counts = F.sequence(F.lit(0), F.greatest(F.floor(F.months_between(last, first) / size), F.lit(0)).cast("int"))
        days = F.transform(counts, lambda k: F.struct(k.alias("k"), F.add_months(first, k * size).alias("day")))
        # Up to the first step on which the day had to be cut.
        cut = F.coalesce(F.array_min(F.transform(F.filter(days, lambda d: F.dayofmonth(d["day"]) != F.dayofmonth(first)), lambda d: d["k"])), F.lit(2**31 - 1))
        kept = F.filter(days, lambda d: (d["k"] < cut) & (d["k"] % step == 0) & (d["day"] <= last))
        return F.transform(kept, lambda d: d["day"])

    days = F.when(frequency == "daily", daily).when(frequency == "weekly", weekly).when(frequency == "monthly", by_months(1)).when(frequency == "yearly", by_months(12)).otherwise(F.array(first))
    return F.slice(days, 1, MOST)


def expand(series: DataFrame) -> DataFrame:
    """The occurrences of each series: its columns, ``occurrence_index``, and ``start_at`` and ``end_at`` of the occurrence.

    ``series`` has start_at and end_at (UTC), time_zone, frequency, repeat_interval, weekdays, until_date. The wall time of the
    start stays the same through changes of the clock, and so does the duration. A series without days gives no rows.
    """
    local = instant_to_local(F.col("start_at"), F.col("time_zone"))
    first = local.cast("date")
    seconds = F.unix_micros(F.col("end_at")) - F.unix_micros(F.col("start_at"))
    clock = F.unix_micros(local) - F.unix_micros(F.date_trunc("day", local))
    days = occurrence_days(F.col("__first"), F.col("frequency"), F.col("repeat_interval"), F.col("weekdays"), F.col("until_date"))
    placed = series.select("*", first.alias("__first"), clock.alias("__clock"), seconds.alias("__long"))
    rows = placed.select("*", F.posexplode(days).alias("occurrence_index", "__day"))
    wall = F.timestamp_micros(F.unix_micros(F.col("__day").cast("timestamp")) + F.col("__clock"))
    start = local_to_instant(wall, F.col("time_zone"))
    rows = rows.withColumn("__start", start)
    end = F.timestamp_micros(F.unix_micros("__start") + F.col("__long"))
    return rows.select(*[c for c in series.columns if c not in ("start_at", "end_at")], "occurrence_index", F.col("__start").alias("start_at"), end.alias("end_at"))


def drop_occurrences(rows: DataFrame, series_id: str, index: int, scope: str) -> DataFrame:
    """The rows without an occurrence (``single``), it and all later ones (``following``), or the whole series (``series``)."""
    mine = F.col("series_id").eqNullSafe(F.lit(series_id))
    hit = {"single": mine & (F.col("occurrence_index") == index), "following": mine & (F.col("occurrence_index") >= index), "series": mine}[scope]
    return rows.where(~F.coalesce(hit, F.lit(False)))


def change_occurrences(rows: DataFrame, series_id: str, index: int, scope: str, new: DataFrame) -> DataFrame:
    """The rows with an occurrence, the following ones or the whole series replaced by ``new`` (copy on write)."""
    return drop_occurrences(rows, series_id, index, scope).unionByName(new)


def change_series(rows: DataFrame, changes: DataFrame, owner: str = "owner_id") -> DataFrame:
    """Many changes to many series at once (L2, L3). ``rows``: ``owner``, series_id, occurrence_index, frequency and any columns.
    ``changes``: ``owner``, series_id, at_index, scope (``single``, ``following``, ``series``), new_series_id, and ``delete``.

    Of each change the rows it hits go, if it deletes; else a single occurrence stays in its series and loses its recurrence, and
    following ones or the whole series go over to ``new_series_id`` and are numbered from 0. Rows of another owner are never
    hit; a series may have one change. Rows without a series are no part of any.
    """
    keys = changes.select(F.col(owner).alias("__o"), F.col("series_id").alias("__s"), "at_index", "scope", "new_series_id", "delete")
    met = rows.join(keys, (F.col(owner) == F.col("__o")) & (F.col("series_id") == F.col("__s")), "left")
    at = F.col("occurrence_index")
    hit = F.when(F.col("scope") == "single", at == F.col("at_index")).when(F.col("scope") == "following", at >= F.col("at_index")).otherwise(F.col("scope") == "series")
    hit = F.coalesce(hit, F.lit(False))
    moved = hit & (F.col("scope") != "single")
    new = {
        "series_id": F.when(moved, F.col("new_series_id")).otherwise(F.col("series_id")),
        "occurrence_index": F.when(moved & (F.col("scope") == "following"), at - F.col("at_index")).otherwise(at),
        "frequency": F.when(hit & (F.col("scope") == "single"), F.lit(None).cast("string")).otherwise(F.col("frequency")),
    }
    kept = met.where(~(hit & F.coalesce("delete", F.lit(False))))
    return kept.select(*[new[c].cast(rows.schema[c].dataType).alias(c) if c in new else F.col(c) for c in rows.columns])


# What events may be, how they may repeat, and how long their texts may be.
STATUSES, PRIVACY, FREQUENCIES = ("planned", "confirmed", "in_progress", "completed", "cancelled"), ("public", "private"), ("daily", "weekly", "monthly", "yearly")
LENGTHS = {"description": 10_000, "category": 80, "location": 500, "meeting_url": 1000}
MOST_ATTENDEES = 100
_INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:[zZ]|[+-]\d{2}:?\d{2})$"


def read_instant(text: Column) -> Column:
    """The instant of an ISO text with a zone; null for anything else."""
    colon = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(text.rlike(_INSTANT), F.try_to_timestamp(colon))


def payload_issues(payloads: DataFrame, row_id: str, zones: Sequence[str] | None = None, statuses: Sequence[str] = STATUSES) -> DataFrame:
    """What is wrong with events handed in (L6): ``row_id``, ``issue``. Columns: title, start_at and end_at (ISO texts with a zone),
    time_zone, status, privacy, frequency, repeat_interval, until_date (text). A null status, privacy or zone stands for the default."""
    start, end = read_instant(F.col("start_at")), read_instant(F.col("end_at"))
    repeats = F.col("frequency").isNotNull()
    rules = {
        "no title": F.coalesce(F.trim("title"), F.lit("")) == "",
        "no instant": start.isNull() | end.isNull(),
        "ends before it starts": end <= start,
        "unknown frequency": repeats & ~F.col("frequency").isin(*FREQUENCIES),
        "strange interval": repeats & ~F.coalesce("repeat_interval", F.lit(1)).between(1, 31),
        "strange end of the series": repeats & F.col("until_date").isNotNull() & F.try_to_date("until_date", "yyyy-MM-dd").isNull(),
        "unknown status": ~F.coalesce("status", F.lit("planned")).isin(*statuses),
        "unknown privacy": ~F.coalesce("privacy", F.lit("private")).isin(*PRIVACY),
    }
    if zones is not None:
        rules["unknown zone"] = ~F.coalesce("time_zone", F.lit("UTC")).isin(*zones)
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return payloads.select(F.col(row_id), F.explode(found).alias("issue"))


def normal_payloads(payloads: DataFrame) -> DataFrame:
    """Events handed in with trimmed and shortened texts, instants, and defaults for what isn't given; wrong ones are to be left out before."""
    text = lambda c, most: F.substring(F.trim(F.coalesce(F.col(c), F.lit(""))), 1, most)
    guests = F.slice(F.filter(F.transform(F.coalesce("attendees", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), 1, MOST_ATTENDEES)
    new = {"title": F.trim("title"), "start_at": read_instant(F.col("start_at")), "end_at": read_instant(F.col("end_at")), "attendees": guests}
    new |= {c: text(c, most) for c, most in LENGTHS.items()} | {c: F.coalesce(F.col(c), F.lit(v)) for c, v in (("status", "planned"), ("privacy", "private"), ("time_zone", "UTC"))}
    new["category"] = F.coalesce(F.nullif(new["category"], F.lit("")), F.lit("personal"))
    return payloads.select(*[new[c].alias(c) if c in new else F.col(c) for c in payloads.columns])


def in_range(rows: DataFrame, owner: str, start: str, end: str, status: str | None = None, category: str | None = None) -> DataFrame:
    """An owner's events that end after ``start`` and begin before ``end`` (instants with a zone), in order of start and title (O2)."""
    a, z = F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
    found = rows.where((F.col("owner_id") == owner) & (F.col("end_at") > a) & (F.col("start_at") < z))
    for column, wanted in (("status", status), ("category", category)):
        if wanted is not None:
            found = found.where(F.col(column) == wanted)
    return found.orderBy(*by_instant())
