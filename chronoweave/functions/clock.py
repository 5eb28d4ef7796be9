"""Clocks as written by people, and minutes or seconds of the day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ``H:MM``, ``HH.MM`` and ``HH:MM:SS`` up to 23:59:59, with blanks around them.
CLOCK = r"^\s*(?:[01]?\d|2[0-3])[:.][0-5]\d(?:[:.][0-5]\d)?\s*$"
_BLANKS = " \t\n\u000b\f\r"


def seconds_of_day(text: Column) -> Column:
    """Seconds since midnight of a written clock; null where it isn't one (or lies past 23:59:59).

    One pattern decides; the parts are then cut out without patterns, as clocks are read for every row of the largest tables.
    """
    plain = F.translate(F.trim(text, F.lit(_BLANKS)), ".", ":")
    hour = F.substring_index(plain, ":", 1).cast("int")
    minute = F.substring_index(F.substring_index(plain, ":", 2), ":", -1).cast("int")
    second = F.when(F.length(plain) > 5, F.substring_index(plain, ":", -1).cast("int")).otherwise(0)
    return F.when(text.rlike(CLOCK), hour * 3600 + minute * 60 + second)


def minutes_of_day(text: Column) -> Column:
    """Minutes since midnight of a written clock, seconds dropped."""
    return F.floor(seconds_of_day(text) / 60).cast("int")


def clock_identity(text: Column) -> Column:
    """A value equal for two clocks exactly if they show the same time of day.

    Text that is no clock stays itself (trimmed), so that two different broken clocks differ.
    """
    return F.coalesce(seconds_of_day(text).cast("string"), F.concat(F.lit("?"), F.trim(text)))


def render_minutes(minutes: Column) -> Column:
    """``HH:MM`` of minutes since midnight."""
    return F.concat(F.lpad((minutes / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("int").cast("string"), 2, "0"))
