"""Dates, academic weeks, clocks and instants."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoweave.functions.clock import render_minutes
from chronoweave.functions.text import clean_text

#: The Monday that academic week 1 is counted from where no week table says otherwise.
ANCHOR = dt.date(2026, 8, 31)
_ISO, _DOTTED = r"^\d{4}-\d{2}-\d{2}$", r"^\d{1,2}\.\d{1,2}\.\d{4}$"
# Block lengths in minutes that are two lessons with a break, and that break.
DOUBLE, BREAK = (185, 205), 15


def _hyphens(text: Column) -> Column:
    return F.regexp_replace(clean_text(text), "[–—−]", "-")


def read_date(text: Column) -> Column:
    """The date of ``YYYY-MM-DD`` or ``D.M.YYYY``; null for anything else and for days that don't exist."""
    plain = _hyphens(text)
    return F.when(plain.rlike(_ISO), F.try_to_date(plain, "yyyy-MM-dd")).when(plain.rlike(_DOTTED), F.try_to_date(plain, "d.M.yyyy"))


def read_date_range(text: Column) -> Column:
    """The first two dates of a text as struct ``from_date``, ``to_date``; null unless both exist."""
    found = F.regexp_extract_all(_hyphens(text), F.lit(r"\d{1,2}\.\d{1,2}\.\d{4}|\d{4}-\d{2}-\d{2}"), F.lit(0))
    a, b = (read_date(F.try_element_at(found, F.lit(k))) for k in (1, 2))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("from_date"), b.alias("to_date")))


def read_clock(text: Column) -> Column:
    """The first clock of a text as ``HH:MM``; null if there is none or it is past 23:59."""
    mark = r"(?:^|\D)(\d{1,2})\s*[:.]\s*(\d{2})"
    plain = clean_text(text)
    hour, minute = (F.nullif(F.regexp_extract(plain, mark, k), F.lit("")).cast("int") for k in (1, 2))
    return F.when((hour <= 23) & (minute <= 59), render_minutes(hour * 60 + minute))


def read_clock_range(text: Column) -> Column:
    """The first two clocks of a text as struct ``start_time``, ``end_time``. There must be a hyphen or ``до`` between two
    clocks, or a colon in one of the first two; the start must be before the end. Else null."""
    plain = _hyphens(text)
    mark = r"(\d{1,2})\s*([:.])\s*(\d{2})"
    hours, signs, minutes = (F.regexp_extract_all(plain, F.lit(mark), F.lit(k)) for k in (1, 2, 3))
    at = lambda xs, k: F.try_element_at(xs, F.lit(k))
    h1, h2, m1, m2 = at(hours, 1).cast("int"), at(hours, 2).cast("int"), at(minutes, 1).cast("int"), at(minutes, 2).cast("int")
    clear = plain.rlike(r"(?iu)\d{1,2}\s*[:.]\s*\d{2}\s*(?:-|до)\s*\d{1,2}\s*[:.]\s*\d{2}") | (at(signs, 1) == ":") | (at(signs, 2) == ":")
    a, b = h1 * 60 + m1, h2 * 60 + m2
    good = clear & (h1 <= 23) & (h2 <= 23) & (m1 <= 59) & (m2 <= 59) & (a < b)
    return F.when(good, F.struct(render_minutes(a).alias("start_time"), render_minutes(b).alias("end_time")))


def monday_of(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def week_number(day: Column, anchor: dt.date = ANCHOR) -> Column:
    """The academic week of a day, counted from the anchor's Monday; days before it get numbers below 1."""
    return (F.floor(F.datediff(monday_of(day), F.lit(anchor)) / 7) + 1).cast("int")


def monday_of_week(number: Column, anchor: dt.date = ANCHOR) -> Column:
    return F.date_add(F.lit(anchor), ((number - 1) * 7).cast("int"))


def day_in_week(week_from: Column, week_to: Column, weekday: Column, holidays: Sequence[dt.date] = ()) -> Column:
    """The day with a weekday (0 is Monday) in a week that may begin and end on any day; null if it lies outside or is a holiday."""
    day = F.date_add(week_from, F.pmod(weekday - F.weekday(week_from), F.lit(7)).cast("int"))
    free = day.isin(*holidays) if holidays else F.lit(False)
    return F.when(weekday.between(0, 6) & (day <= week_to) & ~free, day)


def matrix_days(week_from: Column, slots: Column) -> Column:
    """The days of a weekly block whose slots are read as offsets from the week's first day (T17): an option of its own, as weekly
    blocks have no days otherwise. Slots outside 0 to 6 are left out; without a week or slots the array is empty."""
    good = F.filter(F.coalesce(slots, F.array().cast("array<int>")), lambda n: n.between(0, 6))
    return F.coalesce(F.transform(good, lambda n: F.date_add(week_from, n)), F.array().cast("array<date>"))


def academic_year_of(month: Column, start_year: int = 2026) -> Column:
    """The calendar year of a month in the academic year that begins in autumn of ``start_year``."""
    return F.when(month >= 8, F.lit(start_year)).otherwise(F.lit(start_year + 1))


def local_to_instant(local: Column, zone: Column | str) -> Column:
    """The UTC instant of a wall time. In the repeated hour of autumn the later instant is taken; a wall time that the clock
    skips in spring goes forward by the change."""
    first = F.to_utc_timestamp(local, zone)
    after = [F.timestamp_micros(F.unix_micros(first) + m * 60_000_000) for m in (60, 30)]
    same = [F.when(F.from_utc_timestamp(x, zone) == local, x) for x in after]
    return F.coalesce(*same, first)


def instant_to_local(instant: Column, zone: Column | str) -> Column:
    """The wall time of a UTC instant."""
    return F.from_utc_timestamp(instant, zone)


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes from one instant to a later one, rounded; 0 if it isn't later."""
    seconds = F.unix_micros(end) / 1e6 - F.unix_micros(start) / 1e6
    return F.greatest(F.lit(0), F.round(seconds / 60)).cast("int")


def days_spanned(start: Column, end: Column, zone: Column | str, most: int = 370) -> Column:
    """The local days that an event touches, in order, at most ``most``; empty if it ends before it begins."""
    a, b = instant_to_local(start, zone).cast("date"), instant_to_local(end, zone).cast("date")
    return F.when(a <= b, F.slice(F.sequence(a, F.greatest(a, b)), 1, most)).otherwise(F.array().cast("array<date>"))


def view_days(day: Column, view: str) -> Column:
    """The days that a view shows: ``day``, ``workweek`` (Monday to Saturday), ``week``, or ``month`` filled up to whole weeks."""
    monday = monday_of(day)
    if view == "day":
        return F.array(day)
    if view in ("workweek", "week"):
        return F.sequence(monday, F.date_add(monday, 5 if view == "workweek" else 6))
    if view == "month":
        return F.sequence(monday_of(F.trunc(day, "month")), F.date_add(monday_of(F.last_day(day)), 6))
    raise ValueError(f"no such view: {view}")


def lesson_parts(start: Column, end: Column, whole: Column) -> Column:
    """The lessons of a block in minutes of the day, as an array of struct ``part``, ``start``, ``end``.

    A block of a double length that isn't to be kept ``whole`` has two equal lessons with a break between them, parts 1 and
    2; any other has one, part null.
    """
    slot = ((end - start - BREAK) / 2).cast("int")
    one = lambda part, a, b: F.struct(part.cast("int").alias("part"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    two = F.array(one(F.lit(1), start, start + slot), one(F.lit(2), start + slot + BREAK, end))
    return F.when((end - start).isin(*DOUBLE) & ~F.coalesce(whole, F.lit(False)), two).otherwise(F.array(one(F.lit(None), start, end)))


# Weekdays from Monday, and months as they stand after a day.
DAY_NAMES = ("понедельник", "вторник", "среда", "четверг", "пятница", "суббота", "воскресенье")
MONTH_NAMES = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")


def day_in_words(day: Column) -> Column:
    """A day as people read it: ``вторник, 6 октября`` (T22), whatever the locale of the machine."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), k)
    return F.concat(pick(DAY_NAMES, F.weekday(day) + 1), F.lit(", "), F.dayofmonth(day).cast("string"), F.lit(" "), pick(MONTH_NAMES, F.month(day)))


def accepted_year_starts(today: Column) -> Column:
    """The academic years whose documents are accepted on a day: the one that goes on (from July on) and the next."""
    start = F.year(today) - F.when(F.month(today) >= 7, 0).otherwise(1)
    return F.array(start, start + 1)


def countdown(minutes: Column) -> Column:
    """A remaining time in words: days and hours, hours and minutes, or minutes."""
    d, h, m = F.floor(minutes / 1440), F.floor(minutes % 1440 / 60), minutes % 60
    say = lambda *xs: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in xs])
    return F.when(minutes >= 1440, say(d, " д ", h, " ч")).when(minutes >= 60, say(h, " ч ", m, " мин")).otherwise(say(m, " мин"))
