"""The orders in which events and tasks are listed, as columns for ``orderBy``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def russian(c: str) -> Column:
    """Texts in the order of the Russian alphabet."""
    return F.collate(c, "ru")


def by_date(day: str = "event_date", start: str = "start_time", subject: str = "subject") -> list[Column]:
    """Day, start, subject in Russian order (O1)."""
    return [F.col(day), F.col(start), russian(subject)]


def by_instant(start: str = "start_at", title: str = "title") -> list[Column]:
    """Start, title in Russian order (O2)."""
    return [F.col(start), russian(title)]


def by_week(week: str = "week_number", start: str = "start_time", subject: str = "subject") -> list[Column]:
    """Week, start, subject in Russian order (O3)."""
    return [F.col(week), F.col(start), russian(subject)]


def by_week_and_group(week: str = "week_number", weekday: str = "weekday", start: str = "start_time", group: str = "group_code", subject: str = "subject") -> list[Column]:
    """Week, weekday, start, group, subject by code points (O4): no week and week 0 count as 999, no weekday as 99, other nulls as empty."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [F.coalesce(F.nullif(F.col(week), F.lit(0)), F.lit(999)), F.coalesce(F.col(weekday), F.lit(99)), empty(start), empty(group), empty(subject)]


def by_date_and_group(day: str = "event_date", start: str = "start_time", group: str = "group_code", subject: str = "subject") -> list[Column]:
    """Day, start, group, subject by code points."""
    return [F.col(c) for c in (day, start, group, subject)]


def by_due(due: str = "due", created: str = "created_at") -> list[Column]:
    """Tasks: those due first, those without a deadline last, then the newest."""
    return [F.asc_nulls_last(due), F.desc(created)]
