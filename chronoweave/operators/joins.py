"""Joins of timetables: by calendar, by overlap of intervals, as of an instant, and patches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.temporal import day_in_week


def resolve_days(blocks: DataFrame, weeks: DataFrame, number: str = "week_number", weekday: str = "weekday", calendar: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Blocks known by academic week and weekday, with the day (``event_date``), and those that get none: no such week in the
    calendar (``weeks``: week_number, from_date, to_date), no weekday, or a day outside the week.

    ``calendar`` names the columns of both tables that tell calendars apart; without it there is one calendar. Of a week that
    is there twice the earlier one counts.
    """
    placed = _with_weeks(blocks, weeks, number, calendar).withColumn("event_date", day_in_week(F.col("__from"), F.col("__to"), F.col(weekday)))
    placed = placed.drop("__from", "__to")
    return placed.where("event_date IS NOT NULL"), placed.where("event_date IS NULL").drop("event_date")


def with_week_ranges(blocks: DataFrame, weeks: DataFrame, number: str = "week_number", calendar: Sequence[str] = ()) -> DataFrame:
    """Blocks known by week only, with the days between which they take place (``week_from``, ``week_to``), null where the
    calendar hasn't the week. They never get a day."""
    return _with_weeks(blocks, weeks, number, calendar).withColumnsRenamed({"__from": "week_from", "__to": "week_to"})


def _with_weeks(blocks: DataFrame, weeks: DataFrame, number: str, calendar: Sequence[str]) -> DataFrame:
    keys = {c: f"__c{k}" for k, c in enumerate(calendar)}
    table = weeks.groupBy(*calendar, "week_number").agg(F.min(F.struct("from_date", "to_date")).alias("w"))
    table = table.select(*[F.col(c).alias(k) for c, k in keys.items()], F.col("week_number").alias("__n"), F.col("w.from_date").alias("__from"), F.col("w.to_date").alias("__to"))
    same = F.col(number) == F.col("__n")
    for c, k in keys.items():
        same = same & (F.col(c) == F.col(k))
    return blocks.join(table, same, "left").drop("__n", *keys.values())


def overlapping(left: DataFrame, right: DataFrame, on: Sequence[str], bounds: tuple[str, str, str, str], width: int, closed: bool = False) -> DataFrame:
    """Pairs of rows, equal in ``on``, whose intervals overlap. ``bounds`` names the starts and ends (whole numbers) left and
    right; ``closed`` counts a shared end point.

    Intervals are cut at multiples of ``width`` and joined by (on, piece); a pair is kept only in the piece in which the later
    of the two begins, so that each comes out once. The work follows the number of overlaps, not that of all pairs, and a
    long interval costs its number of pieces. Intervals with a null bound or that end before they begin meet nothing.
    """
    la, lz, ra, rz = bounds
    pieces = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(z) / width)))
    l = left.where(F.col(la) <= F.col(lz)).withColumn("__piece", pieces(la, lz))  # noqa: E741
    r = right.where(F.col(ra) <= F.col(rz)).select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns], pieces(ra, rz).alias("__rpiece"))
    same = F.col("__piece") == F.col("__rpiece")
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    meet = (F.col(la) <= F.col(rz)) & (F.col(ra) <= F.col(lz)) if closed else (F.col(la) < F.col(rz)) & (F.col(ra) < F.col(lz))
    once = F.col("__piece") == F.floor(F.greatest(la, ra) / width)
    return l.join(r, same & meet & once).drop("__piece", "__rpiece", *[f"__r_{c}" for c in on])


def active_counts(points: DataFrame, intervals: DataFrame, on: Sequence[str], at: str, first: str, last: str) -> DataFrame:
    """How many closed intervals (of the same ``on``) cover each distinct point: ``on``, ``at``, ``active``.

    Starts and the days after ends are counted per day before anything is joined, and a running sum over points and days
    gives the count: nothing is paired, however many intervals cover a point.
    """
    good = intervals.where(F.col(first) <= F.col(last))
    steps = good.select(*on, F.col(first).alias("__t"), F.lit(1).alias("__d")).unionByName(good.select(*on, F.date_add(last, 1).alias("__t"), F.lit(-1).alias("__d")))
    steps = steps.groupBy(*on, "__t").agg(F.sum("__d").alias("__d"), F.lit(False).alias("__point"))
    asked = points.where(F.col(at).isNotNull()).select(*on, F.col(at).alias("__t")).distinct().select("*", F.lit(0).cast("long").alias("__d"), F.lit(True).alias("__point"))
    upto = Window.partitionBy(*on).orderBy("__t", "__point").rowsBetween(Window.unboundedPreceding, 0)
    return steps.unionByName(asked).withColumn("active", F.sum("__d").over(upto)).where("__point").select(*on, F.col("__t").alias(at), "active")


def next_after(probes: DataFrame, events: DataFrame, on: Sequence[str], at: str, start: str, take: str) -> DataFrame:
    """For each probe the first event of the same ``on`` that starts after its instant: ``next_start`` and ``next_<take>``.

    Probes and events are reduced to distinct instants per key before they meet, so that a key with a third of all rows costs
    no more than its instants; these are one ordered stream, in which a window carries the next event back, and the outcome is
    joined to the probes. Of events at the same instant the smallest ``take`` counts. Probes without an instant or without a
    later event get nulls; nulls in ``on`` are equal.
    """
    marks = events.groupBy(*on, start).agg(F.min(take).alias("__take")).select(*on, F.col(start).alias("__t"), F.lit(1).alias("__kind"), "__take")
    asked = probes.where(F.col(at).isNotNull()).select(*on, F.col(at).alias("__t")).distinct()
    both = marks.unionByName(asked.withColumns({"__kind": F.lit(0), "__take": F.lit(None).cast(events.schema[take].dataType)}))
    # At one instant events come before probes, so that a probe only sees later ones.
    order = Window.partitionBy(*on).orderBy(F.col("__t").asc(), F.col("__kind").desc()).rowsBetween(1, Window.unboundedFollowing)
    later = F.when(F.col("__kind") == 1, F.struct(F.col("__t").alias("t"), F.col("__take").alias("x")))
    found = both.withColumn("__next", F.first(later, ignorenulls=True).over(order)).where("__kind = 0")
    found = found.select(*[F.col(c).alias(f"__k{k}") for k, c in enumerate(on)], F.col("__t").alias("__at"), F.col("__next.t").alias("next_start"), F.col("__next.x").alias(f"next_{take}"))
    same = F.col(at) == F.col("__at")
    for k, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{k}"))
    return probes.join(found, same, "left").drop("__at", *[f"__k{k}" for k in range(len(on))])


def now_and_next(events: DataFrame, by: Sequence[str], start: str, end: str, take: str, now: Column) -> DataFrame:
    """Per key the event that goes on at an instant (half-open; the one that began first) and the next one to begin after it:
    ``by``, ``current``, ``following`` (P10). Keys with neither are left out."""
    active = (F.col(start) <= now) & (F.col(end) > now)
    first = lambda rule: F.min(F.when(rule, F.struct(F.col(start).alias("t"), F.col(take).alias("x"))))
    out = events.where((F.col(end) > now) | (F.col(start) > now)).groupBy(*by).agg(first(active)["x"].alias("current"), first(F.col(start) > now)["x"].alias("following"))
    return out.where("current IS NOT NULL OR following IS NOT NULL")


def slot_conflicts(events: DataFrame, slot: Sequence[str], content: Sequence[str], order: Sequence[str]) -> DataFrame:
    """How many rows of each slot differ in content from the slot's first row: ``slot``, ``conflicts`` (slots without any are left out).

    Rows are counted per slot and content before the slot is looked at, so that a slot with a third of all rows costs its
    different contents only.
    """
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__own{k}") for k, c in enumerate(content)]
    counted = events.groupBy(*slot, *own).agg(F.count("*").alias("__n"), F.min(F.struct(*order)).alias("__first"))
    sums = counted.groupBy(*slot).agg((F.sum("__n") - F.min(F.struct("__first", "__n"))["__n"]).alias("conflicts"))
    return sums.where("conflicts > 0")


def missing_and_extra(expected: DataFrame, actual: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that are expected and not there, and those that are there and not expected: the key and ``side`` (missing, extra)."""
    e, a = expected.select(*key).distinct(), actual.select(*key).distinct()
    return e.exceptAll(a).withColumn("side", F.lit("missing")).unionByName(a.exceptAll(e).withColumn("side", F.lit("extra")))


def _same(key: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in key:
        out = out & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return out


def upsert(base: DataFrame, patch: DataFrame, key: Sequence[str]) -> DataFrame:
    """The patch's rows, and the base's rows whose key isn't in the patch. Null parts of a key are equal."""
    kept = base.alias("a").join(patch.select(*key).distinct().alias("b"), _same(key), "left_anti").select("a.*")
    return kept.unionByName(patch)


def last_good(fresh: DataFrame, previous: DataFrame, failed: DataFrame, source: str, key: Sequence[str]) -> DataFrame:
    """The fresh rows, and the previous rows of sources that failed now whose key isn't fresh."""
    lost = previous.join(failed.select(source).distinct(), source, "left_semi").select(*previous.columns)
    return fresh.unionByName(lost.alias("a").join(fresh.select(*key).distinct().alias("b"), _same(key), "left_anti").select("a.*"))


def prefix_of(rows: DataFrame, text: str, known: DataFrame, name: str, shortest: int = 3) -> DataFrame:
    """Rows whose text begins with a known name, with the longest such name (``found``).

    Distinct texts only are looked at. Their prefixes that end at a word's end are looked up by equality, so that no text meets
    every name; of each text the length of the longest hit is kept.
    """
    low = F.lower(F.col("__text"))
    words = F.split(low, " ")
    prefixes = F.filter(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " ")), lambda p: F.length(p) >= shortest)
    texts = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("__text")).distinct()
    names = known.where(F.col(name).isNotNull()).select(F.lower(F.col(name)).alias("__prefix")).distinct()
    longest = texts.select("__text", F.explode(prefixes).alias("__prefix")).join(names, "__prefix").groupBy("__text").agg(F.max(F.length("__prefix")).alias("__n"))
    found = longest.select("__text", F.substring(low, F.lit(1), F.col("__n")).alias("found"))
    return rows.join(found, F.col(text) == F.col("__text")).drop("__text")


def first_or_fallback(rows: DataFrame, first: DataFrame, fallback: DataFrame, key: Sequence[str], fallback_key: Sequence[str], allowed: Column, order: str, take: Sequence[str]) -> DataFrame:
    """Every row with the columns ``take`` of the first matching row (by ``order``) of one table, or else, where ``allowed``, of
    another table with a shorter key; nulls where both have none (J12)."""
    best = lambda df, by, mark: df.groupBy(*[F.col(c).alias(f"__{mark}{c}") for c in by]).agg(F.min_by(F.struct(*take), order).alias(f"__{mark}"))
    same = lambda by, mark: reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{mark}{c}") for c in by])
    both = rows.join(best(first, key, "f"), same(key, "f"), "left").join(best(fallback, fallback_key, "b"), same(fallback_key, "b"), "left")
    return both.select(*rows.columns, *[F.when(F.col("__f").isNotNull(), F.col(f"__f.{c}")).when(allowed, F.col(f"__b.{c}")).alias(f"found_{c}") for c in take])


def owned(rows: DataFrame, parents: DataFrame, key: str, owner: str, who: str) -> DataFrame:
    """Rows whose parent (``key``) belongs to an owner; the parent's owner decides, whatever the row says."""
    mine = parents.where(F.col(owner) == who).select(F.col(key).alias("__key")).distinct()
    return rows.join(mine, F.col(key) == F.col("__key"), "left_semi")


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, order: Sequence[str]) -> DataFrame:
    """Parents with their children as an ordered array ``name``, empty where there are none (J15). A parent's children are in one row."""
    item = F.struct(*order, *[c for c in children.columns if c != key and c not in order])
    lists = children.groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(item)).alias(name))
    return parents.join(lists, F.col(key) == F.col("__key"), "left").drop("__key").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def all_hold(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, rule: Column, name: str) -> DataFrame:
    """Parents with ``name``: whether they have children and the rule holds for each of them (a null counts as no)."""
    verdict = children.groupBy(F.col(child_key).alias("__key")).agg(F.bool_and(F.coalesce(rule, F.lit(False))).alias(name))
    return parents.join(verdict, F.col(parent_key) == F.col("__key"), "left").drop("__key").fillna(False, [name])
