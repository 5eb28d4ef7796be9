"""What is there, what is missing, and what is wrong: coverage, counters and issues."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.clock import minutes_of_day
from chronoweave.functions.text import group_code, is_everybody, week_list
from chronoweave.operators.grid import BUILDINGS
from chronoweave.operators.joins import slot_conflicts
from chronoweave.operators.references import packed_key

KINDS = ("lecture", "practice", "lab", "assessment", "other")


def kinds_per_group(roster: DataFrame, events: DataFrame) -> DataFrame:
    """For every roster group how many events of each kind it has, those for everybody (of its stream, or of none) included,
    and how many of its own (``own_<kind>``). Groups without events stay, with zeros.

    Events are counted per (program, course, group, stream, kind) before any join, so that the joins are as small as the
    roster; events for everybody are a second equi-join, not a condition with an or.
    """
    groups = roster.select("program_code", "course", "stream_code", group_code(F.col("group_code")).alias("group_code")).where("group_code IS NOT NULL").distinct()
    counted = events.groupBy("program_code", "course", group_code(F.col("group_code")).alias("g"), F.col("stream_code").alias("s"), F.col("lesson_type").alias("kind")).agg(F.count("*").alias("n"))
    streams = F.col("s").isNull() | F.col("stream_code").isNull() | (F.col("s") == F.col("stream_code"))
    common = is_everybody(F.col("g"))
    own = groups.join(counted.where(~common).withColumnRenamed("g", "group_code"), ["program_code", "course", "group_code"]).where(streams).withColumn("own", F.col("n"))
    every = groups.join(counted.where(common).drop("g"), ["program_code", "course"]).where(streams).withColumn("own", F.lit(0).cast("long"))
    columns = ["program_code", "course", "stream_code", "group_code", "kind", "n", "own"]
    both = own.select(*columns).unionByName(every.select(*columns))
    of = lambda v, k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(v))), F.lit(0))
    sums = both.groupBy("program_code", "course", "group_code", F.coalesce("stream_code", F.lit("")).alias("__s")).agg(*[of("n", k).alias(k) for k in KINDS], *[of("own", k).alias(f"own_{k}") for k in KINDS])
    out = groups.withColumn("__s", F.coalesce("stream_code", F.lit(""))).join(sums, ["program_code", "course", "group_code", "__s"], "left").drop("__s")
    return out.fillna(0, [*KINDS, *[f"own_{k}" for k in KINDS]])


def coverage(roster: DataFrame, events: DataFrame, needed: Sequence[str] = ("lecture", "practice")) -> DataFrame:
    """Coverage rolled up from groups to streams and courses: ``level``, its keys (null above their level), ``expected``
    groups, ``covered`` groups (all needed kinds are there), and ``status`` (full, partial, missing)."""
    groups = kinds_per_group(roster, events)
    full, none = F.lit(True), F.lit(True)
    for kind in needed:
        full, none = full & (F.col(kind) > 0), none & (F.col(kind) == 0)
    rows = groups.select("program_code", "course", "stream_code", "group_code", full.cast("int").alias("full"), none.cast("int").alias("none"))
    out = rows.rollup("program_code", "course", F.coalesce("stream_code", F.lit("-")).alias("stream"), "group_code").agg(
        F.grouping_id().alias("g"), F.count("*").alias("expected"), F.sum("full").alias("covered"), F.sum("none").alias("nothing")
    )
    level = F.when(F.col("g") == 0, "group").when(F.col("g") == 1, "stream").when(F.col("g") == 3, "course").when(F.col("g") == 7, "program").otherwise("all")
    status = F.when(F.col("covered") == F.col("expected"), "full").when(F.col("nothing") == F.col("expected"), "missing").otherwise("partial")
    return out.select(level.alias("level"), "program_code", "course", "stream", "group_code", "expected", "covered", status.alias("status"))


def blanks(events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows there are and how many have nothing (null or blanks) in each column: ``column_name``, ``total_rows``, ``blank_rows``."""
    bare = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    counts = events.agg(F.count("*").alias("total"), *[F.coalesce(F.count_if(bare(c)), F.lit(0)).alias(f"b{k}") for k, c in enumerate(columns)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("total").alias("total_rows"), F.col(f"b{k}").alias("blank_rows")) for k, c in enumerate(columns)])).alias("x")).select("x.*")


def issues(rows: DataFrame, row_id: str, rules: dict[str, Column]) -> DataFrame:
    """One row per row and broken rule: ``row_id``, ``issue``. A rule that can't be decided (null) isn't broken."""
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.select(F.col(row_id), F.explode(found).alias("issue"))


def event_rules() -> dict[str, Column]:
    """What must not be of an event: no day, broken or reversed clocks, too long a lesson, no subject, no place, a strange group."""
    a, z = minutes_of_day(F.col("start_time")), minutes_of_day(F.col("end_time"))
    return {
        "no day": F.col("event_date").isNull(),
        "no clock": a.isNull() | z.isNull(),
        "ends before it starts": z <= a,
        "longer than four hours": z - a > 240,
        "duration differs": F.col("duration_minutes") != z - a,
        "no subject": F.coalesce(F.trim("subject"), F.lit("")) == "",
        "no location": F.coalesce(F.trim("location_text"), F.lit("")) == "",
        "strange group": ~is_everybody(F.col("group_code")) & ~group_code(F.col("group_code")).rlike("^[0-9]{3}[А-Я]?$"),
        "address in the subject": F.col("subject").rlike("(?iu)(?:^|[^а-яё])(?:ауд|ул|каб)\\."),
    }


def is_place_only(subject: Column, place: Column) -> Column:
    """Whether an address stands where the subject should and no place is given: such rows are set aside, not guessed at."""
    names = "|".join(BUILDINGS)
    return (F.coalesce(F.trim(place), F.lit("")) == "") & F.coalesce(F.trim(subject).rlike(rf"(?iu)^(?:(?:{names}|База)(?![\p{{L}}\p{{N}}_])|(?:ауд|каб)\.?\s|зал\s|ул\.\s|просп?\.?\s)"), F.lit(False))


def lesson_rules(kinds: Sequence[str] = KINDS, late_courses: Sequence[int] = (4, 5, 6)) -> dict[str, Column]:
    """What must not be of a lesson known by week and weekday (V3): columns as of raw_event, and ``source_url``."""
    a, z = minutes_of_day(F.col("start_time")), minutes_of_day(F.col("end_time"))
    canonical = lambda c: F.coalesce(F.col(c).rlike(r"^\d{2}:\d{2}$"), F.lit(False))
    stream, kind = F.coalesce("stream_code", F.lit("")), F.col("lesson_type")
    return {
        "unknown kind": ~F.coalesce(kind.isin(*kinds), F.lit(False)),
        "made up for a test": F.coalesce(F.col("source_url").startswith("fixture://"), F.lit(False)),
        "no stream": (F.col("course") != 6) & ~stream.isin("A", "B"),
        "stream in the last course": (F.col("course") == 6) & (stream != ""),
        "practice of no group": (kind == "practice") & ~F.coalesce(group_code(F.col("group_code")).rlike("^[0-9]{3}[А-Я]?$"), F.lit(False)),
        "lecture of one group": (kind == "lecture") & ~F.coalesce(is_everybody(F.col("group_code")), F.lit(False)),
        "strange weekday": ~F.col("weekday").between(0, 6),
        "no weekday": F.col("weekday").isNull() & (kind != "practice"),
        "late practice without weekday": F.col("weekday").isNull() & (kind == "practice") & F.col("course").isin(*late_courses),
        "clock not canonical": ~(canonical("start_time") & canonical("end_time")),
        "no duration": canonical("start_time") & canonical("end_time") & ~F.coalesce((z - a > 0) & (z - a <= 240), F.lit(False)),
        "strange week": ~F.coalesce(F.col("week_number").between(1, 52), F.lit(False)),
        "no subject": F.coalesce(F.trim("subject"), F.lit("")) == "",
        "place in the subject": is_place_only(F.col("subject"), F.lit(None).cast("string")),
    }


def exact_duplicates(rows: DataFrame, key: Sequence[str], by: Sequence[str]) -> DataFrame:
    """How many rows more than one there are of each key, summed up by ``by``: ``by``, ``extra`` (keys without any are left out)."""
    digest = F.md5(packed_key(*[F.col(k) for k in key]))
    return rows.groupBy(*by, digest.alias("__key")).agg((F.count("*") - 1).alias("n")).where("n > 0").groupBy(*by).agg(F.sum("n").alias("extra"))


def few_events(events: DataFrame, by: Sequence[str], kinds: Sequence[str] = ("lecture", "practice"), least: int = 3) -> DataFrame:
    """Where there are suspiciously few events of a kind (A4): ``by``, ``kind``, ``events``; none at all counts, too, if the key has any event."""
    counts = events.groupBy(*by).agg(*[F.count_if(F.col("lesson_type") == k).alias(k) for k in kinds])
    rows = counts.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("events")) for k in kinds])).alias("x")).select(*by, "x.*")
    return rows.where(F.col("events") < least)


def rule_issues(rules: DataFrame, groups: DataFrame, first_week: int, last_week: int) -> DataFrame:
    """What is wrong with rules typed by people (V11): ``rule_id``, ``issue``. ``groups`` has the known groups (program_code, course,
    group_code). Broken or reversed clocks, a weekday outside 1 to 7, weeks outside the window, unknown groups, and a (group, week,
    weekday, clocks, subject) that an earlier rule (by rule_id) has already."""
    a, z = minutes_of_day(F.col("start_time")), minutes_of_day(F.col("end_time"))
    weeks = week_list(F.col("weeks_spec"))
    own = {
        "no clock": a.isNull() | z.isNull(), "ends before it starts": z <= a, "weekday not 1 to 7": ~F.coalesce(F.col("weekday").between(1, 7), F.lit(False)),
        "weeks outside the window": F.coalesce((F.array_min(weeks) < first_week) | (F.array_max(weeks) > last_week), F.lit(False)),
    }
    found = issues(rules, "rule_id", own)
    spread = rules.select("rule_id", "program_code", "course", "weekday", "start_time", "end_time", "subject", weeks.alias("weeks"), F.explode(F.array_distinct("groups_list")).alias("g"))
    known = groups.select("program_code", "course", group_code(F.col("group_code")).alias("__g")).distinct()
    unknown = spread.withColumn("__g", group_code(F.col("g"))).join(known, ["program_code", "course", "__g"], "left_anti").select("rule_id", F.lit("unknown group").alias("issue")).distinct()
    slots = spread.select("*", F.explode("weeks").alias("week"))
    key = packed_key(*[F.col(c) for c in ("program_code", "course", "g", "week", "weekday", "start_time", "end_time", "subject")])
    first = slots.groupBy(F.md5(key).alias("__key")).agg(F.min("rule_id").alias("__first"), F.count_distinct("rule_id").alias("__n")).where("__n > 1")
    again = slots.withColumn("__key", F.md5(key)).join(first, "__key").where("rule_id <> __first").select("rule_id", F.lit("repeats an earlier rule").alias("issue")).distinct()
    return found.unionByName(unknown).unionByName(again)


def readiness(events: DataFrame, by: Sequence[str], slot: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Whether the events of each key can be published (V9, A8): ``by``, ``events``, ``missing`` (rows without a required field),
    ``duplicates``, ``conflicts`` (rows that differ from the first of their slot), ``set_aside`` and ``status``: ``not-ready`` if any of
    them is there, else ``ready``."""
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in ("group_code", "lesson_type", "start_time", "end_time", "event_date")])
    counts = events.groupBy(*by).agg(F.count("*").alias("events"), F.count_if(blank).alias("missing"), F.count_if(is_place_only(F.col("subject"), F.col("location_text"))).alias("set_aside"))
    extra = exact_duplicates(events, [*slot, "end_time", *content], by).withColumnRenamed("extra", "duplicates")
    clashes = slot_conflicts(events, slot, content, ["event_id"]).groupBy(*by).agg(F.sum("conflicts").alias("conflicts"))
    out = counts.join(extra, list(by), "left").join(clashes, list(by), "left").fillna(0, ["duplicates", "conflicts"])
    bad = F.col("missing") + F.col("duplicates") + F.col("conflicts") + F.col("set_aside") > 0
    return out.select(*by, "events", "missing", "duplicates", "conflicts", "set_aside", F.when(bad, "not-ready").otherwise("ready").alias("status"))


def split_good(rows: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that are good (the rule is false or can't be decided), and those set aside."""
    hit = F.coalesce(bad, F.lit(False))
    return rows.where(~hit), rows.where(hit)


def first_most_common(rows: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """The most common value per key; of equally common ones that which comes first in ``order``."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    return counted.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), F.col("at"))).alias(value), F.max("n").alias("times"))
