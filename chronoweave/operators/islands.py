"""Rows in order: filled down, split into lessons, and merged into runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.clock import minutes_of_day, render_minutes
from chronoweave.functions.temporal import lesson_parts
from chronoweave.functions.text import clean_text, is_org_subject
from chronoweave.operators.components import shared_folder
from chronoweave.operators.references import packed_key


def _fill_part(names: Sequence[str], filled: Sequence[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fills within one task. A row's block is its key and number of resets; ``__head`` marks rows of the task's first block, which
    may go on from the task before; ``__seq`` numbers the task's rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, head, last_key, carry = 0, True, None, dict.fromkeys(filled)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, reset = batch.column("__key"), batch.column("__reset").to_numpy(zero_copy_only=False).astype(bool)
            n = batch.num_rows
            new = np.empty(n, dtype=bool)
            new[0] = seq > 0 and key[0].as_py() != last_key
            new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            new |= reset
            begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            open_ = ~np.maximum.accumulate(new)  # still in the block that the batch before ended with
            columns = []
            for c in names:
                values = batch.column(c)
                if c in filled:
                    known = np.maximum.accumulate(np.where(pc.is_valid(values).to_numpy(zero_copy_only=False), np.arange(n), -1))
                    # Place 0 is what was carried in; a value before the block's begin doesn't count.
                    place = np.where(known >= begin, known + 1, np.where(open_, 0, -1))
                    pool = pa.concat_arrays([pa.array([carry[c]], values.type), values])
                    values = pool.take(pa.array(place, mask=place < 0))
                    carry[c] = values[-1].as_py()
                columns.append(values)
            heads = head & open_ if head else np.zeros(n, dtype=bool)
            head = bool(heads[-1])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(heads), pa.array(np.arange(seq, seq + n))], [*names, "__head", "__seq"])
            seq, last_key = seq + n, key[-1].as_py()

    return run


def fill_down(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], reset: Column | None = None) -> DataFrame:
    """Nulls of ``columns`` become the last value above them, within ``by`` and, if ``reset`` is given, not across rows where it holds.

    Rows are range-partitioned and sorted by (``by``, ``order``), so that a key with a third of all rows is cut over many tasks.
    Each task fills its rows as arrays; what goes on from one task to the next is one row a task, which the driver chains, and
    which is joined back to the rows at the begin of each task. ``order`` should end in a unique column, else rows that are equal
    in it come in any order. An empty table gives no rows.
    """
    spark = df.sparkSession
    shared_folder(spark)
    flag = F.coalesce(reset, F.lit(False)) if reset is not None else F.lit(False)
    placed = df.withColumns({"__key": packed_key(*[F.col(c) for c in by]), "__reset": flag}).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "__head boolean", "__seq long"])
    local = placed.mapInArrow(_fill_part(df.columns, columns), schema).withColumn("__part", F.spark_partition_id()).withColumn("__key", packed_key(*[F.col(c) for c in by])).checkpoint()
    ends = local.groupBy("__part").agg(
        F.min_by("__key", "__seq").alias("first"), F.min_by("__head", "__seq").alias("head"), F.max_by(F.struct("__key", "__head", *columns), "__seq").alias("end")
    ).orderBy("__part").collect()  # one row per task
    carried, known = [], None
    for row in ends:
        open_ = known is not None and row["first"] == known["__key"] and row["head"]
        values = {c: known[c] if open_ else None for c in columns}
        carried.append((row["__part"], *values.values()))
        end = row["end"].asDict()
        known = end | {c: end[c] if end[c] is not None or not end["__head"] else values[c] for c in columns}
    kinds = [T.StructField("__part", T.IntegerType()), *[T.StructField(f"__c{k}", df.schema[c].dataType) for k, c in enumerate(columns)]]
    carry = F.broadcast(spark.createDataFrame(carried, T.StructType(kinds)))
    filled = {c: F.coalesce(F.col(c), F.when(F.col("__head"), F.col(f"__c{k}"))) for k, c in enumerate(columns)}
    return local.join(carry, "__part", "left").select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def split_double(events: DataFrame, whole: Column) -> DataFrame:
    """Blocks of double length as two lessons (``double_part`` 1 and 2); others as they are, part null. Rows whose clocks
    can't be read stay as they are."""
    a, b = minutes_of_day(F.col("start_time")), minutes_of_day(F.col("end_time"))
    parts = F.when(a.isNotNull() & b.isNotNull(), lesson_parts(a, b, whole)).otherwise(F.array(F.struct(*[F.lit(None).cast("int").alias(n) for n in ("part", "start", "end")])))
    rows = events.withColumn("__p", F.explode(parts))
    clock = lambda n: F.coalesce(F.when(F.col("__p.part").isNotNull(), render_minutes(F.col(f"__p.{n}"))), F.col(f"{n}_time"))
    return rows.select(*[clock(c.removesuffix("_time")).alias(c) if c in ("start_time", "end_time") else F.col(c) for c in events.columns], F.col("__p.part").alias("double_part"))


def merge_runs(slots: DataFrame, same: Sequence[str], start: str, end: str, shortest: int = 45, longest: int = 130, gap: int = 20, merged: str | None = None) -> DataFrame:
    """Runs of slots that follow each other and are equal in ``same``: one row each, ``same``, ``start``, ``end``, ``slots``.

    Starts and ends are minutes. A slot can be in a run if it lasts from ``shortest`` to ``longest`` minutes, or longer if
    ``merged`` (a boolean column) says that it is a run already. It joins the slot just before it in order of start and end
    if it begins 0 to ``gap`` minutes after that one ends. Other rows stay alone. Nulls in ``same`` are equal.
    """
    minutes = F.col(end) - F.col(start)
    fits = minutes.between(shortest, longest) | ((minutes > longest) & F.coalesce(F.col(merged), F.lit(False)) if merged else F.lit(False))
    order = Window.partitionBy(*same).orderBy(start, end)
    rows = slots.select(*same, F.col(start).alias("__a"), F.col(end).alias("__z"), F.coalesce(fits, F.lit(False)).alias("__fits"))
    order = Window.partitionBy(*same).orderBy("__a", "__z")
    goes_on = F.col("__fits") & F.lag("__fits").over(order) & (F.col("__a") - F.lag("__z").over(order)).between(0, gap)
    rows = rows.withColumn("__new", F.when(goes_on, 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*same, "__run").agg(F.min("__a").alias(start), F.max("__z").alias(end), F.count("*").alias("slots")).drop("__run")


def merge_lessons(events: DataFrame, identity: Sequence[str], tie: str, merged: Column, slots: Column | None = None, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Runs of equal lessons that follow each other as one row each (W2): the columns of the run's first row with its last end, and
    ``merged_slot_count``, ``merged_minutes``, ``org_merged`` and ``merged_consecutive`` (null where nothing was merged).

    Lessons are equal in ``identity``: subject, place, teacher and kind cleaned of blanks and letter case, null as empty; all
    spellings of the state-foundations subject are one. A lesson can be in a run if it lasts 45 to 130 minutes, or longer if it was
    merged before (``merged``); it joins the one before it if it begins 0 to 20 minutes after that one ends. A lesson merged
    before counts as two slots, or as many as ``slots`` says, so a single one comes out as merged again.
    """
    soft = ("subject", "location_text", "teacher", "lesson_type")
    parts = [F.coalesce(F.lower(clean_text(F.col(c))) if c in soft else F.col(c).cast("string"), F.lit("")) for c in identity]
    org = is_org_subject(F.col("subject"))
    parts = [F.when(org, F.lit("org")).otherwise(p) if c == "subject" else p for c, p in zip(identity, parts, strict=True)]
    a, z = minutes_of_day(F.col(start)), minutes_of_day(F.col(end))
    before = F.coalesce(merged, F.lit(False))
    fits = F.coalesce((z > a) & ((z - a).between(45, 130) | (before & (z - a > 130))), F.lit(False))
    count = F.greatest(F.lit(1), F.coalesce(slots if slots is not None else F.lit(None).cast("int"), F.when(before, 2).otherwise(1)))
    rows = events.withColumns({"__key": F.md5(packed_key(*parts)), "__a": a, "__z": z, "__fits": fits, "__count": count, "__org": org})
    order = Window.partitionBy("__key").orderBy(F.coalesce("__a", F.lit(0)), F.coalesce("__z", F.lit(0)), tie)
    goes_on = F.col("__fits") & F.lag("__fits").over(order) & (F.col("__a") - F.lag("__z").over(order)).between(0, 20)
    rows = rows.withColumn("__new", F.when(goes_on, 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__at", F.row_number().over(order))
    runs = rows.groupBy("__key", "__run").agg(F.min_by(F.struct(*events.columns, "__a", "__fits", "__org"), "__at").alias("f"), F.max_by(F.struct(F.col(end).alias("end"), F.col("__z").alias("z")), "__at").alias("l"), F.sum("__count").alias("n"))
    many = (F.col("n") >= 2) & F.col("f.__fits")
    return runs.select(
        *[(F.when(many, F.col("l.end")).otherwise(F.col(f"f.{c}")) if c == end else F.col(f"f.{c}")).alias(c) for c in events.columns],
        F.when(many, F.col("n").cast("int")).alias("merged_slot_count"), F.when(many, F.col("l.z") - F.col("f.__a")).alias("merged_minutes"),
        F.when(many, F.col("f.__org")).alias("org_merged"), F.when(many, ~F.col("f.__org")).alias("merged_consecutive"),
    )


def merge_pairs(parts: DataFrame, same: Sequence[str], part: str, start: str, end: str, gap: int = 20) -> DataFrame:
    """Part 1 and the part 2 that follows it within ``gap`` minutes become one row again (``joined`` true); others stay."""
    order = Window.partitionBy(*same).orderBy(start, part)
    follows = (F.lead(part).over(order) == 2) & (F.col(part) == 1) & (F.lead(start).over(order) - F.col(end)).between(0, gap)
    rows = parts.select(*same, part, start, end, F.coalesce(follows, F.lit(False)).alias("joined"), F.when(follows, F.lead(end).over(order)).alias("__z"))
    taken = F.coalesce(F.lag("joined").over(order), F.lit(False)) & (F.col(part) == 2)
    rows = rows.withColumn("__taken", taken).where("NOT __taken")
    return rows.select(*same, F.when(~F.col("joined"), F.col(part)).alias(part), start, F.coalesce("__z", end).alias(end), "joined")
