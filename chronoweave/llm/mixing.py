"""Mixing sources to target shares of the total size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.components import shared_folder
from chronoweave.operators.sizes import sent_if_small

#: A source may lack so much of its budget, and records are passed over in so many rounds at most.
LACK, ROUNDS = 0.001, 25


def _running(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a task (sorted by source): the sum of sizes up to and with each row of its source."""
    last, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        source = batch.column("source").to_numpy(zero_copy_only=False)
        sizes = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.r_[source[0] != last, source[1:] != source[:-1]]
        upto = np.cumsum(sizes)
        before = upto - sizes
        starts = np.flatnonzero(new)
        # What is to be taken off: all before the row's source began here (for the first rows, less what earlier batches held).
        off = np.r_[-total, before[starts]][np.cumsum(new)]
        upto = upto - off
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto)], [*batch.schema.names, "upto"])
        last, total = source[-1], int(upto[-1])


def mix_plan(sizes: DataFrame, targets: DataFrame, total: int | str | None = None) -> DataFrame:
    """What each source gives: ``source``, ``target_share``, ``max_repeats``, ``available``, ``budget``, ``sets_total``.

    ``total`` is the wanted size of the result. If it is not given, it is the largest one at which every source that has
    records can hold its share, so that the shares come out as wanted; ``sets_total`` tells which source that is. A larger
    total leaves small sources short of theirs. ``"available"`` asks for as much as all sources with a target hold.
    """
    wanted = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    held = sizes.groupBy("source").agg(F.sum("size").alias("available"))
    plan = wanted.join(held, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    most = F.col("available") * F.col("max_repeats")
    every = Window.partitionBy()  # one row per source
    could = F.when(F.col("available") > 0, most / F.col("target_share"))
    if total is None:
        limit = F.min(could).over(every)
    else:
        limit = F.sum("available").over(every) if total == "available" else F.lit(total)
    budget = F.least(most.cast("double"), F.coalesce(F.col("target_share") * limit, F.lit(0.0)))
    sets = F.coalesce(could == F.min(could).over(every), F.lit(False)) if total is None else F.lit(False)
    return plan.withColumns({"budget": F.floor(budget + 1e-6).cast("long"), "sets_total": sets})


def _prefix(rows: DataFrame) -> DataFrame:
    """The rows with ``upto``, the sum of sizes up to and with each one in its source, in order of their keys; written once.

    Rows are range-sorted by (source, key); sums per task and source and their running sums give what comes before a task,
    running sums within the tasks the rest. No source is ever in one task only.
    """
    placed = rows.repartitionByRange("source", "key", "id").sortWithinPartitions("source", "key", "id").withColumn("part", F.spark_partition_id()).checkpoint()
    sums = placed.groupBy("source", "part").agg(F.sum("size").alias("held"))  # one row per task, and one more per source
    before = F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("source", "part", before.alias("offset")).checkpoint()
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema), "upto bigint"])
    running = placed.mapInArrow(_running, schema).join(sent_if_small(offsets), ["source", "part"])
    return running.withColumn("upto", F.col("upto") + F.col("offset")).drop("part", "offset").checkpoint()


def mix(records: DataFrame, row_id: str, source: str, size: str, targets: DataFrame, total: int | str | None = None, seed: int = 20260831) -> tuple[DataFrame, DataFrame]:
    """The chosen records with their repeats (``row_id``, ``source``, ``size``, ``repeats``), and the shares reached
    (``source``, ``target_share``, ``max_repeats``, ``available``, ``budget``, ``sets_total``, ``reached``, ``share``, ``met``).

    Records get a hash-random key, are range-sorted by (source, key), and a distributed prefix sum of sizes gives each its
    place in its source. The budget is a number of whole epochs and a rest: every record is used once per whole epoch, and
    once more if it lies in the rest's prefix. The record that lies across the cut is passed over, and those behind it that
    still fit are taken by a further prefix sum over them, until a source lacks no more than ``LACK`` of its budget, holds
    nothing that fits, or ``ROUNDS`` are done: one long record doesn't break a share. No budget is ever exceeded.

    Records with a null id, a null source or no size are left out, as are sources without a target. A target whose source
    has no records gets nothing and is not met. ``met`` tells whether the reached share is within a hundredth of the target.
    """
    shared_folder(records.sparkSession)
    rows = records.where(F.col(row_id).isNotNull() & (F.col(size) > 0)).select(F.col(row_id).alias("id"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"))
    rows = rows.join(targets.where("source IS NOT NULL").select("source").distinct(), "source", "left_semi").withColumn("key", F.xxhash64(F.lit(seed), F.col("id"))).checkpoint()
    plan = mix_plan(rows, targets, total).withColumn("epochs", F.coalesce(F.floor(F.try_divide("budget", "available")), F.lit(0))).checkpoint()
    left = plan.select("source", (F.col("budget") - F.col("epochs") * F.col("available")).alias("lacks"), "budget")
    parts, open_ = [], rows
    for _ in range(ROUNDS):
        asked = open_.join(sent_if_small(left), "source")
        passed = _prefix(asked.where("size <= lacks")).withColumn("more", (F.col("upto") <= F.col("lacks")).cast("int"))
        parts += [asked.where("size > lacks").select("id", "source", "size", F.lit(0).alias("more")), passed.where("more = 1").select("id", "source", "size", "more")]
        open_ = passed.where("more = 0").select("id", "source", "size", "key")
        taken = passed.groupBy("source").agg(F.sum(F.col("size") * F.col("more")).alias("taken"), F.min(F.when(F.col("more") == 0, F.col("size"))).alias("smallest"))
        left = left.select("source", "lacks", "budget").join(taken, "source").select("source", (F.col("lacks") - F.col("taken")).alias("lacks"), "budget", "smallest").checkpoint()
        if left.where((F.col("smallest") <= F.col("lacks")) & (F.col("lacks") > F.col("budget") * LACK)).isEmpty():
            break
        left = left.select("source", F.when(F.col("lacks") > F.col("budget") * LACK, F.col("lacks")).otherwise(0).alias("lacks"), "budget")
    parts.append(open_.select("id", "source", "size", F.lit(0).alias("more")))
    whole = reduce(DataFrame.unionByName, parts).join(sent_if_small(plan.select("source", "epochs")), "source")
    chosen = whole.withColumn("repeats", (F.col("epochs") + F.col("more")).cast("int")).where("repeats > 0").select(F.col("id").alias(row_id), "source", "size", "repeats")
    used = chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("reached"))
    all_ = F.sum("reached").over(Window.partitionBy())
    shares = plan.drop("epochs").join(used, "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0).cast("long"))).withColumn("share", F.coalesce(F.try_divide("reached", all_), F.lit(0.0)))
    return chosen, shares.withColumn("met", F.abs(F.col("share") - F.col("target_share")) <= 0.01)
