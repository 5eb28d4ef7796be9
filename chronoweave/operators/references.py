"""References to records that do not exist, or did not exist on their day."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.components import shared_folder
from chronoweave.operators.sizes import sent_if_small

#: A day number beyond every day.
NEVER = 2**22
_SPAN = np.int64(1) << 24  # more than there are days between -NEVER and NEVER


def packed_key(*columns: Column) -> Column:
    """One text for a key of several columns. A null part equals only a null part, and parts can't run into each other."""
    escaped = lambda c: F.replace(F.replace(c.cast("string"), F.lit("\u0002"), F.lit("\u0002\u0002")), F.lit("\u0001"), F.lit("\u0002\u0003"))
    return F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), escaped(c)), F.lit("0")) for c in columns])


class _Targets:
    """The targets of one range as sorted arrays: the known keys in order of their hashes, and as one number per (key, day)
    the days from which, and from which no longer, targets hold, and the days on which any of them ended."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(batches) if batches else pa.table({"__ref": pa.array([], pa.string()), "__hash": pa.array([], pa.int64()), "__from": pa.array([], pa.int32()), "__to": pa.array([], pa.int32())})
        rows = rows.sort_by([("__hash", "ascending"), ("__ref", "ascending")]).combine_chunks()
        self.hash, self.key = rows.column("__hash").to_numpy(), pa.concat_arrays([pa.array([], pa.string()), *rows.column("__ref").chunks])
        n = len(self.hash)
        new = np.ones(n, dtype=bool)
        if n > 1:
            new[1:] = pc.not_equal(self.key[1:], self.key[:-1]).to_numpy(zero_copy_only=False)
        place = (np.cumsum(new) - 1).astype(np.int64) * _SPAN
        at = np.flatnonzero(new)
        self.hash, self.key = self.hash[at], self.key.take(pa.array(at))
        first = rows.column("__from").to_numpy().astype(np.int64)
        last = pc.fill_null(rows.column("__to"), NEVER).to_numpy().astype(np.int64)
        real = first < last  # a target that ends before it begins never holds, but has ended
        self.opened, self.ended, self.all_ended = np.sort((place + first)[real]), np.sort((place + last)[real]), np.sort(place + last)

    def find(self, hashes: np.ndarray, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key by binary search for its hash, and whether it is there: full keys are compared, and of keys
        with one hash all are tried."""
        place = np.searchsorted(self.hash, hashes)
        there = np.zeros(len(hashes), dtype=bool)
        open_ = np.flatnonzero(place < len(self.hash))
        while len(open_):
            open_ = open_[(place[open_] < len(self.hash))]
            open_ = open_[self.hash[place[open_]] == hashes[open_]]
            if not len(open_):
                break
            same = pc.equal(self.key.take(pa.array(place[open_])), keys.take(pa.array(open_))).to_numpy(zero_copy_only=False)
            there[open_[same]] = True
            open_ = open_[~same]
            place[open_] += 1
        return place, there


def _judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of keys, its targets before its references: the targets become sorted arrays, and every batch of
    references is looked up in them by binary search."""
    held: list[pa.RecordBatch] = []
    targets: _Targets | None = None
    for batch in batches:
        n = int((batch.column("__side").to_numpy(zero_copy_only=False) == 0).sum())
        if n:
            held.append(batch.slice(0, n).select(["__ref", "__hash", "__from", "__to"]))
        probe = batch.slice(n)
        if not probe.num_rows:
            continue
        if targets is None:
            targets, held = _Targets(held), []
        place, there = targets.find(probe.column("__hash").to_numpy(zero_copy_only=False), probe.column("__ref"))
        undated = pc.is_null(probe.column("__from")).to_numpy(zero_copy_only=False)
        day = pc.fill_null(probe.column("__from"), -NEVER).to_numpy(zero_copy_only=False).astype(np.int64)
        base = place.astype(np.int64) * _SPAN
        until = lambda edges: np.searchsorted(edges, base + day, side="right") - np.searchsorted(edges, base - _SPAN // 2, side="left")  # noqa: B023, E731
        holds = until(targets.opened) - until(targets.ended) > 0
        reason = np.where(~there, "missing", np.where(until(targets.all_ended) > 0, "deleted", "late"))
        miss = ~there | (~holds & ~undated)
        if miss.any():
            keep = pa.array(miss)
            columns = [probe.column("__ref").filter(keep), probe.column("__from").filter(keep), pa.array(reason[miss].astype(object), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["__ref", "__from", "reason"])


def unheld_references(references: DataFrame, targets: DataFrame, key: str, day: str, target_key: str, opened: str, ended: str) -> DataFrame:
    """The distinct (``key``, ``day``) of ``references`` for which no target row of the key holds on the day, with the reason.

    A target holds from ``opened`` on and, if ``ended`` is set, no longer on that day. The reason is ``missing`` if there is
    no target with the key, else ``deleted`` if one of them ended on or before the day, else ``late``.

    References are first reduced to distinct (key, day) with a combine before the shuffle, so that a key referred to by a
    third of all rows costs one entry per day. Both sides are range-partitioned by the key's 64-bit hash, which spreads keys
    evenly; in the task of a range the targets are sorted arrays, and batches of references are looked up in them by binary
    search for the hash, followed by a comparison of the full keys. All of it works on Arrow and numpy arrays.

    A null key refers to nothing and is left out. A null day can only be ``missing``. A target with a null ``opened`` holds
    from the beginning; one that ends before it begins never holds. Without targets every reference is ``missing``.
    """
    asked = references.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("__ref"), F.unix_date(F.col(day).cast("date")).alias("__from")).distinct()
    held = (
        targets.where(F.col(target_key).isNotNull())
        .select(
            F.col(target_key).cast("string").alias("__ref"),
            F.coalesce(F.unix_date(F.col(opened).cast("date")), F.lit(-NEVER)).alias("__from"),
            F.unix_date(F.col(ended).cast("date")).alias("__to"),
        )
        .distinct()
    )
    hashed = F.xxhash64("__ref").alias("__hash")
    both = asked.select(F.lit(1).alias("__side"), "__ref", hashed, "__from", F.lit(None).cast("int").alias("__to")).unionByName(held.select(F.lit(0).alias("__side"), "__ref", hashed, "__from", "__to"))
    placed = both.repartitionByRange("__hash").sortWithinPartitions("__side")
    missed = placed.mapInArrow(_judge, "__ref string, __from int, reason string")
    return missed.select(F.col("__ref").alias(key), F.date_from_unix_date("__from").alias(day), "reason")


def orphan_rows(rows: DataFrame, missed: DataFrame, key: str, day: str) -> DataFrame:
    """The rows whose (``key``, ``day``) is among the misses, with the reason; a null day meets a null day.

    The misses are written once and measured: if they are small they are sent to every task, and rows are read once more but
    not shuffled; else Spark joins by shuffle and splits hot keys.
    """
    shared_folder(rows.sparkSession)
    there = missed.select(F.col(key).alias("__ref"), F.col(day).alias("__day"), "reason").checkpoint()
    return rows.join(sent_if_small(there), (F.col(key) == F.col("__ref")) & F.col(day).eqNullSafe(F.col("__day"))).drop("__ref", "__day")


def report(cases: DataFrame) -> DataFrame:
    """Orphan references per table, field, reason and month."""
    return cases.groupBy("table_name", "ref_field", "reason", "ref_month").agg(F.count("*").alias("references"))
