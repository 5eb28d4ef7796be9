"""Closed day intervals per entity: continuous periods and the gaps between them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A task gives its maps on when they hold so many intervals in all.
FLUSH_AT = 200_000
#: Rows in a batch given on.
BATCH = 50_000


class IntervalMap:
    """Disjoint closed day intervals in order. Intervals that touch (the next day begins another) are one."""

    __slots__ = ("ends", "starts")

    def __init__(self, starts: Iterable[int] = (), ends: Iterable[int] = ()) -> None:
        self.starts, self.ends = list(starts), list(ends)

    def __len__(self) -> int:
        return len(self.starts)

    def add(self, start: int, end: int) -> None:
        """Insert an interval; what it overlaps or touches is found by binary search and merged with it."""
        first = bisect_left(self.ends, start - 1)
        last = bisect_right(self.starts, end + 1)
        if first < last:
            start, end = min(start, self.starts[first]), max(end, self.ends[last - 1])
        self.starts[first:last] = [start]
        self.ends[first:last] = [end]

    def gaps(self) -> Iterator[tuple[int, int]]:
        """The free days between neighbours."""
        for end, start in zip(self.ends[:-1], self.starts[1:], strict=True):
            yield end + 1, start - 1


def _runs(entity: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """The disjoint runs of a batch, merged by array operations: one (entity, start, end) each, in order."""
    if not len(entity):
        return
    names, code = np.unique(entity, return_inverse=True)
    order = np.lexsort((start, code))
    code, start, end = code[order], start[order].astype(np.int64), end[order].astype(np.int64)
    wide = np.int64(1) << 32  # farther apart than any two days, so that entities never touch
    place = code.astype(np.int64) * wide
    reach = np.maximum.accumulate(end + place)
    new = np.r_[True, start[1:] + place[1:] > reach[:-1] + 1]
    at = np.flatnonzero(new)
    stop = np.maximum.reduceat(end + place, at) - place[at]
    yield from zip(names[code[at]].tolist(), start[at].tolist(), stop.tolist(), strict=True)


def _table(names: list[str], starts: list[int], ends: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["__entity", "__start", "__end"])


def _collapse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: what one task holds of each entity, as disjoint intervals. A hot entity shrinks to its days."""
    maps: dict[str, IntervalMap] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        names, starts, ends = [], [], []
        for name, one in maps.items():
            names += [name] * len(one)
            starts += one.starts
            ends += one.ends
            if len(names) >= BATCH:
                yield _table(names, starts, ends)
                names, starts, ends = [], [], []
        if names:
            yield _table(names, starts, ends)

    for batch in batches:
        for name, start, end in _runs(*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))):
            one = maps.get(name)
            if one is None:
                one = maps[name] = IntervalMap()
            held -= len(one)
            one.add(start, end)
            held += len(one)
        if held > FLUSH_AT:
            yield from flush()
            maps, held = {}, 0
    yield from flush()


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """After the shuffle: the state of one entity at a time (rows come sorted by entity), given out when the next begins."""
    out: list[tuple[str, str, int, int]] = []
    entity, state = None, IntervalMap()

    def close() -> None:
        if entity is not None:
            out.extend((entity, "period", s, e) for s, e in zip(state.starts, state.ends, strict=True))
            out.extend((entity, "gap", s, e) for s, e in state.gaps())

    def give() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["__entity", "piece", "__start", "__end"])

    for batch in batches:
        for name, start, end in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if name != entity:
                close()
                entity, state = name, IntervalMap()
                if len(out) >= BATCH:
                    yield give()
                    out.clear()
            state.add(start, end)
    close()
    if out:
        yield give()


def periods_and_gaps(df: DataFrame, entity: Sequence[str], start: str, end: str) -> DataFrame:
    """The continuous periods of each entity's closed day intervals, and the gaps between two periods.

    Columns out: the entity columns, ``piece`` (``period`` or ``gap``), ``from_day`` and ``to_day`` (``YYYY-MM-DD``, both included).

    An ordered map of disjoint intervals is kept per entity; an insertion finds its overlaps by binary search. It is kept
    twice: first per task, so that only disjoint intervals are shuffled and an entity that holds a third of all rows shrinks
    to at most one interval per other day, then per entity over what came out of the tasks. In a task, the rows of a batch
    are merged by sort and running maximum first, and only these runs are inserted; after the shuffle the map is a variable
    of a scan over rows sorted by entity and start.

    A row with a null bound, or one that begins after it ends, covers no day. Intervals that touch day to day are continuous.
    A null entity column is a value like any other. An entity with no covered day, and an empty table, give no rows.
    """
    # One text, written as JSON, so that nulls stay apart from every text and parts can't run into each other.
    packed = F.to_json(F.array(*[F.col(c).cast("string") for c in entity]))
    days = df.where(F.col(start) <= F.col(end)).select(
        packed.alias("__entity"), F.unix_date(F.col(start).cast("date")).alias("__start"), F.unix_date(F.col(end).cast("date")).alias("__end")
    )
    schema = "__entity string, __start int, __end int"
    partial = days.mapInArrow(_collapse, schema)
    whole = partial.repartition("__entity").sortWithinPartitions("__entity", "__start").mapInArrow(_pieces, "__entity string, piece string, __start int, __end int")
    parts = F.from_json("__entity", "array<string>")
    names = [parts[k].cast(df.schema[c].dataType).alias(c) for k, c in enumerate(entity)]
    iso = lambda c: F.date_from_unix_date(c).cast("string")
    return whole.select(*names, "piece", iso("__start").alias("from_day"), iso("__end").alias("to_day"))
