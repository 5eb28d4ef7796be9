"""Keyed state over streams: interval maps and fixed windows from the first hit."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoweave.operators.intervals import IntervalMap


def _grow(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    one = IntervalMap(*([int(x) for x in part] for part in state.get)) if state.exists else IntervalMap()
    for frame in frames:
        for a, z in zip(frame["a"].tolist(), frame["z"].tolist(), strict=True):
            one.add(int(a), int(z))
    state.update((one.starts, one.ends))
    pieces = [("period", a, z) for a, z in zip(one.starts, one.ends, strict=True)] + [("gap", a, z) for a, z in one.gaps()]
    yield pd.DataFrame([(key[0], *p) for p in pieces], columns=["entity", "piece", "a", "z"])


def live_periods(stream: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """The periods and gaps of each entity that got intervals in the micro-batch, as of then: ``entity``, ``piece``,
    ``from_day``, ``to_day``. The state of an entity is its ordered map of disjoint intervals."""
    days = stream.where(F.col(entity).isNotNull() & (F.col(start) <= F.col(end))).select(F.col(entity).cast("string").alias("entity"), F.unix_date(start).alias("a"), F.unix_date(end).alias("z"))
    out = days.groupBy("entity").applyInPandasWithState(_grow, "entity string, piece string, a int, z int", "starts array<int>, ends array<int>", "update", GroupStateTimeout.NoTimeout)
    return out.select("entity", "piece", F.date_from_unix_date("a").cast("string").alias("from_day"), F.date_from_unix_date("z").cast("string").alias("to_day"))


def rate_windows(stream: DataFrame, key: str, at: str, limit: int, window_ms: int = 60_000) -> DataFrame:
    """Whether each hit of a key is within the limit of its window, which begins with the key's first hit and again with the
    first hit after it has ended: ``key``, ``at_ms``, ``hit`` (its number in the window), ``allowed``."""

    def count(k: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        began, n = state.get if state.exists else (None, 0)
        for frame in frames:
            out = []
            for t in sorted(frame["at_ms"].tolist()):
                if began is None or t - began >= window_ms:
                    began, n = t, 0
                n += 1
                out.append((k[0], t, n, n <= limit))
            yield pd.DataFrame(out, columns=["key", "at_ms", "hit", "allowed"])
        state.update((began, n))

    hits = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"))
    return hits.groupBy("key").applyInPandasWithState(count, "key string, at_ms long, hit long, allowed boolean", "began long, n long", "update", GroupStateTimeout.NoTimeout)


def tumbling(stream: DataFrame, at: str, by: list[str], length: str, late: str | None = None) -> DataFrame:
    """Counts per fixed window of the clock; with ``late`` given, windows are closed so long after their end."""
    rows = stream.withWatermark(at, late) if late else stream
    counted = rows.groupBy(F.window(at, length).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), *by, "n")


def sessions(stream: DataFrame, at: str, by: list[str], gap: str, late: str | None = None) -> DataFrame:
    """Counts per session: hits of a key with less than ``gap`` between neighbours."""
    rows = stream.withWatermark(at, late) if late else stream
    counted = rows.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")
