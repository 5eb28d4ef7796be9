"""Micro-batches into tables: each once, and never an empty delivery over a good one."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronoweave.sources.sinks import _files


def keep_versions(stream: DataFrame, path: str, checkpoint: str, refine: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Each micro-batch of what is there now as a version of its own under ``path``, refined first.

    A version is named by the number of its batch: a batch that is run again after a failure replaces its own version, and no
    other. A batch without rows leaves no version, so the last good one stays the newest.
    """

    def write(df: DataFrame, number: int) -> None:
        rows = refine(df)
        if not rows.isEmpty():
            rows.write.mode("overwrite").parquet(f"{path}/version={number:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_version(df_path: str, spark, columns: Sequence[str] | None = None) -> DataFrame | None:  # noqa: ANN001
    """The newest version under a path, or None if there is none."""
    fs, at = _files(spark, df_path)
    if not fs.exists(at(df_path)):
        return None
    names = sorted(PurePosixPath(s.getPath().toString()).name for s in fs.listStatus(at(df_path)))
    names = [n for n in names if n.startswith("version=")]
    if not names:
        return None
    found = spark.read.parquet(f"{df_path}/{names[-1]}")
    return found.select(*columns) if columns else found


def newest_rows(rows: DataFrame, by: Sequence[str], at: str, order: Sequence[str], most: int) -> DataFrame:
    """The newest ``most`` rows of each key (M7), the last by ``order`` of equals first: a bounded log. Spark keeps no more than
    ``most`` rows a key and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(at), *[F.desc(o) for o in order]))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def usable(snapshots: DataFrame, by: Sequence[str], now: Column, version: str, fresh_hours: int, kept_days: int) -> DataFrame:
    """Which snapshot of each key is to be shown (M2 to M4): of those written by this ``version`` and not empty the newest one that is
    fresh, else the newest one within ``kept_days``. ``snapshots``: ``by``, snapshot_no, cached_at, pipeline_version, events. Out: ``by``,
    ``snapshot_no``, ``status`` (``fresh``, ``cache``). Keys without any are left out."""
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("cached_at").cast("timestamp"))) / 3600
    good = snapshots.where((F.col("pipeline_version") == version) & (F.col("events") > 0)).withColumn("age", age).where((F.col("age") >= 0) & (F.col("age") <= kept_days * 24))
    best = good.groupBy(*by).agg(F.max_by(F.struct("snapshot_no", "age"), F.struct(-F.col("age"), "snapshot_no")).alias("b"))
    return best.select(*by, "b.snapshot_no", F.when(F.col("b.age") <= fresh_hours, "fresh").otherwise("cache").alias("status"))
