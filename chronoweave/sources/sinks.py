"""Writing: whole or not at all, and never an empty delivery over a good one."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from chronoweave.functions.text import ics_text


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def publish(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write beside the target and swap by renaming, so that readers never see half of a delivery: they see the old one, the
    new one, or, between the two renames, none. If the second rename fails, the old delivery is put back."""
    fs, at = _files(df.sparkSession, path)
    staged, old = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}"
    df.write.format(kind).save(staged)
    there = fs.exists(at(path))
    if there and not fs.rename(at(path), at(old)):
        fs.delete(at(staged), True)
        raise OSError(f"{path} could not be replaced")
    if not fs.rename(at(staged), at(path)):
        if there:
            fs.rename(at(old), at(path))
        fs.delete(at(staged), True)
        raise OSError(f"{path} could not be published")
    fs.delete(at(old), True)


def publish_parts(df: DataFrame, path: str, by: list[str], expected: DataFrame | None = None) -> DataFrame:
    """Replace only those parts of a partitioned table that have rows now: a part that came out empty keeps its last good rows.

    Returns the report: the keys ``by``, ``rows`` written and ``status`` (written, kept), for the parts of ``expected`` too.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    counts = df.groupBy(*by).agg(F.count("*").alias("rows"))
    keys = counts.select(*by) if expected is None else counts.select(*by).unionByName(expected.select(*by)).distinct()
    return keys.join(counts, by, "left").select(*by, F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("rows") > 0, "written").otherwise("kept").alias("status"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of rows and a fingerprint of their content in any order (``total_rows``, ``fingerprint``, 16 digits).

    Row hashes are summed in halves, so that equal tables have equal fingerprints without sorting or gathering rows. Lists
    and structures are hashed as JSON, in which their items can't run into each other.
    """
    nested = {f.name for f in df.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))}
    as_text = lambda c: F.to_json(c) if c in nested else F.col(c).cast("string")
    digest = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), as_text(c)), F.lit("0")) for c in columns]), 256)
    half = lambda k: F.conv(F.substring(digest, k, 8), 16, 10).cast("decimal(38,0)")
    sums = df.agg(F.count("*").alias("n"), F.sum(half(1)).alias("a"), F.sum(half(9)).alias("b"))
    return sums.select(F.col("n").alias("total_rows"), F.substring(F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256), 1, 16).alias("fingerprint"))


def table_diff(before: DataFrame, after: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows that only one of two tables has, as often as it has more of them: the columns and ``side`` (removed, added).

    Both tables are read once and counted against each other in one aggregation with a combine before the shuffle.
    """
    columns = [c for c in after.columns if c not in ignore]
    both = before.select(*columns, F.lit(-1).alias("__n")).unionByName(after.select(*columns, F.lit(1).alias("__n")))
    more = both.groupBy(*columns).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    times = F.explode(F.sequence(F.lit(1), F.abs("__n").cast("int")))
    return more.select(*columns, F.when(F.col("__n") > 0, "added").otherwise("removed").alias("side"), times.alias("__t")).drop("__t")


def ics_entries(events: DataFrame, zone: str = "Europe/Moscow") -> DataFrame:
    """Each event as a calendar entry: ``event_id``, ``entry``. Events without day or clocks have none."""

    def stamp(clock: str) -> Column:
        local = F.try_to_timestamp(F.concat_ws(" ", F.col("event_date").cast("string"), clock), F.lit("yyyy-MM-dd HH:mm"))
        return F.date_format(F.to_utc_timestamp(local, zone), "yyyyMMdd'T'HHmmss'Z'")

    lines = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "event_id"), F.concat(F.lit("DTSTART:"), stamp("start_time")), F.concat(F.lit("DTEND:"), stamp("end_time")), F.concat(F.lit("SUMMARY:"), ics_text(F.col("subject"))), F.concat(F.lit("LOCATION:"), ics_text(F.coalesce("location_text", F.lit("")))), F.lit("END:VEVENT"))
    return events.where(stamp("start_time").isNotNull() & stamp("end_time").isNotNull()).select("event_id", lines.alias("entry"))


def write_ics(events: DataFrame, path: str, zone: str = "Europe/Moscow") -> None:
    """Calendar entries as text files; each is whole in one file."""
    ics_entries(events, zone).select("entry").write.text(path)
