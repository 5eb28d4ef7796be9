"""Broadcasts behind a measured size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A side of a join is sent to every task if it is no larger than so many bytes, counted beforehand.
MOST_BYTES = 32 * 2**20


def measured_bytes(df: DataFrame) -> int:
    """About how many bytes the rows take: the length of their texts, and 16 for every other value and every row."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, StringType)]
    width = reduce(lambda a, b: a + b, texts, F.lit(16 * (1 + len(df.columns))).cast("long"))
    return df.agg(F.sum(width)).first()[0] or 0


def sent_if_small(df: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """The table with a hint to broadcast it, if it was measured to be small; else as it is, to be joined by shuffle.

    It is read once more for that, so it should be a checkpoint.
    """
    return F.broadcast(df) if measured_bytes(df) <= most else df
