"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.clock import clock_identity
from chronoweave.operators.components import shared_folder
from chronoweave.operators.sizes import sent_if_small

def content_hash(df: DataFrame, columns: Sequence[str], clocks: Sequence[str] = ()) -> F.Column:
    """A 64-bit hash of the row's content. Nulls count (a null equals only a null); clocks count as times of day."""
    parts: list[F.Column] = []
    for name in columns:
        value = clock_identity(F.col(name)) if name in clocks else F.col(name)
        parts += [value, F.col(name).isNull()]
    return F.xxhash64(*parts)


def deliveries(df: DataFrame, snapshot: str) -> DataFrame:
    """One row per delivered snapshot: ``__snap``, the one before it ``__prev`` and after it ``__next`` (null at the ends).

    Only the snapshot column is read, and reduced before the shuffle. The list itself is in one task: it has one row per
    delivery, whatever the size of the deliveries. It is written once.
    """
    shared_folder(df.sparkSession)
    distinct = df.where(F.col(snapshot).isNotNull()).select(F.col(snapshot).cast("long").alias("__snap")).distinct()
    order = Window.orderBy("__snap")
    return distinct.select("__snap", F.lag("__snap").over(order).alias("__prev"), F.lead("__snap").over(order).alias("__next")).checkpoint()


def snapshot_changes(df: DataFrame, key: str, snapshot: str, content: Sequence[str], clocks: Sequence[str] = ()) -> DataFrame:
    """Records added, removed or changed between each delivered snapshot and the delivered one just before it.

    Every key is windowed by the place of its snapshots in the list of deliveries: a lagged hash that differs is a change,
    a gap in the places is a removal and, where the key comes back, a later addition.

    Columns out: ``snapshot`` (of the later delivery), ``key``, ``change_kind`` (added, removed, changed).
    Numbers left out in the deliveries are no deliveries. The first delivery has no cases. Repeated rows of a key in a
    snapshot count once, whenever they arrived; if their contents differ, all of them are compared: the number of different
    contents and the exclusive or of their hashes. Rows with a null key are no records, though their snapshot counts as delivered; rows with a null snapshot
    are left out. An empty table gives no rows.
    """
    kind = df.schema[snapshot].dataType
    rows = (
        df.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull())
        .select(F.col(key).alias("__key"), F.col(snapshot).cast("long").alias("__snap"), content_hash(df, content, clocks).alias("__hash"))
        .groupBy("__key", "__snap")
        .agg(F.struct(F.count_distinct("__hash"), F.expr("bit_xor(DISTINCT __hash)")).alias("__content"))
        .join(sent_if_small(deliveries(df, snapshot)), "__snap")
    )
    by = Window.partitionBy("__key").orderBy("__snap")
    before, after = F.lag("__snap").over(by), F.lead("__snap").over(by)
    seen = rows.select(
        "__key", "__snap", "__prev", "__next", before.alias("__before"), after.alias("__after"),
        (F.lag("__content").over(by) != F.col("__content")).alias("__differs"),
    )
    came = F.col("__prev").isNotNull() & ~F.col("__before").eqNullSafe(F.col("__prev"))
    changed = F.col("__before").eqNullSafe(F.col("__prev")) & F.col("__differs")
    left = F.col("__next").isNotNull() & ~F.col("__after").eqNullSafe(F.col("__next"))
    case = lambda at, what: F.struct(F.col(at).alias("at"), F.lit(what).alias("what"))
    own = F.when(came, case("__snap", "added")).when(changed, case("__snap", "changed"))
    return (
        seen.where(came | changed | left)
        .select("__key", F.explode(F.array_compact(F.array(own, F.when(left, case("__next", "removed"))))).alias("__case"))
        .select(F.col("__case.at").cast(kind).alias(snapshot), F.col("__key").alias(key), F.col("__case.what").alias("change_kind"))
    )
