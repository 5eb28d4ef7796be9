"""Records that are identical but for whitespace, letter case, punctuation and the order of their fields."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.components import shared_folder
from chronoweave.operators.sizes import sent_if_small

# Signs that are no content, and invisible breaks; blanks of any kind are separators (Z) or controls (Cc).
_SIGN = r"[\p{P}$+<=>^`|~]"
_BLANK = r"[\p{Z}\p{Cc}\x{200B}\x{2060}\x{FEFF}]"
#: Blanks anywhere; a sign unless a digit stands on both sides of it. Letters and digits are passed over by one look.
NOISE = rf"(?![\p{{L}}\p{{Nd}}])(?:{_BLANK}|{_SIGN}(?:(?!\p{{Nd}})|(?<!\p{{Nd}}.)))"


def bare_text(text: Column) -> Column:
    """Lower case without whitespace and punctuation; a sign directly between two digits stays."""
    return F.regexp_replace(F.lower(text), NOISE, "")


def canonical_record(exact: Sequence[str], free: Sequence[str]) -> Column:
    """One text, equal for copies only: the exact columns in order, then the bare free columns in sorted order. Null equals
    only null, and values can't run into each other: the separator is a control character, which bare texts don't hold and
    which is written as two in exact ones."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("0"))
    fixed = [mark(F.replace(F.col(c).cast("string"), F.lit("\u0001"), F.lit("\u0001\u0001"))) for c in exact]
    moving = F.array_sort(F.array(*[mark(bare_text(F.col(c).cast("string"))) for c in free]))
    return F.concat_ws("\u0001|", *fixed, moving)


def _runs(key: pa.Array, last: str | None) -> np.ndarray:
    """Where another key begins, by comparing full keys of neighbours."""
    new = np.empty(len(key), dtype=bool)
    new[0] = key[0].as_py() != last
    new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
    return new


def _scan_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row with the first id of its run; at the end one row more for the first and the last run of the task, with the key.
    Only these can go on in a neighbouring task."""
    names = ["id", "rep", "edge"]
    last, rep, edges, last_id = None, None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        new = _runs(key, last)
        fresh = np.r_[ids[0] != last_id or new[0], (ids[1:] != ids[:-1]) | new[1:]]  # a row that is there twice counts once
        starts = np.flatnonzero(new)
        if rep is None:
            edges.append((rep := int(ids[0]), key[0].as_py()))
        reps = np.r_[rep, ids[starts]][np.cumsum(new)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[fresh]), pa.array(reps[fresh]), pa.nulls(int(fresh.sum()), pa.string())], names)
        last, rep, last_id = key[-1].as_py(), int(reps[-1]), ids[-1]
    if rep is not None:
        edges.append((rep, last))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(edges), pa.int64()), pa.array([r for r, _ in edges], pa.int64()), pa.array([k for _, k in edges], pa.string())], names)


def _sorted_records(df: DataFrame, row_id: str, exact: Sequence[str], free: Sequence[str]) -> DataFrame:
    rows = df.where(F.col(row_id).isNotNull()).select(canonical_record(exact, free).alias("__key"), F.col(row_id).cast("long").alias("__id"))
    return rows.repartitionByRange("__key", "__id").sortWithinPartitions("__key", "__id")


def copies(df: DataFrame, row_id: str, exact: Sequence[str], free: Sequence[str]) -> DataFrame:
    """Every record (``id``) with the smallest id of its copies (``rep``).

    Records are range-partitioned by (canonical text, id) and sorted; each task scans neighbours and compares full keys, so no
    two different records are ever taken for copies. Because the id is part of the range key, a group of copies that holds a
    third of all rows is cut over many tasks. What the scan gives out is written once, so that rows and the runs at the
    borders of tasks are of one and the same partitioning. Runs that may go on in the next task are the first and last of each
    task: at most two per task are gathered and joined back by their first id, sent to every task after they were measured.

    Rows with a null id are left out; a row that is there twice counts once. Empty texts, blank texts and texts of signs only
    are equal to each other and not to null. An empty table gives no rows.
    """
    shared_folder(df.sparkSession)
    scanned = _sorted_records(df, row_id, exact, free).mapInArrow(_scan_rows, "id long, rep long, edge string").checkpoint()
    edge = scanned.where(F.col("edge").isNotNull()).groupBy("edge").agg(F.min("rep").alias("first"), F.collect_set("rep").alias("reps"))
    moved = edge.select("first", F.explode("reps").alias("rep")).where("rep <> first").checkpoint()
    return scanned.where(F.col("id").isNotNull()).join(sent_if_small(moved), "rep", "left").select("id", F.coalesce("first", "rep").alias("rep"))


def distinct_records(df: DataFrame, row_id: str, exact: Sequence[str], free: Sequence[str]) -> DataFrame:
    """One row per distinct record: the smallest id of its copies (``rep``) and their exact number (``copies``)."""
    return copies(df, row_id, exact, free).groupBy("rep").agg(F.count("*").alias("copies"))
