"""Snapshots, references and intervals: defined results for odd rows, and brute force on random ones."""

from __future__ import annotations

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoweave.operators.intervals import IntervalMap, periods_and_gaps
from chronoweave.operators.references import orphan_rows, unheld_references
from chronoweave.operators.snapshots import snapshot_changes

SNAP = "no int, id string, clock string, body string, extra string"


def changes(spark, rows):
    frame = spark.createDataFrame(rows, SNAP)
    return sorted(tuple(r) for r in snapshot_changes(frame, "id", "no", ["clock", "body"], ["clock"]).collect())


def test_snapshots(spark):
    rows = [(1, "a", "08:30", "x", "1"), (1, "a", "8.30", "x", "2"), (1, "b", None, None, ""), (1, "c", "9:00", "y", ""), (3, "a", "08:30:00", "x", ""), (3, "b", None, "", ""), (3, "d", "1:00", "z", ""), (7, "c", "9:00", "y", ""), (7, "b", None, "", "")]
    assert changes(spark, rows) == [(3, "b", "changed"), (3, "c", "removed"), (3, "d", "added"), (7, "a", "removed"), (7, "c", "added"), (7, "d", "removed")]
    assert changes(spark, []) == []
    # A delivery whose rows have no key is a delivery all the same.
    assert changes(spark, [(1, "a", None, None, None), (None, "a", "", "", ""), (2, None, "", "", "")]) == [(2, "a", "removed")]


def test_snapshots_equal_brute_force(spark):
    rnd = random.Random(2)
    rows = [(no, f"k{rnd.randrange(40)}", rnd.choice(["08:30", "8.30", " 08:30", "9:00", None]), rnd.choice(["x", None]), "") for no in (2, 3, 5, 9) for _ in range(40)]
    once = {}
    for no, key, clock, body, _ in rows:
        once.setdefault((no, key), (no, key, clock, body, ""))  # one content per key and snapshot
    rows = [*once.values(), *list(once.values())[:20]]
    same = lambda r: (r[2] and r[2].strip().replace(".", ":").zfill(5), r[3])
    wanted = []
    for before, no in ((2, 3), (3, 5), (5, 9)):
        old, new = ({k: same(r) for (n, k), r in once.items() if n == x} for x in (before, no))
        wanted += [(no, k, "added") for k in new.keys() - old.keys()] + [(no, k, "removed") for k in old.keys() - new.keys()] + [(no, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]]
    assert changes(spark, rows) == sorted(wanted)


def test_every_content_of_a_snapshot_counts(spark):
    rows = [(1, "a", "8:00", b, "") for b in "xyzw"] + [(2, "a", "8:00", b, "") for b in "xyvw"] + [(3, "a", "8:00", b, "") for b in "wvyxx"]
    assert [c for body in ("xyz", "zyx", "xvz", "xz") for c in changes(spark, [(1, "b", None, b, "") for b in "xyz"] + [(2, "b", None, b, "") for b in body])] == [(2, "b", "changed")] * 2
    assert changes(spark, rows) == [(2, "a", "changed")]


def _days(intervals):
    return {d for a, z in intervals for d in range(a, z + 1)}


def _pieces(days):
    out, run = [], []
    for d in sorted(days):
        if run and d == run[-1] + 1:
            run.append(d)
            continue
        if run:
            out += [("period", run[0], run[-1]), ("gap", run[-1] + 1, d - 1)]
        run = [d]
    return [*out, ("period", run[0], run[-1])] if run else []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 8)), max_size=30))
def test_interval_map(pairs):
    one = IntervalMap()
    for a, n in pairs:
        one.add(a, a + n)
    days = _days((a, a + n) for a, n in pairs)
    assert _days(zip(one.starts, one.ends, strict=True)) == days
    got = [("period", a, z) for a, z in zip(one.starts, one.ends, strict=True)] + [("gap", a, z) for a, z in one.gaps()]
    assert sorted(got) == sorted(_pieces(days))


def test_periods_equal_brute_force(spark):
    rnd, zero = random.Random(4), dt.date(2026, 9, 1)
    day = lambda n: None if n is None else zero + dt.timedelta(n)
    rows = [(rnd.choice(["x", "y", "z", None, ""]), rnd.choice([1, None]), a := rnd.choice([None, *range(200)]), None if a is None else a + rnd.choice([-3, 0, 1, 2, 9])) for _ in range(300)]
    rows += [("x", 1, 0, 1)] * 50  # a hot entity
    frame = spark.createDataFrame([(e, n, day(a), day(z)) for e, n, a, z in rows], "e string, n int, a date, z date").repartition(7)
    got = sorted((str(r.e), str(r.n), r.piece, r.from_day, r.to_day) for r in periods_and_gaps(frame, ["e", "n"], "a", "z").collect())
    wanted = []
    for key in {(e, n) for e, n, _, _ in rows}:
        days = _days((a, z) for e, n, a, z in rows if (e, n) == key and a is not None and a <= z)
        wanted += [(str(key[0]), str(key[1]), piece, str(day(a)), str(day(z))) for piece, a, z in _pieces(days)]
    assert got == sorted(wanted)
    assert periods_and_gaps(frame.limit(0), ["e", "n"], "a", "z").count() == 0


def test_references_equal_brute_force(spark):
    rnd, zero = random.Random(6), dt.date(2026, 9, 1)
    day = lambda n: None if n is None else zero + dt.timedelta(n)
    keys = [f"k{n}" for n in range(30)]
    refs = [(rnd.choice([*keys, None, "hot"]), rnd.choice([None, *range(40)])) for _ in range(400)] + [("hot", 7)] * 200
    targets = [(rnd.choice([*keys[:20], None, "hot"]), rnd.choice([None, *range(40)]), rnd.choice([None, *range(40)])) for _ in range(40)]
    got = unheld_references(
        spark.createDataFrame([(k, day(d)) for k, d in refs], "key string, day date").repartition(5),
        spark.createDataFrame([(k, day(a), day(z)) for k, a, z in targets], "k string, a date, z date"),
        "key", "day", "k", "a", "z",
    )
    wanted = set()
    for key, d in set(refs):
        mine = [(a, z) for k, a, z in targets if k == key]
        if key is None or (d is None and mine):
            continue
        if not mine:
            wanted.add((key, day(d), "missing"))
        elif not any((a is None or a <= d) and (z is None or z > d) for a, z in mine):
            wanted.add((key, day(d), "deleted" if any(z is not None and z <= d for _, z in mine) else "late"))
    assert {tuple(r) for r in got.collect()} == wanted
    rows = spark.createDataFrame([(n, k, day(d), "clash") for n, (k, d) in enumerate(refs)], "n int, key string, day date, reason_ string")
    assert {r.n for r in orphan_rows(rows, got, "key", "day").collect()} == {n for n, (k, d) in enumerate(refs) if any((k, day(d)) == w[:2] for w in wanted)}
    empty = spark.createDataFrame([], "k string, a date, z date")
    assert unheld_references(rows, empty, "key", "day", "k", "a", "z").where("reason <> 'missing'").count() == 0
    assert unheld_references(rows.limit(0), empty, "key", "day", "k", "a", "z").count() == 0


def test_keys_that_share_a_hash_and_odd_keys(spark):
    import numpy as np
    import pyarrow as pa

    from chronoweave.operators.references import _Targets

    keys, hashes = ["b", "a", "c\0", "c", "", "a"], [7, 7, 7, 9, 1, 7]
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(hashes, pa.int64()), pa.array([1] * 6, pa.int32()), pa.array([None] * 6, pa.int32())], ["__ref", "__hash", "__from", "__to"])
    found = _Targets([batch])
    asked = ["c\0", "a", "b", "c", "d", "x", "", "z"]
    place, there = found.find(np.array([7, 7, 7, 9, 7, 3, 1, 99]), pa.array(asked))
    assert there.tolist() == [True, True, True, True, False, False, True, False]
    assert [found.key[int(p)].as_py() for p, t in zip(place, there, strict=True) if t] == ["c\0", "a", "b", "c", ""]
    row = spark.createDataFrame([("a\u0001=b", "c", "a", "b\u0001=c", "\u0002")], "a string, b string, c string, d string, e string")
    from chronoweave.operators.references import packed_key

    packed = row.select(packed_key(F.col("a"), F.col("b")), packed_key(F.col("c"), F.col("d")), packed_key(F.col("e")), packed_key(F.lit("\u0002\u0002"))).first()
    assert len(set(packed)) == 4


def test_entities_of_any_length(spark):
    long = "x" * 1_500_000 + "\u0001\u0002\n\""
    frame = spark.createDataFrame([(long, None, dt.date(2026, 1, 1), dt.date(2026, 1, 2))], "e string, n int, a date, z date")
    (row,) = periods_and_gaps(frame, ["e", "n"], "a", "z").collect()
    assert (row.e, row.n, row.to_day) == (long, None, "2026-01-02")


def test_extra_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a", "8:00", "x", "e"), (2, "a", "8:00", "y", "e")], SNAP).withColumn("change_kind", F.lit("mine")).withColumn("snapshot_no", F.lit(5))
    assert [tuple(r) for r in snapshot_changes(frame, "id", "no", ["clock", "body"], ["clock"]).collect()] == [(2, "a", "changed")]
    days = spark.createDataFrame([("e", dt.date(2026, 1, 1), dt.date(2026, 1, 2), "p")], "entity string, from_day date, to_day date, piece string")
    assert [tuple(r) for r in periods_and_gaps(days, ["entity"], "from_day", "to_day").collect()] == [("e", "period", "2026-01-01", "2026-01-02")]
