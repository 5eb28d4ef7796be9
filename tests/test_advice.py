"""Cases in which parts of the data used to be passed over."""

from __future__ import annotations

import datetime as dt
import pathlib
import shutil

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import components, orders, recurrence
from chronoweave.plans import registry
from chronoweave.sources import sinks
from tests.test_queries import DATA

EVENT = "snapshot_no int, received_at timestamp, event_id string, program_code string, course int, group_code string, stream_code string, event_date date, start_time string, end_time string, subject string, location_text string, teacher string, lesson_type string"


def test_stream_or_kind_alone_is_a_difference(spark, tmp_path):
    def row(number, event, stream, kind):
        return (number, dt.datetime(2026, 9, number), event, "p", 1, "101", stream, dt.date(2026, 9, 1), "09:00", "10:30", "s", "r", "t", kind)

    rows = [row(n, e, *v) for e, old, new in (("same", ("A", "x"), ("A", "x")), ("stream", ("A", "x"), ("B", "x")), ("kind", ("A", "x"), ("A", None))) for n, v in ((1, old), (3, new))]
    spark.createDataFrame(rows, EVENT).write.parquet(str(tmp_path / "event_snapshot.parquet"))
    got = {(r.event_id, r.stream_code, r.lesson_type, r.side) for r in registry.QUERIES["delivery_diff"](spark, str(tmp_path)).collect()}
    assert got == {("stream", "A", "x", "removed"), ("stream", "B", "x", "added"), ("kind", "A", "x", "removed"), ("kind", "A", None, "added")}


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_a_change_in_any_column_changes_the_fingerprint(spark, tmp_path):
    def marks():
        return {r.table_name: (r.fingerprint, r.all_tables) for r in registry.QUERIES["table_fingerprints"](spark, str(tmp_path)).collect()}

    for p in DATA.glob("*.parquet"):
        (shutil.copytree if p.is_dir() else shutil.copy)(p, tmp_path / p.name)
    before = marks()
    for name, column in (("roster", "stream_code"), ("schedule_event", "confidence")):
        at = tmp_path / f"{name}.parquet"
        changed = spark.read.parquet(str(DATA / at.name))
        changed = changed.withColumn(column, F.lit(None).cast(changed.schema[column].dataType))
        shutil.rmtree(at) if at.is_dir() else at.unlink()
        changed.write.parquet(str(at))
        spark.catalog.refreshByPath(str(at))
    after = marks()
    assert {name for name in before if before[name][0] != after[name][0]} == {"roster", "schedule_event"}
    assert {v[1] for v in before.values()} != {v[1] for v in after.values()}


def test_items_of_lists_do_not_run_into_each_other(spark):
    mark = lambda v: sinks.fingerprint(spark.createDataFrame([(v,)], "v array<string>"), ["v"]).first().fingerprint
    assert mark(["a, b"]) != mark(["a", "b"])


def test_subjects_of_events_are_listed(spark, tmp_path):
    for name, subjects in (("schedule_event", ["яды", "ёлки", None, " "]), ("manual_rule", ["жуки", "ёлки", "Азы"])):
        spark.createDataFrame([(s,) for s in subjects], "subject string").write.parquet(str(tmp_path / f"{name}.parquet"))
    got = [r.subject for r in registry.QUERIES["all_subjects_in_order"](spark, str(tmp_path)).collect()]
    assert got == ["Азы", "ёлки", "жуки", "яды"]


def test_unfinished_components_are_an_error(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "a int, b int")
    with pytest.raises(RuntimeError, match="unfinished after 2 rounds"):
        components.connected_components(chain, "a", "b", rounds=2)
    assert {r.component for r in components.connected_components(chain, "a", "b").collect()} == {0}


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}  # noqa: RUF012

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        components.shared_folder(Session())


def test_files_of_finished_rounds_are_deleted(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a int, b int")
    folder = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {p.name for p in folder.glob("rdd-*")}
    assert components.connected_components(chain, "a", "b").count() == 41
    assert len({p.name for p in folder.glob("rdd-*")} - before) == 1


def test_shares_of_the_corpus_show_who_falls_short(spark, tmp_path):
    llm = pytest.importorskip("chronoweave.llm.queries")
    docs = [(n, "слово " * 20, "big") for n in range(90)] + [(100 + n, "слово " * 20, "small") for n in range(10)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 2)], "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_target.parquet"))
    got = {r.source: r for r in llm.QUERIES["p8_shares_of_corpus"](spark, str(tmp_path)).collect()}
    held = got["big"].available + got["small"].available
    assert got["big"].budget == pytest.approx(0.6 * held, abs=1)
    assert got["small"].reached == 2 * got["small"].available < 0.4 * held
    assert not got["small"].met


def test_orders_of_events_and_tasks(spark):
    lessons = spark.createDataFrame([(1, None, 0, "a"), (2, 0, 0, "б"), (3, 2, None, "a"), (4, 2, 6, "я"), (5, 2, 6, "ё"), (6, 2, 6, None)], "id int, week_number int, weekday int, subject string").selectExpr("*", "'09:00' AS start_time", "'1' AS group_code", "DATE '2026-09-01' AS event_date")
    ids = lambda df, order: [r.id for r in df.orderBy(*order).collect()]
    assert ids(lessons, orders.by_week_and_group()) == [6, 4, 5, 3, 1, 2]
    assert ids(lessons.where("id IN (4, 5)"), orders.by_date_and_group()) == [4, 5]
    assert ids(lessons.where("id IN (4, 5)"), orders.by_date()) == ids(lessons.where("id IN (4, 5)"), orders.by_week()) == [5, 4]
    tasks = spark.createDataFrame([(1, None, 1), (2, "2026-09-02", 1), (3, "2026-09-01", 1), (4, "2026-09-01", 2), (5, None, 2)], "id int, due string, created_at int")
    assert ids(tasks, orders.by_due()) == [4, 3, 2, 5, 1]


def test_titles_of_one_start_are_in_russian_order(spark):
    rows = spark.createDataFrame([("o", "я"), ("o", "ё"), ("o", "а"), ("o", "Б")], "owner_id string, title string")
    rows = rows.selectExpr("*", "TIMESTAMP '2026-09-01 09:00:00Z' AS start_at", "TIMESTAMP '2026-09-01 10:00:00Z' AS end_at")
    got = [r.title for r in recurrence.in_range(rows, "o", "2026-09-01T00:00:00Z", "2026-09-02T00:00:00Z").collect()]
    assert got == ["а", "Б", "ё", "я"]
