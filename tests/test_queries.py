"""Every registered query of the core against its SQL twin, on the smallest test data."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from chronoweave.plans import registry

DATA = Path(os.environ.get("TESTDATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_equals_sql(spark, duck, name):
    out = registry.QUERIES[name](spark, str(DATA))
    rows = [tuple(map(_plain, r)) for r in out.select(*sorted(out.columns)).collect()]
    result = duck.execute(registry.ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(out.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert sorted(rows, key=repr) == sorted((tuple(_plain(r[k]) for k in order) for r in result.fetchall()), key=repr)


def test_core_does_not_need_the_subpackage():
    root = Path(registry.__file__).resolve().parents[1]
    users = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "chronoweave.llm" in p.read_text(encoding="utf-8")]
    assert users == []
