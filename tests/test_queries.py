"""Every query with SQL against DuckDB on the smallest folder."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from shelfline.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _rows(rows):
    return sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    cols = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*[f"`{c}`" for c in cols]).collect()]
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == cols
        assert _rows(rows) == _rows(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_whole_reports_read_more_than_the_newest_imports(spark):
    whole, newest = (QUERIES[f"sellout_{x}latest_imports"](spark, FOLDER) for x in ("whole_", ""))
    assert whole.count() > newest.count() and not newest.exceptAll(whole).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
