"""One query for each numbered operator, the pipeline, and the SQL of those that have one."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from shelfline.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_names():
    names = set(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = queries.queries()[name](spark, FOLDER)
    cols = sorted(got.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want.select(*[f'"{c}"' for c in cols]).fetchall()))
