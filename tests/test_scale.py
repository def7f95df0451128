"""What larger tables show: numbers beyond four digits and beyond an int, sums in a fixed order, plans that stay small."""

from __future__ import annotations

import re
import shutil
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfline.operators import exports, extras, masters, matching, stores
from shelfline.plans import registry

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _folder(at: Path, **changed: str) -> str:
    """A copy of the smallest folder in which some tables are made by SQL over it."""
    at.mkdir()
    for p in Path(SMALL).glob("*.parquet"):
        if p.stem in changed:
            duckdb.sql(f"COPY ({changed[p.stem].replace('{t}', str(p))}) TO '{at / p.name}' (FORMAT parquet)")
        else:
            shutil.copy(p, at / p.name)
    return str(at)


def _same(spark, folder: str, name: str) -> None:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = QUERIES[name](spark, folder)
    want = con.sql(SQL[name])
    rows = lambda rs: sorted(repr(tuple(r)) for r in rs)
    assert rows(got.collect()) == rows(want.select(*[f'"{c}"' for c in got.columns]).fetchall())


@pytest.fixture(scope="module")
def chain(tmp_path_factory):
    """One chain of 10,600 stores."""
    sql = "SELECT i AS c_custkey, 'Customer#' || lpad(CAST(i AS VARCHAR), 9, '0') AS c_name, CAST(0 AS INT) AS c_nationkey, 0e0 AS c_acctbal, 'X' AS c_mktsegment FROM range(10600) t(i)"
    return _folder(tmp_path_factory.mktemp("chain") / "t", customer=sql)


@pytest.mark.parametrize("name", ["sheet_flag_list", "sheet_allocation", "sheet_store_allocation", "sheet_shipments"])
def test_a_chain_of_more_stores_than_four_digits_count(spark, chain, name):
    _same(spark, chain, name)


def test_dispatch_of_a_chain_of_more_stores_than_four_digits_count(spark, chain):
    _same(spark, chain, "sheet_dispatch")


@pytest.mark.parametrize("name", ["import_errors", "import_headers"])
def test_row_numbers_beyond_an_int(spark, tmp_path, name):
    far = {"orders": "SELECT * REPLACE (o_orderkey + 54000000 AS o_orderkey) FROM '{t}'", "lineitem": "SELECT * REPLACE (l_orderkey + 54000000 AS l_orderkey) FROM '{t}'"}
    _same(spark, _folder(tmp_path / "t", **far), name)


def test_an_orders_total_is_added_line_by_line(spark):
    order = spark.sql("SELECT '1' AS id, 'C' AS client_id, '1' AS order_no, 'shipped' AS status, date '2024-01-01' AS arrival_due_date, 'x' AS ship_to_name, '' AS ship_to_center, '' AS ship_to_address")
    lines = spark.createDataFrame([("1", 3, "c", 1), ("1", 1, "a", 1), ("1", 2, "b", 1)], "order_id string, line_no int, jan string, qty int").coalesce(1)
    products = spark.createDataFrame([("C", "a", "a", 1e16, ""), ("C", "b", "b", 1.0, ""), ("C", "c", "c", -1e16, "")], "client_id string, jan string, name string, wholesale_price double, internal_sku string")
    none = spark.createDataFrame([], "code string, name string, postal_code string, address string, tel string")
    assert {r.c13 for r in exports.maker_rows(order, lines, products, none).collect()} == {"0"}


def test_a_name_of_many_products_is_one_row_before_it_meets_the_rows(spark):
    products = spark.createDataFrame([("C", "1", "same"), ("C", "2", "same"), ("C", "3", "own"), ("D", "4", "same")], "client_id string, jan string, name string")
    rows = spark.createDataFrame([("a", "C", "", "same"), ("b", "C", "", " own"), ("c", "D", "", "same"), ("d", "C", "2", "x"), ("e", "C", "", "")], "row_id string, client_id string, jan string, name string")
    found = masters.existing_product(rows, products)
    assert sorted(map(tuple, found.collect())) == [("b", "3", "name"), ("c", "4", "name"), ("d", "2", "jan")]
    named = _plan(found).split("Union")[1]
    assert re.search(r"Join Inner(.|\n)*Aggregate \[client_id", named[named.rindex("Join Inner") :])


def test_numbers_of_a_file_are_searched_one_by_one(spark):
    orders = spark.createDataFrame([("f", "12"), ("f", "3 4"), ("f", None), ("g", "99"), ("F x", "5")], "source_file string, order_no string")
    batches = spark.createDataFrame([(1, "f", "saved"), (2, "g", "saved"), (3, "F x", "saved"), (4, "none", "saved"), (5, "f", "open"), (6, None, "saved")], "id int, file_name string, status string")
    texts = {1: "f saved 12 3 4", 2: "g saved 99", 3: "f x saved 5", 4: "none saved", 6: "saved"}
    for q in ("2", "12", "2 3", "12 3 4", "d 12", "F", "x saved 5", "saved", "d 12 3", "f saved 12 3 4", "9 9", "", " SAVED ", "3 4 5"):
        got = {r.id for r in masters.order_files(batches, orders, q).select("id", "orders").collect()}
        assert got == {i for i, x in texts.items() if q.strip().lower() in x}, q
    assert "collect_list" not in _plan(masters.order_files(batches, orders, "1").select("id", "orders"))


def test_a_search_of_further_fields_makes_their_variant_once(spark):
    found = extras.search(extras.packed(spark.sql("SELECT id, concat('Made in ', id) AS country_of_origin, 'x' AS ingredients, 'n' AS name FROM range(5)")), "IN 3", ["name"])
    assert [r.id for r in found.select("id").collect()] == [3]
    assert _plan(found.select("id")).count("parse_json") <= 2


def test_the_cascade_of_store_matching_is_no_single_plan(spark):
    locations = spark.createDataFrame([("loft-1", "渋谷ロフト"), ("hands-7", "ハンズ 名古屋栄店")], "store_code string, store_name string")
    entries = spark.createDataFrame([("渋谷ロフト", ""), ("ハンズNorthgate名古屋栄", "")], "store_name string, store_code string")
    for found in (stores.resolve_stores(entries, locations), matching.resolve_locations(entries, locations)):
        assert found.count() == 2 and len(_plan(found).splitlines()) < 60


def test_texts_that_hold_others_are_found_like_by_brute_force(spark):
    from itertools import product

    words = ["".join(w) for n in range(1, 5) for w in product("ab", repeat=n)] + ["abcabcabc", "bcab", "cab", "zz", ""]
    a, b = spark.createDataFrame([(w,) for w in words[::2]], "x string"), spark.createDataFrame([(w,) for w in words[1::2]], "y string")
    want = {(x, y) for x in words[::2] for y in words[1::2] if x and y and x in y}
    assert {tuple(r) for r in matching._inside(a, "x", b, "y").select("x", "y").collect()} == want
    own, there = (d.withColumn("g", F.length(c) % 2) for d, c in ((a, "x"), (b, "y")))
    assert {tuple(r) for r in matching._inside(own, "x", there, "y", by=["g"]).select("x", "y").collect()} == {(x, y) for x, y in want if len(x) % 2 == len(y) % 2}


def test_only_orders_without_a_chain_gather_their_memos(spark):
    chains = spark.createDataFrame([("Mart A", ["Shop A"], 1)], "name string, aliases array<string>, ord int")
    orders = spark.createDataFrame([(1, ""), (2, ""), (3, " own ")], "order_id int, saved string")
    lines = spark.createDataFrame([(1, 1, "nothing"), (1, 2, "Mart A"), (2, 1, "Mart"), (2, 2, "A")], "order_id int, line_no int, memo string")
    found = stores.order_chains(orders, lines, chains)
    assert {r.order_id: r.chain for r in found.collect()} == {1: "Mart A", 2: "Mart A", 3: "own"}
    assert _plan(found).count("collect_list") == 0


def test_the_row_list_reads_its_entries_twice(spark):
    assert _plan(QUERIES["cells_row_list"](spark, SMALL)).count("l_orderkey") > 0
    assert len(re.findall(r"Relation \[.*l_orderkey", _plan(QUERIES["cells_row_list"](spark, SMALL)))) <= 4
