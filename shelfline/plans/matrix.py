"""The matrix by strategy, over entries and locations made by SQL that both engines read: chains of each strategy, and stores that the locations lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matrix as op
from ..sources.testdata import Tables

PICKS = ["P1", "P3"]
_G = "({k} % 25)"
_CHAIN = f"CASE {_G} % 5 WHEN 0 THEN 'ロフト' WHEN 4 THEN 'ハンズ' ELSE concat('N', {_G}) END"
_NO = "lpad(cast({k} as {S}), 6, '0')"
_ENTRIES = f"""SELECT {_CHAIN} AS chain_name, {_NO} AS store_code, concat({_NO}, ' shop') AS store_name, CASE WHEN {{k}} % 3 = 0 THEN '1-2 own' ELSE '' END AS address, concat('P', l_partkey % 6) AS product_key, {_G} % 5 IN (2, 3) OR l_returnflag = 'N' AS is_introduced, (l_orderkey * 16 + l_linenumber) * 1000000 + l_partkey AS ord
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey) JOIN orders ON o_orderkey = l_orderkey""".replace("{k}", "o_custkey")
_LOCATIONS = f"""SELECT CASE WHEN {_G} % 5 = 0 THEN concat('loft-', {{k}}) ELSE {_NO} END AS store_code, concat({_NO}, ' shop') AS store_name, CASE WHEN {_G} % 5 = 0 THEN 'other' ELSE {_CHAIN} END AS chain_name, concat('2-3 ', {{k}}) AS address
FROM customer WHERE {_G} % 5 = 0 OR {_G} % 5 = 2 AND {{k}} % 7 <> 0 OR {_G} % 5 = 1 AND {{k}} % 2 = 0""".replace("{k}", "c_custkey")


def _tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    for name in ("orders", "lineitem", "customer"):
        t.raw(name).createOrReplaceTempView(f"_{name}")
    read = lambda sql: t.spark.sql(sql.replace("{S}", "string").replace("FROM lineitem", "FROM _lineitem").replace("JOIN orders", "JOIN _orders").replace("FROM customer", "FROM _customer"))
    return read(_ENTRIES), read(_LOCATIONS)


#: Names are their stores' own numbers, so a store is matched by its name within its chain.
_VIEWS = f"""WITH e AS ({_ENTRIES.replace("{S}", "VARCHAR")}), l0 AS ({_LOCATIONS.replace("{S}", "VARCHAR")}), l AS (SELECT * REPLACE (CASE WHEN starts_with(store_code, 'loft-') THEN 'ロフト' ELSE chain_name END AS chain_name) FROM l0),
s AS (SELECT chain_name, CASE WHEN chain_name IN ('ロフト', 'ハンズ', '@cosme STORE', 'アインズ') AND chain_name IN (SELECT chain_name FROM l) THEN 'official' WHEN count(*) >= 5 AND count(DISTINCT store_name) >= 5 AND bool_or(is_introduced) AND NOT bool_and(is_introduced) THEN 'list'
  WHEN chain_name IN (SELECT chain_name FROM l) THEN 'locations' ELSE 'entries' END AS strategy FROM e GROUP BY chain_name)
"""
_MATRIX = (
    _VIEWS
    + """, m AS (SELECT e.*, l.store_code AS m_code, l.address AS m_address FROM e LEFT JOIN l ON l.chain_name = e.chain_name AND l.store_name = e.store_name),
i AS (SELECT chain_name, store_name, product_key FROM m WHERE product_key IN ('P1', 'P3') GROUP BY ALL HAVING arg_max(is_introduced, ord)),
c AS (SELECT chain_name, store_name, string_agg(product_key, ',' ORDER BY product_key) AS products FROM i GROUP BY ALL),
b AS (SELECT l.chain_name, l.store_code, l.store_name, l.address, strategy AS origin FROM l JOIN s USING (chain_name) WHERE strategy IN ('official', 'locations')
  UNION ALL SELECT DISTINCT chain_name, store_code, store_name, coalesce(m_address, address), strategy FROM m JOIN s USING (chain_name) WHERE strategy IN ('list', 'entries')),
x AS (SELECT DISTINCT chain_name, coalesce(m_code, store_code) AS store_code, store_name, coalesce(m_address, address) AS address, 'supplement' AS origin FROM m WHERE is_introduced AND chain_name NOT IN ('ロフト', 'ハンズ') AND store_name NOT IN (SELECT store_name FROM b))
SELECT r.*, coalesce(products, '') AS products FROM (SELECT * FROM b UNION ALL SELECT * FROM x) r LEFT JOIN c USING (chain_name, store_name) WHERE origin <> 'supplement' OR products IS NOT NULL"""
)

QUERIES = {
    "matrix_strategies": (lambda t: op.strategies(*_tables(t)), _VIEWS + "SELECT * FROM s"),
    "introduction_matrix_rows": (lambda t: op.matrix(*_tables(t), PICKS).withColumn("products", F.array_join("products", ",")), _MATRIX),
}
