"""The same views as sources.testdata in SQL, for the comparison engine."""

from __future__ import annotations

VIEWS = {
    "clients": """SELECT 'C' || r_regionkey AS id, r_name AS name, CASE WHEN r_regionkey <> 0 THEN 8e-2 + 1e-2 * r_regionkey END AS fbp_fee_rate FROM region""",
    "suppliers": """SELECT 'S' || s_suppkey AS id, 'C' || n_regionkey AS client_id, s_name AS name, 'standard:C' || n_regionkey AS mapping_key FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "products": """SELECT 'C' || r_regionkey AS client_id, lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS jan, p_name AS name, p_brand AS internal_sku, p_type AS category,
  p_retailprice * (4e-1 + 5e-2 * (p_partkey % 5)) AS wholesale_price, CASE WHEN p_partkey % 20 <> 0 THEN p_retailprice END AS retail_price,
  CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS memo FROM part, region WHERE p_partkey % 5 <> r_regionkey""",
    "shop_orders": """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'C' || n_regionkey AS client_id, CAST(o_orderkey AS VARCHAR) AS order_no, CAST(o_orderdate AS DATE) AS order_date,
  CAST(o_orderdate AS DATE) + 3 AS arrival_due_date, CASE o_orderstatus WHEN 'F' THEN 'shipped' WHEN 'O' THEN 'confirmed' ELSE 'imported' END AS status,
  c_name AS ship_to_name, n_name AS warehouse, c_mktsegment AS store_name, 'file-' || (o_orderkey % 97) AS source_file,
  CASE WHEN o_orderkey % 3 = 0 THEN 'path/' || (o_orderkey % 97) END AS source_file_path, o_orderkey % 7 = 0 AS needs_review, o_orderdate AS imported_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "order_lines": """SELECT CAST(l_orderkey AS VARCHAR) AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS line_no,
  lpad(CAST(l_partkey AS VARCHAR), 13, '0') AS jan, CAST(l_quantity AS INTEGER) AS qty FROM lineitem""",
    "sellout_entries": """SELECT n_name || '-' || strftime(l_shipdate, '%Y%m') || '-' || (l_linenumber % 2) || '-C' || ((CAST(regexp_extract(n_name, '(\\d+)$', 1) AS INT) + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END) % 5) AS import_id,
  'C' || ((CAST(regexp_extract(n_name, '(\\d+)$', 1) AS INT) + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END) % 5) AS client_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS period_start, last_day(l_shipdate) AS period_end,
  n_name AS retailer, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS store_code, c_name AS store_name, CASE WHEN o_custkey % 4 <> 0 THEN 'Shop ' || o_custkey END AS matched_store_name,
  lpad(CAST(l_partkey AS VARCHAR), 13, '0') AS jan, CASE WHEN l_partkey % 6 <> 0 THEN p_name ELSE '' END AS product_name, CAST(l_quantity AS BIGINT) AS qty, CAST(floor(l_extendedprice) AS BIGINT) AS amount,
  l_linenumber % 2 AS version, l_linenumber AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey""",
    "store_locations": """SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS store_code, c_name AS store_name, n_name AS chain_name,
  CASE WHEN c_custkey % 5 <> 0 THEN '1-' || (c_custkey % 90) || '-3 ' || c_mktsegment END AS address FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "introductions": """SELECT 'I-' || n_name AS import_id, n_name AS chain_name, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS store_code, c_name AS store_name, lpad(CAST(l_partkey AS VARCHAR), 13, '0') AS jan,
  p_name AS product_name, p_brand AS internal_sku, l_returnflag = 'N' AS is_introduced, l_orderkey * 16 + l_linenumber AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey""",
    "import_batches": """SELECT 'B' || event_id AS id, CASE WHEN user_id % 11 = 0 THEN ' ' ELSE CASE WHEN event_id % 2 = 0 THEN 'Order ' ELSE 'order ' END || (user_id % 40) || '.PDF ' END AS file_name,
  CASE event_type WHEN 'error' THEN 'blocked' WHEN 'purchase' THEN 'saved' ELSE 'checked' END AS status, ts AS imported_at, event_id AS ord FROM events""",
    "sellout_imports": """SELECT import_id, client_id, retailer, period_start, period_end, version, count(*) AS entry_count, CAST(period_end AS TIMESTAMP) + version * INTERVAL 1 DAY AS imported_at FROM sellout_entries GROUP BY ALL""",
}


def using(names: str, query: str) -> str:
    """query after a WITH clause of the views named."""
    wanted = names.split()
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted) + "\n" + query
