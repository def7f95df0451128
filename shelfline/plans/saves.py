"""Tables after a save of order files, over files and orders made by SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import saves as op
from ..sources.testdata import Tables

_F = "(o_orderkey % 40)"
#: Half of the files hold orders that were confirmed; a third of the files is kept.
_FILES = f"SELECT DISTINCT concat('f', {_F}) AS file_id, concat('C', {_F} % 5) AS client_id, 'S' AS supplier_id, concat('file ', {_F}) AS file_name, CASE WHEN {_F} % 3 = 0 THEN concat('p/', {_F}) END AS path, 'op' AS operator_name, cast({_F} as int) AS at FROM orders"
_CURRENT = f"SELECT concat('o', o_orderkey) AS id, concat('C', {_F} % 5) AS client_id, 'S' AS supplier_id, cast(o_orderkey as {{S}}) AS order_no, CASE WHEN {_F} >= 20 AND o_orderkey % 7 = 0 THEN 'confirmed' ELSE 'imported' END AS status, 'old' AS source_file, CASE WHEN o_orderkey % 5 = 0 THEN 'old/path' END AS source_file_path FROM orders"
_NEW = f"SELECT concat('f', {_F}) AS file_id, concat('n', o_orderkey) AS id, concat(CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE '' END, o_orderkey) AS order_no FROM orders WHERE o_orderkey % 4 < 2"
_LINES = "SELECT concat({p}, l_orderkey) AS order_id, l_linenumber AS line_no, l_partkey AS part FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders{w})"


def _saved(t: Tables) -> dict[str, DataFrame]:
    for name in ("orders", "lineitem"):
        t.raw(name).createOrReplaceTempView(f"_{name}")
    read = lambda sql: t.spark.sql(sql.replace("{S}", "string").replace("FROM orders", "FROM _orders").replace("FROM lineitem", "FROM _lineitem"))
    batches = t.spark.createDataFrame([], "client_id string, supplier_id string, file_name string, status string, file_storage_path string, operator_name string, imported_at int")
    lines = lambda p, w: read(_LINES.replace("{p}", p).replace("{w}", w))
    return op.saved(read(_FILES), read(_NEW), lines("'n'", " WHERE o_orderkey % 4 < 2"), read(_CURRENT), lines("'o'", ""), batches)


_RULE = f"""WITH f AS ({_FILES}), c AS ({_CURRENT.replace("{S}", "VARCHAR")}), n AS ({_NEW}), m AS (SELECT n.*, f.client_id, f.supplier_id, file_name, path FROM n JOIN f USING (file_id)),
p AS (SELECT DISTINCT file_id FROM m JOIN c USING (client_id, supplier_id, order_no) WHERE status <> 'imported'),
o AS (SELECT f.*, CASE WHEN p.file_id IS NULL THEN 'saved' WHEN path IS NOT NULL THEN 'attached' ELSE 'refused' END AS outcome FROM f LEFT JOIN p USING (file_id)),
w AS (SELECT m.*, outcome FROM m JOIN o USING (file_id)),
s AS (SELECT coalesce(c.id, w.id) AS id, w.id AS new_id, w.client_id, w.supplier_id, w.order_no, 'imported' AS status, w.file_name AS source_file, coalesce(w.path, c.source_file_path) AS source_file_path FROM w LEFT JOIN c USING (client_id, supplier_id, order_no) WHERE outcome = 'saved')
"""
_ORDERS = (
    _RULE
    + """SELECT * EXCLUDE (new_id) FROM s UNION ALL SELECT c.id, c.client_id, c.supplier_id, c.order_no, c.status, CASE WHEN a.path IS NOT NULL THEN a.file_name ELSE c.source_file END, CASE WHEN a.path IS NOT NULL THEN a.path ELSE c.source_file_path END
FROM c LEFT JOIN (SELECT * FROM w WHERE outcome = 'attached') a ON a.client_id = c.client_id AND a.supplier_id = c.supplier_id AND a.order_no = c.order_no AND c.status <> 'imported' WHERE c.id NOT IN (SELECT id FROM s)"""
)
_ORDER_LINES = (
    _RULE
    + f""", nl AS ({_LINES.replace("{p}", "'n'").replace("{w}", " WHERE o_orderkey % 4 < 2")}), ol AS ({_LINES.replace("{p}", "'o'").replace("{w}", "")})
SELECT s.id AS order_id, line_no, part FROM nl JOIN s ON nl.order_id = s.new_id UNION ALL SELECT * FROM ol WHERE order_id NOT IN (SELECT id FROM s)"""
)

QUERIES = {
    "saved_orders": (lambda t: _saved(t)["orders"], _ORDERS),
    "saved_order_lines": (lambda t: _saved(t)["order_lines"], _ORDER_LINES),
    "saved_batches": (lambda t: _saved(t)["import_batches"].select("client_id", "file_name", "status", "file_storage_path"), _RULE + "SELECT client_id, file_name, 'saved' AS status, path AS file_storage_path FROM o WHERE outcome <> 'refused'"),
}
