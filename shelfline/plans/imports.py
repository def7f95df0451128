"""Import, upsert and dedupe queries. Order rows with faults are derived from the orders and lines of the folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import imports as op
from ..sources.testdata import Tables
from .views import using


def _rows(t: Tables) -> DataFrame:
    """Rows under the sample supplier's headings; every 11th order has no ship-to, every 13th a bad date, some quantities are off."""
    o = t.orders().withColumn("n", F.col("id").cast("long"))
    rows = t.order_lines().join(o.select(F.col("id").alias("order_id"), "order_date", "arrival_due_date", "ship_to_name", "warehouse", "n"), "order_id")
    text = lambda d: F.date_format(d, "yyyy/MM/dd")
    return rows.select(
        F.concat(F.lit("file-"), F.col("n") % 499).alias("file_id"),
        (F.col("n") * 64 + F.col("line_no")).alias("row_idx"),
        F.concat(F.lit("　"), F.col("order_id"), F.lit(" ")).alias("発注No"),
        F.when(F.col("n") % 131 == 0, "someday").otherwise(text(F.col("order_date"))).alias("発注日"),
        text(F.col("arrival_due_date")).alias("着荷指定日"),
        F.when(F.col("n") % 113 == 0, "").otherwise(F.col("ship_to_name")).alias("お届け先会社名"),
        F.when(F.col("n") % 2 == 0, "30").otherwise(F.col("warehouse")).alias("倉庫"),
        F.col("jan").alias("JANコード"),
        F.when((F.col("n") % 127 == 0) & (F.col("line_no") == 1), "1.5").otherwise(F.col("qty").cast("string")).alias("数量"),
    )


def _normal(t: Tables) -> DataFrame:
    return op.normalise(_rows(t), op.mapping_of("standard:C0"))


def _faults(t: Tables) -> DataFrame:
    return op.errors(_normal(t))


_BASE = """, src AS (SELECT 'file-' || (CAST(o.id AS INT) % 499) AS file_id, CAST(o.id AS BIGINT) * 64 + line_no AS row_idx, o.id AS order_no, CAST(o.id AS INT) AS n, line_no, jan, qty, order_date, arrival_due_date, ship_to_name,
  CASE WHEN CAST(o.id AS INT) % 2 = 0 THEN '埼玉センター(No.30)' ELSE warehouse END AS warehouse FROM order_lines l JOIN shop_orders o ON o.id = l.order_id),
faults AS (SELECT file_id, row_idx + 2 AS row_number, 'ship_to_name' AS field, 'required' AS message, true AS drops FROM src WHERE n % 113 = 0 UNION ALL
  SELECT file_id, row_idx + 2, 'qty', 'not a whole number above 0', true FROM src WHERE n % 127 = 0 AND line_no = 1 UNION ALL SELECT file_id, row_idx + 2, 'order_date', 'not a date', false FROM src WHERE n % 131 = 0),
clean AS (SELECT * FROM src WHERE file_id NOT IN (SELECT file_id FROM faults))
"""


def _sql(tail: str, names: str = "shop_orders order_lines") -> str:
    return using(names, _BASE + tail)


def _with_client(t: Tables) -> DataFrame:
    return t.order_lines().join(t.orders().select(F.col("id").alias("order_id"), "client_id"), "order_id")


def _batches(t: Tables) -> DataFrame:
    """One batch for each client and file of its orders; every other one has the stored path."""
    o = t.orders().groupBy("client_id", "source_file").agg(F.max("source_file_path").alias("p"))
    n = F.substring("source_file", 6, 9).cast("int")
    return o.select(F.concat_ws("/", "client_id", "source_file").alias("id"), "client_id", F.col("source_file").alias("file_name"), F.when(n % 2 == 0, F.col("p")).alias("file_path"))


def _renames(t: Tables) -> DataFrame:
    p = F.col("jan").cast("long")
    return t.products().where(p % 50 == 1).select("client_id", F.col("jan").alias("old_jan"), F.when(p % 100 == 1, F.concat(F.lit("9"), F.substring("jan", 2, 12))).otherwise(F.lpad((p + 5).cast("string"), 13, "0")).alias("new_jan"))


_RENAMES = "SELECT client_id, jan AS old_jan, CASE WHEN CAST(jan AS BIGINT) % 100 = 1 THEN '9' || substr(jan, 2, 12) ELSE lpad(CAST(CAST(jan AS BIGINT) + 5 AS VARCHAR), 13, '0') END AS new_jan FROM products WHERE CAST(jan AS BIGINT) % 50 = 1"


def _new_products(t: Tables) -> DataFrame:
    p = F.col("jan").cast("long")
    return t.products().where(p % 10 == 3).withColumn("jan", F.when(p % 20 == 3, F.col("jan")).otherwise(F.concat(F.lit("8"), F.substring("jan", 2, 12)))).withColumn("name", F.upper("name"))


def _locations(t: Tables) -> DataFrame:
    n = F.col("store_code").cast("int")
    return t.store_locations().where(n % 7 == 0).select(
        F.when(n % 14 == 0, F.col("store_code")).when(n % 21 == 0, "").otherwise(F.concat(F.lit("N"), "store_code")).alias("store_code"),
        F.upper("store_name").alias("store_name"),
        F.when(n % 28 == 0, "").otherwise("NEW CHAIN").alias("chain_name"),
        "address",
        n.alias("ord"),
    )


_NEW_LOCATIONS = """SELECT CASE WHEN CAST(store_code AS INT) % 14 = 0 THEN store_code WHEN CAST(store_code AS INT) % 21 = 0 THEN '' ELSE 'N' || store_code END AS store_code, upper(store_name) AS store_name,
  CASE WHEN CAST(store_code AS INT) % 28 = 0 THEN '' ELSE 'NEW CHAIN' END AS chain_name, address FROM store_locations WHERE CAST(store_code AS INT) % 7 = 0"""

QUERIES = {
    "import_rows": (
        lambda t: _normal(t).select("file_id", F.col("row_idx").cast("long").alias("row_idx"), "order_no", "warehouse", "jan", F.size("review_reasons").alias("reasons")),
        _sql("SELECT file_id, row_idx, order_no, warehouse, jan, 0 AS reasons FROM src"),
    ),
    "import_errors": (lambda t: _faults(t).withColumn("row_number", F.col("row_number").cast("long")), _sql("SELECT * FROM faults")),
    "import_blocked_files": (lambda t: _faults(t).groupBy("file_id").agg(F.count("*").alias("errors")), _sql("SELECT file_id, count(*) AS errors FROM faults GROUP BY ALL")),
    "import_headers": (
        lambda t: op.drafts(_normal(t))[0].select("file_id", "order_no", F.col("order_date").cast("string").alias("order_date"), "ship_to_name", "warehouse"),
        _sql("SELECT DISTINCT file_id, order_no, CAST(order_date AS VARCHAR) AS order_date, ship_to_name, warehouse FROM clean"),
    ),
    "import_lines": (lambda t: op.drafts(_normal(t))[1].withColumn("line_no", F.col("line_no").cast("long")), _sql("SELECT file_id, order_no, line_no, jan, qty FROM clean")),
    "import_missing_jans": (
        lambda t: op.missing_jans(_normal(t), t.products(), "C2", t.clients()),
        using(
            "clients products order_lines",
            """SELECT jan, coalesce((SELECT string_agg(DISTINCT c.name, ',' ORDER BY c.name) FROM products p JOIN clients c ON c.id = p.client_id WHERE p.jan = m.jan AND p.client_id <> 'C2'), '') AS other_clients
  FROM (SELECT DISTINCT jan FROM order_lines WHERE jan NOT IN (SELECT jan FROM products WHERE client_id = 'C2')) m""",
        ),
    ),
    "import_locks": (
        lambda t: op.locked(op.drafts(_normal(t))[0].select("file_id", "order_no").withColumn("client_id", F.lit("C1")), t.orders()),
        _sql("SELECT 'C1' AS client_id, c.order_no, c.file_id, o.id AS existing_id, o.status AS existing_status FROM (SELECT DISTINCT file_id, order_no FROM clean) c JOIN shop_orders o ON o.client_id = 'C1' AND o.order_no = c.order_no WHERE o.status <> 'imported'"),
    ),
    "latest_batches": (
        lambda t: op.latest_batches(t.import_batches()).select("id", "status"),
        using("import_batches", "SELECT id, status FROM import_batches QUALIFY row_number() OVER (PARTITION BY CASE WHEN trim(file_name) <> '' THEN lower(trim(file_name)) ELSE chr(1) || id END ORDER BY imported_at DESC, ord DESC) = 1"),
    ),
    "batch_orders": (
        lambda t: op.batch_orders(_batches(t), t.orders()).groupBy("batch_id").agg(F.count("*").alias("orders"), F.max("order_id").alias("last_order")),
        using(
            "shop_orders",
            """, b AS (SELECT client_id || '/' || source_file AS batch_id, client_id, source_file AS name, CASE WHEN CAST(substr(source_file, 6) AS INT) % 2 = 0 THEN max(source_file_path) END AS path FROM shop_orders GROUP BY client_id, source_file)
SELECT batch_id, count(*) AS orders, max(o.id) AS last_order FROM b JOIN shop_orders o ON o.client_id = b.client_id AND CASE WHEN b.path IS NOT NULL AND o.source_file_path IS NOT NULL THEN b.path = o.source_file_path ELSE b.name = o.source_file END GROUP BY ALL""",
        ),
    ),
    "product_upsert": (
        lambda t: op.upsert(t.products(), _new_products(t), ["client_id", "jan"]).select("client_id", "jan", "name"),
        using(
            "products",
            """, n AS (SELECT client_id, CASE WHEN CAST(jan AS BIGINT) % 20 = 3 THEN jan ELSE '8' || substr(jan, 2, 12) END AS jan, upper(name) AS name FROM products WHERE CAST(jan AS BIGINT) % 10 = 3)
SELECT client_id, jan, name FROM products p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.client_id = p.client_id AND n.jan = p.jan) UNION ALL SELECT * FROM n""",
        ),
    ),
    "product_changed": (
        lambda t: op.changed(_new_products(t), t.products(), ["client_id", "jan"], ["name", "retail_price"]),
        using("products", "SELECT client_id, jan FROM products WHERE CAST(jan AS BIGINT) % 20 = 3 AND upper(name) <> name"),
    ),
    "product_rename_lines": (
        lambda t: op.rename_jans(_with_client(t), _renames(t)).groupBy("client_id", "jan").agg(F.count("*").alias("lines")),
        using("products shop_orders order_lines", f", r AS ({_RENAMES}) SELECT o.client_id, coalesce(r.new_jan, l.jan) AS jan, count(*) AS lines FROM order_lines l JOIN shop_orders o ON o.id = l.order_id LEFT JOIN r ON r.client_id = o.client_id AND r.old_jan = l.jan GROUP BY ALL"),
    ),
    "product_rename_conflicts": (
        lambda t: op.rename_conflicts(_renames(t), t.products()),
        using("products", f", r AS ({_RENAMES}) SELECT * FROM r WHERE EXISTS (SELECT 1 FROM products p WHERE p.client_id = r.client_id AND p.jan = r.new_jan)"),
    ),
    "product_deletable": (
        lambda t: op.deletable(t.products(), _with_client(t)).select("client_id", "jan"),
        using("products shop_orders order_lines", "SELECT client_id, jan FROM products p WHERE NOT EXISTS (SELECT 1 FROM order_lines l JOIN shop_orders o ON o.id = l.order_id WHERE o.client_id = p.client_id AND l.jan = p.jan)"),
    ),
    "location_upsert": (
        # Every code comes twice; the later row, with a name in upper case, counts.
        lambda t: op.merge_locations(t.store_locations(), _locations(t).unionByName(_locations(t).withColumn("store_name", F.lit("first")).withColumn("ord", -F.col("ord")))),
        using(
            "store_locations",
            f""", n AS (SELECT n.store_code, n.store_name, coalesce(nullif(n.chain_name, ''), o.chain_name) AS chain_name, n.address FROM ({_NEW_LOCATIONS}) n LEFT JOIN store_locations o USING (store_code) WHERE n.store_code <> '')
SELECT * FROM store_locations WHERE store_code NOT IN (SELECT store_code FROM n) UNION ALL SELECT * FROM n""",
        ),
    ),
    "import_recheck": (
        lambda t: op.recheck(_normal(t), t.products().where("client_id = 'C2'"), t.products().where("client_id IN ('C2', 'C3')")),
        _sql(
            """, j AS (SELECT DISTINCT file_id, jan FROM src), p AS (SELECT DISTINCT jan, client_id FROM products)
SELECT file_id, count(*) FILTER (jan NOT IN (SELECT jan FROM p WHERE client_id = 'C2')) AS unregistered_before, count(*) FILTER (jan NOT IN (SELECT jan FROM p WHERE client_id IN ('C2', 'C3'))) AS unregistered_after FROM j GROUP BY ALL""",
            "products shop_orders order_lines",
        ),
    ),
    "supplier_upsert": (
        lambda t: op.insert_or_update(t.suppliers(), t.suppliers().where("id LIKE '%3'").select(F.concat(F.lit("X"), "id").alias("id"), "client_id", F.when(F.col("id").like("%13"), F.concat("name", F.lit(" new"))).otherwise(F.col("name")).alias("name"), F.lit("custom").alias("mapping_key")), ["client_id", "name"]),
        using(
            "suppliers",
            """, n AS (SELECT CASE WHEN id LIKE '%13' THEN 'X' || id ELSE id END AS id, client_id, CASE WHEN id LIKE '%13' THEN name || ' new' ELSE name END AS name, 'custom' AS mapping_key FROM suppliers WHERE id LIKE '%3')
SELECT * FROM suppliers s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.client_id = s.client_id AND n.name = s.name) UNION ALL SELECT * FROM n""",
        ),
    ),
    "location_chain_replace": (
        lambda t: op.replace_partition(t.store_locations(), _locations(t).drop("ord").where("chain_name <> ''").withColumn("chain_name", F.lit("NATION_3")), "chain_name", "NATION_3"),
        using("store_locations", f"SELECT * FROM store_locations WHERE chain_name <> 'NATION_3' UNION ALL SELECT store_code, store_name, 'NATION_3', address FROM ({_NEW_LOCATIONS}) WHERE chain_name <> ''"),
    ),
    "clients_scan": (
        lambda t: t.clients().select("id", "name", F.coalesce("fbp_fee_rate", F.lit(0.08)).alias("fee")).orderBy("name"),
        using("clients", "SELECT id, name, coalesce(fbp_fee_rate, 8e-2) AS fee FROM clients"),
    ),
    "suppliers_scan": (lambda t: t.suppliers().orderBy("name"), using("suppliers", "SELECT * FROM suppliers")),
    "products_scan": (
        lambda t: t.products().select("client_id", "jan", "name", F.when((F.col("wholesale_price") > 0) & (F.col("retail_price") > 0), F.col("wholesale_price") / F.col("retail_price")).alias("payout_rate"), F.get_json_object("flags", "$.memo").alias("memo")),
        using("products", "SELECT client_id, jan, name, CASE WHEN wholesale_price > 0 AND retail_price > 0 THEN wholesale_price / retail_price END AS payout_rate, memo FROM products"),
    ),
    "orders_nested": (
        lambda t: t.orders()
        .join(t.order_lines().groupBy(F.col("order_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("line_no", "jan", "qty"))).alias("lines")), "id", "left")
        .select("id", F.size(F.coalesce("lines", F.array().cast("array<struct<line_no:int,jan:string,qty:int>>"))).alias("n_lines"), F.coalesce(F.array_join(F.transform("lines", lambda x: x["jan"]), ","), F.lit("")).alias("jans")),
        using("shop_orders order_lines", "SELECT id, CAST(count(line_no) AS INTEGER) AS n_lines, coalesce(string_agg(jan, ',' ORDER BY line_no), '') AS jans FROM shop_orders LEFT JOIN order_lines ON order_id = id GROUP BY id"),
    ),
    "product_search_page": (
        lambda t: t.products().where(F.contains(F.lower("name"), F.lit("ring")) | F.contains("jan", F.lit("777"))).orderBy("name", "client_id", "jan").offset(50).limit(50).select("client_id", "jan", "name"),
        using("products", "SELECT client_id, jan, name FROM products WHERE name ILIKE '%ring%' OR jan LIKE '%777%' ORDER BY name, client_id, jan LIMIT 50 OFFSET 50"),
    ),
}
