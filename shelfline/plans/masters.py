"""Master, option and batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import imports as im
from ..operators import masters as op
from ..sources.testdata import Tables
from . import imports as plans
from .views import using


def _drafts(t: Tables) -> DataFrame:
    p = t.raw("part")
    return p.select(
        F.lit("C1").alias("client_id"),
        F.concat(F.lit("JAN "), F.lpad(F.col("p_partkey").cast("string"), 13, "0")).alias("jan"),
        F.concat(F.lit("　"), "p_name", F.lit(" ")).alias("name"),
        F.when(F.col("p_partkey") % 4 != 0, F.concat(F.format_number("p_size", 0), F.lit("円"))).otherwise("").alias("wholesale_price"),
        F.lit("1,000 円").alias("retail_price"),
        F.when(F.col("p_partkey") % 2 == 0, "8%").otherwise("0.1").alias("tax_rate"),
        F.concat("p_brand", F.lit("、"), "p_type", F.lit("\n"), "p_brand").alias("alias_text"),
    )


def _sheet(t: Tables) -> DataFrame:
    """Rows of a product sheet: some by JAN, some by name alone."""
    k = F.col("jan").cast("long")
    return t.products().select(F.concat("client_id", "jan").alias("row_id"), "client_id", F.when(k % 2 == 0, F.col("jan")).otherwise("").alias("jan"), F.when(k % 9 == 0, F.lit("")).otherwise(F.col("name")).alias("name"), F.when(k % 5 == 1, F.col("wholesale_price") + 1).alias("wholesale_price"))


def _entries(t: Tables) -> DataFrame:
    n = F.col("store_code").cast("int")
    return t.store_locations().select(
        "chain_name", F.when(n % 3 == 0, F.col("store_code")).otherwise("").alias("store_code"), F.when(n % 3 == 1, F.upper("store_name")).otherwise(F.concat(F.lit("x "), "store_name")).alias("store_name"), (n % 2 == 0).alias("is_introduced"), n.cast("long").alias("ord")
    )


def _postals(t: Tables) -> DataFrame:
    return t.raw("customer").select(F.concat(F.lit("100-00"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("postal"), F.col("c_custkey").alias("row_idx"))


def _dest(t: Tables, kind: int) -> DataFrame:
    k = F.col("s_suppkey")
    return t.raw("supplier").where(k % (kind + 2) == 0).select(F.concat(F.lit("D"), k).alias("code"), F.concat(F.lit(f"{kind} "), "s_name").alias("name"), F.when(k % 4 == kind * 2, "W").alias("wholesaler_name"))


QUERIES = {
    "typed_products": (
        lambda t: op.typed_products(_drafts(t)).withColumn("aliases", F.array_join("aliases", ",")),
        """SELECT 'C1' AS client_id, lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS jan, p_name AS name, w AS wholesale_price, 1e3 AS retail_price, CASE WHEN p_partkey % 2 = 0 THEN 8e0 / 100 ELSE 1e-1 END AS tax_rate,
  CASE WHEN w > 0 THEN w / 1e3 END AS payout_rate, p_name || ',' || p_brand || ',' || p_type AS aliases FROM (SELECT *, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS w FROM part)""",
    ),
    "sheet_existing_products": (
        lambda t: op.existing_product(_sheet(t), t.products()),
        using(
            "products",
            """, s AS (SELECT client_id, client_id || jan AS row_id, CASE WHEN CAST(jan AS BIGINT) % 2 = 0 THEN jan ELSE '' END AS jan, CASE WHEN CAST(jan AS BIGINT) % 9 = 0 THEN '' ELSE name END AS name FROM products)
SELECT row_id, jan AS matched_jan, 'jan' AS by FROM s WHERE jan <> '' UNION ALL SELECT row_id, min(p.jan), 'name' FROM s JOIN products p ON p.client_id = s.client_id AND p.name = s.name WHERE s.jan = '' AND s.name <> '' GROUP BY row_id HAVING count(DISTINCT p.jan) = 1""",
        ),
    ),
    "sheet_merged_products": (
        lambda t: op.merged_products(_sheet(t).where("jan <> ''"), t.products(), ["name", "wholesale_price"]),
        using("products", "SELECT client_id, jan, name, CASE WHEN CAST(jan AS BIGINT) % 5 = 1 THEN wholesale_price + 1 ELSE wholesale_price END AS wholesale_price FROM products WHERE CAST(jan AS BIGINT) % 2 = 0"),
    ),
    "edited_orders": (
        lambda t: op.edited_orders(t.orders(), t.orders().where("cast(id as int) % 9 = 0").select("id", F.lit("2000-01-01").cast("date").alias("arrival_due_date"), F.when(F.col("id").cast("int") % 2 == 0, "EDITED").alias("store_name"))).select("id", F.col("arrival_due_date").cast("string").alias("arrival_due_date"), "store_name"),
        using("shop_orders", "SELECT id, CASE WHEN CAST(id AS INT) % 9 = 0 THEN '2000-01-01' ELSE CAST(arrival_due_date AS VARCHAR) END AS arrival_due_date, CASE WHEN CAST(id AS INT) % 18 = 0 THEN 'EDITED' ELSE store_name END AS store_name FROM shop_orders"),
    ),
    "order_files": (
        lambda t: op.order_files(t.import_batches().withColumn("file_name", F.concat(F.lit("file-"), F.col("ord") % 97)), t.orders(), "file-1").select("id", "file_name", "orders"),
        using("import_batches shop_orders", "SELECT id, f AS file_name, n AS orders FROM (SELECT id, 'file-' || (ord % 97) AS f FROM import_batches WHERE status = 'saved') LEFT JOIN (SELECT source_file, count(*) AS n FROM shop_orders GROUP BY ALL) ON f = source_file WHERE contains(f, 'file-1')"),
    ),
    "location_search": (
        lambda t: op.search_rows(t.store_locations(), ["store_code", "store_name", "chain_name", "address"], " Nation_7 ").select("store_code"),
        using("store_locations", "SELECT store_code FROM store_locations WHERE contains(lower(concat_ws(' ', store_code, store_name, chain_name, address)), 'nation_7')"),
    ),
    "location_page": (lambda t: op.page(t.store_locations(), ["store_name", "store_code"], 3, 500).select("store_code"), using("store_locations", "SELECT store_code FROM store_locations ORDER BY store_name, store_code LIMIT 200 OFFSET 400")),
    "location_chains": (
        lambda t: op.location_chains(t.store_locations().withColumn("store_code", F.when(F.col("store_code").cast("int") % 2 == 0, F.concat(F.lit("loft-"), "store_code")).otherwise(F.col("store_code")))).groupBy("chain_name").agg(F.count("*").alias("stores")),
        using("store_locations", "SELECT CASE WHEN CAST(store_code AS INT) % 2 = 0 THEN 'ロフト' ELSE chain_name END AS chain_name, count(*) AS stores FROM store_locations GROUP BY ALL"),
    ),
    "blocked_batches": (
        lambda t: op.blocked_batches(plans._faults(t), "C0", "2024-01-01")[0].select("file_name", "status", "errors"),
        plans._sql("SELECT file_id AS file_name, 'blocked' AS status, count(*) AS errors FROM faults GROUP BY ALL"),
    ),
    "official_merge": (
        lambda t: op.official_merge(_entries(t), t.store_locations()),
        using(
            "store_locations",
            """, m AS (SELECT *, CAST(store_code AS INT) AS n, count(*) OVER (PARTITION BY chain_name) AS size FROM store_locations)
SELECT chain_name, store_code, store_name, n % 3 < 2 AND n % 2 = 0 AS is_introduced, 'master' AS origin FROM m WHERE size >= 5 UNION ALL SELECT chain_name, '', 'x ' || store_name, true, 'file' FROM m WHERE size >= 5 AND n % 3 = 2 AND n % 2 = 0
UNION ALL SELECT DISTINCT chain_name, CASE WHEN n % 3 = 0 THEN store_code ELSE '' END, CASE WHEN n % 3 = 1 THEN upper(store_name) ELSE 'x ' || store_name END, n % 2 = 0, 'file' FROM m WHERE size < 5""",
        ),
    ),
    "store_count_warnings": (
        lambda t: t.store_locations().groupBy("chain_name").agg(F.count("*").alias("m"), F.count("address").alias("i")).select("chain_name", op.store_count_warning(F.col("i"), F.col("m")).alias("warning")),
        using("store_locations", "SELECT chain_name, CASE WHEN count(address) <> count(*) THEN '店舗数が一致しません（取込' || count(address) || ' / マスタ' || count(*) || '）' END AS warning FROM store_locations GROUP BY ALL"),
    ),
    "numbered_codes": (
        lambda t: op.numbered_codes(_postals(t)),
        "SELECT postal, row_idx, CASE WHEN n = 1 THEN postal ELSE postal || '-' || n END AS code FROM (SELECT '100-00' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS postal, c_custkey AS row_idx, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer)",
    ),
    "merged_destinations": (
        lambda t: op.merged_destinations(_dest(t, 0), _dest(t, 1)),
        """SELECT code, name, wholesaler_name FROM (SELECT 'D' || s_suppkey AS code, k || ' ' || s_name AS name, CASE WHEN s_suppkey % 4 = k * 2 THEN 'W' END AS wholesaler_name, k FROM supplier, (VALUES (0), (1)) v(k) WHERE s_suppkey % (k + 2) = 0)
QUALIFY row_number() OVER (PARTITION BY code ORDER BY wholesaler_name IS NULL, k, name) = 1""",
    ),
    # Saved orders change their store and keep their id; every eighth order comes again under a new number.
    "order_save": (
        lambda t: im.insert_or_update(
            t.orders().select("id", "client_id", "order_no", "status", "store_name"),
            t.orders().where("status = 'imported' AND cast(id as int) % 4 = 0 OR cast(id as int) % 8 = 1").select(
                F.concat(F.lit("new-"), "id").alias("id"), "client_id", F.when(F.col("id").cast("int") % 8 == 1, F.concat(F.lit("N"), "order_no")).otherwise(F.col("order_no")).alias("order_no"), F.lit("imported").alias("status"), F.lit("SAVED").alias("store_name")
            ),
            ["client_id", "order_no"],
        ),
        using(
            "shop_orders",
            """SELECT id, client_id, order_no, status, CASE WHEN status = 'imported' AND CAST(id AS INT) % 4 = 0 THEN 'SAVED' ELSE store_name END AS store_name FROM shop_orders
UNION ALL SELECT 'new-' || id, client_id, 'N' || order_no, 'imported', 'SAVED' FROM shop_orders WHERE CAST(id AS INT) % 8 = 1""",
        ),
    ),
    "seed_missing_clients": (
        lambda t: im.insert_missing(
            t.raw("customer").where("c_custkey % 3 > 0").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_name").alias("name")), t.raw("customer").select(F.concat(F.lit("S"), "c_custkey").alias("id"), F.upper("c_name").alias("name")), "name"
        ),
        "SELECT CASE WHEN c_custkey % 3 > 0 THEN 'C' ELSE 'S' END || c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE upper(c_name) END AS name FROM customer",
    ),
}
