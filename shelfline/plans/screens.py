"""Lists as screens show them: names in the order of their language, the deletion log, filters of introductions, address books' locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import introductions as intro
from ..operators import lifecycle as life
from ..operators import lists as op
from ..operators.imports import merge_locations
from ..sources.testdata import Tables
from .views import using

_SHOPS = """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'あいんず' WHEN 1 THEN 'アインズ' WHEN 2 THEN 'Bravo' WHEN 3 THEN 'alpha' WHEN 4 THEN '漢字堂' ELSE 'ぷらざ' END AS chain_name,
  concat(CASE c_custkey % 5 WHEN 0 THEN 'ロフト' WHEN 1 THEN 'ろふと' WHEN 2 THEN 'a' WHEN 3 THEN 'B' ELSE '渋谷' END, c_custkey % 40) AS store_name FROM customer"""


def _shops(t: Tables) -> DataFrame:
    t.raw("customer").createOrReplaceTempView("_customer")
    return t.spark.sql(_SHOPS.replace("FROM customer", "FROM _customer"))


def _log(t: Tables) -> DataFrame:
    return t.orders().select(F.col("id").alias("target_id"), "client_id", F.col("imported_at").alias("deleted_at"))


def _entries(t: Tables) -> DataFrame:
    stored = F.when(F.col("ord") % 3 == 0, F.concat(F.lit(" Old "), "product_name")).otherwise("")
    return t.introductions().select("ord", "store_code", F.col("jan").alias("shown_jan"), F.upper("product_name").alias("shown_name"), stored.alias("product_name"), F.col("chain_name").alias("matched_chain"))


def _book(t: Tables) -> DataFrame:
    n = F.col("store_code").cast("int")
    sheet = F.expr("CASE CAST(substr(chain_name, 8) AS INT) % 4 WHEN 0 THEN 'ｱｲﾝｽﾞ住所' WHEN 1 THEN 'inCube' ELSE '住所録' END")
    return t.store_locations().select(F.col("chain_name").alias("file_id"), sheet.alias("sheet_name"), F.when(n % 11 == 0, "").otherwise(F.col("store_code")).alias("store_code"), F.upper("store_name").alias("store_name"), F.when(n % 7 == 0, " ").otherwise("9-9 book").alias("address"), n.cast("long").alias("ord"))


QUERIES = {
    "names_in_order": (lambda t: op.in_order(_shops(t), "chain_name", "store_name", ["c_custkey"]), f"SELECT *, row_number() OVER (ORDER BY chain_name COLLATE ja, chain_name, store_name COLLATE ja, store_name, c_custkey) AS place FROM ({_SHOPS})"),
    "deletion_log_newest": (
        lambda t: life.deletions(_log(t)).select("target_id", "client_id", "place"),
        using("shop_orders", "SELECT id AS target_id, client_id, row_number() OVER (PARTITION BY client_id ORDER BY imported_at DESC, id) AS place FROM shop_orders"),
    ),
    "introduction_filtered": (
        lambda t: intro.filtered(_entries(t), " OLD ", "NATION_3").select("ord", "store_code").unionByName(intro.filtered(_entries(t), "0017").select("ord", "store_code")),
        using("introductions", "SELECT ord, store_code FROM introductions WHERE (ord % 3 = 0 OR contains(lower(product_name), 'old')) AND chain_name = 'NATION_3' UNION ALL SELECT ord, store_code FROM introductions WHERE contains(jan, '0017') OR contains(product_name, '0017')"),
    ),
    "address_book_locations": (
        lambda t: merge_locations(t.store_locations().where("cast(store_code as int) % 2 = 0"), op.book_locations(_book(t))),
        using(
            "store_locations",
            """, b AS (SELECT store_code, upper(store_name) AS store_name, CASE WHEN CAST(substr(chain_name, 8) AS INT) % 4 = 1 THEN 'インキューブ' ELSE '' END AS chain, '9-9 book' AS address FROM store_locations WHERE CAST(store_code AS INT) % 11 <> 0 AND CAST(store_code AS INT) % 7 <> 0 AND CAST(substr(chain_name, 8) AS INT) % 4 <> 0),
o AS (SELECT * FROM store_locations WHERE CAST(store_code AS INT) % 2 = 0)
SELECT store_code, store_name, chain_name, address FROM o WHERE store_code NOT IN (SELECT store_code FROM b) UNION ALL SELECT b.store_code, b.store_name, coalesce(nullif(b.chain, ''), o.chain_name), b.address FROM b LEFT JOIN o USING (store_code)""",
        ),
    ),
}
