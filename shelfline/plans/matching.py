"""Chain, channel, location and destination matching, shipment files and text functions over the folder's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import destinations as ds
from ..operators import exports as ex
from ..operators import matching as op
from ..operators import sellin
from ..sources.testdata import Tables
from .sellin import END, START
from .sellin import _sql as sell_in_sql
from .views import using


def _chains(t: Tables) -> DataFrame:
    return t.raw("nation").select(F.col("n_name").alias("name"), F.array(F.concat(F.lit("Mart "), "n_nationkey")).alias("aliases"), F.col("n_nationkey").alias("ord"))


def _shops(t: Tables, alias: str) -> DataFrame:
    """A chain for each customer, with one alias."""
    return t.raw("customer").select(F.col("c_name").alias("name"), F.array(F.concat(F.lit(alias), "c_custkey")).alias("aliases"), F.col("c_custkey").alias("ord"))


def _memos(t: Tables) -> DataFrame:
    """Five kinds of memo: decided by first words, holding a chain, a table header, blank, full-width alias."""
    c = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        "c_custkey",
        F.expr("""CASE c_custkey % 5 WHEN 0 THEN concat('店舗：ロフト 渋谷', c_custkey) WHEN 1 THEN concat('*', n_name, ' branch ¥1,200 x') WHEN 2 THEN '発注番号　発注日' WHEN 3 THEN ' ' ELSE concat('Ｍａｒｔ　', c_nationkey) END""").alias("memo"),
    )


def _stores(t: Tables) -> DataFrame:
    return t.store_locations().select("store_code", "store_name")


def _entries(t: Tables) -> DataFrame:
    """By an equal name, by one that goes on, by code alone, by the first six characters, or not at all."""
    n = F.col("store_code").cast("int") % 5
    name = F.when(n == 0, F.concat(F.upper("store_name"), F.lit(" 店"))).when(n == 1, F.concat("store_name", F.lit("annex"))).when(n == 2, "zz").when(n == 3, F.concat(F.lit("custom"), "store_code")).otherwise(F.concat(F.lit("q"), "store_code"))
    code = F.when(n == 2, F.col("store_code")).otherwise("")
    return _stores(t).select(name.alias("store_name"), code.alias("store_code"))


_ENTRIES = """, loc AS (SELECT store_code AS l_code, lower(store_name) AS l_key, CAST(store_code AS INT) AS n FROM store_locations),
e AS (SELECT DISTINCT CASE n % 5 WHEN 0 THEN upper(l_key) || ' 店' WHEN 1 THEN store_name || 'annex' WHEN 2 THEN 'zz' WHEN 3 THEN 'custom' || l_code ELSE 'q' || l_code END AS store_name, CASE n % 5 WHEN 2 THEN l_code ELSE '' END AS store_code, n, l_code, l_key FROM loc JOIN store_locations s ON s.store_code = l_code),
loose AS (SELECT e.store_name, arg_min(c.l_code, {'k': c.l_key, 'c': c.l_code}) AS code FROM (SELECT store_name, lower(store_name) AS k FROM e WHERE n % 5 IN (1, 3, 4)) e JOIN loc c
  ON starts_with(c.l_key, k) OR starts_with(k, c.l_key) OR contains(c.l_key, k) OR contains(k, c.l_key) OR contains(c.l_key, substr(k, 1, 6)) GROUP BY e.store_name)
"""

_CHANNEL = "CASE CAST(store_code AS INT) % 7 WHEN 0 THEN 'ロフト渋谷' WHEN 1 THEN 'ツルハ　札幌' WHEN 2 THEN 'MEGAドン・キホーテ' WHEN 3 THEN 'イオン' WHEN 4 THEN 'ﾛｰｿﾝ 駅前' WHEN 5 THEN 'みどり薬局' ELSE concat('nowhere ', store_code) END"


def _channel_rows(t: Tables) -> DataFrame:
    return t.store_locations().select("store_code", F.expr(_CHANNEL).alias("store_name"), F.lit(tx.UNKNOWN).alias("matched_store_name"), (F.col("store_code").cast("int") % 3 != 0).alias("is_introduced"))


_CHANNEL_SQL = "CASE CAST(store_code AS INT) % 7 WHEN 0 THEN 'variety' WHEN 1 THEN 'drugstore' WHEN 2 THEN 'discount' WHEN 3 THEN 'gms' WHEN 4 THEN 'cvs' WHEN 5 THEN 'drugstore' ELSE 'other' END"


def _destinations(t: Tables) -> DataFrame:
    """One for each nation: a code for even ones, else a postal code; addresses differ in their block."""
    k = F.col("n_nationkey")
    no = F.lpad(k.cast("string"), 4, "0")
    return t.raw("nation").select(
        F.when(k % 2 == 0, F.concat(F.lit("D-77"), no)).otherwise(F.concat(F.lit("200-"), no)).alias("code"),
        F.concat(F.lit("物流センター"), "n_name").alias("name"),
        F.concat(F.lit("200-"), no).alias("postal_code"),
        F.concat(F.lit("東京都港区"), k + 1, F.lit("-2-3")).alias("address"),
        F.concat(F.lit("03-5555-"), no).alias("tel"),
        F.array().cast("array<string>").alias("aliases"),
        k.alias("n"),
    )


def _delivery_docs(t: Tables) -> DataFrame:
    """A document for each order: by code in the text, by code beside it, by postal code with the address, by phone with it, by a centre's name with more behind it, or by none."""
    o = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
    k, no = F.col("c_nationkey"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0")
    address = F.concat(F.lit("東京都港区"), k + 1, F.lit("-2-3"))
    kind = F.col("o_orderkey") % 5
    even = k % 2 == 0
    text = (
        F.when(kind == 0, F.concat(F.lit("納品先 "), F.when(even, F.concat(F.lit("D-77"), no)).otherwise("X"), F.lit(" 御中")))
        .when(kind == 2, F.concat(F.lit("〒200-"), no, F.lit(" "), address))
        .when(kind == 3, F.concat(F.lit("TEL 03-5555-"), no, F.lit(" "), address))
        .when((kind == 4) & even, address)
        .otherwise("なし")
    )
    return o.select("o_orderkey", k.alias("n"), F.col("o_orderkey").alias("doc_id"), text.alias("text"), F.when((kind == 1) & even, F.concat(F.lit("d77"), no)).otherwise("").alias("code"), F.when((kind == 4) & even, F.concat(F.lit("物流センター NATION_"), k, F.lit(" 第一倉庫"))).otherwise("").alias("center_name"))


def _maker(t: Tables) -> DataFrame:
    o = t.orders()
    n = F.regexp_extract("warehouse", r"(\d+)$", 1).cast("int")
    o = o.withColumn("ship_to_center", F.when(n % 2 == 0, F.concat(F.lit("d77"), F.lpad(n.cast("string"), 4, "0"))).otherwise("")).withColumn("ship_to_address", F.lit("999-0001 大阪府大阪市北区9-9"))
    return ex.maker_rows(o, t.order_lines(), t.products(), _destinations(t))


_MAKER = """, o AS (SELECT *, CAST(substr(warehouse, 8) AS INT) AS n FROM shop_orders WHERE status IN ('confirmed', 'shipped')),
r AS (SELECT o.*, l.line_no, l.jan, l.qty, coalesce(p.wholesale_price, 0e0) AS price, coalesce(p.wholesale_price, 0e0) * l.qty AS amount, p.name, p.internal_sku, lpad(CAST(n AS VARCHAR), 4, '0') AS no
  FROM order_lines l JOIN o ON o.id = l.order_id LEFT JOIN products p ON p.client_id = o.client_id AND p.jan = l.jan)
SELECT order_no, line_no, lpad(order_no, CAST(greatest(8, length(order_no)) AS INTEGER), '0') AS c1, CASE WHEN n % 2 = 0 THEN 'D-77' || no ELSE '' END AS c2, 'FBP' AS c3, CASE WHEN n % 2 = 0 THEN '物流センターNATION_' || n ELSE ship_to_name END AS c4,
  CASE WHEN n % 2 = 0 THEN '200-' || no ELSE '999-0001' END AS c5, CASE WHEN n % 2 = 0 THEN '東京都港区' ELSE '大阪府大阪市北区' END AS c6, CASE WHEN n % 2 = 0 THEN (n + 1) || '-2-3' ELSE '9-9' END AS c7, '' AS c8,
  CASE WHEN n % 2 = 0 THEN '03-5555-' || no ELSE '' END AS c9, '佐川急便宅配便' AS c10, CAST(arrival_due_date AS VARCHAR) AS c11, '' AS c12, format('{:,}', CAST(floor(sum(amount) OVER (PARTITION BY id) + 5e-1) AS BIGINT)) AS c13,
  coalesce(internal_sku, '') AS c14, coalesce(name, '') AS c15, CAST(qty AS VARCHAR) AS c16, format('{:,}', CAST(floor(price + 5e-1) AS BIGINT)) AS c17, format('{:,}', CAST(floor(amount + 5e-1) AS BIGINT)) AS c18, '\\' || format('{:,}', CAST(floor(amount + 5e-1) AS BIGINT)) AS c19, '' AS c20 FROM r"""

_SCALARS = """SELECT o_orderkey AS id, lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(8, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS padded, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y') || '年' || month(o_orderdate) || '月' AS label,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' 〜 ' || CAST(CAST(o_orderdate AS DATE) + 3 AS VARCHAR) END AS period,
  format('{:,}', CAST(floor(o_totalprice + 5e-1) AS BIGINT)) AS yen, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey AS BIGINT) END AS whole, CASE WHEN o_orderkey % 2 = 0 OR o_custkey % 30 > 1 THEN CAST(o_custkey % 30 AS DOUBLE) / 100 ELSE CAST(o_custkey % 30 AS DOUBLE) END AS tax,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE substr(p, 1, 3) || '-' || substr(p, 4) END AS postal, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 2 END AS aliases, '"a""' || o_orderpriority || '"' AS cell, CAST(floor(o_custkey % 1000 + 5e-1) / 10 AS VARCHAR) || '%' AS share
FROM (SELECT *, lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS p FROM orders)"""


def _scalars(t: Tables) -> DataFrame:
    """Text functions over texts made of each order's columns: blanks, signs and missing parts by its number."""
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    start, due = day.cast("string"), F.when(key % 3 > 0, F.date_add(day, 3).cast("string"))
    rate = F.concat(F.lit(" "), F.col("o_custkey") % 30, F.when(key % 2 == 0, "%").otherwise("　"))
    return t.raw("orders").select(
        key.alias("id"),
        tx.order_number(key.cast("string")).alias("padded"),
        tx.month_key(start, F.lit("")).alias("month"),
        tx.month_label(F.lit(""), start).alias("label"),
        tx.period_text(start, due).alias("period"),
        tx.yen(F.col("o_totalprice")).alias("yen"),
        tx.whole_number(F.concat(F.lit(" "), F.format_number("o_orderkey", 0), F.when(key % 4 == 0, ".5").otherwise("　"))).alias("whole"),
        tx.tax_rate(rate).alias("tax"),
        tx.postal(F.concat(F.lit("〒"), F.lpad(F.col("o_custkey").cast("string"), 7, "0"), F.when(key % 5 == 0, "9").otherwise(" x"))).alias("postal"),
        F.size(tx.aliases(F.concat("o_orderpriority", F.lit("、"), F.when(key % 7 == 0, "").otherwise(" x "), F.lit(" \n"), "o_orderpriority"))).alias("aliases"),
        tx.csv_cell(F.concat(F.lit('a"'), "o_orderpriority")).alias("cell"),
        tx.percent_text(F.col("o_custkey") % 1000 / 1000).alias("share"),
    )


_MAKER_CELLS = " || ',' || ".join(f"""'"' || replace(coalesce(c{i + 1}, ''), '"', '""') || '"'""" for i in range(20))
_MAKER_HEADS = ",".join(f'"{h}"' for h in ex.MAKER_HEADERS)
_MAKER_LINES = (
    _MAKER.replace("\nSELECT order_no, line_no", ",\nm AS (SELECT order_no, line_no", 1)
    + f""") SELECT DISTINCT order_no, order_no || '.csv' AS file, CAST(0 AS BIGINT) AS place, '{_MAKER_HEADS}' AS line FROM m UNION ALL SELECT order_no, order_no || '.csv', line_no, {_MAKER_CELLS} FROM m"""
)

QUERIES = {
    "memo_chains": (
        lambda t: _memos(t).join(op.memo_chains(_memos(t), _chains(t)), "memo").select("c_custkey", "chain"),
        "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'ロフト' WHEN 1 THEN n_name WHEN 4 THEN n_name ELSE '店舗不明' END AS chain FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "unknown_memos": (
        lambda t: op.memo_chains(_memos(t), _chains(t)).where(F.col("chain") == tx.UNKNOWN).select("memo"),
        "SELECT DISTINCT CASE c_custkey % 5 WHEN 2 THEN '発注番号　発注日' ELSE ' ' END AS memo FROM customer WHERE c_custkey % 5 IN (2, 3)",
    ),
    "merge_chains": (
        lambda t: op.merge_chains(_shops(t, "Mart ").where("ord % 2 = 0"), _shops(t, "Extra ")).select("name", F.array_join("aliases", ",").alias("aliases")),
        "SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_name || ',Extra ' || c_custkey || ',Mart ' || c_custkey ELSE c_name || ',Extra ' || c_custkey END AS aliases FROM customer",
    ),
    "store_channels": (
        lambda t: _channel_rows(t).join(op.channels(_channel_rows(t)), ["store_name", "matched_store_name"]).select("store_code", "channel"),
        using("store_locations", f"SELECT store_code, {_CHANNEL_SQL} AS channel FROM store_locations"),
    ),
    "channel_summary": (
        lambda t: op.channel_summary(_channel_rows(t)),
        using(
            "store_locations",
            f"""SELECT count(*) AS introduced, {", ".join(f"count(*) FILTER (c = '{c}') AS {c}" for c in op.CHANNELS)} FROM (SELECT {_CHANNEL_SQL} AS c FROM store_locations WHERE CAST(store_code AS INT) % 3 <> 0)""",
        ),
    ),
    "store_location_matches": (
        lambda t: op.resolve_locations(_entries(t), _stores(t)),
        using(
            "store_locations",
            _ENTRIES
            + """SELECT e.store_name, e.store_code, CASE WHEN n % 5 = 0 THEN 1 WHEN n % 5 = 2 THEN 3 WHEN loose.code IS NOT NULL THEN 2 END AS step, CASE WHEN n % 5 IN (0, 2) THEN l_code ELSE loose.code END AS matched_code
FROM e LEFT JOIN loose ON loose.store_name = e.store_name""",
        ),
    ),
    "inferred_chains": (
        lambda t: t.store_locations().select("store_code", tx.inferred_chain(F.concat(F.element_at(F.array(*map(F.lit, ("loft-", "hands-", "atcosme-", "x-"))), (F.col("store_code").cast("int") % 4 + 1)), "store_code"), F.when(F.col("store_code").cast("int") % 8 == 3, "AINZ x").otherwise(F.col("store_name"))).alias("chain")),
        using("store_locations", "SELECT store_code, CASE CAST(store_code AS INT) % 4 WHEN 0 THEN 'ロフト' WHEN 1 THEN 'ハンズ' WHEN 2 THEN '@cosme STORE' ELSE CASE WHEN CAST(store_code AS INT) % 8 = 3 THEN 'アインズ' ELSE '' END END AS chain FROM store_locations"),
    ),
    "delivery_destinations": (
        lambda t: ds.resolve(_delivery_docs(t), _destinations(t)).drop("reasons"),
        # A name of two digits holds that of its first digit too, so no name leads.
        """WITH d AS (SELECT o_orderkey AS doc_id, c_nationkey AS k, o_orderkey % 5 AS kind, c_nationkey % 2 = 0 AS even, CASE WHEN c_nationkey % 2 = 0 THEN 'D-77' || lpad(CAST(c_nationkey AS VARCHAR), 4, '0') ELSE '200-' || lpad(CAST(c_nationkey AS VARCHAR), 4, '0') END AS own FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT *, CASE WHEN kind IN (0, 1) AND even THEN 'code' WHEN kind = 2 THEN CASE WHEN even THEN 'postal' ELSE 'code' END WHEN kind = 3 THEN 'tel' WHEN kind = 4 AND even AND k < 10 THEN 'centerName' ELSE 'none' END AS method FROM d)
SELECT doc_id, CASE WHEN method <> 'none' THEN own END AS code, method, method IN ('none', 'centerName') AS needs_review FROM m""",
    ),
    "maker_rows": (lambda t: _maker(t).withColumn("line_no", F.col("line_no").cast("long")), using("products shop_orders order_lines", _MAKER)),
    "maker_lines": (lambda t: ex.maker_lines(_maker(t)), using("products shop_orders order_lines", _MAKER_LINES)),
    "sell_in_export": (
        lambda t: ex.sell_in_export(sellin.sell_in_rows(sellin.sell_in_lines(t.orders(), t.order_lines(START, END), t.products(), START, END), t.products(), START, END)),
        sell_in_sql(
            "SELECT CAST(date AS VARCHAR) AS 日付, store_name AS 店舗, jan AS JAN, product_name AS 商品名, order_count AS 受注件数, qty AS 数量, coalesce(CAST(wholesale_amount AS VARCHAR), '未計算') AS 卸金額, coalesce(CAST(retail_amount AS VARCHAR), '未計算') AS 上代金額 FROM rows"
        ),
    ),
    "text_functions": (_scalars, _SCALARS),
    "file_names": (
        lambda t: t.orders().select("id", ex.file_name(F.concat(F.lit("a/b "), "store_name"), F.col("order_no")).alias("name")),
        using("shop_orders", "SELECT id, 'a-b-' || store_name || '_' || order_no AS name FROM shop_orders"),
    ),
}
