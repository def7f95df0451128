"""Chains of orders and introductions, further steps of store matching, and searches of masters, over names derived from the folder's tables.

Texts that both sides derive are written once, in SQL that both engines read; the comparison then states the rule over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import introductions as intro
from ..operators import stores as op
from ..operators import workbooks
from ..operators.imports import insert_or_update, merge_locations
from ..operators.lifecycle import review_flags
from ..sources.testdata import Tables
from .introductions import _BASE, FORMAT
from .matching import _chains, _shops
from .views import using

_TOWN = "CASE c_custkey % 7 WHEN 0 THEN '渋谷' WHEN 1 THEN '池袋' WHEN 2 THEN '名古屋栄' WHEN 3 THEN '本厚木' WHEN 4 THEN '梅田' WHEN 5 THEN 'イクスピアリ' ELSE '仙台' END"

#: A customer as a location: code and name by kind of chain.
_CODE = "concat(CASE c_custkey % 4 WHEN 1 THEN 'hands-' ELSE 'loft-' END, c_custkey)"
_NAME = f"CASE c_custkey % 4 WHEN 0 THEN concat('コスメロフト ', {_TOWN}, c_custkey % 50) WHEN 1 THEN concat('ハンズ', {_TOWN}, c_custkey % 50, '店') WHEN 2 THEN concat('グランスタ ', c_custkey % 60) ELSE concat('ロフト', {_TOWN}, c_custkey) END"

#: A customer as a row of a sheet, by a name that is cut short or written otherwise.
_SHEET = f"""CASE c_custkey % 6 WHEN 0 THEN concat('コスメ', {_TOWN}, c_custkey % 9, '階') WHEN 1 THEN concat('HB', {_TOWN}, c_custkey % 50) WHEN 2 THEN concat('ハンズ CITY', {_TOWN})
  WHEN 3 THEN CASE c_custkey % 5 WHEN 0 THEN 'コスメグラ東京' WHEN 1 THEN 'コスメ本厚木' WHEN 2 THEN 'コスメイクスピ' WHEN 3 THEN 'コスメ武蔵小金' ELSE 'コスメノノワク' END WHEN 4 THEN concat('コスメ', {_TOWN}, 'x') ELSE concat('ハンズ', {_TOWN}, c_custkey % 50, 'annex') END"""

_PLACES = f"""WITH loc AS (SELECT code, name, replace(lower(name), ' ', '') AS k FROM (SELECT {_CODE} AS code, {_NAME} AS name FROM customer)),
sheet AS (SELECT DISTINCT name, replace(lower(name), ' ', '') AS k FROM (SELECT {_SHEET} AS name FROM customer)),
"""


def _locations(t: Tables) -> DataFrame:
    return t.raw("customer").select(F.expr(_CODE).alias("store_code"), F.expr(_NAME).alias("store_name"))


def _sheet(t: Tables) -> DataFrame:
    return t.raw("customer").select(F.expr(_SHEET).alias("name"))


def _longest(a: str, b: str, least: int, most: int) -> str:
    return f"coalesce(list_max(list_filter(range({least}, {most + 1}), lambda n: length({a}) >= n AND contains({b}, substr({a}, 1, CAST(n AS BIGINT))))), 0)"


_HANDS_KEY = lambda c: f"regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace({c}, '^hb', 'ハンズビー'), 'ハンズビーハンズ', 'ハンズ'), 'city', 'シティ'), 'northgate', ''), 'パルコシティ', ''), '\\d+店$', ''), '店$', '')"

_COSMETIC = (
    _PLACES
    + f"""a AS (SELECT name, substr(k, 4) AS core FROM sheet WHERE starts_with(k, 'コスメ') AND length(k) >= 6), b AS (SELECT code, name AS l, substr(k, 7) AS cand FROM loc WHERE starts_with(k, 'コスメロフト')),
s AS (SELECT a.name, code, l, {_longest("core", "cand", 2, 8)} AS ahead, {_longest("cand", "core", 2, 8)} AS behind FROM a, b)
SELECT name, arg_min(code, {{'s': -score, 'l': l, 'c': code}}) AS store_code FROM (SELECT *, CASE WHEN ahead > 0 THEN ahead ELSE behind END AS score FROM s) WHERE score >= 2 GROUP BY name"""
)

_TRUNCATED_ROWS = ", ".join(f"('{tx._plain(k)}', {i}, '{tx._plain(p)}')" for k, ps in op.TRUNCATED.items() for i, p in enumerate(ps))
_TRUNCATED = (
    _PLACES
    + f"""listed(k, r, part) AS (VALUES {_TRUNCATED_ROWS}), there AS (SELECT sheet.name, r, arg_min(code, {{'l': loc.name, 'c': code}}) AS code FROM sheet JOIN listed USING (k) JOIN loc ON contains(loc.k, part) GROUP BY sheet.name, r)
SELECT name, arg_min(code, r) AS store_code FROM there GROUP BY name"""
)

_HANDS = (
    _PLACES
    + f"""a AS (SELECT name, {_HANDS_KEY("k")} AS x FROM sheet), b AS (SELECT code, name AS l, {_HANDS_KEY("k")} AS y FROM loc WHERE starts_with(code, 'hands-') OR contains(k, 'ハンズ')),
s AS (SELECT a.name, code, l, x, y, {_longest("x", "y", 4, 10)} AS ahead, {_longest("y", "x", 4, 10)} AS behind FROM a, b WHERE length(x) >= 3 AND y <> '')
SELECT name, arg_min(code, {{'s': -score, 'l': l, 'c': code}}) AS store_code
FROM (SELECT *, CASE WHEN x = y THEN 1000 WHEN contains(x, y) OR contains(y, x) THEN least(length(x), length(y)) + 100 WHEN ahead > 0 THEN ahead ELSE behind END AS score FROM s) WHERE score >= 4 GROUP BY name"""
)

_MEMO = "CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN '発注番号　発注日' WHEN 1 THEN ' ' WHEN 2 THEN concat('Ｍａｒｔ　', l_partkey % 25, ' ¥1,200') WHEN 3 THEN 'ロフト 渋谷' WHEN 4 THEN concat('入荷先：NATION_', l_suppkey % 25) ELSE concat('nowhere ', l_partkey % 50) END"
_SAVED = "CASE o_orderkey % 11 WHEN 0 THEN ' Saved Shop ' WHEN 1 THEN '店舗不明' ELSE '' END"


def _order_chains(t: Tables) -> DataFrame:
    orders = t.raw("orders").select(F.col("o_orderkey").alias("order_id"), F.expr(_SAVED).alias("saved"))
    lines = t.raw("lineitem").select(F.col("l_orderkey").alias("order_id"), (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey")).alias("line_no"), F.expr(_MEMO).alias("memo"))
    return op.order_chains(orders, lines, _chains(t))


_ORDER_CHAINS = f"""WITH m AS (SELECT l_orderkey, CASE (l_orderkey + l_linenumber) % 7 WHEN 2 THEN 'NATION_' || (l_partkey % 25) WHEN 3 THEN 'ロフト' WHEN 4 THEN 'NATION_' || (l_suppkey % 25) END AS chain, l_linenumber * 100000000 + l_partkey AS no FROM lineitem),
f AS (SELECT l_orderkey, arg_min(chain, no) AS chain FROM m WHERE chain IS NOT NULL GROUP BY l_orderkey)
SELECT o_orderkey AS order_id, CASE WHEN trim({_SAVED}) NOT IN ('', '店舗不明') THEN trim({_SAVED}) ELSE coalesce(chain, '店舗不明') END AS chain FROM orders LEFT JOIN f ON l_orderkey = o_orderkey"""

_FORMAT = "CASE c_nationkey % 6 WHEN 0 THEN 'hands-allocation-list' WHEN 1 THEN 'ainz-shipment-list' WHEN 2 THEN 'flag-list' WHEN 3 THEN 'store-allocation-list' WHEN 4 THEN 'flag-list' ELSE 'row-list' END"
_ROW_CODE = "CASE WHEN c_custkey % 9 = 0 AND c_nationkey % 6 = 2 THEN concat('2', c_custkey % 10, '7') ELSE concat('9', c_custkey) END"
_ROW_NAME = "CASE c_custkey % 5 WHEN 0 THEN concat('Ｍａｒｔ　', c_nationkey) WHEN 1 THEN concat('HBなんば', c_custkey) WHEN 2 THEN concat('@cosme ', c_custkey) WHEN 3 THEN concat('ハンズ ', c_custkey) ELSE concat('nowhere ', c_custkey) END"


def _rows(t: Tables) -> DataFrame:
    """Rows of one sheet for each nation, of five formats."""
    return t.raw("customer").select("c_custkey", F.concat(F.lit("F-"), "c_nationkey").alias("import_id"), F.expr(_FORMAT).alias("format_key"), F.expr(_ROW_CODE).alias("store_code"), F.expr(_ROW_NAME).alias("store_name"))


_ROWS = f"""WITH e AS (SELECT c_custkey, c_nationkey, 'F-' || c_nationkey AS import_id, {_FORMAT} AS format_key, {_ROW_CODE} AS store_code, {_ROW_NAME} AS store_name FROM customer),
n AS (SELECT import_id, format_key, count(*) AS n, count(*) FILTER (contains(lower(store_name), 'ロフト')) AS loft, count(*) FILTER (regexp_matches(store_code, '^(2\\d\\d|501)$')) AS codes, count(*) FILTER (contains(store_name, 'cosme')) AS cosme FROM e GROUP BY ALL),
series AS (SELECT import_id, CASE WHEN n < 5 THEN '' WHEN format_key = 'hands-allocation-list' THEN 'ハンズ' WHEN format_key = 'ainz-shipment-list' THEN 'アインズ' WHEN format_key = 'flag-list' AND (loft >= 3 OR codes >= least(10, ceil(n / 5))) THEN 'ロフト'
  WHEN format_key = 'store-allocation-list' AND cosme >= 3 THEN '@cosme STORE' ELSE '' END AS series FROM n),
own AS (SELECT e.*, CASE WHEN format_key = 'hands-allocation-list' THEN 'ハンズ' WHEN format_key = 'ainz-shipment-list' THEN 'アインズ' WHEN format_key = 'flag-list' AND (series = 'ロフト' OR regexp_matches(store_code, '^(2\\d\\d|501)$')) THEN 'ロフト'
  WHEN format_key = 'store-allocation-list' THEN '@cosme STORE' WHEN contains(store_name, 'ハンズ') THEN 'ハンズ' WHEN c_custkey % 5 = 0 THEN 'NATION_' || c_nationkey ELSE '店舗不明' END AS matched_chain FROM e JOIN series USING (import_id))
"""

_IMPORTS = "SELECT import_id, client_id, CASE WHEN client_id = 'C4' OR version = 1 AND month(period_end) = 6 THEN ' ' ELSE ' ' || retailer END AS chain_name, imported_at FROM sellout_imports"


def _imports(t: Tables) -> DataFrame:
    """Imports of five clients who share chains; some of June and all of one client have no chain."""
    i = t.sellout_imports()
    chain = F.when((F.col("client_id") == "C4") | (F.col("version") == 1) & (F.month("period_end") == 6), " ").otherwise(F.concat(F.lit(" "), "retailer"))
    return i.select("import_id", "client_id", chain.alias("chain_name"), "imported_at")


_ADDRESS = "CASE WHEN l_partkey % 3 = 0 THEN concat('1-', l_suppkey) ELSE '' END"


_ORD = "(l_orderkey * 16 + l_linenumber) * 1000000 + l_partkey"
_LINES = f"(SELECT ord, l_orderkey, l_partkey, r.l_suppkey AS l_suppkey, r.l_returnflag AS l_returnflag FROM (SELECT {_ORD} AS ord, min(l_orderkey) AS l_orderkey, min(l_partkey) AS l_partkey, min({{'l_suppkey': l_suppkey, 'l_returnflag': l_returnflag}}) AS r FROM lineitem GROUP BY 1))"


def _lines(t: Tables) -> DataFrame:
    """Order lines, one for each number `ord`."""
    one = t.raw("lineitem").groupBy(F.expr(_ORD).alias("ord")).agg(F.min("l_orderkey").alias("l_orderkey"), F.min("l_partkey").alias("l_partkey"), F.min(F.struct("l_suppkey", "l_returnflag")).alias("r"))
    return one.select("ord", "l_orderkey", "l_partkey", "r.*")


def _store_rows(t: Tables) -> DataFrame:
    """Rows of stores from order lines, with and without codes, chains and addresses."""
    return _lines(t).select(
        F.expr("CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE concat('S', l_suppkey) END").alias("store_code"),
        F.expr("concat('Shop ', l_suppkey)").alias("store_name"),
        F.expr("CASE WHEN l_suppkey % 5 = 0 THEN ' ' ELSE concat(' N', l_partkey % 7) END").alias("chain_name"),
        F.expr(_ADDRESS).alias("address"),
        "ord",
    )


def _matrix_rows(t: Tables) -> DataFrame:
    return _lines(t).select(F.concat(F.lit("N"), F.col("l_partkey") % 5, F.lit("::s"), "l_suppkey").alias("key"), "ord", (F.col("l_returnflag") == "N").alias("introduced"), F.expr(_ADDRESS).alias("address"))


_DESTINATION = "CASE s_suppkey % 4 WHEN 0 THEN concat('大山センター', s_suppkey) WHEN 1 THEN concat('アラタ物流', s_suppkey) ELSE s_name END"


def _destinations(t: Tables) -> DataFrame:
    s = t.raw("supplier")
    return s.select(F.concat(F.expr("CASE WHEN s_suppkey % 7 = 0 THEN '081701' ELSE 'D' END"), "s_suppkey").alias("code"), F.expr(_DESTINATION).alias("name"), F.array(F.expr("CASE WHEN s_suppkey % 6 = 2 THEN 'あらた' ELSE '' END")).alias("aliases"), F.expr("CASE WHEN s_suppkey % 10 = 0 THEN '大山' ELSE '' END").alias("wholesaler_name"))


def _cells(t: Tables) -> DataFrame:
    """Cells of part numbers as sheets hold them: numbers with fractions and exponents, text with blanks, too few digits."""
    return t.raw("part").select("p_partkey", F.expr(_CELL).alias("value"), (F.col("p_partkey") % 8 < 4).alias("number"), "p_size", F.expr(_UNIT).alias("unit"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat(' ', p_name, ' F') ELSE ' ' END").alias("formal"), "p_name", F.expr("CASE p_partkey % 3 WHEN 0 THEN '店舗住所録.xlsx' ELSE 'list.xlsx' END").alias("file"))


_CELL = "CASE p_partkey % 8 WHEN 0 THEN concat(4900000000000 + p_partkey, '.5') WHEN 1 THEN concat(4900000000000 + p_partkey, '.0') WHEN 2 THEN concat('4.9', p_partkey % 1000 + 1000, '1E12') WHEN 3 THEN concat(4900000000000 + p_partkey, '') WHEN 4 THEN concat(' 49 000000', p_partkey, ' ') WHEN 5 THEN '_' WHEN 6 THEN concat('4.9', p_partkey % 1000 + 1000, 'e+12') ELSE concat('JAN', p_partkey % 1000) END"
_UNIT = "CASE p_partkey % 4 WHEN 0 THEN 'ml' WHEN 1 THEN ' g ' WHEN 2 THEN '' END"

def _introduction_imports(t: Tables) -> DataFrame:
    """An import for each chain's entries; every fourth chain has a newer one, which holds none, and so has every third one, but of another client."""
    n = t.raw("nation").select(F.col("n_name").alias("chain_name"), "n_nationkey")
    some = lambda rows, kind, client, day: rows.select(F.concat(F.lit(kind), "chain_name").alias("import_id"), F.concat(F.lit("C"), client % 5).alias("client_id"), "chain_name", F.lit(day).cast("timestamp").alias("imported_at"))
    k = F.col("n_nationkey")
    return some(n, "I-", k, "2024-01-01").unionByName(some(n.where("n_nationkey % 4 = 0"), "J-", k, "2024-02-01")).unionByName(some(n.where("n_nationkey % 3 = 1"), "K-", k + 1, "2024-03-01"))


def _loft(t: Tables) -> DataFrame:
    return t.store_locations().select("store_code", "store_name")


def _official(chain: Column) -> Column:
    return F.when(F.substring(chain, 8, 9).cast("int") % 3 == 0, op.OFFICIAL[0]).otherwise(chain)


_OFFICIAL_SQL = f"CASE WHEN CAST(substr(chain_name, 8) AS INT) % 3 = 0 THEN '{op.OFFICIAL[0]}' ELSE chain_name END"

_SHEET_JAN = "CASE WHEN p_partkey % 4 = 0 THEN lpad(CAST(p_partkey AS VARCHAR(20)), 13, '0') ELSE 'UNKNOWN' END"
_SHEET_NAME = "CASE p_partkey % 4 WHEN 0 THEN 'any' WHEN 1 THEN concat(' ', upper(p_name)) WHEN 2 THEN concat(p_name, ' set') ELSE concat('zzz ', p_partkey) END"

_TEXTS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
_SHIP = "concat('発注元 X\n', CASE doc_id % 4 WHEN 0 THEN 'お届け先' WHEN 1 THEN '納品先：' WHEN 2 THEN 'お届け先住所 1' ELSE 'お届先 御中' END, '\n a \n\n', doc_id, '\n', CASE WHEN doc_id % 3 = 0 THEN '納品先TEL 03' ELSE 'c' END, '\nd\ne\nf\ng\nh\ni')"

# Locations of two sub-brands in the same places, and names that end at each stage of the last step.
_SPOT = f"concat({_TOWN}, cast(c_custkey % 30 as {{S}}))"
_SPOTS = f"""SELECT concat(CASE c_custkey % 3 WHEN 0 THEN 'hands-be_' WHEN 1 THEN 'hands-' ELSE 'loft-' END, c_custkey) AS code, CASE c_custkey % 3 WHEN 0 THEN concat('ハンズビー', {_SPOT}, 'モディ店') WHEN 1 THEN concat('ハンズ', {_SPOT}, '店') ELSE concat({_SPOT}, 'スクエア ', c_custkey % 40) END AS name FROM customer"""
_ASKED = f"""SELECT DISTINCT CASE c_custkey % 6 WHEN 0 THEN {_SPOT} WHEN 1 THEN concat({_SPOT}, ' SQ') WHEN 2 THEN concat('ハンズビー', {_SPOT}) WHEN 3 THEN {_TOWN} WHEN 4 THEN concat({_SPOT}, 'モディ') ELSE concat({_SPOT}, 'スクエア ', c_custkey % 8) END AS name FROM customer"""
_KNOWN = "SELECT concat(CASE c_custkey % 3 WHEN 0 THEN 'hands-be_' WHEN 1 THEN 'hands-' ELSE 'loft-' END, c_custkey) AS code FROM customer WHERE c_custkey % 11 = 0"


def _asked(t: Tables) -> DataFrame:
    customer = t.raw("customer")
    customer.createOrReplaceTempView("_customer")
    read = lambda sql: t.spark.sql(sql.replace("{S}", "string").replace("FROM customer", "FROM _customer"))
    return op.store_candidates(read(_ASKED), read(_SPOTS).withColumnsRenamed({"code": "store_code", "name": "store_name"}), read(_KNOWN).withColumnRenamed("code", "store_code"))


_PLAIN = "replace(lower(name), ' ', '')"
_CANDIDATES = f"""WITH loc AS (SELECT *, {_PLAIN} AS k FROM ({_SPOTS.replace("{S}", "VARCHAR")})), a AS (SELECT *, {_PLAIN} AS q FROM ({_ASKED.replace("{S}", "VARCHAR")})),
p AS (SELECT a.name, q, code, starts_with(code, 'hands-be_') OR contains(k, 'ハンズビー') AS be, regexp_replace({_HANDS_KEY("k")}, '^(ハンズビー|ハンズ)', '') = q AS exact, code IN ({_KNOWN}) AS known FROM a JOIN loc ON contains(k, q) OR contains(k, replace(q, 'sq', 'スクエア')) OR contains(k, replace(q, 'sq', 'スクランブルスクエア'))),
r AS (SELECT *, NOT regexp_matches(q, 'ビー|^hb') AND bool_or(NOT be) OVER (PARTITION BY name) AS without FROM p), f AS (SELECT * FROM r WHERE NOT (without AND be)),
c AS (SELECT name, count(*) AS n, min(code) AS c1, count(*) FILTER (exact) AS n2, min(code) FILTER (exact) AS c2, count(*) FILTER (known) AS n3, min(code) FILTER (known) AS c3, count(*) FILTER (exact AND known) AS n4, min(code) FILTER (exact AND known) AS c4 FROM f GROUP BY name),
s AS (SELECT name, CASE WHEN n = 1 THEN 1 WHEN n2 = 1 THEN 2 WHEN n3 = 1 THEN 3 WHEN n4 = 1 THEN 4 END AS stage, c1, c2, c3, c4 FROM c)
SELECT name, [c1, c2, c3, c4][stage] AS store_code, stage FROM s WHERE stage IS NOT NULL"""

QUERIES = {
    "store_candidates": (_asked, _CANDIDATES),
    "store_matches_cosmetic": (lambda t: op.cosmetic_matches(_sheet(t), _locations(t)), _COSMETIC),
    "store_matches_truncated": (lambda t: op.truncated_matches(_sheet(t), _locations(t)), _TRUNCATED),
    "store_matches_hands": (lambda t: op.hands_matches(_sheet(t), _locations(t)), _HANDS),
    "order_chains": (_order_chains, _ORDER_CHAINS),
    "introduction_sheet_series": (lambda t: op.series(_rows(t)), _ROWS + "SELECT import_id, series FROM series"),
    "introduction_row_chains": (lambda t: op.introduction_chains(_rows(t), _chains(t)).select("c_custkey", "matched_chain"), _ROWS + "SELECT c_custkey, matched_chain FROM own"),
    "chains_to_refresh": (
        lambda t: op.chains_to_refresh(op.introduction_chains(_rows(t), _chains(t))),
        _ROWS + f"SELECT import_id, matched_chain AS chain FROM own WHERE matched_chain IN ({', '.join(f"'{c}'" for c in op.OFFICIAL)}) UNION SELECT import_id, 'ハンズ' FROM own WHERE starts_with(lower(store_name), 'hb') UNION SELECT import_id, series FROM series WHERE series <> ''",
    ),
    "imports_newest": (
        lambda t: op.newest(_imports(t), 20).select("client_id", "import_id"),
        using("sellout_entries sellout_imports", f", i AS ({_IMPORTS}) SELECT client_id, import_id FROM i QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY imported_at DESC, import_id DESC) <= 20"),
    ),
    "imports_latest_by_chain": (
        lambda t: op.latest_by_chain(_imports(t)).select("client_id", F.trim("chain_name").alias("chain"), "import_id"),
        using(
            "sellout_entries sellout_imports",
            f""", i AS ({_IMPORTS}) SELECT client_id, trim(chain_name) AS chain, import_id FROM i WHERE trim(chain_name) <> '' OR client_id NOT IN (SELECT client_id FROM i WHERE trim(chain_name) <> '')
QUALIFY row_number() OVER (PARTITION BY client_id, trim(chain_name) ORDER BY imported_at DESC, import_id DESC) = 1""",
        ),
    ),
    "store_rows_once": (
        lambda t: op.first_with_address(_store_rows(t)).select("ord"),
        f"""WITH r AS (SELECT CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE 'N' || (l_partkey % 7) || '::' END || CASE WHEN l_suppkey % 4 = 0 THEN 'shop' || l_suppkey ELSE 'code:S' || l_suppkey END AS key, {{'ord': ord, 'd': {_ADDRESS} <> ''}} AS s FROM {_LINES}),
l AS (SELECT key, list(s ORDER BY s.ord) AS rows FROM r GROUP BY key)
SELECT list_reduce(rows, lambda cur, row: CASE WHEN NOT cur.d AND row.d THEN row ELSE cur END).ord AS ord FROM l""",
    ),
    "matrix_rows_once": (
        lambda t: op.one_matrix_row(_matrix_rows(t)).select("key", "ord"),
        f"""WITH r AS (SELECT 'N' || (l_partkey % 5) || '::s' || l_suppkey AS key, {{'ord': ord, 'a': l_returnflag = 'N', 'd': {_ADDRESS} <> ''}} AS s FROM {_LINES}),
l AS (SELECT key, list(s ORDER BY s.ord) AS rows FROM r GROUP BY key)
SELECT key, list_reduce(rows, lambda cur, row: CASE WHEN (NOT cur.a AND row.a) OR (NOT cur.d AND row.d) THEN row ELSE cur END).ord AS ord FROM l""",
    ),
    "destinations_by_wholesaler": (
        lambda t: op.by_wholesaler(_destinations(t), "大山").select("code").unionByName(op.by_wholesaler(_destinations(t), "あらた").select("code")),
        f"""WITH d AS (SELECT (CASE WHEN s_suppkey % 7 = 0 THEN '081701' ELSE 'D' END) || s_suppkey AS code, {_DESTINATION} AS name, CASE WHEN s_suppkey % 6 = 2 THEN 'あらた' ELSE '' END AS alias, CASE WHEN s_suppkey % 10 = 0 THEN '大山' ELSE '' END AS w FROM supplier)
SELECT code FROM d WHERE w = '大山' OR regexp_matches(code || name || alias, '大山|081701') OR regexp_matches(name || alias, 'あらた|アラタ')""",
    ),
    "chain_search": (
        lambda t: op.search_chains(t.raw("customer").select(F.col("c_name").alias("name"), F.array("c_mktsegment", F.concat(F.lit("Mart "), "c_nationkey")).alias("aliases")), " mart 1").select("name"),
        "SELECT c_name AS name FROM customer WHERE contains(lower(c_name), 'mart 1') OR contains(lower(c_mktsegment), 'mart 1') OR contains('mart ' || c_nationkey, 'mart 1')",
    ),
    "product_keyword_search": (
        lambda t: op.search_products(t.products(), t.clients(), " 1 A").select("client_id", "jan"),
        using("products clients", "SELECT client_id, jan FROM products p JOIN clients c ON c.id = client_id WHERE contains(lower(jan || ' ' || p.name || ' ' || internal_sku || ' ' || c.name), '1 a')"),
    ),
    "product_export": (
        lambda t: op.product_export(t.products(), t.products().where("jan LIKE '%7'").select("client_id", "jan")).select("client_id", "jan", "name", "sku", "category"),
        using("products", "SELECT client_id, jan, name, internal_sku AS sku, category FROM products WHERE jan LIKE '%7'"),
    ),
    "jan_cells": (
        lambda t: _cells(t).select("p_partkey", tx.jan_value(F.col("value"), F.col("number")).alias("jan"), tx.jan_cell(F.col("value"), F.col("number")).alias("cell")),
        f"""WITH c AS (SELECT p_partkey, {_CELL} AS v, p_partkey % 8 < 4 AS number FROM part)
SELECT p_partkey, CASE WHEN number OR regexp_matches(trim(v), '^\\d+(\\.\\d+)?[eE]\\+\\d+$') THEN CAST(CAST(trunc(CAST(v AS DOUBLE)) AS BIGINT) AS VARCHAR) WHEN trim(v) IN ('', '_') THEN '' WHEN length(regexp_replace(v, '\\D', '', 'g')) >= 8 THEN replace(v, ' ', '') ELSE '' END AS jan,
  CASE WHEN number THEN CAST(CAST(floor(CAST(v AS DECIMAL(38, 10)) + 5e-1) AS BIGINT) AS VARCHAR) ELSE regexp_replace(replace(v, ' ', ''), '\\.0$', '') END AS cell FROM c""",
    ),
    "product_names": (
        lambda t: _cells(t).select("p_partkey", tx.preferred_name(F.col("formal"), F.col("p_name")).alias("name"), tx.unit_volume(F.when(F.col("p_size") > 3, F.col("p_size")), F.col("unit")).alias("volume"), tx.format_key(F.lit("row-list"), F.col("file")).alias("format")),
        f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' F' ELSE p_name END AS name, CASE WHEN p_size <= 3 THEN '' WHEN trim(coalesce(u, '')) = '' THEN CAST(p_size AS VARCHAR) ELSE p_size || ' ' || CASE WHEN trim(u) = 'ml' THEN 'mL' ELSE trim(u) END END AS volume,
  CASE WHEN p_partkey % 3 = 0 THEN 'promotional-address-list' ELSE 'row-list' END AS format FROM (SELECT *, {_UNIT} AS u FROM part)""",
    ),
    "text_quality": (
        lambda t: t.raw("documents").select("doc_id", tx.has_useful_text(F.col("text")).alias("useful"), tx.text_quality(F.col("text")).alias("quality")),
        f"""WITH t AS (SELECT doc_id, text, regexp_replace(text, '\\s', '', 'g') AS s FROM ({_TEXTS}))
SELECT doc_id, length(regexp_replace(regexp_replace(text, '(?i)--\\s*\\d+\\s*of\\s*\\d+\\s*--', '', 'g'), '\\s', '', 'g')) >= 20 AS useful,
  CAST(length(s) + 200 * len(regexp_extract_all(s, '\\d{{13}}')) + 100 * len(regexp_extract_all(s, '\\d{{4}}[/\\-.年月]\\d{{1,2}}[/\\-.月]\\d{{1,2}}')) + 3 * len(regexp_extract_all(s, '[\\p{{Hiragana}}\\p{{Katakana}}\\p{{Han}}]')) + len(regexp_extract_all(s, '\\d')) AS INTEGER) AS quality FROM t""",
    ),
    "best_texts": (
        lambda t: t.raw("documents").groupBy(F.floor(F.col("doc_id") / 3).alias("page")).agg(F.max_by("doc_id", F.struct(tx.text_quality(F.col("text")), -F.col("doc_id"))).alias("doc_id")),
        f"""WITH t AS (SELECT doc_id, regexp_replace(text, '\\s', '', 'g') AS s FROM ({_TEXTS})),
q AS (SELECT doc_id, length(s) + 200 * len(regexp_extract_all(s, '\\d{{13}}')) + 100 * len(regexp_extract_all(s, '\\d{{4}}[/\\-.年月]\\d{{1,2}}[/\\-.月]\\d{{1,2}}')) + 3 * len(regexp_extract_all(s, '[\\p{{Hiragana}}\\p{{Katakana}}\\p{{Han}}]')) + len(regexp_extract_all(s, '\\d')) AS q FROM t)
SELECT CAST(doc_id // 3 AS BIGINT) AS page, arg_max(doc_id, {{'q': q, 'd': -doc_id}}) AS doc_id FROM q GROUP BY ALL""",
    ),
    "ship_to_blocks": (
        lambda t: t.raw("documents").select("doc_id", tx.ship_to_block(F.expr(_SHIP)).alias("block"), tx.wholesaler(F.expr("concat(CASE doc_id % 3 WHEN 0 THEN 'ｵｵﾔﾏ' WHEN 1 THEN '㈱あらた' ELSE 'x' END, doc_id)")).alias("wholesaler")),
        """SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN '' WHEN doc_id % 3 = 0 THEN 'a\n' || doc_id ELSE 'a\n' || doc_id || '\nc\nd\ne\nf\ng' END AS block, CASE doc_id % 3 WHEN 0 THEN '大山' WHEN 1 THEN 'あらた' ELSE '' END AS wholesaler FROM documents""",
    ),
    "chain_scores": (
        lambda t: _locations(t).select("store_code", F.expr("concat(CASE WHEN store_code LIKE '%5' THEN 'イオンモール ' WHEN store_code LIKE '%6' THEN 'AEON' WHEN store_code LIKE '%7' THEN '＠ｃｏｓｍｅ ' ELSE '' END, store_name)").alias("n")).select("store_code", tx.cosme_score(tx.plain_key(F.col("n"))).alias("cosme"), tx.aeon_score(tx.plain_key(F.col("n"))).alias("aeon")),
        f"""WITH l AS (SELECT {_CODE} AS store_code, {_NAME} AS name FROM customer),
k AS (SELECT store_code, regexp_replace(CASE WHEN store_code LIKE '%5' THEN 'イオンモール' WHEN store_code LIKE '%6' THEN 'aeon' WHEN store_code LIKE '%7' THEN '@cosme' ELSE '' END || name, '[ ー]', '', 'g') AS k FROM l),
tokens(t) AS (VALUES {", ".join(f"('{tx._plain(x)}')" for x in tx.COSME_TOKENS)}),
s AS (SELECT store_code, any_value(k) AS k, CASE WHEN contains(any_value(k), 'cosme') THEN 1000 + length(any_value(k)) ELSE coalesce(max(500 + length(t)) FILTER (contains(k, t) OR contains(t, k)), 0) END AS cosme FROM k, tokens GROUP BY store_code)
SELECT store_code, CAST(cosme AS INTEGER) AS cosme, CAST(CASE WHEN cosme = 0 AND (starts_with(k, 'イオンモル') OR starts_with(k, 'aeon')) THEN length(k) + 200 ELSE 0 END AS INTEGER) AS aeon FROM s""",
    ),
    "introduced_codes": (
        lambda t: op.introduced_codes(t.introductions(), _introduction_imports(t), t.store_locations()),
        using("introductions", "SELECT DISTINCT store_code FROM introductions WHERE is_introduced AND CAST(substr(chain_name, 8) AS INT) % 4 <> 0"),
    ),
    "sellout_store_codes": (
        lambda t: op.sellout_locations(t.sellout_entries().withColumn("retailer", F.when(F.col("store_code").cast("int") % 5 == 0, "ロフト").otherwise(F.col("retailer"))), _loft(t)).select("retailer", "store_code", "matched_code"),
        using("sellout_entries", "SELECT DISTINCT CASE WHEN CAST(store_code AS INT) % 5 = 0 THEN 'ロフト' ELSE retailer END AS retailer, store_code, store_code AS matched_code FROM sellout_entries"),
    ),
    "stores_enriched": (
        lambda t: op.enriched(t.store_locations().select(F.when(F.col("store_code").cast("int") % 2 == 0, F.col("store_code")).otherwise("").alias("store_code"), F.upper("store_name").alias("store_name"), F.lit("own").alias("address")), t.store_locations()),
        using("store_locations", "SELECT store_code, store_name, coalesce(address, 'own') AS address FROM store_locations"),
    ),
    "matrix_store_rows": (
        lambda t: op.matrix_rows(t.introductions().withColumn("chain_name", _official(F.col("chain_name"))), t.store_locations().withColumn("chain_name", _official(F.col("chain_name")))).select("chain_name", "store_code", "store_name"),
        using("introductions store_locations", f"""SELECT {_OFFICIAL_SQL} AS chain_name, store_code, store_name FROM store_locations WHERE CAST(substr(chain_name, 8) AS INT) % 3 = 0
UNION ALL SELECT DISTINCT chain_name, store_code, store_name FROM introductions WHERE CAST(substr(chain_name, 8) AS INT) % 3 <> 0"""),
    ),
    "matrix_row_chains": (
        lambda t: t.raw("customer").select("c_custkey", op.row_chain(F.expr(_CODE), F.expr(_NAME), F.concat(F.lit(" N"), "c_nationkey")).alias("chain")),
        "SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'ハンズ' ELSE 'ロフト' END AS chain FROM customer",
    ),
    "introduction_options": (
        lambda t: op.report_options(t.introductions()),
        using("introductions", "SELECT DISTINCT 'product' AS kind, product_name AS value FROM introductions WHERE is_introduced UNION SELECT 'chain', chain_name FROM introductions"),
    ),
    "payout_order": (
        lambda t: op.numbered(t.orders().select("arrival_due_date", "order_no"), ["arrival_due_date", "order_no"]).select("order_no", "place"),
        using("shop_orders", "SELECT order_no, row_number() OVER (ORDER BY arrival_due_date, order_no) AS place FROM shop_orders"),
    ),
    "sell_in_order": (
        lambda t: op.numbered(t.orders().join(t.order_lines(), F.col("id") == F.col("order_id")).groupBy("order_date", "store_name", "jan").agg(F.sum("qty").alias("qty")), ["order_date", "store_name", "jan"]).select(F.col("order_date").cast("string").alias("date"), "store_name", "jan", "qty", "place"),
        using("shop_orders order_lines", "SELECT CAST(order_date AS VARCHAR) AS date, store_name, jan, CAST(sum(qty) AS BIGINT) AS qty, row_number() OVER (ORDER BY order_date, store_name, jan) AS place FROM shop_orders o JOIN order_lines ON order_id = o.id GROUP BY order_date, store_name, jan"),
    ),
    "introduction_products": (
        lambda t: workbooks.resolve(t.raw("part").select(F.lit("C1").alias("client_id"), F.expr(_SHEET_JAN).alias("jan"), F.expr(_SHEET_NAME).alias("name")), t.products()),
        using(
            "products",
            f""", r AS (SELECT DISTINCT {_SHEET_JAN} AS jan, trim({_SHEET_NAME}) AS name FROM part), k AS (SELECT *, regexp_replace(lower(name), '[ x-]', '', 'g') AS key FROM r),
p AS (SELECT jan, name, regexp_replace(lower(name), '[ x-]', '', 'g') AS key FROM products WHERE client_id = 'C1'),
b AS (SELECT k.jan, k.name, arg_min({{'jan': p.jan, 'name': p.name}}, {{'s': CASE WHEN k.key = p.key THEN -length(p.key) - 1000 ELSE -least(length(k.key), length(p.key)) - 100 END, 'n': p.name, 'j': p.jan}}) AS b FROM k JOIN p ON k.key <> '' AND (contains(k.key, p.key) OR contains(p.key, k.key)) GROUP BY k.jan, k.name)
SELECT 'C1' AS client_id, k.jan, k.name, CASE WHEN j.jan IS NOT NULL THEN k.jan ELSE coalesce(b.b.jan, k.jan) END AS found_jan, CASE WHEN j.jan IS NOT NULL AND k.key <> j.key AND contains(k.key, j.key) AND length(k.key) > length(j.key) + 2 THEN k.name WHEN j.jan IS NOT NULL THEN j.name ELSE coalesce(b.b.name, nullif(k.name, ''), k.jan) END AS found_name
FROM k LEFT JOIN p j ON j.jan = k.jan LEFT JOIN b ON b.jan = k.jan AND b.name = k.name""",
        ),
    ),
    "address_texts": (
        lambda t: t.store_locations().select("store_code", tx.looks_like_address(F.col("address")).alias("is_address"), tx.located_address(F.when(F.col("store_code").cast("int") % 2 == 0, "100-0001"), F.concat(F.lit("1000001 "), F.coalesce("address", F.lit("")))).alias("full"), tx.header_key(F.concat(F.lit("Ｓｔｏｒｅ　"), "chain_name")).alias("header")),
        using(
            "store_locations",
            """SELECT store_code, length(trim(coalesce(address, ''))) >= 4 AND NOT regexp_matches(trim(coalesce(address, '')), '^[0-9]+$') AS is_address,
  concat_ws(' ', CASE WHEN CAST(store_code AS INT) % 2 = 0 THEN '100-0001' END, CASE WHEN address IS NULL THEN '1000001' ELSE address END) AS full, 'store' || lower(chain_name) AS header FROM store_locations""",
        ),
    ),
    "order_review_flags": (
        lambda t: review_flags(t.orders().withColumn("store_name", F.when(F.col("id").cast("int") % 5 > 0, F.col("store_name"))).withColumn("review_reasons", F.when(F.col("id").cast("int") % 3 == 0, F.array(F.lit("店舗名を確認してください"), F.lit("x"))).when(F.col("id").cast("int") % 3 == 1, F.array(F.lit("店舗名を確認してください"))))).select("id", F.size("display_reasons").alias("reasons"), "needs_store", "review"),
        using("shop_orders", "SELECT id, CASE WHEN CAST(id AS INT) % 3 = 0 THEN 1 ELSE 0 END AS reasons, CAST(id AS INT) % 5 = 0 AS needs_store, CAST(id AS INT) % 3 = 0 OR needs_review OR CAST(id AS INT) % 5 = 0 AS review FROM shop_orders"),
    ),
    "introduction_latest_kpis": (
        lambda t: intro.chain_kpis(intro.dedupe(t.introductions().join(op.latest_by_chain(_introduction_imports(t)).select("import_id"), "import_id", "left_semi")), FORMAT),
        using("introductions store_locations", _BASE + "SELECT * FROM kpi WHERE CAST(substr(chain, 8) AS INT) % 4 <> 0"),
    ),
    # Names that the sheets write in upper case, of stores that the master has or lacks; the later of two rows counts, a blank chain keeps the old one.
    "locations_from_entries": (
        lambda t: merge_locations(
            t.store_locations().where("cast(store_code as int) % 3 <> 0"),
            t.introductions().groupBy("store_code").agg(F.upper(F.max("store_name")).alias("store_name"), F.max("ord").alias("ord")).select("store_code", "store_name", F.lit("").alias("chain_name"), F.lit("1-1 sheet").alias("address"), "ord"),
        ),
        using(
            "introductions store_locations",
            """, n AS (SELECT store_code, upper(max(store_name)) AS store_name FROM introductions GROUP BY ALL), o AS (SELECT * FROM store_locations WHERE CAST(store_code AS INT) % 3 <> 0)
SELECT * FROM o WHERE store_code NOT IN (SELECT store_code FROM n) UNION ALL SELECT n.store_code, n.store_name, o.chain_name, '1-1 sheet' FROM n LEFT JOIN o USING (store_code)""",
        ),
    ),
    "chain_upsert": (
        lambda t: insert_or_update(_shops(t, "Mart ").where("ord % 2 = 0").withColumn("id", F.concat(F.lit("old-"), "ord")), _shops(t, "Extra ").where("ord % 3 = 0").withColumn("id", F.concat(F.lit("new-"), "ord")), ["name"]).select("id", "name", F.element_at("aliases", 1).alias("alias")),
        "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'old-' ELSE 'new-' END || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'Extra ' ELSE 'Mart ' END || c_custkey AS alias FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    ),
}
