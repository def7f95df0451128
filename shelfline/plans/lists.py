"""Address lists, product sheets and periods, which Spark derives from the folder's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lists as op
from ..sources.testdata import Tables
from .sheets import _cells, _stores
from .views import using


def _sheet(rows: DataFrame, name: str, heads: list[str], columns: list[str], head_row: int = 0) -> DataFrame:
    head = rows.select("file_id").distinct().select("file_id", F.lit(name).alias("sheet_name"), F.lit(head_row).alias("row_idx"), *[F.lit(h).alias(c) for h, c in zip(heads, columns, strict=True)])
    body = rows.select("file_id", F.lit(name).alias("sheet_name"), "row_idx", *[F.col(c).cast("string").alias(c) for c in columns])
    return _cells(head.unionByName(body), columns)


def _destinations(t: Tables) -> DataFrame:
    """A list for each chain; every code comes twice and every seventh row has no phone number."""
    s = _stores(t).withColumn("row_idx", F.col("no").cast("int"))
    rows = s.select("file_id", "row_idx", F.lit("W").alias("a"), F.concat(F.lit("D"), F.floor(F.col("row_idx") / 2)).alias("b"), F.col("store_name").alias("c"), F.lit("1000001").alias("d"), F.lit("東京都 1-2").alias("e"), F.when(F.col("n") % 7 == 0, "").otherwise("03-1").alias("f"))
    return _sheet(rows, "list", ["卸名", "センター コード", "センター名", "郵便番号", "住所", "TEL"], list("abcdef"))


def _book(t: Tables) -> DataFrame:
    s = _stores(t).withColumn("row_idx", F.col("no").cast("int"))
    return _sheet(s.select("file_id", "row_idx", F.col("no").alias("a"), F.col("store_name").alias("b"), F.coalesce("address", F.lit("")).alias("c")), "住所録", ["店番", "店名", "住所"], list("abc"), 3)


def _sides(t: Tables) -> DataFrame:
    """Branches over five rows each; every other row has its address on the right only."""
    s = _stores(t).withColumn("row_idx", F.col("no").cast("int"))
    left = F.col("row_idx") % 2 == 0
    pick = lambda v, here: F.when(here, v).otherwise("")
    rows = s.select(
        "file_id",
        F.lit("both").alias("sheet_name"),
        "row_idx",
        pick(F.concat(F.lit("branch "), F.floor(F.col("row_idx") / 5)), F.col("row_idx") % 5 == 0).alias("a"),
        pick(F.col("store_name"), left).alias("b"),
        F.lit("100-0001").alias("c"),
        pick(F.col("no"), left).alias("d"),
        F.lit("").alias("e"),
        F.lit("").alias("f"),
        F.lit("").alias("g"),
        pick(F.col("store_name"), ~left).alias("h"),
        F.lit("").alias("i"),
        pick(F.col("no"), ~left).alias("j"),
    )
    return _cells(rows, list("abcdefghij"))


def _products(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    p = t.raw("part").select(F.concat(F.lit("file-"), k % 10).alias("file_id"), (k + 5).cast("int").alias("row_idx"), F.when(k % 11 == 0, "12").otherwise(F.concat(F.lit("49"), F.lpad(k.cast("string"), 11, "0"))).alias("a"), F.col("p_name").alias("b"), F.when(k % 13 == 0, "free").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("円"))).alias("c"), F.lit("").alias("d"), F.lit("10%").alias("e"))
    return _sheet(p, "products", ["JANコード", "商品名", "卸単価", "上代", "税率"], list("abcde"), 4)


def _periods(t: Tables) -> DataFrame:
    e = t.sellout_imports()
    text = F.concat(F.lit("期間："), F.date_format("period_start", "yyyy年M月d日"), F.lit(" ~ "), F.date_format("period_end", "yyyy年M月d日"))
    return e.select(F.col("import_id").alias("file_id"), F.lit("s").alias("sheet_name"), F.posexplode(F.array(F.lit("title"), text, F.lit("2001年1月1日 ~ 2001年1月2日"))).alias("row_idx", "value")).withColumn("col_idx", F.lit(2))


_S = ", s AS (SELECT chain_name AS file_id, 9 + row_number() OVER (PARTITION BY chain_name ORDER BY store_code) AS r, store_name, address, CAST(store_code AS INT) AS n FROM store_locations)\n"

QUERIES = {
    "destination_list": (
        lambda t: op.destinations(_destinations(t))[0].select("file_id", "code", "name", "postal_code", "tel"),
        using("store_locations", _S + "SELECT file_id, 'D' || (r // 2) AS code, store_name AS name, '100-0001' AS postal_code, '03-1' AS tel FROM s WHERE n % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY file_id, r // 2 ORDER BY r DESC) = 1"),
    ),
    "destination_list_errors": (
        lambda t: op.destinations(_destinations(t))[1].select("file_id", F.col("row_number").cast("long").alias("row_number"), "field"),
        using("store_locations", _S + "SELECT file_id, r + 1 AS row_number, 'tel' AS field FROM s WHERE n % 7 = 0"),
    ),
    "address_book": (
        lambda t: op.enriched(_stores(t).select("file_id", F.col("no").alias("store_code"), F.lit("").alias("address")), op.address_book(_book(t))),
        using("store_locations", _S + "SELECT file_id, CAST(r AS VARCHAR) AS store_code, address FROM s"),
    ),
    "two_sided_list": (
        lambda t: op.two_sided(_sides(t), 10).select("file_id", F.col("row_idx").cast("long").alias("row_idx"), "name", "postal", "address", "branch"),
        using("store_locations", _S + "SELECT file_id, r AS row_idx, store_name AS name, '100-0001' AS postal, CAST(r AS VARCHAR) AS address, 'branch ' || (r // 5) AS branch FROM s"),
    ),
    "product_sheet": (
        lambda t: op.products(_products(t))[0].drop("row_number"),
        "SELECT 'file-' || (p_partkey % 10) AS file_id, '49' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS jan, p_name AS name, CAST(p_size AS DOUBLE) AS wholesale_price, CAST(NULL AS DOUBLE) AS retail_price, 10e0 / 100 AS tax_rate FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0",
    ),
    "product_sheet_errors": (
        lambda t: op.products(_products(t))[1].select("file_id", F.col("row_number").cast("long").alias("row_number"), "field"),
        "SELECT 'file-' || (p_partkey % 10) AS file_id, p_partkey + 6 AS row_number, 'jan' AS field FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT 'file-' || (p_partkey % 10), p_partkey + 6, 'wholesale_price' FROM part WHERE p_partkey % 13 = 0",
    ),
    "sheet_periods": (
        lambda t: op.period(_periods(t)).drop("sheet_name"),
        using("sellout_entries sellout_imports", "SELECT import_id AS file_id, CAST(period_start AS VARCHAR) AS period_start, CAST(period_end AS VARCHAR) AS period_end FROM sellout_imports"),
    ),
}
