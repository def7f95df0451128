"""Report files: the maker's shipment rows, sell-in and product exports, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.order_files import OrderFiles

CARRIER, SENDER, UNCOUNTED = "佐川急便宅配便", "FBP", "未計算"

#: Headings of the maker's file, in order. Fixed values.
MAKER_HEADERS = (
    "受注番号", "配送先コード", "ご依頼主名", "配送先名", "配送先郵便番号", "配送先住所1", "配送先住所2", "配送先住所3", "配送先TEL", "配送方法",
    "配達指定日", "時間指定", "請求金額（税込）", "商品コード", "商品名", "出荷数", "単価（税込）", "小計（税込）", "備考", "送り状備考",
)


def maker_rows(orders: DataFrame, lines: DataFrame, products: DataFrame, destinations: DataFrame) -> DataFrame:
    """order_no, line_no and the 20 columns c1..c20 of confirmed and shipped orders; the order's total, added line by line, stands on every line.

    orders: ship_to_center and ship_to_address besides the usual; destinations: code, name, postal_code, address, tel.
    """
    key = lambda c: F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Za-z]", ""))
    dest = destinations.select(key(F.col("code")).alias("code_key"), F.col("code").alias("d_code"), F.col("name").alias("d_name"), F.col("postal_code").alias("d_postal"), F.col("address").alias("d_address"), F.col("tel").alias("d_tel"))
    dest = dest.withColumn("_r", F.row_number().over(Window.partitionBy("code_key").orderBy("d_code"))).where("_r = 1").drop("_r")
    own = orders.where(F.col("status").isin("confirmed", "shipped")).withColumn("code_key", F.nullif(key(F.col("ship_to_center")), F.lit("")))
    head = own.join(dest, "code_key", "left").select(F.col("id").alias("order_id"), "client_id", "order_no", "arrival_due_date", "ship_to_name", "ship_to_center", "ship_to_address", "d_code", "d_name", "d_postal", "d_address", "d_tel")
    prod = products.select("client_id", "jan", F.col("name").alias("p_name"), "wholesale_price", F.col("internal_sku").alias("p_code"))
    rows = lines.join(head, "order_id").join(prod, ["client_id", "jan"], "left")
    price = F.coalesce(F.col("wholesale_price"), F.lit(0.0))
    rows = rows.withColumn("price", price).withColumn("amount", price * F.col("qty"))
    # Doubles are added in the order of the lines, whichever way they arrive.
    whole = Window.partitionBy("order_id").orderBy("line_no", "jan").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("amount").over(whole))
    parts = tx.split_address(F.coalesce("d_address", "ship_to_address"))
    cells: list[Column] = [
        tx.order_number(F.col("order_no")),
        F.coalesce("d_code", "ship_to_center"),
        F.lit(SENDER),
        F.coalesce("d_name", "ship_to_name"),
        F.coalesce("d_postal", F.regexp_extract("ship_to_address", r"\d{3}-?\d{4}", 0)),
        *[F.get(parts, F.lit(i)) for i in range(3)],
        F.coalesce("d_tel", F.lit("")),
        F.lit(CARRIER),
        F.col("arrival_due_date").cast("string"),
        F.lit(""),
        tx.yen(F.col("total")),
        F.coalesce("p_code", F.lit("")),
        F.coalesce("p_name", F.lit("")),
        F.col("qty").cast("string"),
        tx.yen(F.col("price")),
        tx.yen(F.col("amount")),
        F.concat(F.lit("\\"), tx.yen(F.col("amount"))),
        F.lit(""),
    ]
    return rows.select("order_no", "line_no", *[c.alias(f"c{i + 1}") for i, c in enumerate(cells)])


def maker_lines(rows: DataFrame) -> DataFrame:
    """order_no, file, place, line: the text of each order's file, the heading at place 0 and then the order's lines; every cell is quoted."""
    line = lambda cells: F.array_join(F.array(*map(tx.csv_cell, cells)), ",")
    cells = [F.coalesce(F.col(f"c{i + 1}"), F.lit("")) for i in range(len(MAKER_HEADERS))]
    body = rows.select("order_no", F.col("line_no").cast("long").alias("place"), line(cells).alias("line"))
    heads = rows.select("order_no").distinct().select("order_no", F.lit(0).cast("long").alias("place"), F.lit(",".join(f'"{h}"' for h in MAKER_HEADERS)).alias("line"))
    return heads.unionByName(body).withColumn("file", F.concat(file_name(F.col("order_no")), F.lit(".csv"))).select("order_no", "file", "place", "line")


def write_maker_files(rows: DataFrame, path: str, mode: str = "append") -> None:
    """A file of its own for each order, with a byte-order mark, named by its number; path: a folder that all machines share.

    append adds files and refuses names that are there; overwrite replaces the folder's files once all new ones are written.
    """
    rows.sparkSession.dataSource.register(OrderFiles)
    lines = maker_lines(rows).repartition("file").sortWithinPartitions("file", "place").select("file", "line")
    lines.write.format("orderfiles").mode(mode).save(path)


def sell_in_export(rows: DataFrame) -> DataFrame:
    """The eight columns of the sell-in file; amounts that cannot be counted say so."""
    amount = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(UNCOUNTED))
    return rows.select(
        F.col("date").cast("string").alias("日付"), F.col("store_name").alias("店舗"), F.col("jan").alias("JAN"), F.col("product_name").alias("商品名"), F.col("order_count").alias("受注件数"), F.col("qty").alias("数量"), amount("wholesale_amount").alias("卸金額"), amount("retail_amount").alias("上代金額")
    )


def file_name(*parts: Column) -> Column:
    """Parts joined by _, with what file systems refuse replaced."""
    return F.concat_ws("_", *[F.regexp_replace(p, r'[\\/:*?"<>|\s]+', "-") for p in parts])
