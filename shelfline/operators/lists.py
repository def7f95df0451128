"""Address lists over the long cells table: destination lists, address books, two-sided sheets, product sheets, periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .cells import fill_down
from .imports import latest
from .sheets import SHEET, _at, _columns, _header_row, rows_of
from .stores import OFFICIAL

#: Header words of a destination list, by field. Fixed values.
DESTINATION = {"wholesaler_name": ("卸名", "問屋名", "卸"), "code": ("配送先コード", "センターコード", "コード"), "name": ("配送先名", "センター名", "名称"), "postal_code": ("郵便番号",), "address": ("住所", "住所1"), "tel": ("電話番号", "tel"), "aliases": ("別名",)}
REQUIRED = ("wholesaler_name", "code", "name", "postal_code", "address", "tel")

#: Header words of a product sheet, by field. Fixed values.
PRODUCT = {"jan": ("janコード", "jan"), "name": ("商品名", "商品名称"), "wholesale_price": ("卸単価", "卸価格"), "retail_price": ("上代", "小売価格"), "tax_rate": ("税率",)}
PRICES = ("wholesale_price", "retail_price")


def destinations(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each (wholesaler, code), the last of the sheet; errors of rows that lack a required field)."""
    cols = _columns(cells, _header_row(cells, [DESTINATION["code"], DESTINATION["name"]]), {f"i_{k}": v for k, v in DESTINATION.items()})
    rows = rows_of(cells).join(cols, SHEET).where("row_idx > head")
    typed = rows.select(*SHEET, "row_idx", *[_at(F.col(f"i_{k}")).alias(k) for k in DESTINATION]).withColumn("postal_code", tx.postal(F.col("postal_code")))
    missing = F.array_compact(F.array(*[F.when(F.col(k) == "", F.lit(k)) for k in REQUIRED]))
    judged = typed.withColumn("missing", missing)
    good = latest(judged.where(F.size("missing") == 0), [F.col(x) for x in (*SHEET, "wholesaler_name", "code")], [F.desc("row_idx")])
    bad = judged.where(F.size("missing") > 0).select(*SHEET, (F.col("row_idx") + 1).alias("row_number"), F.explode("missing").alias("field"), F.lit("required").alias("message"))
    return good.drop("missing", "row_idx").withColumn("aliases", tx.aliases(F.col("aliases"))), bad


def address_book(cells: DataFrame) -> DataFrame:
    """store_code, store_name, address, postal_code of sheets with the three headings; the last row of a code wins."""
    fields = {"i_code": ("店番", "店舗コード", "店コード"), "i_name": ("店名", "店舗名"), "i_addr": ("住所", "住所1"), "i_post": ("郵便番号",)}
    cols = _columns(cells, _header_row(cells, [fields["i_code"], fields["i_name"], fields["i_addr"]]), fields)
    rows = rows_of(cells).join(cols, SHEET).where("row_idx > head")
    out = rows.select(*SHEET, "row_idx", _at(F.col("i_code")).alias("store_code"), _at(F.col("i_name")).alias("store_name"), _at(F.col("i_addr")).alias("address"), tx.postal(_at(F.col("i_post"))).alias("postal_code"))
    return latest(out.where("store_code <> '' AND address <> ''"), [F.col("file_id"), F.col("store_code")], [F.desc("sheet_name"), F.desc("row_idx")]).drop("row_idx", "sheet_name")


def enriched(entries: DataFrame, book: DataFrame) -> DataFrame:
    """Entries (file_id, store_code, address) with the book's address where they have none."""
    b = book.select("file_id", "store_code", F.col("address").alias("_a"))
    return entries.join(b, ["file_id", "store_code"], "left").withColumn("address", tx.first_filled(F.col("address"), F.col("_a"))).drop("_a")


def two_sided(cells: DataFrame, first_row: int = 8, right: int = 6) -> DataFrame:
    """Branch, name, postal code and address from the left block (columns 0 to 3), gaps filled from the right one; blank branches take the one above."""
    branch = fill_down(cells.where(F.col("row_idx") >= first_row), 0).withColumnRenamed("value", "branch")
    rows = rows_of(cells).where(F.col("row_idx") >= first_row)
    side = lambda i: tx.first_filled(_at(i), _at(right + i), "")
    out = rows.select(*SHEET, "row_idx", side(1).alias("name"), tx.postal(side(2)).alias("postal"), side(3).alias("address")).join(branch, [*SHEET, "row_idx"])
    return out.where("name <> '' AND postal <> ''")


def products(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_id, row_number, jan and typed fields; errors of rows whose JAN or prices cannot be read). Rows without JAN and name are passed over."""
    cols = _columns(cells, _header_row(cells, [PRODUCT["jan"], PRODUCT["name"]]), {f"i_{k}": v for k, v in PRODUCT.items()})
    rows = rows_of(cells).join(cols, SHEET).where("row_idx > head").select(*SHEET, (F.col("row_idx") + 1).alias("row_number"), *[_at(F.col(f"i_{k}")).alias(k) for k in PRODUCT]).where("jan <> '' OR name <> ''")
    faults = F.array_compact(F.array(F.when((F.col("jan") != "") & (tx.jan_digits(F.col("jan")) == ""), F.lit("jan")), *[F.when((F.col(p) != "") & tx.money(F.col(p)).isNull(), F.lit(p)) for p in PRICES]))
    judged = rows.withColumn("faults", faults)
    good = judged.where(F.size("faults") == 0).select("file_id", "row_number", tx.jan_digits(F.col("jan")).alias("jan"), "name", *[tx.money(F.nullif(F.col(p), F.lit(""))).alias(p) for p in PRICES], tx.tax_rate(F.nullif("tax_rate", F.lit(""))).alias("tax_rate"))
    return good, judged.select("file_id", "row_number", F.explode("faults").alias("field"))


def period(cells: DataFrame, pattern: str = r"(\d{4})年(\d{1,2})月(\d{1,2})日\s*[~〜～-]\s*(\d{4})年(\d{1,2})月(\d{1,2})日", rows: int = 20) -> DataFrame:
    """file_id, sheet_name, period_start, period_end from the first cell of the first rows that holds a period."""
    part = lambda i: F.lpad(F.regexp_extract("value", pattern, i), 2, "0")
    day = lambda i: F.concat_ws("-", F.regexp_extract("value", pattern, i), part(i + 1), part(i + 2))
    found = cells.where((F.col("row_idx") < rows) & F.col("value").rlike(pattern)).select(*SHEET, "row_idx", "col_idx", day(1).alias("s"), day(4).alias("e"))
    return found.groupBy(*SHEET).agg(F.min_by(F.struct("s", "e"), F.struct("row_idx", "col_idx")).alias("p")).select(*SHEET, F.col("p.s").alias("period_start"), F.col("p.e").alias("period_end"))


def in_order(rows: DataFrame, group: str, name: str, ties: list[str], locale: str = "ja") -> DataFrame:
    """Rows with place, from 1: groups in the locale's order, names within a group likewise, then ties. Only a group's rows meet in
    a task; the groups' sizes give the places before them.
    """
    by = lambda c: F.expr(f"coalesce(`{c}`, '') collate {locale}")
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    ahead = Window.orderBy(by(group), group).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col(group).alias("_g"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    own = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(by(name), name, *ties)))
    return own.join(before, F.col(group).eqNullSafe(F.col("_g"))).withColumn("place", F.col("_before") + F.col("_r")).drop("_g", "_before", "_r")


#: Words in the names of sheets and stores of an address book that tell its chain. Fixed values.
BOOK_CHAINS = (("アインズ", "アインズ|ｱｲﾝｽﾞ", "(?i)アインズ|ainz"), ("インキューブ", "(?i)インキューブ|incube", "(?i)インキューブ|incube"))


def book_locations(book: DataFrame) -> DataFrame:
    """store_code, store_name, chain_name, address, ord of address books' rows with code and address, for an upsert of locations.

    book: file_id, sheet_name, store_code, store_name, address, ord. A file's chain is what its sheets' or stores' names tell,
    else blank; files of chains with an official list give none.
    """
    rows = book.where((F.coalesce("store_code", F.lit("")) != "") & (tx.trim(F.col("address")) != ""))
    flags = [F.max(F.coalesce(F.col("sheet_name").rlike(a) | F.coalesce("store_name", F.lit("")).rlike(b), F.lit(False))).alias(f"_{i}") for i, (_, a, b) in enumerate(BOOK_CHAINS)]
    chain = F.coalesce(*[F.when(F.col(f"_{i}"), name) for i, (name, _, _) in enumerate(BOOK_CHAINS)], F.lit(""))
    files = rows.groupBy("file_id").agg(*flags).select("file_id", chain.alias("chain_name")).where(~F.col("chain_name").isin(*OFFICIAL))
    return rows.join(files, "file_id").select("store_code", "store_name", "chain_name", "address", "ord")
