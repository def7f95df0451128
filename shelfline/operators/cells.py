"""Spreadsheet layouts over a long cells table: file_id, sheet_name, row_idx, col_idx, value (text).

A workbook is decoded elsewhere; here many files' cells become entries at once.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Header words of the sell-out row list, by field. Fixed values.
ROW_LIST = {"store_code": ("店舗cd", "店舗コード"), "store_name": ("店舗", "店舗名"), "jan": ("jan", "janコード"), "product_name": ("商品", "商品名"), "qty": ("売上", "数量"), "amount": ("金額", "売上金額"), "stock": ("在庫",)}
TOTAL_CODE = "9999"
TOTAL_BLOCK = "全社計"


def headers(cells: DataFrame, synonyms: dict[str, tuple[str, ...]], header_row: int = 0) -> DataFrame:
    """file_id, sheet_name, col_idx, field: which column of each sheet holds which field; the first fitting column wins."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(w).alias("word")) for f, ws in synonyms.items() for w in ws]))
    words = cells.sparkSession.range(1).select(pairs.alias("p")).select("p.*")
    key = F.lower(F.regexp_replace("value", f"[{tx.BLANK}]", ""))
    heads = cells.where(F.col("row_idx") == header_row).withColumn("word", key).join(F.broadcast(words), "word")
    return heads.groupBy("file_id", "sheet_name", "field").agg(F.min("col_idx").alias("col_idx"))


def row_list(cells: DataFrame, synonyms: dict[str, tuple[str, ...]] = ROW_LIST, header_row: int = 0) -> DataFrame:
    """Entries of a list with one row per sale; the date stands in column 0. Total rows and rows without a date are left out."""
    per = ["file_id", "sheet_name"]
    cols = headers(cells, synonyms, header_row).groupBy(*per).agg(*[F.max(F.when(F.col("field") == f, F.col("col_idx"))).alias(f"_{f}") for f in synonyms])
    body = cells.where(F.col("row_idx") > header_row).join(cols, per, "left")
    of = {"day": F.col("col_idx") == 0} | {f: F.col("col_idx") == F.col(f"_{f}") for f in synonyms}
    wide = body.where(reduce(or_, of.values())).groupBy(*per, "row_idx").agg(*[F.max(F.when(own, F.col("value"))).alias(f) for f, own in of.items()])
    day = F.regexp_extract(tx.trim(F.col("day")), r"^(\d{4})(\d{2})(\d{2})$", 0)
    rows = wide.where((day != "") & (tx.trim(F.col("store_code")) != TOTAL_CODE))
    return rows.select(
        "file_id",
        "row_idx",
        F.try_to_date(day, "yyyyMMdd").alias("day"),
        tx.trim(F.col("store_code")).alias("store_code"),
        tx.trim(F.col("store_name")).alias("store_name"),
        tx.jan_digits(F.col("jan")).alias("jan"),
        tx.trim(F.col("product_name")).alias("product_name"),
        F.coalesce(tx.whole_number(F.col("qty")), F.lit(0)).alias("qty"),
        F.coalesce(tx.whole_number(F.col("amount")), F.lit(0)).alias("amount"),
        tx.whole_number(F.col("stock")).alias("stock"),
    )


def matrix(cells: DataFrame, store_row: int = 9, metric_row: int = 10, first_col: int = 10, metrics: tuple[str, ...] = ("qty", "amount", "stock"), jan_col: int = 0, name_col: int = 1) -> DataFrame:
    """Entries of a sheet with a block of metric columns for each store: unpivoted, without the total block and all-empty cells."""
    n = len(metrics)
    blocks = cells.where((F.col("row_idx") == store_row) & (F.col("col_idx") >= first_col) & ((F.col("col_idx") - first_col) % n == 0) & (tx.trim(F.col("value")) != "")).select(
        "file_id", "sheet_name", F.floor((F.col("col_idx") - first_col) / n).alias("block"), tx.trim(F.col("value")).alias("store_name")
    ).where(F.col("store_name") != TOTAL_BLOCK)
    left = cells.where((F.col("row_idx") > metric_row) & F.col("col_idx").isin(jan_col, name_col)).groupBy("file_id", "sheet_name", "row_idx").agg(
        F.max(F.when(F.col("col_idx") == jan_col, tx.jan_digits(F.col("value")))).alias("jan"), F.max(F.when(F.col("col_idx") == name_col, tx.trim(F.col("value")))).alias("product_name")
    )
    values = cells.where((F.col("row_idx") > metric_row) & (F.col("col_idx") >= first_col)).select(
        "file_id", "sheet_name", "row_idx", F.floor((F.col("col_idx") - first_col) / n).alias("block"), ((F.col("col_idx") - first_col) % n).alias("m"), tx.whole_number(F.col("value")).alias("v")
    )
    per = values.groupBy("file_id", "sheet_name", "row_idx", "block").agg(*[F.max(F.when(F.col("m") == i, F.col("v"))).alias(k) for i, k in enumerate(metrics)])
    rows = per.join(blocks, ["file_id", "sheet_name", "block"]).join(left.where("jan <> ''"), ["file_id", "sheet_name", "row_idx"])
    some = (F.coalesce("qty", F.lit(0)) != 0) | (F.coalesce("amount", F.lit(0)) != 0) | F.col("stock").isNotNull()
    return rows.where(some).select("file_id", "row_idx", "store_name", "jan", "product_name", F.coalesce("qty", F.lit(0)).alias("qty"), F.coalesce("amount", F.lit(0)).alias("amount"), "stock")


def fill_down(cells: DataFrame, col: int) -> DataFrame:
    """file_id, sheet_name, row_idx, value: a column whose blanks take the last value above."""
    own = cells.where(F.col("col_idx") == col).withColumn("value", F.nullif(tx.trim(F.col("value")), F.lit("")))
    w = Window.partitionBy("file_id", "sheet_name").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("file_id", "sheet_name", "row_idx", F.last("value", ignorenulls=True).over(w).alias("value"))


def until_gap(rows: DataFrame, has_data: Column) -> DataFrame:
    """Rows of each sheet up to the first one without data that follows data; rows before the first data are dropped too."""
    w = Window.partitionBy("file_id", "sheet_name").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(has_data.cast("int")).over(w)
    gaps = F.sum(F.when(~has_data & (F.col("_seen") == 1), 1).otherwise(0)).over(w)
    return rows.withColumn("_seen", seen).withColumn("_gaps", gaps).where((F.col("_gaps") == 0) & (F.col("_seen") == 1)).drop("_seen", "_gaps")


def profile(cells: DataFrame, profiles: list[tuple[str, list[str]]], header_row: int = 0) -> DataFrame:
    """file_id, profile: the first profile all of whose header words a sheet of the file holds."""
    key = F.lower(F.regexp_replace("value", f"[{tx.BLANK}]", ""))
    heads = cells.where(F.col("row_idx") == header_row).groupBy("file_id", "sheet_name").agg(F.collect_set(key).alias("heads"))
    fits = [F.when(F.size(F.array_except(F.array(*map(F.lit, words)), "heads")) == 0, F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"))) for i, (name, words) in enumerate(profiles)]
    return heads.select("file_id", F.array_min(F.array_compact(F.array(*fits))).alias("p")).groupBy("file_id").agg(F.min("p").alias("p")).select("file_id", F.col("p.name").alias("profile")).where("profile IS NOT NULL")
