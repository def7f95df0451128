"""Sell-in: what was ordered, by day, store and product, at current prices and over all statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pricing import UNREGISTERED, with_products

ALL_STORES = "全店舗"


def poisoned_sum(x: Column) -> Column:
    """A sum that is null as soon as one part is null; 0 without parts."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.coalesce(F.sum(x), F.lit(0)))


def sell_in_lines(orders: DataFrame, lines: DataFrame, products: DataFrame, start: str, end: str, store: str | None = None) -> DataFrame:
    """Priced lines of orders dated within [start, end], of one store or of all."""
    within = orders.where(F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if store is not None:
        within = within.where(F.col("store_name") == store)
    rows = with_products(within, lines, products)
    return rows.select(
        "order_id",
        "line_no",
        F.col("order_date").alias("date"),
        (F.col("store_name") if store is not None else F.lit(ALL_STORES)).alias("store_name"),
        "jan",
        F.when(F.col("registered"), F.col("product_name")).otherwise(UNREGISTERED).alias("product_name"),
        F.col("qty").cast("long").alias("qty"),
        F.floor(F.col("wholesale_price") * F.col("qty")).alias("wholesale_amount"),
        F.floor(F.col("retail_price") * F.col("qty")).alias("retail_amount"),
        F.col("retail_price").isNull().alias("has_issue"),
    )


def sell_in_rows(priced: DataFrame, products: DataFrame, start: str, end: str, search: str = "") -> DataFrame:
    """A row for every day and every active (store, product): sums where there were orders, zeros elsewhere.

    An empty day takes name and issue flag from the pair's last line, and amounts are null where the product, looked up
    by JAN alone, is unknown or has no retail price.
    """
    order = F.struct("date", "order_id", "line_no")
    actual = priced.groupBy("date", "store_name", "jan").agg(
        F.min_by("product_name", order).alias("product_name"),
        F.count_distinct("order_id").alias("order_count"),
        F.sum("qty").alias("qty"),
        poisoned_sum(F.col("wholesale_amount")).alias("wholesale_amount"),
        poisoned_sum(F.col("retail_amount")).alias("retail_amount"),
        F.bool_or("has_issue").alias("has_issue"),
    )
    pairs = priced.groupBy("store_name", "jan").agg(F.max_by(F.struct("product_name", "has_issue"), order).alias("last"))
    by_jan = products.groupBy("jan").agg(F.min_by(F.struct(F.lit(True).alias("known"), F.col("retail_price").isNotNull().alias("priced")), "client_id").alias("p"))
    day = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))) if start <= end else F.explode(F.array().cast("array<date>"))
    grid = pairs.join(by_jan, "jan", "left").select("store_name", "jan", "last", "p", day.alias("date"))
    rows = grid.join(actual, ["date", "store_name", "jan"], "left")
    empty = F.col("order_count").isNull()
    out = rows.select(
        "date",
        "store_name",
        "jan",
        F.when(empty, F.col("last.product_name")).otherwise(F.col("product_name")).alias("product_name"),
        F.coalesce("order_count", F.lit(0)).alias("order_count"),
        F.coalesce("qty", F.lit(0)).alias("qty"),
        F.when(~empty, F.col("wholesale_amount")).when(F.col("p.known"), 0).alias("wholesale_amount"),
        F.when(~empty, F.col("retail_amount")).when(F.col("p.priced"), 0).alias("retail_amount"),
        F.when(empty, F.col("last.has_issue")).otherwise(F.col("has_issue")).alias("has_issue"),
    )
    return matching(out, search)


def matching(rows: DataFrame, search: str) -> DataFrame:
    """Rows whose JAN or product name holds the text, in any case; all rows for a blank text."""
    q = search.strip().lower()
    return rows.where(F.contains(F.lower("jan"), F.lit(q)) | F.contains(F.lower("product_name"), F.lit(q))) if q else rows


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.coalesce(F.sum("qty"), F.lit(0)).alias("qty"),
        poisoned_sum(F.col("wholesale_amount")).alias("wholesale_amount"),
        poisoned_sum(F.col("retail_amount")).alias("retail_amount"),
        F.count_if("has_issue").alias("issues"),
    )


def daily_chart(rows: DataFrame) -> DataFrame:
    return rows.groupBy("date").agg(F.sum("qty").alias("qty"), poisoned_sum(F.col("wholesale_amount")).alias("wholesale_amount"), poisoned_sum(F.col("retail_amount")).alias("retail_amount"))


def product_chart(rows: DataFrame, top: int = 8) -> DataFrame:
    """The `top` product names by quantity; the name breaks ties."""
    return rows.groupBy("product_name").agg(F.sum("qty").alias("qty"), poisoned_sum(F.col("wholesale_amount")).alias("wholesale_amount")).orderBy(F.desc("qty"), "product_name").limit(top)


def order_count(priced: DataFrame, search: str = "") -> DataFrame:
    return matching(priced, search).agg(F.count_distinct("order_id").alias("orders"))


def store_options(orders: DataFrame, lines: DataFrame, start: str, end: str) -> DataFrame:
    """Chains with an order line in the range, whatever the store filter."""
    within = orders.where(F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return within.join(lines.select(F.col("order_id").alias("id")), "id", "left_semi").select("store_name").distinct()
