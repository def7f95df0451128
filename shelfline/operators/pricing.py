"""Prices and amounts of order lines, in double arithmetic and in a fixed order of operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_FEE = 0.08
UNREGISTERED = "未登録"


def half_up(x: Column) -> Column:
    """Rounds to a whole number, halves upwards."""
    return F.floor(x + F.lit(0.5))


def payout_rate(wholesale: Column, retail: Column) -> Column:
    """wholesale / retail, null unless both are positive."""
    return F.when((wholesale > 0) & (retail > 0), wholesale / retail)


def payout_amount(retail: Column, qty: Column, rate: Column, fee: Column) -> Column:
    """floor(retail x qty x (rate - fee)); null unless the rate is above the fee."""
    return F.when(rate > fee, F.floor(retail * qty * (rate - fee)))


def line_amount(status: Column, stored: Column, price: Column, qty: Column) -> Column:
    """The stored amount of a line past import; else the current price times quantity, 0 if unknown."""
    return F.coalesce(F.when(status != "imported", stored), F.floor(price * qty), F.lit(0))


def fee_of(clients: DataFrame) -> DataFrame:
    """client_id, fee: the default where a client has none."""
    return clients.select(F.col("id").alias("client_id"), F.coalesce("fbp_fee_rate", F.lit(DEFAULT_FEE)).alias("fee"))


def with_products(orders: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with the order's client, date, status and store, and the product of (client, jan) where there is one."""
    head = orders.select(F.col("id").alias("order_id"), "client_id", "order_no", "order_date", "arrival_due_date", "status", "store_name")
    prod = products.select("client_id", "jan", F.col("name").alias("product_name"), "wholesale_price", "retail_price", F.lit(True).alias("registered"))
    joined = lines.join(head, "order_id").join(prod, ["client_id", "jan"], "left")
    return joined.withColumn("registered", F.coalesce("registered", F.lit(False)))
