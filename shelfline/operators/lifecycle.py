"""Orders through their life: order totals, confirm, ship, undo, delete, payouts and integrity checks.

A transition returns new orders and lines and the orders that it refused with the reason; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pricing import DEFAULT_FEE, fee_of, half_up, line_amount, payout_amount, payout_rate, with_products

SNAPSHOTS = ("unit_price_snapshot", "amount", "retail_price_snapshot", "payout_rate_snapshot", "fbp_fee_rate_snapshot", "payout_amount")
STATUSES = ("imported", "confirmed", "shipping_instructed", "shipped")
TAX = 0.1


def confirm(orders: DataFrame, lines: DataFrame, products: DataFrame, clients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of the orders that can be confirmed, with price snapshots; refused orders with a reason).

    An order is refused if a line's product is not registered, or if a payout cannot be computed.
    """
    open_ = orders.where("status = 'imported'")
    priced = with_products(open_, lines, products).join(fee_of(clients), "client_id")
    rate = payout_rate(F.col("wholesale_price"), F.col("retail_price"))
    rows = priced.select(
        "order_id",
        "line_no",
        "jan",
        "qty",
        "registered",
        F.col("wholesale_price").alias("unit_price_snapshot"),
        F.floor(F.col("wholesale_price") * F.col("qty")).alias("amount"),
        F.col("retail_price").alias("retail_price_snapshot"),
        rate.alias("payout_rate_snapshot"),
        F.col("fee").alias("fbp_fee_rate_snapshot"),
        payout_amount(F.col("retail_price"), F.col("qty"), rate, F.col("fee")).alias("payout_amount"),
    )
    refused = rows.groupBy("order_id").agg(
        F.when(F.bool_or(~F.col("registered")), "product missing").when(F.bool_or(F.col("payout_amount").isNull()), "payout missing").alias("reason")
    ).where("reason IS NOT NULL")
    return rows.join(refused, "order_id", "left_anti").drop("registered"), refused


def undo_confirm(orders: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed orders become imported and their lines lose the snapshots."""
    confirmed = orders.where("status = 'confirmed'").select(F.col("id").alias("order_id"), F.lit(True).alias("_c"))
    kinds = dict(lines.dtypes)
    back = lines.join(confirmed, "order_id", "left")
    for c in SNAPSHOTS:
        if c in kinds:
            back = back.withColumn(c, F.when(F.col("_c").isNull(), F.col(c)))
    return orders.withColumn("status", F.when(F.col("status") == "confirmed", "imported").otherwise(F.col("status"))), back.drop("_c")


def ship(orders: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orders that may ship: confirmed, with a payout snapshot on every line; refused orders)."""
    confirmed = orders.where("status = 'confirmed'")
    incomplete = lines.where(F.col("payout_amount").isNull() | F.col("retail_price_snapshot").isNull() | F.col("payout_rate_snapshot").isNull()).select(F.col("order_id").alias("id")).distinct()
    return confirmed.join(incomplete, "id", "left_anti").withColumn("status", F.lit("shipped")), confirmed.join(incomplete, "id", "left_semi")


def unship(orders: DataFrame) -> DataFrame:
    return orders.withColumn("status", F.when(F.col("status") == "shipped", "confirmed").otherwise(F.col("status")))


def delete(orders: DataFrame, lines: DataFrame, wanted: DataFrame, operator: str, at: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(orders left, lines left, log rows, refused). wanted: id, client_id, order_no; an order is found by id, else by client and number.

    Instructed and shipped orders are refused. Orders that are already gone are no error and leave no log.
    """
    by_id = wanted.where("id IS NOT NULL").select("id").join(orders, "id", "left_semi")
    by_number = wanted.join(orders.select("id"), "id", "left_anti").drop("id").join(orders.select("id", "client_id", "order_no"), ["client_id", "order_no"]).select("id")
    found = orders.join(by_id.unionByName(by_number).distinct(), "id", "left_semi")
    refused = found.where(F.col("status").isin("shipping_instructed", "shipped"))
    gone = found.where(~F.col("status").isin("shipping_instructed", "shipped"))
    count = lines.groupBy(F.col("order_id").alias("id")).agg(F.count("*").alias("line_count"))
    log = gone.join(count, "id", "left").select(
        F.col("id").alias("target_id"),
        "client_id",
        F.lit("order").alias("target_type"),
        "order_no",
        F.col("source_file").alias("file_name"),
        F.col("status").alias("order_status"),
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.lit(operator).alias("operator_name"),
        at.alias("deleted_at"),
    )
    ids = gone.select("id")
    return orders.join(ids, "id", "left_anti"), lines.join(ids.withColumnRenamed("id", "order_id"), "order_id", "left_anti"), log, refused


def deletions(log: DataFrame, client: str | None = None) -> DataFrame:
    """The deletion log of a client, or of all, with place: newest first within a client, then by target."""
    own = log if client is None else log.where(F.col("client_id") == client)
    return own.withColumn("place", F.row_number().over(Window.partitionBy("client_id").orderBy(F.desc("deleted_at"), "target_id")))


def order_totals(orders: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    """Amount of each order: current prices while it is imported, stored amounts after; unknown products count 0."""
    rows = with_products(orders, lines, products)
    stored = F.col("amount") if "amount" in lines.columns else F.lit(None).cast("long")
    return rows.groupBy("order_id").agg(F.sum(line_amount(F.col("status"), stored, F.col("wholesale_price"), F.col("qty"))).alias("total"))


def client_totals(orders: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    totals = order_totals(orders, lines, products)
    return orders.select(F.col("id").alias("order_id"), "client_id").join(totals, "order_id", "left").groupBy("client_id").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


def payout_lines(orders: DataFrame, lines: DataFrame, month: str) -> DataFrame:
    """Snapshot lines of shipped orders that arrive in the month (yyyy-MM)."""
    own = orders.where((F.col("status") == "shipped") & in_month(F.col("arrival_due_date"), month))
    return lines.join(own.select(F.col("id").alias("order_id"), "client_id", "order_no", "arrival_due_date"), "order_id").withColumn("fbp_fee_rate_snapshot", F.coalesce("fbp_fee_rate_snapshot", F.lit(DEFAULT_FEE)))


def payout_totals(rows: DataFrame) -> DataFrame:
    """Sum of floored wholesale amounts less the rounded sum of fees; not the sum of the lines' payouts."""
    goods = F.coalesce(F.sum(F.floor(F.coalesce("unit_price_snapshot", F.lit(0.0)) * F.col("qty"))), F.lit(0))
    fees = F.coalesce(F.sum(F.coalesce("retail_price_snapshot", F.lit(0.0)) * F.col("qty") * F.col("fbp_fee_rate_snapshot")), F.lit(0.0))
    return rows.agg((goods - half_up(fees)).alias("payout_total"), F.coalesce(F.sum("qty"), F.lit(0)).alias("qty"), F.count_if(F.col("payout_amount").isNull()).alias("missing"))


def in_month(day: Column, month: str) -> Column:
    return F.substring(F.translate(day.cast("string"), "/", "-"), 1, 7) == month


def in_period(at: Column, period: str, as_of: str, start: str | None = None, end: str | None = None) -> Column:
    """Whether a time lies in all / this_month / last_month / custom (both days included); an unreadable time does not."""
    now = F.lit(as_of).cast("date")
    if period == "all":
        return F.lit(True)
    if period in ("this_month", "last_month"):
        first = F.trunc(now, "MM") if period == "this_month" else F.add_months(F.trunc(now, "MM"), -1)
        return F.coalesce(F.trunc(at, "MM") == first, F.lit(False))
    inside = at.isNotNull()
    if start:
        inside &= at.cast("date") >= F.lit(start).cast("date")
    if end:
        inside &= at.cast("date") <= F.lit(end).cast("date")
    return F.coalesce(inside, F.lit(False))


def order_list(orders: DataFrame, search: str = "", status: str = "all", period: str = "all", as_of: str = "1970-01-01") -> DataFrame:
    """The workbench list: text over number, file, ship-to and warehouse; imported first, then confirmed, then the rest."""
    text = F.lower(F.concat_ws(" ", "order_no", "source_file", "ship_to_name", "warehouse"))
    own = orders.where(F.contains(text, F.lit(search.strip().lower())) & in_period(F.col("imported_at"), period, as_of))
    if status != "all":
        own = own.where(F.col("status") == status)
    rank = F.when(F.col("status") == "imported", 0).when(F.col("status") == "confirmed", 1).otherwise(2)
    return own.withColumn("rank", rank).orderBy("rank", F.desc(F.coalesce(F.col("arrival_due_date").cast("string"), F.lit("9999-12-31"))), F.desc("order_no"))


def history(orders: DataFrame) -> DataFrame:
    """Per client: checked (confirmed or shipped), sent (shipped), and all orders."""
    return orders.groupBy("client_id").agg(
        F.count_if(F.col("status").isin("confirmed", "shipped")).alias("checked"), F.count_if(F.col("status") == "shipped").alias("sent"), F.count("*").alias("orders")
    )


def violations(orders: DataFrame, lines: DataFrame, products: DataFrame, clients: DataFrame) -> DataFrame:
    """rule, rows: how many rows break each rule; all zero in a sound store. A product's rate must be above its client's fee, or the default one."""
    fees = clients.select(F.col("id").alias("client_id"), F.coalesce("fbp_fee_rate", F.lit(DEFAULT_FEE)).alias("fee"))
    priced = products.join(fees, "client_id", "left").withColumn("fee", F.coalesce("fee", F.lit(DEFAULT_FEE)))
    snapshots = [F.col(c).isNull() for c in SNAPSHOTS if c in lines.columns]
    rules = [
        orders.groupBy("client_id", "order_no").count().where("count > 1").agg(F.lit("order number twice").alias("rule"), F.count("*").alias("rows")),
        products.groupBy("client_id", "jan").count().where("count > 1").agg(F.lit("product twice").alias("rule"), F.count("*").alias("rows")),
        orders.agg(F.lit("unknown status").alias("rule"), F.count_if(~F.col("status").isin(*STATUSES)).alias("rows")),
        lines.agg(F.lit("quantity not positive").alias("rule"), F.count_if(~(F.col("qty") > 0)).alias("rows")),
        products.agg(F.lit("negative price").alias("rule"), F.count_if((F.col("wholesale_price") < 0) | (F.col("retail_price") < 0)).alias("rows")),
        priced.agg(F.lit("rate not above fee").alias("rule"), F.count_if(payout_rate(F.col("wholesale_price"), F.col("retail_price")) <= F.col("fee")).alias("rows")),
    ]
    if snapshots:
        some = F.lit(0)
        for s in snapshots:
            some += s.cast("int")
        rules.append(lines.agg(F.lit("snapshots not all or none").alias("rule"), F.count_if((some > 0) & (some < len(snapshots))).alias("rows")))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def review_flags(orders: DataFrame, unresolved: str = "店舗不明") -> DataFrame:
    """display_reasons (stored ones without the chain reason), needs_store: whether the chain must be confirmed, review."""
    kept = F.array_except(F.coalesce("review_reasons", F.array().cast("array<string>")), F.array(F.lit("店舗名を確認してください")))
    needs = F.coalesce(F.col("store_name"), F.lit(unresolved)) == unresolved
    return orders.withColumn("display_reasons", kept).withColumn("needs_store", needs).withColumn("review", (F.size("display_reasons") > 0) | F.col("needs_review") | needs)
