"""The business tables (clients, products, orders, ...) as views over the generic star schema of a test folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """Lazy tables of one folder: a table that a query does not name is not read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def clients(self) -> DataFrame:
        k = F.col("r_regionkey")
        return self.raw("region").select(_client(k).alias("id"), F.col("r_name").alias("name"), F.when(k != 0, F.lit(0.08) + F.lit(0.01) * k).alias("fbp_fee_rate"))

    def suppliers(self) -> DataFrame:
        nation = self.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
        return self.raw("supplier").join(nation, "s_nationkey").select(
            F.concat(F.lit("S"), "s_suppkey").alias("id"),
            _client(F.col("n_regionkey")).alias("client_id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("standard:"), _client(F.col("n_regionkey"))).alias("mapping_key"),
        )

    def products(self) -> DataFrame:
        k = F.col("p_partkey")
        regions = self.raw("region").select("r_regionkey")
        part = self.raw("part").withColumn("r_regionkey", F.explode(F.array(*[F.lit(i) for i in range(5)])))
        both = part.join(regions, "r_regionkey").where(k % 5 != F.col("r_regionkey"))
        return both.select(
            _client(F.col("r_regionkey")).alias("client_id"),
            jan(k).alias("jan"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("internal_sku"),
            F.col("p_type").alias("category"),
            (F.col("p_retailprice") * (F.lit(0.4) + F.lit(0.05) * (k % 5))).alias("wholesale_price"),
            F.when(k % 20 != 0, F.col("p_retailprice")).alias("retail_price"),
            F.when(k % 3 != 0, F.to_json(F.struct(F.col("p_type").alias("memo")))).alias("flags"),
        )

    def orders(self) -> DataFrame:
        nation = self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
        customer = self.raw("customer").join(nation, "c_nationkey").withColumnRenamed("c_custkey", "o_custkey")
        day = F.col("o_orderdate").cast("date")
        status = F.when(F.col("o_orderstatus") == "F", "shipped").when(F.col("o_orderstatus") == "O", "confirmed").otherwise("imported")
        return self.raw("orders").join(customer, "o_custkey").select(
            F.col("o_orderkey").cast("string").alias("id"),
            _client(F.col("n_regionkey")).alias("client_id"),
            F.col("o_orderkey").cast("string").alias("order_no"),
            day.alias("order_date"),
            F.date_add(day, 3).alias("arrival_due_date"),
            status.alias("status"),
            F.col("c_name").alias("ship_to_name"),
            F.col("n_name").alias("warehouse"),
            F.col("c_mktsegment").alias("store_name"),
            F.concat(F.lit("file-"), F.col("o_orderkey") % 97).alias("source_file"),
            F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("path/"), F.col("o_orderkey") % 97)).alias("source_file_path"),
            (F.col("o_orderkey") % 7 == 0).alias("needs_review"),
            F.col("o_orderdate").alias("imported_at"),
        )

    def order_lines(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """Lines numbered within their order; of orders dated within [first, last] where given, which are picked by their keys before any line is sorted."""
        order = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"
        )
        lines = self.raw("lineitem")
        if first is not None:
            within = self.raw("orders").where(F.col("o_orderdate").cast("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select(F.col("o_orderkey").alias("l_orderkey"))
            lines = lines.join(within, "l_orderkey", "left_semi")
        return lines.select(
            F.col("l_orderkey").cast("string").alias("order_id"), F.row_number().over(order).alias("line_no"), jan(F.col("l_partkey")).alias("jan"), F.col("l_quantity").cast("int").alias("qty")
        )

    def sellout_imports(self) -> DataFrame:
        """A retailer's month comes from two clients, from each in two versions; the later one has the higher version number and the later time."""
        e = self.sellout_entries()
        return e.groupBy("import_id", "client_id", "retailer", "period_start", "period_end", "version").agg(F.count("*").alias("entry_count")).withColumn(
            "imported_at", F.expr("cast(period_end as timestamp) + make_interval(0, 0, 0, version)")
        )

    def sellout_entries(self) -> DataFrame:
        """A third of a retailer's stores report to another client than the rest."""
        nation = self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        client = _client((F.regexp_extract("n_name", r"(\d+)$", 1).cast("int") + F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0)) % 5)
        customer = self.raw("customer").join(nation, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "c_name", "n_name", client.alias("client_id"))
        orders = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        part = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
        start = F.trunc("l_shipdate", "MM")
        version = (F.col("l_linenumber") % 2).cast("int")
        return self.raw("lineitem").join(orders, "l_orderkey").join(customer, "o_custkey").join(part, "l_partkey").select(
            F.concat_ws("-", "n_name", F.date_format(start, "yyyyMM"), version, "client_id").alias("import_id"),
            "client_id",
            start.alias("period_start"),
            F.last_day("l_shipdate").alias("period_end"),
            F.col("n_name").alias("retailer"),
            F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("store_code"),
            F.col("c_name").alias("store_name"),
            F.when(F.col("o_custkey") % 4 != 0, F.concat(F.lit("Shop "), F.col("o_custkey"))).alias("matched_store_name"),
            jan(F.col("l_partkey")).alias("jan"),
            F.when(F.col("l_partkey") % 6 != 0, F.col("p_name")).otherwise("").alias("product_name"),
            F.col("l_quantity").cast("long").alias("qty"),
            F.floor("l_extendedprice").cast("long").alias("amount"),
            version.alias("version"),
            F.col("l_linenumber").alias("ord"),
        )

    def store_locations(self) -> DataFrame:
        nation = self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        return self.raw("customer").join(nation, "c_nationkey").select(
            F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("store_code"),
            F.col("c_name").alias("store_name"),
            F.col("n_name").alias("chain_name"),
            F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("1-"), F.col("c_custkey") % 90, F.lit("-3 "), "c_mktsegment")).alias("address"),
        )

    def introductions(self) -> DataFrame:
        """A store has introduced a part that it ordered if a line of it has return flag N."""
        orders = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
        nation = self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        customer = self.raw("customer").join(nation, "c_nationkey")
        part = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
        return self.raw("lineitem").join(orders, "l_orderkey").join(customer, "c_custkey").join(part, "l_partkey").select(
            F.concat(F.lit("I-"), "n_name").alias("import_id"),
            F.col("n_name").alias("chain_name"),
            F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("store_code"),
            F.col("c_name").alias("store_name"),
            jan(F.col("l_partkey")).alias("jan"),
            F.col("p_name").alias("product_name"),
            F.col("p_brand").alias("internal_sku"),
            (F.col("l_returnflag") == "N").alias("is_introduced"),
            (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("ord"),
        )

    def import_batches(self) -> DataFrame:
        status = F.when(F.col("event_type") == "error", "blocked").when(F.col("event_type") == "purchase", "saved").otherwise("checked")
        return self.raw("events").select(
            F.concat(F.lit("B"), "event_id").alias("id"),
            F.when(F.col("user_id") % 11 == 0, F.lit(" ")).otherwise(F.concat(F.when(F.col("event_id") % 2 == 0, "Order ").otherwise("order "), F.col("user_id") % 40, F.lit(".PDF "))).alias("file_name"),
            status.alias("status"),
            F.col("ts").alias("imported_at"),
            F.col("event_id").alias("ord"),
        )


def jan(part: Column) -> Column:
    return F.lpad(part.cast("string"), 13, "0")


def _client(region: Column) -> Column:
    return F.concat(F.lit("C"), region.cast("string"))
