"""Sell-out: what retailers sold, from the newest import of each retailer and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .stores import newest

IMPORTS_READ = 100


def latest_imports(imports: DataFrame, read: int | None = IMPORTS_READ) -> DataFrame:
    """The `read` newest imports of each client, and of these each client's newest of a retailer and period; imports without a retailer are left out.

    The limit comes first: it is what the report reads. Without one (None) all imports count.
    """
    newest_ = imports if read is None else newest(imports, read)
    newest_ = newest_.where("trim(coalesce(retailer, '')) <> ''")
    rank = F.row_number().over(Window.partitionBy("client_id", F.trim("retailer"), "period_start", "period_end").orderBy(F.desc("imported_at"), F.desc("import_id")))
    return newest_.withColumn("_r", rank).where("_r = 1").drop("_r")


def entries_of(entries: DataFrame, imports: DataFrame) -> DataFrame:
    return entries.join(imports.select("import_id"), "import_id", "left_semi")


def display_store() -> Column:
    return tx.first_filled(F.col("matched_store_name"), F.col("store_name"), tx.UNKNOWN)


def _month(f) -> Column:
    return f(F.col("period_start").cast("string"), F.col("period_end").cast("string"))


def with_product_names(entries: DataFrame, products: DataFrame) -> DataFrame:
    """The client's registered product's name, else the file's, else 未登録; products: client_id, jan, name."""
    named = products.select("client_id", "jan", F.col("name").alias("_name"))
    return entries.join(named, ["client_id", "jan"], "left").withColumn("product_name", tx.first_filled(F.col("_name"), F.col("product_name"), "未登録")).drop("_name")


def filtered(entries: DataFrame, retailer: str = "all", store: str = "", product: str = "", year: str = "all", month: str = "all") -> DataFrame:
    out, key = entries, _month(tx.month_key)
    if retailer != "all":
        out = out.where(F.col("retailer") == retailer)
    if q := store.strip().lower():
        out = out.where(F.contains(F.lower(display_store()), F.lit(q)))
    if q := product.strip().lower():
        out = out.where(F.contains(F.lower("product_name"), F.lit(q)) | F.contains(F.lower("jan"), F.lit(q)))
    if year != "all":
        out = out.where(F.startswith(key, F.lit(f"{year}-")))
    return out if month == "all" else out.where(F.endswith(key, F.lit(f"-{month.zfill(2)}")))


def monthly(entries: DataFrame) -> DataFrame:
    """month, retailer, store, jan: sums, with the first row's product name; rows order by import and place."""
    rows = entries.withColumn("month", _month(tx.month_label)).withColumn("store", display_store())
    out = rows.groupBy("month", "retailer", "store", "jan").agg(F.min_by("product_name", F.struct("import_id", "ord", "product_name")).alias("product_name"), F.sum("qty").alias("qty"), F.sum("amount").alias("amount"))
    return out.orderBy(F.desc("amount"), F.desc("qty"), "store", "jan")


def trend(entries: DataFrame) -> DataFrame:
    """Months with a valid key, without those that sold nothing."""
    rows = entries.withColumn("label", _month(tx.month_key)).where(F.col("label").rlike(r"^\d{4}-\d{2}$"))
    return rows.groupBy("label").agg(F.sum("qty").alias("qty"), F.sum("amount").alias("amount")).where("amount > 0 OR qty > 0").orderBy("label")


def top_products(entries: DataFrame, top: int = 8) -> DataFrame:
    label = tx.first_filled(F.col("product_name"), F.col("jan"), "商品不明")
    return entries.groupBy(label.alias("label")).agg(F.sum("qty").alias("qty"), F.sum("amount").alias("amount")).orderBy(F.desc("qty"), "label").limit(top)


def panel(entries: DataFrame) -> DataFrame:
    """Distinct stores, totals and rounded averages per store; zeros for no entries."""
    a = entries.agg(F.count_distinct(display_store()).alias("stores"), F.coalesce(F.sum("qty"), F.lit(0)).alias("qty"), F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"))
    per = lambda c, digits: F.when(F.col("stores") > 0, F.floor(F.col(c) / F.col("stores") * 10**digits + F.lit(0.5)) / 10**digits).otherwise(0.0)
    return a.select("stores", "qty", "amount", per("amount", 0).alias("amount_per_store"), per("qty", 2).alias("qty_per_store"))


def import_summary(entries: DataFrame) -> DataFrame:
    store = tx.first_filled(F.col("store_code"), F.col("store_name"))
    return entries.groupBy("import_id").agg(
        F.count("*").alias("entries"),
        F.count_distinct(store).alias("stores"),
        F.sum("qty").alias("qty"),
        F.sum("amount").alias("amount"),
        F.count_distinct("jan").alias("jans"),
        F.min(F.col("period_start").cast("string")).alias("first_day"),
        F.max(F.col("period_end").cast("string")).alias("last_day"),
    )


def latest_month(entries: DataFrame) -> DataFrame:
    key = F.max(F.when(_month(tx.month_key).rlike(r"^\d{4}-\d{2}$"), _month(tx.month_key)))
    return entries.agg(key.alias("k")).select(F.substring("k", 1, 4).alias("year"), F.substring("k", 6, 2).cast("int").cast("string").alias("month"))


def options(entries: DataFrame, retailer: str = "all", year: str = "all") -> DataFrame:
    """kind, value: choices of each filter under the others' values."""
    scoped = filtered(entries, retailer, year=year)
    key = _month(tx.month_key)
    kinds = [
        entries.where("coalesce(retailer, '') <> ''").select(F.lit("retailer").alias("kind"), F.col("retailer").alias("value")),
        scoped.select(F.lit("store").alias("kind"), display_store().alias("value")),
        entries.select(F.lit("year").alias("kind"), F.substring(key, 1, 4).alias("value")).where(F.col("value").rlike(r"^\d{4}$")),
        scoped.select(F.lit("month").alias("kind"), F.substring(key, 6, 2).try_cast("int").cast("string").alias("value")).where("value IS NOT NULL"),
        scoped.where("coalesce(product_name, '') <> '' OR coalesce(jan, '') <> ''").select(
            F.lit("product").alias("kind"),
            F.when((F.coalesce("product_name", F.lit("")) != "") & (F.coalesce("jan", F.lit("")) != "") & (F.col("product_name") != F.col("jan")), F.concat("product_name", F.lit(" ("), "jan", F.lit(")")))
            .otherwise(tx.first_filled(F.col("product_name"), F.col("jan")))
            .alias("value"),
        ),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.distinct()
