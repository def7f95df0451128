"""Store introductions: which stores carry which products, penetration by chain, and the store x product matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Formats that list every store of a chain. Fixed values.
FULL_LISTS = ("flag-list", "hands-allocation-list", "store-allocation-list", "promotional-address-list", "ainz-shipment-list")
LEAST_STORES = 5


def product_key(sku: Column, name: Column, jan: Column) -> Column:
    return F.when(F.coalesce(sku, F.lit("")) != "", F.concat(F.lit("sku:"), sku)).when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("name:"), name)).otherwise(F.concat(F.lit("jan:"), jan))


def dedupe(entries: DataFrame) -> DataFrame:
    """One entry of each (import, jan, code, name), the last by `ord`."""
    w = Window.partitionBy("import_id", "jan", "store_code", "store_name").orderBy(F.desc("ord"), F.desc("is_introduced"))
    return entries.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rate(part: Column, whole: Column) -> Column:
    """Percent with one decimal, halves up; null for an empty whole."""
    return F.when(whole > 0, F.floor(part / whole * 1000 + F.lit(0.5)) / 10)


def chain_kpis(entries: DataFrame, format_key: str) -> DataFrame:
    """Per chain and product: entry rows, introduced rows, and the rate where the format lists all stores and there are enough."""
    full = F.lit(format_key in FULL_LISTS) & (F.col("total_stores") >= LEAST_STORES)
    chain = tx.trim(F.col("chain_name"))
    rows = entries.where((chain != "") & (chain != tx.UNKNOWN)).withColumn("product_key", product_key(F.col("internal_sku"), F.col("product_name"), F.col("jan")))
    kpi = rows.groupBy(chain.alias("chain"), "product_key").agg(F.count_if("is_introduced").alias("introduced"), F.count("*").alias("total_stores"))
    return kpi.withColumn("full_list", full).withColumn("rate", F.when(full, rate(F.col("introduced"), F.col("total_stores"))))


def with_master(kpis: DataFrame, locations: DataFrame, official: list[str]) -> DataFrame:
    """For official chains the number of master stores is the denominator, where there are any."""
    n = locations.where(F.col("chain_name").isin(*official)).groupBy(F.col("chain_name").alias("chain")).agg(F.count("*").alias("master_stores"))
    out = kpis.join(F.broadcast(n.where(F.col("chain").isin(*official))), "chain", "left")
    has = F.col("master_stores") > 0
    return out.select(
        "chain",
        "product_key",
        "introduced",
        F.when(has, F.col("master_stores")).otherwise(F.col("total_stores")).alias("total_stores"),
        F.coalesce("master_stores", F.lit(0)).alias("master_stores"),
        F.coalesce(has & (F.col("master_stores") != F.col("total_stores")), F.lit(False)).alias("mismatch"),
        F.when(has, True).otherwise(F.col("full_list")).alias("full_list"),
        F.when(has, rate(F.col("introduced"), F.col("master_stores"))).otherwise(F.col("rate")).alias("rate"),
    )


def visible(kpis: DataFrame) -> DataFrame:
    return kpis.where((F.col("introduced") > 0) | (F.col("full_list") & (F.col("total_stores") >= LEAST_STORES)))


def across_chains(kpis: DataFrame) -> DataFrame:
    """Per product over all chains; each chain counts its stores once, at the largest number seen."""
    per = kpis.groupBy("product_key", "chain").agg(F.sum("introduced").alias("introduced"), F.max(F.when(F.col("full_list"), F.col("total_stores"))).alias("n"))
    out = per.groupBy("product_key").agg(F.sum("introduced").alias("introduced"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_stores"))
    return out.withColumn("rate", rate(F.col("introduced"), F.col("total_stores")))


def company_overview(kpis: DataFrame) -> DataFrame:
    per = kpis.groupBy("chain").agg(F.sum("introduced").alias("introduced"), F.max(F.when(F.col("full_list"), F.col("total_stores"))).alias("n"))
    return per.agg(F.sum("introduced").alias("introduced"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_stores")).withColumn("rate", rate(F.col("introduced"), F.col("total_stores")))


def import_chain(entries: DataFrame) -> DataFrame:
    """The chain that most entries of an import name, the first seen on ties."""
    n = entries.groupBy("import_id", "chain_name").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    w = Window.partitionBy("import_id").orderBy(F.desc("n"), "first", "chain_name")
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("import_id", F.col("chain_name").alias("chain"), "n")


def dominant_jan(entries: DataFrame, products: DataFrame) -> DataFrame:
    """Per import the known JAN with most entries, and how many different JANs it had."""
    known = products.select("jan").distinct()
    n = entries.groupBy("import_id", "jan").agg(F.count("*").alias("n"))
    best = n.join(known, "jan", "left_semi").groupBy("import_id").agg(F.min_by("jan", F.struct(-F.col("n"), F.col("jan"))).alias("jan"))
    return best.join(n.groupBy("import_id").agg(F.count("*").alias("jans")), "import_id")


def import_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("import_id").agg(F.count("*").alias("rows"), F.count_if("is_introduced").alias("introduced"), F.count_distinct("jan").alias("jans"), F.count_distinct(tx.first_filled(F.col("store_code"), F.col("store_name"))).alias("stores"))


def unmatched_stores(entries: DataFrame, locations: DataFrame) -> DataFrame:
    """Per import the distinct store names without a location, and the first three by name."""
    names = entries.join(locations.select("store_code"), "store_code", "left_anti").select("import_id", "store_name").distinct()
    w = Window.partitionBy("import_id").orderBy("store_name")
    return names.withColumn("r", F.row_number().over(w)).groupBy("import_id").agg(F.count("*").alias("unmatched"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.col("store_name")))), ",").alias("examples"))


def display_products(products: DataFrame) -> DataFrame:
    """jan, display_name: members of a SKU family share the name of the first member by name, jan."""
    w = Window.partitionBy("client_id", "internal_sku").orderBy("name", "jan")
    return products.select("client_id", "jan", F.when(F.coalesce("internal_sku", F.lit("")) != "", F.first("name").over(w)).otherwise(F.col("name")).alias("display_name"))


def matrix(entries: DataFrame, locations: DataFrame, products: list[str]) -> DataFrame:
    """chain, store_code, product_key, introduced: every store of the master by every product; the last entry decides.

    The products are those that the reader picked; the grid is stores x picks and grows with the stores.
    """
    rows = entries.withColumn("product_key", product_key(F.col("internal_sku"), F.col("product_name"), F.col("jan"))).where(F.col("product_key").isin(*products))
    last = rows.groupBy("chain_name", "store_code", "product_key").agg(F.max_by("is_introduced", F.struct("ord", "is_introduced")).alias("introduced"))
    grid = locations.select("chain_name", "store_code", "store_name", F.explode(F.array(*map(F.lit, products))).alias("product_key"))
    return grid.join(last, ["chain_name", "store_code", "product_key"], "left").withColumn("introduced", F.coalesce("introduced", F.lit(False)))


def matrix_export(m: DataFrame, products: list[str]) -> DataFrame:
    """A numbered row for each store, a ◯ or - for each product. Numbers restart in each chain."""
    wide = m.groupBy("chain_name", "store_code", "store_name").pivot("product_key", products).agg(F.max("introduced"))
    no = F.row_number().over(Window.partitionBy("chain_name").orderBy("store_code"))
    return wide.select(no.alias("no"), "chain_name", "store_code", "store_name", *[F.when(F.col(f"`{p}`"), "◯").otherwise("-").alias(f"p{i}") for i, p in enumerate(products)])


def supplemental(entries: DataFrame, locations: DataFrame) -> DataFrame:
    """Introduced stores that the master has neither by code nor by name."""
    own = entries.where("is_introduced").select("chain_name", "store_code", "store_name").distinct()
    by_name = locations.select(F.lower(F.regexp_replace("store_name", r"\s", "")).alias("_n")).distinct()
    left = own.join(locations.select("store_code").distinct(), "store_code", "left_anti")
    return left.join(by_name, F.lower(F.regexp_replace("store_name", r"\s", "")) == F.col("_n"), "left_anti")


def filtered(entries: DataFrame, query: str = "", chain: str = "all") -> DataFrame:
    """Entries whose shown JAN, shown name or stored name holds the text, in any case, of one chain or of all.

    entries: shown_jan, shown_name, product_name, matched_chain.
    """
    q = query.strip().lower()
    text = lambda c: F.contains(F.lower(F.coalesce(F.trim(c), F.lit(""))), F.lit(q))
    out = entries if not q else entries.where(text(F.col("shown_jan")) | text(F.col("shown_name")) | text(F.col("product_name")))
    return out if chain == "all" else out.where(F.col("matched_chain") == chain)


def picked_products(options: DataFrame, key: str = "all", query: str = "") -> DataFrame:
    """A matrix's products (product_key, jan, product_name): one key or all, that hold the text in JAN or name."""
    q = query.strip().lower()
    out = options if key == "all" else options.where(F.col("product_key") == key)
    return out.where(F.contains(F.lower("jan"), F.lit(q)) | F.contains(F.lower("product_name"), F.lit(q))) if q else out


def locations_by_chain(locations: DataFrame) -> DataFrame:
    return locations.groupBy("chain_name").agg(F.count("*").alias("stores"), F.min("store_name").alias("first_store"), F.count_if(F.col("address").isNotNull()).alias("with_address"))


def sync_preview(current: DataFrame, official: DataFrame, sample: int = 5) -> DataFrame:
    """Official codes that the master lacks: how many, and the first `sample` by code."""
    new = official.join(current.select("store_code"), "store_code", "left_anti").select("store_code").distinct()
    first = new.orderBy("store_code").limit(sample)
    return new.agg(F.count("*").alias("missing")).withColumn("one", F.lit(1)).join(first.agg(F.array_join(F.array_sort(F.collect_list("store_code")), ",").alias("examples")).withColumn("one", F.lit(1)), "one").drop("one")
