"""The matrix of stores and introduced products: where each chain's stores come from, what they carry, and stores that lack.

entries: chain_name, store_code, store_name, address, product_key, is_introduced, ord. locations: store_code, store_name,
chain_name, address. Stores are matched within their chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import kept
from .matching import name_keys
from .stores import LEGACY, OFFICIAL, first_with_address, one_matrix_row, resolve_stores, row_chain

LEAST = 5  # entries and different stores of a list that names every store
CHAIN = ["chain_name"]
CODED = "^(loft-|hands-|atcosme-|ainz-)"  # codes of official lists


def _entries(entries: DataFrame) -> DataFrame:
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("store_code", "store_name", "address")}
    return entries.withColumn("chain_name", tx.trim(F.col("chain_name"))).withColumns(text).where("chain_name <> ''")


def chained(locations: DataFrame) -> DataFrame:
    """Locations by the chain that their code or name stands for, else their own."""
    own = tx.first_filled(tx.inferred_chain(F.col("store_code"), F.col("store_name")), tx.trim(F.col("chain_name")))
    return locations.select("store_code", "store_name", own.alias("chain_name"), F.coalesce("address", F.lit("")).alias("address")).where("chain_name IS NOT NULL")


def strategies(entries: DataFrame, locations: DataFrame) -> DataFrame:
    """chain_name, strategy for each chain of the entries.

    official: a chain with an official list that the locations hold. list: entries of five stores or more, some introduced and
    some not, which name every store. locations: the chain's locations. entries: what the entries name.
    """
    own = _entries(entries)
    per = own.groupBy("chain_name").agg(F.count("*").alias("n"), F.count_distinct(F.nullif(tx.location_key(F.col("store_name")), F.lit(""))).alias("stores"), F.max("is_introduced").alias("some"), F.min("is_introduced").alias("every"))
    there = chained(locations).select("chain_name", F.lit(True).alias("there")).distinct()
    there_, full = F.coalesce("there", F.lit(False)), (F.col("n") >= LEAST) & (F.col("stores") >= LEAST) & F.col("some") & ~F.col("every")
    strategy = F.when(F.col("chain_name").isin(*OFFICIAL) & there_, "official").when(full, "list").when(there_, "locations").otherwise("entries")
    return per.join(there, "chain_name", "left").select("chain_name", strategy.alias("strategy"))


def matched(entries: DataFrame, locations: DataFrame) -> DataFrame:
    """Entries with m_code, m_name, m_address: the location of their chain that they stand for; null without one."""
    there = chained(locations)
    found = resolve_stores(entries, there, by=CHAIN).where("matched_code IS NOT NULL").select(*CHAIN, "store_name", "store_code", "matched_code")
    named = there.groupBy(*CHAIN, F.col("store_code").alias("matched_code")).agg(F.max(F.struct("store_name", "address")).alias("l"))
    hit = found.join(named, [*CHAIN, "matched_code"]).select(*CHAIN, "store_name", "store_code", F.col("matched_code").alias("m_code"), F.col("l.store_name").alias("m_name"), F.col("l.address").alias("m_address"))
    return entries.join(hit, [*CHAIN, "store_name", "store_code"], "left")


def _keys(name: Column, code: Column) -> Column:
    coded = F.when(code != "", F.array(F.concat(F.lit("code:"), code))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(name_keys(tx.location_key(name)), coded))


def _lookup(own: DataFrame) -> DataFrame:
    """chain_name, key, product_key of matched entries that are introduced, by the last entry of each key."""
    legacy = F.create_map(*[F.lit(x) for k, v in LEGACY.items() for x in (k, f"code:atcosme-{v}")])
    found = F.when(F.coalesce("m_code", F.lit("")) != "", F.array(F.concat(F.lit("code:"), "m_code"))).otherwise(_keys(F.col("store_name"), F.col("store_code")))
    every = F.array_compact(F.array_append(found, F.try_element_at(legacy, F.trim("store_code"))))
    each = own.select(*CHAIN, "product_key", "is_introduced", "ord", F.explode(F.array_distinct(every)).alias("key"))
    last = each.groupBy(*CHAIN, "key", "product_key").agg(F.max_by("is_introduced", F.struct("ord", "is_introduced")).alias("on"))
    return last.where("on").drop("on")


def _carried(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Rows (id, keys, chain_name, ...) with products, the sorted keys of what they carry."""
    hit = rows.select("id", *CHAIN, F.explode("keys").alias("key")).join(lookup, [*CHAIN, "key"]).groupBy("id").agg(F.array_sort(F.collect_set("product_key")).alias("products"))
    return rows.join(hit, "id", "left").withColumn("products", F.coalesce("products", F.array().cast("array<string>")))


def matrix(entries: DataFrame, locations: DataFrame, picks: list[str]) -> DataFrame:
    """chain_name, store_code, store_name, address, origin, products: a row for each store, by its chain's strategy, and for each
    introduced store that those rows lack (origin supplement; not for chains with an official list). products: which of the
    picked product keys it carries, sorted. A store that comes twice is one row, as in one_matrix_row().
    """
    own = kept(matched(_entries(entries), locations))
    how = strategies(entries, locations)
    there = chained(locations).join(how.where(F.col("strategy").isin("official", "locations")), "chain_name")
    named = own.select(*CHAIN, F.when(F.col("store_code") != "", F.col("store_code")).otherwise(F.coalesce("m_code", F.lit(""))).alias("store_code"), F.coalesce("m_name", "store_name").alias("store_name"), F.coalesce(F.nullif("m_address", F.lit("")), "address").alias("address"), "ord")
    named = named.join(how.where(F.col("strategy").isin("list", "entries")), "chain_name")
    cols = [*CHAIN, "store_code", "store_name", "address", "ord", "strategy"]
    listed = first_with_address(there.withColumn("ord", F.lit(0).cast("long")).select(*cols).unionByName(named.select(*cols)))
    chain = row_chain(F.col("store_code"), F.col("store_name"), F.col("chain_name"))
    rows = listed.select(chain.alias("chain_name"), "store_code", "store_name", "address", F.col("strategy").alias("origin"))
    rows = rows.withColumn("keys", F.when(F.col("store_code") != "", F.array(F.concat(F.lit("code:"), "store_code"))).otherwise(_keys(F.col("store_name"), F.col("store_code"))))
    rows = kept(rows).withColumn("row_key", F.coalesce(F.nullif("store_code", F.lit("")), F.get("keys", F.lit(0)), "store_name")).withColumn("id", F.concat_ws("\x01", "chain_name", "row_key", "store_name"))
    lookup = _lookup(own.where(F.col("product_key").isin(*picks)))
    base = kept(_carried(rows, lookup))
    full = base.unionByName(_supplement(own, base, lookup))
    key = F.concat("chain_name", F.lit("::"), F.when(F.col("row_key").rlike(CODED), F.concat(F.lit("code:"), "row_key")).otherwise(F.coalesce(F.nullif(tx.location_key(F.col("store_name")), F.lit("")), "row_key")))
    keyed = full.withColumn("key", key).withColumn("introduced", F.size("products") > 0)
    order = Window.partitionBy("key").orderBy("store_name", F.col("origin") == "supplement", "row_key")
    return one_matrix_row(keyed.withColumn("ord", F.row_number().over(order))).select(*CHAIN, "store_code", "store_name", "address", "origin", "products")


def _supplement(own: DataFrame, rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Rows of introduced stores of other chains than those with an official list, which the rows hold neither by key, if they
    carry anything, nor by code or name; the last entry of each.
    """
    seen = own.where("is_introduced").where(~F.col("chain_name").isin(*OFFICIAL))
    plain = tx.location_key(F.col("store_name"))
    code = F.coalesce("m_code", F.nullif("store_code", F.lit("")), F.concat(F.lit("import:"), F.coalesce(F.nullif(plain, F.lit("")), "store_name")))
    each = seen.select(*CHAIN, code.alias("row_key"), F.coalesce("m_name", "store_name").alias("store_name"), F.coalesce(F.nullif("m_address", F.lit("")), "address").alias("address"), "ord")
    last = each.groupBy("row_key").agg(F.max(F.struct("ord", *CHAIN, "store_name", "address")).alias("e")).select("row_key", "e.*").drop("ord")
    covered = rows.where(F.size("products") > 0).select("row_key").unionByName(rows.where("store_code <> ''").select(F.col("store_code").alias("row_key"))).distinct()
    names = rows.select(tx.location_key(F.col("store_name")).alias("_n")).where("_n <> ''").distinct()
    left = last.join(covered, "row_key", "left_anti").withColumn("_n", tx.location_key(F.col("store_name"))).join(names, "_n", "left_anti").drop("_n")
    keys = F.when(F.startswith("row_key", F.lit("import:")), _keys(F.col("store_name"), F.col("row_key"))).otherwise(F.array(F.concat(F.lit("code:"), "row_key")))
    made = left.select(*CHAIN, F.col("row_key").alias("store_code"), "store_name", "address", F.lit("supplement").alias("origin"), keys.alias("keys"), "row_key", F.concat_ws("\x01", "chain_name", "row_key", F.lit("+")).alias("id"))
    return _carried(made, lookup).where(F.size("products") > 0)
