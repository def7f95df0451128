"""Master tables and report options: product edits, order files, import batches, location sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .sheets import code_aliases
from .pricing import payout_rate


def typed_products(drafts: DataFrame) -> DataFrame:
    """Text drafts (client_id, jan, name, wholesale_price, retail_price, tax_rate, alias_text) to typed rows; blank prices are null."""
    w, r = tx.money(F.col("wholesale_price")), tx.money(F.col("retail_price"))
    return drafts.select(
        "client_id",
        tx.jan_digits(F.col("jan")).alias("jan"),
        tx.trim(F.col("name")).alias("name"),
        w.alias("wholesale_price"),
        r.alias("retail_price"),
        tx.tax_rate(F.col("tax_rate")).alias("tax_rate"),
        payout_rate(w, r).alias("payout_rate"),
        F.array_distinct(F.concat(F.array(tx.trim(F.col("name"))), tx.aliases(F.col("alias_text")))).alias("aliases"),
    )


def existing_product(rows: DataFrame, products: DataFrame) -> DataFrame:
    """row_id, matched_jan, by: the client's product by JAN; a row without JAN by its name, if only one product has it."""
    by_jan = rows.where("jan <> ''").join(products.select("client_id", "jan"), ["client_id", "jan"]).select("row_id", F.col("jan").alias("matched_jan"), F.lit("jan").alias("by"))
    # A name that many products share is one row before it meets the rows: its first and last JAN differ.
    names = products.groupBy("client_id", tx.trim(F.col("name")).alias("_n")).agg(F.min("jan").alias("low"), F.max("jan").alias("high"))
    named = rows.where("jan = ''").select("row_id", "client_id", tx.trim(F.col("name")).alias("_n")).where("_n <> ''").join(names, ["client_id", "_n"])
    by_name = named.groupBy("row_id").agg(F.min("low").alias("matched_jan"), F.max("high").alias("high")).where("matched_jan = high").select("row_id", "matched_jan", F.lit("name").alias("by"))
    return by_jan.unionByName(by_name)


def merged_products(new: DataFrame, old: DataFrame, fields: list[str]) -> DataFrame:
    """client_id, jan and fields of new rows; a blank field keeps the old value."""
    o = old.select("client_id", "jan", *[F.col(f).alias(f"_{f}") for f in fields])
    keep = lambda f: F.coalesce(F.when(F.col(f).cast("string") != "", F.col(f)), F.col(f"_{f}")).alias(f)
    return new.join(o, ["client_id", "jan"], "left").select("client_id", "jan", *[keep(f) for f in fields])


def edited_orders(orders: DataFrame, edits: DataFrame) -> DataFrame:
    """Manual edits (id, arrival_due_date, store_name) over orders; a null leaves the field as it is."""
    e = edits.select("id", F.col("arrival_due_date").alias("_a"), F.col("store_name").alias("_s"))
    return orders.join(e, "id", "left").withColumn("arrival_due_date", F.coalesce("_a", "arrival_due_date")).withColumn("store_name", F.coalesce("_s", "store_name")).drop("_a", "_s")


def order_files(batches: DataFrame, orders: DataFrame, search: str = "") -> DataFrame:
    """Saved batches with the numbers of their orders; the text is looked for in name, status and numbers, joined by blanks.

    A text with n blanks stands within n + 1 of these. So it is looked for once for each file, in name, status and the first n
    numbers and in each number with the n behind it, and no file's numbers are searched, or copied to its batches, as one text.
    """
    q = search.strip().lower()
    spans = q.count(" ")
    holds = lambda c: F.contains(F.lower(c), F.lit(q))
    own = orders.select(F.col("source_file").alias("file_name"), "order_no")
    numbers = own.groupBy("file_name").agg(F.array_join(F.array_sort(F.collect_list("order_no")), " ").alias("numbers"), F.count("*").alias("orders"), F.max(holds("order_no")).alias("_hit"), F.lit("").alias("_first"))
    if spans:
        w = Window.partitionBy("file_name").orderBy("order_no")
        runs = own.where("order_no IS NOT NULL").select("file_name", F.row_number().over(w).alias("_at"), F.concat_ws(" ", "order_no", *[F.lead("order_no", i).over(w) for i in range(1, spans + 1)]).alias("_run"))
        found = runs.groupBy("file_name").agg(F.max(holds("_run")).alias("_hit"), F.max(F.when(F.col("_at") == 1, F.substring_index("_run", " ", spans))).alias("_first"))
        numbers = numbers.drop("_hit", "_first").join(found, "file_name", "left")
    rows = batches.where("status = 'saved'").join(numbers, "file_name", "left")
    return rows.where(F.coalesce("_hit", F.lit(False)) | holds(F.concat_ws(" ", "file_name", "status", "_first"))).drop("_hit", "_first")


def search_rows(rows: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows that hold the text in any of the columns joined, in any case."""
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.strip().lower())))


def page(rows: DataFrame, order: list[str | Column], number: int, size: int = 50, most: int = 200) -> DataFrame:
    """One page of a total order; size is held to 1..most and the page to 1 and above."""
    size = min(max(size, 1), most)
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def batch_header(client: str, supplier: str, file: str, path: str | None, status: str, operator: str, at: str) -> dict[str, Column]:
    """Columns of one import batch."""
    name = F.substring(tx.trim(F.lit(operator)), 1, 50)
    values = {"client_id": F.lit(client), "supplier_id": F.lit(supplier), "file_name": F.lit(file), "file_storage_path": F.lit(path).cast("string"), "status": F.lit(status), "operator_name": name, "imported_at": F.lit(at).cast("timestamp")}
    return {"id": F.sha2(F.concat_ws("|", F.lit(client), F.lit(file), F.lit(at)), 256)} | values


def blocked_batches(errors: DataFrame, client: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(one blocked batch for each faulty file, its errors; row 0 is stored as null)."""
    id_ = F.sha2(F.concat_ws("|", F.lit(client), F.col("file_id"), F.lit(at)), 256)
    batch = errors.groupBy("file_id").agg(F.count("*").alias("errors")).select(id_.alias("id"), F.lit(client).alias("client_id"), F.col("file_id").alias("file_name"), F.lit("blocked").alias("status"), "errors")
    return batch, errors.select(id_.alias("batch_id"), F.nullif("row_number", F.lit(0)).alias("row_number"), "field", "message")


def location_chains(locations: DataFrame) -> DataFrame:
    """Blank chains are inferred from code and name; what cannot be inferred keeps its own."""
    inferred = tx.inferred_chain(F.col("store_code"), F.col("store_name"))
    return locations.withColumn("chain_name", F.when(inferred != "", inferred).otherwise(F.coalesce(tx.trim(F.col("chain_name")), F.lit(""))))


def official_merge(entries: DataFrame, master: DataFrame, least: int = 5) -> DataFrame:
    """chain_name, store_code, store_name, is_introduced, origin: every chain's master stores with their introduction state, by any
    form of their code, else by name; introduced rows that no master store stands for are added.

    entries: chain_name, store_code, store_name, is_introduced, ord; of rows with one code or name the last counts. A master of
    fewer than `least` stores is no master: its chain's entries stay as they are.
    """
    name = lambda c: F.concat(F.lit("n:"), F.lower(F.regexp_replace(c, rf"[{tx.BLANK}]", "")))
    codes = lambda c: F.transform(code_aliases(F.coalesce(c, F.lit(""))), lambda x: F.concat(F.lit("c:"), x))
    chain, none = ["chain_name"], ("c:", "n:")
    full = master.groupBy(*chain).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*chain)
    own = entries.join(full, chain, "left_semi")
    keys = F.concat(codes(F.col("store_code")), F.array(name(F.col("store_name"))))
    said = own.select(*chain, "ord", "is_introduced", F.explode(F.array_distinct(keys)).alias("_k")).where(~F.col("_k").isin(*none))
    last = said.groupBy(*chain, "_k").agg(F.max_by("is_introduced", F.struct("ord", "is_introduced")).alias("_on"))
    m = master.join(full, chain, "left_semi").select(*chain, "store_code", "store_name")
    asked = m.select(*chain, "store_code", "store_name", F.posexplode(F.concat(codes(F.col("store_code")), F.array(name(F.col("store_name"))))).alias("_at", "_k"))
    found = asked.join(last, [*chain, "_k"], "left").groupBy(*chain, "store_code", "store_name").agg(F.min_by("_on", F.when(F.col("_on").isNotNull(), F.col("_at"))).alias("_on"))
    merged = found.select(*chain, "store_code", "store_name", F.coalesce("_on", F.lit(False)).alias("is_introduced"), F.lit("master").alias("origin"))
    lone = own.where("is_introduced").withColumn("_id", F.struct(*chain, F.coalesce("store_code", F.lit("")).alias("c"), F.coalesce("store_name", F.lit("")).alias("n")))
    claimed = lone.select("_id", *chain, F.explode(keys).alias("_k")).where(~F.col("_k").isin(*none)).join(asked.select(*chain, "_k").distinct(), [*chain, "_k"]).select("_id").distinct()
    rest = lone.join(claimed, "_id", "left_anti").unionByName(entries.join(full, chain, "left_anti").withColumn("_id", F.lit(None).cast(lone.schema["_id"].dataType)))
    return merged.unionByName(rest.select(*chain, "store_code", "store_name", "is_introduced", F.lit("file").alias("origin")).distinct())


def store_count_warning(imported: Column, master: Column) -> Column:
    """A warning where import and master differ in stores; null where they agree or there is no master."""
    return F.when((master > 0) & (imported != master), F.concat(F.lit("店舗数が一致しません（取込"), imported, F.lit(" / マスタ"), master, F.lit("）")))


def numbered_codes(rows: DataFrame) -> DataFrame:
    """code of each destination of a postal code: the postal code for the first, with -2, -3, ... for the others in row order."""
    n = F.row_number().over(Window.partitionBy("postal").orderBy("row_idx"))
    return rows.withColumn("code", F.when(n == 1, F.col("postal")).otherwise(F.concat("postal", F.lit("-"), n)))


def merged_destinations(seed: DataFrame, stored: DataFrame) -> DataFrame:
    """One row for each code: one with a wholesaler first, the seed before stored ones."""
    both = seed.withColumn("_o", F.lit(0)).unionByName(stored.withColumn("_o", F.lit(1)))
    has = F.coalesce("wholesaler_name", F.lit("")) != ""
    w = Window.partitionBy("code").orderBy(F.desc(has), "_o", "name")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_o")
