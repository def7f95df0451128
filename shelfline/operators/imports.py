"""Purchase-order import: rows to validated orders, locks, upserts and batches; many files at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("order_no", "order_date", "arrival_due_date", "ship_to_name", "jan")

#: A supplier's columns and value maps are configuration. Fixed values of the sample supplier.
MAPPINGS: dict[str, dict] = {
    "default": {
        "header_row": 1,
        "columns": {
            "order_no": "発注No",
            "order_date": "発注日",
            "arrival_due_date": "着荷指定日",
            "ship_to_name": "お届け先会社名",
            "ship_to_center": "センター名",
            "ship_to_address": "住所",
            "ship_to_tel": "電話番号",
            "warehouse": "倉庫",
            "jan": "JANコード",
            "qty": "数量",
            "memo": "備考",
        },
        "warehouse": {"30": "埼玉センター(No.30)", "42": "埼玉センター(No.42)"},
    }
}


def mapping_of(key: str, mappings: Mapping[str, dict] = MAPPINGS) -> dict:
    """By the exact key, then by the part before ':', then the default."""
    return mappings.get(key) or mappings.get(key.split(":")[0]) or mappings["default"]


def trimmed(c: Column) -> Column:
    """Text without surrounding blanks, the ideographic space among them; null becomes empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"^[\s　 ﻿]+|[\s　 ﻿]+$", "")


def normalise(rows: DataFrame, mapping: dict) -> DataFrame:
    """file_id, row_idx and the mapped, trimmed columns; a missing source column is empty; codes go through the value map."""
    have = set(rows.columns)
    out = {to: trimmed(F.col(f"`{src}`")) if src in have else F.lit("") for to, src in mapping["columns"].items()}
    codes = mapping.get("warehouse") or {}
    if codes:
        pairs = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
        out["warehouse"] = F.coalesce(F.try_element_at(pairs, out["warehouse"]), out["warehouse"])
    reasons = F.array().cast("array<string>")
    if "_reviewReasons" in have:
        reasons = F.filter(F.transform(F.split(F.coalesce("_reviewReasons", F.lit("")), "[;/|]"), trimmed), lambda x: x != "")
    return rows.select("file_id", "row_idx", *[c.alias(n) for n, c in out.items()], reasons.alias("review_reasons"))


def to_day(c: Column) -> Column:
    """A day from yyyy-M-d, yyyy/M/d, yyyy.M.d, yyyy年M月d日 or eight digits; else null."""
    plain = F.regexp_replace(F.regexp_replace(c, "[年月/.]", "-"), "日$", "")
    parts = [F.regexp_extract(plain, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", i) for i in (1, 2, 3)]
    digits = [F.regexp_extract(plain, r"^(\d{4})(\d{2})(\d{2})$", i) for i in (1, 2, 3)]
    text = [F.when(p != "", p).otherwise(d) for p, d in zip(parts, digits, strict=True)]
    return F.try_to_date(F.concat(text[0], F.lit("-"), F.lpad(text[1], 2, "0"), F.lit("-"), F.lpad(text[2], 2, "0")), "yyyy-MM-dd")


def _faults() -> Column:
    """array<struct<field, message, drops>> of a row's faults; drops: the row cannot become a line."""

    def fault(field: str, message: str, bad: Column, drops: bool) -> Column:
        return F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"), F.lit(drops).alias("drops")))

    found = [fault(f, "required", F.col(f) == "", True) for f in REQUIRED]
    qty = F.col("qty").try_cast("double")
    found.append(fault("qty", "not a whole number above 0", ~F.coalesce((qty > 0) & (qty == F.floor(qty)), F.lit(False)), True))
    found += [fault(f, "not a date", (F.col(f) != "") & to_day(F.col(f)).isNull(), False) for f in ("order_date", "arrival_due_date")]
    return F.array_compact(F.array(*found))


def errors(rows: DataFrame, header_row: int = 1) -> DataFrame:
    """file_id, row_number, field, message, drops: every fault of every row."""
    return rows.select("file_id", (F.col("row_idx") + header_row + 1).alias("row_number"), F.explode(_faults()).alias("e")).select("file_id", "row_number", "e.*")


def missing_jans(rows: DataFrame, products: DataFrame, client: str, clients: DataFrame) -> DataFrame:
    """jan, other_clients: JANs that the client has not registered, and who else has, by name."""
    wanted = rows.select("jan").where("jan <> ''").distinct()
    missing = wanted.join(products.where(F.col("client_id") == client).select("jan").distinct(), "jan", "left_anti")
    others = products.where(F.col("client_id") != client).join(clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name")), "client_id")
    hints = others.join(missing, "jan", "left_semi").groupBy("jan").agg(F.array_join(F.array_sort(F.collect_set("client_name")), ",").alias("other_clients"))
    return missing.join(hints, "jan", "left").select("jan", F.coalesce("other_clients", F.lit("")).alias("other_clients"))


def drafts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, lines) of files without any fault: the first row of an order gives the header, lines are numbered in file order.

    Rows are dealt by file once; whether a file has a fault and the numbers of its lines both come from there.
    """
    faulty = F.max(F.size(_faults()) > 0).over(Window.partitionBy("file_id"))
    clean = rows.withColumn("_faulty", faulty).where("NOT _faulty").drop("_faulty")
    first = F.struct(to_day(F.col("order_date")).alias("order_date"), to_day(F.col("arrival_due_date")).alias("arrival_due_date"), "ship_to_name", "warehouse", "memo", "review_reasons")
    headers = clean.groupBy("file_id", "order_no").agg(F.min_by(first, "row_idx").alias("h")).select("file_id", "order_no", "h.*")
    number = F.row_number().over(Window.partitionBy("file_id", "order_no").orderBy("row_idx"))
    lines = clean.select("file_id", "order_no", number.alias("line_no"), "jan", F.col("qty").try_cast("double").cast("int").alias("qty"))
    return headers, lines


def recheck(rows: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """file_id, unregistered_before, unregistered_after: how many of a file's JANs lack a product before and after registration.

    before, after: the client's products. A file whose number falls to zero passes the check without being read again.
    """
    jans = rows.select("file_id", "jan").where("jan <> ''").distinct()
    known = lambda p, name: p.select("jan", F.lit(1).alias(name)).distinct()
    both = jans.join(known(before, "b"), "jan", "left").join(known(after, "a"), "jan", "left")
    return both.groupBy("file_id").agg(F.count_if(F.col("b").isNull()).alias("unregistered_before"), F.count_if(F.col("a").isNull()).alias("unregistered_after"))


def locked(headers: DataFrame, existing: DataFrame) -> DataFrame:
    """Orders of the headers (client_id, order_no) that exist and have left the imported state; each locks its whole file."""
    past = existing.where("status <> 'imported'").select("client_id", "order_no", F.col("id").alias("existing_id"), F.col("status").alias("existing_status"))
    return headers.join(past, ["client_id", "order_no"])


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `current` whose key is not in `new`, and `new`: a snapshot to be written to a new place."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def keep_ids(new: DataFrame, current: DataFrame, keys: list[str], id_: str = "id") -> DataFrame:
    """`new` with the ids of rows that exist already."""
    old = current.select(*keys, F.col(id_).alias("_old"))
    return new.join(old, keys, "left").withColumn(id_, F.coalesce("_old", id_)).drop("_old")


def insert_missing(current: DataFrame, seed: DataFrame, name: str) -> DataFrame:
    """`current` and the seed rows whose lower-cased name it lacks."""
    have = current.select(F.lower(name).alias("_n")).distinct()
    return current.unionByName(seed.join(have, F.lower(seed[name]) == F.col("_n"), "left_anti"), allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given; the order should end in a column that tells rows apart."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def latest_batches(batches: DataFrame) -> DataFrame:
    """The newest batch of each file name, in any case and without blanks around; batches without a name stay apart."""
    name = F.lower(trimmed(F.col("file_name")))
    return latest(batches, [F.when(name != "", name).otherwise(F.concat(F.lit("\0"), "id"))], [F.desc("imported_at"), F.desc("ord")])


def batch_orders(batches: DataFrame, orders: DataFrame) -> DataFrame:
    """batch_id, order_id: by stored path where both have one, else by file name; two equi joins, never one with OR."""
    b = batches.select(F.col("id").alias("batch_id"), F.col("file_name").alias("b_name"), F.col("file_path").alias("b_path"), F.col("client_id"))
    o = orders.select(F.col("id").alias("order_id"), F.col("source_file").alias("o_name"), F.col("source_file_path").alias("o_path"), "client_id")
    by_path = b.where("b_path IS NOT NULL").join(o.where("o_path IS NOT NULL"), (F.col("b_path") == F.col("o_path")) & (b.client_id == o.client_id))
    by_name = b.join(o, (F.col("b_name") == F.col("o_name")) & (b.client_id == o.client_id)).where("b_path IS NULL OR o_path IS NULL")
    return by_path.select("batch_id", "order_id").unionByName(by_name.select("batch_id", "order_id"))


def rename_jans(lines: DataFrame, renames: DataFrame) -> DataFrame:
    """Lines (client_id, jan) follow renamed products (client_id, old_jan, new_jan)."""
    return lines.join(renames.withColumnRenamed("old_jan", "jan"), ["client_id", "jan"], "left").withColumn("jan", F.coalesce("new_jan", "jan")).drop("new_jan")


def rename_conflicts(renames: DataFrame, products: DataFrame) -> DataFrame:
    """Renames whose new JAN the client has already."""
    return renames.join(products.select("client_id", F.col("jan").alias("new_jan")), ["client_id", "new_jan"], "left_semi")


def deletable(products: DataFrame, lines: DataFrame) -> DataFrame:
    """Products that no order line uses; lines: client_id, jan."""
    return products.join(lines.select("client_id", "jan").distinct(), ["client_id", "jan"], "left_anti")


def insert_or_update(current: DataFrame, new: DataFrame, keys: list[str], id_: str = "id") -> DataFrame:
    """A snapshot in which new rows replace those of their key, under the old id, or are added under their own."""
    return upsert(current, keep_ids(new, current, keys, id_), keys)


def replace_partition(current: DataFrame, new: DataFrame, column: str, value: str) -> DataFrame:
    """All rows of one chain give way to the new ones."""
    return current.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new, allowMissingColumns=True)


def merge_locations(current: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by store_code, the last row by `ord` of equal ones; rows without a code are dropped and a blank chain does not overwrite one."""
    usable = latest(new.where("coalesce(store_code, '') <> ''"), [F.col("store_code")], [F.desc("ord")]).drop("ord")
    chain = current.select("store_code", F.col("chain_name").alias("_chain"))
    kept = usable.join(chain, "store_code", "left").withColumn("chain_name", F.coalesce(F.nullif("chain_name", F.lit("")), "_chain")).drop("_chain")
    return upsert(current, kept, ["store_code"])


def changed(new: DataFrame, old: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys of rows that are in both and differ in any field, nulls compared as values."""
    o = old.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    differs = F.lit(False)
    for f in fields:
        differs |= ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    return new.join(o, keys).where(differs).select(*keys)
