"""The product that a workbook is about, found over all of its sheets, and product families of a master.

cells: file_id, sheet_name, row_idx, col_idx, value, and sheet_no where sheets have an order other than that of their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .matching import _meet
from .sheets import SHEET, _at, _columns, _key, rows_of

# Fixed values.
HEADS = ("メーカjanコード", "janコード", "単品コード", "単品名称")
JAN_HEADS, OTHER_JAN_HEADS, NAME_HEADS = ("メーカjanコード", "janコード"), ("単品コード",), ("単品名称", "商品名称", "商品名")
ADDRESS_SHEETS = "販促物|送付先|店舗住所|店舗マスタ|アインズ|ｱｲﾝｽﾞ"
PLAIN_FAMILY = "エシエンス"
FAMILY_WORDS = ("ダーマインショット", "エシエンス", "esience", "ダーマ")
FAMILY = "ダーマインショット"
RENAMED = (("ダマショット", "ダマインショット"), ("ダーマショット", "ダーマインショット"))
FILE_NAME_WORDS = "14包|esience|エシエンス14"

ROWS = 24  # below a heading that are read for a product
TOP = 30  # rows of a sheet that are read without a heading
UNKNOWN = "UNKNOWN"


def product_key_text(c: Column) -> Column:
    """A product's name for comparison: NFKC, lower case, without blanks, signs of multiplication, dashes and long vowels."""
    return F.regexp_replace(F.lower(tx.nfkc(F.coalesce(c, F.lit("")))), r"[\s×xｰ\-ー‐]", "")


def _plain(word: str) -> str:
    return re.sub(r"[\s×xｰ\-ー‐]", "", word.lower())


def name_score(key: Column) -> Column:
    """The length of a plain name, less 50 for the family's bare name; 0 for none."""
    return F.length(key) - F.when(key == _plain(PLAIN_FAMILY), 50).otherwise(0)


def sheet_products(cells: DataFrame) -> DataFrame:
    """file_id, sheet_name, jan, product_name, score: of the 24 rows below the first heading with a word for JAN or product the
    row with a JAN whose name scores most, the first on ties.
    """
    k = _key(F.col("value"))
    heads = cells.where(k.isin(*HEADS)).groupBy(*SHEET).agg(F.min("row_idx").alias("head"))
    cols = _columns(cells, heads, {"i_jan": JAN_HEADS, "i_other": OTHER_JAN_HEADS, "i_name": NAME_HEADS})
    rows = rows_of(cells).join(cols, SHEET).where((F.col("row_idx") > F.col("head")) & (F.col("row_idx") <= F.col("head") + ROWS))
    jan = tx.first_filled(tx.jan_digits(_at(F.col("i_jan"))), tx.jan_digits(_at(F.col("i_other"))))
    named = rows.select(*SHEET, "row_idx", jan.alias("jan"), _at(F.col("i_name")).alias("product_name")).where("jan IS NOT NULL")
    scored = named.withColumn("score", name_score(product_key_text(F.col("product_name"))))
    best = scored.groupBy(*SHEET).agg(F.min_by(F.struct("jan", "product_name", "score"), F.struct(-F.col("score"), F.col("row_idx"))).alias("b"))
    return best.select(*SHEET, "b.*")


def file_products(cells: DataFrame) -> DataFrame:
    """file_id, jan, product_name: every file's product; empty where nothing tells it.

    The sheets' products compete by their names' scores, the first sheet on ties; sheets of addresses take no part. A file
    without any has the first JAN in the first 30 rows of its sheets, and the first name beside a label for it in their first column.
    """
    place = F.col("sheet_no") if "sheet_no" in cells.columns else F.lit(0)
    order = cells.groupBy(*SHEET).agg(F.struct(F.min(place).alias("no"), F.col("sheet_name").alias("name")).alias("place"))
    listed = sheet_products(cells).where(~F.col("sheet_name").rlike(ADDRESS_SHEETS)).join(order, SHEET)
    best = listed.groupBy("file_id").agg(F.min_by(F.struct("jan", "product_name"), F.struct((-F.col("score")).alias("s"), F.col("place").alias("p"))).alias("b"))
    top = cells.where(F.col("row_idx") < TOP).join(order, SHEET)
    jan = tx.jan_digits(F.col("value"))
    first = top.withColumn("j", jan).where("j <> ''").groupBy("file_id").agg(F.min_by("j", F.struct(F.col("place").alias("p"), F.col("row_idx").alias("r"), F.col("col_idx").alias("c"))).alias("first_jan"))
    beside = rows_of(cells.where((F.col("row_idx") < TOP) & (F.col("col_idx") < 4))).where(_key(_at(0)).isin(*NAME_HEADS)).withColumn("v", tx.first_filled(_at(1), _at(2), _at(3))).where("v IS NOT NULL").join(order, SHEET)
    label = beside.groupBy("file_id").agg(F.min_by("v", F.struct(F.col("place").alias("p"), F.col("row_idx").alias("r"))).alias("first_name"))
    every = cells.select("file_id").distinct().join(best, "file_id", "left").join(first, "file_id", "left").join(label, "file_id", "left")
    pick = lambda own, other: F.coalesce(F.when(F.col("b").isNotNull(), F.col(own)).otherwise(F.col(other)), F.lit(""))
    return every.select("file_id", pick("b.jan", "first_jan").alias("jan"), pick("b.product_name", "first_name").alias("product_name"))


def filled(entries: DataFrame, cells: DataFrame) -> DataFrame:
    """Entries of sheets with what they lack: the JAN and the name of their sheet's product, else of their file's."""
    sheet = sheet_products(cells).select(*SHEET, F.col("jan").alias("_sj"), F.col("product_name").alias("_sn"))
    file = file_products(cells).select("file_id", F.col("jan").alias("_fj"), F.col("product_name").alias("_fn"))
    both = entries.join(sheet, SHEET, "left").join(file, "file_id", "left")
    known = F.when(F.col("jan") != UNKNOWN, F.col("jan"))
    jan = F.coalesce(tx.first_filled(known, F.col("_sj"), F.col("_fj")), F.lit(UNKNOWN))
    name = F.coalesce(tx.first_filled(F.col("product_name"), F.col("_sn"), F.col("_fn")), F.lit(""))
    return both.withColumn("jan", jan).withColumn("product_name", name).drop("_sj", "_sn", "_fj", "_fn")


# Families


def family_key(key: Column) -> Column:
    """A plain name after the family's other spellings were rewritten, in order."""
    for old, new in RENAMED:
        key = F.replace(key, F.lit(_plain(old)), F.lit(_plain(new)))
    return key


def in_family(key: Column) -> Column:
    return key.rlike("|".join(_plain(w) for w in FAMILY_WORDS))


def _bears(key: Column) -> Column:
    return F.contains(key, F.lit(_plain(FAMILY)))


def keyed(products: DataFrame) -> DataFrame:
    """client_id, p_jan, p_name, shown (the formal name where there is one), p_key, sku, formal (whether it has one)."""
    formal = tx.trim(F.col("formal_name")) if "formal_name" in products.columns else F.lit("")
    sku = tx.trim(F.col("internal_sku")) if "internal_sku" in products.columns else F.lit("")
    own = products.select("client_id", F.col("jan").alias("p_jan"), F.col("name").alias("p_name"), tx.first_filled(formal, tx.trim(F.col("name"))).alias("shown"), F.coalesce(sku, F.lit("")).alias("sku"), (formal != "").alias("formal"))
    return own.withColumn("shown", F.coalesce("shown", F.lit(""))).withColumn("p_plain", product_key_text(F.col("shown"))).withColumn("p_key", family_key(F.col("p_plain")))


def resolve(rows: DataFrame, products: DataFrame) -> DataFrame:
    """client_id, jan, name, found_jan, found_name for each distinct triple of the rows: by JAN, else by name, else as it stands.

    Names are compared after NFKC and with the family's spellings made one. An equal name scores its length and 1000, one
    inside the other the shorter one's length and 100, else two names of the family 500; the best wins, then the first by
    name and JAN. A row with a product's JAN keeps its own name where that says more. What is not found keeps its JAN, and a
    blank name becomes the JAN.
    """
    own = rows.select("client_id", F.coalesce(tx.trim(F.col("jan")), F.lit("")).alias("jan"), tx.trim(F.col("name")).alias("name")).distinct()
    own = own.withColumn("plain", product_key_text(F.col("name"))).withColumn("key", family_key(F.col("plain")))
    there = keyed(products)
    by_jan = own.join(there.select("client_id", F.col("p_jan").alias("jan"), F.col("p_name").alias("j_name"), product_key_text(F.col("p_name")).alias("j_plain")), ["client_id", "jan"], "left")
    open_ = by_jan.where("j_name IS NULL AND key <> ''").select("client_id", "key").distinct()
    named = there.where("p_key <> ''")
    met = _meet(open_, "key", named.select("client_id", "p_key").distinct(), "p_key", by=["client_id"])
    inside = open_.join(met, ["client_id", "key"]).join(named, ["client_id", "p_key"])
    score = F.when(F.col("key") == F.col("p_key"), F.length("p_key") + 1000).otherwise(F.least(F.length("key"), F.length("p_key")) + 100)
    pairs = inside.select("client_id", "key", score.alias("score"), "p_name", "p_jan").unionByName(_family_pairs(open_, named, inside))
    best = pairs.groupBy("client_id", "key").agg(F.min_by(F.struct("p_jan", "p_name"), F.struct((-F.col("score")).alias("s"), F.col("p_name"), F.col("p_jan"))).alias("b"))
    out = by_jan.join(best, ["client_id", "key"], "left")
    more = (F.col("plain") != "") & (F.col("plain") != F.col("j_plain")) & ((F.contains("plain", F.col("j_plain")) & (F.length("plain") > F.length("j_plain") + 2)) | F.col("plain").rlike(FILE_NAME_WORDS))
    hit = F.col("j_name").isNotNull()
    return out.select(
        "client_id",
        "jan",
        "name",
        F.when(hit, F.col("jan")).otherwise(F.coalesce("b.p_jan", "jan")).alias("found_jan"),
        F.when(hit & more, F.col("name")).when(hit, F.col("j_name")).otherwise(F.coalesce("b.p_name", F.nullif("name", F.lit("")), "jan")).alias("found_name"),
    )


def _family_pairs(open_: DataFrame, named: DataFrame, inside: DataFrame) -> DataFrame:
    """client_id, key, score, p_name, p_jan: for each name of the family the first product of the family that it does not meet
    otherwise. A name that meets m products is asked to look at the first m + 1 of its client's family alone.
    """
    ours = named.where(_bears(F.col("p_key"))).withColumn("r", F.row_number().over(Window.partitionBy("client_id").orderBy("p_name", "p_jan")))
    asks = open_.where(_bears(F.col("key")))
    met = inside.where(_bears(F.col("p_key"))).select("client_id", "key", "p_jan", "p_name")
    count = met.groupBy("client_id", "key").agg(F.count("*").alias("m"))
    look = asks.join(count, ["client_id", "key"], "left").select("client_id", "key", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("m", F.lit(0)) + 1)).alias("r"))
    left = look.join(ours.select("client_id", F.col("r").cast("long").alias("r"), "p_jan", "p_name"), ["client_id", "r"]).join(met, ["client_id", "key", "p_jan", "p_name"], "left_anti")
    first = left.groupBy("client_id", "key").agg(F.min_by(F.struct("p_name", "p_jan"), "r").alias("b"))
    return first.select("client_id", "key", F.lit(500).alias("score"), "b.p_name", "b.p_jan")


def canonical(products: DataFrame) -> DataFrame:
    """client_id, p_jan, shown, sku: for each product its family's one name.

    Products of a SKU share the first with a formal name, else the first by name; a product of the named family without a
    SKU takes the client's only one that bears the family's name; others are their own.
    """
    own = keyed(products)
    member = F.struct((~F.col("formal")).alias("plain"), F.when(F.col("formal"), "").otherwise(F.col("p_name")).alias("by_name"), "p_name", "p_jan", "shown", "sku")
    by_sku = own.where("sku <> ''").groupBy("client_id", "sku").agg(F.min(member).alias("head"))
    bearing = own.where(_bears(F.col("p_plain"))).groupBy("client_id").agg(F.count("*").alias("n"), F.min(F.struct("shown", "sku")).alias("only")).where("n = 1").drop("n")
    both = own.join(by_sku, ["client_id", "sku"], "left").join(bearing, "client_id", "left")
    named = in_family(F.col("p_plain")) & F.col("only").isNotNull()
    pick = lambda c: F.when(F.col("head").isNotNull(), F.col(f"head.{c}")).when(named, F.col(f"only.{c}")).otherwise(F.col(c))
    return both.select("client_id", "p_jan", pick("shown").alias("shown"), F.when(F.col("head").isNotNull(), F.col("sku")).when(named, F.col("only.sku")).otherwise(F.col("sku")).alias("sku"))


def display(rows: DataFrame, products: DataFrame) -> DataFrame:
    """client_id, jan, name, shown_jan, shown_name, product_key for each distinct triple of the rows: the canonical member of what
    resolve() finds; a row without a JAN whose name is of the family takes the client's only product of the family.
    """
    found = resolve(rows, products)
    own = keyed(products)
    only = own.where(in_family(F.col("p_plain"))).groupBy("client_id").agg(F.count("*").alias("n"), F.min("p_jan").alias("only_jan")).where("n = 1").drop("n")
    there = own.select("client_id", F.col("p_jan").alias("found_jan"), F.lit(True).alias("there")).distinct()
    both = found.join(there, ["client_id", "found_jan"], "left").join(only, "client_id", "left")
    lone = F.col("there").isNull() & F.col("jan").isin("", UNKNOWN) & in_family(product_key_text(F.col("name")))
    jan = F.when(F.col("there"), F.col("found_jan")).when(lone, F.col("only_jan"))
    picked = both.withColumn("p_jan", jan).join(canonical(products), ["client_id", "p_jan"], "left")
    shown = tx.first_filled(F.col("shown"), F.when(F.col("p_jan").isNull(), F.col("found_name")), F.col("found_jan"))
    out = picked.select("client_id", "jan", "name", F.coalesce("p_jan", "found_jan").alias("shown_jan"), F.coalesce(shown, F.lit("")).alias("shown_name"), F.coalesce("sku", F.lit("")).alias("sku"))
    key = product_key_text(F.col("shown_name"))
    return out.withColumn("product_key", F.when(F.col("sku") != "", F.concat(F.lit("sku:"), "sku")).when(key != "", F.concat(F.lit("name:"), key)).otherwise(F.concat(F.lit("jan:"), "shown_jan"))).drop("sku")
