"""Store-introduction sheets of six layouts over the long cells table (file_id, sheet_name, row_idx, col_idx, value).

Every layout returns file_id, sheet_name, jan, product_name, store_code, store_name, address, postal_code, is_introduced,
ord; a sheet that does not have the layout, or has fewer than five entries, gives none. dispatch() takes the first layout
that fits a sheet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import kept
from .imports import latest

SHEET = ["file_id", "sheet_name"]
LEAST = 5
ALL = "全店"
#: A store's own number in a list: shorter than any JAN (8 or 13 digits). Chains of the original have four digits at most; larger ones go on counting.
CODE, ANY_CODE = "^[0-9]{2,7}$", "^[0-9]{1,7}$"

#: Header words by field. Fixed values.
JAN_WORDS = ("janコード", "メーカjanコード", "jan")
NAME_WORDS = ("店名", "店舗名", "送り先名称①", "送り先名称1", "送り先名称")
CODE_WORDS = ("回答店番", "店番", "各店コード", "店舗コード", "店コード")
ADDRESS_WORDS = ("住所", "住所①", "住所1")
PRODUCT_WORDS = ("商品名称全部", "商品名称", "商品名", "単品名称")
OUT = ("jan", "product_name", "store_code", "store_name", "address", "postal_code")


def _key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{tx.BLANK}]", ""))


def rows_of(cells: DataFrame) -> DataFrame:
    """A row's cells as a map from column to trimmed text; blank rows are dropped."""
    filled = cells.withColumn("value", tx.trim(F.col("value"))).where("value <> ''")
    return filled.groupBy(*SHEET, "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "value"))).alias("c"))


def _at(i: int | Column) -> Column:
    return F.coalesce(F.try_element_at("c", F.lit(i) if isinstance(i, int) else i), F.lit(""))


def _entries(rows: DataFrame, ord_: Column) -> DataFrame:
    """Five entries at least; of equal (jan, code, name) the last."""
    counted = rows.withColumn("ord", ord_).withColumn("_n", F.count("*").over(Window.partitionBy(*SHEET))).where(F.col("_n") >= LEAST)
    kept = latest(counted, [F.col(x) for x in (*SHEET, "jan", "store_code", "store_name")], [F.desc("ord")])
    return kept.select(*SHEET, *OUT, "is_introduced", "ord")


def _header_row(cells: DataFrame, groups: list[tuple[str, ...]]) -> DataFrame:
    """file_id, sheet_name, head: the first row with a word of every group."""
    k = _key(F.col("value"))
    flags = [F.max(k.isin(*g).cast("int")).alias(f"g{i}") for i, g in enumerate(groups)]
    per = cells.groupBy(*SHEET, "row_idx").agg(*flags)
    for i in range(len(groups)):
        per = per.where(F.col(f"g{i}") == 1)
    return per.groupBy(*SHEET).agg(F.min("row_idx").alias("head"))


def _columns(cells: DataFrame, heads: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """file_id, sheet_name, head and each field's column, by the first word of its list that a heading equals; null without one."""
    own = cells.join(heads, SHEET).where("row_idx = head").withColumn("k", _key(F.col("value")))
    picks = []
    for f, ws in fields.items():
        rank = F.array_position(F.array(*map(F.lit, ws)), F.col("k"))
        picks.append(F.min(F.when(rank > 0, F.struct(rank.alias("r"), F.col("col_idx").alias("i"))))["i"].alias(f))
    return own.groupBy(*SHEET, "head").agg(*picks)


def allocation(cells: DataFrame, title: str = "各店按分数") -> DataFrame:
    """Store codes stand in the row above the names; each product row has a quantity for each store."""
    heads = _header_row(cells, [("商品名称",), ("納品日",)]).join(cells.where(F.contains("value", F.lit(title))).select(*SHEET).distinct(), SHEET, "left_semi")
    own = kept(cells.join(heads, SHEET).withColumn("value", tx.trim(F.col("value"))))
    codes = own.where(F.col("row_idx") == F.col("head") - 1).where(F.col("value").rlike(ANY_CODE)).select(*SHEET, "col_idx", F.col("value").alias("store_code"))
    names = own.where(F.col("row_idx") == F.col("head")).where((F.col("value") != "") & ~F.contains("value", F.lit(ALL))).select(*SHEET, "col_idx", F.col("value").alias("store_name"))
    stores = codes.join(names, [*SHEET, "col_idx"])
    stores = kept(stores.withColumn("_n", F.count("*").over(Window.partitionBy(*SHEET))).where(F.col("_n") >= LEAST).drop("_n"))
    below = own.where("row_idx > head")
    at = lambda i: F.coalesce(F.max(F.when(F.col("col_idx") == i, F.col("value"))), F.lit(""))
    rows = below.where(F.col("col_idx").isin(1, 2, 3)).groupBy(*SHEET, "row_idx").agg(*[at(i).alias(f"c{i}") for i in (1, 2, 3)])
    jan = F.coalesce(F.nullif(tx.jan_digits(F.col("c2")), F.lit("")), F.nullif(tx.jan_digits(F.col("c1")), F.lit("")), F.lit("UNKNOWN"))
    rows = rows.select(*SHEET, "row_idx", jan.alias("jan"), F.col("c3").alias("product_name")).where(~F.contains("product_name", F.lit("販促物同梱")) & ((F.col("jan") != "UNKNOWN") | (F.col("product_name") != "")))
    # A wide sheet has as many columns as the chain has stores: its cells meet the stores by their columns, never as one row.
    given = below.join(stores.select(*SHEET, "col_idx"), [*SHEET, "col_idx"], "left_semi").where(tx.positive(F.col("value"))).select(*SHEET, "row_idx", "col_idx", F.lit(True).alias("is_introduced")).distinct()
    each = rows.join(given.select(*SHEET, "row_idx").distinct(), [*SHEET, "row_idx"], "left_semi").join(stores, SHEET).join(given, [*SHEET, "row_idx", "col_idx"], "left")
    return _entries(each.select(*SHEET, "row_idx", "jan", "product_name", "store_code", "store_name", F.lit("").alias("address"), F.lit("").alias("postal_code"), "col_idx", F.coalesce("is_introduced", F.lit(False)).alias("is_introduced")), F.struct("row_idx", "col_idx"))


def store_allocation(cells: DataFrame, first_col: int = 4) -> DataFrame:
    """JANs stand in the row labelled jan from column 4 on; each store row has a quantity for each of them."""
    rows = rows_of(cells)
    label = _key(_at(1))
    jans = rows.where(label == "jan").select(*SHEET, F.explode("c").alias("col_idx", "v")).where(F.col("col_idx") >= first_col).select(*SHEET, "col_idx", tx.jan_digits(F.col("v")).alias("jan")).where("jan <> ''")
    names = rows.where(F.contains(label, F.lit("商品名"))).select(*SHEET, F.explode("c").alias("col_idx", "product_name")).where(F.col("col_idx") >= first_col)
    products = jans.join(names, [*SHEET, "col_idx"], "left").groupBy(*SHEET, "col_idx").agg(F.min("jan").alias("jan"), F.coalesce(F.min("product_name"), F.lit("")).alias("product_name"))
    stores = rows.where(_at(0).rlike(CODE) & (_at(1) != "") & ~F.contains(_at(1), F.lit(ALL)))
    each = stores.join(products, SHEET).select(*SHEET, "row_idx", "jan", "product_name", _at(0).alias("store_code"), _at(1).alias("store_name"), F.lit("").alias("address"), F.lit("").alias("postal_code"), "col_idx", tx.positive(_at(F.col("col_idx"))).alias("is_introduced"))
    return _entries(each, F.struct("row_idx", "col_idx"))


def flag_list(cells: DataFrame) -> DataFrame:
    """Code, name, 0 or 1 in the first three columns; the sheet's first JAN is the product."""
    rows = rows_of(cells)
    jan = cells.withColumn("jan", tx.jan_digits(F.col("value"))).where("jan <> ''").groupBy(*SHEET).agg(F.min_by("jan", F.struct("row_idx", "col_idx")).alias("jan"))
    flags = rows.where(_at(0).rlike(CODE) & (_at(1) != "") & ~F.contains(_at(1), F.lit(ALL)) & _at(2).isin("0", "1")).join(jan, SHEET)
    return _entries(flags.select(*SHEET, "row_idx", "jan", F.lit("").alias("product_name"), _at(0).alias("store_code"), _at(1).alias("store_name"), F.lit("").alias("address"), F.lit("").alias("postal_code"), (_at(2) == "1").alias("is_introduced")), F.struct("row_idx"))


def row_list(cells: DataFrame) -> DataFrame:
    """One row for each store and product, all introduced; found by its headings."""
    cols = _columns(cells, _header_row(cells, [("店名",), JAN_WORDS]), {"i_jan": JAN_WORDS, "i_name": NAME_WORDS, "i_code": CODE_WORDS, "i_addr": ADDRESS_WORDS, "i_post": ("郵便番号",), "i_prod": PRODUCT_WORDS})
    rows = rows_of(cells).join(cols, SHEET).where("row_idx > head")
    out = rows.select(*SHEET, "row_idx", tx.jan_digits(_at(F.col("i_jan"))).alias("jan"), _at(F.col("i_prod")).alias("product_name"), _at(F.col("i_code")).alias("store_code"), _at(F.col("i_name")).alias("store_name"), _at(F.col("i_addr")).alias("address"), _at(F.col("i_post")).alias("postal_code"), F.lit(True).alias("is_introduced"))
    kept = out.where("jan <> '' AND store_name <> ''").withColumn("ord", F.struct("row_idx"))
    return latest(kept, [F.col(x) for x in (*SHEET, "jan", "store_code", "store_name")], [F.desc("ord")]).select(*SHEET, *OUT, "is_introduced", "ord")


def promotional_list(cells: DataFrame) -> DataFrame:
    """Addresses of stores; one is introduced if it has a mark, a number of pieces, or of stands."""
    cols = _columns(cells, _header_row(cells, [CODE_WORDS[2:], NAME_WORDS, ADDRESS_WORDS]), {"i_name": NAME_WORDS, "i_code": CODE_WORDS, "i_addr": ADDRESS_WORDS, "i_post": ("郵便番号",), "i_qty": ("個数",), "i_unit": ("台数",), "i_mark": ("パネル",)})
    jan = cells.join(cols.select(*SHEET, "head"), SHEET).where("row_idx < head").withColumn("jan", tx.jan_digits(F.col("value"))).where("jan <> ''").groupBy(*SHEET).agg(F.min_by("jan", F.struct("row_idx", "col_idx")).alias("jan"))
    rows = rows_of(cells).join(cols, SHEET).where("row_idx > head").join(jan, SHEET, "left").where(_at(F.col("i_name")) != "")
    some = (_at(F.col("i_mark")) == "●") | tx.positive(_at(F.col("i_qty"))) | tx.positive(_at(F.col("i_unit")))
    return _entries(rows.select(*SHEET, "row_idx", F.coalesce("jan", F.lit("UNKNOWN")).alias("jan"), F.lit("").alias("product_name"), _at(F.col("i_code")).alias("store_code"), _at(F.col("i_name")).alias("store_name"), _at(F.col("i_addr")).alias("address"), tx.postal(_at(F.col("i_post"))).alias("postal_code"), some.alias("is_introduced")), F.struct("row_idx"))


def shipment_list(cells: DataFrame, title: str = "本部送り込みリスト") -> DataFrame:
    """A title, the product's JAN beside its label, then code, name and quantity of each store, up to the first blank row.

    Rows that are no stores are passed over; of rows with one code the last decides whether it is introduced.
    """
    rows = rows_of(cells)
    titled = cells.where(F.contains("value", F.lit(title))).select(*SHEET).distinct()
    jan = rows.where("row_idx < 20").withColumn("_l", F.get(F.sort_array(F.map_keys(F.map_filter("c", lambda _, v: F.lower(v).isin("jan", "ｊａｎ")))), F.lit(0))).where("_l IS NOT NULL")
    jan = jan.withColumn("jan", tx.jan_digits(tx.first_filled(_at(F.col("_l") + 1), _at(4)))).where("jan <> ''").groupBy(*SHEET).agg(F.max_by("jan", "row_idx").alias("jan"))
    heading = (F.contains(_key(_at(1)), F.lit("コード")) | (_key(_at(1)) == "コ-ド")) & _key(_at(2)).isin("名", "店名")
    named = rows.where(heading & (F.col("row_idx") < 20) & F.contains(_key(_at(3)), F.lit("商品名")) & ~_at(4).isin("", "バーコード")).groupBy(*SHEET).agg(F.max_by(_at(4), "row_idx").alias("product_name"))
    heads = rows.where(heading).groupBy(*SHEET).agg(F.min("row_idx").alias("head"))
    below = rows.join(titled, SHEET, "left_semi").join(heads, SHEET, "left").where(F.col("row_idx") > F.coalesce("head", F.lit(13)))
    own = below.select(*SHEET, "row_idx", _at(1).alias("store_code"), _at(2).alias("store_name"), _at(4).alias("qty")).where("store_code <> '' OR store_name <> ''")
    # Blank rows are not there, so rows of one stretch keep their distance to their rank.
    own = own.withColumn("_run", F.col("row_idx") - F.row_number().over(Window.partitionBy(*SHEET).orderBy("row_idx"))).withColumn("_store", is_store_row(F.col("store_code"), F.col("store_name")))
    first = own.where("_store").groupBy(*SHEET).agg(F.min("_run").alias("_first"))
    kept = own.where("_store").join(first, SHEET).where("_run = _first").withColumn("is_introduced", tx.positive(F.col("qty")))
    kept = kept.withColumn("is_introduced", F.last("is_introduced").over(Window.partitionBy(*SHEET, "store_code").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = kept.join(jan, SHEET).join(named, SHEET, "left")
    return _entries(out.select(*SHEET, "row_idx", "jan", F.coalesce("product_name", F.lit("")).alias("product_name"), "store_code", "store_name", F.lit("").alias("address"), F.lit("").alias("postal_code"), "is_introduced"), F.struct("row_idx"))


LAYOUTS: tuple[tuple[str, Callable[[DataFrame], DataFrame]], ...] = (("allocation", allocation), ("store-allocation", store_allocation), ("flag-list", flag_list), ("row-list", row_list), ("promotional", promotional_list), ("shipment-list", shipment_list))


def dispatch(cells: DataFrame) -> DataFrame:
    """Entries of every sheet by the first layout that gives any, with its name. Six layouts read the cells, so these are checkpointed."""
    cells, out = kept(cells), None
    for rank, (name, parse) in enumerate(LAYOUTS):
        part = parse(cells).drop("ord").withColumn("layout", F.lit(name)).withColumn("rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    first = F.min("rank").over(Window.partitionBy(*SHEET))
    return out.withColumn("_first", first).where("rank = _first").drop("rank", "_first")


def code_aliases(code: Column) -> Column:
    """A store code and the forms that lists write it in: the number, four digits, 10 and three digits, with the chain's prefix."""
    c = F.trim(code)
    digits = F.coalesce(
        F.nullif(F.regexp_extract(c, "(?i)^ainz-0*([0-9]+)$", 1), F.lit("")), F.nullif(F.regexp_extract(c, "^1(0[0-9]{3,4})$", 1), F.lit("")), F.nullif(F.regexp_extract(c, "^([0-9]{1,4})$", 1), F.lit(""))
    )
    n = F.nullif(F.regexp_replace(digits, "^0+(?=[0-9])", ""), F.lit(""))
    pad = lambda width: F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n)
    more = F.array(n, pad(4), F.concat(F.lit("10"), pad(3)), F.concat(F.lit("ainz-"), pad(4)), F.concat(F.lit("ainz-"), n))
    return F.array_distinct(F.when(n.isNull(), F.array(c)).otherwise(F.concat(F.array(c), more)))


def is_store_row(code: Column, name: Column) -> Column:
    """A physical store of a shipment list: its code, and a name that is no total, region, centre, pharmacy, new or web store."""
    n = F.coalesce(name, F.lit(""))
    no = n.rlike("^(関東|九州)[0-9]+$|^新店|^アイン薬局|(?i)webstore|ウェブストア|通販|オンライン") | n.isin("", "札幌センター", "関東センター") | F.contains(n, F.lit(ALL))
    return F.coalesce(code.rlike("^10[0-9]{3,4}$"), F.lit(False)) & ~no
