"""The product master's further fields in one VARIANT column: written as it is, read by name and type, searched over all fields."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The further fields by column, in order. Fixed values.
FIELDS = {
    "formal_product_name": "text", "csv_export_product_name": "text", "product_name_kana": "text", "manufacturer_code": "text", "manufacturer_name": "text", "reference_retail_price": "number",
    "purchase_lot_quantity": "number", "sales_lot_quantity": "number", "minimum_order_unit": "text", "case_gtin": "text", "unit_width_mm": "number", "unit_height_mm": "number", "unit_depth_mm": "number",
    "unit_volume_l": "number", "unit_volume_unit": "text", "unit_weight_g": "number", "case_width_mm": "number", "case_height_mm": "number", "case_depth_mm": "number", "case_volume_l": "number", "case_weight_g": "number",
    "receipt_product_name": "text", "product_features": "text", "product_catchcopy": "text", "usage_instructions": "text", "usage_precautions": "text", "ingredients": "text", "country_of_origin": "text", "shelf_life_days": "text",
    "hazardous_material_category": "text",
}


def packed(df: DataFrame, out: str = "extras") -> DataFrame:
    """df with its further fields in one VARIANT; blank texts and nulls are left out, and so are fields that df lacks."""
    there = [c for c in FIELDS if c in df.columns]
    value = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if FIELDS[c] == "text" else F.col(c).cast("double")
    made = F.to_json(F.struct(*[value(c).alias(c) for c in there])) if there else F.lit("{}")
    return df.withColumn(out, F.parse_json(made)).drop(*there)


def field(name: str, extras: str | Column = "extras") -> Column:
    """A further field in its type: null where it is absent or not of that type."""
    return F.try_variant_get(F.col(extras) if isinstance(extras, str) else extras, f"$.{name}", "string" if FIELDS[name] == "text" else "double")


def unpacked(df: DataFrame, extras: str = "extras", fields: list[str] | None = None) -> DataFrame:
    """df with further fields as typed columns, all of them or those named, in their order."""
    return df.select(*[c for c in df.columns if c != extras], *[field(c, extras).alias(c) for c in FIELDS if fields is None or c in fields])


def search(df: DataFrame, query: str, columns: list[str], extras: str = "extras") -> DataFrame:
    """Rows that hold the text in one of the columns or of the further text fields, in any case; all for a blank text.

    The condition names the VARIANT once: what makes it is copied into a filter for each time that it is named there.
    """
    q = query.strip().lower()
    holds = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))
    inside = lambda v: reduce(or_, [holds(field(c, v)) for c, kind in FIELDS.items() if kind == "text"])
    return df.where(reduce(or_, [holds(F.col(c)) for c in columns], F.exists(F.array(F.col(extras)), inside))) if q else df


def page(found: DataFrame, keys: list[str], number: int, size: int = 50) -> tuple[DataFrame, DataFrame]:
    """(a page's rows, number from 1, in the order of keys; how many rows were found in all, exactly)."""
    rows = found.orderBy(*keys).offset((max(1, number) - 1) * size).limit(size)
    return rows, found.agg(F.count("*").alias("found"))
