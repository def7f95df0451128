"""Store-list pages of four markups to store rows: chain, store_code, store_name, postal_code, address, tel.

Input: page_id, html. A store on several pages is taken from the last page, and there from the last place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .imports import latest

#: Markup of the four store lists, which the patterns must match as it is. Fixed values.
LD_BLOCK = r'<script type="application/ld\+json">\s*(\{[\s\S]*?\})\s*</script>'
BOX, BOX_ID = 'class="shopdetail-box"', r"shop_id=(\d+)"
BOX_NAME, BOX_POSTCODE = r"shop-name[^>]*>\s*<a[^>]*>([^<]+)</a>", "shop-postcode[^>]*>〒([^<]+)"
BOX_ADDRESS, BOX_TEL = r"shop-address[^>]*>\s*([\s\S]*?)</p>", r"(\d{2,4}-\d{2,4}-\d{4})"
ITEM, ITEM_ID = "shopTable__item", r'href="/store/shop/([^/"]+)'
ITEM_NAME, ITEM_ADDRESS = r'shopTable__name[\s\S]*?<span class="txt">([^<]+)', r"shopTable__address[\s\S]*?<p>([^<]+)"
LINK, LINK_ID = r'(?i)(?=<a href="/blogs/shop/\d+"[^>]*class="wl-shop-list__link">)', r'(?i)^<a href="/blogs/shop/(\d+)"[^>]*class="wl-shop-list__link">'
LINK_NAME, LINK_VALUE = '(?i)<h4 class="wl-shop-list__item-title">([^<]+)</h4>', r'[\s\S]*?wl-shop-list__item-data__value">([^<]+)</div>'
LINK_ADDRESS, LINK_TEL = f"(?i)wl-place[^>]*>{LINK_VALUE}", f"(?i)wl-tel[^>]*>{LINK_VALUE}"

_LD = "name string, url string, telephone string, address string"
_ADDRESS = "postalCode string, addressRegion string, addressLocality string, streetAddress string"


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group)


def _last(rows: DataFrame) -> DataFrame:
    kept = rows.where("store_name <> '' AND address <> '' AND slug <> ''")
    return latest(kept, [F.col("store_code")], [F.desc("page_id"), F.desc("place")]).drop("page_id", "place", "slug")


def json_ld(pages: DataFrame) -> DataFrame:
    """Every JSON-LD block; a block that is no JSON or lacks name, slug or address is passed over."""
    blocks = F.regexp_extract_all("html", F.lit(LD_BLOCK), F.lit(1))
    rows = pages.select("page_id", F.posexplode(blocks).alias("place", "block")).withColumn("d", F.from_json("block", _LD))
    a = F.from_json("d.address", _ADDRESS)
    slug = F.regexp_replace(F.element_at(F.split(F.regexp_replace(F.coalesce(F.try_parse_url(tx.trim(F.col("d.url")), F.lit("PATH")), F.lit("")), "/+$", ""), "/"), -1), r"\.html$", "")
    structured = F.startswith(F.coalesce("d.address", F.lit("")), F.lit("{"))
    parts = F.concat(*[tx.trim(F.col(f"a.{k}")) for k in ("addressRegion", "addressLocality", "streetAddress")])
    return _last(
        rows.withColumn("a", a).select(
            "page_id",
            "place",
            slug.alias("slug"),
            F.concat(F.lit("hands-"), slug).alias("store_code"),
            tx.trim(F.col("d.name")).alias("store_name"),
            F.when(structured, F.regexp_replace(F.coalesce("a.postalCode", F.lit("")), r"\D", "")).otherwise("").alias("postal_code"),
            F.when(structured, parts).otherwise(tx.trim(F.col("d.address"))).alias("address"),
            tx.trim(F.regexp_replace(F.coalesce("d.telephone", F.lit("")), r"(?i)TEL[:：]?\s*", "")).alias("tel"),
        )
    )


def boxes(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", F.posexplode(F.split("html", BOX)).alias("place", "part")).where("place > 0")
    p = F.col("part")
    address = F.regexp_replace(F.regexp_replace(_found(p, BOX_ADDRESS), r"(?i)<br\s*/?>", " "), "<[^>]+>", "")
    slug = _found(p, BOX_ID)
    return _last(
        rows.select(
            "page_id",
            "place",
            slug.alias("slug"),
            F.concat(F.lit("loft-"), slug).alias("store_code"),
            tx.trim(_found(p, BOX_NAME)).alias("store_name"),
            tx.trim(_found(p, BOX_POSTCODE)).alias("postal_code"),
            tx.squeeze(address).alias("address"),
            _found(p, BOX_TEL).alias("tel"),
        )
    )


def items(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", F.posexplode(F.split("html", ITEM)).alias("place", "part")).where("place > 0")
    p = F.col("part")
    slug, text = _found(p, ITEM_ID), tx.trim(_found(p, ITEM_ADDRESS))
    return _last(
        rows.select(
            "page_id",
            "place",
            slug.alias("slug"),
            F.concat(F.lit("atcosme-"), slug).alias("store_code"),
            tx.trim(_found(p, ITEM_NAME)).alias("store_name"),
            _found(text, r"^(\d{3}-\d{4})").alias("postal_code"),
            tx.trim(F.regexp_replace(text, r"^\d{3}-\d{4}\s*", "")).alias("address"),
            F.lit("").alias("tel"),
        )
    )


def links(pages: DataFrame) -> DataFrame:
    """One link for each store; the phone number is optional."""
    rows = pages.select("page_id", F.posexplode(F.split("html", LINK)).alias("place", "part"))
    p = F.col("part")
    slug = _found(p, LINK_ID)
    return _last(
        rows.select(
            "page_id",
            "place",
            slug.alias("slug"),
            F.concat(F.lit("ainz-"), slug).alias("store_code"),
            tx.trim(_found(p, LINK_NAME)).alias("store_name"),
            F.lit("").alias("postal_code"),
            tx.trim(_found(p, LINK_ADDRESS)).alias("address"),
            tx.trim(_found(p, LINK_TEL)).alias("tel"),
        )
    )
