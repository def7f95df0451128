"""Store-introduction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import introductions as op
from ..sources.testdata import Tables
from .views import using

FORMAT = "flag-list"
OFFICIAL = ["NATION_1", "NATION_2", "NATION_3"]
PRODUCTS = [f"sku:Brand#{i}" for i in (2, 5, 17)]


def _entries(t: Tables) -> DataFrame:
    return op.dedupe(t.introductions())


def _kpis(t: Tables) -> DataFrame:
    return op.with_master(op.chain_kpis(_entries(t), FORMAT), t.store_locations(), OFFICIAL)


def _known(t: Tables) -> DataFrame:
    """A master that lacks every third store."""
    return t.store_locations().where(F.col("store_code").cast("int") % 3 != 0)


_BASE = f""", entries AS (SELECT * FROM introductions QUALIFY row_number() OVER (PARTITION BY import_id, jan, store_code, store_name ORDER BY ord DESC, is_introduced DESC) = 1),
kpi AS (SELECT chain_name AS chain, 'sku:' || internal_sku AS product_key, count(*) FILTER (is_introduced) AS introduced, count(*) AS total_stores, count(*) >= 5 AS full_list,
  CASE WHEN count(*) >= 5 THEN floor(CAST(count(*) FILTER (is_introduced) AS DOUBLE) / count(*) * 1000 + 5e-1) / 10 END AS rate FROM entries GROUP BY ALL),
master AS (SELECT chain_name AS chain, count(*) AS master_stores FROM store_locations WHERE chain_name IN ({", ".join(f"'{x}'" for x in OFFICIAL)}) GROUP BY ALL),
full_kpi AS (SELECT k.chain, product_key, introduced, coalesce(master_stores, total_stores) AS total_stores, coalesce(master_stores, 0) AS master_stores, coalesce(master_stores <> total_stores, false) AS mismatch,
  master_stores IS NOT NULL OR full_list AS full_list, CASE WHEN master_stores IS NOT NULL THEN floor(CAST(introduced AS DOUBLE) / master_stores * 1000 + 5e-1) / 10 ELSE rate END AS rate FROM kpi k LEFT JOIN master USING (chain)),
known AS (SELECT * FROM store_locations WHERE CAST(store_code AS INT) % 3 <> 0)
"""


def _sql(tail: str) -> str:
    return using("introductions store_locations", _BASE + tail)


_LAST = "last AS (SELECT chain_name, store_code, 'sku:' || internal_sku AS product_key, arg_max(is_introduced, {'o': ord, 'i': is_introduced}) AS introduced FROM entries GROUP BY ALL)"
_GRID = "grid AS (SELECT chain_name, store_code, store_name, unnest([" + ", ".join(f"'{p}'" for p in PRODUCTS) + "]) AS product_key FROM store_locations)"

QUERIES = {
    "introduction_entries": (lambda t: _entries(t).select("import_id", "store_code", "jan", "is_introduced"), _sql("SELECT import_id, store_code, jan, is_introduced FROM entries")),
    "introduction_summary": (
        lambda t: op.import_summary(_entries(t)),
        _sql("SELECT import_id, count(*) AS rows, count(*) FILTER (is_introduced) AS introduced, count(DISTINCT jan) AS jans, count(DISTINCT store_code) AS stores FROM entries GROUP BY ALL"),
    ),
    "introduction_kpis": (lambda t: op.chain_kpis(_entries(t), FORMAT), _sql("SELECT * FROM kpi")),
    "introduction_kpis_with_master": (lambda t: _kpis(t), _sql("SELECT * FROM full_kpi")),
    "introduction_kpis_visible": (lambda t: op.visible(_kpis(t)).select("chain", "product_key"), _sql("SELECT chain, product_key FROM full_kpi WHERE introduced > 0 OR (full_list AND total_stores >= 5)")),
    "introduction_across_chains": (
        lambda t: op.across_chains(_kpis(t)),
        _sql(
            """, p AS (SELECT product_key, chain, sum(introduced) AS i, max(CASE WHEN full_list THEN total_stores END) AS n FROM full_kpi GROUP BY ALL)
SELECT product_key, CAST(sum(i) AS BIGINT) AS introduced, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_stores, CASE WHEN coalesce(sum(n), 0) > 0 THEN floor(CAST(sum(i) AS DOUBLE) / CAST(sum(n) AS DOUBLE) * 1000 + 5e-1) / 10 END AS rate FROM p GROUP BY ALL"""
        ),
    ),
    "introduction_company": (
        lambda t: op.company_overview(_kpis(t)),
        _sql(
            """, p AS (SELECT chain, sum(introduced) AS i, max(CASE WHEN full_list THEN total_stores END) AS n FROM full_kpi GROUP BY ALL)
SELECT CAST(sum(i) AS BIGINT) AS introduced, CAST(sum(n) AS BIGINT) AS total_stores, floor(CAST(sum(i) AS DOUBLE) / CAST(sum(n) AS DOUBLE) * 1000 + 5e-1) / 10 AS rate FROM p"""
        ),
    ),
    "introduction_import_chain": (
        lambda t: op.import_chain(t.introductions().withColumn("import_id", F.col("internal_sku"))),
        using("introductions", "SELECT internal_sku AS import_id, chain_name AS chain, count(*) AS n FROM introductions GROUP BY internal_sku, chain_name QUALIFY row_number() OVER (PARTITION BY internal_sku ORDER BY count(*) DESC, min(ord), chain_name) = 1"),
    ),
    "introduction_dominant_jan": (
        lambda t: op.dominant_jan(_entries(t), t.products().where("client_id = 'C2'")),
        using(
            "introductions store_locations products",
            _BASE
            + """, n AS (SELECT import_id, jan, count(*) AS n FROM entries GROUP BY ALL), best AS (SELECT import_id, jan FROM n WHERE jan IN (SELECT jan FROM products WHERE client_id = 'C2') QUALIFY row_number() OVER (PARTITION BY import_id ORDER BY n DESC, jan) = 1)
SELECT import_id, best.jan AS jan, (SELECT count(*) FROM n WHERE n.import_id = best.import_id) AS jans FROM best""",
        ),
    ),
    "introduction_unmatched": (
        lambda t: op.unmatched_stores(_entries(t), _known(t)),
        _sql(
            """, u AS (SELECT import_id, store_name, row_number() OVER (PARTITION BY import_id ORDER BY store_name) AS r FROM (SELECT DISTINCT import_id, store_name FROM entries WHERE store_code NOT IN (SELECT store_code FROM known)))
SELECT import_id, count(*) AS unmatched, string_agg(store_name, ',' ORDER BY store_name) FILTER (r <= 3) AS examples FROM u GROUP BY ALL"""
        ),
    ),
    "display_products": (
        lambda t: op.display_products(t.products()),
        using("products", "SELECT client_id, jan, first_value(name) OVER (PARTITION BY client_id, internal_sku ORDER BY name, jan) AS display_name FROM products"),
    ),
    "introduction_matrix": (
        lambda t: op.matrix(_entries(t), t.store_locations(), PRODUCTS),
        _sql(f", {_LAST}, {_GRID} SELECT g.*, coalesce(introduced, false) AS introduced FROM grid g LEFT JOIN last USING (chain_name, store_code, product_key)"),
    ),
    "introduction_matrix_export": (
        lambda t: op.matrix_export(op.matrix(_entries(t), t.store_locations(), PRODUCTS), PRODUCTS),
        _sql(
            f""", {_LAST}, {_GRID}, flat AS (SELECT chain_name, store_code, store_name, {", ".join(f"CASE WHEN bool_or(introduced) FILTER (product_key = '{p}') THEN '◯' ELSE '-' END AS p{i}" for i, p in enumerate(PRODUCTS))}
  FROM grid LEFT JOIN last USING (chain_name, store_code, product_key) GROUP BY chain_name, store_code, store_name)
SELECT CAST(row_number() OVER (PARTITION BY chain_name ORDER BY store_code) AS INTEGER) AS no, * FROM flat"""
        ),
    ),
    "introduction_supplemental": (
        lambda t: op.supplemental(_entries(t), _known(t)),
        _sql("SELECT DISTINCT chain_name, store_code, store_name FROM entries WHERE is_introduced AND store_code NOT IN (SELECT store_code FROM known) AND lower(store_name) NOT IN (SELECT lower(store_name) FROM known)"),
    ),
    "locations_by_chain": (lambda t: op.locations_by_chain(t.store_locations()), using("store_locations", "SELECT chain_name, count(*) AS stores, min(store_name) AS first_store, count(address) AS with_address FROM store_locations GROUP BY ALL")),
    "location_sync_preview": (
        lambda t: op.sync_preview(_known(t), t.store_locations()),
        _sql("SELECT count(*) AS missing, string_agg(store_code, ',' ORDER BY store_code) FILTER (r <= 5) AS examples FROM (SELECT store_code, row_number() OVER (ORDER BY store_code) AS r FROM store_locations WHERE store_code NOT IN (SELECT store_code FROM known))"),
    ),
}
