"""Sell-out queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import sellout as op
from ..sources.testdata import Tables
from .views import using

READ = op.IMPORTS_READ  # of each client


def _latest(t: Tables, read: int | None) -> DataFrame:
    return op.entries_of(t.sellout_entries(), op.latest_imports(t.sellout_imports(), read))


def _named(t: Tables, read: int | None) -> DataFrame:
    return op.with_product_names(_latest(t, read), t.products())


_LATEST = """, newest AS (SELECT * FROM sellout_imports{limit}),
latest AS (SELECT * FROM newest QUALIFY row_number() OVER (PARTITION BY client_id, retailer, period_start, period_end ORDER BY imported_at DESC, import_id DESC) = 1),
own AS (SELECT *, coalesce(nullif(matched_store_name, ''), nullif(store_name, ''), '店舗不明') AS store, strftime(period_end, '%Y-%m') AS label FROM sellout_entries WHERE import_id IN (SELECT import_id FROM latest)),
named AS (SELECT o.* REPLACE (coalesce(nullif(p.name, ''), nullif(o.product_name, ''), '未登録') AS product_name) FROM own o LEFT JOIN products p ON p.client_id = o.client_id AND p.jan = o.jan)
"""


def _sql(read: int | None, tail: str) -> str:
    return using("products sellout_entries sellout_imports", _LATEST.replace("{limit}", "" if read is None else f" QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY imported_at DESC, import_id DESC) <= {read}") + tail)


_FILTER = "retailer = 'NATION_3' AND contains(lower(store), 'shop 1') AND label LIKE '2001-%'"

def _reports(read: int | None) -> dict:
    """The reports over the `read` newest imports of each client, which is what its screen reads, or over all of them."""
    return {
        "sellout_latest_imports": (lambda t: op.latest_imports(t.sellout_imports(), read).select("import_id", "entry_count"), _sql(read, "SELECT import_id, entry_count FROM latest")),
        "sellout_import_summary": (
            lambda t: op.import_summary(t.sellout_entries()),
            using(
                "sellout_entries",
                """SELECT import_id, count(*) AS entries, count(DISTINCT coalesce(nullif(store_code, ''), store_name)) AS stores, CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(amount) AS BIGINT) AS amount, count(DISTINCT jan) AS jans,
  CAST(min(period_start) AS VARCHAR) AS first_day, CAST(max(period_end) AS VARCHAR) AS last_day FROM sellout_entries GROUP BY ALL""",
            ),
        ),
        "sellout_filtered": (
            lambda t: op.filtered(_latest(t, read), "NATION_3", "Shop 1", "", "2001").select("import_id", "store_code", "jan", "qty", "amount"),
            _sql(read, f"SELECT import_id, store_code, jan, qty, amount FROM own WHERE {_FILTER}"),
        ),
        "sellout_monthly": (
            lambda t: op.monthly(_named(t, read)),
            _sql(
                read,
                """SELECT CAST(year(period_end) AS VARCHAR) || '年' || month(period_end) || '月' AS month, retailer, store, jan, arg_min(product_name, {'i': import_id, 'o': ord, 'p': product_name}) AS product_name,
  CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(amount) AS BIGINT) AS amount FROM named GROUP BY ALL"""
            ),
        ),
        "sellout_trend": (lambda t: op.trend(_latest(t, read)), _sql(read, "SELECT label, CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(amount) AS BIGINT) AS amount FROM own GROUP BY ALL HAVING sum(amount) > 0 OR sum(qty) > 0")),
        "sellout_top_products": (
            lambda t: op.top_products(_latest(t, read)),
            _sql(read, "SELECT coalesce(nullif(product_name, ''), jan) AS label, CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(amount) AS BIGINT) AS amount FROM own GROUP BY ALL ORDER BY qty DESC, label LIMIT 8"),
        ),
        "sellout_panel": (
            lambda t: op.panel(_named(t, read)),
            _sql(
                read,
                """SELECT count(DISTINCT store) AS stores, CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(amount) AS BIGINT) AS amount,
  floor(CAST(sum(amount) AS DOUBLE) / count(DISTINCT store) + 5e-1) AS amount_per_store, floor(CAST(sum(qty) AS DOUBLE) / count(DISTINCT store) * 100 + 5e-1) / 100 AS qty_per_store FROM named"""
            ),
        ),
        "sellout_latest_month": (lambda t: op.latest_month(_latest(t, read)), _sql(read, "SELECT substr(max(label), 1, 4) AS year, CAST(CAST(substr(max(label), 6) AS INT) AS VARCHAR) AS month FROM own")),
        "sellout_options": (
            lambda t: op.options(_latest(t, read), "NATION_3", "2001"),
            _sql(
                read,
                """, scoped AS (SELECT * FROM own WHERE retailer = 'NATION_3' AND label LIKE '2001-%')
SELECT DISTINCT 'retailer' AS kind, retailer AS value FROM own UNION SELECT 'store', store FROM scoped UNION SELECT 'year', substr(label, 1, 4) FROM own UNION SELECT 'month', CAST(CAST(substr(label, 6) AS INT) AS VARCHAR) FROM scoped
UNION SELECT 'product', CASE WHEN product_name <> '' THEN product_name || ' (' || jan || ')' ELSE jan END FROM scoped"""
            ),
        ),
    }


#: The names with "whole" read every import.
QUERIES = _reports(READ) | {name.replace("sellout_", "sellout_whole_", 1): q for name, q in _reports(None).items() if name != "sellout_import_summary"}
