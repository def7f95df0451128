"""Sell-in queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sellin as op
from ..sources.testdata import Tables
from .views import using

START, END, SEARCH, STORE = "1997-03-01", "1997-03-31", "red", "BUILDING"


def _priced(t: Tables, start: str = START, end: str = END, store: str | None = None):
    return op.sell_in_lines(t.orders(), t.order_lines(start, end), t.products(), start, end, store)


def _rows(t: Tables, search: str = "", store: str | None = None):
    return op.sell_in_rows(_priced(t, store=store), t.products(), START, END, search)


def _text(df):
    return df.withColumn("date", F.col("date").cast("string"))


def _sql(tail: str, store: str | None = None, search: str = "") -> str:
    name = "store_name" if store else f"'{op.ALL_STORES}'"
    own = f"AND o.store_name = '{store}'" if store else ""
    match = f"WHERE contains(lower(jan), '{search}') OR contains(lower(product_name), '{search}')" if search else ""
    return using(
        "products shop_orders order_lines",
        f""", priced AS (SELECT l.order_id, l.line_no, o.order_date AS date, {name} AS store_name, l.jan, coalesce(p.name, '未登録') AS product_name, CAST(l.qty AS BIGINT) AS qty,
  CAST(floor(p.wholesale_price * l.qty) AS BIGINT) AS wholesale_amount, CAST(floor(p.retail_price * l.qty) AS BIGINT) AS retail_amount, p.retail_price IS NULL AS has_issue
  FROM order_lines l JOIN shop_orders o ON l.order_id = o.id LEFT JOIN products p ON p.client_id = o.client_id AND p.jan = l.jan
  WHERE o.order_date BETWEEN DATE '{START}' AND DATE '{END}' {own}),
actual AS (SELECT date, store_name, jan, arg_min(product_name, {{'d': date, 'o': order_id, 'l': line_no}}) AS product_name, count(DISTINCT order_id) AS order_count, CAST(sum(qty) AS BIGINT) AS qty,
  CASE WHEN count(wholesale_amount) = count(*) THEN CAST(sum(wholesale_amount) AS BIGINT) END AS wholesale_amount,
  CASE WHEN count(retail_amount) = count(*) THEN CAST(sum(retail_amount) AS BIGINT) END AS retail_amount, bool_or(has_issue) AS has_issue FROM priced GROUP BY ALL),
pairs AS (SELECT store_name, jan, arg_max({{'n': product_name, 'h': has_issue}}, {{'d': date, 'o': order_id, 'l': line_no}}) AS last FROM priced GROUP BY ALL),
by_jan AS (SELECT jan, true AS known, arg_min({{'p': retail_price IS NOT NULL}}, client_id).p AS priced FROM products GROUP BY jan),
days AS (SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS date),
every AS (SELECT d.date, g.store_name, g.jan, CASE WHEN a.jan IS NULL THEN g.last.n ELSE a.product_name END AS product_name, coalesce(a.order_count, 0) AS order_count, coalesce(a.qty, 0) AS qty,
  CASE WHEN a.jan IS NOT NULL THEN a.wholesale_amount WHEN b.known THEN 0 END AS wholesale_amount, CASE WHEN a.jan IS NOT NULL THEN a.retail_amount WHEN b.priced THEN 0 END AS retail_amount,
  CASE WHEN a.jan IS NULL THEN g.last.h ELSE a.has_issue END AS has_issue
  FROM days d CROSS JOIN pairs g LEFT JOIN by_jan b USING (jan) LEFT JOIN actual a ON a.date = d.date AND a.store_name = g.store_name AND a.jan = g.jan),
rows AS (SELECT * FROM every {match})
{tail}""",
    )


_POISONED = "CASE WHEN count({0}) = count(*) THEN CAST(coalesce(sum({0}), 0) AS BIGINT) END AS {0}"

QUERIES = {
    "sell_in_rows": (lambda t: _text(_rows(t)), _sql("SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM rows")),
    "sell_in_rows_of_store": (lambda t: _text(_rows(t, store=STORE)), _sql("SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM rows", STORE)),
    "sell_in_search": (lambda t: _text(_rows(t, SEARCH)), _sql("SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM rows", search=SEARCH)),
    "sell_in_totals": (
        lambda t: op.totals(_rows(t, SEARCH)),
        _sql(f"SELECT CAST(coalesce(sum(qty), 0) AS BIGINT) AS qty, {_POISONED.format('wholesale_amount')}, {_POISONED.format('retail_amount')}, count(*) FILTER (has_issue) AS issues FROM rows", search=SEARCH),
    ),
    "sell_in_daily_chart": (
        lambda t: _text(op.daily_chart(_rows(t))),
        _sql(f"SELECT CAST(date AS VARCHAR) AS date, CAST(sum(qty) AS BIGINT) AS qty, {_POISONED.format('wholesale_amount')}, {_POISONED.format('retail_amount')} FROM rows GROUP BY ALL"),
    ),
    "sell_in_product_chart": (
        lambda t: op.product_chart(_rows(t)),
        _sql(f"SELECT product_name, CAST(sum(qty) AS BIGINT) AS qty, {_POISONED.format('wholesale_amount')} FROM rows GROUP BY ALL ORDER BY qty DESC, product_name LIMIT 8"),
    ),
    "sell_in_order_count": (
        lambda t: op.order_count(_priced(t), SEARCH),
        _sql(f"SELECT count(DISTINCT order_id) AS orders FROM priced WHERE contains(lower(jan), '{SEARCH}') OR contains(lower(product_name), '{SEARCH}')"),
    ),
    "sell_in_store_options": (
        lambda t: op.store_options(t.orders(), t.order_lines(START, END), START, END),
        using("shop_orders order_lines", f"SELECT DISTINCT store_name FROM shop_orders o JOIN order_lines l ON l.order_id = o.id WHERE order_date BETWEEN DATE '{START}' AND DATE '{END}'"),
    ),
}
