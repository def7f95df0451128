"""Order, payout and integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as op
from ..sources.testdata import Tables
from .views import using

MONTH = "1998-05"

_CONFIRM = """, priced AS (SELECT l.order_id, l.line_no, l.jan, l.qty, o.client_id, p.jan IS NOT NULL AS registered, p.wholesale_price AS unit_price_snapshot, CAST(floor(p.wholesale_price * l.qty) AS BIGINT) AS amount,
  p.retail_price AS retail_price_snapshot, CASE WHEN p.wholesale_price > 0 AND p.retail_price > 0 THEN p.wholesale_price / p.retail_price END AS payout_rate_snapshot, coalesce(c.fbp_fee_rate, 8e-2) AS fbp_fee_rate_snapshot
  FROM order_lines l JOIN shop_orders o ON l.order_id = o.id JOIN clients c ON c.id = o.client_id LEFT JOIN products p ON p.client_id = o.client_id AND p.jan = l.jan WHERE o.status = '{status}'),
paid AS (SELECT *, CASE WHEN payout_rate_snapshot > fbp_fee_rate_snapshot THEN CAST(floor(retail_price_snapshot * qty * (payout_rate_snapshot - fbp_fee_rate_snapshot)) AS BIGINT) END AS payout_amount FROM priced),
refused AS (SELECT order_id, CASE WHEN bool_or(NOT registered) THEN 'product missing' WHEN bool_or(payout_amount IS NULL) THEN 'payout missing' END AS reason FROM paid GROUP BY order_id HAVING reason IS NOT NULL),
confirmed AS (SELECT * EXCLUDE (registered, client_id) FROM paid WHERE order_id NOT IN (SELECT order_id FROM refused))
"""


def _confirmed(t: Tables, status: str = "imported"):
    """The tables hold no snapshots; orders of any status get them as if they were confirmed now."""
    orders = t.orders().where(F.col("status") == status).withColumn("status", F.lit("imported"))
    return op.confirm(orders, t.order_lines(), t.products(), t.clients())


def _snapshots(t: Tables, status: str):
    """Lines of orders of the status with snapshots where a product is known, and null ones elsewhere."""
    done, _ = _confirmed(t, status)
    lines = t.order_lines().join(t.orders().where(F.col("status") == status).select(F.col("id").alias("order_id")), "order_id", "left_semi")
    return lines.join(done.drop("jan", "qty"), ["order_id", "line_no"], "left")


def _sql(names: str, tail: str, status: str = "imported") -> str:
    return using(names, _CONFIRM.format(status=status) + tail)


_ALL = "clients products shop_orders order_lines"


def _delete(t: Tables):
    wanted = t.orders().where("cast(id as int) % 10 < 2").select(F.when(F.col("id").cast("int") % 10 == 0, F.col("id")).alias("id"), "client_id", "order_no")
    return op.delete(t.orders(), t.order_lines(), wanted, "someone", F.lit("2024-01-01 00:00:00"))


_DELETED = "SELECT * FROM shop_orders WHERE CAST(id AS INT) % 10 < 2"

QUERIES = {
    "confirm_lines": (lambda t: _confirmed(t)[0].withColumn("line_no", F.col("line_no").cast("long")), _sql(_ALL, "SELECT * FROM confirmed")),
    "confirm_refused": (lambda t: _confirmed(t)[1], _sql(_ALL, "SELECT * FROM refused")),
    "undo_confirm": (
        lambda t: op.undo_confirm(t.orders(), _snapshots(t, "confirmed"))[1].select("order_id", F.col("line_no").cast("long").alias("line_no"), "jan", "qty", "amount", "payout_amount"),
        using("shop_orders order_lines", "SELECT l.order_id, l.line_no, l.jan, l.qty, CAST(NULL AS BIGINT) AS amount, CAST(NULL AS BIGINT) AS payout_amount FROM order_lines l JOIN shop_orders o ON o.id = l.order_id WHERE status = 'confirmed'"),
    ),
    "ship": (
        lambda t: op.ship(t.orders(), _snapshots(t, "confirmed"))[0].select("id", "status"),
        _sql(_ALL, "SELECT id, 'shipped' AS status FROM shop_orders WHERE status = 'confirmed' AND id NOT IN (SELECT order_id FROM refused)", "confirmed"),
    ),
    "ship_refused": (
        lambda t: op.ship(t.orders(), _snapshots(t, "confirmed"))[1].select("id", "client_id"),
        _sql(_ALL, "SELECT id, client_id FROM shop_orders WHERE id IN (SELECT order_id FROM refused)", "confirmed"),
    ),
    "unship": (
        lambda t: op.unship(t.orders()).groupBy("client_id", "status").agg(F.count("*").alias("orders")),
        using("shop_orders", "SELECT client_id, CASE status WHEN 'shipped' THEN 'confirmed' ELSE status END AS status, count(*) AS orders FROM shop_orders GROUP BY ALL"),
    ),
    "delete_log": (
        lambda t: _delete(t)[2],
        using(
            "shop_orders order_lines",
            f"""SELECT id AS target_id, client_id, 'order' AS target_type, order_no, source_file AS file_name, status AS order_status, (SELECT count(*) FROM order_lines l WHERE l.order_id = d.id) AS line_count,
  'someone' AS operator_name, '2024-01-01 00:00:00' AS deleted_at FROM ({_DELETED}) d WHERE status <> 'shipped'""",
        ),
    ),
    "delete_orders_left": (lambda t: _delete(t)[0].select("id", "status"), using("shop_orders", "SELECT id, status FROM shop_orders WHERE NOT (CAST(id AS INT) % 10 < 2 AND status <> 'shipped')")),
    "delete_lines_left": (
        lambda t: _delete(t)[1].groupBy("order_id").agg(F.count("*").alias("lines")),
        using("shop_orders order_lines", "SELECT order_id, count(*) AS lines FROM order_lines WHERE order_id NOT IN (SELECT id FROM shop_orders WHERE CAST(id AS INT) % 10 < 2 AND status <> 'shipped') GROUP BY ALL"),
    ),
    "delete_refused": (lambda t: _delete(t)[3].select("id"), using("shop_orders", "SELECT id FROM shop_orders WHERE CAST(id AS INT) % 10 < 2 AND status = 'shipped'")),
    "order_totals": (
        lambda t: op.order_totals(t.orders(), t.order_lines(), t.products()),
        using(
            "products shop_orders order_lines",
            "SELECT order_id, CAST(sum(coalesce(floor(wholesale_price * qty), 0)) AS BIGINT) AS total FROM order_lines l JOIN shop_orders o ON o.id = l.order_id LEFT JOIN products p ON p.client_id = o.client_id AND p.jan = l.jan GROUP BY ALL",
        ),
    ),
    "client_totals": (
        lambda t: op.client_totals(t.orders(), t.order_lines(), t.products()),
        using(
            "products shop_orders order_lines",
            "SELECT o.client_id, CAST(sum(coalesce(floor(wholesale_price * qty), 0)) AS BIGINT) AS total FROM shop_orders o LEFT JOIN order_lines l ON o.id = l.order_id LEFT JOIN products p ON p.client_id = o.client_id AND p.jan = l.jan GROUP BY ALL",
        ),
    ),
    "order_total_on_lines": (
        lambda t: t.order_lines().join(op.order_totals(t.orders(), t.order_lines(), t.products()), "order_id").select("order_id", F.col("line_no").cast("long").alias("line_no"), "total"),
        using(
            "products shop_orders order_lines",
            "SELECT order_id, line_no, CAST(sum(coalesce(floor(wholesale_price * qty), 0)) OVER (PARTITION BY order_id) AS BIGINT) AS total FROM order_lines l JOIN shop_orders o ON o.id = l.order_id LEFT JOIN products p ON p.client_id = o.client_id AND p.jan = l.jan",
        ),
    ),
    "payout_lines": (
        lambda t: op.payout_lines(t.orders(), _snapshots(t, "shipped"), MONTH).select("client_id", "order_no", F.col("arrival_due_date").cast("string").alias("arrival_due_date"), "jan", "qty", "payout_amount", "fbp_fee_rate_snapshot"),
        _sql(
            _ALL,
            f"""SELECT o.client_id, o.order_no, CAST(o.arrival_due_date AS VARCHAR) AS arrival_due_date, l.jan, l.qty, c.payout_amount, coalesce(c.fbp_fee_rate_snapshot, 8e-2) AS fbp_fee_rate_snapshot
  FROM order_lines l JOIN shop_orders o ON o.id = l.order_id LEFT JOIN confirmed c ON c.order_id = l.order_id AND c.line_no = l.line_no WHERE o.status = 'shipped' AND strftime(o.arrival_due_date, '%Y-%m') = '{MONTH}'""",
            "shipped",
        ),
    ),
    "payout_totals": (
        lambda t: op.payout_totals(op.payout_lines(t.orders(), _snapshots(t, "shipped"), MONTH)),
        _sql(
            _ALL,
            f"""SELECT CAST(sum(coalesce(floor(c.unit_price_snapshot * l.qty), 0)) - floor(sum(coalesce(c.retail_price_snapshot, 0e0) * l.qty * coalesce(c.fbp_fee_rate_snapshot, 8e-2)) + 5e-1) AS BIGINT) AS payout_total, CAST(sum(l.qty) AS BIGINT) AS qty,
  count(*) FILTER (c.payout_amount IS NULL) AS missing
  FROM order_lines l JOIN shop_orders o ON o.id = l.order_id LEFT JOIN confirmed c ON c.order_id = l.order_id AND c.line_no = l.line_no WHERE o.status = 'shipped' AND strftime(o.arrival_due_date, '%Y-%m') = '{MONTH}'""",
            "shipped",
        ),
    ),
    "order_list": (
        lambda t: op.order_list(t.orders(), "customer#0000001", "all", "this_month", "1998-05-20").select("order_no", "status", "rank"),
        using(
            "shop_orders",
            "SELECT order_no, status, CASE status WHEN 'imported' THEN 0 WHEN 'confirmed' THEN 1 ELSE 2 END AS rank FROM shop_orders WHERE contains(lower(concat_ws(' ', order_no, source_file, ship_to_name, warehouse)), 'customer#0000001') AND date_trunc('month', imported_at) = DATE '1998-05-01'",
        ),
    ),
    "orders_last_month": (
        lambda t: t.orders().where(op.in_period(F.col("imported_at"), "last_month", "1998-05-20")).groupBy("status").agg(F.count("*").alias("orders")),
        using("shop_orders", "SELECT status, count(*) AS orders FROM shop_orders WHERE date_trunc('month', imported_at) = DATE '1998-04-01' GROUP BY ALL"),
    ),
    "orders_custom_period": (
        lambda t: t.orders().where(op.in_period(F.col("imported_at"), "custom", "1998-05-20", "1996-02-03", "1996-02-10")).select("id"),
        using("shop_orders", "SELECT id FROM shop_orders WHERE CAST(imported_at AS DATE) BETWEEN DATE '1996-02-03' AND DATE '1996-02-10'"),
    ),
    "order_history": (
        lambda t: op.history(t.orders()),
        using("shop_orders", "SELECT client_id, count(*) FILTER (status IN ('confirmed', 'shipped')) AS checked, count(*) FILTER (status = 'shipped') AS sent, count(*) AS orders FROM shop_orders GROUP BY ALL"),
    ),
    "integrity": (
        # Fees five times as high, so that some rates are not above them.
        lambda t: op.violations(t.orders(), t.order_lines(), t.products(), t.clients().withColumn("fbp_fee_rate", F.col("fbp_fee_rate") * 5)),
        using(
            "clients products shop_orders order_lines",
            """SELECT 'order number twice' AS rule, count(*) AS rows FROM (SELECT 1 FROM shop_orders GROUP BY client_id, order_no HAVING count(*) > 1) UNION ALL
SELECT 'product twice', count(*) FROM (SELECT 1 FROM products GROUP BY client_id, jan HAVING count(*) > 1) UNION ALL SELECT 'unknown status', 0 UNION ALL
SELECT 'quantity not positive', count(*) FROM order_lines WHERE NOT qty > 0 UNION ALL SELECT 'negative price', count(*) FROM products WHERE wholesale_price < 0 OR retail_price < 0 UNION ALL
SELECT 'rate not above fee', count(*) FROM products JOIN clients c ON c.id = client_id WHERE wholesale_price > 0 AND retail_price > 0 AND wholesale_price / retail_price <= coalesce(fbp_fee_rate * 5, 8e-2)""",
        ),
    ),
}
