"""Registered allocation and order-placement queries (carts come from purchase events)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from boutique.operators import allocation as al
from boutique.plans.canonical_sql import carts_sql
from boutique.plans.canonical_sql import with_canonical as W
from boutique.plans.registry import register
from boutique.sources.carts import normalise_carts

# Quantity factor of the test carts: with 10 the batch rule admits some carts and
# rejects others at every scale factor, so both branches are exercised.
ALLOC_FACTOR = 10
AS_OF = dt.datetime(2024, 6, 1, 12, 0, 0)


def _cart_customers(t, carts):
    return carts.select("cart_id").distinct().select(
        "cart_id", F.format_string("CUST_%06d", F.col("cart_id")).alias("customer_id")
    )


# Admission as the shop runs it: cart after cart, each against what the admitted ones left.
_LINES = f"""
carts AS ({carts_sql(ALLOC_FACTOR)}),
lines AS (SELECT * FROM carts WHERE qty > 0),
supply_tot AS (SELECT product_id, sum(quantity_available) AS supply FROM c_stock GROUP BY 1),
in_order AS (
  SELECT cart_id, row_number() OVER (ORDER BY cart_id) AS k,
         list({{'p': l.product_id, 'q': l.qty::BIGINT, 's': coalesce(s.supply, 0)::BIGINT}}) AS items
  FROM lines l LEFT JOIN supply_tot s ON s.product_id = l.product_id GROUP BY cart_id),
serial(k, cart_id, admitted, taken) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::BOOLEAN, []::STRUCT(p VARCHAR, q BIGINT, s BIGINT)[]
  UNION ALL
  SELECT k, cart_id, ok, CASE WHEN ok THEN list_concat(taken, items) ELSE taken END
  FROM (SELECT o.k, o.cart_id, o.items, r.taken,
          len(list_filter(o.items, lambda i: i.q + coalesce(list_sum(list_transform(
            list_filter(r.taken, lambda t: t.p = i.p), lambda t: t.q)), 0) > i.s)) = 0 AS ok
        FROM serial r JOIN in_order o ON o.k = r.k + 1)),
verdict AS (SELECT cart_id, admitted FROM serial WHERE k > 0),
dem AS (
  SELECT l.*, sum(l.qty) OVER (PARTITION BY l.product_id ORDER BY l.cart_id) - l.qty AS d0
  FROM lines l JOIN verdict v ON v.cart_id = l.cart_id
  WHERE v.admitted AND l.product_id IN (SELECT product_id FROM c_products)),
sup AS (
  SELECT stock_id, seller_id, product_id, quantity_available,
         sum(quantity_available) OVER (PARTITION BY product_id ORDER BY quantity_available DESC, stock_id
                                       ROWS UNBOUNDED PRECEDING) - quantity_available AS s0,
         row_number() OVER (PARTITION BY product_id ORDER BY quantity_available DESC, stock_id) AS s_rank
  FROM c_stock WHERE quantity_available > 0),
alloc AS (
  SELECT d.cart_id, d.product_id, s.stock_id, s.seller_id, s.s_rank,
         CAST(least(d.d0 + d.qty, s.s0 + s.quantity_available) - greatest(d.d0, s.s0) AS INTEGER) AS take
  FROM dem d JOIN sup s
    ON s.product_id = d.product_id AND s.s0 < d.d0 + d.qty AND d.d0 < s.s0 + s.quantity_available)"""


@register("cart_verdicts", W(f"WITH RECURSIVE {_LINES}\nSELECT * FROM verdict"))
def q_cart_verdicts(t):
    """Batch admission of the purchase carts (all-or-nothing, cart order)."""
    return al.admit_carts(normalise_carts(t.carts(ALLOC_FACTOR)), t.stock)


@register("batch_allocation", W(f"WITH RECURSIVE {_LINES}\nSELECT * FROM alloc"))
def q_batch_allocation(t):
    """Admitted cart lines split over stock rows (interval overlap)."""
    lines = normalise_carts(t.carts(ALLOC_FACTOR))
    verdict = al.admit_carts(lines, t.stock)
    ok = lines.join(verdict.filter("admitted"), "cart_id", "left_semi").join(
        t.products.select("product_id"), "product_id", "left_semi")
    return al.allocate(ok, t.stock)


@register("single_cart_allocation", W(f"""
WITH carts AS ({carts_sql(ALLOC_FACTOR)}),
sup AS (
  SELECT stock_id, seller_id, product_id, quantity_available,
         sum(quantity_available) OVER (PARTITION BY product_id ORDER BY quantity_available DESC, stock_id
                                       ROWS UNBOUNDED PRECEDING) - quantity_available AS s0,
         row_number() OVER (PARTITION BY product_id ORDER BY quantity_available DESC, stock_id) AS s_rank
  FROM c_stock WHERE quantity_available > 0)
SELECT c.cart_id, c.product_id, c.qty, s.stock_id, s.seller_id, s.s_rank,
       CAST(least(s.quantity_available, c.qty - s.s0) AS INTEGER) AS take
FROM carts c JOIN sup s ON s.product_id = c.product_id AND s.s0 < c.qty
WHERE c.qty > 0"""))
def q_single_cart_allocation(t):
    """Every cart line served alone from the current stock (greedy, largest first)."""
    return al.snapshot_allocation(normalise_carts(t.carts(ALLOC_FACTOR)), t.stock)


def _placement(t):
    carts = t.carts(ALLOC_FACTOR)
    return al.place_orders(t, carts, _cart_customers(t, carts), AS_OF)


_MAX_ORDER = "(SELECT coalesce(max(CAST(NULLIF(regexp_extract(order_id, 'ORDER_(\\d+)', 1), '') AS BIGINT)), 0) FROM c_orders)"
_PLACED = f"""
placed AS (
  SELECT cart_id, printf('ORDER_%06d', {_MAX_ORDER} + row_number() OVER (ORDER BY cart_id)) AS order_id
  FROM verdict WHERE admitted)"""


@register("order_placement", W(f"""
WITH RECURSIVE {_LINES},{_PLACED}
SELECT p.order_id,
       CAST(row_number() OVER (PARTITION BY a.cart_id
             ORDER BY CAST(NULLIF(regexp_extract(a.product_id, 'PROD_(\\d+)', 1), '') AS BIGINT), a.product_id, a.s_rank) AS INTEGER) AS order_item_id,
       a.product_id, a.seller_id,
       TIMESTAMP '2024-06-01 23:59:59' AS shipping_limit_date,
       CAST(pr.product_price AS DOUBLE) AS price, CAST(4.99 AS DOUBLE) AS freight_value,
       a.take AS quantity
FROM alloc a JOIN placed p ON p.cart_id = a.cart_id
LEFT JOIN c_products pr ON pr.product_id = a.product_id"""))
def q_order_placement(t):
    """U8: new order lines placed from the admitted carts."""
    return _placement(t)["new_items"]


@register("placed_orders", W(f"""
WITH RECURSIVE {_LINES},{_PLACED}
SELECT p.order_id, printf('CUST_%06d', p.cart_id) AS customer_id, 'created' AS order_status,
       TIMESTAMP '2024-06-01 12:00:00' AS order_purchase_timestamp,
       CAST(NULL AS TIMESTAMP) AS order_approved_at, CAST(NULL AS TIMESTAMP) AS order_delivered_carrier_date,
       CAST(NULL AS TIMESTAMP) AS order_delivered_customer_date
FROM placed p"""))
def q_placed_orders(t):
    """U8: the new orders (one per admitted cart)."""
    return _placement(t)["new_orders"]


@register("stock_after_placement", W(f"""
WITH RECURSIVE {_LINES},
taken AS (SELECT stock_id, CAST(sum(take) AS INTEGER) AS tk FROM alloc GROUP BY stock_id)
SELECT s.stock_id, s.seller_id, s.product_id, s.quantity_in_stock, s.quantity_reserved,
       s.quantity_available - coalesce(k.tk, 0) AS quantity_available,
       s.min_stock_level, s.reorder_point,
       CASE WHEN k.tk IS NOT NULL THEN TIMESTAMP '2024-06-01 12:00:00' ELSE s.last_updated END AS last_updated,
       s.warehouse_location, s.stock_condition
FROM c_stock s LEFT JOIN taken k ON k.stock_id = s.stock_id"""))
def q_stock_after_placement(t):
    """U8: stock after the placed orders took their quantities."""
    return _placement(t)["stock"]


@register("placement_customer_stats", W(f"""
WITH RECURSIVE {_LINES},{_PLACED},
new_items AS (
  SELECT p.order_id, CAST(pr.product_price AS DECIMAL(10,2)) AS price, a.take AS quantity,
         CAST(4.99 AS DECIMAL(10,2)) AS freight_value
  FROM alloc a JOIN placed p ON p.cart_id = a.cart_id LEFT JOIN c_products pr ON pr.product_id = a.product_id),
all_orders AS (
  SELECT order_id, customer_id, order_status, order_purchase_timestamp FROM c_orders
  UNION ALL SELECT order_id, printf('CUST_%06d', cart_id), 'created', TIMESTAMP '2024-06-01 12:00:00' FROM placed),
all_items AS (
  SELECT order_id, price, quantity, freight_value FROM c_order_items
  UNION ALL SELECT order_id, price, quantity, freight_value FROM new_items),
touched AS (SELECT DISTINCT printf('CUST_%06d', cart_id) AS customer_id FROM placed),
per_order AS (SELECT order_id, sum(coalesce(price, 0) * coalesce(quantity, 1) + coalesce(freight_value, 0)) AS value
              FROM all_items GROUP BY order_id),
stats AS (SELECT o.customer_id, count(*) AS n, sum(p.value) AS spent, max(o.order_purchase_timestamp) AS lp
          FROM all_orders o JOIN per_order p ON p.order_id = o.order_id
          WHERE o.order_status <> 'cancelled' GROUP BY o.customer_id)
SELECT c.customer_id,
       CASE WHEN t.customer_id IS NOT NULL THEN CAST(coalesce(s.n, 0) AS INTEGER) ELSE c.total_orders END AS total_orders,
       CASE WHEN t.customer_id IS NOT NULL THEN CAST(round(coalesce(s.spent, 0), 2) AS DOUBLE) ELSE CAST(c.total_spent AS DOUBLE) END AS total_spent,
       CASE WHEN t.customer_id IS NOT NULL THEN s.lp ELSE c.last_purchase_date END AS last_purchase_date,
       CASE WHEN t.customer_id IS NOT NULL THEN
            CASE WHEN coalesce(s.n, 0) = 0 THEN 'nouveau' WHEN coalesce(s.spent, 0) < 200 THEN 'casual'
                 WHEN coalesce(s.spent, 0) < 1000 THEN 'regular' WHEN coalesce(s.spent, 0) < 2000 THEN 'premium'
                 ELSE 'vip' END
            ELSE c.customer_segment END AS customer_segment
FROM c_customers c LEFT JOIN touched t ON t.customer_id = c.customer_id
LEFT JOIN stats s ON s.customer_id = c.customer_id"""))
def q_placement_customer_stats(t):
    """U8 then U7 (checkout): buyers' statistics after their orders were placed."""
    c = _placement(t)["customers"]
    return c.select("customer_id", "total_orders", "total_spent", "last_purchase_date", "customer_segment")
