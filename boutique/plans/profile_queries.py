"""Registered wide-profile query (Q10) and its oracle."""

from __future__ import annotations

from boutique.operators import profile as pf
from boutique.plans.canonical_sql import with_canonical as W
from boutique.plans.registry import register

_WIDE = """
wide AS (
SELECT o.order_purchase_timestamp, o.order_approved_at, o.order_delivered_carrier_date,
       o.order_delivered_customer_date,
       i.order_item_id, i.shipping_limit_date, i.price, i.freight_value, i.quantity,
       p.payment_sequential, p.payment_installments, p.payment_value, p.payment_approved_at,
       r.review_score, r.review_creation_date,
       c.is_admin, c.zip_code_prefix AS customer_zip_code_prefix, c.total_orders, c.total_spent,
       c.registration_date, c.last_purchase_date,
       pr.product_release_year, pr.product_price, pr.product_weight_g, pr.created_at AS product_created_at,
       s.zip_code_prefix AS seller_zip_code_prefix, s.created_at AS seller_created_at,
       st.quantity_in_stock, st.quantity_reserved, st.quantity_available, st.min_stock_level,
       st.reorder_point, st.last_updated
FROM c_orders o
LEFT JOIN c_order_items i ON i.order_id = o.order_id
LEFT JOIN c_order_payments p ON p.order_id = o.order_id
LEFT JOIN c_order_reviews r ON r.order_id = o.order_id
LEFT JOIN c_customers c ON c.customer_id = o.customer_id
LEFT JOIN c_products pr ON pr.product_id = i.product_id
LEFT JOIN c_sellers s ON s.seller_id = i.seller_id
LEFT JOIN c_stock st ON st.product_id = i.product_id AND st.seller_id = i.seller_id)"""


def _column_sql(name: str, kind: str) -> str:
    if kind == "datetime":
        x = f"(CAST(epoch_us({name}) AS DECIMAL(20,0)) * CAST(0.000001 AS DECIMAL(7,6)))"
        std = "CAST(NULL AS DOUBLE)"
    else:
        x = name
        std = (f"CASE WHEN count({x}) > 1 THEN round(sqrt(greatest((CAST(sum({x} * {x}) AS DOUBLE) - "
               f"CAST(sum({x}) AS DOUBLE) * CAST(sum({x}) AS DOUBLE) / count({x})) / (count({x}) - 1), 0)), 6) END")
    q = ", ".join(f"round(quantile_cont(CAST({x} AS DOUBLE), {p}), 6) AS p{int(p * 100)}" for p in pf.QUANTILES)
    return (f"SELECT '{name}' AS column_name, '{kind}' AS kind, count({x}) AS count, "
            f"round(CAST(sum({x}) AS DOUBLE) / count({x}), 6) AS mean, {std} AS std, "
            f"round(CAST(min({x}) AS DOUBLE), 6) AS min, {q}, round(CAST(max({x}) AS DOUBLE), 6) AS max FROM wide")


_PROFILE_SQL = W(
    f"WITH {_WIDE}\n"
    + "\nUNION ALL\n".join(
        [_column_sql(n, "numeric") for n in pf.NUMERIC] + [_column_sql(n, "datetime") for n in pf.DATETIME]
    )
)


@register("wide_profile", _PROFILE_SQL)
def q_wide_profile(t):
    """Q10: describe() of the 8-table join."""
    return pf.wide_profile(t)
