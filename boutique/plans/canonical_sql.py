"""The canonical shop tables stated in plain SQL over the driver's raw views.

This is the oracle's independent statement of ``boutique.sources.testdata``: the same
mapping, written as DuckDB common table expressions named ``c_<table>``. A query body
refers to ``c_orders``, ``c_order_items`` ... and :func:`with_canonical` prepends only
the definitions it needs.
"""

from __future__ import annotations

import re

_NR = "(SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"

CANONICAL: dict[str, str] = {
    "c_orders": """
SELECT printf('ORDER_%06d', o_orderkey) AS order_id,
       printf('CUST_%06d', o_custkey) AS customer_id,
       st AS order_status,
       o_orderdate AS order_purchase_timestamp,
       CASE WHEN st IN ('approved', 'shipped', 'delivered') THEN o_orderdate + INTERVAL 1 HOUR END AS order_approved_at,
       CASE WHEN st IN ('shipped', 'delivered') THEN o_orderdate + INTERVAL 2 DAY END AS order_delivered_carrier_date,
       CASE WHEN st = 'delivered' THEN o_orderdate + INTERVAL 5 DAY END AS order_delivered_customer_date
FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'delivered'
                     WHEN o_orderstatus = 'P' THEN 'cancelled'
                     WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'approved'
                     WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'shipped'
                     ELSE 'created' END AS st
      FROM orders)""",
    "c_order_items": """
SELECT printf('ORDER_%06d', l_orderkey) AS order_id,
       l_linenumber AS order_item_id,
       printf('PROD_%05d', l_partkey) AS product_id,
       printf('SELLER_%04d', l_suppkey) AS seller_id,
       date_trunc('day', l_shipdate) + INTERVAL 86399 SECOND AS shipping_limit_date,
       CAST(l_extendedprice AS DECIMAL(10,2)) AS price,
       CAST(l_tax * 100 AS DECIMAL(10,2)) AS freight_value,
       CAST(l_quantity AS INTEGER) AS quantity
FROM lineitem""",
    "c_products": """
SELECT printf('PROD_%05d', p_partkey) AS product_id,
       p_name AS product_name,
       p_type AS product_category,
       p_brand AS product_platform,
       (['3', '7', '12', '16', '18'])[p_size % 5 + 1] AS product_esrb_rating,
       CAST(2000 + p_size % 25 AS INTEGER) AS product_release_year,
       CAST(p_retailprice AS DECIMAL(10,2)) AS product_price,
       CAST(p_size * 100 AS INTEGER) AS product_weight_g,
       concat_ws(' ', p_name, p_brand) AS product_description,
       '../static/images/' || p_name || '.png' AS product_image,
       TIMESTAMP '2020-01-01 00:00:00' AS created_at
FROM part""",
    "c_customers": f"""
SELECT printf('CUST_%06d', c_custkey) AS customer_id,
       split_part(c_name, '#', 1) AS first_name,
       CASE WHEN strpos(c_name, '#') > 0 THEN split_part(c_name, '#', -1) ELSE c_name END AS last_name,
       lower(c_name) || '@example.com' AS email,
       CAST(CASE WHEN c_custkey = 0 THEN 1 ELSE 0 END AS TINYINT) AS is_admin,
       printf('0%d%08d', c_custkey % 9 + 1, c_custkey) AS phone,
       c_nationkey AS zip_code_prefix,
       nr.n_name AS city,
       nr.r_name AS state,
       printf('%d rue %s', c_custkey, nr.n_name) AS address_line1,
       CAST(NULL AS VARCHAR) AS address_line2,
       CAST(NULL AS VARCHAR) AS customer_segment,
       TIMESTAMP '2020-01-01 00:00:00' AS registration_date,
       CAST(NULL AS TIMESTAMP) AS last_purchase_date,
       0 AS total_orders,
       CAST(0 AS DECIMAL(18,2)) AS total_spent
FROM customer c LEFT JOIN {_NR} nr ON c.c_nationkey = nr.n_nationkey""",
    "c_geolocation": f"""
SELECT n_nationkey AS zip_code_prefix, n_name AS city, r_name AS state, r_name AS region,
       CAST(NULL AS DECIMAL(10,7)) AS latitude, CAST(NULL AS DECIMAL(10,7)) AS longitude
FROM {_NR}""",
    "c_sellers": f"""
SELECT printf('SELLER_%04d', s_suppkey) AS seller_id,
       s_name AS seller_name,
       CASE WHEN s_acctbal >= 5000 THEN 'Store' ELSE 'Standard' END AS seller_type,
       s_nationkey AS zip_code_prefix,
       nr.n_name AS city,
       nr.r_name AS state,
       TIMESTAMP '2020-01-01 00:00:00' AS created_at
FROM supplier s LEFT JOIN {_NR} nr ON s.s_nationkey = nr.n_nationkey""",
    "c_stock": """
SELECT printf('STOCK_%05d_%04d', l_partkey, l_suppkey) AS stock_id,
       printf('SELLER_%04d', l_suppkey) AS seller_id,
       printf('PROD_%05d', l_partkey) AS product_id,
       quantity_in_stock, quantity_reserved,
       quantity_in_stock - quantity_reserved AS quantity_available,
       12 AS min_stock_level, 19 AS reorder_point, last_updated,
       printf('A-%02d-%02d', l_suppkey % 100, l_partkey % 100) AS warehouse_location,
       'new' AS stock_condition
FROM (SELECT l_partkey, l_suppkey,
             CAST(sum(l_quantity) AS INTEGER) AS quantity_in_stock,
             CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0.0 END) AS INTEGER) AS quantity_reserved,
             max(l_shipdate) AS last_updated
      FROM lineitem GROUP BY l_partkey, l_suppkey)""",
    "c_order_reviews": """
SELECT printf('REVIEW_%06d', o.o_orderkey) AS review_id,
       printf('ORDER_%06d', o.o_orderkey) AS order_id,
       CAST(o.o_orderkey * 7 % 5 + 1 AS INTEGER) AS review_score,
       (['Très déçu', 'Décevant', 'Correct', 'Bon jeu', 'Excellent'])[CAST(o.o_orderkey * 7 % 5 + 1 AS INTEGER)] AS review_comment_title,
       d.text AS review_comment_message,
       o.o_orderdate + INTERVAL 7 DAY AS review_creation_date
FROM orders o
LEFT JOIN documents d ON d.doc_id = o.o_orderkey % (SELECT count(*) FROM documents)
WHERE o.o_orderstatus = 'F' AND o.o_orderkey % 2 = 0""",
    "c_order_payments": """
SELECT printf('ORDER_%06d', o_orderkey) AS order_id,
       1 AS payment_sequential,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'credit_card' WHEN '2' THEN 'paypal'
            WHEN '3' THEN 'debit_card' WHEN '4' THEN 'bank_transfer' ELSE 'credit_card' END AS payment_type,
       CAST(o_orderkey % 4 + 1 AS INTEGER) AS payment_installments,
       CAST(o_totalprice AS DECIMAL(10,2)) AS payment_value,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 1 HOUR END AS payment_approved_at
FROM orders""",
}


def carts_sql(qty_factor: int = 1) -> str:
    return f"""
SELECT user_id AS cart_id, printf('PROD_%05d', CAST(json_extract_string(props, '$.k') AS BIGINT)) AS product_id,
       CAST(sum((event_id % 3 + 1) * {int(qty_factor)}) AS INTEGER) AS qty
FROM events WHERE event_type = 'purchase'
GROUP BY 1, 2"""


def with_canonical(body: str, extra: dict[str, str] | None = None) -> str:
    """Prepend the ``c_*`` definitions (and ``extra`` CTEs) that ``body`` refers to."""
    defs = dict(CANONICAL)
    defs.update(extra or {})
    needed: list[str] = []

    def visit(text: str):
        for name in defs:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(defs[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({defs[n]}\n)" for n in needed)
    stripped = body.lstrip()
    if re.match(r"(?i)WITH RECURSIVE\s", stripped):
        return f"WITH RECURSIVE {ctes},\n{stripped[len('WITH RECURSIVE '):]}"
    if re.match(r"(?i)WITH\s", stripped):
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"


def sel(table: str, alias: str | None = None, exclude: tuple[str, ...] = ()) -> str:
    """Select list of a canonical table with money/decimal columns presented as DOUBLE."""
    from pyspark.sql.types import DecimalType

    from boutique.sources.schemas import TABLES

    pre = f"{alias}." if alias else ""
    out = []
    for f in TABLES[table.removeprefix("c_")].fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, DecimalType):
            out.append(f"CAST({pre}{f.name} AS DOUBLE) AS {f.name}")
        else:
            out.append(f"{pre}{f.name}")
    return ", ".join(out)
