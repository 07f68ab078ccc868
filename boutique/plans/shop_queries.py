"""The shop's registered queries with their oracle SQL (whole tables, no row caps
except where a cap is the feature)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from boutique.operators import customers as cu
from boutique.operators import orders as od
from boutique.plans.canonical_sql import carts_sql, sel
from boutique.plans.canonical_sql import with_canonical as W
from boutique.plans.registry import register
from boutique.session import ensure_checkpoint_dir
from boutique.sources.carts import carts_from_map, normalise_carts
from boutique.sources.tables import Tables, with_defaults


def _nullable_as_double(df, *cols):
    """Integer columns that hold nulls are presented as double (one numeric type on every
    client, whether it maps a null integer to NaN or not)."""
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


# ---------------------------------------------------------------------------- orders
_TOTALS = """
SELECT order_id, sum(coalesce(price, 0) * coalesce(quantity, 1) + coalesce(freight_value, 0)) AS total_dec
FROM c_order_items GROUP BY order_id"""


@register("orders_with_totals", W(f"""
SELECT o.*, CAST(coalesce(t.total_dec, 0) AS DOUBLE) AS total_price, c.first_name, c.last_name, c.email
FROM c_orders o
LEFT JOIN ({_TOTALS}) t ON t.order_id = o.order_id
LEFT JOIN c_customers c ON c.customer_id = o.customer_id"""))
def q_orders_with_totals(t):
    """Q1: every order with total and buyer."""
    return od.orders_with_totals(t)


ORDERS_FILTER = dict(
    status="delivered", customer_name="00000(1|2)", min_total="100000",
    max_total="1500000", date_from="1995-01-01", date_to="1998-12-31",
)


@register("orders_filtered", W(f"""
SELECT o.*, CAST(coalesce(t.total_dec, 0) AS DOUBLE) AS total_price, c.first_name, c.last_name, c.email
FROM c_orders o
LEFT JOIN ({_TOTALS}) t ON t.order_id = o.order_id
LEFT JOIN c_customers c ON c.customer_id = o.customer_id
WHERE o.order_status = 'delivered'
  AND (coalesce(regexp_matches(c.first_name, '00000(1|2)', 'i'), false)
       OR coalesce(regexp_matches(c.last_name, '00000(1|2)', 'i'), false))
  AND CAST(coalesce(t.total_dec, 0) AS DOUBLE) >= 100000
  AND CAST(coalesce(t.total_dec, 0) AS DOUBLE) <= 1500000
  AND o.order_purchase_timestamp >= TIMESTAMP '1995-01-01'
  AND o.order_purchase_timestamp <= TIMESTAMP '1998-12-31'"""))
def q_orders_filtered(t):
    """Q2: filtered orders (status, buyer name pattern, total range, date range)."""
    return od.orders_filtered(t, **ORDERS_FILTER)


@register("customer_orders", W(f"""
SELECT o.*, CAST(coalesce(t.total_dec, 0) AS DOUBLE) AS total_price
FROM c_orders o LEFT JOIN ({_TOTALS}) t ON t.order_id = o.order_id"""))
def q_customer_orders(t):
    """Q3: orders with totals keyed by customer (bulk form of one customer's list)."""
    return od.customer_orders(t)


@register("order_lines", W(f"""
SELECT i.order_id, i.order_item_id, i.product_id, i.seller_id, i.shipping_limit_date,
       CAST(coalesce(i.price, 0) AS DOUBLE) AS price,
       CAST(coalesce(i.freight_value, 0) AS DOUBLE) AS freight_value,
       coalesce(i.quantity, 1) AS quantity,
       p.product_name, p.product_platform, p.product_image,
       CAST(coalesce(i.price, 0) * coalesce(i.quantity, 1) + coalesce(i.freight_value, 0) AS DOUBLE) AS line_total,
       CAST(t.total_dec AS DOUBLE) AS order_total
FROM c_order_items i
LEFT JOIN c_products p ON p.product_id = i.product_id
LEFT JOIN ({_TOTALS}) t ON t.order_id = i.order_id"""))
def q_order_lines(t):
    """Q4: order lines with product, line total and order total."""
    return od.order_lines(t)


@register("cancellable_orders", W("""
SELECT * FROM c_orders WHERE order_status IN ('created', 'approved')"""))
def q_cancellable_orders(t):
    """orders still cancellable."""
    return od.cancellable_orders(t)


# ------------------------------------------------------------------------- customers
def _segments_sql(t1, t2, t3):
    return W(f"""
WITH per_order AS (
  SELECT order_id, sum(coalesce(price, 0) * coalesce(quantity, 1) + coalesce(freight_value, 0)) AS value
  FROM c_order_items GROUP BY order_id),
stats AS (
  SELECT o.customer_id, count(*) AS total_orders, sum(p.value) AS spent,
         max(o.order_purchase_timestamp) AS last_purchase_date
  FROM c_orders o JOIN per_order p ON p.order_id = o.order_id
  WHERE o.order_status <> 'cancelled'
  GROUP BY o.customer_id)
SELECT c.customer_id,
       coalesce(s.total_orders, 0) AS total_orders,
       CAST(round(coalesce(s.spent, 0), 2) AS DOUBLE) AS total_spent,
       s.last_purchase_date,
       CASE WHEN coalesce(s.total_orders, 0) = 0 THEN 'nouveau'
            WHEN coalesce(s.spent, 0) < {t1} THEN 'casual'
            WHEN coalesce(s.spent, 0) < {t2} THEN 'regular'
            WHEN coalesce(s.spent, 0) < {t3} THEN 'premium'
            ELSE 'vip' END AS customer_segment
FROM c_customers c LEFT JOIN stats s ON s.customer_id = c.customer_id""")


@register("customer_segments", _segments_sql(200, 1000, 2000))
def q_customer_segments(t):
    """Q11: stats and segment of every customer with the shop's thresholds."""
    return cu.customer_segments(t)


SCALED_THRESHOLDS = (18e6, 39e6, 57e6)


@register("customer_segments_scaled", _segments_sql(18000000, 39000000, 57000000))
def q_customer_segments_scaled(t):
    """Q11 with thresholds scaled to the test data's prices (all five segments occur)."""
    return cu.customer_segments(t, thresholds=SCALED_THRESHOLDS)


@register("customers_search", W(f"""
SELECT {sel("customers")} FROM c_customers
WHERE (coalesce(regexp_matches(first_name, '0{{4}}1', 'i'), false)
       OR coalesce(regexp_matches(last_name, '0{{4}}1', 'i'), false))
  AND coalesce(regexp_matches(email, 'EXAMPLE\\.com', 'i'), false)
  AND coalesce(regexp_matches(city, 'nation_1', 'i'), false)"""))
def q_customers_search(t):
    """Q14: name, email and city search (case-insensitive patterns)."""
    return cu.customers_search(t, name="0{4}1", email=r"EXAMPLE\.com", city="nation_1")


# --------------------------------------------------------------------------- catalogue
from boutique.operators import catalog as ca  # noqa: E402
from boutique.operators import geo as ge  # noqa: E402
from boutique.operators import kpis as kp  # noqa: E402
from boutique.operators import reviews as rv  # noqa: E402
from boutique.operators import stock as sk  # noqa: E402

_RATINGS = """
SELECT i.product_id, round(avg(r.review_score), 1) AS avg_score, count(*) AS review_count
FROM c_order_items i JOIN c_order_reviews r ON r.order_id = i.order_id
GROUP BY i.product_id"""
_STOCK_BY_PRODUCT = """
SELECT product_id, CAST(sum(quantity_available) AS BIGINT) AS stock_available
FROM c_stock GROUP BY product_id"""


@register("product_ratings", W(_RATINGS))
def q_product_ratings(t):
    """A3 / Q9: line-weighted mean score and count per product."""
    return ca.product_ratings(t)


@register("product_scores", W("""
WITH pairs AS (SELECT DISTINCT order_id, product_id FROM c_order_items),
agg AS (SELECT p.product_id, round(avg(r.review_score), 1) AS avg_score, count(*) AS n
        FROM pairs p JOIN c_order_reviews r ON r.order_id = p.order_id GROUP BY p.product_id)
SELECT p.product_id, a.avg_score, coalesce(a.n, 0) AS review_count
FROM c_products p LEFT JOIN agg a ON a.product_id = p.product_id"""))
def q_product_scores(t):
    """A4 / Q9: review-weighted mean score and count of every product."""
    return ca.product_scores(t)


@register("stock_by_product", W(_STOCK_BY_PRODUCT))
def q_stock_by_product(t):
    """A2: available stock per product."""
    return ca.stock_by_product(t.stock)


@register("product_facets", W("""
SELECT DISTINCT * FROM (
  SELECT 'category' AS facet, product_category AS value FROM c_products
  UNION ALL SELECT 'platform' AS facet, product_platform AS value FROM c_products)
WHERE value IS NOT NULL"""))
def q_product_facets(t):
    """Distinct categories and platforms."""
    return ca.product_facets(t)


CATALOG_FILTER = dict(name="(?:ring|bolt)$", category="eco|small", min_price="905", max_price="990.5")


@register("catalog", W(f"""
SELECT {sel("products", "p")},
       coalesce(s.stock_available, 0) AS stock_available,
       r.avg_score, coalesce(r.review_count, 0) AS review_count,
       CAST(floor(r.avg_score) AS DOUBLE) AS star_bucket,
       CASE WHEN coalesce(s.stock_available, 0) > 0 THEN 'En stock' ELSE 'Rupture de stock' END AS availability
FROM c_products p
LEFT JOIN ({_STOCK_BY_PRODUCT}) s ON s.product_id = p.product_id
LEFT JOIN ({_RATINGS}) r ON r.product_id = p.product_id
WHERE coalesce(regexp_matches(p.product_name, '(?:ring|bolt)$', 'i'), false)
  AND coalesce(regexp_matches(p.product_category, 'eco|small', 'i'), false)
  AND p.product_price >= 905 AND p.product_price <= 990.5"""))
def q_catalog(t):
    """Q5: filtered store catalogue with stock and ratings."""
    return _nullable_as_double(ca.catalog(t, **CATALOG_FILTER), "star_bucket")


@register("catalog_all", W(f"""
SELECT {sel("products", "p")},
       coalesce(s.stock_available, 0) AS stock_available,
       r.avg_score, coalesce(r.review_count, 0) AS review_count,
       CAST(floor(r.avg_score) AS DOUBLE) AS star_bucket,
       CASE WHEN coalesce(s.stock_available, 0) > 0 THEN 'En stock' ELSE 'Rupture de stock' END AS availability
FROM c_products p
LEFT JOIN ({_STOCK_BY_PRODUCT}) s ON s.product_id = p.product_id
LEFT JOIN ({_RATINGS}) r ON r.product_id = p.product_id"""))
def q_catalog_all(t):
    """Q5 without filters: the whole catalogue."""
    return _nullable_as_double(ca.catalog(t), "star_bucket")


@register("products_by_platform", W(f"""
SELECT {sel("products")} FROM c_products WHERE product_platform = 'Brand#7' AND product_esrb_rating = '12'"""))
def q_products_by_platform(t):
    """platform and rating filters."""
    return ca.filter_products(t.products, platform="Brand#7", esrb="12")


# ------------------------------------------------------------------------------- stock
_STOCK_VIEW = """
SELECT s.*, p.product_name, p.product_platform, CAST(p.product_price AS DOUBLE) AS product_price
FROM c_stock s LEFT JOIN c_products p ON p.product_id = s.product_id"""


@register("stock_view", W(_STOCK_VIEW))
def q_stock_view(t):
    """Q6: stock with product info, by product name and seller."""
    return sk.stock_view(t)


@register("critical_stock", W(f"SELECT * FROM ({_STOCK_VIEW}) WHERE quantity_available <= min_stock_level"))
def q_critical_stock(t):
    """critical stock rows."""
    return sk.critical_stock(t)


CART_FACTOR = 80


@register("cart_pricing", W(f"""
WITH carts AS ({carts_sql(CART_FACTOR)}),
lines AS (SELECT c.cart_id, c.product_id, p.product_name, p.product_price, c.qty,
                 p.product_price * c.qty AS line_total
          FROM carts c JOIN c_products p ON p.product_id = c.product_id WHERE c.qty > 0)
SELECT cart_id, product_id, product_name, CAST(product_price AS DOUBLE) AS product_price,
       qty AS quantity, CAST(line_total AS DOUBLE) AS line_total,
       CAST(sum(line_total) OVER (PARTITION BY cart_id) AS DOUBLE) AS cart_total
FROM lines"""))
def q_cart_pricing(t):
    """Q13: priced purchase carts with totals."""
    return sk.cart_pricing(t, t.carts(CART_FACTOR))


@register("cart_admission", W(f"""
WITH carts AS ({carts_sql(CART_FACTOR)}),
lines AS (SELECT c.cart_id, c.product_id, c.qty AS requested, coalesce(s.stock_available, 0) AS available,
                 c.qty <= coalesce(s.stock_available, 0) AS line_ok
          FROM carts c LEFT JOIN ({_STOCK_BY_PRODUCT}) s ON s.product_id = c.product_id WHERE c.qty > 0)
SELECT *, bool_and(line_ok) OVER (PARTITION BY cart_id) AS cart_ok FROM lines"""))
def q_cart_admission(t):
    """Cart lines against summed availability; all-or-nothing per cart."""
    return sk.cart_admission(t, t.carts(CART_FACTOR))


def _requests(t):
    """Requests derived from the carts: every cart asks again for its products, some for none."""
    return t.carts(CART_FACTOR).select("cart_id", "product_id", (F.col("qty") * (F.col("cart_id") % 3)).alias("qty"))


@register("cart_additions", W(f"""
WITH carts AS ({carts_sql(CART_FACTOR)}),
j AS (SELECT c.cart_id, c.product_id, c.qty AS in_cart, CAST(greatest(c.qty * (c.cart_id % 3), 1) AS BIGINT) AS requested,
             coalesce(s.stock_available, 0) AS available
      FROM carts c LEFT JOIN ({_STOCK_BY_PRODUCT}) s ON s.product_id = c.product_id)
SELECT *, in_cart + requested <= available AS granted,
       CASE WHEN in_cart + requested <= available THEN in_cart + requested ELSE in_cart END AS quantity FROM j"""))
def q_cart_additions(t):
    """Requests on top of what the carts already hold."""
    return sk.cart_additions(t, t.carts(CART_FACTOR), _requests(t))


@register("map_carts", W(f"SELECT cart_id, product_id, qty FROM ({carts_sql(CART_FACTOR)}) WHERE qty > 0"))
def q_map_carts(t):
    """SRC2: carts given as a map of product to quantity, as rows."""
    maps = t.carts(CART_FACTOR).groupBy("cart_id").agg(
        F.map_from_entries(F.collect_list(F.struct("product_id", "qty"))).alias("items"))
    return normalise_carts(carts_from_map(maps))


@register("product_by_id", W(f"""
SELECT {sel("products")} FROM c_products WHERE product_id = (SELECT max(product_id) FROM c_order_items)"""))
def q_product_by_id(t):
    """the product of the largest id on any order line."""
    wanted = t.order_items.agg(F.max("product_id")).scalar()
    return ca.filter_products(t.products, product_id=wanted)


def stored_folder(t):
    """Where registered queries write tables that they read back."""
    return ensure_checkpoint_dir(t.spark).rstrip("/")


@register("stored_orders", W("SELECT * FROM c_orders"))
def q_stored_orders(t):
    """SNK2: orders written as a table version and read back with their declared schema."""
    root = f"{stored_folder(t)}/version-{uuid.uuid4().hex}"
    t.write(root, names=("orders",))
    return Tables.from_parquet(t.spark, root).orders


@register("stock_defaults", W("""
SELECT stock_id, seller_id, product_id, CAST(NULL AS VARCHAR) AS warehouse_location,
       CASE WHEN quantity_reserved > 0 THEN quantity_in_stock ELSE 0 END AS quantity_in_stock,
       0 AS quantity_reserved, 0 AS quantity_available, 12 AS min_stock_level, 19 AS reorder_point,
       TIMESTAMP '2024-06-01 12:00:00' AS last_updated, 'new' AS stock_condition
FROM c_stock"""))
def q_stock_defaults(t):
    """Inserted stock rows that leave most columns to their defaults."""
    given = t.stock.select("stock_id", "seller_id", "product_id", F.lit(None).cast("string").alias("warehouse_location"),
                           F.when(F.col("quantity_reserved") > 0, F.col("quantity_in_stock")).alias("quantity_in_stock"))
    return with_defaults(given, "stock", dt.datetime(2024, 6, 1, 12, 0, 0))


# --------------------------------------------------------------------------------- geo
@register("distinct_cities", W("SELECT DISTINCT city FROM c_geolocation WHERE city IS NOT NULL"))
def q_distinct_cities(t):
    """D1."""
    return ge.distinct_cities(t)


@register("distinct_states", W("SELECT DISTINCT state FROM c_geolocation WHERE state IS NOT NULL"))
def q_distinct_states(t):
    """D2."""
    return ge.distinct_states(t)


@register("distinct_zips", W(
    "SELECT DISTINCT CAST(zip_code_prefix AS VARCHAR) AS zip_code_prefix FROM c_geolocation WHERE zip_code_prefix IS NOT NULL"))
def q_distinct_zips(t):
    """D3: zip codes as strings."""
    return ge.distinct_zips(t)


@register("city_autocomplete", W("""
SELECT city FROM (SELECT DISTINCT city FROM c_geolocation WHERE city IS NOT NULL)
WHERE contains(lower(city), 'tion_1') ORDER BY city LIMIT 50"""))
def q_city_autocomplete(t):
    """D6 + T5: city autocomplete (literal, case-insensitive), first 50 sorted."""
    return ge.autocomplete(t, "city", "TION_1")


@register("zip_autocomplete", W("""
SELECT zip_code_prefix FROM (SELECT DISTINCT CAST(zip_code_prefix AS VARCHAR) AS zip_code_prefix FROM c_geolocation)
WHERE contains(zip_code_prefix, '1') ORDER BY zip_code_prefix LIMIT 50"""))
def q_zip_autocomplete(t):
    """D6 + T5: zip autocomplete (literal substring), first 50 sorted as strings."""
    return ge.autocomplete(t, "zip_code_prefix", "1")


@register("geo_search", W("""
SELECT * FROM (SELECT DISTINCT CAST(zip_code_prefix AS VARCHAR) AS zip_code_prefix, city, state
               FROM c_geolocation
               WHERE coalesce(regexp_matches(CAST(zip_code_prefix AS VARCHAR), '2', 'i'), false)
                  OR coalesce(regexp_matches(city, '2', 'i'), false)
                  OR coalesce(regexp_matches(state, '2', 'i'), false))
ORDER BY zip_code_prefix, city, state LIMIT 50"""))
def q_geo_search(t):
    """Geolocation search over zip, city and state, first 50."""
    return ge.geo_search(t, "2")


@register("geo_enrich", W("""
WITH by_zip AS (SELECT zip_code_prefix AS ez, min((city, state)) AS v FROM c_geolocation GROUP BY 1),
by_city AS (SELECT lower(city) AS ec, min((zip_code_prefix, state)) AS v FROM c_geolocation
            WHERE city IS NOT NULL GROUP BY 1)
SELECT c.customer_id, c.zip_code_prefix, c.city, c.state,
       z.v[1] AS city_from_zip, z.v[2] AS state_from_zip,
       y.v[1] AS zip_from_city, y.v[2] AS state_from_city
FROM c_customers c
LEFT JOIN by_zip z ON z.ez = c.zip_code_prefix
LEFT JOIN by_city y ON y.ec = lower(trim(c.city))"""))
def q_geo_enrich(t):
    """Fill city/state from zip and zip/state from city for every customer."""
    rows = t.customers.select("customer_id", "zip_code_prefix", "city", "state")
    return ge.geo_enrich(rows, t.geolocation)


# ----------------------------------------------------------------------------- reviews
_AUTHORS = """
SELECT o.order_id, o.customer_id, c.first_name, c.last_name
FROM c_orders o LEFT JOIN c_customers c ON c.customer_id = o.customer_id"""


@register("product_reviews", W(f"""
WITH pairs AS (SELECT DISTINCT order_id, product_id FROM c_order_items)
SELECT p.product_id, r.*, a.customer_id, a.first_name, a.last_name
FROM pairs p JOIN c_order_reviews r ON r.order_id = p.order_id
LEFT JOIN ({_AUTHORS}) a ON a.order_id = r.order_id"""))
def q_product_reviews(t):
    """Q7: reviews per product with author."""
    return rv.product_reviews(t)


_FIRST_PRODUCT = """
SELECT order_id, product_id FROM (
  SELECT order_id, product_id,
         row_number() OVER (PARTITION BY order_id ORDER BY order_item_id, product_id) AS rn
  FROM c_order_items) WHERE rn = 1"""


@register("first_product_per_order", W(_FIRST_PRODUCT))
def q_first_product_per_order(t):
    """First product of every order."""
    return rv.first_product_per_order(t.order_items)


@register("recent_reviews", W(f"""
WITH top AS (SELECT * FROM c_order_reviews ORDER BY review_creation_date DESC, review_id DESC LIMIT 6)
SELECT t.*, a.customer_id, a.first_name, a.last_name, f.product_id, p.product_name, p.product_image,
       CASE WHEN length(t.review_comment_message) > 120
            THEN substring(t.review_comment_message, 1, 120) || '…'
            ELSE t.review_comment_message END AS message_preview
FROM top t
LEFT JOIN ({_AUTHORS}) a ON a.order_id = t.order_id
LEFT JOIN ({_FIRST_PRODUCT}) f ON f.order_id = t.order_id
LEFT JOIN c_products p ON p.product_id = f.product_id"""))
def q_recent_reviews(t):
    """Q8: six newest reviews with author, first product and message preview."""
    return rv.recent_reviews(t)


@register("order_review", W("""
SELECT o.order_id, o.customer_id, o.order_status, r.review_id, CAST(r.review_score AS DOUBLE) AS review_score, r.review_comment_title,
       r.review_comment_message, r.review_creation_date
FROM c_orders o LEFT JOIN c_order_reviews r ON r.order_id = o.order_id"""))
def q_order_review(t):
    """each order with its review, if any."""
    return _nullable_as_double(rv.order_review(t), "review_score")


# -------------------------------------------------------------------------------- kpis
@register("kpis", W("""
SELECT (SELECT count(*) FROM c_products) AS nb_products,
       (SELECT count(*) FROM c_customers) AS nb_customers,
       (SELECT count(*) FROM c_orders) AS nb_orders,
       (SELECT count(*) FROM c_stock WHERE quantity_available <= min_stock_level) AS nb_critical"""))
def q_kpis(t):
    """Q12: admin dashboard counts."""
    return kp.kpis(t)


def _revenue_sql(grain):
    return W(f"""
WITH per_order AS (
  SELECT order_id, sum(coalesce(price, 0) * coalesce(quantity, 1) + coalesce(freight_value, 0)) AS value
  FROM c_order_items GROUP BY order_id),
live AS (SELECT o.order_id, o.customer_id, date_trunc('{grain}', o.order_purchase_timestamp) AS period, p.value
         FROM c_orders o LEFT JOIN per_order p ON p.order_id = o.order_id
         WHERE o.order_status <> 'cancelled')
SELECT period, CAST(sum(coalesce(value, 0)) AS DOUBLE) AS revenue, count(*) AS orders,
       count(DISTINCT customer_id) AS active_customers
FROM live GROUP BY period""")


@register("revenue_daily", _revenue_sql("day"))
def q_revenue_daily(t):
    """Q15: revenue, orders and active customers per day."""
    return kp.revenue(t, "day")


@register("revenue_monthly", _revenue_sql("month"))
def q_revenue_monthly(t):
    """Q15: revenue, orders and active customers per month."""
    return kp.revenue(t, "month")


@register("customers_display", W("""
SELECT customer_id, first_name, last_name, email, phone, city,
       coalesce(customer_segment, 'nouveau') AS segment_label,
       CASE WHEN is_admin = 1 THEN 'Oui' ELSE 'Non' END AS admin_label,
       total_orders, CAST(total_spent AS DOUBLE) AS total_spent
FROM c_customers"""))
def q_customers_display(t):
    """Customer list with segment and admin labels."""
    return cu.customers_display(t)


@register("state_autocomplete", W("""
SELECT state FROM (SELECT DISTINCT state FROM c_geolocation WHERE state IS NOT NULL)
WHERE contains(lower(state), 'am') ORDER BY state LIMIT 50"""))
def q_state_autocomplete(t):
    """D6 + T5: state autocomplete (literal, case-insensitive), first 50 sorted."""
    return ge.autocomplete(t, "state", "AM")
