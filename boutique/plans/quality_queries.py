"""Registered data-quality queries (V*) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutique.operators import quality as qa
from boutique.plans import allocation_queries as aq
from boutique.plans.canonical_sql import with_canonical as W
from boutique.plans.registry import register

AS_OF_YEAR = 2024


def _joined(df, key):
    """Registered form of a checked table: key, the broken rules as one string, validity."""
    return df.select(
        key, F.array_join("errors", "; ").alias("errors"), (F.size("errors") == 0).alias("is_valid")
    )


def _geo_sql(alias):
    return f"""
  (NOT EXISTS (SELECT 1 FROM c_geolocation) OR {alias}.zip_code_prefix IS NULL
     OR trim(CAST({alias}.zip_code_prefix AS VARCHAR)) = ''
     OR TRY_CAST(trim(CAST({alias}.zip_code_prefix AS VARCHAR)) AS INTEGER) IN (SELECT zip_code_prefix FROM c_geolocation)) AS zip_ok,
  (NOT EXISTS (SELECT 1 FROM c_geolocation) OR {alias}.city IS NULL OR trim({alias}.city) = ''
     OR lower(trim({alias}.city)) IN (SELECT lower(city) FROM c_geolocation WHERE city IS NOT NULL)) AS city_ok,
  (NOT EXISTS (SELECT 1 FROM c_geolocation) OR {alias}.state IS NULL OR trim({alias}.state) = ''
     OR lower(trim({alias}.state)) IN (SELECT lower(state) FROM c_geolocation WHERE state IS NOT NULL)) AS state_ok"""


_EMAIL_OK = ("coalesce(contains(trim(email), '@') AND contains(string_split(trim(email), '@')[-1], '.') "
             "AND length(trim(email)) <= 254, false)")
_PHONE_OK = ("(phone IS NULL OR trim(phone) = '' OR coalesce(regexp_full_match("
             "regexp_replace(trim(phone), '[\\s.\\-]', '', 'g'), '0[1-9][0-9]{8}'), false))")
_ZIP_OK = "coalesce(regexp_full_match(trim(CAST(zip_code_prefix AS VARCHAR)), '[0-9]{5}'), false)"


def _nonempty(c):
    return f"coalesce(length(trim(CAST({c} AS VARCHAR))) > 0, false)"


@register("dq_customers", W(f"""
WITH chk AS (
  SELECT c.*, {_geo_sql('c')},
         count(*) OVER (PARTITION BY email) = 1 OR email IS NULL AS email_once
  FROM c_customers c),
err AS (
  SELECT customer_id, concat_ws('; ',
    CASE WHEN NOT {_nonempty('first_name')} THEN 'first_name: must not be empty' END,
    CASE WHEN NOT {_nonempty('last_name')} THEN 'last_name: must not be empty' END,
    CASE WHEN NOT {_EMAIL_OK} THEN 'email: invalid' END,
    CASE WHEN NOT {_PHONE_OK} THEN 'phone: 10 digits starting with 0' END,
    CASE WHEN NOT {_ZIP_OK} THEN 'zip_code_prefix: exactly 5 digits' END,
    CASE WHEN NOT zip_ok THEN 'zip_code_prefix: unknown' END,
    CASE WHEN NOT city_ok THEN 'city: unknown' END,
    CASE WHEN NOT state_ok THEN 'state: unknown' END,
    CASE WHEN NOT email_once THEN 'email: duplicated' END) AS errors
  FROM chk)
SELECT customer_id, errors, errors = '' AS is_valid FROM err"""))
def q_dq_customers(t):
    """V1, V5-V9 over the stored customers."""
    return _joined(qa.customer_table_check(t.customers, t.geolocation), "customer_id")


def _year_ok(c, y):
    return f"coalesce(TRY_CAST(trim(CAST({c} AS VARCHAR)) AS INTEGER) BETWEEN 1970 AND {y + 2}, false)"


def _pos_ok(c):
    return f"coalesce(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) > 0, false)"


@register("dq_products", W(f"""
WITH err AS (
  SELECT product_id, concat_ws('; ',
    CASE WHEN NOT {_nonempty('product_name')} THEN 'product_name: must not be empty' END,
    CASE WHEN NOT {_nonempty('product_category')} THEN 'product_category: must not be empty' END,
    CASE WHEN NOT {_nonempty('product_platform')} THEN 'product_platform: must not be empty' END,
    CASE WHEN NOT {_nonempty('product_esrb_rating')} THEN 'product_esrb_rating: must not be empty' END,
    CASE WHEN NOT {_year_ok('product_release_year', AS_OF_YEAR)} THEN 'product_release_year: out of range' END,
    CASE WHEN NOT {_pos_ok('product_price')} THEN 'product_price: must be > 0' END,
    CASE WHEN NOT {_pos_ok('product_weight_g')} THEN 'product_weight_g: must be > 0' END) AS errors
  FROM c_products)
SELECT product_id, errors, errors = '' AS is_valid FROM err"""))
def q_dq_products(t):
    """V1, V2, V4 over the stored products."""
    return _joined(qa.check(t.products, qa.product_rules(AS_OF_YEAR)), "product_id")


def _tables(t):
    # Keys only: the reviews' texts aren't read.
    return {n: t.review_facts if n == "order_reviews" else t.table(n) for n in ("customers", "geolocation", "orders", "order_items", "order_payments",
                                    "order_reviews", "products", "sellers", "stock")}


def _keys_sql():
    from boutique.sources import schemas as S

    parts = []
    for name in ("customers", "geolocation", "orders", "order_items", "order_payments", "order_reviews",
                 "products", "sellers", "stock"):
        sets = [("primary", S.PRIMARY_KEYS[name])] + [("unique", k) for k in S.UNIQUE_KEYS.get(name, ())]
        for kind, cols in sets:
            kv = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '∅')" for c in cols) + ")"
            parts.append(
                f"SELECT '{name}' AS table_name, '{kind}' AS key_kind, '{','.join(cols)}' AS key_columns, "
                f"{kv} AS key_value, count(*) AS n FROM c_{name} GROUP BY {', '.join(cols)} HAVING count(*) > 1")
    return "\nUNION ALL\n".join(parts)


@register("dq_keys", W(_keys_sql()))
def q_dq_keys(t):
    """Duplicated primary / unique keys in all nine tables."""
    return qa.key_report(_tables(t))


def _fk_sql():
    from boutique.sources import schemas as S

    parts = []
    for child, ccols, parent, pcols in S.FOREIGN_KEYS:
        kv = "concat_ws('|', " + ", ".join(f"coalesce(CAST(c.{c} AS VARCHAR), '∅')" for c in ccols) + ")"
        on = " AND ".join(f"p.{b} = c.{a}" for a, b in zip(ccols, pcols))
        notnull = " AND ".join(f"c.{a} IS NOT NULL" for a in ccols)
        parts.append(
            f"SELECT '{child}' AS table_name, '{','.join(ccols)}' AS key_columns, '{parent}' AS parent_table, "
            f"{kv} AS key_value, count(*) AS n FROM c_{child} c WHERE {notnull} "
            f"AND NOT EXISTS (SELECT 1 FROM c_{parent} p WHERE {on}) GROUP BY {', '.join('c.' + a for a in ccols)}")
    return "\nUNION ALL\n".join(parts)


@register("dq_foreign_keys", W(_fk_sql()))
def q_dq_foreign_keys(t):
    """Child rows whose parent row does not exist."""
    return qa.foreign_key_report(_tables(t))


# Customers deleted without their orders: every order of theirs loses its parent.
_BEREFT = "c_kept AS (SELECT * FROM c_customers WHERE customer_id NOT IN (SELECT printf('CUST_%06d', c_custkey) FROM customer WHERE c_acctbal < 0))"


@register("dq_foreign_keys_orphans", W(f"WITH {_BEREFT}\n" + _fk_sql().replace("c_customers p", "c_kept p")))
def q_dq_foreign_keys_orphans(t):
    """V14 with orphans: customers with a negative balance are gone, their orders stayed."""
    gone = t.adapter.raw("customer").filter("c_acctbal < 0").select(F.format_string("CUST_%06d", "c_custkey").alias("customer_id"))
    kept = t.customers.join(gone, "customer_id", "left_anti")
    return qa.foreign_key_report(_tables(t.with_tables(customers=kept)))


_STOCK_AFTER = aq._LINES + """,
taken AS (SELECT stock_id, CAST(sum(take) AS INTEGER) AS tk FROM alloc GROUP BY stock_id),
st AS (SELECT s.stock_id, s.quantity_in_stock, s.quantity_reserved,
              s.quantity_available - coalesce(k.tk, 0) AS quantity_available
       FROM c_stock s LEFT JOIN taken k ON k.stock_id = s.stock_id)"""


@register("dq_stock", W(f"""
WITH RECURSIVE {_STOCK_AFTER}
SELECT stock_id,
       concat_ws('; ', CASE WHEN NOT coalesce(quantity_available = quantity_in_stock - quantity_reserved
                                              AND quantity_available >= 0, false)
                            THEN 'quantity_available: must equal in stock - reserved and be >= 0' END) AS errors,
       coalesce(quantity_available = quantity_in_stock - quantity_reserved AND quantity_available >= 0, false) AS is_valid
FROM st"""))
def q_dq_stock(t):
    """V13 over the stock after order placement (placing decrements only the available
    quantity, so touched rows break the in-stock - reserved equality)."""
    stock = aq._placement(t)["stock"]
    return _joined(qa.stock_check(stock), "stock_id")


REVIEW_BATCH_SQL = """
SELECT printf('ORDER_%06d', o_orderkey) AS order_id, CAST(o_orderkey % 7 AS INTEGER) AS review_score,
       'Avis' AS review_comment_title, '  Livraison rapide  ' AS review_comment_message
FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT printf('ORDER_%06d', o_orderkey), 4, NULL, '' FROM orders
WHERE o_orderstatus = 'F' AND dayofmonth(o_orderdate) = 1"""


def review_batch(t):
    """Review proposals derived from the orders: one per delivered order (score = key mod 7,
    so 0 and 6 are out of range), plus a second one for orders placed on the 1st."""
    o = t.adapter.raw("orders").filter(F.col("o_orderstatus") == "F")
    first = o.select(
        F.format_string("ORDER_%06d", "o_orderkey").alias("order_id"),
        (F.col("o_orderkey") % 7).cast("int").alias("review_score"),
        F.lit("Avis").alias("review_comment_title"),
        F.lit("  Livraison rapide  ").alias("review_comment_message"),
    )
    again = o.filter(F.dayofmonth("o_orderdate") == 1).select(
        F.format_string("ORDER_%06d", "o_orderkey").alias("order_id"),
        F.lit(4).alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_title"),
        F.lit("").alias("review_comment_message"),
    )
    return first.unionByName(again)


@register("dq_reviews", W(f"""
WITH b AS ({REVIEW_BATCH_SQL}),
chk AS (
  SELECT b.*,
         b.order_id IN (SELECT order_id FROM c_orders) AS has_order,
         b.order_id NOT IN (SELECT order_id FROM c_order_reviews) AS not_reviewed,
         coalesce(review_score BETWEEN 1 AND 5, false) AS score_ok
  FROM b),
once AS (SELECT *, NOT (has_order AND not_reviewed AND score_ok)
                   OR count(*) FILTER (WHERE has_order AND not_reviewed AND score_ok) OVER (PARTITION BY order_id) = 1 AS once
         FROM chk)
SELECT order_id, review_score,
       concat_ws('; ',
         CASE WHEN NOT has_order THEN 'order_id: unknown order' END,
         CASE WHEN NOT not_reviewed THEN 'order_id: already reviewed' END,
         CASE WHEN NOT score_ok THEN 'review_score: integer from 1 to 5' END,
         CASE WHEN NOT once THEN 'order_id: duplicated in batch' END) AS errors
FROM once"""))
def q_dq_reviews(t):
    """V10, V11 over a batch of review proposals."""
    chk = qa.review_batch_check(review_batch(t), t.orders, t.order_reviews)
    return chk.select("order_id", "review_score", F.array_join("errors", "; ").alias("errors"))
