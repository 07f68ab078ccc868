"""Registered table-maintenance queries (U1-U14) with change batches derived from the
given tables, and their oracles (the resulting table stated in SQL)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from boutique.operators import maintenance as mt
from boutique.plans.canonical_sql import sel
from boutique.plans.canonical_sql import with_canonical as W
from boutique.plans.quality_queries import REVIEW_BATCH_SQL, review_batch
from boutique.plans.registry import register

AS_OF = dt.datetime(2024, 6, 1, 12, 0, 0)
AS_OF_SQL = "TIMESTAMP '2024-06-01 12:00:00'"
YEAR = 2024


def _max_id(table, col, prefix):
    return (f"(SELECT coalesce(max(TRY_CAST(NULLIF(regexp_extract({col}, '{prefix}(\\d+)', 1), '') AS BIGINT)), 0) "
            f"FROM {table})")


def _strip(c):
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _ne(c):
    return f"coalesce(length(trim(CAST({c} AS VARCHAR))) > 0, false)"


# ------------------------------------------------------------------------------ products
def product_batch(t):
    p = t.adapter.raw("part").filter(F.col("p_size") >= 48)
    return p.select(
        F.concat("p_name", F.lit(" deluxe")).alias("product_name"),
        F.col("p_type").alias("product_category"),
        F.col("p_brand").alias("product_platform"),
        F.when(F.col("p_size") == 48, " ").otherwise("16").alias("product_esrb_rating"),
        (F.lit(1975) + F.col("p_size")).cast("string").alias("product_release_year"),
        F.when(F.col("p_partkey") % 10 == 3, "abc").when(F.col("p_partkey") % 10 == 7, "1e12")
        .otherwise((F.col("p_retailprice") - 905.0).cast("string")).alias("product_price"),
        (F.col("p_size") * 10).alias("product_weight_g"),
        F.concat(F.lit("Edition "), "p_brand").alias("product_description"),
    )


_PRODUCT_BATCH = """
SELECT p_name || ' deluxe' AS product_name, p_type AS product_category, p_brand AS product_platform,
       CASE WHEN p_size = 48 THEN ' ' ELSE '16' END AS product_esrb_rating,
       CAST(1975 + p_size AS VARCHAR) AS product_release_year,
       CASE p_partkey % 10 WHEN 3 THEN 'abc' WHEN 7 THEN '1e12' ELSE CAST(p_retailprice - 905.0 AS VARCHAR) END AS product_price,
       p_size * 10 AS product_weight_g, 'Edition ' || p_brand AS product_description
FROM part WHERE p_size >= 48"""

_NEW_PRODUCTS = f"""
b AS ({_PRODUCT_BATCH}),
r AS (
  SELECT *, concat_ws('; ',
    CASE WHEN NOT {_ne('product_name')} THEN 'product_name: must not be empty' END,
    CASE WHEN NOT {_ne('product_category')} THEN 'product_category: must not be empty' END,
    CASE WHEN NOT {_ne('product_platform')} THEN 'product_platform: must not be empty' END,
    CASE WHEN NOT {_ne('product_esrb_rating')} THEN 'product_esrb_rating: must not be empty' END,
    CASE WHEN NOT coalesce(TRY_CAST(trim(product_release_year) AS INTEGER) BETWEEN 1970 AND {YEAR + 2}, false) THEN 'product_release_year: out of range' END,
    CASE WHEN NOT coalesce(TRY_CAST(product_price AS DOUBLE) > 0, false) THEN 'product_price: must be > 0' END,
    CASE WHEN TRY_CAST(product_price AS DOUBLE) >= 99999999.99 THEN 'product_price: too large' END,
    CASE WHEN NOT coalesce(product_weight_g > 0, false) THEN 'product_weight_g: must be > 0' END) AS errors
  FROM b),
v AS (
  SELECT {_strip('product_name')} AS product_name, {_strip('product_category')} AS product_category,
         {_strip('product_platform')} AS product_platform, {_strip('product_esrb_rating')} AS product_esrb_rating,
         CAST(trim(product_release_year) AS INTEGER) AS product_release_year,
         CAST(CAST(product_price AS DOUBLE) AS DECIMAL(10,2)) AS product_price,
         CAST(CAST(product_weight_g AS DOUBLE) AS INTEGER) AS product_weight_g,
         coalesce(product_description, '') AS product_description
  FROM r WHERE errors = ''),
np AS (
  SELECT printf('PROD_%05d', {_max_id('c_products', 'product_id', 'PROD_')} + row_number() OVER (
           ORDER BY product_name, product_platform, product_category, product_esrb_rating,
                    product_release_year, product_price, product_weight_g, product_description)) AS product_id,
         product_name, product_category, product_platform, product_esrb_rating, product_release_year,
         product_price, product_weight_g, product_description,
         '../static/images/' || product_name || '.png' AS product_image, {AS_OF_SQL} AS created_at
  FROM v)"""


@register("add_products", W(f"WITH {_NEW_PRODUCTS}\nSELECT {sel('products')} FROM np"))
def q_add_products(t):
    """Validated new products with PROD_ ids."""
    return mt.add_products(t, product_batch(t), AS_OF, YEAR)["new_products"]


def _rejected(df, key):
    """Registered form of rejects: the key and the broken rules as one string."""
    return df.select(F.col(key).cast("string").alias("key"), F.array_join("errors", "; ").alias("errors"))


@register("add_products_rejects", W(f"WITH {_NEW_PRODUCTS}\nSELECT product_name AS key, errors FROM r WHERE errors <> ''"))
def q_add_products_rejects(t):
    """Refused products with the rules they break (a price that is no number, or too large)."""
    return _rejected(mt.add_products(t, product_batch(t), AS_OF, YEAR)["rejects"], "product_name")


@register("add_products_stock", W(f"""
WITH {_NEW_PRODUCTS}
SELECT printf('STOCK_%05d', {_max_id('c_stock', 'stock_id', 'STOCK_')} + row_number() OVER (ORDER BY CAST(NULLIF(regexp_extract(product_id, 'PROD_(\\d+)', 1), '') AS BIGINT) NULLS FIRST, product_id)) AS stock_id,
       'SELLER_0001' AS seller_id, product_id, 10 AS quantity_in_stock, 0 AS quantity_reserved,
       10 AS quantity_available, 3 AS min_stock_level, 5 AS reorder_point, {AS_OF_SQL} AS last_updated,
       'A-00-00' AS warehouse_location, 'new' AS stock_condition
FROM np"""))
def q_add_products_stock(t):
    """The default stock row created with each new product."""
    return mt.add_products(t, product_batch(t), AS_OF, YEAR)["new_stock"]


def product_changes(t):
    p = t.adapter.raw("part").filter(F.col("p_size") >= 45)
    return p.select(
        F.format_string("PROD_%05d", "p_partkey").alias("product_id"),
        F.when(F.col("p_size") == 46, F.upper("p_name")).alias("new_product_name"),
        F.when(F.col("p_size") == 47, F.lit(" ")).alias("new_product_category"),
        F.lit(None).cast("string").alias("new_product_platform"),
        F.lit(None).cast("string").alias("new_product_esrb_rating"),
        F.lit(None).cast("string").alias("new_product_release_year"),
        (F.col("p_retailprice") + 10.0).alias("new_product_price"),
        F.lit(None).cast("double").alias("new_product_weight_g"),
        F.lit(None).cast("string").alias("new_product_description"),
    )


@register("update_products", W(f"""
WITH ch AS (
  SELECT printf('PROD_%05d', p_partkey) AS product_id,
         CASE WHEN p_size = 46 THEN upper(p_name) END AS new_name,
         CASE WHEN p_size = 47 THEN ' ' END AS new_category,
         p_retailprice + 10.0 AS new_price
  FROM part WHERE p_size >= 45),
ok AS (SELECT * FROM ch WHERE (new_name IS NULL OR {_ne('new_name')}) AND (new_category IS NULL OR {_ne('new_category')})
                         AND (new_price IS NULL OR coalesce(new_price > 0, false)))
SELECT p.product_id,
       coalesce({_strip('ok.new_name')}, p.product_name) AS product_name,
       coalesce({_strip('ok.new_category')}, p.product_category) AS product_category,
       p.product_platform, p.product_esrb_rating, p.product_release_year,
       CAST(coalesce(CAST(CAST(ok.new_price AS DOUBLE) AS DECIMAL(10,2)), p.product_price) AS DOUBLE) AS product_price,
       p.product_weight_g, p.product_description, p.product_image, p.created_at
FROM c_products p LEFT JOIN ok ON ok.product_id = p.product_id"""))
def q_update_products(t):
    """Products after a sparse update batch."""
    return mt.update_products(t, product_changes(t), YEAR)["products"]


@register("delete_products", W(f"""
WITH ids AS (SELECT printf('PROD_%05d', p_partkey) AS product_id FROM part WHERE p_size = 1),
gone AS (SELECT product_id FROM ids WHERE product_id IN (SELECT product_id FROM c_products)
           AND product_id NOT IN (SELECT product_id FROM c_order_items))
SELECT {sel('products')} FROM c_products WHERE product_id NOT IN (SELECT product_id FROM gone)"""))
def q_delete_products(t):
    """Products after deleting the size-1 parts that are on no order line."""
    ids = t.adapter.raw("part").filter(F.col("p_size") == 1).select(
        F.format_string("PROD_%05d", "p_partkey").alias("product_id"))
    return mt.delete_products(t, ids)["products"]


_FREED = """
lines AS (SELECT * FROM c_order_items WHERE shipping_limit_date < TIMESTAMP '1993-01-01'),
ids AS (SELECT printf('PROD_%05d', p_partkey) AS product_id FROM part WHERE p_size <= 25
        UNION ALL SELECT 'PROD_unknown'),
gone AS (SELECT product_id FROM ids WHERE product_id IN (SELECT product_id FROM c_products)
           AND product_id NOT IN (SELECT product_id FROM lines))"""


def _delete_freed(t):
    """U3 on a shop that has kept only its oldest order lines, so some products are free."""
    lines = t.order_items.filter(F.col("shipping_limit_date") < F.lit("1993-01-01").cast("timestamp_ntz"))
    ids = t.adapter.raw("part").filter(F.col("p_size") <= 25).select(F.format_string("PROD_%05d", "p_partkey").alias("product_id"))
    unknown = t.spark.createDataFrame([("PROD_unknown",)], "product_id string")
    return mt.delete_products(t.with_tables(order_items=lines), ids.unionByName(unknown))


@register("delete_free_products", W(f"""
WITH {_FREED}
SELECT {sel('products')} FROM c_products WHERE product_id NOT IN (SELECT product_id FROM gone)"""))
def q_delete_free_products(t):
    """Products left after deleting those on no order line."""
    return _delete_freed(t)["products"]


@register("delete_free_products_stock", W(f"""
WITH {_FREED}
SELECT * FROM c_stock WHERE product_id NOT IN (SELECT product_id FROM gone)"""))
def q_delete_free_products_stock(t):
    """Stock left after the deleted products' rows went with them."""
    return _delete_freed(t)["stock"]


@register("delete_products_rejects", W(f"""
WITH {_FREED}
SELECT DISTINCT product_id AS key, CASE WHEN product_id IN (SELECT product_id FROM c_products)
       THEN 'product_id: referenced by order lines' ELSE 'product_id: not found' END AS errors
FROM ids WHERE product_id NOT IN (SELECT product_id FROM gone)"""))
def q_delete_products_rejects(t):
    """Products that can't be deleted, and unknown ones."""
    return _rejected(_delete_freed(t)["rejects"], "key")


# ----------------------------------------------------------------------------- customers
def customer_batch(t):
    s = t.adapter.raw("supplier")
    nr = t.adapter._nation_region()
    j = s.join(nr, s.s_nationkey == nr.n_nationkey, "left")
    return j.select(
        F.lit("Vendeur").alias("first_name"),
        F.col("s_name").alias("last_name"),
        F.when(F.col("s_acctbal") < 0, F.when(F.col("s_suppkey") % 2 == 0, "partenaire@shop.example").otherwise(" partenaire@shop.example\t"))
        .when(F.col("s_suppkey") % 9 == 1, F.concat(F.lit("\tcustomer#00000000"), (F.col("s_suppkey") % 9).cast("string"), F.lit("@example.com\t")))
        .when(F.col("s_suppkey") % 9 == 2, "nobody.example")
        .otherwise(F.concat(F.lit(" seller"), F.col("s_suppkey").cast("string"), F.lit("@shop.example\t")))
        .alias("email"),
        F.col("s_suppkey").cast("bigint").alias("seq"),
        F.when(F.col("s_suppkey") % 9 == 4, "0012345678").otherwise(
            F.format_string("06 %02d.%02d-%02d %02d", F.col("s_suppkey") % 100, F.col("s_nationkey"), F.lit(12), F.lit(34))).alias("phone"),
        F.when(F.col("s_nationkey") >= 20, F.col("s_nationkey").cast("string"))
        .otherwise(F.lpad(F.col("s_nationkey").cast("string"), 5, "0")).alias("zip_code_prefix"),
        F.when(F.col("s_suppkey") % 9 == 5, "Atlantis").otherwise(F.upper("n_name")).alias("city"),
        F.when(F.col("s_suppkey") % 9 == 6, "Utopia").otherwise(F.col("r_name")).alias("state"),
        F.concat(F.lit("Zone "), F.col("s_suppkey").cast("string")).alias("address_line1"),
        F.lit(None).cast("string").alias("address_line2"),
        F.lit(None).cast("tinyint").alias("is_admin"),
    )


_NEW_CUSTOMERS = f"""
raw_batch AS (
  SELECT 'Vendeur' AS first_name, s_name AS last_name, s_suppkey AS seq,
         CASE WHEN s_acctbal < 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'partenaire@shop.example' ELSE ' partenaire@shop.example' || chr(9) END
              WHEN s_suppkey % 9 = 1 THEN chr(9) || 'customer#00000000' || CAST(s_suppkey % 9 AS VARCHAR) || '@example.com' || chr(9)
              WHEN s_suppkey % 9 = 2 THEN 'nobody.example'
              ELSE ' seller' || CAST(s_suppkey AS VARCHAR) || '@shop.example' || chr(9) END AS raw_email,
         CASE WHEN s_suppkey % 9 = 4 THEN '0012345678' ELSE printf('06 %02d.%02d-%02d %02d', s_suppkey % 100, s_nationkey, 12, 34) END AS phone,
         CASE WHEN s_nationkey >= 20 THEN CAST(s_nationkey AS VARCHAR) ELSE lpad(CAST(s_nationkey AS VARCHAR), 5, '0') END AS zip_code_prefix,
         CASE WHEN s_suppkey % 9 = 5 THEN 'Atlantis' ELSE upper(n.n_name) END AS city,
         CASE WHEN s_suppkey % 9 = 6 THEN 'Utopia' ELSE r.r_name END AS state, 'Zone ' || CAST(s_suppkey AS VARCHAR) AS address_line1
  FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey),
b AS (SELECT *, {_strip('raw_email')} AS email FROM raw_batch),
judged AS (
  SELECT *, concat_ws('; ',
    CASE WHEN NOT coalesce(contains(email, '@') AND contains(string_split(email, '@')[-1], '.') AND length(email) <= 254, false) THEN 'email: invalid' END,
    CASE WHEN NOT (phone IS NULL OR trim(phone) = '' OR coalesce(regexp_full_match(regexp_replace(trim(phone), '[\\s.\\-]', '', 'g'), '0[1-9][0-9]{{8}}'), false)) THEN 'phone: 10 digits starting with 0' END,
    CASE WHEN NOT coalesce(regexp_full_match(trim(zip_code_prefix), '[0-9]{{5}}'), false) THEN 'zip_code_prefix: exactly 5 digits' END,
    CASE WHEN TRY_CAST(trim(zip_code_prefix) AS INTEGER) NOT IN (SELECT zip_code_prefix FROM c_geolocation) THEN 'zip_code_prefix: unknown' END,
    CASE WHEN lower(trim(city)) NOT IN (SELECT lower(city) FROM c_geolocation) THEN 'city: unknown' END,
    CASE WHEN lower(trim(state)) NOT IN (SELECT lower(state) FROM c_geolocation) THEN 'state: unknown' END,
    CASE WHEN email IN (SELECT {_strip('email')} FROM c_customers) THEN 'email: already registered' END) AS broken
  FROM b),
final AS (
  SELECT *, CASE WHEN broken = '' AND row_number() OVER (PARTITION BY email, broken = '' ORDER BY seq) > 1
                 THEN 'email: duplicated in batch' ELSE broken END AS errors FROM judged),
v AS (SELECT * FROM final WHERE errors = '')"""


@register("add_customers_rejects", W(f"WITH {_NEW_CUSTOMERS}\nSELECT last_name AS key, errors FROM final WHERE errors <> ''"))
def q_add_customers_rejects(t):
    """U4: refused customers with the rules they break (V5-V9; the first valid row of an
    email stands)."""
    return _rejected(mt.add_customers(t, customer_batch(t), AS_OF)["rejects"], "last_name")


@register("add_customers", W(f"""
WITH {_NEW_CUSTOMERS}
SELECT printf('CUST_%06d', {_max_id('c_customers', 'customer_id', 'CUST_')} + row_number() OVER (ORDER BY email)) AS customer_id,
       {_strip('first_name')} AS first_name, {_strip('last_name')} AS last_name, email,
       CAST(0 AS TINYINT) AS is_admin,
       regexp_replace(trim(phone), '[\\s.\\-]', '', 'g') AS phone,
       CAST(trim(zip_code_prefix) AS INTEGER) AS zip_code_prefix, city, state, address_line1,
       '' AS address_line2, CAST(NULL AS VARCHAR) AS customer_segment, {AS_OF_SQL} AS registration_date,
       CAST(NULL AS TIMESTAMP) AS last_purchase_date, 0 AS total_orders, CAST(0 AS DOUBLE) AS total_spent
FROM v"""))
def q_add_customers(t):
    """U4: validated new customers with CUST_ ids."""
    return mt.add_customers(t, customer_batch(t), AS_OF)["new_customers"]


def customer_changes(t):
    c = t.adapter.raw("customer").filter(F.col("c_acctbal") > 9000)
    none = F.lit(None).cast("string")
    return c.select(
        F.format_string("CUST_%06d", "c_custkey").alias("customer_id"),
        F.lit("Client").alias("new_first_name"),
        none.alias("new_last_name"),
        F.when(F.col("c_acctbal") > 9500, F.concat(F.lit("vip"), F.col("c_custkey").cast("string"),
                                                   F.lit("@example.com"))).alias("new_email"),
        F.when(F.col("c_acctbal") > 9900, F.lit("12345")).alias("new_phone"),
        none.alias("new_zip_code_prefix"), none.alias("new_city"), none.alias("new_state"),
        F.lit("Nouvelle adresse").alias("new_address_line1"), none.alias("new_address_line2"),
        F.lit(None).cast("tinyint").alias("new_is_admin"),
    )


@register("update_customers_self", W(f"""
WITH ch AS (SELECT printf('CUST_%06d', c_custkey) AS customer_id, c_acctbal FROM customer WHERE c_acctbal > 9000 AND c_acctbal <= 9900)
SELECT c.customer_id, CASE WHEN ch.customer_id IS NOT NULL THEN 'Client' ELSE c.first_name END AS first_name, c.email, c.is_admin,
       CASE WHEN ch.customer_id IS NOT NULL THEN 'Nouvelle adresse' ELSE c.address_line1 END AS address_line1
FROM c_customers c LEFT JOIN ch ON ch.customer_id = c.customer_id"""))
def q_update_customers_self(t):
    """U5, self-service: email and is_admin stay whatever the change says."""
    asked = customer_changes(t).withColumn("new_is_admin", F.lit(1).cast("tinyint"))
    return mt.update_customers(t, asked, admin=False)["customers"].select("customer_id", "first_name", "email", "is_admin", "address_line1")


@register("update_customers_rejects", W("""
SELECT printf('CUST_%06d', c_custkey) AS key, 'phone: 10 digits starting with 0' AS errors FROM customer WHERE c_acctbal > 9900"""))
def q_update_customers_rejects(t):
    """Refused customer changes."""
    return _rejected(mt.update_customers(t, customer_changes(t), admin=True)["rejects"], "key")


@register("update_customers", W(f"""
WITH ch AS (
  SELECT printf('CUST_%06d', c_custkey) AS customer_id,
         CASE WHEN c_acctbal > 9500 THEN 'vip' || CAST(c_custkey AS VARCHAR) || '@example.com' END AS new_email,
         CASE WHEN c_acctbal > 9900 THEN '12345' END AS new_phone
  FROM customer WHERE c_acctbal > 9000),
ok AS (SELECT * FROM ch WHERE new_phone IS NULL)
SELECT c.customer_id,
       CASE WHEN ok.customer_id IS NOT NULL THEN 'Client' ELSE c.first_name END AS first_name,
       c.last_name,
       coalesce(trim(ok.new_email), c.email) AS email,
       c.is_admin, c.phone, c.zip_code_prefix, c.city, c.state,
       CASE WHEN ok.customer_id IS NOT NULL THEN 'Nouvelle adresse' ELSE c.address_line1 END AS address_line1,
       c.address_line2, c.customer_segment, c.registration_date, c.last_purchase_date, c.total_orders,
       CAST(c.total_spent AS DOUBLE) AS total_spent
FROM c_customers c LEFT JOIN ok ON ok.customer_id = c.customer_id"""))
def q_update_customers(t):
    """Customers after an admin sparse-update batch."""
    return mt.update_customers(t, customer_changes(t), admin=True)["customers"]


_GONE_CUSTOMERS = "SELECT printf('CUST_%06d', c_custkey) AS customer_id FROM customer WHERE c_acctbal < -900"


def _gone_customers(t):
    return t.adapter.raw("customer").filter(F.col("c_acctbal") < -900).select(
        F.format_string("CUST_%06d", "c_custkey").alias("customer_id"))


@register("delete_customers", W(f"""
SELECT * FROM c_orders WHERE customer_id NOT IN ({_GONE_CUSTOMERS})"""))
def q_delete_customers(t):
    """Orders left after deleting customers (their orders go with them)."""
    return mt.delete_customers(t, _gone_customers(t))["orders"]


@register("delete_customers_items", W(f"""
SELECT {sel('order_items')} FROM c_order_items WHERE order_id NOT IN (
  SELECT order_id FROM c_orders WHERE customer_id IN ({_GONE_CUSTOMERS}))"""))
def q_delete_customers_items(t):
    """Order lines left after the cascade."""
    return mt.delete_customers(t, _gone_customers(t))["order_items"]


@register("delete_customers_left", W(f"""
SELECT {sel('customers')} FROM c_customers WHERE customer_id NOT IN ({_GONE_CUSTOMERS})"""))
def q_delete_customers_left(t):
    """Customers left after the deletion."""
    return mt.delete_customers(t, _gone_customers(t))["customers"]


@register("delete_customers_payments", W(f"""
SELECT {sel('order_payments')} FROM c_order_payments WHERE order_id NOT IN (
  SELECT order_id FROM c_orders WHERE customer_id IN ({_GONE_CUSTOMERS}))"""))
def q_delete_customers_payments(t):
    """Payments left after the cascade."""
    return mt.delete_customers(t, _gone_customers(t))["order_payments"]


@register("delete_customers_reviews", W(f"""
SELECT {sel('order_reviews')} FROM c_order_reviews WHERE order_id NOT IN (
  SELECT order_id FROM c_orders WHERE customer_id IN ({_GONE_CUSTOMERS}))"""))
def q_delete_customers_reviews(t):
    """Reviews left after the cascade."""
    return mt.delete_customers(t, _gone_customers(t))["order_reviews"]


# -------------------------------------------------------------------------------- orders
def status_changes(t):
    """One change for many orders; two for some: approved then shipped, cancelled then
    reopened; a repeated cancel; unknown statuses and orders."""
    o = t.adapter.raw("orders")
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    new = (F.when((st == "O") & (pr == "1-URGENT"), F.array(F.lit("shipped")))
           .when((st == "O") & (pr == "2-HIGH"), F.array(F.lit("approved"), F.lit("shipped")))
           .when((st == "O") & (pr == "3-MEDIUM"), F.array(F.lit("cancelled"), F.lit("created")))
           .when((st == "O") & (pr == "4-NOT SPECIFIED"), F.array(F.lit("cancelled"), F.lit("cancelled"), F.lit("approved"), F.lit("cancelled")))
           .when((st == "O") & (pr == "5-LOW"), F.array(F.lit("cancelled")))
           .when((st == "P") & (pr == "2-HIGH"), F.array(F.lit("cancelled")))
           .when((st == "F") & (pr == "4-NOT SPECIFIED"), F.array(F.lit("returned"))))
    known = o.select(F.format_string("ORDER_%06d", "o_orderkey").alias("order_id"), F.posexplode(new).alias("seq", "new_status"))
    unknown = o.filter((st == "P") & (pr == "1-URGENT")).select(
        F.format_string("NONE_%06d", "o_orderkey").alias("order_id"), F.lit(0).alias("seq"), F.lit("shipped").alias("new_status"))
    return known.unionByName(unknown)


_STATUS_CHANGES = """
listed AS (
  SELECT printf('ORDER_%06d', o_orderkey) AS order_id,
         CASE WHEN o_orderstatus = 'O' THEN CASE o_orderpriority
                WHEN '1-URGENT' THEN ['shipped'] WHEN '2-HIGH' THEN ['approved', 'shipped']
                WHEN '3-MEDIUM' THEN ['cancelled', 'created']
                WHEN '4-NOT SPECIFIED' THEN ['cancelled', 'cancelled', 'approved', 'cancelled']
                WHEN '5-LOW' THEN ['cancelled'] END
              WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN ['cancelled']
              WHEN o_orderstatus = 'F' AND o_orderpriority = '4-NOT SPECIFIED' THEN ['returned'] END AS news
  FROM orders
  UNION ALL SELECT printf('NONE_%06d', o_orderkey), ['shipped'] FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'),
ch AS (SELECT order_id, unnest(news) AS new_status, unnest(range(len(news))) AS seq FROM listed WHERE news IS NOT NULL),
steps AS (
  SELECT ch.*, coalesce(lag(ch.new_status) OVER (PARTITION BY ch.order_id ORDER BY ch.seq), o.order_status) AS before
  FROM ch JOIN c_orders o ON o.order_id = ch.order_id
  WHERE ch.new_status IN ('created', 'approved', 'shipped', 'delivered', 'cancelled')),
ok AS (
  SELECT order_id, arg_max(new_status, seq) AS new_status,
         bool_or(new_status = 'approved') AS approved, bool_or(new_status = 'shipped') AS shipped, bool_or(new_status = 'delivered') AS delivered,
         count(*) FILTER (WHERE new_status = 'cancelled' AND before <> 'cancelled') AS cancels
  FROM steps GROUP BY order_id)"""


@register("status_update_rejects", W(f"""
WITH {_STATUS_CHANGES}
SELECT order_id AS key, CASE WHEN new_status NOT IN ('created', 'approved', 'shipped', 'delivered', 'cancelled')
         THEN 'new_status: not an allowed status' ELSE 'order_id: not found' END AS errors
FROM ch WHERE new_status NOT IN ('created', 'approved', 'shipped', 'delivered', 'cancelled')
   OR order_id NOT IN (SELECT order_id FROM c_orders)"""))
def q_status_update_rejects(t):
    """Changes to a status that isn't allowed or of an unknown order."""
    return _rejected(mt.update_order_status(t, status_changes(t), AS_OF)["rejects"], "key")


@register("status_update", W(f"""
WITH {_STATUS_CHANGES}
SELECT o.order_id, o.customer_id, coalesce(ok.new_status, o.order_status) AS order_status,
       o.order_purchase_timestamp,
       CASE WHEN ok.approved THEN {AS_OF_SQL} ELSE o.order_approved_at END AS order_approved_at,
       CASE WHEN ok.shipped THEN {AS_OF_SQL} ELSE o.order_delivered_carrier_date END AS order_delivered_carrier_date,
       CASE WHEN ok.delivered THEN {AS_OF_SQL} ELSE o.order_delivered_customer_date END AS order_delivered_customer_date
FROM c_orders o LEFT JOIN ok ON ok.order_id = o.order_id"""))
def q_status_update(t):
    """Orders after a batch of status changes."""
    return mt.update_order_status(t, status_changes(t), AS_OF)["orders"]


@register("stock_restore", W(f"""
WITH {_STATUS_CHANGES},
back AS (SELECT product_id, seller_id, CAST(sum(coalesce(quantity, 1) * cancels) AS INTEGER) AS bk
         FROM c_order_items JOIN ok USING (order_id) WHERE cancels > 0 GROUP BY product_id, seller_id)
SELECT s.stock_id, s.seller_id, s.product_id, s.quantity_in_stock, s.quantity_reserved,
       s.quantity_available + coalesce(b.bk, 0) AS quantity_available, s.min_stock_level, s.reorder_point,
       CASE WHEN b.bk IS NOT NULL THEN {AS_OF_SQL} ELSE s.last_updated END AS last_updated,
       s.warehouse_location, s.stock_condition
FROM c_stock s LEFT JOIN back b ON b.product_id = s.product_id AND b.seller_id = s.seller_id"""))
def q_stock_restore(t):
    """Stock after cancellations gave their quantities back."""
    return mt.update_order_status(t, status_changes(t), AS_OF)["stock"]


@register("status_customer_stats", W(f"""
WITH {_STATUS_CHANGES},
new_orders AS (SELECT o.order_id, o.customer_id, coalesce(ok.new_status, o.order_status) AS order_status,
                      o.order_purchase_timestamp
               FROM c_orders o LEFT JOIN ok ON ok.order_id = o.order_id),
touched AS (SELECT DISTINCT o.customer_id FROM c_orders o JOIN ok ON ok.order_id = o.order_id),
per_order AS (SELECT order_id, sum(coalesce(price, 0) * coalesce(quantity, 1) + coalesce(freight_value, 0)) AS value
              FROM c_order_items GROUP BY order_id),
stats AS (SELECT o.customer_id, count(*) AS n, sum(p.value) AS spent, max(o.order_purchase_timestamp) AS lp
          FROM new_orders o JOIN per_order p ON p.order_id = o.order_id
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
def q_status_customer_stats(t):
    """U7 after U9: statistics of the customers whose orders changed status."""
    c = mt.update_order_status(t, status_changes(t), AS_OF)["customers"]
    return c.select("customer_id", "total_orders", "total_spent", "last_purchase_date", "customer_segment")


# --------------------------------------------------------------------------------- stock
def stock_changes(t):
    s = t.stock.filter(F.col("quantity_available") <= 2)
    small = F.col("quantity_in_stock") < 5
    return s.select(
        "stock_id",
        F.when(~small, F.col("quantity_in_stock") + 50).alias("new_quantity_in_stock"),
        F.when(small, F.col("quantity_in_stock") + 1).alias("new_quantity_reserved"),
        F.when(F.col("quantity_in_stock") % 4 == 1, "abc").otherwise("5").alias("new_min_stock_level"),
        F.lit(None).cast("int").alias("new_reorder_point"),
        F.lit(None).cast("string").alias("new_seller_id"),
        F.lit("  B-01-01 ").alias("new_warehouse_location"),
        F.lit("").alias("new_stock_condition"),
    )


@register("stock_update", W(f"""
WITH ch AS (
  SELECT stock_id,
         CASE WHEN quantity_in_stock >= 5 THEN quantity_in_stock + 50 END AS nin,
         CASE WHEN quantity_in_stock < 5 THEN quantity_in_stock + 1 END AS nres
  FROM c_stock WHERE quantity_available <= 2 AND quantity_in_stock % 4 <> 1),
upd AS (
  SELECT s.stock_id, s.seller_id, s.product_id,
         coalesce(ch.nin, s.quantity_in_stock) AS quantity_in_stock,
         coalesce(ch.nres, s.quantity_reserved) AS quantity_reserved,
         coalesce(ch.nin, s.quantity_in_stock) - coalesce(ch.nres, s.quantity_reserved) AS quantity_available,
         5 AS min_stock_level, s.reorder_point, {AS_OF_SQL} AS last_updated,
         'B-01-01' AS warehouse_location, s.stock_condition
  FROM c_stock s JOIN ch ON ch.stock_id = s.stock_id),
ok AS (SELECT * FROM upd WHERE quantity_available >= 0)
SELECT * FROM c_stock WHERE stock_id NOT IN (SELECT stock_id FROM ok)
UNION ALL SELECT * FROM ok"""))
def q_stock_update(t):
    """Stock after a sparse update batch (negative availability rejected)."""
    t = t.computed_once("stock")
    return mt.update_stock(t, stock_changes(t), AS_OF)["stock"]


# ------------------------------------------------------------------------------- reviews
@register("add_reviews", W(f"""
WITH b AS ({REVIEW_BATCH_SQL}),
fit AS (SELECT * FROM b
      WHERE order_id IN (SELECT order_id FROM c_orders)
        AND order_id NOT IN (SELECT order_id FROM c_order_reviews)
        AND coalesce(review_score BETWEEN 1 AND 5, false)),
v AS (SELECT * FROM fit WHERE order_id IN (SELECT order_id FROM fit GROUP BY order_id HAVING count(*) = 1))
SELECT printf('REVIEW_%06d', {_max_id('c_order_reviews', 'review_id', 'REVIEW_')} + row_number() OVER (ORDER BY CAST(NULLIF(regexp_extract(order_id, 'ORDER_(\\d+)', 1), '') AS BIGINT) NULLS FIRST, order_id)) AS review_id,
       order_id, review_score,
       CASE WHEN review_comment_title IS NULL OR review_comment_title = '' THEN NULL ELSE {_strip('review_comment_title')} END AS review_comment_title,
       CASE WHEN review_comment_message IS NULL OR review_comment_message = '' THEN NULL ELSE {_strip('review_comment_message')} END AS review_comment_message,
       {AS_OF_SQL} AS review_creation_date
FROM v"""))
def q_add_reviews(t):
    """Validated new reviews with REVIEW_ ids."""
    return mt.add_reviews(t, review_batch(t), AS_OF)["new_reviews"]


def review_changes(t):
    r = t.order_reviews
    one = r.filter(F.col("review_score") == 1).select(
        "review_id", F.lit(2).alias("new_review_score"), F.lit("").alias("new_review_comment_title"),
        F.lit(None).cast("string").alias("new_review_comment_message"))
    bad = r.filter((F.col("review_score") == 5) & (F.dayofmonth("review_creation_date") == 9)).select(
        "review_id", F.lit(9).alias("new_review_score"), F.lit("x").alias("new_review_comment_title"),
        F.lit(None).cast("string").alias("new_review_comment_message"))
    return one.unionByName(bad)


@register("update_reviews", W("""
SELECT r.review_id, r.order_id,
       CASE WHEN r.review_score = 1 THEN 2 ELSE r.review_score END AS review_score,
       CASE WHEN r.review_score = 1 THEN NULL ELSE r.review_comment_title END AS review_comment_title,
       r.review_comment_message, r.review_creation_date
FROM c_order_reviews r"""))
def q_update_reviews(t):
    """Reviews after an update batch (score sparse, empty title clears it)."""
    return mt.update_reviews(t, review_changes(t))["order_reviews"]


@register("delete_reviews", W("""
SELECT * FROM c_order_reviews WHERE review_score <> 3"""))
def q_delete_reviews(t):
    """Reviews after deleting every score-3 review."""
    ids = t.review_facts.filter(F.col("review_score") == 3).select("review_id")
    return mt.delete_reviews(t, ids)["order_reviews"]
