"""Registered queries over batches whose order matters (U2, U5, U11, U13), rejects, insert
ties, number and date forms, and published versions; oracles state them call after call."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from boutique.functions.numbers import python_float, python_int
from boutique.operators import maintenance as mt
from boutique.operators import orders as od
from boutique.operators import quality as qa
from boutique.plans import maintenance_queries as mq
from boutique.plans.canonical_sql import with_canonical as W
from boutique.plans.registry import register
from boutique.plans.shop_queries import stored_folder
from boutique.sources.versions import VersionLog, publish_tables, read_tables

AS_OF = dt.datetime(2024, 6, 1, 12, 0, 0)
AS_OF_SQL = "TIMESTAMP '2024-06-01 12:00:00'"
YEAR = 2024


def _events(df, key, cases, fields):
    """One row per entry of the first case that holds: ``cases`` are (condition, [(seq, {field: value})])."""
    kind = "struct<seq:bigint," + ",".join(f"{f}:string" for f in fields) + ">"

    def entry(seq, given):
        return F.struct(seq.cast("bigint").alias("seq"), *[given.get(f, F.lit(None)).cast("string").alias(f) for f in fields]).cast(kind)

    chosen = None
    for condition, entries in cases:
        rows = F.array(*[entry(seq, given) for seq, given in entries])
        chosen = F.when(condition, rows) if chosen is None else chosen.when(condition, rows)
    return df.select(key, F.explode(chosen).alias("e")).select(key, "e.*")


# ------------------------------------------------------------------------------ customers
def handover_batch(t):
    """Emails given up and taken (1 takes 0's), refused at first and granted later (2), swapped
    by way of a third (2 and 3), kept by their owner (4 wants 5's), lost with an invalid change
    (5), and several changes of one customer (6), by customer number modulo 7."""
    k = F.col("c_custkey")
    base = k * 10
    own = lambda n: F.format_string("customer#%09d@example.com", n)
    named = lambda stem: F.concat(F.lit(stem), k.cast("string"), F.lit("@example.com"))
    mail, first, phone, none = "new_email", "new_first_name", "new_phone", F.lit(None).cast("bigint")
    cases = [
        (k % 7 == 0, [(base + 1, {mail: named("moved")})]),
        (k % 7 == 1, [(base + 2, {mail: F.concat(own(k - 1), F.lit(" \t")), first: F.lit("Preneur")})]),
        (k % 7 == 2, [(base, {mail: own(k + 1), first: F.lit("Trop tot")}), (base + 17, {mail: own(k + 1)})]),
        (k % 7 == 3, [(base + 5, {mail: named("tmp")}), (base + 9, {mail: own(k - 1), first: F.lit("Echange")})]),
        (k % 7 == 4, [(base, {mail: own(k + 1), first: F.lit("Refuse")})]),
        (k % 7 == 5, [(base + 3, {mail: named("autre"), first: F.lit("Invalide"), phone: F.lit("12")})]),
        (k % 7 == 6, [(base + 1, {first: F.lit("Un")}), (base + 4, {first: F.lit("Deux")}), (none, {mail: named("dernier")})])]
    c = t.adapter.raw("customer").withColumn("key", F.format_string("CUST_%06d", "c_custkey"))
    ev = _events(c, F.col("key"), cases, [mail, first, phone]).withColumnRenamed("key", "customer_id")
    blank = [f"new_{x}" for x in ("last_name", "zip_code_prefix", "city", "state", "address_line1", "address_line2")]
    return ev.withColumns({x: F.lit(None).cast("string") for x in blank}).withColumn("new_is_admin", F.lit(None).cast("tinyint"))


_HANDOVER = r"""
asked AS (
  SELECT printf('CUST_%06d', k) AS id, e.seq, trim(e.mail, ' ' || chr(9)) AS mail, e.first, e.phone
  FROM (SELECT c_custkey AS k, unnest(CASE c_custkey % 7
    WHEN 0 THEN [{'seq': k * 10 + 1, 'mail': printf('moved%d@example.com', k), 'first': NULL, 'phone': NULL}]
    WHEN 1 THEN [{'seq': k * 10 + 2, 'mail': printf('customer#%09d@example.com', k - 1), 'first': 'Preneur', 'phone': NULL}]
    WHEN 2 THEN [{'seq': k * 10, 'mail': printf('customer#%09d@example.com', k + 1), 'first': 'Trop tot', 'phone': NULL},
                 {'seq': k * 10 + 17, 'mail': printf('customer#%09d@example.com', k + 1), 'first': NULL, 'phone': NULL}]
    WHEN 3 THEN [{'seq': k * 10 + 5, 'mail': printf('tmp%d@example.com', k), 'first': NULL, 'phone': NULL},
                 {'seq': k * 10 + 9, 'mail': printf('customer#%09d@example.com', k - 1), 'first': 'Echange', 'phone': NULL}]
    WHEN 4 THEN [{'seq': k * 10, 'mail': printf('customer#%09d@example.com', k + 1), 'first': 'Refuse', 'phone': NULL}]
    WHEN 5 THEN [{'seq': k * 10 + 3, 'mail': printf('autre%d@example.com', k), 'first': 'Invalide', 'phone': '12'}]
    ELSE [{'seq': k * 10 + 1, 'mail': NULL, 'first': 'Un', 'phone': NULL}, {'seq': k * 10 + 4, 'mail': NULL, 'first': 'Deux', 'phone': NULL},
          {'seq': NULL, 'mail': printf('dernier%d@example.com', k), 'first': NULL, 'phone': NULL}] END) AS e
    FROM (SELECT c_custkey, c_custkey AS k FROM customer))),
ev AS (SELECT *, row_number() OVER (ORDER BY seq NULLS LAST, id) AS n FROM asked),
mails AS (
  SELECT e.*, row_number() OVER (ORDER BY n) AS k, o.customer_id AS owner
  FROM ev e LEFT JOIN c_customers o ON o.email = e.mail WHERE e.phone IS NULL AND e.mail IS NOT NULL),
serial(k, n, granted, moved) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::BOOLEAN, []::STRUCT(c VARCHAR, e VARCHAR)[]
  UNION ALL
  SELECT k, n, ok, CASE WHEN ok THEN list_append(list_filter(moved, lambda m: m.c <> id), {'c': id, 'e': mail}) ELSE moved END
  FROM (SELECT m.k, m.n, m.id, m.mail, s.moved,
          NOT coalesce((m.owner <> m.id AND len(list_filter(s.moved, lambda x: x.c = m.owner)) = 0), false)
          AND len(list_filter(s.moved, lambda x: x.c <> m.id AND x.e = m.mail)) = 0 AS ok
        FROM serial s JOIN mails m ON m.k = s.k + 1)),
judged AS (
  SELECT e.*, CASE WHEN e.phone IS NOT NULL THEN 'phone: 10 digits starting with 0' WHEN s.granted = false THEN 'email: already registered' END AS errors
  FROM ev e LEFT JOIN serial s ON s.n = e.n),
last AS (
  SELECT id, arg_max(mail, n) FILTER (WHERE mail IS NOT NULL) AS mail, arg_max(first, n) FILTER (WHERE first IS NOT NULL) AS first
  FROM judged WHERE errors IS NULL GROUP BY id)"""


@register("customer_handover", W(f"""
WITH RECURSIVE {_HANDOVER}
SELECT c.customer_id, coalesce(l.first, c.first_name) AS first_name, coalesce(l.mail, c.email) AS email, c.phone
FROM c_customers c LEFT JOIN last l ON l.id = c.customer_id"""))
def q_customer_handover(t):
    """Customers after a batch in which emails change hands."""
    return mt.update_customers(t, handover_batch(t))["customers"].select("customer_id", "first_name", "email", "phone")


@register("customer_handover_rejects", W(f"WITH RECURSIVE {_HANDOVER}\nSELECT id AS key, errors FROM judged WHERE errors IS NOT NULL"))
def q_customer_handover_rejects(t):
    """The changes refused on the way."""
    return mq._rejected(mt.update_customers(t, handover_batch(t))["rejects"], "key")


def tied_customers(t):
    """New customers of whom three share an email: with seq 1, 1 and none; equal rows occur."""
    s = t.adapter.raw("supplier")
    group = F.floor(F.col("s_suppkey") / 3)
    rows = s.select(
        F.when(F.col("s_suppkey") % 3 < 2, group).cast("bigint").alias("seq"),
        F.when(group % 2 == 0, F.lit("Meme")).otherwise(F.col("s_name")).alias("first_name"), F.lit("Nom").alias("last_name"),
        F.concat(F.lit("trio"), group.cast("string"), F.lit("@shop.example")).alias("email"), F.lit(None).cast("string").alias("phone"),
        F.lit("00012").alias("zip_code_prefix"), *[F.lit(None).cast("string").alias(c) for c in ("city", "state", "address_line1", "address_line2")],
        F.lit(None).cast("tinyint").alias("is_admin"))
    return rows


_TIED = """
b AS (SELECT CASE WHEN s_suppkey % 3 < 2 THEN s_suppkey // 3 END AS seq, CASE WHEN (s_suppkey // 3) % 2 = 0 THEN 'Meme' ELSE s_name END AS first_name,
             'trio' || (s_suppkey // 3) || '@shop.example' AS email FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY seq NULLS LAST, first_name) AS k FROM b)"""


@register("add_customers_ties", W(f"WITH {_TIED}\nSELECT first_name, email FROM r WHERE k = 1"))
def q_add_customers_ties(t):
    """U4, V9: of rows with one email, equal or null seq, one is added."""
    return mt.add_customers(t, tied_customers(t), AS_OF)["new_customers"].select("first_name", "email")


@register("add_customers_ties_rejects", W(f"WITH {_TIED}\nSELECT email AS key, 'email: duplicated in batch' AS errors FROM r WHERE k > 1"))
def q_add_customers_ties_rejects(t):
    """U4, V9: the others of them."""
    return mq._rejected(mt.add_customers(t, tied_customers(t), AS_OF)["rejects"], "email")


# ------------------------------------------------------------------------------- products
def product_sequence(t):
    """Three changes of every product: a price and a name; a blank name or a price; a price in a
    form that is a number in the shop (or isn't), and a year (or one out of range)."""
    k = F.col("p_partkey")
    text = lambda n: n.cast("string")
    name, price, year = "new_product_name", "new_product_price", "new_product_release_year"
    last = F.when(k % 5 == 0, F.lit("1_2e1")).when(k % 5 == 1, F.lit("12d")).when(k % 5 == 2, F.lit("0x1p3")).when(k % 5 == 3, F.lit(" 7.5\n")).otherwise(F.lit("1,5"))
    cases = [(F.lit(True), [
        (k * 2 + 3, {price: last, year: F.when(k % 3 == 0, "1969").otherwise("1_999")}),
        (k * 2 + 2, {name: F.when(k % 2 == 0, F.lit("  ")), price: text(k + 50)}),
        (k * 2 + 1, {name: F.concat(F.lit(" Jeu "), text(k)), price: text(k + 10)})])]
    p = t.adapter.raw("part").withColumn("key", F.format_string("PROD_%05d", "p_partkey"))
    ev = _events(p, F.col("key"), cases, [name, price, year]).withColumnRenamed("key", "product_id")
    return ev.withColumns({f"new_{c}": F.lit(None).cast("string") for c in (
        "product_category", "product_platform", "product_esrb_rating", "product_weight_g", "product_description")})


_PRODUCT_SEQUENCE = """
ev AS (
  SELECT printf('PROD_%05d', k) AS id, e.* FROM (SELECT p_partkey AS k, unnest([
    {'seq': p_partkey * 2 + 1, 'name': 'Jeu ' || p_partkey, 'price': (p_partkey + 10)::DOUBLE, 'priced': true, 'year': NULL::INTEGER, 'bad_year': false, 'blank': false},
    {'seq': p_partkey * 2 + 2, 'name': NULL, 'price': (p_partkey + 50)::DOUBLE, 'priced': true, 'year': NULL, 'bad_year': false, 'blank': p_partkey % 2 = 0},
    {'seq': p_partkey * 2 + 3, 'name': NULL, 'price': CASE p_partkey % 5 WHEN 0 THEN 120.0 WHEN 3 THEN 7.5 END, 'priced': p_partkey % 5 IN (0, 3),
     'year': 1999, 'bad_year': p_partkey % 3 = 0, 'blank': false}]) AS e FROM part)),
judged AS (
  SELECT *, concat_ws('; ', CASE WHEN blank THEN 'product_name: must not be empty' END, CASE WHEN bad_year THEN 'product_release_year: out of range' END,
                      CASE WHEN NOT priced THEN 'product_price: must be > 0' END) AS errors FROM ev),
last AS (
  SELECT id, arg_max(name, seq) FILTER (WHERE name IS NOT NULL) AS name, arg_max(price, seq) AS price, arg_max(year, seq) FILTER (WHERE year IS NOT NULL) AS year
  FROM judged WHERE errors = '' GROUP BY id)"""


@register("product_sequence", W(f"""
WITH {_PRODUCT_SEQUENCE}
SELECT p.product_id, coalesce(l.name, p.product_name) AS product_name, CAST(coalesce(l.price, p.product_price) AS DOUBLE) AS product_price,
       coalesce(l.year, p.product_release_year) AS product_release_year
FROM c_products p LEFT JOIN last l ON l.id = p.product_id"""))
def q_product_sequence(t):
    """Products after three changes of each, in order."""
    return mt.update_products(t, product_sequence(t), YEAR)["products"].select("product_id", "product_name", "product_price", "product_release_year")


@register("product_sequence_rejects", W(f"WITH {_PRODUCT_SEQUENCE}\nSELECT id AS key, errors FROM judged WHERE errors <> ''"))
def q_product_sequence_rejects(t):
    """The refused ones of those changes."""
    return mq._rejected(mt.update_products(t, product_sequence(t), YEAR)["rejects"], "key")


@register("update_products_rejects", W(f"""
SELECT printf('PROD_%05d', p_partkey) AS key, 'product_category: must not be empty' AS errors FROM part WHERE p_size = 47"""))
def q_update_products_rejects(t):
    """Refused product changes."""
    return mq._rejected(mt.update_products(t, mq.product_changes(t), YEAR)["rejects"], "key")


# --------------------------------------------------------------------------------- orders
def cancel_requests(t):
    """Every open order's customer asks to cancel it, some twice; strangers ask for others."""
    o = t.adapter.raw("orders").filter(F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM", "5-LOW"))
    k = F.col("o_orderkey")
    asks = F.when(k % 10 == 3, F.array(F.col("o_custkey") + 1)).when(k % 10 == 4, F.array("o_custkey", "o_custkey")).otherwise(F.array("o_custkey"))
    return o.select(F.when(k % 50 == 9, F.format_string("NONE_%06d", k)).otherwise(F.format_string("ORDER_%06d", k)).alias("order_id"),
                    F.explode(asks).alias("c")).select("order_id", F.format_string("CUST_%06d", "c").alias("customer_id"))


_CANCELS = """
asked AS (
  SELECT CASE WHEN o_orderkey % 50 = 9 THEN printf('NONE_%06d', o_orderkey) ELSE printf('ORDER_%06d', o_orderkey) END AS order_id,
         printf('CUST_%06d', unnest(CASE o_orderkey % 10 WHEN 3 THEN [o_custkey + 1] WHEN 4 THEN [o_custkey, o_custkey] ELSE [o_custkey] END)) AS asker
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW')),
judged AS (
  SELECT a.order_id, concat_ws('; ', CASE WHEN o.order_id IS NULL THEN 'order_id: not found' END,
           CASE WHEN o.customer_id <> asker THEN 'customer_id: not the customer''s order' END,
           CASE WHEN o.order_status NOT IN ('created', 'approved') THEN 'order_status: can no longer be cancelled' END) AS broken
  FROM asked a LEFT JOIN c_orders o ON o.order_id = a.order_id),
final AS (
  SELECT order_id, CASE WHEN broken = '' AND row_number() OVER (PARTITION BY order_id, broken = '') > 1
                        THEN 'order_status: can no longer be cancelled' ELSE broken END AS errors FROM judged)"""


@register("cancel_requests", W(f"""
WITH {_CANCELS}
SELECT o.order_id, CASE WHEN o.order_id IN (SELECT order_id FROM final WHERE errors = '') THEN 'cancelled' ELSE o.order_status END AS order_status
FROM c_orders o"""))
def q_cancel_requests(t):
    """U9, the customer's cancel: only from created or approved, only one's own orders."""
    return mt.cancel_orders(t, cancel_requests(t), AS_OF)["orders"].select("order_id", "order_status")


@register("cancel_requests_rejects", W(f"WITH {_CANCELS}\nSELECT order_id AS key, errors FROM final WHERE errors <> ''"))
def q_cancel_requests_rejects(t):
    """Refused cancels."""
    return mq._rejected(mt.cancel_orders(t, cancel_requests(t), AS_OF)["rejects"], "key")


# ---------------------------------------------------------------------------------- stock
def stock_sequence(t):
    """Changes of well-stocked rows, by seller number modulo 3: a seller's place taken, then
    numbers that are refused and accepted; numbers that only fit after another change; a place
    that is often taken, then another, and a level that is no number."""
    k = F.regexp_extract("seller_id", r"(\d+)", 1).cast("bigint")
    n = F.col("quantity_in_stock")
    text = lambda c: c.cast("string")
    seller, stocked, reserved, level = "new_seller_id", "new_quantity_in_stock", "new_quantity_reserved", "new_min_stock_level"
    cases = [
        (k % 3 == 0, [(k * 10, {seller: F.lit(" SELLER_9001 ")}), (k * 10 + 5, {stocked: F.lit("-1")}), (k * 10 + 7, {stocked: text(n + 4), seller: F.lit(" ")})]),
        (k % 3 == 1, [(k * 10, {reserved: text(n + 1)}), (k * 10 + 1, {stocked: text(n + 50)}), (k * 10 + 2, {reserved: text(n + 1)})]),
        (k % 3 == 2, [(k * 10 + 3, {seller: F.lit("SELLER_9001")}), (k * 10 + 100000, {seller: F.lit("SELLER_9002"), level: F.when(k % 2 == 0, "abc")})])]
    rows = t.stock.filter(F.col("quantity_in_stock") >= 48).withColumn("key", F.col("stock_id"))
    ev = _events(rows, F.col("key"), cases, [seller, stocked, reserved, level]).withColumnRenamed("key", "stock_id")
    return ev.withColumns({f"new_{c}": F.lit(None).cast("string") for c in ("reorder_point", "warehouse_location", "stock_condition")})


_STOCK_SEQUENCE = r"""
asked AS (
  SELECT stock_id AS id, product_id, e.* FROM (SELECT stock_id, product_id, unnest(CASE k % 3
    WHEN 0 THEN [{'seq': k * 10, 's': 'SELLER_9001', 'a': NULL::INTEGER, 'b': NULL::INTEGER, 'bad': false}, {'seq': k * 10 + 5, 's': NULL, 'a': -1, 'b': NULL, 'bad': false},
                 {'seq': k * 10 + 7, 's': NULL, 'a': n + 4, 'b': NULL, 'bad': false}]
    WHEN 1 THEN [{'seq': k * 10, 's': NULL, 'a': NULL, 'b': n + 1, 'bad': false}, {'seq': k * 10 + 1, 's': NULL, 'a': n + 50, 'b': NULL, 'bad': false},
                 {'seq': k * 10 + 2, 's': NULL, 'a': NULL, 'b': n + 1, 'bad': false}]
    ELSE [{'seq': k * 10 + 3, 's': 'SELLER_9001', 'a': NULL, 'b': NULL, 'bad': false},
          {'seq': k * 10 + 100000, 's': 'SELLER_9002', 'a': NULL, 'b': NULL, 'bad': k % 2 = 0}] END) AS e
    FROM (SELECT *, CAST(regexp_extract(seller_id, '(\d+)', 1) AS BIGINT) AS k, quantity_in_stock AS n FROM c_stock WHERE quantity_in_stock >= 48))),
ev AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seq) AS k FROM asked WHERE NOT bad),
held AS (
  SELECT product_id, list({'id': stock_id, 's': seller_id, 'a': quantity_in_stock, 'b': quantity_reserved}) AS held
  FROM c_stock WHERE product_id IN (SELECT product_id FROM ev) GROUP BY product_id),
serial(product_id, k, errors, held) AS (
  SELECT product_id, 0::BIGINT, '', held FROM held
  UNION ALL
  SELECT product_id, k, errors, CASE WHEN errors <> '' THEN held ELSE list_transform(held, lambda r: CASE WHEN r.id = id
           THEN {'id': r.id, 's': coalesce(s, r.s), 'a': coalesce(a, r.a), 'b': coalesce(b, r.b)} ELSE r END) END
  FROM (SELECT *, concat_ws('; ',
          CASE WHEN coalesce(a, cur.a) - coalesce(b, cur.b) < 0 THEN 'quantity_available: negative (stock < reserved)' END,
          CASE WHEN s <> cur.s AND len(list_filter(held, lambda r: r.id <> id AND r.s = s)) > 0 THEN 'seller_id: the seller already stocks this product' END) AS errors
        FROM (SELECT e.product_id, e.k, e.id, e.s, e.a, e.b, x.held, list_filter(x.held, lambda r: r.id = e.id)[1] AS cur
              FROM serial x JOIN ev e ON e.product_id = x.product_id AND e.k = x.k + 1))),
after AS (SELECT r.* FROM (SELECT unnest(held) AS r FROM (SELECT arg_max(held, k) AS held FROM serial GROUP BY product_id))),
touched AS (SELECT DISTINCT e.id FROM ev e JOIN serial x ON x.product_id = e.product_id AND x.k = e.k WHERE x.errors = '')"""


@register("stock_sequence", W(f"""
WITH RECURSIVE {_STOCK_SEQUENCE}
SELECT c.stock_id, coalesce(f.s, c.seller_id) AS seller_id, c.product_id, coalesce(f.a, c.quantity_in_stock) AS quantity_in_stock,
       coalesce(f.b, c.quantity_reserved) AS quantity_reserved,
       CASE WHEN t.id IS NOT NULL THEN f.a - f.b ELSE c.quantity_available END AS quantity_available,
       CASE WHEN t.id IS NOT NULL THEN {AS_OF_SQL} ELSE c.last_updated END AS last_updated
FROM c_stock c LEFT JOIN after f ON f.id = c.stock_id LEFT JOIN touched t ON t.id = c.stock_id"""))
def q_stock_sequence(t):
    """Stock after changes that depend on each other."""
    t = t.computed_once("stock")
    return mt.update_stock(t, stock_sequence(t), AS_OF)["stock"].select(
        "stock_id", "seller_id", "product_id", "quantity_in_stock", "quantity_reserved", "quantity_available", "last_updated")


@register("stock_sequence_rejects", W(f"""
WITH RECURSIVE {_STOCK_SEQUENCE}
SELECT id AS key, 'min_stock_level: must be an integer' AS errors FROM asked WHERE bad
UNION ALL SELECT e.id, x.errors FROM ev e JOIN serial x ON x.product_id = e.product_id AND x.k = e.k WHERE x.errors <> ''"""))
def q_stock_sequence_rejects(t):
    """The refused ones of those changes."""
    t = t.computed_once("stock")
    return mq._rejected(mt.update_stock(t, stock_sequence(t), AS_OF)["rejects"], "key")


@register("stock_update_rejects", W("""
SELECT stock_id AS key, CASE WHEN quantity_in_stock % 4 = 1 THEN 'min_stock_level: must be an integer'
                             ELSE 'quantity_available: negative (stock < reserved)' END AS errors
FROM c_stock WHERE quantity_available <= 2 AND (quantity_in_stock % 4 = 1
  OR CASE WHEN quantity_in_stock >= 5 THEN quantity_in_stock + 50 - quantity_reserved ELSE -1 END < 0)"""))
def q_stock_update_rejects(t):
    """Refused stock changes."""
    t = t.computed_once("stock")
    return mq._rejected(mt.update_stock(t, mq.stock_changes(t), AS_OF)["rejects"], "key")


# -------------------------------------------------------------------------------- reviews
def review_sequence(t):
    """Three changes of every review: a score; a title and a bad or good score; a message."""
    k = F.regexp_extract("review_id", r"(\d+)", 1).cast("bigint")
    score, title, message = "new_review_score", "new_review_comment_title", "new_review_comment_message"
    cases = [(F.lit(True), [
        (k + 2, {score: F.when(k % 4 == 0, "6").otherwise("+3"), title: F.when(k % 3 == 0, "").otherwise(" Titre ")}),
        (k + 1, {score: F.lit("1"), message: F.lit("Premier")}),
        (k + 3, {message: F.when(k % 5 == 0, "")})])]
    rows = t.review_facts.select("review_id").withColumn("key", F.col("review_id"))
    return _events(rows, F.col("key"), cases, [score, title, message]).withColumnRenamed("key", "review_id")


_REVIEW_SEQUENCE = r"c_key AS (SELECT review_id, CAST(regexp_extract(review_id, '(\d+)', 1) AS BIGINT) AS k FROM c_order_reviews)"


@register("review_sequence", W(f"""
WITH {_REVIEW_SEQUENCE}
SELECT r.review_id, CASE WHEN k % 4 = 0 THEN 1 ELSE 3 END AS review_score,
       CASE WHEN k % 4 = 0 THEN r.review_comment_title WHEN k % 3 = 0 THEN NULL ELSE 'Titre' END AS review_comment_title,
       CASE WHEN k % 5 = 0 THEN NULL ELSE 'Premier' END AS review_comment_message
FROM c_order_reviews r JOIN c_key USING (review_id)"""))
def q_review_sequence(t):
    """Reviews after three changes of each, in order."""
    return mt.update_reviews(t, review_sequence(t))["order_reviews"].select("review_id", "review_score", "review_comment_title", "review_comment_message")


@register("review_sequence_rejects", W(f"WITH {_REVIEW_SEQUENCE}\nSELECT review_id AS key, 'review_score: integer from 1 to 5' AS errors FROM c_key WHERE k % 4 = 0"))
def q_review_sequence_rejects(t):
    """The refused ones of those changes."""
    return mq._rejected(mt.update_reviews(t, review_sequence(t))["rejects"], "key")


@register("add_reviews_rejects", W(f"""
WITH b AS ({mq.REVIEW_BATCH_SQL}),
chk AS (SELECT *, order_id IN (SELECT order_id FROM c_order_reviews) AS done, coalesce(review_score BETWEEN 1 AND 5, false) AS ok FROM b),
n AS (SELECT *, count(*) FILTER (WHERE ok AND NOT done) OVER (PARTITION BY order_id) AS c FROM chk)
SELECT order_id AS key, concat_ws('; ', CASE WHEN done THEN 'order_id: already reviewed' END, CASE WHEN NOT ok THEN 'review_score: integer from 1 to 5' END,
         CASE WHEN ok AND NOT done AND c > 1 THEN 'order_id: duplicated in batch' END) AS errors
FROM n WHERE done OR NOT ok OR c > 1"""))
def q_add_reviews_rejects(t):
    """Refused review proposals."""
    return mq._rejected(mt.add_reviews(t, mq.review_batch(t), AS_OF)["rejects"], "order_id")


def _unknown_too(ids, key, unknown):
    """The ids, and as many that don't exist."""
    return ids.unionByName(ids.select(F.concat(F.lit(unknown), F.col(key)).alias(key)))


@register("delete_reviews_rejects", W("""
SELECT 'X' || review_id AS key, 'review_id: not found' AS errors FROM c_order_reviews WHERE review_score = 3"""))
def q_delete_reviews_rejects(t):
    """Unknown reviews to delete."""
    ids = t.review_facts.filter(F.col("review_score") == 3).select("review_id")
    return mq._rejected(mt.delete_reviews(t, _unknown_too(ids, "review_id", "X"))["rejects"], "key")


@register("delete_customers_rejects", W(f"""
SELECT 'X' || customer_id AS key, 'customer_id: not found' AS errors FROM ({mq._GONE_CUSTOMERS})"""))
def q_delete_customers_rejects(t):
    """Unknown customers to delete."""
    return mq._rejected(mt.delete_customers(t, _unknown_too(mq._gone_customers(t), "customer_id", "X"))["rejects"], "key")


# -------------------------------------------------------------------------------- grammars
_FORMS = ("12d", "0x1p3", "1_000", " 12.5\t", "1e3", "abc", "-4", "3.", ".5", "1__0", "+7", "1,5", "nan", "")


@register("dq_number_forms", W(r"""
WITH f AS (SELECT p_partkey, (['12d', '0x1p3', '1_000', ' 12.5' || chr(9), '1e3', 'abc', '-4', '3.', '.5', '1__0', '+7', '1,5', 'nan', ''])[p_partkey % 14 + 1] AS text,
             (['x', 'x', '1000', '12.5', '1000', 'x', '-4', '3', '0.5', 'x', '7', 'x', 'nan', 'x'])[p_partkey % 14 + 1] AS said,
             p_partkey % 14 IN (2, 6, 10) AS whole FROM part)
SELECT p_partkey, text, nullif(TRY_CAST(said AS DOUBLE), 'nan'::DOUBLE) AS number, CASE WHEN whole THEN TRY_CAST(said AS DOUBLE) END AS integer,
       coalesce(TRY_CAST(said AS DOUBLE) > 0 AND said <> 'nan', false) AS positive, whole AND said <> '-4' AS non_negative,
       coalesce(whole AND TRY_CAST(said AS INTEGER) + 1000 BETWEEN 1970 AND 2026, false) AS a_year FROM f"""))
def q_dq_number_forms(t):
    """V2, V3, V4: what is a number, a positive one, a whole one from zero, a year; both outcomes."""
    p = t.adapter.raw("part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in _FORMS]), (F.col("p_partkey") % len(_FORMS) + 1).cast("int")).alias("text"))
    p = p.withColumn("later", (python_int("text") + 1000).cast("string"))
    return p.select("p_partkey", "text", F.nullif(python_float("text"), F.lit(float("nan"))).alias("number"), python_int("text").cast("double").alias("integer"),
                    qa.positive_number("text").alias("positive"), qa.non_negative_int("text").alias("non_negative"), qa.valid_year("later", YEAR).alias("a_year"))


def odd_products(t):
    """The stored products with years from 1940 on, and some without a name, weight or price."""
    k = F.regexp_extract("product_id", r"(\d+)", 1).cast("int")
    return t.products.select(
        "product_id", F.when(k % 7 == 0, F.lit(" \n")).otherwise(F.col("product_name")).alias("product_name"), "product_category", "product_platform", "product_esrb_rating",
        (k % 100 + 1940).cast("string").alias("product_release_year"), F.when(k % 11 == 0, F.lit(0)).otherwise(F.col("product_price")).alias("product_price"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("product_weight_g")).alias("product_weight_g"))


@register("dq_odd_products", W(r"""
WITH k AS (SELECT *, CAST(regexp_extract(product_id, '(\d+)', 1) AS INTEGER) AS k FROM c_products),
e AS (SELECT product_id, concat_ws('; ', CASE WHEN k % 7 = 0 THEN 'product_name: must not be empty' END,
        CASE WHEN NOT k % 100 + 1940 BETWEEN 1970 AND 2026 THEN 'product_release_year: out of range' END,
        CASE WHEN k % 11 = 0 THEN 'product_price: must be > 0' END, CASE WHEN k % 13 = 0 OR product_weight_g <= 0 THEN 'product_weight_g: must be > 0' END) AS errors FROM k)
SELECT product_id, errors, errors = '' AS is_valid FROM e"""))
def q_dq_odd_products(t):
    """V1, V2, V4: products of which many break a rule."""
    checked = qa.check(odd_products(t), qa.product_rules(YEAR))
    return checked.select("product_id", F.array_join("errors", "; ").alias("errors"), (F.size("errors") == 0).alias("is_valid"))


@register("orders_between_dates", W("""
SELECT order_id, customer_id, order_status, order_purchase_timestamp FROM c_orders
WHERE order_purchase_timestamp >= TIMESTAMP '1995-03-05 00:00:00' AND order_purchase_timestamp <= TIMESTAMP '1996-02-01 15:30:00'"""))
def q_orders_between_dates(t):
    """bounds in the forms that people type."""
    found = od.filter_orders(t.orders, date_from="3/5/1995", date_to="Feb 1, 1996 3:30 PM")
    return found.select("order_id", "customer_id", "order_status", "order_purchase_timestamp")


# -------------------------------------------------------------------------------- versions
@register("published_orders", W("""
SELECT o.order_id, CASE WHEN o.order_status = 'created' THEN 'approved' ELSE o.order_status END AS order_status, c.email, 2 AS version
FROM c_orders o LEFT JOIN c_customers c ON c.customer_id = o.customer_id"""))
def q_published_orders(t):
    """SNK2: two versions published and a third one that failed before its manifest: readers
    see the second, its orders with the customers of the first."""
    root = f"{stored_folder(t)}/shop-{uuid.uuid4().hex}"
    publish_tables(t, root, ("orders", "customers"))
    approved = F.when(F.col("order_status") == "created", "approved").otherwise(F.col("order_status"))
    second = read_tables(t.spark, root)
    publish_tables(second.with_tables(orders=second.orders.withColumn("order_status", approved)), root, ("orders",))
    log = VersionLog(t.spark, root)
    second.orders.limit(0).write.parquet(f"{log.root}/{log.new_folder('tables')}/orders")  # a third one, never finished
    now = read_tables(t.spark, root)
    return now.orders.select("order_id", "order_status", "customer_id").join(now.customers.select("customer_id", "email"), "customer_id", "left").select(
        "order_id", "order_status", "email", F.lit(log.current()[0]).alias("version"))
