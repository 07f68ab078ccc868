"""Reviews: per-product review lists (J5, J6, Q7), recent reviews (T3, J8, W1, P4, Q8),
review of each order (F17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutique import constants as K
from boutique.functions.text import preview
from boutique.session import materialize
from boutique.sources.tables import Tables

REVIEW_COLUMNS = (
    "review_id", "order_id", "review_score", "review_comment_title",
    "review_comment_message", "review_creation_date",
)


def _with_authors(t: Tables, reviews: DataFrame) -> DataFrame:
    """Attach the buyer (customer id and name) to review rows: reviews -> orders ->
    customers, so only the reviewed orders are looked up."""
    o = t.orders.select("order_id", "customer_id")
    c = t.customers.select("customer_id", "first_name", "last_name")
    return reviews.join(o, "order_id", "left").join(c, "customer_id", "left")


FACTS = tuple(c for c in REVIEW_COLUMNS if c != "review_comment_message")


def _with_messages(t: Tables, reviews: DataFrame) -> DataFrame:
    """Attach the review texts, after everything else has been decided without them."""
    return reviews.join(t.order_reviews.select("review_id", "review_comment_message"), "review_id", "left")


def product_reviews(t: Tables, product_id: str | None = None) -> DataFrame:
    """Q7: reviews of the orders holding each product (each review once per product),
    with the author's name, newest first.

    A review is one row, with the list of its order's products, until the rows are in order;
    only then is it repeated for each product. So its message is moved once, however many
    products its order holds.
    """
    items = t.order_items
    if product_id is not None:
        items = items.filter(F.col("product_id") == product_id)
    items = items.join(t.review_facts.select("order_id"), "order_id", "left_semi").select("order_id", F.struct(F.col("product_id")).alias("_p"))
    held = items.groupBy("order_id").agg(F.sort_array(F.collect_set("_p")).alias("_products"))
    rows = t.review_facts.select(*FACTS).dropDuplicates(["order_id", "review_id"]).join(held, "order_id")
    messages = t.review_rows.drop(*[c for c in FACTS if c != "review_id"])
    df = t.with_messages(_with_authors(t, rows).join(messages, "review_id", "left")).orderBy(F.col("review_creation_date").desc(), "review_id")
    return df.withColumn("_product", F.explode("_products")).select(
        "order_id", F.col("_product")["product_id"].alias("product_id"), *[c for c in REVIEW_COLUMNS if c != "order_id"], "customer_id", "first_name", "last_name")


#: A product id that packs: the shop's prefix and up to this many digits.
PACKED_DIGITS = 9
_PACKED = rf"^{K.ID_FORMATS['product_id'][0]}[0-9]{{1,{PACKED_DIGITS}}}$"


def _pack(line: str, product: str) -> Column:
    """(line number, product id) as one long that orders as they do: the id's digits are read
    as a number of base 11, a missing one below 0, so that ids of any width compare as text."""
    digits = F.translate(F.substring(product, len(K.ID_FORMATS["product_id"][0]) + 1, PACKED_DIGITS), "0123456789", "123456789a")
    return F.col(line).cast("bigint") * 11**PACKED_DIGITS + F.conv(F.rpad(digits, PACKED_DIGITS, "0"), 11, 10).cast("bigint")


def _unpack(packed: str) -> Column:
    digits = F.lower(F.conv((F.col(packed) % 11**PACKED_DIGITS).cast("string"), 10, 11))
    digits = F.rtrim(F.lpad(digits, PACKED_DIGITS, "0"), F.lit("0"))
    return F.concat(F.lit(K.ID_FORMATS["product_id"][0]), F.translate(digits, "123456789a", "0123456789"))


def first_product_per_order(items: DataFrame) -> DataFrame:
    """The product of each order's first line (lowest line number, then product id).

    Line number and id are packed into one long, so a single hash aggregate with map-side
    combining decides. Tables in which some line has another kind of id, or no valid number,
    take two aggregates instead: the lowest number first, then the id among its lines.
    """
    lines = items.select("order_id", "order_item_id", "product_id")
    packs = F.coalesce(F.col("product_id").rlike(_PACKED) & (F.col("order_item_id") >= 0), F.lit(False))
    if lines.filter(~packs).isEmpty():
        least = lines.groupBy("order_id").agg(F.min(_pack("order_item_id", "product_id")).alias("_least"))
        return least.select("order_id", _unpack("_least").alias("product_id"))
    lowest = lines.groupBy("order_id").agg(F.min("order_item_id").alias("_first"))
    first = lines.join(lowest, "order_id").filter(F.col("order_item_id").eqNullSafe(F.col("_first")))
    return first.groupBy("order_id").agg(F.min("product_id").alias("product_id"))


def recent_reviews(t: Tables, limit: int = K.RECENT_REVIEWS_LIMIT) -> DataFrame:
    """Q8: the ``limit`` newest reviews with author, first product and a message preview.

    The top-k runs once, on (date, id) alone, and is materialized. Texts, orders, customers,
    order lines and products are then only looked up for its rows; whether a side is
    broadcast is left to the optimizer, which knows the sizes.
    """
    top = materialize(
        t.review_facts.select(*FACTS)
        .orderBy(F.col("review_creation_date").desc(), F.col("review_id").desc())
        .limit(limit)
    )
    keys = top.select("order_id")
    messages = t.order_reviews.select("order_id", "review_id", "review_comment_message").join(keys, "order_id", "left_semi").drop("order_id")
    orders = t.orders.select("order_id", "customer_id").join(keys, "order_id", "left_semi")
    customers = t.customers.select("customer_id", "first_name", "last_name").join(
        orders.select("customer_id"), "customer_id", "left_semi")
    first = first_product_per_order(
        t.order_items.select("order_id", "order_item_id", "product_id").join(keys, "order_id", "left_semi"))
    products = t.products.select("product_id", "product_name", "product_image").join(
        first.select("product_id"), "product_id", "left_semi")
    df = (
        top.join(messages, "review_id", "left")
        .join(orders, "order_id", "left")
        .join(customers, "customer_id", "left")
        .join(first, "order_id", "left")
        .join(products, "product_id", "left")
    )
    return df.withColumn("message_preview", preview("review_comment_message")).orderBy(
        F.col("review_creation_date").desc(), F.col("review_id").desc()
    )


def order_review(t: Tables) -> DataFrame:
    """F17 (bulk): each order with its review, if any (first by review id). The choice is
    made on the ids; the chosen reviews' texts are joined to it."""
    first = t.review_facts.groupBy("order_id").agg(F.min("review_id").alias("review_id"))
    r = _with_messages(t, first.join(t.review_facts.select(*[c for c in FACTS if c != "order_id"]), "review_id"))
    return t.orders.select("order_id", "customer_id", "order_status").join(
        r.select("order_id", *[c for c in REVIEW_COLUMNS if c != "order_id"]), "order_id", "left")
