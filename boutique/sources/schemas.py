"""Explicit schemas of the nine shop tables plus carts (no inference on read)."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
# Accumulated amounts (a customer's total spend) outgrow DECIMAL(10,2) on large data.
AMOUNT = T.DecimalType(18, 2)
COORD = T.DecimalType(10, 7)
TS = T.TimestampNTZType()


def _s(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


S, I, B = T.StringType(), T.IntegerType(), T.ByteType()

CUSTOMERS = _s(
    ("customer_id", S, False), ("first_name", S, True), ("last_name", S, True),
    ("email", S, False), ("is_admin", B, True), ("phone", S, True),
    ("zip_code_prefix", I, False), ("city", S, True), ("state", S, True),
    ("address_line1", S, True), ("address_line2", S, True), ("customer_segment", S, True),
    ("registration_date", TS, True), ("last_purchase_date", TS, True),
    ("total_orders", I, True), ("total_spent", AMOUNT, True),
)
GEOLOCATION = _s(
    ("zip_code_prefix", I, False), ("city", S, True), ("state", S, True), ("region", S, True),
    ("latitude", COORD, True), ("longitude", COORD, True),
)
ORDERS = _s(
    ("order_id", S, False), ("customer_id", S, False), ("order_status", S, False),
    ("order_purchase_timestamp", TS, False), ("order_approved_at", TS, True),
    ("order_delivered_carrier_date", TS, True), ("order_delivered_customer_date", TS, True),
)
ORDER_ITEMS = _s(
    ("order_id", S, False), ("order_item_id", I, False), ("product_id", S, False),
    ("seller_id", S, False), ("shipping_limit_date", TS, True), ("price", MONEY, False),
    ("freight_value", MONEY, False), ("quantity", I, False),
)
ORDER_PAYMENTS = _s(
    ("order_id", S, False), ("payment_sequential", I, False), ("payment_type", S, False),
    ("payment_installments", I, True), ("payment_value", MONEY, False),
    ("payment_approved_at", TS, True),
)
ORDER_REVIEWS = _s(
    ("review_id", S, False), ("order_id", S, False), ("review_score", I, False),
    ("review_comment_title", S, True), ("review_comment_message", S, True),
    ("review_creation_date", TS, True),
)
PRODUCTS = _s(
    ("product_id", S, False), ("product_name", S, False), ("product_category", S, True),
    ("product_platform", S, True), ("product_esrb_rating", S, True),
    ("product_release_year", I, True), ("product_price", MONEY, False),
    ("product_weight_g", I, True), ("product_description", S, True),
    ("product_image", S, True), ("created_at", TS, True),
)
SELLERS = _s(
    ("seller_id", S, False), ("seller_name", S, False), ("seller_type", S, True),
    ("zip_code_prefix", I, False), ("city", S, True), ("state", S, True), ("created_at", TS, True),
)
STOCK = _s(
    ("stock_id", S, False), ("seller_id", S, False), ("product_id", S, False),
    ("quantity_in_stock", I, False), ("quantity_reserved", I, False),
    ("quantity_available", I, False), ("min_stock_level", I, True), ("reorder_point", I, True),
    ("last_updated", TS, True), ("warehouse_location", S, True), ("stock_condition", S, True),
)
CARTS = _s(("cart_id", T.LongType(), False), ("product_id", S, False), ("qty", I, False))

TABLES: dict[str, T.StructType] = {
    "customers": CUSTOMERS,
    "geolocation": GEOLOCATION,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "order_payments": ORDER_PAYMENTS,
    "order_reviews": ORDER_REVIEWS,
    "products": PRODUCTS,
    "sellers": SELLERS,
    "stock": STOCK,
}

# Primary / unique keys and foreign keys of the shop schema (checked by the key report).
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "customers": ("customer_id",),
    "geolocation": ("zip_code_prefix",),
    "orders": ("order_id",),
    "order_items": ("order_id", "order_item_id"),
    "order_payments": ("order_id", "payment_sequential"),
    "order_reviews": ("review_id",),
    "products": ("product_id",),
    "sellers": ("seller_id",),
    "stock": ("stock_id",),
}
UNIQUE_KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    "customers": (("email",),),
    "stock": (("seller_id", "product_id"),),
}
# (child table, child columns, parent table, parent columns)
FOREIGN_KEYS: tuple[tuple[str, tuple[str, ...], str, tuple[str, ...]], ...] = (
    ("customers", ("zip_code_prefix",), "geolocation", ("zip_code_prefix",)),
    ("orders", ("customer_id",), "customers", ("customer_id",)),
    ("order_items", ("order_id",), "orders", ("order_id",)),
    ("order_items", ("product_id",), "products", ("product_id",)),
    ("order_items", ("seller_id",), "sellers", ("seller_id",)),
    ("order_payments", ("order_id",), "orders", ("order_id",)),
    ("order_reviews", ("order_id",), "orders", ("order_id",)),
    ("sellers", ("zip_code_prefix",), "geolocation", ("zip_code_prefix",)),
    ("stock", ("seller_id",), "sellers", ("seller_id",)),
    ("stock", ("product_id",), "products", ("product_id",)),
)

# Column defaults of the shop tables (applied to inserted rows that leave them out).
# "now" marks a timestamp that takes the insert time.
DEFAULTS: dict[str, dict[str, object]] = {
    "customers": {"total_orders": 0, "total_spent": "0.00", "registration_date": "now"},
    "orders": {"order_status": "pending"},
    "order_items": {"freight_value": "0.00", "quantity": 1},
    "order_payments": {"payment_installments": 1},
    "order_reviews": {"review_creation_date": "now"},
    "products": {"created_at": "now"},
    "sellers": {"seller_type": "Standard", "created_at": "now"},
    "stock": {"quantity_in_stock": 0, "quantity_reserved": 0, "quantity_available": 0,
              "min_stock_level": 12, "reorder_point": 19, "last_updated": "now",
              "stock_condition": "new"},
}
