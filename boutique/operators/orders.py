"""Orders: line totals, per-order totals, order lists and order lines.

Order totals are pre-aggregated per order before any join (partial aggregation runs
map-side, so even an order holding a third of all lines is summed in parallel), and the
customer columns are joined on the already-aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutique import constants as K
from boutique.functions.bounds import parse_number, parse_timestamp
from boutique.functions.money import as_amount, line_total
from boutique.functions.text import contains, search_term
from boutique.sources.schemas import MONEY
from boutique.sources.tables import Tables

ORDER_COLUMNS = (
    "order_id", "customer_id", "order_status", "order_purchase_timestamp",
    "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date",
)


def order_totals(items: DataFrame) -> DataFrame:
    """A1: exact decimal sum of line totals per order (order_id, total_dec)."""
    return items.groupBy("order_id").agg(F.sum(line_total()).alias("total_dec"))


def _with_total(orders: DataFrame, items: DataFrame) -> DataFrame:
    j = orders.select(*ORDER_COLUMNS).join(order_totals(items), "order_id", "left")
    return j.withColumn(
        "total_price", as_amount(F.coalesce(F.col("total_dec"), F.lit(0).cast(MONEY)))
    ).drop("total_dec")


def _newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("order_purchase_timestamp").desc(), F.col("order_id"))


def orders_with_totals(t: Tables, sort: bool = True) -> DataFrame:
    """Q1: every order with its total (0 when it has no lines) and the buyer's name and email."""
    cust = t.customers.select("customer_id", "first_name", "last_name", "email")
    df = _with_total(t.orders, t.order_items).join(cust, "customer_id", "left")
    df = df.select(*ORDER_COLUMNS, "total_price", "first_name", "last_name", "email")
    return _newest_first(df) if sort else df


def _ts_literal(d) -> "F.Column":
    """A zone-less timestamp literal (no conversion through the Python process zone)."""
    return F.lit(d.isoformat(sep=" ")).cast("timestamp_ntz")


def filter_orders(
    df: DataFrame,
    status: str | None = None,
    customer_name: str | None = None,
    min_total=None,
    max_total=None,
    date_from=None,
    date_to=None,
    inclusive_end_day: bool = False,
) -> DataFrame:
    """F8-F11 on a Q1 result. Unparseable bounds drop their predicate (as the shop does).

    ``date_to`` compares with midnight of that day, so that day itself is excluded unless
    ``inclusive_end_day`` is set.
    """
    if status:
        df = df.filter(F.col("order_status") == status)
    name = search_term(customer_name)
    if name:
        df = df.filter(contains("first_name", name) | contains("last_name", name))
    lo, hi = parse_number(min_total), parse_number(max_total)
    if lo is not None:
        df = df.filter(F.col("total_price") >= F.lit(lo))
    if hi is not None:
        df = df.filter(F.col("total_price") <= F.lit(hi))
    d0, d1 = parse_timestamp(date_from), parse_timestamp(date_to)
    ts = F.col("order_purchase_timestamp")
    if d0 is not None:
        df = df.filter(ts >= _ts_literal(d0))
    if d1 is not None:
        end = _ts_literal(d1)
        df = df.filter(ts < F.date_add(end, 1) if inclusive_end_day else ts <= end)
    return df


def orders_filtered(t: Tables, **criteria) -> DataFrame:
    """Q2: Q1 narrowed by the optional criteria of :func:`filter_orders`."""
    return _newest_first(filter_orders(orders_with_totals(t, sort=False), **criteria))


def customer_orders(t: Tables, customer_id: str | None = None) -> DataFrame:
    """Q3 / F16: orders with totals, per customer (all customers when no id is given)."""
    o = t.orders
    if customer_id is not None:
        o = o.filter(F.col("customer_id") == customer_id)
    return _newest_first(_with_total(o, t.order_items))


def order_lines(t: Tables, order_id: str | None = None) -> DataFrame:
    """Order lines with product info, line total and the order's total."""
    items = t.order_items
    if order_id is not None:
        items = items.filter(F.col("order_id") == order_id)
    prod = t.products.select("product_id", "product_name", "product_platform", "product_image")
    lines = items.join(prod, "product_id", "left").select(
        "order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date",
        F.coalesce("price", F.lit(0).cast(MONEY)).cast("double").alias("price"),
        F.coalesce("freight_value", F.lit(0).cast(MONEY)).cast("double").alias("freight_value"),
        F.coalesce("quantity", F.lit(1)).alias("quantity"),
        "product_name", "product_platform", "product_image",
        as_amount(line_total()).alias("line_total"),
    )
    totals = order_totals(items).select("order_id", as_amount(F.col("total_dec")).alias("order_total"))
    return lines.join(totals, "order_id", "left")


def cancellable_orders(t: Tables) -> DataFrame:
    """orders a customer may still cancel."""
    return t.orders.filter(F.col("order_status").isin(*K.CANCELLABLE_STATUSES))
