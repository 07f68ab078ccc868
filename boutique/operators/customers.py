"""Customers: statistics and segments (A5, A6, Q11) and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutique import constants as K
from boutique.functions.money import line_total
from boutique.functions.text import contains, search_term, yes_no
from boutique.sources.schemas import MONEY
from boutique.sources.tables import Tables


def segment(total_orders: Column, spent: Column, thresholds=K.SEGMENT_THRESHOLDS) -> Column:
    """Nouveau without live orders, else by (unrounded) spend; upper bounds exclusive."""
    t1, t2, t3 = (F.lit(x).cast("decimal(20,2)") for x in thresholds)
    c1, c2, c3, c4 = K.SEGMENTS
    return (
        F.when(F.coalesce(total_orders, F.lit(0)) == 0, K.SEGMENT_NEW)
        .when(spent < t1, c1)
        .when(spent < t2, c2)
        .when(spent < t3, c3)
        .otherwise(c4)
    )


def live_order_values(orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row per non-cancelled order that has lines: customer, timestamp, exact value.

    The cancelled test is ``<> 'cancelled'`` exactly, so other spellings count as live.
    """
    per_order = items.groupBy("order_id").agg(F.sum(line_total()).alias("value"))
    live = orders.filter(F.col("order_status") != K.CANCELLED).select(
        "order_id", "customer_id", "order_purchase_timestamp"
    )
    return live.join(per_order, "order_id", "inner")


def customer_stats(orders: DataFrame, items: DataFrame) -> DataFrame:
    """A5 per customer having live orders: count, exact spend, last purchase."""
    return live_order_values(orders, items).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("value").alias("spent"),
        F.max("order_purchase_timestamp").alias("last_purchase_date"),
    )


def customer_segments(t: Tables, thresholds=K.SEGMENT_THRESHOLDS,
                      customers: DataFrame | None = None) -> DataFrame:
    """Q11: statistics and segment for every customer (or for the given customer rows).

    With ``customers`` given (a refresh after some orders changed), the orders are first
    narrowed to those customers and the lines to those orders (semi joins), so only their
    lines are aggregated, not the whole order history.
    """
    orders, items = t.orders, t.order_items
    if customers is not None:
        cust = customers.select("customer_id")
        orders = orders.join(cust.distinct(), "customer_id", "left_semi")
        items = items.join(orders.select("order_id"), "order_id", "left_semi")
    else:
        cust = t.customers.select("customer_id")
    stats = customer_stats(orders, items)
    j = cust.join(stats, "customer_id", "left")
    spent = F.coalesce(F.col("spent"), F.lit(0).cast(MONEY))
    n = F.coalesce(F.col("total_orders"), F.lit(0)).cast("bigint")
    return j.select(
        "customer_id",
        n.alias("total_orders"),
        F.round(spent, 2).cast("double").alias("total_spent"),
        "last_purchase_date",
        segment(n, spent, thresholds).alias("customer_segment"),
    )


def customers_search(t: Tables, name=None, email=None, city=None, literal: bool = False) -> DataFrame:
    """Q14: customers whose first or last name, email and city contain the given terms."""
    df = t.customers
    n, e, c = search_term(name), search_term(email), search_term(city)
    if n:
        df = df.filter(contains("first_name", n, literal) | contains("last_name", n, literal))
    if e:
        df = df.filter(contains("email", e, literal))
    if c:
        df = df.filter(contains("city", c, literal))
    return df.drop("password_hash") if "password_hash" in df.columns else df


def customers_display(t: Tables) -> DataFrame:
    """Customer list as shown to an admin: a missing segment reads ``nouveau`` and
    the admin flag reads yes / no."""
    c = t.customers
    return c.select(
        "customer_id", "first_name", "last_name", "email", "phone", "city",
        F.coalesce("customer_segment", F.lit(K.SEGMENT_NEW)).alias("segment_label"),
        yes_no("is_admin").alias("admin_label"),
        "total_orders", F.col("total_spent").cast("double").alias("total_spent"),
    )
