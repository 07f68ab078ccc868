"""Dashboard figures: admin KPIs (A7, Q12) and revenue / active customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutique import constants as K
from boutique.functions.money import line_total
from boutique.sources.tables import Tables


def kpis(t: Tables) -> DataFrame:
    """Q12: one row with the product, customer and order counts and the critical-stock count.

    Each figure is a scalar subquery over its own table (four small aggregates, no join).
    """
    def n(df: DataFrame):
        return df.select(F.count(F.lit(1))).scalar()

    critical = t.stock.filter(F.col("quantity_available") <= F.col("min_stock_level"))
    return t.spark.range(1).select(
        n(t.products).alias("nb_products"),
        n(t.customers).alias("nb_customers"),
        n(t.orders).alias("nb_orders"),
        n(critical).alias("nb_critical"),
    )


def revenue(t: Tables, grain: str = "day") -> DataFrame:
    """Q15: per period (day or month) of non-cancelled orders: revenue, order count and
    active customers (customers with at least one such order in the period).

    Aggregated in two steps (per customer and period, then per period) so no distinct
    aggregate is needed.
    """
    per_order = t.order_items.groupBy("order_id").agg(F.sum(line_total()).alias("value"))
    live = t.orders.filter(F.col("order_status") != K.CANCELLED).select(
        "order_id", "customer_id",
        F.date_trunc(grain, "order_purchase_timestamp").cast("timestamp_ntz").alias("period"),
    )
    j = live.join(per_order, "order_id", "left")
    per_cust = j.groupBy("period", "customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("value", F.lit(0))).alias("v")
    )
    return (
        per_cust.groupBy("period")
        .agg(
            F.sum("v").cast("double").alias("revenue"),
            F.sum("n").alias("orders"),
            F.count(F.lit(1)).alias("active_customers"),
        )
        .orderBy("period")
    )
