"""Registered streaming query (S1) and its oracle (batch Q11 over customers with orders)."""

from __future__ import annotations

from boutique.plans.registry import ORACLE, QUERIES, present
from boutique.session import configure
from boutique.plans.shop_queries import _segments_sql
from boutique.streaming.customer_stats import customer_stats_from_stream


def q_customer_stats_stream(spark, sf_dir):
    """Customer statistics maintained by a stream of order events."""
    configure(spark)
    return present(customer_stats_from_stream(spark, sf_dir))


QUERIES["customer_stats_stream"] = q_customer_stats_stream
ORACLE["customer_stats_stream"] = (
    "SELECT * FROM (" + _segments_sql(200, 1000, 2000) + ") q "
    "WHERE customer_id IN (SELECT printf('CUST_%06d', o_custkey) FROM orders)"
)
