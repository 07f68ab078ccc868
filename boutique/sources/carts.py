"""Carts as a relation: (cart_id, product_id, qty)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def carts_from_map(df: DataFrame, cart_col: str = "cart_id", map_col: str = "items") -> DataFrame:
    """Explode a ``map<product_id, qty>`` column into one row per cart line."""
    return df.select(
        F.col(cart_col).cast("bigint").alias("cart_id"),
        F.explode(map_col).alias("product_id", "qty"),
    ).select("cart_id", "product_id", F.col("qty").cast("int").alias("qty"))


def normalise_carts(carts: DataFrame) -> DataFrame:
    """One row per (cart, product) with the quantities added; non-positive lines dropped."""
    return (
        carts.groupBy("cart_id", "product_id")
        # More than an integer holds is more than any stock: clamped, not an error.
        .agg(F.least(F.sum(F.col("qty").cast("bigint")), F.lit(2_147_483_647).cast("bigint")).cast("int").alias("qty"))
        .filter(F.col("qty") > 0)
    )
