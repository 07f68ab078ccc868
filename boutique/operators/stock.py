"""Stock views (Q6, F12, T4), cart pricing (Q13) and cart admission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutique.operators.catalog import stock_by_product
from boutique.sources.carts import normalise_carts
from boutique.sources.tables import Tables


def stock_view(t: Tables, sort: bool = True) -> DataFrame:
    """Stock rows with product name, platform and price; by product name, seller."""
    prod = t.products.select("product_id", "product_name", "product_platform", "product_price")
    df = t.stock.join(prod, "product_id", "left")
    if sort:
        df = df.orderBy(
            F.col("product_name").asc_nulls_last(), F.col("seller_id").asc_nulls_last(),
            F.col("stock_id"),
        )
    return df


def critical_stock(t: Tables) -> DataFrame:
    """stock rows whose available quantity is at or below the minimum level."""
    return stock_view(t, sort=False).filter(
        F.col("quantity_available") <= F.col("min_stock_level")
    )


def cart_pricing(t: Tables, carts: DataFrame) -> DataFrame:
    """Priced cart lines (unknown products drop) with the cart total."""
    lines = normalise_carts(carts).join(
        t.products.select("product_id", "product_name", "product_price"), "product_id", "inner"
    ).withColumn("line_total", F.col("product_price") * F.col("qty"))
    totals = lines.groupBy("cart_id").agg(F.sum("line_total").alias("cart_total"))
    return lines.join(totals, "cart_id", "inner").select(
        "cart_id", "product_id", "product_name", "product_price",
        F.col("qty").alias("quantity"), "line_total", "cart_total",
    )


def cart_admission(t: Tables, carts: DataFrame) -> DataFrame:
    """Each cart line against the product's summed availability; a cart is admitted
    only when every line fits (all-or-nothing)."""
    lines = normalise_carts(carts).join(stock_by_product(t.stock), "product_id", "left")
    lines = lines.select(
        "cart_id", "product_id", F.col("qty").alias("requested"),
        F.coalesce("stock_available", F.lit(0)).cast("bigint").alias("available"),
    ).withColumn("line_ok", F.col("requested") <= F.col("available"))
    verdict = lines.groupBy("cart_id").agg(F.bool_and("line_ok").alias("cart_ok"))
    return lines.join(verdict, "cart_id", "inner")


def cart_additions(t: Tables, carts: DataFrame, requests: DataFrame) -> DataFrame:
    """V15, adding to a cart: each request (cart_id, product_id, qty) is granted if what the
    cart already holds of the product plus the request does not exceed its availability.
    Requested quantities below one count as one, as in the shop."""
    held = normalise_carts(carts).select("cart_id", "product_id", F.col("qty").alias("in_cart"))
    asked = requests.select("cart_id", "product_id", F.greatest(F.col("qty"), F.lit(1)).alias("requested"))
    j = asked.join(held, ["cart_id", "product_id"], "left").join(stock_by_product(t.stock), "product_id", "left")
    in_cart, available = F.coalesce("in_cart", F.lit(0)), F.coalesce("stock_available", F.lit(0)).cast("bigint")
    granted = in_cart.cast("bigint") + F.col("requested") <= available
    return j.select(
        "cart_id", "product_id", in_cart.alias("in_cart"), "requested", available.alias("available"), granted.alias("granted"),
        F.when(granted, in_cart + F.col("requested")).otherwise(in_cart).alias("quantity"))
