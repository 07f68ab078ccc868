"""Product catalogue: filters (F1-F4, F18), stock per product (A2), ratings (A3, A4),
facets (D4, D5) and the store catalogue (Q5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutique.functions.bounds import parse_number
from boutique.functions.text import availability_label, contains, search_term
from boutique.sources.tables import Tables


def filter_products(
    products: DataFrame,
    product_id: str | None = None,
    name: str | None = None,
    category: str | None = None,
    min_price=None,
    max_price=None,
    platform: str | None = None,
    esrb: str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Optional product predicates; each blank/unparseable one is skipped."""
    df = products
    if product_id is not None:
        df = df.filter(F.col("product_id") == product_id)
    n, c = search_term(name), search_term(category)
    if n:
        df = df.filter(contains("product_name", n, literal))
    if c:
        df = df.filter(contains("product_category", c, literal))
    lo, hi = parse_number(min_price), parse_number(max_price)
    if lo is not None:
        df = df.filter(F.col("product_price") >= F.lit(lo))
    if hi is not None:
        df = df.filter(F.col("product_price") <= F.lit(hi))
    if platform:
        df = df.filter(F.col("product_platform") == platform)
    if esrb:
        df = df.filter(F.col("product_esrb_rating") == esrb)
    return df


def stock_by_product(stock: DataFrame) -> DataFrame:
    """A2: summed available quantity per product."""
    return stock.groupBy("product_id").agg(
        F.sum("quantity_available").cast("bigint").alias("stock_available")
    )


def product_ratings(t: Tables) -> DataFrame:
    """A3: mean score (1 decimal) and count per product, one count per matching order line."""
    lines = t.order_items.select("order_id", "product_id")
    rev = t.review_facts.select("order_id", "review_score")
    return (
        lines.join(rev, "order_id", "inner")
        .groupBy("product_id")
        .agg(
            F.round(F.avg("review_score"), 1).alias("avg_score"),
            F.count(F.lit(1)).alias("review_count"),
        )
    )


def product_scores(t: Tables, product_id: str | None = None) -> DataFrame:
    """A4: mean score and count per product, each review once per product; (null, 0) if none."""
    lines = t.order_items
    prods = t.products.select("product_id")
    if product_id is not None:
        lines = lines.filter(F.col("product_id") == product_id)
        prods = prods.filter(F.col("product_id") == product_id)
    rev = t.review_facts.select("review_id", "order_id", "review_score")
    agg = (
        # Joined first: the join's partitioning by order also serves the removal of repeats,
        # and only lines of reviewed orders take part in it.
        lines.select("order_id", "product_id").join(rev, "order_id", "inner")
        .dropDuplicates(["order_id", "product_id", "review_id"])
        .groupBy("product_id")
        .agg(F.round(F.avg("review_score"), 1).alias("avg_score"), F.count(F.lit(1)).alias("n"))
    )
    return prods.join(agg, "product_id", "left").select(
        "product_id", "avg_score", F.coalesce("n", F.lit(0)).alias("review_count")
    )


def product_facets(t: Tables) -> DataFrame:
    """Distinct non-null categories and platforms, as (facet, value)."""
    p = t.products
    cats = p.select(F.lit("category").alias("facet"), F.col("product_category").alias("value"))
    plats = p.select(F.lit("platform").alias("facet"), F.col("product_platform").alias("value"))
    return cats.unionByName(plats).dropna().distinct().orderBy("facet", "value")


def catalog(t: Tables, **filters) -> DataFrame:
    """Q5: filtered products with available stock, rating, star bucket and stock label."""
    prods = filter_products(t.products, **filters)
    j = prods.join(stock_by_product(t.stock), "product_id", "left").join(
        product_ratings(t), "product_id", "left"
    )
    avail = F.coalesce("stock_available", F.lit(0)).cast("bigint")
    return j.select(
        *prods.columns,
        avail.alias("stock_available"),
        "avg_score",
        F.coalesce("review_count", F.lit(0)).alias("review_count"),
        F.floor("avg_score").cast("int").alias("star_bucket"),
        availability_label(avail).alias("availability"),
    )
