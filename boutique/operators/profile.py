"""Wide profile (J9, A10, Q10): the 8-table join of orders and everything hanging off them,
summarised per numeric and datetime column like a ``describe()``: count, mean, sample
standard deviation, min, 25/50/75 % (linear interpolation between order statistics), max.

Scale notes:
* The join is never built. A row of a table appears in it as often as its order has other
  lines, payments and reviews (at least once each), so each table's histogram is built from
  its own rows, weighted: orders by lines x payments x reviews of the order, lines by
  payments x reviews, and so on; customers, products, sellers and stock by the sums of the
  weights of the orders or lines that refer to them. Only keys and counts are shuffled.
  Keys of customers, products, sellers and (product, seller) of stock are unique.
* A histogram holds (column index, value, count) of distinct values, combined map-side;
  moments are exact decimal sums over it. Percentiles are found by rank selection: the value
  range that holds a wanted rank is cut into ``RANGES`` parts, the counts of the parts say
  which one holds it, and that one is cut again. So the values are never sorted, a round
  shuffles at most ``RANGES`` counts per wanted rank and task, and no task holds a column's
  values (``percentile`` would, in its final merge).
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutique.session import materialize
from boutique.sources.tables import Tables

# (output name, source expression kind); order is the output order.
NUMERIC = (
    "is_admin", "customer_zip_code_prefix", "total_orders", "total_spent", "order_item_id",
    "price", "freight_value", "quantity", "product_release_year", "product_price",
    "product_weight_g", "seller_zip_code_prefix", "payment_sequential", "payment_installments",
    "payment_value", "review_score", "quantity_in_stock", "quantity_reserved",
    "quantity_available", "min_stock_level", "reorder_point",
)
DATETIME = (
    "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
    "order_delivered_customer_date", "registration_date", "last_purchase_date",
    "shipping_limit_date", "product_created_at", "seller_created_at", "payment_approved_at",
    "review_creation_date", "last_updated",
)
QUANTILES = (0.25, 0.5, 0.75)
#: Parts into which a round of the rank selection cuts a value range.
RANGES = 1024


def weighted_tables(t: Tables) -> list[DataFrame]:
    """Each table of the wide join with the number of its rows there, column ``_w``."""

    def per_order(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy("order_id").agg(F.count(F.lit(1)).alias(name))

    one = F.lit(1).cast("bigint")
    counts = (
        t.orders.select("order_id", "customer_id")
        .join(per_order(t.order_items, "_i"), "order_id", "left")
        .join(per_order(t.order_payments, "_p"), "order_id", "left")
        .join(per_order(t.review_facts, "_r"), "order_id", "left")
        .select("order_id", "customer_id", *[F.coalesce(c, one).alias(c) for c in ("_i", "_p", "_r")])
    )
    counts = materialize(counts)

    def of_order(table: DataFrame, *others: str) -> DataFrame:
        weight = F.col(others[0])
        for c in others[1:]:
            weight = weight * F.col(c)
        return table.join(counts.select("order_id", weight.alias("_w")), "order_id")

    lines = of_order(t.order_items, "_p", "_r")
    pairs = materialize(lines.groupBy("product_id", "seller_id").agg(F.sum("_w").alias("_w")))

    def referred(table: DataFrame, weights: DataFrame, *keys: str) -> DataFrame:
        return table.join(weights.groupBy(*keys).agg(F.sum("_w").alias("_w")), list(keys))

    buyers = counts.select("customer_id", (F.col("_i") * F.col("_p") * F.col("_r")).alias("_w"))
    return [
        of_order(t.orders, "_i", "_p", "_r"), lines, of_order(t.order_payments, "_i", "_r"), of_order(t.review_facts, "_i", "_p"),
        referred(t.customers.withColumnRenamed("zip_code_prefix", "customer_zip_code_prefix"), buyers, "customer_id"),
        referred(t.products.withColumnRenamed("created_at", "product_created_at"), pairs, "product_id"),
        referred(t.sellers.withColumnsRenamed({"zip_code_prefix": "seller_zip_code_prefix", "created_at": "seller_created_at"}), pairs, "seller_id"),
        referred(t.stock, pairs, "product_id", "seller_id"),
    ]


def _scaled(wide: DataFrame, name: str) -> tuple[Column, int]:
    """The column as an exact long in its smallest unit, and the unit's power of ten:
    cents for DECIMAL(10,2), microseconds for timestamps, the value for integers."""
    if name in DATETIME:
        return F.unix_micros(F.col(name).cast("timestamp")), 6
    dtype = wide.schema[name].dataType
    if isinstance(dtype, T.DecimalType):
        return (F.col(name) * F.lit(10 ** dtype.scale)).cast("bigint"), dtype.scale
    return F.col(name).cast("bigint"), 0


def histogram(table: DataFrame, names: list[str]) -> DataFrame:
    """(c, x, cnt): weighted counts of the values of the profiled columns of ``table``, as
    exact longs in each column's smallest unit; c is the place in ``names``."""
    own = [(i, n) for i, n in enumerate(names) if n in table.columns]
    pairs = ", ".join(f"{i}, _x{i}" for i, _ in own)
    long = table.select("_w", *[_scaled(table, n)[0].alias(f"_x{i}") for i, n in own]).selectExpr(
        "_w", f"stack({len(own)}, {pairs}) AS (c, x)").filter(F.col("x").isNotNull())
    return long.groupBy("c", "x").agg(F.sum("_w").alias("cnt"))


def order_statistics(hist: DataFrame, wanted: dict[int, list[int]], ranges: int = RANGES) -> dict[tuple[int, int], int]:
    """{(c, rank): value} of the 0-based ranks ``wanted`` of each column of a histogram (c, x,
    cnt). A round narrows every wanted rank's range of values by ``ranges``; it ends when the
    range holds one value. Only the ranges (one per wanted rank at most) reach the driver."""
    found: dict[tuple[int, int], int] = {}
    # (c, low, high, rows below low, ranks): None for an open range, the column's whole one.
    limits = {r["c"]: r for r in hist.filter(F.col("c").isin(list(wanted))).groupBy("c").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()}
    open_ = [(c, limits[c]["low"], limits[c]["high"], 0, sorted(set(ranks))) for c, ranks in wanted.items() if c in limits]
    spark = hist.sparkSession
    while open_:
        single = [o for o in open_ if o[1] == o[2]]
        found |= {(c, r): low for c, low, _, _, ranks in single for r in ranks}
        open_ = [o for o in open_ if o[1] < o[2]]
        if not open_:
            break
        # Widths are exact: longs may span more than a double can tell apart.
        cuts = spark.createDataFrame([(k, c, Decimal(low), Decimal(high), Decimal(-(-(high - low + 1) // ranges))) for k, (c, low, high, _, _) in enumerate(open_)],
                                     "k int, c int, low decimal(20,0), high decimal(20,0), width decimal(20,0)")
        asked = spark.createDataFrame([(k, r, r - below) for k, (_, _, _, below, ranks) in enumerate(open_) for r in ranks], "k int, r long, within long")
        value = F.col("x").cast("decimal(20,0)")
        inside = hist.join(F.broadcast(cuts), "c").filter((value >= F.col("low")) & (value <= F.col("high")))
        part = F.floor((value - F.col("low")) / F.col("width")).cast("int")
        counted = inside.groupBy("k", part.alias("part")).agg(F.sum("cnt").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("k").orderBy("part"))  # `ranges` rows at most
        placed = counted.withColumn("end", upto).withColumn("begin", F.col("end") - F.col("n"))
        hit = placed.join(F.broadcast(asked), "k").filter((F.col("begin") <= F.col("within")) & (F.col("within") < F.col("end")))
        narrowed: dict[tuple, list[int]] = {}
        for r in hit.select("k", "low", "high", "begin", "r").collect():
            c, _, _, below, _ = open_[r["k"]]
            narrowed.setdefault((c, r["low"], r["high"], below + r["begin"]), []).append(r["r"])
        open_ = [(*key, sorted(ranks)) for key, ranks in narrowed.items()]
    return found


def describe(tables: list[DataFrame], numeric=NUMERIC, datetime=DATETIME, ranges: int = RANGES) -> DataFrame:
    """A10 over weighted tables (column ``_w``): one row per column (datetimes in epoch
    seconds, no std). Sums are taken exactly as decimals over the histogram and scaled back."""
    names = list(numeric) + list(datetime)
    scaled = [next(_scaled(d, n) for d in tables if n in d.columns) for n in names]
    scale_of = F.create_map(*[x for i, (_, sc) in enumerate(scaled) for x in (F.lit(i), F.lit(sc))])
    hist = histogram(tables[0], names)
    for d in tables[1:]:
        hist = hist.unionByName(histogram(d, names))
    hist = materialize(hist)

    xd = F.col("x").cast("decimal(38,0)")
    moments = hist.groupBy("c").agg(
        F.sum("cnt").alias("n"),
        F.sum(xd * F.col("cnt")).alias("s1u"),
        F.sum(F.when(F.col("c") < len(numeric), xd * xd * F.col("cnt"))).alias("s2u"),
        F.min("x").alias("mnu"),
        F.max("x").alias("mxu"),
    ).withColumn("sc", scale_of[F.col("c")])
    moments = materialize(moments)

    # Target ranks: for each column and quantile the two order statistics around p*(n-1).
    counts = {r["c"]: r["n"] for r in moments.select("c", "n").collect()}  # a row per profiled column
    wanted = {c: sorted({min(math.floor(p * (n - 1)) + k, n - 1) for p in QUANTILES for k in (0, 1)}) for c, n in counts.items()}
    statistics = order_statistics(hist, wanted, ranges)
    hit = hist.sparkSession.createDataFrame([(c, r, x) for (c, r), x in statistics.items()], "c int, r long, xu long")
    targets = moments.select(
        "c", "n", F.explode(F.array(*[F.lit(p) for p in QUANTILES])).alias("p")
    ).withColumn("pos", F.col("p") * (F.col("n") - 1).cast("double")).withColumn(
        "lo", F.floor("pos").cast("bigint")
    ).withColumn("frac", F.col("pos") - F.col("lo").cast("double"))
    q = targets.alias("t").join(
        hit.alias("a"), (F.col("a.c") == F.col("t.c")) & (F.col("a.r") == F.col("t.lo")), "left"
    ).join(
        hit.alias("b"), (F.col("b.c") == F.col("t.c")) & (F.col("b.r") == F.col("t.lo") + 1), "left"
    ).select(
        F.col("t.c").alias("c"), F.col("t.p").alias("p"),
        F.col("a.xu").alias("au"), F.coalesce(F.col("b.xu"), F.col("a.xu")).alias("bu"),
        F.col("t.frac").alias("frac"),
    ).withColumn("sc", scale_of[F.col("c")])
    unit = F.pow(F.lit(10.0), F.col("sc"))
    va, vb = F.col("au") / unit, F.col("bu") / unit
    q = q.withColumn("q", va + (vb - va) * F.col("frac"))
    qs = q.groupBy("c").agg(
        *[F.max(F.when(F.col("p") == p, F.col("q"))).alias(f"p{int(p * 100)}") for p in QUANTILES]
    )

    def exact(col: str, power: int) -> Column:
        """Scaled decimal sum back in the column's unit (exact), as double."""
        branches = None
        for k in sorted({sc for _, sc in scaled}):
            e = F.col(col) * F.lit(10 ** -(k * power)).cast(f"decimal({k * power + 1},{k * power})") \
                if k else F.col(col)
            branches = (F.when(F.col("sc") == k, e.cast("double")) if branches is None
                        else branches.when(F.col("sc") == k, e.cast("double")))
        return branches

    n = F.col("n").cast("double")
    s1 = exact("s1u", 1)
    s2 = exact("s2u", 2)
    var = (s2 - s1 * s1 / n) / (n - 1)
    name_map = F.create_map(*[x for i, nm in enumerate(names) for x in (F.lit(i), F.lit(nm))])
    n_numeric = len(numeric)

    def r6(c: Column) -> Column:
        return F.round(c, 6)

    # Every profiled column gets a row, also when it holds no value at all (count 0).
    columns = hist.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("c"))
    out = columns.join(moments, "c", "left").join(qs.drop("sc"), "c", "left").select(
        "c",
        name_map[F.col("c")].alias("column_name"),
        F.when(F.col("c") < n_numeric, "numeric").otherwise("datetime").alias("kind"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("count"),
        r6(s1 / n).alias("mean"),
        F.when((F.col("c") < n_numeric) & (F.col("n") > 1), r6(F.sqrt(F.greatest(var, F.lit(0.0)))))
        .alias("std"),
        r6(F.col("mnu") / F.pow(F.lit(10.0), F.col("sc"))).alias("min"),
        r6(F.col("p25")).alias("p25"),
        r6(F.col("p50")).alias("p50"),
        r6(F.col("p75")).alias("p75"),
        r6(F.col("mxu") / F.pow(F.lit(10.0), F.col("sc"))).alias("max"),
    )
    return out.orderBy("c").drop("c")


def wide_profile(t: Tables, ranges: int = RANGES) -> DataFrame:
    """Q10: describe() of the wide join."""
    return describe(weighted_tables(t), ranges=ranges)
