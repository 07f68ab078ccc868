"""Stock allocation for carts (W2, J13, W3) and order placement from carts (U8).

The shop serves a cart line from the product's stock rows largest-available first, taking
``min(available, remaining)`` from each. For a batch of carts, lay the demand of each
product on a line in cart order (intervals ``[d0, d0+qty)``) and the supply in stock order
(intervals ``[s0, s0+available)``): the quantity a cart takes from a stock row is the
overlap of the two intervals. The overlaps are found without pairing every cart with
every stock row of a product: the interval starts of both sides are merged into one
ordered list of breakpoints; between two consecutive breakpoints exactly one demand and
one supply interval are active, identified by running counts; each such segment is one
(cart line, stock row, quantity) allocation. All ordered steps use ``running_sum``, so a
product holding a large share of the demand is still spread over many tasks.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutique import constants as K
from boutique.functions.ids import format_id, id_number
from boutique.operators.components import connected
from boutique.operators.ordered import max_id_number, row_numbers, running_sum
from boutique.sources.carts import normalise_carts
from boutique.sources.schemas import MONEY
from boutique.session import materialize, ship_package
from boutique.sources.tables import Tables

def supply_order():
    """Stock rows of a product are used largest-available first, ties by stock id."""
    return (F.col("quantity_available").desc(), F.col("stock_id").asc())


def supply_intervals(stock: DataFrame, pieces: int | None = None) -> DataFrame:
    """Usable stock rows with their interval start ``s0`` and rank ``s_rank`` per product."""
    s = stock.filter(F.col("quantity_available") > 0).select(
        "stock_id", "seller_id", "product_id", "quantity_available"
    )
    s = running_sum(
        s, {"s0": F.col("quantity_available").cast("bigint"), "s_rank": F.lit(1)},
        supply_order(), ["product_id"], inclusive=True, per_piece=pieces,
    )
    return materialize(s.withColumn("s0", F.col("s0") - F.col("quantity_available")).withColumn(
        "s_rank", F.col("s_rank").cast("bigint")
    ))


#: Lines that one task decides serially (about a second's work); a parameter of the session
#: (``boutique.serialLines``), so that tests can make it small.
SERIAL_LINES = 500_000


def _serial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Carts in their order, each against what the admitted ones before it have left; the
    rows of a cart follow each other. ``room``: what a line's product had at the start."""
    left: dict[str, int] = {}

    def decide(cart: int, lines: list[tuple[str, int, int]]) -> bool:
        if any(qty > left.get(product, room) for product, qty, room in lines):
            return False
        for product, qty, room in lines:
            left[product] = left.get(product, room) - qty
        return True

    cart, lines = None, []
    for batch in batches:
        carts, verdicts = [], []
        for own, *line in zip(*(batch.column(c).to_pylist() for c in ("cart_id", "product_id", "qty", "room")), strict=True):
            if own != cart and lines:
                carts.append(cart)
                verdicts.append(decide(cart, lines))
                lines = []
            cart = own
            lines.append(tuple(line))
        yield pa.RecordBatch.from_arrays([pa.array(carts, pa.int64()), pa.array(verdicts, pa.bool_())], names=["cart_id", "admitted"])
    if lines:
        yield pa.RecordBatch.from_arrays([pa.array([cart], pa.int64()), pa.array([decide(cart, lines)], pa.bool_())], names=["cart_id", "admitted"])


def _serial_by_component(key: tuple[pa.Scalar, ...], lines: pa.Table) -> pa.Table:
    ordered = lines.select(["cart_id", "product_id", "qty", "room"]).sort_by("cart_id")
    return pa.Table.from_batches(_serial(iter(ordered.to_batches())), pa.schema([("cart_id", pa.int64()), ("admitted", pa.bool_())]))


_VERDICT = "cart_id long, admitted boolean"


def _contended(lines: DataFrame, room: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, open lines): what follows from each product's total alone.

    A cart that asks more than a product has left is rejected. Of the other carts' demand, a
    product that has enough for all of it decides nothing, so its lines are done with; a cart
    with no other lines is admitted. What stays open are lines on scarce products.
    """
    asked = materialize(lines.join(room, "product_id", "left").withColumn("room", F.coalesce("room", F.lit(0).cast("bigint"))))
    fits = asked.groupBy("cart_id").agg(F.bool_and(F.col("qty") <= F.col("room")).alias("fits"))
    asked = asked.join(fits, "cart_id")
    scarce = asked.filter("fits").groupBy("product_id").agg(F.sum("qty").alias("demand"), F.max("room").alias("has")).filter("demand > has")
    marked = asked.join(scarce.select("product_id", F.lit(True).alias("scarce")), "product_id", "left")
    marked = materialize(marked.select("cart_id", "product_id", "qty", "room", "fits", (F.col("fits") & F.coalesce("scarce", F.lit(False))).alias("open")))
    judged = marked.groupBy("cart_id").agg(F.bool_and("fits").alias("admitted"), F.bool_or("open").alias("open"))
    return judged.filter(~F.col("open")).select("cart_id", "admitted"), marked.filter("open").select("cart_id", "product_id", "qty", "room")


def admit_carts(lines: DataFrame, stock: DataFrame, pieces: int | None = None, serial_lines: int | None = None) -> DataFrame:
    """Serial checkout (V15, U8): carts in order of their id; a cart is admitted when, for
    every line, what the admitted carts before it have left of the product suffices.

    Availability is the sum of the product's stock rows as they are; a product without stock
    rows has none. Only carts that contend for a scarce product need an order
    (:func:`_contended`). Up to ``serial_lines`` of their lines are decided by one task, cart
    after cart. Beyond that, carts are split into components (carts that share a scarce
    product, directly or through others), which don't affect each other: every component's
    first ``serial_lines`` lines are decided in one task, all components in parallel; their
    takings come off the products, and what is still contended goes on. So the rounds are as
    many as the largest component has times ``serial_lines`` lines: the order of one
    component is serial by definition.
    Returns ``(cart_id, admitted)``.
    """
    ship_package(lines.sparkSession)
    most = serial_lines or int(lines.sparkSession.conf.get("boutique.serialLines", str(SERIAL_LINES)))
    lines = lines.select(F.col("cart_id").cast("bigint").alias("cart_id"), "product_id", F.col("qty").cast("bigint").alias("qty"))
    room = stock.join(lines.select("product_id").distinct(), "product_id", "left_semi").groupBy("product_id").agg(
        F.sum("quantity_available").cast("bigint").alias("room"))
    verdicts, open_ = _contended(lines, room)
    while (n := open_.count()) > most:
        open_, decided = _first_lines_of_components(open_, n, most, pieces)
        verdicts = verdicts.unionByName(decided)
        taken = open_.join(decided.filter("admitted"), "cart_id", "left_semi").groupBy("product_id").agg(F.sum("qty").alias("taken"))
        room = materialize(open_.select("product_id", "room").distinct().join(taken, "product_id", "left").select(
            "product_id", (F.col("room") - F.coalesce("taken", F.lit(0))).alias("room")))
        left = open_.join(decided, "cart_id", "left_anti").drop("room")
        more, open_ = _contended(left, room)
        verdicts = verdicts.unionByName(more)
    last = open_.repartition(1).sortWithinPartitions("cart_id").mapInArrow(_serial, _VERDICT)  # `most` rows at most
    return materialize(verdicts.unionByName(last))


def _first_lines_of_components(open_: DataFrame, n: int, most: int, pieces: int | None) -> tuple[DataFrame, DataFrame]:
    """(open lines, verdicts): the carts that begin within the first ``most`` lines of their
    component, decided."""
    node = lambda kind, c: F.xxhash64(F.lit(kind), F.col(c))
    edges = open_.select(node("cart", "cart_id").alias("a"), node("product", "product_id").alias("b"))
    roots = connected(edges).select(F.col("node").alias("_node"), F.col("root").alias("component"))
    placed = materialize(open_.withColumn("_node", node("cart", "cart_id")).join(roots, "_node").drop("_node"))
    sizes = placed.groupBy("component", "cart_id").agg(F.count(F.lit(1)).alias("lines"))
    sizes = running_sum(sizes, {"before": F.col("lines")}, ["cart_id"], ["component"], inclusive=False, per_piece=pieces)
    first = sizes.filter(F.col("before") < most).select("component", "cart_id")
    chosen = placed.join(first, ["component", "cart_id"])
    decided = materialize(chosen.groupBy("component").applyInArrow(_serial_by_component, _VERDICT))
    return placed.drop("component"), decided


def ranked_sides(lines: DataFrame, stock: DataFrame, pieces: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Supply and demand intervals of the demanded products in one ordered pass.

    Both sides are running sums per product in their own order (stock: largest available
    first, then stock id; demand: cart order), so they are ranked together, partitioned by
    (product, side), and materialized once. Returns (supply, demand) as in
    :func:`supply_intervals` and :func:`demand_intervals`.
    """
    demanded = lines.select("product_id").distinct()
    s = stock.join(demanded, "product_id", "left_semi").filter(F.col("quantity_available") > 0)
    sup = s.select(
        "product_id", F.lit("S").alias("side"),
        (-F.col("quantity_available")).cast("bigint").alias("k1"), F.col("stock_id").alias("k2"),
        F.col("quantity_available").cast("bigint").alias("amount"),
        "stock_id", "seller_id", F.lit(None).cast("bigint").alias("cart_id"),
    )
    dem = lines.select(
        "product_id", F.lit("D").alias("side"), F.col("cart_id").cast("bigint").alias("k1"),
        F.lit("").alias("k2"),
        F.col("qty").cast("bigint").alias("amount"),
        F.lit(None).cast("string").alias("stock_id"), F.lit(None).cast("string").alias("seller_id"),
        F.col("cart_id").cast("bigint").alias("cart_id"),
    )
    both = running_sum(
        sup.unionByName(dem), {"end": F.col("amount"), "rank": F.lit(1)}, ["k1", "k2"],
        ["product_id", "side"], inclusive=True, per_piece=pieces,
    )
    both = materialize(both.select(
        "product_id", "side", "stock_id", "seller_id", "cart_id", "amount",
        (F.col("end") - F.col("amount")).alias("start"), F.col("rank").cast("bigint").alias("rank"),
    ))
    supply = both.filter(F.col("side") == "S").select(
        "stock_id", "seller_id", "product_id", F.col("amount").cast("int").alias("quantity_available"),
        F.col("start").alias("s0"), F.col("rank").alias("s_rank"))
    demand = both.filter(F.col("side") == "D").select(
        "cart_id", "product_id", F.col("amount").cast("int").alias("qty"),
        F.col("start").alias("d0"), F.col("rank").alias("d_rank"))
    return supply, demand


def allocate(lines: DataFrame, stock: DataFrame, pieces: int | None = None) -> DataFrame:
    """Split each admitted cart line over stock rows.

    ``lines``: (cart_id, product_id, qty > 0), all assumed admitted. Returns
    (cart_id, product_id, stock_id, seller_id, s_rank, take). Demand beyond a product's
    supply stays unallocated.
    """
    sup, dem = ranked_sides(lines.select("cart_id", "product_id", "qty"), stock, pieces)
    totals = (
        dem.groupBy("product_id").agg(F.sum("qty").cast("bigint").alias("D"))
        .join(sup.groupBy("product_id").agg(F.sum("quantity_available").cast("bigint").alias("S")),
              "product_id", "inner")
        .select("product_id", F.least("D", "S").alias("E"))
    )
    events = (
        dem.select("product_id", F.col("d0").alias("x"), F.lit(1).alias("is_d"), F.lit(0).alias("is_s"))
        .unionByName(
            sup.select("product_id", F.col("s0").alias("x"), F.lit(0).alias("is_d"), F.lit(1).alias("is_s"))
        )
        .join(totals, "product_id", "inner")
        .filter(F.col("x") < F.col("E"))
        .groupBy("product_id", "x", "E")
        .agg(F.max("is_d").alias("is_d"), F.max("is_s").alias("is_s"))
    )
    ev = running_sum(
        events, {"d_rank": F.col("is_d"), "s_rank": F.col("is_s"), "e_idx": F.lit(1)},
        ["x"], ["product_id"], inclusive=True, per_piece=pieces,
    )
    nxt = ev.select("product_id", (F.col("e_idx") - 1).alias("e_idx"), F.col("x").alias("x_next"))
    seg = ev.join(nxt, ["product_id", "e_idx"], "left").select(
        "product_id",
        F.col("d_rank").cast("bigint").alias("d_rank"),
        F.col("s_rank").cast("bigint").alias("s_rank"),
        (F.coalesce("x_next", "E") - F.col("x")).alias("take"),
    )
    seg = seg.join(dem.select("product_id", "d_rank", "cart_id"), ["product_id", "d_rank"], "inner")
    seg = seg.join(sup.select("product_id", "s_rank", "stock_id", "seller_id"),
                   ["product_id", "s_rank"], "inner")
    return materialize(seg.select("cart_id", "product_id", "stock_id", "seller_id", "s_rank",
                                  F.col("take").cast("int").alias("take")))


def snapshot_allocation(lines: DataFrame, stock: DataFrame, pieces: int | None = None) -> DataFrame:
    """Each cart line served alone from the current stock (as if it were the only cart).

    A line of ``qty`` uses the product's stock rows whose interval starts before ``qty``,
    taking ``min(available, qty - start)``. The number of rows used, ``k``, comes from one
    ordered pass over line ends and stock starts (a running count), then the line is
    expanded to ranks 1..k and joined to the stock rows on (product, rank): the work is
    proportional to the rows produced, never to lines x stock rows of a product.
    Returns (cart_id, product_id, qty, stock_id, seller_id, s_rank, take); a line whose
    quantity exceeds the product's stock takes everything there is.
    """
    ln = lines.select("cart_id", "product_id", "qty").filter(F.col("qty") > 0)
    sup = supply_intervals(stock.join(ln.select("product_id").distinct(), "product_id", "left_semi"), pieces)
    # Lines of one product and quantity use the same ranks: counted once, joined back.
    events = ln.select(
        "product_id", (F.col("qty") - 1).cast("bigint").alias("x"), F.lit(1).alias("kind"), F.lit(0).alias("is_s"),
    ).distinct().unionByName(
        sup.select("product_id", F.col("s0").alias("x"), F.lit(0).alias("kind"), F.lit(1).alias("is_s"))
    )
    counted = running_sum(events, {"k": F.col("is_s")}, ["x", "kind"], ["product_id"],
                          inclusive=True, per_piece=pieces)
    k = counted.filter(F.col("kind") == 1).select(
        "product_id", (F.col("x") + 1).cast("int").alias("qty"), F.col("k").cast("int").alias("k")
    )
    used = ln.join(k, ["product_id", "qty"], "inner").filter(F.col("k") > 0).select(
        "cart_id", "product_id", "qty",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("k").cast("bigint"))).alias("s_rank"),
    )
    j = used.join(sup, ["product_id", "s_rank"], "inner")
    return j.select(
        "cart_id", "product_id", "qty", "stock_id", "seller_id", "s_rank",
        F.least(F.col("quantity_available"), F.col("qty") - F.col("s0")).cast("int").alias("take"),
    )


def place_orders(
    t: Tables,
    carts: DataFrame,
    cart_customers: DataFrame,
    as_of: dt.datetime,
    pieces: int | None = None,
) -> dict[str, DataFrame]:
    """U8: place one order per admitted cart (all-or-nothing per cart).

    ``cart_customers``: (cart_id, customer_id). Returns the new ``orders``, ``order_items``,
    ``stock`` and ``customers`` (buyers' statistics refreshed) tables plus ``placed``
    (cart_id -> order_id) and ``rejected`` carts.
    """
    t = t.computed_once("stock")  # read four times below
    prices = t.products.select("product_id", "product_price")
    lines = materialize(normalise_carts(carts))
    verdict = admit_carts(lines, t.stock, pieces)
    # A line of an unknown product that has stock nevertheless is passed over, as in the shop.
    ok = lines.join(verdict.filter("admitted"), "cart_id", "left_semi").join(
        prices.select("product_id"), "product_id", "left_semi")
    alloc = allocate(ok, t.stock, pieces)

    ts = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    limit_ts = F.lit(f"{as_of.date().isoformat()} {K.SHIPPING_LIMIT_TIME}").cast("timestamp_ntz")
    prefix, width = K.ID_FORMATS["order_id"]
    base = max_id_number(t.orders, "order_id", prefix)
    placed = row_numbers(verdict.filter("admitted").select("cart_id"), "_n", ["cart_id"], (),
                         per_piece=pieces)
    placed = materialize(
        placed.select("cart_id", format_id(prefix, width, base + F.col("_n")).alias("order_id")))

    new_orders = placed.join(cart_customers, "cart_id", "left").select(
        "order_id", "customer_id",
        F.lit(K.NEW_ORDER_STATUS).alias("order_status"),
        ts.alias("order_purchase_timestamp"),
        *[F.lit(None).cast("timestamp_ntz").alias(c) for c in
          ("order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date")],
    )
    # Lines of a new order follow the product number, then the stock rank.
    alloc = alloc.withColumn("_pnum", id_number("product_id", K.ID_FORMATS["product_id"][0]))
    items = row_numbers(alloc, "order_item_id", ["_pnum", "product_id", "s_rank"], ["cart_id"],
                        per_piece=pieces)
    new_items = items.join(placed, "cart_id", "inner").join(prices, "product_id", "left").select(
        "order_id",
        F.col("order_item_id").cast("int").alias("order_item_id"),
        "product_id", "seller_id",
        limit_ts.alias("shipping_limit_date"),
        F.col("product_price").cast(MONEY).alias("price"),
        F.lit(K.ORDER_LINE_FREIGHT).cast(MONEY).alias("freight_value"),
        F.col("take").alias("quantity"),
    )
    taken = alloc.groupBy("stock_id").agg(F.sum("take").cast("int").alias("_taken"))
    stock = t.stock.join(taken, "stock_id", "left").select(
        *[
            (F.col(c) - F.coalesce("_taken", F.lit(0))).alias(c) if c == "quantity_available"
            else F.when(F.col("_taken").isNotNull(), ts).otherwise(F.col(c)).alias(c) if c == "last_updated"
            else F.col(c)
            for c in t.stock.columns
        ]
    )
    orders = t.orders.unionByName(new_orders)
    order_items = t.order_items.unionByName(new_items)
    # The buyers' statistics, recomputed over the new tables.
    from boutique.operators.maintenance import refresh_customer_stats

    customers = refresh_customer_stats(
        t.with_tables(orders=orders, order_items=order_items), new_orders.select("customer_id"))
    return {
        "orders": orders,
        "order_items": order_items,
        "stock": stock,
        "customers": customers,
        "new_orders": new_orders,
        "new_items": new_items,
        "placed": placed,
        "rejected": verdict.filter(~F.col("admitted")).select("cart_id"),
    }
