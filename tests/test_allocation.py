"""Stock allocation against a plain sequential loop (property tests)."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from boutique.operators import allocation as al
from tests.helpers import product, stock, tables


def serial_greedy(stock_rows, qty):
    """Reference loop: largest available first (ties by id), take min(available, remaining)."""
    out, remaining = {}, qty
    for sid, avail in sorted(stock_rows, key=lambda r: (-r[1], r[0])):
        if remaining <= 0:
            break
        if avail <= 0:
            continue
        use = min(avail, remaining)
        out[sid] = use
        remaining -= use
    return out


def serial_checkout(stock_rows, carts):
    """The shop's loop: cart after cart, {product: qty} each, against the current stock
    (stock id, product, available): all lines must fit, then largest available first."""
    available = {s: a for s, _, a in stock_rows}
    admitted, taken = {}, {}
    for cid, cart in carts:
        total = lambda p: sum(available[s] for s, q, _ in stock_rows if q == p)
        admitted[cid] = all(total(p) >= q for p, q in cart.items())
        if admitted[cid]:
            for p, q in cart.items():
                for s, _, _ in sorted((r for r in stock_rows if r[1] == p), key=lambda r: (-available[r[0]], r[0])):
                    use = max(0, min(available[s], q))
                    available[s] -= use
                    q -= use
                taken[(cid, p)] = cart[p]
    return admitted, taken, available


stock_lists = st.lists(st.integers(min_value=0, max_value=30), min_size=1, max_size=6)


@settings(max_examples=8, deadline=None)
@given(avail=stock_lists, qty=st.integers(min_value=1, max_value=120))
def test_snapshot_allocation_equals_loop(spark, avail, qty):
    rows = [(f"STOCK_{i:05d}", a) for i, a in enumerate(avail)]
    t = tables(spark, products=[product("PROD_00001")],
               stock=[stock(s, "PROD_00001", seller=f"SELLER_{i:04d}", avail=a) for i, (s, a) in enumerate(rows)])
    lines = spark.createDataFrame([(1, "PROD_00001", qty)], "cart_id long, product_id string, qty int")
    got = {r.stock_id: r.take for r in al.snapshot_allocation(lines, t.stock, pieces=2).collect()}
    assert got == serial_greedy(rows, qty)
    assert sum(got.values()) == min(qty, sum(avail))


products = st.sampled_from(["PROD_00001", "PROD_00002", "PROD_00003", "PROD_00009"])  # the last has no stock


@settings(max_examples=10, deadline=None)
@given(avail=st.lists(st.tuples(st.sampled_from(["PROD_00001", "PROD_00002", "PROD_00003"]), st.integers(-3, 30)), min_size=1, max_size=7),
       carts=st.lists(st.dictionaries(products, st.integers(1, 25), min_size=1, max_size=3), min_size=1, max_size=8))
def test_admission_equals_serial_checkout(spark, avail, carts):
    rows = [(f"STOCK_{i:05d}", p, a) for i, (p, a) in enumerate(avail)]
    t = tables(spark, products=[product(p) for p in ("PROD_00001", "PROD_00002", "PROD_00003")],
               stock=[stock(s, p, seller=f"SELLER_{i:04d}", avail=a) for i, (s, p, a) in enumerate(rows)])
    numbered = [(c + 1, cart) for c, cart in enumerate(carts)]
    lines = spark.createDataFrame([(c, p, q) for c, cart in numbered for p, q in cart.items()],
                                  "cart_id long, product_id string, qty int")
    want, taken, left = serial_checkout(rows, numbered)
    verdicts = al.admit_carts(lines, t.stock, pieces=2)
    assert {r.cart_id: r.admitted for r in verdicts.collect()} == want
    ok = lines.join(verdicts.filter("admitted"), "cart_id", "left_semi")
    got = al.allocate(ok, t.stock, pieces=2).groupBy("cart_id", "product_id").sum("take").collect()
    assert {(r.cart_id, r.product_id): r["sum(take)"] for r in got} == taken


def test_admission_by_components(spark):
    """Groups of carts that contend for their own scarce products, each larger than what one
    task decides: in rounds, component by component, with the serial verdicts."""
    import random

    rng = random.Random(3)
    rows, carts = [], []
    for group in range(4):
        for k in range(5):
            rows.append((f"STOCK_{group}{k:04d}", f"PROD_{group}{k:04d}", rng.randrange(5, 60)))
    for c in range(90):
        group = rng.choice([0, 0, 0, 1, 2, 3])
        picks = rng.sample(range(5), rng.choice([1, 1, 2, 3]))
        carts.append((c + 1, {f"PROD_{group}{k:04d}": rng.choice([1, 3, 9, 70]) for k in picks}))
    carts.append((91, {"PROD_00000": 1, "PROD_10001": 1}))  # joins two groups
    carts.append((92, {"PROD_99999": 1}))
    t = tables(spark, stock=[stock(s, p, seller=f"SELLER_{i:04d}", avail=a) for i, (s, p, a) in enumerate(rows)])
    lines = spark.createDataFrame([(c, p, q) for c, cart in carts for p, q in cart.items()], "cart_id long, product_id string, qty int")
    want, _, _ = serial_checkout(rows, carts)
    assert 20 < sum(want.values()) < 70
    for serial_lines in (None, 15):
        got = al.admit_carts(lines, t.stock, pieces=20, serial_lines=serial_lines)
        assert {r.cart_id: r.admitted for r in got.collect()} == want


def test_connected_components(spark):
    import random

    from boutique.operators.components import connected

    rng = random.Random(8)
    edges = [(rng.randrange(10**9) * 2, rng.randrange(10**9) * 2) for _ in range(30)]
    nodes = sorted({x for e in edges for x in e})
    edges += [(rng.choice(nodes), rng.choice(nodes)) for _ in range(25)] + [(nodes[0], nodes[0])]
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(nodes)
    assert len({(label[x], got[x]) for x in nodes}) == len(set(label.values())) == len(set(got.values()))


def test_rejected_demand_is_free_again(spark):
    """One cart asking for too much, or for an unknown product, does not block later carts."""
    t = tables(spark, products=[product("PROD_00001")], stock=[stock("STOCK_00001", "PROD_00001", avail=10)])
    lines = spark.createDataFrame([(1, "PROD_00001", 1000), (2, "PROD_00001", 4), (3, "PROD_00001", 1), (3, "PROD_00077", 1), (4, "PROD_00001", 6)],
                                  "cart_id long, product_id string, qty int")
    got = {r.cart_id: r.admitted for r in al.admit_carts(lines, t.stock).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True}


def test_place_orders_and_cancel_restores_stock(spark):
    from pyspark.sql import functions as F

    from boutique.operators import maintenance as mt
    from tests.helpers import customer

    t = tables(spark, products=[product("PROD_00001", price=20), product("PROD_00002", price=5)],
               customers=[customer("CUST_000001"), customer("CUST_000002")],
               stock=[stock("STOCK_00001", "PROD_00001", "SELLER_0001", 3),
                      stock("STOCK_00002", "PROD_00001", "SELLER_0002", 5),
                      stock("STOCK_00003", "PROD_00002", "SELLER_0001", 1)])
    carts = spark.createDataFrame([(1, "PROD_00001", 6), (1, "PROD_00002", 1), (2, "PROD_00002", 1)],
                                  "cart_id long, product_id string, qty int")
    who = spark.createDataFrame([(1, "CUST_000001"), (2, "CUST_000002")], "cart_id long, customer_id string")
    as_of = dt.datetime(2024, 6, 1, 12, 0, 0)
    res = al.place_orders(t, carts, who, as_of)
    assert [r.cart_id for r in res["rejected"].collect()] == [2]  # PROD_00002 exhausted by cart 1
    items = sorted((r.product_id, r.seller_id, r.quantity, r.order_item_id) for r in res["new_items"].collect())
    assert items == [("PROD_00001", "SELLER_0001", 1, 2), ("PROD_00001", "SELLER_0002", 5, 1),
                     ("PROD_00002", "SELLER_0001", 1, 3)]
    assert {r.order_id for r in res["new_orders"].collect()} == {"ORDER_000001"}
    buyers = {r.customer_id: (r.total_orders, r.customer_segment) for r in res["customers"].collect()}
    assert buyers["CUST_000001"] == (1, "casual") and buyers["CUST_000002"] == (0, None)
    after = {r.stock_id: r.quantity_available for r in res["stock"].collect()}
    assert after == {"STOCK_00001": 2, "STOCK_00002": 0, "STOCK_00003": 0}
    # cancelling the new order gives everything back; cancelling again gives nothing more
    t2 = t.with_tables(orders=res["orders"], order_items=res["order_items"], stock=res["stock"])
    ch = spark.createDataFrame([("ORDER_000001", "cancelled")], "order_id string, new_status string")
    r2 = mt.update_order_status(t2, ch, as_of)
    back = {r.stock_id: r.quantity_available for r in r2["stock"].collect()}
    assert back == {"STOCK_00001": 3, "STOCK_00002": 5, "STOCK_00003": 1}
    t3 = t2.with_tables(orders=r2["orders"], stock=r2["stock"])
    again = {r.stock_id: r.quantity_available for r in mt.update_order_status(t3, ch, as_of)["stock"].collect()}
    assert again == back
    seg = {r.customer_id: r.customer_segment for r in r2["customers"].collect()}
    assert seg["CUST_000001"] == "nouveau"
    assert r2["orders"].filter(F.col("order_status") == "cancelled").count() == 1


def test_hot_product_many_carts(spark):
    """One product holds almost all demand: allocation is split over many pieces and still
    equals the sequential reference (computed with pandas cumulative sums)."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    n_carts, n_stock = 3000, 40
    lines = spark.range(n_carts).select(
        (F.col("id") + 1).alias("cart_id"),
        F.when(F.col("id") % 50 == 0, "PROD_00002").otherwise("PROD_00001").alias("product_id"),
        (F.col("id") % 4 + 1).cast("int").alias("qty"))
    avail = [(i * 37) % 200 + 1 for i in range(n_stock)]
    t = tables(spark, products=[product("PROD_00001"), product("PROD_00002")],
               stock=[stock(f"STOCK_{i:05d}", "PROD_00001", f"SELLER_{i:04d}", a) for i, a in enumerate(avail)]
               + [stock("STOCK_99999", "PROD_00002", "SELLER_9999", 10)])
    verdict = al.admit_carts(lines, t.stock, pieces=100)
    ok = lines.join(verdict.filter("admitted"), "cart_id", "left_semi")
    got = al.allocate(ok, t.stock, pieces=100).toPandas()

    # reference: per product, demand and supply intervals and their overlaps
    lp = lines.toPandas().sort_values(["product_id", "cart_id"])
    sp = t.stock.toPandas()
    want_rows = []
    for pid, d in lp.groupby("product_id"):
        s = sp[(sp.product_id == pid) & (sp.quantity_available > 0)].sort_values(
            ["quantity_available", "stock_id"], ascending=[False, True])
        supply = int(s.quantity_available.sum())
        keep, used = [], 0  # one line per cart here: served while it fits what is left
        for q in d.qty:
            keep.append(used + q <= supply)
            used += q if keep[-1] else 0
        d = d[keep]
        d = d.assign(d1=d.qty.cumsum())
        d = d.assign(d0=d.d1 - d.qty)
        s = s.assign(s1=s.quantity_available.cumsum())
        s = s.assign(s0=s.s1 - s.quantity_available)
        for r in d.itertuples():
            ov = np.minimum(r.d1, s.s1) - np.maximum(r.d0, s.s0)
            for sid, take in zip(s.stock_id[ov > 0], ov[ov > 0]):
                want_rows.append((r.cart_id, sid, int(take)))
    want = pd.DataFrame(want_rows, columns=["cart_id", "stock_id", "take"])
    key = ["cart_id", "stock_id"]
    a = got[key + ["take"]].sort_values(key).reset_index(drop=True).astype({"take": "int64"})
    b = want.sort_values(key).reset_index(drop=True)
    assert len(a) > 1000
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
