"""Batches with several changes to one row against plain loops, one call after the other."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from boutique.operators import changes as cg
from boutique.operators import maintenance as mt
from tests.helpers import customer, product, review, stock, tables

AS_OF = dt.datetime(2024, 6, 1, 12, 0, 0)
GEO = [dict(zip_code_prefix=75001, city="Paris", state="IDF")]


def in_order(rows):
    """Rows (seq first) by seq, null last."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def errors(result):
    return sorted((r.key, tuple(r.errors)) for r in result["rejects"].collect())


@pytest.fixture
def small_steps(spark):
    """Components are decided a few changes at a time."""
    spark.conf.set("boutique.serialLines", "4")
    yield
    spark.conf.unset("boutique.serialLines")


# ------------------------------------------------------------------------------- products
PRODUCT = "seq long, product_id string, new_product_name string, new_product_price string, new_product_release_year string"


def test_products_fold(spark):
    rng = random.Random(1)
    rows = [(k, f"PROD_{rng.randrange(8):05d}", rng.choice([None, f" name {k} ", " "]), rng.choice([None, f"{k}.5", "abc", "-1"]), rng.choice([None, "2001", "1900"]))
            for k in range(60)] + [(None, "PROD_00001", "at last", None, None), (99, "PROD_00077", "x", None, None)]
    rng.shuffle(rows)
    shop = {f"PROD_{k:05d}": ("Jeu", 20.0, 2022) for k in range(8)}
    want = dict(shop)
    refused = []
    for _, pid, name, price, year in in_order(rows):
        if pid not in want:
            refused.append((pid, ("product_id: not found",)))
            continue
        bad = [m for m, wrong in (("product_name: must not be empty", name is not None and not name.strip()), ("product_release_year: out of range", year == "1900"),
                                  ("product_price: must be > 0", price in ("abc", "-1", "0.5x"))) if wrong]
        if bad:
            refused.append((pid, tuple(bad)))
            continue
        old = want[pid]
        want[pid] = (name.strip() if name else old[0], float(price) if price else old[1], int(year) if year else old[2])
    ch = spark.createDataFrame(rows, PRODUCT)
    for c in ("product_category", "product_platform", "product_esrb_rating", "product_weight_g", "product_description"):
        ch = ch.withColumn(f"new_{c}", F.lit(None).cast("string"))
    res = mt.update_products(tables(spark, products=[product(p) for p in shop]), ch, 2024)
    assert {r.product_id: (r.product_name, float(r.product_price), r.product_release_year) for r in res["products"].collect()} == want
    assert errors(res) == sorted(refused)


# ------------------------------------------------------------------------------ customers
CUSTOMER = "seq long, customer_id string, new_email string, new_first_name string, new_phone string"


def customer_frame(spark, rows):
    ch = spark.createDataFrame(rows, CUSTOMER)
    for c in ("last_name", "zip_code_prefix", "city", "state", "address_line1", "address_line2"):
        ch = ch.withColumn(f"new_{c}", F.lit(None).cast("string"))
    return ch.withColumn("new_is_admin", F.lit(None).cast("tinyint"))


def serial_customers(shop, rows):
    shop, refused = dict(shop), []
    for _, cid, email, first, phone in in_order(rows):
        email = email.strip() if email is not None else None
        bad = [m for m, wrong in (("first_name: must not be empty", first == " "), ("email: invalid", email is not None and "@" not in email),
                                  ("phone: 10 digits starting with 0", phone == "12")) if wrong]
        if not bad and email is not None and any(e == email for c, (e, _) in shop.items() if c != cid):
            bad = ["email: already registered"]
        if bad:
            refused.append((cid, tuple(bad)))
        else:
            old = shop[cid]
            shop[cid] = (email or old[0], first or old[1])
    return shop, sorted(refused)


HANDOVER = [
    (1, "CUST_000001", "new@x.fr", None, None), (2, "CUST_000002", "c1@x.fr", "Taker", None),  # 1 gives up, 2 takes
    (3, "CUST_000003", "c4@x.fr", None, None),  # 4 still has it
    (4, "CUST_000004", "tmp@x.fr", None, None), (5, "CUST_000003", "c4@x.fr", None, None), (6, "CUST_000004", "c3@x.fr", None, None),  # a swap by way of tmp
    (7, "CUST_000005", " c2@x.fr\t", None, "12"),  # invalid: 2's old email stays free
    (8, "CUST_000006", "c2@x.fr", None, None), (9, "CUST_000005", "c2@x.fr", "No", None),  # 6 has it by then
    (10, "CUST_000006", "c6@x.fr", None, None), (None, "CUST_000005", "c2@x.fr", "Late", None),  # back again; the last one takes it
]


def test_emails_handed_over(spark, small_steps):
    shop = {f"CUST_{k:06d}": (f"c{k}@x.fr", "A") for k in range(1, 8)}
    t = tables(spark, geolocation=GEO, customers=[customer(c, email=e) for c, (e, _) in shop.items()])
    want, refused = serial_customers(shop, HANDOVER)
    assert want["CUST_000002"] == ("c1@x.fr", "Taker") and want["CUST_000005"] == ("c2@x.fr", "Late") and len(refused) == 3
    res = mt.update_customers(t, customer_frame(spark, HANDOVER))
    assert {r.customer_id: (r.email, r.first_name) for r in res["customers"].collect()} == want
    assert errors(res) == refused


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_customer_batches(spark, small_steps, seed):
    rng = random.Random(seed)
    shop = {f"CUST_{k:06d}": (f"c{k}@x.fr", "A") for k in range(14)}
    rows = [(k, f"CUST_{rng.randrange(14):06d}", rng.choice([None, *[f"c{j}@x.fr" for j in range(20)]]), rng.choice([None, f"N{k}", " "]), rng.choice([None, None, "12"]))
            for k in range(70)]
    t = tables(spark, geolocation=GEO, customers=[customer(c, email=e) for c, (e, _) in shop.items()])
    want, refused = serial_customers(shop, rows)
    res = mt.update_customers(t, customer_frame(spark, rows))
    assert {r.customer_id: (r.email, r.first_name) for r in res["customers"].collect()} == want
    assert errors(res) == refused


def test_without_a_sequence(spark):
    """No order: nobody is first, and what is held at the start stays taken."""
    t = tables(spark, geolocation=GEO, customers=[customer(f"CUST_{k:06d}", email=f"c{k}@x.fr") for k in range(1, 7)])
    rows = [(0, "CUST_000001", "new@x.fr", None, None), (0, "CUST_000002", "c1@x.fr", None, None), (0, "CUST_000003", "same@x.fr", None, None),
            (0, "CUST_000004", "same@x.fr", None, None), (0, "CUST_000005", "c5@x.fr", "Own", None), (0, "CUST_000006", None, "x", None), (0, "CUST_000006", None, "y", None)]
    res = mt.update_customers(t, customer_frame(spark, rows).drop("seq"))
    assert errors(res) == [("CUST_000002", ("email: already registered",)), ("CUST_000003", ("email: duplicated in batch",)), ("CUST_000004", ("email: duplicated in batch",)),
                           ("CUST_000006", ("customer_id: duplicated in batch",)), ("CUST_000006", ("customer_id: duplicated in batch",))]
    assert {r.customer_id: r.email for r in res["customers"].collect()}["CUST_000001"] == "new@x.fr"


def test_inserts_with_equal_or_null_seq(spark):
    """Of the valid rows with one email one stands, whatever their seq."""
    t = tables(spark, geolocation=GEO, customers=[customer("CUST_000001", email="taken@x.fr")])
    rows = [(s, f, "L", e, None, "75001", "Paris", "IDF", None, None, None) for s, f, e in [
        (1, "b", "p@x.fr"), (1, "a", "p@x.fr"), (None, "c", "q@x.fr"), (None, "d", "q@x.fr"), (5, "e", "q@x.fr"), (2, "same", "r@x.fr"), (2, "same", "r@x.fr"), (2, "same", "r@x.fr"),
        (None, "g", "s@x.fr"), (0, " ", "t@x.fr"), (1, "h", "t@x.fr"), (0, "i", "taken@x.fr")]]
    batch = spark.createDataFrame(rows, "seq long, first_name string, last_name string, email string, phone string, zip_code_prefix string, "
                                  "city string, state string, address_line1 string, address_line2 string, is_admin tinyint")
    res = mt.add_customers(t, batch, AS_OF)
    assert sorted((r.email, r.first_name) for r in res["new_customers"].collect()) == [
        ("p@x.fr", "a"), ("q@x.fr", "e"), ("r@x.fr", "same"), ("s@x.fr", "g"), ("t@x.fr", "h")]
    assert sorted((r.email, r.first_name) for r in res["rejects"].collect()) == [
        ("p@x.fr", "b"), ("q@x.fr", "c"), ("q@x.fr", "d"), ("r@x.fr", "same"), ("r@x.fr", "same"), ("t@x.fr", " "), ("taken@x.fr", "i")]


# ---------------------------------------------------------------------------------- stock
STOCK = ("seq long, stock_id string, new_seller_id string, new_quantity_in_stock string, new_quantity_reserved string, new_min_stock_level string, "
         "new_warehouse_location string")


def stock_frame(spark, rows):
    ch = spark.createDataFrame(rows, STOCK)
    for c in ("reorder_point", "stock_condition"):
        ch = ch.withColumn(f"new_{c}", F.lit(None).cast("string"))
    return ch


def serial_stock(shop, rows):
    """shop: stock_id -> (product, seller, in stock, reserved, min level, place)."""
    shop, refused, touched = dict(shop), [], set()
    for _, sid, seller, n, r, level, place in in_order(rows):
        product_, old_seller, old_n, old_r, old_level, old_place = shop[sid]
        if "x" in (n, r, level):
            refused.append((sid, tuple(f"{c}: must be an integer" for c, v in (("quantity_in_stock", n), ("quantity_reserved", r), ("min_stock_level", level)) if v == "x")))
            continue
        new_n, new_r = int(n) if n else old_n, int(r) if r else old_r
        new_seller = seller.strip() if seller and seller.strip() else old_seller
        bad = [m for m, wrong in (("quantity_available: negative (stock < reserved)", new_n < new_r), (
            "seller_id: the seller already stocks this product", any(p == product_ and s == new_seller for i, (p, s, *_) in shop.items() if i != sid) and new_seller != old_seller)) if wrong]
        if bad:
            refused.append((sid, tuple(bad)))
            continue
        shop[sid] = (product_, new_seller, new_n, new_r, int(level) if level else old_level, place.strip() if place and place.strip() else old_place)
        touched.add(sid)
    return shop, sorted(refused), touched


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_stock_batches(spark, small_steps, seed):
    rng = random.Random(seed)
    shop = {f"STOCK_{k:05d}": (f"PROD_{k // 4:05d}", f"S{k % 4}", 8, 3, 12, "A-01-01") for k in range(16)}
    rows = [(k, f"STOCK_{rng.randrange(16):05d}", rng.choice([None, None, " ", *[f" S{j}" for j in range(6)]]), rng.choice([None, None, "1", "9", "x"]),
             rng.choice([None, None, "0", "6"]), rng.choice([None, "5"]), rng.choice([None, "", f" B-{k} "])) for k in range(80)]
    t = tables(spark, stock=[stock(s, p, seller=seller, avail=n - r, in_stock=n, reserved=r) for s, (p, seller, n, r, _, _) in shop.items()])
    want, refused, touched = serial_stock(shop, rows)
    res = mt.update_stock(t, stock_frame(spark, rows), AS_OF)
    got = res["stock"].collect()
    assert {r.stock_id: (r.product_id, r.seller_id, r.quantity_in_stock, r.quantity_reserved, r.min_stock_level, r.warehouse_location) for r in got} == want
    assert all(r.quantity_available == r.quantity_in_stock - r.quantity_reserved and (r.last_updated == AS_OF) == (r.stock_id in touched) for r in got)
    assert errors(res) == refused


def test_settle_takes_one_task_when_nothing_is_contended(spark):
    """Rows with one change each and values that nobody else wants need no component."""
    events = spark.createDataFrame([(k, f"h{k}", f"new{k}", None, 5 if k % 2 else -1) for k in range(20)], "_n long, holder string, wanted string, set_a long, set_b long")
    holders = spark.createDataFrame([(f"h{k}", f"old{k}", 3, 0) for k in range(30)], "holder string, held string, a long, b long")
    got = {r._n: (r.taken, r.negative) for r in cg.settle(events, holders).collect()}
    assert got == {k: (False, k % 2 == 1) for k in range(20)}


# -------------------------------------------------------------------------------- reviews
def test_reviews_fold(spark):
    rng = random.Random(4)
    rows = [(k, f"REVIEW_{rng.randrange(6):06d}", rng.choice([None, 1, 4, 9]), rng.choice([None, "", f" t{k} "]), rng.choice([None, "", f"m{k}"])) for k in range(50)]
    shop = {f"REVIEW_{k:06d}": (5, "t", "m") for k in range(6)}
    refused = []
    want = dict(shop)
    for _, rid, score, title, message in rows:
        if score == 9:
            refused.append((rid, ("review_score: integer from 1 to 5",)))
            continue
        old = want[rid]
        want[rid] = (score or old[0], old[1] if title is None else title.strip() or None, old[2] if message is None else message.strip() or None)
    rng.shuffle(rows)
    ch = spark.createDataFrame(rows, "seq long, review_id string, new_review_score int, new_review_comment_title string, new_review_comment_message string")
    res = mt.update_reviews(tables(spark, order_reviews=[review(r, f"O{k}") for k, r in enumerate(shop)]), ch)
    assert {r.review_id: (r.review_score, r.review_comment_title, r.review_comment_message) for r in res["order_reviews"].collect()} == want
    assert errors(res) == sorted(refused)
