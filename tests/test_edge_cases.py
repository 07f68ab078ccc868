"""Edge cases of the shop's semantics on hand-made tables."""

import datetime as dt

import pytest

from boutique.operators import catalog as ca
from boutique.operators import customers as cu
from boutique.operators import orders as od
from boutique.operators import reviews as rv
from boutique.operators import geo as ge
from tests.helpers import customer, item, order, product, review, tables


@pytest.fixture(scope="module")
def t(spark):
    return tables(
        spark,
        customers=[customer("CUST_000001", "Émile", "Zola"), customer("CUST_000002", "anne", "ÉLIE"),
                   customer("CUST_000003", None, "Sans"), customer("CUST_000004", "Only", "Cancelled"),
                   customer("CUST_000005", "Two", "Hundred")],
        orders=[order("ORDER_000001", "CUST_000001", when="2024-01-10 10:00:00"),
                order("ORDER_000002", "CUST_000001", "canceled", "2024-01-12 00:00:00"),
                order("ORDER_000003", "CUST_000002", "cancelled"),
                order("ORDER_000004", "CUST_000003", "created", "2024-01-12 08:00:00"),
                order("ORDER_000005", "CUST_000004", "cancelled"),
                order("ORDER_000006", "CUST_000005")],
        order_items=[item("ORDER_000001", 1, "PROD_00001", price=10, qty=2, freight=1),
                     item("ORDER_000001", 2, "PROD_00001", price=5, qty=1),
                     item("ORDER_000001", 3, "PROD_00002", price=None, qty=None, freight=None),
                     item("ORDER_000002", 1, "PROD_00002", price=100),
                     item("ORDER_000003", 1, "PROD_00001", price=7),
                     item("ORDER_000005", 1, "PROD_00001", price=999),
                     item("ORDER_000006", 1, "PROD_00002", price=190, freight=10)],
        products=[product("PROD_00001", "Élan Vital"), product("PROD_00002", "elan (2)")],
        order_reviews=[review("REVIEW_000001", "ORDER_000001", 4), review("REVIEW_000002", "ORDER_000003", 1,
                                                                          "2024-01-16 09:00:00")],
    )


def rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_order_totals_defaults_and_empty_order(t):
    r = rows(od.orders_with_totals(t), "order_id")
    # 10*2+1 + 5*1+0 + (null price -> 0, null qty -> 1, null freight -> 0)
    assert r["ORDER_000001"]["total_price"] == 26.0
    assert r["ORDER_000004"]["total_price"] == 0.0  # order without lines
    assert r["ORDER_000001"]["first_name"] == "Émile"


def test_orders_sorted_newest_first(t):
    ids = [x.order_id for x in od.orders_with_totals(t).collect()]
    assert ids[0] in ("ORDER_000002", "ORDER_000004")


def test_filter_orders_accents_and_bounds(t):
    base = od.orders_with_totals(t, sort=False)
    got = {r.order_id for r in od.filter_orders(base, customer_name="élie").collect()}
    assert got == {"ORDER_000003"}  # case-insensitive across accents
    # blank / non-numeric / NaN bounds are ignored
    n = base.count()
    assert od.filter_orders(base, min_total=" ", max_total="abc").count() == n
    assert od.filter_orders(base, min_total="nan").count() == n
    # date_to compares with midnight: the last day is excluded unless inclusive_end_day
    assert "ORDER_000004" not in {r.order_id for r in od.filter_orders(base, date_to="2024-01-12").collect()}
    assert "ORDER_000004" in {r.order_id for r in
                              od.filter_orders(base, date_to="2024-01-12", inclusive_end_day=True).collect()}


def test_invalid_pattern_fails_on_driver(t):
    with pytest.raises(Exception):
        od.filter_orders(od.orders_with_totals(t, sort=False), customer_name="(")


def test_literal_search(t):
    got = ca.filter_products(t.products, name="(2)", literal=True).collect()
    assert [r.product_id for r in got] == ["PROD_00002"]


def test_segments(t):
    r = rows(cu.customer_segments(t), "customer_id")
    # 'canceled' (one l) counts as live
    assert r["CUST_000001"]["total_orders"] == 2
    assert r["CUST_000001"]["total_spent"] == 126.0
    assert r["CUST_000001"]["customer_segment"] == "casual"
    assert r["CUST_000004"]["customer_segment"] == "nouveau"  # only cancelled orders
    assert r["CUST_000003"]["customer_segment"] == "nouveau"  # order without lines
    # exactly 200 is not below 200
    assert r["CUST_000005"]["total_spent"] == 200.0
    assert r["CUST_000005"]["customer_segment"] == "regular"


def test_line_weighted_versus_review_weighted(t):
    a3 = rows(ca.product_ratings(t), "product_id")
    a4 = rows(ca.product_scores(t), "product_id")
    # PROD_00001 is twice on ORDER_000001: the line-weighted count sees that review twice
    assert a3["PROD_00001"]["review_count"] == 3
    assert a4["PROD_00001"]["review_count"] == 2
    assert a4["PROD_00001"]["avg_score"] == 2.5


def test_first_product_and_recent_reviews(t):
    first = rows(rv.first_product_per_order(t.order_items), "order_id")
    assert first["ORDER_000001"]["product_id"] == "PROD_00001"
    recent = rv.recent_reviews(t, limit=1).collect()
    assert [r.review_id for r in recent] == ["REVIEW_000002"]


def test_preview(spark):
    from pyspark.sql import functions as F

    from boutique.functions.text import preview

    df = spark.createDataFrame([("x" * 121,), ("y" * 120,)], "m string")
    got = [r.p for r in df.select(preview(F.col("m")).alias("p")).collect()]
    assert got[0] == "x" * 120 + "…" and got[1] == "y" * 120


def test_geo_autocomplete_and_flags(spark):
    geo_rows = [dict(zip_code_prefix=75001, city="Paris", state="Île-de-France"),
                dict(zip_code_prefix=6000, city="Nice", state="PACA")]
    t = tables(spark, geolocation=geo_rows)
    assert [r.zip_code_prefix for r in ge.distinct_zips(t).collect()] == ["6000", "75001"]
    assert [r.city for r in ge.autocomplete(t, "city", "PAR").collect()] == ["Paris"]
    rows_ = spark.createDataFrame([(1, "6000", "NICE", "paca"), (2, "6001", "", None)],
                                  "id int, zip_code_prefix string, city string, state string")
    f = {r.id: r for r in ge.geo_flags(rows_, t.geolocation).collect()}
    assert f[1].zip_ok and f[1].city_ok and f[1].state_ok
    assert not f[2].zip_ok and f[2].city_ok and f[2].state_ok
    empty = tables(spark).geolocation
    assert all(r.zip_ok for r in ge.geo_flags(rows_, empty).collect())


@pytest.mark.parametrize("odd", [False, True])
def test_first_product_of_ids_of_any_width(spark, odd):
    """Packed or not, ids compare as text; a line number decides before the id."""
    from boutique.operators.reviews import first_product_per_order

    rows = [("a", 1, "PROD_00020"), ("a", 1, "PROD_100000"), ("a", 1, "PROD_0002"), ("b", 2, "PROD_1"), ("b", 1, "PROD_999999999"), ("b", 1, "PROD_99999999"),
            ("c", 2_000_000_000, "PROD_000000000"), ("d", 0, "PROD_0"), ("d", 0, "PROD_00"), ("e", 3, "PROD_109"), ("e", 3, "PROD_11"), ("e", 3, "PROD_1090")]
    if odd:
        rows += [("e", 3, "OTHER"), ("f", None, "PROD_2"), ("f", None, "PROD_1"), ("g", -1, "PROD_9"), ("g", 1, "PROD_1")]
    got = {r.order_id: r.product_id for r in first_product_per_order(spark.createDataFrame(rows, "order_id string, order_item_id int, product_id string")).collect()}
    want = {"a": "PROD_0002", "b": "PROD_99999999", "c": "PROD_000000000", "d": "PROD_0", "e": "OTHER" if odd else "PROD_109"}
    assert got == (want | {"f": "PROD_1", "g": "PROD_9"} if odd else want)


def test_product_reviews_once_per_product(spark):
    """Newest first, then by review and product; a product on several lines counts once, a
    missing one too; orders without reviews, and reviews without lines, give nothing."""
    t = tables(
        spark, orders=[order("O1", "C1"), order("O2", "C1"), order("O3", "C9")], customers=[customer("C1")],
        order_items=[item("O1", 1, "P2"), item("O1", 2, "P1"), item("O1", 3, "P2"), item("O1", 4, None), item("O2", 1, "P1"), item("O3", 1, "P1")],
        order_reviews=[review("R1", "O1", when="2024-01-15 09:00:00", msg="un"), review("R2", "O2", when="2024-01-16 09:00:00", msg=None),
                       review("R3", "O2", when="2024-01-15 09:00:00"), review("R4", "O9")])
    got = [(r.review_id, r.product_id, r.review_comment_message, r.first_name) for r in rv.product_reviews(t).collect()]
    assert got == [("R2", "P1", None, "A"), ("R1", None, "un", "A"), ("R1", "P1", "un", "A"), ("R1", "P2", "un", "A"), ("R3", "P1", "m", "A")]
    assert [r.review_id for r in rv.product_reviews(t, "P2").collect()] == ["R1"]
