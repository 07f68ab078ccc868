"""Sources and sinks: carts as a map, canonical Parquet round trip, insert defaults."""

import datetime as dt

from boutique.sources.carts import carts_from_map, normalise_carts
from boutique.sources.tables import Tables, with_defaults


def test_carts_from_map(spark):
    df = spark.createDataFrame([(1, {"PROD_00001": 2, "PROD_00002": 1}), (2, {"PROD_00001": 0})],
                               "cart_id long, items map<string,int>")
    got = sorted(tuple(r) for r in normalise_carts(carts_from_map(df)).collect())
    assert got == [(1, "PROD_00001", 2), (1, "PROD_00002", 1)]


def test_parquet_round_trip(spark, sf_small, tmp_path):
    t = Tables.from_testdata(spark, sf_small)
    t.write(str(tmp_path / "v1"), names=("orders", "products"))
    back = Tables.from_parquet(spark, str(tmp_path / "v1"))
    assert back.orders.count() == t.orders.count()
    assert back.products.schema == t.products.schema or back.products.columns == t.products.columns


def test_with_defaults(spark):
    df = spark.createDataFrame([("S1", "SELLER_0001", "PROD_00001", None)],
                               "stock_id string, seller_id string, product_id string, min_stock_level int")
    r = with_defaults(df, "stock", dt.datetime(2024, 6, 1, 12)).collect()[0]
    assert (r.min_stock_level, r.reorder_point, r.quantity_available, r.stock_condition) == (12, 19, 0, "new")
    assert r.last_updated == dt.datetime(2024, 6, 1, 12)


def test_bucketed_catalog_joins_without_shuffle(spark, sf_small, tmp_path):
    from boutique.operators.customers import customer_segments

    t = Tables.from_testdata(spark, sf_small)
    db = "boutique_test_catalog"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{tmp_path}'")
    t.write_catalog(db, buckets=4, names=("orders", "order_items", "customers"), mode="overwrite")
    b = Tables.from_catalog(spark, db)
    joined = b.orders.join(b.order_items, "order_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # matching buckets, no shuffle
    want = sorted(customer_segments(t).collect())
    got = sorted(customer_segments(b.with_tables(customers=b.customers)).collect())
    assert got == want
