"""Validators and maintenance round trips on hand-made tables."""

import datetime as dt

from pyspark.sql import functions as F

from boutique.operators import maintenance as mt
from boutique.operators import quality as qa
from tests.helpers import customer, item, order, product, review, stock, tables

AS_OF = dt.datetime(2024, 6, 1, 12, 0, 0)
GEO = [dict(zip_code_prefix=75001, city="Paris", state="Île-de-France"),
       dict(zip_code_prefix=6000, city="Nice", state="PACA")]


def errs(df, key):
    return {r[key]: list(r.errors) for r in df.collect()}


def test_phone_zip_email_rules(spark):
    df = spark.createDataFrame(
        [("a", "06 12.34-56 78", "75001", "a@b.fr"), ("b", "061234567", "7500", "a@bfr"),
         ("c", "", "06000", "x" * 250 + "@b.fr"), ("d", None, " 75001 ", "a@b@c.fr"),
         ("e", "0012345678", "75001\n", "@b.fr")],
        "k string, phone string, zip string, email string")
    r = {x.k: x for x in df.select("k", qa.valid_phone("phone").alias("p"), qa.valid_zip("zip").alias("z"),
                                  qa.valid_email("email").alias("e")).collect()}
    assert (r["a"].p, r["a"].z, r["a"].e) == (True, True, True)
    assert (r["b"].p, r["b"].z, r["b"].e) == (False, False, False)
    assert (r["c"].p, r["c"].z, r["c"].e) == (True, True, False)  # blank phone ok; email too long
    assert (r["d"].p, r["d"].z, r["d"].e) == (True, True, True)  # dot after the last @
    assert (r["e"].p, r["e"].z) == (False, True)  # 0 then 0 is not allowed; trailing newline stripped


def test_customer_batch(spark):
    t = tables(spark, geolocation=GEO, customers=[customer("CUST_000004", email="taken@x.fr")])
    batch = spark.createDataFrame(
        [("Ana", "Lima", "new@x.fr", "0612345678", "75001", "PARIS", "île-de-france"),
         ("Bo", "Li", "taken@x.fr", "", "06000", "Nice", "PACA"),
         ("Cy", " ", "dup@x.fr", "0612345678", "06000", "Nice", ""),
         ("Di", "Do", "dup@x.fr", "0612345678", "99999", "Lyon", "PACA")],
        "first_name string, last_name string, email string, phone string, zip_code_prefix string, "
        "city string, state string").withColumn("address_line1", F.lit(None).cast("string")).withColumn(
        "address_line2", F.lit(None).cast("string")).withColumn("is_admin", F.lit(None).cast("tinyint"))
    res = mt.add_customers(t, batch, AS_OF)
    new = res["new_customers"].collect()
    assert [(r.customer_id, r.email, r.zip_code_prefix) for r in new] == [("CUST_000005", "new@x.fr", 75001)]
    e = errs(res["rejects"], "email")
    assert e["taken@x.fr"] == ["email: already registered"]
    # Invalid rows don't count as duplicates of each other.
    assert not [m for m in e["dup@x.fr"] if "duplicated" in m]
    assert "last_name: must not be empty" in [m for r in res["rejects"].collect() for m in r.errors]
    assert any("zip_code_prefix: unknown" in r.errors and "city: unknown" in r.errors
               for r in res["rejects"].collect())


def test_product_crud(spark):
    t = tables(spark, products=[product("PROD_00009"), product("PROD_00010")],
               stock=[stock("STOCK_00003", "PROD_00010")],
               order_items=[item("ORDER_000001", 1, "PROD_00009")])
    batch = spark.createDataFrame(
        [("Zelda", "Aventure", "Switch", "12", "2023", 59.99, 300, None),
         ("Bad", "X", "Y", "16", "1969", 10.0, 100, "d"), ("Cheap", "X", "Y", "16", "2024", 0.0, 100, "d")],
        "product_name string, product_category string, product_platform string, product_esrb_rating string, "
        "product_release_year string, product_price double, product_weight_g int, product_description string")
    res = mt.add_products(t, batch, AS_OF, 2024)
    p = res["new_products"].collect()
    assert [(r.product_id, r.product_image, r.product_description) for r in p] == [
        ("PROD_00011", "../static/images/Zelda.png", "")]
    s = res["new_stock"].collect()
    assert [(r.stock_id, r.product_id, r.quantity_available, r.seller_id) for r in s] == [
        ("STOCK_00004", "PROD_00011", 10, "SELLER_0001")]
    assert res["rejects"].count() == 2
    # sparse update: null keeps, invalid rejects, unknown id rejects
    ch = spark.createDataFrame(
        [("PROD_00009", "  New name ", None, 30.0), ("PROD_00010", None, " ", None), ("PROD_99999", "x", None, None)],
        "product_id string, new_product_name string, new_product_category string, new_product_price double")
    for c in ("new_product_platform", "new_product_esrb_rating", "new_product_release_year",
              "new_product_weight_g", "new_product_description"):
        ch = ch.withColumn(c, F.lit(None).cast("string"))
    up = mt.update_products(t, ch, 2024)
    got = {r.product_id: r for r in up["products"].collect()}
    assert got["PROD_00009"].product_name == "New name" and float(got["PROD_00009"].product_price) == 30.0
    assert got["PROD_00009"].product_category == "Action"
    assert got["PROD_00010"].product_category == "Action"
    assert {r.key for r in up["rejects"].collect()} == {"PROD_00010", "PROD_99999"}
    # delete: a product on an order line is refused; the other goes with its stock
    d = mt.delete_products(t, spark.createDataFrame([("PROD_00009",), ("PROD_00010",)], "product_id string"))
    assert [r.product_id for r in d["products"].collect()] == ["PROD_00009"]
    assert d["stock"].count() == 0
    assert [r.key for r in d["rejects"].collect()] == ["PROD_00009"]


def test_delete_customer_cascades(spark):
    t = tables(spark, customers=[customer("CUST_000001"), customer("CUST_000002")],
               orders=[order("ORDER_000001", "CUST_000001"), order("ORDER_000002", "CUST_000002")],
               order_items=[item("ORDER_000001", 1, "PROD_00001"), item("ORDER_000002", 1, "PROD_00001")],
               order_payments=[dict(order_id="ORDER_000001", payment_sequential=1, payment_type="paypal",
                                    payment_value=None)],
               order_reviews=[review("REVIEW_000001", "ORDER_000001")],
               stock=[stock("STOCK_00001", "PROD_00001", avail=4)])
    r = mt.delete_customers(t, spark.createDataFrame([("CUST_000001",)], "customer_id string"))
    assert [x.customer_id for x in r["customers"].collect()] == ["CUST_000002"]
    assert [x.order_id for x in r["order_items"].collect()] == ["ORDER_000002"]
    assert r["order_payments"].count() == 0 and r["order_reviews"].count() == 0


def test_reviews_round_trip(spark):
    t = tables(spark, orders=[order("ORDER_000001", "CUST_000001"), order("ORDER_000002", "CUST_000001")],
               order_reviews=[review("REVIEW_000003", "ORDER_000002")])
    batch = spark.createDataFrame(
        [("ORDER_000001", "5", "  Top ", ""), ("ORDER_000002", "4", None, None), ("ORDER_000009", "3", None, None),
         ("ORDER_000001", "2", None, None)],
        "order_id string, review_score string, review_comment_title string, review_comment_message string")
    res = mt.add_reviews(t, batch, AS_OF)
    assert res["new_reviews"].count() == 0  # ORDER_000001 twice in the batch, others invalid
    res = mt.add_reviews(t, batch.limit(1), AS_OF)
    new = res["new_reviews"].collect()
    assert [(r.review_id, r.review_comment_title, r.review_comment_message) for r in new] == [
        ("REVIEW_000004", "Top", None)]
    t2 = t.with_tables(order_reviews=res["order_reviews"])
    ch = spark.createDataFrame([("REVIEW_000004", None, "", "  ")],
                               "review_id string, new_review_score int, new_review_comment_title string, "
                               "new_review_comment_message string")
    up = mt.update_reviews(t2, ch)["order_reviews"].filter("review_id = 'REVIEW_000004'").collect()[0]
    assert (up.review_score, up.review_comment_title, up.review_comment_message) == (5, None, "")
    back = mt.delete_reviews(t2, spark.createDataFrame([("REVIEW_000004",)], "review_id string"))
    assert sorted(r.review_id for r in back["order_reviews"].collect()) == ["REVIEW_000003"]


def test_stock_update(spark):
    t = tables(spark, stock=[stock("STOCK_00001", "PROD_00001", avail=5, in_stock=8, reserved=3),
                             stock("STOCK_00002", "PROD_00001", avail=5)])
    ch = spark.createDataFrame([("STOCK_00001", 20, None, " B-2 ", ""), ("STOCK_00002", None, 50, None, None)],
                               "stock_id string, new_quantity_in_stock int, new_quantity_reserved int, "
                               "new_warehouse_location string, new_stock_condition string")
    for c in ("new_min_stock_level", "new_reorder_point", "new_seller_id"):
        ch = ch.withColumn(c, F.lit(None))
    r = mt.update_stock(t, ch, AS_OF)
    got = {x.stock_id: x for x in r["stock"].collect()}
    assert (got["STOCK_00001"].quantity_available, got["STOCK_00001"].warehouse_location,
            got["STOCK_00001"].stock_condition) == (17, "B-2", "new")
    assert got["STOCK_00002"].quantity_available == 5  # rejected: 5 - 50 < 0
    assert [x.key for x in r["rejects"].collect()] == ["STOCK_00002"]
    # moving a row onto a (seller, product) pair that already exists is refused
    t2 = tables(spark, stock=[stock("STOCK_00001", "PROD_00001", seller="SELLER_0001"),
                              stock("STOCK_00002", "PROD_00001", seller="SELLER_0002")])
    mv = spark.createDataFrame([("STOCK_00002", "SELLER_0001")], "stock_id string, new_seller_id string")
    for c in ("new_quantity_in_stock", "new_quantity_reserved", "new_min_stock_level", "new_reorder_point"):
        mv = mv.withColumn(c, F.lit(None).cast("int"))
    for c in ("new_warehouse_location", "new_stock_condition"):
        mv = mv.withColumn(c, F.lit(None).cast("string"))
    r2 = mt.update_stock(t2, mv, AS_OF)
    assert [x.key for x in r2["rejects"].collect()] == ["STOCK_00002"]
    assert {x.stock_id: x.seller_id for x in r2["stock"].collect()} == {
        "STOCK_00001": "SELLER_0001", "STOCK_00002": "SELLER_0002"}


def test_key_report(spark):
    t = tables(spark, customers=[customer("CUST_000001", email="a@x.fr"), customer("CUST_000002", email="a@x.fr")],
               orders=[order("ORDER_000001", "CUST_000009")])
    keys = qa.key_report({"customers": t.customers}).collect()
    assert [(r.key_kind, r.key_value, r.n) for r in keys] == [("unique", "a@x.fr", 2)]
    fk = qa.foreign_key_report({"orders": t.orders, "customers": t.customers}).collect()
    assert [(r.table_name, r.key_value) for r in fk] == [("orders", "CUST_000009")]


def test_update_customers_admin_and_self(spark):
    t = tables(spark, geolocation=GEO,
               customers=[customer("CUST_000001", email="a@x.fr"), customer("CUST_000002", email="b@x.fr")])
    cols = ("new_first_name string, new_last_name string, new_email string, new_phone string, "
            "new_zip_code_prefix string, new_city string, new_state string, new_address_line1 string, "
            "new_address_line2 string, new_is_admin tinyint")
    ch = spark.createDataFrame(
        [("CUST_000001", " Zoé ", None, "z@x.fr", "06.11.22.33.44", None, None, None, None, None, 1),
         ("CUST_000002", None, None, "a@x.fr", None, "06000", "nice", None, None, None, None)],
        "customer_id string, " + cols)
    admin = mt.update_customers(t, ch, admin=True)
    got = {r.customer_id: r for r in admin["customers"].collect()}
    assert (got["CUST_000001"].first_name, got["CUST_000001"].email, got["CUST_000001"].phone,
            got["CUST_000001"].is_admin) == ("Zoé", "z@x.fr", "0611223344", 1)
    # b's new email belongs to another customer: the whole change is rejected
    assert got["CUST_000002"].email == "b@x.fr" and got["CUST_000002"].zip_code_prefix == 75001
    assert [r.key for r in admin["rejects"].collect()] == ["CUST_000002"]
    # self-service ignores email and the admin flag
    own = {r.customer_id: r for r in mt.update_customers(t, ch, admin=False)["customers"].collect()}
    assert (own["CUST_000001"].email, own["CUST_000001"].is_admin) == ("a@x.fr", 0)
    assert (own["CUST_000002"].zip_code_prefix, own["CUST_000002"].city) == (6000, "nice")


def _people(spark, rows):
    return spark.createDataFrame(
        [(s, "Ana", "Lima", e, "0612345678", z, "Paris", "IDF", None, None, None) for s, e, z in rows],
        "seq long, first_name string, last_name string, email string, phone string, zip_code_prefix string, "
        "city string, state string, address_line1 string, address_line2 string, is_admin tinyint")


def test_one_stripped_email_and_first_valid_row(spark):
    """Whitespace of any kind is stripped before every use of an email; the first valid row
    of an email stands, and an invalid row blocks nobody."""
    t = tables(spark, geolocation=[dict(zip_code_prefix=75001, city="Paris", state="IDF")],
               customers=[customer("CUST_000001", email="taken@x.fr")])
    batch = _people(spark, [(1, "taken@x.fr\t", "75001"), (2, "a@x.fr", "99999"), (3, " a@x.fr", "75001"),
                            (4, "a@x.fr\n", "75001"), (5, "b@x.fr", "75001")])
    res = mt.add_customers(t, batch, AS_OF)
    assert sorted(r.email for r in res["new_customers"].collect()) == ["a@x.fr", "b@x.fr"]
    errors = {r.seq: r.errors for r in res["rejects"].collect()}
    assert errors[1] == ["email: already registered"] and errors[4] == ["email: duplicated in batch"]
    assert errors[2] == ["zip_code_prefix: unknown"] and set(errors) == {1, 2, 4}
    # Without a sequence nobody is first: both valid rows are refused.
    res = mt.add_customers(t, batch.drop("seq"), AS_OF)
    assert [r.email for r in res["new_customers"].collect()] == ["b@x.fr"]


def test_bad_numbers_are_rejects(spark):
    """A value that is no number, or that no column holds, refuses its row, not the job."""
    t = tables(spark, products=[product("PROD_00001")], stock=[stock("STOCK_00001", "PROD_00001"), stock("STOCK_00002", "PROD_00001", seller="SELLER_0002")])
    batch = spark.createDataFrame([("A", "1e12"), ("B", "abc"), ("C", "12.5")], "product_name string, product_price string").selectExpr(
        "*", "'c' product_category", "'p' product_platform", "'16' product_esrb_rating", "'2020' product_release_year",
        "'5' product_weight_g", "'' product_description")
    res = mt.add_products(t, batch, AS_OF, 2024)
    assert [r.product_name for r in res["new_products"].collect()] == ["C"]
    assert errs(res["rejects"], "product_name") == {"A": ["product_price: too large"], "B": ["product_price: must be > 0"]}
    changes = spark.createDataFrame([("STOCK_00001", "abc"), ("STOCK_00002", " 7 ")], "stock_id string, new_min_stock_level string").selectExpr(
        "*", "cast(null as int) new_quantity_in_stock", "cast(null as int) new_quantity_reserved", "cast(null as int) new_reorder_point",
        "cast(null as string) new_seller_id", "cast(null as string) new_warehouse_location", "cast(null as string) new_stock_condition")
    res = mt.update_stock(t, changes, AS_OF)
    assert {r.stock_id: r.min_stock_level for r in res["stock"].collect()} == {"STOCK_00001": 12, "STOCK_00002": 7}
    assert errs(res["rejects"], "key") == {"STOCK_00001": ["min_stock_level: must be an integer"]}


def test_several_status_changes_of_one_order(spark):
    t = tables(spark, products=[product("PROD_00001")], customers=[customer("CUST_000001")],
               stock=[stock("STOCK_00001", "PROD_00001", avail=1)],
               orders=[order("ORDER_000001", "CUST_000001", "created"), order("ORDER_000002", "CUST_000001", "created")],
               order_items=[item("ORDER_000002", 1, "PROD_00001", qty=3)])
    changes = spark.createDataFrame(
        [("ORDER_000001", "shipped", 2), ("ORDER_000001", "approved", 1), ("ORDER_000002", "cancelled", 1), ("ORDER_000002", "created", 2),
         ("ORDER_000002", "cancelled", 3), ("ORDER_000002", "cancelled", 4)], "order_id string, new_status string, seq int")
    res = mt.update_order_status(t, changes, AS_OF)
    got = {r.order_id: r for r in res["orders"].collect()}
    assert got["ORDER_000001"].order_status == "shipped" and got["ORDER_000002"].order_status == "cancelled"
    assert got["ORDER_000001"].order_approved_at == got["ORDER_000001"].order_delivered_carrier_date == AS_OF
    assert [r.quantity_available for r in res["stock"].collect()] == [1 + 3 + 3]  # entered cancelled twice
