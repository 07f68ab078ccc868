"""Table maintenance as set-based jobs.

Each operator takes the current tables and a batch of changes and returns the new
version of the touched tables plus the rejected changes (with reasons). Nothing is
updated in place: callers write the returned tables to a new location (``Tables.write``).
"Sparse" updates keep the old value where the change holds null.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutique import constants as K
from boutique.functions.numbers import python_float, python_int
from boutique.functions.text import (
    blank_to_null_stripped,
    digits_only_phone,
    strip_python,
)
from boutique.functions.ids import id_number
from boutique.operators import changes as cg
from boutique.operators import quality as qa
from boutique.operators.customers import customer_segments
from boutique.operators.ordered import assign_ids, row_numbers
from boutique.session import materialize
from boutique.sources.schemas import AMOUNT, MONEY
from boutique.sources.tables import Tables


def _ts(as_of: dt.datetime) -> Column:
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def _conform(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns of ``like`` in its order and types (for unions)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def _reject(df: DataFrame, key: str, message: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.array(F.lit(message)).alias("errors"))


def _rejects(checked: DataFrame, key: str) -> DataFrame:
    return checked.filter(F.size("errors") > 0).select(
        F.col(key).cast("string").alias("key"), "errors")


# --------------------------------------------------------------------------------- products
def add_products(t: Tables, batch: DataFrame, as_of: dt.datetime, as_of_year: int | None = None) -> dict:
    """Validate, number (PROD_, then one default stock row each, STOCK_), append."""
    year = as_of_year or as_of.year
    checked = materialize(qa.check(batch, qa.product_rules(year)))
    valid = checked.filter(F.size("errors") == 0).drop("errors")
    clean = valid.select(
        *[strip_python(c).alias(c) for c in ("product_name", "product_category", "product_platform",
                                           "product_esrb_rating")],
        python_int("product_release_year").alias("product_release_year"),
        python_float("product_price").try_cast(MONEY).alias("product_price"),
        python_float("product_weight_g").try_cast("int").alias("product_weight_g"),
        F.coalesce(F.col("product_description"), F.lit("")).alias("product_description"),
    )
    prefix, width = K.ID_FORMATS["product_id"]
    order = ["product_name", "product_platform", "product_category", "product_esrb_rating",
             "product_release_year", "product_price", "product_weight_g", "product_description"]
    numbered = assign_ids(clean, t.products, "product_id", prefix, width, order)
    new_products = numbered.select(
        "product_id", "product_name", "product_category", "product_platform", "product_esrb_rating",
        "product_release_year", "product_price", "product_weight_g", "product_description",
        F.concat(F.lit(K.PRODUCT_IMAGE_PREFIX), "product_name", F.lit(K.PRODUCT_IMAGE_SUFFIX))
        .alias("product_image"),
        _ts(as_of).alias("created_at"),
    )
    sprefix, swidth = K.ID_FORMATS["stock_id"]
    d = K.NEW_PRODUCT_STOCK
    pnum = id_number("product_id", K.ID_FORMATS["product_id"][0])
    stock_rows = assign_ids(new_products.select("product_id"), t.stock, "stock_id", sprefix, swidth,
                            [pnum, "product_id"])
    new_stock = stock_rows.select(
        "stock_id", F.lit(d["seller_id"]).alias("seller_id"), "product_id",
        *[F.lit(d[c]).alias(c) for c in ("quantity_in_stock", "quantity_reserved", "quantity_available",
                                         "min_stock_level", "reorder_point")],
        _ts(as_of).alias("last_updated"),
        F.lit(d["warehouse_location"]).alias("warehouse_location"),
        F.lit(d["stock_condition"]).alias("stock_condition"),
    )
    new_products = _conform(new_products, t.products)
    new_stock = _conform(new_stock, t.stock)
    return {
        "products": t.products.unionByName(new_products),
        "stock": t.stock.unionByName(new_stock),
        "new_products": new_products,
        "new_stock": new_stock,
        "rejects": checked.filter(F.size("errors") > 0),
    }


def update_products(t: Tables, changes: DataFrame, as_of_year: int) -> dict:
    """Sparse product update; a change with any invalid field is rejected whole. Several
    changes of a product (in the order of ``seq``) leave the last value of each field."""
    changes, dup = cg.ordered(changes, "product_id")
    found, missing = qa.split_existing(changes, t.products, "product_id")
    nn = lambda c: F.col(c).isNull()
    rules = [
        qa.Rule("product_name: must not be empty", nn("new_product_name") | qa.non_empty("new_product_name")),
        qa.Rule("product_category: must not be empty",
                nn("new_product_category") | qa.non_empty("new_product_category")),
        qa.Rule("product_platform: must not be empty",
                nn("new_product_platform") | qa.non_empty("new_product_platform")),
        qa.Rule("product_esrb_rating: must not be empty",
                nn("new_product_esrb_rating") | qa.non_empty("new_product_esrb_rating")),
        qa.Rule("product_release_year: out of range",
                nn("new_product_release_year") | qa.valid_year("new_product_release_year", as_of_year)),
        qa.Rule("product_price: must be > 0", nn("new_product_price") | qa.positive_number("new_product_price")),
        qa.Rule("product_price: too large", qa.storable_money("new_product_price")),
        qa.Rule("product_weight_g: must be > 0",
                nn("new_product_weight_g") | qa.positive_number("new_product_weight_g")),
        qa.Rule("product_weight_g: too large", qa.storable_int("new_product_weight_g")),
    ]
    checked = qa.check(found, rules)
    casts = {
        "product_name": strip_python("new_product_name"),
        "product_category": strip_python("new_product_category"),
        "product_platform": strip_python("new_product_platform"),
        "product_esrb_rating": strip_python("new_product_esrb_rating"),
        "product_release_year": python_int("new_product_release_year"),
        "product_price": python_float("new_product_price").try_cast(MONEY),
        "product_weight_g": python_float("new_product_weight_g").try_cast("int"),
        "product_description": F.col("new_product_description"),
    }
    ok = cg.fold(checked.filter(F.size("errors") == 0), "product_id", [f"new_{c}" for c in casts])
    ch = ok.select("product_id", *[v.alias(f"_n_{k}") for k, v in casts.items()])
    j = t.products.join(ch, "product_id", "left")
    products = j.select(*[
        F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in casts else F.col(c)
        for c in t.products.columns
    ])
    rejects = _rejects(checked, "product_id").unionByName(missing.select(
        F.col("product_id").alias("key"), "errors")).unionByName(dup)
    return {"products": products, "rejects": rejects}


def delete_products(t: Tables, product_ids: DataFrame) -> dict:
    """Delete products and their stock rows; a product on any order line is refused."""
    ids = product_ids.select("product_id").distinct()
    found, missing = qa.split_existing(ids, t.products, "product_id")
    in_use = found.join(t.order_items.select("product_id"), "product_id", "left_semi")
    gone = found.join(in_use, "product_id", "left_anti")
    rejects = _reject(in_use, "product_id", "product_id: referenced by order lines").unionByName(
        missing.select(F.col("product_id").alias("key"), "errors"))
    return {
        "products": t.products.join(gone, "product_id", "left_anti"),
        "stock": t.stock.join(gone, "product_id", "left_anti"),
        "deleted": gone,
        "rejects": rejects,
    }


# -------------------------------------------------------------------------------- customers
def add_customers(t: Tables, batch: DataFrame, as_of: dt.datetime) -> dict:
    """U4: validate (V1, V5-V9), number (CUST_, width 6) in email order, append with zeroed
    statistics and registration time ``as_of``."""
    checked = materialize(qa.customer_batch_check(batch, t.customers, t.geolocation))
    valid = checked.filter(F.size("errors") == 0).drop("errors")
    prefix, width = K.ID_FORMATS["customer_id"]
    clean = valid.select(
        strip_python("first_name").alias("first_name"), strip_python("last_name").alias("last_name"),
        "email", F.coalesce("phone", F.lit("")).alias("phone"),
        python_int("zip_code_prefix").alias("zip_code_prefix"),
        "city", "state",
        F.coalesce("address_line1", F.lit("")).alias("address_line1"),
        F.coalesce("address_line2", F.lit("")).alias("address_line2"),
        F.coalesce(F.col("is_admin").cast("tinyint"), F.lit(0).cast("tinyint")).alias("is_admin"),
    )
    numbered = assign_ids(clean, t.customers, "customer_id", prefix, width, ["email"])
    new_rows = numbered.select(
        "*", F.lit(None).cast("string").alias("customer_segment"),
        _ts(as_of).alias("registration_date"),
        F.lit(None).cast("timestamp_ntz").alias("last_purchase_date"),
        F.lit(0).alias("total_orders"), F.lit(0).cast(MONEY).alias("total_spent"),
    )
    new_rows = _conform(new_rows, t.customers)
    return {"customers": t.customers.unionByName(new_rows), "new_customers": new_rows,
            "rejects": checked.filter(F.size("errors") > 0)}


def update_customers(t: Tables, changes: DataFrame, admin: bool = True) -> dict:
    """Sparse customer update. Self-service changes may not touch email or is_admin.

    Changed fields are validated as on insert (names non-empty, email, phone, zip, and the
    geolocation membership of changed zip/city/state). With a ``seq``, changes apply one
    after the other: an email can be taken once its customer has given it up, and several
    changes of a customer leave the last value of each field. Without, a changed email must
    not belong to another customer at the start nor repeat in the batch.
    """
    in_order = "seq" in changes.columns
    changes, dup = cg.ordered(changes, "customer_id")
    found, missing = qa.split_existing(changes, t.customers, "customer_id")
    if not admin:
        found = found.withColumn("new_email", F.lit(None).cast("string")).withColumn(
            "new_is_admin", F.lit(None).cast("tinyint"))
    nn = lambda c: F.col(c).isNull()
    found = found.withColumn("new_email", strip_python("new_email"))
    flagged = qa.geo_flags(found, t.geolocation, "new_zip_code_prefix", "new_city", "new_state")
    rules = [
        qa.Rule("first_name: must not be empty", nn("new_first_name") | qa.non_empty("new_first_name")),
        qa.Rule("last_name: must not be empty", nn("new_last_name") | qa.non_empty("new_last_name")),
        qa.Rule("email: invalid", nn("new_email") | qa.valid_email("new_email")),
        qa.Rule("phone: 10 digits starting with 0", nn("new_phone") | qa.valid_phone("new_phone")),
        qa.Rule("zip_code_prefix: exactly 5 digits", nn("new_zip_code_prefix") | qa.valid_zip("new_zip_code_prefix")),
        qa.Rule("zip_code_prefix: unknown", F.col("zip_ok")),
        qa.Rule("city: unknown", F.col("city_ok")),
        qa.Rule("state: unknown", F.col("state_ok")),
    ]
    checked = materialize(qa.check(flagged, rules).drop("zip_ok", "city_ok", "state_ok"))
    if admin:
        amount = F.lit(None).cast("bigint")
        events = checked.filter((F.size("errors") == 0) & F.col("new_email").isNotNull()).select(
            cg.N, F.col("customer_id").alias("holder"), F.col("new_email").alias("wanted"), amount.alias("set_a"), amount.alias("set_b"))
        zero = F.lit(0).cast("bigint")
        holders = t.customers.select(F.col("customer_id").alias("holder"), strip_python("email").alias("held"), zero.alias("a"), zero.alias("b"))
        taken = F.when(F.col("taken"), F.lit("email: already registered"))
        if in_order:
            verdict = cg.settle(events, holders).select(cg.N, taken.alias("_email"))
        else:
            verdict = cg.settle_unordered(events, holders).select(
                cg.N, F.coalesce(taken, F.when(F.col("repeated"), F.lit("email: duplicated in batch"))).alias("_email"))
        checked = materialize(checked.join(verdict, cg.N, "left").withColumn(
            "errors", F.array_compact(F.concat("errors", F.array("_email")))).drop("_email"))
    casts = {
        "first_name": strip_python("new_first_name"),
        "last_name": strip_python("new_last_name"),
        "email": F.col("new_email"),
        "phone": F.when(F.trim("new_phone") == "", F.lit("")).otherwise(digits_only_phone("new_phone")),
        "zip_code_prefix": python_int("new_zip_code_prefix"),
        "city": F.col("new_city"),
        "state": F.col("new_state"),
        "address_line1": F.col("new_address_line1"),
        "address_line2": F.col("new_address_line2"),
        "is_admin": F.col("new_is_admin").cast("tinyint"),
    }
    ok = cg.fold(checked.filter(F.size("errors") == 0), "customer_id", [f"new_{c}" for c in casts])
    ch = ok.select("customer_id", *[v.alias(f"_n_{k}") for k, v in casts.items()])
    j = t.customers.join(ch, "customer_id", "left")
    customers = j.select(*[
        F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in casts else F.col(c)
        for c in t.customers.columns
    ])
    rejects = _rejects(checked, "customer_id").unionByName(
        missing.select(F.col("customer_id").alias("key"), "errors")).unionByName(dup)
    return {"customers": customers, "rejects": rejects}


def delete_customers(t: Tables, customer_ids: DataFrame) -> dict:
    """Delete customers and their orders; lines, payments and reviews of those orders
    go with them (cascade). Stock is not restored."""
    ids = customer_ids.select("customer_id").distinct()
    found, missing = qa.split_existing(ids, t.customers, "customer_id")
    gone_orders = t.orders.join(found, "customer_id", "left_semi").select("order_id")
    return {
        "customers": t.customers.join(found, "customer_id", "left_anti"),
        "orders": t.orders.join(found, "customer_id", "left_anti"),
        "order_items": t.order_items.join(gone_orders, "order_id", "left_anti"),
        "order_payments": t.order_payments.join(gone_orders, "order_id", "left_anti"),
        "order_reviews": _reviews(t, t.review_rows.join(gone_orders, "order_id", "left_anti")),
        "rejects": missing.select(F.col("customer_id").alias("key"), "errors"),
    }


def refresh_customer_stats(t: Tables, customer_ids: DataFrame | None = None,
                           thresholds=K.SEGMENT_THRESHOLDS) -> DataFrame:
    """Customers table with statistics and segment recomputed (for the given ids, or
    for everyone). Recomputing rather than incrementing makes it idempotent."""
    target = t.customers if customer_ids is None else t.customers.join(
        customer_ids.select("customer_id").distinct(), "customer_id", "left_semi")
    stats = customer_segments(t, thresholds, customers=target).select(
        "customer_id",
        F.col("total_orders").cast("int").alias("_o"),
        F.col("total_spent").cast(AMOUNT).alias("_s"),
        F.col("last_purchase_date").alias("_l"),
        F.col("customer_segment").alias("_g"),
    )
    j = t.customers.join(stats, "customer_id", "left")
    hit = F.col("_o").isNotNull()
    repl = {"total_orders": "_o", "total_spent": "_s", "last_purchase_date": "_l", "customer_segment": "_g"}
    return j.select(*[
        F.when(hit, F.col(repl[c])).otherwise(F.col(c)).alias(c) if c in repl else F.col(c)
        for c in t.customers.columns
    ])


# ----------------------------------------------------------------------------------- orders
def update_order_status(t: Tables, changes: DataFrame, as_of: dt.datetime) -> dict:
    """U9 + U10: apply status changes, per order in the order of ``seq``.

    The last status of an order stands. Every approved / shipped / delivered among its
    changes stamps its timestamp column with ``as_of``. Whenever the changes enter
    ``cancelled`` from another status, the order's line quantities go back to the (product,
    seller) stock rows; a repeated cancel restores nothing. Customer statistics of the
    touched customers are recomputed. No transition order is enforced (as in the shop).
    """
    if "seq" not in changes.columns:
        changes = changes.withColumn("seq", F.lit(0))
    checked = qa.check(changes, [qa.Rule("new_status: not an allowed status", qa.valid_status("new_status"))])
    bad = _rejects(checked, "order_id")
    ok = checked.filter(F.size("errors") == 0).drop("errors")
    found, missing = qa.split_existing(ok, t.orders, "order_id")
    steps = materialize(row_numbers(found.select("order_id", "new_status", "seq"), "_n", ["seq", "new_status"], ["order_id"]))
    earlier = steps.select("order_id", (F.col("_n") + 1).alias("_n"), F.col("new_status").alias("_from"))
    steps = steps.join(earlier, ["order_id", "_n"], "left").join(
        t.orders.select("order_id", F.col("order_status").alias("_stored")), "order_id")
    enters = (F.col("new_status") == K.CANCELLED) & (F.coalesce("_from", "_stored", F.lit("")) != K.CANCELLED)
    per_order = materialize(steps.groupBy("order_id").agg(
        F.max_by("new_status", "_n").alias("_new"), F.sum(enters.cast("int")).alias("_cancels"),
        *[F.bool_or(F.col("new_status") == s).alias(f"_did_{s}") for s in K.STATUS_STAMP_COLUMNS]))
    ts = _ts(as_of)
    j = t.orders.join(per_order, "order_id", "left")
    stamps = {col: s for s, col in K.STATUS_STAMP_COLUMNS.items()}
    orders = j.select(*[
        F.coalesce("_new", F.col(c)).alias(c) if c == "order_status"
        else F.when(F.col(f"_did_{stamps[c]}"), ts).otherwise(F.col(c)).alias(c) if c in stamps
        else F.col(c)
        for c in t.orders.columns
    ])
    cancels = per_order.filter("_cancels > 0").select("order_id", F.col("_cancels").alias("times"))
    stock = restore_stock(t, cancels, as_of)
    touched = t.orders.join(per_order.select("order_id"), "order_id", "left_semi").select("customer_id")
    t2 = t.with_tables(orders=orders, stock=stock)
    customers = refresh_customer_stats(t2, touched)
    rejects = bad.unionByName(missing.select(F.col("order_id").alias("key"), "errors"))
    return {"orders": orders, "stock": stock, "customers": customers, "rejects": rejects}


def cancel_orders(t: Tables, requests: DataFrame, as_of: dt.datetime) -> dict:
    """U9 as customers use it: cancel an order that is still created or approved.

    ``requests``: order_id, customer_id (who asks; null for an admin). A customer's own orders
    only. Of several requests for one order that may be cancelled one stands; the others come
    too late, as it is cancelled by then. Stock and statistics follow as in U9.
    """
    rows = materialize(requests.select("order_id", "customer_id").withColumn("_row", F.monotonically_increasing_id()))
    orders = t.orders.select("order_id", F.col("customer_id").alias("_owner"), "order_status")
    j = rows.join(orders, "order_id", "left")
    checked = qa.check(j, [
        qa.Rule("order_id: not found", F.col("_owner").isNotNull()),
        qa.Rule("customer_id: not the customer's order", F.col("_owner").isNull() | F.col("customer_id").isNull() | (F.col("_owner") == F.col("customer_id"))),
        qa.Rule("order_status: can no longer be cancelled", F.col("_owner").isNull() | F.col("order_status").isin(*K.CANCELLABLE_STATUSES)),
    ])
    checked = materialize(checked)
    first = checked.filter(F.size("errors") == 0).groupBy("order_id").agg(F.min("_row").alias("_first"))
    late = (F.size("errors") == 0) & (F.col("_row") != F.col("_first"))
    checked = materialize(checked.join(first, "order_id", "left").withColumn(
        "errors", F.when(late, F.array(F.lit("order_status: can no longer be cancelled"))).otherwise(F.col("errors"))))
    accepted = checked.filter(F.size("errors") == 0).select("order_id", F.lit(K.CANCELLED).alias("new_status"))
    done = update_order_status(t, accepted, as_of)
    return done | {"rejects": _rejects(checked, "order_id")}


def restore_stock(t: Tables, cancelled_orders: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Add the line quantities of the cancelled orders (order_id and, optionally, how
    many ``times``) back to the stock row of the same (product, seller); all lines on one
    stock row are summed."""
    if "times" not in cancelled_orders.columns:
        cancelled_orders = cancelled_orders.select("order_id").distinct().withColumn("times", F.lit(1))
    back = (
        t.order_items.join(cancelled_orders.select("order_id", "times"), "order_id")
        .groupBy("product_id", "seller_id")
        .agg(F.sum(F.coalesce("quantity", F.lit(K.DEFAULT_QUANTITY)) * F.col("times")).cast("int").alias("_back"))
    )
    j = t.stock.join(back, ["product_id", "seller_id"], "left")
    hit = F.col("_back").isNotNull()
    return j.select(*[
        (F.col(c) + F.coalesce("_back", F.lit(0))).alias(c) if c == "quantity_available"
        else F.when(hit, _ts(as_of)).otherwise(F.col(c)).alias(c) if c == "last_updated"
        else F.col(c)
        for c in t.stock.columns
    ])


# ------------------------------------------------------------------------------------ stock
def update_stock(t: Tables, changes: DataFrame, as_of: dt.datetime) -> dict:
    """Sparse stock update. Numbers: null keeps. Texts: null or blank keeps, else
    stripped. Available is recomputed as in stock - reserved; a negative result rejects.

    With a ``seq``, each change is judged by what the accepted ones before it have left: the
    row's numbers, and which row holds a seller's place for the product (a place given up
    earlier in the batch can be taken). Without, a place held at the start, or wanted by two
    changes, is refused; changes that break another rule don't count.
    """
    in_order = "seq" in changes.columns
    t = t.computed_once("stock")  # read six times below
    changes, dup = cg.ordered(changes, "stock_id")
    held = t.stock.select("stock_id", "product_id", "seller_id", "quantity_in_stock", "quantity_reserved")
    found, missing = qa.split_existing(changes, held, "stock_id")
    numbers = ("quantity_in_stock", "quantity_reserved", "min_stock_level", "reorder_point")
    texts = ("seller_id", "warehouse_location", "stock_condition")
    blank = lambda c: F.coalesce(strip_python(F.col(c)), F.lit("")) == ""
    found = found.withColumns({f"new_{c}": F.when(~blank(f"new_{c}"), strip_python(f"new_{c}")) for c in texts})
    checked = qa.check(found, [qa.Rule(f"{c}: must be an integer", qa.integer_or_null(f"new_{c}")) for c in numbers])
    checked = materialize(checked.withColumns(
        {f"new_{c}": python_int(f"new_{c}") for c in numbers}))

    place = lambda seller: F.concat(F.length(seller).cast("string"), F.lit(":"), seller, F.coalesce("product_id", F.lit("")))
    products = held.select("stock_id", "product_id")
    events = checked.filter(F.size("errors") == 0).join(products, "stock_id").select(
        cg.N, F.col("stock_id").alias("holder"), place(F.col("new_seller_id")).alias("wanted"),
        F.col("new_quantity_in_stock").cast("bigint").alias("set_a"), F.col("new_quantity_reserved").cast("bigint").alias("set_b"))
    holders = held.select(
        F.col("stock_id").alias("holder"), place(F.col("seller_id")).alias("held"),
        F.col("quantity_in_stock").cast("bigint").alias("a"), F.col("quantity_reserved").cast("bigint").alias("b"))
    verdict = cg.settle(events, holders).withColumn("repeated", F.lit(False)) if in_order else cg.settle_unordered(events, holders)
    refused = F.array_compact(F.array(
        F.when(F.col("large"), F.lit("quantity_available: too large")),
        F.when(F.col("negative"), F.lit("quantity_available: negative (stock < reserved)")),
        F.when(F.col("taken") | F.col("repeated"), F.lit("seller_id: the seller already stocks this product"))))
    checked = materialize(checked.join(verdict.select(cg.N, refused.alias("_refused")), cg.N, "left").withColumn(
        "errors", F.concat("errors", F.coalesce("_refused", F.array().cast("array<string>")))).drop("_refused"))
    ok = cg.fold(checked.filter(F.size("errors") == 0), "stock_id", [f"new_{c}" for c in (*numbers, *texts)])
    j = t.stock.join(ok.withColumn("_hit", F.lit(True)), "stock_id", "left")
    hit = F.col("_hit").isNotNull()
    new = {c: F.coalesce(f"new_{c}", c) for c in (*numbers, *texts)}
    new["quantity_available"] = F.when(hit, new["quantity_in_stock"] - new["quantity_reserved"]).otherwise(F.col("quantity_available"))
    new["last_updated"] = F.when(hit, _ts(as_of)).otherwise(F.col("last_updated"))
    stock = _conform(j.select(*[new.get(c, F.col(c)).alias(c) for c in t.stock.columns]), t.stock)
    rejects = _rejects(checked, "stock_id").unionByName(
        missing.select(F.col("stock_id").alias("key"), "errors")).unionByName(dup)
    return {"stock": stock, "rejects": rejects}


# ---------------------------------------------------------------------------------- reviews
def add_reviews(t: Tables, batch: DataFrame, as_of: dt.datetime) -> dict:
    """Validate (V10, V11), number (REVIEW_, width 6) in order-id order, append."""
    checked = materialize(qa.review_batch_check(batch, t.orders, t.order_reviews))
    valid = checked.filter(F.size("errors") == 0).drop("errors")
    prefix, width = K.ID_FORMATS["review_id"]
    clean = valid.select(
        "order_id",
        python_int("review_score").alias("review_score"),
        blank_to_null_stripped("review_comment_title").alias("review_comment_title"),
        blank_to_null_stripped("review_comment_message").alias("review_comment_message"),
        _ts(as_of).alias("review_creation_date"),
    )
    onum = id_number("order_id", K.ID_FORMATS["order_id"][0])
    numbered = assign_ids(clean, t.order_reviews, "review_id", prefix, width, [onum, "order_id"])
    new_rows = _conform(numbered, t.order_reviews)
    return {"order_reviews": t.order_reviews.unionByName(new_rows), "new_reviews": new_rows,
            "rejects": checked.filter(F.size("errors") > 0)}


def _reviews(t: Tables, rows: DataFrame) -> DataFrame:
    """``rows`` (of ``t.review_rows``) as the review table, messages included."""
    return t.with_messages(rows).select(*t.order_reviews.columns)


def update_reviews(t: Tables, changes: DataFrame) -> dict:
    """Score is sparse (null keeps; otherwise 1..5); title and message: null keeps,
    empty clears, other text is stripped. Several changes of a review (in the order of
    ``seq``) leave the last value of each field."""
    changes, dup = cg.ordered(changes, "review_id")
    found, missing = qa.split_existing(changes, t.review_facts, "review_id")
    checked = qa.check(found, [qa.Rule("review_score: integer from 1 to 5",
                                       F.col("new_review_score").isNull() | qa.valid_score("new_review_score"))])
    fields = [f"new_{c}" for c in ("review_score", "review_comment_title", "review_comment_message")]
    ok = cg.fold(checked.filter(F.size("errors") == 0), "review_id", fields)

    def text(c):
        v = F.col(f"new_{c}")
        return F.when(v.isNull(), F.col(c)).otherwise(blank_to_null_stripped(v))

    j = t.with_messages(t.review_rows.join(ok, "review_id", "left"))
    reviews = j.select(*[
        F.coalesce(python_int("new_review_score"), F.col(c)).alias(c)
        if c == "review_score" else text(c).alias(c) if c in ("review_comment_title", "review_comment_message")
        else F.col(c)
        for c in t.order_reviews.columns
    ])
    rejects = _rejects(checked, "review_id").unionByName(
        missing.select(F.col("review_id").alias("key"), "errors")).unionByName(dup)
    return {"order_reviews": reviews, "rejects": rejects}


def delete_reviews(t: Tables, review_ids: DataFrame) -> dict:
    """Delete reviews by id; unknown ids are rejected."""
    ids = review_ids.select("review_id").distinct()
    found, missing = qa.split_existing(ids, t.review_facts, "review_id")
    return {"order_reviews": _reviews(t, t.review_rows.join(found, "review_id", "left_anti")),
            "rejects": missing.select(F.col("review_id").alias("key"), "errors")}
