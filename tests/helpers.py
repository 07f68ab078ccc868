"""Hand-made canonical tables for edge-case tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from boutique.sources import schemas as S
from boutique.sources.tables import Tables


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def D(x) -> Decimal | None:
    return None if x is None else Decimal(str(x))


def frame(spark, name, rows):
    # Nullable copy of the schema: edge cases include nulls in NOT NULL columns.
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in S.TABLES[name].fields])
    full = []
    for r in rows:
        full.append(tuple(r.get(f.name) for f in schema.fields))
    return spark.createDataFrame(full, schema)


def tables(spark, **rows) -> Tables:
    frames = {n: frame(spark, n, rows.get(n, [])) for n in S.TABLES}
    return Tables.from_frames(spark, **frames)


def customer(cid, first="A", last="B", email=None, zip_=75001, city="Paris", state="IDF", phone=None):
    return dict(customer_id=cid, first_name=first, last_name=last, email=email or f"{cid.lower()}@x.fr",
                zip_code_prefix=zip_, city=city, state=state, phone=phone, is_admin=0,
                total_orders=0, total_spent=D(0))


def order(oid, cid, status="delivered", when="2024-01-10 10:00:00"):
    return dict(order_id=oid, customer_id=cid, order_status=status, order_purchase_timestamp=ts(when))


def item(oid, n, pid, sid="SELLER_0001", price=10, qty=1, freight=0):
    return dict(order_id=oid, order_item_id=n, product_id=pid, seller_id=sid, price=D(price),
                quantity=qty, freight_value=D(freight), shipping_limit_date=ts("2024-01-11 23:59:59"))


def product(pid, name="Jeu", cat="Action", price=20, plat="PS5"):
    return dict(product_id=pid, product_name=name, product_category=cat, product_platform=plat,
                product_esrb_rating="16", product_release_year=2022, product_price=D(price),
                product_weight_g=100)


def stock(sid, pid, seller="SELLER_0001", avail=10, in_stock=None, reserved=0, min_level=12):
    return dict(stock_id=sid, seller_id=seller, product_id=pid,
                quantity_in_stock=avail if in_stock is None else in_stock, quantity_reserved=reserved,
                quantity_available=avail, min_stock_level=min_level, reorder_point=19,
                last_updated=ts("2024-01-01 00:00:00"), warehouse_location="A-01-01", stock_condition="new")


def review(rid, oid, score=5, when="2024-01-15 09:00:00", title="t", msg="m"):
    return dict(review_id=rid, order_id=oid, review_score=score, review_comment_title=title,
                review_comment_message=msg, review_creation_date=ts(when))
