"""Adapter: the driver's TPC-H-like Parquet tables -> the nine canonical shop tables.

The mapping is fixed so that the DuckDB oracle (``boutique.plans.oracle``) can state the
same tables in SQL. Every table is a lazy projection of the raw scan, so filters on raw
columns (order date, keys) still reach the Parquet reader and unused columns are pruned.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutique.functions.ids import format_id, padded
from boutique.sources import schemas as S

# Fixed values of the adapter (mirrored in the oracle SQL).
EPOCH = "2020-01-01 00:00:00"
PEGI_RATINGS = ("3", "7", "12", "16", "18")
REVIEW_TITLES = ("Très déçu", "Décevant", "Correct", "Bon jeu", "Excellent")
PAYMENT_TYPES = {"1": "credit_card", "2": "paypal", "3": "debit_card", "4": "bank_transfer"}
DEFAULT_PAYMENT_TYPE = "credit_card"


def _fmt(prefix_fmt: str, col: str | Column) -> Column:
    """``PREFIX_%0Nd`` of one key column (same text as format_string, cheaper per row)."""
    m = re.fullmatch(r"([A-Z]+_)%0(\d+)d", prefix_fmt)
    return format_id(m.group(1), int(m.group(2)), F.col(col) if isinstance(col, str) else col)


def _epoch() -> Column:
    return F.lit(EPOCH).cast("timestamp_ntz")


def _plus(ts: str | Column, interval: str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return c + F.expr(f"INTERVAL {interval}")


#: The columns used of the raw tables, declared so that no file is opened to infer them.
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


class TestDataAdapter:
    """Builds canonical tables from ``{sf_dir}/{name}.parquet`` on demand (memoised, lazy)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    # ---- canonical tables ------------------------------------------------------------
    def orders(self) -> DataFrame:
        o = self.raw("orders")
        prio = F.substring("o_orderpriority", 1, 1)
        status = (
            F.when(F.col("o_orderstatus") == "F", "delivered")
            .when(F.col("o_orderstatus") == "P", "cancelled")
            .when(prio.isin("1", "2"), "approved")
            .when(prio == "3", "shipped")
            .otherwise("created")
        )
        o = o.select("o_orderkey", "o_custkey", "o_orderdate", status.alias("order_status"))
        st = F.col("order_status")
        return o.select(
            _fmt("ORDER_%06d", "o_orderkey").alias("order_id"),
            _fmt("CUST_%06d", "o_custkey").alias("customer_id"),
            st.alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            F.when(st.isin("approved", "shipped", "delivered"), _plus("o_orderdate", "1 HOUR"))
            .alias("order_approved_at"),
            F.when(st.isin("shipped", "delivered"), _plus("o_orderdate", "2 DAYS"))
            .alias("order_delivered_carrier_date"),
            F.when(st == "delivered", _plus("o_orderdate", "5 DAYS"))
            .alias("order_delivered_customer_date"),
        )

    def order_items(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(
            _fmt("ORDER_%06d", "l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            _fmt("PROD_%05d", "l_partkey").alias("product_id"),
            _fmt("SELLER_%04d", "l_suppkey").alias("seller_id"),
            _plus(F.date_trunc("DAY", "l_shipdate").cast("timestamp_ntz"), "86399 SECONDS")
            .alias("shipping_limit_date"),
            F.col("l_extendedprice").cast(S.MONEY).alias("price"),
            (F.col("l_tax") * 100).cast(S.MONEY).alias("freight_value"),
            F.col("l_quantity").cast("int").alias("quantity"),
        )

    def products(self) -> DataFrame:
        p = self.raw("part")
        pegi = F.array(*[F.lit(x) for x in PEGI_RATINGS])
        return p.select(
            _fmt("PROD_%05d", "p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("product_category"),
            F.col("p_brand").alias("product_platform"),
            F.element_at(pegi, (F.col("p_size") % len(PEGI_RATINGS) + 1).cast("int"))
            .alias("product_esrb_rating"),
            (F.lit(2000) + F.col("p_size") % 25).cast("int").alias("product_release_year"),
            F.col("p_retailprice").cast(S.MONEY).alias("product_price"),
            (F.col("p_size") * 100).cast("int").alias("product_weight_g"),
            F.concat_ws(" ", "p_name", "p_brand").alias("product_description"),
            F.concat(F.lit("../static/images/"), "p_name", F.lit(".png")).alias("product_image"),
            _epoch().alias("created_at"),
        )

    def _nation_region(self) -> DataFrame:
        n, r = self.raw("nation"), self.raw("region")
        return n.join(r, n.n_regionkey == r.r_regionkey, "left").select(
            "n_nationkey", "n_name", "r_name"
        )

    def customers(self) -> DataFrame:
        c = self.raw("customer")
        nr = self._nation_region()
        j = c.join(nr, c.c_nationkey == nr.n_nationkey, "left")
        return j.select(
            _fmt("CUST_%06d", "c_custkey").alias("customer_id"),
            F.substring_index("c_name", "#", 1).alias("first_name"),
            F.substring_index("c_name", "#", -1).alias("last_name"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            F.when(F.col("c_custkey") == 0, 1).otherwise(0).cast("tinyint").alias("is_admin"),
            F.concat(F.lit("0"), (F.col("c_custkey") % 9 + 1).cast("string"), padded(F.col("c_custkey"), 8))
            .alias("phone"),
            F.col("c_nationkey").alias("zip_code_prefix"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
            F.concat(F.col("c_custkey").cast("string"), F.lit(" rue "), F.coalesce("n_name", F.lit("null")))
            .alias("address_line1"),
            F.lit(None).cast("string").alias("address_line2"),
            F.lit(None).cast("string").alias("customer_segment"),
            _epoch().alias("registration_date"),
            F.lit(None).cast("timestamp_ntz").alias("last_purchase_date"),
            F.lit(0).alias("total_orders"),
            F.lit(0).cast(S.AMOUNT).alias("total_spent"),
        )

    def geolocation(self) -> DataFrame:
        nr = self._nation_region()
        return nr.select(
            F.col("n_nationkey").alias("zip_code_prefix"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
            F.col("r_name").alias("region"),
            F.lit(None).cast(S.COORD).alias("latitude"),
            F.lit(None).cast(S.COORD).alias("longitude"),
        )

    def sellers(self) -> DataFrame:
        s = self.raw("supplier")
        nr = self._nation_region()
        j = s.join(nr, s.s_nationkey == nr.n_nationkey, "left")
        return j.select(
            _fmt("SELLER_%04d", "s_suppkey").alias("seller_id"),
            F.col("s_name").alias("seller_name"),
            F.when(F.col("s_acctbal") >= 5000, "Store").otherwise("Standard").alias("seller_type"),
            F.col("s_nationkey").alias("zip_code_prefix"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
            _epoch().alias("created_at"),
        )

    def stock(self) -> DataFrame:
        li = self.raw("lineitem")
        g = li.groupBy("l_partkey", "l_suppkey").agg(
            F.sum("l_quantity").cast("int").alias("quantity_in_stock"),
            F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0))
            .cast("int")
            .alias("quantity_reserved"),
            F.max("l_shipdate").alias("last_updated"),
        )
        return g.select(
            F.concat(F.lit("STOCK_"), padded(F.col("l_partkey"), 5), F.lit("_"),
                     padded(F.col("l_suppkey"), 4)).alias("stock_id"),
            _fmt("SELLER_%04d", "l_suppkey").alias("seller_id"),
            _fmt("PROD_%05d", "l_partkey").alias("product_id"),
            "quantity_in_stock",
            "quantity_reserved",
            (F.col("quantity_in_stock") - F.col("quantity_reserved")).alias("quantity_available"),
            F.lit(12).alias("min_stock_level"),
            F.lit(19).alias("reorder_point"),
            "last_updated",
            F.concat(F.lit("A-"), padded(F.col("l_suppkey") % 100, 2), F.lit("-"),
                     padded(F.col("l_partkey") % 100, 2)).alias("warehouse_location"),
            F.lit("new").alias("stock_condition"),
        )

    def _reviewed(self) -> DataFrame:
        return self.raw("orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 2 == 0))

    @staticmethod
    def _review_columns() -> dict:
        score = (F.col("o_orderkey") * 7 % 5 + 1).cast("int")
        return {
            "review_id": _fmt("REVIEW_%06d", "o_orderkey"),
            "order_id": _fmt("ORDER_%06d", "o_orderkey"),
            "review_score": score,
            "review_comment_title": F.element_at(F.array(*[F.lit(t) for t in REVIEW_TITLES]), score),
            "review_comment_message": F.col("text"),
            "review_creation_date": _plus("o_orderdate", "7 DAYS"),
        }

    def review_facts(self) -> DataFrame:
        """The reviews without their messages: ``documents`` isn't read."""
        return self._reviewed().select(*[e.alias(c) for c, e in self._review_columns().items() if c != "review_comment_message"])

    def review_rows(self) -> DataFrame:
        """The reviews with the number of their message's document in its place (``_message``)."""
        n_docs = self.raw("documents").select(F.count(F.lit(1))).scalar()
        columns = self._review_columns() | {"review_comment_message": F.col("o_orderkey") % n_docs}
        return self._reviewed().select(*[e.alias("_message" if c == "review_comment_message" else c) for c, e in columns.items()])

    def with_messages(self, reviews: DataFrame) -> DataFrame:
        """:meth:`review_rows` with their messages; other columns of theirs stay."""
        docs = self.raw("documents").select(F.col("doc_id").alias("_message"), F.col("text").alias("review_comment_message"))
        return reviews.join(docs, "_message", "left").drop("_message")

    def order_reviews(self) -> DataFrame:
        return self.with_messages(self.review_rows()).select(*self._review_columns())

    def order_payments(self) -> DataFrame:
        o = self.raw("orders")
        prio = F.substring("o_orderpriority", 1, 1)
        ptype = F.lit(DEFAULT_PAYMENT_TYPE)
        for k, v in reversed(list(PAYMENT_TYPES.items())):
            ptype = F.when(prio == k, v).otherwise(ptype)
        return o.select(
            _fmt("ORDER_%06d", "o_orderkey").alias("order_id"),
            F.lit(1).alias("payment_sequential"),
            ptype.alias("payment_type"),
            (F.col("o_orderkey") % 4 + 1).cast("int").alias("payment_installments"),
            F.col("o_totalprice").cast(S.MONEY).alias("payment_value"),
            F.when(F.col("o_orderstatus") != "P", _plus("o_orderdate", "1 HOUR"))
            .alias("payment_approved_at"),
        )

    def carts(self, qty_factor: int = 1) -> DataFrame:
        """Purchase events as carts: (cart_id=user, product, qty summed per pair)."""
        e = self.raw("events").filter(F.col("event_type") == "purchase")
        k = F.get_json_object("props", "$.k").cast("bigint")
        return (
            e.select(
                F.col("user_id").alias("cart_id"),
                format_id("PROD_", 5, k).alias("product_id"),
                ((F.col("event_id") % 3 + 1) * qty_factor).cast("int").alias("qty"),
            )
            .groupBy("cart_id", "product_id")
            .agg(F.sum("qty").cast("int").alias("qty"))
        )
