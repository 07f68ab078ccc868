"""Plans: what is read and how often lines are shuffled."""

import re

import pytest

import boutique.plans.all_queries  # noqa: F401
from boutique.operators import catalog, reviews
from boutique.plans.registry import QUERIES
from boutique.sources.tables import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["product_ratings", "product_scores", "catalog", "catalog_all", "dq_keys", "dq_foreign_keys"])
def test_texts_are_not_read(spark, sf_small, name):
    assert "documents.parquet" not in plan(QUERIES[name](spark, sf_small))


def test_weighted_profile_reads_no_texts(spark, sf_small):
    from boutique.operators.profile import weighted_tables

    assert all("documents.parquet" not in plan(d) for d in weighted_tables(Tables.from_testdata(spark, sf_small)))


def test_lines_are_shuffled_once(spark, sf_small):
    """Joining to the reviews and dropping repeats both use the partitioning by order."""
    t = Tables.from_testdata(spark, sf_small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(catalog.product_scores(t))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_order = re.findall(r"Exchange hashpartitioning\(order_id[^\n]*", text)
    assert len(by_order) == 2  # lines and reviews
    assert not re.findall(r"Exchange hashpartitioning\(order_id#\d+, product_id", text)


def test_first_lines_in_one_hash_aggregate(spark, sf_small):
    """One scan and one exchange of the lines, no join, nothing sorted."""
    text = plan(reviews.first_product_per_order(Tables.from_testdata(spark, sf_small).order_items))
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1
    assert "HashAggregate" in text and not re.search("SortAggregate|Join|Sort ", text)


def _without_broadcast(spark, build):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return plan(build())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["update_reviews", "delete_customers_reviews"])
def test_messages_are_joined_last(spark, sf_small, name):
    """Only the documents themselves are shuffled with their texts, not the reviews."""
    text = _without_broadcast(spark, lambda: QUERIES[name](spark, sf_small))
    assert text.index("hashpartitioning(_message") < text.index("hashpartitioning(review_id" if name == "update_reviews" else "hashpartitioning(order_id")


def test_reviews_are_sorted_once_per_review(spark, sf_small):
    """Repeated for the products of the order after the sort, not before."""
    text = plan(QUERIES["product_reviews"](spark, sf_small))
    assert text.index("Generate explode") < text.index("Exchange rangepartitioning")


def test_foreign_keys_count_orphans_only(spark, sf_small):
    """No table of all child keys: lines are joined to their parents before they are counted."""
    text = _without_broadcast(spark, lambda: QUERIES["dq_foreign_keys"](spark, sf_small))
    assert text.index("HashAggregate") < text.index("LeftAnti")


def test_materialized_tables_are_files(spark):
    from pyspark.sql import functions as F

    from boutique.session import materialize

    df = materialize(spark.range(5).select(F.col("id"), F.array(F.col("id")).alias("a"), F.lit(None).cast("timestamp_ntz").alias("t")))
    assert "FileScan parquet" in plan(df) and df.count() == 5
    assert materialize(df.limit(0)).isEmpty()


def test_computed_stock_is_computed_once(spark, sf_small):
    t = Tables.from_testdata(spark, sf_small)
    once = t.computed_once("stock")
    assert "lineitem" in plan(t.stock) and "lineitem" not in plan(once.stock)
    assert once.computed_once("stock") is once and once.stock.exceptAll(t.stock).isEmpty()
