"""Customer statistics kept current by a stream of order events.

Two streams of events, orders (with status and customer) and lines (with their value), are
folded per order by a streaming aggregation: the state store keeps, for every order, its
customer, its last status (by the events' own order ``at``) and the sum of its lines. A
micro-batch gives the orders that it has changed, with their new values; nothing else of the
history is read for it.

Each batch appends those orders to one ledger (keyed by order, bucketed by customer), then
recomputes the statistics of the touched customers from the orders that the ledger holds for
them, reading their buckets only, and appends them to a second ledger (keyed by customer). A
maximum such as the last purchase can't be undone by a difference when an order is
cancelled, hence the recomputation; it costs the touched customers' orders, not lines.

Both ledgers replace an epoch that is written again, so a replayed micro-batch (the state
store gives the same orders) leaves the same files; every ``compact_every`` epochs they are
merged into snapshots. Events may come late and in any order: lines before their order, a
status older than the one known (ignored), a cancel of an order from long ago. An order
belongs to the customer of its first event.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutique import constants as K
from boutique.operators.customers import segment
from boutique.operators.orders import line_total
from boutique.session import ensure_checkpoint_dir
from boutique.sources.testdata import RAW_SCHEMAS, TestDataAdapter
from boutique.streaming.ledger import Ledger

VALUE = T.DecimalType(28, 2)
EVENT = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("at", T.LongType()),  # order of the events of one order
    T.StructField("customer_id", T.StringType()),  # order events: customer, status, purchase
    T.StructField("order_status", T.StringType()),
    T.StructField("purchased", T.TimestampNTZType()),
    T.StructField("value", VALUE),  # line events: the line's value
])
ORDER_FACTS = T.StructType([
    T.StructField("order_id", T.StringType()), T.StructField("customer_id", T.StringType()),
    T.StructField("order_status", T.StringType()), T.StructField("purchased", T.TimestampNTZType()),
    T.StructField("value", VALUE), T.StructField("lines", T.LongType()),
])
CUSTOMER_STATS = T.StructType([
    T.StructField("customer_id", T.StringType()), T.StructField("total_orders", T.LongType()),
    T.StructField("total_spent", VALUE), T.StructField("last_purchase_date", T.TimestampNTZType()),
])
BUCKETS, COMPACT_EVERY = 64, 16
#: State lives in RocksDB on the executors' disks, its changes in the checkpoint folder.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# ---------------------------------------------------------------------------------- events
def order_events(orders: DataFrame, at: int = 0) -> DataFrame:
    """Events of order rows (canonical columns, batch or stream)."""
    return orders.select("order_id", F.lit(at).cast("long").alias("at"), "customer_id", "order_status",
                         F.col("order_purchase_timestamp").alias("purchased"), F.lit(None).cast(VALUE).alias("value"))


def line_events(order_items: DataFrame) -> DataFrame:
    """Events of order lines (canonical columns, batch or stream)."""
    none = lambda name: F.lit(None).cast(EVENT[name].dataType).alias(name)
    return order_items.select("order_id", none("at"), none("customer_id"), none("order_status"), none("purchased"),
                              line_total().cast(VALUE).alias("value"))


def testdata_events(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Both kinds of events, streamed from the raw order and line files of ``folder``."""
    adapter = TestDataAdapter(spark, folder)
    for name in ("orders", "lineitem"):
        reader = spark.readStream.schema(RAW_SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet")
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        adapter._raw[name] = reader.parquet(folder)
    return order_events(adapter.orders()).unionByName(line_events(adapter.order_items()))


def event_files(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Events streamed from Parquet files in the form of ``EVENT``."""
    reader = spark.readStream.schema(EVENT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder)


# ----------------------------------------------------------------------------------- folds
def fold_orders(events: DataFrame) -> DataFrame:
    """Per order: what its events say so far (batch, or streaming in update mode)."""
    said = F.when(F.col("customer_id").isNotNull(), F.struct("at", "order_status"))
    facts = events.groupBy("order_id").agg(
        F.min_by("customer_id", said).alias("customer_id"),
        F.max_by(F.struct("order_status", "purchased"), said).alias("last"),
        F.sum("value").cast(VALUE).alias("value"), F.count("value").alias("lines"))
    return facts.select("order_id", "customer_id", "last.order_status", "last.purchased", "value", "lines")


def fold_customers(facts: DataFrame) -> DataFrame:
    """Per customer of the given orders: live orders that have lines, their value, the last."""
    live = (F.col("order_status") != K.CANCELLED) & (F.col("lines") > 0)
    return facts.groupBy("customer_id").agg(
        F.count(F.when(live, 1)).alias("total_orders"), F.coalesce(F.sum(F.when(live, F.col("value"))), F.lit(0)).cast(VALUE).alias("total_spent"),
        F.max(F.when(live, F.col("purchased"))).alias("last_purchase_date"))


class CustomerStats:
    """The ledgers below ``root`` and the function that a stream applies to its batches."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY):
        root = root.rstrip("/")
        self.spark, self.compact_every = spark, compact_every
        self.facts = Ledger(spark, f"{root}/orders", ORDER_FACTS, "order_id", "customer_id", buckets)
        self.stats = Ledger(spark, f"{root}/customers", CUSTOMER_STATS, "customer_id", "customer_id", buckets)

    def apply(self, changed: DataFrame, epoch: int) -> None:
        """One micro-batch: the orders it has changed (the output of :func:`fold_orders`)."""
        self.facts.write_epoch(changed.filter(F.col("customer_id").isNotNull()), epoch)
        self.stats.write_epoch(self.touched_stats(epoch), epoch)
        if epoch and epoch % self.compact_every == 0:
            self.facts.compact()
            self.stats.compact()

    def touched_stats(self, epoch: int) -> DataFrame:
        """Statistics of the customers whose orders ``epoch`` has changed."""
        written = self.facts.read_epoch(epoch)
        touched = written.select("customer_id").distinct()
        buckets = [r[0] for r in written.select(self.facts.bucket_of("customer_id")).distinct().collect()]  # as many as there are buckets
        return fold_customers(self.facts.current(buckets, epoch, touched))

    def current(self, thresholds=K.SEGMENT_THRESHOLDS) -> DataFrame:
        """Statistics and segment of every customer that has had an order, as of the last batch."""
        n, spent = F.col("total_orders"), F.col("total_spent")
        return self.stats.current().select(
            "customer_id", "total_orders", spent.cast("double").alias("total_spent"), "last_purchase_date",
            segment(n, spent, thresholds).alias("customer_segment"))


def run_customer_stats(stats: CustomerStats, events: DataFrame, checkpoint: str, available_now: bool = True):
    """Start the stream (``available_now`` processes what is there and stops)."""
    spark = stats.spark
    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        writer = fold_orders(events).writeStream.outputMode("update").foreachBatch(stats.apply).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
        return writer.start()
    finally:
        spark.conf.unset(STATE_STORE[0]) if before is None else spark.conf.set(STATE_STORE[0], before)


def finished(query) -> None:
    """Wait for a query that stops by itself; its failure is raised."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def customer_stats_from_stream(spark: SparkSession, sf_dir: str, thresholds=K.SEGMENT_THRESHOLDS) -> DataFrame:
    """Run the stream once over the order and line files of ``sf_dir``: the statistics of all
    customers with orders."""
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/customer-stats-{uuid.uuid4().hex}"
    stats = CustomerStats(spark, f"{root}/out", buckets=8)
    finished(run_customer_stats(stats, testdata_events(spark, sf_dir), f"{root}/checkpoint"))
    return stats.current(thresholds)
