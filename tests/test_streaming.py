"""Streamed customer statistics against the batch computation; the ledger's promises."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from boutique.operators.customers import customer_segments
from boutique.sources.tables import Tables
from boutique.streaming.customer_stats import (EVENT, CustomerStats, customer_stats_from_stream, event_files, finished, fold_customers,
                                               fold_orders, run_customer_stats)

COLUMNS = ["customer_id", "total_orders", "total_spent", "last_purchase_date", "customer_segment"]


def test_stream_equals_batch(spark, sf_small):
    got = customer_stats_from_stream(spark, sf_small)
    t = Tables.from_testdata(spark, sf_small)
    want = customer_segments(t).join(t.orders.select("customer_id").distinct(), "customer_id", "left_semi")
    assert sorted(got.select(*COLUMNS).collect()) == sorted(want.select(*COLUMNS).collect())


def order(o, at, customer, status, day=1):
    return (o, at, customer, status, dt.datetime(2024, 1, day), None)


def line(o, value):
    return (o, None, None, None, None, Decimal(value))


BATCHES = [
    [order("a", 0, "x", "created", 1), line("a", "10.50"), line("a", "1.25"), order("b", 0, "y", "created", 2), line("c", "7.00")],
    [order("c", 0, "x", "created", 5), order("b", 1, "y", "approved", 2), line("b", "100.00"), line("d", "3.00")],  # c's lines came first
    [order("c", 2, "x", "cancelled", 5), order("c", 1, "x", "approved", 5)],  # the older status comes late
    [line("a", "0.25"), order("b", 2, "y", "cancelled", 2)],
    [order("d", 0, "z", "created", 9), order("b", 3, "y", "approved", 2), order("e", 0, "z", "created", 9)],  # e has no lines
    [order("c", 3, "x", "created", 5), order("c", 3, "x", "delivered", 5)],
]


def plain(batches):
    orders, lines = {}, {}
    for rows in batches:
        for o, at, customer, status, purchased, value in rows:
            if customer is None:
                lines.setdefault(o, []).append(value)
            else:
                orders.setdefault(o, []).append((at, status, customer, purchased))
    out = {}
    for o, events in orders.items():
        _, status, _, purchased = max(events)
        customer = min(events)[2]
        n, spent, last = out.get(customer, (0, Decimal(0), None))
        if status != "cancelled" and o in lines:
            n, spent, last = n + 1, spent + sum(lines[o]), max(purchased, last or purchased)
        out[customer] = (n, spent, last)
    return {(c, n, float(s), last) for c, (n, s, last) in out.items()}


@pytest.fixture
def event_folder(spark, tmp_path):
    """One file per micro-batch."""
    folder = tmp_path / "events"
    for k, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(tmp_path / f"raw-{k}"))
        folder.mkdir(exist_ok=True)
        (name,) = [n for n in os.listdir(tmp_path / f"raw-{k}") if n.endswith(".parquet")]
        target = folder / f"{k}.parquet"
        target.write_bytes((tmp_path / f"raw-{k}" / name).read_bytes())
        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    return str(folder)


def rows(stats):
    return {tuple(r) for r in stats.current().drop("customer_segment").collect()}


def test_late_events_in_micro_batches(spark, event_folder, tmp_path):
    """Lines before their order, old statuses, cancels of earlier batches; compaction on the way."""
    stats = CustomerStats(spark, str(tmp_path / "out"), buckets=4, compact_every=2)
    finished(run_customer_stats(stats, event_files(spark, event_folder, 1), str(tmp_path / "ckpt")))
    assert rows(stats) == plain(BATCHES)
    assert stats.facts.epochs() == stats.stats.epochs() == [4, 5]  # merged ones are gone
    # A restart on the same checkpoint finds nothing new.
    finished(run_customer_stats(stats, event_files(spark, event_folder, 1), str(tmp_path / "ckpt")))
    assert rows(stats) == plain(BATCHES)


def changed_by(spark, k):
    """What the stream's fold gives for batch k: the orders it touches, as of then."""
    touched = {r[0] for r in BATCHES[k]}
    facts = fold_orders(spark.createDataFrame([r for b in BATCHES[:k + 1] for r in b], EVENT))
    return facts.filter(F.col("order_id").isin(*touched))


def test_replay_and_crashes(spark, tmp_path, monkeypatch):
    """Every batch applied twice, and a crash at every step of a compaction, change nothing."""
    stats = CustomerStats(spark, str(tmp_path / "out"), buckets=3, compact_every=100)
    for k in range(len(BATCHES)):
        stats.apply(changed_by(spark, k), k)
        stats.apply(changed_by(spark, k), k)
        assert rows(stats) == plain(BATCHES[:k + 1])
    want = plain(BATCHES)
    log = type(stats.facts.log)

    def crash(*_):
        raise RuntimeError("crash")

    for ledger in (stats.facts, stats.stats):
        with monkeypatch.context() as m:  # after the snapshot's data, before its manifest
            m.setattr(log, "publish", crash)
            with pytest.raises(RuntimeError):
                ledger.compact()
        assert rows(stats) == want and len(ledger.epochs()) == len(BATCHES)
        with monkeypatch.context() as m:  # after the manifest, before anything is deleted
            m.setattr(log, "delete", crash)
            with pytest.raises(RuntimeError):
                ledger.compact()
        assert rows(stats) == want and len(ledger.epochs()) == len(BATCHES)
        ledger.compact()
        assert rows(stats) == want and ledger.epochs() == [len(BATCHES) - 1]
        assert len([n for n in ledger.log.names(ledger.log.root) if n.startswith("snapshot-")]) == 1
    stats.apply(changed_by(spark, len(BATCHES) - 1), len(BATCHES) - 1)  # the open epoch may still be replayed
    assert rows(stats) == want


def test_a_batch_reads_touched_buckets_only(spark, tmp_path):
    stats = CustomerStats(spark, str(tmp_path / "out"), buckets=16)
    first = spark.createDataFrame([e for k in range(200) for e in (order(f"o{k}", 0, f"c{k}", "created"), line(f"o{k}", "1.00"))], EVENT)
    stats.apply(fold_orders(first), 0)
    later = spark.createDataFrame([order("o7", 0, "c7", "created"), line("o7", "1.00"), order("o7", 1, "c7", "cancelled")], EVENT)
    stats.facts.write_epoch(fold_orders(later), 1)
    plan = stats.touched_stats(1)
    bucket = spark.range(1).select(stats.facts.bucket_of(F.lit("c7"))).first()[0]
    # The epoch itself names the touched customers; whatever reads order values is cut to their buckets.
    scans = [f for f in plan._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in f and "order_status" in f]
    assert len(scans) == 2 and all("_bucket" in f.split("PartitionFilters: ")[1].split("]")[0] for f in scans)
    assert [tuple(r) for r in plan.collect()] == [("c7", 0, Decimal("0.00"), None)]
    read = stats.facts.versions([bucket]).select(F.input_file_name()).distinct().collect()
    assert read and all(f"_bucket={bucket}/" in r[0] for r in read)


def test_fold_customers_needs_lines(spark):
    facts = fold_orders(spark.createDataFrame([order("a", 0, "x", "created")], EVENT))
    assert [tuple(r) for r in fold_customers(facts).collect()] == [("x", 0, Decimal("0.00"), None)]
