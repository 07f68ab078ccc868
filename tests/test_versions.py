"""SNK2: versions become current by their manifest, all or nothing."""

import os

import pytest

from boutique.sources.versions import VersionConflict, VersionLog, expire, publish_tables, read_tables
from tests.helpers import customer, order, tables


def shop(spark, status):
    return tables(spark, customers=[customer("CUST_000001")], orders=[order("ORDER_000001", "CUST_000001", status)])


def status(spark, root, number=None):
    return [r.order_status for r in read_tables(spark, root, number).orders.collect()]


def test_readers_see_complete_versions_only(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "shop")
    with pytest.raises(FileNotFoundError):
        read_tables(spark, root)
    assert publish_tables(shop(spark, "created"), root, ("orders", "customers")) == 1
    assert publish_tables(shop(spark, "shipped"), root, ("orders",)) == 2
    assert status(spark, root) == ["shipped"] and status(spark, root, 1) == ["created"]
    assert read_tables(spark, root).customers.count() == 1  # not written again

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(VersionLog, "publish", crash)
        with pytest.raises(RuntimeError):
            publish_tables(shop(spark, "cancelled"), root, ("orders",))
    assert status(spark, root) == ["shipped"]
    assert publish_tables(shop(spark, "delivered"), root, ("orders",)) == 3
    assert status(spark, root) == ["delivered"]


def test_of_two_writers_one_fails(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path / "x"))
    assert log.publish({"tables": {}}, 0) == 1
    with pytest.raises(VersionConflict):
        log.publish({"tables": {"orders": "late"}}, 0)
    assert log.publish({"tables": {"orders": "next"}}, 1) == 2
    assert log.current() == (2, {"tables": {"orders": "next"}})
    assert [n for n in os.listdir(tmp_path / "x" / "_versions") if n.startswith(".") and not n.endswith(".crc")] == []


def test_expire_keeps_what_is_used(spark, tmp_path):
    root = str(tmp_path / "shop")
    publish_tables(shop(spark, "created"), root, ("orders", "customers"))
    for s in ("approved", "shipped", "delivered"):
        publish_tables(shop(spark, s), root, ("orders",))
    unfinished = VersionLog(spark, root).new_folder("tables")
    os.makedirs(f"{root}/{unfinished}")
    gone = expire(spark, root, keep=2)
    assert len(gone) == 1 and os.path.isdir(f"{root}/{unfinished}")  # the first one's customers are still in use
    assert status(spark, root) == ["delivered"] and status(spark, root, 3) == ["shipped"] and read_tables(spark, root).customers.count() == 1
