"""Every registered query against its DuckDB oracle on the smallest test tables."""

import duckdb
import pytest

from tools.check_oracle import RAW, digest

import __spark_entry__ as entry_mod
from boutique.plans.registry import ORACLE, QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in RAW:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert "total_price" in df.columns
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(NAMES)
    assert set(NAMES) <= set(entry_mod.queries()) and set(ORACLE) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_small, con, name):
    got = entry_mod.queries()[name](spark, sf_small).toPandas()
    want = con.execute(ORACLE[name]).df()
    assert digest(got, strict=True) == digest(want, strict=True)
