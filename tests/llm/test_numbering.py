"""Places in groups that reach over many partitions, against plain numbering."""

import pytest
from pyspark.sql import functions as F

from boutique.llm import numbering
from boutique.llm.frames import stored


@pytest.mark.parametrize("few", [0, 10_000])
def test_numbered(spark, rng, monkeypatch, few):
    monkeypatch.setattr(numbering, "FEW_ROWS", few)
    rows = [(rng.choice([7] * 5 + list(range(-3, 12))), rng.choice([None, *range(50)]), k) for k in range(3000)]  # group 7: a third
    df = stored(spark.createDataFrame(rows, "grp long, at long, k long"), "rows")
    got = numbering.numbered(df, "grp", [F.col("at").asc_nulls_first(), F.col("k")], "numbered").collect()
    want = {}
    for grp, at, k in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        want.setdefault(grp, []).append(k)
    assert {(r.grp, r.k): r.place for r in got} == {(g, k): i for g, ks in want.items() for i, k in enumerate(ks)}
    assert numbering.numbered(df.filter("false"), "grp", [F.col("k")], "none").count() == 0


def test_string_groups(spark, monkeypatch):
    monkeypatch.setattr(numbering, "FEW_ROWS", 0)
    df = stored(spark.createDataFrame([(g, k) for g in ("", "=", "=é", "=z") for k in range(40)], "grp string, k long"), "rows")
    got = numbering.numbered(df, "grp", [F.col("k")], "numbered").collect()
    assert all(r.place == r.k for r in got) and len(got) == 160
