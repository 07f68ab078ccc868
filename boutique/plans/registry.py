"""Registry of named queries: ``name -> (spark builder, oracle SQL or None)``.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the whole tables
of that folder. The oracle SQL states the same result for DuckDB over the raw views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutique.session import configure
from boutique.sources.tables import Tables

def present(df: DataFrame) -> DataFrame:
    """Output form of a registered query: exact decimals are shown as doubles."""
    decimals = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    if not decimals:
        return df
    return df.select(*[F.col(c).cast("double").alias(c) if c in decimals else F.col(c) for c in df.columns])


Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: ``fn(t: Tables) -> DataFrame`` becomes the builder of ``name``."""

    def deco(fn: Callable[[Tables], DataFrame]):
        def builder(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return present(fn(Tables.from_testdata(spark, sf_dir)))

        builder.__name__ = f"q_{name}"
        builder.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = builder
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco
