"""A bundle of the nine canonical shop tables.

``Tables.from_testdata`` adapts the driver's Parquet files; ``Tables.from_parquet`` reads a
folder holding one Parquet dataset per canonical table with the explicit schemas of
:mod:`boutique.sources.schemas` (no inference). ``Tables.write`` is the sink: it writes a
new version of every table to a fresh folder, which callers then switch to (no in-place
overwrite of a table that is still being read).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from boutique.session import materialize
from boutique.sources import schemas as S
from boutique.sources.testdata import TestDataAdapter

TABLE_NAMES = tuple(S.TABLES)
BUCKET_KEYS = {
    "orders": "order_id", "order_items": "order_id", "order_payments": "order_id",
    "order_reviews": "order_id", "customers": "customer_id", "products": "product_id",
    "stock": "product_id",
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """The canonical columns of table ``name`` in order and type (extra columns dropped)."""
    from pyspark.sql import functions as F

    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.TABLES[name].fields])


def with_defaults(df: DataFrame, name: str, as_of) -> DataFrame:
    """Fill the table's column defaults where an inserted row holds null (or lacks the
    column); ``as_of`` is the insert time used for "now" defaults."""
    from pyspark.sql import functions as F

    out = df
    for col, value in S.DEFAULTS.get(name, {}).items():
        dtype = S.TABLES[name][col].dataType
        lit = (F.lit(as_of.isoformat(sep=" ")) if value == "now" else F.lit(value)).cast(dtype)
        out = out.withColumn(col, F.coalesce(F.col(col).cast(dtype), lit) if col in out.columns else lit)
    return out


@dataclass
class Tables:
    spark: SparkSession
    loaders: dict = field(default_factory=dict)
    _cache: dict = field(default_factory=dict)
    adapter: TestDataAdapter | None = None
    files: bool = False  # every table is read from files as it is
    replaced: frozenset = frozenset()  # tables given by with_tables
    once: frozenset = frozenset()  # tables materialized by computed_once

    # ---- construction ----------------------------------------------------------------
    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        ad = TestDataAdapter(spark, sf_dir)
        loaders = {name: getattr(ad, name) for name in TABLE_NAMES}
        return cls(spark=spark, loaders=loaders, adapter=ad)

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "Tables":
        root = root.rstrip("/")

        def loader(name):
            return lambda: spark.read.schema(S.TABLES[name]).parquet(f"{root}/{name}")

        return cls(spark=spark, loaders={n: loader(n) for n in TABLE_NAMES}, files=True)

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, properties: dict,
                  partitioning: dict[str, tuple[str, int, int, int]] | None = None) -> "Tables":
        """Read the nine tables from a relational database over JDBC.

        ``partitioning`` maps a table to (numeric column, lower bound, upper bound, number of
        partitions) so that large tables are read by parallel range queries instead of one
        connection; the explicit schemas are applied by casting.
        """
        parts = partitioning or {}

        def loader(name):
            def load():
                if name in parts:
                    col, lo, hi, n = parts[name]
                    df = spark.read.jdbc(url, name, column=col, lowerBound=lo, upperBound=hi,
                                         numPartitions=n, properties=properties)
                else:
                    df = spark.read.jdbc(url, name, properties=properties)
                return conform(df, name)
            return load

        return cls(spark=spark, loaders={n: loader(n) for n in TABLE_NAMES})

    @classmethod
    def from_frames(cls, spark: SparkSession, **frames: DataFrame) -> "Tables":
        return cls(spark=spark, loaders={n: (lambda d=d: d) for n, d in frames.items()})

    def with_tables(self, **frames: DataFrame) -> "Tables":
        """A new bundle in which the given tables are replaced (others shared)."""
        loaders = dict(self.loaders)
        cache = {k: v for k, v in self._cache.items() if k not in frames}
        for n, d in frames.items():
            loaders[n] = lambda d=d: d
            cache[n] = d
        return replace(self, loaders=loaders, _cache=cache, files=False, replaced=self.replaced | set(frames), once=self.once - set(frames))

    # ---- access ------------------------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.loaders[name]()
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.table(name)
        raise AttributeError(name)

    @property
    def review_facts(self) -> DataFrame:
        """The reviews without their messages, for readers that don't need the text (the
        test-data adapter has it in a table of its own, which they then don't read)."""
        if not self._own_messages():
            return self.table("order_reviews").drop("review_comment_message")
        return self.adapter.review_facts()

    @property
    def review_rows(self) -> DataFrame:
        """The reviews for steps that choose or change some: rows to be given their messages by
        :meth:`with_messages` when all else is done, so that texts don't go through shuffles.
        (The test-data adapter has the texts in a table of its own.)"""
        if self._own_messages():
            return self.adapter.review_rows()
        return self.table("order_reviews")

    def with_messages(self, reviews: DataFrame) -> DataFrame:
        """``reviews`` (from :attr:`review_rows`, columns added, rows dropped) with their messages."""
        return self.adapter.with_messages(reviews) if self._own_messages() else reviews

    def _own_messages(self) -> bool:
        return self.adapter is not None and "order_reviews" not in self.replaced

    def computed_once(self, *names: str) -> "Tables":
        """This bundle with the given tables materialized, unless they are files already: for
        readers of a table that the test-data adapter (or an earlier step) computes."""
        todo = [n for n in names if not (self.files or n in self.once)]
        if not todo:
            return self
        out = self.with_tables(**{n: materialize(self.table(n)) for n in todo})
        return replace(out, once=self.once | set(todo))

    def carts(self, qty_factor: int = 1) -> DataFrame:
        if self.adapter is None:
            raise ValueError("carts come from the test-data events; pass a carts DataFrame")
        return self.adapter.carts(qty_factor)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> "Tables":
        """Read the nine tables saved by :meth:`write_catalog` (bucketing kept)."""
        return cls(spark=spark, loaders={n: (lambda n=n: spark.table(f"{database}.{n}")) for n in TABLE_NAMES})

    # ---- sink --------------------------------------------------------------------------
    def write_catalog(self, database: str, buckets: int, names: tuple[str, ...] = TABLE_NAMES,
                      mode: str = "errorifexists"):
        """Save the tables as catalog tables, bucketed and sorted by their join keys.

        Orders, lines, payments and reviews are all bucketed by ``order_id`` into the same
        number of buckets, so joins among them read matching buckets without a shuffle;
        stock by ``product_id`` (allocation works per product), customers by
        ``customer_id``, products by ``product_id``.
        """
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        for n in names:
            key = BUCKET_KEYS.get(n)
            w = self.table(n).write.mode(mode).format("parquet")
            if key:
                w = w.bucketBy(buckets, key).sortBy(key)
            w.saveAsTable(f"{database}.{n}")

    # ---- sink (files) ----------------------------------------------------------------
    def write(self, root: str, names: tuple[str, ...] = TABLE_NAMES, mode: str = "errorifexists"):
        """Write each table to ``{root}/{name}`` as Parquet (a new version folder)."""
        root = root.rstrip("/")
        for n in names:
            self.table(n).write.mode(mode).parquet(f"{root}/{n}")
