"""A keyed table kept as a log of epochs with one compacted snapshot.

Rows are versions of a key; the one of the highest epoch counts. Every epoch is a folder
(``epoch=7/bucket=3/...``), written with overwrite, so a replayed micro-batch leaves the
same files. Buckets are a hash of ``bucket_by``: a reader that needs a few keys reads their
buckets only.

``compact`` writes the current rows of the snapshot and of the closed epochs as a new
snapshot, then publishes a manifest {snapshot, through} (see ``sources/versions.py``), then
deletes what the manifest has replaced. Readers take the snapshot and the epochs after
``through``: a crash before the manifest leaves an unnamed folder that nobody reads, a crash
after it leaves epochs that nobody reads; the next compaction deletes both. The last epoch
stays open, as it may be replayed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutique.sources.versions import VersionLog

EPOCH, BUCKET = "_epoch", "_bucket"


@dataclass
class Ledger:
    spark: SparkSession
    root: str
    schema: T.StructType
    key: str
    bucket_by: str  # never changes for a key
    buckets: int = 64

    @property
    def log(self) -> VersionLog:
        return VersionLog(self.spark, self.root)

    def bucket_of(self, column: str | Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    # ---- writing -------------------------------------------------------------------------
    def write_epoch(self, rows: DataFrame, epoch: int) -> None:
        """The rows of one micro-batch (one per key); writing an epoch again replaces it."""
        self._write(rows.withColumn(EPOCH, F.lit(epoch).cast("long")), f"epoch={epoch}")

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows = rows.select(*self.schema.names, EPOCH, self.bucket_of(self.bucket_by).alias(BUCKET))
        # One file a bucket and task; a large bucket is written by several tasks (AQE splits
        # the partitions of a rebalance by size).
        rows.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.log.root}/{folder}")

    # ---- reading -------------------------------------------------------------------------
    def _state(self) -> tuple[int, dict]:
        return self.log.current() or (0, {"snapshot": None, "through": -1})

    def epochs(self) -> list[int]:
        return sorted(int(m.group(1)) for m in (re.fullmatch(r"epoch=(\d+)", n) for n in self.log.names(self.log.root)) if m)

    def _stored(self, folder: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(EPOCH, T.LongType()), T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.log.root}/{folder}")

    def read_epoch(self, epoch: int) -> DataFrame:
        """The rows that an epoch has written."""
        return self._stored(f"epoch={epoch}").select(*self.schema.names)

    def versions(self, buckets: list[int] | None = None, upto: int | None = None) -> DataFrame:
        """Snapshot and open epochs (``upto`` an epoch, itself included), of some buckets."""
        _, state = self._state()
        open_ = [e for e in self.epochs() if e > state["through"] and (upto is None or e <= upto)]
        folders = [f"epoch={e}" for e in open_]
        if state["snapshot"] is not None:
            folders.insert(0, state["snapshot"])
        out = None
        for folder in folders:
            part = self._stored(folder)
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField(EPOCH, T.LongType()), T.StructField(BUCKET, T.IntegerType())]))
        return out if buckets is None else out.filter(F.col(BUCKET).isin(buckets))

    def current(self, buckets: list[int] | None = None, upto: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """One row per key, that of its highest epoch; ``only`` the ``bucket_by`` values given."""
        versions = self.versions(buckets, upto)
        if only is not None:
            versions = versions.join(only, self.bucket_by, "left_semi")
        return self._latest(versions).select(*self.schema.names)

    def _latest(self, versions: DataFrame) -> DataFrame:
        others = [c for c in self.schema.names if c != self.key]
        latest = versions.groupBy(self.key).agg(F.max_by(F.struct(*others), EPOCH).alias("_r"), F.max(EPOCH).alias(EPOCH))
        return latest.select(self.key, *[F.col(f"_r.{c}").alias(c) for c in others], EPOCH)

    # ---- compacting ----------------------------------------------------------------------
    def compact(self) -> int | None:
        """Merge all epochs but the last into the snapshot; returns the version's number
        (None if there was nothing to merge)."""
        number, state = self._state()
        closed = [e for e in self.epochs()[:-1] if e > state["through"]]
        if not closed:
            self.clean()
            return None
        folder = self.log.new_folder("snapshot")
        self._write(self._latest(self.versions(upto=closed[-1])), folder)
        number = self.log.publish({"snapshot": folder, "through": closed[-1]}, number)
        self.clean()
        return number

    def clean(self) -> None:
        """Delete epochs that the current snapshot holds, and other snapshots (one writer
        compacts at a time: unnamed ones are left from a crash)."""
        number, state = self._state()
        for e in self.epochs():
            if e <= state["through"]:
                self.log.delete(f"{self.log.root}/epoch={e}")
        for name in self.log.names(self.log.root):
            if name.startswith("snapshot-") and name != state["snapshot"]:
                self.log.delete(f"{self.log.root}/{name}")
        for n in self.log.numbers():
            if n < number:
                self.log.delete(f"{self.log.folder}/{n:012d}.json")
