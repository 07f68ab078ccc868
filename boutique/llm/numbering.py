"""Places of rows in their group, for groups of any size, and a bounded broadcast."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutique.llm.frames import stored

#: Rows of a few numbers or digests each, up to which a table may be broadcast.
BROADCAST_ROWS = 500_000
#: Rows of that kind up to which one task does all: shuffles of so few cost more than they spread.
FEW_ROWS = 10_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a stored table of short rows) with a broadcast hint if its count is small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _local_places(group: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun, at = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = batch.column(group)
            starts = np.ones(n, bool)
            starts[0] = own[0].as_py() != last
            if n > 1:
                starts[1:] = pc.not_equal(own.slice(1), own.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            first = np.maximum.accumulate(np.where(starts, np.arange(at, at + n), begun))
            last, begun = own[n - 1].as_py(), int(first[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + n) - first)], names=[*batch.schema.names, "_local"])
            at += n

    return run


def numbered(rows: DataFrame, group: str, order: Sequence, name: str) -> DataFrame:
    """``rows`` (a stored table; ``group`` is a string or long and never null) with ``place``,
    the row's position in its group (from 0) by ``order``; stored, in that order.

    One range partitioning of the group and its whole order, numbered as it streams by; a
    group that reaches over partitions gets what its earlier partitions hold, from one row
    per partition. A group of any size is spread like all others; only rows equal in group
    and order share a task. Up to FEW_ROWS rows are one task's work.
    """
    if rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        one = rows.coalesce(1).sortWithinPartitions(F.col(group), *order)
        schema = T.StructType([*one.schema.fields, T.StructField("_local", T.LongType())])
        return stored(one.mapInArrow(_local_places(group), schema), name).withColumnRenamed("_local", "place")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    ranged = ranged.withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("_local", T.LongType())])
    local = stored(ranged.mapInArrow(_local_places(group), schema), name)
    edges = local.groupBy("_part").agg(F.min(group).alias("low"), F.max(group).alias("high"))
    edges = edges.select(F.explode(F.array_distinct(F.array("low", "high"))).alias(group)).distinct()
    cells = local.select(group, "_part").join(small(stored(edges, f"{name}-edges")), group).groupBy(group, "_part").count()
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(group, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_earlier")).filter("_earlier > 0")
    placed = local.join(small(stored(cells, f"{name}-cells")), [group, "_part"], "left")
    return placed.withColumn("place", F.col("_local") + F.coalesce("_earlier", F.lit(0))).drop("_part", "_local", "_earlier")
