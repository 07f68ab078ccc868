"""Spark helpers of the corpus operators: scratch tables, label masks, table access."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutique.session import configure, ensure_checkpoint_dir

#: Labels are joined by broadcast up to so many rows (16 bytes each), else by a shuffle.
LABELS_BROADCAST_ROWS = 2_000_000
#: Rows in an Arrow batch: texts are long, and a batch is held by the JVM and by Python.
ARROW_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for scratch tables, below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


_made: list[str] = []
_path_of: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: computed
    once, lineage cut, safe against lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _made.append(path)
    _path_of[out] = path
    return out


def scratch_mark() -> int:
    """A point in time for :func:`drop_since`."""
    return len(_made)


def drop_since(spark: SparkSession, mark: int, *kept: DataFrame) -> None:
    """Delete the scratch tables written since ``mark`` but for ``kept``, which must be
    scratch tables themselves (nothing lazy may need the others any more)."""
    keep = {_path_of[d] for d in kept}
    for path in [p for p in _made[mark:] if p not in keep]:
        _delete(spark, path)
        _made.remove(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application (when its results are written)."""
    _delete(spark, scratch_root(spark))
    _made.clear()


def as_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """(row, text): the columns of ``df`` as one struct, so that added names can't clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).cast("string").alias("text"))


def schema_with(df: DataFrame, columns: list[str], added: str) -> T.StructType:
    """Schema of ``columns`` of ``df`` followed by the ``added`` DDL columns."""
    return T.StructType([df.schema[c] for c in columns] + T.StructType.fromDDL(added).fields)


def id_remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32(doc_id as text) mod ``divisor``; a null id has remainder 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % divisor, F.lit(0).cast("bigint"))


def learning_labels(labels: DataFrame, label: str, divisor: int, held_out: int) -> DataFrame:
    """(doc_id, y) of the rows to learn from: ids outside the held-out fold, labels 0 or 1.
    A doc_id labelled several times gets its larger label."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)
                      & (id_remainder("doc_id", divisor) != held_out))
        .groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))
    )


def with_labels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, y) of the labelled documents. Small label tables are broadcast, so
    that texts aren't shuffled; beyond the bound it is an ordinary shuffle join."""
    few = labels.limit(LABELS_BROADCAST_ROWS + 1).count() <= LABELS_BROADCAST_ROWS
    return documents.select("doc_id", "text").join(F.broadcast(labels) if few else labels, "doc_id")


_shipped: set[str] = set()


def ready(spark: SparkSession) -> None:
    """Settings and code that the corpus operators rely on, for a session built elsewhere."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ship_code(spark)


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once per application: tasks import it by name."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    target = pathlib.Path(tempfile.mkdtemp(prefix="boutique-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
