"""SparkSession settings and lineage cutting.

The settings are the ones every query here relies on: UTC session time zone (the data is
zone-less), ANSI mode, AQE with partition coalescing and skew-join splitting.
"""

from __future__ import annotations

import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "boutique",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return the active session or build one with the settings the library expects.

    On a cluster pass ``master=None`` and let the launcher decide; shuffle partitions are
    only forced when given (locally: about the core count).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Checkpoint files of collected DataFrames are removed by the context cleaner.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def cluster_settings(input_bytes: int, executor_cores: int = 4, target_partition_bytes: int = 256 << 20,
                     cluster_cores: int | None = None) -> dict[str, str]:
    """Spill-aware sizing for a cluster run over ``input_bytes`` of Parquet.

    Scan splits and shuffle partitions target ``target_partition_bytes`` each, so a task's
    input fits comfortably in an executor slot's share of memory; the initial shuffle
    partition count is generous (at least 2x the cores) and AQE coalesces it from the
    measured sizes and splits skewed partitions.
    """
    parts = max(1, -(-input_bytes // target_partition_bytes))
    if cluster_cores:
        parts = max(parts, 2 * cluster_cores)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.executor.cores": str(executor_cores),
    }


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators rely on to a session built elsewhere
    (UTC for zone-less timestamps, ANSI, AQE with skew-join splitting)."""
    for k, v in RUNTIME_SETTINGS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application: operators whose tasks run
    Python functions call it, as tasks import them by name."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="boutique-package-")) / f"{package.name}-package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point the SparkContext at the cluster's shared checkpoint folder.

    The folder is read from ``spark.checkpoint.dir``. Only a local-mode session (tests)
    without that setting gets a fresh private folder; a cluster without it is an error,
    because a machine-local folder does not survive the loss of that machine.
    """
    sc = spark.sparkContext
    path = sc.getConf().get(_CHECKPOINT_KEY, None) or spark.conf.get(_CHECKPOINT_KEY, None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_KEY} to a shared folder before cutting lineage")
        path = tempfile.mkdtemp(prefix="boutique-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set(_CHECKPOINT_KEY, path)
    if path.startswith("file:") and not sc.master.startswith("local"):
        raise RuntimeError(f"{_CHECKPOINT_KEY} names a machine-local folder; a cluster needs a shared one")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage: a Parquet table in the shared checkpoint folder.

    For intermediate tables that later steps read several times (ranked supply and demand,
    allocations, assigned ids). The plan runs once, its shuffles coalesced by their measured
    sizes; later steps read only the columns they need, and the optimizer knows the table's
    size. A lost executor loses nothing. The files stay until :func:`drop_materialized`.
    """
    path = f"{_materialized_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _materialized_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def drop_materialized(spark: SparkSession) -> None:
    """Delete this application's materialized tables (when its results are written)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_materialized_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
