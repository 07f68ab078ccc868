"""Versions of a stored dataset: data first, a manifest last.

A version is a folder of data and, once all of it is written, one small JSON manifest
(``_versions/000000000042.json``) that names it. Readers take the manifest of the highest
number, so they never see a half-written version: without its manifest it doesn't exist, and
a run that fails in between leaves the last complete version current. Manifests are written
under another name and renamed; a number is taken once, so of two writers that prepared the
same next version the second one fails instead of undoing the first.

The files go through Spark's own Hadoop file systems (any folder that Spark can read).
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from boutique.sources import schemas as S
from boutique.sources.tables import TABLE_NAMES, Tables, conform


class VersionConflict(RuntimeError):
    """Another writer has published this version number first."""


class VersionLog:
    """The manifests of one dataset below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = f"{self.root}/_versions"

    # ---- file system ---------------------------------------------------------------------
    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        """Names in a folder (empty if there is none)."""
        path, fs = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def delete(self, folder: str) -> None:
        path, fs = self._path(folder)
        fs.delete(path, True)

    def _read(self, name: str) -> str:
        path, fs = self._path(name)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    # ---- manifests -----------------------------------------------------------------------
    def numbers(self) -> list[int]:
        return [int(m.group(1)) for m in (re.fullmatch(r"(\d{12})\.json", n) for n in self.names(self.folder)) if m]

    def read(self, number: int) -> dict:
        return json.loads(self._read(f"{self.folder}/{number:012d}.json"))

    def current(self) -> tuple[int, dict] | None:
        """(number, manifest) of the last complete version, or None."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else None

    def publish(self, manifest: dict, after: int) -> int:
        """Make ``manifest`` the version after number ``after`` (0: the first one)."""
        if self.numbers()[-1:] not in ([after], [] if after == 0 else [after]):
            raise VersionConflict(f"version {after} is no longer the current one")
        number = after + 1
        target, fs = self._path(f"{self.folder}/{number:012d}.json")
        draft, _ = self._path(f"{self.folder}/.{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise VersionConflict(f"version {number} exists")
        return number

    def new_folder(self, kind: str = "data") -> str:
        """A folder for the data of a version to come (relative to the root)."""
        return f"{kind}-{uuid.uuid4().hex}"


def publish_tables(tables: Tables, root: str, names: tuple[str, ...] = TABLE_NAMES) -> int:
    """SNK2: write ``names`` as the next version below ``root`` and make it current. Tables
    not named keep the files of the version before. Returns the version's number."""
    log = VersionLog(tables.spark, root)
    number, before = log.current() or (0, {"tables": {}})
    folder = log.new_folder("tables")
    for n in names:
        conform(tables.table(n), n).write.mode("errorifexists").parquet(f"{log.root}/{folder}/{n}")
    return log.publish({"tables": before["tables"] | {n: f"{folder}/{n}" for n in names}}, number)


def read_tables(spark: SparkSession, root: str, number: int | None = None) -> Tables:
    """The tables of the last complete version (or of version ``number``)."""
    log = VersionLog(spark, root)
    found = log.current() if number is None else (number, log.read(number))
    if found is None:
        raise FileNotFoundError(f"no complete version below {log.root}")
    where = found[1]["tables"]

    def loader(n: str):
        def load() -> DataFrame:
            return spark.read.schema(S.TABLES[n]).parquet(f"{log.root}/{where[n]}")
        return load

    return Tables(spark=spark, loaders={n: loader(n) for n in where})


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the table folders that only versions before the last ``keep`` name, and those
    versions' manifests. Folders that no manifest names (a version being written) stay."""
    log = VersionLog(spark, root)
    numbers = log.numbers()
    old, kept = numbers[:-keep], numbers[-keep:]

    def used(some: list[int]) -> set[str]:
        return {path.split("/")[0] for n in some for path in log.read(n)["tables"].values()}

    gone = sorted(used(old) - used(kept))
    for n in old:
        log.delete(f"{log.folder}/{n:012d}.json")
    for folder in gone:
        log.delete(f"{log.root}/{folder}")
    return gone
