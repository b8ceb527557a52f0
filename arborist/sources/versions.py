"""Small tables in versions that appear whole: written aside, then renamed to the next number, which only one writer can take.

This is compare-and-swap for tables: a writer says which version its rows were made from, and is refused
where another one has come since. Readers see a version whole or not at all. The number is as safe as
the file system's rename: HDFS refuses a taken name atomically; on a local disk writers of one process are
kept apart here; an object store needs one writer.
"""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_renames = threading.Lock()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def appear(spark: SparkSession, aside: str, name: str, replace: bool = False) -> bool:
    """Renames a folder; False where the name is taken, unless `replace`, which removes what has it first."""
    sc = spark.sparkContext
    jvm = sc._jvm.org.apache.hadoop.fs
    to = jvm.Path(name)
    context = jvm.FileContext.getFileContext(to.toUri(), sc._jsc.hadoopConfiguration())
    with _renames:
        if replace and exists(spark, name):
            context.delete(context.makeQualified(to), True)
        try:
            context.rename(context.makeQualified(jvm.Path(aside)), context.makeQualified(to), sc._gateway.new_array(jvm.Options.Rename, 0))
        except Exception as why:
            if "AlreadyExists" in str(why):
                return False
            raise
    return True


class Contended(RuntimeError):
    """Other writers were faster too many times."""


class VersionedTable:
    """A table of the given columns below `root`, a path that Spark and Hadoop's file systems understand."""

    def __init__(self, spark: SparkSession, root: str, columns: str):
        self.spark, self.root, self.columns = spark, root.rstrip("/"), columns
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def current(self) -> int:
        """The last version, 0 without any."""
        return (self.versions() or [0])[-1]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last one); version 0 has none."""
        version = self.current() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.columns)
        return self.spark.read.schema(self.columns).parquet(f"{self.root}/v{version:08d}")

    def swap(self, base: int, rows: DataFrame) -> bool:
        """Makes rows the version after `base`, unless there is one already."""
        self._fs.mkdirs(self._path(self.root))
        aside = f"{self.root}/.pending-{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        if appear(self.spark, aside, f"{self.root}/v{base + 1:08d}"):
            return True
        self._fs.delete(self._path(aside), True)
        return False

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 50) -> int:
        """Replaces the rows by change(rows), again from the newest version whenever another writer came first; the version made."""
        for n in range(tries):
            base = self.current()
            if self.swap(base, change(self.read(base))):
                return base + 1
            time.sleep(random.random() * min(1.0, 0.01 * 2**n))
        raise Contended(f"{self.root}: {tries} attempts")

    def forget(self, keep: int = 2) -> int:
        """Removes all but the last `keep` versions; how many. Readers of an older version must be done."""
        old = self.versions()[:-keep]
        for v in old:
            self._fs.delete(self._path(f"{self.root}/v{v:08d}"), True)
        return len(old)
