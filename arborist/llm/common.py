"""Helpers shared by the corpus operators: shared storage, materialised tables, column checks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one in local mode (tests), an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="arborist-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/arborist-{what}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def forget(df: DataFrame) -> None:
    """Remove a table made by stored() as soon as nothing reads it any more."""
    path = getattr(df, "_arborist_path", None)
    if path:
        _remove(df.sparkSession, path)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001, S112 - gone already, or the session is; the next path may still be there
            continue


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written once to shared storage and read back: lineage is cut, lost executors cost nothing.

    The writer's commit makes the rows the same for every later reader, also where they came from
    tasks that were tried again.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._arborist_path = path
    return out


def columns(df: DataFrame, *pairs: tuple[str, str, str]) -> DataFrame:
    """Only the named columns, cast and renamed: (name in df, name out, type)."""
    return df.select(*[F.col(f"`{a}`").cast(t).alias(b) for a, b, t in pairs])
