"""Where intermediate tables go: the folder in spark.checkpoint.dir, which the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's own; where neither is set, a temporary folder in local mode (tests), an error on a cluster."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="arborist-")
    sc.setCheckpointDir(root)
    return root


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and read back from shared storage: its lineage is cut, and a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
