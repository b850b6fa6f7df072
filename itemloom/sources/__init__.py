"""Readers. Every reader goes through Spark, so any store that Spark reads will do."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table *name* of the data set in *sf_dir* (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(df: DataFrame, rows: int = 500_000) -> int:
    """Partitions for *df* at so many *rows* each, and at least one a core: what a task holds in a sort or a grouping then stays the same as
    tables grow. *df* should be a table, whose rows are counted from its footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir; only where that is unset, as in tests, a temporary
    one), deleted when the driver's JVM ends."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="itemloom-"))
        path = sc.getCheckpointDir()
    path = f"{path.rstrip('/')}/itemloom-{name}-{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
