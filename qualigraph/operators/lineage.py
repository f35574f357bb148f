"""Cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; a temporary one only where none is set and driver and executors are one process."""
    context, found = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    now = context._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        if not found and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors see")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="qualigraph-"))
    return found or context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def spread(df: DataFrame) -> DataFrame:
    """`df` in as many partitions as there are cores, if it has fewer: a file of one row group is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
