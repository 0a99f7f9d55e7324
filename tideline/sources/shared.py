"""The application's folder that driver and executors share: intermediate tables outlive executors there."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()


def filesystem(spark: SparkSession, path: str):
    """(Hadoop's file system of the path, the path)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    system, target = filesystem(spark, path)
    system.delete(target, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; all of the application's are deleted when the driver ends.

    Where the setting is missing, a local master gets a temporary folder; a cluster must name one."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tideline-")
        context.setCheckpointDir(root)
    own = f"{root.rstrip('/')}/tables-{context.applicationId}"
    if own not in _FOLDERS:
        _FOLDERS.add(own)

        def gone() -> None:
            with contextlib.suppress(Exception):  # the JVM may have ended before
                delete(spark, own)

        atexit.register(gone)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
