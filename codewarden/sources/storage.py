"""Folders through the file system of their path: local, HDFS or an object store."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def _of(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    system, folder = _of(spark, path)
    return system.exists(folder)


def delete(spark: SparkSession, path: str) -> None:
    system, folder = _of(spark, path)
    system.delete(folder, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, none if it is missing."""
    system, folder = _of(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(folder)) if system.exists(folder) else []


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df``, kept in the folder that ``spark.checkpoint.dir`` names; later use reads them there.

    Where that is unset and all of Spark runs on this machine, the folder is a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if root is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="codewarden-checkpoints-"))
    return df.checkpoint()
