"""Paths through the Hadoop file system, so local folders and object stores work alike."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _path(spark, path)
    return fs.exists(target)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob; only for control files such as run results, never for data files."""
    target, fs = _path(spark, pattern)
    found = fs.globStatus(target)
    return sorted(s.getPath().toString() for s in found) if found else []


def child_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the sub-folders of a folder."""
    target, fs = _path(spark, folder)
    if not fs.exists(target):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory())
