"""Telemetry stored in buckets of vehicles, sorted inside: trips, gaps and stops of it need no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_clustered(
    rows: DataFrame, table: str, path: str, key: str = "vehicle_id", order: Sequence[str] = ("timestep_time",), buckets: int = 64
) -> DataFrame:
    """Saves ``rows`` as ``table`` below ``path`` and reads it back: all rows of a key in one of ``buckets`` files, in order.

    Choose ``buckets`` so that one holds what a task can sort: later jobs have as many tasks. The one shuffle is this
    one, by the buckets themselves, so a bucket is one file however many tasks the rows come from. A vehicle that holds
    a large part of all rows makes one bucket large; its aggregates are still computed as the bucket is read.
    """
    spark = rows.sparkSession
    placed = rows.repartition(buckets, key)
    writer = placed.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key, *order)
    writer.saveAsTable(table)
    return read_clustered(spark, table)


def read_clustered(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
