"""Telemetry and trip tables: CSV and Parquet readers, conversion, partitioned writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import settings as S
from fleetlens.operators.prep import load_window
from fleetlens.schemas import TELEMETRY


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_telemetry_csv(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated text with a header, columns by declared type; a malformed row fails the job."""
    reader = spark.read.schema(TELEMETRY).option("sep", ";").option("header", True).option("mode", "FAILFAST")
    return reader.csv(path)


def write_telemetry(
    fcd: DataFrame, path: str, folder_seconds: int | None = S.SECONDS_PER_HOUR, rows_per_file: int = 5_000_000
) -> None:
    """Snappy Parquet, one folder per ``folder_seconds`` (an hour; None for no folders) so that time windows prune.

    Rows are range-partitioned by time before the write: each task writes to few folders and a crowded hour is
    spread over several tasks; ``rows_per_file`` bounds the files.
    """
    options = {"compression": "snappy", "maxRecordsPerFile": str(rows_per_file)}
    if folder_seconds is None:
        fcd.write.mode("overwrite").options(**options).parquet(path)
        return
    placed = fcd.withColumn("slot", F.floor(F.col("timestep_time") / folder_seconds))
    placed = placed.repartitionByRange("timestep_time", "vehicle_id").sortWithinPartitions("slot", "timestep_time")
    placed.write.mode("overwrite").options(**options).partitionBy("slot").parquet(path)


def convert_csv_to_parquet(
    spark: SparkSession, csv_path: str, parquet_path: str, folder_seconds: int | None = S.SECONDS_PER_HOUR
) -> DataFrame:
    write_telemetry(read_telemetry_csv(spark, csv_path), parquet_path, folder_seconds)
    return read_telemetry(spark, parquet_path)


def read_window(
    spark: SparkSession, path: str, start: int, end: int, column: str = "timestep_time",
    folder_seconds: int | None = None,
) -> DataFrame:
    """Rows with ``start <= column < end``; with ``folder_seconds`` only the folders of the window are listed."""
    rows = load_window(spark.read.parquet(path), start, end, column)
    if folder_seconds:
        rows = rows.where(F.col("slot").between(start // folder_seconds, (end - 1) // folder_seconds)).drop("slot")
    return rows


def write_trips(trips: DataFrame, path: str, time: str = "time_start", rows_per_file: int = 5_000_000) -> None:
    """Trips in time order across and inside files, so that window scans read few row groups.

    Ranges are cut by time and then by the hash of the row, so trips that start in one crowded second are many tasks.
    """
    ordered = trips.repartitionByRange(F.col(time), F.xxhash64(*trips.columns)).sortWithinPartitions(time)
    ordered.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
