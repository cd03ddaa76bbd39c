"""Trips built in a stream: a session per vehicle that ends after a pause, with records that come late merged in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trip_stream(records: DataFrame, gap: int, delay: str = "1 hour", tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """Trips, first and last record of each with its distance and number of records, of a stream or a table of telemetry.

    A pause above ``gap`` seconds ends a trip, as in the batch segments. In append mode a trip comes out once the
    watermark has passed its last record by the pause, so records up to ``delay`` out of order still join the trips
    they belong to, or join two trips into one. State per open trip is its ends and sums, not its records. Records
    without a vehicle or a time belong to no trip; the same record twice counts twice.
    """
    timed = records.where("vehicle_id IS NOT NULL AND timestep_time IS NOT NULL").withColumn("_at", F.timestamp_seconds("timestep_time"))
    if records.isStreaming:
        timed = timed.withWatermark("_at", delay)
    point = F.struct("timestep_time", *tiebreak, "vehicle_x", "vehicle_y", "vehicle_odometer")
    # times are whole seconds: half a second more takes a pause of gap seconds, not one of gap + 1, and closes no trip
    # while the watermark still admits its next record
    sessions = timed.groupBy("vehicle_id", F.session_window("_at", f"{gap * 1000 + 500} milliseconds").alias("_session")).agg(
        F.min(point).alias("_a"), F.max(point).alias("_b"), F.count(F.lit(1)).alias("n_records")
    )
    return sessions.select(
        "vehicle_id", F.col("_a.timestep_time").alias("time_start"), F.col("_b.timestep_time").alias("time_end"),
        F.col("_a.vehicle_x").alias("source_x"), F.col("_a.vehicle_y").alias("source_y"),
        F.col("_b.vehicle_x").alias("destination_x"), F.col("_b.vehicle_y").alias("destination_y"),
        (F.col("_b.vehicle_odometer") - F.col("_a.vehicle_odometer")).alias("distance"), "n_records",
    )
