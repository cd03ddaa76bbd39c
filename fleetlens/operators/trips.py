"""Telemetry to trips: ordered grouped aggregation, gap segmentation, stop counting, sub-trips."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import settings as S
from fleetlens.functions.columns import edge_of_lane, hour_of, mixed_hash
from fleetlens.operators.joins import keep_known
from fleetlens.operators.ordered import OrderedRows
from fleetlens.operators.prep import (
    check_required_columns, drop_repeated, fill_nulls, keep_eta_trips, keep_stops_trips,
)

TRIP_COLUMNS = ["source_x", "source_y", "destination_x", "destination_y", "time_start", "distance", "duration"]


def generate_trips(
    fcd: DataFrame,
    min_duration: float = S.ETA_MIN_DURATION,
    min_distance: float = S.ETA_MIN_DISTANCE,
    tiebreak: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """One trip per vehicle from its first and last record.

    The ends are aggregates that combine before the shuffle, so no vehicle is too long for a task. Without ``tiebreak``
    the order is the time alone and the buffers stay primitive (hash aggregation, nothing sorted); give columns only
    where a vehicle can have several records in one second.
    """
    if tiebreak:
        point = F.struct("timestep_time", *tiebreak, "vehicle_x", "vehicle_y", "vehicle_odometer")
        found = fcd.groupBy("vehicle_id").agg(F.min(point).alias("_a"), F.max(point).alias("_b"))
        ends = found.select(
            "vehicle_id", F.col("_a.vehicle_x").alias("source_x"), F.col("_a.vehicle_y").alias("source_y"),
            F.col("_b.vehicle_x").alias("destination_x"), F.col("_b.vehicle_y").alias("destination_y"),
            F.col("_a.vehicle_odometer").alias("_from"), F.col("_b.vehicle_odometer").alias("_to"),
            F.col("_a.timestep_time").alias("time_start"), F.col("_b.timestep_time").alias("_end"),
        )
    else:
        at = F.col("timestep_time")
        ends = fcd.groupBy("vehicle_id").agg(
            F.min_by("vehicle_x", at).alias("source_x"), F.min_by("vehicle_y", at).alias("source_y"),
            F.max_by("vehicle_x", at).alias("destination_x"), F.max_by("vehicle_y", at).alias("destination_y"),
            F.min_by("vehicle_odometer", at).alias("_from"), F.max_by("vehicle_odometer", at).alias("_to"),
            F.min(at).alias("time_start"), F.max(at).alias("_end"),
        )
    trips = ends.withColumns(
        {"duration": F.col("_end") - F.col("time_start"), "distance": F.col("_to") - F.col("_from")}
    )
    return keep_eta_trips(trips, min_duration, min_distance).select(*keep, *TRIP_COLUMNS)


def add_time_features(fcd: DataFrame) -> DataFrame:
    """Adds ``hour_bin`` and replaces nulls by 0."""
    return fill_nulls(fcd.withColumn("hour_bin", hour_of("timestep_time")))


def count_points(fcd: DataFrame, min_points: int = S.FUEL_MIN_POINTS) -> DataFrame:
    """Vehicles with at least ``min_points`` records."""
    return fcd.groupBy("vehicle_id").count().where(F.col("count") >= min_points).select("vehicle_id")


def create_trips_simple(
    fcd: DataFrame, min_points: int = S.FUEL_MIN_POINTS, prefer: Sequence[str] = ()
) -> DataFrame:
    """Records of vehicles with enough of them, one record per vehicle and second."""
    single = drop_repeated(fcd, ["vehicle_id", "timestep_time"], prefer)
    return keep_known(single, count_points(single, min_points), "vehicle_id")


def _span(high_x: str, low_x: str, high_y: str, low_y: str) -> Column:
    return F.hypot(F.col(high_x) - F.col(low_x), F.col(high_y) - F.col(low_y))


def create_trip_features(fcd: DataFrame, min_points: int = 0) -> DataFrame:
    """Fuel trips from records that are unique per vehicle and second; ``min_points`` drops short ones in passing."""
    t = F.col("timestep_time")
    grouped = fcd.groupBy("vehicle_id").agg(
        F.min(t).alias("timestep_time_min"),
        F.min_by("vehicle_x", t).alias("vehicle_x_first"),
        F.max_by("vehicle_x", t).alias("vehicle_x_last"),
        F.min_by("vehicle_y", t).alias("vehicle_y_first"),
        F.max_by("vehicle_y", t).alias("vehicle_y_last"),
        F.min("vehicle_x").alias("_x0"), F.max("vehicle_x").alias("_x1"),
        F.min("vehicle_y").alias("_y0"), F.max("vehicle_y").alias("_y1"),
        F.min("vehicle_odometer").alias("_o0"), F.max("vehicle_odometer").alias("_o1"),
        F.min_by("hour_bin", t).alias("_hour"),
        F.sum("vehicle_fuel").alias("_fuel"),
        F.count(F.lit(1)).alias("_n"),
    )
    return grouped.where(F.col("_n") >= min_points).select(
        "vehicle_id", "timestep_time_min", "vehicle_x_first", "vehicle_x_last", "vehicle_y_first", "vehicle_y_last",
        F.log1p("_fuel").alias("vehicle_fuel_log_sum"),
        (F.col("_o1") - F.col("_o0")).alias("trip_actual_distance"),
        (F.col("_hour") % 24).cast("int").alias("start_hour"),
        _span("vehicle_x_last", "vehicle_x_first", "vehicle_y_last", "vehicle_y_first").alias("straight_line_distance"),
        _span("_x1", "_x0", "_y1", "_y0").alias("spatial_extent"),
    )


def fuel_trips(fcd: DataFrame, min_points: int = S.FUEL_MIN_POINTS, prefer: Sequence[str] = ()) -> DataFrame:
    """Telemetry to fuel trips in two aggregations, without joining the counts back to the records."""
    single = drop_repeated(add_time_features(fcd), ["vehicle_id", "timestep_time"], prefer)
    return create_trip_features(single, min_points)


def _trip_name() -> Column:
    return F.concat_ws("_", F.col("vehicle_id").cast("string"), F.col("trip_segment").cast("string"))


def split_at_gaps(
    fcd: DataFrame,
    is_break: Callable[[Column], Column] = lambda step: step != 1,
    tiebreak: Sequence[str] = (),
    **layout,
) -> OrderedRows:
    """Adds ``trip_segment`` and ``trip_id``: a new trip starts wherever the step to the previous record breaks."""
    laid = OrderedRows.lay_out(fcd, ["vehicle_id"], ["timestep_time", *tiebreak], **layout)
    laid = laid.previous(_before=F.col("timestep_time"))
    step = F.col("timestep_time") - F.col("_before")
    starts = F.when(F.col("_before").isNull() | is_break(step), 1).otherwise(0)
    laid = laid.running(trip_segment=("sum", starts))
    return laid.with_rows(laid.df.withColumn("trip_id", _trip_name()).drop("_before"))


def mark_stops(laid: OrderedRows, stopped: Column) -> OrderedRows:
    """Adds ``stop_start``: 1 on the first record of every run of stopped records within a trip."""
    laid = laid.previous(_prior=F.struct(F.col("trip_segment").alias("s"), stopped.alias("z")))
    continues = (F.col("_prior.s") == F.col("trip_segment")) & F.col("_prior.z")
    begins = F.when(stopped & ~F.coalesce(continues, F.lit(False)), 1).otherwise(0)
    return laid.with_rows(laid.df.withColumn("stop_start", begins).drop("_prior"))


def edge_statistics(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per trip: records with an edge, distinct edges, and their ratio (0, 0, 1 without edges)."""
    counted = records.groupBy(*keys).agg(
        F.count("edge_id").alias("route_num_edges"), F.count_distinct("edge_id").alias("route_unique_edges")
    )
    ratio = F.try_divide(F.col("route_unique_edges").cast("double"), F.col("route_num_edges"))
    return counted.withColumn("route_edge_reuse_ratio", F.coalesce(ratio, F.lit(1.0)))


def extract_stop_trips(
    fcd: DataFrame,
    min_records: int = S.STOPS_MIN_RECORDS,
    min_duration: float = S.STOPS_MIN_DURATION,
    min_distance: float = S.STOPS_MIN_DISTANCE,
    use_routes: bool = True,
    is_break: Callable[[Column], Column] = lambda step: step != 1,
    stopped: Column | None = None,
    tiebreak: Sequence[str] = (),
    **layout,
) -> DataFrame:
    """Telemetry to stops trips: segments, runs of standing still, route statistics and filters.

    Records without an edge leave after the segmentation and before the stops are counted.
    """
    needed = ["vehicle_id", "timestep_time", "vehicle_x", "vehicle_y", "vehicle_speed", "vehicle_odometer"]
    check_required_columns(fcd, needed, "stops trips")
    stopped = F.col("vehicle_speed") == 0 if stopped is None else stopped
    routed = use_routes and "vehicle_lane" in fcd.columns
    laid = split_at_gaps(fcd, is_break, tiebreak, **layout)
    if routed:
        edged = laid.df.withColumn("edge_id", edge_of_lane("vehicle_lane")).where("edge_id <> ''")
        laid = laid.with_rows(edged)
    records = mark_stops(laid, stopped).rows()
    at = F.struct("timestep_time", *tiebreak)
    point = F.struct("vehicle_x", "vehicle_y", "vehicle_odometer", "timestep_time")
    edges = (
        [F.count("edge_id").alias("route_num_edges"), F.count_distinct("edge_id").alias("route_unique_edges")]
        if routed
        else [F.lit(0).cast("long").alias("route_num_edges"), F.lit(0).cast("long").alias("route_unique_edges")]
    )
    grouped = records.groupBy("vehicle_id", "trip_segment").agg(
        F.min_by(point, at).alias("_a"), F.max_by(point, at).alias("_b"),
        F.sum("stop_start").alias("actual_stops"), F.count(F.lit(1)).alias("n_records"), *edges,
    )
    a, b = "_a.vehicle_", "_b.vehicle_"
    ratio = F.try_divide(F.col("route_unique_edges").cast("double"), F.col("route_num_edges"))
    trips = grouped.select(
        _trip_name().alias("trip_id"), "vehicle_id",
        F.col(f"{a}x").alias("trip_start_x"), F.col(f"{a}y").alias("trip_start_y"),
        F.col(f"{b}x").alias("trip_end_x"), F.col(f"{b}y").alias("trip_end_y"),
        (F.col(f"{b}odometer") - F.col(f"{a}odometer")).alias("actual_distance"),
        F.hypot(F.col(f"{b}x") - F.col(f"{a}x"), F.col(f"{b}y") - F.col(f"{a}y")).alias("straight_distance"),
        "actual_stops",
        (hour_of("_a.timestep_time") % 24).cast("int").alias("hour_of_day"),
        F.col("_a.timestep_time").alias("timestep"),
        (F.col("_b.timestep_time") - F.col("_a.timestep_time")).alias("duration"),
        "n_records", "route_num_edges", "route_unique_edges",
        F.coalesce(ratio, F.lit(1.0)).alias("route_edge_reuse_ratio"),
    )
    return keep_stops_trips(trips, min_duration, min_distance, min_records).drop("duration", "n_records")


def generate_full_trips(
    fcd: DataFrame,
    min_duration: float = S.ETA_MIN_DURATION,
    min_distance: float = S.ETA_MIN_DISTANCE,
    rate: float = S.SUB_TRIP_RATE,
    min_ratio: float = S.SUB_TRIP_MIN_RATIO,
    seed: int = 42,
    seed_column: str | None = None,
    tiebreak: Sequence[str] = (),
    **layout,
) -> DataFrame:
    """Whole trips plus, for ``rate`` > 0, random contiguous sub-trips.

    A vehicle with n records yields int(n * rate) draws. Record i carries the draws i, i + n, i + 2n, ..., so the
    draws of a long vehicle are spread like its records. Each draw looks up its two ends by (vehicle, position).
    """
    whole = generate_trips(fcd, min_duration, min_distance, tiebreak)
    if rate <= 0:
        return whole
    number = F.col(seed_column) if seed_column else F.pmod(F.xxhash64("vehicle_id"), F.lit(2147483648))
    laid = OrderedRows.lay_out(fcd, ["vehicle_id"], ["timestep_time", *tiebreak], **layout)
    indexed = laid.numbered("_at").totals(_n=("count", F.lit(1))).rows().withColumn("_at", F.col("_at") - 1)
    rounds = F.sequence(F.lit(0), F.lit(max(0, int(-(-rate // 1)) - 1)))
    draws = (
        indexed.select("vehicle_id", "_at", "_n", number.alias("_key"), F.explode(rounds).alias("_round"))
        .withColumn("_draw", F.col("_at") + F.col("_round") * F.col("_n"))
        .where(F.col("_draw") < F.floor(F.col("_n") * rate))
        .withColumn("_least", F.greatest(F.lit(2), F.floor(F.col("_n") * min_ratio)))
        .where(F.col("_n") >= F.col("_least"))
    )
    mixed = F.col("_key") * 1000003 + F.col("_draw")
    draws = draws.withColumn("_i", mixed_hash(mixed, seed) % (F.col("_n") - F.col("_least") + 1))
    reach = mixed_hash(mixed, seed + 1) % (F.col("_n") - F.col("_i") - F.col("_least") + 1)
    draws = draws.withColumn("_j", F.col("_i") + F.col("_least") + reach - 1).select("vehicle_id", "_i", "_j")
    point = indexed.select(
        "vehicle_id", "_at", F.struct("vehicle_x", "vehicle_y", "vehicle_odometer", "timestep_time").alias("_p")
    )
    begin = point.withColumnsRenamed({"_at": "_i", "_p": "_a"})
    finish = point.withColumnsRenamed({"_at": "_j", "_p": "_b"})
    parts = draws.join(begin, ["vehicle_id", "_i"]).join(finish, ["vehicle_id", "_j"]).select(
        F.col("_a.vehicle_x").alias("source_x"), F.col("_a.vehicle_y").alias("source_y"),
        F.col("_b.vehicle_x").alias("destination_x"), F.col("_b.vehicle_y").alias("destination_y"),
        F.col("_a.timestep_time").alias("time_start"),
        (F.col("_b.vehicle_odometer") - F.col("_a.vehicle_odometer")).alias("distance"),
        (F.col("_b.timestep_time") - F.col("_a.timestep_time")).alias("duration"),
    )
    return whole.unionByName(keep_eta_trips(parts, min_duration, min_distance))
