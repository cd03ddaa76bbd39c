"""Cleaning, validation, deduplication and column selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import settings as S
from fleetlens.functions.columns import edge_of_lane
from fleetlens.operators.joins import lookup_with_default


def check_required_columns(df: DataFrame, required: Sequence[str], label: str) -> None:
    """Raise ``ValueError`` naming the columns that are missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns for {label}: {', '.join(missing)}")


def clean_telemetry(fcd: DataFrame, end_time: int = S.SCENARIO_SECONDS) -> DataFrame:
    """Rows without nulls, before ``end_time``, speed in km/h."""
    kept = fcd.dropna().where(F.col("timestep_time") < end_time)
    return kept.withColumn("vehicle_speed", F.col("vehicle_speed") * S.MPS_TO_KMH)


def fill_nulls(df: DataFrame, text: str = "0") -> DataFrame:
    """Numbers become 0 and strings ``text`` where they are null (the policy of the fuel path)."""
    return df.fillna(0).fillna(text)


def drop_repeated(df: DataFrame, keys: Sequence[str], prefer: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first by ``prefer``, then by all other columns.

    An aggregate, so copies collapse before the shuffle however many there are.
    """
    rest = [c for c in df.columns if c not in keys and c not in prefer]
    ordered = [*prefer, *rest]
    if not ordered:
        return df.distinct()
    picked = df.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def split_features_and_target(
    df: DataFrame, targets: Sequence[str] = ("duration",), features: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Feature columns and target columns, as two projections of the same plan."""
    check_required_columns(df, targets, "target")
    chosen = list(features) if features is not None else [c for c in df.columns if c not in targets]
    return df.select(*chosen), df.select(*targets)


def with_edges(fcd: DataFrame) -> DataFrame:
    """Adds ``edge_id`` and drops rows without one."""
    edged = fcd.withColumn("edge_id", edge_of_lane("vehicle_lane"))
    return edged.where(F.col("edge_id").isNotNull() & (F.col("edge_id") != ""))


def keep_eta_trips(
    trips: DataFrame, min_duration: float = S.ETA_MIN_DURATION, min_distance: float = S.ETA_MIN_DISTANCE
) -> DataFrame:
    return trips.where((F.col("duration") >= min_duration) & (F.col("distance") >= min_distance))


def keep_stops_trips(
    trips: DataFrame,
    min_duration: float = S.STOPS_MIN_DURATION,
    min_distance: float = S.STOPS_MIN_DISTANCE,
    min_records: int = S.STOPS_MIN_RECORDS,
) -> DataFrame:
    """Strict limits, unlike the ETA filter."""
    return trips.where(
        (F.col("n_records") >= min_records)
        & (F.col("duration") > min_duration)
        & (F.col("actual_distance") > min_distance)
    )


def keep_fuel_trips(trips: DataFrame, start_hour_limit: int = S.FUEL_START_HOUR_LIMIT) -> DataFrame:
    """Trips that start before the limit; used when fitting only."""
    return trips.where(F.col("start_hour") < start_hour_limit)


def select_model_columns(df: DataFrame, model_columns: Sequence[str]) -> DataFrame:
    """The model's columns in the model's order."""
    check_required_columns(df, model_columns, "model input")
    return df.select(*model_columns)


def select_runs(
    results: DataFrame, pattern: str = "transform|features|research", without_model: str | None = None
) -> DataFrame:
    """Runs whose name matches ``pattern`` in any case, optionally without one model."""
    kept = results.where(F.col("experiment").rlike(f"(?i){pattern}"))
    return kept.where(F.col("model") != without_model) if without_model else kept


def in_box(
    df: DataFrame, x: str, y: str, lower: tuple[float, float], upper: tuple[float, float]
) -> DataFrame:
    """Points inside a box, borders included."""
    return df.where(F.col(x).between(lower[0], upper[0]) & F.col(y).between(lower[1], upper[1]))


def with_feature_category(
    df: DataFrame, categories: Mapping[str, Sequence[str]] | None = None, column: str = "feature"
) -> DataFrame:
    """Adds the category of each feature name, ``none`` for unknown names."""
    pairs = [(f, c) for c, names in (categories or S.FEATURE_CATEGORIES).items() for f in names]
    table = df.sparkSession.createDataFrame(pairs, f"{column} string, category string")
    return lookup_with_default(df, table, column, "category", "none", computed=False)


def load_window(trips: DataFrame, start: int, end: int, column: str = "time_start") -> DataFrame:
    """Rows with ``start <= column < end``; both bounds reach the Parquet scan."""
    return trips.where((F.col(column) >= start) & (F.col(column) < end))
