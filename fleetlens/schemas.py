"""Declared schemas; files are never sampled to guess them."""

from __future__ import annotations

from pyspark.sql import types as T

TELEMETRY = T.StructType(
    [
        T.StructField("timestep_time", T.LongType(), False),
        T.StructField("vehicle_fuel", T.DoubleType()),
        T.StructField("vehicle_id", T.StringType()),
        T.StructField("vehicle_lane", T.StringType()),
        T.StructField("vehicle_odometer", T.DoubleType()),
        T.StructField("vehicle_speed", T.DoubleType()),
        T.StructField("vehicle_waiting", T.DoubleType()),
        T.StructField("vehicle_x", T.DoubleType()),
        T.StructField("vehicle_y", T.DoubleType()),
    ]
)

TRIPS = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("source_x", "source_y", "destination_x", "destination_y")]
    + [
        T.StructField("time_start", T.LongType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("duration", T.LongType()),
    ]
)

METRICS = ["training_time", "prediction_time", "evaluation_time", "mae", "mape"]

_metrics = [T.StructField(m, T.DoubleType()) for m in METRICS]

# model -> metrics with the same five per fold
RUN_RESULTS = T.MapType(
    T.StringType(),
    T.StructType([*_metrics, T.StructField("per_fold", T.ArrayType(T.StructType(_metrics)))]),
)

STUDY = T.StructType(
    [
        T.StructField("best_trial", T.LongType()),
        T.StructField("best_value", T.DoubleType()),
        T.StructField("study_name", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("n_trials", T.LongType()),
        T.StructField(
            "trials",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("number", T.LongType()),
                        T.StructField("value", T.DoubleType()),
                        T.StructField("state", T.StringType()),
                        T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
                        T.StructField("user_attrs", T.MapType(T.StringType(), T.DoubleType())),
                    ]
                )
            ),
        ),
    ]
)

IMPORTANCE = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("importance_mean", T.DoubleType()),
        T.StructField("percentage_mean", T.DoubleType()),
    ]
)

RANKING = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("final_score", T.DoubleType()),
        T.StructField("final_rank", T.DoubleType()),
        T.StructField("final_scaled", T.DoubleType()),
        T.StructField("normalized_rank", T.DoubleType()),
        T.StructField("category", T.StringType()),
    ]
)

ERRORS = T.StructType(
    [
        T.StructField("task", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("error", T.DoubleType()),
    ]
)
