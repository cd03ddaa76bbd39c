"""Queries over streams that score with models as rows, keep late rows, and build trips."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import functions as F

from fleetlens.operators import prep
from fleetlens.operators.prep import load_window
from fleetlens.plans import inputs as I
from fleetlens.plans.catalog import query, rounded
from fleetlens.plans.telemetry_queries import CLEAN_SQL, END
from fleetlens.session import shared_path, stage
from fleetlens.sources.registry import version_in_force
from fleetlens.streaming import lifecycle as L, model_table as M, scoring as R, trips as T

DAY = 86_400
# version, first and last second of its training rows, the second it comes into force: amid a slice that is scored at once
VERSIONS = [("v1", 0, 5 * DAY, 5 * DAY), ("v2", 0, 10 * DAY, 15 * DAY), ("v3", 5 * DAY, 20 * DAY, 25 * DAY)]
SLICES = [0, 10 * DAY, 20 * DAY, 40 * DAY]

SCORED_SQL = f"""WITH {I.ERRORS_SQL}, spans(version, first, last, valid_from) AS (VALUES {', '.join(map(str, VERSIONS))}),
fits AS (SELECT task, version, valid_from, regr_slope(truth, prediction) AS slope, regr_intercept(truth, prediction) AS level
  FROM errors JOIN spans ON ts >= first AND ts < last GROUP BY 1, 2, 3)
SELECT errors.task, ts, seq, version, round(abs(truth - (level + slope * prediction)), 6) + 0 AS error
FROM errors ASOF LEFT JOIN fits ON errors.task = fits.task AND ts >= valid_from"""


def _spans(spark, versions):
    rows = [(task, *v) for v in versions for task in I.TASKS]
    return spark.createDataFrame(rows, "task string, version string, start long, `end` long, valid_from long")


def _error_rows(spark, folder):
    """Errors with the prediction of the table as the one feature."""
    return I.errors(spark, folder).select("task", "ts", "seq", "truth", F.col("prediction").alias("level"))


def _errors_of(scored):
    error = F.abs(F.col("truth") - F.col("prediction"))
    return rounded(scored.select("task", "ts", "seq", "version", error.alias("error")))


def _scored(spark, folder, **limits):
    rows, spans = _error_rows(spark, folder), _spans(spark, VERSIONS)
    models = M.fit_linear_models(rows, spans, ["level"], "truth")
    marked = version_in_force(rows, spans, "ts", ("seq",)).withColumn("features", F.array("level"))
    return _errors_of(M.score_by_version(marked, models, **limits))


@query("scored_with_models_as_rows", SCORED_SQL)
def scored_with_models_as_rows(spark, folder):
    """Three versions of every task fitted in one aggregate; every row scored under the version in force."""
    return _scored(spark, folder)


@query("scored_with_large_models", SCORED_SQL)
def scored_with_large_models(spark, folder):
    """The path for models that may not travel whole: rows meet their own model, many rows over several copies of it."""
    return _scored(spark, folder, most_bytes=0, group_rows=500)


@query("hot_swap_streamed", SCORED_SQL)
def hot_swap_streamed(spark, folder):
    """Slices of ten days; after each, the next version of all tasks is fitted and published, to take over amid a slice."""
    rows = stage(_error_rows(spark, folder), "rows")
    published, inbox, sink, checkpoint = (shared_path(spark, n) for n in ("published", "inbox", "sink", "progress"))
    vectors = rows.withColumn("features", F.array("level"))

    def publish(version):
        spans = _spans(spark, [version])
        R.publish(M.fit_linear_models(rows, spans, ["level"], "truth"), spans, published)

    for version, (start, end) in zip(VERSIONS, pairwise(SLICES)):
        publish(version)
        load_window(vectors, start, end, "ts").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(vectors.schema).parquet(inbox)
        R.scored_stream(stream, published, sink, checkpoint, trigger={"availableNow": True}).awaitTermination()
    schema = "task string, ts long, seq long, truth double, version string, prediction double"
    return _errors_of(L.read_sink(spark, sink, schema))


HOURS, HELD_BACK, DELAY, ARRIVAL = 21_600, 3 * DAY, DAY, 5 * DAY


@query(
    "late_errors_streamed",
    f"""WITH {I.ERRORS_SQL}, arriving AS (SELECT task, ts, error, (ts // {HOURS} + 1) * {HOURS} AS window_end,
      (ts + CASE WHEN seq % 7 = 0 THEN {HELD_BACK} ELSE 0 END) // {ARRIVAL} AS batch FROM errors),
    marks AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DELAY} AS mark
      FROM arriving GROUP BY batch),
    told AS (SELECT *, coalesce(window_end <= mark, false) AS late FROM arriving JOIN marks USING (batch))
    SELECT task, window_end, round(avg(error) FILTER (NOT late), 6) + 0 AS mae, count(*) FILTER (NOT late) AS n_samples,
      count(*) FILTER (late) AS n_late FROM told GROUP BY 1, 2""",
)
def late_errors_streamed(spark, folder):
    """A seventh of the errors arrive three days late, at a delay of one day: counted per window and kept, not in the means."""
    arrival = F.col("ts") + F.when(F.col("seq") % 7 == 0, HELD_BACK).otherwise(0)
    rows = stage(I.errors(spark, folder).select("task", "ts", "seq", "error", arrival.alias("arrival")), "rows")
    inbox, state, checkpoint = (shared_path(spark, n) for n in ("inbox", "late", "progress"))
    watch = R.LateRows(spark, state, HOURS, DELAY)
    for start in range(0, rows.agg(F.max("arrival")).first()[0] + 1, ARRIVAL):
        load_window(rows, start, start + ARRIVAL, "arrival").drop("arrival").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("task string, ts long, seq long, error double").parquet(inbox)
        watch.start(stream, checkpoint, {"availableNow": True}).awaitTermination()  # one micro-batch a slice
    return rounded(watch.metrics())


SESSION_GAP = 12 * 3_600
SESSIONS_SQL = f"""WITH {CLEAN_SQL}, marked AS (SELECT *, coalesce(timestep_time - lag(timestep_time) OVER w > {SESSION_GAP}, true) AS opens
  FROM clean WINDOW w AS (PARTITION BY vehicle_id ORDER BY timestep_time, event_id)),
numbered AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY vehicle_id ORDER BY timestep_time, event_id) AS trip FROM marked)
SELECT vehicle_id, min(timestep_time) AS time_start, max(timestep_time) AS time_end,
  round(arg_min(vehicle_x, (timestep_time, event_id)), 6) + 0 AS source_x, round(arg_min(vehicle_y, (timestep_time, event_id)), 6) + 0 AS source_y,
  round(arg_max(vehicle_x, (timestep_time, event_id)), 6) + 0 AS destination_x,
  round(arg_max(vehicle_y, (timestep_time, event_id)), 6) + 0 AS destination_y,
  round(arg_max(vehicle_odometer, (timestep_time, event_id)) - arg_min(vehicle_odometer, (timestep_time, event_id)), 6) + 0 AS distance,
  count(*) AS n_records FROM numbered GROUP BY vehicle_id, trip"""


@query("trips_by_session", SESSIONS_SQL)
def trips_by_session(spark, folder):
    return rounded(T.trip_stream(prep.clean_telemetry(I.telemetry(spark, folder), END), SESSION_GAP, tiebreak=("event_id",)))


@query("trips_streamed", SESSIONS_SQL)
def trips_streamed(spark, folder):
    """Trips from slices of telemetry; every third record arrives up to a day after its time and still joins its trip."""
    clean = prep.clean_telemetry(I.telemetry(spark, folder), END).drop("user_id")
    arrival = F.col("timestep_time") + F.when(F.col("event_id") % 3 == 0, F.col("event_id") * 7919 % DAY).otherwise(0)
    rows = stage(clean.withColumn("arrival", arrival), "rows")
    inbox, sink, checkpoint = (shared_path(spark, n) for n in ("inbox", "sink", "progress"))
    schema = rows.drop("arrival").schema

    def arrive(slice):
        slice.write.mode("append").parquet(inbox)
        trips = T.trip_stream(spark.readStream.schema(schema).parquet(inbox), SESSION_GAP, "1 day", ("event_id",))
        with L.state_partitions(spark, 64):
            L.append_sink(trips, sink, checkpoint, trigger={"availableNow": True}).awaitTermination()

    for start in range(0, END + DAY, ARRIVAL):
        arrive(load_window(rows, start, start + ARRIVAL, "arrival").drop("arrival"))
    # the last slice moves the watermark past every pause: a record of no vehicle in the table, a year on
    values = {"vehicle_id": F.lit("-"), "timestep_time": F.lit(400 * DAY)}
    arrive(spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]))
    trips = "vehicle_id string, time_start long, time_end long, source_x double, source_y double, destination_x double, destination_y double, distance double, n_records long"
    return rounded(L.read_sink(spark, sink, trips).drop("batch").where("vehicle_id <> '-'"))
