"""Queries over trips: statistics, feature groups, fitted transforms, calibrators, folds and scenario sets."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from fleetlens.functions import columns as C
from fleetlens.operators import adaptation, features as X, folds, prep, stats
from fleetlens.operators.calibrators import (
    GROUPS, FeatureCalibrator, FeatureCalibratorETA, FeatureCalibratorFuel, FeatureCalibratorStops,
)
from fleetlens.operators.ordered import exact_percentiles
from fleetlens.operators.routes import edge_array_statistics
from fleetlens.plans import inputs as I
from fleetlens.plans.catalog import query, rounded, rounded_sql, table
from fleetlens.session import shared_path, stage
from fleetlens.settings import ETA_MODEL_FEATURES
from fleetlens.sources import telemetry as src

KEY = "trip_id, part, supplier"


def grid_centres(k: int, width: float = 3000.0) -> list[tuple[float, float]]:
    """Fixed centres on a circle, ordered by (x, y)."""
    return sorted((round(width * math.cos(a), 3), round(width * math.sin(a), 3)) for a in C.even_angles(k))


def nearest_sql(x: str, y: str, centres) -> str:
    scored = ", ".join(f"(({x}) - ({cx})) ** 2 + (({y}) - ({cy})) ** 2" for cx, cy in centres)
    return f"(list_position(dl := [{scored}], list_min([{scored}])) - 1)".replace("dl := ", "")


@query(
    "trip_statistics",
    f"""WITH {I.TRIPS_SQL} SELECT count(*) AS total_trips, round(avg(distance), 6) AS average_distance,
    round(avg(duration), 6) AS average_duration FROM trips""",
)
def trip_statistics(spark, folder):
    return rounded(stats.trip_statistics(I.trips(spark, folder)))


HISTOGRAM_SQL = """, x AS (SELECT min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi FROM trips),
    h AS (SELECT CAST(least(floor((CAST({c} AS DOUBLE) - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, count(*) AS n FROM trips, x GROUP BY 1)
    SELECT CAST(b AS INT) AS bin, coalesce(n, 0) AS n, round(lo + b * ((hi - lo) / 50), 4) + 0 AS lower,
    round(lo + (b + 1) * ((hi - lo) / 50), 4) + 0 AS upper FROM range(50) r(b) CROSS JOIN x LEFT JOIN h ON h.bin = b"""


@query("distance_histogram", f"WITH {I.TRIPS_SQL} {HISTOGRAM_SQL.format(c='distance')}")
def distance_histogram(spark, folder):
    return rounded(stats.histogram(I.trips(spark, folder), "distance"), 4)


@query("duration_histogram", f"WITH {I.TRIPS_SQL} {HISTOGRAM_SQL.format(c='duration')}")
def duration_histogram(spark, folder):
    return rounded(stats.histogram(I.trips(spark, folder), "duration"), 4)


@query(
    "mean_and_median_distance",
    f"""WITH {I.TRIPS_SQL} SELECT round(avg(distance), 6) AS mean, round(median(distance), 6) AS median FROM trips""",
)
def mean_and_median_distance(spark, folder):
    return rounded(stats.mean_and_median(I.trips(spark, folder), "distance"))


@query(
    "distance_percentiles",
    f"""WITH {I.TRIPS_SQL} SELECT model, round(quantile_cont(distance, 0.25), 6) AS p25,
    round(quantile_cont(distance, 0.5), 6) AS p50, round(quantile_cont(distance, 0.75), 6) AS p75
    FROM trips GROUP BY model""",
)
def distance_percentiles(spark, folder):
    return rounded(exact_percentiles(I.trips(spark, folder), "distance", [0.25, 0.5, 0.75], ["model"]))


@query(
    "distance_percentiles_in_chunks",
    f"""WITH {I.TRIPS_SQL} SELECT round(quantile_cont(distance, 0.1), 6) AS p10,
    round(quantile_cont(distance, 0.9), 6) AS p90 FROM trips""",
)
def distance_percentiles_in_chunks(spark, folder):
    """The path for groups above the size limit, with a limit that the test tables exceed."""
    return rounded(exact_percentiles(I.trips(spark, folder), "distance", [0.1, 0.9], group_rows=2000))


@query(
    "city_centres",
    f"""WITH {I.TRIPS_SQL} SELECT round(avg((source_x + destination_x) / 2), 6) AS centre_x,
    round(avg((source_y + destination_y) / 2), 6) AS centre_y, round(avg(source_x), 6) AS source_x,
    round(avg(source_y), 6) AS source_y FROM trips""",
)
def city_centres(spark, folder):
    trips = I.trips(spark, folder)
    x, y = X.midpoint_centre(trips)
    sx, sy = X.mean_point(trips, "source_x", "source_y")
    return rounded(spark.createDataFrame([(x, y, sx, sy)], "centre_x double, centre_y double, source_x double, source_y double"))


@query(
    "temporal_features",
    f"""WITH {I.TRIPS_SQL}, t AS (SELECT {KEY}, time_start + 36000 AS time_start FROM trips),
    h AS (SELECT *, CAST((time_start % 36000) // 3600 AS BIGINT) AS hour_bin FROM t)
    SELECT *, CAST(hour_bin <= 2 AS INT) AS is_morning, CAST(hour_bin BETWEEN 3 AND 6 AS INT) AS is_noon,
           CAST(hour_bin >= 7 AS INT) AS is_afternoon, CAST(hour_bin IN (0, 1, 8, 9) AS INT) AS is_rush_hour FROM h""",
)
def temporal_features(spark, folder):
    trips = I.trips(spark, folder).select(*I.ROW_ID, (F.col("time_start") + 36000).alias("time_start"))
    return X.temporal_features(trips)


SPATIAL_SQL = f"""{I.TRIPS_SQL}, fit AS (
  SELECT quantile_cont(distance, 0.25) AS p25, quantile_cont(distance, 0.75) AS p75,
         avg((source_x + destination_x) / 2) AS cx, avg((source_y + destination_y) / 2) AS cy FROM trips),
half AS (
  SELECT trips.*, (source_x + destination_x) / 2 AS x_center, (source_y + destination_y) / 2 AS y_center,
         destination_x - source_x AS x_difference, destination_y - source_y AS y_difference,
         sqrt((destination_x - source_x) ** 2 + (destination_y - source_y) ** 2) AS euclidean_distance, p25, p75, cx, cy
  FROM trips, fit),
spatial AS (
  SELECT *, euclidean_distance / distance AS route_efficiency, distance - euclidean_distance AS detour_length,
         atan2(y_difference, x_difference) AS trip_bearing, sin(atan2(y_difference, x_difference)) AS trip_bearing_sin,
         cos(atan2(y_difference, x_difference)) AS trip_bearing_cos,
         CAST(distance <= p25 AS INT) AS is_short_distance,
         CAST(distance > p25 AND distance <= p75 AS INT) AS is_medium_distance,
         CAST(distance > p75 AS INT) AS is_long_distance,
         sqrt((source_x - cx) ** 2 + (source_y - cy) ** 2) AS source_distance_from_city_center,
         sqrt((destination_x - cx) ** 2 + (destination_y - cy) ** 2) AS destination_distance_from_city_center,
         sqrt((x_center - cx) ** 2 + (y_center - cy) ** 2) AS trip_centrality,
         sqrt((destination_x - cx) ** 2 + (destination_y - cy) ** 2) - sqrt((source_x - cx) ** 2 + (source_y - cy) ** 2)
           AS trip_centrality_change
  FROM half)"""
SPATIAL = [
    "x_center", "y_center", "x_difference", "y_difference", "euclidean_distance", "route_efficiency", "detour_length",
    "trip_bearing", "trip_bearing_sin", "trip_bearing_cos", "source_distance_from_city_center",
    "destination_distance_from_city_center", "trip_centrality", "trip_centrality_change",
]
FLAGS = ["is_short_distance", "is_medium_distance", "is_long_distance"]


@query("spatial_features", f"WITH {SPATIAL_SQL} SELECT {KEY}, {', '.join(FLAGS)}, {rounded_sql(', '.join(SPATIAL))} FROM spatial")
def spatial_features(spark, folder):
    trips = I.trips(spark, folder)
    fitted = FeatureCalibrator.fit(trips, ("spatial",))
    return rounded(fitted.transform(trips).select(*I.ROW_ID, *FLAGS, *SPATIAL))


def fourier_sql() -> str:
    waves = [
        f"round({w}({c} / 1000 * {2 ** i}), 6) + 0 AS {c}_{w}_{i}" for c in X.ENDS for i in range(2) for w in ("sin", "cos")
    ]
    return f"WITH {I.TRIPS_SQL} SELECT {KEY}, {', '.join(waves)} FROM trips"


@query("fourier_features", fourier_sql())
def fourier_features(spark, folder):
    return rounded(X.fourier_features(I.trips(spark, folder).select(*I.ROW_ID, *X.ENDS)).drop(*X.ENDS))


@query(
    "cell_features",
    f"""WITH {I.TRIPS_SQL} SELECT {KEY}, CAST(floor(source_x / 100) AS INT) AS source_cell_x,
    CAST(floor(source_y / 100) AS INT) AS source_cell_y, CAST(floor(destination_x / 100) AS INT) AS destination_cell_x,
    CAST(floor(destination_y / 100) AS INT) AS destination_cell_y FROM trips""",
)
def cell_features(spark, folder):
    return X.cell_features(I.trips(spark, folder).select(*I.ROW_ID, *X.ENDS)).drop(*X.ENDS)


CENTRES = grid_centres(20)
CLUSTERS_SQL = f"""{I.TRIPS_SQL}, clustered AS (
  SELECT *, CAST({nearest_sql("source_x", "source_y", CENTRES)} AS INT) AS source_cluster,
         CAST({nearest_sql("destination_x", "destination_y", CENTRES)} AS INT) AS destination_cluster FROM trips)"""


@query("cluster_features", f"WITH {CLUSTERS_SQL} SELECT {KEY}, source_cluster, destination_cluster FROM clustered")
def cluster_features(spark, folder):
    trips = I.trips(spark, folder).select(*I.ROW_ID, *X.ENDS)
    return X.cluster_features(trips, CENTRES, CENTRES).drop(*X.ENDS)


PCA_SQL = f"""{I.TRIPS_SQL}, both_ends AS (
  SELECT source_x AS x, source_y AS y FROM trips UNION ALL SELECT destination_x, destination_y FROM trips),
moments AS (SELECT avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a FROM both_ends),
axes AS (
  SELECT mx, my, CASE WHEN abs(cos(a)) >= abs(sin(a)) THEN sign(cos(a)) ELSE sign(sin(a)) END AS s1,
         CASE WHEN abs(sin(a)) >= abs(cos(a)) THEN sign(-sin(a)) ELSE sign(cos(a)) END AS s2, cos(a) AS c, sin(a) AS s
  FROM moments)"""


@query(
    "principal_axes",
    f"""WITH {PCA_SQL} SELECT {KEY},
    round(((source_x - mx) * c + (source_y - my) * s) * s1, 4) + 0 AS source_pca_1,
    round(((source_y - my) * c - (source_x - mx) * s) * s2, 4) + 0 AS source_pca_2,
    round(((destination_x - mx) * c + (destination_y - my) * s) * s1, 4) + 0 AS destination_pca_1,
    round(((destination_y - my) * c - (destination_x - mx) * s) * s2, 4) + 0 AS destination_pca_2
    FROM trips, axes""",
)
def principal_axes(spark, folder):
    trips = I.trips(spark, folder).select(*I.ROW_ID, *X.ENDS)
    return rounded(X.pca_features(trips, X.fit_axes(trips)).drop(*X.ENDS), 4)


@query(
    "one_hot_clusters",
    f"WITH {CLUSTERS_SQL} SELECT {KEY}, "
    + ", ".join(f"CAST(source_cluster = {i} AS INT) AS start_cluster_{i}" for i in range(20)) + " FROM clustered",
)
def one_hot_clusters(spark, folder):
    trips = X.cluster_features(I.trips(spark, folder).select(*I.ROW_ID, *X.ENDS), CENTRES, CENTRES)
    hot = X.one_hot(trips, "source_cluster", 20, "start_cluster")
    return hot.select(*I.ROW_ID, *[f"start_cluster_{i}" for i in range(20)])


@query(
    "target_encoding",
    f"""WITH {CLUSTERS_SQL}, means AS (
      SELECT source_cluster AS c, avg(duration) AS m FROM clustered WHERE scenario = 'F' AND source_cluster < 15 GROUP BY 1)
    SELECT {KEY}, round(coalesce(m, 0.0), 6) AS source_cluster_target_encoded
    FROM clustered LEFT JOIN means ON source_cluster = c""",
)
def target_encoding(spark, folder):
    """Means of one scenario's first 15 clusters; the clusters not seen there are encoded as 0."""
    trips = X.cluster_features(I.trips(spark, folder), CENTRES, CENTRES)
    seen = trips.where((F.col("scenario") == "F") & (F.col("source_cluster") < 15))
    means = X.cluster_target_means(seen, "source_cluster", "duration")
    encoded = X.encode_target("source_cluster", means).alias("source_cluster_target_encoded")
    return rounded(trips.select(*I.ROW_ID, encoded))


@query(
    "centre_distances",
    f"WITH {I.TRIPS_SQL} SELECT {KEY}, "
    + ", ".join(
        f"round(sqrt((source_x - ({x})) ** 2 + (source_y - ({y})) ** 2), 6) AS src_dist_to_cluster_{i}"
        for i, (x, y) in enumerate(grid_centres(7))
    ) + " FROM trips",
)
def centre_distances(spark, folder):
    trips = I.trips(spark, folder).select(*I.ROW_ID, *X.ENDS)
    far = X.centre_distances(trips, "source_x", "source_y", grid_centres(7), "src_dist_to_cluster")
    return rounded(far.drop(*X.ENDS))


@query("log_features", f"WITH {I.TRIPS_SQL} SELECT {KEY}, round(ln(1 + distance), 6) AS distance FROM trips")
def log_features(spark, folder):
    return rounded(X.log_transform(I.trips(spark, folder).select(*I.ROW_ID, "distance")))


@query(
    "standard_scaled_features",
    f"""WITH {I.TRIPS_SQL}, fit AS (
      SELECT avg(distance) AS md, stddev_pop(distance) AS sd, avg(duration) AS mu, stddev_pop(duration) AS su
      FROM trips WHERE scenario = 'F')
    SELECT {KEY}, scenario, round((distance - md) / sd, 6) + 0 AS distance, round((duration - mu) / su, 6) + 0 AS duration
    FROM trips, fit""",
)
def standard_scaled_features(spark, folder):
    trips = I.trips(spark, folder)
    fitted = X.fit_scaler(trips.where("scenario = 'F'"), ["distance", "duration"])
    return rounded(X.scale(trips, fitted).select(*I.ROW_ID, "scenario", "distance", "duration"))


@query(
    "log_target_round_trip",
    f"""WITH {I.TRIPS_SQL} SELECT {KEY}, round(ln(1 + duration), 6) AS forward, round(CAST(duration AS DOUBLE), 4) AS inverse FROM trips""",
)
def log_target_round_trip(spark, folder):
    target = X.LogTarget()
    trips = I.trips(spark, folder).select(*I.ROW_ID, target.forward(F.col("duration")).alias("forward"))
    return rounded(trips.withColumn("inverse", F.round(target.inverse(F.col("forward")), 4)))


def box_cox_sql() -> str:
    grid = [round(-2 + i * 0.25, 12) for i in range(17)]
    scored = " UNION ALL ".join(
        f"SELECT CAST({e} AS DOUBLE) AS exponent, round(({e} - 1) * sum(ln(duration)) - count(*) / 2 * "
        f"ln(var_pop({'ln(duration)' if e == 0 else f'((CAST(duration AS DOUBLE) ** {e}) - 1) / {e}'})), 1) AS likelihood FROM trips"
        for e in grid
    )
    return f"WITH {I.TRIPS_SQL} {scored}"


@query("box_cox_likelihoods", box_cox_sql())
def box_cox_likelihoods(spark, folder):
    grid = [round(-2 + i * 0.25, 12) for i in range(17)]
    scores = X.BoxCoxTarget.likelihoods(I.trips(spark, folder), "duration", grid)
    rows = [(e, round(v, 1)) for e, v in zip(grid, scores)]
    return spark.createDataFrame(rows, "exponent double, likelihood double")


@query("box_cox_target")
def box_cox_target(spark, folder):
    trips = I.trips(spark, folder)
    target = X.BoxCoxTarget().fit(trips, "duration")
    moved = trips.select(*I.ROW_ID, "duration", target.forward(F.col("duration")).alias("forward"))
    return moved.withColumn("inverse", target.inverse(F.col("forward")))


@query("quantile_normal_target")
def quantile_normal_target(spark, folder):
    trips = I.trips(spark, folder)
    target = X.QuantileNormalTarget(200).fit(trips, "duration")
    moved = trips.select(*I.ROW_ID, "duration", target.forward(F.col("duration")).alias("forward"))
    return moved.withColumn("inverse", target.inverse(F.col("forward")))


ETA_NUMBERS = [c for c in ETA_MODEL_FEATURES if not c.startswith("is_") and c not in (
    "source_cluster", "destination_cluster", "time_start")]


@query(
    "eta_calibrator",
    f"""WITH {SPATIAL_SQL},
    both_ends AS (SELECT source_x AS x, source_y AS y FROM trips UNION ALL SELECT destination_x, destination_y FROM trips),
    moments AS (SELECT avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a
                FROM both_ends),
    axes AS (SELECT mx, my, cos(a) AS c, sin(a) AS s,
             CASE WHEN abs(cos(a)) >= abs(sin(a)) THEN sign(cos(a)) ELSE sign(sin(a)) END AS s1,
             CASE WHEN abs(sin(a)) >= abs(cos(a)) THEN sign(-sin(a)) ELSE sign(cos(a)) END AS s2 FROM moments),
    done AS (SELECT spatial.*, ((source_x - mx) * c + (source_y - my) * s) * s1 AS source_pca_1,
      ((source_y - my) * c - (source_x - mx) * s) * s2 AS source_pca_2,
      ((destination_x - mx) * c + (destination_y - my) * s) * s1 AS destination_pca_1,
      ((destination_y - my) * c - (destination_x - mx) * s) * s2 AS destination_pca_2,
      CAST({nearest_sql("source_x", "source_y", CENTRES)} AS INT) AS source_cluster,
      CAST({nearest_sql("destination_x", "destination_y", CENTRES)} AS INT) AS destination_cluster FROM spatial, axes)
    SELECT {KEY}, time_start, duration, {", ".join(FLAGS)}, source_cluster, destination_cluster,
           {rounded_sql(", ".join(ETA_NUMBERS), 4)} FROM done""",
)
def eta_calibrator(spark, folder):
    """The 22 columns with centres fixed, so that the twin can assign the same clusters; saved and loaded once."""
    trips = I.trips(spark, folder).drop("model", "scenario")
    inner = FeatureCalibrator.fit(trips, ("spatial", "pca"))
    path = shared_path(spark, "calibrator")
    FeatureCalibratorETA(inner.percentiles, inner.centre, CENTRES, CENTRES, inner.axes).save(spark, path)
    return rounded(FeatureCalibratorETA.load(spark, path).transform(trips), 4)


@query("eta_calibrator_fitted")
def eta_calibrator_fitted(spark, folder):
    """All of the calibration on the trips themselves, clusters included."""
    trips = I.trips(spark, folder).drop("model", "scenario")
    return FeatureCalibratorETA.fit(trips).transform(trips)


@query("all_feature_groups")
def all_feature_groups(spark, folder):
    """The 54 features of the six groups."""
    trips = I.trips(spark, folder).drop("model", "scenario")
    return FeatureCalibrator.fit(trips, clusters=8).transform(trips)


FUEL_READY_SQL = f"""WITH {I.TRIPS_SQL} SELECT {KEY}, time_start AS timestep_time_min,
  CAST((time_start // 3600) % 24 AS INT) AS start_hour, round(source_x, 6) AS vehicle_x_first, round(source_y, 6) AS vehicle_y_first,
  round(destination_x, 6) AS vehicle_x_last, round(destination_y, 6) AS vehicle_y_last, round(distance, 6) AS trip_actual_distance,
  round(sqrt((greatest(source_x, destination_x) - least(source_x, destination_x)) ** 2
           + (greatest(source_y, destination_y) - least(source_y, destination_y)) ** 2), 6) AS spatial_extent,
  round(sqrt((destination_x - source_x) ** 2 + (destination_y - source_y) ** 2), 6) AS straight_line_distance,
  {", ".join(f"CAST({nearest_sql('source_x', 'source_y', grid_centres(10))} = {i} AS INT) AS start_cluster_{i}" for i in range(10))},
  {", ".join(f"CAST({nearest_sql('destination_x', 'destination_y', grid_centres(10))} = {i} AS INT) AS end_cluster_{i}" for i in range(10))}
  FROM trips"""


@query("fuel_calibrator_on_trips", FUEL_READY_SQL)
def fuel_calibrator_on_trips(spark, folder):
    """Ready trips: the missing columns are derived, clusters come from fixed centres."""
    ready = I.trips(spark, folder).select(
        *I.ROW_ID, F.col("time_start").alias("timestep_time_min"),
        F.col("source_x").alias("vehicle_x_first"), F.col("source_y").alias("vehicle_y_first"),
        F.col("destination_x").alias("vehicle_x_last"), F.col("destination_y").alias("vehicle_y_last"),
        F.col("distance").alias("trip_actual_distance"),
        F.least("source_x", "destination_x").alias("minimum_x"), F.greatest("source_x", "destination_x").alias("maximum_x"),
        F.least("source_y", "destination_y").alias("minimum_y"), F.greatest("source_y", "destination_y").alias("maximum_y"),
    )
    calibrator = FeatureCalibratorFuel(grid_centres(10), grid_centres(10))
    return rounded(calibrator.transform(ready, keep=tuple(I.ROW_ID)))


@query("fuel_calibrator_fitted")
def fuel_calibrator_fitted(spark, folder):
    fcd = I.telemetry(spark, folder).drop("event_id", "user_id")
    hours = fcd.withColumn("timestep_time", F.col("timestep_time") % 36_000)
    return FeatureCalibratorFuel.fit(hours, restarts=2).transform(hours)


STOPS_CENTRES = grid_centres(7, 40.0)


def stops_sql() -> str:
    from fleetlens.plans.telemetry_queries import STOP_TRIPS_SQL

    ends = ""
    for end, short, at in (("source", "src", "trip_start"), ("dest", "dst", "trip_end")):
        ends += f", round(sqrt(({at}_x - cx) ** 2 + ({at}_y - cy) ** 2), 6) AS {end}_dist_to_center, {end}_cluster"
        ends += f", round(coalesce({end}_mean, 0.0), 6) AS {end}_cluster_target_encoded, "
        ends += ", ".join(f"CAST({end}_cluster = {i} AS INT) AS {short}_cluster_{i}" for i in range(7)) + ", "
        ends += ", ".join(
            f"round(sqrt(({at}_x - ({x})) ** 2 + ({at}_y - ({y})) ** 2), 6) AS {short}_dist_to_cluster_{i}"
            for i, (x, y) in enumerate(STOPS_CENTRES)
        )
    return f"""WITH {STOP_TRIPS_SQL}, good AS (
      SELECT *, CAST({nearest_sql("trip_start_x", "trip_start_y", STOPS_CENTRES)} AS INT) AS source_cluster,
             CAST({nearest_sql("trip_end_x", "trip_end_y", STOPS_CENTRES)} AS INT) AS dest_cluster
      FROM stop_trips WHERE n >= 2 AND dur > 60 AND actual_distance > 5),
    centre AS (SELECT avg(trip_start_x) AS cx, avg(trip_start_y) AS cy FROM good),
    sm AS (SELECT source_cluster, avg(actual_stops) AS source_mean FROM good GROUP BY 1),
    dm AS (SELECT dest_cluster, avg(actual_stops) AS dest_mean FROM good GROUP BY 1)
    SELECT trip_id, actual_stops{ends} FROM good JOIN sm USING (source_cluster) JOIN dm USING (dest_cluster), centre"""


@query("stops_calibrator", stops_sql())
def stops_calibrator(spark, folder):
    """Telemetry to stops trips to the spatial features of the stops model, with fixed centres."""
    from fleetlens.operators.trips import extract_stop_trips

    trips = stage(
        extract_stop_trips(
            I.telemetry(spark, folder), 2, 60, 5, is_break=lambda step: step > I.GAP,
            stopped=F.col("vehicle_speed") < 20, tiebreak=["event_id"],
        ),
        "stop-trips",
    )
    state = FeatureCalibratorStops(
        use_routes=False, centre=list(X.mean_point(trips, "trip_start_x", "trip_start_y")),
        source_centres=STOPS_CENTRES, destination_centres=STOPS_CENTRES,
    ).fit_means(trips)
    done = state.transform(trips)
    names = [c for c in done.columns if c.startswith(("source_", "dest_", "src_", "dst_"))]
    return rounded(done.select("trip_id", "actual_stops", *names))


@query(
    "edge_arrays",
    """SELECT doc_id, len(string_split(text, ' ')) AS route_num_edges, len(list_distinct(string_split(text, ' '))) AS route_unique_edges,
    round(len(list_distinct(string_split(text, ' '))) / CAST(len(string_split(text, ' ')) AS DOUBLE), 6) AS route_edge_reuse_ratio
    FROM documents""",
)
def edge_arrays(spark, folder):
    """The words of each document as the edges of a route; array functions inside the row."""
    routes = table(spark, folder, "documents").select("doc_id", F.split("text", " ", -1).alias("route_edges"))
    return rounded(routes.withColumns(edge_array_statistics("route_edges")).drop("route_edges"))


@query(
    "stratified_folds",
    f"""WITH {I.TRIPS_SQL}, e AS (SELECT list_distinct(quantile_cont(duration, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM trips),
    b AS (SELECT {KEY}, CAST(len(list_filter(q, lambda x: x < duration)) AS INT) AS stratum,
          {C.mixed_hash_sql("trip_id", 42)} AS h FROM trips, e)
    SELECT {KEY}, stratum, CAST((row_number() OVER (PARTITION BY stratum ORDER BY h, trip_id, part, supplier) - 1) % 5 AS INT) AS fold
    FROM b""",
)
def stratified_folds(spark, folder):
    trips = I.trips(spark, folder).select(*I.ROW_ID, "duration")
    return folds.stratified_folds(trips, "duration", I.ROW_ID).select(*I.ROW_ID, "stratum", "fold")


@query(
    "stratified_folds_in_chunks",
    f"""WITH {I.TRIPS_SQL}, b AS (SELECT {KEY}, {C.mixed_hash_sql("trip_id", 7)} AS h,
          CAST(CASE WHEN duration > (SELECT quantile_cont(duration, 0.5) FROM trips) THEN 1 ELSE 0 END AS INT) AS stratum FROM trips)
    SELECT {KEY}, stratum, CAST((row_number() OVER (PARTITION BY stratum ORDER BY h, trip_id, part, supplier) - 1) % 5 AS INT) AS fold
    FROM b""",
)
def stratified_folds_in_chunks(spark, folder):
    """Two strata that each hold half of all rows, cut into chunks."""
    trips = I.trips(spark, folder).select(*I.ROW_ID, "duration")
    folded = folds.stratified_folds(trips, "duration", I.ROW_ID, bins=2, seed=7, group_rows=1000, chunks=12)
    return folded.select(*I.ROW_ID, "stratum", "fold")


@query(
    "quantile_bins",
    f"""WITH {I.TRIPS_SQL}, e AS (SELECT quantile_cont(distance, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM trips)
    SELECT CAST(len(list_filter(list_distinct(q), lambda x: x < distance)) AS INT) AS stratum, count(*) AS n
    FROM trips, e GROUP BY 1""",
)
def quantile_bins(spark, folder):
    trips = I.trips(spark, folder).select("distance")
    binned = folds.quantile_bin(trips, "distance", folds.quantile_edges(trips, "distance"))
    return binned.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@query(
    "merged_scenarios",
    f"""WITH {I.TRIPS_SQL} SELECT {KEY}, CASE WHEN scenario = 'O' THEN time_start + 36000 ELSE time_start END AS time_start
    FROM trips""",
)
def merged_scenarios(spark, folder):
    trips = I.trips(spark, folder).select(*I.ROW_ID, "scenario", "time_start")
    merged = adaptation.merge_scenarios(trips.where("scenario = 'F'"), trips.where("scenario = 'O'"))
    path = shared_path(spark, "trips")
    src.write_trips(merged.drop("scenario"), path)
    return spark.read.parquet(path)


@query(
    "retraining_data",
    f"""WITH {I.TRIPS_SQL}
    (SELECT {KEY}, time_start, scenario FROM trips WHERE scenario = 'F' ORDER BY time_start DESC, {KEY} LIMIT 1000)
    UNION ALL
    (SELECT {KEY}, time_start, scenario FROM trips WHERE scenario = 'O' ORDER BY time_start, {KEY} LIMIT 1000)""",
)
def retraining_data(spark, folder):
    trips = I.trips(spark, folder).select(*I.ROW_ID, "time_start", "scenario")
    return adaptation.retraining_data(
        trips.where("scenario = 'F'"), trips.where("scenario = 'O'"), 1000, 1000, I.ROW_ID
    )


@query(
    "adaptation_test_data",
    f"""WITH {I.TRIPS_SQL} SELECT {KEY}, time_start FROM trips WHERE scenario = 'O'
    ORDER BY time_start, {KEY} OFFSET 1000""",
)
def adaptation_test_data(spark, folder):
    rain = I.trips(spark, folder).where("scenario = 'O'").select(*I.ROW_ID, "time_start")
    return adaptation.after_first(rain, 1000, I.ROW_ID)


@query(
    "labelled_union",
    """SELECT 'orders' AS source, o_orderkey AS id, o_totalprice AS amount, o_orderpriority AS priority FROM orders
    UNION ALL SELECT 'parts', p_partkey, p_retailprice, NULL FROM part""",
)
def labelled_union(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("priority")
    )
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("amount"))
    return adaptation.labelled_union({"orders": orders, "parts": parts}, "source")


@query(
    "features_and_target",
    f"""WITH {I.TRIPS_SQL} SELECT round(distance, 6) AS distance, round(source_x, 6) AS source_x, duration,
    CAST(0 AS DOUBLE) AS nothing FROM trips""",
)
def features_and_target(spark, folder):
    """Both projections in one: the feature side in model order and the target."""
    trips = I.trips(spark, folder).select("source_x", "distance", "duration")
    left, right = prep.split_features_and_target(trips)
    ordered = prep.select_model_columns(trips, [*reversed(left.columns), *right.columns])
    return rounded(ordered.withColumn("nothing", F.lit(0.0)))


@query(
    "eta_trip_filter",
    f"""WITH {I.TRIPS_SQL} SELECT {KEY} FROM trips WHERE duration >= 300 AND distance >= 1000""",
)
def eta_trip_filter(spark, folder):
    return prep.keep_eta_trips(I.trips(spark, folder), 300, 1000).select(*I.ROW_ID)


@query(
    "correlated_features",
    f"""WITH {I.TRIPS_SQL}, c AS (SELECT corr(source_x, distance) AS a, corr(source_x, duration) AS b, corr(distance, duration) AS d FROM trips)
    SELECT * FROM (SELECT 'distance' AS feature_1, 'source_x' AS feature_2, round(abs(a), 6) AS correlation FROM c
      UNION ALL SELECT 'duration', 'source_x', round(abs(b), 6) FROM c
      UNION ALL SELECT 'duration', 'distance', round(abs(d), 6) FROM c) WHERE correlation > 0.9""",
)
def correlated_features(spark, folder):
    return rounded(stats.correlated_pairs(I.trips(spark, folder), ["source_x", "source_y", "distance", "duration"], 0.9))


def wide_features(trips):
    """All six feature groups. Clusters are fitted on the trips with both ends; a trip without one has no cluster there."""
    fitted = FeatureCalibrator.fit(trips, tuple(g for g in GROUPS if g != "cluster"))
    placed = FeatureCalibrator.fit(trips.dropna(subset=X.ENDS), ("cluster",))
    centres = {"source_centres": placed.source_centres, "destination_centres": placed.destination_centres}
    return replace(fitted, groups=list(GROUPS), **centres).transform(trips)


@query("correlated_features_wide")
def correlated_features_wide(spark, folder):
    """All 54 features, nulls skipped pair by pair."""
    trips = I.trips(spark, folder).drop("model", "scenario", "trip_id", "part", "supplier")
    full = wide_features(trips)
    return stats.correlated_pairs(full, [c for c in full.columns if c != "duration"], 0.95)


@query(
    "scenario_change",
    f"""WITH {I.TRIPS_SQL}, m AS (SELECT avg(distance) FILTER (scenario = 'F') AS a, avg(distance) FILTER (scenario = 'O') AS b,
      avg(duration) FILTER (scenario = 'F') AS c, avg(duration) FILTER (scenario = 'O') AS d FROM trips)
    SELECT 'distance' AS measure, round(a, 6) AS first, round(b, 6) AS second, round((b - a) * 100 / a, 6) + 0 AS change_percent FROM m
    UNION ALL SELECT 'duration', round(c, 6), round(d, 6), round((d - c) * 100 / c, 6) + 0 FROM m""",
)
def scenario_change(spark, folder):
    return rounded(stats.scenario_change(I.trips(spark, folder), "scenario", "F", "O", ["distance", "duration"]))
