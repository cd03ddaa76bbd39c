"""Queries over telemetry: cleaning, trips, segments, stops, fuel trips and telemetry statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import columns as C
from fleetlens.operators import prep, sketches, stats, trips as T
from fleetlens.operators.ordered import OrderedRows
from fleetlens.plans import inputs as I
from fleetlens.plans.catalog import query, rounded, rounded_sql, table
from fleetlens.session import shared_path, stage
from fleetlens.sources import clustered, telemetry as src

END = 25 * 86_400
PAUSE = lambda step: step > I.GAP

CLEAN_SQL = f"""{I.TELEMETRY_SQL}, clean AS (
  SELECT * REPLACE (vehicle_speed * CAST(3.6 AS DOUBLE) AS vehicle_speed) FROM telemetry WHERE timestep_time < {END})"""

TRIPS_FROM_TELEMETRY = f"""WITH {CLEAN_SQL}, ends AS (
  SELECT vehicle_id, arg_min(vehicle_x, (timestep_time, event_id)) AS source_x,
         arg_min(vehicle_y, (timestep_time, event_id)) AS source_y,
         arg_max(vehicle_x, (timestep_time, event_id)) AS destination_x,
         arg_max(vehicle_y, (timestep_time, event_id)) AS destination_y,
         min(timestep_time) AS time_start,
         arg_max(vehicle_odometer, (timestep_time, event_id)) - arg_min(vehicle_odometer, (timestep_time, event_id)) AS distance,
         max(timestep_time) - min(timestep_time) AS duration
  FROM clean GROUP BY vehicle_id)
SELECT vehicle_id, {rounded_sql("source_x, source_y, destination_x, destination_y, distance")}, time_start, duration
FROM ends WHERE duration >= 2000000 AND distance >= 20500"""


@query("trips_from_telemetry", TRIPS_FROM_TELEMETRY)
def trips_from_telemetry(spark, folder):
    clean = prep.clean_telemetry(I.telemetry(spark, folder), END)
    return rounded(T.generate_trips(clean, 2_000_000, 20_500, ["event_id"], keep=["vehicle_id"]))


@query("trips_from_clustered_telemetry", TRIPS_FROM_TELEMETRY)
def trips_from_clustered_telemetry(spark, folder):
    """The same trips from telemetry in buckets of vehicles: stored once, aggregated without a shuffle."""
    clean = prep.clean_telemetry(I.telemetry(spark, folder), END)
    path = shared_path(spark, "clustered")
    stored = clustered.write_clustered(clean, "clustered_" + path.rsplit("-", 1)[1], path, buckets=16)
    return rounded(T.generate_trips(stored, 2_000_000, 20_500, ["event_id"], keep=["vehicle_id"]))


@query("clean_telemetry", f"""WITH {CLEAN_SQL} SELECT event_id, timestep_time, {rounded_sql("vehicle_speed")} FROM clean""")
def clean_telemetry(spark, folder):
    clean = prep.clean_telemetry(I.telemetry(spark, folder), END)
    return rounded(clean.select("event_id", "timestep_time", "vehicle_speed"))


@query(
    "fill_nulls_and_hours",
    f"""WITH {I.TELEMETRY_SQL}
    SELECT event_id, CAST(floor(timestep_time / 3600) AS BIGINT) AS hour_bin,
           CASE WHEN vehicle_x < 10 THEN 0 ELSE round(vehicle_x, 6) END AS vehicle_x,
           CASE WHEN event_id % 7 = 0 THEN '0' ELSE vehicle_lane END AS vehicle_lane FROM telemetry""",
)
def fill_nulls_and_hours(spark, folder):
    holes = I.telemetry(spark, folder).withColumns(
        {
            "vehicle_x": F.when(F.col("vehicle_x") >= 10, F.col("vehicle_x")),
            "vehicle_lane": F.when(F.col("event_id") % 7 != 0, F.col("vehicle_lane")),
        }
    )
    return rounded(T.add_time_features(holes).select("event_id", "hour_bin", "vehicle_x", "vehicle_lane"))


@query(
    "one_record_per_second",
    f"""WITH {I.TELEMETRY_SQL} SELECT vehicle_id, hour, event_id, round(vehicle_x, 6) AS vehicle_x FROM (
      SELECT vehicle_id, CAST(floor(timestep_time / 3600) AS BIGINT) AS hour, event_id, vehicle_x,
             row_number() OVER (PARTITION BY vehicle_id, floor(timestep_time / 3600) ORDER BY event_id) AS rn
      FROM telemetry) WHERE rn = 1""",
)
def one_record_per_second(spark, folder):
    hourly = T.add_time_features(I.telemetry(spark, folder)).select(
        "vehicle_id", F.col("hour_bin").alias("hour"), "event_id", "vehicle_x"
    )
    return rounded(prep.drop_repeated(hourly, ["vehicle_id", "hour"], ["event_id"]))


@query(
    "edges_of_lanes",
    """SELECT event_id, regexp_replace(lane, '_[^_]*$', '') AS edge_id FROM (
      SELECT event_id, CASE event_id % 5 WHEN 0 THEN '_1' WHEN 1 THEN ':' || event_type || '_1_0'
             ELSE event_type || '_' || CAST(event_id % 3 AS VARCHAR) END AS lane FROM events)
    WHERE regexp_replace(lane, '_[^_]*$', '') <> ''""",
)
def edges_of_lanes(spark, folder):
    kind = F.col("event_id") % 5
    lane = (
        F.when(kind == 0, F.lit("_1")).when(kind == 1, F.concat(F.lit(":"), "event_type", F.lit("_1_0")))
        .otherwise(F.concat_ws("_", "event_type", (F.col("event_id") % 3).cast("string")))
    )
    lanes = table(spark, folder, "events").withColumn("vehicle_lane", lane)
    return prep.with_edges(lanes).select("event_id", "edge_id")


@query(
    "window_scan",
    f"""WITH {I.TELEMETRY_SQL} SELECT event_id, timestep_time FROM telemetry
    WHERE timestep_time >= 36000 AND timestep_time < 720000""",
)
def window_scan(spark, folder):
    start, end = (F.timestamp_seconds(F.lit(I.EPOCH + s)).cast("timestamp_ntz") for s in (36_000, 720_000))
    rows = prep.load_window(table(spark, folder, "events"), start, end, "ts")
    return rows.select("event_id", (F.floor(F.col("ts").cast("timestamp").cast("long")) - I.EPOCH).alias("timestep_time"))


@query(
    "box_filter",
    f"""WITH {I.TELEMETRY_SQL} SELECT event_id, round(vehicle_x, 6) AS vehicle_x, round(vehicle_y, 6) AS vehicle_y
    FROM telemetry WHERE vehicle_x BETWEEN 10 AND 60 AND vehicle_y BETWEEN 20 AND 80""",
)
def box_filter(spark, folder):
    rows = I.telemetry(spark, folder).select("event_id", "vehicle_x", "vehicle_y")
    return rounded(prep.in_box(rows, "vehicle_x", "vehicle_y", (10, 20), (60, 80)))


SEGMENTS_SQL = f"""{I.TELEMETRY_SQL}, marked AS (
  SELECT *, CASE WHEN timestep_time - lag(timestep_time) OVER w > {I.GAP} OR lag(timestep_time) OVER w IS NULL
                 THEN 1 ELSE 0 END AS starts
  FROM telemetry WINDOW w AS (PARTITION BY vehicle_id ORDER BY timestep_time, event_id)),
segmented AS (
  SELECT *, CAST(sum(starts) OVER (PARTITION BY vehicle_id ORDER BY timestep_time, event_id) AS BIGINT) AS trip_segment
  FROM marked)"""


@query(
    "trip_segments",
    f"""WITH {SEGMENTS_SQL} SELECT event_id, vehicle_id, trip_segment,
    vehicle_id || '_' || CAST(trip_segment AS VARCHAR) AS trip_id FROM segmented""",
)
def trip_segments(spark, folder):
    laid = T.split_at_gaps(I.telemetry(spark, folder), PAUSE, ["event_id"])
    return laid.rows().select("event_id", "vehicle_id", "trip_segment", "trip_id")


@query(
    "trip_segments_of_a_hot_key",
    """WITH t AS (
      SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '0' ELSE CAST(user_id AS VARCHAR) END AS vehicle_id,
             CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
    m AS (SELECT *, CASE WHEN s - lag(s) OVER w <= 3600 THEN 0 ELSE 1 END AS starts
      FROM t WINDOW w AS (PARTITION BY vehicle_id ORDER BY s, event_id))
    SELECT event_id, vehicle_id, CAST(sum(starts) OVER (PARTITION BY vehicle_id ORDER BY s, event_id) AS BIGINT)
           AS trip_segment FROM m""",
)
def trip_segments_of_a_hot_key(spark, folder):
    """A third of all rows under one key; a small size limit makes the chunked scan run on the test tables too."""
    e = I.telemetry(spark, folder)
    hot = e.withColumn("vehicle_id", F.when(F.col("user_id") % 3 == 0, F.lit("0")).otherwise(F.col("vehicle_id")))
    slim = hot.select("event_id", "vehicle_id", "timestep_time")
    laid = T.split_at_gaps(slim, lambda step: step > 3600, ["event_id"], group_rows=1000, chunks=16)
    return laid.rows().select("event_id", "vehicle_id", "trip_segment")


STOPPED_SQL = """stopped AS (
  SELECT *, vehicle_speed < 20 AS z,
         coalesce(lag(vehicle_speed < 20) OVER (PARTITION BY vehicle_id, trip_segment ORDER BY timestep_time, event_id),
                  false) AS before FROM segmented)"""


@query(
    "stop_counts",
    f"""WITH {SEGMENTS_SQL}, {STOPPED_SQL}
    SELECT vehicle_id, trip_segment, CAST(sum(CASE WHEN z AND NOT before THEN 1 ELSE 0 END) AS BIGINT) AS actual_stops
    FROM stopped GROUP BY 1, 2""",
)
def stop_counts(spark, folder):
    laid = T.split_at_gaps(I.telemetry(spark, folder), PAUSE, ["event_id"])
    marked = T.mark_stops(laid, F.col("vehicle_speed") < 20).rows()
    return marked.groupBy("vehicle_id", "trip_segment").agg(F.sum("stop_start").alias("actual_stops"))


@query(
    "route_edge_statistics",
    """SELECT user_id, count(event_type) AS route_num_edges, count(DISTINCT event_type) AS route_unique_edges,
       round(coalesce(count(DISTINCT event_type) / nullif(CAST(count(event_type) AS DOUBLE), 0), 1.0), 6)
         AS route_edge_reuse_ratio
    FROM events GROUP BY user_id""",
)
def route_edge_statistics(spark, folder):
    records = table(spark, folder, "events").select("user_id", F.col("event_type").alias("edge_id"))
    return rounded(T.edge_statistics(records, ["user_id"]))


STOP_TRIPS_SQL = f"""{SEGMENTS_SQL}, edged AS (
  SELECT * FROM (SELECT *, regexp_replace(vehicle_lane, '_[^_]*$', '') AS edge_id FROM segmented) WHERE edge_id <> ''),
stopped AS (
  SELECT *, vehicle_speed < 20 AS z,
         coalesce(lag(vehicle_speed < 20) OVER (PARTITION BY vehicle_id, trip_segment ORDER BY timestep_time, event_id),
                  false) AS before FROM edged),
stop_trips AS (
  SELECT vehicle_id || '_' || CAST(trip_segment AS VARCHAR) AS trip_id, vehicle_id,
         arg_min(vehicle_x, (timestep_time, event_id)) AS trip_start_x,
         arg_min(vehicle_y, (timestep_time, event_id)) AS trip_start_y,
         arg_max(vehicle_x, (timestep_time, event_id)) AS trip_end_x,
         arg_max(vehicle_y, (timestep_time, event_id)) AS trip_end_y,
         arg_max(vehicle_odometer, (timestep_time, event_id)) - arg_min(vehicle_odometer, (timestep_time, event_id))
           AS actual_distance,
         max(timestep_time) - min(timestep_time) AS dur, count(*) AS n,
         CAST(sum(CASE WHEN z AND NOT before THEN 1 ELSE 0 END) AS BIGINT) AS actual_stops,
         CAST((min(timestep_time) // 3600) % 24 AS INT) AS hour_of_day, min(timestep_time) AS timestep,
         count(edge_id) AS route_num_edges, count(DISTINCT edge_id) AS route_unique_edges
  FROM stopped GROUP BY vehicle_id, trip_segment)"""


@query(
    "stop_trips",
    f"""WITH {STOP_TRIPS_SQL}
    SELECT trip_id, vehicle_id, {rounded_sql("trip_start_x, trip_start_y, trip_end_x, trip_end_y, actual_distance")},
           round(sqrt((trip_end_x - trip_start_x) ** 2 + (trip_end_y - trip_start_y) ** 2), 6) AS straight_distance,
           actual_stops, hour_of_day, timestep, route_num_edges, route_unique_edges,
           round(route_unique_edges / CAST(route_num_edges AS DOUBLE), 6) AS route_edge_reuse_ratio
    FROM stop_trips WHERE n >= 2 AND dur > 60 AND actual_distance > 5""",
)
def stop_trips(spark, folder):
    return rounded(
        T.extract_stop_trips(
            I.telemetry(spark, folder), 2, 60, 5, is_break=PAUSE, stopped=F.col("vehicle_speed") < 20,
            tiebreak=["event_id"],
        )
    )


SINGLE_SQL = f"""{I.TELEMETRY_SQL}, single AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, timestep_time ORDER BY event_id) AS rn
                 FROM telemetry) WHERE rn = 1)"""


@query(
    "records_of_long_trips",
    f"""WITH {SINGLE_SQL} SELECT event_id, vehicle_id, timestep_time FROM single
    WHERE vehicle_id IN (SELECT vehicle_id FROM single GROUP BY 1 HAVING count(*) >= 65)""",
)
def records_of_long_trips(spark, folder):
    kept = T.create_trips_simple(I.telemetry(spark, folder), 65, ["event_id"])
    return kept.select("event_id", "vehicle_id", "timestep_time")


FUEL_SQL = f"""{SINGLE_SQL}, fuel AS (
  SELECT vehicle_id, min(timestep_time) AS timestep_time_min,
         arg_min(vehicle_x, timestep_time) AS vehicle_x_first, arg_max(vehicle_x, timestep_time) AS vehicle_x_last,
         arg_min(vehicle_y, timestep_time) AS vehicle_y_first, arg_max(vehicle_y, timestep_time) AS vehicle_y_last,
         ln(1 + sum(vehicle_fuel)) AS vehicle_fuel_log_sum,
         max(vehicle_odometer) - min(vehicle_odometer) AS trip_actual_distance,
         CAST((min(timestep_time) // 3600) % 24 AS INT) AS start_hour,
         sqrt((arg_max(vehicle_x, timestep_time) - arg_min(vehicle_x, timestep_time)) ** 2
            + (arg_max(vehicle_y, timestep_time) - arg_min(vehicle_y, timestep_time)) ** 2) AS straight_line_distance,
         sqrt((max(vehicle_x) - min(vehicle_x)) ** 2 + (max(vehicle_y) - min(vehicle_y)) ** 2) AS spatial_extent
  FROM single GROUP BY vehicle_id HAVING count(*) >= 30)"""


@query(
    "fuel_trips",
    f"""WITH {FUEL_SQL} SELECT vehicle_id, timestep_time_min, start_hour,
    {rounded_sql("vehicle_x_first, vehicle_x_last, vehicle_y_first, vehicle_y_last, vehicle_fuel_log_sum, trip_actual_distance, straight_line_distance, spatial_extent")}
    FROM fuel""",
)
def fuel_trips(spark, folder):
    return rounded(T.fuel_trips(I.telemetry(spark, folder), 30, ["event_id"]))


@query(
    "telemetry_per_hour",
    f"""WITH {I.TELEMETRY_SQL} SELECT CAST(floor(timestep_time / 3600) AS BIGINT) AS hour,
    round(avg(vehicle_speed), 6) AS average_speed, count(DISTINCT vehicle_id) AS vehicle_count
    FROM telemetry GROUP BY 1""",
)
def telemetry_per_hour(spark, folder):
    return rounded(stats.telemetry_per_hour(I.telemetry(spark, folder)))


@query(
    "sketched_days",
    f"""WITH {I.TELEMETRY_SQL} SELECT timestep_time // 86400 AS day, count(*) AS n, count(DISTINCT vehicle_id) AS n_vehicles,
    true AS vehicles_within, true AS median_within, true AS ninth_decile_within FROM telemetry GROUP BY 1""",
)
def sketched_days(spark, folder):
    """Sketches of every hour, stored and merged per day; estimates beside exact counts and ranks, within four standard errors."""
    rows = I.telemetry(spark, folder).select("timestep_time", "vehicle_id", "vehicle_speed")
    stored = stage(sketches.sketches(rows, [C.hour_of("timestep_time").alias("hour")], "vehicle_id", "vehicle_speed"), "sketches")
    found = sketches.estimates(sketches.merged(stored, [F.floor(F.col("hour") / 24).alias("day")]), [0.5, 0.9])
    days = rows.withColumn("day", F.floor(F.col("timestep_time") / 86_400))
    shares = days.join(F.broadcast(stage(found, "estimates")), "day").groupBy("day", "n", "n_distinct").agg(  # a row a day
        F.count_distinct("vehicle_id").alias("n_vehicles"),
        *[F.avg(F.expr(f"CAST(vehicle_speed {op} {q} AS INT)")).alias(f"{q}_{name}") for q in ("q0", "q1") for op, name in (("<", "below"), ("<=", "up_to"))],
    )
    spread = 4 * sketches.DISTINCT_ERROR * F.col("n_vehicles")

    def within(q, p):
        return (F.col(f"{q}_below") <= p + 4 * sketches.RANK_ERROR) & (F.col(f"{q}_up_to") >= p - 4 * sketches.RANK_ERROR)

    return shares.select(
        "day", "n", "n_vehicles", (F.abs(F.col("n_distinct") - F.col("n_vehicles")) <= spread).alias("vehicles_within"),
        within("q0", 0.5).alias("median_within"), within("q1", 0.9).alias("ninth_decile_within"),
    )


@query(
    "telemetry_statistics",
    f"""WITH {I.TELEMETRY_SQL} SELECT count(DISTINCT vehicle_id) AS unique_vehicles,
    round((SELECT avg(m) FROM (SELECT max(vehicle_odometer) AS m FROM telemetry GROUP BY vehicle_id)), 6)
      AS average_trip_distance, round(avg(vehicle_speed), 6) AS average_speed FROM telemetry""",
)
def telemetry_statistics(spark, folder):
    return rounded(stats.telemetry_statistics(I.telemetry(spark, folder)))


SUB_KEY = "user_id * 1000003 + draw"


@query(
    "full_and_sub_trips",
    f"""WITH {I.TELEMETRY_SQL}, indexed AS (
      SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY timestep_time, event_id) - 1 AS pos,
             count(*) OVER (PARTITION BY vehicle_id) AS n FROM telemetry),
    draws AS (
      SELECT vehicle_id, user_id, n, pos + r * n AS draw, greatest(2, CAST(floor(n * 0.5) AS BIGINT)) AS least_n
      FROM indexed, (SELECT unnest([0, 1]) AS r) WHERE pos + r * n < floor(n * 1.5)),
    firsts AS (
      SELECT *, {C.mixed_hash_sql(SUB_KEY, 42)} % (n - least_n + 1) AS i
      FROM draws WHERE n >= least_n),
    cuts AS (
      SELECT vehicle_id, i, i + least_n + ({C.mixed_hash_sql(SUB_KEY, 43)}
             % (n - i - least_n + 1)) - 1 AS j FROM firsts),
    subs AS (
      SELECT a.vehicle_x AS source_x, a.vehicle_y AS source_y, b.vehicle_x AS destination_x,
             b.vehicle_y AS destination_y, a.timestep_time AS time_start,
             b.vehicle_odometer - a.vehicle_odometer AS distance, b.timestep_time - a.timestep_time AS duration
      FROM cuts c JOIN indexed a ON a.vehicle_id = c.vehicle_id AND a.pos = c.i
                  JOIN indexed b ON b.vehicle_id = c.vehicle_id AND b.pos = c.j),
    whole AS (
      SELECT arg_min(vehicle_x, (timestep_time, event_id)) AS source_x,
             arg_min(vehicle_y, (timestep_time, event_id)) AS source_y,
             arg_max(vehicle_x, (timestep_time, event_id)) AS destination_x,
             arg_max(vehicle_y, (timestep_time, event_id)) AS destination_y, min(timestep_time) AS time_start,
             max(vehicle_odometer) - min(vehicle_odometer) AS distance,
             max(timestep_time) - min(timestep_time) AS duration FROM telemetry GROUP BY vehicle_id)
    SELECT {rounded_sql("source_x, source_y, destination_x, destination_y, distance")}, time_start, duration
    FROM (SELECT * FROM whole UNION ALL SELECT * FROM subs) WHERE duration >= 30 AND distance >= 200""",
)
def full_and_sub_trips(spark, folder):
    full = T.generate_full_trips(
        I.telemetry(spark, folder), rate=1.5, seed=42, seed_column="user_id", tiebreak=["event_id"]
    )
    return rounded(full)


@query(
    "csv_round_trip",
    f"""WITH {I.TELEMETRY_SQL} SELECT vehicle_id, timestep_time, vehicle_lane,
    {rounded_sql("vehicle_speed, vehicle_x, vehicle_y, vehicle_odometer, vehicle_fuel")} FROM telemetry""",
)
def csv_round_trip(spark, folder):
    """Telemetry to semicolon text, back by declared types, and on to Parquet by hour."""
    rows = I.telemetry(spark, folder).withColumn("vehicle_waiting", F.lit(0.0)).select(*src.TELEMETRY.names)
    text, columnar = shared_path(spark, "csv"), shared_path(spark, "hourly")
    rows.write.option("sep", ";").option("header", True).csv(text)
    back = src.convert_csv_to_parquet(spark, text, columnar, 86_400)
    return rounded(
        back.select(
            F.col("vehicle_id").cast("string"), "timestep_time", "vehicle_lane", "vehicle_speed", "vehicle_x",
            "vehicle_y", "vehicle_odometer", "vehicle_fuel",
        )
    )


@query(
    "pruned_window",
    f"""WITH {I.TELEMETRY_SQL} SELECT vehicle_id, timestep_time FROM telemetry
    WHERE timestep_time >= 5000 AND timestep_time < 400000""",
)
def pruned_window(spark, folder):
    path = shared_path(spark, "by-day")
    src.write_telemetry(I.telemetry(spark, folder).select("vehicle_id", "timestep_time"), path, 86_400)
    return src.read_window(spark, path, 5_000, 400_000, folder_seconds=86_400).select("vehicle_id", "timestep_time")


@query(
    "row_positions",
    f"""WITH {I.ERRORS_SQL} SELECT task, seq, row_number() OVER (PARTITION BY task ORDER BY ts, seq) AS position
    FROM errors""",
)
def row_positions(spark, folder):
    rows = I.errors(spark, folder).select("task", "ts", "seq")
    laid = OrderedRows.lay_out(rows, ["task"], ["ts", "seq"]).numbered("position")
    return laid.rows().select("task", "seq", "position")
