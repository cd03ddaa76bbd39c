"""Clustered storage spares shuffles, crowded seconds are split, sketches merge within their bounds."""

from pyspark.sql import functions as F

from fleetlens.operators import sketches
from fleetlens.operators.trips import generate_trips, split_at_gaps
from fleetlens.sources import clustered, telemetry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trips_of_clustered_telemetry_need_no_exchange(spark, tmp_path):
    rows = spark.range(4000).select(
        (F.col("id") % 37).cast("string").alias("vehicle_id"), F.col("id").alias("timestep_time"), F.rand(3).alias("vehicle_x"),
        F.rand(4).alias("vehicle_y"), F.col("id").cast("double").alias("vehicle_odometer"),
    )
    path = str(tmp_path / "plain")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    stored = clustered.write_clustered(rows, "clustered_test", str(tmp_path / "clustered"), buckets=8)
    try:
        trips, segments = generate_trips(stored), split_at_gaps(stored, lambda step: step > 37).rows()
        assert "Exchange" not in plan(trips) and "Exchange" not in plan(segments)
        assert "Exchange" in plan(generate_trips(rows))
        assert sorted(trips.collect()) == sorted(generate_trips(rows).collect())
        files = stored.select(F.input_file_name()).distinct().count()
        assert files <= 8  # one file a bucket
        assert clustered.write_clustered(rows.limit(0), "clustered_empty", str(tmp_path / "empty"), buckets=8).count() == 0
    finally:
        for name in ("clustered_test", "clustered_empty"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_one_crowded_second_is_many_ranges(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 100 < 95, 7).otherwise(F.col("id")).alias("time_start"))
    path = str(tmp_path / "trips")
    usual = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one file in any case
    try:
        telemetry.write_trips(rows, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", usual)
    sizes = [r[1] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 20_000 * 0.6
    assert spark.read.parquet(path).count() == 20_000


def test_merged_sketches_stay_within_their_bounds(spark):
    rows = spark.range(200_000).select(
        (F.col("id") % 24).alias("hour"), (F.col("id") * 7 % 50_000).alias("who"),
        F.when(F.col("id") % 10 > 0, F.col("id") % 1000 / 10).alias("value"),
    )
    whole = sketches.merged(sketches.sketches(rows, ["hour"], "who", "value"))
    found = sketches.estimates(whole, [0.0, 0.25, 0.5, 1.0]).first()
    assert found["n"] == 200_000
    exact = rows.agg(F.count_distinct("who")).first()[0]
    assert abs(found["n_distinct"] - exact) <= 4 * sketches.DISTINCT_ERROR * exact
    for name, p in (("q0", 0.0), ("q1", 0.25), ("q2", 0.5), ("q3", 1.0)):
        held = rows.where("value IS NOT NULL").agg(F.avg((F.col("value") < found[name]).cast("int")), F.avg((F.col("value") <= found[name]).cast("int"))).first()
        assert held[0] - 4 * sketches.RANK_ERROR <= p <= held[1] + 4 * sketches.RANK_ERROR


def test_sketches_of_nulls_and_of_nothing(spark):
    schema = "hour long, who string, value double"
    nulls = spark.createDataFrame([(1, None, None), (1, None, None), (2, "a", 3.0)], schema)
    stored = sketches.sketches(nulls, ["hour"], "who", "value")
    found = {r["hour"]: r for r in sketches.estimates(stored, [0.5]).collect()}
    assert (found[1]["n"], found[1]["n_distinct"], found[1]["q0"]) == (2, 0, None)
    assert (found[2]["n"], found[2]["n_distinct"], found[2]["q0"]) == (1, 1, 3.0)
    whole = sketches.estimates(sketches.merged(stored), [0.5]).first()
    assert (whole["n"], whole["n_distinct"], whole["q0"]) == (3, 1, 3.0)
    assert sketches.sketches(nulls.limit(0), ["hour"], "who", "value").count() == 0
