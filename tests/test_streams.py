"""Models as rows beside Spark's own predictions, version swaps, late rows, trips in a stream."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators.models import create_model, predict, retrain
from fleetlens.sources.registry import ModelRegistry
from fleetlens.streaming import model_table as M, scoring as R
from fleetlens.streaming.trips import trip_stream

KINDS = {"linear": {}, "xgboost": {"maxIter": 4, "maxDepth": 4}, "forest": {"numTrees": 3, "maxDepth": 4}, "tree": {}}


@pytest.fixture(scope="module")
def rows(spark):
    base = spark.range(600).select(F.col("id").alias("seq"), (F.rand(1) * 10).alias("a"), F.rand(2).alias("b"))
    made = base.withColumns({"y": F.col("a") * F.col("b") + F.sin("a"), "ts": F.col("seq") * 60})
    return spark.createDataFrame(made.collect(), made.schema)


@pytest.fixture(scope="module")
def saved(spark, rows, tmp_path_factory):
    """Registered models of all kinds and a continued one: their parts, and Spark's own predictions by (task, seq)."""
    root, parts, want = str(tmp_path_factory.mktemp("models")), None, {}
    models = {k: create_model(k, ["a", "b"], "y", **p).fit(rows) for k, p in KINDS.items()}
    models["continued"] = retrain(models["xgboost"], "xgboost", rows.where("seq < 300"), "y", 600, maxDepth=3)
    for task, model in models.items():
        registry = ModelRegistry(spark, root, task)
        registry.save(model, "v1", {})
        part = M.saved_parts(spark, f"{root}/{task}/v1", task, "v1")
        parts = part if parts is None else parts.unionByName(part)
        want.update({(task, r["seq"]): r["prediction"] for r in predict(model, rows).collect()})
    return parts, want


@pytest.mark.parametrize("limits", [{}, {"most_bytes": 0, "group_rows": 50}])
def test_parts_predict_what_spark_predicts(spark, rows, saved, limits):
    parts, want = saved
    tasks = spark.createDataFrame([(t, "v1") for t in [*KINDS, "continued"]], "task string, version string")
    marked = rows.crossJoin(F.broadcast(tasks)).withColumn("features", F.array("a", "b"))
    got = {(r["task"], r["seq"]): r["prediction"] for r in M.score_by_version(marked, parts, **limits).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


@pytest.mark.parametrize("limits", [{}, {"most_bytes": 0, "group_rows": 2}])
def test_odd_rows_have_no_prediction_and_keep_their_columns(spark, saved, limits):
    parts, _ = saved
    nan = float("nan")
    odd = [
        ("linear", "v1", 1, [1.0, 0.5], "kept"), ("linear", "v1", 1, [1.0, 0.5], "kept"), ("linear", "v1", 2, [nan, 0.5], "x"),
        ("linear", "v1", 3, [None, 0.5], "x"), ("linear", "v1", 4, [1.0], None), ("linear", "v1", 5, None, "x"),
        ("linear", "v9", 6, [1.0, 0.5], "x"), ("linear", None, 7, [1.0, 0.5], "x"), (None, "v1", 8, [1.0, 0.5], "x"),
        ("linear", "v1", None, [1.0, 0.5], "kept"), ("tree", "v1", 9, [1.0, 0.5, 2.0], "x"),
    ]
    schema = "task string, version string, seq long, features array<double>, part string"
    scored = M.score_by_version(spark.createDataFrame(odd, schema), parts.unionByName(parts), **limits)
    assert scored.columns == ["task", "version", "seq", "features", "part", "prediction"]
    found = scored.collect()
    assert len(found) == len(odd)
    assert {r["seq"] for r in found if r["prediction"] is not None} == {1, None}
    assert sum(r["part"] == "kept" for r in found) == 3
    assert len({r["prediction"] for r in found if r["part"] == "kept"}) == 1
    assert M.score_by_version(spark.createDataFrame([], schema), parts, **limits).count() == 0
    with pytest.raises(ValueError):
        M.score_by_version(scored, parts)


def test_a_thousand_tasks_are_one_scan(spark, tmp_path):
    n = 1000
    made = spark.range(n * 6).select(
        F.concat(F.lit("t"), (F.col("id") % n).cast("string")).alias("task"), F.floor(F.col("id") / n).alias("ts"), F.col("id").alias("seq"),
    ).withColumn("x", F.col("ts") * 1.5).withColumn("y", F.col("x") * (F.col("seq") % n) + 3)
    path = str(tmp_path / "rows")
    made.write.parquet(path)
    rows = spark.read.parquet(path)
    spans = spark.range(n).select(
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("task"), F.lit("v1").alias("version"), F.lit(0).alias("start"), F.lit(6).alias("end")
    )
    parts = M.fit_linear_models(rows, spans, ["x"], "y")
    scored = M.score_by_version(rows.withColumn("version", F.lit("v1")).withColumn("features", F.array("x")), parts)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan
    assert scored.where("prediction IS NULL OR abs(prediction - y) > 1e-6").count() == 0


def test_fits_with_dependent_features_nulls_and_empty_spans(spark):
    data = [("a", i, float(i), 2.0 * i, 3.0 * i + 1) for i in range(10)] + [("a", 3, None, 1.0, 9e9), ("b", 1, 1.0, 1.0, None)]
    rows = spark.createDataFrame(data, "task string, ts long, p double, q double, y double")
    spans = spark.createDataFrame([("a", "v1", 0, 10), ("a", "v2", 50, 60), ("b", "v1", 0, 10)], "task string, version string, start long, `end` long")
    found = M.fit_linear_models(rows, spans, ["p", "q"], "y").collect()
    assert [(r["task"], r["version"]) for r in found] == [("a", "v1")]
    beta = found[0]["coefficients"]
    assert math.isclose(beta[0] + 2 * beta[1], 3.0, rel_tol=1e-9) and math.isclose(found[0]["intercept"], 1.0, abs_tol=1e-9)


def _constant(spark, task, version, value):
    rows = spark.createDataFrame([(task, t, 1.0 * t, value) for t in range(3)], "task string, ts long, x double, y double")
    spans = spark.createDataFrame([(task, version, 0, 9)], "task string, version string, start long, `end` long")
    return M.fit_linear_models(rows, spans, ["x"], "y")


def test_a_version_takes_over_amid_a_batch_and_a_finished_batch_stays(spark, tmp_path):
    folder, inbox, sink, progress = (str(tmp_path / n) for n in ("published", "inbox", "sink", "progress"))
    line = lambda *rows: spark.createDataFrame(rows, R.VERSIONS)
    R.publish(_constant(spark, "a", "v1", 1.0), line(("a", 0, "v1")), folder)
    schema = "task string, ts long, seq long, features array<double>"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        R.scored_stream(stream, folder, sink, progress, trigger={"availableNow": True}).awaitTermination()

    arrive(("a", 5, 0, [1.0]), ("a", 15, 1, [1.0]), ("b", 5, 2, [1.0]))
    R.publish(_constant(spark, "a", "v2", 2.0), line(("a", 10, "v2")), folder)
    arrive(("a", 9, 3, [1.0]), ("a", 10, 4, [1.0]), ("a", 11, 5, [1.0]))
    out = {r["seq"]: (r["version"], r["prediction"]) for r in spark.read.parquet(sink).collect()}
    assert {k: v[0] for k, v in out.items()} == {0: "v1", 1: "v1", 2: None, 3: "v1", 4: "v2", 5: "v2"}
    assert out[2][1] is None and np.allclose([out[k][1] for k in (0, 1, 3, 4, 5)], [1, 1, 1, 2, 2])


def test_streamed_and_late_rows_are_all_rows(spark, tmp_path):
    watch = R.LateRows(spark, str(tmp_path / "state"), 100, 50)
    schema = "task string, ts long, seq long, error double"
    batches = [
        [("a", 10, 0, 1.0), ("a", 240, 1, 3.0), (None, 5, 2, 1.0), ("a", None, 3, 1.0)],
        [("a", 90, 4, 5.0), ("a", 120, 5, 7.0), ("a", 230, 6, None), ("b", 1000, 7, 2.0)],  # mark 190: only windows up to 100 are closed
        [("a", 240, 8, 9.0), ("b", 960, 9, 4.0), ("b", 960, 9, 4.0)],  # mark 950
    ]
    inbox, progress = str(tmp_path / "inbox"), str(tmp_path / "progress")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        watch.start(spark.readStream.schema(schema).parquet(inbox), progress, {"availableNow": True}).awaitTermination()
    late = {r["seq"] for r in watch.late_rows(schema).collect()}
    assert late == {2, 3, 4, 8}
    before = {tuple(r) for r in watch.metrics().collect()}
    assert before == {
        ("a", 100, 1.0, 1, 1), ("a", 200, 7.0, 1, 0), ("a", 300, 3.0, 2, 1), ("b", 1000, 4.0, 2, 0), ("b", 1100, 2.0, 1, 0),
        (None, None, None, 0, 1), ("a", None, None, 0, 1),
    }
    assert sum(n + m for *_, n, m in before) == sum(map(len, batches))
    watch.write_batch(spark.createDataFrame(batches[1], schema), 1)  # run again
    assert {tuple(r) for r in watch.metrics().collect()} == before


def test_late_records_join_two_sessions_into_one_trip(spark, tmp_path):
    schema = "vehicle_id string, timestep_time long, vehicle_x double, vehicle_y double, vehicle_odometer double"
    record = lambda v, t: (v, t, float(t), 0.0, t / 2)
    slices = [
        [record("a", 0), record("a", 100), record("b", 0), (None, 7, 0.0, 0.0, 0.0)],
        [record("a", 280), record("b", 101), ("a", None, 0.0, 0.0, 0.0)],
        [record("a", 190)],  # between 100 and 280: both are within the pause of 100
        [record("z", 100_000)],
    ]
    inbox, sink, progress = (str(tmp_path / n) for n in ("inbox", "sink", "progress"))
    from fleetlens.streaming import lifecycle as L

    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        trips = trip_stream(spark.readStream.schema(schema).parquet(inbox), 100, "500 seconds")
        with L.state_partitions(spark, 2):
            L.append_sink(trips, sink, progress, trigger={"availableNow": True}).awaitTermination()
    wanted = {("a", 0, 280, 140.0, 4), ("b", 0, 0, 0.0, 1), ("b", 101, 101, 0.0, 1)}
    columns = ["vehicle_id", "time_start", "time_end", "distance", "n_records"]
    assert {tuple(r) for r in spark.read.parquet(sink).select(columns).collect()} == wanted
    whole = spark.createDataFrame([r for s in slices[:3] for r in s], schema)
    assert {tuple(r) for r in trip_stream(whole, 100).select(columns).collect()} == wanted
