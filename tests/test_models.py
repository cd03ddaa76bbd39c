"""Models: warm start, cross-validation without leaks, importances, tuning, registry."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import models as M, tuning
from fleetlens.sources import results as R
from fleetlens.sources.registry import ModelRegistry, version_in_force


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    a, b = rng.uniform(0, 10, 600), rng.uniform(0, 10, 600)
    y = np.where(a > 5, 30.0, 10.0) + 2 * b
    data = [(i, float(p), float(q), 1.0, float(t)) for i, (p, q, t) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, y double").cache()


def test_unknown_model_names_the_known_ones():
    with pytest.raises(ValueError, match="linear, xgboost"):
        M.create_model("x", ["a"], "y")


def test_tree_budget():
    assert M.new_trees(1100, 6755, 53_229) == 69
    assert M.new_trees(100, 10, 53_229) == 10


def test_warm_start_improves_on_shifted_data(rows):
    base = M.create_model("xgboost", ["a", "b"], "y", maxIter=5, maxDepth=3).fit(rows)
    shifted = rows.withColumn("y", F.col("y") + 25)
    model = M.retrain(base, "xgboost", shifted, "y", 600, maxDepth=3)
    assert model.n_new_trees == 10
    error = lambda m: M.evaluate(M.predict(m, shifted), "y", "prediction").first()["mae"]
    assert error(model) < error(base) / 3
    with pytest.raises(ValueError):
        M.retrain(base, "xgboost", rows.where("a < 0"), "y", 600)


def test_folds_are_prepared_on_their_training_part(rows):
    seen = []

    def prepare(learn):
        seen.append({r["id"] for r in learn.select("id").collect()})
        return lambda part: part

    folded = rows.withColumn("fold", (F.col("id") % 3).cast("int"))
    scores, _ = M.cross_validate(folded, ["linear"], "y", "run", prepare, ["a", "b"])
    assert scores.count() == 3 and [len(s) for s in seen] == [400] * 3
    assert all({i % 3 for i in s} == {0, 1, 2} - {k} for k, s in enumerate(seen))


def test_permutation_importance_ranks_and_ignores_constants(rows):
    model = M.create_model("linear", ["a", "b", "c"], "y").fit(rows)
    for limit in (10**6, 100):
        got = {r["feature"]: r["importance"] for r in M.permutation_importance(
            model, rows, "y", ["a", "b", "c"], ["id"], repeats=4, group_rows=limit).collect()}
        assert abs(got["c"]) < 1e-9 and got["a"] > 1 and got["b"] > 1


def test_linear_shap_is_exact(rows):
    model = M.create_model("linear", ["a", "b"], "y").fit(rows)
    beta, frame = model.stages[-1].coefficients.toArray(), rows.toPandas()
    got = {r["feature"]: r["importance"] for r in M.linear_shap(model, rows).collect()}
    for f, w in zip(("a", "b"), beta):
        assert abs(got[f] - np.abs(w * (frame[f] - frame[f].mean())).mean()) < 1e-9


def shapley(paths, x, n):
    """Shapley values straight from the definition, over all subsets."""
    def value(known):
        return sum(
            leaf * math.prod((lo < x[f] <= hi) if f in known else z for f, lo, hi, z in conditions)
            for leaf, conditions in paths
        )

    result = []
    for f in range(n):
        others = [g for g in range(n) if g != f]
        result.append(sum(
            math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (value({*s, f}) - value(set(s)))
            for k in range(n) for s in itertools.combinations(others, k)
        ))
    return result


def test_tree_shap_matches_the_definition(rows):
    features = ["a", "b", "c", "id"]
    model = M.create_model("xgboost", features, "y", maxIter=3, maxDepth=4).fit(rows.withColumn("id", F.col("id").cast("double")))
    paths = M.ensemble_paths(model.stages[-1])
    x = rows.select(*features).limit(20).toPandas().to_numpy(dtype=float)
    got = M.path_shap(paths, x)
    for i, row in enumerate(x):
        assert np.allclose(got[i], shapley(paths, row, 4))
    scored = model.transform(rows.limit(20)).toPandas()["prediction"].to_numpy()
    base = sum(leaf * math.prod(z for *_, z in c) for leaf, c in paths)
    assert np.allclose(got.sum(axis=1) + base, scored)


def test_tree_shap_over_partitions(rows):
    model = M.create_model("tree", ["a", "b"], "y", maxDepth=3).fit(rows)
    x = rows.toPandas()[["a", "b"]].to_numpy()
    want = np.abs(M.path_shap(M.ensemble_paths(model.stages[-1]), x)).mean(axis=0)
    got = {r["feature"]: r["importance"] for r in M.tree_shap(model, rows.repartition(5)).collect()}
    assert np.allclose([got["a"], got["b"]], want)


def test_drawn_trials_stay_in_their_ranges(spark):
    for space in (*tuning.BROAD.values(), *tuning.FOCUSED.values()):
        drawn = tuning.draw_trials(spark.range(200).withColumnRenamed("id", "trial_number"), space).toPandas()
        for name, spec in space.items():
            if isinstance(spec, list):
                assert set(drawn[name]) <= set(map(float, spec))
                continue
            assert drawn[name].min() >= spec[0] - 1e-12 and drawn[name].max() <= spec[1] + 1e-9
            if spec[2].startswith("int"):
                step = int(spec[2][4:] or 1) if ":" in spec[2] else 1
                assert ((drawn[name] - spec[0]) % step == 0).all() and drawn[name].nunique() > 2
        if "num_leaves" in space:
            top = np.maximum(space["num_leaves"][0], np.minimum(space["num_leaves"][1], 2 ** drawn["max_depth"]))
            assert (drawn["num_leaves"] <= top).all()


def test_failed_trials_are_recorded(spark):
    trials = tuning.draw_trials(spark.range(4).withColumnRenamed("id", "trial_number"), {"max_depth": (1, 4, "int")})

    def objective(drawn):
        if drawn["max_depth"] >= 3:
            raise RuntimeError("no")
        return {"mae": drawn["max_depth"]}

    states = {r["state"] for r in tuning.run_search(trials, objective).collect()}
    assert "COMPLETE" in states or "FAIL" in states


def test_registry_versions(spark, rows, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path), "eta")
    assert registry.get_next_version() == "v1" and registry.load("v1") is None
    model = M.create_model("linear", ["a", "b"], "y").fit(rows)
    registry.save(model, "v1", {"model": "linear"})
    registry.save(model, "v9", {"model": "linear"})
    (tmp_path / "eta" / "vault").mkdir()
    assert registry.versions() == ["v1", "v9"] and registry.get_next_version() == "v10"
    loaded, metadata = registry.load("v9")
    assert metadata["ml_task"] == "eta" and M.predict(loaded, rows).count() == 600


def test_version_in_force_before_at_and_after(spark):
    points = spark.createDataFrame([("t", i, i) for i in range(6)] + [("u", 3, 0)], "task string, at long, id long")
    versions = spark.createDataFrame([("t", 2, "v1"), ("t", 4, "v2")], "task string, valid_from long, version string")
    want = {0: None, 1: None, 2: "v1", 3: "v1", 4: "v2", 5: "v2"}
    for most in (100, 1):
        got = version_in_force(points, versions, "at", ("id",), most).collect()
        assert {r["at"]: r["version"] for r in got if r["task"] == "t"} == want
        assert [r["version"] for r in got if r["task"] == "u"] == [None]


def test_results_written_by_hand_are_read(spark, tmp_path):
    one = '{"training_time": 1.0, "prediction_time": 2.0, "evaluation_time": 3.0, "mae": %s, "mape": 0.5%s}'
    fold = one % (7.0, "")
    for run, text in (
        ("features_all", '{"LGBM": %s, "Linear": %s}' % (one % (2.0, f', "per_fold": [{fold}, {fold}]'), one % (4.0, ""))),
        ("baseline", '{"Linear": %s}' % (one % (9.0, ""))),
    ):
        (tmp_path / run / "results").mkdir(parents=True)
        (tmp_path / run / "results" / "results.json").write_text(text)
    (tmp_path / "empty_run").mkdir()
    got = [tuple(r)[:2] + (r["mae"],) for r in R.load_all_results(spark, str(tmp_path)).collect()]
    assert got == [("baseline", "Linear", 9.0), ("features_all", "LGBM", 2.0), ("features_all", "Linear", 4.0)]
    assert R.load_all_results(spark, str(tmp_path / "empty_run")).count() == 0


def test_tuning_results_keep_finished_trials(spark, tmp_path):
    (tmp_path / "tuning_x" / "results").mkdir(parents=True)
    (tmp_path / "tuning_x" / "results" / "tuning_results.json").write_text(
        '{"best_trial": 0, "best_value": 3.5, "study_name": "s", "model": "XGB", "n_trials": 2, "trials": ['
        '{"number": 0, "value": 3.5, "state": "COMPLETE", "params": {"max_depth": 4, "eta": 0.1}, "user_attrs": {"mape": 0.2}},'
        '{"number": 1, "value": null, "state": "FAIL", "params": {"max_depth": 5, "eta": 0.2}, "user_attrs": {}}]}'
    )
    got = R.spread_parameters(R.load_all_tuning_results(spark, str(tmp_path)), ["max_depth", "eta"]).collect()
    assert [(r["experiment"], r["model"], r["mae"], r["mape"], r["max_depth"], r["eta"]) for r in got] == [
        ("tuning_x", "XGB", 3.5, 0.2, 4.0, 0.1)]


def test_importance_files_without_the_columns_are_skipped(spark, tmp_path):
    for run, text in (
        ("features_selection_gain", "model,feature,importance_mean,percentage_mean\nm,a,1.5,60\n"),
        ("features_selection_ranking", "feature,final_score,final_rank,final_scaled,normalized_rank,category\na,0.9,1,1,0,cell\n"),
        ("other", "model,feature,importance_mean,percentage_mean\nm,b,1,1\n"),
    ):
        (tmp_path / run / "results").mkdir(parents=True)
        (tmp_path / run / "results" / "feature_selection_results.csv").write_text(text)
    got = R.load_feature_selection_results(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("features_selection_gain", "m", "a", 1.5, 60.0)]
    assert R.load_feature_ranking_results(spark, str(tmp_path)).first()["category"] == "cell"
    assert R.load_feature_ranking_results(spark, str(tmp_path / "none")).count() == 0


def test_warm_started_models_are_registered_and_continued(spark, rows, tmp_path):
    base = M.create_model("xgboost", ["a", "b"], "y", maxIter=4, maxDepth=3).fit(rows)
    first = M.retrain(base, "xgboost", rows.withColumn("y", F.col("y") + 10), "y", 600, maxDepth=2)
    registry = ModelRegistry(spark, str(tmp_path), "eta")
    registry.save(first, "v2", {"model": "xgboost"})
    loaded, metadata = registry.load("v2")
    assert metadata["n_estimators"] == 10 and M.tree_count(loaded) == 14
    same = lambda m: [r["prediction"] for r in M.predict(m, rows).orderBy("id").collect()]
    assert np.allclose(same(loaded), same(first))
    second = M.retrain(loaded, "xgboost", rows, "y", 600, maxDepth=2)
    assert M.tree_count(second) == 24 and M.model_features(second) == ["a", "b"]


def test_serving_scores_and_retrains_each_task_on_its_own(spark, tmp_path):
    from fleetlens.streaming.serving import ModelServing

    data = [(t, ts, i, float(i % 7), (i % 7) * k + (40.0 if ts >= 50 else 0.0))
            for t, k in (("a", 2.0), ("b", 5.0)) for i, ts in enumerate(range(100))]
    trips = spark.createDataFrame(data, "task string, ts long, seq long, x double, y double").cache()
    serving = ModelServing(spark, str(tmp_path), trips, ["a", "b"], ["x"], "y")
    versions = serving.start(50)
    mae = lambda v, t: serving.score(trips.where("ts >= 50"), v).where(F.col("task") == t).agg(F.avg("error")).first()[0]
    assert versions == {"a": "v1", "b": "v1"} and mae(versions, "a") > 30
    assert serving.retrain("a", 50, 80) == "v2"
    assert mae(serving.versions, "a") < 1e-6 and mae(serving.versions, "b") > 30
    with pytest.raises(ValueError):
        serving.retrain("b", 500, 600)
