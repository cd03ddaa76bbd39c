"""Features, fitted transforms, calibrators, folds, statistics and joins."""

import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetlens.functions import columns as C
from fleetlens.operators import adaptation, features as X, folds, joins, ranking, routes, stats
from fleetlens.operators.calibrators import (
    FeatureCalibrator, FeatureCalibratorETA, FeatureCalibratorFuel, FeatureCalibratorStops,
)
from fleetlens.schemas import TRIPS
from fleetlens.settings import ETA_MODEL_FEATURES, FEATURE_CATEGORIES


@pytest.fixture(scope="module")
def trips(spark):
    rng = np.random.default_rng(1)
    xy = rng.normal(0, 3000, (400, 4)) + np.array([0, 500, -200, 900])
    rows = [
        (*map(float, p), int(rng.integers(0, 36_000)), float(np.hypot(p[0] - p[2], p[1] - p[3]) * 1.3), int(50 + i))
        for i, p in enumerate(xy)
    ]
    return spark.createDataFrame(rows, TRIPS).cache()


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_hours_wrap_with_the_scenario(spark):
    df = spark.createDataFrame([(t,) for t in (0, 3599, 3600, 35_999, 36_000)], "time_start long")
    got = [tuple(r)[1:] for r in X.temporal_features(df).collect()]
    assert got == [(0, 1, 0, 0, 1), (0, 1, 0, 0, 1), (1, 1, 0, 0, 1), (9, 0, 0, 1, 1), (0, 1, 0, 0, 1)]


def test_cells_are_floored(spark):
    got = [one(spark, C.floor_cell(F.lit(v), 100)) for v in (-0.5, -100.0, 99.9, 100.0)]
    assert got == [-1, -1, 0, 1]


def test_distance_classes_at_their_limits(spark):
    df = spark.createDataFrame([(0.0, 0.0, 3.0, 4.0, d) for d in (10.0, 10.1, 20.0, 20.1, 0.0)],
                               "source_x double, source_y double, destination_x double, destination_y double, distance double")
    got = X.spatial_features(df, [10.0, 15.0, 20.0], (0.0, 0.0)).collect()
    assert [(r["is_short_distance"], r["is_medium_distance"], r["is_long_distance"]) for r in got] == [
        (1, 0, 0), (0, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 0)]
    assert got[4]["route_efficiency"] is None and got[0]["route_efficiency"] == 0.5


def test_axes_match_an_eigendecomposition(trips):
    p = trips.toPandas()
    points = np.vstack([p[["source_x", "source_y"]], p[["destination_x", "destination_y"]]])
    values, vectors = np.linalg.eigh(np.cov(points.T))
    axes = X.fit_axes(trips)
    for name, vector in (("first", vectors[:, 1]), ("second", vectors[:, 0])):
        vector = vector * np.sign(vector[np.argmax(np.abs(vector))])
        assert np.allclose(axes[name], vector)
    assert np.allclose(axes["means"], points.mean(axis=0))


def test_nearest_centre_matches_numpy_with_mirrored_centres(spark, trips):
    centres = sorted((1000 * math.cos(a), 1000 * math.sin(a)) for a in C.even_angles(20))
    done = trips.withColumn("c", C.nearest_centre("source_x", "source_y", centres))
    rows = done.select("source_x", "source_y", "c").collect()
    for x, y, c in rows:
        d = [(x - cx) ** 2 + (y - cy) ** 2 for cx, cy in centres]
        assert d[c] <= min(d) + 1e-6
    counted = {r["c"]: r["count"] for r in done.where("distance > 0").groupBy("c").count().collect()}
    assert counted == {c: sum(r["c"] == c for r in rows) for c in {r["c"] for r in rows}}


def test_normal_functions(spark):
    ps = [1e-7, 1e-4, 0.01, 0.0242, 0.0243, 0.2, 0.5, 0.9, 0.9757, 0.9758, 0.9999, 1 - 1e-7]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = df.select("p", C.normal_quantile("p").alias("z")).withColumn("back", C.normal_cdf("z")).collect()
    for p, z, back in got:
        assert abs(z - statistics.NormalDist().inv_cdf(p)) < 1e-7 and abs(back - p) < 1e-8


def test_target_transforms_round_trip(trips):
    for target in (X.LogTarget(), X.BoxCoxTarget(), X.QuantileNormalTarget(100)):
        fitted = target.fit(trips, "duration")
        moved = trips.select("duration", fitted.forward(F.col("duration")).alias("z"))
        back = moved.select("duration", "z", fitted.inverse(F.col("z")).alias("b")).toPandas()
        assert np.allclose(back["b"], back["duration"], rtol=1e-4), type(target).__name__
    assert abs(back["z"].median()) < 0.05 and 0.8 < back["z"].std() < 1.6


def test_box_cox_of_lognormal_values_is_a_logarithm(spark):
    values = np.exp(np.random.default_rng(0).normal(2, 0.7, 2000))
    target = X.BoxCoxTarget().fit(spark.createDataFrame([(float(v),) for v in values], "y double"), "y")
    assert abs(target.exponent) < 0.1


def test_scaler_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert X.fit_scaler(df, ["a", "b"]) == {"a": (2.0, 1.0), "b": (5.0, 1.0)}


def test_unseen_cluster_is_encoded_as_zero(spark):
    df = spark.createDataFrame([(0,), (1,), (7,)], "c int").select(X.encode_target("c", {0: 2.5, 1: 4.0}).alias("e"))
    assert [r["e"] for r in df.collect()] == [2.5, 4.0, 0.0]


def test_eta_calibrator_has_the_model_columns_and_is_row_local(spark, trips, tmp_path):
    fitted = FeatureCalibratorETA.fit(trips, clusters=5)
    path = str(tmp_path / "c")
    fitted.save(spark, path)
    loaded = FeatureCalibratorETA.load(spark, path)
    done = loaded.transform(trips)
    assert set(ETA_MODEL_FEATURES) | {"duration"} == set(done.columns)
    again = loaded.transform(trips.repartition(7))
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, again.collect()))
    with pytest.raises(TypeError):
        FeatureCalibratorFuel.load(spark, path)


def test_all_groups_give_all_features(trips):
    done = FeatureCalibrator.fit(trips, clusters=4).transform(trips)
    names = {n for group in FEATURE_CATEGORIES.values() for n in group}
    assert len(names) == 54 and names == set(done.columns) - {"duration"}
    with pytest.raises(ValueError, match="nonsense"):
        FeatureCalibrator.fit(trips, ("nonsense",))


def test_fuel_calibrator_from_ready_trips(spark):
    row = (7200, 0.0, 0.0, 3.0, 4.0, 9.0, 0.0, 6.0, 0.0, 8.0)
    names = ("timestep_time_min vehicle_x_first vehicle_y_first vehicle_x_last vehicle_y_last trip_actual_distance "
             "minimum_x maximum_x minimum_y maximum_y").split()
    df = spark.createDataFrame([row], names)
    got = FeatureCalibratorFuel([(0.0, 0.0), (9.0, 9.0)], [(0.0, 0.0), (3.0, 3.0)]).transform(df).first()
    assert (got["start_hour"], got["straight_line_distance"], got["spatial_extent"]) == (2, 5.0, 10.0)
    assert (got["start_cluster_0"], got["start_cluster_1"], got["end_cluster_1"]) == (1, 0, 1)


def test_stops_calibrator_with_routes_only(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 1.0, 1.0, 5.0, ["a", "b", "a"]), (0.0, 0.0, 1.0, 1.0, 5.0, [])],
        "trip_start_x double, trip_start_y double, trip_end_x double, trip_end_y double, actual_distance double, route_edges array<string>",
    )
    got = FeatureCalibratorStops(use_spatial=False).transform(df).collect()
    assert (got[0]["route_num_edges"], got[0]["route_unique_edges"]) == (3, 2)
    assert got[1]["route_edge_reuse_ratio"] is None


@pytest.mark.parametrize("limit", [10**6, 20])
def test_fold_sizes_differ_by_at_most_one(spark, trips, limit):
    numbered = trips.withColumn("id", F.col("duration"))
    done = folds.stratified_folds(numbered, "distance", ["id"], group_rows=limit, chunks=5)
    sizes = {}
    for r in done.groupBy("stratum", "fold").count().collect():
        sizes.setdefault(r["stratum"], []).append(r["count"])
    assert len(sizes) == 10 and all(len(s) == 5 and max(s) - min(s) <= 1 for s in sizes.values())


def test_quantile_bins_drop_repeated_edges(spark):
    df = spark.createDataFrame([(v,) for v in [1.0] * 60 + [2.0] * 25 + [3.0] * 15], "v double")
    edges = folds.quantile_edges(df, "v", 4)
    assert edges == [1.0, 2.0, 3.0]
    counted = {r["stratum"]: r["count"] for r in folds.quantile_bin(df, "v", edges).groupBy("stratum").count().collect()}
    assert counted == {0: 85, 1: 15}


def test_after_first_keeps_the_rest(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(50)], "time_start long, id long")
    want = sorted((i % 5, i) for i in range(50))[13:]
    assert sorted(map(tuple, adaptation.after_first(df, 13, ["id"]).collect())) == want
    assert adaptation.after_first(df, 60, ["id"]).count() == 0


@pytest.mark.parametrize("per_cell", [1000, 40, 2])
def test_nearest_within_matches_brute_force(spark, per_cell):
    rng = np.random.default_rng(2)
    points = [(float(x), float(y)) for x, y in np.vstack([rng.uniform(-50, 50, (200, 2)), rng.normal(0, 1, (200, 2))])]
    points += [points[0]] * 30 + [(900.0, 900.0)]
    targets = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.uniform(-50, 50, (60, 2)), rng.normal(0, 1, (300, 2))]))]
    got = joins.nearest_within(
        spark.createDataFrame(points, "x double, y double"),
        spark.createDataFrame(targets, "target_id int, x double, y double"), 12.0, per_cell=per_cell,
    ).collect()
    assert len(got) == len(points)
    for r in got:
        gap, best = min((math.hypot(r["x"] - x, r["y"] - y), i) for i, x, y in targets)
        assert (r["target_id"] == best and abs(r["gap"] - gap) < 1e-9) if gap <= 12 else r["target_id"] is None


@pytest.mark.parametrize("per_cell", [1000, 20, 2])
def test_nearest_edge_matches_brute_force(spark, per_cell):
    rng = np.random.default_rng(5)
    points = [(float(x), float(y)) for x, y in np.vstack([rng.uniform(-50, 50, (150, 2)), rng.normal(0, 1, (100, 2))])]
    points += [points[0]] * 20 + [(900.0, 900.0), (0.0, 0.0), (None, 1.0)]
    starts = np.vstack([rng.uniform(-50, 50, (40, 2)), rng.normal(0, 1, (60, 2))])
    edges = [(i, [tuple(map(float, p)) for p in a + np.cumsum(rng.normal(0, 1 + i % 9, (1 + i % 5, 2)), axis=0)]) for i, a in enumerate(starts)]
    edges += [(200, edges[3][1]), (201, [(-500.0, -45.0), (500.0, 45.0)]), (202, []), (203, None), (204, [(2.0, 2.0), (2.0, 2.0)])]

    def gap(x, y, shape):
        best = math.inf
        for a, b in zip(shape, shape[1:] or shape):
            d = (b[0] - a[0], b[1] - a[1])
            n = d[0] ** 2 + d[1] ** 2
            t = max(0.0, min(1.0, ((x - a[0]) * d[0] + (y - a[1]) * d[1]) / n)) if n else 0.0
            best = min(best, math.hypot(x - a[0] - t * d[0], y - a[1] - t * d[1]))
        return best

    got = joins.nearest_edge(
        spark.createDataFrame(points, "x double, y double"),
        spark.createDataFrame(edges, "edge_id int, shape array<struct<x: double, y: double>>"), 6.0, per_cell=per_cell,
    ).collect()
    assert len(got) == len(points)
    for r in got:
        if r["x"] is None:
            assert r["edge_id"] is None
            continue
        gaps = {i: gap(r["x"], r["y"], s) for i, s in edges if s}
        near = min(gaps.values())
        if near > 6:
            assert r["edge_id"] is None
        else:
            assert abs(r["gap"] - near) < 1e-9 and gaps[r["edge_id"]] - near < 1e-9
            assert r["edge_id"] != 200  # the copy of a smaller id


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_salted_and_broadcast_lookups_agree(spark, how):
    keys = [None if i % 7 == 0 else "h" if i % 3 else f"k{i}" for i in range(300)]
    facts = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    table = spark.createDataFrame([("h", 1.0), ("h", 3.0), ("k3", 2.0), (None, 9.0)], "k string, w double")
    small = joins.lookup(facts, table, "k", how)
    for hot_rows in (1, 50, 1000):  # every key of two rows, "h" alone, none
        large = joins.lookup(facts, table, "k", how, rows=1, salts=5, hot_rows=hot_rows)
        assert sorted(map(tuple, small.collect()), key=repr) == sorted(map(tuple, large.select(*small.columns).collect()), key=repr)
    assert joins.keep_known(facts, table, "k", rows=1).count() == joins.keep_known(facts, table, "k").count()


def test_only_hot_keys_are_copied_and_bytes_count(spark):
    facts = spark.createDataFrame([("h" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, i) for i in range(300)], "k string, i int")
    assert [r.k for r in joins.hot_keys(facts, ["k"], 50).collect()] == ["h"]
    assert [r.k for r in joins.hot_keys(facts, ["k"], 0, most=1).collect()] == ["h"]
    table = spark.createDataFrame([("a" * 100, [1, 2], 1.0)] * 4 + [(None, None, None)], "k string, l array<int>, w double")
    assert joins.is_small(table, 5) and not joins.is_small(table, 4)
    assert joins.is_small(table, 5, 1000) and not joins.is_small(table, 5, 400)


def test_ranking_ties_gaps_and_flat_scores(spark):
    schema = "model string, feature string, percentage_mean double"
    a = spark.createDataFrame([("m", "x", 50.0), ("m", "y", 50.0), ("m", "z", 0.0)], schema)
    ranked = {r["feature"]: (r["rank"], r["scaled"]) for r in ranking.rank_and_scale(a).collect()}
    assert ranked == {"x": (1, 1.0), "y": (1, 1.0), "z": (2, 0.0)}
    flat = spark.createDataFrame([("m", "x", 5.0), ("m", "y", 5.0)], schema)
    assert {r["scaled"] for r in ranking.rank_and_scale(flat).collect()} == {None}
    both = {r["feature"]: r for r in ranking.combine_rankings({"a": a, "b": flat}).collect()}
    assert both["z"]["final_rank"] == 2.0 and both["x"]["final_scaled"] == 1.0


def test_pair_choice_keeps_the_first_on_ties(spark):
    pairs = spark.createDataFrame([("p", "q", 0.99), ("q", "u", 0.98)], "feature_1 string, feature_2 string, correlation double")
    scores = spark.createDataFrame([("p", 0.5), ("q", 0.5)], "feature string, final_score double")
    got = {r["feature_1"]: r for r in ranking.compare_correlated_pairs(pairs, scores).collect()}
    assert (got["p"]["keep"], got["p"]["drop"]) == ("p", "q")
    assert (got["q"]["keep"], got["q"]["drop_index"], got["q"]["feature_2_score"]) == ("q", -1, -1.0)


def test_wide_correlations_agree_with_narrow_ones(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 22))
    base[:, 5] = base[:, 2] * -3 + 1
    names = [f"c{i}" for i in range(22)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in base], names)
    wide = stats.correlated_pairs(df, names, 0.9).collect()
    narrow = stats.correlated_pairs(df, names[:10], 0.9).collect()
    assert [tuple(r)[:2] for r in wide] == [tuple(r)[:2] for r in narrow] == [("c5", "c2")]


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 5, 9.99, 10)], "v double")
    got = {r["bin"]: r["n"] for r in stats.histogram(df, "v", 10).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0, 7: 0, 8: 0, 9: 2}


def test_display_texts(spark):
    assert one(spark, C.simulation_clock(F.lit(36_000 + 3_661))) == "Day 02 - 09:01"
    assert [one(spark, C.prediction_text(t, F.lit(v))) for t, v in (("eta", 125.9), ("fuel", 740_000.0), ("stops", 0.5), ("stops", 1.2))] == [
        "02:05 min", "1.00 L", "0 stops", "1 stop"]
    with pytest.raises(ValueError):
        C.prediction_text("x", F.lit(1.0))
    assert one(spark, C.without_special_tokens(F.lit("<｜a｜> x <|b|>y "))) == "x y"


def test_correlated_pairs_skip_nulls_pair_by_pair_at_any_width(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({f"f{i}": rng.normal(size=200) for i in range(24)})
    frame["f24"] = frame["f0"] + 0.1 * frame["f1"]
    frame["f25"] = 3.0
    frame.loc[frame.index % 10 == 0, "f24"] = np.nan
    found = stats.correlated_pairs(spark.createDataFrame(frame), list(frame), 0.9).collect()
    assert [(r["feature_1"], r["feature_2"]) for r in found] == [("f24", "f0")]
    assert abs(found[0]["correlation"] - frame["f24"].corr(frame["f0"])) < 1e-9


def test_hashes_of_neighbouring_seeds_are_independent(spark):
    rows = spark.range(1000).select(C.mixed_hash("id", 1).alias("a"), C.mixed_hash("id", 2).alias("b")).toPandas()
    assert (rows["a"] - rows["b"]).nunique() > 990
    assert abs(rows["a"].corr(rows["b"])) < 0.15 and abs(rows["a"].corr(pd.Series(range(1000)))) < 0.15


def test_routes_without_a_segment(spark):
    rows = [(1, [1.0, 2.0]), (2, []), (3, [0.0, 0.0, 4.0, 0.0]), (4, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>").withColumn("route", routes.points_from_array("v"))
    found = {r["id"]: r for r in df.withColumn("n", routes.nearest_segment("route", F.lit(1.0), F.lit(2.0))).collect()}
    assert [len(found[i]["route"]) for i in (1, 2, 3)] == [1, 0, 2] and found[4]["route"] is None
    assert found[1]["n"] is None and found[2]["n"] is None and found[4]["n"] is None
    assert (found[3]["n"]["d"], found[3]["n"]["i"], found[3]["n"]["x"]) == (2.0, 0, 1.0)
