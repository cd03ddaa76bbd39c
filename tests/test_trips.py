"""Telemetry to trips: boundaries, gaps, stops, cleaning policies."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import prep, trips as T
from fleetlens.schemas import TELEMETRY
from fleetlens.sources import telemetry as src


def record(vehicle, t, odometer=0.0, speed=1.0, lane="a_0", x=None, y=0.0, fuel=1.0):
    return (t, fuel, vehicle, lane, float(odometer), float(speed), 0.0, float(t if x is None else x), float(y))


def frame(spark, rows):
    return spark.createDataFrame(rows, TELEMETRY)


def ride(vehicle, duration, distance, start=0):
    return [record(vehicle, start, 5), record(vehicle, start + duration, 5 + distance)]


def test_eta_limits_are_inclusive(spark):
    rows = ride("a", 29, 200) + ride("b", 30, 199) + ride("c", 30, 200) + ride("d", 31, 201)
    kept = T.generate_trips(frame(spark, rows), keep=["vehicle_id"])
    assert sorted(r["vehicle_id"] for r in kept.collect()) == ["c", "d"]


def test_trip_columns_and_ends(spark):
    rows = [record("a", 40, 300, x=9, y=8), record("a", 0, 10, x=1, y=2), record("a", 20, 99, x=5, y=5)]
    trip = T.generate_trips(frame(spark, rows)).first().asDict()
    assert trip == {
        "source_x": 1.0, "source_y": 2.0, "destination_x": 9.0, "destination_y": 8.0, "time_start": 0,
        "distance": 290.0, "duration": 40,
    }


def test_stops_limits_are_strict(spark):
    def many(vehicle, duration, distance):
        return [record(vehicle, t, distance * t / duration) for t in range(duration + 1)]

    rows = many("a", 60, 501) + many("b", 61, 500) + many("c", 61, 501)
    kept = T.extract_stop_trips(frame(spark, rows))
    assert [r["vehicle_id"] for r in kept.collect()] == ["c"]


@pytest.mark.parametrize("limit", [10**6, 2])
def test_a_step_other_than_one_starts_a_trip(spark, limit):
    rows = [record("a", t) for t in (0, 1, 2, 4, 5, 9)] + [record("b", 7)]
    done = T.split_at_gaps(frame(spark, rows), group_rows=limit, chunks=4).rows()
    got = {(r["vehicle_id"], r["timestep_time"]): r["trip_id"] for r in done.collect()}
    assert got == {
        ("a", 0): "a_1", ("a", 1): "a_1", ("a", 2): "a_1", ("a", 4): "a_2", ("a", 5): "a_2", ("a", 9): "a_3",
        ("b", 7): "b_1",
    }


@pytest.mark.parametrize("limit", [10**6, 3])
def test_stops_are_runs_of_standing_still(spark, limit):
    speeds = {"a": [0, 0, 5, 0, 5, 0, 0], "b": [0] * 7, "c": [3] * 7}
    rows = [record(v, t, speed=s) for v, list_ in speeds.items() for t, s in enumerate(list_)]
    laid = T.split_at_gaps(frame(spark, rows), group_rows=limit, chunks=5)
    marked = T.mark_stops(laid, F.col("vehicle_speed") == 0).rows()
    got = {r[0]: r[1] for r in marked.groupBy("vehicle_id").agg(F.sum("stop_start")).collect()}
    assert got == {"a": 3, "b": 1, "c": 0}


def test_a_stop_does_not_reach_over_a_gap(spark):
    rows = [record("a", t, speed=0) for t in (0, 1, 5, 6)]
    marked = T.mark_stops(T.split_at_gaps(frame(spark, rows)), F.col("vehicle_speed") == 0).rows()
    assert marked.agg(F.sum("stop_start")).first()[0] == 2


def test_records_without_edge_leave_after_segmentation(spark):
    lanes = ["a_0", "", "a_1", ":j_1_0"]
    rows = [record("a", t, 600 * t, speed=0, lane=lanes[t % 4]) for t in range(64)]
    trip = T.extract_stop_trips(frame(spark, rows)).first()
    assert (trip["trip_id"], trip["actual_stops"], trip["route_unique_edges"]) == ("a_1", 1, 2)
    assert trip["route_num_edges"] == sum(bool(lanes[t % 4]) for t in range(64))


def test_cleaning_drops_nulls_and_late_rows(spark):
    rows = [record("a", 35_999), record("a", 36_000), (5, None, "a", "l", 0.0, 1.0, 0.0, 0.0, 0.0)]
    kept = prep.clean_telemetry(frame(spark, rows)).collect()
    assert [(r["timestep_time"], r["vehicle_speed"]) for r in kept] == [(35_999, 3.6)]


def test_fuel_keeps_long_trips_and_single_records(spark):
    rows = [record("a", t, t, fuel=2.0) for t in range(29)] + [record("b", t, t, fuel=2.0) for t in range(30)]
    rows += [record("b", 3, 3, fuel=2.0)]
    done = T.fuel_trips(frame(spark, rows)).collect()
    assert [r["vehicle_id"] for r in done] == ["b"]
    assert abs(done[0]["vehicle_fuel_log_sum"] - 4.110873864173311) < 1e-12  # log(1 + 60)
    simple = T.create_trips_simple(frame(spark, rows))
    assert simple.count() == 30 and simple.select("vehicle_id").distinct().count() == 1


def test_copies_collapse_to_the_preferred_row(spark):
    df = spark.createDataFrame([(1, 9, "b"), (1, 3, "a"), (2, 1, "c")], "k int, p int, s string")
    got = prep.drop_repeated(df, ["k"], ["p"])
    assert sorted(map(tuple, got.collect())) == [(1, 3, "a"), (2, 1, "c")] and got.columns == ["k", "p", "s"]


def test_sub_trips_are_contiguous_and_long_enough(spark):
    rows = [record("a", t, 10 * t) for t in range(100)]
    for limit in (10**6, 10):
        full = T.generate_full_trips(frame(spark, rows), 1, 1, rate=2.0, min_ratio=0.5, group_rows=limit, chunks=6)
        got = full.collect()
        assert len(got) == 201
        assert all(49 <= r["duration"] <= 99 and r["distance"] == 10 * r["duration"] for r in got)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="vehicle_x, vehicle_y"):
        prep.check_required_columns(spark.range(1), ["id", "vehicle_x", "vehicle_y"], "x")


def test_window_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "fcd")
    src.write_telemetry(frame(spark, [record("a", t) for t in range(0, 20_000, 50)]), path)
    window = src.read_window(spark, path, 3600, 7200, folder_seconds=3600)
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestep_time,3600)" in plan and "LessThan(timestep_time,7200)" in plan
    assert "PartitionFilters: [isnotnull(slot" in plan
    assert window.agg(F.min("timestep_time"), F.max("timestep_time"), F.count("*")).first()[:] == (3600, 7150, 72)


def test_telemetry_csv_keeps_types(spark, tmp_path):
    path = str(tmp_path / "csv")
    frame(spark, [record("7", 1, lane="e_1_0")]).write.option("sep", ";").option("header", True).csv(path)
    back = src.read_telemetry_csv(spark, path)
    assert back.dtypes == frame(spark, []).dtypes and back.first()["vehicle_id"] == "7"


def test_trips_plan_has_one_shuffle_and_no_sort(spark):
    plan = T.generate_trips(frame(spark, ride("a", 50, 900)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan and "HashAggregate" in plan
