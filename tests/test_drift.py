"""Detectors, calibration, the lifecycle's golden traces, and streams against their batch twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators.ordered import OrderedRows
from fleetlens.plans import inputs as I
from fleetlens.streaming import batch as B, calibration as K, lifecycle as L
from fleetlens.streaming.detectors import KINDS, Adwin, Kswin, PageHinkley, Spc, fires, ks_distance, longest_run, smooth

SMALL = K.DetectorSettings(
    smoothing=10, grace=20, calibration=100, adwin_deltas=(0.002, 1e-6), page_deltas=(0.01,), page_thresholds=(20.0, 80.0),
    kswin_alphas=(1e-3, 1e-6), kswin_sizes=((20, 10), (40, 20)), spc_sigmas=(3.0, 4.0), spc_runs=((8, 2),), collect={"a": 600, "b": 0},
)


def noise(n, level=10.0, seed=0):
    return np.abs(np.random.default_rng(seed).normal(level, 1.0, n))


def test_detectors_stay_silent_on_constants():
    for detector in (Adwin(0.002), PageHinkley(0.005, 50.0), Kswin(0.01, 60, 30), Spc(5.1, 3)):
        assert not fires(detector, [5.0] * 3000), type(detector).__name__


def test_detectors_fire_after_a_jump_and_not_before():
    values = np.concatenate([noise(1500), noise(1500, 20.0, 1)])
    for detector in (Adwin(0.002), PageHinkley(0.1, 50.0, 30), Kswin(1e-5, 100, 50), Spc(15.0, 5)):
        first = next(i for i, v in enumerate(values) if detector.update(float(v)))
        assert 1500 <= first < 1900, type(detector).__name__


def test_adwin_window_statistics_match_its_values():
    detector, values = Adwin(1e-300), noise(777, 3.0)
    for v in values:
        detector.update(float(v))
    assert detector.width == 777 and np.isclose(detector.total, values.sum())
    assert np.isclose(detector.spread / detector.width, values.var())
    assert sum(len(r) * 2**i for i, r in enumerate(detector.rows)) == 777 and max(map(len, detector.rows)) <= 5


def test_adwin_forgets_the_old_level_and_respects_grace():
    values = np.concatenate([noise(1000), noise(1000, 30.0, 1)])
    detector = Adwin(0.002)
    fires_at = [i for i, v in enumerate(values) if detector.update(float(v))]
    assert fires_at and abs(detector.total / detector.width - 30) < 1
    assert not fires(Adwin(0.002, grace=2000), values)


@pytest.mark.parametrize("detector", [Adwin(0.01, 3), PageHinkley(0.1, 9.0, 5), Kswin(0.01, 20, 8), Spc(11.0, 3, 4)])
def test_state_survives_dump_and_restore(detector):
    import json

    values = noise(300, seed=7)
    for v in values[:150]:
        detector.update(float(v))
    name = next(n for n, c in KINDS.items() if type(detector) is c)
    copy = KINDS[name].restore(json.loads(json.dumps(detector.dump())))
    assert [detector.update(float(v)) for v in values[150:]] == [copy.update(float(v)) for v in values[150:]]


def test_spc_needs_exactly_k_in_a_row():
    assert not fires(Spc(1.0, 3), [2, 2, 0, 2, 2, 0]) and fires(Spc(1.0, 3), [2, 2, 2])
    assert not fires(Spc(1.0, 3, grace=2), [2, 2, 2, 2]) and fires(Spc(1.0, 3, grace=2), [2] * 5)


def test_helpers():
    assert longest_run(np.array([0, 1, 1, 0, 1, 1, 1], bool)) == 3 and longest_run(np.zeros(4, bool)) == 0
    assert np.allclose(smooth(np.array([1.0, 3.0, 5.0]), 2), [1, 2, 4])
    assert ks_distance(np.array([1.0, 2.0]), np.array([3.0, 4.0])) == 1.0


def error_frame(spark, parts):
    rows = [(t, i * 10, i, float(v)) for t, values in parts.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "task string, ts long, seq long, error double")


def test_calibration_chooses_the_first_silent_candidate(spark):
    errors = error_frame(spark, {"a": noise(150), "b": noise(150, 50.0, 3)})
    for detector in ("ADWIN", "PAGE_HINKLEY", "KSWIN"):
        got = {r["task"]: r["candidate"] for r in K.choose_candidates(errors, detector, SMALL).collect()}
        for task, seed, level in (("a", 0, 10.0), ("b", 3, 50.0)):
            first = noise(150, level, seed)[:100]
            silent = [K.stays_silent(detector, c, first, SMALL) for c in SMALL.candidates(detector)]
            assert got[task] == (silent.index(True) if any(silent) else len(silent) - 1)


def test_spc_calibration_in_sql_matches_numpy(spark):
    errors = error_frame(spark, {"a": noise(150), "b": np.concatenate([noise(80), noise(70, 14.0, 2)]), "c": np.full(120, 2.0)})
    for limit in (10**6, 40):
        got = {r["task"]: (r["threshold"], r["needed"]) for r in K.spc_calibration(errors, SMALL, group_rows=limit, chunks=6).collect()}
        for task, values in (("a", noise(150)), ("b", np.concatenate([noise(80), noise(70, 14.0, 2)])), ("c", np.full(120, 2.0))):
            limit_, needed = K.spc_limits(smooth(values[:100], SMALL.smoothing), SMALL)
            assert np.isclose(got[task][0], limit_) and got[task][1] == needed


def test_page_hinkley_twin_matches_the_detector(spark):
    values = np.concatenate([noise(400), noise(400, 14.0, 5)])
    detector = PageHinkley(0.1, 60.0, 30, keep=1.0)
    want = next(i for i, v in enumerate(values) if detector.update(float(v))) + 1
    for limit in (10**6, 100):
        fire = B.first_page_hinkley_fire(error_frame(spark, {"a": values}), 0.1, 60.0, 30, group_rows=limit, chunks=5).first()
        assert (fire["position"], fire["ts"]) == (want, (want - 1) * 10)


LAYOUTS = [{}, {"group_rows": 100, "chunks": 5}]


@pytest.mark.parametrize("keep", [0.9999, 0.9, 1.0])
@pytest.mark.parametrize("layout", LAYOUTS)
def test_decayed_sums_are_the_recurrence(spark, keep, layout):
    x = np.random.default_rng(4).normal(0, 3, 900)
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, float(-v)) for i, v in enumerate(x[:300])] + [(None, 0, 2.0)]
    laid = OrderedRows.lay_out(spark.createDataFrame(rows, "task string, seq long, x double"), ["task"], ["seq"], **layout)
    got = {(r["task"], r["seq"]): r["y"] for r in laid.decayed_sums(keep, y=F.col("x")).rows().collect()}
    for task, values in (("a", x), ("b", -x[:300]), (None, [2.0])):
        y = 0.0
        for i, v in enumerate(values):
            y = keep * y + v
            assert np.isclose(got[task, i], y, atol=1e-8)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_page_hinkley_with_forgetting_matches_the_monitor(spark, layout):
    parts = {t: np.concatenate([noise(500, seed=i), noise(400, 12.0 + i, 5)]) for i, t in enumerate("abc")}
    parts["quiet"] = np.full(300, 3.0)
    limits = [(t, 0.1, 40.0 + 10 * i) for i, t in enumerate(parts)]
    for keep in (0.9999, 0.99):
        want = set()
        for task, delta, threshold in limits:
            detector = PageHinkley(delta, threshold, 30, keep)
            first = next((i for i, v in enumerate(parts[task]) if detector.update(float(v))), None)
            want |= {(task, first + 1, first * 10)} if first is not None else set()
        rows = spark.createDataFrame(limits, "task string, delta double, threshold double")
        found = B.first_page_hinkley_fires(error_frame(spark, parts), rows, 30, keep, **layout).collect()
        assert {tuple(r) for r in found} == want


@pytest.mark.parametrize("layout", LAYOUTS)
def test_sliding_ks_matches_the_monitor(spark, layout, monkeypatch):
    monkeypatch.setattr(B, "KS_BLOCK", 50)
    parts = {"a": np.round(np.concatenate([noise(600), noise(500, 11.5, 5)]), 1), "b": noise(700, seed=8), "short": noise(30)}
    limits = [("a", 1e-2, 40, 20), ("b", 1e-4, 60, 30), ("short", 0.5, 40, 20)]
    rows = spark.createDataFrame(limits, "task string, alpha double, size int, stat int")
    tested = B.sliding_ks(error_frame(spark, parts), rows, 5, **layout).collect()
    got = {(r["task"], r["position"]): r["ks"] for r in tested}
    want = set()
    for task, alpha, size, stat in limits:
        values, detector = parts[task][::5], Kswin(alpha, size, stat)
        for i in range(size - 1, len(values)):
            window = values[i - size + 1 : i + 1]
            assert np.isclose(got.pop((task, 5 * i + 1)), ks_distance(window[:-stat], window[-stat:]))
        first = next((i for i, v in enumerate(values) if detector.update(float(v))), None)
        want |= {(task, 5 * first + 1)} if first is not None else set()
    assert not got and want
    fired = B.first_kswin_fire(error_frame(spark, parts), rows, 5, **layout).collect()
    assert {(r["task"], r["position"]) for r in fired} == want
    assert B.first_kswin_fire(error_frame(spark, parts), rows.limit(0), 5).collect() == []


def test_adwin_in_batch_matches_the_monitor(spark):
    parts = {t: np.concatenate([noise(700, seed=i), noise(600, 11.0 + i, 5)]) for i, t in enumerate("abc")}
    limits = [("a", 0.002), ("b", 1e-3), ("c", 1e-300)]
    want = set()
    for task, delta in limits:
        detector = Adwin(delta, 100)
        first = next((i for i, v in enumerate(parts[task]) if detector.update(float(v))), None)
        want |= {(task, first + 1, first * 10)} if first is not None else set()
    rows = spark.createDataFrame(limits, "task string, delta double")
    found = B.first_adwin_fire(error_frame(spark, parts), rows, 100).collect()
    assert {tuple(r) for r in found} == want and len(want) == 2


def test_ks_twin_matches_numpy(spark):
    values = np.round(np.concatenate([noise(300), noise(300, 11.0, 5)]), 1)
    errors = error_frame(spark, {"a": values})
    for limit in (10**6, 50):
        got = B.ks_two_sample(errors, F.col("ts") < 3000, F.col("ts") >= 3000, 5, group_rows=limit, chunks=4).first()
        assert np.isclose(got["ks"], ks_distance(values[:300:5], values[300::5]))


def run(task, values, step=30, controls=()):
    monitor = L.TaskMonitor(task, SMALL, 300)
    for i, v in enumerate(values):
        monitor.error(i * step, i, float(v))
    for ts, kind in controls:
        monitor.control(ts, kind)
    return monitor


DRIFTING = np.concatenate([noise(300), noise(300, 40.0, 9)])


def test_golden_trace_of_a_drift():
    monitor = run("a", DRIFTING)
    names = [e[3] for e in monitor.events]
    assert names[0] == "calibrated" and monitor.events[0][1] == 3000
    assert names.index("calibrated") < names.index("consensus") < names.index("drifted") < names.index("retraining")
    assert sum(n.startswith("fired") for n in names) == SMALL.consensus
    drifted = next(e for e in monitor.events if e[3] == "drifted")
    asked = next(e for e in monitor.events if e[3] == "retraining")
    assert (asked[5], asked[6]) == (drifted[1], drifted[1] + 600) and asked[4] == "RETRAINING"
    assert drifted[1] % 300 == 0 and drifted[1] > 9000


def test_swap_calibrates_again_and_failure_stays_drifted():
    swapped = run("a", DRIFTING, controls=[(18_000, "swapped")])
    assert swapped.state == "CALIBRATING" and swapped.phase == "CALIBRATING" and swapped.events[-1][3] == "swapped"
    for i, v in enumerate(noise(200, 40.0, 11)):
        swapped.error(18_000 + i * 30, 1000 + i, float(v))
    assert [e[3] for e in swapped.events].count("calibrated") == 2
    failed = run("a", DRIFTING, controls=[(18_000, "failed")])
    assert (failed.state, failed.phase, failed.collecting) == ("DRIFTED", "DRIFTED", False)
    failed.control(30_000, "reset")
    assert failed.state == "CALIBRATING" and failed.buffer == []


def test_a_swap_without_a_request_changes_nothing():
    monitor = run("a", noise(50), controls=[(3000, "swapped")])
    assert monitor.state == "CALIBRATING" and len(monitor.buffer) == 50


def test_no_drift_no_request():
    assert [e[3] for e in run("a", noise(900)).events if e[3] in ("consensus", "retraining")] == []


def test_monitor_state_survives_any_cut():
    whole = run("a", DRIFTING)
    for cut in (50, 250, 340, 420):
        first = run("a", DRIFTING[:cut])
        second = L.TaskMonitor.restore(first.dump(), SMALL)
        for i in range(cut, len(DRIFTING)):
            second.error(i * 30, i, float(DRIFTING[i]))
        assert first.events + second.events == whole.events


def stream_events(spark, tmp_path, frames):
    inbox, sink = str(tmp_path / "in"), str(tmp_path / "out")
    L.control_rows(spark, []).write.parquet(inbox)
    query = L.append_sink(L.monitor_stream(L.read_inbox(spark, inbox), SMALL, 300), sink, str(tmp_path / "cp"))
    try:
        for frame in frames:
            frame.write.mode("append").parquet(inbox)
            query.processAllAvailable()
    finally:
        query.stop()
    rows = L.read_sink(spark, sink, L.EVENTS).drop("batch").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_streamed_tasks_match_single_monitors(spark, tmp_path):
    parts = {"a": DRIFTING, "b": noise(600, 5.0, 21), "c": np.concatenate([noise(200), noise(400, 30.0, 2)])}
    rows = [(t, i * 30, i, float(v), None) for t, values in parts.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, L.INPUT)
    got = stream_events(spark, tmp_path, [df.where(f"ts >= {a} AND ts < {b}").repartition(3) for a, b in ((0, 4000), (4000, 10_000), (10_000, 18_000))])
    want = sorted((tuple(e) for t, v in parts.items() for e in run(t, v).events), key=repr)
    assert got == want


def test_replay_loop_swaps_and_recovers(spark, tmp_path):
    rows = [("a", i * 30, i, float(v)) for i, v in enumerate(np.concatenate([noise(300), noise(700, 40.0, 9)]))]
    trips = spark.createDataFrame(rows, "task string, ts long, seq long, truth double")

    def score(batch, versions):
        level = 0.0 if versions["a"] == "v1" else 30.0
        return batch.select("task", "ts", "seq", F.abs(F.col("truth") - level).alias("error"))

    asked = []
    loop = L.ReplayLoop(spark, str(tmp_path / "r"), score, lambda *a: asked.append(a) or "v2", {"a": "v1"}, SMALL)
    events = loop.run(trips, "ts", [0, 6000, 12_000, 18_000, 24_000, 30_001]).orderBy("ts").collect()
    names = [r["event"] for r in events]
    assert names.count("swapped") == 1 and names.count("calibrated") == 2 and len(asked) == 1
    assert [r["version"] for r in loop.version_table().orderBy("valid_from").collect()] == ["v1", "v2"]


def test_notifications_and_collection(spark):
    events = spark.createDataFrame([("a", 5, "drifted"), ("a", 6, "fired:SPC")], "task string, ts long, event string")
    assert [tuple(r) for r in B.notifications(events).collect()] == [("a", 5, "Concept drift detected", "DANGER")]
    got = B.collection_windows(events.where("ts = 5"), {"a": 7200}).first()
    assert tuple(got) == ("a", 300, 7500)
    assert [t for t, *_ in B.clock_notifications()] == [0, 36_000, 72_000]
    assert I.TASKS == sorted(I.TASKS)


def test_slices_are_bounded_by_rows_and_time(spark):
    errors = error_frame(spark, {"a": np.ones(1000), "b": np.ones(10)})
    cuts = L.slice_cuts(errors, "ts", 300, most_rows=200)
    assert cuts[0] == 0 and cuts[-1] >= 10_000 and all(c % 300 == 0 for c in cuts)
    for start, end in zip(cuts, cuts[1:]):
        assert errors.where(f"task = 'a' AND ts >= {start} AND ts < {end}").count() <= 200
    assert L.slice_cuts(errors, "ts", 300, most_seconds=3000) == [0, 3000, 6000, 9000, 10_200]


def test_queries_try_whole_candidate_lists():
    from fleetlens.plans.drift_queries import SETTINGS

    whole = K.DetectorSettings()
    for detector in ("ADWIN", "PAGE_HINKLEY", "KSWIN"):
        assert len(SETTINGS.candidates(detector)) == len(whole.candidates(detector))
    assert tuple(SETTINGS.spc_sigmas) == tuple(whole.spc_sigmas) and len(SETTINGS.spc_runs) == len(whole.spc_runs)


def test_a_finished_folder_is_known(spark, tmp_path):
    path = str(tmp_path / "out")
    assert not L.is_written(spark, path)
    spark.range(3).write.parquet(path)
    assert L.is_written(spark, path)


def test_a_failing_retraining_stops_no_other_task(spark, tmp_path):
    def retrain(task, start, end):
        if task == "a":
            raise RuntimeError("no model")
        return "v2"

    def score(rows, versions):
        return rows.select("task", "ts", "seq", F.col("truth").alias("error"))

    drifting = np.concatenate([noise(200, seed=1), noise(150, 25.0, 2)])
    rows = [(t, 30 * i, i, float(v)) for t in "ab" for i, v in enumerate(drifting)]
    trips = spark.createDataFrame(rows, "task string, ts long, seq long, truth double")
    loop = L.ReplayLoop(spark, str(tmp_path / "r"), score, retrain, {"a": "v1", "b": "v1"}, SMALL)
    events = loop.run(trips, "ts", [0, 6000, 9000, 12_000]).collect()
    ends = {(r.task, r.event) for r in events if r.event in ("failed", "swapped")}
    assert ends == {("a", "failed"), ("b", "swapped")} and loop.failures[0][0] == "a" and "no model" in loop.failures[0][2]
    assert spark.read.option("recursiveFileLookup", "true").parquet(loop.errors).where("control IS NULL").count() == len(rows)
