"""The typed monitor beside the plain one: over slices, a restart in between, swaps, and timers."""

import numpy as np

from fleetlens.streaming import lifecycle as L, typed as T
from tests.test_drift import SMALL, noise


def rows_of(parts, controls=()):
    rows = [(t, 30 * i, i, float(v), None) for t, values in parts.items() for i, v in enumerate(values)]
    return sorted(rows + [(t, ts, 1 << 60, None, kind) for t, ts, kind in controls], key=lambda r: (r[1], r[2]))


def plain_events(rows, last):
    monitors = {}
    for task, ts, seq, error, control in rows:
        m = monitors.setdefault(task, L.TaskMonitor(task, SMALL, 300))
        m.control(ts, control) if control else m.error(ts, seq, error)
    for m in monitors.values():
        m.advance(last)
    return sorted(map(repr, (e for m in monitors.values() for e in m.events)))


def test_typed_monitor_over_a_restart(spark, tmp_path):
    drifting = np.concatenate([noise(200, seed=1), noise(150, 25.0, 2)])
    controls = [("a", 30 * 330, "swapped"), ("b", 30 * 345, "reset")]
    parts = {"a": np.concatenate([drifting, noise(150, 12.0, 3)]), "b": drifting, "c": noise(420, 5.0, 4)}
    rows = rows_of(parts, controls)
    last = 30 * 500
    inbox, sink, checkpoint = (str(tmp_path / n) for n in ("inbox", "sink", "progress"))
    L.control_rows(spark, []).write.parquet(inbox)

    def start():
        with T.typed_store(spark), L.state_partitions(spark, 2):
            return L.append_sink(T.typed_monitor_stream(L.read_inbox(spark, inbox), SMALL, 300), sink, checkpoint)

    query = start()
    cuts = [0, 60, 130, 215, 260, 340, 420, 500, 10**9]
    try:
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if i == 4:  # another run goes on from the checkpoint
                query.stop()
                query = start()
            part = [r for r in rows if 30 * a <= r[1] < 30 * b]
            if part:
                spark.createDataFrame(part, L.INPUT).coalesce(1).write.mode("append").parquet(inbox)
                query.processAllAvailable()
        # rows of another task move the watermark on: timers end what waits
        spark.createDataFrame([("z", last + 6000, 0, 1.0, None)], L.INPUT).write.mode("append").parquet(inbox)
        query.processAllAvailable()
    finally:
        query.stop()
    found = L.read_sink(spark, sink, L.EVENTS).drop("batch").collect()
    got = sorted(repr((r.task, r.ts, r.seq, r.event, r.state, r.range_start, r.range_end)) for r in found)
    want = plain_events(rows, last + 6000)
    assert got == want
    kinds = {r.event for r in found}
    assert {"calibrated", "drifted", "retraining", "swapped", "reset", "consensus"} <= kinds
