"""The drift lifecycle as typed keyed state with event-time timers (``transformWithStateInPandas``).

The same monitor as in :mod:`fleetlens.streaming.lifecycle`, but nothing is one text: facts are a value, calibration
errors a list that only grows by what is new, the smoothing window, the test's window and the buckets of adaptive
windowing lists of numbers, and the detectors' numbers a map by name. A timer closes windows and ends the collection of
retraining data when the watermark passes, so a task whose rows stop coming still goes on, without ticks of a clock.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens import settings as S
from fleetlens.streaming.calibration import DetectorSettings, chunks_of
from fleetlens.streaming.detectors import KINDS
from fleetlens.streaming.lifecycle import EVENTS, TaskMonitor

FACTS = {
    "phase": "string", "phase_ts": "long", "state": "string", "since": "long", "collecting": "boolean", "job": "boolean",
    "clock": "long", "index": "long", "total": "double",
}
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class MonitorProcessor(StatefulProcessor):
    """One task's monitor between micro-batches."""

    def __init__(self, settings: DetectorSettings, seconds: int = S.WINDOW_SECONDS) -> None:
        self.settings, self.seconds = settings, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", ", ".join(f"`{n}` {kind}" for n, kind in FACTS.items()))
        self.lists = {n: handle.getListState(n, "x double") for n in ("buffer", "history", "newest")}
        self.buckets = handle.getListState("buckets", "level int, total double, spread double")
        self.fired = handle.getListState("fired", "name string")
        self.detectors = handle.getMapState("detectors", "name string", "numbers array<double>")

    def load(self, task: str) -> TaskMonitor:
        monitor = TaskMonitor(task, self.settings, self.seconds)
        if not self.facts.exists():
            return monitor
        monitor.__dict__.update(zip(FACTS, self.facts.get()))
        numbers = {n: [row[0] for row in state.get()] for n, state in self.lists.items()}
        monitor.buffer, monitor.history = numbers["buffer"], numbers["history"]
        monitor.fired = [row[0] for row in self.fired.get()]
        for (name,), (values,) in self.detectors.iterator():
            kind, state = KINDS[name], list(values)
            if name == "ADWIN":
                rows: list[list[tuple]] = [[]]
                for level, total, spread in self.buckets.get():
                    while len(rows) <= level:
                        rows.append([])
                    rows[level].append((total, spread))
                state = [state[0], int(state[1]), int(state[2]), *state[3:5], int(state[5]), rows]
            elif name == "KSWIN":
                state = [state[0], *map(int, state[1:]), numbers["newest"]]
            elif name == "PAGE_HINKLEY":
                state[2], state[4] = int(state[2]), int(state[4])
            else:
                state[1:] = map(int, state[1:])
            monitor.detectors[name] = kind.restore(state)
        # detectors report in one order, whatever that of the map is
        monitor.detectors = {n: monitor.detectors[n] for n in KINDS if n in monitor.detectors}
        return monitor

    def save(self, monitor: TaskMonitor, buffered: int) -> None:
        """Writes what changed; of the calibration errors only those after the first ``buffered``."""
        self.facts.update(tuple(getattr(monitor, n) for n in FACTS))
        if len(monitor.buffer) < buffered or not monitor.buffer:
            self.lists["buffer"].clear()
            buffered = 0
        if len(monitor.buffer) > buffered:
            self.lists["buffer"].appendList([(float(v),) for v in monitor.buffer[buffered:]])
        self._put(self.lists["history"], [(float(v),) for v in monitor.history])
        self._put(self.fired, [(n,) for n in monitor.fired])
        if not monitor.detectors:
            for state in (self.detectors, self.buckets, self.lists["newest"]):
                state.clear()
        for name, detector in monitor.detectors.items():
            state = detector.dump()
            if name == "ADWIN":
                self._put(self.buckets, [(level, float(s), float(v)) for level, row in enumerate(state.pop()) for s, v in row])
            elif name == "KSWIN":
                self._put(self.lists["newest"], [(float(v),) for v in state.pop()])
            self.detectors.updateValue((name,), ([float(v) for v in state],))

    @staticmethod
    def _put(state: Any, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def due(self, monitor: TaskMonitor) -> int | None:
        """The end of the window at whose closing the task has something to tell, if it has."""
        if monitor.collecting and not monitor.job:
            need = self.settings.collect.get(monitor.task, S.COLLECT_SECONDS["eta"])
            return max(monitor.clock, monitor.since + -(-need // self.seconds) * self.seconds)
        calibrated = monitor.phase == "STABLE" and monitor.state == "CALIBRATING"
        drifted = monitor.phase == "DRIFTED" and monitor.state == "STABLE" and not monitor.collecting
        return monitor.clock if calibrated or drifted else None

    def _finish(self, monitor: TaskMonitor, buffered: int) -> Iterator[pd.DataFrame]:
        self.save(monitor, buffered)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if (due := self.due(monitor)) is not None:
            self.handle.registerTimer(due * 1000)
        if monitor.events:
            frame = pd.DataFrame(monitor.events, columns=[c.split()[0] for c in EVENTS.split(", ")])
            for c in ("range_start", "range_end"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        monitor = self.load(key[0])
        buffered = len(monitor.buffer)
        for row in chunks_of(rows).itertuples(index=False):
            if isinstance(row.control, str):
                monitor.control(int(row.ts), row.control)
                buffered = min(buffered, len(monitor.buffer))
            else:
                monitor.error(int(row.ts), int(row.seq), float(row.error))
        if not monitor.buffer or monitor.phase != "CALIBRATING" or buffered == 0:
            self.lists["buffer"].clear()
            buffered = 0
        yield from self._finish(monitor, buffered)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        monitor = self.load(key[0])
        buffered = len(monitor.buffer)
        monitor.advance(expiredTimerInfo.getExpiryTimeInMs() // 1000)
        yield from self._finish(monitor, buffered)

    def close(self) -> None:
        pass


@contextmanager
def typed_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that typed state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    usual = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def typed_monitor_stream(
    errors: DataFrame, settings: DetectorSettings, seconds: int = S.WINDOW_SECONDS, delay: str = "1 second"
) -> DataFrame:
    """Transition events from a stream of (task, ts, seq, error, control) rows; rows that are ``delay`` or more behind the
    latest one of the batches before are left out (with one second: those of earlier seconds than it).

    Start it inside :func:`typed_store`. Event time is one second ahead of ``ts``, since a stream begins with its
    watermark at 0 and takes a row at that very moment for late.
    """
    timed = errors.select("task", "ts", "seq", "error", "control", F.timestamp_seconds(F.col("ts") + 1).alias("at"))
    return timed.withWatermark("at", delay).groupBy("task").transformWithStateInPandas(
        MonitorProcessor(settings, seconds), EVENTS, "Append", "EventTime"
    )
