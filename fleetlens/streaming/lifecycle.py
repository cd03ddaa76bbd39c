"""The drift lifecycle of every task as keyed streaming state, and the replay that drives it.

Per task: calibrate, watch, reach consensus, collect data, retrain, swap, calibrate again. All tasks are keys of one
stateful operator. The state has a fixed size (calibration buffer, smoothing window, detector state). Detectors are
sequential by nature, so one task's errors pass one after the other; the trigger bounds how many are held at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetlens import settings as S
from fleetlens.operators.prep import load_window
from fleetlens.streaming.calibration import DetectorSettings, calibrated_detectors, chunks_of
from fleetlens.streaming.detectors import KINDS

EVENTS = "task string, ts long, seq long, event string, state string, range_start long, range_end long"
INPUT = "task string, ts long, seq long, error double, control string"


class TaskMonitor:
    """Both state machines of one task: the detectors' and the driver's. Windows close when a later row arrives."""

    def __init__(self, task: str, settings: DetectorSettings, seconds: int = S.WINDOW_SECONDS) -> None:
        self.task, self.settings, self.seconds = task, settings, seconds
        self.clock: int | None = None
        self.events: list[tuple] = []
        self.state, self.since, self.collecting, self.job = "CALIBRATING", None, False, False
        self._fresh()

    def _fresh(self) -> None:
        self.phase, self.phase_ts = "CALIBRATING", 0
        self.buffer: list[float] = []
        self.history: list[float] = []
        self.total, self.index = 0.0, 0
        self.detectors: dict = {}
        self.fired: list[str] = []

    def _emit(self, ts: int, event: str, seq: int = -1, start: int | None = None, end: int | None = None) -> None:
        self.events.append((self.task, ts, seq, event, self.state, start, end))

    def error(self, ts: int, seq: int, value: float) -> None:
        self.advance(ts)
        if self.phase == "CALIBRATING":
            self.buffer.append(value)
            if len(self.buffer) >= self.settings.calibration:
                detectors = calibrated_detectors(self.buffer, self.settings)
                self._fresh()
                self.phase, self.phase_ts, self.detectors = "STABLE", ts, detectors
        elif self.phase == "STABLE":
            self._watch(ts, seq, value)

    def _watch(self, ts: int, seq: int, value: float) -> None:
        self.history.append(value)
        self.total += value
        if len(self.history) > self.settings.smoothing:
            self.total -= self.history.pop(0)
        smoothed = self.total / len(self.history)
        for name, detector in self.detectors.items():
            if name in self.fired or (name == "KSWIN" and self.index % self.settings.stride):
                continue
            if detector.update(value if name == "KSWIN" else smoothed):
                self.fired.append(name)
                self._emit(ts, f"fired:{name}", seq)
        self.index += 1
        if len(self.fired) >= self.settings.consensus:
            self.phase, self.phase_ts = "DRIFTED", ts
            self._emit(ts, "consensus", seq)

    def advance(self, ts: int) -> None:
        """Close every window that ends before the one of ``ts``."""
        end = (ts // self.seconds + 1) * self.seconds
        if self.clock is None:
            self.clock = end
        while self.clock < end:
            self._close(self.clock)
            waiting = self.collecting and not self.job
            self.clock = self.clock + self.seconds if waiting else end

    def _close(self, end: int) -> None:
        if self.phase == "STABLE" and self.state == "CALIBRATING":
            self.state, self.since = "STABLE", self.phase_ts
            self._emit(end, "calibrated")
        if self.phase == "DRIFTED" and self.state == "STABLE" and not self.collecting:
            self.state, self.since, self.collecting = "DRIFTED", end, True
            self._emit(end, "drifted")
        need = self.settings.collect.get(self.task, S.COLLECT_SECONDS["eta"])
        if self.collecting and not self.job and end - self.since >= need:
            self.state, self.job = "RETRAINING", True
            self._emit(end, "retraining", start=self.since, end=end)

    def control(self, ts: int, kind: str) -> None:
        """Rows that are not errors: ``tick``, ``swapped``, ``failed``, ``recalibration_failed`` and ``reset``."""
        self.advance(ts)
        if kind == "tick":
            return
        if kind == "reset":
            clock, events = self.clock, self.events
            self.__init__(self.task, self.settings, self.seconds)
            self.clock, self.events = clock, events
        elif self.job or kind == "recalibration_failed":
            self.state = "CALIBRATING" if kind == "swapped" else "DRIFTED"
            self.since, self.collecting, self.job = None, False, False
            if kind == "swapped":
                self._fresh()
        self._emit(ts, kind)

    def dump(self) -> str:
        kept = {k: v for k, v in self.__dict__.items() if k not in ("settings", "events", "detectors")}
        kept["detectors"] = {n: d.dump() for n, d in self.detectors.items()}
        return json.dumps(kept)

    @classmethod
    def restore(cls, text: str, settings: DetectorSettings) -> TaskMonitor:
        kept = json.loads(text)
        monitor = cls(kept["task"], settings, kept["seconds"])
        monitor.__dict__.update(kept)
        monitor.detectors = {n: KINDS[n].restore(s) for n, s in kept["detectors"].items()}
        return monitor


def monitor_stream(errors: DataFrame, settings: DetectorSettings, seconds: int = S.WINDOW_SECONDS) -> DataFrame:
    """Transition events from a stream of (task, ts, seq, error, control) rows."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        monitor = TaskMonitor.restore(state.get[0], settings) if state.exists else TaskMonitor(key[0], settings, seconds)
        for row in chunks_of(rows).itertuples(index=False):
            if isinstance(row.control, str):
                monitor.control(int(row.ts), row.control)
            else:
                monitor.error(int(row.ts), int(row.seq), float(row.error))
        state.update((monitor.dump(),))
        if monitor.events:
            frame = pd.DataFrame(monitor.events, columns=[c.split()[0] for c in EVENTS.split(", ")])
            for c in ("range_start", "range_end"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    return errors.select("task", "ts", "seq", "error", "control").groupBy("task").applyInPandasWithState(
        step, EVENTS, "monitor string", "append", GroupStateTimeout.NoTimeout
    )


def read_inbox(spark: SparkSession, inbox: str, schema: str = INPUT, **options: str) -> DataFrame:
    """A stream over the files that appear in a folder; ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` bound a batch."""
    return spark.readStream.schema(schema).options(**options).parquet(inbox)


@contextmanager
def state_partitions(spark: SparkSession, keys: int) -> Iterator[None]:
    """Streams started inside keep their state in at most ``keys`` partitions.

    A query fixes the number when it first starts. Every partition is committed with every micro-batch, so hundreds of
    them for a handful of tasks would be all overhead.
    """
    name = "spark.sql.shuffle.partitions"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(max(1, min(int(usual), keys))))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def append_sink(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None
) -> StreamingQuery:
    """Every micro-batch to its own folder, overwritten if it is run again, so a retried batch leaves no copies."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a job has finished writing the folder."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def read_sink(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches of a sink; their number is the column ``batch``."""
    return spark.read.schema(f"{schema}, batch long").parquet(path)


def slice_cuts(
    rows: DataFrame, time: str, tick: int = S.WINDOW_SECONDS, most_rows: int = 1_000_000, most_seconds: int | None = None
) -> list[int]:
    """Borders of replay slices on the tick grid: at most ``most_rows`` of a task in a slice (a single tick apart), so
    that what one task of the monitor holds at a time is bounded. The driver sees one count per tick.
    """
    start = (F.floor(F.col(time) / tick) * tick).alias("start")
    busiest = rows.groupBy("task", start).count().groupBy("start").agg(F.max("count").alias("n")).orderBy("start")
    cuts, held, last = [0], 0, 0
    for begin, n in busiest.collect():
        full = held + n > most_rows or (most_seconds is not None and begin - cuts[-1] >= most_seconds)
        if full and begin > cuts[-1]:
            cuts.append(begin)
            held = 0
        held, last = held + n, begin + tick
    return [*cuts, last]


def replay(rows: DataFrame, time: str, cuts: Sequence[int], inbox: str, after: Callable[[int, int], None]) -> None:
    """The replay clock: publishes the rows of one time slice after the other and lets the streams catch up.

    ``rows`` should be stored in time order (see ``write_trips``), so that a slice reads only its own row groups.
    """
    for start, end in zip(cuts, cuts[1:]):
        load_window(rows, start, end, time).write.mode("append").parquet(inbox)
        after(start, end)


def control_rows(spark: SparkSession, rows: Sequence[tuple[str, int, str]]) -> DataFrame:
    """(task, ts, control) as input rows of the monitor."""
    return spark.createDataFrame([(t, ts, 1 << 60, None, c) for t, ts, c in rows], INPUT)


def windowed_metrics_stream(errors: DataFrame, seconds: int = S.WINDOW_SECONDS, delay: str = "1 hour") -> DataFrame:
    """Metric points per task and tumbling window, for update mode; the watermark lets old windows leave the state.

    Append mode would hold back the last window of every task until a later row arrives.
    """
    timed = errors.withColumn("_at", F.timestamp_seconds("ts")).withWatermark("_at", delay)
    grouped = timed.groupBy("task", F.window("_at", f"{seconds} seconds").alias("w")).agg(
        F.avg("error").alias("mae"), F.count(F.lit(1)).alias("n_samples")
    )
    return grouped.select("task", F.unix_timestamp("w.end").alias("window_end"), "mae", "n_samples")


def latest_metrics(updates: DataFrame) -> DataFrame:
    """The last state of every (task, window) from the updates of :func:`windowed_metrics_stream`."""
    return updates.groupBy("task", "window_end").agg(
        F.max_by(F.struct("mae", "n_samples"), "batch").alias("m")
    ).select("task", "window_end", "m.mae", "m.n_samples")


class ReplayLoop:
    """Scoring, drift watch, retraining and hot swap of several tasks over one replay.

    ``score(rows, versions)`` gives (task, ts, seq, error) rows with the version in force; ``retrain(task, start,
    end)`` fits on that time range, registers the model and returns the new version, or raises.
    """

    def __init__(
        self, spark: SparkSession, folder: str, score: Callable[[DataFrame, dict], DataFrame],
        retrain: Callable[[str, int, int], str], versions: dict[str, str], settings: DetectorSettings,
        seconds: int = S.WINDOW_SECONDS,
    ) -> None:
        self.spark, self.folder, self.score, self.retrain = spark, folder, score, retrain
        self.versions, self.history = dict(versions), [(t, -1, v) for t, v in versions.items()]
        self.settings, self.seconds, self.handled, self.seen = settings, seconds, set(), -1
        self.failures: list[tuple[str, int, str]] = []
        self.inbox, self.sink, self.errors = f"{folder}/trips", f"{folder}/events", f"{folder}/errors"

    def run(self, trips: DataFrame, time: str, cuts: Sequence[int]) -> DataFrame:
        """Replays the trips slice by slice and returns all transition events."""
        control_rows(self.spark, []).write.mode("overwrite").parquet(self.errors)
        trips.limit(0).write.mode("overwrite").parquet(self.inbox)
        schema = trips.schema

        def score_batch(batch: DataFrame, number: int) -> None:
            scored = self.score(batch, self.versions).withColumn("control", F.lit(None).cast("string"))
            scored = scored.select("task", "ts", "seq", "error", "control")
            path = f"{self.errors}/scored-{number:09d}"
            if not is_written(self.spark, path):  # a batch that is run again has been seen by the monitors already
                scored.write.mode("overwrite").parquet(path)

        scoring = (
            self.spark.readStream.schema(schema).parquet(self.inbox).writeStream.foreachBatch(score_batch)
            .option("checkpointLocation", f"{self.folder}/scoring").start()
        )
        with state_partitions(self.spark, len(self.versions)):
            inbox = read_inbox(self.spark, self.errors, recursiveFileLookup="true")
            events = monitor_stream(inbox, self.settings, self.seconds)
            watch = append_sink(events, self.sink, f"{self.folder}/watch")

        def after(start: int, end: int) -> None:
            scoring.processAllAvailable()
            self._publish([(t, end, "tick") for t in self.versions])
            watch.processAllAvailable()
            self._retrain_due(end)
            watch.processAllAvailable()

        try:
            replay(trips, time, cuts, self.inbox, after)
        finally:
            scoring.stop()
            watch.stop()
        return read_sink(self.spark, self.sink, EVENTS)

    def _publish(self, rows: Sequence[tuple[str, int, str]]) -> None:
        control_rows(self.spark, rows).write.mode("append").parquet(self.errors)

    def _retrain_due(self, now: int) -> None:
        events = read_sink(self.spark, self.sink, EVENTS).where(F.col("batch") > self.seen)  # only the folders since then
        self.seen = max(self.seen, events.agg(F.max("batch")).first()[0] or 0)
        asked = events.where("event = 'retraining'").orderBy("ts", "task").collect()
        outcome = []
        for row in asked:
            if (row["task"], row["ts"]) in self.handled:
                continue
            self.handled.add((row["task"], row["ts"]))
            try:
                version = self.retrain(row["task"], row["range_start"], row["range_end"])
                self.versions[row["task"]] = version
                self.history.append((row["task"], now, version))
                outcome.append((row["task"], now, "swapped"))
            except Exception as reason:  # whatever stops one task's retraining must not stop the others
                self.failures.append((row["task"], now, repr(reason)))
                outcome.append((row["task"], now, "failed"))
        if outcome:
            self._publish(outcome)

    def version_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.history, "task string, valid_from long, version string")
