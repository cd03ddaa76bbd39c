"""Batch twins of the streaming steps: the same results from a stored error table, in SQL operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import settings as S
from fleetlens.functions.columns import absolute_error
from fleetlens.operators.joins import lookup
from fleetlens.operators.ordered import OrderedRows
from fleetlens.streaming.detectors import Adwin, ks_p_values, sliding_distances

KS_BLOCK = 4096  # positions of a block of sliding tests, more where windows are larger


def window_of(ts: str | Column = "ts", seconds: int = S.WINDOW_SECONDS) -> tuple[Column, Column]:
    """Start and end of the tumbling window that holds ``ts``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    start = F.floor(ts / seconds) * seconds
    return start, start + seconds


def error_points(scored: DataFrame, truth: str, prediction: str, log_scale: bool = False) -> DataFrame:
    """Adds the absolute error; truth and prediction sit on one row and are never matched by position."""
    return scored.withColumn("error", absolute_error(truth, prediction, log_scale))


def window_metrics(errors: DataFrame, seconds: int = S.WINDOW_SECONDS) -> DataFrame:
    """One metric point per task and non-empty window, stamped with the window's end."""
    return errors.groupBy("task", window_of("ts", seconds)[1].alias("window_end")).agg(
        F.avg("error").alias("mae"), F.count(F.lit(1)).alias("n_samples")
    )


def rolling_errors(errors: DataFrame, samples: int = S.SMOOTHING_SAMPLES, **layout) -> DataFrame:
    laid = OrderedRows.lay_out(errors, ["task"], ["ts", "seq"], **layout)
    return laid.rolling_mean("error", samples, "smoothed").rows()


def smoothed_errors(errors: DataFrame, samples: int = S.SMOOTHING_SAMPLES, skip: int = 0, **layout) -> DataFrame:
    """``task, ts, seq, error``: what SPC and Page-Hinkley watch, the rolling mean, after the first ``skip`` (calibration) errors."""
    laid = OrderedRows.lay_out(errors.select("task", "ts", "seq", "error"), ["task"], ["ts", "seq"], **layout)
    laid = laid.rolling_mean("error", samples, "smoothed").numbered("_n")
    return laid.rows().where(F.col("_n") > skip).select("task", "ts", "seq", F.col("smoothed").alias("error"))


def longest_runs(errors: DataFrame, threshold: Column, **layout) -> DataFrame:
    """Longest run of errors above the threshold per task."""
    laid = OrderedRows.lay_out(errors, ["task"], ["ts", "seq"], **layout)
    runs = laid.run_lengths(F.col("error") > threshold, "run").rows()
    return runs.groupBy("task").agg(F.max("run").alias("longest_run"))


def first_spc_fire(errors: DataFrame, limits: DataFrame, grace: int = S.GRACE_SAMPLES, **layout) -> DataFrame:
    """First point per task whose run of values above the threshold is long enough; ``limits`` (task, threshold, needed)."""
    laid = OrderedRows.lay_out(errors, ["task"], ["ts", "seq"], **layout).numbered("position")
    laid = laid.with_rows(lookup(laid.df, limits, "task", "inner").where(F.col("position") > grace))
    runs = laid.run_lengths(F.col("error") > F.col("threshold"), "run").rows().where(F.col("run") >= F.col("needed"))
    return runs.groupBy("task").agg(F.min(F.struct("position", "ts")).alias("f")).select("task", "f.position", "f.ts")


def first_page_hinkley_fire(
    errors: DataFrame, delta: float, threshold: float, least: int = S.GRACE_SAMPLES, **layout
) -> DataFrame:
    """First point per task where the two-sided test without forgetting fires: prefix sums and running extremes."""
    laid = OrderedRows.lay_out(errors.select("task", "ts", "seq", "error"), ["task"], ["ts", "seq"], **layout)
    laid = laid.running(position=("count", F.lit(1)), _sum=("sum", F.col("error")))
    laid = laid.with_rows(laid.df.withColumn("_gap", F.col("error") - F.col("_sum") / F.col("position")))
    laid = laid.running(_up=("sum", F.col("_gap") - delta), _down=("sum", F.col("_gap") + delta))
    laid = laid.running(_low=("min", F.col("_up")), _high=("max", F.col("_down")))
    statistic = F.greatest(F.col("_up") - F.col("_low"), F.col("_high") - F.col("_down"))
    fired = laid.rows().where((F.col("position") >= least) & (statistic > threshold))
    return fired.groupBy("task").agg(F.min(F.struct("position", "ts")).alias("f")).select("task", "f.position", "f.ts")


def first_page_hinkley_fires(
    errors: DataFrame, limits: DataFrame, least: int = S.GRACE_SAMPLES, keep: float = S.PAGE_HINKLEY_KEEP, **layout
) -> DataFrame:
    """First point per task where the two-sided test with forgetting fires; ``limits`` (task, delta, threshold).

    The two sums decay by ``keep`` a row: scans over affine maps, see :meth:`OrderedRows.decayed_sums`.
    """
    laid = OrderedRows.lay_out(errors.select("task", "ts", "seq", "error"), ["task"], ["ts", "seq"], **layout)
    laid = laid.running(position=("count", F.lit(1)), _sum=("sum", F.col("error")))
    rows = lookup(laid.df, limits, "task", "inner").withColumn("_gap", F.col("error") - F.col("_sum") / F.col("position"))
    laid = laid.with_rows(rows).decayed_sums(keep, _up=F.col("_gap") - F.col("delta"), _down=F.col("_gap") + F.col("delta"))
    laid = laid.running(_low=("min", F.col("_up")), _high=("max", F.col("_down")))
    statistic = F.greatest(F.col("_up") - F.col("_low"), F.col("_high") - F.col("_down"))
    fired = laid.rows().where((F.col("position") >= least) & (statistic > F.col("threshold")))
    return fired.groupBy("task").agg(F.min(F.struct("position", "ts")).alias("f")).select("task", "f.position", "f.ts")


KS_POINTS = "task string, position long, ts long, ks double, p_value double"


def sliding_ks(errors: DataFrame, limits: DataFrame, stride: int = S.HIGH_STRIDE, **layout) -> DataFrame:
    """The sliding two-sample test of every ``stride``-th error: the newest ``stat`` values against the ``size - stat``
    before them, from the moment the window is full.

    ``limits`` (task, alpha, size, stat) has a row per task. Rows go to blocks of positions with the block before as
    their halo, so any number of tasks works on one stream, and a group holds twice the largest window at most. Within a
    block the values are sorted once for many windows. The whole older part takes part, not a sample of it, so that the
    result does not hang on a random choice. ``position`` counts all errors of a task from 1.
    """
    widest = limits.agg(F.max("size")).first()[0]
    if widest is None:
        return errors.sparkSession.createDataFrame([], KS_POINTS)
    laid = OrderedRows.lay_out(errors.select("task", "ts", "seq", "error"), ["task"], ["ts", "seq"], **layout)
    numbered = laid.numbered("position")
    taken = numbered.with_rows(numbered.df.where((F.col("position") - 1) % stride == 0))
    rows = lookup(taken.blocks(max(int(widest), KS_BLOCK), "_n", "_block", "_home"), limits, "task", "inner")

    def test(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        column = lambda name: table[name].to_numpy()
        size, stat = int(table["size"][0].as_py()), int(table["stat"][0].as_py())
        numbers, own = column("_n"), np.asarray(table["_home"])
        ends = np.flatnonzero(own & (numbers >= size - 1))
        distances = sliding_distances(column("error"), ends, size, stat)
        p = ks_p_values(distances, size - stat, stat)
        found = table.select(["task", "position", "ts"]).take(pa.array(ends))
        return found.append_column("ks", pa.array(distances, pa.float64())).append_column("p_value", pa.array(p, pa.float64()))

    return rows.groupBy("task", "_block").applyInArrow(test, KS_POINTS)


def first_kswin_fire(errors: DataFrame, limits: DataFrame, stride: int = S.HIGH_STRIDE, **layout) -> DataFrame:
    """First point per task where the sliding test fires: distance above ``KSWIN_LEAST``, p-value of alpha at most."""
    tested = lookup(sliding_ks(errors, limits, stride, **layout), limits.select("task", "alpha"), "task", "inner")
    fired = tested.where((F.col("ks") > S.KSWIN_LEAST) & (F.col("p_value") <= F.col("alpha")))
    first = fired.groupBy("task").agg(F.min(F.struct("position", "ts", "ks", "p_value")).alias("f"))
    return first.select("task", "f.position", "f.ts", "f.ks", "f.p_value")


def first_adwin_fire(errors: DataFrame, limits: DataFrame, grace: int = S.GRACE_SAMPLES) -> DataFrame:
    """First point per task at which adaptive windowing fires after the grace period; ``limits`` (task, delta).

    The window's next state hangs on its last, so one task's errors pass through one Spark task in their order. They
    stream through it: what is held is one batch and the buckets, whose number grows with the logarithm of the rows.
    """
    rows = lookup(errors.select("task", "ts", "seq", "error"), limits.select("task", "delta"), "task", "inner")
    dealt = rows.repartition("task").sortWithinPartitions("task", "ts", "seq").select("task", "ts", "error", "delta")
    schema = pa.schema([("task", pa.string()), ("position", pa.int64()), ("ts", pa.int64())])

    def watch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, detector, position, fired = None, None, 0, False
        for batch in batches:
            if fired and batch.num_rows and batch["task"][-1].as_py() == batch["task"][0].as_py() == task:
                continue  # the task has fired, and the batch holds no other one
            found = []
            for name, ts, error, delta in zip(*(c.to_pylist() for c in batch.columns)):
                if detector is None or name != task:
                    task, detector, position, fired = name, Adwin(delta, grace), 0, False
                position += 1
                if not fired and detector.update(error):
                    fired = True
                    found.append((name, position, ts))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return dealt.mapInArrow(watch, "task string, position long, ts long")


def ks_two_sample(
    errors: DataFrame, older: Column, recent: Column, stride: int = S.HIGH_STRIDE, **layout
) -> DataFrame:
    """Kolmogorov-Smirnov distance per task between two parts of every ``stride``-th error.

    Equal values are counted together first; then both distribution functions run over the distinct values.
    """
    laid = OrderedRows.lay_out(errors.select("task", "ts", "seq", "error"), ["task"], ["ts", "seq"], **layout)
    taken = laid.numbered("_at").rows().where((F.col("_at") - 1) % stride == 0)
    counted = taken.groupBy("task", "error").agg(
        F.sum(older.cast("int")).alias("_a"), F.sum(recent.cast("int")).alias("_b")
    )
    scan = OrderedRows.lay_out(counted, ["task"], ["error"], **layout)
    scan = scan.running(_fa=("sum", F.col("_a")), _fb=("sum", F.col("_b")))
    scan = scan.totals(_na=("sum", F.col("_a")), _nb=("sum", F.col("_b")))
    gap = F.abs(F.try_divide(F.col("_fa").cast("double"), F.col("_na")) - F.try_divide(F.col("_fb").cast("double"), F.col("_nb")))
    return scan.rows().groupBy("task").agg(
        F.max(gap).alias("ks"), F.max("_na").alias("n_older"), F.max("_nb").alias("n_recent")
    )


def consensus(fires: DataFrame, needed: int = S.CONSENSUS) -> DataFrame:
    """The moment per task at which ``needed`` of the detectors have fired; ``fires`` (task, detector, ts)."""
    first = fires.groupBy("task", "detector").agg(F.min("ts").alias("ts"))
    times = first.groupBy("task").agg(F.sort_array(F.collect_list("ts")).alias("t"))
    return times.where(F.size("t") >= needed).select("task", F.get("t", F.lit(needed - 1)).alias("ts"))


def collection_windows(
    detections: DataFrame, collect_seconds: dict, default: int = S.COLLECT_SECONDS["eta"], seconds: int = S.WINDOW_SECONDS
) -> DataFrame:
    """Retraining data range per task: from the end of the window of the detection, for the task's collection time."""
    need = F.lit(default)
    for task, s in collect_seconds.items():
        need = F.when(F.col("task") == task, F.lit(s)).otherwise(need)
    start = window_of("ts", seconds)[1]
    last = start + F.ceil(need / seconds) * seconds
    return detections.select("task", start.alias("retrain_start"), last.alias("retrain_end"))


def clock_notifications(last: int = S.REPLAY_SECONDS, middle: int = S.SCENARIO_SECONDS) -> list[tuple[int, str, str]]:
    """The notifications of the replay clock itself."""
    # The texts shown.
    return [
        (0, "First day started with normal conditions", "INFO"),
        (middle, "Second day started with rain conditions", "INFO"),
        (last, "End of simulation reached with all data processed", "INFO"),
    ]


# Notification text and level per transition.
TRANSITIONS = {
    "calibrated": ("Drift detector calibration completed", "SUCCESS"),
    "drifted": ("Concept drift detected", "DANGER"),
    "retraining": ("Model retraining initiated", "WARNING"),
    "swapped": ("Retrained model swapped", "SUCCESS"),
    "failed": ("Model retraining failed", "DANGER"),
    "recalibration_failed": ("Drift detector recalibration failed", "DANGER"),
}


def notifications(events: DataFrame) -> DataFrame:
    """Notification rows for the transition events (task, ts, event); other events have none."""
    text, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (message, shade) in TRANSITIONS.items():
        text = F.when(F.col("event") == name, F.lit(message)).otherwise(text)
        level = F.when(F.col("event") == name, F.lit(shade)).otherwise(level)
    return events.select("task", "ts", text.alias("message"), level.alias("level")).where("message IS NOT NULL")
