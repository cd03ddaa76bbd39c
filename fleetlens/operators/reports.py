"""Tables behind the run reports: comparisons, convergence, histories, payloads and run facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens import settings as S
from fleetlens.operators.joins import lookup
from fleetlens.operators.ordered import OrderedRows


def convergence(trials: DataFrame, order: Sequence[str] = ("experiment", "trial_number"), **layout) -> DataFrame:
    """Best MAE so far per model over continuous trial numbers (0-based, experiments one after the other)."""
    laid = OrderedRows.lay_out(trials, ["model"], order, **layout)
    laid = laid.running(_at=("count", F.lit(1)), best_mae=("min", F.col("mae")))
    return laid.rows().withColumn("trial", F.col("_at") - 1).drop("_at")


def best_share(trials: DataFrame, share: int = 10, tiebreak: Sequence[str] = (), **layout) -> DataFrame:
    """The best tenth of the trials per model by MAE, at least one."""
    laid = OrderedRows.lay_out(trials, ["model"], ["mae", *tiebreak], **layout)
    laid = laid.numbered("_at").totals(_n=("count", F.lit(1)))
    limit = F.greatest(F.lit(1), F.floor(F.col("_n") / share))
    return laid.rows().where(F.col("_at") <= limit).drop("_at", "_n")


def best_trial(trials: DataFrame, by: Sequence[str] = ("model",), columns: Sequence[str] = ()) -> DataFrame:
    """The trial with the smallest MAE per study, the earliest on ties."""
    kept = F.struct("trial_number", "mae", *columns)
    best = trials.where(F.col("mae").isNotNull()).groupBy(*by).agg(
        F.min_by(kept, F.struct("mae", "trial_number")).alias("b")
    )
    return best.select(*by, "b.*")


def bounded_history(df: DataFrame, keys: Sequence[str], time: str, n: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rows per key with ``recency`` 1 for the newest; top-n is taken before the shuffle too."""
    order = Window.partitionBy(*keys or [F.lit(0)]).orderBy(F.col(time).desc(), *[F.col(c).desc() for c in tiebreak])
    return df.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= n)


def detection_window_start(
    metrics: DataFrame, stable_from: DataFrame, samples: int = S.SMOOTHING_SAMPLES
) -> DataFrame:
    """Per task the start of the shaded window: walking back from the newest point until ``samples`` are covered,
    not before the stable state began.

    ``metrics`` is the bounded history (at most 1000 points per task); ``stable_from`` has (task, start_timestamp).
    """
    points = lookup(metrics, stable_from, "task", "inner")
    points = points.where(F.col("window_end") >= F.col("start_timestamp"))
    back = Window.partitionBy("task").orderBy(F.col("window_end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    covered = points.withColumn("_covered", F.sum("n_samples").over(back))
    return covered.groupBy("task").agg(
        F.coalesce(
            F.max(F.when(F.col("_covered") >= samples, F.col("window_end"))), F.min("window_end")
        ).alias("window_start"),
        F.max("window_end").alias("window_stop"),
    )


def report_payload(metrics: DataFrame, notifications: DataFrame) -> DataFrame:
    """One JSON text per task from bounded histories (1000 points, 100 notifications); fuel errors in litres."""
    scaled = F.when(F.col("task") == "fuel", F.col("mae") / S.FUEL_MG_PER_LITRE).otherwise(F.col("mae"))
    recent = bounded_history(metrics, ["task"], "window_end", S.METRIC_HISTORY)
    points = recent.groupBy("task").agg(
        F.sort_array(F.collect_list(
            F.struct(F.col("window_end").alias("timestamp"), scaled.alias("mae"), "n_samples")
        )).alias("metric_points")
    )
    log = bounded_history(notifications, ["task"], "ts", S.NOTIFICATION_HISTORY, ["message"]).groupBy("task").agg(
        F.sort_array(F.collect_list(F.struct(F.col("ts").alias("timestamp"), "message", "level"))).alias("notifications")
    )
    both = points.join(log, "task", "full")
    return both.select("task", F.to_json(F.struct("notifications", "metric_points")).alias("payload"))


def run_facts(
    metrics: DataFrame, events: DataFrame, drift_start: int = S.SCENARIO_SECONDS
) -> DataFrame:
    """Per task: MAE before the drift, after it and after the swap, detection time and latency.

    ``events`` has a detection and a swap time per task (task, detected_at, swapped_at).
    """
    joined = lookup(metrics, events, "task")
    total = lambda condition: F.try_divide(
        F.sum(F.when(condition, F.col("mae") * F.col("n_samples"))), F.sum(F.when(condition, F.col("n_samples")))
    )
    end = F.col("window_end")
    before = end <= drift_start
    swapped = end > F.col("swapped_at")
    return joined.groupBy("task").agg(
        total(before).alias("mae_before"),
        total(~before & ~F.coalesce(swapped, F.lit(False))).alias("mae_drift"),
        total(swapped).alias("mae_after_swap"),
        F.max("detected_at").alias("detected_at"),
        (F.max("detected_at") - drift_start).alias("detection_latency"),
        F.max("swapped_at").alias("swapped_at"),
    )
