"""Detector parameters from the first errors of a task: for each detector the first candidate that stays silent."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens import settings as S
from fleetlens.operators.joins import lookup
from fleetlens.operators.ordered import OrderedRows
from fleetlens.streaming.detectors import Adwin, Kswin, PageHinkley, Spc, fires, longest_run, smooth


@dataclass(frozen=True)
class DetectorSettings:
    """Sample counts and candidate lists; smaller ones suit shorter error streams."""

    smoothing: int = S.SMOOTHING_SAMPLES
    grace: int = S.GRACE_SAMPLES
    calibration: int = S.CALIBRATION_SAMPLES
    consensus: int = S.CONSENSUS
    stride: int = S.HIGH_STRIDE
    adwin_deltas: Sequence[float] = S.ADWIN_DELTAS
    page_deltas: Sequence[float] = S.PAGE_HINKLEY_DELTAS
    page_thresholds: Sequence[float] = S.PAGE_HINKLEY_THRESHOLDS
    kswin_alphas: Sequence[float] = S.KSWIN_ALPHAS
    kswin_sizes: Sequence[tuple[int, int]] = S.KSWIN_SIZES
    spc_sigmas: Sequence[float] = S.SPC_SIGMAS
    spc_runs: Sequence[tuple[int, int]] = S.SPC_RUNS
    collect: dict = field(default_factory=lambda: dict(S.COLLECT_SECONDS))

    def candidates(self, detector: str) -> list[tuple[float, ...]]:
        """Candidates of a detector in the order they are tried."""
        if detector == "ADWIN":
            return [(d,) for d in self.adwin_deltas]
        if detector == "PAGE_HINKLEY":
            return [(d, t) for d in self.page_deltas for t in self.page_thresholds]
        if detector == "KSWIN":
            return [(a, w, s) for w, s in self.kswin_sizes for a in self.kswin_alphas]
        raise ValueError(f"no candidate list for {detector!r}")


def stays_silent(detector: str, candidate: Sequence[float], errors: np.ndarray, settings: DetectorSettings) -> bool:
    """Whether a candidate does not fire on the calibration errors of one task."""
    stride = S.HIGH_STRIDE if len(errors) > S.STRIDE_SWITCH else S.LOW_STRIDE
    if detector == "KSWIN":
        alpha, size, stat = candidate[0], int(candidate[1]), int(candidate[2])
        if len(errors) < size + stat:
            return False
        test = Kswin(alpha, size, stat)
        return not any([test.update(float(e)) and i * stride >= size for i, e in enumerate(errors[::stride])])
    smoothed = smooth(errors, settings.smoothing)
    if detector == "ADWIN":
        skipped = min(len(smoothed) - 1, settings.smoothing)
        return not fires(Adwin(candidate[0]), smoothed[skipped::stride])
    return not fires(PageHinkley(candidate[0], candidate[1]), smoothed)


def spc_limits(smoothed: np.ndarray, settings: DetectorSettings) -> tuple[float, int]:
    """Threshold and required run length of the first (sigma, run) pair that stays silent."""
    mean, std = float(smoothed.mean()), float(smoothed.std()) or S.SPC_MIN_STD
    for sigma in settings.spc_sigmas:
        limit = mean + sigma * std
        longest = longest_run(smoothed > limit)
        for base, factor in settings.spc_runs:
            needed = max(base, longest * factor)
            if longest < needed:
                return limit, needed
    return mean + settings.spc_sigmas[-1] * std, settings.spc_runs[-1][0]


def calibrated_detectors(errors: Sequence[float], settings: DetectorSettings) -> dict:
    """Fresh detectors for one task, as used by the streaming operator."""
    values = np.asarray(errors, dtype=float)
    chosen = {}
    for name in ("ADWIN", "PAGE_HINKLEY", "KSWIN"):
        options = settings.candidates(name)
        chosen[name] = next((c for c in options if stays_silent(name, c, values, settings)), options[-1])
    limit, needed = spc_limits(smooth(values, settings.smoothing), settings)
    alpha, size, stat = chosen["KSWIN"]
    return {
        "ADWIN": Adwin(chosen["ADWIN"][0], settings.grace),
        "PAGE_HINKLEY": PageHinkley(*chosen["PAGE_HINKLEY"], least=settings.grace),
        "KSWIN": Kswin(alpha, int(size), int(stat)),
        "SPC": Spc(limit, needed, settings.grace),
    }


def calibration_rows(errors: DataFrame, samples: int, **layout) -> DataFrame:
    """The first ``samples`` errors of every task in (ts, seq) order with their position.

    Rows are counted per task and window of time before, so that only those up to the window of the last are put in
    order, not the whole stream.
    """
    rows, at = errors.select("task", "ts", "seq", "error"), F.floor(F.col("ts") / S.WINDOW_SECONDS)
    counts = rows.groupBy("task", at.alias("_w")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("task").orderBy("_w").rowsBetween(Window.unboundedPreceding, -1))
    begun = counts.withColumn("_before", before).where(F.coalesce("_before", F.lit(0)) < samples)
    last = begun.groupBy("task").agg(F.max("_w").alias("_last"))
    early = lookup(rows, last, "task").where(F.coalesce(at <= F.col("_last"), F.lit(True))).drop("_last")
    laid = OrderedRows.lay_out(early, ["task"], ["ts", "seq"], **layout)
    return laid.numbered("position").rows().where(F.col("position") <= samples)


def choose_candidates(errors: DataFrame, detector: str, settings: DetectorSettings, **layout) -> DataFrame:
    """First silent candidate per task, or the last one.

    Every (task, candidate) is its own group, so all candidates of all tasks run in parallel. A group holds at most
    ``settings.calibration`` errors, whatever the length of the stream.
    """
    spark = errors.sparkSession
    options = settings.candidates(detector)
    first = calibration_rows(errors, settings.calibration, **layout)
    shared = asdict(settings)
    copies = first.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(len(options) - 1))))

    def judge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values("position")["error"].to_numpy()
        silent = stays_silent(detector, options[key[1]], values, DetectorSettings(**shared))
        return pd.DataFrame({"task": [key[0]], "candidate": [key[1]], "silent": [silent]})

    judged = copies.groupBy("task", "candidate").applyInPandas(judge, "task string, candidate int, silent boolean")
    picked = judged.groupBy("task").agg(
        F.coalesce(F.min(F.when(F.col("silent"), F.col("candidate"))), F.lit(len(options) - 1)).alias("candidate")
    )
    values = spark.createDataFrame(
        [(i, [float(v) for v in c]) for i, c in enumerate(options)], "candidate int, parameters array<double>"
    )
    return lookup(picked, values, "candidate", computed=False)


def spc_calibration(errors: DataFrame, settings: DetectorSettings, **layout) -> DataFrame:
    """Threshold and required run per task, in SQL operators; the rows per task are bounded by the calibration size."""
    first = calibration_rows(errors, settings.calibration, **layout)
    laid = OrderedRows.lay_out(first, ["task"], ["position"]).rolling_mean("error", settings.smoothing, "smoothed")
    mean, std = F.avg("smoothed"), F.stddev_pop("smoothed")
    whole = laid.rows().groupBy("task").agg(
        mean.alias("_mean"), F.when(std > 0, std).otherwise(F.lit(S.SPC_MIN_STD)).alias("_std")
    )
    rows = laid.with_rows(lookup(laid.df, whole, "task", "inner"))
    limits = {i: F.col("_mean") + F.col("_std") * s for i, s in enumerate(settings.spc_sigmas)}
    for i, limit in limits.items():
        rows = rows.run_lengths(F.col("smoothed") > limit, f"_run{i}")
    longest = rows.rows().groupBy("task").agg(
        F.max("_mean").alias("_mean"), F.max("_std").alias("_std"),
        *[F.max(f"_run{i}").alias(f"_run{i}") for i in limits],
    )
    options = []
    for i, sigma in enumerate(settings.spc_sigmas):
        for base, factor in settings.spc_runs:
            needed = F.greatest(F.lit(base), F.col(f"_run{i}") * factor)
            options.append(F.when(F.col(f"_run{i}") < needed, F.struct(
                (F.col("_mean") + F.col("_std") * sigma).alias("threshold"), needed.cast("long").alias("needed")
            )))
    last = F.struct(
        (F.col("_mean") + F.col("_std") * settings.spc_sigmas[-1]).alias("threshold"),
        F.lit(settings.spc_runs[-1][0]).cast("long").alias("needed"),
    )
    return longest.select("task", F.coalesce(*options, last).alias("c")).select("task", "c.threshold", "c.needed")


def chunks_of(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of one key and micro-batch in stream order."""
    return pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"], kind="stable")
