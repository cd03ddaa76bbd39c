"""Hyper-parameter search: a trial table, distributed cross-validation per trial, parameter importance."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions.columns import mixed_hash
from fleetlens.operators.joins import lookup

# Search ranges as (low, high, kind), kind one of int, int:<step>, float, log, or a list of choices.
BROAD = {
    "xgboost": {
        "n_estimators": (100, 1000, "int:100"), "max_depth": (3, 12, "int"), "learning_rate": (0.01, 0.3, "log"),
        "subsample": (0.6, 1.0, "float"), "colsample_bytree": (0.6, 1.0, "float"),
        "colsample_bynode": (0.6, 1.0, "float"), "min_child_weight": (1, 10, "int"), "gamma": (1e-8, 1.0, "log"),
        "reg_alpha": (1e-8, 1.0, "log"), "reg_lambda": (1e-8, 1.0, "log"),
    },
    "lightgbm": {
        "max_depth": (3, 12, "int"), "n_estimators": (100, 1000, "int:100"), "num_leaves": (20, 300, "leaves"),
        "learning_rate": (0.01, 0.3, "log"), "subsample": (0.6, 1.0, "float"),
        "colsample_bytree": (0.6, 1.0, "float"), "min_child_samples": (5, 100, "int"),
        "min_split_gain": (1e-8, 1.0, "log"), "reg_alpha": (1e-8, 1.0, "log"), "reg_lambda": (1e-8, 1.0, "log"),
    },
    "catboost": {
        "n_estimators": (100, 1000, "int:100"), "max_depth": (3, 12, "int"), "learning_rate": (0.01, 0.3, "log"),
        "subsample": (0.6, 1.0, "float"), "colsample_bylevel": (0.6, 1.0, "float"), "l2_leaf_reg": (1e-3, 10.0, "log"),
        "random_strength": (0.0, 10.0, "float"), "bagging_temperature": (0.0, 10.0, "float"),
        "border_count": [32, 64, 128, 255], "min_data_in_leaf": (1, 50, "int"),
    },
}
FOCUSED = {
    "xgboost": {
        "n_estimators": (900, 1200, "int:50"), "max_depth": (6, 9, "int"), "learning_rate": (0.02, 0.08, "log"),
        "subsample": (0.6, 0.9, "float"), "colsample_bytree": (0.6, 0.7, "float"),
        "colsample_bynode": (0.6, 0.85, "float"), "min_child_weight": (8, 12, "int"), "gamma": (1e-8, 0.6, "log"),
        "reg_alpha": (1e-8, 1.0, "log"), "reg_lambda": (1e-8, 1.0, "log"),
    },
    "lightgbm": {
        "max_depth": (10, 14, "int"), "n_estimators": (900, 1200, "int:50"), "num_leaves": (100, 170, "leaves"),
        "learning_rate": (0.02, 0.05, "log"), "subsample": (0.9, 1.0, "float"),
        "colsample_bytree": (0.65, 0.8, "float"), "min_child_samples": (35, 60, "int"),
        "min_split_gain": (1e-8, 0.5, "log"), "reg_alpha": (1e-8, 0.1, "log"), "reg_lambda": (1e-8, 0.1, "log"),
    },
    "catboost": {
        "n_estimators": (900, 1200, "int:50"), "max_depth": (8, 12, "int"), "learning_rate": (0.02, 0.08, "log"),
        "subsample": (0.9, 1.0, "float"), "colsample_bylevel": (0.8, 1.0, "float"), "l2_leaf_reg": (1e-8, 1.0, "log"),
        "random_strength": (0.0, 1.0, "float"), "bagging_temperature": (3.0, 5.5, "float"), "border_count": [255],
        "min_data_in_leaf": (30, 45, "int"),
    },
}
TRIALS = 100
FOCUSED_TRIALS = 50


def _draw(spec: tuple | list, share: Column, depth: Column) -> Column:
    """A value of one range from a number in [0, 1)."""
    if isinstance(spec, list):
        return F.get(F.array(*[F.lit(float(v)) for v in spec]), F.floor(share * len(spec)).cast("int"))
    low, high, kind = spec
    if kind == "log":
        return F.exp(F.log(F.lit(float(low))) + share * (F.log(F.lit(float(high))) - F.log(F.lit(float(low)))))
    if kind == "float":
        return F.lit(float(low)) + share * (high - low)
    if kind == "leaves":
        top = F.greatest(F.lit(low), F.least(F.lit(high), F.pow(F.lit(2.0), depth)))
        return F.lit(float(low)) + F.floor(share * (top - low + 1))
    step = int(kind[4:]) if ":" in kind else 1
    return F.lit(float(low)) + F.floor(share * ((high - low) // step + 1)) * step


def draw_trials(numbers: DataFrame, space: dict, seed: int = 42, column: str = "trial_number") -> DataFrame:
    """One seeded draw of every parameter per trial number; the upper end of ``num_leaves`` follows ``max_depth``."""
    drawn = numbers
    for i, (name, spec) in enumerate(sorted(space.items(), key=lambda item: item[0] != "max_depth")):
        share = mixed_hash(F.col(column) * 1009 + i * 7919, seed) / F.lit(2147483648.0)
        drawn = drawn.withColumn(name, _draw(spec, share, F.col("max_depth") if "max_depth" in drawn.columns else F.lit(0)))
    return drawn


def narrowed(trials: DataFrame, space: dict, share: int = 10) -> dict:
    """The space cut down to the ranges of the best tenth of the finished trials: the second, focused phase.

    Where the best trials agree on a value there is nothing to draw between; the range then goes to the next value tried
    on either side, or to the end of the space.
    """
    done = trials.where(F.col("mae").isNotNull())
    ranked = done.orderBy("mae", "trial_number").limit(max(1, done.count() // share))
    names = [n for n, spec in space.items() if not isinstance(spec, list) and spec[2] != "leaves"]
    row = ranked.agg(*[f(n) for n in names for f in (F.min, F.max)]).first()
    best = {n: (row[2 * i], row[2 * i + 1]) for i, n in enumerate(names) if row[2 * i] is not None}
    beside = done.agg(F.count(F.lit(1)), *[
        side for n, (low, high) in best.items()
        for side in (F.max(F.when(F.col(n) < low, F.col(n))), F.min(F.when(F.col(n) > high, F.col(n))))
    ]).first()
    cut = {}
    for i, (n, (low, high)) in enumerate(best.items()):
        if low == high:
            below, above = beside[1 + 2 * i], beside[2 + 2 * i]
            low, high = space[n][0] if below is None else below, space[n][1] if above is None else above
        cut[n] = (low, high, space[n][2])
    return {n: cut.get(n, spec) for n, spec in space.items()}


def spark_parameters(drawn: dict) -> dict:
    """The drawn parameters that Spark's boosted trees have, in their names."""
    names = {
        "n_estimators": ("maxIter", int), "max_depth": ("maxDepth", int), "learning_rate": ("stepSize", float),
        "subsample": ("subsamplingRate", float), "min_child_samples": ("minInstancesPerNode", int),
        "min_data_in_leaf": ("minInstancesPerNode", int), "min_split_gain": ("minInfoGain", float),
        "gamma": ("minInfoGain", float),
    }
    chosen = {names[n][0]: names[n][1](v) for n, v in drawn.items() if n in names}
    for n in ("colsample_bytree", "colsample_bylevel"):
        if n in drawn:
            chosen["featureSubsetStrategy"] = str(float(drawn[n]))
    return chosen


def run_search(
    trials: DataFrame, objective, parallel: int = 4, experiment: str = "tuning", model: str = "xgboost"
) -> DataFrame:
    """Evaluates every trial with ``objective(parameters) -> metrics``; trials run side by side as Spark jobs.

    The trial table is the search budget (some hundred rows). A trial that fails is recorded as FAIL.
    """
    spark: SparkSession = trials.sparkSession
    rows = [r.asDict() for r in trials.collect()]

    def one(row: dict) -> tuple:
        drawn = {k: float(v) for k, v in row.items() if k != "trial_number"}
        try:
            metrics = objective(drawn)
            return experiment, model, row["trial_number"], float(metrics["mae"]), "COMPLETE", drawn, metrics
        except Exception as e:  # noqa: BLE001
            return experiment, model, row["trial_number"], None, "FAIL", drawn, {"failure": float(len(json.dumps(str(e))))}

    with ThreadPoolExecutor(parallel) as pool:
        done = list(pool.map(one, rows))
    return spark.createDataFrame(
        done, "experiment string, model string, trial_number long, mae double, state string, "
        "params map<string,double>, user_attrs map<string,double>"
    )


def parameter_importance(trials: DataFrame, parameters: Sequence[str], by: str = "model", bins: int = 10) -> DataFrame:
    """Share of the variance of the MAE that each parameter explains alone: variance of its bin means.

    Bins have equal width; the shares of a model sum to one.
    """
    ranges = trials.groupBy(by).agg(
        F.avg("mae").alias("_mean"), F.var_pop("mae").alias("_var"),
        *[f(p).cast("double").alias(f"_{n}_{p}") for p in parameters for n, f in (("lo", F.min), ("hi", F.max))],
    )
    entries = F.explode(F.array(*[
        F.struct(
            F.lit(p).alias("parameter"), F.col(p).cast("double").alias("v"), F.col(f"_lo_{p}").alias("lo"),
            F.col(f"_hi_{p}").alias("hi"),
        )
        for p in parameters
    ]))
    rows = lookup(trials.select(by, "mae", *parameters), ranges, by, "inner")
    long_form = rows.select(by, "mae", "_mean", "_var", entries.alias("e"))
    share = F.coalesce(F.try_divide(F.col("e.v") - F.col("e.lo"), F.col("e.hi") - F.col("e.lo")), F.lit(0.0))
    cells = long_form.groupBy(
        by, F.col("e.parameter").alias("parameter"), F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin")
    ).agg(
        F.avg("mae").alias("_m"), F.count(F.lit(1)).alias("_n"), F.max("_mean").alias("_mean"), F.max("_var").alias("_var")
    )
    spread = F.sum(F.col("_n") * F.pow(F.col("_m") - F.col("_mean"), F.lit(2.0)))
    raw = cells.groupBy(by, "parameter").agg(
        F.try_divide(spread / F.sum("_n"), F.max("_var")).alias("_raw")
    )
    return raw.select(
        by, "parameter", F.try_divide(F.col("_raw"), F.sum("_raw").over(Window.partitionBy(by))).alias("importance")
    )
