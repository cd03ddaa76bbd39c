"""Regressors: factory, training, prediction, evaluation, cross-validation, warm start and importances.

Spark ML does the fitting; everything around it - folds, errors, metrics, permutations - is DataFrame work. The three
boosted families of the feature search map to one distributed boosted-tree learner with family defaults.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.storagelevel import StorageLevel

from fleetlens import settings as S
from fleetlens.functions.columns import mixed_hash
from fleetlens.operators.ordered import numbered_by_hash
from fleetlens.operators.stats import evaluate
from fleetlens.schemas import METRICS
from fleetlens.session import shared_path, stage

# Defaults of the boosted families.
BOOSTED = {"maxIter": 100, "maxDepth": 7, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}

FACTORIES: dict[str, Callable] = {
    "linear": LinearRegression,
    "xgboost": GBTRegressor,
    "lightgbm": GBTRegressor,
    "catboost": GBTRegressor,
    "forest": RandomForestRegressor,
    "tree": DecisionTreeRegressor,
}


def create_model(kind: str, features: Sequence[str], target: str, seed: int = 42, **parameters) -> Pipeline:
    """An untrained pipeline of assembler and regressor; boosted kinds minimise the absolute error."""
    if kind not in FACTORIES:
        raise ValueError(f"unknown model {kind!r}; known: {', '.join(FACTORIES)}")
    settings = {"featuresCol": "features", "labelCol": target}
    if FACTORIES[kind] is GBTRegressor:
        settings.update(BOOSTED, lossType="absolute", seed=seed)
    elif kind != "linear":
        settings.update(seed=seed)
    regressor = FACTORIES[kind](**{**settings, **parameters})
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), regressor])


def fit_pipeline(pipeline: Pipeline, rows: DataFrame) -> PipelineModel:
    """Fits assembler and regressor; learners that read the rows more than once read assembled vectors from a cache.

    Linear least squares sums up its normal equations in one pass and needs none. Rows may come with the vector of the
    same columns already (:func:`assembled`).
    """
    assembler, regressor = pipeline.getStages()
    ready = assembler.getOutputCol() in rows.columns
    vectors = (rows if ready else assembler.transform(rows)).select(assembler.getOutputCol(), regressor.getLabelCol())
    held = not (ready or isinstance(regressor, LinearRegression))
    if held:
        vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return PipelineModel([assembler, regressor.fit(vectors)])
    finally:
        if held:
            vectors.unpersist()


def assembled(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Vector and target of the rows, to be cached for several models on the same columns."""
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(rows).select("features", target)


def model_features(model: PipelineModel | WarmStarted) -> list[str]:
    return model.stages[0].getInputCols() if hasattr(model, "stages") else model_features(model.base)


def tree_count(model: PipelineModel | WarmStarted) -> int:
    """Boosted trees in the model; 0 for other kinds."""
    if not hasattr(model, "stages"):
        return tree_count(model.base) + model.n_new_trees
    return len(getattr(model.stages[-1], "treeWeights", ()))


def train(model: Pipeline, rows: DataFrame) -> tuple[PipelineModel, float]:
    """The fitted pipeline and its wall time in seconds."""
    start = time.perf_counter()
    fitted = model.fit(rows)
    return fitted, time.perf_counter() - start


class TransformedTarget:
    """Trains on a transformed target and predicts on the original scale."""

    def __init__(self, kind: str, features: Sequence[str], target: str, transform, seed: int = 42, **parameters) -> None:
        self.target, self.transform = target, transform
        self.pipeline = create_model(kind, features, "_moved", seed, **parameters)
        self.model: PipelineModel | None = None

    def fit(self, rows: DataFrame) -> TransformedTarget:
        fitted = self.transform.fit(rows, self.target)
        self.model = fit_pipeline(self.pipeline, rows.withColumn("_moved", fitted.forward(F.col(self.target))))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        scored = predict(self.model, rows)
        return scored.withColumn("prediction", self.transform.inverse(F.col("prediction")))


class WarmStarted:
    """A boosted model continued on new data: base prediction plus trees fitted to what the base leaves over."""

    def __init__(self, base: PipelineModel, correction: PipelineModel, n_new_trees: int) -> None:
        self.base, self.correction, self.n_new_trees = base, correction, n_new_trees

    def predict(self, rows: DataFrame) -> DataFrame:
        scored = predict(self.base, rows).withColumnRenamed("prediction", "_base")
        both = self.correction.transform(scored).withColumn("prediction", F.col("_base") + F.col("prediction"))
        return both.drop("_base", "features")


def new_trees(base_trees: int, n_samples: int, n_training: int, shrink: float = S.SHRINK_FACTOR) -> int:
    """Trees to add: the base's number scaled by the share of new data and a shrink factor, at least ten."""
    return max(S.MIN_NEW_TREES, int(base_trees * (n_samples / n_training) * shrink))


def new_trees_column(base_trees: str | Column, n_samples: str | Column, n_training: str | Column, shrink: float = S.SHRINK_FACTOR) -> Column:
    ratio = F.col(n_samples) / F.col(n_training) if isinstance(n_samples, str) else n_samples / n_training
    base = F.col(base_trees) if isinstance(base_trees, str) else base_trees
    return F.greatest(F.lit(S.MIN_NEW_TREES), F.floor(base * ratio * shrink)).cast("long")


def retrain(
    base: PipelineModel | WarmStarted, kind: str, rows: DataFrame, target: str, n_training: int,
    shrink: float = S.SHRINK_FACTOR, **parameters,
) -> PipelineModel | WarmStarted:
    """Warm start on the rows of a window; a linear model is simply refitted, an empty window is an error."""
    features = model_features(base)
    n = rows.count()
    if not n:
        raise ValueError("no rows to retrain on")
    if not tree_count(base):
        return create_model(kind, features, target, **parameters).fit(rows)
    budget = new_trees(tree_count(base), n, n_training, shrink)
    left = predict(base, rows).withColumn("_left", F.col(target) - F.col("prediction")).drop("prediction")
    correction = create_model(kind, features, "_left", **{**parameters, "maxIter": budget}).fit(left)
    return WarmStarted(base, correction, budget)


def predict(model, rows: DataFrame) -> DataFrame:
    """Rows with ``prediction``; truth and prediction stay on one row. Rows may hold the assembled vector already."""
    if hasattr(model, "predict"):
        return model.predict(rows)
    scored = model.stages[-1].transform(rows) if "features" in rows.columns else model.transform(rows)
    return scored.drop("features")


def hold_out(
    kinds: Sequence[str], train_rows: DataFrame, test_rows: DataFrame, features: Sequence[str], target: str,
    experiment: str, parameters: dict | None = None, base: dict | None = None, n_training: int | None = None,
) -> DataFrame:
    """Train on one set and evaluate on another, one metric row per model; with ``base`` models as a warm start."""
    spark = train_rows.sparkSession
    rows = []
    if not base:
        train_rows = assembled(train_rows, features, target)
        test_rows = assembled(test_rows, features, target)
    held = [df.persist(StorageLevel.MEMORY_AND_DISK) for df in (train_rows, test_rows)] if len(kinds) > 1 else []
    try:
        for kind in kinds:
            settings = (parameters or {}).get(kind, {})
            start = time.perf_counter()
            if base:
                model = retrain(base[kind], kind, train_rows, target, n_training or train_rows.count(), **settings)
            else:
                model = fit_pipeline(create_model(kind, features, target, **settings), train_rows)
            fitted = time.perf_counter()
            predicted = stage(predict(model, test_rows).select(target, "prediction"), "predicted")
            at = time.perf_counter()
            scored = evaluate(predicted, target, "prediction").first()
            rows.append((experiment, kind, fitted - start, at - fitted, time.perf_counter() - at, scored["mae"], scored["mape"]))
    finally:
        for df in held:
            df.unpersist()
    return spark.createDataFrame(rows, "experiment string, model string, " + ", ".join(f"{m} double" for m in METRICS))


class FoldParts:
    """Rows with a ``fold`` column, written once with a folder per fold, for any number of runs over the same folds.

    A part is a union of whole folders. Each folder is split by itself, so the parts have more and smaller tasks than
    one scan of all folders, and none reads a fold only to drop it. Where every run uses the same columns, ``columns``
    and ``target`` let the runs share one assembled and cached copy of each part; :meth:`release` drops them.
    """

    def __init__(self, folded: DataFrame, columns: Sequence[str] = (), target: str | None = None) -> None:
        self.spark, self.columns, self.held = folded.sparkSession, list(columns), {}
        self.path = shared_path(self.spark, "folded")
        folded.write.partitionBy("fold").parquet(self.path)
        self.schema = [f for f in folded.schema.fields if f.name != "fold"]
        whole = self.spark.read.parquet(self.path)
        self.folds = sorted(r[0] for r in whole.select("fold").distinct().collect())
        if self.columns:
            for fold in self.folds:
                self.held[fold] = assembled(self.part(fold), self.columns, target).persist(StorageLevel.MEMORY_AND_DISK)

    def part(self, *folds: int) -> DataFrame:
        """The rows of some folds."""
        parts = [self.spark.read.schema(StructType(self.schema)).parquet(f"{self.path}/fold={f}") for f in folds]
        return reduce(DataFrame.unionByName, parts)

    def ready(self, *folds: int) -> DataFrame:
        """Cached vectors and targets of some folds."""
        return reduce(DataFrame.unionByName, [self.held[f] for f in folds])

    def release(self) -> None:
        for df in self.held.values():
            df.unpersist()


def cross_validate(
    folded: DataFrame | FoldParts,
    kinds: Sequence[str],
    target: str,
    experiment: str,
    prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]] | None = None,
    features: Callable[[DataFrame], list[str]] | Sequence[str] = (),
    parameters: dict | None = None,
    wrap=None,
    inspect: Callable[[str, int, object, DataFrame, list[str]], DataFrame] | None = None,
) -> tuple[DataFrame, list[DataFrame]]:
    """Metric rows per (model, fold) of rows with a ``fold`` column, or of their :class:`FoldParts`.

    ``prepare`` is fitted on the training part of each fold and applied to both parts, so nothing leaks. ``wrap`` makes
    a target transform; ``inspect`` may add an importance table per model and fold. The folds are written once and
    read back for every part, so the assignment is neither computed again nor lost with an executor. Vectors of a part
    are computed from its folders in each of the few passes: a cached copy is many times as large as the rows it comes
    from, fills the executors' heap, and boosted trees keep a binned copy of their own.
    """
    parts = folded if isinstance(folded, FoldParts) else FoldParts(folded)
    rows, inspected = [], []
    for fold in parts.folds:
        others = [f for f in parts.folds if f != fold]
        if parts.held:
            columns, learn, check = parts.columns, parts.ready(*others), parts.ready(fold)
        else:
            learn, check = parts.part(*others), parts.part(fold)
            if prepare:
                apply = prepare(learn)
                learn, check = apply(learn), apply(check)
            columns = features(learn) if callable(features) else list(features)
            learn, check = assembled(learn, columns, target), assembled(check, columns, target)
        for kind in kinds:
            settings = (parameters or {}).get(kind, {})
            start = time.perf_counter()
            if wrap:
                model = TransformedTarget(kind, columns, target, wrap(), **settings).fit(learn)
            else:
                model = fit_pipeline(create_model(kind, columns, target, **settings), learn)
            fitted = time.perf_counter()
            predicted = stage(predict(model, check).select(target, "prediction"), "predicted")
            at = time.perf_counter()
            scored = evaluate(predicted, target, "prediction").first()
            done = time.perf_counter()
            rows.append((experiment, kind, int(fold), fitted - start, at - fitted, done - at, scored["mae"], scored["mape"]))
            if inspect:
                inspected.append(inspect(kind, int(fold), model, check, columns))
    schema = "experiment string, model string, fold int, " + ", ".join(f"{m} double" for m in METRICS)
    return parts.spark.createDataFrame(rows, schema), inspected


def _gains(model: PipelineModel | WarmStarted) -> np.ndarray:
    """Shares per feature; a warm-started model weighs base and correction by their trees."""
    if isinstance(model, WarmStarted):
        return (_gains(model.base) * tree_count(model.base) + _gains(model.correction) * model.n_new_trees) / tree_count(model)
    last = model.stages[-1]
    return np.abs(last.coefficients.toArray() if isinstance(last, LinearRegressionModel) else last.featureImportances.toArray())


def gain_importance(model: PipelineModel | WarmStarted, spark) -> DataFrame:
    """(feature, importance, percentage) from the splits of a tree model, or |coefficient| of a linear one."""
    values = _gains(model)
    total = values.sum()
    shares = values / total * 100 if total > 0 else np.zeros_like(values)
    rows = [(f, float(v), float(p)) for f, v, p in zip(model_features(model), values, shares)]
    return spark.createDataFrame(rows, "feature string, importance double, percentage double")


def permutation_importance(
    model, rows: DataFrame, target: str, features: Sequence[str], row_id: Sequence[str],
    repeats: int = S.PERMUTATION_REPEATS, seed: int = 42, **layout,
) -> DataFrame:
    """Rise of the MAE when one feature is shuffled, averaged over the repeats.

    Rows get positions in hashed order. A repeat moves position i to (a * i + b) mod n with a coprime to n, a
    bijection, so the shuffled values arrive by one equi-join on positions - no sort, no collected group, no hot key.
    Donors travel to the positions that take their values, once a repeat and with the features alone; the rows that
    take them move once. All features share the join; each is swapped in on its own before scoring.
    """
    hashed = rows.select(*row_id, target, *features).withColumn("_mix", mixed_hash(row_id[0], seed))
    placed = numbered_by_hash(hashed, [], "_mix", row_id, "_at", **layout)
    placed = stage(placed.select(target, *features, (F.col("_at") - 1).alias("_at")), "placed")
    n = placed.count()
    shifts = []
    for r in range(repeats):
        a = (1_000_003 * (r + 1) + seed) % n or 1
        while math.gcd(a, n) != 1:
            a += 1
        back = pow(a, -1, n)
        shifts.append((r, back, -back * (7_919 * (r + 1) * (seed + 1)) % n))
    homes = F.explode(F.array(*[
        F.struct(F.lit(r).alias("r"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
        for r, a, b in shifts
    ]))
    to = ((F.col("_d.a").cast("decimal(38,0)") * F.col("_at") + F.col("_d.b")) % n).cast("long")
    donors = placed.select("_at", *features, homes.alias("_d")).select(
        to.alias("_at"), F.col("_d.r").alias("_r"), F.struct(*features).alias("_other")
    )
    joined = placed.join(donors, "_at").withColumn("_f", F.explode(F.array(*[F.lit(f) for f in features])))
    swapped = joined.withColumns(
        {f: F.when(F.col("_f") == f, F.col(f"_other.{f}")).otherwise(F.col(f)) for f in features}
    )
    scored = predict(model, swapped.select(*features, target, "_f", "_r"))
    shuffled = scored.groupBy("_f", "_r").agg(F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("mae"))
    base = predict(model, rows).agg(F.avg(F.abs(F.col(target) - F.col("prediction")))).first()[0]
    return shuffled.groupBy(F.col("_f").alias("feature")).agg((F.avg("mae") - F.lit(base)).alias("importance"))


def linear_shap(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Mean |coefficient * (x - mean x)| per feature: exact for a linear model, two aggregates."""
    features, beta = model_features(model), model.stages[-1].coefficients.toArray()
    means = rows.agg(*[F.avg(f).alias(f) for f in features]).first()
    sums = rows.agg(*[F.avg(F.abs((F.col(f) - means[f]) * float(b))).alias(f) for f, b in zip(features, beta)]).first()
    return _importance_rows(rows, {f: float(sums[f]) for f in features})


def _importance_rows(rows: DataFrame, values: dict[str, float]) -> DataFrame:
    total = sum(values.values())
    table = [(f, v, v / total * 100 if total > 0 else 0.0) for f, v in values.items()]
    return rows.sparkSession.createDataFrame(table, "feature string, importance double, percentage double")


def _paths(tree) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """Leaves of a tree as (value, [(feature, low, high, share)]): one interval and cover share per feature."""
    def walk(node, conditions: dict[int, tuple[float, float, float]]):
        if node.numDescendants() == 0:
            return [(node.prediction(), [(f, *c) for f, c in conditions.items()])]
        f, cut = node.split().featureIndex(), node.split().threshold()
        cover = node.impurityStats().count()
        leaves = []
        for child, side in ((node.leftChild(), 0), (node.rightChild(), 1)):
            low, high, share = conditions.get(f, (-math.inf, math.inf, 1.0))
            low, high = (low, min(high, cut)) if side == 0 else (max(low, cut), high)
            part = child.impurityStats().count() / cover
            leaves += walk(child, {**conditions, f: (low, high, share * part)})
        return leaves

    return walk(tree, {})


def ensemble_paths(model) -> list[tuple[float, list]]:
    """All weighted leaf paths of a fitted Spark tree model."""
    java = model._java_obj
    if not hasattr(model, "treeWeights"):
        return _paths(java.rootNode())
    leaves = []
    for tree, weight in zip(java.trees(), model.treeWeights):
        leaves += [(value * weight, conditions) for value, conditions in _paths(tree.rootNode())]
    return leaves


def path_shap(paths: list[tuple[float, list]], x: np.ndarray) -> np.ndarray:
    """SHAP values of the rows of ``x`` for an ensemble given by its leaf paths.

    A leaf is a product game: feature j contributes o_j (1 inside its interval, else 0) when known and its cover
    share z_j when not. The Shapley value of such a game is an integral over t in [0, 1] of the product of the other
    features' t * o + (1 - t) * z, which Gauss-Legendre quadrature evaluates exactly for these polynomials.
    """
    values = np.zeros(x.shape)
    for leaf, conditions in paths:
        if not conditions:
            continue
        nodes, weights = np.polynomial.legendre.leggauss(max(1, (len(conditions) + 1) // 2))
        t, w = (nodes + 1) / 2, weights / 2
        known = np.stack([(x[:, f] > low) & (x[:, f] <= high) for f, low, high, _ in conditions], axis=1).astype(float)
        share = np.array([z for *_, z in conditions])
        mixed = t[:, None, None] * known + (1 - t)[:, None, None] * share
        for j, (f, *_) in enumerate(conditions):
            rest = np.prod(np.delete(mixed, j, axis=2), axis=2)
            values[:, f] += leaf * (known[:, j] - share[j]) * (w @ rest)
    return values


def tree_shap(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Mean |SHAP value| per feature of a tree model: partial sums per Arrow batch, one aggregate at the end.

    What travels to the tasks is the model's leaf table; it grows with the trees, not with the rows.
    """
    features = model_features(model)
    paths = ensemble_paths(model.stages[-1])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                total = np.abs(path_shap(paths, frame[features].to_numpy(dtype=float))).sum(axis=0)
                yield pd.DataFrame({"feature": features, "total": total, "n": len(frame)})

    parts = rows.select(*features).mapInPandas(batches, "feature string, total double, n long")
    mean = parts.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("importance"))
    return _importance_rows(rows, {r["feature"]: r["importance"] for r in mean.collect()})


def vector_columns(rows: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """A vector column spread over named columns."""
    spread = vector_to_array(vector)
    return rows.withColumns({n: F.get(spread, F.lit(i)) for i, n in enumerate(names)})
