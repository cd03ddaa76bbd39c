"""Models as rows: all tasks and versions in one table, fitted in one aggregate and scored in one pass over the rows.

A model is a sum of parts, one row each: ``intercept + coefficients . x + weight * tree(x)``. A linear model is one part
without a tree, a boosted one has a part for every tree, a continued one has those of its base and of its corrections. The
number of tasks is a number of rows then, not of scans, plan branches or fits in the driver's loop.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.joins import is_small, lookup
from fleetlens.session import stage
from fleetlens.settings import LOOKUP_BYTES
from fleetlens.sources import files

PARTS = """task string, version string, part int, n_features int, weight double, intercept double, coefficients array<double>,
split array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>"""
TREE = ["split", "threshold", "left", "right", "value"]
GROUP = 100_000  # rows of one (task, version) that one call scores where the models are too large to travel to all tasks


def _no_tree() -> dict:
    return {n: F.array().cast("array<int>" if n in ("split", "left", "right") else "array<double>") for n in TREE}


def fit_linear_models(rows: DataFrame, spans: DataFrame, features: Sequence[str], target: str, time: str = "ts") -> DataFrame:
    """Least squares for every (task, version) of ``spans`` (task, version, start, end) on its rows of [start, end).

    Means and covariances are aggregates that combine before the shuffle; what is solved per model is one small system.
    Rows with a null in a feature or the target take no part; a span without rows gives no model; features that depend
    on each other get the solution of least norm.
    """
    used = rows.select("task", F.col(time).alias("_at"), *features, target).dropna()
    named = spans.select("task", "version", "start", "end")
    held = lookup(used, named, "task", "inner").where("_at >= start AND _at < end")
    pairs = list(combinations_with_replacement(range(len(features)), 2))
    sums = held.groupBy("task", "version").agg(
        F.avg(target).alias("y"), F.array(*[F.avg(f) for f in features]).alias("x"),
        F.array(*[F.covar_pop(features[i], features[j]) for i, j in pairs]).alias("xx"),
        F.array(*[F.covar_pop(f, target) for f in features]).alias("xy"),
    )

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for row in frame.itertuples(index=False):
                gram = np.zeros((len(features), len(features)))
                for (i, j), c in zip(pairs, row.xx):
                    gram[i, j] = gram[j, i] = c
                beta = np.linalg.lstsq(gram, np.asarray(row.xy), rcond=None)[0]
                found.append((row.task, row.version, float(row.y - beta @ np.asarray(row.x)), beta.tolist()))
            yield pd.DataFrame(found, columns=["task", "version", "intercept", "coefficients"])

    solved = sums.mapInPandas(solve, "task string, version string, intercept double, coefficients array<double>")
    added = {"part": F.lit(0), "n_features": F.lit(len(features)), "weight": F.lit(0.0), **_no_tree()}
    return _in_order(solved.withColumns(added))


def _in_order(parts: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in PARTS.split(",")]
    return parts.select(*names)


def saved_parts(spark: SparkSession, folder: str, task: str, version: str) -> DataFrame:
    """Parts of a model that the registry has saved in ``folder``, with its corrections; read from its files as rows."""
    corrections = [n for n in files.child_names(spark, folder) if re.fullmatch(r"correction\d+", n)]
    whole = None
    for number, name in enumerate(["model", *sorted(corrections, key=lambda n: int(n[10:]))]):
        part = _stage_parts(spark, f"{folder}/{name}").withColumn("part", (F.col("part") + number * 1_000_000).cast("int"))
        whole = part if whole is None else whole.unionByName(part)
    return _in_order(whole.withColumns({"task": F.lit(task), "version": F.lit(version)}))


def _stage_parts(spark: SparkSession, folder: str) -> DataFrame:
    stages = files.child_names(spark, f"{folder}/stages")
    path = f"{folder}/stages/{next(n for n in stages if n.startswith('1_'))}"
    assembler = next(n for n in stages if n.startswith("0_"))
    described = spark.read.text(f"{folder}/stages/{assembler}/metadata")
    n_features = described.select(F.size(F.from_json(F.get_json_object("value", "$.paramMap.inputCols"), "array<string>"))).first()[0]
    data = spark.read.parquet(f"{path}/data")
    if "coefficients" in data.columns:
        linear = data.select("intercept", vector_to_array("coefficients").alias("coefficients"))
        return linear.withColumns({"part": F.lit(0), "n_features": F.lit(n_features), "weight": F.lit(0.0), **_no_tree()})
    nodes = data.select("treeID", "nodeData.*") if "treeID" in data.columns else data.withColumn("treeID", F.lit(0))
    if nodes.where("split.numCategories >= 0").limit(1).count():
        raise ValueError("trees that split on categories have no threshold")
    node = F.struct(
        "id", F.greatest("split.featureIndex", F.lit(0)).alias("split"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.when(F.col("leftChild") < 0, F.col("id")).otherwise(F.col("leftChild")).alias("left"),
        F.when(F.col("leftChild") < 0, F.col("id")).otherwise(F.col("rightChild")).alias("right"),
        F.col("prediction").alias("value"),
    )
    trees = nodes.groupBy("treeID").agg(F.sort_array(F.collect_list(node)).alias("n"))  # a tree is bounded by its depth
    trees = trees.select("treeID", *[F.col(f"n.{c}").alias(c) for c in TREE])
    trees = trees.withColumn("threshold", F.transform("threshold", lambda t: F.coalesce(t, F.lit(0.0))))
    if "RandomForest" in path:
        trees = trees.withColumn("weight", F.lit(1.0) / data.agg(F.count_distinct("treeID")).first()[0])
    elif "treeID" in data.columns:
        weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "_m", "weight").drop("_m")
        trees = trees.join(weights, "treeID")
    else:
        trees = trees.withColumn("weight", F.lit(1.0))
    return trees.withColumnRenamed("treeID", "part").withColumns(
        {"n_features": F.lit(n_features), "intercept": F.lit(0.0), "coefficients": F.array().cast("array<double>")}
    )


def _sum_of_parts(parts: Sequence[dict], x: np.ndarray) -> np.ndarray:
    """Predictions of one model; leaves point to themselves, so all rows walk until none moves."""
    total, at = np.zeros(len(x)), np.arange(len(x))
    for p in parts:
        total += p["intercept"]
        if len(p["coefficients"]):
            total += x @ np.asarray(p["coefficients"])
        if len(p["value"]):
            split, threshold, left, right, value = (np.asarray(p[c]) for c in TREE)
            node = np.zeros(len(x), dtype=int)
            while True:
                moved = np.where(x[at, split[node]] <= threshold[node], left[node], right[node])
                if (moved == node).all():
                    break
                node = moved
            total += p["weight"] * value[node]
    return total


def _predictions(tasks: pa.Array, versions: pa.Array, features: pa.Array, models: dict) -> pa.Array:
    """One prediction a row; null where the version is unknown, or the features are null, too few, too many or not all there."""
    out = np.full(len(tasks), np.nan)
    keys = pd.DataFrame({"t": tasks.to_pandas(), "v": versions.to_pandas()})
    width = pc.fill_null(pc.list_value_length(features), -1).to_numpy(zero_copy_only=False)
    for key, at in keys.groupby(["t", "v"]).indices.items():
        parts = models.get(key)
        if not parts:
            continue
        at = at[width[at] == parts[0]["n_features"]]
        if len(at):
            x = pc.list_flatten(features.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(float)
            x = x.reshape(len(at), -1)
            whole = ~np.isnan(x).any(axis=1)
            out[at[whole]] = _sum_of_parts(parts, x[whole])
    return pa.array(out, pa.float64(), mask=np.isnan(out))


def _by_model(parts: Sequence[dict]) -> dict:
    """Parts per (task, version) in one order, so that sums agree; a part that was published twice counts once."""
    models: dict = {}
    for p in sorted(parts, key=lambda p: p["part"]):
        models.setdefault((p["task"], p["version"]), {})[p["part"]] = p
    return {key: list(found.values()) for key, found in models.items()}


def score_by_version(rows: DataFrame, parts: DataFrame, features: str = "features", most_bytes: int = LOOKUP_BYTES, group_rows: int = GROUP) -> DataFrame:
    """Rows (task, version, an array of features, anything else) with ``prediction``, in one pass over all tasks.

    Models whose counted size allows it travel to the tasks, and no row moves. Larger tables meet the rows in a cogroup
    by (task, version), where a key with many rows is dealt over copies of its model. A row whose version is null or
    unknown, or whose features are null, of another number than the model's, or hold a null or NaN, has no prediction.
    """
    if "prediction" in rows.columns:
        raise ValueError("the rows already have a column prediction")
    spark = rows.sparkSession
    parts = stage(_in_order(parts), "model-parts")
    schema = rows.withColumn("prediction", F.lit(None).cast("double")).schema
    if is_small(parts, most_bytes // 64, most_bytes):
        sent = spark.sparkContext.broadcast(_by_model([r.asDict() for r in parts.collect()]))  # at most most_bytes

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = _predictions(b.column("task"), b.column("version"), b.column(features), sent.value)
                yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, "prediction"])

        return rows.mapInArrow(score, schema)

    known = rows.where("task IS NOT NULL AND version IS NOT NULL")
    counts = known.groupBy("task", "version").agg(F.ceil(F.count(F.lit(1)) / group_rows).cast("int").alias("_pieces"))
    counts = stage(counts, "rows-of-models")
    dealt = lookup(known, counts, ["task", "version"], "inner", computed=False)
    dealt = dealt.withColumn("_piece", F.pmod(F.xxhash64(*rows.columns), "_pieces").cast("int")).drop("_pieces")
    copies = counts.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    models = copies.join(parts, ["task", "version"])

    names = rows.columns

    def score_group(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(names).combine_chunks()
        columns = [left.column(c).combine_chunks() for c in ("task", "version", features)]
        return left.append_column("prediction", _predictions(*columns, _by_model(right.to_pylist())))

    keys = ["task", "version", "_piece"]
    dealt, models = dealt.groupBy(*keys), models.groupBy(*keys)
    scored = dealt.cogroup(models).applyInArrow(score_group, schema)
    unknown = rows.where("task IS NULL OR version IS NULL").withColumn("prediction", F.lit(None).cast("double"))
    return scored.unionByName(unknown)
