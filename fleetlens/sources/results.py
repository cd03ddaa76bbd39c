"""Run results, tuning studies, importance and ranking tables: nested JSON and CSV in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.schemas import IMPORTANCE, METRICS, RANKING, RUN_RESULTS, STUDY
from fleetlens.sources import files

RESULTS_FILE = "results.json"
STUDY_FILE = "tuning_results.json"
IMPORTANCE_FILE = "feature_selection_results.csv"


def _run_name(level: int = 3):
    """The run folder in ``<outputs>/<run>/results/<file>``."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -level)


def run_results_json(results: DataFrame, folds: DataFrame | None = None) -> DataFrame:
    """One JSON document per experiment from (experiment, model, metrics) rows and optional fold rows."""
    rows = results
    if folds is not None:
        nested = folds.groupBy("experiment", "model").agg(
            F.sort_array(F.collect_list(F.struct("fold", *METRICS))).alias("_folds")
        )
        plain = F.transform("_folds", lambda f: F.struct(*[f[m].alias(m) for m in METRICS]))
        rows = results.join(nested.select("experiment", "model", plain.alias("per_fold")), ["experiment", "model"], "left")
    else:
        rows = rows.withColumn("per_fold", F.lit(None).cast(RUN_RESULTS.valueType["per_fold"].dataType))
    entry = F.struct("model", F.struct(*METRICS, "per_fold"))
    return rows.groupBy("experiment").agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry), asc=True))).alias("value")
    )


def save_results(results: DataFrame, path: str, folds: DataFrame | None = None) -> None:
    """Writes one folder per experiment, ``<path>/experiment=<name>/``, with its JSON document."""
    documents = run_results_json(results, folds)
    documents.write.mode("overwrite").partitionBy("experiment").text(path)


def parse_results(documents: DataFrame, text: str = "value") -> DataFrame:
    """(experiment, model, five metrics) from documents; ``per_fold`` is left out."""
    parsed = documents.select("experiment", F.from_json(text, RUN_RESULTS).alias("r"))
    rows = parsed.select("experiment", F.explode("r").alias("model", "m"))
    return rows.select("experiment", "model", *[F.col(f"m.{c}").alias(c) for c in METRICS])


def parse_folds(documents: DataFrame, text: str = "value") -> DataFrame:
    """(experiment, model, fold, five metrics): the per-fold part of the documents."""
    parsed = documents.select("experiment", F.from_json(text, RUN_RESULTS).alias("r"))
    rows = parsed.select("experiment", F.explode("r").alias("model", "m"))
    folds = rows.select("experiment", "model", F.posexplode("m.per_fold").alias("fold", "f"))
    return folds.select("experiment", "model", "fold", *[F.col(f"f.{c}").alias(c) for c in METRICS])


def load_all_results(spark: SparkSession, outputs: str) -> DataFrame:
    """All runs below ``outputs`` (either layout: ``<run>/results/results.json`` or as written by save_results)."""
    own = files.matching(spark, f"{outputs}/experiment=*")
    if own:
        documents = spark.read.option("basePath", outputs).text(own, wholetext=True)
    else:
        found = files.matching(spark, f"{outputs}/*/results/{RESULTS_FILE}")
        if not found:
            return parse_results(spark.createDataFrame([], "experiment string, value string"))
        documents = spark.read.text(found, wholetext=True).withColumn("experiment", _run_name())
    return parse_results(documents).orderBy("experiment", "model")


def load_all_tuning_results(spark: SparkSession, outputs: str) -> DataFrame:
    """Finished trials of every study whose run name contains ``tuning``."""
    found = files.matching(spark, f"{outputs}/*tuning*/results/{STUDY_FILE}")
    if not found:
        return parse_studies(spark.createDataFrame([], "experiment string, value string"))
    documents = spark.read.text(found, wholetext=True).withColumn("experiment", _run_name())
    return parse_studies(documents)


def parse_studies(documents: DataFrame, text: str = "value") -> DataFrame:
    """One row per COMPLETE trial with its metrics and the parameters as a map."""
    parsed = documents.select("experiment", F.from_json(text, STUDY).alias("s"))
    trials = parsed.select("experiment", F.col("s.model").alias("model"), F.explode("s.trials").alias("t"))
    attributes = [F.col("t.user_attrs")[c].alias(c) for c in ("mape", "training_time", "prediction_time", "evaluation_time")]
    return trials.where(F.col("t.state") == "COMPLETE").select(
        "experiment", "model", F.col("t.number").alias("trial_number"), F.col("t.value").alias("mae"), *attributes,
        F.col("t.params").alias("params"),
    )


def spread_parameters(trials: DataFrame, names: Sequence[str]) -> DataFrame:
    """The parameter map as columns."""
    return trials.select(*[c for c in trials.columns if c != "params"], *[F.col("params")[n].alias(n) for n in names])


def studies_json(trials: DataFrame) -> DataFrame:
    """One study document per (experiment, model) from trial rows (trial_number, mae, state, params, user_attrs)."""
    trial = F.struct(
        F.col("trial_number").alias("number"), F.col("mae").alias("value"), "state", "params", "user_attrs"
    )
    done = F.when(F.col("state") == "COMPLETE", F.struct("mae", "trial_number"))
    return trials.groupBy("experiment", "model").agg(
        F.min(done).alias("_best"),
        F.count(F.lit(1)).alias("n_trials"),
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("trial_number").alias("_n"), F.to_json(trial).alias("_t")))),
            lambda e: e["_t"],
        ).alias("_trials"),
    ).select(
        "experiment",
        F.concat(
            F.lit('{"best_trial":'), F.col("_best.trial_number").cast("string"),
            F.lit(',"best_value":'), F.col("_best.mae").cast("string"),
            F.lit(',"n_trials":'), F.col("n_trials").cast("string"),
            F.lit(',"study_name":"'), F.col("experiment"), F.lit('","model":"'), F.col("model"),
            F.lit('","trials":['), F.concat_ws(",", "_trials"), F.lit("]}"),
        ).alias("value"),
    )


def save_csv(df: DataFrame, path: str) -> None:
    """CSV with a header (feature selection, research and tuning tables)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def load_feature_selection_results(spark: SparkSession, outputs: str) -> DataFrame:
    """Importance tables of all runs ``features_selection_*`` that have the four columns; the others are skipped."""
    empty = spark.createDataFrame([], IMPORTANCE).select(F.lit("").alias("experiment"), "*")
    merged = empty
    for path in files.matching(spark, f"{outputs}/features_selection_*/results/{IMPORTANCE_FILE}"):
        if set(IMPORTANCE.names) <= set(_header(spark, path)):
            table = spark.read.option("header", True).csv(path)
            typed = [F.col(f.name).cast(f.dataType) for f in IMPORTANCE.fields]
            merged = merged.unionByName(table.select(F.lit(path.split("/")[-3]).alias("experiment"), *typed))
    return merged


def load_feature_ranking_results(spark: SparkSession, outputs: str) -> DataFrame:
    """The ranking table, or an empty one of the same columns."""
    path = f"{outputs}/features_selection_ranking/results/{IMPORTANCE_FILE}"
    if not files.exists(spark, path):
        return spark.createDataFrame([], RANKING)
    return spark.read.schema(RANKING).option("header", True).option("enforceSchema", False).csv(path)
