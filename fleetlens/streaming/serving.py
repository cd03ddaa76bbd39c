"""Models of several tasks behind a replay: scoring with the version in force and retraining on a time range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import settings as S
from fleetlens.functions.columns import absolute_error
from fleetlens.operators.models import create_model, retrain
from fleetlens.operators.prep import load_window
from fleetlens.sources.registry import ModelRegistry
from fleetlens.streaming.model_table import PARTS, saved_parts, score_by_version


class ModelServing:
    """One registry per task over a table of featurised trips with the columns task, ts and seq.

    All tasks are scored in one pass, with their models as rows of one table; retraining reads only the rows of its window. The number of tasks is
    that of the deployed models, not of the data.
    """

    def __init__(
        self, spark: SparkSession, root: str, trips: DataFrame, tasks: Sequence[str], features: Sequence[str], target: str,
        kind: str = "linear", n_training: dict[str, int] | None = None, log_scale: Sequence[str] = (), **parameters,
    ) -> None:
        self.trips, self.features, self.target, self.kind = trips, list(features), target, kind
        self.n_training, self.log_scale, self.parameters = n_training or S.TRAINING_SAMPLES, set(log_scale), parameters
        self.parts = f"{root}/parts"
        self.registries = {t: ModelRegistry(spark, root, t) for t in tasks}
        self.models: dict[tuple[str, str], object] = {}
        self.versions: dict[str, str] = {}

    def start(self, end: int, start: int = 0) -> dict[str, str]:
        """Trains and registers v1 of every task on the rows of [start, end)."""
        for task, registry in self.registries.items():
            rows = load_window(self.trips, start, end, "ts").where(F.col("task") == task)
            model = create_model(self.kind, self.features, self.target, **self.parameters).fit(rows)
            self._register(task, registry.get_next_version(), model, start, end, None)
        return dict(self.versions)

    def _register(self, task: str, version: str, model, start: int, end: int, base: str | None) -> None:
        metadata = {"base_version": base or version, "model": self.kind, "start_timestamp": start, "end_timestamp": end}
        registry = self.registries[task]
        registry.save(model, version, metadata)
        saved_parts(registry.spark, f"{registry.folder}/{version}", task, version).write.mode("append").parquet(self.parts)
        self.models[task, version] = model
        self.versions[task] = version

    def _model(self, task: str, version: str):
        if (task, version) not in self.models:
            self.models[task, version] = self.registries[task].load(version)[0]
        return self.models[task, version]

    def score(self, rows: DataFrame, versions: dict[str, str]) -> DataFrame:
        """(task, ts, seq, error) of a batch under the given versions: one pass over the rows, models come as a table.

        Rows of tasks without a version, and rows that lack a feature, have no error and are left out.
        """
        spark = rows.sparkSession
        in_force = F.broadcast(spark.createDataFrame(list(versions.items()), "task string, version string"))  # one row a task
        vector = F.array(*[F.col(f).cast("double") for f in self.features])
        marked = rows.join(in_force, "task").select("task", "ts", "seq", "version", self.target, vector.alias("features"))
        parts = spark.read.schema(PARTS).parquet(self.parts).join(in_force, ["task", "version"], "left_semi")
        scored = score_by_version(marked, parts).where("prediction IS NOT NULL")
        plain, logs = (absolute_error(self.target, "prediction", log) for log in (False, True))
        error = F.when(F.col("task").isin(*self.log_scale), logs).otherwise(plain) if self.log_scale else plain
        return scored.select("task", "ts", "seq", error.alias("error"))

    def retrain(self, task: str, start: int, end: int) -> str:
        """Continues the task's model on [start, end), registers the result and returns its version."""
        base = self.versions[task]
        rows = load_window(self.trips, start, end, "ts").where(F.col("task") == task)
        size = self.n_training.get(task, S.TRAINING_SAMPLES["eta"])
        model = retrain(self._model(task, base), self.kind, rows, self.target, size, **self.parameters)
        version = self.registries[task].get_next_version()
        self._register(task, version, model, start, end, base)
        return version
