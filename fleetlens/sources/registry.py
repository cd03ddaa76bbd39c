"""Versioned models: ``<root>/<task>/v<N>/model`` with a metadata file, and the version table for hot swaps."""

from __future__ import annotations

import json
import re

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.joins import is_small
from fleetlens.operators.models import WarmStarted
from fleetlens.operators.ordered import OrderedRows
from fleetlens.sources import files


def version_number(name: str | Column) -> Column:
    """N of a name ``v<N>``; NULL for other names."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(name.rlike("^v[0-9]+$"), F.regexp_extract(name, "^v([0-9]+)$", 1).cast("long"))


def next_version(names: DataFrame, column: str = "name", by: tuple[str, ...] = ()) -> DataFrame:
    """The next free version, largest number plus one, ``v1`` if there is none."""
    largest = F.coalesce(F.max(version_number(column)), F.lit(0))
    return names.groupBy(*by).agg(F.concat(F.lit("v"), (largest + 1).cast("string")).alias("next_version"))


class ModelRegistry:
    """Models of one task."""

    def __init__(self, spark: SparkSession, root: str, task: str) -> None:
        self.spark, self.folder, self.task = spark, f"{root}/{task}", task

    def versions(self) -> list[str]:
        names = [n for n in files.child_names(self.spark, self.folder) if re.fullmatch(r"v\d+", n)]
        return sorted(names, key=lambda n: int(n[1:]))

    def get_next_version(self) -> str:
        known = self.versions()
        return f"v{int(known[-1][1:]) + 1}" if known else "v1"

    def save(self, model: PipelineModel | WarmStarted, version: str, metadata: dict) -> None:
        """Writes the first model and the corrections of all warm starts since, before the metadata that makes it complete."""
        folder = f"{self.folder}/{version}"
        chain = []
        while isinstance(model, WarmStarted):
            chain.insert(0, model)
            model = model.base
        self._save_base(model, folder)
        for i, step in enumerate(chain):
            step.correction.write().overwrite().save(f"{folder}/correction{i}")
        if chain:
            metadata = {**metadata, "n_estimators": chain[-1].n_new_trees, "new_trees": [step.n_new_trees for step in chain]}
        text = json.dumps({"ml_task": self.task, "version": version, **metadata})
        rows = self.spark.createDataFrame([(text,)], "value string").coalesce(1)
        rows.write.mode("overwrite").text(f"{folder}/metadata")

    def _save_base(self, model: PipelineModel, folder: str) -> None:
        model.write().overwrite().save(f"{folder}/model")

    def load(self, version: str = "v1") -> tuple[PipelineModel | WarmStarted, dict] | None:
        """Model and metadata, or None if there is no such version."""
        folder = f"{self.folder}/{version}"
        if not files.exists(self.spark, f"{folder}/model"):
            return None
        stored = {}
        if files.exists(self.spark, f"{folder}/metadata"):
            stored = json.loads(self.spark.read.text(f"{folder}/metadata").first()[0])
        model = PipelineModel.load(f"{folder}/model")
        for i, trees in enumerate(stored.get("new_trees", [])):
            model = WarmStarted(model, PipelineModel.load(f"{folder}/correction{i}"), trees)
        return model, stored


def version_in_force(
    points: DataFrame, versions: DataFrame, time: str = "window_start", row_id: tuple[str, ...] = (), most: int = 1000
) -> DataFrame:
    """As-of join: the version of the row's task with the latest ``valid_from`` not after the row.

    A table of at most ``most`` versions (task, valid_from, version) travels as one array per task beside each row.
    A larger one is merged with the points in time order, and the latest mark is carried forward by the chunked
    scan; ``row_id`` must then make (time, row_id) unique per task.
    """
    if is_small(versions, most):
        line = versions.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("valid_from", "version"))).alias("_v"))
        joined = points.join(F.broadcast(line), "task", "left")
        past = F.filter("_v", lambda v: v["valid_from"] <= F.col(time))
        return joined.withColumn("version", F.try_element_at(past, F.lit(-1))["version"]).drop("_v")
    marks = versions.select(
        "task", F.col("valid_from").alias(time), F.struct("valid_from", "version").alias("_mark"), F.lit(0).alias("_row")
    )
    both = points.withColumn("_row", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    laid = OrderedRows.lay_out(both, ["task"], [time, "_row", *row_id]).running(_latest=("max", F.col("_mark")))
    return laid.rows().where("_row = 1").withColumn("version", F.col("_latest.version")).drop("_mark", "_row", "_latest")
