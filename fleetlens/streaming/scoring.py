"""Streams that score with the version in force, and that keep what came too late.

The tables of versions and models are read again for every micro-batch, so a version published between two batches is
used by the next one, and inside a batch the row's own time decides. What a batch writes depends on earlier batches
only through tables that hold one folder a batch, so a batch that is run again writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from fleetlens import settings as S
from fleetlens.sources.registry import version_in_force
from fleetlens.streaming.lifecycle import is_written
from fleetlens.streaming.model_table import PARTS, score_by_version

VERSIONS = "task string, valid_from long, version string"


def publish(models: DataFrame, versions: DataFrame, folder: str) -> None:
    """Appends models, then the versions that name them: a reader never meets a version without its model."""
    models.write.mode("append").parquet(f"{folder}/parts")
    versions.select("task", "valid_from", "version").write.mode("append").parquet(f"{folder}/versions")


def score_in_force(rows: DataFrame, folder: str, time: str = "ts", row_id: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Rows with the version in force at their own time and its prediction; both null before a task's first version."""
    spark = rows.sparkSession
    marked = version_in_force(rows, spark.read.schema(VERSIONS).parquet(f"{folder}/versions"), time, row_id)
    return score_by_version(marked, spark.read.schema(PARTS).parquet(f"{folder}/parts"))


def scored_stream(
    trips: DataFrame, folder: str, sink: str, checkpoint: str, time: str = "ts", row_id: tuple[str, ...] = ("seq",),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Scores a stream of (task, time, row id, features, ...) with the models published in ``folder``."""

    def write(batch: DataFrame, number: int) -> None:
        path = f"{sink}/batch={number}"
        if not is_written(batch.sparkSession, path):  # versions published since must not change a finished batch
            score_in_force(batch, folder, time, row_id).write.mode("overwrite").parquet(path)

    writer = trips.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


class LateRows:
    """Windowed metrics of a stream whose late rows are stored and counted instead of dropped unseen.

    The watermark of a batch is the largest time of all earlier batches less ``delay`` seconds. A row is late when its
    window ended at or before it; such rows go to a table of their own and leave the metrics of closed windows as they
    are. Every batch writes its late rows, sums per (task, window) and largest time, and sums are merged on reading.
    A row without a task or a time belongs to no window: it counts as late, with a null window.
    """

    def __init__(self, spark: SparkSession, folder: str, seconds: int = S.WINDOW_SECONDS, delay: int = 3600) -> None:
        self.spark, self.folder, self.seconds, self.delay = spark, folder, seconds, delay

    def _table(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _watermark(self, number: int) -> int | None:
        if not number:
            return None
        marks = self.spark.read.schema("newest long, batch long").parquet(self._table("marks"))
        newest = marks.where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        return None if newest is None else newest - self.delay

    def write_batch(self, batch: DataFrame, number: int) -> None:
        end = ((F.floor(F.col("ts") / self.seconds) + 1) * self.seconds).cast("long")
        rows = batch.withColumn("window_end", F.when(F.col("task").isNotNull(), end)).persist(StorageLevel.MEMORY_AND_DISK)
        mark = self._watermark(number)
        late = F.col("window_end").isNull() | (F.col("window_end") <= mark if mark is not None else F.lit(False))
        sums = rows.where(~late).groupBy("task", "window_end").agg(
            F.sum("error").alias("total"), F.count("error").alias("n_errors"), F.count(F.lit(1)).alias("n_samples")
        )
        try:
            rows.where(late).write.mode("overwrite").parquet(f"{self._table('late')}/batch={number}")
            sums.write.mode("overwrite").parquet(f"{self._table('sums')}/batch={number}")
            rows.agg(F.max("ts").alias("newest")).write.mode("overwrite").parquet(f"{self._table('marks')}/batch={number}")
        finally:
            rows.unpersist()

    def start(self, errors: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """``errors`` is a stream of task, ts, error and anything else."""
        writer = errors.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def metrics(self) -> DataFrame:
        """(task, window_end, mae, n_samples, n_late); mae is null where all rows of a window were late."""
        schema = "task string, window_end long, total double, n_errors long, n_samples long"
        sums = self.spark.read.schema(schema).parquet(self._table("sums")).drop("batch").withColumn("n_late", F.lit(0).cast("long"))
        late = self.spark.read.schema("task string, window_end long").parquet(self._table("late")).select(
            "task", "window_end", F.lit(None).cast("double").alias("total"), F.lit(0).cast("long").alias("n_errors"),
            F.lit(0).cast("long").alias("n_samples"), F.lit(1).cast("long").alias("n_late"),
        )
        merged = sums.unionByName(late).groupBy("task", "window_end").agg(
            (F.sum("total") / F.nullif(F.sum("n_errors"), F.lit(0))).alias("mae"), F.sum("n_samples").alias("n_samples"),
            F.sum("n_late").alias("n_late"),
        )
        return merged

    def late_rows(self, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, window_end long, batch long").parquet(self._table("late"))
