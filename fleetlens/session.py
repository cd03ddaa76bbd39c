"""Session settings and the shared folder that staged tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[str, str]] = []
_local_roots: dict[str, str] = {}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for. On a cluster, leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName("fleetlens")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # the JIT skips methods above 8000 bytes of code; wide feature projections then run per expression instead
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a local session may fall back to a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="fleetlens-")
    return _local_roots[app]


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed by :func:`drop_staged`."""
    path = f"{shared_folder(spark)}/fleetlens/{label}-{uuid.uuid4().hex}"
    _staged.append((spark.sparkContext.applicationId, path))
    return path


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``options`` are those of the Parquet writer.

    Cuts the lineage and fixes the rows: what a lost executor held is read again, not computed again, so a
    placement decided by sampling (a range partitioning) cannot come out differently in a second run.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Remove what this application put into the shared folder; call it when the results have been written."""
    app = spark.sparkContext.applicationId
    jvm = spark.sparkContext._jvm
    mine = [path for owner, path in _staged if owner == app]
    for path in mine:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _staged.remove((app, path))
    return len(mine)
