"""The register of queries: a callable (spark, folder) -> DataFrame and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            TWINS[name] = sql
        return run

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that both engines agree to the last digit shown; adding 0 turns -0 into 0.

    Spark's own round goes through decimals, at several times the cost of the features it rounds here. ``floor`` gives
    a long, so what has no digits behind these (from 2^53 units on, NaN and infinity too) stays as it is.
    """
    names = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    unit = 10.0**digits

    def one(x: Column) -> Column:
        return F.when(F.abs(x) >= 2.0**53 / unit, x).otherwise(F.floor(x * unit + 0.5) / unit) + F.lit(0.0)

    return df.withColumns({n: one(F.col(n)) for n in names})


def rounded_sql(columns: str, digits: int = 6) -> str:
    """``round(x, d) + 0 AS x`` for every name of a comma list."""
    return ", ".join(f"round({c.strip()}, {digits}) + 0 AS {c.strip()}" for c in columns.split(","))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def seconds(column: str | Column) -> Column:
    """Whole seconds since the epoch of a timestamp without zone."""
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("timestamp").cast("long")
