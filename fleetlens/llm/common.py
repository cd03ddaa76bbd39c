"""Small helpers shared by the corpus operators: word rules, tables, staging, Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import stage

__all__ = ["SPACE", "SPACES", "WORD", "arrow_map", "hash60", "no_text", "stage", "table", "words"]

#: The white space that ends a word: blank, and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def no_text(text: str | Column) -> Column:
    """The text, with null as the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text as an array. Only the first and last piece of a split can be empty."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def hash60(text: Column) -> Column:
    """The first 60 bits of the MD5 as a long: the same number in every engine, evenly spread over [0, 2^60)."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def arrow_map(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow``; batches are cut small by rows, since one row may be a very long text."""
    return df.mapInArrow(run, schema)
