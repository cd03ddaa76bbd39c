"""Sketches per group that are stored once and merged for any range of groups, beside the exact figures.

Distinct counts are HyperLogLog sketches, quantiles are KLL sketches: a few kilobytes a group, whatever the rows. A
question about a day or a month merges the sketches of its hours and reads no record again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K = 14, 800
#: Relative standard error of a distinct count (1.04 / sqrt(2^LG_K)), and rank error of a quantile at these sizes.
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (LG_K / 2), 0.0036


def sketches(rows: DataFrame, by: Sequence[str | Column], distinct: str, value: str) -> DataFrame:
    """Per group: n rows, ``distinct_sketch`` of one column and ``value_sketch`` of another; nulls enter neither sketch."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, LG_K).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("value_sketch"),
    )


def merged(stored: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """The stored sketches of all groups with the same ``by`` as one."""
    return stored.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("value_sketch", KLL_K).alias("value_sketch"),
    )


def estimates(sketched: DataFrame, probabilities: Sequence[float], label: str = "q") -> DataFrame:
    """The distinct count and the quantiles ``q0``, ``q1``, ... of every sketch; null quantiles for a group of nulls."""
    filled = F.kll_sketch_get_n_double("value_sketch") > 0
    quantiles = {
        f"{label}{i}": F.when(filled, F.kll_sketch_get_quantile_double("value_sketch", F.lit(float(p))))
        for i, p in enumerate(probabilities)
    }
    found = sketched.withColumns({"n_distinct": F.hll_sketch_estimate("distinct_sketch"), **quantiles})
    return found.drop("distinct_sketch", "value_sketch")
