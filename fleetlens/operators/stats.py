"""Statistics of telemetry, trips and errors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens import settings as S
from fleetlens.functions.columns import absolute_error, absolute_percentage_error, hour_of
from fleetlens.operators.joins import lookup
from fleetlens.operators.ordered import exact_percentiles

#: Over the rows where both columns of a pair have values: their number, means, and central sums of squares and products.
SUMS = ["n", "a", "b", "aa", "bb", "ab"]


def telemetry_per_hour(fcd: DataFrame, approximate: bool = False) -> DataFrame:
    """Mean speed and number of vehicles per hour; ``approximate`` counts vehicles with a sketch."""
    vehicles = F.approx_count_distinct("vehicle_id") if approximate else F.count_distinct("vehicle_id")
    return fcd.groupBy(hour_of("timestep_time").alias("hour")).agg(
        F.avg("vehicle_speed").alias("average_speed"), vehicles.alias("vehicle_count")
    )


def telemetry_statistics(fcd: DataFrame) -> DataFrame:
    """Vehicles, mean of their largest odometer, mean speed. Two levels of aggregation, one pass."""
    per_vehicle = fcd.groupBy("vehicle_id").agg(
        F.max("vehicle_odometer").alias("_far"), F.sum("vehicle_speed").alias("_sum"),
        F.count("vehicle_speed").alias("_n"),
    )
    return per_vehicle.agg(
        F.count("vehicle_id").alias("unique_vehicles"),
        F.avg("_far").alias("average_trip_distance"),
        (F.sum("_sum") / F.sum("_n")).alias("average_speed"),
    )


def trip_statistics(trips: DataFrame) -> DataFrame:
    return trips.agg(
        F.count(F.lit(1)).alias("total_trips"),
        F.avg("distance").alias("average_distance"),
        F.avg("duration").alias("average_duration"),
    )


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins, the last one closed, empty bins with 0. A constant column spreads by 1, one without values gives no rows."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    every = df.sparkSession.range(bins if low is not None else 0).select(F.col("id").cast("int").alias("bin"))
    low, high = low or 0, high or 0
    low, high = float(low), float(high)
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    counted = df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(F.broadcast(counted), "bin", "left").select(
        "bin", (F.col("bin") * width + low).alias("lower"), ((F.col("bin") + 1) * width + low).alias("upper"), F.coalesce("n", F.lit(0)).alias("n")
    )


def mean_and_median(df: DataFrame, column: str) -> DataFrame:
    mean = df.agg(F.avg(column)).first()[0]
    return exact_percentiles(df, column, [0.5], names=["median"]).withColumn("mean", F.lit(mean))


def evaluate(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE and MAPE, optionally per group."""
    return df.groupBy(*by).agg(
        F.avg(absolute_error(truth, prediction)).alias("mae"),
        F.avg(absolute_percentage_error(truth, prediction)).alias("mape"),
    )


def mean_metrics(df: DataFrame, by: Sequence[str] | str, metrics: Sequence[str]) -> DataFrame:
    """Mean of every metric per group (over folds, experiments or models)."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def pivot_metric(df: DataFrame, row: str, column: str, metric: str, values: Sequence[str]) -> DataFrame:
    """Rows by columns table of one metric; the columns are given, so no extra pass looks for them."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.max(metric))


def box_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 IQR) and number of outliers per group."""
    box = exact_percentiles(df, value, [0.25, 0.5, 0.75], [by], ["q1", "median", "q3"])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fenced = lookup(df, box, by, "inner").withColumns({"_lo": F.col("q1") - reach, "_hi": F.col("q3") + reach})
    inside = F.col(value).between(F.col("_lo"), F.col("_hi"))
    return fenced.groupBy(by).agg(
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).alias("outliers"),
        F.count(F.lit(1)).alias("n"),
    )


def box_outliers(df: DataFrame, by: str, value: str) -> DataFrame:
    """The rows beyond the whiskers."""
    box = exact_percentiles(df, value, [0.25, 0.75], [by], ["_q1", "_q3"])
    reach = (F.col("_q3") - F.col("_q1")) * 1.5
    outside = (F.col(value) < F.col("_q1") - reach) | (F.col(value) > F.col("_q3") + reach)
    return lookup(df, box, by, "inner").where(outside).drop("_q1", "_q3")


def correlated_pairs(df: DataFrame, columns: Sequence[str], limit: float = S.CORRELATION_LIMIT) -> DataFrame:
    """Pairs of columns with |Pearson r| above ``limit``; feature_1 is the later column of the two.

    Nulls and NaN are skipped pair by pair at any width; a column that is constant over a pair's rows has no r. The rows
    are read once: every task sums products of differences to its first values into columns^2 / 2 rows, which is also
    the most the result can have. The tasks' means and central moments then merge exactly.
    """
    columns = list(columns)
    number = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]
    first, second = np.triu_indices(len(columns), 1)

    def moments(batches):
        sums, shift = np.zeros((6, len(first))), np.full(len(columns), np.nan)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            known = ~np.isnan(x)
            fresh = np.isnan(shift) & known.any(axis=0)
            shift[fresh] = x[known.argmax(axis=0), np.arange(len(columns))][fresh]
            x = np.where(known, x - shift, 0.0)
            if known.all():
                n, total, square = float(len(x)), x.sum(axis=0), (x * x).sum(axis=0)
                parts = (np.full(len(first), n), total[first], total[second], square[first], square[second])
            else:
                m = known.astype(float)
                at, of_square = x.T @ m, (x * x).T @ m
                parts = tuple(p[first, second] for p in (m.T @ m, at, at.T, of_square, of_square.T))
            sums += np.array([*parts, (x.T @ x)[first, second]])
        n, a, b, aa, bb, ab = sums
        of = np.where(n > 0, n, 1.0)
        shift = np.nan_to_num(shift)
        done = (n, a / of + shift[first], b / of + shift[second], aa - a * a / of, bb - b * b / of, ab - a * b / of)
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), *map(pa.array, done)], ["i", "j", *SUMS])

    schema = "i int, j int, " + ", ".join(f"{n} double" for n in SUMS)
    parts = df.select(*number).mapInArrow(moments, schema).where("n > 0")
    mean = lambda c: F.sum(F.col("n") * F.col(c)).over(Window.partitionBy("i", "j")) / F.sum("n").over(Window.partitionBy("i", "j"))
    away = parts.withColumns({"_a": F.col("a") - mean("a"), "_b": F.col("b") - mean("b")})
    between = lambda c, x, y: F.sum(F.col(c) + F.col("n") * F.col(x) * F.col(y))
    total = away.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("a")).alias("sa"), F.sum(F.col("n") * F.col("b")).alias("sb"),
        between("aa", "_a", "_a").alias("aa"), between("bb", "_b", "_b").alias("bb"), between("ab", "_a", "_b").alias("ab"),
    )
    # a constant column leaves at most what rounding adds to squares of its size
    spread = lambda xx, s: F.col(xx) > F.col("n") * (F.pow(F.col(s) / F.col("n"), F.lit(2.0)) * 1e-24 + 1e-300)
    r = F.when(spread("aa", "sa") & spread("bb", "sb"), F.abs(F.col("ab") / F.sqrt(F.col("aa")) / F.sqrt(F.col("bb"))))
    names = F.array(*[F.lit(c) for c in columns])
    return total.select(F.get(names, "j").alias("feature_1"), F.get(names, "i").alias("feature_2"), r.alias("correlation")).where(F.col("correlation") > limit)


def scenario_change(df: DataFrame, scenario: str, first: str, second: str, measures: Sequence[str]) -> DataFrame:
    """One row per measure: its mean in both scenarios and the change in percent."""
    means = df.where(F.col(scenario).isin(first, second)).agg(
        *[F.avg(F.when(F.col(scenario) == s, F.col(m))).alias(f"{m}_{i}") for m in measures
          for i, s in enumerate((first, second))]
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(f"{m}_0").alias("first"), F.col(f"{m}_1").alias("second"))
        for m in measures
    ]))
    return means.select(rows.alias("r")).select("r.*").withColumn("change_percent", percent_change("first", "second"))


def percent_change(before: str | Column, after: str | Column) -> Column:
    before = F.col(before) if isinstance(before, str) else before
    after = F.col(after) if isinstance(after, str) else after
    return F.try_divide((after - before) * 100, before)


def relative_improvement(
    df: DataFrame, start: int, end: int, time: str, old_error: str, new_error: str, truth: str
) -> DataFrame:
    """MAE and MAPE of two models on the same window, and the improvement in percent."""
    size = F.greatest(F.abs(F.col(truth)), F.lit(2.220446049250313e-16))
    window = df.where((F.col(time) >= start) & (F.col(time) <= end)).agg(
        F.avg(old_error).alias("mae_old"), F.avg(new_error).alias("mae_new"),
        F.avg(F.col(old_error) / size).alias("mape_old"), F.avg(F.col(new_error) / size).alias("mape_new"),
    )
    gain = lambda m: F.try_divide((F.col(f"{m}_old") - F.col(f"{m}_new")) * 100, F.col(f"{m}_old"))
    return window.withColumns({"mae_gain": gain("mae"), "mape_gain": gain("mape")})


def trends(df: DataFrame, by: str, target: str, parameters: Sequence[str]) -> DataFrame:
    """Least-squares line of ``target`` on each parameter, per group, in one aggregate."""
    fitted = df.groupBy(by).agg(
        *[f(F.col(target), F.col(p).cast("double")).alias(f"{n}_{p}") for p in parameters
          for n, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept))]
    )
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(p).alias("parameter"), F.col(f"slope_{p}").alias("slope"), F.col(f"intercept_{p}").alias("intercept")
        )
        for p in parameters
    ]))
    return fitted.select(by, rows.alias("r")).select(by, "r.*")
