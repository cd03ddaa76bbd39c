"""Scalar column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens import settings as S


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def hour_of(seconds: str | Column) -> Column:
    return F.floor(as_column(seconds) / S.SECONDS_PER_HOUR)


def floor_cell(value: str | Column, size: float) -> Column:
    """Floor division (towards minus infinity), as integer."""
    return F.floor(as_column(value) / size).cast("int")


def flag(condition: Column) -> Column:
    return condition.cast("int")


def litres(milligrams: str | Column) -> Column:
    return as_column(milligrams) / S.FUEL_MG_PER_LITRE


def edge_of_lane(lane: str | Column) -> Column:
    """Lane id without its last ``_n`` part."""
    return F.regexp_replace(as_column(lane), "_[^_]*$", "")


def mixed_hash(number: str | Column, seed: int = 0) -> Column:
    """Integer hash in [0, 2^31) from the MD5 of number and seed: the same in any SQL engine, and independent between seeds."""
    text = F.concat(as_column(number).cast("long").cast("string"), F.lit(f":{seed}"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(2147483648))


def mixed_hash_sql(number: str, seed: int = 0) -> str:
    """SQL text of :func:`mixed_hash`."""
    return f"(('0x' || md5(({number})::BIGINT::VARCHAR || ':{seed}')[1:15])::BIGINT % 2147483648)"


def nearest_centre(x: str | Column, y: str | Column, centres: Sequence[Sequence[float]]) -> Column:
    """Index of the nearest fixed centre, the lower index on ties.

    The squared distance without its common term x^2 + y^2: two products per centre, and an array of plain doubles
    keeps the generated method small enough for the JIT. Written as (x - cx) * (x - cx) + ..., the shared differences
    came back wrong from Spark 4.1's subexpression elimination once centres mirrored each other.
    """
    x, y = as_column(x), as_column(y)
    scores = F.array(*[x * (-2.0 * cx) + y * (-2.0 * cy) + (cx * cx + cy * cy) for cx, cy in centres])
    return (F.array_position(scores, F.array_min(scores)) - 1).cast("int")


def rotated(x: str | Column, y: str | Column, means: Sequence[float], axis: Sequence[float]) -> Column:
    """Coordinate of a point, centred at ``means``, along one principal axis."""
    return (as_column(x) - means[0]) * axis[0] + (as_column(y) - means[1]) * axis[1]


def absolute_error(truth: str | Column, prediction: str | Column, log_scale: bool = False) -> Column:
    truth, prediction = as_column(truth), as_column(prediction)
    if log_scale:
        truth, prediction = F.expm1(truth), F.expm1(prediction)
    return F.abs(truth - prediction)


def absolute_percentage_error(truth: str | Column, prediction: str | Column) -> Column:
    truth = as_column(truth)
    return F.abs(truth - as_column(prediction)) / F.greatest(F.abs(truth), F.lit(2.220446049250313e-16))


def _horner(coefficients: Sequence[float], x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


# Coefficients of a published rational approximation of the inverse normal distribution function.
INVERSE_NORMAL = {
    "centre_top": (
        -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02,
        -3.066479806614716e01, 2.506628277459239e00,
    ),
    "centre_bottom": (
        -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01,
        -1.328068155288572e01, 1.0,
    ),
    "tail_top": (
        -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00,
        4.374664141464968e00, 2.938163982698783e00,
    ),
    "tail_bottom": (
        7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0,
    ),
    "tail_from": 0.02425,
}

# Coefficients of a published rational approximation of the normal distribution function.
NORMAL = {
    "top": (
        3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
        221.213596169931, 220.206867912376,
    ),
    "bottom": (
        8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
        637.333633378831, 793.826512519948, 440.413735824752,
    ),
}


def normal_quantile(p: str | Column) -> Column:
    """Inverse of the standard normal distribution function, for p inside (0, 1)."""
    p = as_column(p)
    k = INVERSE_NORMAL
    q = p - 0.5
    r = q * q
    centre = q * _horner(k["centre_top"], r) / _horner(k["centre_bottom"], r)

    def tail(mass: Column) -> Column:
        t = F.sqrt(F.log(mass) * -2.0)
        return _horner(k["tail_top"], t) / _horner(k["tail_bottom"], t)

    return (
        F.when(p < k["tail_from"], tail(p))
        .when(p > 1 - k["tail_from"], -tail(F.lit(1.0) - p))
        .otherwise(centre)
    )


def normal_cdf(z: str | Column) -> Column:
    """The standard normal distribution function; |z| beyond 7 counts as 7."""
    z = as_column(z)
    a = F.least(F.abs(z), F.lit(7.0))
    upper = F.exp(a * a * -0.5) * _horner(NORMAL["top"], a) / _horner(NORMAL["bottom"], a)
    return F.when(z > 0, F.lit(1.0) - upper).otherwise(upper)


def simulation_clock(seconds: str | Column) -> Column:
    """``Day 01 - 08:05``: days of 36000 s that start at 8 o'clock."""
    t = as_column(seconds).cast("long")
    rest = F.pmod(t, F.lit(S.SCENARIO_SECONDS))
    day = F.floor(t / S.SCENARIO_SECONDS) + 1
    hour = F.floor(rest / 3600) + 8
    minute = F.floor((rest % 3600) / 60)
    return F.format_string("Day %02d - %02d:%02d", day, hour, minute)


def prediction_text(task: str, value: str | Column) -> Column:
    """A prediction in the unit of its task: ``mm:ss min``, ``x.xx L`` or ``n stops``."""
    v = as_column(value)
    if task == "eta":
        total = v.cast("long")
        return F.format_string("%02d:%02d min", F.floor(total / 60), total % 60)
    if task == "fuel":
        return F.concat(F.format_string("%.2f", litres(v)), F.lit(" L"))
    if task == "stops":
        n = F.bround(v, 0).cast("long")
        return F.concat(n.cast("string"), F.when(n == 1, F.lit(" stop")).otherwise(F.lit(" stops")))
    raise ValueError(f"unknown task {task!r}")


def without_special_tokens(text: str | Column) -> Column:
    """Text without ``<|...|>`` marks (plain and full-width bars), trimmed."""
    t = as_column(text)
    for bar in ("｜", "\\|"):
        t = F.regexp_replace(t, f"<{bar}.*?{bar}>", "")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def even_angles(n: int) -> list[float]:
    """n angles around the circle; for fixed, evenly spread centres."""
    return [2 * math.pi * i / n for i in range(n)]
