"""Trip features: scalar groups, fitted transforms and their inverses.

Fitting is one aggregate whose single row becomes literals, so every transform is a projection without a join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from fleetlens import settings as S
from fleetlens.functions.columns import (
    flag, floor_cell, nearest_centre, normal_cdf, normal_quantile, rotated,
)
from fleetlens.operators.ordered import exact_percentiles, quantile_grid
from fleetlens.operators.prep import check_required_columns

ENDS = ["source_x", "source_y", "destination_x", "destination_y"]


def distance_percentiles(
    trips: DataFrame, probabilities: Sequence[float] = S.DISTANCE_PERCENTILES, column: str = "distance"
) -> list[float]:
    return [float(v) for v in exact_percentiles(trips, column, probabilities).first()]


def midpoint_centre(trips: DataFrame) -> tuple[float, float]:
    """Mean of the trip midpoints."""
    row = trips.agg(
        F.avg((F.col("source_x") + F.col("destination_x")) / 2), F.avg((F.col("source_y") + F.col("destination_y")) / 2)
    ).first()
    return float(row[0]), float(row[1])


def mean_point(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    row = df.agg(F.avg(x), F.avg(y)).first()
    return float(row[0]), float(row[1])


def temporal_features(trips: DataFrame) -> DataFrame:
    check_required_columns(trips, ["time_start"], "temporal features")
    within = F.pmod(F.col("time_start"), F.lit(S.SCENARIO_SECONDS))
    hour = F.floor(within / S.SECONDS_PER_HOUR)
    return trips.withColumn("hour_bin", hour).withColumns(
        {
            "is_morning": flag(F.col("hour_bin") <= S.MORNING_LAST_HOUR),
            "is_noon": flag(F.col("hour_bin").between(S.NOON_FIRST_HOUR, S.NOON_LAST_HOUR)),
            "is_afternoon": flag(F.col("hour_bin") >= S.AFTERNOON_FIRST_HOUR),
            "is_rush_hour": flag(F.col("hour_bin").isin(*S.RUSH_HOURS)),
        }
    )


def _radial(x: str, y: str, centre: tuple[float, float]) -> Column:
    return F.hypot(F.col(x) - centre[0], F.col(y) - centre[1])


def spatial_features(trips: DataFrame, percentiles: Sequence[float], centre: tuple[float, float]) -> DataFrame:
    """The 17 spatial features; ``route_efficiency`` is NULL for a trip of length 0."""
    check_required_columns(trips, [*ENDS, "distance"], "spatial features")
    low, high = percentiles[0], percentiles[2]
    d = F.col("distance")
    first = trips.withColumns(
        {
            "x_center": (F.col("source_x") + F.col("destination_x")) / 2,
            "y_center": (F.col("source_y") + F.col("destination_y")) / 2,
            "x_difference": F.col("destination_x") - F.col("source_x"),
            "y_difference": F.col("destination_y") - F.col("source_y"),
        }
    ).withColumn("euclidean_distance", F.hypot("x_difference", "y_difference"))
    bearing = F.atan2("y_difference", "x_difference")
    second = first.withColumns(
        {
            "route_efficiency": F.try_divide(F.col("euclidean_distance"), d),
            "detour_length": d - F.col("euclidean_distance"),
            "trip_bearing": bearing,
            "trip_bearing_sin": F.sin(bearing),
            "trip_bearing_cos": F.cos(bearing),
            "is_short_distance": flag(d <= low),
            "is_medium_distance": flag((d > low) & (d <= high)),
            "is_long_distance": flag(d > high),
            "source_distance_from_city_center": _radial("source_x", "source_y", centre),
            "destination_distance_from_city_center": _radial("destination_x", "destination_y", centre),
            "trip_centrality": _radial("x_center", "y_center", centre),
        }
    )
    change = F.col("destination_distance_from_city_center") - F.col("source_distance_from_city_center")
    return second.withColumn("trip_centrality_change", change)


def fourier_features(
    trips: DataFrame, scale: float = S.FOURIER_SCALE, frequencies: int = S.FOURIER_FREQUENCIES
) -> DataFrame:
    check_required_columns(trips, ENDS, "fourier features")
    waves = {}
    for c in ENDS:
        for i in range(frequencies):
            angle = F.col(c) / scale * 2**i
            waves[f"{c}_sin_{i}"], waves[f"{c}_cos_{i}"] = F.sin(angle), F.cos(angle)
    return trips.withColumns(waves)


def cell_features(trips: DataFrame, size: float = S.CELL_METRES) -> DataFrame:
    check_required_columns(trips, ENDS, "cell features")
    names = {c: c.replace("_", "_cell_") for c in ENDS}
    return trips.withColumns({name: floor_cell(c, size) for c, name in names.items()})


CELL = "_cell"
_SUMS = ["n", "x", "y", "s"]  # of a cell or a cluster: points, sums of both coordinates, squares around the middle of all


def _sums(middle: np.ndarray) -> list[Column]:
    square = F.pow(F.col("x") - float(middle[0]), F.lit(2.0)) + F.pow(F.col("y") - float(middle[1]), F.lit(2.0))
    return [F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(square).alias("s")]


def _in_cells(points: DataFrame, x: str, y: str) -> tuple[DataFrame, np.ndarray]:
    """``x, y`` and the cell of a grid over three deviations around the middle; outer cells take what lies beyond."""
    xy = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    usable = (F.abs("x") < math.inf) & (F.abs("y") < math.inf)
    row = xy.agg(
        F.count(F.lit(1)), F.count_if(usable), F.avg("x"), F.avg("y"), F.stddev_pop("x"), F.stddev_pop("y")
    ).first()
    if not row[0] or row[0] != row[1]:
        raise ValueError(f"clusters need points with both coordinates: {row[0] - row[1]} of {row[0]} have none")
    middle, side = np.array(row[2:4]), S.CLUSTER_GRID

    def place(axis: str, mean: float, std: float) -> Column:
        at = F.floor((F.col(axis) - (mean - 3 * std)) * (side / (6 * std or 1.0)))
        return F.greatest(F.lit(0), F.least(F.lit(side - 1), at))

    cell = (place("x", row[2], row[4]) * side + place("y", row[3], row[5])).cast("int")
    return xy.withColumn(CELL, cell), middle


def _may_be_nearest(cells: pd.DataFrame, centres: np.ndarray) -> np.ndarray:
    """Per cell and centre, whether the centre may be the nearest one somewhere in the cell's box."""
    boxes = cells[["x0", "x1", "y0", "y1"]].to_numpy()
    middles = np.stack([boxes[:, :2].mean(axis=1), boxes[:, 2:].mean(axis=1)], axis=1)
    norms = (centres**2).sum(axis=1)
    own = (middles @ (-2 * centres.T) + norms).argmin(axis=1)
    maybe = np.zeros((len(cells), len(centres)), dtype=bool)
    for j, (cx, cy) in enumerate(centres):
        # how much farther the middle's centre is than this one is linear in the place: largest in a corner of the box
        dx, dy = 2 * (cx - centres[own, 0]), 2 * (cy - centres[own, 1])
        most = np.maximum(boxes[:, 0] * dx, boxes[:, 1] * dx) + np.maximum(boxes[:, 2] * dy, boxes[:, 3] * dy)
        maybe[:, j] = (own == j) | (most + norms[own] - norms[j] >= 0)
    return maybe


_BORDER = pa.schema([(CELL, pa.int32()), ("near", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("n", pa.float64()), ("j", pa.int32())])))])


def _clusters(placed: DataFrame, cells: pd.DataFrame, centres: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """The sums of each cluster over all points: whole cells by their sums, points of cells on a border one by one.

    The centres go in as rows, not as literals, so the code generated for the first iteration serves all of them.
    """
    maybe = _may_be_nearest(cells, centres)
    border = maybe.sum(axis=1) > 1
    sums = np.zeros((len(centres), len(_SUMS)))
    np.add.at(sums, maybe[~border].argmax(axis=1), cells.loc[~border, _SUMS].to_numpy(dtype=float))
    if border.any():
        lines = [{"x": -2 * cx, "y": -2 * cy, "n": cx * cx + cy * cy, "j": j} for j, (cx, cy) in enumerate(centres.tolist())]
        rows = [
            {CELL: cell, "near": [lines[j] for j in np.flatnonzero(near)]}
            for cell, near in zip(cells.loc[border, CELL].tolist(), maybe[border])
        ]
        few = placed.sparkSession.createDataFrame(pa.Table.from_pylist(rows, _BORDER))
        gap = lambda t: F.struct((F.col("x") * t["x"] + F.col("y") * t["y"] + t["n"]).alias("d"), t["j"].alias("j"))
        nearest = F.array_min(F.transform("near", gap))["j"]
        found = placed.join(F.broadcast(few), CELL).groupBy(nearest.alias("j")).agg(*_sums(middle))
        for r in found.collect():
            sums[r["j"]] += [r[n] for n in _SUMS]
    return sums


def _cost(sums: np.ndarray, centres: np.ndarray, middle: np.ndarray) -> float:
    """Sum of squared distances of all points to their centres."""
    n, off = sums[:, 0], centres - middle
    moved = sums[:, 1:3] - n[:, None] * middle
    return float((sums[:, 3] - 2 * (off * moved).sum(axis=1) + n * (off**2).sum(axis=1)).sum())


def _means(sums: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The mean of each cluster; one without points keeps its centre."""
    return np.where(sums[:, :1] > 0, sums[:, 1:3] / np.maximum(sums[:, :1], 1), centres)


def _first_centres(placed: DataFrame, cells: pd.DataFrame, k: int, seed: int, rounds: int) -> np.ndarray:
    """Where the iterations over all points start: k-means++ over the means of the cells, weighted, and its own iterations.

    Where few cells are occupied (all but a few points far closer to each other than these are), they do not show how
    the points lie; then Spark's k-means|| looks at the points.
    """
    if len(cells) < 8 * k:
        vectors = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(placed)
        return np.array(KMeans(k=k, seed=seed, maxIter=0).fit(vectors).clusterCenters())
    rng, n = np.random.default_rng(seed), cells["n"].to_numpy(dtype=float)
    at = cells[["x", "y"]].to_numpy() / n[:, None]
    chosen = [int(rng.choice(len(at), p=n / n.sum()))]
    gap = ((at - at[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        chosen.append(int(rng.choice(len(at), p=n * gap / (n * gap).sum())))
        gap = np.minimum(gap, ((at - at[chosen[-1]]) ** 2).sum(axis=1))
    centres = at[chosen]
    for _ in range(rounds):
        own = (at @ (-2 * centres.T) + (centres**2).sum(axis=1)).argmin(axis=1)
        sums = np.zeros((k, 3))
        np.add.at(sums, own, cells[_SUMS[:3]].to_numpy(dtype=float))
        centres = _means(sums, centres)
    return centres


def fit_centres(
    points: DataFrame, x: str, y: str, k: int, seed: int = 42, restarts: int = 1, max_iter: int = 20, tol: float = 1e-4
) -> list[tuple[float, float]]:
    """Cluster centres of the best of several starts, ordered by (x, y) so that cluster ids do not depend on the run.

    Every iteration takes in every point, but few of them singly: points are summed up per cell of a grid once, and a
    cell that no border between clusters crosses counts by its sums. The driver holds the cells, ``CLUSTER_GRID``
    squared at most.
    """
    placed, middle = _in_cells(points, x, y)
    placed = placed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        box = [f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))]
        cells = placed.groupBy(CELL).agg(*_sums(middle), *box).orderBy(CELL).collect()
        cells = pd.DataFrame([r.asDict() for r in cells])
        best, least = None, math.inf
        for start in range(restarts):
            centres = _first_centres(placed, cells, k, seed + start, max_iter)
            for _ in range(max_iter):
                before, centres = centres, _means(_clusters(placed, cells, centres, middle), centres)
                if np.hypot(*(centres - before).T).max() <= tol:
                    break
            cost = _cost(_clusters(placed, cells, centres, middle), centres, middle) if restarts > 1 else 0.0
            if cost < least:
                best, least = centres, cost
    finally:
        placed.unpersist()
    return sorted((float(cx), float(cy)) for cx, cy in best)


def cluster_features(
    trips: DataFrame, source: Sequence[Sequence[float]], destination: Sequence[Sequence[float]]
) -> DataFrame:
    check_required_columns(trips, ENDS, "cluster features")
    return trips.withColumns(
        {
            "source_cluster": nearest_centre("source_x", "source_y", source),
            "destination_cluster": nearest_centre("destination_x", "destination_y", destination),
        }
    )


def fit_axes(trips: DataFrame) -> dict[str, list[float]]:
    """Means and two principal axes of sources and destinations together, from one aggregate.

    In two dimensions the angle has a closed form. The largest component of each axis is positive.
    """
    both = trips.select(
        F.explode(
            F.array(
                F.struct(F.col("source_x").alias("x"), F.col("source_y").alias("y")),
                F.struct(F.col("destination_x").alias("x"), F.col("destination_y").alias("y")),
            )
        ).alias("p")
    ).select("p.x", "p.y")
    mx, my, vx, vy, cov = both.agg(
        F.avg("x"), F.avg("y"), F.var_pop("x"), F.var_pop("y"), F.covar_pop("x", "y")
    ).first()
    angle = 0.5 * math.atan2(2 * cov, vx - vy)
    axes = [[math.cos(angle), math.sin(angle)], [-math.sin(angle), math.cos(angle)]]
    axes = [[v if max(axis, key=abs) > 0 else -v for v in axis] for axis in axes]
    return {"means": [float(mx), float(my)], "first": axes[0], "second": axes[1]}


def pca_features(trips: DataFrame, axes: dict[str, list[float]]) -> DataFrame:
    check_required_columns(trips, ENDS, "pca features")
    return trips.withColumns(
        {
            f"{end}_pca_{i}": rotated(f"{end}_x", f"{end}_y", axes["means"], axes[axis])
            for end in ("source", "destination")
            for i, axis in ((1, "first"), (2, "second"))
        }
    )


def one_hot(df: DataFrame, column: str, size: int, prefix: str) -> DataFrame:
    """0/1 columns ``<prefix>_0 ... <prefix>_<size-1>``, all of them whatever values occur."""
    return df.withColumns({f"{prefix}_{i}": flag(F.col(column) == i) for i in range(size)})


def centre_distances(
    df: DataFrame, x: str, y: str, centres: Sequence[Sequence[float]], prefix: str
) -> DataFrame:
    return df.withColumns(
        {f"{prefix}_{i}": F.hypot(F.col(x) - cx, F.col(y) - cy) for i, (cx, cy) in enumerate(centres)}
    )


def cluster_target_means(df: DataFrame, cluster: str, target: str) -> dict[int, float]:
    """Mean target per cluster; one entry per cluster, so it is small by construction."""
    rows = df.groupBy(cluster).agg(F.avg(target).alias("m")).collect()
    return {int(r[0]): float(r["m"]) for r in rows if r[0] is not None}


def encode_target(column: str | Column, means: dict[int, float]) -> Column:
    """The mean of the row's cluster, 0 for a cluster not seen when fitting."""
    c = F.col(column) if isinstance(column, str) else column
    encoded = F.lit(None).cast("double")
    for cluster, mean in sorted(means.items()):
        encoded = F.when(c == cluster, F.lit(mean)).otherwise(encoded)
    return F.coalesce(encoded, F.lit(0.0))


def log_transform(df: DataFrame, columns: Sequence[str] = ("distance",)) -> DataFrame:
    return df.withColumns({c: F.log1p(c) for c in columns})


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column; a constant column gets scale 1."""
    row = df.agg(*[f(c) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    return {c: (float(row[2 * i]), float(row[2 * i + 1]) or 1.0) for i, c in enumerate(columns)}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - mean) / std for c, (mean, std) in fitted.items()})


class LogTarget:
    """log1p of the target, expm1 back."""

    def fit(self, df: DataFrame, column: str) -> LogTarget:
        return self

    def forward(self, y: Column) -> Column:
        return F.log1p(y)

    def inverse(self, z: Column) -> Column:
        return F.expm1(z)


class BoxCoxTarget:
    """Box-Cox with the likelihood maximised on a grid of exponents, then standardised. The target must be positive.

    All grid points are evaluated in the same aggregate, so fitting is one pass; a second, finer grid refines it.
    """

    def __init__(self, low: float = -2.0, high: float = 2.0, steps: int = 17, rounds: int = 3) -> None:
        self.low, self.high, self.steps, self.rounds = low, high, steps, rounds
        self.exponent, self.mean, self.std = 1.0, 0.0, 1.0

    @staticmethod
    def power(y: Column, exponent: float) -> Column:
        return F.log(y) if abs(exponent) < 1e-12 else (F.pow(y, F.lit(exponent)) - 1) / exponent

    @staticmethod
    def likelihoods(df: DataFrame, column: str, grid: Sequence[float]) -> list[float]:
        y = F.col(column)
        row = df.agg(
            F.count(y), F.sum(F.log(y)), *[F.var_pop(BoxCoxTarget.power(y, e)) for e in grid]
        ).first()
        n, logs = row[0], row[1]
        return [(e - 1) * logs - n / 2 * math.log(v) if v > 0 else -math.inf for e, v in zip(grid, row[2:])]

    def fit(self, df: DataFrame, column: str) -> BoxCoxTarget:
        low, high = self.low, self.high
        for _ in range(self.rounds):
            step = (high - low) / (self.steps - 1)
            grid = [round(low + i * step, 12) for i in range(self.steps)]
            scores = self.likelihoods(df, column, grid)
            self.exponent = grid[max(range(len(grid)), key=scores.__getitem__)]
            low, high = self.exponent - step, self.exponent + step
        z = self.power(F.col(column), self.exponent)
        mean, std = df.agg(F.avg(z), F.stddev_pop(z)).first()
        self.mean, self.std = float(mean), float(std) or 1.0
        return self

    def forward(self, y: Column) -> Column:
        return (self.power(y, self.exponent) - self.mean) / self.std

    def inverse(self, z: Column) -> Column:
        raw = z * self.std + self.mean
        if abs(self.exponent) < 1e-12:
            return F.exp(raw)
        return F.pow(F.greatest(raw * self.exponent + 1, F.lit(0.0)), F.lit(1 / self.exponent))


def _interpolated(value: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Linear interpolation on a sorted grid, the middle of both ends on a flat stretch; one Arrow column in and out.

    A search in a grid of a thousand points is the one step here that column expressions do far slower.
    """
    axis, levels = np.asarray(xs, dtype=float), np.asarray(ys, dtype=float)

    @F.pandas_udf("double")
    def look_up(v: pd.Series) -> pd.Series:
        up = np.interp(v, axis, levels)
        down = -np.interp(-v, -axis[::-1], -levels[::-1])
        return pd.Series((up + down) / 2).where(v.notna().to_numpy())

    return look_up(value)


class QuantileNormalTarget:
    """Target to a normal distribution through a grid of quantiles, and back through the same grid."""

    EDGE = 1e-7

    def __init__(self, quantiles: int = 1000) -> None:
        self.quantiles = quantiles
        self.grid: list[float] = []

    def fit(self, df: DataFrame, column: str) -> QuantileNormalTarget:
        self.grid = quantile_grid(df, column, self.quantiles)
        return self

    def _ranks(self) -> np.ndarray:
        return np.linspace(0, 1, len(self.grid))

    def forward(self, y: Column) -> Column:
        rank = _interpolated(y.cast("double"), self.grid, self._ranks())
        return normal_quantile(F.greatest(F.lit(self.EDGE), F.least(F.lit(1 - self.EDGE), rank)))

    def inverse(self, z: Column) -> Column:
        return _interpolated(normal_cdf(z), self._ranks(), self.grid)
