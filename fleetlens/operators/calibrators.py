"""Calibrators: fitted on training trips, applied to any trips. State is plain numbers, kept as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import settings as S
from fleetlens.functions.columns import hour_of, nearest_centre
from fleetlens.operators import features as X
from fleetlens.operators.prep import check_required_columns, keep_fuel_trips, select_model_columns
from fleetlens.operators.routes import edge_array_statistics
from fleetlens.operators.trips import extract_stop_trips, fuel_trips
from fleetlens.session import stage

GROUPS = ("temporal", "spatial", "fourier", "cell", "cluster", "pca")
_KINDS: dict[str, type] = {}


class Calibrator:
    """Saving and loading with a check of the kind."""

    def __init_subclass__(cls) -> None:
        _KINDS[cls.__name__] = cls

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"kind": type(self).__name__, "state": asdict(self)})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Calibrator:
        stored = json.loads(spark.read.text(path).first()[0])
        if _KINDS.get(stored["kind"]) is not cls:
            raise TypeError(f"{path} holds a {stored['kind']}, not a {cls.__name__}")
        return cls(**stored["state"])


@dataclass
class FeatureCalibrator(Calibrator):
    """Any of the six feature groups."""

    groups: list[str]
    percentiles: list[float] = field(default_factory=list)
    centre: list[float] = field(default_factory=list)
    source_centres: list = field(default_factory=list)
    destination_centres: list = field(default_factory=list)
    axes: dict = field(default_factory=dict)

    @classmethod
    def fit(
        cls, trips: DataFrame, groups: tuple[str, ...] = GROUPS, clusters: int = S.ETA_CLUSTERS, seed: int = 42
    ) -> FeatureCalibrator:
        unknown = set(groups) - set(GROUPS)
        if unknown:
            raise ValueError(f"unknown feature groups: {', '.join(sorted(unknown))}")
        state = cls(list(groups))
        if "spatial" in groups:
            check_required_columns(trips, [*X.ENDS, "distance"], "spatial calibration")
            state.percentiles = X.distance_percentiles(trips)
            state.centre = list(X.midpoint_centre(trips))
        if "cluster" in groups:
            check_required_columns(trips, X.ENDS, "cluster calibration")
            state.source_centres = X.fit_centres(trips, "source_x", "source_y", clusters, seed)
            state.destination_centres = X.fit_centres(trips, "destination_x", "destination_y", clusters, seed)
        if "pca" in groups:
            check_required_columns(trips, X.ENDS, "pca calibration")
            state.axes = X.fit_axes(trips)
        return state

    def transform(self, trips: DataFrame) -> DataFrame:
        steps = {
            "temporal": X.temporal_features,
            "spatial": lambda d: X.spatial_features(d, self.percentiles, tuple(self.centre)),
            "fourier": X.fourier_features,
            "cell": X.cell_features,
            "cluster": lambda d: X.cluster_features(d, self.source_centres, self.destination_centres),
            "pca": lambda d: X.pca_features(d, self.axes),
        }
        for group in GROUPS:
            if group in self.groups:
                trips = steps[group](trips)
        return trips


@dataclass
class FeatureCalibratorETA(Calibrator):
    """The fixed 22 columns of the ETA model, plus the target and whatever else the trips hold."""

    percentiles: list[float]
    centre: list[float]
    source_centres: list
    destination_centres: list
    axes: dict

    _DROPPED: ClassVar[list[str]] = [
        "x_difference", "y_difference", "route_efficiency", "trip_bearing", "trip_bearing_sin", "trip_bearing_cos",
        "trip_centrality_change",
    ]

    @classmethod
    def fit(cls, trips: DataFrame, clusters: int = S.ETA_CLUSTERS, seed: int = 42) -> FeatureCalibratorETA:
        check_required_columns(trips, [*X.ENDS, "distance"], "ETA calibration")
        inner = FeatureCalibrator.fit(trips, ("spatial", "cluster", "pca"), clusters, seed)
        return cls(inner.percentiles, inner.centre, inner.source_centres, inner.destination_centres, inner.axes)

    def transform(self, trips: DataFrame) -> DataFrame:
        check_required_columns(trips, [*X.ENDS, "distance", "time_start"], "ETA transformation")
        spatial = X.spatial_features(trips, self.percentiles, tuple(self.centre)).drop(*self._DROPPED)
        clustered = X.cluster_features(spatial, self.source_centres, self.destination_centres)
        return X.pca_features(clustered, self.axes)


@dataclass
class FeatureCalibratorFuel(Calibrator):
    """Fuel trips from telemetry or from ready trips, with one-hot start and end clusters."""

    start_centres: list
    end_centres: list

    CORE: ClassVar[list[str]] = [
        "timestep_time_min", "start_hour", "vehicle_x_first", "vehicle_y_first", "vehicle_x_last", "vehicle_y_last",
        "trip_actual_distance", "spatial_extent", "straight_line_distance",
    ]
    TARGET: ClassVar[str] = "vehicle_fuel_log_sum"
    TELEMETRY: ClassVar[list[str]] = [
        "vehicle_id", "timestep_time", "vehicle_x", "vehicle_y", "vehicle_odometer", "vehicle_fuel",
    ]

    @classmethod
    def fit(
        cls, fcd: DataFrame, clusters: int = S.FUEL_CLUSTERS, seed: int = 42, restarts: int = S.CLUSTER_RESTARTS,
        min_points: int = S.FUEL_MIN_POINTS,
    ) -> FeatureCalibratorFuel:
        check_required_columns(fcd, cls.TELEMETRY, "fuel calibration")
        trips = stage(keep_fuel_trips(fuel_trips(fcd, min_points)), "fuel-trips")
        return cls(
            X.fit_centres(trips, "vehicle_x_first", "vehicle_y_first", clusters, seed, restarts),
            X.fit_centres(trips, "vehicle_x_last", "vehicle_y_last", clusters, seed, restarts),
        )

    @property
    def feature_columns(self) -> list[str]:
        starts = [f"start_cluster_{i}" for i in range(len(self.start_centres))]
        return [*self.CORE, *starts, *[f"end_cluster_{i}" for i in range(len(self.end_centres))]]

    def transform(self, df: DataFrame, min_points: int = S.FUEL_MIN_POINTS, keep: tuple[str, ...] = ()) -> DataFrame:
        if "trip_actual_distance" in df.columns:
            trips = df
        else:
            check_required_columns(df, self.TELEMETRY, "fuel transformation")
            trips = fuel_trips(df, min_points)
        derived = {
            "start_hour": lambda: (hour_of("timestep_time_min") % 24).cast("int"),
            "straight_line_distance": lambda: F.hypot(
                F.col("vehicle_x_last") - F.col("vehicle_x_first"), F.col("vehicle_y_last") - F.col("vehicle_y_first")
            ),
            "spatial_extent": lambda: F.hypot(
                F.col("maximum_x") - F.col("minimum_x"), F.col("maximum_y") - F.col("minimum_y")
            ),
        }
        trips = trips.withColumns({n: make() for n, make in derived.items() if n not in trips.columns})
        trips = trips.withColumns(
            {
                "_start": nearest_centre("vehicle_x_first", "vehicle_y_first", self.start_centres),
                "_end": nearest_centre("vehicle_x_last", "vehicle_y_last", self.end_centres),
            }
        )
        trips = X.one_hot(trips, "_start", len(self.start_centres), "start_cluster")
        trips = X.one_hot(trips, "_end", len(self.end_centres), "end_cluster")
        target = [self.TARGET] if self.TARGET in trips.columns else []
        return select_model_columns(trips, [*keep, *self.feature_columns, *target])


@dataclass
class FeatureCalibratorStops(Calibrator):
    """Stops trips: route statistics, distances to centres and target encoding of clusters."""

    use_spatial: bool = True
    use_routes: bool = True
    centre: list[float] = field(default_factory=list)
    source_centres: list = field(default_factory=list)
    destination_centres: list = field(default_factory=list)
    source_means: list = field(default_factory=list)
    destination_means: list = field(default_factory=list)

    @classmethod
    def fit(
        cls, fcd: DataFrame, target: str = "actual_stops", clusters: int = S.STOPS_CLUSTERS, seed: int = 0,
        restarts: int = S.CLUSTER_RESTARTS, use_spatial: bool = True, use_routes: bool = True, **extract,
    ) -> FeatureCalibratorStops:
        state = cls(use_spatial, use_routes)
        if not use_spatial:
            return state
        trips = stage(extract_stop_trips(fcd, use_routes=use_routes, **extract), "stop-trips")
        return state.fit_trips(trips, target, clusters, seed, restarts)

    def fit_trips(
        self, trips: DataFrame, target: str = "actual_stops", clusters: int = S.STOPS_CLUSTERS, seed: int = 0,
        restarts: int = S.CLUSTER_RESTARTS,
    ) -> FeatureCalibratorStops:
        self.centre = list(X.mean_point(trips, "trip_start_x", "trip_start_y"))
        self.source_centres = X.fit_centres(trips, "trip_start_x", "trip_start_y", clusters, seed, restarts)
        self.destination_centres = X.fit_centres(trips, "trip_end_x", "trip_end_y", clusters, seed + 1, restarts)
        return self.fit_means(trips, target)

    def fit_means(self, trips: DataFrame, target: str = "actual_stops") -> FeatureCalibratorStops:
        placed = self._clusters(trips)
        self.source_means = sorted(X.cluster_target_means(placed, "source_cluster", target).items())
        self.destination_means = sorted(X.cluster_target_means(placed, "dest_cluster", target).items())
        return self

    def _clusters(self, trips: DataFrame) -> DataFrame:
        return trips.withColumns(
            {
                "source_cluster": nearest_centre("trip_start_x", "trip_start_y", self.source_centres),
                "dest_cluster": nearest_centre("trip_end_x", "trip_end_y", self.destination_centres),
            }
        )

    def transform(self, trips: DataFrame) -> DataFrame:
        needed = ["trip_start_x", "trip_start_y", "trip_end_x", "trip_end_y", "actual_distance"]
        check_required_columns(trips, [*needed, *(["route_edges"] if self.use_routes else [])], "stops transformation")
        if self.use_routes:
            trips = trips.withColumns(edge_array_statistics("route_edges"))
        if not self.use_spatial:
            return trips
        if "straight_distance" not in trips.columns:
            gap = F.hypot(F.col("trip_end_x") - F.col("trip_start_x"), F.col("trip_end_y") - F.col("trip_start_y"))
            trips = trips.withColumn("straight_distance", gap)
        placed = self._clusters(trips)
        ends = (
            ("source", "src", "trip_start", self.source_centres, self.source_means),
            ("dest", "dst", "trip_end", self.destination_centres, self.destination_means),
        )
        for end, short, at, centres, means in ends:
            radial = F.hypot(F.col(f"{at}_x") - self.centre[0], F.col(f"{at}_y") - self.centre[1])
            placed = placed.withColumns(
                {
                    f"{end}_dist_to_center": radial,
                    f"{end}_cluster_target_encoded": X.encode_target(f"{end}_cluster", {int(k): v for k, v in means}),
                }
            )
            placed = X.one_hot(placed, f"{end}_cluster", len(centres), f"{short}_cluster")
            placed = X.centre_distances(placed, f"{at}_x", f"{at}_y", centres, f"{short}_dist_to_cluster")
        return placed
