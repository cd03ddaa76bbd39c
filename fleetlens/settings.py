"""Default parameters. Every operator takes its own as arguments; these are only the defaults."""

from __future__ import annotations

# The scenario clock and the quality filters that results must agree on.
SCENARIO_SECONDS = 36_000
REPLAY_SECONDS = 72_000
WINDOW_SECONDS = 300
SECONDS_PER_HOUR = 3_600
MPS_TO_KMH = 3.6
FUEL_MG_PER_LITRE = 740_000

ETA_MIN_DURATION = 30
ETA_MIN_DISTANCE = 200
STOPS_MIN_DURATION = 60.0
STOPS_MIN_DISTANCE = 500.0
STOPS_MIN_RECORDS = 2
FUEL_MIN_POINTS = 30
FUEL_START_HOUR_LIMIT = 10
RETRAINING_TRIPS = 10_000
SUB_TRIP_RATE = 0.0
SUB_TRIP_MIN_RATIO = 0.5

# Feature parameters.
SCENARIO_HOURS = 10
MORNING_LAST_HOUR = 2
NOON_FIRST_HOUR = 3
NOON_LAST_HOUR = 6
AFTERNOON_FIRST_HOUR = 7
RUSH_HOURS = (0, 1, 8, 9)
DISTANCE_PERCENTILES = (0.25, 0.5, 0.75)
FOURIER_FREQUENCIES = 2
FOURIER_SCALE = 1000
CELL_METRES = 100
ETA_CLUSTERS = 20
FUEL_CLUSTERS = 10
STOPS_CLUSTERS = 7
CLUSTER_RESTARTS = 10
CORRELATION_LIMIT = 0.95
RANKING_ALPHA = 0.5
STRATA = 10
FOLDS = 5
PERMUTATION_REPEATS = 100

# Drift detection.
SMOOTHING_SAMPLES = 2_500
GRACE_SAMPLES = 5_000
CALIBRATION_SAMPLES = 10_000
CONSENSUS = 3
HIGH_STRIDE = 5
LOW_STRIDE = 2
STRIDE_SWITCH = 5_000
ADWIN_DELTAS = (
    0.01, 0.005, 0.002, 0.001, 0.0005, 0.0002, 0.0001, 0.00005, 0.00002, 0.00001, 0.000005, 0.000002, 0.000001,
    5e-7, 1e-7, 5e-8, 1e-8, 5e-9, 1e-9, 5e-10, 1e-10, 5e-11, 1e-11, 5e-12, 1e-12, 5e-13, 1e-13, 5e-14, 1e-14,
    5e-15, 1e-15,
)
PAGE_HINKLEY_DELTAS = (0.0001, 0.001, 0.01, 0.1)
PAGE_HINKLEY_THRESHOLDS = (2500.0, 5000.0, 10000.0, 20000.0, 50000.0, 200000.0, 500000.0)
KSWIN_ALPHAS = (0.001, 0.0005, 0.0001, 5e-5, 2e-5, 1e-5, 5e-6, 1e-6, 5e-7, 1e-7, 1e-8)
KSWIN_SIZES = ((6000, 3000), (8000, 4000), (11000, 5000), (12500, 6000))
PAGE_HINKLEY_KEEP = 0.9999
KSWIN_LEAST = 0.1
SPC_SIGMAS = (3.0, 3.5, 4.0, 4.5, 5.0, 6.0)
SPC_MIN_STD = 1e-6
SPC_RUNS = ((4500, 450), (5400, 540), (7200, 720))
METRIC_HISTORY = 1000
NOTIFICATION_HISTORY = 100

# Per task, training sample counts, collection seconds and tree shrink factor.
TRAINING_SAMPLES = {"eta": 53_229, "fuel": 53_441, "stops": 40_284}
COLLECT_SECONDS = {"eta": 3_600, "fuel": 7_200, "stops": 3_600}
SHRINK_FACTOR = 0.5
MIN_NEW_TREES = 10

# Feature names by category.
FEATURE_CATEGORIES = {
    "original": ["source_x", "source_y", "destination_x", "destination_y", "time_start", "distance"],
    "temporal": ["hour_bin", "is_morning", "is_noon", "is_afternoon", "is_rush_hour"],
    "spatial": [
        "x_center", "y_center", "x_difference", "y_difference", "euclidean_distance", "route_efficiency",
        "detour_length", "trip_bearing", "trip_bearing_sin", "trip_bearing_cos", "is_short_distance",
        "is_medium_distance", "is_long_distance", "source_distance_from_city_center",
        "destination_distance_from_city_center", "trip_centrality_change", "trip_centrality",
    ],
    "fourier": [
        f"{end}_{axis}_{wave}_{i}"
        for end in ("source", "destination") for axis in "xy" for wave in ("sin", "cos") for i in range(2)
    ],
    "cell": ["source_cell_x", "source_cell_y", "destination_cell_x", "destination_cell_y"],
    "cluster": ["source_cluster", "destination_cluster"],
    "pca": ["source_pca_1", "source_pca_2", "destination_pca_1", "destination_pca_2"],
}

# The columns of the ETA model besides the target.
ETA_MODEL_FEATURES = [
    "source_x", "source_y", "destination_x", "destination_y", "time_start", "distance", "x_center", "y_center",
    "euclidean_distance", "detour_length", "is_short_distance", "is_medium_distance", "is_long_distance",
    "source_distance_from_city_center", "destination_distance_from_city_center", "trip_centrality",
    "source_cluster", "destination_cluster", "source_pca_1", "source_pca_2", "destination_pca_1",
    "destination_pca_2",
]

# Scale limits of our own. A window group above GROUP_ROWS is cut into chunks; a table above LOOKUP_ROWS or LOOKUP_BYTES
# is not broadcast; a join key with more than HOT_ROWS rows is salted, the HOT_KEYS most frequent ones at most.
GROUP_ROWS = 2_000_000
MOST_CHUNKS = 500
BUCKET_ROWS = 200_000  # of one hash range over all groups together
CLUSTER_GRID = 256  # cells along each axis; the driver gets one row of sums for each occupied one
LOOKUP_ROWS = 200_000
LOOKUP_BYTES = 64 << 20
HOT_ROWS = 1_000_000
HOT_KEYS = 10_000
SALTS = 64
