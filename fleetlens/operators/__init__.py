"""DataFrame operators: telemetry to trips, features, statistics, joins, folds, models."""
