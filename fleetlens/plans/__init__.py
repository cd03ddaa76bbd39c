"""Registered queries over the given tables, each with its SQL twin where one exists."""

from importlib import import_module

MODULES = ["telemetry_queries", "trip_queries", "report_queries", "drift_queries", "model_queries", "stream_queries"]


def load_catalog() -> tuple[dict, dict]:
    from fleetlens.plans import catalog

    for module in MODULES:
        import_module(f"fleetlens.plans.{module}")
    return catalog.QUERIES, catalog.TWINS
