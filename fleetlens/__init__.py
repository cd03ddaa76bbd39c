"""Trip analytics and drift monitoring for vehicle telemetry, written as Spark jobs."""
