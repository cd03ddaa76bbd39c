"""The given tables in the roles of telemetry, trips, errors, results; each with the SQL that builds the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.plans.catalog import seconds, table

EPOCH = 1_704_067_200  # 2024-01-01, the first day of the events table
SECOND_SCENARIO = 15 * 86_400  # the second half of the month plays the changed scenario
GAP = 6 * 3_600  # a pause above six hours starts a new trip
TASKS = ["click", "error", "purchase", "signup", "view"]
MODELS = ["A", "N", "R"]


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    at = seconds("ts") - EPOCH
    return e.select(
        "event_id", "user_id", F.col("user_id").cast("string").alias("vehicle_id"), at.alias("timestep_time"),
        F.col("value").alias("vehicle_speed"), (F.col("value") * 3).alias("vehicle_fuel"),
        F.col("value").alias("vehicle_x"),
        F.get_json_object("props", "$.k").cast("double").alias("vehicle_y"),
        (at * F.lit(0.01)).alias("vehicle_odometer"),
        F.concat_ws("_", "event_type", (F.col("event_id") % 3).cast("string")).alias("vehicle_lane"),
    )


TELEMETRY_SQL = f"""telemetry AS (
  SELECT event_id, user_id, CAST(user_id AS VARCHAR) AS vehicle_id,
         CAST(floor(epoch(ts)) AS BIGINT) - {EPOCH} AS timestep_time,
         value AS vehicle_speed, value * 3 AS vehicle_fuel, value AS vehicle_x,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS vehicle_y,
         (CAST(floor(epoch(ts)) AS BIGINT) - {EPOCH}) * CAST(0.01 AS DOUBLE) AS vehicle_odometer,
         event_type || '_' || CAST(event_id % 3 AS VARCHAR) AS vehicle_lane
  FROM events)"""


def trips(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("trip_id"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("scenario"),
        (price / 10 - 5000).alias("source_x"), (quantity * 100 - 2500).alias("source_y"),
        ((F.col("l_partkey") * 37 % 10000).cast("double") - 5000).alias("destination_x"),
        ((F.col("l_suppkey") * 91 % 5000).cast("double") - 2500).alias("destination_y"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 97) % 36000).alias("time_start"),
        (price / 20 + F.col("l_discount") * 1000).alias("distance"),
        F.floor(price / 100 + quantity * 3 + F.col("l_orderkey") % 50).alias("duration"),
    )


TRIPS_SQL = """trips AS (
  SELECT l_orderkey * 8 + l_linenumber AS trip_id, l_partkey AS part, l_suppkey AS supplier,
         l_returnflag AS model, l_linestatus AS scenario,
         l_extendedprice / 10 - 5000 AS source_x, l_quantity * 100 - 2500 AS source_y,
         CAST(l_partkey * 37 % 10000 AS DOUBLE) - 5000 AS destination_x,
         CAST(l_suppkey * 91 % 5000 AS DOUBLE) - 2500 AS destination_y,
         (l_orderkey * 7 + l_linenumber * 97) % 36000 AS time_start,
         l_extendedprice / 20 + l_discount * 1000 AS distance,
         CAST(floor(l_extendedprice / 100 + l_quantity * 3 + l_orderkey % 50) AS BIGINT) AS duration
  FROM lineitem)"""

ROW_ID = ["trip_id", "part", "supplier"]


def errors(spark: SparkSession, folder: str) -> DataFrame:
    """Absolute errors of a fixed prediction per task; 1.6 times as large in the second scenario."""
    e = table(spark, folder, "events")
    at = seconds("ts") - EPOCH
    k = F.get_json_object("props", "$.k").cast("double")
    grown = F.when(at >= SECOND_SCENARIO, F.col("value") * 1.6).otherwise(F.col("value"))
    return e.select(
        F.col("event_type").alias("task"), at.alias("ts"), F.col("event_id").alias("seq"),
        grown.alias("truth"), (k * 0.1 + 20).alias("prediction"),
        F.abs(grown - (k * 0.1 + 20)).alias("error"),
    )


ERRORS_SQL = f"""errors AS (
  SELECT task, ts, seq, truth, prediction, abs(truth - prediction) AS error FROM (
    SELECT event_type AS task, CAST(floor(epoch(ts)) AS BIGINT) - {EPOCH} AS ts, event_id AS seq,
           CASE WHEN CAST(floor(epoch(ts)) AS BIGINT) - {EPOCH} >= {SECOND_SCENARIO}
                THEN value * CAST(1.6 AS DOUBLE) ELSE value END AS truth,
           CAST(json_extract_string(props, '$.k') AS DOUBLE) * CAST(0.1 AS DOUBLE) + 20 AS prediction
    FROM events))"""


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Metric rows per experiment (ship month), model and fold, aggregated from all line items."""
    li = table(spark, folder, "lineitem")
    part = F.month("l_shipdate") % 4
    kind = F.when(part == 0, "Features_").when(part == 1, "transform_").when(part == 2, "baseline_").otherwise("research_")
    return li.groupBy(
        F.concat(kind, F.month("l_shipdate").cast("string")).alias("experiment"),
        F.col("l_returnflag").alias("model"), F.pmod(F.col("l_linenumber"), F.lit(5)).alias("fold"),
    ).agg(
        F.avg("l_quantity").alias("training_time"), F.avg("l_tax").alias("prediction_time"),
        F.avg("l_discount").alias("evaluation_time"), F.avg("l_extendedprice").alias("mae"),
        F.avg(F.col("l_tax") + F.col("l_discount")).alias("mape"),
    )


RESULTS_SQL = """folds AS (
  SELECT CASE month(l_shipdate) % 4 WHEN 0 THEN 'Features_' WHEN 1 THEN 'transform_' WHEN 2 THEN 'baseline_'
              ELSE 'research_' END || CAST(month(l_shipdate) AS VARCHAR) AS experiment,
         l_returnflag AS model, l_linenumber % 5 AS fold, avg(l_quantity) AS training_time,
         avg(l_tax) AS prediction_time, avg(l_discount) AS evaluation_time, avg(l_extendedprice) AS mae,
         avg(l_tax + l_discount) AS mape
  FROM lineitem GROUP BY 1, 2, 3)"""


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as one finished trial: MAE from its price, parameters from its keys, study from its priority."""
    o = table(spark, folder, "orders")
    return o.select(
        F.concat(F.lit("tuning_"), F.substring("o_orderpriority", 1, 1)).alias("experiment"),
        F.col("o_orderstatus").alias("model"), F.col("o_orderkey").alias("trial_number"),
        F.col("o_totalprice").alias("mae"), (F.col("o_custkey") % 10 + 3).alias("max_depth"),
        (F.col("o_orderkey") % 97 / 97.0).alias("learning_rate"),
    )


TRIALS_SQL = """trials AS (
  SELECT 'tuning_' || substr(o_orderpriority, 1, 1) AS experiment, o_orderstatus AS model,
         o_orderkey AS trial_number, o_totalprice AS mae, o_custkey % 10 + 3 AS max_depth,
         (o_orderkey % 97) / CAST(97 AS DOUBLE) AS learning_rate
  FROM orders)"""


def importances(spark: SparkSession, folder: str) -> DataFrame:
    """Importance per method (line status), model (return flag), feature (quantity) and fold, from all line items."""
    li = table(spark, folder, "lineitem")
    return li.groupBy(
        F.col("l_linestatus").alias("method"), F.col("l_returnflag").alias("model"),
        F.concat(F.lit("feature_"), F.col("l_quantity").cast("int").cast("string")).alias("feature"),
        F.pmod(F.col("l_linenumber"), F.lit(5)).alias("fold"),
    ).agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("importance"))


IMPORTANCE_SQL = """importances AS (
  SELECT l_linestatus AS method, l_returnflag AS model, 'feature_' || CAST(CAST(l_quantity AS INT) AS VARCHAR) AS feature,
         l_linenumber % 5 AS fold, sum(l_extendedprice * l_discount) AS importance
  FROM lineitem GROUP BY 1, 2, 3, 4)"""
