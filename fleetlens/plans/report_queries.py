"""Queries over run results, trials, importance tables, joins, routes, text and model versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import settings as S
from fleetlens.functions import columns as C
from fleetlens.operators import joins, prep, ranking, reports, routes, stats
from fleetlens.operators.ordered import OrderedRows
from fleetlens.plans import inputs as I
from fleetlens.plans.catalog import query, rounded, rounded_sql, seconds, table
from fleetlens.schemas import METRICS
from fleetlens.session import shared_path
from fleetlens.session import stage
from fleetlens.sources import integrity, registry, results as R

MEANS = ", ".join(f"avg({m}) AS {m}" for m in METRICS)
METRICS_SQL = rounded_sql(", ".join(METRICS))


def averaged(spark, folder):
    return stats.mean_metrics(I.results(spark, folder), ["experiment", "model"], METRICS)


AVERAGED_SQL = f"{I.RESULTS_SQL}, runs AS (SELECT experiment, model, {MEANS} FROM folds GROUP BY 1, 2)"


@query("mean_over_folds", f"WITH {AVERAGED_SQL} SELECT experiment, model, {METRICS_SQL} FROM runs")
def mean_over_folds(spark, folder):
    return rounded(averaged(spark, folder))


@query(
    "results_json_round_trip",
    f"WITH {AVERAGED_SQL} SELECT experiment, model, {METRICS_SQL} FROM runs ORDER BY 1, 2",
)
def results_json_round_trip(spark, folder):
    """Run results with their folds to one nested JSON document per experiment and back to flat rows."""
    path = shared_path(spark, "outputs")
    R.save_results(averaged(spark, folder), path, I.results(spark, folder))
    return rounded(R.load_all_results(spark, path))


@query(
    "results_folds_round_trip",
    f"WITH {I.RESULTS_SQL} SELECT experiment, model, CAST(fold AS INT) AS fold, {METRICS_SQL} FROM folds",
)
def results_folds_round_trip(spark, folder):
    documents = R.run_results_json(averaged(spark, folder), I.results(spark, folder))
    parsed = R.parse_folds(documents)
    order = OrderedRows.lay_out(I.results(spark, folder).select("experiment", "model", F.col("fold").alias("real")),
                                ["experiment", "model"], ["real"]).numbered("_at").rows()
    real = order.select("experiment", "model", (F.col("_at") - 1).cast("int").alias("fold"), "real")
    named = parsed.join(real, ["experiment", "model", "fold"]).withColumn("fold", F.col("real").cast("int"))
    return rounded(named.drop("real"))


@query(
    "research_runs",
    f"""WITH {AVERAGED_SQL} SELECT experiment, model, {METRICS_SQL} FROM runs
    WHERE regexp_matches(experiment, 'transform|features|research', 'i') AND model <> 'R'""",
)
def research_runs(spark, folder):
    return rounded(prep.select_runs(averaged(spark, folder), without_model="R"))


@query(
    "research_csv_round_trip",
    f"""WITH {AVERAGED_SQL} SELECT experiment, model, round(mae, 4) AS mae, round(mape, 4) AS mape FROM runs""",
)
def research_csv_round_trip(spark, folder):
    path = shared_path(spark, "csv")
    R.save_csv(averaged(spark, folder).select("experiment", "model", "mae", "mape"), path)
    back = spark.read.schema("experiment string, model string, mae double, mape double").option("header", True).csv(path)
    return rounded(back, 4)


@query("metric_by_experiment", f"WITH {AVERAGED_SQL} SELECT experiment, round(avg(mae), 6) AS mae FROM runs GROUP BY 1")
def metric_by_experiment(spark, folder):
    return rounded(stats.mean_metrics(averaged(spark, folder), "experiment", ["mae"]))


@query("metric_by_model", f"WITH {AVERAGED_SQL} SELECT model, round(avg(mape), 6) AS mape FROM runs GROUP BY 1")
def metric_by_model(spark, folder):
    return rounded(stats.mean_metrics(averaged(spark, folder), "model", ["mape"]))


@query(
    "metric_heat_map",
    f"""WITH {AVERAGED_SQL} SELECT experiment, {", ".join(f"round(max(mae) FILTER (model = '{m}'), 6) AS {m}" for m in I.MODELS)}
    FROM runs GROUP BY 1""",
)
def metric_heat_map(spark, folder):
    return rounded(stats.pivot_metric(averaged(spark, folder), "experiment", "model", "mae", I.MODELS))


BOX_SQL = """box AS (SELECT model, quantile_cont(mae, 0.25) AS q1, median(mae) AS median, quantile_cont(mae, 0.75) AS q3
  FROM trials GROUP BY 1)"""


@query(
    "box_summary",
    f"""WITH {I.TRIALS_SQL}, {BOX_SQL} SELECT model, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
    round(any_value(q3), 6) AS q3,
    round(min(mae) FILTER (mae BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
    round(max(mae) FILTER (mae BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
    count(*) FILTER (NOT mae BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS n
    FROM trials JOIN box USING (model) GROUP BY model""",
)
def box_summary(spark, folder):
    return rounded(stats.box_summary(I.trials(spark, folder).select("model", "mae"), "model", "mae"))


@query(
    "box_outliers",
    f"""WITH {I.ERRORS_SQL}, box AS (SELECT task, quantile_cont(error, 0.25) AS a, quantile_cont(error, 0.75) AS b FROM errors GROUP BY 1)
    SELECT task, seq, round(error, 6) AS error FROM errors JOIN box USING (task)
    WHERE error < a - 1.5 * (b - a) OR error > b + 1.5 * (b - a)""",
)
def box_outliers(spark, folder):
    rows = I.errors(spark, folder).select("task", "seq", "error")
    return rounded(stats.box_outliers(rows, "task", "error"))


@query(
    "parameter_trends",
    f"""WITH {I.TRIALS_SQL}
    SELECT model, 'max_depth' AS parameter, round(regr_slope(mae, max_depth), 4) AS slope, round(regr_intercept(mae, max_depth), 4) AS intercept FROM trials GROUP BY 1
    UNION ALL SELECT model, 'learning_rate', round(regr_slope(mae, learning_rate), 4), round(regr_intercept(mae, learning_rate), 4) FROM trials GROUP BY 1""",
)
def parameter_trends(spark, folder):
    return rounded(stats.trends(I.trials(spark, folder), "model", "mae", ["max_depth", "learning_rate"]), 4)


@query(
    "convergence",
    f"""WITH {I.TRIALS_SQL} SELECT model, trial_number,
    row_number() OVER w - 1 AS trial, round(min(mae) OVER w, 6) AS best_mae FROM trials
    WINDOW w AS (PARTITION BY model ORDER BY experiment, trial_number ROWS UNBOUNDED PRECEDING)""",
)
def convergence(spark, folder):
    done = reports.convergence(I.trials(spark, folder))
    return rounded(done.select("model", "trial_number", "trial", "best_mae"))


@query(
    "best_tenth_of_trials",
    f"""WITH {I.TRIALS_SQL} SELECT model, trial_number, round(mae, 6) AS mae FROM (
      SELECT *, row_number() OVER (PARTITION BY model ORDER BY mae, trial_number) AS rn, count(*) OVER (PARTITION BY model) AS n
      FROM trials) WHERE rn <= greatest(1, n // 10)""",
)
def best_tenth_of_trials(spark, folder):
    best = reports.best_share(I.trials(spark, folder), tiebreak=["trial_number"], group_rows=1000)
    return rounded(best.select("model", "trial_number", "mae"))


@query(
    "best_trial",
    f"""WITH {I.TRIALS_SQL} SELECT experiment, model, trial_number, round(mae, 6) AS mae, max_depth FROM (
      SELECT *, row_number() OVER (PARTITION BY experiment, model ORDER BY mae, trial_number) AS rn FROM trials) WHERE rn = 1""",
)
def best_trial(spark, folder):
    return rounded(reports.best_trial(I.trials(spark, folder), ["experiment", "model"], ["max_depth"]))


@query(
    "tuning_round_trip",
    f"""WITH {I.TRIALS_SQL} SELECT experiment, model, trial_number, round(mae, 4) AS mae,
    CAST(max_depth AS DOUBLE) AS max_depth, round(learning_rate, 6) AS learning_rate FROM trials WHERE trial_number % 10 <> 0""",
)
def tuning_round_trip(spark, folder):
    """Trials to study documents - one per study of 500 trials - and back; unfinished trials drop out on reading."""
    t = I.trials(spark, folder).select(
        F.concat_ws("/", "experiment", F.floor(F.col("trial_number") / 500).cast("string")).alias("experiment"), "model",
        "trial_number", "mae", F.when(F.col("trial_number") % 10 == 0, "PRUNED").otherwise("COMPLETE").alias("state"),
        F.create_map(F.lit("max_depth"), F.col("max_depth").cast("double"), F.lit("learning_rate"), "learning_rate").alias("params"),
        F.create_map(F.lit("mape"), F.col("mae") / 100).alias("user_attrs"),
    )
    back = R.spread_parameters(R.parse_studies(R.studies_json(t)), ["max_depth", "learning_rate"])
    named = back.withColumn("experiment", F.split("experiment", "/")[0]).withColumn("mae", F.round("mae", 4))
    return rounded(named.select("experiment", "model", "trial_number", "mae", "max_depth", "learning_rate"))


SHARES_SQL = f"""{I.IMPORTANCE_SQL}, shares AS (
  SELECT *, CASE WHEN sum(importance) OVER (PARTITION BY method, model, fold) > 0
    THEN importance / sum(importance) OVER (PARTITION BY method, model, fold) * 100 ELSE 0 END AS percentage FROM importances),
means AS (SELECT method, model, feature, avg(importance) AS importance_mean, avg(percentage) AS percentage_mean
  FROM shares GROUP BY 1, 2, 3)"""


def shares(spark, folder):
    return ranking.importance_share(I.importances(spark, folder), ["method", "model", "fold"])


def means(spark, folder):
    return ranking.mean_importance(shares(spark, folder), ["method", "model", "feature"])


@query(
    "importance_shares",
    f"WITH {SHARES_SQL} SELECT method, model, feature, fold, round(percentage, 6) AS percentage FROM shares",
)
def importance_shares(spark, folder):
    return rounded(shares(spark, folder).select("method", "model", "feature", "fold", "percentage"))


@query(
    "mean_importances",
    f"WITH {SHARES_SQL} SELECT method, model, feature, round(importance_mean, 4) AS importance_mean, round(percentage_mean, 4) AS percentage_mean FROM means",
)
def mean_importances(spark, folder):
    return rounded(means(spark, folder), 4)


@query(
    "cumulative_importances",
    f"""WITH {SHARES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY method, model ORDER BY importance_mean DESC, feature) AS rn FROM means)
    SELECT method, model, t AS top, round(sum(percentage_mean) FILTER (rn <= t), 4) AS cumulative
    FROM r, (SELECT unnest([10, 20, 30, 40, 50]) AS t) GROUP BY 1, 2, 3""",
)
def cumulative_importances(spark, folder):
    return rounded(ranking.cumulative_importance(means(spark, folder), by=("method", "model")), 4)


@query(
    "importance_ranks",
    f"""WITH {SHARES_SQL} SELECT method, model, feature, dense_rank() OVER (g ORDER BY percentage_mean DESC) AS rank,
    round((percentage_mean - min(percentage_mean) OVER g) / nullif(max(percentage_mean) OVER g - min(percentage_mean) OVER g, 0), 6) AS scaled
    FROM means WINDOW g AS (PARTITION BY method, model)""",
)
def importance_ranks(spark, folder):
    ranked = ranking.rank_and_scale(means(spark, folder), by=("method", "model"))
    return rounded(ranked.select("method", "model", "feature", "rank", "scaled"))


RANKING_SQL = f"""{SHARES_SQL}, kept AS (
  SELECT * FROM means WHERE NOT (method = 'O' AND feature IN ('feature_1', 'feature_2') AND model = 'A')),
ranked AS (
  SELECT method, model, feature, dense_rank() OVER (PARTITION BY method, model ORDER BY percentage_mean DESC) AS rk,
    (percentage_mean - min(percentage_mean) OVER (PARTITION BY method, model))
      / (max(percentage_mean) OVER (PARTITION BY method, model) - min(percentage_mean) OVER (PARTITION BY method, model)) AS sc
  FROM kept),
per_model AS (SELECT model, feature, avg(rk) AS r, avg(sc) AS s FROM ranked GROUP BY 1, 2),
final AS (SELECT feature, avg(r) AS final_rank, avg(s) AS final_scaled FROM per_model GROUP BY 1),
scored AS (SELECT *, (final_rank - min(final_rank) OVER ()) / (max(final_rank) OVER () - min(final_rank) OVER ()) AS normalized_rank FROM final),
ranking AS (SELECT *, 0.5 * final_scaled + 0.5 * (1 - normalized_rank) AS final_score FROM scored)"""


def final_ranking(spark, folder):
    """Two methods; one lacks two features for one model, as the outer join must bear."""
    m = means(spark, folder)
    first = m.where("method = 'F'")
    second = m.where("method = 'O' AND NOT (feature IN ('feature_1', 'feature_2') AND model = 'A')")
    return ranking.combine_rankings({"gain": first, "shap": second})


@query(
    "combined_ranking",
    f"WITH {RANKING_SQL} SELECT feature, {rounded_sql('final_rank, final_scaled, normalized_rank, final_score')} FROM ranking",
)
def combined_ranking(spark, folder):
    return rounded(final_ranking(spark, folder))


@query(
    "outer_join_of_methods",
    f"""WITH {RANKING_SQL} SELECT coalesce(a.model, b.model) AS model, coalesce(a.feature, b.feature) AS feature,
    round(a.percentage_mean, 4) AS percentage_mean_gain, round(b.percentage_mean, 4) AS percentage_mean_shap
    FROM (SELECT * FROM kept WHERE method = 'F' AND feature <> 'feature_9') a
    FULL JOIN (SELECT * FROM kept WHERE method = 'O') b ON a.model = b.model AND a.feature = b.feature""",
)
def outer_join_of_methods(spark, folder):
    m = means(spark, folder)
    tables = {
        "gain": m.where("method = 'F' AND feature <> 'feature_9'"),
        "shap": m.where("method = 'O' AND NOT (feature IN ('feature_1', 'feature_2') AND model = 'A')"),
    }
    return rounded(joins.full_outer_fold(tables, ["model", "feature"], ["percentage_mean"]), 4)


CATEGORY_NAMES = {"low": [f"feature_{i}" for i in range(1, 11)], "high": [f"feature_{i}" for i in range(40, 49)]}


@query(
    "feature_categories",
    f"""WITH {RANKING_SQL} SELECT feature, round(final_score, 6) AS final_score,
    CASE WHEN CAST(substr(feature, 9) AS INT) BETWEEN 1 AND 10 THEN 'low'
         WHEN CAST(substr(feature, 9) AS INT) BETWEEN 40 AND 48 THEN 'high' ELSE 'none' END AS category FROM ranking""",
)
def feature_categories(spark, folder):
    ranked = final_ranking(spark, folder).select("feature", "final_score")
    return rounded(prep.with_feature_category(ranked, CATEGORY_NAMES))


PAIRS_SQL = """pairs AS (
  SELECT DISTINCT 'feature_' || CAST(CAST(l_quantity AS INT) AS VARCHAR) AS feature_1,
         'feature_' || CAST(CAST(l_quantity AS INT) % 60 + 3 AS VARCHAR) AS feature_2, l_quantity / 50 AS correlation FROM lineitem)"""


@query(
    "correlated_pair_choice",
    f"""WITH {RANKING_SQL}, {PAIRS_SQL}, pos AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, feature) AS p FROM ranking),
    j AS (SELECT feature_1, feature_2, correlation, coalesce(a.final_score, -1) AS s1, coalesce(b.final_score, -1) AS s2,
      coalesce(a.p, -1) AS r1, coalesce(b.p, -1) AS r2 FROM pairs LEFT JOIN pos a ON feature_1 = a.feature LEFT JOIN pos b ON feature_2 = b.feature)
    SELECT feature_1, feature_2, round(correlation, 6) AS correlation, round(s1, 6) AS feature_1_score, round(s2, 6) AS feature_2_score,
    r1 AS feature_1_rank, r2 AS feature_2_rank, CASE WHEN s1 >= s2 THEN feature_1 ELSE feature_2 END AS keep,
    CASE WHEN s1 >= s2 THEN r1 ELSE r2 END AS keep_index, CASE WHEN s1 >= s2 THEN feature_2 ELSE feature_1 END AS drop,
    CASE WHEN s1 >= s2 THEN r2 ELSE r1 END AS drop_index FROM j""",
)
def correlated_pair_choice(spark, folder):
    q = F.col("l_quantity").cast("int")
    name = lambda c: F.concat(F.lit("feature_"), c.cast("string"))
    pairs = table(spark, folder, "lineitem").select(
        name(q).alias("feature_1"), name(q % 60 + 3).alias("feature_2"), (F.col("l_quantity") / 50).alias("correlation")
    ).distinct()
    return rounded(ranking.compare_correlated_pairs(pairs, final_ranking(spark, folder)))


@query(
    "default_lookup",
    """SELECT o_orderkey, coalesce(n.s, 0.0) AS balance FROM orders LEFT JOIN (
      SELECT c_custkey, round(c_acctbal, 2) AS s FROM customer WHERE c_custkey % 3 <> 0) n ON o_custkey = c_custkey""",
)
def default_lookup(spark, folder):
    known = table(spark, folder, "customer").where("c_custkey % 3 <> 0").select(
        F.col("c_custkey").alias("o_custkey"), F.round("c_acctbal", 2).alias("balance")
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return joins.lookup_with_default(orders, known, "o_custkey", "balance", 0.0).drop("o_custkey")


@query(
    "salted_lookup",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_size FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
)
def salted_lookup(spark, folder):
    """The path for tables that are too large to broadcast, with limits that the test tables exceed: parts of over 30 items are hot."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.lookup(items, parts, "l_partkey", rows=10, salts=8, hot_rows=30)


@query(
    "orders_of_active_customers",
    """SELECT o_orderkey, o_custkey FROM orders
    WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)""",
)
def orders_of_active_customers(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    active = orders.groupBy("o_custkey").count().where("count >= 12")
    return joins.keep_known(orders, active, "o_custkey")


@query(
    "nearest_edges",
    f"""WITH {I.TELEMETRY_SQL}, p AS (SELECT DISTINCT vehicle_x AS x, vehicle_y AS y FROM telemetry),
    t AS (SELECT s_suppkey AS target_id, CAST((s_suppkey * 37) % 101 AS DOUBLE) AS tx, CAST((s_suppkey * 53) % 97 AS DOUBLE) AS ty FROM supplier),
    d AS (SELECT x, y, target_id, sqrt((x - tx) ** 2 + (y - ty) ** 2) AS gap FROM p, t),
    best AS (SELECT x, y, arg_min(target_id, (gap, target_id)) AS target_id, min(gap) AS gap FROM d WHERE gap <= 8 GROUP BY 1, 2)
    SELECT event_id, best.target_id, round(best.gap, 6) AS gap FROM telemetry LEFT JOIN best ON vehicle_x = x AND vehicle_y = y""",
)
def nearest_edges(spark, folder):
    s = F.col("s_suppkey")
    targets = table(spark, folder, "supplier").select(
        s.alias("target_id"), (s * 37 % 101).cast("double").alias("x"), (s * 53 % 97).cast("double").alias("y")
    )
    points = I.telemetry(spark, folder).select("event_id", F.col("vehicle_x").alias("x"), F.col("vehicle_y").alias("y"))
    found = joins.nearest_within(points, targets, 8.0)
    return rounded(found.select("event_id", "target_id", "gap"))


ROUTES_SQL = """pts AS (SELECT vec_id, list_transform(range(0, 32), lambda i: {'x': CAST(embedding[2 * i + 1] AS DOUBLE),
  'y': CAST(embedding[2 * i + 2] AS DOUBLE)}) AS route, CAST(embedding[7] AS DOUBLE) + 0.05 AS sx, CAST(embedding[8] AS DOUBLE) - 0.02 AS sy,
  CAST(embedding[41] AS DOUBLE) - 0.03 AS dx, CAST(embedding[42] AS DOUBLE) + 0.04 AS dy FROM embeddings)"""


def route_rows(spark, folder):
    e = table(spark, folder, "embeddings")
    at = lambda i: F.element_at("embedding", i).cast("double")
    return e.select(
        "vec_id", routes.points_from_array("embedding").alias("route"), (at(7) + 0.05).alias("sx"),
        (at(8) - 0.02).alias("sy"), (at(41) - 0.03).alias("dx"), (at(42) + 0.04).alias("dy"),
    )


EDGES_SQL = f"""{ROUTES_SQL}, edge AS (SELECT vec_id AS edge_id, list_transform(route[1:4], lambda p: {{'x': 50 + 150 * p.x, 'y': 50 + 150 * p.y}}) AS shape FROM pts),
    seg AS (SELECT edge_id, shape[i] AS a, shape[i + 1] AS b FROM edge, (SELECT unnest(range(1, 4)) AS i))"""


@query(
    "nearest_edges_on_polylines",
    f"""WITH {I.TELEMETRY_SQL}, {EDGES_SQL}, p AS (SELECT DISTINCT vehicle_x AS x, vehicle_y AS y FROM telemetry),
    near AS (SELECT x, y, edge_id, a, b, ((x - a.x) * (b.x - a.x) + (y - a.y) * (b.y - a.y)) / ((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS t
      FROM p JOIN seg ON x BETWEEN least(a.x, b.x) - 3 AND greatest(a.x, b.x) + 3 AND y BETWEEN least(a.y, b.y) - 3 AND greatest(a.y, b.y) + 3),
    foot AS (SELECT x, y, edge_id, a, b, greatest(0.0, least(1.0, t)) AS t FROM near),
    d AS (SELECT x, y, edge_id, sqrt((x - a.x - t * (b.x - a.x)) ** 2 + (y - a.y - t * (b.y - a.y)) ** 2) AS gap FROM foot),
    best AS (SELECT x, y, arg_min(edge_id, (gap, edge_id)) AS edge_id, min(gap) AS gap FROM d WHERE gap <= 3 GROUP BY 1, 2)
    SELECT event_id, best.edge_id, round(best.gap, 6) AS gap FROM telemetry LEFT JOIN best ON vehicle_x = x AND vehicle_y = y""",
)
def nearest_edges_on_polylines(spark, folder):
    """Every telemetry record beside the edges' polylines: the first four vertices of a route, scaled to the records' area."""
    spread = lambda p: F.struct((50 + 150 * p["x"]).alias("x"), (50 + 150 * p["y"]).alias("y"))
    shape = F.transform(F.slice("route", 1, 4), spread)
    edges = route_rows(spark, folder).select(F.col("vec_id").alias("edge_id"), shape.alias("shape"))
    points = I.telemetry(spark, folder).select("event_id", F.col("vehicle_x").alias("x"), F.col("vehicle_y").alias("y"))
    found = joins.nearest_edge(points, edges, 3.0)
    return rounded(found.select("event_id", "edge_id", "gap"))


@query(
    "route_envelopes",
    f"""WITH {ROUTES_SQL} SELECT vec_id, round(list_min(list_transform(route, lambda p: p.x)), 6) AS minimum_x,
    round(list_max(list_transform(route, lambda p: p.x)), 6) AS maximum_x, round(list_min(list_transform(route, lambda p: p.y)), 6) AS minimum_y,
    round(list_max(list_transform(route, lambda p: p.y)), 6) AS maximum_y FROM pts""",
)
def route_envelopes(spark, folder):
    rows = route_rows(spark, folder)
    return rounded(routes.route_columns(rows, routes.route_envelope("route"), ["vec_id"]))


def segment_sql(px: str, py: str, name: str) -> str:
    return f"""{name}_p AS (SELECT vec_id, {px} AS px, {py} AS py, i, route[i + 1] AS a, route[i + 2] AS b
      FROM pts, (SELECT unnest(range(0, 31)) AS i)),
    {name}_t AS (SELECT *, greatest(0.0, least(1.0, ((px - a.x) * (b.x - a.x) + (py - a.y) * (b.y - a.y))
      / ((b.x - a.x) ** 2 + (b.y - a.y) ** 2))) AS t FROM {name}_p),
    {name}_q AS (SELECT vec_id, i, a.x + t * (b.x - a.x) AS qx, a.y + t * (b.y - a.y) AS qy, px, py FROM {name}_t),
    {name} AS (SELECT vec_id, CAST(arg_min(i, (sqrt((px - qx) ** 2 + (py - qy) ** 2), i)) AS INT) AS i,
      arg_min(qx, (sqrt((px - qx) ** 2 + (py - qy) ** 2), i)) AS qx, arg_min(qy, (sqrt((px - qx) ** 2 + (py - qy) ** 2), i)) AS qy,
      min(sqrt((px - qx) ** 2 + (py - qy) ** 2)) AS d FROM {name}_q GROUP BY vec_id)"""


@query(
    "nearest_segments",
    f"""WITH {ROUTES_SQL}, {segment_sql("sx", "sy", "s")} SELECT vec_id, i AS segment, round(qx, 6) + 0 AS x, round(qy, 6) + 0 AS y, round(d, 6) AS d FROM s""",
)
def nearest_segments(spark, folder):
    found = route_rows(spark, folder).select("vec_id", routes.nearest_segment("route", "sx", "sy").alias("n"))
    return rounded(found.select("vec_id", F.col("n.i").alias("segment"), "n.x", "n.y", "n.d"))


@query(
    "trimmed_routes",
    f"""WITH {ROUTES_SQL}, {segment_sql("sx", "sy", "s")}, {segment_sql("dx", "dy", "e")}
    SELECT vec_id, CAST(2 + greatest(e.i - s.i, 0) AS INT) AS vertices, round(s.qx, 6) + 0 AS first_x, round(e.qy, 6) + 0 AS last_y,
    round(s.qx + e.qx + coalesce(list_sum(list_transform(route[s.i + 2 : e.i + 1], lambda p: p.x)), 0), 5) + 0 AS sum_x
    FROM pts JOIN s USING (vec_id) JOIN e USING (vec_id)""",
)
def trimmed_routes(spark, folder):
    cut = routes.trim_route(route_rows(spark, folder), "route", ("sx", "sy"), ("dx", "dy"))
    total = F.aggregate("trimmed", F.lit(0.0), lambda acc, p: acc + p["x"])
    done = cut.select(
        "vec_id", F.size("trimmed").alias("vertices"), F.element_at("trimmed", 1)["x"].alias("first_x"),
        F.element_at("trimmed", -1)["y"].alias("last_y"), F.round(total, 5).alias("sum_x"),
    )
    return rounded(done)


@query(
    "joined_edge_shapes",
    f"""WITH {ROUTES_SQL} SELECT vec_id, CAST(32 + CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 1 END AS INT) AS vertices FROM pts""",
)
def joined_edge_shapes(spark, folder):
    """Each route cut in two; where the cut repeats its vertex the join drops one copy, else a vertex is added."""
    r = route_rows(spark, folder)
    extra = F.array(F.struct(F.lit(9.0).alias("x"), F.lit(9.0).alias("y")))
    tail = F.when(F.col("vec_id") % 2 == 0, F.slice("route", 10, 32)).otherwise(
        F.concat(extra, F.slice("route", 11, 32))
    )
    return r.select("vec_id", F.size(routes.join_edge_shapes(F.array(F.slice("route", 1, 10), tail))).alias("vertices"))


@query(
    "display_texts",
    """SELECT o_orderkey, 'Day ' || lpad(CAST(t // 36000 + 1 AS VARCHAR), 2, '0') || ' - '
      || lpad(CAST((t % 36000) // 3600 + 8 AS VARCHAR), 2, '0') || ':' || lpad(CAST((t % 3600) // 60 AS VARCHAR), 2, '0') AS clock,
    lpad(CAST(CAST(floor(o_totalprice / 100) AS BIGINT) // 60 AS VARCHAR), 2, '0') || ':'
      || lpad(CAST(CAST(floor(o_totalprice / 100) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ' min' AS eta,
    CAST(CAST(round_even((o_orderkey % 9) / CAST(2 AS DOUBLE), 0) AS BIGINT) AS VARCHAR) || CASE WHEN round_even((o_orderkey % 9) / CAST(2 AS DOUBLE), 0) = 1 THEN ' stop' ELSE ' stops' END AS stops
    FROM (SELECT *, o_orderkey * 61 % 3500000 AS t FROM orders)""",
)
def display_texts(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", C.simulation_clock(F.col("o_orderkey") * 61 % 3_500_000).alias("clock"),
        C.prediction_text("eta", F.col("o_totalprice") / 100).alias("eta"),
        C.prediction_text("stops", (F.col("o_orderkey") % 9) / 2.0).alias("stops"),
    )


@query(
    "without_special_tokens",
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(marked, '<｜.*?｜>', '', 'g'), '<\|.*?\|>', '', 'g'),
      '^\s+|\s+$', '', 'g') AS cleaned FROM (
      SELECT doc_id, '<|start|> ' || text || ' <｜end｜>' AS marked FROM documents)""",
)
def without_special_tokens(spark, folder):
    marked = F.concat(F.lit("<|start|> "), "text", F.lit(" <｜end｜>"))
    return table(spark, folder, "documents").select("doc_id", C.without_special_tokens(marked).alias("cleaned"))


@query(
    "next_versions",
    """SELECT o_orderstatus AS task, 'v' || CAST(coalesce(max(CASE WHEN regexp_matches(name, '^v[0-9]+$') THEN CAST(substr(name, 2) AS BIGINT) END), 0) + 1 AS VARCHAR) AS next_version
    FROM (SELECT o_orderstatus, CASE o_custkey % 3 WHEN 0 THEN 'v' || CAST(o_orderkey % 41 AS VARCHAR) WHEN 1 THEN 'vault' ELSE 'x9' END AS name FROM orders) GROUP BY 1""",
)
def next_versions(spark, folder):
    kind = F.col("o_custkey") % 3
    name = F.when(kind == 0, F.concat(F.lit("v"), (F.col("o_orderkey") % 41).cast("string"))).when(kind == 1, "vault").otherwise("x9")
    names = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("task"), name.alias("name"))
    return registry.next_version(names, by=("task",))


VERSIONS_SQL = f"""{I.ERRORS_SQL}, versions AS (
  SELECT task, ts AS valid_from, 'v' || CAST(row_number() OVER (PARTITION BY task ORDER BY ts, seq) AS VARCHAR) AS version
  FROM errors WHERE seq % 211 = 0)"""


def version_rows(spark, folder):
    marks = I.errors(spark, folder).where("seq % 211 = 0").select("task", "ts", "seq")
    laid = OrderedRows.lay_out(marks, ["task"], ["ts", "seq"]).numbered("_v").rows()
    return laid.select("task", F.col("ts").alias("valid_from"), F.concat(F.lit("v"), F.col("_v").cast("string")).alias("version"))


@query(
    "versions_in_force",
    f"""WITH {VERSIONS_SQL} SELECT e.task, e.seq, v.version FROM errors e ASOF LEFT JOIN versions v
    ON e.task = v.task AND e.ts >= v.valid_from""",
)
def versions_in_force(spark, folder):
    points = I.errors(spark, folder).select("task", "ts", "seq")
    return registry.version_in_force(points, version_rows(spark, folder), "ts").select("task", "seq", "version")


@query(
    "versions_in_force_merged",
    f"""WITH {VERSIONS_SQL} SELECT e.task, e.seq, v.version FROM errors e ASOF LEFT JOIN versions v
    ON e.task = v.task AND e.ts >= v.valid_from""",
)
def versions_in_force_merged(spark, folder):
    """The path for version tables of any length."""
    points = I.errors(spark, folder).select("task", "ts", "seq")
    merged = registry.version_in_force(points, version_rows(spark, folder), "ts", ("seq",), most=3)
    return merged.select("task", "seq", "version")


def digest_sql(columns):
    """The digest of a row over (column, kind), as :func:`fleetlens.sources.integrity.row_digest` makes it."""
    texts = {"text": "CAST({} AS VARCHAR)", "real": "printf('%.12e', {} + 0.0)", "moment": "CAST(epoch_us({}) AS VARCHAR)"}
    parts = [texts[kind].format(c) for c, kind in columns]
    whole = " || ".join(f"coalesce(length({t}) || ':' || {t}, 'n')" for t in parts)
    return f"sum(('0x' || substr(md5({whole}), 1, 15))::HUGEINT)"


LINEITEM = [
    *((f"l_{c}", "text") for c in ("orderkey", "partkey", "suppkey", "linenumber")),
    *((f"l_{c}", "real") for c in ("quantity", "extendedprice", "discount", "tax")),
    ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "moment"),
]
ORDERS = [
    ("o_orderkey", "text"), ("o_custkey", "text"), ("o_orderstatus", "text"), ("o_totalprice", "real"), ("o_orderdate", "moment"),
    ("o_orderpriority", "text"),
]


@query(
    "content_checksums",
    f"SELECT l_returnflag AS part, count(*) AS n_rows, CAST({digest_sql(LINEITEM)} AS VARCHAR) AS checksum FROM lineitem GROUP BY 1",
)
def content_checksums(spark, folder):
    items = table(spark, folder, "lineitem")
    sums = integrity.content_checksums(items, integrity.canonical(items), [F.col("l_returnflag").alias("part")])
    return sums.withColumn("checksum", F.col("checksum").cast("string"))


@query(
    "failed_integrity_parts",
    f"""SELECT 'p' || CAST(l_suppkey AS VARCHAR) AS part, CAST({digest_sql(LINEITEM)} + 1 AS VARCHAR) AS expected,
    CAST({digest_sql(LINEITEM)} AS VARCHAR) AS actual FROM lineitem GROUP BY l_suppkey HAVING l_suppkey % 10 = 3""",
)
def failed_integrity_parts(spark, folder):
    """Content checksums per supplier over all columns; the manifest is off for every tenth supplier."""
    items = table(spark, folder, "lineitem")
    sums = stage(integrity.content_checksums(items, integrity.canonical(items), ["l_suppkey"]), "sums")
    part = F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("part")
    off = F.when(F.col("l_suppkey") % 10 == 3, 1).otherwise(0)
    manifest = sums.select(part, (F.col("checksum") + off).cast("decimal(38,0)").cast("string").alias("md5"))
    return integrity.failed_parts(sums.select(part, F.col("checksum").cast("string").alias("md5")), manifest, "part")


@query(
    "checksums_per_file",
    f"SELECT 'orders.parquet' AS name, count(*) AS n_rows, CAST({digest_sql(ORDERS)} AS VARCHAR) AS checksum FROM orders",
)
def checksums_per_file(spark, folder):
    """Rows and content checksum of every data file, computed from its rows in parallel."""
    orders = table(spark, folder, "orders")
    name = F.regexp_extract("file_path", "([^/]*[.]parquet)", 1).alias("name")
    rows = orders.select("*", "_metadata.file_path")
    sums = integrity.content_checksums(rows, integrity.canonical(orders), [name])
    return sums.withColumn("checksum", F.col("checksum").cast("string"))


@query("file_digests")
def file_digests(spark, folder):
    """md5 of every file of the given tables, whatever its size."""
    return integrity.file_checksums(spark, folder)


@query(
    "parameter_importance",
    f"""WITH {I.TRIALS_SQL}, long_form AS (
      SELECT model, 'max_depth' AS parameter, CAST(max_depth AS DOUBLE) AS v, mae FROM trials
      UNION ALL SELECT model, 'learning_rate', learning_rate, mae FROM trials),
    r AS (SELECT *, min(v) OVER (PARTITION BY model, parameter) AS lo, max(v) OVER (PARTITION BY model, parameter) AS hi FROM long_form),
    b AS (SELECT model, parameter, least(CAST(floor((v - lo) / (hi - lo) * 10) AS INT), 9) AS bin, mae FROM r),
    m AS (SELECT model, parameter, bin, avg(mae) AS a, count(*) AS n FROM b GROUP BY 1, 2, 3),
    s AS (SELECT m.model, parameter, sum(n * (a - t) ** 2) / sum(n) / any_value(vp) AS raw FROM m JOIN
      (SELECT model, avg(mae) AS t, var_pop(mae) AS vp FROM trials GROUP BY 1) x ON m.model = x.model GROUP BY 1, 2)
    SELECT model, parameter, round(raw / sum(raw) OVER (PARTITION BY model), 6) AS importance FROM s""",
)
def parameter_importance(spark, folder):
    from fleetlens.operators.tuning import parameter_importance as importance

    return rounded(importance(I.trials(spark, folder), ["max_depth", "learning_rate"]))


@query(
    "payload_of_last_points",
    f"""WITH {I.ERRORS_SQL}, w AS (SELECT task, (ts // 3600 + 1) * 3600 AS window_end, avg(error) AS mae, count(*) AS n_samples FROM errors GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY window_end DESC) AS rn FROM w)
    SELECT task, count(*) FILTER (rn <= 1000) AS points, CAST(100 AS BIGINT) AS messages FROM k GROUP BY 1""",
)
def payload_of_last_points(spark, folder):
    """The report payload per task, read back and counted."""
    e = I.errors(spark, folder)
    hour = ((F.floor(F.col("ts") / 3600) + 1) * 3600).alias("window_end")
    metrics = e.groupBy("task", hour).agg(F.avg("error").alias("mae"), F.count(F.lit(1)).alias("n_samples"))
    notes = e.select("task", "ts", F.concat(F.lit("event "), F.col("seq").cast("string")).alias("message"), F.lit("INFO").alias("level"))
    payload = reports.report_payload(metrics, notes)
    shape = "struct<notifications:array<struct<message:string>>,metric_points:array<struct<mae:double>>>"
    parsed = payload.select("task", F.from_json("payload", shape).alias("p"))
    return parsed.select(
        "task", F.size("p.metric_points").cast("long").alias("points"), F.size("p.notifications").cast("long").alias("messages")
    )


@query(
    "recent_notifications",
    """SELECT event_type AS task, event_id, rn AS recency FROM (SELECT event_type, event_id,
      row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 100""",
)
def recent_notifications(spark, folder):
    e = table(spark, folder, "events").select(F.col("event_type").alias("task"), "ts", "event_id")
    kept = reports.bounded_history(e, ["task"], "ts", S.NOTIFICATION_HISTORY, ["event_id"])
    return kept.select("task", "event_id", F.col("recency").cast("long"))
