"""Queries over error streams: metrics, smoothing, detectors, lifecycle, reports of a run."""

from __future__ import annotations

from functools import reduce
from itertools import pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import settings as S
from fleetlens.operators import reports, stats
from fleetlens.plans import inputs as I
from fleetlens.plans.catalog import query, rounded
from fleetlens.session import shared_path, stage
from fleetlens.operators.prep import load_window
from fleetlens.streaming import batch as B, calibration as K, lifecycle as L, typed as T
from fleetlens.streaming.serving import ModelServing

# The error table has some 2,000 points per task at scale 0.01, so sample counts are smaller than the defaults, and so are
# window sizes (a hundredth), run lengths and Page-Hinkley thresholds (one 25th, as the calibration). No list is shortened.
SETTINGS = K.DetectorSettings(
    smoothing=100, grace=100, calibration=400, page_thresholds=tuple(t / 25 for t in S.PAGE_HINKLEY_THRESHOLDS),
    kswin_sizes=tuple((w // 100, s // 100) for w, s in S.KSWIN_SIZES), spc_runs=tuple((b // 25, f // 25) for b, f in S.SPC_RUNS),
    collect={"click": 86_400, "view": 172_800},
)
WINDOW = 21_600
OFF_TIES = 1.283e-7  # means of few decimals often end in an exact 5; the shift keeps both engines on one side of it


def values_sql(rows):
    return "(VALUES " + ", ".join(f"({', '.join(repr(v) for v in r)})" for r in rows) + ")"


def error_rows(spark, folder):
    return I.errors(spark, folder).select("task", "ts", "seq", "error")


@query(
    "error_points",
    f"""WITH {I.ERRORS_SQL} SELECT task, ts, seq, round(error, 6) AS error FROM errors""",
)
def error_points(spark, folder):
    scored = B.error_points(I.errors(spark, folder).drop("error"), "truth", "prediction")
    return rounded(scored.select("task", "ts", "seq", "error"))


@query(
    "error_points_on_log_scale",
    f"""WITH {I.ERRORS_SQL} SELECT task, seq, round(abs((exp(ln(1 + truth)) - 1) - (exp(prediction / 10) - 1)), 4) AS error FROM errors""",
)
def error_points_on_log_scale(spark, folder):
    logs = I.errors(spark, folder).select(
        "task", "seq", F.log1p("truth").alias("truth"), (F.col("prediction") / 10).alias("prediction")
    )
    return rounded(B.error_points(logs, "truth", "prediction", log_scale=True).select("task", "seq", "error"), 4)


@query(
    "mae_and_mape",
    f"""WITH {I.ERRORS_SQL} SELECT task, round(avg(abs(truth - prediction)), 6) AS mae,
    round(avg(abs(truth - prediction) / greatest(abs(truth), 2.220446049250313e-16)), 6) AS mape FROM errors GROUP BY 1""",
)
def mae_and_mape(spark, folder):
    return rounded(stats.evaluate(I.errors(spark, folder), "truth", "prediction", ["task"]))


METRICS_SQL = f"""{I.ERRORS_SQL}, metrics AS (
  SELECT task, (ts // {WINDOW} + 1) * {WINDOW} AS window_end, avg(error) AS mae, count(*) AS n_samples FROM errors GROUP BY 1, 2)"""


@query("window_metrics", f"WITH {METRICS_SQL} SELECT task, window_end, round(mae, 6) AS mae, n_samples FROM metrics")
def window_metrics(spark, folder):
    return rounded(B.window_metrics(error_rows(spark, folder), WINDOW))


@query("window_metrics_streamed", f"WITH {METRICS_SQL} SELECT task, window_end, round(mae, 6) AS mae, n_samples FROM metrics")
def window_metrics_streamed(spark, folder):
    """The same metrics from Structured Streaming: slices are published in order, windows update in the sink."""
    rows = error_rows(spark, folder).withColumn("control", F.lit(None).cast("string"))
    inbox, sink, checkpoint = (shared_path(spark, n) for n in ("inbox", "sink", "progress"))
    rows.limit(0).write.parquet(inbox)
    stream = L.windowed_metrics_stream(L.read_inbox(spark, inbox).select("task", "ts", "error"), WINDOW)
    with L.state_partitions(spark, 64):
        running = L.append_sink(stream, sink, checkpoint, "update")
    try:
        cuts = L.slice_cuts(rows, "ts", WINDOW, most_seconds=10 * 86_400)
        L.replay(rows, "ts", cuts, inbox, lambda start, end: running.processAllAvailable())
    finally:
        running.stop()
    updates = L.read_sink(spark, sink, "task string, window_end long, mae double, n_samples long")
    return rounded(L.latest_metrics(updates))


@query(
    "rolling_errors",
    f"""WITH {I.ERRORS_SQL} SELECT task, seq, round(avg(error) OVER (PARTITION BY task ORDER BY ts, seq ROWS 99 PRECEDING) + {OFF_TIES}, 6) AS smoothed FROM errors""",
)
def rolling_errors(spark, folder):
    rolled = B.rolling_errors(error_rows(spark, folder), 100)
    return rounded(rolled.select("task", "seq", (F.col("smoothed") + OFF_TIES).alias("smoothed")))


@query(
    "rolling_errors_in_chunks",
    f"""WITH {I.ERRORS_SQL} SELECT task, seq, round(avg(error) OVER (PARTITION BY task ORDER BY ts, seq ROWS 99 PRECEDING) + {OFF_TIES}, 6) AS smoothed FROM errors""",
)
def rolling_errors_in_chunks(spark, folder):
    """The path for tasks above the size limit, with a limit that the test tables exceed."""
    rolled = B.rolling_errors(error_rows(spark, folder), 100, group_rows=500, chunks=16)
    return rounded(rolled.select("task", "seq", (F.col("smoothed") + OFF_TIES).alias("smoothed")))


@query(
    "longest_violation_runs",
    f"""WITH {I.ERRORS_SQL}, r AS (SELECT task, error > 30 AS v, row_number() OVER w - row_number() OVER (PARTITION BY task, error > 30 ORDER BY ts, seq) AS island
      FROM errors WINDOW w AS (PARTITION BY task ORDER BY ts, seq))
    SELECT task, max(n) AS longest_run FROM (SELECT task, count(*) AS n FROM r WHERE v GROUP BY task, island) GROUP BY 1""",
)
def longest_violation_runs(spark, folder):
    return B.longest_runs(error_rows(spark, folder), F.lit(30.0), group_rows=500, chunks=16)


@query(
    "calibration_errors",
    f"""WITH {I.ERRORS_SQL} SELECT task, seq, position FROM (SELECT task, seq, row_number() OVER (PARTITION BY task ORDER BY ts, seq) AS position
      FROM errors) WHERE position <= 400""",
)
def calibration_errors(spark, folder):
    return K.calibration_rows(error_rows(spark, folder), 400).select("task", "seq", "position")


SMOOTH_SQL = f"""{I.ERRORS_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts, seq) AS p FROM errors),
smooth AS (SELECT *, avg(error) OVER (PARTITION BY task ORDER BY p ROWS 99 PRECEDING) AS sm FROM placed WHERE p <= 400),
fit AS (SELECT task, avg(sm) AS m, stddev_pop(sm) AS s FROM smooth GROUP BY 1),
cand AS (SELECT unnest([{', '.join(map(str, SETTINGS.spc_sigmas))}]) AS sigma),
flags AS (SELECT smooth.task, sigma, p, sm > m + sigma * s AS v FROM smooth JOIN fit USING (task), cand),
isl AS (SELECT *, p - row_number() OVER (PARTITION BY task, sigma, v ORDER BY p) AS island FROM flags),
runs AS (SELECT task, sigma, coalesce(max(n) FILTER (v), 0) AS longest FROM
  (SELECT task, sigma, v, island, count(*) AS n FROM isl GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
options AS (SELECT runs.task, sigma, base, m + sigma * s AS threshold, CAST(greatest(base, longest * factor) AS BIGINT) AS needed, longest
  FROM runs JOIN fit USING (task), {values_sql(SETTINGS.spc_runs)} c(base, factor)),
spc AS (SELECT task, threshold, needed FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY sigma, base) AS rn FROM options WHERE longest < needed) WHERE rn = 1)"""


@query("spc_calibration", f"WITH {SMOOTH_SQL} SELECT task, round(threshold, 6) AS threshold, needed FROM spc")
def spc_calibration(spark, folder):
    return rounded(K.spc_calibration(error_rows(spark, folder), SETTINGS))


@query(
    "spc_detection",
    f"""WITH {SMOOTH_SQL}, every AS (SELECT *, avg(error) OVER (PARTITION BY task ORDER BY p ROWS 99 PRECEDING) AS sm FROM placed),
    w AS (SELECT every.task, p, ts, sm > threshold AS v, needed FROM every JOIN spc USING (task) WHERE p > 400),
    wi AS (SELECT *, p - row_number() OVER (PARTITION BY task, v ORDER BY p) AS island FROM w),
    len AS (SELECT *, row_number() OVER (PARTITION BY task, v, island ORDER BY p) AS run FROM wi WHERE v)
    SELECT task, position, ts FROM (SELECT task, p AS position, ts, row_number() OVER (PARTITION BY task ORDER BY p) AS rn FROM len WHERE run >= needed) WHERE rn = 1""",
)
def spc_detection(spark, folder):
    errors = error_rows(spark, folder)
    return B.first_spc_fire(B.smoothed_errors(errors, SETTINGS.smoothing), K.spc_calibration(errors, SETTINGS), SETTINGS.calibration)


PAGE_SQL = f"""{I.ERRORS_SQL}, e AS (SELECT task, ts, seq, row_number() OVER w AS n, avg(error) OVER (w ROWS 99 PRECEDING) AS error FROM errors
  WINDOW w AS (PARTITION BY task ORDER BY ts, seq)),
a AS (SELECT task, ts, seq, error, row_number() OVER w AS p, sum(error) OVER w AS s FROM e WHERE n > 400
  WINDOW w AS (PARTITION BY task ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, sum(error - s / p - 0.1) OVER w AS up, sum(error - s / p + 0.1) OVER w AS down FROM a
  WINDOW w AS (PARTITION BY task ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, min(up) OVER w AS low, max(down) OVER w AS high FROM b
  WINDOW w AS (PARTITION BY task ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
page AS (SELECT task, p AS position, ts FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY p) AS rn FROM c
  WHERE p >= 100 AND greatest(up - low, high - down) > 800) WHERE rn = 1)"""


@query("page_hinkley_detection", f"WITH {PAGE_SQL} SELECT task, position, ts FROM page")
def page_hinkley_detection(spark, folder):
    errors = B.smoothed_errors(error_rows(spark, folder), SETTINGS.smoothing, SETTINGS.calibration)
    return B.first_page_hinkley_fire(errors, 0.1, 800.0, 100)


@query("page_hinkley_detection_in_chunks", f"WITH {PAGE_SQL} SELECT task, position, ts FROM page")
def page_hinkley_detection_in_chunks(spark, folder):
    errors = B.smoothed_errors(error_rows(spark, folder), SETTINGS.smoothing, SETTINGS.calibration, group_rows=500, chunks=8)
    return B.first_page_hinkley_fire(errors, 0.1, 800.0, 100, group_rows=500, chunks=8)


# Limits of the detectors per task, as tables in both engines: (delta, threshold) and (alpha, window, newest part).
PAGE_LIMITS = [(t, 0.1, 500.0 + 100 * i) for i, t in enumerate(I.TASKS)]
KSWIN_LIMITS = [(t, 0.05 / 2**i, *SETTINGS.kswin_sizes[i % 4]) for i, t in enumerate(I.TASKS)]


FORGETTING_SQL = f"""WITH {I.ERRORS_SQL}, e AS (SELECT task, ts, seq, row_number() OVER w AS n, avg(error) OVER (w ROWS 99 PRECEDING) AS error FROM errors
  WINDOW w AS (PARTITION BY task ORDER BY ts, seq)),
a AS (SELECT task, ts, row_number() OVER w AS p, error - avg(error) OVER w AS gap FROM e WHERE n > 400
  WINDOW w AS (PARTITION BY task ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
lim(task, delta, threshold) AS {values_sql(PAGE_LIMITS)},
row AS (SELECT task, p, {{'gap': gap, 'delta': delta::DOUBLE, 'threshold': threshold::DOUBLE, 'p': p, 'ts': ts, 'up': 0::DOUBLE, 'down': 0::DOUBLE,
  'low': 1e300::DOUBLE, 'high': -1e300::DOUBLE, 'position': 0::BIGINT, 'at': 0::BIGINT}} AS x FROM a JOIN lim USING (task)),
step AS (SELECT task, list_reduce(list_prepend({{'gap': 0::DOUBLE, 'delta': 0::DOUBLE, 'threshold': 0::DOUBLE, 'p': 0::BIGINT, 'ts': 0::BIGINT, 'up': 0::DOUBLE,
  'down': 0::DOUBLE, 'low': 1e300::DOUBLE, 'high': -1e300::DOUBLE, 'position': 0::BIGINT, 'at': 0::BIGINT}}, list(x ORDER BY p)), lambda y, z: {{
  'gap': z.gap, 'delta': z.delta, 'threshold': z.threshold, 'p': z.p, 'ts': z.ts,
  'up': 0.9999 * y.up + z.gap - z.delta, 'down': 0.9999 * y.down + z.gap + z.delta,
  'low': least(y.low, 0.9999 * y.up + z.gap - z.delta), 'high': greatest(y.high, 0.9999 * y.down + z.gap + z.delta),
  'position': CASE WHEN y.position = 0 AND z.p >= 100 AND greatest(0.9999 * y.up + z.gap - z.delta - least(y.low, 0.9999 * y.up + z.gap - z.delta),
     greatest(y.high, 0.9999 * y.down + z.gap + z.delta) - (0.9999 * y.down + z.gap + z.delta)) > z.threshold THEN z.p ELSE y.position END,
  'at': CASE WHEN y.position = 0 THEN z.ts ELSE y.at END}}) AS r FROM row GROUP BY task)
SELECT task, r.position AS position, r.at AS ts FROM step WHERE r.position > 0"""


def forgetting_fires(spark, folder, **layout):
    errors = B.smoothed_errors(error_rows(spark, folder), SETTINGS.smoothing, SETTINGS.calibration, **layout)
    limits = spark.createDataFrame(PAGE_LIMITS, "task string, delta double, threshold double")
    return B.first_page_hinkley_fires(errors, limits, 100, **layout)


@query("page_hinkley_with_forgetting", FORGETTING_SQL)
def page_hinkley_with_forgetting(spark, folder):
    return forgetting_fires(spark, folder)


@query("page_hinkley_with_forgetting_in_chunks", FORGETTING_SQL)
def page_hinkley_with_forgetting_in_chunks(spark, folder):
    return forgetting_fires(spark, folder, group_rows=500, chunks=8)


KSWIN_SQL = f"""{I.ERRORS_SQL}, n AS (SELECT task, ts, seq, error, row_number() OVER (PARTITION BY task ORDER BY ts, seq) AS n FROM errors),
k AS (SELECT task, ts, error, n - 400 AS position, (n - 401) // 5 AS k FROM n WHERE n > 400 AND (n - 401) % 5 = 0),
lim(task, alpha, size, stat) AS {values_sql(KSWIN_LIMITS)},
w AS (SELECT e.task, e.k, e.position, e.ts, size, stat, v.error AS x, CASE WHEN v.k > e.k - stat THEN 1 ELSE 0 END AS recent
  FROM k e JOIN lim USING (task) JOIN k v ON v.task = e.task AND v.k > e.k - size AND v.k <= e.k WHERE e.k >= size - 1),
f AS (SELECT *, sum(1 - recent) OVER o / (size - stat) - sum(recent) OVER o / stat AS gap FROM w WINDOW o AS (PARTITION BY task, k ORDER BY x RANGE UNBOUNDED PRECEDING)),
d AS (SELECT task, position, ts, max(abs(gap)) AS ks, any_value((size - stat) * stat / size::DOUBLE) AS e FROM f GROUP BY 1, 2, 3),
l AS (SELECT *, (sqrt(e) + 0.12 + 0.11 / sqrt(e)) * ks AS level FROM d),
tested AS (SELECT task, position, ts, ks, CASE WHEN level < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101),
  lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * j * j * level * level))))) END AS p_value FROM l)"""


def first_errors(rows):
    """The errors that calibration looks at, found once."""
    return stage(K.calibration_rows(rows, SETTINGS.calibration), "calibration")


def kswin_errors(spark, folder, first=None):
    """The raw errors after the calibration, which is what the test watches."""
    rows = error_rows(spark, folder)
    first = first_errors(rows) if first is None else first
    return rows.join(first.select("task", "seq"), ["task", "seq"], "left_anti")


def kswin_limits(spark):
    return spark.createDataFrame(KSWIN_LIMITS, "task string, alpha double, size int, stat int")


@query("sliding_ks_distances", f"WITH {KSWIN_SQL} SELECT task, position, ts, round(ks, 6) AS ks, round(p_value, 6) AS p_value FROM tested")
def sliding_ks_distances(spark, folder):
    return rounded(B.sliding_ks(kswin_errors(spark, folder), kswin_limits(spark)))


@query(
    "kswin_detection",
    f"""WITH {KSWIN_SQL} SELECT task, position, ts, round(ks, 6) AS ks FROM (SELECT tested.*, row_number() OVER (PARTITION BY task ORDER BY position) AS rn
    FROM tested JOIN lim USING (task) WHERE ks > 0.1 AND p_value <= alpha) WHERE rn = 1""",
)
def kswin_detection(spark, folder):
    return rounded(B.first_kswin_fire(kswin_errors(spark, folder), kswin_limits(spark)).drop("p_value"))


@query("adwin_detection")
def adwin_detection(spark, folder):
    """Adaptive windowing with grace over smoothed errors after the calibration, with the delta that it chose per task."""
    errors = error_rows(spark, folder)
    limits = K.choose_candidates(errors, "ADWIN", SETTINGS).select("task", F.get("parameters", F.lit(0)).alias("delta"))
    return B.first_adwin_fire(B.smoothed_errors(errors, SETTINGS.smoothing, SETTINGS.calibration), limits, SETTINGS.grace)


@query("calibrated_fires")
def calibrated_fires(spark, folder):
    """First fires of all four detectors, each with the parameters that calibration chose for the task."""
    errors = error_rows(spark, folder)
    first = first_errors(errors)
    smooth = stage(B.smoothed_errors(errors, SETTINGS.smoothing, SETTINGS.calibration), "smoothed")
    of = lambda name, *columns: K.choose_candidates(first, name, SETTINGS).select(
        "task", *[F.get("parameters", F.lit(i)).cast(kind).alias(c) for i, (c, kind) in enumerate(columns)]
    )
    page = of("PAGE_HINKLEY", ("delta", "double"), ("threshold", "double"))
    kswin = of("KSWIN", ("alpha", "double"), ("size", "int"), ("stat", "int"))
    spc = K.spc_calibration(first, SETTINGS)
    found = {
        "ADWIN": B.first_adwin_fire(smooth, of("ADWIN", ("delta", "double")), SETTINGS.grace),
        "PAGE_HINKLEY": B.first_page_hinkley_fires(smooth, page, SETTINGS.grace),
        "KSWIN": B.first_kswin_fire(kswin_errors(spark, folder, first), kswin, SETTINGS.stride),
        "SPC": B.first_spc_fire(smooth, spc, SETTINGS.grace),
    }
    rows = [df.select("task", F.lit(name).alias("detector"), "position", "ts") for name, df in found.items()]
    return reduce(DataFrame.unionByName, rows)


@query(
    "ks_distances",
    f"""WITH {I.ERRORS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts, seq) AS p FROM errors),
    t AS (SELECT task, error, CASE WHEN ts < {I.SECOND_SCENARIO} THEN 1 ELSE 0 END AS a, CASE WHEN ts >= {I.SECOND_SCENARIO} THEN 1 ELSE 0 END AS b
      FROM p WHERE (p - 1) % 5 = 0),
    f AS (SELECT task, sum(a) OVER (PARTITION BY task ORDER BY error RANGE UNBOUNDED PRECEDING) AS fa,
      sum(b) OVER (PARTITION BY task ORDER BY error RANGE UNBOUNDED PRECEDING) AS fb, sum(a) OVER (PARTITION BY task) AS na,
      sum(b) OVER (PARTITION BY task) AS nb FROM t)
    SELECT task, round(max(abs(fa / CAST(na AS DOUBLE) - fb / CAST(nb AS DOUBLE))), 6) AS ks, CAST(max(na) AS BIGINT) AS n_older,
    CAST(max(nb) AS BIGINT) AS n_recent FROM f GROUP BY 1""",
)
def ks_distances(spark, folder):
    older, recent = F.col("ts") < I.SECOND_SCENARIO, F.col("ts") >= I.SECOND_SCENARIO
    return rounded(B.ks_two_sample(error_rows(spark, folder), older, recent, 5))


FIRES_SQL = f"""{I.ERRORS_SQL}, fires AS (
  SELECT task, 'D' || CAST(seq % 4 AS VARCHAR) AS detector, ts FROM errors WHERE error > 60 + 40 * (seq % 4))"""


def fires(spark, folder):
    """Four threshold detectors of rising strictness."""
    e = error_rows(spark, folder).withColumn("_d", F.col("seq") % 4)
    return e.where(F.col("error") > F.col("_d") * 40 + 60).select(
        "task", F.concat(F.lit("D"), F.col("_d").cast("string")).alias("detector"), "ts"
    )


@query(
    "consensus_times",
    f"""WITH {FIRES_SQL}, first AS (SELECT task, detector, min(ts) AS ts FROM fires GROUP BY 1, 2)
    SELECT task, ts FROM (SELECT task, ts, row_number() OVER (PARTITION BY task ORDER BY ts) AS rn FROM first) WHERE rn = 3""",
)
def consensus_times(spark, folder):
    return B.consensus(fires(spark, folder))


@query(
    "collection_windows",
    f"""WITH {FIRES_SQL}, d AS (SELECT task, min(ts) AS ts FROM fires GROUP BY 1)
    SELECT task, (ts // 300 + 1) * 300 AS retrain_start, (ts // 300 + 1) * 300 + CASE task WHEN 'click' THEN 7200 ELSE 3600 END AS retrain_end FROM d""",
)
def collection_windows(spark, folder):
    first = fires(spark, folder).groupBy("task").agg(F.min("ts").alias("ts"))
    return B.collection_windows(first, {"click": 7200})


@query(
    "notifications",
    f"""WITH {I.ERRORS_SQL}, e AS (SELECT task, ts, CASE seq % 5 WHEN 0 THEN 'Drift detector calibration completed' WHEN 1 THEN 'Concept drift detected'
      WHEN 2 THEN 'Model retraining initiated' WHEN 3 THEN 'Retrained model swapped' END AS message,
      CASE seq % 5 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'DANGER' WHEN 2 THEN 'WARNING' WHEN 3 THEN 'SUCCESS' END AS level FROM errors)
    SELECT * FROM e WHERE message IS NOT NULL""",
)
def notifications(spark, folder):
    names = F.array(*[F.lit(n) for n in ("calibrated", "drifted", "retraining", "swapped", "fired:SPC")])
    events = error_rows(spark, folder).select("task", "ts", F.get(names, (F.col("seq") % 5).cast("int")).alias("event"))
    return B.notifications(events)


@query(
    "metric_history",
    f"""WITH {METRICS_SQL} SELECT task, window_end, round(mae, 6) AS mae, n_samples, rn AS recency FROM (
      SELECT *, row_number() OVER (PARTITION BY task ORDER BY window_end DESC) AS rn FROM metrics) WHERE rn <= 30""",
)
def metric_history(spark, folder):
    kept = reports.bounded_history(B.window_metrics(error_rows(spark, folder), WINDOW), ["task"], "window_end", 30)
    return rounded(kept.withColumn("recency", F.col("recency").cast("long")))


@query(
    "shaded_windows",
    f"""WITH {METRICS_SQL}, p AS (SELECT *, sum(n_samples) OVER (PARTITION BY task ORDER BY window_end DESC) AS c FROM metrics WHERE window_end >= 864000)
    SELECT task, coalesce(max(window_end) FILTER (c >= 500), min(window_end)) AS window_start, max(window_end) AS window_stop FROM p GROUP BY 1""",
)
def shaded_windows(spark, folder):
    metrics = B.window_metrics(error_rows(spark, folder), WINDOW)
    recent = reports.bounded_history(metrics, ["task"], "window_end", S.METRIC_HISTORY).drop("recency")
    stable = spark.createDataFrame([(t, 864_000) for t in I.TASKS], "task string, start_timestamp long")
    return reports.detection_window_start(recent, stable, 500)


@query(
    "run_facts",
    f"""WITH {METRICS_SQL}, ev AS (SELECT task, min(ts) FILTER (error > 150 AND ts > {I.SECOND_SCENARIO}) AS detected_at, min(ts) FILTER (ts >= 1900000) AS swapped_at FROM errors GROUP BY 1)
    SELECT task, round(sum(mae * n_samples) FILTER (window_end <= {I.SECOND_SCENARIO}) / sum(n_samples) FILTER (window_end <= {I.SECOND_SCENARIO}), 6) AS mae_before,
    round(sum(mae * n_samples) FILTER (window_end > {I.SECOND_SCENARIO} AND window_end <= swapped_at) / sum(n_samples) FILTER (window_end > {I.SECOND_SCENARIO} AND window_end <= swapped_at), 6) AS mae_drift,
    round(sum(mae * n_samples) FILTER (window_end > swapped_at) / sum(n_samples) FILTER (window_end > swapped_at), 6) AS mae_after_swap,
    any_value(detected_at) AS detected_at, any_value(detected_at) - {I.SECOND_SCENARIO} AS detection_latency, any_value(swapped_at) AS swapped_at
    FROM metrics JOIN ev USING (task) GROUP BY task""",
)
def run_facts(spark, folder):
    errors = error_rows(spark, folder)
    events = errors.groupBy("task").agg(
        F.min(F.when((F.col("error") > 150) & (F.col("ts") > I.SECOND_SCENARIO), F.col("ts"))).alias("detected_at"),
        F.min(F.when(F.col("ts") >= 1_900_000, F.col("ts"))).alias("swapped_at"),
    )
    return rounded(reports.run_facts(B.window_metrics(errors, WINDOW), events, I.SECOND_SCENARIO))


@query(
    "relative_improvement",
    f"""WITH {I.ERRORS_SQL}, w AS (SELECT truth, abs(truth - prediction) AS o, abs(truth - prediction * 1.5) AS n FROM errors WHERE ts BETWEEN 1500000 AND 2400000),
    m AS (SELECT avg(o) AS a, avg(n) AS b, avg(o / greatest(abs(truth), 2.220446049250313e-16)) AS c, avg(n / greatest(abs(truth), 2.220446049250313e-16)) AS d FROM w)
    SELECT round(a, 6) AS mae_old, round(b, 6) AS mae_new, round(c, 6) AS mape_old, round(d, 6) AS mape_new,
    round((a - b) * 100 / a, 6) AS mae_gain, round((c - d) * 100 / c, 6) AS mape_gain FROM m""",
)
def relative_improvement(spark, folder):
    e = I.errors(spark, folder).withColumns(
        {"old": F.abs(F.col("truth") - F.col("prediction")), "new": F.abs(F.col("truth") - F.col("prediction") * 1.5)}
    )
    return rounded(stats.relative_improvement(e, 1_500_000, 2_400_000, "ts", "old", "new", "truth"))


@query("adwin_calibration")
def adwin_calibration(spark, folder):
    return K.choose_candidates(error_rows(spark, folder), "ADWIN", SETTINGS)


@query("page_hinkley_calibration")
def page_hinkley_calibration(spark, folder):
    return K.choose_candidates(error_rows(spark, folder), "PAGE_HINKLEY", SETTINGS)


@query("kswin_calibration")
def kswin_calibration(spark, folder):
    return K.choose_candidates(error_rows(spark, folder), "KSWIN", SETTINGS)


def score_with_versions(rows, versions):
    """A fixed linear prediction whose level depends on the version in force of each task."""
    level = F.lit(1.0)
    for task, version in versions.items():
        level = F.when(F.col("task") == task, F.lit(1.0 if version == "v1" else 1.6)).otherwise(level)
    return rows.select("task", "ts", "seq", F.abs(F.col("truth") - F.col("prediction") * level).alias("error"))


@query("drift_lifecycle_streamed")
def drift_lifecycle_streamed(spark, folder):
    """Six days a slice, less where they are crowded, through scoring, detection, retraining request and swap; the transition events of all tasks."""
    rows = I.errors(spark, folder).select("task", "ts", "seq", "truth", "prediction")
    loop = L.ReplayLoop(
        spark, shared_path(spark, "replay"), score_with_versions, lambda task, start, end: "v2",
        {t: "v1" for t in I.TASKS}, SETTINGS, WINDOW,
    )
    return loop.run(rows, "ts", L.slice_cuts(rows, "ts", WINDOW, most_seconds=6 * 86_400)).drop("batch")


@query("drift_watch_typed")
def drift_watch_typed(spark, folder):
    """The monitors of all tasks as typed state: one file a slice, one slice a micro-batch; events of rows and timers."""
    rows = error_rows(spark, folder).withColumn("control", F.lit(None).cast("string"))
    inbox, sink, checkpoint = (shared_path(spark, n) for n in ("typed-inbox", "typed-sink", "typed-progress"))
    for start, end in pairwise(L.slice_cuts(rows, "ts", WINDOW, most_seconds=6 * 86_400)):
        load_window(rows, start, end, "ts").coalesce(1).write.mode("append").parquet(inbox)  # a file comes whole or not at all
    stream = T.typed_monitor_stream(L.read_inbox(spark, inbox, maxFilesPerTrigger="1"), SETTINGS, WINDOW)
    with T.typed_store(spark), L.state_partitions(spark, 64):
        L.append_sink(stream, sink, checkpoint, trigger={"availableNow": True}).awaitTermination()
    return L.read_sink(spark, sink, L.EVENTS).drop("batch")


@query("replay_with_retraining")
def replay_with_retraining(spark, folder):
    """The whole loop on real models: trained on the first days, watched, retrained on the drifted days, swapped.

    Gives the MAE per task before the drift, from the drift to the swap, and after it.
    """
    trips = I.errors(spark, folder).select("task", "ts", "seq", "truth", F.col("prediction").alias("level"))
    root = shared_path(spark, "serving")
    serving = ModelServing(spark, f"{root}/models", trips, I.TASKS, ["level"], "truth")
    versions = serving.start(4 * 86_400)
    loop = L.ReplayLoop(spark, f"{root}/replay", serving.score, serving.retrain, versions, SETTINGS, WINDOW)
    events = loop.run(trips, "ts", L.slice_cuts(trips, "ts", WINDOW, most_seconds=6 * 86_400))
    errors = spark.read.schema(L.INPUT).option("recursiveFileLookup", "true").parquet(loop.errors).where("control IS NULL")
    moments = events.groupBy("task").agg(
        F.min(F.when(F.col("event") == "drifted", F.col("ts"))).alias("detected_at"),
        F.min(F.when(F.col("event") == "swapped", F.col("ts"))).alias("swapped_at"),
    )
    return reports.run_facts(B.window_metrics(errors, WINDOW), moments, I.SECOND_SCENARIO)
