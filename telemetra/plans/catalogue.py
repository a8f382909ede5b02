"""Name → query over the driver's tables, and name → the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.functions import scalars as S
from telemetra.operators import evaluate, evidence, logs, series, text, windows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
GRID = [0.1 * k for k in range(1, 10)]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def log_rows(spark: SparkSession, d: str) -> DataFrame:
    """events as a log: c0 to c9 are components; errors and purchases are the anomalous levels."""
    e = table(spark, d, "events")
    e = e.withColumn("component", F.concat(F.lit("c"), F.col("user_id") % 10)).withColumn("level", F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warn").otherwise("info"))
    return logs.normalize(e, "events", "ts", "event_id", "event_type", "component", "level")


LOGS = """logs AS (SELECT 'events' AS dataset, ts, event_id AS seq, event_type AS event, 'c' || (user_id % 10) AS component,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS level FROM events WHERE ts IS NOT NULL)"""
BUCKET = "make_timestamp(epoch_us(ts) - epoch_us(ts) % {us})"
HOUR, SIX, DAY = (BUCKET.format(us=s * 1_000_000) for s in (3600, 21600, 86400))
SEVERITY = lambda x, ladder: "CASE WHEN {0} >= {4} THEN 'CRITICAL' WHEN {0} >= {3} THEN 'HIGH' WHEN {0} >= {2} THEN 'MEDIUM' WHEN {0} >= {1} THEN 'LOW' ELSE 'INFO' END".format(x, *S.LADDERS[ladder])


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: S.rounded_as_sql(F.col(c), 6) for c in columns})


@query(f"""WITH {LOGS} SELECT dataset, {HOUR} AS bucket, count(*) AS n, count(*) FILTER (level IN ('WARN', 'ERROR')) AS n_anomalous,
    count(DISTINCT event) AS n_events, count(DISTINCT component) AS n_components,
    round(count(*) FILTER (level IN ('WARN', 'ERROR')) / count(*), 6) AS anomalous_rate, round(count(DISTINCT event) / count(*), 6) AS diversity FROM logs GROUP BY ALL""")
def log_bucket_summary(spark, d):
    return rounded(logs.bucket_summary(log_rows(spark, d), 3600), "anomalous_rate", "diversity")


def _frequency_sql(key: str) -> str:
    return f"WITH {LOGS} SELECT dataset, {DAY} AS bucket, {key}, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM logs GROUP BY ALL"


@query(_frequency_sql("event"))
def log_event_frequency(spark, d):
    return logs.frequency(log_rows(spark, d), 86400, "event")


@query(_frequency_sql("level"))
def log_level_frequency(spark, d):
    return logs.frequency(log_rows(spark, d), 86400, "level")


@query(_frequency_sql("component"))
def log_component_frequency(spark, d):
    return logs.frequency(log_rows(spark, d), 86400, "component")


@query(f"""WITH {LOGS}, p AS (SELECT *, lag(event) OVER (PARTITION BY dataset ORDER BY ts, seq) AS previous FROM logs),
    g AS (SELECT dataset, previous, event, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM p WHERE previous IS NOT NULL GROUP BY ALL)
    SELECT *, round(n / sum(n) OVER (PARTITION BY dataset), 6) AS frequency FROM g""")
def log_transitions(spark, d):
    return rounded(logs.transitions(log_rows(spark, d)), "frequency")


RARE = f"""WITH {LOGS}, u AS (SELECT dataset, ts, seq, component || ':' || event AS event FROM logs),
    s AS (SELECT dataset, event, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY dataset) AS frequency FROM u GROUP BY dataset, event),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY dataset, event ORDER BY ts, seq) AS INTEGER) AS occurrence FROM u JOIN s USING (dataset, event) WHERE n <= 3 OR frequency <= 0.02)
    SELECT dataset, event, ts, seq, n, round(frequency, 6) AS frequency, occurrence, round(greatest(1 - least(frequency / 0.02, 1), 1 / n), 6) AS normalized FROM r WHERE occurrence <= 3"""


@query(RARE)
def detect_rare_events(spark, d):
    rows = log_rows(spark, d).select("dataset", "ts", "seq", F.concat_ws(":", "component", "event").alias("event"))
    return rounded(logs.rare(rows, "event", share=0.02), "frequency", "normalized")


def _spike_sql(key: str, us: int, least: int, z: float) -> str:
    return f"""WITH {LOGS}, b AS (SELECT dataset, {key} AS k, {BUCKET.format(us=us)} AS bucket, count(*) AS n FROM logs GROUP BY ALL),
    span AS (SELECT dataset, CAST(floor(min(epoch_us(ts)) / {us}) AS BIGINT) AS a, CAST(ceil(max(epoch_us(ts)) / {us}) AS BIGINT) AS z FROM logs GROUP BY dataset),
    grid AS (SELECT dataset, make_timestamp(unnest(range(a, z + 1)) * {us}) AS bucket FROM span),
    f AS (SELECT k.dataset, k.k, grid.bucket, coalesce(b.n, 0) AS n FROM (SELECT DISTINCT dataset, k FROM b) k JOIN grid USING (dataset) LEFT JOIN b ON b.k = k.k AND b.bucket = grid.bucket),
    m AS (SELECT dataset, k, quantile_cont(n, 0.5) AS median FROM f GROUP BY ALL),
    a AS (SELECT dataset, k, median, quantile_cont(abs(n - median), 0.5) AS mad FROM f JOIN m USING (dataset, k) GROUP BY ALL),
    s AS (SELECT *, greatest(1.0, 1.4826 * mad, sqrt(greatest(median, 1.0))) AS scale FROM a),
    x AS (SELECT dataset, k AS {key}, bucket, n, CAST(median AS DOUBLE) AS median, CAST(mad AS DOUBLE) AS mad, CAST(scale AS DOUBLE) AS scale, CAST((n - median) / scale AS DOUBLE) AS z FROM b JOIN s USING (dataset, k))
    SELECT dataset, {key}, bucket, n, median, mad, round(scale, 6) AS scale, round(z, 6) AS z, round(least(greatest(z / 8, 0), 1), 6) AS normalized FROM x WHERE n >= {least} AND z >= {z}"""


@query(_spike_sql("event", 3_600_000_000, 5, 2.0))
def detect_frequency_spikes(spark, d):
    return rounded(logs.spikes(log_rows(spark, d), 3600, "event", z_least=2.0), "scale", "z", "normalized")


@query(_spike_sql("component", 3_600_000_000, 5, 2.0))
def detect_component_spikes(spark, d):
    return rounded(logs.spikes(log_rows(spark, d), 3600, "component", z_least=2.0), "scale", "z", "normalized")


@query(f"""WITH {LOGS}, s AS (SELECT dataset, {HOUR} AS bucket, count(*) AS n, count(*) FILTER (level IN ('WARN', 'ERROR')) AS n_anomalous, count(*) FILTER (level IN ('WARN', 'ERROR')) / count(*) AS r FROM logs GROUP BY dataset, {HOUR}),
    m AS (SELECT dataset, quantile_cont(r, 0.5) AS median FROM s GROUP BY dataset),
    a AS (SELECT dataset, median, quantile_cont(abs(r - median), 0.5) AS mad FROM s JOIN m USING (dataset) GROUP BY ALL),
    x AS (SELECT *, (r - median) / greatest(CAST(0.01 AS DOUBLE), CAST(1.4826 AS DOUBLE) * mad) AS z FROM s JOIN a USING (dataset))
    SELECT dataset, bucket, n, n_anomalous, round(r, 6) AS anomalous_rate, round(median, 6) AS median, round(mad, 6) AS mad, round(z, 6) AS z,
    round(least(greatest(greatest(z / 6, r / CAST(0.75 AS DOUBLE)), 0), 1), 6) AS normalized FROM x WHERE n_anomalous >= 5 AND (z >= 1 OR r >= 0.75)""")
def detect_level_anomalies(spark, d):
    return rounded(logs.level_anomalies(log_rows(spark, d), 3600, z_least=1.0), "anomalous_rate", "median", "mad", "z", "normalized")


def signals(spark, d) -> DataFrame:
    """Evidence rows from the spikes of two detectors and the rare events, with one shape."""
    rows = log_rows(spark, d)
    comp = logs.spikes(rows, 3600, "component", least=2, z_least=1.0).select(F.col("component").alias("entity"), F.col("bucket").alias("ts"), F.lit("LOG_COMPONENT").alias("signal_type"), "normalized", F.lit("MEDIUM").alias("reliability"))
    bad = rows.where(F.col("level").isin("ERROR", "WARN")).select(F.col("component").alias("entity"), "ts", F.when(F.col("level") == "ERROR", "LOG_LEVEL").otherwise("LOG_RARE_EVENT").alias("signal_type"), F.when(F.col("level") == "ERROR", 0.8).otherwise(0.3).alias("normalized"), F.when(F.col("level") == "ERROR", "HIGH").otherwise("LOW").alias("reliability"))
    return comp.unionByName(bad).withColumn("confidence", S.clamp(evidence.weight_of("reliability", evidence.RELIABILITY_WEIGHTS) * (0.5 + 0.5 * F.col("normalized"))))


SIGNALS = _spike_sql("component", 3_600_000_000, 2, 1.0).replace("SELECT dataset, component, bucket, n, median", "SELECT component AS entity, bucket AS ts, 'LOG_COMPONENT' AS signal_type, least(greatest(z / 8, 0), 1) AS normalized, 'MEDIUM' AS reliability FROM x WHERE n >= 2 AND z >= 1.0\n--").split("\n--")[0]
SIGNALS = SIGNALS.replace("SELECT component AS entity", ", sig AS (SELECT component AS entity") + """
    UNION ALL SELECT component, ts, CASE level WHEN 'ERROR' THEN 'LOG_LEVEL' ELSE 'LOG_RARE_EVENT' END, CASE level WHEN 'ERROR' THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END, CASE level WHEN 'ERROR' THEN 'HIGH' ELSE 'LOW' END FROM logs WHERE level IN ('ERROR', 'WARN')),
    weighed AS (SELECT *, CASE reliability WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.75 ELSE 0.45 END AS rel, CASE signal_type WHEN 'LOG_COMPONENT' THEN 0.4 WHEN 'LOG_LEVEL' THEN 0.4 ELSE 0.25 END AS tw FROM sig),
    rated AS (SELECT *, least(greatest(normalized * CAST(tw AS DOUBLE) * CAST(rel AS DOUBLE), 0), CAST(0.95 AS DOUBLE)) AS c, least(greatest(CAST(rel AS DOUBLE) * (CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * normalized), 0), 1) AS confidence FROM weighed)"""
RISK = SIGNALS + f""", risk AS (SELECT entity, {SIX} AS bucket, 1 - product(1 - c) AS risk, count(*) AS evidence, least(greatest(avg(confidence) * least(ln(1 + count(*)) / ln(CAST(6 AS DOUBLE)), 1), 0), 1) AS confidence FROM rated GROUP BY entity, {SIX})"""


@query(RISK + f" SELECT entity, bucket, round(risk, 6) AS risk, evidence, round(confidence, 6) AS confidence, {SEVERITY('risk', 'risk')} AS severity FROM risk")
def log_risk_signals(spark, d):
    return rounded(evidence.risk(signals(spark, d), 21600), "risk", "confidence")


@query(SIGNALS + f""", t AS (SELECT entity, {SIX} AS bucket, signal_type, sum(c) AS c FROM rated GROUP BY ALL)
    SELECT entity, bucket, string_agg(signal_type, '|' ORDER BY round(c, 9) DESC, signal_type) AS dominant_types FROM t GROUP BY ALL""")
def risk_dominant_types(spark, d):
    return evidence.dominant_types(signals(spark, d), 21600)


@query(SIGNALS + f""" SELECT entity, {DAY} AS bucket, count(*) FILTER (signal_type = 'LOG_COMPONENT') AS LOG_COMPONENT, count(*) FILTER (signal_type = 'LOG_LEVEL') AS LOG_LEVEL, count(*) FILTER (signal_type = 'LOG_RARE_EVENT') AS LOG_RARE_EVENT FROM rated GROUP BY ALL""")
def evidence_timeline_pivot(spark, d):
    types = ["LOG_COMPONENT", "LOG_LEVEL", "LOG_RARE_EVENT"]
    return signals(spark, d).groupBy("entity", S.bucket(F.col("ts"), 86400).alias("bucket")).pivot("signal_type", types).count().na.fill(0, types)


_ratio = lambda a, b: f"CASE WHEN abs({b}) > 1e-8 THEN ({a}) / ({b}) WHEN {b} IS NULL THEN NULL WHEN abs({a}) <= 1e-8 THEN 0 ELSE ({a}) / 1e-8 END"
_frame = lambda n: f"count(value) OVER {n} AS n{n}, avg(value) OVER {n} AS m{n}, CASE WHEN max(value) OVER {n} = min(value) OVER {n} THEN 0 ELSE stddev_pop(value) OVER {n} END AS s{n}"
ROLLING = ["raw_value", "diff_1", "pct_change_1", "rolling_mean_short", "rolling_std_short", "rolling_zscore_short", "rolling_mean_long", "rolling_std_long", "rolling_zscore_long", "trend_short"]


@query(f"""WITH i AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS i FROM events),
    x AS (SELECT *, lag(value) OVER w AS p, {_frame('a')}, {_frame('b')}, regr_slope(value, i) OVER a AS slope FROM i
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    y AS (SELECT *, CASE WHEN na >= 3 THEN ma END AS mean_a, CASE WHEN na >= 3 THEN sa END AS sd_a, CASE WHEN nb >= 3 THEN mb END AS mean_b, CASE WHEN nb >= 3 THEN sb END AS sd_b FROM x)
    SELECT event_id, round(value, 7) AS raw_value, round(value - p, 7) AS diff_1, round({_ratio('value - p', 'p')}, 7) AS pct_change_1, round(mean_a, 7) AS rolling_mean_short, round(sd_a, 7) AS rolling_std_short, round({_ratio('value - mean_a', 'sd_a')}, 7) AS rolling_zscore_short,
    round(mean_b, 7) AS rolling_mean_long, round(sd_b, 7) AS rolling_std_long, round({_ratio('value - mean_b', 'sd_b')}, 7) AS rolling_zscore_long, round(CASE WHEN na >= 3 THEN slope END, 7) AS trend_short FROM y""")
def causal_rolling_features(spark, d):
    out = windows.causal_rolling(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return out.select("event_id", *(F.round(c, 7).alias(c) for c in ROLLING))


@query("""WITH x AS (SELECT event_id, ts, value, count(value) OVER w AS n, avg(value) OVER w AS mean_window, min(value) OVER w AS min_window, max(value) OVER w AS max_window, first_value(value) OVER v AS v0, (epoch_us(ts) - first_value(epoch_us(ts)) OVER v) / 1000000 AS gone
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW), v AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))
    SELECT event_id, CAST(n AS BIGINT) AS n_window, round(mean_window, 6) AS mean_window, min_window, max_window, round(CASE WHEN gone > 0 THEN (value - v0) / gone END, 6) AS rate_window FROM x""")
def time_range_rolling(spark, d):
    out = windows.time_rolling(table(spark, d, "events"), "event_type", "ts", "value", 3600)
    return rounded(out, "mean_window", "rate_window").select("event_id", "n_window", "mean_window", "min_window", "max_window", "rate_window")


@query("""WITH a AS (SELECT event_id, user_id, ts, CAST(event_type = 'click' AS INTEGER) AS state, epoch_us(ts) AS us FROM events),
    b AS (SELECT *, CASE WHEN lag(state) OVER w IS NULL THEN 0 ELSE CAST(state <> lag(state) OVER w AS INTEGER) END AS transition FROM a WINDOW w AS (PARTITION BY user_id ORDER BY us))
    SELECT event_id, state, transition, round((us - max(CASE WHEN transition = 1 THEN us END) OVER (PARTITION BY user_id ORDER BY us)) / 1000000, 3) AS seconds_since, CAST(sum(transition) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS transitions_window FROM b""")
def state_transitions(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "click").cast("int").alias("state"))
    return windows.state_features(e, "user_id", "ts", "state", 86400).select("event_id", "state", "transition", F.round("seconds_since", 3).alias("seconds_since"), "transitions_window")


@query("""WITH a AS (SELECT user_id, ts, event_id, CAST(value > 50 AS INTEGER) AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
    b AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM a WHERE y = 1) SELECT user_id, min(i) AS start_index, max(i) + 1 AS end_index FROM b GROUP BY user_id, g""")
def positive_segments(spark, d):
    return windows.positive_segments(table(spark, d, "events").withColumn("y", (F.col("value") > 50).cast("int")), "user_id", ["ts", "event_id"], "y")


@query("""WITH a AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 43200000000 THEN 1 ELSE 0 END AS fresh FROM events)
    SELECT event_id, user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS segment_id FROM a""")
def temporal_segments(spark, d):
    return windows.temporal_segments(table(spark, d, "events"), "user_id", "ts", 43200).select("event_id", "user_id", "segment_id")


@query("""WITH a AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT event_id, user_id, CASE WHEN i < floor(n * CAST(0.6 AS DOUBLE)) THEN 'train' WHEN i < floor(n * CAST(0.6 AS DOUBLE)) + floor(n * CAST(0.2 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM a""")
def chronological_split(spark, d):
    return windows.chronological_split(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "split")


@query("""WITH a AS (SELECT user_id, row_number() OVER w AS i, sum(value) OVER f AS total, max(CAST(event_type = 'error' AS INTEGER)) OVER f AS window_label FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
    SELECT user_id, i - 1 AS end_index, round(total, 4) AS total, window_label FROM a WHERE i >= 8 AND (i - 8) % 4 = 0""")
def sequence_windows(spark, d):
    e = table(spark, d, "events").withColumn("y", (F.col("event_type") == "error").cast("int"))
    out = windows.sequence_windows(e, "user_id", ["ts", "event_id"], "value", "y", 8, 4)
    return out.select("user_id", "end_index", F.round(F.aggregate("window_values", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), "window_label")


SCORED = "scored AS (SELECT doc_id, toxic AS y, (n_chars % 97) / CAST(97 AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id))"


def scored(spark, d) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", F.col("toxic").alias("y"), (F.col("n_chars") % 97 / 97.0).alias("score"))


METRICS = """g AS (SELECT threshold, count(*) FILTER (y = 1 AND p) AS tp, count(*) FILTER (y <> 1 AND p) AS fp, count(*) FILTER (y <> 1 AND NOT p) AS tn, count(*) FILTER (y = 1 AND NOT p) AS fn FROM r GROUP BY threshold),
    h AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re, coalesce(fp / nullif(fp + tn, 0), 0) AS fa FROM g),
    k AS (SELECT round(threshold, 6) AS threshold, tp, fp, tn, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, round(fa, 6) AS fpr FROM h)"""
GRID_ROWS = "r AS (SELECT y, t AS threshold, score >= t AS p FROM scored, (SELECT unnest([" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in GRID) + "]) AS t))"


@query(f"WITH {SCORED}, {GRID_ROWS}, {METRICS} SELECT * FROM k")
def threshold_grid(spark, d):
    return rounded(evaluate.threshold_grid(scored(spark, d), "y", "score", GRID), "threshold", "precision", "recall", "f1", "fpr")


@query(f"WITH {SCORED}, {GRID_ROWS}, {METRICS} SELECT * FROM k ORDER BY f1 DESC, recall DESC, fpr, threshold LIMIT 1")
def best_threshold(spark, d):
    return rounded(evaluate.best_threshold(scored(spark, d), "y", "score", GRID), "threshold", "precision", "recall", "f1", "fpr")


BY_SCORE = "b AS (SELECT score, count(*) AS n, sum(y) AS pos FROM scored GROUP BY score), c AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS above, sum(pos) OVER (ORDER BY score DESC) AS hits FROM b)"


@query(f"WITH {SCORED}, {BY_SCORE} SELECT round(sum(pos * hits / above) / sum(pos), 6) AS average_precision FROM c")
def average_precision(spark, d):
    return rounded(evaluate.average_precision(scored(spark, d), "y", "score"), "average_precision")


@query(f"WITH {SCORED}, {BY_SCORE} SELECT round(1 - sum(pos * ((above - hits - n + pos) + (n - pos) / 2)) / (sum(pos) * sum(n - pos)), 6) AS roc_auc FROM c")
def roc_auc(spark, d):
    return rounded(evaluate.roc_auc(scored(spark, d), "y", "score"), "roc_auc")


@query("""WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.99) AS percentile FROM events GROUP BY event_type),
    a AS (SELECT event_type, median, percentile, quantile_cont(abs(value - median), 0.5) AS mad FROM events JOIN m USING (event_type) GROUP BY ALL)
    SELECT event_type, round(median, 6) AS median, round(percentile, 6) AS percentile, round(mad, 6) AS mad, round(CASE WHEN mad > 0 THEN median + 6 * CAST(1.4826 AS DOUBLE) * mad ELSE percentile END, 6) AS threshold FROM a""")
def mad_threshold(spark, d):
    return rounded(evaluate.mad_threshold(table(spark, d, "events"), ["event_type"], "value"), "median", "percentile", "mad", "threshold")


@query("""SELECT event_id, round(coalesce(sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY value) / nullif(sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type), 0), 0), 6) AS ecdf FROM events""")
def ecdf_scores(spark, d):
    return evaluate.ecdf(table(spark, d, "events"), ["event_type"], "value", F.col("user_id") % 2 == 0).select("event_id", F.round("ecdf", 6).alias("ecdf"))


@query("""WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value > 40 AS y, event_type = 'click' AS p FROM events),
    b AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM a WHERE y) SELECT user_id, min(i) AS start_index, min(CASE WHEN p THEN i END) - min(i) AS delay_steps FROM b GROUP BY user_id, g""")
def detection_delay(spark, d):
    e = table(spark, d, "events").withColumn("y", (F.col("value") > 40).cast("int")).withColumn("p", (F.col("event_type") == "click").cast("int"))
    return evaluate.detection_delay(e, "user_id", ["ts", "event_id"], "y", "p")


FAILURES = "fail AS (SELECT * FROM (VALUES ('f1', TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-05 06:00:00'), ('f2', TIMESTAMP '2024-01-20 12:00:00', TIMESTAMP '2024-01-21 00:00:00')) t(failure_id, start_ts, end_ts))"


def failures(spark) -> DataFrame:
    return spark.sql("SELECT failure_id, CAST(a AS timestamp_ntz) AS start_ts, CAST(b AS timestamp_ntz) AS end_ts FROM VALUES ('f1', '2024-01-05 00:00:00', '2024-01-05 06:00:00'), ('f2', '2024-01-20 12:00:00', '2024-01-21 00:00:00') t(failure_id, a, b)")


@query(f"""WITH {FAILURES} SELECT event_id, max(CASE WHEN ts >= start_ts - INTERVAL 6 HOUR AND ts < start_ts THEN 1 ELSE 0 END) AS target, max(CASE WHEN ts BETWEEN start_ts AND end_ts THEN 1 ELSE 0 END) AS active,
    max(CASE WHEN ts >= start_ts - INTERVAL 6 HOUR AND ts < start_ts THEN failure_id END) AS failure_id FROM events, fail GROUP BY event_id""")
def failure_target(spark, d):
    return evaluate.failure_target(table(spark, d, "events").select("event_id", "ts"), failures(spark), "ts", "6 hours").drop("ts")


@query(f"WITH {FAILURES} SELECT count(*) AS false_alarms FROM events e WHERE value > 50 AND NOT EXISTS (SELECT 1 FROM fail WHERE ts BETWEEN start_ts - INTERVAL 6 HOUR AND end_ts)")
def false_alarms(spark, d):
    return evaluate.false_alarms(table(spark, d, "events").withColumn("w", (F.col("value") > 50).cast("int")), failures(spark), "ts", "w", "6 hours")


RANGES = "ranges AS (SELECT event_type, avg(value) AS mean, stddev_pop(value) AS sd, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.99) AS q99 FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY event_type)"


def ranges(spark, d) -> DataFrame:
    return evidence.normal_ranges(table(spark, d, "events"), "event_type", "value", F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))


@query(f"WITH {RANGES} SELECT event_type, round(mean, 6) AS mean, round(sd, 6) AS sd, round(q01, 6) AS q01, round(q99, 6) AS q99 FROM ranges")
def normal_ranges(spark, d):
    return rounded(ranges(spark, d), "mean", "sd", "q01", "q99")


@query(f"""WITH {RANGES}, x AS (SELECT event_id, event_type, value, q01, q99, abs((value - mean) / greatest(sd, 1e-8)) AS z FROM events JOIN ranges USING (event_type))
    SELECT event_id, event_type, round(z, 6) AS z, round(least(greatest(z / 5, 0), 1), 6) AS normalized, {SEVERITY('z', 'anomaly')} AS severity FROM x WHERE z >= 2.5 OR value < q01 OR value > q99""")
def current_anomaly(spark, d):
    out = evidence.current_anomalies(table(spark, d, "events"), ranges(spark, d), "event_type", "value")
    return rounded(out, "z", "normalized").select("event_id", "event_type", "z", "normalized", "severity")


@query(f"""WITH {RANGES}, x AS (SELECT event_id, event_type, value - first_value(value) OVER w AS change, count(*) OVER w AS points FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW)),
    z AS (SELECT event_id, event_type, change, abs(change) / greatest(sd, 1e-8) AS z FROM x JOIN ranges USING (event_type) WHERE points >= 3) SELECT event_id, event_type, round(change, 6) AS change, round(z, 6) AS z, {SEVERITY('z', 'trend')} AS severity FROM z WHERE z >= 0.8""")
def trend_evidence(spark, d):
    out = evidence.trend_signals(table(spark, d, "events"), ranges(spark, d), "event_type", "ts", "value", 7200)
    return rounded(out, "change", "z").select("event_id", "event_type", "change", "z", "severity")


@query(f"""WITH t AS (SELECT DISTINCT user_id, ts FROM events), p AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 172800000000 PRECEDING AND 1 PRECEDING) AS prior FROM t),
    b AS (SELECT *, {DAY} AS bucket FROM p WHERE prior >= 3) SELECT user_id, ts, prior, bucket FROM (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY ts) AS r FROM b) WHERE r = 1""")
def historical_context(spark, d):
    return evidence.historical_context(table(spark, d, "events"), ["user_id"], "ts", 172800, 86400)


@query(f"""WITH s AS (SELECT event_type, {SIX} AS bucket, quantile_cont(value, 0.5) AS median FROM events WHERE value > 30 GROUP BY event_type, {SIX}), span AS (SELECT event_type, min(epoch_us(bucket)) AS a, max(epoch_us(bucket)) AS b FROM s GROUP BY event_type),
    g AS (SELECT event_type, make_timestamp(unnest(range(a, b + 1, 21600000000))) AS bucket FROM span), j AS (SELECT g.event_type, g.bucket, s.median, row_number() OVER (PARTITION BY g.event_type ORDER BY g.bucket) AS i FROM g LEFT JOIN s ON s.event_type = g.event_type AND s.bucket = g.bucket),
    k AS (SELECT *, last_value(median IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN median IS NOT NULL THEN i END IGNORE NULLS) OVER p AS i0, first_value(median IGNORE NULLS) OVER q AS v1, first_value(CASE WHEN median IS NOT NULL THEN i END IGNORE NULLS) OVER q AS i1 FROM j
        WINDOW p AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_type, bucket, round(CASE WHEN median IS NOT NULL THEN median WHEN i - i0 <= 2 AND v1 IS NOT NULL THEN v0 + (v1 - v0) * (i - i0) / (i1 - i0) END, 6) AS value FROM k""")
def resample_interpolate(spark, d):
    grid = series.resample_median(table(spark, d, "events").where("value > 30"), "event_type", "ts", "value", 21600)
    return rounded(series.interpolate(grid, "event_type"), "value")


FORECAST = """i AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS DOUBLE) AS i FROM events),
    f AS (SELECT event_id, event_type, value, lead(value, 5) OVER w AS y_true, avg(value) OVER a AS moving_average, CASE WHEN count(value) OVER t >= 2 THEN regr_intercept(value, i) OVER t + regr_slope(value, i) OVER t * (i + 5) END AS linear_trend FROM i WINDOW t AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), w AS (PARTITION BY event_type ORDER BY event_id), a AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {FORECAST} SELECT event_id, y_true, value AS persistence, round(moving_average, 4) AS moving_average, round(linear_trend, 4) AS linear_trend FROM f")
def forecast_baselines(spark, d):
    out = series.forecasts(table(spark, d, "events"), "event_type", "event_id", "value")
    return out.select("event_id", "y_true", "persistence", F.round("moving_average", 4).alias("moving_average"), F.round("linear_trend", 4).alias("linear_trend"))


@query(f"""WITH {FORECAST}, e AS (SELECT event_type, y_true, abs(y_true - moving_average) AS e FROM f WHERE y_true IS NOT NULL)
    SELECT CASE WHEN grouping(event_type) = 1 THEN '__global__' ELSE event_type END AS event_type, round(avg(e), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(100 * avg(CASE WHEN abs(y_true) >= 0.1 THEN e / abs(y_true) END), 3) AS mape, round(avg(CASE WHEN abs(y_true) >= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS applicable FROM e GROUP BY ROLLUP (event_type)""")
def forecast_metrics(spark, d):
    out = series.forecasts(table(spark, d, "events"), "event_type", "event_id", "value")
    out = evaluate.forecast_metrics(out, "event_type", "y_true", "moving_average")
    return out.select("event_type", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("mape", 3).alias("mape"), F.round("applicable", 6).alias("applicable"))


@query("""WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE event_id % 10 < 6 GROUP BY event_type) SELECT event_id, round((value - m) / CASE WHEN s <= 1e-8 THEN 1 ELSE s END, 6) AS scaled FROM events JOIN s USING (event_type)""")
def standard_scaler(spark, d):
    return series.standardize(table(spark, d, "events"), "event_type", "value", F.col("event_id") % 10 < 6).select("event_id", F.round("scaled", 6).alias("scaled"))


@query("""WITH x AS (SELECT user_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1000000 AS d FROM events), m AS (SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, quantile_cont(d, 0.5) AS median_step, count(*) FILTER (d = 0) AS repeated FROM x GROUP BY user_id)
    SELECT m.user_id, n, first_ts, last_ts, round(median_step, 4) AS median_step, repeated, count(*) FILTER (d > 1.5 * median_step) AS gaps FROM m JOIN x USING (user_id) GROUP BY ALL""")
def temporal_profile(spark, d):
    return series.temporal_profile(table(spark, d, "events"), "user_id", "ts").withColumn("median_step", F.round("median_step", 4))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) <= 1 AS constant FROM events" for c in ("event_id", "user_id", "event_type", "value", "props")))
def column_profile(spark, d):
    return series.column_profile(table(spark, d, "events"), ["event_id", "user_id", "event_type", "value", "props"])


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def dedupe_first(spark, d):
    return windows.first_by(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("""WITH a AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS original, CASE WHEN event_id % 50 <> 0 THEN date_trunc('day', ts) END AS t FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, original ORDER BY event_id) > 1 AS dup FROM a),
    c AS (SELECT *, last_value(CASE WHEN NOT dup THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)
    SELECT event_id, CASE WHEN t IS NULL THEN 'INVALID' WHEN dup THEN 'DUPLICATE' WHEN t < before THEN 'OUT_OF_ORDER' ELSE 'VALID' END AS quality_flag FROM c""")
def order_quality_flags(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("original"), F.when(F.col("event_id") % 50 != 0, F.date_trunc("day", "ts").cast("timestamp_ntz")).alias("t"))
    return windows.quality_flags(e, "user_id", "event_id", "original", "t").select("event_id", "quality_flag")


@query("""WITH n AS (SELECT count(*) AS n FROM orders), w AS (SELECT DISTINCT CASE WHEN i = 499 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / CAST(499 AS DOUBLE))) AS BIGINT) END AS k FROM n, range(500) r(i)) SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY epoch_us(o_orderdate) + o_orderkey) - 1 AS k FROM orders) JOIN w USING (k)""")
def even_sample(spark, d):
    return windows.even_sample(table(spark, d, "orders").select("o_orderkey", (S.micros(F.col("o_orderdate")) + F.col("o_orderkey")).alias("_order")), "_order", 500).select("o_orderkey")


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_./:-]+')) AS term FROM documents) SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM t GROUP BY doc_id""")
def tokenize_terms(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("term").alias("n_terms"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_./:-]+') AS t FROM documents), p AS (SELECT doc_id, t, unnest(range(CAST(greatest(ceil((len(t) - 30) / 130), 1) AS INTEGER))) AS position FROM t WHERE len(t) > 0)
    SELECT doc_id, CAST(position AS INTEGER) AS position, md5(array_to_string(t[position * 130 + 1 : position * 130 + 160], ' ')) AS chunk_md5 FROM p""")
def word_windows(spark, d):
    return text.word_windows(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "position", F.md5("chunk").alias("chunk_md5"))


@query("""WITH t AS (SELECT item_id, sha256(unnest(regexp_extract_all(lower(text), '[a-z0-9_./:-]+'))) AS h FROM benchmark),
    w AS (SELECT item_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 384 AS slot, sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS w FROM t GROUP BY ALL HAVING w <> 0)
    SELECT item_id, slot, round(CAST(w AS DOUBLE) / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM w""")
def hashing_embedding(spark, d):
    return rounded(text.hashing_embedding(table(spark, d, "benchmark"), "item_id", "text"), "weight")


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id < 10), s AS (SELECT query_id, vec_id, list_cosine_similarity(q, CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings WHERE vec_id <> query_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS position FROM s) SELECT query_id, vec_id, round(score, 6) AS score, position FROM r WHERE position <= 5""")
def cosine_topk(spark, d):
    v = table(spark, d, "embeddings")
    return rounded(text.cosine_top_k(v.where("vec_id < 10"), v, 5), "score")


@query("SELECT event_id, severity, n FROM (SELECT event_id, CASE WHEN value / 100 >= 0.8 THEN 'CRITICAL' WHEN value / 100 >= 0.6 THEN 'HIGH' WHEN value / 100 >= 0.35 THEN 'MEDIUM' WHEN value / 100 >= 0.15 THEN 'LOW' ELSE 'INFO' END AS severity, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events)")
def parse_and_grade(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", S.severity(F.col("value") / 100, S.LADDERS["risk"]).alias("severity"), F.get_json_object("props", "$.k").try_cast("bigint").alias("n"))


@query("SELECT event_id, round(sin(2 * pi() * h), 6) AS hour_sin, round(cos(2 * pi() * h), 6) AS hour_cos, isodow(ts) - 1 AS weekday FROM (SELECT event_id, ts, (hour(ts) + minute(ts) / 60 + floor(second(ts)) / 3600) / 24 AS h FROM events)")
def cyclic_time(spark, d):
    h = (F.hour("ts") + F.minute("ts") / 60 + F.second("ts") / 3600) / 24
    return table(spark, d, "events").select("event_id", F.round(F.sin(2 * F.pi() * h), 6).alias("hour_sin"), F.round(F.cos(2 * F.pi() * h), 6).alias("hour_cos"), F.weekday("ts").cast("long").alias("weekday"))
