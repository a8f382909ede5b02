"""Queries of the assessment operators; they are added to the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.operators import assess, evaluate, isolation, logs, series
from telemetra.plans.catalogue import DAY, FAILURES, FORECAST, HOUR, LOGS, RANGES, SEVERITY, SIGNALS, failures, log_rows, query, ranges, rounded, signals, table


def _forecast(spark, d):
    e = table(spark, d, "events")
    f = series.forecasts(e, "event_type", "event_id", "value")
    return f.select("event_id", "event_type", "y_true", "moving_average")


@query(f"""WITH {FAILURES}, s AS (SELECT failure_id, 'far' AS stage, start_ts - INTERVAL 6 HOUR AS a, start_ts - INTERVAL 1 HOUR AS b FROM fail
    UNION ALL SELECT failure_id, 'near', start_ts - INTERVAL 1 HOUR, start_ts - INTERVAL 10 MINUTE FROM fail UNION ALL SELECT failure_id, 'imminent', start_ts - INTERVAL 10 MINUTE, start_ts FROM fail
    UNION ALL SELECT failure_id, 'active', start_ts, end_ts + INTERVAL 1 MICROSECOND FROM fail UNION ALL SELECT failure_id, 'after', end_ts, end_ts + INTERVAL 1 HOUR FROM fail),
    g AS (SELECT failure_id, stage, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM events JOIN s ON ts >= a AND ts < b GROUP BY ALL)
    SELECT failure_id, stage, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round((mean - max(CASE WHEN stage = 'far' THEN mean END) OVER w) / greatest(max(CASE WHEN stage = 'far' THEN sd END) OVER w, 1e-8), 6) AS effect FROM g WINDOW w AS (PARTITION BY failure_id)""")
def prefailure_stages(spark, d):
    return rounded(assess.prefailure_stages(table(spark, d, "events"), failures(spark), "ts", "value"), "mean", "sd", "effect")


@query(f"""WITH {FAILURES}, g AS (SELECT failure_id, min(CASE WHEN value >= 100 THEN ts END) AS first_warning, max(value) AS max_probability FROM events JOIN fail ON ts >= start_ts - INTERVAL 6 HOUR AND ts < start_ts GROUP BY failure_id)
    SELECT failure_id, first_warning, round(epoch_us(start_ts) / 3.6e9 - epoch_us(first_warning) / 3.6e9, 6) AS lead_hours, max_probability, CAST(first_warning IS NOT NULL AS INTEGER) AS covered FROM fail LEFT JOIN g USING (failure_id)""")
def early_warning(spark, d):
    return rounded(assess.early_warning(table(spark, d, "events"), failures(spark), "ts", "value", 100.0, "6 hours"), "lead_hours")


@query("""WITH r AS (SELECT ts < TIMESTAMP '2024-01-20' AS t, 'value' AS feature, value AS x FROM events UNION ALL SELECT ts < TIMESTAMP '2024-01-20', 'user_id', CAST(user_id AS DOUBLE) FROM events),
    g AS (SELECT feature, avg(x) FILTER (t) AS a, stddev_pop(x) FILTER (t) AS s, avg(x) FILTER (NOT t) AS b, quantile_cont(x, 0.01) FILTER (t) AS q01, quantile_cont(x, 0.99) FILTER (t) AS q99 FROM r GROUP BY feature)
    SELECT feature, round(a, 6) AS train_mean, round(s, 6) AS train_sd, round(b, 6) AS test_mean, round(q01, 6) AS q01, round(q99, 6) AS q99, round((b - a) / greatest(s, 1e-8), 6) AS shift, CAST(b < q01 OR b > q99 AS INTEGER) AS outside FROM g""")
def distribution_shift(spark, d):
    train = F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")
    return rounded(assess.distribution_shift(table(spark, d, "events"), ["value", "user_id"], train), "train_mean", "train_sd", "test_mean", "q01", "q99", "shift")


@query(f"""WITH {RANGES}, {FORECAST}, x AS (SELECT event_id, event_type, abs(y_true - moving_average) / greatest(sd, 1e-8) AS z FROM f JOIN ranges USING (event_type) WHERE y_true IS NOT NULL)
    SELECT event_id, event_type, round(z, 6) AS z, round(least(greatest(z / 4, 0), 1), 6) AS normalized, {SEVERITY('z', 'residual')} AS severity FROM x WHERE z >= 1""")
def forecast_deviation(spark, d):
    out = assess.forecast_deviations(_forecast(spark, d), ranges(spark, d), "event_type", "y_true", "moving_average")
    return rounded(out, "z", "normalized").select("event_id", "event_type", "z", "normalized", "severity")


@query(f"""WITH {RANGES}, {FORECAST}, x AS (SELECT event_type, y_true < q01 OR y_true > q99 AS y, moving_average < q01 OR moving_average > q99 AS p FROM f JOIN ranges USING (event_type) WHERE y_true IS NOT NULL),
    g AS (SELECT event_type, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (NOT y AND NOT p) AS tn, count(*) FILTER (y AND NOT p) AS fn FROM x GROUP BY event_type),
    h AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS "precision", CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM g)
    SELECT *, CASE WHEN "precision" + recall = 0 THEN 0 ELSE 2 * "precision" * recall / ("precision" + recall) END AS f1, CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END AS fpr FROM h""")
def forecast_risk_summary(spark, d):
    return evaluate.binary_metrics(assess.risk_flags(_forecast(spark, d), ranges(spark, d), "event_type", "y_true", "moving_average"), ["event_type"], "actual_outside", "predicted_outside")


@query("""WITH g AS (SELECT event_type, count(*) FILTER (a AND b) AS agreed, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither
    FROM (SELECT event_type, value > 100 AS a, user_id % 3 = 0 AS b FROM events) GROUP BY event_type) SELECT *, round(CASE WHEN agreed + only_a + only_b = 0 THEN 0 ELSE agreed / (agreed + only_a + only_b) END, 6) AS jaccard FROM g""")
def detector_complementarity(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("value") > 100).cast("int").alias("a"), (F.col("user_id") % 3 == 0).cast("int").alias("b"))
    return rounded(assess.complementarity(e, ["event_type"], "a", "b"), "jaccard")


@query(f"""{SIGNALS}, r AS (SELECT entity, ts, signal_type, normalized, CAST(row_number() OVER (PARTITION BY signal_type ORDER BY round(normalized, 9) DESC, ts DESC, entity) AS INTEGER) AS position FROM rated)
    SELECT entity, ts, signal_type, round(normalized, 6) AS normalized, position FROM r WHERE position <= 250""")
def limited_signals(spark, d):
    out = assess.limited(signals(spark, d), ["signal_type"], [F.desc(F.round("normalized", 9)), F.desc("ts"), F.asc("entity")], 250)
    return rounded(out, "normalized").select("entity", "ts", "signal_type", "normalized", "position")


@query(f"""{SIGNALS}, k AS (SELECT entity, signal_type, count(*) AS c FROM rated GROUP BY ALL), t AS (SELECT entity, first(signal_type ORDER BY c DESC, signal_type) AS dominant_type FROM k GROUP BY entity)
    SELECT entity, count(*) AS n, round(avg(normalized), 6) AS mean_score, round(max(normalized), 6) AS max_score, dominant_type FROM rated JOIN t USING (entity) GROUP BY ALL""")
def per_metric_evidence(spark, d):
    return rounded(assess.summary_by(signals(spark, d), ["entity"], "signal_type"), "mean_score", "max_score")


@query(f"{SIGNALS} SELECT signal_type, count(*) AS n, (SELECT count(*) FROM logs) AS rows, round(1000 * count(*) / (SELECT count(*) FROM logs), 6) AS rate FROM rated GROUP BY signal_type")
def signal_rates(spark, d):
    return rounded(assess.per_thousand(signals(spark, d), log_rows(spark, d), "signal_type"), "rate")


@query(f"""WITH {LOGS}, k AS (SELECT dataset, event, component, count(*) AS c FROM logs GROUP BY ALL)
    SELECT dataset, event, CAST(sum(c) AS BIGINT) AS n, first(component ORDER BY c DESC, component) AS component, round(sum(c) / sum(sum(c)) OVER (PARTITION BY dataset), 6) AS frequency FROM k GROUP BY dataset, event""")
def log_event_statistics(spark, d):
    return rounded(assess.event_statistics(log_rows(spark, d)), "frequency")


@query(f"""WITH {LOGS}, k AS (SELECT component, event, count(*) AS n FROM logs GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY component ORDER BY n DESC, event) AS INTEGER) AS position FROM k) SELECT * FROM r WHERE position <= 3""")
def top_event_distribution(spark, d):
    counts = log_rows(spark, d).groupBy("component", "event").agg(F.count("*").alias("n"))
    return assess.limited(counts, ["component"], [F.desc("n"), F.asc("event")], 3)


@query(f"""WITH {LOGS}, b AS (SELECT dataset, {DAY} AS bucket, count(*) AS n, count(*) FILTER (level IN ('WARN', 'ERROR')) / count(*) AS r FROM logs GROUP BY ALL),
    s AS (SELECT DISTINCT dataset, {DAY} AS bucket FROM logs WHERE event = 'error' AND component = 'c3'), x AS (SELECT * FROM b ANTI JOIN s USING (dataset, bucket))
    SELECT dataset, anomalous_rate, n, bucket FROM (SELECT dataset, round(r, 6) AS anomalous_rate, n, bucket, row_number() OVER (PARTITION BY dataset ORDER BY r, n, bucket) AS p FROM x) WHERE p = 1""")
def calmest_log_bucket(spark, d):
    rows = log_rows(spark, d)
    loud = logs.frequency(rows.where("event = 'error' and component = 'c3'"), 86400, "event")
    return rounded(assess.calmest_bucket(logs.bucket_summary(rows, 86400), loud), "anomalous_rate")


@query(f"""WITH {LOGS}, b AS (SELECT dataset, {HOUR} AS bucket, count(*) AS n, count(*) FILTER (level IN ('WARN', 'ERROR')) / count(*) AS r FROM logs GROUP BY ALL),
    s AS (SELECT DISTINCT dataset, {HOUR} AS bucket FROM logs WHERE event = 'error' AND component = 'c3'), x AS (SELECT * FROM b ANTI JOIN s USING (dataset, bucket))
    SELECT dataset, anomalous_rate, n, bucket FROM (SELECT dataset, round(r, 6) AS anomalous_rate, n, bucket, row_number() OVER (PARTITION BY dataset ORDER BY r, n, bucket) AS p FROM x) WHERE p = 1""")
def calmest_log_hour(spark, d):
    rows = log_rows(spark, d)
    loud = logs.frequency(rows.where("event = 'error' and component = 'c3'"), 3600, "event")
    return rounded(assess.calmest_bucket(logs.bucket_summary(rows, 3600), loud), "anomalous_rate")


@query(f"""WITH {LOGS}, s AS (SELECT dataset, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY dataset ORDER BY ts, seq)) / 1e6 AS step FROM logs), m AS (SELECT dataset, quantile_cont(step, 0.5) AS median_step FROM s WHERE step IS NOT NULL GROUP BY dataset),
    g AS (SELECT dataset, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT event) AS n_events, count(DISTINCT component) AS n_components FROM logs GROUP BY dataset) SELECT dataset, n, first_ts, last_ts, n_events, n_components, round(median_step, 6) AS median_step FROM g LEFT JOIN m USING (dataset)""")
def log_profile(spark, d):
    return rounded(assess.log_profile(log_rows(spark, d)), "median_step")


@query(f"""WITH {LOGS}, p AS (SELECT dataset, ts, seq, lag(event) OVER (PARTITION BY dataset ORDER BY ts, seq) || '->' || event AS event FROM logs), u AS (SELECT * FROM p WHERE event IS NOT NULL),
    s AS (SELECT dataset, event, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY dataset) AS frequency FROM u GROUP BY dataset, event),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY dataset, event ORDER BY ts, seq) AS INTEGER) AS occurrence FROM u JOIN s USING (dataset, event) WHERE n <= 2 OR frequency <= 0.04)
    SELECT dataset, event, ts, seq, n, round(frequency, 6) AS frequency, occurrence, round(greatest(1 - least(frequency / 0.04, 1), 1 / n), 6) AS normalized FROM r WHERE occurrence <= 3""")
def detect_sequence_anomalies(spark, d):
    pairs = logs.with_previous(log_rows(spark, d)).select("dataset", "ts", "seq", F.concat_ws("->", "previous", "event").alias("event"))
    return rounded(logs.rare(pairs, "event", most=2, share=0.04), "frequency", "normalized")


@query(f"""WITH s AS (SELECT event_type, {HOUR} AS h, count(*) FILTER (value > 100) / count(*) AS f FROM events GROUP BY ALL)
    SELECT event_type, round(avg(f), 6) AS mean, round(quantile_cont(f, 0.5), 6) AS median, round(var_pop(f), 6) AS variance, round(min(f), 6) AS least, round(max(f), 6) AS most, round(avg(CAST(f > 0 AS DOUBLE)), 6) AS nonzero FROM s GROUP BY event_type""")
def robustness_summary(spark, d):
    s = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg((F.count_if(F.col("value") > 100) / F.count("*")).alias("f"))
    return rounded(assess.robustness(s, "event_type", "f"), "mean", "median", "variance", "least", "most", "nonzero")


@query()
def isolation_forest(spark, d):
    e = table(spark, d, "events").withColumn("hour", F.hour("ts"))
    return isolation.isolation_scores(e, "event_type", "event_id", ["value", "hour"], F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
