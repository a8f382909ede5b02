"""Queries of signals, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.functions import scalars as S
from telemetra.operators import assess, logs
from telemetra.operators import signals as G
from telemetra.plans.catalogue import DAY, HOUR, LOGS, SEVERITY, SIX, log_rows, query, rounded, table

D = "CAST({} AS DOUBLE)".format


def states(spark, d):
    e = table(spark, d, "events")
    return e.select("ts", F.concat(F.lit("u"), F.col("user_id") % 5).alias("entity"), (F.col("event_type") == "click").cast("int").alias("COMP"), (F.col("value") > 40).cast("int").alias("MPG"))


@query(f"""WITH l AS (SELECT 'u' || (user_id % 5) AS entity, {SIX} AS ts, unnest([{{'state': 'COMP', 'x': CAST(event_type = 'click' AS DOUBLE)}}, {{'state': 'MPG', 'x': CAST(value > 40 AS DOUBLE)}}]) AS s FROM events),
    b AS (SELECT entity, s.state AS state, ts, CAST(quantile_cont(s.x, 0.5) >= 0.5 AS INTEGER) AS active FROM l GROUP BY ALL), c AS (SELECT *, lag(active) OVER (PARTITION BY entity, state ORDER BY ts) AS before FROM b)
    SELECT ts, entity, 'STATE_TRANSITION' AS signal_type, state AS metric_name, CAST(active AS DOUBLE) AS value, CASE active WHEN 1 THEN {D(0.65)} ELSE {D(0.45)} END AS normalized, CASE active WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity, 'LOW' AS reliability,
    round({D(0.45)} * (0.5 + 0.5 * CASE active WHEN 1 THEN {D(0.65)} ELSE {D(0.45)} END), 6) AS confidence, state || ' operating state transitioned to ' || CASE active WHEN 1 THEN 'active' ELSE 'inactive' END || '.' AS description,
    substr(sha1(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '|' || entity || '|STATE_TRANSITION|' || state || '|' || active || '.000000000'), 1, 16) AS signal_id FROM c WHERE before IS NOT NULL AND before <> active""")
def state_transition_signals(spark, d):
    out = G.state_transition_signals(states(spark, d), "entity", "ts", ["COMP", "MPG"], 21600)
    return rounded(out, "confidence").select("ts", "entity", "signal_type", "metric_name", "value", "normalized", "severity", "reliability", "confidence", "description", "signal_id")


def predictions(spark, d):
    e = table(spark, d, "events")
    return e.select("ts", F.col("event_id").alias("row_id"), F.concat(F.lit("u"), F.col("user_id") % 5).alias("entity"), F.when(F.col("event_id") % 3 == 0, "h6").otherwise("h12").alias("candidate_id"), F.when(F.col("event_id") % 2 == 0, "random_forest").otherwise("logistic").alias("model"), F.when(F.col("event_id") % 5 < 3, "train").otherwise("test").alias("split"), F.round(F.col("value") / 500, 6).alias("probability"))


@query(f"""WITH p AS (SELECT ts, event_id, 'u' || (user_id % 5) AS entity, round(value / 500, 6) AS probability, row_number() OVER (ORDER BY round(value / 500, 6) DESC, event_id) - 1 AS i, count(*) OVER () AS n FROM events WHERE event_id % 5 >= 3 AND event_id % 3 = 0 AND event_id % 2 = 0 AND round(value / 500, 6) >= 0.02),
    k AS (SELECT DISTINCT CASE WHEN j = 39 THEN n - 1 ELSE CAST(floor(j * ((n - 1) / {D(39)})) AS BIGINT) END AS i FROM (SELECT max(n) AS n FROM p), range(40) r(j))
    SELECT event_id, ts, entity, probability AS value, round(least(probability / {D(0.2)}, 1), 6) AS normalized, {SEVERITY('probability', 'failure')} AS severity, 'RESEARCH_ONLY' AS validity, 'RESEARCH_ONLY' AS reliability FROM p JOIN k USING (i)""")
def research_failure_signals(spark, d):
    out = G.research_failure_signals(predictions(spark, d), "test", "h6", "random_forest", most=40)
    ids = predictions(spark, d).select(F.col("row_id").alias("event_id"), "ts", "entity")
    return rounded(out, "normalized").join(ids, ["ts", "entity"]).select("event_id", "ts", "entity", "value", "normalized", "severity", "validity", "reliability")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}', {D({'HIGH': 1.0, 'MEDIUM': 0.75, 'LOW': 0.45, 'RESEARCH_ONLY': 0.15}[v])}, '{G.TIER_RULES[v]}')" for k, v in G.RELIABILITY.items()) + ") t(source, reliability, weight, rule)")
def reliability_table(spark, d):
    return G.reliability_table(spark)


@query("""SELECT doc_id, CASE WHEN lang = 'en' AND source LIKE 's%' THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN 's' ELSE 'x' END AS source FROM documents)""")
def resolve_reliability(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.col("lang").alias("ds"), F.when(F.col("doc_id") % 4 == 0, "metropt_failure_prediction_v2").otherwise("other").alias("m"))
    return x.select("doc_id", G.reliability(F.col("ds"), F.col("m"), {"en:metropt_failure_prediction": "MEDIUM", "de:metropt": "HIGH"}).alias("tier"))


@query("""WITH s AS (SELECT 'f' || (user_id % 3) AS dataset, ts FROM events UNION ALL SELECT 'long', TIMESTAMP '2000-01-01' UNION ALL SELECT 'long', TIMESTAMP '2001-01-01' UNION ALL SELECT 'hour', TIMESTAMP '2000-01-01 00:00:00' UNION ALL SELECT 'hour', TIMESTAMP '2000-01-01 01:00:00'),
    g AS (SELECT dataset, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS span FROM s GROUP BY dataset)
    SELECT dataset, span AS span_seconds, CASE WHEN dataset = 'f1' THEN 300 WHEN span <= 120 THEN 1 WHEN span <= 3600 THEN 10 WHEN span <= 604800 THEN 3600 WHEN span <= 3888000 THEN 86400 ELSE 604800 END AS bucket_seconds FROM g""")
def log_bucket_choice(spark, d):
    rows = table(spark, d, "events").select(F.concat(F.lit("f"), F.col("user_id") % 3).alias("dataset"), "ts")
    more = spark.sql("SELECT dataset, CAST(ts AS timestamp_ntz) AS ts FROM VALUES ('long', '2000-01-01'), ('long', '2001-01-01'), ('hour', '2000-01-01 00:00:00'), ('hour', '2000-01-01 01:00:00') t(dataset, ts)")
    return G.bucket_frequency(rows.unionByName(more), {"f1": 300})


LABELS = "lab AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'anomaly' ELSE 'normal' END AS label_kind FROM events WHERE event_id % 4 <> 0)"


@query(f"""WITH {LABELS}, p AS (SELECT DISTINCT event_id FROM events WHERE value > 60), j AS (SELECT p.event_id IS NOT NULL AS p, label_kind FROM lab FULL JOIN p ON p.event_id = lab.event_id),
    c AS (SELECT count(*) FILTER (p) AS predicted, count(*) FILTER (label_kind = 'anomaly') AS anomalies, count(*) FILTER (p AND label_kind = 'anomaly') AS tp, count(*) FILTER (p AND label_kind = 'normal') AS fp, count(*) FILTER (NOT p AND label_kind = 'anomaly') AS fn, count(*) FILTER (NOT p AND label_kind = 'normal') AS tn FROM j)
    SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, round(fp / (fp + tn), 6) AS false_alarm_rate FROM c""")
def log_signals_against_labels(spark, d):
    e = table(spark, d, "events").withColumn("label", F.when(F.col("event_type") == "error", "ERR").otherwise("-"))
    flagged = e.where("value > 60").select(F.lit("events").alias("dataset"), F.col("event_id").cast("string").alias("event_id"))
    other = flagged.withColumn("dataset", F.lit("unlabelled"))
    out = G.against_labels(flagged.unionByName(flagged).unionByName(other.where("event_id % 4 = 1")), G.log_labels(e.where("event_id % 4 <> 0"), "events", "event_id", "label"))
    return rounded(out, "precision", "recall", "f1", "false_alarm_rate")


@query(f"""WITH {LOGS}, b AS (SELECT *, {HOUR} AS bucket FROM logs), s AS (SELECT bucket, count(*) AS n FROM b GROUP BY bucket HAVING count(*) >= 22),
    r AS (SELECT dataset, b.bucket, ts, seq, event, CAST(row_number() OVER (PARTITION BY b.bucket ORDER BY ts, seq) AS INTEGER) AS position FROM b JOIN s USING (bucket)) SELECT dataset, bucket, seq, event, position FROM r WHERE position <= 8""")
def log_case_preview(spark, d):
    rows = log_rows(spark, d)
    cases = logs.bucket_summary(rows, 3600).where("n >= 22")
    return G.raw_preview(cases, rows, 3600).select("dataset", "bucket", "seq", "event", "position")


@query(f"""WITH {LOGS}, g AS (SELECT dataset, event, count(*) AS n FROM logs GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY dataset ORDER BY n DESC, event) AS INTEGER) AS position FROM g QUALIFY position <= 3""")
def log_top_events(spark, d):
    return G.top_events(log_rows(spark, d), 3)


KINDS = f"""k AS (SELECT ts, 'u' || (user_id % 5) AS entity, CASE event_type WHEN 'click' THEN 'TREND' WHEN 'view' THEN 'CURRENT_ANOMALY' WHEN 'error' THEN 'LOG_LEVEL' ELSE 'LOG_RARE_EVENT' END AS signal_type, round(least(value / 100, {D(1)}), 6) AS normalized FROM events)"""


def kinds(spark, d):
    kind = F.when(F.col("event_type") == "click", "TREND").when(F.col("event_type") == "view", "CURRENT_ANOMALY").when(F.col("event_type") == "error", "LOG_LEVEL").otherwise("LOG_RARE_EVENT")
    return table(spark, d, "events").select("ts", F.concat(F.lit("u"), F.col("user_id") % 5).alias("entity"), kind.alias("signal_type"), F.round(F.least(F.col("value") / 100, F.lit(1.0)), 6).alias("normalized"))


@query(f"WITH {KINDS} SELECT signal_type, ts, entity, normalized FROM (SELECT *, row_number() OVER (PARTITION BY signal_type ORDER BY normalized DESC, ts, entity DESC) AS r FROM k) WHERE r = 1")
def log_case_studies(spark, d):
    return G.log_cases(kinds(spark, d))


@query(f"""WITH {KINDS}, t AS (SELECT count(*) AS telemetry_evidence, list_sort(list(DISTINCT signal_type)) AS tt FROM k WHERE signal_type NOT LIKE 'LOG%'), l AS (SELECT count(*) AS log_evidence, list_sort(list(DISTINCT signal_type)) AS lt FROM k WHERE signal_type LIKE 'LOG%')
    SELECT telemetry_evidence, array_to_string(tt, '|') AS telemetry_types, log_evidence, array_to_string(lt, '|') AS log_types, true AS complementary FROM t, l""")
def evidence_modalities(spark, d):
    k = kinds(spark, d)
    out = G.modalities(k.where("signal_type not like 'LOG%'"), k.where("signal_type like 'LOG%'"))
    return out.select("telemetry_evidence", F.array_join("telemetry_types", "|").alias("telemetry_types"), "log_evidence", F.array_join("log_types", "|").alias("log_types"), "complementary")


@query(f"""WITH {KINDS} SELECT signal_type, count(*) AS n, round(avg(normalized), 6) AS mean, round(stddev_pop(normalized), 6) AS sd, min(normalized) AS least, max(normalized) AS most, round(quantile_cont(normalized, 0.5), 6) AS median FROM k GROUP BY signal_type""")
def score_spread(spark, d):
    return rounded(G.spread(kinds(spark, d), ["signal_type"], "normalized"), "mean", "sd", "median")


@query("""WITH f AS (SELECT ts AS input_end_ts, CASE WHEN event_id % 97 = 0 THEN ts - INTERVAL 1 MINUTE ELSE ts + INTERVAL 5 MINUTE END AS target_ts FROM events), s AS (SELECT ts + INTERVAL 5 MINUTE AS ts FROM events WHERE value > 100 UNION ALL SELECT ts - INTERVAL 1 MINUTE FROM events WHERE event_id % 194 = 0),
    m AS (SELECT target_ts, min(input_end_ts) AS input_end_ts FROM f GROUP BY target_ts)
    SELECT (SELECT count(*) FROM f) AS rows_checked, (SELECT count(*) FROM f WHERE target_ts < input_end_ts) AS alignment_errors, (SELECT count(*) FROM s) AS signals_checked, (SELECT count(*) FROM s JOIN m ON s.ts = m.target_ts WHERE s.ts < m.input_end_ts) AS signals_before_input_end, true AS leakage_detected""")
def forecast_leakage_audit(spark, d):
    e = table(spark, d, "events")
    f = e.select(F.col("ts").alias("input_end_ts"), F.when(F.col("event_id") % 97 == 0, F.expr("ts - interval 1 minute")).otherwise(F.expr("ts + interval 5 minutes")).alias("target_ts"))
    s = e.where("value > 100").select(F.expr("ts + interval 5 minutes").alias("ts")).unionByName(e.where("event_id % 194 = 0").select(F.expr("ts - interval 1 minute").alias("ts")))
    return G.residual_leakage(f, s)


@query(f"""WITH {LOGS}, p AS (SELECT dataset, seq, event, component, lag(event) OVER w AS previous_event, lag(component) OVER w AS previous_component, row_number() OVER w AS n FROM logs WINDOW w AS (PARTITION BY component ORDER BY ts, seq))
    SELECT seq, event, previous_event FROM p WHERE n > 1""")
def event_sequences(spark, d):
    from telemetra.operators import windows

    rows = log_rows(spark, d)
    return windows.event_sequences(rows, "component", ["ts", "seq"], ["event"]).select("seq", "event", "previous_event")


@query(f"""WITH {LOGS}, s AS (SELECT component, {DAY} AS bucket, count(*) AS n FROM logs WHERE level = 'ERROR' GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY component ORDER BY n DESC, bucket) AS INTEGER) AS position FROM s) SELECT * FROM r WHERE position <= 2""")
def strongest_buckets(spark, d):
    s = log_rows(spark, d).where("level = 'ERROR'").groupBy("component", S.bucket(F.col("ts"), 86400).alias("bucket")).agg(F.count("*").alias("n"))
    return assess.limited(s, ["component"], [F.desc("n"), F.col("bucket")], 2)
