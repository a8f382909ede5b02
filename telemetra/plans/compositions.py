"""Queries that put several operators together: prepared series, all log detectors, summaries of data sets, grids of settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.scalars import LADDERS, severity
from telemetra.operators import detectors, evaluate, evidence, forecasting, labels, logs, models, series, windows
from telemetra.operators import signals as G
from telemetra.plans import audits, detections
from telemetra.plans.catalogue import DAY, HOUR, LOGS, _spike_sql, log_rows, query, rounded, table
from telemetra.sources import sinks

D = "CAST({} AS DOUBLE)".format


def prepared(spark, d, length: int = 6) -> DataFrame:
    """Series as detectors take them: labels from windows and points, causal features, chronological split, values scaled by
    the training rows without a label, rows with all features."""
    rows = labels.label_observations(audits.observed(spark, d), audits.spans(spark, d), audits.points(spark, d), "entity", "ts")
    rows = windows.causal_rolling(rows, "entity", ["ts", "event_id"], "value")
    rows = windows.chronological_split(rows, "entity", ["ts", "event_id"])
    rows = series.standardize(rows, "entity", "value", (F.col("split") == "train") & (F.col("label") == 0))
    return rows.where(windows.finite(["rolling_zscore_long", "trend_short", "pct_change_1"]))


PREPARED = f"""{audits.LABELLED}, h AS (SELECT ob.*, EXISTS (SELECT 1 FROM sp WHERE sp.entity = ob.entity AND ob.ts BETWEEN start_ts AND end_ts) AS inside, EXISTS (SELECT 1 FROM pt WHERE pt.entity = ob.entity AND pt.ts = ob.ts) AS spot FROM ob),
    lb AS (SELECT event_id, entity, ts, value, CASE WHEN max(CAST(inside AS INTEGER)) OVER (PARTITION BY entity) = 1 THEN CAST(inside AS INTEGER) ELSE CAST(spot AS INTEGER) END AS label, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM h),
    sq AS (SELECT *, CASE WHEN i < floor(n * {D(0.6)}) THEN 'train' WHEN i < floor(n * {D(0.6)}) + floor(n * {D(0.2)}) THEN 'validation' ELSE 'test' END AS split FROM lb), st AS (SELECT entity, avg(value) AS m, stddev_pop(value) AS s FROM sq WHERE split = 'train' AND label = 0 GROUP BY entity),
    pp AS (SELECT event_id, entity, label, split, i, (value - m) / CASE WHEN s <= 1e-8 THEN 1 ELSE s END AS scaled FROM sq JOIN st USING (entity) WHERE i >= 3)"""


@query(f"WITH {PREPARED} SELECT event_id, entity, label, split, round(scaled, 6) AS scaled FROM pp")
def prepared_series(spark, d):
    return rounded(prepared(spark, d), "scaled").select("event_id", "entity", "label", "split", "scaled")


@query(f"WITH {PREPARED} SELECT split, count(DISTINCT entity) AS series, count(*) AS observations, CAST(sum(label) AS BIGINT) AS labelled FROM pp GROUP BY split")
def dataset_summary(spark, d):
    return prepared(spark, d).groupBy("split").agg(F.countDistinct("entity").alias("series"), F.count("*").alias("observations"), F.sum(F.col("label").cast("long")).alias("labelled"))


def log_signals(rows: DataFrame) -> DataFrame:
    """The signals of all log detectors in one shape: (dataset, signal_type, ts, metric_name, normalized, severity)."""
    shape = lambda df, kind, ts, name: df.select("dataset", F.lit(kind).alias("signal_type"), F.col(ts).alias("ts"), name.alias("metric_name"), "normalized")
    event = rows.withColumn("event", F.concat_ws(":", "component", "event"))
    pairs = logs.with_previous(rows).withColumn("event", F.concat_ws(">", "previous", "event"))
    parts = [
        shape(logs.rare(event, "event", share=0.02), "LOG_RARE_EVENT", "ts", F.col("event")),
        shape(logs.spikes(rows, 3600, "event", z_least=2.0), "LOG_FREQUENCY", "bucket", F.col("event")),
        shape(logs.level_anomalies(rows, 3600, z_least=1.0), "LOG_LEVEL", "bucket", F.lit("level")),
        shape(logs.rare(pairs, "event", most=2, share=0.005), "LOG_SEQUENCE", "ts", F.col("event")),
        shape(logs.spikes(rows, 3600, "component", z_least=2.0), "LOG_COMPONENT", "bucket", F.col("component")),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("severity", severity(F.col("normalized"), LADDERS["log"]))


@query(f"""WITH r AS ({_spike_sql("event", 3_600_000_000, 5, 2.0)}), c AS ({_spike_sql("component", 3_600_000_000, 5, 2.0)}), g AS (SELECT 'LOG_FREQUENCY' AS signal_type, normalized FROM r UNION ALL SELECT 'LOG_COMPONENT', normalized FROM c)
    SELECT signal_type, count(*) AS n, round(max(normalized), 6) AS top FROM g GROUP BY signal_type""")
def log_evidence(spark, d):
    out = log_signals(log_rows(spark, d)).where("signal_type in ('LOG_FREQUENCY', 'LOG_COMPONENT')")
    return rounded(out.groupBy("signal_type").agg(F.count("*").alias("n"), F.max("normalized").alias("top")), "top")


@query(f"""WITH {LOGS}, x AS (SELECT component AS entity, {DAY} AS bucket, count(*) AS n, count(*) FILTER (level = 'ERROR') AS errors FROM logs GROUP BY ALL), p AS (SELECT *, lag(errors) OVER (PARTITION BY entity ORDER BY bucket) AS before FROM x)
    SELECT entity, bucket, n, errors, errors - before AS more FROM p WHERE before IS NOT NULL AND errors > before""")
def error_growth(spark, d):
    x = log_rows(spark, d).groupBy(F.col("component").alias("entity"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("level") == "ERROR").alias("errors"))
    before = F.lag("errors").over(Window.partitionBy("entity").orderBy("bucket"))
    return x.withColumn("before", before).where("before is not null and errors > before").select("entity", "bucket", "n", "errors", (F.col("errors") - F.col("before")).alias("more"))


@query(" UNION ALL ".join(f"""SELECT * FROM (WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, max(CAST(event_type = 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS y FROM events)
    SELECT {k} AS length, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM a WHERE i >= {k} AND (i - {k}) % 4 = 0)""" for k in (4, 8, 16)))
def window_sensitivity(spark, d):
    e = table(spark, d, "events").withColumn("y", (F.col("event_type") == "error").cast("int"))
    one = lambda k: windows.sequence_windows(e, "user_id", ["ts", "event_id"], "value", "y", k, 4).agg(F.lit(k).alias("length"), F.count("*").alias("n"), F.sum(F.col("window_label").cast("long")).alias("positives"))
    return reduce(DataFrame.unionByName, map(one, (4, 8, 16)))


@query("SELECT count(*) AS rows, true AS several FROM lineitem")
def written_files_audit(spark, d):
    path = f"{sinks.scratch(spark, 'audit')}/lineitem"
    sinks.write_partitioned(table(spark, d, "lineitem"), path, ("l_returnflag",))
    files = sinks.rows_by_file(spark, path)
    return files.agg(F.sum("n").alias("rows"), (F.count("*") > 1).alias("several"))


@query()
def model_family(spark, d):
    """Every classifier on one split, with the metrics of its best validation threshold on the test rows."""
    rows, out = detections.model_rows(spark, d), []
    for kind in ("logistic", "boosted"):
        fitted = models.fit_classifier(rows.where("split = 'train'"), kind, ["price", "customer"], ["priority"], "y")
        scored = models.predict(fitted, rows.where("split <> 'train'"))
        best = evaluate.best_threshold(scored.where("split = 'validation'"), "y", "score", [0.1, 0.3, 0.5, 0.7]).select("threshold")
        test = scored.where("split = 'test'").crossJoin(F.broadcast(best))  # one row
        out.append(detectors.evaluate_scores(test.withColumn("model", F.lit(kind)), ["model", "threshold"], "y", "score", F.col("threshold")))
    return reduce(DataFrame.unionByName, out)


@query(f"WITH {audits.TARGETS} SELECT event_id, target, split FROM tg WHERE event_id % 6 = 0 AND value IS NOT NULL")
def modeling_frame(spark, d):
    rows = audits.targets(spark, d)
    return windows.stride(rows.where(windows.finite(["value"])), "event_id", 6).select("event_id", "target", "split")


@query(f"""WITH {LOGS}, b AS (SELECT dataset, {HOUR} AS bucket, count(*) AS n FROM logs GROUP BY ALL), e AS (SELECT component, CASE WHEN max(n) >= 8 THEN 'busy' ELSE 'calm' END AS kind FROM (SELECT component, {HOUR} AS bucket, count(*) AS n FROM logs GROUP BY ALL) GROUP BY component) SELECT kind, count(*) AS components, (SELECT max(n) FROM b) AS busiest FROM e GROUP BY kind""")
def busy_components(spark, d):
    rows = log_rows(spark, d)
    top = logs.frequency(rows, 3600, "component").groupBy("component").agg(F.when(F.max("n") >= 8, "busy").otherwise("calm").alias("kind"))
    busiest = logs.bucket_summary(rows, 3600).agg(F.max("n").alias("busiest"))
    return top.groupBy("kind").agg(F.count("*").alias("components")).crossJoin(F.broadcast(busiest))  # one row


@query("""WITH w AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n, count(*) OVER (PARTITION BY event_type) AS k FROM events) SELECT event_type, count(*) AS n, CAST(count(*) FILTER (event_id % 10 < 8) AS BIGINT) AS fitting FROM w WHERE n >= 6 AND (n - 6) % 2 = 0 AND n + 3 <= k GROUP BY event_type""")
def pooled_windows(spark, d):
    w = forecasting.forecast_windows(table(spark, d, "events"), "event_type", "event_id", ["value"], 6, 3, 2)
    return w.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("input_end") % 10 < 8).alias("fitting"))


@query(f"SELECT event_id, round(least(greatest({D(0.75)} * (0.5 + 0.5 * value / 500), 0), 1), 6) AS confidence FROM events")
def signal_confidence(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") / 500).alias("normalized"), F.lit("MEDIUM").alias("tier"))
    return rounded(e.withColumn("confidence", G.confidence("tier", "normalized")), "confidence").select("event_id", "confidence")


@query("SELECT 'HIGH' AS tier, CAST(1 AS DOUBLE) AS weight UNION ALL SELECT 'MEDIUM', 0.75 UNION ALL SELECT 'LOW', 0.45 UNION ALL SELECT 'RESEARCH_ONLY', 0.15 UNION ALL SELECT 'none', 0")
def tier_weights(spark, d):
    rows = spark.createDataFrame([(t,) for t in ("HIGH", "MEDIUM", "LOW", "RESEARCH_ONLY", "none")], "tier string")
    return rows.select("tier", evidence.weight_of("tier", evidence.RELIABILITY_WEIGHTS).alias("weight"))
