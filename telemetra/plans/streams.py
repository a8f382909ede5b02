"""Queries that run the streaming twins over a table, and the same as SQL over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.plans.catalogue import RANGES, SEVERITY, query, ranges, rounded, table
from telemetra.streaming import twins as W

D = "CAST({} AS DOUBLE)".format
PAST = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def events(spark, d):
    return W.stream(spark, f"{d}/events.parquet")


def plain(df):
    """Times as in the tables."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.simpleString() == "timestamp"})


@query(f"""WITH b AS (SELECT make_timestamp(epoch_us(ts) - epoch_us(ts) % 3600000000) AS bucket, event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_anomalous FROM events GROUP BY ALL) SELECT * FROM b WHERE bucket + INTERVAL 1 HOUR <= {PAST}""")
def stream_bucket_counts(spark, d):
    return plain(W.drained(W.bucket_counts(events(spark, d), ["event_type"], "10 minutes", "1 hour", "event_type")))


@query(f"""WITH w AS (SELECT event_type, value, make_timestamp(epoch_us(ts) - epoch_us(ts) % 1800000000 - unnest([0, 1800000000])) AS start_ts FROM events), g AS (SELECT start_ts, start_ts + INTERVAL 1 HOUR AS end_ts, event_type, count(*) AS n, avg(value) AS mean, min(value) AS least, max(value) AS most FROM w GROUP BY ALL)
    SELECT start_ts, end_ts, event_type, n, round(mean, 6) AS mean, least, most FROM g WHERE end_ts <= {PAST}""")
def stream_sliding(spark, d):
    return rounded(plain(W.drained(W.sliding(events(spark, d), ["event_type"], "value", "10 minutes", "1 hour", "30 minutes"))), "mean")


@query(f"""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 7200000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s), r AS (SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 2 HOUR AS end_ts, count(*) AS n FROM g GROUP BY user_id, g)
    SELECT start_ts, end_ts, user_id, n FROM r WHERE end_ts <= {PAST}""")
def stream_sessions(spark, d):
    return plain(W.drained(W.sessions(events(spark, d), "user_id", "10 minutes", "2 hours")))


@query(f"""WITH {RANGES}, x AS (SELECT event_id, event_type, value, q01, q99, abs((value - mean) / greatest(sd, 1e-8)) AS z FROM events JOIN ranges USING (event_type))
    SELECT event_id, round(z, 6) AS z, round(least(z / 5, 1), 6) AS normalized, {SEVERITY('z', 'anomaly')} AS severity FROM x WHERE z >= 2.5 OR value < q01 OR value > q99""")
def stream_breaches(spark, d):
    out = W.breaches(events(spark, d), ranges(spark, d), "event_type", "value").select("event_id", "z", "normalized", "severity")
    return rounded(W.drained(out), "z", "normalized")


@query(f"""WITH s AS (SELECT 'u' || (user_id % 10) AS entity, make_timestamp(epoch_us(ts) - epoch_us(ts) % 21600000000) AS bucket, least(value / 100 * {D(0.4)} * {D(0.75)}, {D(0.95)}) AS c FROM events), g AS (SELECT entity, bucket, 1 - product(1 - c) AS risk, count(*) AS evidence FROM s GROUP BY ALL)
    SELECT entity, bucket, round(risk, 6) AS risk, evidence, {SEVERITY('risk', 'risk')} AS severity FROM g WHERE bucket + INTERVAL 6 HOUR <= {PAST}""")
def stream_risk(spark, d):
    s = events(spark, d).select("ts", F.concat(F.lit("u"), F.col("user_id") % 10).alias("entity"), F.lit("LOG_LEVEL").alias("signal_type"), (F.col("value") / 100).alias("normalized"), F.lit("MEDIUM").alias("reliability"))
    return rounded(plain(W.drained(W.risk(s, "10 minutes", "6 hours"))), "risk")


@query("""WITH a AS (SELECT event_id AS row_id, user_id, ts, CAST(event_type = 'click' AS INTEGER) AS state, epoch_us(ts) AS us FROM events), b AS (SELECT *, CASE WHEN lag(state) OVER w IS NULL THEN 0 ELSE CAST(state <> lag(state) OVER w AS INTEGER) END AS transition FROM a WINDOW w AS (PARTITION BY user_id ORDER BY us, row_id))
    SELECT user_id, row_id, state, transition, round((us - max(CASE WHEN transition = 1 THEN us END) OVER (PARTITION BY user_id ORDER BY us, row_id)) / 1000000, 3) AS seconds_since FROM b""")
def stream_state_changes(spark, d):
    e = events(spark, d).select("user_id", "ts", F.col("event_id").alias("row_id"), (F.col("event_type") == "click").cast("int").alias("state"))
    return W.drained(W.state_changes(e, "user_id", "state")).drop("ts").withColumn("seconds_since", F.round("seconds_since", 3))


@query("""WITH t AS (SELECT DISTINCT user_id, epoch_us(ts) AS us FROM events), p AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS prior FROM t) SELECT e.user_id, event_id AS row_id, prior FROM events e JOIN p ON p.user_id = e.user_id AND p.us = epoch_us(e.ts)""")
def stream_history(spark, d):
    e = events(spark, d).select("user_id", "ts", F.col("event_id").alias("row_id"))
    return W.drained(W.history(e, "user_id", 86400)).drop("ts")


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_without_repeats(spark, d):
    e = events(spark, d)
    twice = e.unionByName(e)
    return W.drained(W.without_repeats(twice, ["event_id"], "60 days").select("event_id", "event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS on_time, CAST(0 AS BIGINT) AS late FROM events")
def stream_late_rows(spark, d):
    from telemetra.sources.sinks import scratch

    root = scratch(spark, "late-rows")
    W.with_late(events(spark, d), 3600, f"{root}/on_time", f"{root}/late")
    one = lambda n: spark.read.parquet(f"{root}/{n}").agg(F.count("*").alias(n))
    return one("on_time").crossJoin(one("late"))
