"""Queries of incidents and candidates, and the same as SQL. The evidence is made of events, a row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.functions import scalars as S
from telemetra.operators import evidence as E
from telemetra.operators import incidents as I
from telemetra.plans.catalogue import SEVERITY, query, rounded, table
from telemetra.sources.sinks import kept

TYPES = ("CURRENT_ANOMALY", "FORECAST_DEVIATION", "TREND", "STATE_TRANSITION", "HISTORICAL_CONTEXT", "FAILURE_SIGNAL")
RULES = I.Rules(bucket_seconds=3600, risk_least=0.6, bucket_evidence=2, window_evidence=4, persistence_least=120.0, critical_risk=0.85, gap_seconds=3600, merge_gap_seconds=10800, jaccard=0.4, components={"click": "web", "view": "web", "purchase": "shop"})


def evidence(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select(F.concat(F.lit("s"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("signal_id"), "ts", F.concat(F.lit("e"), F.col("user_id") % 10).alias("entity"), kind.alias("signal_type"), F.col("event_type").alias("metric_name"), F.round(F.least(F.col("value") / 100, F.lit(1.0)), 6).alias("normalized"), (F.lit(0.25) + F.lit(0.125) * (F.col("event_id") % 5)).alias("confidence"), F.concat(F.lit("m"), F.col("event_id") % 3).alias("source_model"), F.lit("events").alias("source_dataset"), F.when(F.col("event_id") % 7 == 0, "RESEARCH_ONLY").otherwise("VALID").alias("validity"), F.col("event_type").alias("description"))


def risks(spark, d) -> DataFrame:
    own = evidence(spark, d).withColumn("bucket", S.bucket(F.col("ts"), 3600))
    out = own.groupBy("entity", "bucket").agg(F.round(1 - F.product(1 - F.col("normalized") * 0.9), 6).alias("risk"), F.count("*").alias("evidence"))
    return out.withColumn("severity", S.severity(F.col("risk"), S.LADDERS["risk"]))


def parts(spark, d):
    r, e = risks(spark, d), evidence(spark, d)
    first = kept(I.detect(r, e, RULES))  # a row for each incident, read several times
    merged = kept(I.merge(first, r, e, RULES))
    return r, e, first, merged


BASE = f"""WITH RECURSIVE ev AS (SELECT 's' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS signal_id, ts, make_timestamp(epoch_us(ts) - epoch_us(ts) % 3600000000) AS bucket, 'e' || (user_id % 10) AS entity,
      ['CURRENT_ANOMALY', 'FORECAST_DEVIATION', 'TREND', 'STATE_TRANSITION', 'HISTORICAL_CONTEXT', 'FAILURE_SIGNAL'][event_id % 6 + 1] AS signal_type, event_type AS metric_name,
      round(least(value / 100, 1), 6) AS normalized, CAST(0.25 AS DOUBLE) + CAST(0.125 AS DOUBLE) * (event_id % 5) AS confidence, 'm' || (event_id % 3) AS source_model, 'events' AS source_dataset, event_id % 7 = 0 AS research FROM events),
    rk0 AS (SELECT entity, bucket, round(1 - product(1 - normalized * CAST(0.9 AS DOUBLE)), 6) AS risk, count(*) AS evidence FROM ev GROUP BY ALL),
    rk AS (SELECT *, {SEVERITY('risk', 'risk')} AS severity FROM rk0),
    hot AS (SELECT *, CASE WHEN epoch_us(bucket) - lag(epoch_us(bucket)) OVER w > 3600000000 OR lag(bucket) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM rk WHERE risk >= 0.6 AND evidence >= 2 WINDOW w AS (PARTITION BY entity ORDER BY bucket)),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY entity ORDER BY bucket) AS g FROM hot),
    sp AS (SELECT entity, g, min(bucket) AS start_ts, max(bucket) AS end_ts FROM runs GROUP BY ALL)"""


def _described(spans: str, out: str) -> str:
    return f"""{out}r AS (SELECT s.entity, s.start_ts, s.end_ts, max(risk) AS risk_score, avg(risk) AS mean_risk, count(*) AS buckets, arg_max(severity, risk) AS severity FROM {spans} s JOIN rk ON rk.entity = s.entity AND rk.bucket BETWEEN s.start_ts AND s.end_ts GROUP BY ALL),
    {out}e AS (SELECT s.entity, s.start_ts, count(*) AS evidence, list_sort(list(DISTINCT metric_name)) AS metric_names, list_sort(list(DISTINCT signal_type)) AS evidence_types FROM {spans} s JOIN ev ON ev.entity = s.entity AND ev.bucket BETWEEN s.start_ts AND s.end_ts GROUP BY ALL),
    {out} AS (SELECT *, (epoch_us(end_ts) - epoch_us(start_ts)) / 60000000 + 60 AS persistence_minutes FROM {out}r JOIN {out}e USING (entity, start_ts) WHERE evidence >= 4 AND ((epoch_us(end_ts) - epoch_us(start_ts)) / 60000000 + 60 >= 120 OR risk_score >= 0.85))"""


FIRST = BASE + ", " + _described("sp", "w1")
MERGED = FIRST + """, ord AS (SELECT entity, start_ts, end_ts, list_distinct(list_concat(metric_names, evidence_types)) AS pattern, row_number() OVER (PARTITION BY entity ORDER BY start_ts) AS k FROM w1),
    fold AS (SELECT entity, k, start_ts, end_ts, pattern, 1 AS merged, 1 AS grp FROM ord WHERE k = 1
      UNION ALL SELECT entity, k, CASE WHEN yes THEN s0 ELSE s1 END, e1, CASE WHEN yes THEN list_distinct(list_concat(p0, p1, coalesce(between_, []))) ELSE p1 END, CASE WHEN yes THEN merged + 1 ELSE 1 END, CASE WHEN yes THEN grp ELSE grp + 1 END FROM (
        SELECT o.entity, o.k, f.start_ts AS s0, o.start_ts AS s1, greatest(o.end_ts, CASE WHEN false THEN f.end_ts ELSE o.end_ts END) AS e1, f.pattern AS p0, o.pattern AS p1, f.merged, f.grp,
          (epoch_us(o.start_ts) - epoch_us(f.end_ts)) / 1000000 <= 10800 AND len(list_intersect(f.pattern, o.pattern)) / len(list_distinct(list_concat(f.pattern, o.pattern))) >= 0.4 AS yes,
          (SELECT list_distinct(list_concat(list(DISTINCT metric_name), list(DISTINCT signal_type))) FROM ev WHERE ev.entity = o.entity AND ev.bucket > f.end_ts AND ev.bucket < o.start_ts) AS between_
        FROM fold f JOIN ord o ON o.entity = f.entity AND o.k = f.k + 1)),
    ms AS (SELECT entity, grp, min(start_ts) AS start_ts, max(end_ts) AS end_ts, max(merged) AS merged FROM fold GROUP BY entity, grp), """ + _described("ms", "w2")
WINDOW_COLUMNS = "entity, start_ts, end_ts, severity, round(risk_score, 6) AS risk_score, round(mean_risk, 6) AS mean_risk, evidence, buckets, round(persistence_minutes, 4) AS persistence_minutes, array_to_string(metric_names, '|') AS metric_names, array_to_string(evidence_types, '|') AS evidence_types"


def _shown(df: DataFrame) -> DataFrame:
    out = rounded(df, "risk_score", "mean_risk").withColumn("persistence_minutes", S.rounded_as_sql(F.col("persistence_minutes"), 4))
    out = out.withColumns({c: F.array_join(c, "|") for c in ("metric_names", "evidence_types")})
    return out.select("entity", "start_ts", "end_ts", "severity", "risk_score", "mean_risk", "evidence", "buckets", "persistence_minutes", "metric_names", "evidence_types")


@query(FIRST + f" SELECT {WINDOW_COLUMNS} FROM w1")
def incident_windows(spark, d):
    return _shown(I.detect(risks(spark, d), evidence(spark, d), RULES))


@query(MERGED + f" SELECT {WINDOW_COLUMNS} FROM w2")
def incident_merge(spark, d):
    return _shown(parts(spark, d)[3])


FEATURES = ("magnitude", "persistence", "signal_count", "multi_signal_support", "forecast_deviation", "trend_strength", "state_transition", "temporal_precedence", "historical_recurrence", "confidence")
_top = lambda t: f"coalesce(max(normalized) FILTER (signal_type = '{t}'), 0)"
RANKED = MERGED + f""", pk AS (SELECT w.entity, w.start_ts, min(bucket) FILTER (risk = risk_score) AS peak FROM w2 w JOIN rk ON rk.entity = w.entity AND rk.bucket BETWEEN w.start_ts AND w.end_ts GROUP BY ALL),
    cr AS (SELECT w.entity, w.start_ts, w.end_ts, unnest([{{'kind': 'metric', 'candidate': metric_name}}, {{'kind': 'component', 'candidate': CASE metric_name WHEN 'click' THEN 'web' WHEN 'view' THEN 'web' WHEN 'purchase' THEN 'shop' ELSE metric_name END}}, {{'kind': 'entity', 'candidate': w.entity}}]) AS c,
        ev.* EXCLUDE (entity) FROM w2 w JOIN ev ON ev.entity = w.entity AND ev.bucket BETWEEN w.start_ts AND w.end_ts),
    cg AS (SELECT entity, start_ts, end_ts, c.kind AS kind, c.candidate AS candidate, count(*) AS n, count(DISTINCT metric_name) AS nm, min(metric_name) AS m1, min(ts) AS first_ts, max(ts) AS last_ts, (max(normalized) + avg(normalized)) / 2 AS magnitude, list(DISTINCT signal_type) AS types, avg(confidence) AS confidence,
        {_top('FORECAST_DEVIATION')} AS forecast_deviation, {_top('TREND')} AS trend_strength, {_top('STATE_TRANSITION')} AS state_transition, {_top('HISTORICAL_CONTEXT')} AS historical_recurrence, max(CAST(research AS INTEGER)) AS research FROM cr GROUP BY ALL HAVING c.kind <> 'component' OR count(DISTINCT metric_name) > 1 OR c.candidate <> min(metric_name)),
    cf AS (SELECT cg.*, (epoch_us(last_ts) - epoch_us(first_ts)) / 60000000 + 60 AS minutes, greatest((epoch_us(peak) - epoch_us(first_ts)) / 60000000, 0) / greatest((epoch_us(end_ts) - epoch_us(start_ts)) / 60000000, 1e-8) AS lead,
        list_aggregate(list_transform(types, lambda t: CAST(CASE t WHEN 'CURRENT_ANOMALY' THEN 1.0 WHEN 'FORECAST_DEVIATION' THEN 0.95 WHEN 'TREND' THEN 0.75 WHEN 'HISTORICAL_CONTEXT' THEN 0.55 WHEN 'STATE_TRANSITION' THEN 0.45 WHEN 'FAILURE_SIGNAL' THEN 0.2 ELSE 0.5 END AS DOUBLE)), 'avg') AS role FROM cg JOIN pk USING (entity, start_ts)),
    cw AS (SELECT *, least(minutes / 60, 1) AS persistence, least(ln(1 + n) / ln(CAST(13 AS DOUBLE)), 1) AS signal_count, least(len(types) / 4, 1) AS multi_signal_support, least(lead, 1) AS temporal_precedence FROM cf),
    cs AS (SELECT *, least(greatest((CAST(0.24 AS DOUBLE) * magnitude + CAST(0.16 AS DOUBLE) * persistence + CAST(0.12 AS DOUBLE) * signal_count + CAST(0.14 AS DOUBLE) * multi_signal_support + CAST(0.1 AS DOUBLE) * forecast_deviation + CAST(0.08 AS DOUBLE) * trend_strength + CAST(0.04 AS DOUBLE) * state_transition
        + CAST(0.06 AS DOUBLE) * temporal_precedence + CAST(0.04 AS DOUBLE) * historical_recurrence + CAST(0.02 AS DOUBLE) * confidence) * least(greatest(role + CAST(0.15 AS DOUBLE), CAST(0.35 AS DOUBLE)), 1) * CAST(CASE kind WHEN 'metric' THEN 1.0 WHEN 'component' THEN 0.95 ELSE 0.75 END AS DOUBLE), 0), 1) AS score FROM cw),
    cp AS (SELECT *, CAST(row_number() OVER (PARTITION BY entity, start_ts ORDER BY round(score, 9) DESC, n DESC, minutes DESC, candidate DESC, kind DESC) AS INTEGER) AS position FROM cs QUALIFY position <= 8)"""


@query(RANKED + f" SELECT entity, start_ts, kind, candidate, n, position, round(score, 6) AS score, {', '.join(f'round({f}, 6) AS {f}' for f in FEATURES)} FROM cp")
def rca_candidate_ranking(spark, d):
    r, e, _, merged = parts(spark, d)
    return rounded(I.candidates(merged, r, e, RULES), "score", *FEATURES).select("entity", "start_ts", "kind", "candidate", "n", "position", "score", *FEATURES)


@query(MERGED + """, x AS (SELECT w.entity, w.start_ts, metric_name, max(normalized) AS max_normalized, avg(normalized) AS mean_normalized, count(*) AS n FROM w2 w JOIN ev ON ev.entity = w.entity AND ev.bucket BETWEEN w.start_ts AND w.end_ts GROUP BY ALL)
    SELECT entity, start_ts, metric_name, max_normalized, round(mean_normalized, 6) AS mean_normalized, n, CAST(row_number() OVER (PARTITION BY entity, start_ts ORDER BY max_normalized DESC, n DESC, metric_name DESC) AS INTEGER) AS position FROM x QUALIFY position <= 3""")
def incident_top_metrics(spark, d):
    _, e, _, merged = parts(spark, d)
    out = I.top_metrics(merged, e, RULES, 3).join(merged.select("incident_id", "entity", "start_ts"), "incident_id")
    return rounded(out, "mean_normalized").drop("incident_id")


@query(MERGED + """, a AS (SELECT w.entity, w.start_ts, ev.bucket, count(*) AS n, array_to_string(list_sort(list(DISTINCT signal_type)), '|') AS types, array_to_string(list_sort(list(DISTINCT metric_name)), '|') AS metrics FROM w2 w JOIN ev ON ev.entity = w.entity AND ev.bucket BETWEEN w.start_ts AND w.end_ts GROUP BY ALL)
    SELECT entity, start_ts, bucket, risk, rk.severity, n, types, metrics FROM a JOIN rk USING (entity, bucket)""")
def incident_timelines(spark, d):
    r, e, _, merged = parts(spark, d)
    return I.timelines(merged, r, e, RULES).join(merged.select("incident_id", "entity", "start_ts"), "incident_id").drop("incident_id")


@query(RANKED + """, m AS (SELECT w.entity, w.start_ts, metric_name, row_number() OVER (PARTITION BY w.entity, w.start_ts ORDER BY max(normalized) DESC, count(*) DESC, metric_name DESC) AS k FROM w2 w JOIN ev ON ev.entity = w.entity AND ev.bucket BETWEEN w.start_ts AND w.end_ts GROUP BY w.entity, w.start_ts, metric_name),
    n AS (SELECT entity, start_ts, string_agg(metric_name, ', ' ORDER BY k) AS names FROM m WHERE k <= 3 GROUP BY ALL)
    SELECT w2.entity, w2.start_ts, (SELECT count(*) FROM cp WHERE cp.entity = w2.entity AND cp.start_ts = w2.start_ts) AS n_candidates, w2.severity || ' evidence window for ' || w2.entity || '. Top metric signals: ' || names || '. Top candidate: ' || cp.candidate || '.' AS summary
    FROM w2 JOIN n USING (entity, start_ts) JOIN cp ON cp.entity = w2.entity AND cp.start_ts = w2.start_ts AND cp.position = 1""")
def incident_reports(spark, d):
    r, e, _, merged = parts(spark, d)
    out = I.reports(merged, I.candidates(merged, r, e, RULES), I.top_metrics(merged, e, RULES))
    return out.select("entity", "start_ts", F.size("candidates").cast("long").alias("n_candidates"), "summary")


DOUBT = RANKED + """, du AS (SELECT entity, start_ts, count(*) AS candidates, max(score) FILTER (position = 1) - max(score) FILTER (position = 2) AS gap, CAST(sum(research) AS BIGINT) AS research FROM cp GROUP BY ALL),
    dd AS (SELECT *, research + coalesce(greatest(0, CAST(0.05 AS DOUBLE) - gap), 0) AS doubt FROM du)"""


@query(DOUBT + " SELECT entity, start_ts, candidates, round(gap, 6) AS gap, research, round(doubt, 6) AS doubt FROM dd")
def incident_uncertainty(spark, d):
    r, e, _, merged = parts(spark, d)
    out = I.uncertainty(I.candidates(merged, r, e, RULES)).join(merged.select("incident_id", "entity", "start_ts"), "incident_id")
    return rounded(out, "gap", "doubt").select("entity", "start_ts", "candidates", "gap", "research", "doubt")


@query(RANKED + """, s AS (SELECT cr.entity, cr.start_ts, c.kind AS kind, c.candidate AS candidate, signal_id, cr.ts, signal_type, metric_name, normalized, row_number() OVER (PARTITION BY cr.entity, cr.start_ts, c.kind, c.candidate ORDER BY cr.ts, signal_id) AS k FROM cr)
    SELECT s.entity, s.start_ts, s.kind, s.candidate, s.signal_id, s.ts, s.signal_type, s.metric_name, s.normalized FROM s JOIN cp USING (entity, start_ts, kind, candidate) WHERE k <= 20""")
def candidate_lineage(spark, d):
    r, e, _, merged = parts(spark, d)
    ranked = I.candidates(merged, r, e, RULES)
    return I.lineage(ranked, e).join(ranked.select("candidate_id", "entity", "start_ts", "kind", "candidate"), "candidate_id").drop("candidate_id")


@query(RANKED + """, hi AS (SELECT entity, bucket FROM rk WHERE risk >= 0.6 AND evidence >= 2)
    SELECT (SELECT count(*) FROM w1) AS preliminary, (SELECT count(*) FROM w2) AS merged, round(coalesce(1 - (SELECT count(*) FROM w2) / nullif((SELECT count(*) FROM w1), 0), 0), 6) AS duplicate_rate,
      round((SELECT count(DISTINCT signal_id) FROM w2 w JOIN ev ON ev.entity = w.entity AND ev.bucket BETWEEN w.start_ts AND w.end_ts) / (SELECT count(*) FROM ev), 6) AS evidence_coverage,
      round(coalesce((SELECT count(*) FROM hi WHERE EXISTS (SELECT 1 FROM w2 w WHERE w.entity = hi.entity AND hi.bucket BETWEEN w.start_ts AND w.end_ts)) / nullif((SELECT count(*) FROM hi), 0), 0), 6) AS high_risk_coverage,
      round(coalesce((SELECT avg(evidence) FROM w2), 0), 6) AS mean_evidence, round(coalesce((SELECT count(*) FROM cp) / nullif((SELECT count(*) FROM w2), 0), 0), 6) AS mean_candidates, CAST((SELECT count(*) FROM cp) > 0 AS DOUBLE) AS provenance,
      round(coalesce((SELECT avg(CAST(start_ts <= first_ts AND last_ts <= end_ts + INTERVAL 1 HOUR AS INTEGER)) FROM cp), 0), 6) AS temporal_consistency, CAST((SELECT count(*) FROM cp) > 0 AS DOUBLE) AS rank_consistency""")
def incident_evaluation(spark, d):
    r, e, first, merged = parts(spark, d)
    out = I.evaluation(first, merged, I.candidates(merged, r, e, RULES), r, e, RULES)
    return rounded(out, "duplicate_rate", "evidence_coverage", "high_risk_coverage", "mean_evidence", "mean_candidates", "temporal_consistency")


@query(DOUBT + """, j AS (SELECT w2.*, epoch_us(end_ts) - epoch_us(start_ts) AS d FROM w2)
    SELECT * FROM (SELECT 'normal_period' AS case_name, entity, bucket AS at, round(risk, 6) AS value FROM rk ORDER BY round(risk, 9), evidence, bucket, entity LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'isolated_anomaly', entity, start_ts, round(risk_score, 6) FROM j ORDER BY d, round(risk_score, 9), start_ts, entity LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'persistent_anomaly', entity, start_ts, round(risk_score, 6) FROM j ORDER BY d DESC, round(risk_score, 9) DESC, start_ts, entity LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'pre_failure_period', entity, start_ts, round(risk_score, 6) FROM j WHERE start_ts <= TIMESTAMP '2024-01-20 12:00:00' AND end_ts >= TIMESTAMP '2024-01-19 12:00:00' ORDER BY round(risk_score, 9) DESC, buckets DESC, start_ts, entity LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'difficult_noisy_case', entity, start_ts, round(risk_score, 6) FROM j JOIN dd USING (entity, start_ts) ORDER BY round(doubt, 9) DESC, candidates DESC, round(risk_score, 9) DESC, start_ts, entity LIMIT 1)""")
def incident_case_studies(spark, d):
    r, e, _, merged = parts(spark, d)
    return rounded(I.case_studies(r, merged, I.candidates(merged, r, e, RULES), "2024-01-20 12:00:00", 24), "value")


@query(BASE + """, x AS (SELECT rk.*, ev.signal_id, ev.metric_name, ev.normalized, ev.confidence FROM (SELECT * FROM rk WHERE severity = 'CRITICAL') rk JOIN ev USING (entity, bucket))
    SELECT entity, bucket, signal_id, metric_name, normalized, CAST(row_number() OVER (PARTITION BY entity, bucket ORDER BY normalized DESC, confidence DESC, signal_id) AS INTEGER) AS position FROM x QUALIFY position <= 8""")
def case_evidence(spark, d):
    r = risks(spark, d).where("severity = 'CRITICAL'").select("entity", "bucket")
    return E.case_evidence(r, I.with_buckets(evidence(spark, d), RULES)).select("entity", "bucket", "signal_id", "metric_name", "normalized", "position")
