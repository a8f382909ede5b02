"""Incident windows, root-cause candidates, reports and their evaluation.

risks: (entity, bucket, risk, severity, evidence). evidence: (signal_id, ts, entity, signal_type, metric_name, normalized,
confidence, source_model, source_dataset, validity, description).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.scalars import bucket, clamp, log_score, micros, stable_id
from telemetra.functions.spans import in_spans

# Order of severities; weights of candidate features, of the roles of signal types, of kinds of candidates.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
FEATURE_WEIGHTS = {"magnitude": 0.24, "persistence": 0.16, "signal_count": 0.12, "multi_signal_support": 0.14, "forecast_deviation": 0.10, "trend_strength": 0.08, "state_transition": 0.04, "temporal_precedence": 0.06, "historical_recurrence": 0.04, "confidence": 0.02}
ROLE_WEIGHTS = {"CURRENT_ANOMALY": 1.00, "FORECAST_DEVIATION": 0.95, "TREND": 0.75, "HISTORICAL_CONTEXT": 0.55, "STATE_TRANSITION": 0.45, "FAILURE_SIGNAL": 0.20}
KIND_WEIGHTS = {"metric": 1.00, "component": 0.95, "entity": 0.75}


@dataclass(frozen=True)
class Rules:
    """When buckets make a window, windows one incident, and how candidates are scored."""

    bucket_seconds: int = 300
    risk_least: float = 0.80
    bucket_evidence: int = 6
    window_evidence: int = 8
    persistence_least: float = 5.0
    critical_risk: float = 0.80
    gap_seconds: int = 900
    merge_gap_seconds: int = 1200
    jaccard: float = 0.25
    persistence_cap: float = 60.0
    signal_cap: int = 12
    type_cap: int = 4
    top: int = 8
    components: dict[str, str] = field(default_factory=dict)


def _lookup(x: Column, table: dict, default) -> Column:
    if not table:
        return F.coalesce(F.lit(default) if not isinstance(default, Column) else default)
    found = F.element_at(F.create_map(*(F.lit(y) for kv in table.items() for y in kv)), x)
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def with_buckets(evidence: DataFrame, rules: Rules) -> DataFrame:
    return evidence.withColumn("bucket", bucket(F.col("ts"), rules.bucket_seconds))


def _minutes(a: str, b: str) -> Column:
    return (micros(F.col(b)) - micros(F.col(a))) / 6e7


def described(spans: DataFrame, risks: DataFrame, evidence: DataFrame, rules: Rules) -> DataFrame:
    """Spans (entity, incident, start_ts, end_ts) that make an incident, over all risk rows and evidence in them.

    Enough evidence, and either long enough or with a critical bucket; patterns are metric names and signal types.
    """
    r = in_spans(risks, spans, "bucket", "start_ts", "end_ts", 86400, ("entity",), closed=True)
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    r = r.groupBy("entity", "incident").agg(F.max("risk").alias("risk_score"), F.sort_array(F.collect_list(F.struct("bucket", "risk")), asc=False).alias("_own"), F.count("risk").alias("_valued"), F.count("*").alias("buckets"), F.max(rank).alias("_rank"))
    total = F.aggregate("_own", F.lit(0.0), lambda s, x: s + F.coalesce(x["risk"].cast("double"), F.lit(0.0)))  # newest first, so that the last bits don't depend on how rows are dealt out
    r = r.withColumn("mean_risk", F.when(F.col("_valued") > 0, total / F.col("_valued"))).drop("_own", "_valued")
    e = in_spans(with_buckets(evidence, rules), spans, "bucket", "start_ts", "end_ts", 86400, ("entity",), closed=True)
    e = e.groupBy("entity", "incident").agg(F.count("*").alias("evidence"), F.sort_array(F.collect_set("metric_name")).alias("metric_names"), F.sort_array(F.collect_set("signal_type")).alias("evidence_types"), F.slice(F.sort_array(F.collect_set("signal_id")), 1, 20).alias("_ids"))
    out = spans.join(r, ["entity", "incident"]).join(e, ["entity", "incident"])
    out = out.withColumn("persistence_minutes", _minutes("start_ts", "end_ts") + rules.bucket_seconds / 60)
    out = out.where((F.col("evidence") >= rules.window_evidence) & ((F.col("persistence_minutes") >= rules.persistence_least) | (F.col("risk_score") >= rules.critical_risk)))
    severity = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("_rank").cast("int"))
    ident = F.concat(F.lit("inc_"), stable_id(F.col("entity"), F.col("start_ts").cast("string"), F.col("end_ts").cast("string"), F.array_join("_ids", "|")))
    return out.withColumns({"severity": severity, "incident_id": ident}).drop("_rank", "_ids")


def detect(risks: DataFrame, evidence: DataFrame, rules: Rules) -> DataFrame:
    """Runs of risky buckets of an entity without a longer gap, as described windows."""
    base = risks.where((F.col("risk") >= rules.risk_least) & (F.col("evidence") >= rules.bucket_evidence)).select("entity", "bucket", micros(F.col("bucket")).alias("_us"))
    w = Window.partitionBy("entity").orderBy("_us")
    base = base.withColumn("_new", F.coalesce((F.col("_us") - F.lag("_us").over(w) > rules.gap_seconds * 1_000_000).cast("int"), F.lit(1)))
    base = base.withColumn("incident", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = base.groupBy("entity", "incident").agg(F.min("bucket").alias("start_ts"), F.max("bucket").alias("end_ts"))
    return described(spans, risks, evidence, rules)


def merge(windows: DataFrame, risks: DataFrame, evidence: DataFrame, rules: Rules) -> DataFrame:
    """Windows of detect() folded from the first on: one that follows closely and has a like pattern joins what is before it.

    What is before counts with all evidence of its span, that of the gap too. Only windows that follow within the gap can
    meet, so each chain of them is folded alone, as an array.
    """
    w = Window.partitionBy("entity").orderBy("start_ts")
    rows = windows.select("entity", "start_ts", "end_ts", F.array_union("metric_names", "evidence_types").alias("pattern"))
    rows = rows.withColumn("before", F.lag("end_ts").over(w)).withColumn("_new", F.coalesce((_minutes("before", "start_ts") * 60 > rules.merge_gap_seconds).cast("int"), F.lit(1)))
    rows = rows.withColumn("chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gaps = rows.where("_new = 0").select("entity", "start_ts", F.expr("before + interval 1 microsecond").alias("_a"), F.col("start_ts").alias("_b"))
    inner = in_spans(with_buckets(evidence, rules), gaps, "bucket", "_a", "_b", 86400, ("entity",))
    inner = inner.groupBy("entity", "start_ts").agg(F.array_union(F.collect_set("metric_name"), F.collect_set("signal_type")).alias("between"))
    rows = rows.join(inner, ["entity", "start_ts"], "left").withColumn("between", F.coalesce("between", F.array().cast("array<string>")))
    chains = rows.groupBy("entity", "chain").agg(F.sort_array(F.collect_list(F.struct("start_ts", "end_ts", "pattern", "between"))).alias("own"))

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        alike = F.size(F.array_intersect(last["pattern"], x["pattern"])) / F.greatest(F.size(F.array_union(last["pattern"], x["pattern"])), F.lit(1))
        one = F.struct(last["start_ts"].alias("start_ts"), F.greatest(last["end_ts"], x["end_ts"]).alias("end_ts"), F.array_union(F.array_union(last["pattern"], x["between"]), x["pattern"]).alias("pattern"), (last["merged"] + 1).alias("merged"))
        fresh = F.struct(x["start_ts"].alias("start_ts"), x["end_ts"].alias("end_ts"), x["pattern"].alias("pattern"), F.lit(1).alias("merged"))
        return F.when(F.size(done) == 0, F.array(fresh)).when(alike >= rules.jaccard, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(one))).otherwise(F.concat(done, F.array(fresh)))

    start = F.array().cast("array<struct<start_ts:timestamp_ntz,end_ts:timestamp_ntz,pattern:array<string>,merged:int>>")
    out = chains.select("entity", F.explode(F.aggregate("own", start, add)).alias("m")).select("entity", "m.start_ts", "m.end_ts", "m.merged")
    spans = out.withColumn("incident", F.row_number().over(Window.partitionBy("entity").orderBy("start_ts")).cast("long"))
    return described(spans, risks, evidence, rules)


def candidates(windows: DataFrame, risks: DataFrame, evidence: DataFrame, rules: Rules) -> DataFrame:
    """Metrics, components and the entity of each window, scored by ten features and ranked; the first `top` of each."""
    spans = windows.select("entity", "incident_id", "start_ts", "end_ts")
    rows = in_spans(with_buckets(evidence, rules), spans, "bucket", "start_ts", "end_ts", 86400, ("entity",), closed=True)
    peak = in_spans(risks, spans, "bucket", "start_ts", "end_ts", 86400, ("entity",), closed=True).groupBy("incident_id").agg(F.max_by("bucket", F.struct(F.col("risk"), -micros(F.col("bucket")))).alias("peak"))
    kind = lambda k, name: F.struct(F.lit(k).alias("kind"), name.alias("candidate"))
    component = _lookup(F.col("metric_name"), rules.components, F.col("metric_name"))
    rows = rows.withColumn("_c", F.explode(F.array(kind("metric", F.col("metric_name")), kind("component", component), kind("entity", F.col("entity")))))
    top = lambda t: F.coalesce(F.max(F.when(F.col("signal_type") == t, F.col("normalized"))), F.lit(0.0))
    g = rows.groupBy("incident_id", "entity", "start_ts", "end_ts", "_c.kind", "_c.candidate").agg(
        F.count("*").alias("n"), F.countDistinct("metric_name").alias("_metrics"), F.min("metric_name").alias("_metric"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max("normalized").alias("_most"), F.count("normalized").alias("_valued"), F.sort_array(F.collect_set("signal_type")).alias("types"), F.avg("confidence").alias("_k"),
        top("FORECAST_DEVIATION").alias("forecast_deviation"), top("TREND").alias("trend_strength"), top("STATE_TRANSITION").alias("state_transition"), top("HISTORICAL_CONTEXT").alias("historical_recurrence"),
        F.max((F.col("validity") == "RESEARCH_ONLY").cast("int")).alias("research"),
        F.sort_array(F.collect_set("source_dataset")).alias("data_sources"), F.sort_array(F.collect_set("source_model")).alias("source_models"),
        F.sort_array(F.collect_list(F.struct("ts", "signal_id", "normalized"))).alias("_own"),
    )
    mean = F.aggregate(F.reverse("_own"), F.lit(0.0), lambda s, x: s + F.coalesce(x["normalized"], F.lit(0.0))) / F.col("_valued")  # newest first, so that the last bits don't depend on how rows are dealt out
    g = g.withColumns({"_m": (F.col("_most") + F.when(F.col("_valued") > 0, mean)) / 2, "signal_ids": F.slice(F.transform("_own", lambda x: x["signal_id"]), 1, 20)})
    g = g.where((F.col("kind") != "component") | (F.col("_metrics") > 1) | (F.col("candidate") != F.col("_metric"))).join(peak, "incident_id", "left")
    g = g.withColumn("persistence_minutes", _minutes("first_ts", "last_ts") + rules.bucket_seconds / 60)
    lead = F.greatest((micros(F.coalesce("peak", "end_ts")) - micros(F.col("first_ts"))) / 6e7, F.lit(0.0))
    g = g.withColumns({
        "magnitude": clamp(F.col("_m")), "persistence": clamp(F.col("persistence_minutes") / rules.persistence_cap), "signal_count": log_score(F.col("n"), rules.signal_cap),
        "multi_signal_support": clamp(F.size("types") / rules.type_cap), "temporal_precedence": clamp(lead / F.greatest(_minutes("start_ts", "end_ts"), F.lit(1e-8))), "confidence": clamp(F.col("_k")),
    })
    total = sum(FEATURE_WEIGHTS.values())
    weighed = F.lit(0.0)
    for name, weight in FEATURE_WEIGHTS.items():
        weighed = weighed + weight * F.col(name)
    roles = F.aggregate("types", F.lit(0.0), lambda s, t: s + _lookup(t, ROLE_WEIGHTS, 0.5)) / F.size("types")
    g = g.withColumn("score", clamp(weighed / total * clamp(roles + 0.15, 0.35, 1.0) * _lookup(F.col("kind"), KIND_WEIGHTS, 1.0)))
    order = Window.partitionBy("incident_id").orderBy(F.desc(F.round("score", 9)), F.desc("n"), F.desc("persistence_minutes"), F.desc("candidate"), F.desc("kind"))
    g = g.withColumn("position", F.row_number().over(order)).where(F.col("position") <= rules.top)
    ident = F.concat(F.lit("rca_"), stable_id(F.col("incident_id"), F.col("kind"), F.col("candidate"), F.array_join("signal_ids", "|")))
    text = F.format_string("%s candidate '%s' is ranked from %d supporting signals (%s) persisting for %.1f minutes.", F.col("kind"), F.col("candidate"), F.col("n"), F.array_join("types", ", "), F.col("persistence_minutes"))
    return g.withColumns({"candidate_id": ident, "inference": text}).drop("_metrics", "_metric", "_m", "_most", "_valued", "_own", "_k")


def top_metrics(windows: DataFrame, evidence: DataFrame, rules: Rules, most: int = 5) -> DataFrame:
    """Per window the metrics with the strongest evidence: (highest, evidence, name) descending."""
    rows = in_spans(with_buckets(evidence, rules), windows.select("entity", "incident_id", "start_ts", "end_ts"), "bucket", "start_ts", "end_ts", 86400, ("entity",), closed=True)
    g = rows.groupBy("incident_id", "metric_name").agg(F.max("normalized").alias("max_normalized"), F.avg("normalized").alias("mean_normalized"), F.count("*").alias("n"))
    order = Window.partitionBy("incident_id").orderBy(F.desc("max_normalized"), F.desc("n"), F.desc("metric_name"))
    return g.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def timelines(windows: DataFrame, risks: DataFrame, evidence: DataFrame, rules: Rules) -> DataFrame:
    """A row for each bucket of a window that has evidence or a risk: (incident_id, bucket, risk, severity, n, types, metrics)."""
    spans = windows.select("entity", "incident_id", "start_ts", "end_ts")
    e = in_spans(with_buckets(evidence, rules), spans, "bucket", "start_ts", "end_ts", 86400, ("entity",), closed=True)
    e = e.groupBy("incident_id", "bucket").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("signal_type")), "|").alias("types"), F.array_join(F.sort_array(F.collect_set("metric_name")), "|").alias("metrics"))
    r = in_spans(risks, spans, "bucket", "start_ts", "end_ts", 86400, ("entity",), closed=True).select("incident_id", "bucket", "risk", "severity")
    out = r.join(e, ["incident_id", "bucket"], "full")
    return out.select("incident_id", "bucket", F.coalesce("risk", F.lit(0.0)).alias("risk"), F.coalesce("severity", F.lit("INFO")).alias("severity"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("types", F.lit("")).alias("types"), F.coalesce("metrics", F.lit("")).alias("metrics"))


def uncertainty(ranked: DataFrame) -> DataFrame:
    """Per incident: candidates, how close the first two are, research-only candidates, and the score of its doubt."""
    first = lambda k: F.max(F.when(F.col("position") == k, F.col("score")))
    out = ranked.groupBy("incident_id").agg(F.count("*").alias("candidates"), (first(1) - first(2)).alias("gap"), F.sum("research").alias("research"))
    close = F.coalesce(F.greatest(F.lit(0.0), 0.05 - F.col("gap")), F.lit(0.0))
    note = F.concat_ws(" ", F.lit("No causal ground truth is available."), F.when(F.col("research") > 0, "Some evidence is research-only and low weighted."), F.when(F.col("gap") < 0.05, "Top candidates have close scores."))
    return out.withColumns({"doubt": F.col("research") + close, "note": note})


def reports(windows: DataFrame, ranked: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row for each incident, with its candidates and metrics as arrays and a summary made of them."""
    c = ranked.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("position", "kind", "candidate", F.round("score", 6).alias("score"), "candidate_id"))).alias("candidates"))
    m = metrics.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("position", "metric_name", "n"))).alias("metrics"))
    out = windows.join(c, "incident_id", "left").join(m, "incident_id", "left")
    names = F.array_join(F.slice(F.transform("metrics", lambda x: x["metric_name"]), 1, 3), ", ")
    best = F.coalesce(F.get(F.col("candidates"), F.lit(0))["candidate"], F.lit("none"))
    summary = F.concat(F.col("severity"), F.lit(" evidence window for "), F.col("entity"), F.lit(". Top metric signals: "), F.coalesce(names, F.lit("no metric evidence")), F.lit(". Top candidate: "), best, F.lit("."))
    return out.withColumn("summary", summary)


def lineage(ranked: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row for each signal that supports a candidate, with what the signal says; a missing signal has nulls."""
    ids = ranked.select("candidate_id", F.explode("signal_ids").alias("signal_id"))
    return ids.join(evidence.select("signal_id", "ts", "signal_type", "metric_name", "normalized"), "signal_id", "left")


def evaluation(first: DataFrame, merged: DataFrame, ranked: DataFrame, risks: DataFrame, evidence: DataFrame, rules: Rules) -> DataFrame:
    """One row on how sound the results are: repeated windows, coverage of evidence and risk, provenance, order of times, ranks."""
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    spans = merged.select("entity", "incident_id", "start_ts", "end_ts")
    inside = in_spans(with_buckets(evidence, rules), spans, "bucket", "start_ts", "end_ts", 86400, ("entity",), closed=True).select("signal_id").distinct()
    high = risks.where((F.col("risk") >= rules.risk_least) & (F.col("evidence") >= rules.bucket_evidence)).select("entity", "bucket")
    covered = in_spans(high, spans, "bucket", "start_ts", "end_ts", 86400, ("entity",), closed=True).select("entity", "bucket").distinct()
    one = lambda df, name: df.agg(F.count("*").alias(name))
    sound = (F.size("signal_ids") > 0) & (F.size("data_sources") > 0) & (F.size("source_models") > 0)
    timely = (F.col("start_ts") <= F.col("first_ts")) & (F.col("first_ts") <= F.col("last_ts")) & (F.col("last_ts") <= F.expr(f"end_ts + interval {rules.bucket_seconds} seconds"))
    c = ranked.agg(F.count("*").alias("_c"), F.coalesce(F.avg(sound.cast("double")), F.lit(0.0)).alias("provenance"), F.coalesce(F.avg(timely.cast("double")), F.lit(0.0)).alias("temporal_consistency"))
    ranks = ranked.groupBy("incident_id").agg((F.max("position") == F.count("*")).cast("double").alias("ok")).agg(F.coalesce(F.avg("ok"), F.lit(0.0)).alias("rank_consistency"))
    out = one(first, "preliminary")
    for df in (one(merged, "merged"), one(evidence.select("signal_id").distinct(), "_all"), one(inside, "_in"), one(high, "_high"), one(covered, "_covered"), merged.agg(F.coalesce(F.avg("evidence"), F.lit(0.0)).alias("mean_evidence")), c, ranks):
        out = out.crossJoin(F.broadcast(df))  # one row each
    return out.select("preliminary", "merged", F.when(F.col("preliminary") == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.col("merged") / F.col("preliminary"))).alias("duplicate_rate"), ratio(F.col("_in"), F.col("_all")).alias("evidence_coverage"), ratio(F.col("_covered"), F.col("_high")).alias("high_risk_coverage"), "mean_evidence", ratio(F.col("_c"), F.col("merged")).alias("mean_candidates"), "provenance", "temporal_consistency", "rank_consistency")


def case_studies(risks: DataFrame, windows: DataFrame, ranked: DataFrame, before: str, hours: int = 6) -> DataFrame:
    """(case_name, entity, at, value): the calmest bucket, the shortest and the longest incident, the riskiest one up to `hours`
    before a failure at `before`, and the most doubtful one."""
    pick = lambda df, name, at, value, *order: df.orderBy(*order).limit(1).select(F.lit(name).alias("case_name"), "entity", F.col(at).alias("at"), F.col(value).cast("double").alias("value"))
    long = windows.withColumn("_d", micros(F.col("end_ts")) - micros(F.col("start_ts")))
    point = F.lit(before).cast("timestamp_ntz")
    near = windows.where((F.col("start_ts") <= point) & (F.col("end_ts") >= point - F.expr(f"interval {hours} hours")))
    doubtful = windows.join(uncertainty(ranked).select("incident_id", "doubt", "candidates"), "incident_id")
    out = pick(risks, "normal_period", "bucket", "risk", F.round("risk", 9), "evidence", "bucket", "entity")
    out = out.unionByName(pick(long, "isolated_anomaly", "start_ts", "risk_score", "_d", F.round("risk_score", 9), "start_ts", "entity"))
    out = out.unionByName(pick(long, "persistent_anomaly", "start_ts", "risk_score", F.desc("_d"), F.desc(F.round("risk_score", 9)), "start_ts", "entity"))
    out = out.unionByName(pick(near, "pre_failure_period", "start_ts", "risk_score", F.desc(F.round("risk_score", 9)), F.desc("buckets"), "start_ts", "entity"))
    return out.unionByName(pick(doubtful, "difficult_noisy_case", "start_ts", "risk_score", F.desc(F.round("doubt", 9)), F.desc("candidates"), F.desc(F.round("risk_score", 9)), "start_ts", "entity"))
