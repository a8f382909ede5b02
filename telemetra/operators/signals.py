"""Signals of states, failures and logs as one table, with ids, reliability and descriptions; what they are worth against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.ranks import percentiles
from telemetra.functions.scalars import LADDERS, bucket, clamp, micros, normalized, safe_divide, severity, stable_id
from telemetra.operators.evidence import RELIABILITY_WEIGHTS, weight_of
from telemetra.operators.windows import even_sample

# How far the sources can be relied on, and the rule for each tier.
RELIABILITY = {
    "metropt:current_anomaly_rule": "HIGH",
    "metropt:forecast_model": "MEDIUM",
    "metropt:trend_rule": "MEDIUM",
    "metropt:state_transition_rule": "LOW",
    "metropt:metropt_failure_prediction": "RESEARCH_ONLY",
    "metropt:historical_context_rule": "MEDIUM",
}
TIER_RULES = {"HIGH": "validated detector or rule", "MEDIUM": "usable with care", "LOW": "context only", "RESEARCH_ONLY": "capped, never decisive"}


def reliability_table(spark, table: dict[str, str] | None = None) -> DataFrame:
    """(source, reliability, weight, rule) of a configuration."""
    rows = [(k, v, RELIABILITY_WEIGHTS[v], TIER_RULES[v]) for k, v in sorted((table or RELIABILITY).items())]
    return spark.createDataFrame(rows, "source string, reliability string, weight double, rule string")


def reliability(dataset: Column, model: Column, table: dict[str, str] | None = None) -> Column:
    """The tier of `dataset:model`; a failure model's variants have the tier of the failure model; LOW otherwise."""
    names = F.create_map(*(F.lit(x) for kv in (table or RELIABILITY).items() for x in kv))
    of = lambda m: F.element_at(names, F.concat_ws(":", dataset, m))
    failure = F.lit("metropt_failure_prediction")
    return F.coalesce(of(model), F.when(F.startswith(model, failure), of(failure)), F.lit("LOW"))


def confidence(tier: str, strength: str) -> Column:
    return clamp(weight_of(tier, RELIABILITY_WEIGHTS) * (0.5 + 0.5 * F.col(strength)))


def assembled(rows: DataFrame, entity: Column, kind: str, metric: Column, value: Column, strength: Column, grade: Column, model: str, dataset: str, description: Column, validity: str) -> DataFrame:
    """Signal rows with tier, confidence and an id that follows from time, entity, type, metric and value."""
    out = rows.select(F.col("ts"), entity.alias("entity"), F.lit(kind).alias("signal_type"), metric.alias("metric_name"), value.cast("double").alias("value"), strength.cast("double").alias("normalized"), grade.alias("severity"), F.lit(model).alias("source_model"), F.lit(dataset).alias("source_dataset"), description.alias("description"), F.lit(validity).alias("validity"))
    out = out.withColumn("reliability", reliability(F.col("source_dataset"), F.col("source_model")))
    ident = stable_id(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col("entity"), F.col("signal_type"), F.col("metric_name"), F.round("value", 9).cast("decimal(38,9)").cast("string"))
    return out.withColumns({"confidence": confidence("reliability", "normalized"), "signal_id": ident})


def state_transition_signals(df: DataFrame, entity: str, ts: str, states: list[str], seconds: int, dataset: str = "metropt") -> DataFrame:
    """A signal for each state that changes between a bucket and the one before it.

    A bucket's state is its median, at least 0.5 counting as active; empty buckets keep the state before them, so only
    buckets with rows have to be looked at. The first bucket of an entity, and states not yet known, are no change.
    """
    long = df.select(F.col(entity).alias("entity"), bucket(F.col(ts), seconds).alias("ts"), F.explode(F.array(*(F.struct(F.lit(s).alias("state"), F.col(s).cast("double").alias("x")) for s in states))).alias("s")).select("entity", "ts", "s.*")
    b = long.where("x is not null").groupBy("entity", "state", "ts").agg(F.median("x").alias("x"))  # a bucket's rows
    b = b.withColumn("active", (F.col("x") >= 0.5).cast("int"))
    before = F.lag("active").over(Window.partitionBy("entity", "state").orderBy("ts"))
    b = b.withColumn("before", before).where("before is not null and active <> before")
    on = F.col("active") == 1
    text = F.concat(F.col("state"), F.lit(" operating state transitioned to "), F.when(on, "active").otherwise("inactive"), F.lit("."))
    return assembled(b, F.col("entity"), "STATE_TRANSITION", F.col("state"), F.col("active"), F.when(on, 0.65).otherwise(0.45), F.when(on, "MEDIUM").otherwise("LOW"), "state_transition_rule", dataset, text, "LIMITED")


def research_failure_signals(predictions: DataFrame, split: str, candidate: str, model: str, least: float = 0.02, most: int = 1500, dataset: str = "metropt") -> DataFrame:
    """Signals of a failure model's scores (entity, ts, candidate_id, model, split, probability, row_id) in a split.

    The named candidate, then the named model, are preferred where the split has any of them. Scores of `least` and more
    are kept, spread evenly in the order of the score where there are more than `most`.
    """
    rows = predictions.where((F.col("split") == split) & F.col("probability").isNotNull())
    for column, wanted in (("candidate_id", candidate), ("model", model)):
        has = rows.agg(F.max((F.col(column) == wanted).cast("int"))).first()[0]
        rows = rows.where(F.col(column) == wanted) if has else rows
    rows = rows.where(F.col("probability") >= least)
    if rows.count() > most:
        rows = even_sample(rows.withColumn("_o", -F.col("probability")), "_o", most, ties=("row_id",)).drop("_o")
    text = F.format_string("%s candidate %s emitted a research score of %.4f.", F.col("model"), F.col("candidate_id"), F.col("probability"))
    return assembled(rows, F.col("entity"), "FAILURE_SIGNAL", F.lit("failure_prediction_probability"), F.col("probability"), normalized(F.col("probability"), LADDERS["failure"][3]), severity(F.col("probability"), LADDERS["failure"]), "metropt_failure_prediction", dataset, text, "RESEARCH_ONLY")


def bucket_frequency(logs: DataFrame, overrides: dict[str, int] | None = None) -> DataFrame:
    """(dataset, span_seconds, bucket_seconds): the bucket that fits a dataset's span of time."""
    span = ((F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / 1e6).alias("span_seconds")
    out = logs.where("ts is not null").groupBy("dataset").agg(span)
    day = 86400
    # Longest spans of the bucket sizes.
    fit = F.when(F.col("span_seconds") <= 120, 1).when(F.col("span_seconds") <= 3600, 10).when(F.col("span_seconds") <= 7 * day, 3600).when(F.col("span_seconds") <= 45 * day, day).otherwise(7 * day)
    for name, seconds in (overrides or {}).items():
        fit = F.when(F.col("dataset") == name, seconds).otherwise(fit)
    return out.withColumn("bucket_seconds", fit)


def log_labels(labels: DataFrame, dataset: str, event_id: str, value: str) -> DataFrame:
    """(dataset, event_id, label_kind): "-" is normal, anything else an anomaly."""
    return labels.select(F.lit(dataset).alias("dataset"), F.col(event_id).cast("string").alias("event_id"), F.when(F.col(value) == "-", "normal").otherwise("anomaly").alias("label_kind"))


def against_labels(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the events (dataset, event_id) that signals name against row labels, as counts, precision, recall, F1, false alarms.

    Signals of datasets without labels don't count; an event named twice counts once.
    """
    own = flagged.join(labels.select("dataset").distinct(), "dataset", "left_semi").select("event_id").distinct().withColumn("p", F.lit(1))
    both = labels.groupBy("event_id").agg(F.max((F.col("label_kind") == "anomaly").cast("int")).alias("y")).join(own, "event_id", "full")
    y, p = F.coalesce("y", F.lit(-1)), F.col("p").isNotNull()
    out = both.agg(F.count_if(p).alias("predicted"), F.count_if(y == 1).alias("anomalies"), F.count_if(p & (y == 1)).alias("tp"), F.count_if(p & (y == 0)).alias("fp"), F.count_if(~p & (y == 1)).alias("fn"), F.count_if(~p & (y == 0)).alias("tn"))
    out = out.withColumn("precision", safe_divide(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe_divide(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", safe_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("false_alarm_rate", safe_divide(F.col("fp"), F.col("fp") + F.col("tn")))


def raw_preview(cases: DataFrame, logs: DataFrame, seconds: int, most: int = 8) -> DataFrame:
    """The first log rows of each case's (dataset, bucket)."""
    rows = logs.withColumn("bucket", bucket(F.col("ts"), seconds)).join(cases.select("dataset", "bucket").distinct(), ["dataset", "bucket"])
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("dataset", "bucket").orderBy("ts", "seq"))).where(F.col("position") <= most)


def log_cases(signals: DataFrame) -> DataFrame:
    """The strongest signal of each type, ties by time: (signal_type, ts, entity, normalized)."""
    best = signals.groupBy("signal_type").agg(F.max_by(F.struct("ts", "entity", "normalized"), F.struct(F.round("normalized", 9), -micros(F.col("ts")), F.col("entity"))).alias("x"))
    return best.select("signal_type", "x.*")


def modalities(telemetry: DataFrame, logs: DataFrame) -> DataFrame:
    """One row: how much evidence of how many types either side has, and the types that only logs add."""
    one = lambda df, n: df.agg(F.count("*").alias(f"{n}_evidence"), F.sort_array(F.collect_set("signal_type")).alias(f"{n}_types"))
    out = one(telemetry, "telemetry").crossJoin(F.broadcast(one(logs, "log")))  # a row each
    return out.withColumn("added_types", F.array_except("log_types", "telemetry_types")).withColumn("complementary", F.size("added_types") > 0)


def top_events(logs: DataFrame, most: int = 10) -> DataFrame:
    g = logs.groupBy("dataset", "event").agg(F.count("*").alias("n"))
    return g.withColumn("position", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("n"), "event"))).where(F.col("position") <= most)


def residual_leakage(forecasts: DataFrame, signals: DataFrame) -> DataFrame:
    """One row: forecasts whose target is before the end of their input, and residual signals stamped before it. Neither may be."""
    bad = forecasts.agg(F.count("*").alias("rows_checked"), F.count_if(F.col("target_ts") < F.col("input_end_ts")).alias("alignment_errors"))
    first = forecasts.groupBy("target_ts").agg(F.min("input_end_ts").alias("input_end_ts"))
    early = signals.join(first, signals.ts == first.target_ts, "left").agg(F.count("*").alias("signals_checked"), F.count_if(F.col("ts") < F.col("input_end_ts")).alias("signals_before_input_end"))
    out = bad.crossJoin(F.broadcast(early))  # a row each
    return out.withColumn("leakage_detected", (F.col("alignment_errors") > 0) | (F.col("signals_before_input_end") > 0))


def spread(signals: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Number, mean, median, population deviation, least and most of a value per key."""
    own = signals.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))
    return own.join(percentiles(signals, keys, value, {"median": 0.5}), keys)
