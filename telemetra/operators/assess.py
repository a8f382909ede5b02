"""Assessment of signals, failures and detectors: stages, lead times, shift, agreement, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.scalars import EPS, LADDERS, bucket, micros, normalized, safe_divide, severity
from telemetra.functions.spans import in_spans

# Stages around a failure as (name, anchor and offset of the start, anchor and offset of the end); active is closed.
STAGES = (
    ("far", "start_ts - interval 6 hours", "start_ts - interval 1 hour"),
    ("near", "start_ts - interval 1 hour", "start_ts - interval 10 minutes"),
    ("imminent", "start_ts - interval 10 minutes", "start_ts"),
    ("active", "start_ts", "end_ts + interval 1 microsecond"),
    ("after", "end_ts", "end_ts + interval 1 hour"),
)


def prefailure_stages(df: DataFrame, failures: DataFrame, ts: str, value: str) -> DataFrame:
    """Rows, mean and deviation of each stage around each failure, and its distance from the far stage in deviations of it."""
    spans = failures.withColumn("s", F.explode(F.array(*(F.struct(F.lit(n).alias("stage"), F.expr(a).alias("begin"), F.expr(b).alias("end")) for n, a, b in STAGES))))
    rows = in_spans(df.select(ts, value), spans.select("failure_id", "s.*"), ts, "begin", "end")
    out = rows.groupBy("failure_id", "stage").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    far = lambda c: F.max(F.when(F.col("stage") == "far", F.col(c))).over(Window.partitionBy("failure_id"))
    return out.withColumn("effect", (F.col("mean") - far("mean")) / F.greatest(far("sd"), F.lit(EPS)))


def early_warning(df: DataFrame, failures: DataFrame, ts: str, probability: str, threshold: float, horizon: str) -> DataFrame:
    """Per failure the first warning in [start - horizon, start), its lead in hours and the highest probability there."""
    spans = failures.withColumn("_begin", F.expr(f"start_ts - interval {horizon}")).select("failure_id", "_begin", "start_ts")
    seen = in_spans(df.select(ts, probability), spans, ts, "_begin", "start_ts").groupBy("failure_id").agg(F.min(F.when(F.col(probability) >= threshold, F.col(ts))).alias("first_warning"), F.max(probability).alias("max_probability"))
    out = failures.join(seen, "failure_id", "left")
    lead = (micros(F.col("start_ts")) - micros(F.col("first_warning"))) / 3.6e9
    return out.select("failure_id", "first_warning", lead.alias("lead_hours"), "max_probability", F.col("first_warning").isNotNull().cast("int").alias("covered"))


def distribution_shift(df: DataFrame, features: list[str], train: Column) -> DataFrame:
    """Per feature the standardised difference of means between the other rows and the training rows, with its flags."""
    rows = df.select(train.alias("_t"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("s")).select("_t", "s.*")
    fit, test = F.when(F.col("_t"), F.col("x")), F.when(~F.col("_t"), F.col("x"))
    out = rows.groupBy("feature").agg(F.avg(fit).alias("train_mean"), F.stddev_pop(fit).alias("train_sd"), F.avg(test).alias("test_mean"), F.percentile(fit, F.lit(0.01)).alias("q01"), F.percentile(fit, F.lit(0.99)).alias("q99"))
    return out.withColumn("shift", (F.col("test_mean") - F.col("train_mean")) / F.greatest("train_sd", F.lit(EPS))).withColumn("outside", ((F.col("test_mean") < F.col("q01")) | (F.col("test_mean") > F.col("q99"))).cast("int"))


def forecast_deviations(df: DataFrame, ranges: DataFrame, key: str, actual: str, predicted: str, least: float = 1.0) -> DataFrame:
    """Forecasts whose residual is large against the key's normal deviation. ranges has a row for each key."""
    z = F.abs(F.col(actual) - F.col(predicted)) / F.greatest("sd", F.lit(EPS))
    out = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).join(ranges, key).withColumn("z", z).where(F.col("z") >= least)
    return out.withColumn("normalized", normalized(F.col("z"), 4.0)).withColumn("severity", severity(F.col("z"), LADDERS["residual"]))


def risk_flags(df: DataFrame, ranges: DataFrame, key: str, actual: str, predicted: str) -> DataFrame:
    """Whether actual and predicted values lie outside of the key's normal range, as 0 or 1."""
    out = lambda c: ((F.col(c) < F.col("q01")) | (F.col(c) > F.col("q99"))).cast("int")
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).join(ranges, key)
    return rows.withColumn("actual_outside", out(actual)).withColumn("predicted_outside", out(predicted))


def complementarity(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """How two detectors' 0/1 decisions agree per key."""
    x, y = F.col(a) == 1, F.col(b) == 1
    out = df.groupBy(*keys).agg(F.count_if(x & y).alias("agreed"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))
    return out.withColumn("jaccard", safe_divide(F.col("agreed"), F.col("agreed") + F.col("only_a") + F.col("only_b")))


def limited(signals: DataFrame, keys: list[str], best: list[Column], most: int) -> DataFrame:
    """The best `most` signals of each group; the order has to be total for a result without ties."""
    return signals.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("position") <= most)


def summary_by(signals: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Number, mean and highest score, and the commonest kind (ties: the smallest) of the signals of each key."""
    return signals.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("normalized").alias("mean_score"), F.max("normalized").alias("max_score"), F.mode(kind, True).alias("dominant_type"))


def per_thousand(signals: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """Signals of each kind and their rate per thousand rows; the number of rows is one row, joined as such."""
    total = rows.agg(F.count("*").alias("rows"))
    return signals.groupBy(kind).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).withColumn("rate", 1000 * safe_divide(F.col("n"), F.col("rows")))


def event_statistics(logs: DataFrame) -> DataFrame:
    """Per dataset and event: number, commonest component (ties: the smallest), share."""
    out = logs.groupBy("dataset", "event").agg(F.count("*").alias("n"), F.mode("component", True).alias("component"))
    return out.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy("dataset")))


def calmest_bucket(summary: DataFrame, signals: DataFrame, key: str = "dataset", time: str = "bucket") -> DataFrame:
    """Per dataset the bucket without a signal that has the least anomalous rate, then the fewest rows, then is the earliest."""
    free = summary.join(signals.select(key, time).distinct(), [key, time], "left_anti")
    best = free.groupBy(key).agg(F.min(F.struct("anomalous_rate", "n", time)).alias("s"))
    return best.select(key, "s.*")


def log_profile(logs: DataFrame, seconds: int = 86400) -> DataFrame:
    """Per dataset: rows, first and last time, distinct events and components, median step in seconds.

    Steps are taken inside slices of time; the first row of a slice takes its step from the last time of the slice before, so
    that no task sorts a whole dataset. The median is taken over counted steps.
    """
    rows = logs.select("dataset", bucket(F.col("ts"), seconds).alias("_slice"), micros(F.col("ts")).alias("_us"))
    ends = rows.groupBy("dataset", "_slice").agg(F.max("_us").alias("_end")).withColumn("_before", F.lag("_end").over(Window.partitionBy("dataset").orderBy("_slice"))).drop("_end")
    inner = F.lag("_us").over(Window.partitionBy("dataset", "_slice").orderBy("_us"))
    steps = rows.withColumn("_last", inner).join(ends, ["dataset", "_slice"]).withColumn("step", (F.col("_us") - F.coalesce("_last", "_before")) / 1e6).where("step is not null")
    median = steps.groupBy("dataset", "step").count().groupBy("dataset").agg(F.expr("percentile(step, 0.5, count)").alias("median_step"))
    out = logs.groupBy("dataset").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("event").alias("n_events"), F.countDistinct("component").alias("n_components"))
    return out.join(median, "dataset", "left")


def robustness(scores: DataFrame, key: str, score: str) -> DataFrame:
    """Spread of a score over series per model: mean, median, population variance, least, most, share above 0."""
    return scores.groupBy(key).agg(F.avg(score).alias("mean"), F.expr(f"percentile({score}, 0.5)").alias("median"), F.var_pop(score).alias("variance"), F.min(score).alias("least"), F.max(score).alias("most"), F.avg((F.col(score) > 0).cast("double")).alias("nonzero"))
