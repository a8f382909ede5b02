"""Evidence signals, risk, incident windows and candidate ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.frames import Frames, framed
from telemetra.functions.ranks import percentiles, with_key
from telemetra.functions.scalars import LADDERS, bucket, clamp, log_score, micros, normalized, severity
from telemetra.functions.tables import settled

# Weights of signal types, of reliability tiers, of candidate features.
TYPE_WEIGHTS = {"CURRENT_ANOMALY": 1.0, "FORECAST_DEVIATION": 0.9, "TREND": 0.65, "FAILURE_PROBABILITY": 0.3, "STATE_TRANSITION": 0.35, "HISTORICAL_CONTEXT": 0.45, "LOG_RARE_EVENT": 0.25, "LOG_FREQUENCY": 0.45, "LOG_LEVEL": 0.4, "LOG_SEQUENCE": 0.35, "LOG_COMPONENT": 0.4}
RELIABILITY_WEIGHTS = {"HIGH": 1.0, "MEDIUM": 0.75, "LOW": 0.45, "RESEARCH_ONLY": 0.15}


def weight_of(column: str, weights: dict[str, float]):
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col(column)), F.lit(0.0))


def normal_ranges(df: DataFrame, key: str, value: str, fit: Column) -> DataFrame:
    """Mean, population deviation and the 1st and 99th percentiles of the rows that `fit` holds for."""
    rows = df.where(fit)
    out = rows.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return with_key(out, percentiles(rows, [key], value, {"q01": 0.01, "q99": 0.99}), [key])


def current_anomalies(df: DataFrame, ranges: DataFrame, key: str, value: str, z_least: float = 2.5) -> DataFrame:
    """Rows far from the normal range; keys without a range are left out. ranges has a row for each key."""
    z = F.abs((F.col(value) - F.col("mean")) / F.greatest("sd", F.lit(1e-8)))
    out = df.join(settled(ranges), key).withColumn("z", z).where((F.col("z") >= z_least) | (F.col(value) < F.col("q01")) | (F.col(value) > F.col("q99")))
    return out.withColumn("normalized", normalized(F.col("z"), 5.0)).withColumn("severity", severity(F.col("z"), LADDERS["anomaly"]))


def trend_signals(df: DataFrame, ranges: DataFrame, key: str, ts: str, value: str, seconds: int = 1800, z_least: float = 0.8) -> DataFrame:
    """Change over [t - w, t] against the normal deviation, with three points at least."""

    def figures(f: Frames) -> dict[str, pa.Array]:
        low, high = f.bounds(seconds * 1_000_000)
        n, first = f.count(low, high), f.first_known()[low]
        change = f.values - f.values[np.minimum(first, len(f.us) - 1)]
        return {"change": pa.array(change, pa.float64(), mask=~f.known | (n == 0), from_pandas=False), "points": pa.array(n, pa.int64())}

    out = framed(df, [key], ts, value, seconds, figures, "change double, points long").where("points >= 3")
    out = out.join(settled(ranges), key).withColumn("z", F.abs(F.col("change")) / F.greatest("sd", F.lit(1e-8))).where(F.col("z") >= z_least)
    return out.withColumn("normalized", normalized(F.col("z"), 3.0)).withColumn("severity", severity(F.col("z"), LADDERS["trend"]))


def historical_context(signals: DataFrame, keys: list[str], ts: str, seconds: int = 3600, bucket_seconds: int = 300, least: int = 3) -> DataFrame:
    """Distinct earlier times of the same key in [t - w, t); the first that reaches `least` in each bucket."""
    times = signals.select(*keys, ts).distinct().withColumn("_us", micros(F.col(ts)))
    w = Window.partitionBy(*keys).orderBy("_us").rangeBetween(-seconds * 1_000_000, -1)
    out = times.withColumn("prior", F.count("*").over(w)).where(F.col("prior") >= least).withColumn("bucket", bucket(F.col(ts), bucket_seconds))
    first = Window.partitionBy(*keys, "bucket").orderBy("_us")
    return out.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_us")


def risk(signals: DataFrame, seconds: int = 300) -> DataFrame:
    """Noisy-or of weighted signals (entity, ts, signal_type, normalized, reliability, confidence) per bucket."""
    part = clamp(F.col("normalized") * weight_of("signal_type", TYPE_WEIGHTS) * weight_of("reliability", RELIABILITY_WEIGHTS), 0.0, 0.95)
    rows = signals.withColumn("contribution", part).withColumn("bucket", bucket(F.col("ts"), seconds))
    out = rows.groupBy("entity", "bucket").agg((1 - F.product(1 - F.col("contribution"))).alias("risk"), F.count("*").alias("evidence"), clamp(F.avg("confidence") * log_score(F.count("*"), 5)).alias("confidence"))
    return out.withColumn("severity", severity(F.col("risk"), LADDERS["risk"]))


def dominant_types(signals: DataFrame, seconds: int = 300, top: int = 3) -> DataFrame:
    """The signal types that add most to each bucket, ties by name."""
    part = clamp(F.col("normalized") * weight_of("signal_type", TYPE_WEIGHTS) * weight_of("reliability", RELIABILITY_WEIGHTS), 0.0, 0.95)
    sums = signals.withColumn("c", part).groupBy("entity", bucket(F.col("ts"), seconds).alias("bucket"), "signal_type").agg(F.sum("c").alias("c"))
    ranked = sums.withColumn("position", F.row_number().over(Window.partitionBy("entity", "bucket").orderBy(F.desc(F.round("c", 9)), "signal_type"))).where(F.col("position") <= top)
    return ranked.groupBy("entity", "bucket").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "signal_type"))), lambda x: x["signal_type"]), "|").alias("dominant_types"))


def case_evidence(buckets: DataFrame, evidence: DataFrame, most: int = 8) -> DataFrame:
    """The strongest evidence of each (entity, bucket): by normalized value, then confidence."""
    order = Window.partitionBy("entity", "bucket").orderBy(F.desc("normalized"), F.desc("confidence"), "signal_id")
    return evidence.join(buckets, ["entity", "bucket"]).withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
