"""Log operators: frequencies, transitions, rare events, robust spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.scalars import ANOMALOUS_LEVELS, bucket, clamp, micros


def normalize(df: DataFrame, dataset: str, ts: str, seq: str, event: str, component: str, level: str) -> DataFrame:
    """(dataset, ts, seq, event, component, level); rows without a time go, levels are upper case."""
    return df.select(F.lit(dataset).alias("dataset"), F.col(ts).alias("ts"), F.col(seq).alias("seq"), F.col(event).alias("event"), F.col(component).alias("component"), F.upper(level).alias("level")).where("ts is not null")


def bucket_summary(logs: DataFrame, seconds: int) -> DataFrame:
    bad = F.col("level").isin(*ANOMALOUS_LEVELS)
    out = logs.groupBy("dataset", bucket(F.col("ts"), seconds).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_anomalous"), F.countDistinct("event").alias("n_events"), F.countDistinct("component").alias("n_components"))
    return out.withColumn("anomalous_rate", F.col("n_anomalous") / F.col("n")).withColumn("diversity", F.col("n_events") / F.col("n"))


def frequency(logs: DataFrame, seconds: int, key: str) -> DataFrame:
    """Counts per bucket and event, level or component."""
    return logs.groupBy("dataset", bucket(F.col("ts"), seconds).alias("bucket"), key).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def with_previous(logs: DataFrame, seconds: int = 86400) -> DataFrame:
    """Log rows with `previous`, the event before in the dataset; the first row of a dataset goes.

    It is sought inside slices of time, so that no task sorts a whole dataset; the first row of a slice takes the last
    event of the slice before.
    """
    rows = logs.withColumn("_slice", bucket(F.col("ts"), seconds))
    ends = rows.groupBy("dataset", "_slice").agg(F.max(F.struct("ts", "seq", "event")).alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy("dataset").orderBy("_slice"))["event"]).drop("_end")
    inner = F.lag("event").over(Window.partitionBy("dataset", "_slice").orderBy("ts", "seq"))
    out = rows.withColumn("_inner", inner).join(ends, ["dataset", "_slice"]).withColumn("previous", F.coalesce("_inner", "_before"))
    return out.where("previous is not null").drop("_slice", "_inner", "_before")


def transitions(logs: DataFrame) -> DataFrame:
    """Pairs of neighbouring events per dataset with their count, times and share."""
    pairs = with_previous(logs)
    out = pairs.groupBy("dataset", "previous", "event").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy("dataset")))


def rare(logs: DataFrame, key: str, most: int = 3, share: float = 0.01, shown: int = 3) -> DataFrame:
    """The first occurrences of events that come at most `most` times or with at most this share."""
    stats = logs.groupBy("dataset", key).agg(F.count("*").alias("n"))
    stats = stats.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy("dataset")))
    stats = stats.where((F.col("n") <= most) | (F.col("frequency") <= share))
    rows = logs.join(stats, ["dataset", key])
    rows = rows.withColumn("occurrence", F.row_number().over(Window.partitionBy("dataset", key).orderBy("ts", "seq"))).where(F.col("occurrence") <= shown)
    return rows.withColumn("normalized", F.greatest(1 - F.least(F.col("frequency") / share, F.lit(1.0)), 1 / F.col("n")))


def spikes(logs: DataFrame, seconds: int, key: str, least: int = 5, z_least: float = 4.0, z_cap: float = 8.0) -> DataFrame:
    """Buckets in which a key's count stands out from its median and MAD over the zero-filled grid of buckets.

    The grid runs from the first bucket to the end of the last one, inclusive, for the whole dataset. It isn't
    built: the percentile gets one row for all the empty buckets, with their number as its frequency.
    """
    us = seconds * 1_000_000
    t = micros(F.col("ts"))
    grid = logs.groupBy("dataset").agg((F.ceil(F.max(t) / us) - F.floor(F.min(t) / us) + 1).cast("long").alias("grid"))
    counts = logs.groupBy("dataset", key, bucket(F.col("ts"), seconds).alias("bucket")).agg(F.count("*").alias("n"))
    seen = counts.groupBy("dataset", key).agg(F.count("*").alias("seen")).join(grid, "dataset")
    zero = seen.select("dataset", key, F.lit(0).cast("long").alias("n"), (F.col("grid") - F.col("seen")).alias("times"))
    filled = counts.select("dataset", key, "n", F.lit(1).cast("long").alias("times")).unionByName(zero).where("times > 0")
    median = filled.groupBy("dataset", key).agg(F.expr("percentile(n, 0.5, times)").alias("median"))
    mad = filled.join(median, ["dataset", key]).groupBy("dataset", key, "median").agg(F.expr("percentile(abs(n - median), 0.5, times)").alias("mad"))
    out = counts.join(mad, ["dataset", key]).withColumn("scale", F.greatest(F.lit(1.0), 1.4826 * F.col("mad"), F.sqrt(F.greatest(F.col("median"), F.lit(1.0)))))
    out = out.withColumn("z", (F.col("n") - F.col("median")) / F.col("scale")).where((F.col("n") >= least) & (F.col("z") >= z_least))
    return out.withColumn("normalized", clamp(F.col("z") / z_cap))


def level_anomalies(logs: DataFrame, seconds: int, least: int = 5, z_least: float = 3.0, rate_least: float = 0.75, z_cap: float = 6.0) -> DataFrame:
    """Buckets whose share of anomalous levels stands out; buckets without rows play no part."""
    s = bucket_summary(logs, seconds).select("dataset", "bucket", "n", "n_anomalous", "anomalous_rate")
    median = s.groupBy("dataset").agg(F.expr("percentile(anomalous_rate, 0.5)").alias("median"))
    mad = s.join(median, "dataset").groupBy("dataset", "median").agg(F.expr("percentile(abs(anomalous_rate - median), 0.5)").alias("mad"))
    out = s.join(mad, "dataset").withColumn("z", (F.col("anomalous_rate") - F.col("median")) / F.greatest(F.lit(0.01), 1.4826 * F.col("mad")))
    out = out.where((F.col("n_anomalous") >= least) & ((F.col("z") >= z_least) | (F.col("anomalous_rate") >= rate_least)))
    return out.withColumn("normalized", clamp(F.greatest(F.col("z") / z_cap, F.col("anomalous_rate") / rate_least)))
