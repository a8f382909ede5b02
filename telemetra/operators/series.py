"""Resampling, baselines of forecasts, scaling, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.bins import with_previous
from telemetra.functions.ranks import row_framed
from telemetra.functions.scalars import bucket, micros
from telemetra.functions.tables import settled


def resample_median(df: DataFrame, key: str, ts: str, value: str, seconds: int) -> DataFrame:
    """The median of each step of the whole grid between a key's first and last step; empty steps are null."""
    seen = df.groupBy(key, bucket(F.col(ts), seconds).alias("bucket")).agg(F.expr(f"percentile({value}, 0.5)").alias("median"))
    span = seen.groupBy(key).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    grid = span.select(key, F.explode(F.sequence("a", "b", F.expr(f"interval {seconds} seconds"))).alias("bucket"))
    return grid.join(seen, [key, "bucket"], "left")


def interpolate(grid: DataFrame, key: str, limit: int = 2) -> DataFrame:
    """Linear in time between known steps, the first `limit` nulls of each gap; none at the edges."""
    w = Window.partitionBy(key).orderBy("bucket")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.col("median").isNotNull()
    out = grid.withColumns({"_v0": F.last("median", True).over(back), "_v1": F.first("median", True).over(ahead), "_t0": F.last(F.when(known, F.col("bucket")), True).over(back), "_t1": F.first(F.when(known, F.col("bucket")), True).over(ahead), "_n": F.row_number().over(w)})
    out = out.withColumn("_k", F.col("_n") - F.last(F.when(known, F.col("_n")), True).over(back))
    t = lambda c: micros(F.col(c))
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (t("bucket") - t("_t0")) / (t("_t1") - t("_t0"))
    return out.withColumn("value", F.when(known, F.col("median")).when((F.col("_k") <= limit) & F.col("_v1").isNotNull(), line)).select(key, "bucket", "value")


def forecasts(df: DataFrame, key: str, order: str, value: str, horizon: int = 5, average: int = 15, trend: int = 30) -> DataFrame:
    """Persistence, moving average and extrapolated line, with the truth `horizon` rows ahead."""
    rows = row_framed(df, [key], order, max(average, trend), horizon).withColumn("_n", F.col("_index").cast("double"))
    w = Window.partitionBy(key, "_block").orderBy("_index")
    out = rows.withColumn("y_true", F.lead(value, horizon).over(w)).withColumn("persistence", F.col(value))
    out = out.withColumn("moving_average", F.avg(value).over(w.rowsBetween(1 - average, 0)))
    f = w.rowsBetween(1 - trend, 0)
    line = F.regr_intercept(F.col(value), F.col("_n")).over(f) + F.regr_slope(F.col(value), F.col("_n")).over(f) * (F.col("_n") + horizon)
    return out.withColumn("linear_trend", F.when(F.count(value).over(f) >= 2, line)).where("_own").drop("_n", "_index", "_block", "_own")


def inverse_standardize(df: DataFrame, key: str, value: str, scaled: str, fit) -> DataFrame:
    """`restored`: scaled values back in the units of `value`, whose rows that `fit` holds for gave the scale."""
    s = df.where(fit).groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(settled(s), key).withColumn("restored", F.col(scaled) * F.when(F.col("_s") <= 1e-8, 1.0).otherwise(F.col("_s")) + F.col("_m")).drop("_m", "_s")


def identity_scale(df: DataFrame, value: str) -> DataFrame:
    """`scaled` is the value itself."""
    return df.withColumn("scaled", F.col(value).cast("double"))


def standardize(df: DataFrame, key: str, value: str, fit) -> DataFrame:
    """(x - mean) / deviation of the rows that `fit` holds for; a vanishing deviation counts as 1."""
    s = df.where(fit).groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(settled(s), key).withColumn("scaled", (F.col(value) - F.col("_m")) / F.when(F.col("_s") <= 1e-8, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")


def temporal_profile(df: DataFrame, key: str, ts: str) -> DataFrame:
    """First and last time, median step, steps longer than 1.5 medians, repeated times."""
    base = df.withColumn("_us", micros(F.col(ts)))
    d = with_previous(base.select(key, ts, "_us"), [key], ["_us"], {"_p": "_us"}).withColumn("_d", (F.col("_us") - F.col("_p")) / 1e6)
    median = d.groupBy(key, "_d").count().groupBy(key).agg(F.expr("percentile(_d, 0.5, count)").alias("median_step"))
    m = d.groupBy(key).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count_if(F.col("_d") == 0).alias("repeated")).join(median, key)
    gaps = d.join(m.select(key, "median_step"), key).groupBy(key).agg(F.count_if(F.col("_d") > 1.5 * F.col("median_step")).alias("gaps"))
    return m.join(gaps, key)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, nulls, distinct values, least and greatest as text, constant or not. One pass, then a turn."""
    parts = [F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.countDistinct(c).alias("n_distinct")).alias(c) for c in columns]
    one = df.agg(*parts)
    return one.select(F.explode(F.array(*columns)).alias("x")).select("x.*").withColumn("constant", F.col("n_distinct") <= 1)
