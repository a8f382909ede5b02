"""Thresholds, scores and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.functions.ranks import percentiles, running, with_key
from telemetra.functions.scalars import safe_divide
from telemetra.functions.spans import in_spans
from telemetra.functions.tables import settled
from telemetra.operators.windows import even_sample, runs


def binary_metrics(df: DataFrame, keys: list[str], y: str, predicted: str) -> DataFrame:
    t, p = F.col(y) == 1, F.col(predicted) == 1
    out = df.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    out = out.withColumn("precision", safe_divide(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe_divide(F.col("tp"), F.col("tp") + F.col("fn")))
    out = out.withColumn("f1", safe_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("fpr", safe_divide(F.col("fp"), F.col("fp") + F.col("tn")))


def _by_score(df: DataFrame, y: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Per distinct score the rows and positives at or above it."""
    g = df.groupBy(*keys or [], F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    return running(g, keys or [], "score", {"above": F.col("n"), "hits": F.col("pos")}, descending=True)


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    """Step-wise: each score's positives times the precision at it, by all positives."""
    return _by_score(df, y, score).agg(F.when(F.sum("pos") > 0, F.sum(F.col("pos") * F.col("hits") / F.col("above")) / F.sum("pos")).alias("average_precision"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Mann-Whitney with average ranks for ties."""
    s = _by_score(df, y, score).withColumn("neg", F.col("n") - F.col("pos")).withColumn("neg_above", F.col("above") - F.col("hits") - F.col("n") + F.col("pos"))
    total = s.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum(F.col("pos") * (F.col("neg_above") + F.col("neg") / 2)).alias("lost"))
    return total.select((1 - F.col("lost") / (F.col("p") * F.col("q"))).alias("roc_auc"))


def threshold_grid(df: DataFrame, y: str, score: str, grid: list[float]) -> DataFrame:
    """Metrics at every threshold of a small grid, in one pass over the rows."""
    rows = df.select(F.col(y).alias("y"), F.col(score).alias("score")).withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))
    return binary_metrics(rows.withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int")), ["threshold"], "y", "predicted")


def best_threshold(df: DataFrame, y: str, score: str, grid: list[float]) -> DataFrame:
    g = threshold_grid(df, y, score, grid)
    return g.orderBy(F.desc(F.round("f1", 9)), F.desc(F.round("recall", 9)), F.round("fpr", 9), "threshold").limit(1)


def mad_threshold(df: DataFrame, keys: list[str], score: str, times: float = 6.0, q: float = 0.99) -> DataFrame:
    """median + times * 1.4826 * MAD; the percentile where that is not above the median."""
    m = settled(percentiles(df, keys, score, {"median": 0.5, "percentile": q}))
    away = with_key(df.select(*keys, score), m, keys).withColumn("_away", F.abs(F.col(score) - F.col("median")))
    d = with_key(m, percentiles(away, keys, "_away", {"mad": 0.5}), keys)
    t = F.col("median") + times * 1.4826 * F.col("mad")
    return d.withColumn("threshold", F.when(t > F.col("median"), t).otherwise(F.col("percentile")))


def ecdf(df: DataFrame, keys: list[str], value: str, reference: Column) -> DataFrame:
    """Share of the reference rows at or below each row's value. Ranks include ties."""
    ref = F.when(reference, 1).otherwise(0)
    total = df.groupBy(*keys).agg(F.sum(ref).alias("_refs"))
    out = with_key(running(df, keys, value, {"_upto": ref}), total, keys)
    return out.withColumn("ecdf", safe_divide(F.col("_upto"), F.col("_refs"))).drop("_upto", "_refs")


def detection_delay(df: DataFrame, entity: str, order: list[str], y: str, predicted: str) -> DataFrame:
    """Per true segment: its start and the steps to the first hit inside it."""
    rows = runs(df, entity, order, F.coalesce(F.col(y) == 1, F.lit(False)))
    first = F.min(F.when(F.col(predicted) == 1, F.col("_i")))
    return rows.groupBy(entity, F.col("_from").alias("start_index")).agg((first - F.col("start_index")).alias("delay_steps"))


def forecast_metrics(df: DataFrame, sensor: str, y: str, predicted: str, least: float = 0.1) -> DataFrame:
    """MAE, RMSE and MAPE per sensor and over all (`__global__`), by one grouping-sets pass."""
    e, big = F.abs(F.col(y) - F.col(predicted)), F.abs(F.col(y)) >= least
    rows = df.where(F.col(y).isNotNull() & F.col(predicted).isNotNull())
    out = rows.rollup(sensor).agg(F.grouping(sensor).alias("_all"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.when(big, e / F.abs(F.col(y))))).alias("mape"), F.avg(big.cast("double")).alias("applicable"))
    return out.withColumn(sensor, F.when(F.col("_all") == 1, "__global__").otherwise(F.col(sensor))).drop("_all")


def false_alarms(df: DataFrame, events: DataFrame, ts: str, warning: str, horizon: str) -> DataFrame:
    """Warnings outside every event's [start - horizon, end]."""
    spans = events.withColumn("_begin", F.expr(f"start_ts - interval {horizon}")).select("_begin", "end_ts")
    times = df.where(F.col(warning) == 1).groupBy(ts).agg(F.count("*").alias("n"))
    covered = in_spans(times, spans, ts, "_begin", "end_ts", closed=True).select(ts).distinct()
    return times.join(covered, ts, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("false_alarms"))


def failure_target(df: DataFrame, events: DataFrame, ts: str, horizon: str) -> DataFrame:
    """target 1 for start - horizon <= t < start, active 1 for start <= t <= end; the later event names it.

    The spans are sought for each distinct time, so repeated rows stay as many as they are.
    """
    spans = events.withColumn("_begin", F.expr(f"start_ts - interval {horizon}")).select("failure_id", "_begin", "start_ts", "end_ts")
    met = in_spans(df.select(ts).distinct(), spans, ts, "_begin", "end_ts", closed=True)
    ahead, inside = F.col(ts) < F.col("start_ts"), F.col(ts) >= F.col("start_ts")
    found = met.groupBy(ts).agg(F.max(ahead.cast("int")).alias("target"), F.max(inside.cast("int")).alias("active"), F.max(F.when(ahead, F.struct("start_ts", "failure_id")))["failure_id"].alias("failure_id"))
    out = df.join(found, ts, "left")
    return out.select(*df.columns, F.coalesce("target", F.lit(0)).alias("target"), F.coalesce("active", F.lit(0)).alias("active"), "failure_id")


def classification_metrics(df: DataFrame, keys: list[str], y: str, score: str, threshold: float) -> DataFrame:
    """binary_metrics at the threshold with ROC-AUC, average precision and Brier score, for each key; the first two null without both classes."""
    out = binary_metrics(df.withColumn("_p", (F.col(score) >= threshold).cast("int")), keys, y, "_p")
    s = _by_score(df, y, score, keys).withColumn("neg", F.col("n") - F.col("pos"))
    above = F.col("above") - F.col("hits") - F.col("neg")
    ranked = s.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"), F.sum(F.col("pos") * (above + F.col("neg") / 2)).alias("_lost"), F.sum(F.col("pos") * F.col("hits") / F.col("above")).alias("_steps"))
    both = (F.col("_p") > 0) & (F.col("_q") > 0)
    ranked = ranked.select(*keys, F.when(both, 1 - F.col("_lost") / (F.col("_p") * F.col("_q"))).alias("roc_auc"), F.when(both, F.col("_steps") / F.col("_p")).alias("average_precision"))
    brier = df.groupBy(*keys).agg(F.avg((F.col(score) - F.col(y)) ** 2).alias("brier"))
    return with_key(with_key(out, ranked, keys), brier, keys)


def precision_recall_curve(df: DataFrame, y: str, score: str, most: int = 300) -> DataFrame:
    """(threshold, precision, recall) at distinct scores, evenly thinned to `most` of them."""
    curve = _by_score(df, y, score)
    total = df.agg(F.sum(F.col(y).cast("long")).alias("_all"))
    curve = curve.crossJoin(F.broadcast(total))  # one row
    curve = curve.select(F.col("score").alias("threshold"), (F.col("hits") / F.col("above")).alias("precision"), safe_divide(F.col("hits"), F.col("_all")).alias("recall"))
    return even_sample(curve, "threshold", most)
