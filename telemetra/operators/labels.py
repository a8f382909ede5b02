"""Labels of observations, audits of labels and splits, and small joins of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.bins import BLOCK, carried, inside, row_bins
from telemetra.functions.ranks import numbered, percentiles
from telemetra.functions.scalars import micros, safe_divide
from telemetra.functions.spans import in_spans
from telemetra.functions.tables import settled


def label_observations(df: DataFrame, windows: DataFrame, points: DataFrame, entity: str, ts: str, block: int = BLOCK) -> DataFrame:
    """df with `label`: 1 inside a closed window (entity, start_ts, end_ts); where an entity has no row in any of its
    windows, 1 at its labelled points (entity, ts) instead.

    A row is inside if a window that has begun by then ends no sooner: the latest end so far, in the order of time.
    """
    begun = windows.select(entity, F.col("start_ts").alias("_at"), F.lit(0).alias("_kind"), F.col("end_ts").alias("_end"))
    both = df.withColumns({"_at": F.col(ts), "_kind": F.lit(1)}).unionByName(begun, allowMissingColumns=True)
    both = carried(row_bins(both, [entity], ["_at", "_kind"], 0, block), [entity], F.max("_end"), F.max, "_past")
    latest = F.max("_end").over(inside([entity], ["_at", "_kind"]).rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("_in", F.coalesce((F.greatest(latest, "_past") >= F.col("_at")) & F.col(entity).isNotNull(), F.lit(False))).where("_kind = 1")
    met = settled(rows.where("_in").select(entity, F.lit(True).alias("_met")).distinct())
    spots = points.select(entity, F.col(points.columns[-1]).alias(ts), F.lit(True).alias("_spot")).distinct()
    label = F.when(F.col("_met"), F.col("_in")).otherwise(F.coalesce("_spot", F.lit(False))).cast("int")
    return rows.join(met, entity, "left").join(spots, [entity, ts], "left").select(*(F.col(f"`{c}`") for c in df.columns), label.alias("label"))


def window_alignment(df: DataFrame, windows: DataFrame, entity: str, ts: str, block: int = BLOCK) -> DataFrame:
    """Per window: observations in the closed and the half-open interval, whether its ends are observed times, whether it
    reaches outside of the entity's times. Equal windows are one, with the observations of each.

    Observations before and up to either end are counted in the order of time; their differences are the window's.
    """
    times = df.select(entity, F.col(ts).alias("_at"))
    span = settled(times.groupBy(entity).agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi")))
    ids = windows.groupBy(entity, "window_id", "start_ts", "end_ts").agg(F.count("*").alias("_k"))
    ends = F.explode(F.array(*(F.struct(F.col(c).alias("_at"), F.lit(kind).alias("_kind"), F.lit(name).alias("_name")) for c, name in (("start_ts", "a"), ("end_ts", "b")) for kind in (0, 2))))
    marks = ids.select("*", ends.alias("_e")).select(*ids.columns, "_e.*")
    both = times.withColumns({"_kind": F.lit(1), "_one": F.lit(1).cast("long")}).unionByName(marks, allowMissingColumns=True)  # marks before and after the rows of their time
    both = carried(row_bins(both, [entity], ["_at", "_kind"], 0, block), [entity], F.sum("_one"), F.sum, "_past")
    upto = F.sum("_one").over(inside([entity], ["_at", "_kind"]).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_upto", F.coalesce(upto, F.lit(0)) + F.coalesce("_past", F.lit(0))).where("_kind <> 1")
    seen = {f"_{name}{kind}": F.max(F.when((F.col("_name") == name) & (F.col("_kind") == kind), F.col("_upto"))) for name in "ab" for kind in (0, 2)}
    out = both.groupBy(*ids.columns).agg(*(c.alias(name) for name, c in seen.items())).join(span, entity, "left")
    sound = F.col(entity).isNotNull() & (F.col("start_ts") <= F.col("end_ts"))
    count = lambda a, b: F.when(sound, (F.col(b) - F.col(a)) * F.col("_k")).otherwise(F.lit(0))
    at = lambda a, b: F.coalesce((sound & (F.col(b) > F.col(a))).cast("int"), F.lit(0))
    outside = F.col("_lo").isNull() | (F.col("start_ts") < F.col("_lo")) | (F.col("end_ts") > F.col("_hi"))
    return out.select(entity, "window_id", "start_ts", "end_ts", count("_a0", "_b2").alias("closed"), count("_a0", "_b0").alias("half_open"), at("_a0", "_a2").alias("start_seen"), at("_b0", "_b2").alias("end_seen"), outside.cast("int").alias("outside"))


def alignment_summary(aligned: DataFrame) -> DataFrame:
    return aligned.agg(F.count("*").alias("windows"), F.count_if(F.col("closed") == 0).alias("empty"), F.sum("closed").alias("closed"), F.sum("half_open").alias("half_open"), F.sum("start_seen").alias("start_seen"), F.sum("end_seen").alias("end_seen"), F.sum("outside").alias("outside"))


def nearest_rows(df: DataFrame, moments: DataFrame, entity: str, ts: str, seconds: int, slice_seconds: int | None = None) -> DataFrame:
    """For each moment (entity, moment) the nearest row at most so many seconds away: ties go to the earlier one, of rows of
    one time to the least. Moments without one go.

    Rows and moments are sorted together in slices of time, rows also in the slices whose moments they can reach; the last
    row before a moment and the first one after it are carried along.
    """
    us, width = seconds * 1_000_000, (slice_seconds or 16 * max(seconds, 1)) * 1_000_000
    rest = [c for c in df.columns if c not in (entity, ts)]
    one = df.where(F.col(entity).isNotNull() & F.col(ts).isNotNull()).groupBy(entity, ts).agg(F.min(F.struct(ts, *rest)).alias("_row")).withColumn("_us", micros(F.col(ts)))
    reach = F.sequence(F.floor((F.col("_us") - us) / width), F.floor((F.col("_us") + us) / width))
    rows = one.select(entity, F.explode(reach).alias("_slice"), "_us", "_row")
    asked = moments.where(F.col(entity).isNotNull() & F.col("moment").isNotNull()).select(entity, "moment").distinct().withColumn("_us", micros(F.col("moment")))
    both = rows.unionByName(asked.withColumn("_slice", F.floor(F.col("_us") / width)), allowMissingColumns=True)
    upto = lambda order: F.last(F.when(F.col("_row").isNotNull(), F.struct("_us", "_row")), True).over(Window.partitionBy(entity, "_slice").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("_before", upto(F.asc("_us"))).withColumn("_after", upto(F.desc("_us"))).where("moment is not null")
    away = lambda c: F.abs(F.col("_us") - F.col(c)["_us"])
    best = F.array_min(F.array_compact(F.array(*(F.when(away(c) <= us, F.struct(away(c).alias("d"), F.col(c)["_us"].alias("at"), F.col(c)["_row"].alias("row"))) for c in ("_before", "_after")))))
    out = met.withColumn("_best", best).where("_best is not null")
    return out.select(entity, *(F.col("_best.row")[c].alias(c) for c in df.columns if c != entity), "moment", (F.col("_best.d") / 1e6).alias("away_seconds"))


def context_rows(df: DataFrame, cases: DataFrame, entity: str, order: str, value: str, rows: int) -> DataFrame:
    """Around each case row (entity, index from 0) the rows at most so many places away, and their mean and population variance."""
    at = numbered(df, [entity], order).select(entity, F.col("_index").alias("_i"), F.col(value).alias("_v"))
    wanted = cases.withColumn("_i", F.explode(F.sequence(F.greatest(F.col("index") - rows, F.lit(0)), F.col("index") + rows)))
    return wanted.join(at, [entity, "_i"]).groupBy(*cases.columns).agg(F.count("*").alias("n"), F.avg("_v").alias("local_mean"), F.var_pop("_v").alias("local_variance"))


def split_events(events: DataFrame, train_end: str, validation_end: str) -> DataFrame:
    """split of each event by its start, half-open."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return events.withColumn("split", F.when(F.col("start_ts") < at(train_end), "train").when(F.col("start_ts") < at(validation_end), "validation").otherwise("test"))


def split_counts(df: DataFrame, target: str) -> DataFrame:
    out = df.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.col(target).cast("long")).alias("positives"))
    return out.withColumn("ratio", safe_divide(F.col("positives"), F.col("n")))


def positive_weight(df: DataFrame, target: str) -> DataFrame:
    """One row: negatives for each positive, 1 at least; 1 without positives."""
    p, n = F.count_if(F.col(target) == 1), F.count_if(F.col(target) == 0)
    return df.agg(F.when(p == 0, F.lit(1.0)).otherwise(F.greatest(n / p, F.lit(1.0))).alias("weight"))


def event_structure(df: DataFrame, events: DataFrame, ts: str) -> DataFrame:
    """Per event (failure_id, start_ts, end_ts[, split]): rows in it, hours it lasts, hours since the one before began and ended, whether they overlap."""
    n = in_spans(df.select(ts), events.select("failure_id", "start_ts", "end_ts"), ts, "start_ts", "end_ts", closed=True).groupBy("failure_id").agg(F.count("*").alias("n"))
    w = Window.orderBy("start_ts", "failure_id")  # events: one row for each failure
    hours = lambda a, b: (micros(b) - micros(a)) / 3.6e9
    out = events.withColumns({"_s": F.lag("start_ts").over(w), "_e": F.lag("end_ts").over(w)})
    out = out.withColumns({"hours": hours(F.col("start_ts"), F.col("end_ts")), "since_start": hours(F.col("_s"), F.col("start_ts")), "since_end": hours(F.col("_e"), F.col("start_ts"))})
    return out.join(n, "failure_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("overlaps", F.coalesce((F.col("start_ts") <= F.col("_e")).cast("int"), F.lit(0))).drop("_s", "_e")


def target_integrity(df: DataFrame, events: DataFrame, ts: str, horizon: str, target: str) -> DataFrame:
    """One row: positives outside every horizon, negatives inside one, positives while a failure is active. All have to be 0."""
    spans = events.withColumn("_a", F.expr(f"start_ts - interval {horizon}")).select("failure_id", "_a", "start_ts", "end_ts")
    times = df.groupBy(ts, target).agg(F.count("*").alias("_n"))
    ahead = in_spans(times.select(ts).distinct(), spans, ts, "_a", "start_ts").select(ts).distinct().withColumn("_h", F.lit(True))
    active = in_spans(times.select(ts).distinct(), spans, ts, "start_ts", "end_ts", closed=True).select(ts).distinct().withColumn("_on", F.lit(True))
    x = times.join(ahead, ts, "left").join(active, ts, "left")
    h, on = F.coalesce("_h", F.lit(False)), F.coalesce("_on", F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    return x.agg(total((F.col(target) == 1) & ~h).alias("positives_outside"), total((F.col(target) == 0) & h & ~on).alias("negatives_inside"), total((F.col(target) == 1) & on & ~h).alias("positives_while_active"))


def by_bucket(risks: DataFrame, counts: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Risks with their bucket's evidence counts, 0 where there is none."""
    return risks.join(counts, keys, "left").na.fill(0, names)


def size_mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys whose row counts differ, or that one side lacks: (key, n_left, n_right)."""
    out = left.groupBy(key).agg(F.count("*").alias("n_left")).join(right.groupBy(key).agg(F.count("*").alias("n_right")), key, "full").na.fill(0, ["n_left", "n_right"])
    return out.where("n_left <> n_right")


def best_of(results: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key, by an order without ties; without keys the first of all."""
    if not keys:
        return results.orderBy(*order).limit(1)
    return results.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def benefit(results: DataFrame, entity: str, model: str, score: str, baseline: str) -> DataFrame:
    """Per entity the baseline's score, the best other model and its score, and the gain; an entity that only one has is kept."""
    base = results.where(F.col(model) == baseline).select(entity, F.col(score).alias("baseline_score"))
    rest = best_of(results.where(F.col(model) != baseline), [entity], [F.desc(F.round(score, 9)), model]).select(entity, F.col(model).alias("best_model"), F.col(score).alias("best_score"))
    return base.join(rest, entity, "full").withColumn("gain", F.col("best_score") - F.col("baseline_score"))


def matching(winners: DataFrame, others: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Winners with the same candidate's row of another split, as `name`."""
    cols = [c for c in others.columns if c not in keys]
    return winners.join(others.select(*keys, F.struct(*cols).alias(name)), keys, "left")


def difficulty(f1, recall, fpr, positives):
    """A series' difficulty from its best F1 and that model's recall, or from its highest false positive rate where it has no labels."""
    # Bounds of the classes.
    labelled = F.when((f1 >= 0.5) & (recall >= 0.4), "easy").when(f1 >= 0.2, "moderate").when(f1 > 0, "difficult")
    free = F.when(fpr <= 0.01, "easy").when(fpr <= 0.05, "moderate").when(fpr <= 0.15, "difficult")
    return F.when(positives > 0, labelled.otherwise("complete_failure")).otherwise(free.otherwise("complete_failure"))


def overlap_label(a, b):
    return F.when(a & b, "both").when(a, "isolation_only").when(b, "dense_only").otherwise("neither")


def ranked_entities(results: DataFrame, score: str, entity: str, most: int = 5) -> DataFrame:
    """The worst and the best entities, and the one nearest to the median score: (rank_kind, entity, score)."""
    median = results.agg(F.median(score).alias("_m"))  # a row for each entity
    pick = lambda df, kind, n, *order: df.orderBy(*order).limit(n).select(F.lit(kind).alias("rank_kind"), entity, score)
    near = results.crossJoin(F.broadcast(median)).withColumn("_d", F.round(F.abs(F.col(score) - F.col("_m")), 9))
    return pick(results, "best", most, F.desc(score), entity).unionByName(pick(results, "worst", most, score, entity)).unionByName(pick(near, "median", 1, "_d", entity))


def scored_errors(df: DataFrame, ts: str, y: str, predicted: str, score: str, most: int = 10) -> DataFrame:
    """The false positives and the missed rows with the highest scores: (error, ts, score, position)."""
    kind = F.when((F.col(y) == 0) & (F.col(predicted) == 1), "false_positive").when((F.col(y) == 1) & (F.col(predicted) == 0), "missed")
    rows = df.select(kind.alias("error"), ts, score).where("error is not null")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("error").orderBy(F.desc(score), ts))).where(F.col("position") <= most)


def decision(validation_coverage, test_coverage, alarms_per_day, events):
    """A: warnings in both splits, few false alarms, ten events; B: warnings in one of them; C: none."""
    both = (test_coverage > 0) & (validation_coverage > 0)
    return F.when(both & (alarms_per_day < 24) & (events >= 10), "A").when((test_coverage > 0) | (validation_coverage > 0), "B").otherwise("C")


def before_event(df: DataFrame, ts: str, probability: str, start: str, hours: int, threshold: float) -> DataFrame:
    """One row on the scores in the `hours` before a moment, against those of the rest of the day before it: crossings of the
    threshold, and the first score that stands out from the baseline (its 95th percentile, or three deviations by MAD)."""
    at = F.lit(start).cast("timestamp_ntz")
    rows = df.select(ts, F.col(probability).alias("_p")).where((F.col(ts) >= at - F.expr("interval 24 hours")) & (F.col(ts) < at))
    ahead = F.col(ts) >= at - F.expr(f"interval {hours} hours")
    base = percentiles(rows.where(~ahead), [], "_p", {"baseline_median": 0.5, "baseline_p95": 0.95})
    away = rows.where(~ahead).crossJoin(F.broadcast(base)).withColumn("_a", F.abs(F.col("_p") - F.col("baseline_median")))  # one row
    base = base.crossJoin(F.broadcast(percentiles(away, [], "_a", {"_mad": 0.5}))).withColumn("rise", F.greatest("baseline_p95", F.col("baseline_median") + 3 * 1.4826 * F.col("_mad"))).drop("_mad")
    warm = rows.where(ahead).crossJoin(F.broadcast(base))
    out = warm.agg(F.count("*").alias("n"), F.count_if(F.col("_p") >= threshold).alias("warnings"), F.min(F.when(F.col("_p") >= threshold, F.col(ts))).alias("first_crossing"), F.min(F.when(F.col("_p") >= F.col("rise"), F.col(ts))).alias("first_rise"), F.max("_p").alias("max_probability"))
    return out.crossJoin(F.broadcast(base))


def series_errors(results: DataFrame, entity: str, model: str) -> DataFrame:
    """Per entity the best model (F1, recall, then name), and how hard the entity is. results: f1, recall, fpr, positives."""
    worst = results.groupBy(entity).agg(F.max("fpr").alias("max_fpr"))
    best = best_of(results, [entity], [F.desc(F.round("f1", 9)), F.desc(F.round("recall", 9)), F.col(model)])
    out = best.join(worst, entity)
    return out.withColumn("difficulty", difficulty(F.col("f1"), F.col("recall"), F.col("max_fpr"), F.col("positives")))
