"""Audits and profiles of tables: columns, matrices, cadence, segments, states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.bins import with_previous
from telemetra.functions.scalars import EPS, micros, safe_divide


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    lacking = sorted(set(columns) - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def long(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, column, x): one row for each number of each row."""
    return df.select(*keys or [], F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("_s")).select(*keys or [], "_s.*")


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: nulls, distinct values, mean, deviation, least and most, constant or not (deviation of EPS at most)."""
    out = long(df, columns).groupBy("column").agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("n_null"), F.countDistinct("x").alias("n_distinct"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("least"), F.max("x").alias("most"))
    return out.withColumn("constant", (F.coalesce("sd", F.lit(0.0)) <= EPS).cast("int"))


def fit_for_forecasts(profile: DataFrame, distinct: int = 10, sd: float = 1e-6) -> DataFrame:
    """numeric_profile with `usable`: enough distinct values and deviation."""
    return profile.withColumn("usable", ((F.col("n_distinct") >= distinct) & (F.col("sd") > sd)).cast("int"))


def matrix_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, rows that repeat another one, cells that are null, constant columns, MiB as doubles."""
    cells = F.struct(*(F.col(c) for c in columns))
    whole = df.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct(cells)).alias("repeated"))
    cols = numeric_profile(df, columns).agg(F.sum("n_null").alias("missing"), F.sum("constant").alias("constant"))
    return whole.crossJoin(F.broadcast(cols)).withColumn("mib", F.col("n") * len(columns) * 8 / 2.0**20)  # a row each


def label_vector(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, most: int = 20) -> DataFrame:
    """The commonest values, ties by value."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def state_summary(df: DataFrame, entity: str, order: list[str], states: list[str]) -> DataFrame:
    """Per state: rows, share of 1, changes from one row of an entity to the next."""
    rows = with_previous(df, [entity], order, {f"_{s}": s for s in states})
    seen = rows.select(*(F.col(s).cast("int").alias(s) for s in states), *((F.col(s) != F.col(f"_{s}")).cast("int").alias(f"_{s}") for s in states))
    parts = [F.struct(F.lit(s).alias("state"), F.col(s).alias("x"), F.col(f"_{s}").alias("changed")) for s in states]
    rows = seen.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
    return rows.groupBy("state").agg(F.count("x").alias("n"), F.avg("x").alias("active"), F.coalesce(F.sum("changed"), F.lit(0)).alias("transitions"))


def is_binary(df: DataFrame, columns: list[str], rows: int = 10_000) -> DataFrame:
    """Per text column whether all its filled values among the first rows (by hash-free file order) are 0, 1, true or false."""
    some = df.limit(rows)
    parts = [F.struct(F.lit(c).alias("column"), F.trim(F.lower(F.col(c).cast("string"))).alias("x")) for c in columns]
    x = some.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
    filled = F.col("x").isNotNull() & (F.col("x") != "")
    return x.groupBy("column").agg(F.coalesce(F.bool_and(F.when(filled, F.col("x").isin("0", "1", "true", "false"))), F.lit(False)).cast("int").alias("binary"))


def segment_summary(df: DataFrame, ts: str) -> DataFrame:
    """Per (split, segment_id): rows, first and last time, days."""
    out = df.groupBy("split", "segment_id").agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return out.withColumn("days", (micros(F.col("last_ts")) - micros(F.col("first_ts"))) / 8.64e10)


def cadence(df: DataFrame, entity: str, ts: str, most: int = 10) -> DataFrame:
    """Per entity the commonest steps between rows in seconds: (entity, step, n, position), ties by step."""
    step = (micros(F.col(ts)) - micros(F.col("_before"))) / 1e6
    g = with_previous(df.select(entity, ts), [entity], [ts], {"_before": ts}).select(entity, F.round(step, 3).alias("step")).where("step is not null").groupBy(entity, "step").agg(F.count("*").alias("n"))
    return g.withColumn("position", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("n"), "step"))).where(F.col("position") <= most)


def step_profile(df: DataFrame, entity: str, ts: str) -> DataFrame:
    """Per entity: rows, median step, steps of over 1.5 medians, repeated times, regular or not (a single step)."""
    step = (micros(F.col(ts)) - micros(F.col("_before"))) / 1e6
    g = with_previous(df.select(entity, ts), [entity], [ts], {"_before": ts}).select(entity, step.alias("step")).groupBy(entity, "step").agg(F.count("*").alias("k"))
    m = g.where("step is not null").groupBy(entity).agg(F.expr("percentile(step, 0.5, k)").alias("median_step"), F.countDistinct("step").alias("steps"))
    out = g.join(m, entity, "left").groupBy(entity).agg(F.sum("k").alias("n"), F.first("median_step").alias("median_step"), F.coalesce(F.sum(F.when(F.col("step") > 1.5 * F.col("median_step"), F.col("k"))), F.lit(0)).alias("gaps"), F.coalesce(F.sum(F.when(F.col("step") == 0, F.col("k"))), F.lit(0)).alias("repeated"), F.coalesce(F.first("steps"), F.lit(0)).alias("steps"))
    return out.withColumn("regular", (F.col("steps") == 1).cast("int")).drop("steps")


def column_types(df: DataFrame, columns: list[str], exact: int = 100_000) -> DataFrame:
    """Per text column: rows, filled, distinct values, and what it is: empty, bool, int, float, datetime or text; identifier,
    categorical and temporal or not."""
    # Names of identifiers; the counts by which text is categorical.
    known = ("udi", "product id", "lineid", "line_id", "unnamed_index")
    value = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    x = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), value(c).alias("x")) for c in columns))).alias("s")).select("s.*")
    every = lambda ok: F.coalesce(F.bool_and(F.when(F.col("x").isNotNull(), F.coalesce(ok, F.lit(False)))), F.lit(False))
    number = F.col("x").try_cast("double")
    g = x.groupBy("column").agg(F.count("*").alias("n"), F.count("x").alias("filled"), F.countDistinct("x").alias("n_distinct"), every(F.lower("x").isin("true", "false") | number.isin(0.0, 1.0)).alias("_bool"), every(F.col("x").rlike(r"^[+-]?\d+$")).alias("_int"), every(number.isNotNull()).alias("_float"), every(F.col("x").try_cast("timestamp").isNotNull()).alias("_time"))
    kind = F.when(F.col("filled") == 0, "empty").when(F.col("_bool"), "bool").when(F.col("_int"), "int").when(F.col("_float"), "float").when(F.col("_time"), "datetime").otherwise("text")
    name = F.lower("column")
    ident = name.isin(*known) | (F.endswith(name, F.lit("id")) & (safe_divide(F.col("n_distinct"), F.col("n")) > 0.9))
    g = g.withColumns({"kind": kind, "identifier": ident})
    few = F.col("n_distinct") <= F.least(F.greatest(F.lit(50), F.floor(F.col("n") * 0.2)), F.lit(5000))
    cat = ~F.col("identifier") & (F.col("n_distinct") <= exact) & ((F.col("kind") == "bool") | ((F.col("kind") == "text") & few))
    temporal = F.contains(name, F.lit("time")) | F.contains(name, F.lit("date"))
    log = name.isin("pid", "process", "node", "addr", "id") | F.endswith(name, F.lit("id"))
    return g.withColumns({"categorical": cat, "temporal": temporal, "log_column": log}).drop("_bool", "_int", "_float", "_time")


def describe(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """Per column and group of rows: number, mean, deviation."""
    return long(df, columns, [group]).groupBy("column", group).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def machine_audit(df: DataFrame, entity: str, order: list[str], label: str, columns: list[str]) -> DataFrame:
    """Per entity: rows, positives, runs of positives, constant columns, repeated rows."""
    begins = ((F.col(label) == 1) & (F.coalesce("_before", F.lit(0)) == 0)).cast("int")
    g = with_previous(df, [entity], order, {"_before": label}).withColumn("_b", begins).groupBy(entity).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("positives"), F.sum("_b").alias("segments"), (F.count("*") - F.countDistinct(F.struct(*columns))).alias("repeated"))
    flat = long(df, columns, [entity]).groupBy(entity, "column").agg(F.stddev_pop("x").alias("sd")).groupBy(entity).agg(F.count_if(F.col("sd") <= EPS).alias("constant"), F.count_if(F.col("sd") <= 1e-3).alias("nearly_constant"))
    return g.join(flat, entity)


def text_statistics(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Per key: texts, and least, mean and most words between white space."""
    words = F.size(F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda w: w != ""))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(words).alias("least_words"), F.avg(words).alias("mean_words"), F.max(words).alias("most_words"))


def fixed_width(line: Column, width: int, mark: str = ",") -> Column:
    """Fields of a line: too many are joined into the last one, too few are filled with empty ones."""
    parts = F.split(line, mark)
    over = F.concat(F.slice(parts, 1, width - 1), F.array(F.array_join(F.slice(parts, width, F.greatest(F.size(parts) - width + 1, F.lit(1))), mark)))
    return F.when(F.size(parts) > width, over).otherwise(F.concat(parts, F.array_repeat(F.lit(""), F.greatest(width - F.size(parts), F.lit(0)))))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
