"""Ranks, running sums, quantiles and time frames without a task that sorts a whole key.

A key's rows are cut into slices of its values, by approximate quantiles, or of time. What a slice needs to know of the
ones before it is a sum for each slice, or the rows of its edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.scalars import micros
from telemetra.functions.tables import settled

#: Slices of a key's values.
PARTS = 64


def with_key(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df joined to a table with one row for each key, which is computed once; without keys that is one row."""
    other = settled(other)
    return df.join(other, keys) if keys else df.crossJoin(other)


def value_slices(df: DataFrame, keys: list[str], value: str, parts: int = PARTS) -> DataFrame:
    """df with `_slice`, in the order of the value inside a key; equal values share a slice. Null values have slice 0.

    Approximate quantiles depend on the order in which parts of a key are merged, so with_key computes them once: slices are
    counted in one place of a plan and ranked in another, and have to be the same in both.
    """
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 10 * parts).alias("_cuts"))
    return with_key(df, cuts, keys).withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def running(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column], descending: bool = False, parts: int = PARTS) -> DataFrame:
    """df with running sums up to each row's value, rows of an equal value included."""
    rows = value_slices(df.withColumns({f"_{k}": c for k, c in sums.items()}), keys, value, parts)
    way = F.desc if descending else F.asc
    total = rows.groupBy(*keys, "_slice").agg(*(F.sum(f"_{k}").alias(f"_{k}_own") for k in sums))
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy(way("_slice")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    total = total.select(*keys, "_slice", *(F.coalesce(F.sum(f"_{k}_own").over(before), F.lit(0)).alias(f"_{k}_before") for k in sums))
    upto = Window.partitionBy(*keys, "_slice").orderBy(way(value)).rangeBetween(Window.unboundedPreceding, 0)
    out = rows.join(total, [*keys, "_slice"]).withColumns({k: F.col(f"_{k}_before") + F.sum(f"_{k}").over(upto) for k in sums})
    return out.drop("_slice", *(f"_{k}" for k in sums), *(f"_{k}_before" for k in sums))


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], parts: int = PARTS) -> DataFrame:
    """Exact percentiles of each key, linear between the two values around the place. Null values do not count.

    The slices' counts tell in which slice a place lies; only rows of those slices are ranked.
    """
    x = value_slices(df.select(*keys, value).where(F.col(value).isNotNull()), keys, value, parts)
    count = x.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy(*keys or [F.lit(0)])
    before = inside.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    count = count.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(inside)})
    places = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("_all") - 1)).alias("place")) for name, p in wanted.items()))
    count = count.withColumn("_w", F.explode(places)).select("*", "_w.*").drop("_w")
    ends = F.array(F.floor("place"), F.ceil("place"))
    count = count.where(F.exists(ends, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n"))))
    rank = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(value)) - 1
    slices = count.select(*keys, "_slice", "_before").distinct()
    ranked = x.join(slices, [*keys, "_slice"]).withColumn("_rank", rank + F.col("_before"))
    found = ranked.join(count.select(*keys, "_slice", "name", "place"), [*keys, "_slice"]).where((F.col("_rank") == F.floor("place")) | (F.col("_rank") == F.ceil("place")))
    low, high = F.min(value), F.max(value)
    one = found.groupBy(*keys, "name", "place").agg((low + (high - low) * (F.col("place") - F.floor("place"))).alias("_v"))
    return one.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == n, F.col("_v"))).alias(n) for n in wanted))


def time_framed(df: DataFrame, keys: list[str], ts: str, seconds: int, slice_seconds: int | None = None) -> DataFrame:
    """df with `_us`, `_slice` and `_own`: every row in its slice of time and, not as its own, in later slices whose rows look back at it.

    A frame of so many seconds back, partitioned by the keys and `_slice`, sees all of its rows; rows that are not their
    slice's own have to be left out afterwards. Slices are longer than frames, so that a row is in two of them at most.
    """
    us, width = seconds * 1_000_000, max(slice_seconds or 16 * seconds, seconds + 1) * 1_000_000
    rows = df.withColumn("_us", micros(F.col(ts))).withColumn("_own_slice", F.floor(F.col("_us") / width))
    last = F.floor((F.col("_us") + us) / width)
    rows = rows.withColumn("_slice", F.explode_outer(F.sequence("_own_slice", F.coalesce(last, F.col("_own_slice")))))
    return rows.withColumn("_own", F.col("_slice").eqNullSafe(F.col("_own_slice"))).drop("_own_slice")


def numbered(df: DataFrame, keys: list[str], order: str, ties: tuple[str, ...] = (), name: str = "_index", parts: int = PARTS) -> DataFrame:
    """df with each row's place from 0 inside its key, by the number `order`, then by the columns that settle ties."""
    rows = value_slices(df, keys, order, parts)
    count = rows.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    count = count.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(order, *ties)) - 1
    return rows.join(count, [*keys, "_slice"]).withColumn(name, F.col("_before") + own).drop("_slice", "_before")


def row_framed(df: DataFrame, keys: list[str], order: str, back: int, ahead: int, block: int = 100_000) -> DataFrame:
    """df with `_index`, `_block` and `_own`: blocks of rows, with copies of the rows that frames of so many rows reach over their edges."""
    rows = numbered(df, keys, order)
    at = F.col("_index")
    first, last = F.greatest(F.floor((at - ahead) / block), F.lit(0)), F.floor((at + back) / block)
    rows = rows.withColumn("_block", F.explode(F.sequence(first, last)))
    return rows.withColumn("_own", F.floor(at / block) == F.col("_block"))
