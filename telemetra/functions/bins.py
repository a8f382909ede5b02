"""Row order inside keys of any size: the rows of a great key are cut into bins that follow each other in the key's order.

What a bin needs of the ones before it are copies of their last rows, the number of their rows, and sums or last values
with one row for each bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from telemetra.functions.scalars import micros

#: Rows of a bin; a key with no more rows is one bin.
BLOCK = 1_000_000
#: Cells of great keys that are broadcast at most (three numbers and the key for each); beyond, both sides are shuffled.
BROADCAST_CELLS = 200_000


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str, also: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Join by keys, null keys included, and by further pairs of equal columns; the keys of the left side stay."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys} | {r: f"_right_{r}" for _, r in also})
    on = [left[k].eqNullSafe(named[f"_right_{k}"]) for k in keys] + [left[a] == named[f"_right_{r}"] for a, r in also]
    return left.join(named, on, how).drop(*(f"_right_{k}" for k in keys), *(f"_right_{r}" for _, r in also))


def _place(df: DataFrame, column: str) -> tuple[Column, bool]:
    timed = isinstance(df.schema[column].dataType, (DateType, TimestampNTZType, TimestampType))
    return (micros(F.col(column)) if timed else F.col(column)), timed


def row_bins(df: DataFrame, keys: list[str], order: list[str], back: int = 0, block: int = BLOCK, width: int | None = None) -> DataFrame:
    """df with `_bin`, `_own` and `_skipped`, so that windows by the keys and `_bin` see each row and `back` rows before it.

    Rows that are not `_own` are copies of rows of earlier bins and have to go after the window. A row's place in its key,
    from 1, is its row number inside the bin, copies included, plus `_skipped`. The first order column is a time or a
    number; null places come first. Rows of one cell (a minute, or `width` of the place's units) share a bin, so equal
    places do. Keys are counted first: where none has more than `block` rows, nothing is cut or joined.
    """
    place, timed = _place(df, order[0])
    rows = df.withColumn("_cell", F.floor(place / (width or (60_000_000 if timed else max(1, block // 16)))))
    great = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > block).drop("_n")
    whole = {"_bin": F.lit(0).cast("long"), "_skipped": F.lit(0).cast("long"), "_own": F.lit(True)}
    if great.isEmpty():
        return df.withColumns(whole)
    cells = same_keys(rows.select(*keys, "_cell"), great, keys, "left_semi").groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    cells = cells.withColumn("_bin", F.floor(F.col("_before") / block))
    bins = cells.groupBy(*keys, "_bin").agg(F.min("_before").alias("_start"), F.sum("_n").alias("_n"))
    first = F.min("_before").over(Window.partitionBy(*keys, "_bin"))
    later = cells.withColumn("_skipped", F.greatest(first - back, F.lit(0))).where("_bin > 0").select(*keys, "_cell", "_bin", "_skipped")
    if later.count() <= BROADCAST_CELLS:
        later = F.broadcast(later)
    out = same_keys(rows, later, keys, "left", (("_cell", "_cell"),)).drop("_cell")
    out = out.withColumns({"_bin": F.coalesce("_bin", whole["_bin"]), "_skipped": F.coalesce("_skipped", whole["_skipped"]), "_own": whole["_own"]})
    if not back:
        return out
    last = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(*(F.col(c).desc_nulls_last() for c in order)))
    tails = same_keys(out.drop("_skipped", "_own"), great, keys, "left_semi").withColumn("_back", last).where(F.col("_back") <= back)
    ends = bins.select(*keys, F.col("_bin").alias("_of"), (F.col("_start") + F.col("_n")).alias("_end"))
    tails = same_keys(tails, ends, keys, "inner", (("_bin", "_of"),)).withColumn("_at", F.col("_end") - F.col("_back")).drop("_bin", "_end", "_back")
    wanted = bins.where("_bin > 0").withColumn("_skipped", F.greatest(F.col("_start") - back, F.lit(0)))
    wanted = wanted.select(*keys, "_bin", "_skipped", F.explode(F.sequence("_skipped", F.col("_start") - 1)).alias("_wanted"))
    copies = same_keys(tails, wanted, keys, "inner", (("_at", "_wanted"),)).drop("_at")
    return out.unionByName(copies.withColumn("_own", F.lit(False)))


def rank(keys: list[str], order: list[str]) -> Column:
    """Place of a row of `row_bins` in its key, from 1."""
    return F.row_number().over(inside(keys, order)) + F.col("_skipped")


def inside(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, "_bin").orderBy(*order)


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], block: int = BLOCK) -> DataFrame:
    """df with, for each new name, the value of a column in the row before; null in the first row of a key."""
    rows = row_bins(df, keys, order, 1, block).withColumns({name: F.lag(c).over(inside(keys, order)) for name, c in columns.items()})
    return rows.where("_own").drop("_bin", "_own", "_skipped")


def carried(rows: DataFrame, keys: list[str], partial: Column, over_bins, name: str) -> DataFrame:
    """Own rows with `name`: over_bins (sum, or last that skips nulls) of the earlier bins' partial aggregates; null in a first bin."""
    if rows.where("_bin > 0").isEmpty():
        return rows.where("_own").withColumn(name, F.lit(None).cast(rows.agg(partial.alias("_p")).schema["_p"].dataType))
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    per = rows.where("_own").groupBy(*keys, "_bin").agg(partial.alias("_p")).withColumn(name, over_bins("_p").over(earlier)).where("_bin > 0")
    return same_keys(rows.where("_own"), per.select(*keys, F.col("_bin").alias("_of"), name), keys, "left", (("_bin", "_of"),))
