"""Scans that keep the place of a row in its file, and the flags that follow from file order.

A file is read in blocks by many tasks. Places are counted within blocks; the blocks' sizes are summed up and added,
so no task ever has to walk a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BLOCK = ("_file", "_block")


def _indexed(raw: DataFrame) -> DataFrame:
    rows = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_at", F.monotonically_increasing_id())
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*_BLOCK).agg(F.count("*").alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    place = F.row_number().over(Window.partitionBy(*_BLOCK).orderBy("_at")) - 1
    return rows.withColumn("_n", place).join(sizes, list(_BLOCK)).withColumn("sequence_index", (F.col("_before") + F.col("_n")).cast("long")).drop("_at", "_n", "_before")


def csv_rows(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """Rows of CSV files with a header, all text, with sequence_index (from 0 in each file)."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    return _indexed((reader.schema(schema) if schema else reader).csv(path))


def text_lines(spark: SparkSession, path: str | list[str], blank: bool = True) -> DataFrame:
    """Lines of text files (value) with sequence_index; blank ones count only if `blank`."""
    lines = spark.read.option("pathGlobFilter", "*.txt").text(path)
    return _indexed(lines if blank else lines.where("trim(value) <> ''"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def below(path: Column, root: str) -> Column:
    """A file's path below the root."""
    return F.substring_index(path, root.rstrip("/") + "/", -1)


def parse_timestamp(x: Column) -> Column:
    """A wall-clock time of one of the known spellings, else null; ten or more digits are seconds since the epoch."""
    t = F.regexp_replace(F.trim(F.regexp_replace(F.trim(x), '^"+|"+$', "")), ",", ".")
    clock = r"\d{1,2}:\d{1,2}:\d{1,2}"
    full = lambda yy: F.concat(F.when(yy.cast("int") >= 69, "19").otherwise("20"), yy)
    get = lambda pattern, k: F.regexp_extract(t, pattern, k)
    short, dotted, compact = rf"^(\d\d)/(\d{{1,2}})/(\d{{1,2}})( {clock})?$", r"^(\d{4})\.(\d{1,2})\.(\d{1,2})$", r"^(\d\d)(\d\d)(\d\d) (\d\d)(\d\d)(\d\d)$"
    iso = (
        F.when(t.rlike(rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}([ T]{clock}(\.\d{{1,6}})?)?$"), t)
        .when(t.rlike(short), F.concat(full(get(short, 1)), F.lit("-"), get(short, 2), F.lit("-"), get(short, 3), get(short, 4)))
        .when(t.rlike(dotted), F.concat_ws("-", *[get(dotted, k) for k in (1, 2, 3)]))
        .when(t.rlike(compact), F.concat(full(get(compact, 3)), F.lit("-"), get(compact, 1), F.lit("-"), get(compact, 2), F.lit(" "), F.concat_ws(":", *[get(compact, k) for k in (4, 5, 6)])))
    )
    seconds = F.when(t.rlike(r"^\d{10,}$"), F.substring(t, 1, 10).cast("long"))
    epoch = F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.coalesce(epoch, iso.try_cast("timestamp_ntz"))


def combine_date_time(date: Column, time: Column) -> Column:
    return F.when(date.isNotNull() | time.isNotNull(), F.concat_ws(" ", date, time))


def with_times(rows: DataFrame, original: Column, zone: str | None = None) -> DataFrame:
    """timestamp, timestamp_original, timezone_assumption and quality_flag by file order.

    A row is a DUPLICATE if its spelling occurs earlier in the file, OUT_OF_ORDER if it lies before the last earlier row
    that is no duplicate, INVALID without a time. First occurrences come from an aggregation and a join, and the last
    time of the blocks before from a table of blocks, so neither a hot spelling nor a long file ends up in one task.
    """
    text = F.regexp_replace(F.trim(original), '^"+|"+$', "")
    said = "source documented or configured as UTC" if zone else "timezone unavailable in source; preserving naive timestamp"
    rows = rows.withColumn("timestamp_original", text).withColumn("timestamp", parse_timestamp(F.col("timestamp_original"))).withColumn("timezone_assumption", F.when(F.col("timestamp").isNotNull(), F.lit(said)))
    first = rows.where("timestamp_original <> ''").groupBy("_file", "timestamp_original").agg(F.min("sequence_index").alias("_first"))
    rows = rows.join(first, ["_file", "timestamp_original"], "left").withColumn("_dup", F.coalesce(F.col("sequence_index") > F.col("_first"), F.lit(False)))
    clean = F.when(~F.col("_dup"), F.col("timestamp"))
    last = rows.groupBy(*_BLOCK).agg(F.max(F.when(clean.isNotNull(), F.struct("sequence_index", "timestamp"))).alias("_last"))
    carried = F.last("_last.timestamp", True).over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    last = last.withColumn("_carried", carried).drop("_last")
    inside = F.last(clean, True).over(Window.partitionBy(*_BLOCK).orderBy("sequence_index").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_inside", inside).join(last, list(_BLOCK))
    flag = F.when(F.col("timestamp").isNull(), "INVALID").when(F.col("_dup"), "DUPLICATE").when(F.col("timestamp") < F.coalesce("_inside", "_carried"), "OUT_OF_ORDER").otherwise("VALID")
    return rows.withColumn("quality_flag", flag).drop("_first", "_dup", "_inside", "_carried")
