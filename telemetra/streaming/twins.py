"""Structured-streaming twins: buckets, sliding statistics, sessions, breaches, states, history, repeated and late rows, risk.

A stream has `ts` as a timestamp (streams() casts a table's timestamp_ntz, which watermarks don't take); delays are
intervals such as "10 minutes". Results are appended once the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from telemetra.functions.scalars import ANOMALOUS_LEVELS, EPS, LADDERS, normalized, severity
from telemetra.operators.evidence import RELIABILITY_WEIGHTS, TYPE_WEIGHTS, weight_of
from telemetra.sources.sinks import scratch


def stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream, its times as timestamps."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern: the path may be a single file
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"})


def drained(rows: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote, as a table in the shared folder."""
    spark = rows.sparkSession
    root = scratch(spark, "stream")
    q = rows.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/state").format("parquet").start(f"{root}/rows")
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/rows")


def bucket_counts(rows: DataFrame, keys: list[str], delay: str, bucket: str, level: str | None = None) -> DataFrame:
    """Per key and tumbling bucket: rows, and rows of anomalous levels."""
    bad = F.upper(level).isin(*ANOMALOUS_LEVELS) if level else F.lit(False)
    out = rows.withWatermark("ts", delay).groupBy(F.window("ts", bucket), *keys).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_anomalous"))
    return out.select(F.col("window.start").alias("bucket"), *keys, "n", "n_anomalous")


def sliding(rows: DataFrame, keys: list[str], value: str, delay: str, width: str, step: str) -> DataFrame:
    """Statistics of each key over sliding windows."""
    out = rows.withWatermark("ts", delay).groupBy(F.window("ts", width, step), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(F.col("window.start").alias("start_ts"), F.col("window.end").alias("end_ts"), *keys, "n", "mean", "least", "most")


def sessions(rows: DataFrame, key: str, delay: str, gap: str) -> DataFrame:
    """Runs of a key's rows without a gap of `gap` or more: first row, end (last row and gap), rows."""
    out = rows.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), key, "n")


def breaches(rows: DataFrame, ranges: DataFrame, key: str, value: str, least: float = 2.5) -> DataFrame:
    """Rows outside of their key's normal range, a static table with a row for each key."""
    z = F.abs((F.col(value) - F.col("mean")) / F.greatest("sd", F.lit(EPS)))
    out = rows.join(ranges, key).withColumn("z", z).where((F.col("z") >= least) | (F.col(value) < F.col("q01")) | (F.col(value) > F.col("q99")))
    return out.withColumn("normalized", normalized(F.col("z"), 5.0)).withColumn("severity", severity(F.col("z"), LADDERS["anomaly"]))


def risk(rows: DataFrame, delay: str, bucket: str) -> DataFrame:
    """Noisy-or of weighted signals (entity, ts, signal_type, normalized, reliability) per entity and bucket."""
    part = F.least(F.greatest(F.col("normalized") * weight_of("signal_type", TYPE_WEIGHTS) * weight_of("reliability", RELIABILITY_WEIGHTS), F.lit(0.0)), F.lit(0.95))
    out = rows.withColumn("_c", part).withWatermark("ts", delay).groupBy(F.window("ts", bucket), "entity").agg((1 - F.product(1 - F.col("_c"))).alias("risk"), F.count("*").alias("evidence"))
    return out.select("entity", F.col("window.start").alias("bucket"), "risk", "evidence", severity(F.col("risk"), LADDERS["risk"]).alias("severity"))


def without_repeats(rows: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def _sorted(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(["ts", "row_id"], kind="stable")


def state_changes(rows: DataFrame, key: str, state: str) -> DataFrame:
    """(key, ts, row_id, state, transition, seconds_since) of rows (key, ts, row_id, state 0/1) that come in the order of time.

    What is kept for a key is its last state and the time of its last change.
    """
    kind = rows.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], memory: GroupState) -> Iterator[pd.DataFrame]:
        last, since = memory.get if memory.exists else (None, None)
        x, out = _sorted(batches), []
        for t, r, s in zip(x.ts, x.row_id, x[state], strict=True):
            changed = int(last is not None and s != last)
            since = t.value // 1000 if changed else since
            out.append((k[0], t, r, int(s), changed, None if since is None else (t.value // 1000 - since) / 1e6))
            last = int(s)
        memory.update((last, since))
        yield pd.DataFrame(out, columns=[key, "ts", "row_id", "state", "transition", "seconds_since"])

    return rows.select(key, "ts", "row_id", state).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, row_id long, state int, transition int, seconds_since double", "last int, since long", "append", GroupStateTimeout.NoTimeout)


def history(rows: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, ts, row_id, prior): how many distinct earlier times of the key lie in [t - seconds, t), for rows in the order of time.

    What is kept for a key are the times of its last `seconds`.
    """
    kind, us = rows.schema[key].dataType.simpleString(), seconds * 1_000_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], memory: GroupState) -> Iterator[pd.DataFrame]:
        times = list(memory.get[0]) if memory.exists else []
        out = []
        for t, r in _sorted(batches)[["ts", "row_id"]].itertuples(index=False):
            now = t.value // 1000
            times = [x for x in times if x >= now - us]
            out.append((k[0], t, r, sum(x < now for x in times)))
            if not times or times[-1] != now:
                times.append(now)
        memory.update((times,))
        yield pd.DataFrame(out, columns=[key, "ts", "row_id", "prior"])

    return rows.select(key, "ts", "row_id").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, row_id long, prior long", "times array<long>", "append", GroupStateTimeout.NoTimeout)


def with_late(rows: DataFrame, seconds: int, on_time: str, late: str) -> None:
    """Runs a stream into two tables: rows that are at most so many seconds behind the latest time seen before their batch, and the later ones."""
    root, latest = scratch(rows.sparkSession, "late"), [None]

    def put(batch: DataFrame, _: int) -> None:
        behind: Column = F.lit(False) if latest[0] is None else F.col("ts") < F.lit(latest[0]) - F.expr(f"interval {seconds} seconds")
        batch = batch.persist()
        batch.where(~behind).write.mode("append").parquet(on_time)
        batch.where(behind).write.mode("append").parquet(late)
        top = batch.agg(F.max("ts")).first()[0]
        latest[0] = max(x for x in (latest[0], top) if x is not None) if top or latest[0] else None
        batch.unpersist()

    rows.writeStream.foreachBatch(put).trigger(availableNow=True).option("checkpointLocation", f"{root}/state").start().awaitTermination()
