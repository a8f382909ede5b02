"""What the operators of this subpackage share: the shared folder, cut lineage, folds, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master gets a folder of
    its own; a cluster gets an error, since its executors would not see such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    sc = spark.sparkContext
    found = sc._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(sc._jsc.hadoopConfiguration()), found


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    system, found = _path(spark, path)
    system.mkdirs(found)
    system.deleteOnExit(found)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df as a written table in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch(spark, 'cut')}/rows"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and that nothing reads any more."""
    for t in tables:
        system, path = _path(t.sparkSession, t._cut_path)
        system.delete(path, True)


def remainder(modulus: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo; -1 for rows without an id, which so belong to no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def forest(pairs: pd.DataFrame) -> pd.DataFrame:
    """Edges (a, b) of one batch as (node, smallest node reachable inside the batch)."""
    nodes, flat = np.unique(pairs[["a", "b"]].to_numpy(np.int64), return_inverse=True)
    flat = flat.reshape(-1, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[flat[:, 0]], label[flat[:, 1]])
        new = label.copy()
        np.minimum.at(new, flat[:, 0], low)
        np.minimum.at(new, flat[:, 1], low)
        np.minimum.at(new, label[flat[:, 0]], low)
        np.minimum.at(new, label[flat[:, 1]], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = pd.DataFrame({"a": nodes, "b": nodes[label]})
    return out[out.a != out.b]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): (node, component), component the smallest node reachable.

    Alternates large-star and small-star steps. Every batch of edges is first replaced by its own spanning
    forest. Stars are joined to their minimum rather than gathered, so a node with very many neighbours is
    spread by Spark's skew-join splitting. Nodes without edges are not returned. An empty input gives an
    empty result.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    state = cut(edges.mapInPandas(lambda it: (forest(x) for x in it if len(x)), "a long, b long").distinct())
    seen = None
    while True:
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, state = state, cut(small.unionByName(low.withColumnRenamed("m", "b")).distinct())
        free(before)
