"""Isolation forest per entity: trees of random splits on samples, scored by mean path length."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.scalars import EPS

EULER = 0.5772156649015329


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, np.float64)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    out[big] = 2 * (np.log(n[big] - 1) + EULER) - 2 * (n[big] - 1) / n[big]
    return out


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> np.ndarray:
    """One tree as rows (feature, cut, left child, path length); leaves have feature -1. The right child follows the left."""
    nodes: list[list[float]] = [[-1, 0, 0, 0]]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        spread = np.flatnonzero(np.ptp(x[rows], axis=0) > 0) if len(rows) > 1 and depth < limit else []
        if len(spread) == 0:
            nodes[at][3] = depth + float(average_path(np.array([len(rows)]))[0])
            continue
        f = int(rng.choice(spread))
        v = x[rows, f]
        cut = rng.uniform(v.min(), v.max())
        left = v <= cut
        nodes[at] = [f, cut, len(nodes), 0]
        todo += [(len(nodes), rows[left], depth + 1), (len(nodes) + 1, rows[~left], depth + 1)]
        nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
    return np.array(nodes, np.float64)


def fit(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> bytes:
    """A forest on the rows of x, packed: each tree is grown on its own sample without repeats. From trees * sample rows on
    no two trees share a row, so that so many rows by hash order stand for all of a larger table."""
    rng, size = np.random.default_rng(seed), min(sample, len(x))
    limit = int(np.ceil(np.log2(max(size, 2))))
    order = rng.permutation(len(x))
    own = lambda t: order[t * size : (t + 1) * size] if len(x) >= trees * size else rng.choice(len(x), size, replace=False)
    grown = [grow(x[own(t)], rng, limit) for t in range(trees)]
    out = io.BytesIO()
    np.savez(out, nodes=np.concatenate(grown), starts=np.cumsum([0] + [len(g) for g in grown[:-1]]), size=size)
    return out.getvalue()


def score(model: bytes, x: np.ndarray) -> np.ndarray:
    """2 ** (- mean path / expected path): near 1 for rows that are split off early."""
    m = np.load(io.BytesIO(model))
    nodes, total, rows = m["nodes"], np.zeros(len(x)), np.arange(len(x))
    owner = np.repeat(m["starts"], np.diff(np.append(m["starts"], len(nodes))))
    leaf = nodes[:, 0] < 0  # a leaf leads to itself, so every row takes the same number of steps
    feature = np.where(leaf, 0, nodes[:, 0]).astype(np.int64)
    cut = np.where(leaf, np.inf, nodes[:, 1])
    left = np.where(leaf, np.arange(len(nodes)), owner + nodes[:, 2].astype(np.int64))
    for start in m["starts"]:
        at = np.full(len(x), start)
        for _ in range(int(np.ceil(np.log2(max(int(m["size"]), 2))))):
            at = left[at] + (x[rows, feature[at]] > cut[at])
        total += nodes[at, 3]
    return 2.0 ** (-total / len(m["starts"]) / max(float(average_path(np.array([m["size"]]))[0]), EPS))


def isolation_scores(df: DataFrame, entity: str, row_id: str, features: list[str], training=None, trees: int = 100, sample: int = 256, block_rows: int = 20_000, seed: int = 42) -> DataFrame:
    """(entity, row_id, score) of every row that has an entity; rows with a null or non-finite feature get a null score, as do entities with no row to fit on.

    Each tree is grown on `sample` rows drawn from all rows of the entity for which `training` holds (all, if None): the
    trees * sample rows with the least hash of the id are dealt out to the trees, or, where there are fewer rows, each
    tree draws from all of them. Every row is scored. Rows of an entity are dealt out in blocks of about block_rows, each of
    which meets a copy of the entity's forest, so a hot entity is no single task. Ids are unique inside an entity.
    """
    fit_rows = trees * sample
    values = F.array(*(F.col(f).cast("double") for f in features))
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col(entity).cast("string").alias("entity"), F.col(row_id).alias("row_id"), F.when(finite, values).alias("x"), (F.lit(True) if training is None else training).alias("_fit"), F.xxhash64(F.col(row_id), F.lit(seed)).alias("_h"))
    usable = rows.where("_fit and x is not null").withColumn("_part", F.pmod("_h", F.lit(64)))
    first = usable.withColumn("_r", F.row_number().over(Window.partitionBy("entity", "_part").orderBy("_h", "row_id"))).where(F.col("_r") <= fit_rows)
    chosen = first.withColumn("_r", F.row_number().over(Window.partitionBy("entity").orderBy("_h", "row_id"))).where(F.col("_r") <= fit_rows)

    def train(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["_h", "row_id"])
        return pd.DataFrame({"entity": [own.entity.iloc[0]], "model": [fit(np.stack(own.x.to_list()), trees, sample, seed)]})

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # growing and scoring cost time, not bytes: not to be coalesced
    models = chosen.select("entity", "row_id", "_h", "x").repartition(tasks, "entity").groupBy("entity").applyInPandas(train, "entity string, model binary")
    blocks = rows.groupBy("entity").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block_rows)).cast("long").alias("_blocks"))
    dealt = rows.join(blocks, "entity").select("entity", F.pmod(F.xxhash64("row_id", F.lit(seed + 1)), F.col("_blocks")).alias("block"), "row_id", "x")
    copies = models.join(blocks, "entity").select("entity", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("block"), "model")
    kind = df.schema[row_id].dataType.simpleString()

    def rate(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        out = pd.Series(np.nan, index=own.index)
        have = own.x.notna()
        if have.any() and len(model):
            out[have] = score(model.model.iloc[0], np.stack(own.x[have].to_list()))
        return pd.DataFrame({"entity": own.entity, "row_id": own.row_id, "score": out.astype(object).where(out.notna(), None)})

    dealt, copies = dealt.repartition(tasks, "entity", "block"), copies.repartition(tasks, "entity", "block")
    scored = dealt.groupBy("entity", "block").cogroup(copies.groupBy("entity", "block")).applyInPandas(rate, f"entity string, row_id {kind}, score double")
    return scored.select(F.col("entity").alias(entity), F.col("row_id").alias(row_id), "score")
