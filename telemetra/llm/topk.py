"""Operator 10: exact top-k search by inner product with a pivot table.

d(q, x)**2 = |q|**2 + |x|**2 - 2 q.x, and for any pivot p d(q, x) >= |d(q, p) - d(x, p)|. So the precomputed distances
to the pivots give an upper bound of each score: (|q|**2 + |x|**2 - max over p of (d(q, p) - d(x, p))**2) / 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetra.llm.common import cut
from telemetra.llm.lattice import matrix

#: Pivots, taken from at most SAMPLE rows; candidates of a block and queries of a block, which meet in one task.
PIVOTS, SAMPLE, BLOCK, QUERIES = 32, 2048, 4096, 4096


def choose_pivots(x: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Farthest-first points of a sample."""
    chosen = [0] if len(x) else []
    far = ((x - x[0]) ** 2).sum(1) if len(x) else np.zeros(0)
    while len(chosen) < min(count, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0))


def bounds(dq: np.ndarray, nq: np.ndarray, dx: np.ndarray, nx: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of all (query, candidate) pairs."""
    apart = np.zeros((len(dq), len(dx)))
    for p in range(dq.shape[1]):
        np.maximum(apart, np.abs(dq[:, p, None] - dx[None, :, p]), out=apart)
    return (nq[:, None] + nx[None, :] - apart**2) / 2


def search_block(q: np.ndarray, q_id: np.ndarray, floor: np.ndarray, x: np.ndarray, x_id: np.ndarray, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query in a block, those at least that can beat `floor`: positions, ids, scores.

    Candidates are evaluated in the order of their bounds, in steps that double; a query stops once its next bound is
    under its k-th score, or under the floor. Numbers are whole, so doubles are exact to 2**53; bounds have a margin.
    """
    dq, dx, nq, nx = distances(q, pivots), distances(x, pivots), (q**2).sum(1), (x**2).sum(1)
    out: list[list] = [[], [], []]
    for begin in range(0, len(q), 128):
        rows = np.arange(begin, min(begin + 128, len(q)))
        bound = bounds(dq[rows], nq[rows], dx, nx)
        bound += 1e-9 * (np.abs(bound) + nq[rows, None] + nx[None, :]) + 1e-6
        order = np.argsort(-bound, axis=1)
        for r, o, b in zip(rows, order, bound, strict=True):
            best_id, best, at, step = np.empty(0, np.int64), np.empty(0), 0, 64
            while at < len(o):
                least = max(floor[r], best[k - 1] if len(best) >= k else -np.inf)
                if b[o[at]] < least:
                    break
                some = o[at : at + step]
                some = some[(b[some] >= least) & (x_id[some] != q_id[r])]
                ids, scores = np.append(best_id, x_id[some]), np.append(best, x[some] @ q[r])
                first = np.lexsort((ids, -scores))[:k]
                best_id, best, at, step = ids[first], scores[first], at + step, step * 2
            out[0].append(np.full(len(best), r))
            out[1].append(best_id)
            out[2].append(best)
    return tuple(np.concatenate([*c, np.empty(0)]).astype(np.int64) for c in out)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row with all other rows.

    Components become floor(scale * x), x as double. Queries are the rows whose id is divisible by `every`. Ties go to
    the smaller id; a query with fewer candidates gets all. Vectors that are null, empty or hold null or non-finite
    components take no part. Vectors of each length are searched among themselves, with pivots of their own; lengths are
    taken one after the other, as there are few (one for each embedding model). Repeated vectors count each. Ids must be
    unique integers; rows without one take no part; further columns are not read; an empty table gives an empty result.

    Rows are dealt into cells by their nearest pivot and, inside a cell, into blocks. Each query is first answered in
    one block of its own cell; its k-th score there is a floor that rules out whole cells by their ranges of pivot
    distances and norms. It then goes to the blocks of the cells that are left.
    """
    spark = vectors.sparkSession

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, x in matrix(batch.column(1)):
                rows = [r.tobytes() for r in np.floor(scale * x)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at].astype(np.int64)), pa.array([x.shape[1]] * len(at), pa.int32()), pa.array(rows, pa.binary())], names=["vec_id", "size", "v"])

    rows = vectors.select(vectors[id_column].cast("long"), vectors[vector_column]).where(F.col(id_column).isNotNull())
    rows = cut(rows.mapInArrow(whole, "vec_id long, size int, v binary"))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for size in sorted(r["size"] for r in rows.select("size").distinct().collect()):
        out = out.unionByName(_search(rows.where(F.col("size") == size).select("vec_id", "v"), k, every, pivots, block, queries))
    return out


def _search(rows: DataFrame, k: int, every: int, pivots: int, block: int, queries: int) -> DataFrame:
    """top_k for rows (vec_id, v) of whole doubles of one length."""
    sample = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toPandas()
    points = choose_pivots(np.array([np.frombuffer(v) for v in sample.v]), pivots)

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                v = np.frombuffer(b"".join(x.v)).reshape(len(x), -1)
                d = distances(v, points)
                yield pd.DataFrame({"vec_id": x.vec_id, "v": x.v, "cell": d.argmin(1).astype(np.int32), "norm": (v**2).sum(1), "d": list(d)})

    rows = cut(rows.mapInPandas(celled, "vec_id long, v binary, cell int, norm double, d array<double>"))
    spans = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("norm").alias("norm"), *(f(F.col("d")[p]).alias(f"{f.__name__}{p}") for p in range(len(points)) for f in (F.min, F.max))).toPandas()  # a row for each pivot
    cells = spans.cell.to_numpy()
    parts = {int(c): -(-int(n) // block) for c, n in zip(cells, spans.n, strict=True)}
    low = spans[[f"min{p}" for p in range(len(points))]].to_numpy()
    high = spans[[f"max{p}" for p in range(len(points))]].to_numpy()
    part = F.element_at(F.create_map(*(y for c, n in parts.items() for y in (F.lit(c), F.lit(n).cast("long")))), F.col("cell"))
    cand = rows.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id", F.lit(1)), part).alias("part"))
    asked = rows.where(F.col("vec_id") % every == 0)
    split = max(1, -(-sum(parts.values()) * block // (every * queries)))
    asked = asked.select("vec_id", "v", "cell", "norm", "d", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(split)).alias("lot"))
    first = asked.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id", F.lit(3)), part).alias("part"), "lot", F.lit(float("-inf")).alias("floor"))

    def group(keys, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(np.int64)
        q, x = (np.frombuffer(b"".join(t.v)).reshape(len(t), -1) for t in (left, right))
        at, ids, scores = search_block(q, left.vec_id.to_numpy(), left.floor.to_numpy(), x, right.vec_id.to_numpy(), points, k)
        return pd.DataFrame({"query_id": left.vec_id.to_numpy()[at], "vec_id": ids, "score": scores})

    lots = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(split - 1).cast("long")))

    def meet(ask: DataFrame) -> DataFrame:
        places = ["cell", "part", "lot"]
        return ask.groupBy(*places).cogroup(cand.withColumn("lot", lots).groupBy(*places)).applyInPandas(group, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    begun = cut(meet(first))
    floor = begun.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    asked = asked.join(floor, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))

    def onward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            d, norm, floor = np.array(x.d.tolist()), x.norm.to_numpy(), x.floor.to_numpy()
            apart = np.zeros((len(x), len(cells)))
            for p in range(len(points)):
                np.maximum(apart, np.maximum(low[None, :, p] - d[:, p, None], d[:, p, None] - high[None, :, p]), out=apart)
            top = (norm[:, None] + spans.norm.to_numpy()[None, :] - apart**2) / 2
            top += 1e-9 * (np.abs(top) + norm[:, None] + spans.norm.to_numpy()[None, :]) + 1e-6
            r, c = np.nonzero(top >= floor[:, None])
            yield pd.DataFrame({"vec_id": x.vec_id.to_numpy()[r], "v": x.v.to_numpy()[r], "cell": cells[c].astype(np.int32), "lot": x.lot.to_numpy()[r], "floor": floor[r]})

    second = asked.mapInPandas(onward, "vec_id long, v binary, cell int, lot long, floor double")
    second = second.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), part - 1)))
    found = begun.unionByName(meet(second)).distinct()  # what was found at first is found again
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
