"""Operator 6: toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetra.llm.common import cut, remainder
from telemetra.llm.quality import labelled, scored
from telemetra.llm.words import mix, words_of

#: Labelled rows that the model is fitted on, for each label at most.
ROWS_PER_LABEL = 5000
#: Every word has a row in each of two tables, so that words which share a row in one differ in the other.
SLOTS, DIM, FILTERS, WIDTHS, EPOCHS, BATCH = 1 << 16, 4, 6, (1, 2, 3), 12, 64
#: Calibration: the precision that a language's threshold has to reach, the labelled rows it takes, the threshold
#: otherwise, and the steps that scores are counted in.
PRECISION, LEAST, DEFAULT, STEPS = 0.9, 20, 0.7, 1000


def slots(words: np.ndarray) -> np.ndarray:
    """Rows of the two embedding tables, [word, 2], each counted from its table's start."""
    h = mix(words)
    return np.stack([h & np.uint64(SLOTS - 1), (h >> np.uint64(32)) & np.uint64(SLOTS - 1)], 1).astype(np.uint16)


def slots_of(texts: list[bytes]) -> list[bytes]:
    words, at = words_of(texts)
    own = slots(words)
    return [own[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]


def rows(own: np.ndarray) -> np.ndarray:
    """Rows of both tables as one."""
    return own.astype(np.int64) + np.array([0, SLOTS])


@dataclass
class Network:
    """Embeddings, filters of several widths with max pooling, and a dense layer."""

    table: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    last: np.ndarray

    def pooled(self, own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Maxima of each filter over each text, [text, filter]; a text shorter than a filter has the bias alone there."""
        n = len(at) - 1
        e = self.table[rows(own)].reshape(len(own), 2 * DIM)
        out, maps = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32), {}
        for k, w in enumerate(WIDTHS):
            part = out[:, k * FILTERS : (k + 1) * FILTERS]
            m = len(own) - w + 1
            ok = np.flatnonzero(np.diff(at) >= w)
            if m > 0 and len(ok):
                c = sum(e[j : j + m] @ self.filters[w][j] for j in range(w))
                cut_ = np.stack([at[ok], at[ok + 1] - w + 1], 1).ravel()
                top = np.maximum.reduceat(np.concatenate([c, np.full((1, FILTERS), -np.inf, np.float32)]), cut_, axis=0)[::2]
                part[ok] = top
                maps[w] = c
        out[~np.isfinite(out)] = 0
        return out + self.bias, maps

    def score(self, texts: list[bytes]) -> np.ndarray:
        words, at = words_of(texts)
        hidden = np.maximum(self.pooled(slots(words), at)[0], 0)
        return 1 / (1 + np.exp(-np.clip((hidden @ self.dense + self.last[0]).astype(np.float64), -30, 30)))


def start(docs: list[np.ndarray], y: np.ndarray) -> Network:
    """First dimension of a row: how much likelier texts with it are toxic, as smoothed log odds. The rest: small noise."""
    rng = np.random.default_rng(11)
    count = np.zeros((2, 2 * SLOTS))
    for d, label in zip(docs, y, strict=True):
        count[int(label), np.unique(rows(d))] += 1
    n0, n1 = max(1, (y == 0).sum()), max(1, (y == 1).sum())
    table = (rng.standard_normal((2 * SLOTS, DIM)) * 0.02).astype(np.float32)
    table[:, 0] = np.log((count[1] + 0.5 * n1 / (n0 + n1)) / (n1 + 0.5)) - np.log((count[0] + 0.5 * n0 / (n0 + n1)) / (n0 + 0.5))
    table[:, 0] *= np.minimum(1, count.sum(0) / 8)  # rows seen a few times tell little
    filters = {w: (rng.standard_normal((w, 2 * DIM, FILTERS)) * 0.2).astype(np.float32) for w in WIDTHS}
    for f in filters.values():
        f[:, [0, DIM]] = np.abs(f[:, [0, DIM]]) + 0.3 / len(f)
    size = len(WIDTHS) * FILTERS
    return Network(table, filters, np.full(size, -1.0, np.float32), np.full(size, 0.2, np.float32), np.array([-2.0], np.float32))


def first_maxima(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each run [begin, end) of rows and each column the first row that has the run's greatest value."""
    bounds = np.stack([begin, end], 1).ravel()
    closed = np.concatenate([values, np.full((1, values.shape[1]), -np.inf, values.dtype)])
    top = np.maximum.reduceat(closed, bounds, axis=0)[::2]
    owner = np.zeros(len(closed), np.int64)
    owner[begin[1:]] = 1
    owner = np.cumsum(owner)
    at = np.where(closed == top[owner], np.arange(len(closed))[:, None], len(closed))
    return np.minimum.reduceat(at, bounds, axis=0)[::2]


def fit(docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray | None = None) -> Network:
    """Adam on the logistic loss over texts given as their words' slots. Max pooling sends the gradient to one place for each text and filter.
    A row counts as weight rows in the loss; only ratios of weights matter."""
    weight = np.ones(len(y)) if weight is None else weight / weight.mean() if len(y) else weight
    net = start(docs, y)
    if not len(y) or y.min() == y.max():
        rate = np.clip(np.average(y, weights=weight) if len(y) else 0.0, 1e-3, 1 - 1e-3)
        net.dense[:] = 0
        net.last[:] = np.log(rate / (1 - rate))
        return net
    rng = np.random.default_rng(13)
    params = {"bias": net.bias, "dense": net.dense, "last": net.last, **{f"f{w}": f for w, f in net.filters.items()}}
    moments = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in params.items()}
    square = np.zeros(len(net.table), np.float32)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            at = np.cumsum([0, *(len(docs[i]) for i in own)])
            words = np.concatenate([docs[i] for i in own])
            pool, maps = net.pooled(words, at)
            words = rows(words)
            hidden = np.maximum(pool, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.dense + net.last[0], -30, 30)))
            d = (weight[own] * (p - y[own]) / len(own)).astype(np.float32)
            grad = {"last": np.array([d.sum()], np.float32), "dense": hidden.T @ d}
            back = d[:, None] * net.dense * (pool > 0)
            grad["bias"] = back.sum(0)
            hit, sums = [], []
            for j, w in enumerate(WIDTHS):
                g = np.zeros_like(net.filters[w])
                if w in maps:
                    some = np.flatnonzero(np.diff(at) >= w)
                    best = first_maxima(maps[w], at[some], at[some + 1] - w + 1)
                    b = back[some, j * FILTERS : (j + 1) * FILTERS]
                    t, f = np.nonzero(b)
                    if len(t):
                        where, b = best[t, f], b[t, f]
                        for i in range(w):
                            s = words[where + i]
                            np.add.at(g[i].T, f, net.table[s].reshape(len(s), -1) * b[:, None])
                            hit.append(s.ravel())
                            sums.append((net.filters[w][i].T[f] * b[:, None]).reshape(-1, DIM))
                grad[f"f{w}"] = g
            step += 1
            for name, param in params.items():
                m, v = moments[name]
                m += 0.1 * (grad[name] - m)
                v += 0.001 * (grad[name] ** 2 - v)
                param -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            if hit:  # rows of the tables: AdaGrad, only where there is a gradient
                r, which = np.unique(np.concatenate(hit), return_inverse=True)
                total = np.zeros((len(r), DIM), np.float32)
                np.add.at(total, which, np.concatenate(sums))
                square[r] += (total**2).sum(1)
                net.table[r] -= 0.05 * total / (np.sqrt(square[r])[:, None] + 1e-6)
    return net


def train(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> Network:
    """Fits on labels.toxic of rows whose crc32 remainder by 3 is not 1."""
    sample = labelled(docs, labels, "toxic", 3, 1, rows_per_label, slots_of)
    return fit([np.frombuffer(x, np.uint16).reshape(-1, 2) for x in sample.data], sample.y.to_numpy(np.float64), sample.weight.to_numpy())


def thresholds(scores: DataFrame, labels: DataFrame, precision: float = PRECISION, least: int = LEAST, default: float = DEFAULT) -> DataFrame:
    """(lang, threshold) from scores (doc_id, lang, score): the lowest of STEPS steps from which on the training fold's
    labelled rows of the language, all of them, reach the precision. default where fewer than `least` rows are labelled
    or no step does; languages without labelled rows, and null, have no row."""
    own = labels.where(F.col("toxic").isin(0, 1) & (remainder(3) != 1)).where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    seen = scores.where("lang is not null").join(own, "doc_id").groupBy("lang", F.floor(F.col("score") * STEPS).alias("step")).agg(F.count("*").alias("n"), F.sum("y").alias("toxic"))
    above = Window.partitionBy("lang").orderBy(F.desc("step"))  # STEPS + 1 rows of a language at most
    seen = seen.withColumns({"all": F.sum("n").over(above), "right": F.sum("toxic").over(above)})
    good = F.min(F.when(F.col("right") >= precision * F.col("all"), F.col("step") / STEPS))
    return seen.groupBy("lang").agg(F.when(F.sum("n") >= least, F.coalesce(good, F.lit(default))).otherwise(default).alias("threshold"))


def score_by_language(docs: DataFrame, labels: DataFrame, model: Network, threshold: float = DEFAULT) -> DataFrame:
    """score_toxicity's columns, then lang, lang_threshold (see thresholds) and flagged (1 if score >= lang_threshold).

    Every document is scored once and the scores are written, so that thresholds need the texts no second time. The
    language decides on flagged alone, never on a score; rows without a language have the threshold given here.
    """
    held = (remainder(3) == 1).alias("held_out")
    rows = scored(docs.select(F.struct("doc_id", "lang").alias("id"), "text"), model.score, "id").select("id.*", "score")
    rows = cut(rows)
    out = rows.join(thresholds(rows, labels, default=threshold), "lang", "left").withColumn("lang_threshold", F.coalesce("threshold", F.lit(threshold)))
    decided = lambda limit: (F.col("score") >= limit).cast("int")
    return out.select("doc_id", held, "score", decided(F.lit(threshold)).alias("predicted"), "lang", "lang_threshold", decided(F.col("lang_threshold")).alias("flagged"))


def score_toxicity(docs: DataFrame, model: Network, threshold: float = DEFAULT) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Null, empty and blank texts have no words and the network's constant score. Repeated rows score alike; rows without
    an id are not held out; further columns are not read; an empty table gives an empty result.
    """
    out = scored(docs, model.score)
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
