"""Operator 3: text quality by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetra.llm.common import remainder
from telemetra.llm.words import WHITE, fingerprints, join, portions, word_spans

#: Labelled rows that the model is fitted on, for each label at most, and bytes of their texts.
ROWS_PER_LABEL, FIT_BYTES = 4000, 32 << 20
BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, DEPTH = 64, 16, 120, 60, 6, 0.15, 3

_kinds = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:", "shout": b"!?", "bar": b"|<>{}[]=\\/", "symbol": b"#$%&*@^~_+", "line": b"\n\r"}
_CLASS = np.zeros(256, np.int64)
for _k, _v in enumerate(_kinds.values(), 1):
    _CLASS[list(_v)] = _k
_CLASS[128:] = len(_kinds) + 1
FEATURES = [*_kinds, "wide", "bytes", "words", "mean_length", "sd_length", "short", "long", "distinct", "again", "top", "white", "runs"]


def features(texts: list[bytes]) -> np.ndarray:
    """One row of numbers for each text, of the text alone; an empty text gives zeros."""
    data, bounds = join(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    if not len(texts):
        return out
    size = np.diff(bounds) - 1
    n = np.maximum(size, 1)
    kind = _CLASS[data]
    doc = np.repeat(np.arange(len(texts)), size + 1)
    count = np.bincount(doc * 16 + kind, minlength=16 * len(texts)).reshape(-1, 16)
    out[:, : len(_kinds) + 1] = count[:, 1 : len(_kinds) + 2] / n[:, None]
    starts, ends = word_spans(data)
    at = np.searchsorted(starts, bounds)
    m, words = np.diff(at), np.maximum(np.diff(at), 1)
    owner, length = np.repeat(np.arange(len(texts)), m), (ends - starts).astype(np.float64)
    of = lambda x: np.bincount(owner, x, len(texts)) / words
    h = fingerprints(data, starts, ends, lower=True) if len(starts) else np.empty(0, np.uint64)
    mean = of(length)
    same = np.append(False, (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])) if len(h) else np.zeros(0, bool)
    order = np.lexsort((h, owner))
    first = np.flatnonzero(np.append(True, (np.diff(owner[order]) != 0) | (h[order][1:] != h[order][:-1]))) if len(h) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(h)))
    top = np.zeros(len(texts))
    np.maximum.at(top, owner[order][first], times)
    white = WHITE[data]
    twice = np.bincount(doc[1:][white[1:] & white[:-1]], minlength=len(texts)) if len(data) else 0
    rest = [np.log1p(size), np.log1p(m), mean, np.sqrt(np.maximum(of(length**2) - mean**2, 0)), of(length <= 3), of(length > 12), np.bincount(owner[order][first], minlength=len(texts)) / words, of(same), top / words, (np.bincount(doc[white], minlength=len(texts)) - 1) / n, twice / n]
    out[:, len(_kinds) + 1 :] = np.stack(rest, 1)
    return out


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int) -> np.ndarray:
    """A shallow tree over bins in order: the step for each bin."""
    def split(lo: int, hi: int, left: int) -> None:
        g, h = grad[lo:hi].sum(), hess[lo:hi].sum()
        out[lo:hi] = -g / (h + 1.0)
        if left and hi - lo > 1:
            a, b = np.cumsum(grad[lo:hi])[:-1], np.cumsum(hess[lo:hi])[:-1]
            gain = a**2 / (b + 1.0) + (g - a) ** 2 / (h - b + 1.0)
            k = int(gain.argmax())
            if gain[k] > g**2 / (h + 1.0) + 1e-9:
                split(lo, lo + k + 1, left - 1)
                split(lo + k + 1, hi, left - 1)

    out = np.zeros(len(grad))
    split(0, len(grad), depth)
    return out


@dataclass
class Additive:
    """Lookup tables: one for each feature's bins, one for each chosen pair's coarse bins."""

    edges: list[np.ndarray]
    tables: np.ndarray
    intercept: float
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: np.ndarray | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def margin(self, b: np.ndarray) -> np.ndarray:
        out = self.intercept + self.tables[np.arange(b.shape[1]), b].sum(1)
        for k, (i, j) in enumerate(self.pairs):
            out = out + self.pair_tables[k, b[:, i] * COARSE // BINS, b[:, j] * COARSE // BINS]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Additive:
    """Cyclic boosting: each round gives each feature one shallow tree on what the others leave; then the pairs.
    A row counts as weight rows in the loss."""
    weight = np.ones(len(y)) if weight is None else weight
    rate = np.clip(np.average(y, weights=weight) if len(y) else 0.5, 1e-3, 1 - 1e-3)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0) for k in range(x.shape[1])]
    model = Additive(edges, np.zeros((x.shape[1], BINS)), float(np.log(rate / (1 - rate))))
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    f = model.margin(b)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return weight * (p - y), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(x.shape[1]):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[:, k], g, BINS), np.bincount(b[:, k], h, BINS), DEPTH)
            model.tables[k] += step
            f += step[b[:, k]]
    c = b * COARSE // BINS
    g, h = slopes()

    def grid(i: int, j: int, z: np.ndarray) -> np.ndarray:
        return np.bincount(c[:, i] * COARSE + c[:, j], z, COARSE * COARSE).reshape(COARSE, COARSE)

    gains = {(i, j): (grid(i, j, g) ** 2 / (grid(i, j, h) + 5.0)).sum() for i in range(x.shape[1]) for j in range(i)}
    model.pairs = sorted(gains, key=gains.get, reverse=True)[:PAIRS]
    model.pair_tables = np.zeros((len(model.pairs), COARSE, COARSE))
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            gg, hh = grid(i, j, g), grid(i, j, h)
            a, t = np.cumsum(gg.sum(1))[:-1], np.cumsum(hh.sum(1))[:-1]
            cut_ = int((a**2 / (t + 1) + (gg.sum() - a) ** 2 / (hh.sum() - t + 1)).argmax()) + 1
            step = np.empty((COARSE, COARSE))
            step[:cut_] = _tree(gg[:cut_].sum(0), hh[:cut_].sum(0), 1)
            step[cut_:] = _tree(gg[cut_:].sum(0), hh[cut_:].sum(0), 1)
            model.pair_tables[k] += RATE * step
            f += RATE * step[c[:, i], c[:, j]]
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows_per_label: int, digest, most_bytes: int = FIT_BYTES) -> pd.DataFrame:
    """(data, y, weight) of labelled rows outside the held-out fold: of each label at most so many rows and bytes of text, by hash
    order of the id (the first one whatever its size). A document with two labels has the greater one, one with two
    texts each of them. The weight is the number of labelled rows that a row stands for, so that the limits leave the
    share of a label as it is. data is what `digest` makes of a text, in the executors: the driver gets no texts."""
    own = labels.where(F.col(label).isin(0, 1) & (remainder(modulus) != held)).where("doc_id is not null").groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = own.where("y = 0").orderBy(*order).limit(rows_per_label).unionByName(own.where("y = 1").orderBy(*order).limit(rows_per_label))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")  # two times rows_per_label ids at most
    before = Window.partitionBy("y").orderBy(*order, "text").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns({"_n": F.count("*").over(before), "_bytes": F.sum(F.octet_length("text") + 1).over(before)})
    found = found.where((F.col("_n") == 0) | ((F.col("_n") < rows_per_label) & (F.col("_bytes") + F.octet_length("text") <= most_bytes))).select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            data = [x for p in portions(texts) for x in digest(texts[p])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), batch.column(2)], names=["doc_id", "data", "y"])

    found = found.mapInArrow(run, "doc_id long, data binary, y int").toPandas()
    found = found.sort_values(["doc_id", "data"], kind="stable").reset_index(drop=True)
    taken = found.y.value_counts().to_dict()
    share = {r.y: r["count"] / taken[r.y] for r in own.groupBy("y").count().collect() if r.y in taken}
    return pd.DataFrame({"data": found.data, "y": found.y.astype(int), "weight": found.y.map(share).astype(float)})


def train(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> Additive:
    """Fits on labels.quality of rows whose crc32 remainder by 5 is not 0."""
    sample = labelled(docs, labels, "quality", 5, 0, rows_per_label, lambda texts: [x.tobytes() for x in features(texts)])
    x = np.frombuffer(b"".join(sample.data)).reshape(-1, len(FEATURES))
    return fit(x, sample.y.to_numpy(np.float64), sample.weight.to_numpy())


def scored(docs: DataFrame, score, id_column: str = "doc_id", text_column: str | None = "text") -> DataFrame:
    """(id, score) by a function of a list of UTF-8 texts; null counts as empty. Without a text column the id is a struct that has the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1) if text_column else batch.column(0).field("text")
            texts = [(t or "").encode() for t in column.to_pylist()]
            parts = [score(texts[p]) for p in portions(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*parts, np.empty(0)]), pa.float64())], names=["id", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, *([text_column] if text_column else [])).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_column)


def score_quality(docs: DataFrame, model: Additive, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    The score is a sum of table entries, found by adding bins for whole batches; inputs are counts over the whole
    text alone. Null and empty texts have the features of an empty text. Repeated rows score alike; rows without an id
    are not held out; further columns are not read; an empty table gives an empty result.
    """
    out = scored(docs, lambda texts: model.score(features(texts)))
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
