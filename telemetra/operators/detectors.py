"""Detectors and ensembles of scores: rolling and per-feature deviations, autoencoders, ensembles, evaluation over models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.bins import same_keys
from telemetra.functions.scalars import EPS, safe_divide
from telemetra.functions.tables import settled
from telemetra.operators.evaluate import average_precision, binary_metrics, ecdf
from telemetra.operators.labels import best_of
from telemetra.operators.windows import runs

#: Training windows of an entity that an autoencoder is fitted on at most: those with the least hash of (entity, window).
FIT_WINDOWS = 4096


def rolling_z_score(df: DataFrame, threshold: float) -> DataFrame:
    """Rows of windows.causal_rolling with `score`, the long rolling deviation (0 where unknown), and `predicted`."""
    score = F.abs(F.coalesce("rolling_zscore_long", F.lit(0.0)))
    return df.withColumn("score", score).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def feature_z_scores(df: DataFrame, entity: str, features: list[str], fit: Column) -> DataFrame:
    """`scores`, each feature's distance from the entity's fitted mean in its deviations, and `score`, the greatest of them."""
    stats = df.where(fit).groupBy(entity).agg(*(F.avg(f).alias(f"_m_{f}") for f in features), *(F.stddev_pop(f).alias(f"_s_{f}") for f in features))
    one = lambda f: F.abs((F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") <= EPS, 1.0).otherwise(F.col(f"_s_{f}")))
    out = df.join(settled(stats), entity).withColumn("scores", F.array(*map(one, features)))
    return out.withColumn("score", F.array_max("scores")).drop(*(f"_m_{f}" for f in features), *(f"_s_{f}" for f in features))


def top_features(df: DataFrame, features: list[str], keys: list[str], score: str = "score", scores: str = "scores", k: int = 3, most: int = 200) -> DataFrame:
    """The k features with the highest scores of each of the `most` rows with the highest scores: (keys, feature, feature_score, position)."""
    top = df.orderBy(F.desc(score), *keys).limit(most)
    pairs = F.transform(F.col(scores), lambda x, i: F.struct((-x).alias("_n"), F.get(F.array(*map(F.lit, features)), i).alias("feature"), x.alias("feature_score")))
    rows = top.select(*keys, F.posexplode(F.slice(F.sort_array(pairs), 1, k)).alias("position", "_p"))
    return rows.select(*keys, "_p.feature", "_p.feature_score", (F.col("position") + 1).alias("position"))


def feature_mentions(top: DataFrame, keys: list[str]) -> DataFrame:
    """How often each feature is among the top ones, and its mean score there."""
    return top.groupBy(*keys, "feature").agg(F.count("*").alias("mentions"), F.avg("feature_score").alias("mean_score"))


def ensemble(df: DataFrame, keys: list[str], a: str, b: str, fit: Column, threshold: float = 0.99) -> DataFrame:
    """`ensemble`: the greater of two scores' shares of fitted rows at or below them; `predicted` from the threshold on."""
    out = ecdf(df, keys, a, fit).withColumnRenamed("ecdf", "_a")
    out = ecdf(out, keys, b, fit).withColumnRenamed("ecdf", "_b")
    return out.withColumn("ensemble", F.greatest("_a", "_b")).withColumn("predicted", (F.col("ensemble") >= threshold).cast("int")).drop("_a", "_b")


def evaluate_scores(df: DataFrame, keys: list[str], y: str, score: str, threshold: Column) -> DataFrame:
    """Per key the metrics of score >= threshold (a column of each row)."""
    return binary_metrics(df.withColumn("_p", (F.col(score) >= threshold).cast("int")), keys, y, "_p")


def global_metrics(df: DataFrame, keys: list[str], y: str, predicted: str) -> DataFrame:
    """Metrics over all entities for each key, best first by (F1, recall, fewer false positives): `position`."""
    out = binary_metrics(df, keys, y, predicted)
    order = Window.orderBy(F.desc(F.round("f1", 9)), F.desc(F.round("recall", 9)), F.round("fpr", 9), *keys)  # a row for each model
    return out.withColumn("position", F.row_number().over(order))


def strategies(df: DataFrame, y: str, score: str, thresholds: dict[str, float]) -> DataFrame:
    """Metrics at several named thresholds, in one pass over the rows."""
    named = F.array(*(F.struct(F.lit(k).alias("strategy"), F.lit(float(t)).alias("threshold")) for k, t in thresholds.items()))
    rows = df.select(F.col(y).alias("y"), F.col(score).alias("s"), F.explode(named).alias("_t")).select("y", "s", "_t.*")
    return binary_metrics(rows.withColumn("p", (F.col("s") >= F.col("threshold")).cast("int")), ["strategy"], "y", "p")


def agreement(df: DataFrame, entity: str, order: list[str], y: str, a: str, b: str) -> DataFrame:
    """Per entity how many true segments both detectors hit, one of them, or neither."""
    rows = runs(df, entity, order, F.coalesce(F.col(y) == 1, F.lit(False)))
    s = rows.groupBy(entity, "_from").agg(F.max(a).alias("a"), F.max(b).alias("b"))
    x, z = F.col("a") == 1, F.col("b") == 1
    out = s.groupBy(entity).agg(F.count_if(x & z).alias("both"), F.count_if(x & ~z).alias("only_a"), F.count_if(~x & z).alias("only_b"), F.count_if(~x & ~z).alias("neither"))
    return out.withColumn("jaccard", safe_divide(F.col("both"), F.col("both") + F.col("only_a") + F.col("only_b")))


def best_models(results: DataFrame, entity: str, model: str) -> DataFrame:
    """Per entity the model with the best F1, then recall, then fewest false positives, then name."""
    return best_of(results, [entity], [F.desc(F.round("f1", 9)), F.desc(F.round("recall", 9)), F.round("fpr", 9), F.col(model)])


def normal_only(windows: DataFrame, entity: str, label: str) -> DataFrame:
    """Windows without a labelled row; all windows of an entity that has no other."""
    free = windows.groupBy(entity).agg(F.max((F.col(label) == 0).cast("int")).alias("_free"))
    return same_keys(windows, free, [entity], "inner").where((F.col(label) == 0) | (F.col("_free") == 0)).drop("_free")


def labelled_entities(df: DataFrame, entity: str, label: str, most: int) -> DataFrame:
    """The first entities, by name, that have a labelled row."""
    return df.groupBy(entity).agg(F.sum(F.col(label).cast("long")).alias("positives")).where("positives > 0").orderBy(entity).limit(most)


def precision_of(df: DataFrame, y: str, score: str) -> DataFrame:
    return average_precision(df, y, score)


class Dense:
    """Autoencoder of one hidden layer on flattened windows: tanh, squared error, Adam, stops early on a held part."""

    def __init__(self, hidden: int = 8, epochs: int = 40, rate: float = 0.01, patience: int = 5, seed: int = 42):
        self.hidden, self.epochs, self.rate, self.patience, self.rng = hidden, epochs, rate, patience, np.random.default_rng(seed)

    def start(self, width: int) -> dict[str, np.ndarray]:
        k = min(self.hidden, width)
        return {"w": self.rng.normal(0, 1 / np.sqrt(width), (width, k)), "b": np.zeros(k), "v": self.rng.normal(0, 1 / np.sqrt(k), (k, width)), "c": np.zeros(width)}

    def run(self, p: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ p["w"] + p["b"])
        return h, h @ p["v"] + p["c"]

    def slopes(self, p: dict, x: np.ndarray) -> dict[str, np.ndarray]:
        h, out = self.run(p, x)
        d = 2 * (out - x) / x.size
        back = (d @ p["v"].T) * (1 - h**2)
        return {"w": x.T @ back, "b": back.sum(0), "v": h.T @ d, "c": d.sum(0)}

    def errors(self, p: dict, x: np.ndarray) -> np.ndarray:
        return (self.run(p, x)[1] - x) ** 2

    def fit(self, x: np.ndarray) -> dict[str, np.ndarray]:
        p = self.start(x.shape[1])
        held = x[:: max(2, len(x) // max(1, len(x) // 5))] if len(x) >= 10 else x
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        best, kept, waited, t = np.inf, {k: v.copy() for k, v in p.items()}, 0, 0
        for _ in range(self.epochs):
            order = self.rng.permutation(len(x))
            for at in range(0, len(x), 64):
                t += 1
                for k, g in self.slopes(p, x[order[at : at + 64]]).items():
                    a, b = m[k]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g**2 - b)
                    p[k] -= self.rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
            loss = self.errors(p, held).mean()
            if loss < best - 1e-6:
                best, kept, waited = loss, {k: v.copy() for k, v in p.items()}, 0
            else:
                waited += 1
                if waited >= self.patience:
                    break
        return kept


class Recurrent(Dense):
    """The same with an LSTM that reads a window step by step; its last state gives the whole window back. Gradients are exact."""

    def start(self, width: int) -> dict[str, np.ndarray]:
        k = self.hidden
        return {"w": self.rng.normal(0, 0.4, (1 + k, 4 * k)), "b": np.zeros(4 * k), "v": self.rng.normal(0, 1 / np.sqrt(k), (k, width)), "c": np.zeros(width)}

    def _steps(self, p: dict, x: np.ndarray):
        k = self.hidden
        h = c = np.zeros((len(x), k))
        seen = []
        for t in range(x.shape[1]):
            z = np.concatenate([x[:, t : t + 1], h], 1)
            g = z @ p["w"] + p["b"]
            i, f, o = (1 / (1 + np.exp(-np.clip(g[:, j * k : (j + 1) * k] + (j == 1), -30, 30))) for j in range(3))
            n = np.tanh(g[:, 3 * k :])
            before, c = c, f * c + i * n
            h = o * np.tanh(c)
            seen.append((z, i, f, o, n, before, c))
        return h, seen

    def run(self, p: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self._steps(p, x)[0]
        return h, h @ p["v"] + p["c"]

    def slopes(self, p: dict, x: np.ndarray) -> dict[str, np.ndarray]:
        h, seen = self._steps(p, x)
        d = 2 * (h @ p["v"] + p["c"] - x) / x.size
        out = {"v": h.T @ d, "c": d.sum(0), "w": np.zeros_like(p["w"]), "b": np.zeros_like(p["b"])}
        dh, dc = d @ p["v"].T, np.zeros_like(h)
        for z, i, f, o, n, before, c in reversed(seen):
            dc = dc + dh * o * (1 - np.tanh(c) ** 2)
            g = np.concatenate([dc * n * i * (1 - i), dc * before * f * (1 - f), dh * np.tanh(c) * o * (1 - o), dc * i * (1 - n**2)], 1)
            out["w"] += z.T @ g
            out["b"] += g.sum(0)
            dh, dc = (g @ p["w"].T)[:, 1:], dc * f
        return out


def autoencoder_scores(windows: DataFrame, entity: str, values: str, fit: str, kind: str = "dense", fit_windows: int = FIT_WINDOWS, **settings) -> DataFrame:
    """Windows (entity, end_index, values, fit 0/1) with `score`, the mean squared error of giving the window back, and
    `step_scores`, that of each of its steps, by a model fitted on the entity's windows with fit = 1.

    An entity's model is fitted in one task on at most fit_windows windows; all windows are scored where they are. Values
    are scaled by the fitting windows. Entities without fitting windows have null scores.
    """
    take = Window.partitionBy(entity).orderBy(F.xxhash64(entity, "end_index"), "end_index")
    train = windows.where(F.col(fit) == 1).withColumn("_r", F.row_number().over(take)).where(F.col("_r") <= fit_windows)
    names = ("w", "b", "v", "c")

    def learn(own: pd.DataFrame) -> pd.DataFrame:
        x = np.array(own[values].tolist(), float)
        mean, sd = x.mean(), x.std() or 1.0
        model = (Dense if kind == "dense" else Recurrent)(**settings)
        p = model.fit((x - mean) / sd)
        return pd.DataFrame({entity: own[entity].iloc[:1], "_p": [[p[k].ravel().tolist() for k in names]], "_shape": [[list(p[k].shape) for k in names]], "_mean": mean, "_sd": sd})

    kind_of = windows.schema[entity].dataType.simpleString()
    models = train.select(entity, values).groupBy(entity).applyInPandas(learn, f"{entity} {kind_of}, _p array<array<double>>, _shape array<array<int>>, _mean double, _sd double")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = pd.DataFrame({c: x[c] for c in (entity, "end_index")}).assign(score=None, step_scores=None)
            for _, own in x[x._sd.notna()].groupby(entity):
                first = own.iloc[0]
                p = {k: np.array(v).reshape([int(n) for n in s]) for k, v, s in zip(names, first._p, first._shape, strict=True)}
                e = (Dense if kind == "dense" else Recurrent)(**settings).errors(p, (np.array(own[values].tolist(), float) - first._mean) / first._sd)
                out.loc[own.index, "score"] = e.mean(1)
                out.loc[own.index, "step_scores"] = pd.Series(e.tolist(), index=own.index)
            yield out

    rows = windows.select(entity, "end_index", values).join(models, entity, "left")
    return rows.mapInPandas(score, f"{entity} {kind_of}, end_index long, score double, step_scores array<double>")
