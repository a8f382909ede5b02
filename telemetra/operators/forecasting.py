"""Forecast windows, model runs and their selection; an LSTM in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetra.functions.bins import BLOCK, inside, rank, row_bins
from telemetra.functions.scalars import EPS
from telemetra.operators.detectors import Recurrent
from telemetra.operators.evaluate import binary_metrics
from telemetra.operators.labels import best_of


def forecast_windows(df: DataFrame, segment: str, order: str, sensors: list[str], length: int, horizon: int, stride: int = 1, block: int = BLOCK) -> DataFrame:
    """Per segment, every `stride` rows: the last `length` rows' sensors as `inputs` and each sensor `horizon` rows ahead as
    `targets`. Windows that leave the segment are not made."""
    df = row_bins(df, [segment], [order], length - 1 + horizon, block)
    w = inside([segment], [order])
    row = F.array(*(F.col(s).cast("double") for s in sensors))
    # made at the target's row, which looks back only
    out = df.withColumn("_n", rank([segment], [order]) - horizon).withColumn("inputs", F.collect_list(row).over(w.rowsBetween(1 - length - horizon, -horizon)))
    out = out.withColumns({"targets": row, "input_end": F.lag(order, horizon).over(w), "target_at": F.col(order)})
    out = out.where(F.col("_own") & (F.col("_n") >= length) & (F.pmod(F.col("_n") - length, F.lit(stride)) == 0))
    return out.select(segment, "input_end", "target_at", "inputs", "targets")


def sensor_scale(df: DataFrame, sensors: list[str], fit) -> DataFrame:
    """df with each sensor scaled by mean and deviation of the rows that `fit` holds for."""
    stats = df.where(fit).agg(*(F.avg(s).alias(f"_m_{s}") for s in sensors), *(F.stddev_pop(s).alias(f"_s_{s}") for s in sensors))
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({s: (F.col(s) - F.col(f"_m_{s}")) / F.when(F.col(f"_s_{s}") <= EPS, 1.0).otherwise(F.col(f"_s_{s}")) for s in sensors}).drop(*stats.columns)


def long_predictions(df: DataFrame, keys: list[str], truth: list[str], predicted: list[str], sensors: list[str]) -> DataFrame:
    """Wide rows as (keys, sensor, y_true, y_pred, absolute_error)."""
    parts = F.array(*(F.struct(F.lit(s).alias("sensor"), F.col(t).cast("double").alias("y_true"), F.col(p).cast("double").alias("y_pred")) for s, t, p in zip(sensors, truth, predicted, strict=True)))
    return df.select(*keys, F.explode(parts).alias("_s")).select(*keys, "_s.*").withColumn("absolute_error", F.abs(F.col("y_true") - F.col("y_pred")))


def run_models(df: DataFrame, models: dict[str, Callable[[DataFrame], DataFrame]], keys: list[str]) -> DataFrame:
    """Mean absolute and root mean squared error of each model, split and key; a model adds y_pred to rows that have y_true and split."""
    parts = [f(df).select(*keys, "split", "y_true", "y_pred", F.lit(name).alias("model")) for name, f in models.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    e = F.abs(F.col("y_true") - F.col("y_pred"))
    return rows.where("y_true is not null and y_pred is not null").groupBy("model", "split", *keys).agg(F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("n"))


def select_model(metrics: DataFrame, keys: list[str], by: str = "rmse") -> DataFrame:
    """The model with the least validation error for each key, ties by name, with its test error as `test_<by>`."""
    best = best_of(metrics.where("split = 'validation'"), keys, [F.round(by, 9), F.col("model")])
    test = metrics.where("split = 'test'").select("model", *keys, F.col(by).alias(f"test_{by}"))
    return best.join(test, ["model", *keys], "left")


def select_tree(results: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate with the best validation F1, then precision, recall, fewest false positives, name."""
    return best_of(results.where("split = 'validation'"), keys, [F.desc(F.round("f1", 9)), F.desc(F.round("precision", 9)), F.desc(F.round("recall", 9)), F.round("fpr", 9), F.col("model")])


def threshold_rows(scored: DataFrame, y: str, score: str, grid: list[float]) -> DataFrame:
    """Per split and threshold of a grid: warnings and metrics."""
    rows = scored.select("split", F.col(y).alias("y"), F.explode(F.array(*map(F.lit, grid))).alias("threshold"), F.col(score).alias("s"))
    return binary_metrics(rows.withColumn("p", (F.col("s") >= F.col("threshold")).cast("int")), ["split", "threshold"], "y", "p")


def machine_windows(df: DataFrame, entity: str, order: list[str], length: int, train: float = 0.8) -> DataFrame:
    """df with `part` fit or check: the first floor(n * train) rows of an entity, between `length` and n - `length` of them."""
    w = Window.partitionBy(entity)
    n = F.count("*").over(w)
    cut = F.least(F.greatest(F.floor(n * train), F.lit(length)), n - length)
    out = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_cut": cut})
    return out.withColumn("part", F.when(F.col("_i") < F.col("_cut"), "fit").otherwise("check")).drop("_i", "_cut")


class Forecaster(Recurrent):
    """An LSTM that reads a window and gives the next values instead of the window itself."""

    def fit_to(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        self.y = None
        p = self.start(y.shape[1])
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        t = 0
        for _ in range(self.epochs):
            order = self.rng.permutation(len(x))
            for at in range(0, len(x), 64):
                own, t = order[at : at + 64], t + 1
                for k, g in self.slopes_to(p, x[own], y[own]).items():
                    a, b = m[k]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g**2 - b)
                    p[k] -= self.rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return p

    def slopes_to(self, p: dict, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, seen = self._steps(p, x)
        d = 2 * (h @ p["v"] + p["c"] - y) / y.size
        out = {"v": h.T @ d, "c": d.sum(0), "w": np.zeros_like(p["w"]), "b": np.zeros_like(p["b"])}
        dh, dc = d @ p["v"].T, np.zeros_like(h)
        for z, i, f, o, n, before, c in reversed(seen):
            dc = dc + dh * o * (1 - np.tanh(c) ** 2)
            g = np.concatenate([dc * n * i * (1 - i), dc * before * f * (1 - f), dh * np.tanh(c) * o * (1 - o), dc * i * (1 - n**2)], 1)
            out["w"] += z.T @ g
            out["b"] += g.sum(0)
            dh, dc = (g @ p["w"].T)[:, 1:], dc * f
        return out


def lstm_forecasts(windows: DataFrame, keys: list[str], inputs: str, target: str, fit: str, most: int = 4096, **settings) -> DataFrame:
    """Windows (keys, inputs array, target, fit 0/1) with `y_pred` of one LSTM, pooled over all keys.

    It is fitted on the driver on at most `most` windows with fit = 1, those with the least hash of the keys; every window
    is scored where it is. Values are scaled by the fitting windows.
    """
    train = windows.where(F.col(fit) == 1).orderBy(F.xxhash64(*keys), *keys).limit(most).select(inputs, target).toPandas()
    x, y = np.array(train[inputs].tolist(), float), train[target].to_numpy(float)[:, None]
    mean, sd = (x.mean(), x.std() or 1.0) if len(x) else (0.0, 1.0)
    model = Forecaster(**settings)
    p = model.fit_to((x - mean) / sd, (y - mean) / sd) if len(x) else None

    def predict(batches):
        for b in batches:
            if p is None or not len(b):
                yield b.assign(y_pred=None)
            else:
                yield b.assign(y_pred=model.run(p, (np.array(b[inputs].tolist(), float) - mean) / sd)[1][:, 0] * sd + mean)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in windows.select(*keys, inputs, target).schema)
    return windows.select(*keys, inputs, target).mapInPandas(predict, f"{schema}, y_pred double")


def importances(model, names: list[str]) -> pd.DataFrame:
    """(feature, importance) of a fitted pipeline's last stage: a tree's importances, or absolute coefficients."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else np.abs(last.coefficients.toArray())
    return pd.DataFrame({"feature": [names[i] if i < len(names) else f"category_{i - len(names)}" for i in range(len(values))], "importance": values}).sort_values(["importance", "feature"], ascending=[False, True], ignore_index=True)
