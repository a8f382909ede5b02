"""Frames of time over rows of any density: a frame's figures cost no more with more rows in it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.functions.ranks import time_framed


def least_of(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high] for each pair of bounds, which hold a value at least: two overlapping runs of a power of two."""
    out, size = np.empty(len(low), values.dtype), high - low
    level = np.frexp(size)[1] - 1
    runs = values
    for k in range(int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(runs[low[at]], runs[high[at] - (1 << k)])
        runs = np.minimum(runs[: -(1 << k)], runs[1 << k :])
    return out


class Frames:
    """The rows of a slice in the order of time with, for each row, the bounds of its frame: rows at most so long before it, up
    to its equals; rows without a time are each other's frame."""

    def __init__(self, us: np.ndarray, values: np.ndarray, known: np.ndarray):
        self.us, self.values, self.known = us, values, known

    def bounds(self, back: int) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.us, self.us - back, "left"), np.searchsorted(self.us, self.us, "right")

    def count(self, low: np.ndarray, high: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(self.known if which is None else which)])
        return upto[high] - upto[low]

    def total(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Sums of the known values, in long doubles; NaN and the infinities count as such in the frames that hold them alone."""
        v = np.where(self.known & np.isfinite(self.values), self.values, 0.0).astype(np.longdouble)
        upto = np.concatenate([[0], np.cumsum(v)])
        out = (upto[high] - upto[low]).astype(float)
        if not np.isfinite(self.values[self.known]).all():
            up, down, nan = (self.count(low, high, self.known & x) > 0 for x in (self.values == np.inf, self.values == -np.inf, np.isnan(self.values)))
            out[up], out[down], out[nan | (up & down)] = np.inf, -np.inf, np.nan
        return out

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """NaN is greater than any number."""
        v = np.where(self.known, self.values, np.nan)
        out = least_of(np.where(np.isnan(v), np.inf, v), low, high)
        return np.where((out == np.inf) & (self.count(low, high, self.known & ~np.isnan(self.values)) == 0), np.nan, out)

    def greatest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        v = np.where(self.known & ~np.isnan(self.values), -self.values, np.inf)
        return np.where(self.count(low, high, self.known & np.isnan(self.values)) > 0, np.nan, -least_of(v, low, high))

    def first_known(self) -> np.ndarray:
        """For each place the place of the first known value from there on; the number of rows where there is none."""
        at = np.where(self.known, np.arange(len(self.us)), len(self.us))
        return np.append(np.minimum.accumulate(at[::-1])[::-1], len(self.us))


def framed(df: DataFrame, keys: list[str], ts: str, value: str, seconds: int, figures: Callable[[Frames], dict[str, pa.Array]], schema: str) -> DataFrame:
    """df with the columns of `schema`, as figures(Frames) gives them for each slice of a key's time, a task's unit (see time_framed)."""
    rows = time_framed(df, keys, ts, seconds).withColumn("_value", F.col(value).cast("double"))
    kept = [c for c in rows.columns if c not in ("_us", "_slice", "_own", "_value")]

    def run(t: pa.Table) -> pa.Table:
        us = t.column("_us").combine_chunks()
        t = t.take(pa.array(np.argsort(us.fill_null(np.iinfo(np.int64).min // 2).to_numpy(zero_copy_only=False), kind="stable")))
        us, v = t.column("_us").combine_chunks(), t.column("_value").combine_chunks()
        known = ~v.is_null().to_numpy(zero_copy_only=False)
        own = figures(Frames(us.fill_null(np.iinfo(np.int64).min // 2).to_numpy(zero_copy_only=False), v.fill_null(np.nan).to_numpy(zero_copy_only=False), known))
        out = t.select(kept)
        for name, x in own.items():
            out = out.append_column(name, x)
        return out.filter(t.column("_own"))

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.groupBy(*keys, "_slice").applyInArrow(run, f"{types}, {schema}")
