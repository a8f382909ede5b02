"""Frames of time against a plain reading of them, with ties, missing and unlimited numbers."""

import math
import random
from datetime import datetime, timedelta

import pytest

from telemetra.operators import evidence, windows

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    out = [(i, r.choice("ab"), r.choice([None, *range(200)]) if i % 50 == 0 else r.randrange(200), r.choice([None, 0.5, 1.25, 3.0, -8.0])) for i in range(400)]
    out += [(500, "odd", 1, math.nan), (501, "odd", 2, 1.0), (502, "odd", 30, math.inf), (503, "odd", 31, -math.inf), (504, "odd", 90, None)]
    at = lambda s: None if s is None else START + timedelta(seconds=s)
    return [(i, k, at(s), v) for i, k, s, v in out]


def frame(df):
    return df.orderBy("id").collect()


def equal(a, b):
    return (a is None and b is None) or (a is not None and b is not None and ((a != a and b != b) or a == b or abs(a - b) < 1e-9))


def test_time_rolling_equals_a_plain_reading(spark, rows):
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v double")
    out = windows.time_rolling(df, "k", "ts", "v", 20)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()  # Spark's sliding frames read every row of a frame again
    big = lambda x: (x != x, x)  # noqa: E731  NaN is the greatest
    for r in frame(out):
        own = [(t, v) for _, k, t, v in rows if k == r.k and (t is None) == (r.ts is None) and (t is None or timedelta(0) <= r.ts - t < timedelta(seconds=20)) and v is not None]
        values = [v for _, v in own]
        assert r.n_window == len(values)
        assert equal(r.mean_window, sum(values) / len(values) if values else None)
        assert equal(r.min_window, min(values, key=big, default=None)) and equal(r.max_window, max(values, key=big, default=None))
    assert len(frame(out)) == len(rows)


def test_trends_equal_a_plain_reading(spark, rows):
    once = list({(k, t): (i, k, t, v) for i, k, t, v in rows if t is not None and k != "odd"}.values())  # the first of a time is open
    df = spark.createDataFrame(once, "id long, k string, ts timestamp_ntz, v double")
    ranges = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, sd double")
    got = {r.id: r.change for r in evidence.trend_signals(df, ranges, "k", "ts", "v", 20, 0.0).collect()}
    wanted = {}
    for i, k, t, v in once:
        own = sorted((u, x) for _, q, u, x in once if q == k and timedelta(0) <= t - u <= timedelta(seconds=20) and x is not None)
        if len(own) >= 3 and v is not None:
            wanted[i] = v - own[0][1]
    assert got == wanted and len(got) > 50
