"""Keys cut into bins give what whole keys give."""

import random

import pytest
from pyspark.sql import functions as F

from telemetra.functions.bins import row_bins
from telemetra.operators import forecasting, models, windows

ORDER = ["ts", "id"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    out, t = [], 0
    for i in range(400):
        t += r.choice([0, 0, 20, 70, 70, 4000])
        if 200 < i < 230:
            t -= t % 60  # many rows of one minute
        out.append((r.choice(["hot", "hot", "hot", None, "b"]), t, i, r.choice([None, 0.5, 1.0, 3.0, 8.0]), r.choice([0, 1, 1, 1]), "ab"[i // 150 % 2]))
    out += [("hot", None, 900, 2.0, 1, "a"), ("alone", 5, 901, 2.0, 1, "a")]
    df = spark.createDataFrame(out, "e string, s long, id long, v double, y int, split string")
    return df.withColumn("ts", F.expr("timestamp_seconds(s)")).withColumn("state", F.col("y"))


CASES = {
    "causal": lambda d, b: windows.causal_rolling(d, "e", ORDER, "v", block=b),
    "windows": lambda d, b: windows.sequence_windows(d, "e", ORDER, "v", "y", 8, 3, block=b),
    "previous": lambda d, b: windows.event_sequences(d, "e", ORDER, ["v", "id"], block=b),
    "split": lambda d, b: windows.chronological_split(d, "e", ORDER, block=b),
    "runs": lambda d, b: windows.positive_segments(d, "e", ORDER, "y", block=b),
    # ordered by time alone: one row for each time
    "segments": lambda d, b: windows.temporal_segments(d.dropDuplicates(["e", "s"]), "e", "ts", 100, block=b),
    "split segments": lambda d, b: windows.split_segments(d.groupBy("e", "s", "ts").agg(F.min("split").alias("split")), "e", "ts", 100, block=b),
    "states": lambda d, b: windows.state_features(d.groupBy("e", "s", "ts").agg(F.min("state").alias("state")), "e", "ts", "state", 300, block=b),
    "episodes": lambda d, b: windows.warning_episodes(d, "e", "ts", "y", block=b),
    "quality": lambda d, b: windows.quality_flags(d, "e", "id", "s", "ts", block=b),
    "forecasts": lambda d, b: forecasting.forecast_windows(d, "e", "id", ["v", "y"], 4, 3, 2, block=b),
    "lagged": lambda d, b: models.lagged(d.na.fill(0.0, ["v"]), "e", ORDER, ["v"], 3, 2, "y", block=b)[0],
    "stratified": lambda d, b: models.stratified_split(d, "id", "v", block=b),
}


def plain(df):
    own = sorted(c for c in df.columns if c != "trend_short")
    return sorted(([str(round(x, 9) if isinstance(x, float) else x) for x in r] for r in df.select(*own).collect()))


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("block", [7])
def test_bins_equal_whole_keys(rows, name, block):
    cut, whole = CASES[name](rows, block), CASES[name](rows, 10**6)
    assert plain(cut) == plain(whole)
    if name == "causal":
        both = cut.select("id", F.col("trend_short").alias("a")).join(whole.select("id", "trend_short"), "id")
        assert both.count() == 402 and both.where("not (a <=> trend_short) and not (abs(a - trend_short) < 1e-9)").isEmpty()


def test_bins_are_cut(rows):
    out = row_bins(rows, ["e"], ORDER, 2, 20)
    own = out.where("_own")
    assert own.count() == 402 and own.where("e = 'hot'").select("_bin").distinct().count() > 5
    assert own.where("e is null").select("_bin").distinct().count() > 1
    assert out.where("not _own").groupBy("e", "_bin").count().where("count <> 2").isEmpty()


def test_no_rows(rows):
    for make in CASES.values():
        assert make(rows.where("false"), 3).count() == 0
