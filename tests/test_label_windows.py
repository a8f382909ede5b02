"""Windows of labels against a plain reading, in one bin and in many."""

import random
from datetime import datetime, timedelta

import pytest

from telemetra.operators import labels

START = datetime(2024, 1, 1)
at = lambda s: None if s is None else START + timedelta(seconds=s)


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "b", "c", None]), at(r.choice([None, *range(3000)]) if i % 40 == 0 else r.randrange(3000))) for i in range(400)]
    spans = [(k, r.choice(["a", "b", "none", None]), at(s), at(s + r.choice([-5, 0, 7, 7, 400]))) for k, s in enumerate(r.choices(range(3200), k=40))]
    spans += [spans[0], spans[1], (50, "a", rows[1][2], at(3100)), (51, "c", at(5000), at(6000))]
    points = [(e, t) for _, e, t in rows[::5]]
    make = spark.createDataFrame
    return rows, spans, points, make(rows, "id long, e string, ts timestamp_ntz"), make(spans, "window_id long, e string, start_ts timestamp_ntz, end_ts timestamp_ntz"), make(points, "e string, ts timestamp_ntz")


@pytest.mark.parametrize("block", [30, 10**6])
def test_labels_equal_a_plain_reading(tables, block):
    rows, spans, points, df, windows, spots = tables
    within = {i: e is not None and t is not None and any(e == w and a <= t <= b for _, w, a, b in spans) for i, e, t in rows}
    met = {e for i, e, _ in rows if within[i]}
    out = labels.label_observations(df, windows, spots, "e", "ts", block)
    assert out.columns == ["id", "e", "ts", "label"]
    assert {r.id: r.label for r in out.collect()} == {i: int(within[i] if e in met else None not in (e, t) and (e, t) in points) for i, e, t in rows}
    assert "explode" not in labels.label_observations(df, windows, spots, "e", "ts")._jdf.queryExecution().toString()  # no window is copied to its hours


@pytest.mark.parametrize("block", [30, 10**6])
def test_alignment_equals_a_plain_reading(tables, block):
    rows, spans, _, df, windows, _ = tables
    wanted = set()
    for k, e, a, b in set(spans):
        own = [t for _, x, t in rows if x == e and x is not None and t is not None]
        met = [t for t in own if a <= t <= b]
        times = spans.count((k, e, a, b))
        outside = not own or a < min(own) or b > max(own)
        wanted.add((e, k, a, b, len(met) * times, sum(t < b for t in met) * times, int(a in met), int(b in met), int(outside)))
    got = [tuple(r) for r in labels.window_alignment(df, windows, "e", "ts", block).collect()]
    assert len(got) == len(wanted) and set(got) == wanted


@pytest.mark.parametrize("width", [30, None])
def test_nearest_rows_equal_a_plain_reading(spark, tables, width):
    rows, _, _, df, _, _ = tables
    moments = [(e, at(s)) for e in ("a", "b", "none", None) for s in range(-40, 3100, 7)]
    wanted = set()
    for e, m in moments:
        own = [(abs(t - m), t, i) for i, x, t in rows if x == e and None not in (x, t) and abs(t - m) <= timedelta(seconds=20)]
        if own:
            wanted.add((e, m, min(own)[2], min(own)[0].total_seconds()))
    asked = spark.createDataFrame(moments + moments[:9], "e string, moment timestamp_ntz")
    out = labels.nearest_rows(df, asked, "e", "ts", 20, width)
    got = [(r.e, r.moment, r.id, r.away_seconds) for r in out.collect()]
    assert len(got) == len(wanted) > 100 and set(got) == wanted
