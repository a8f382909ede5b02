"""Cases that no table of the driver has: paths that lead out, unknown names, late rows, ties, gradients, hand-made incidents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemetra.functions import ranks, scalars
from telemetra.functions.spans import in_spans
from telemetra.operators import audit, detectors, evaluate, evidence, forecasting, incidents, series, text, windows
from telemetra.sources import catalog, sinks
from telemetra.streaming import twins


def test_paths_stay_inside(spark, tmp_path):
    root = str(tmp_path)
    assert sinks.within(root, f"{root}/a/b") == f"{root}/a/b"
    for bad in (f"{root}/../x", f"{root}/a/../../x", "/elsewhere", root):
        with pytest.raises(ValueError):
            sinks.within(root, bad)
    sinks.write_text(spark, f"{root}/a/old.txt", "x")
    sinks.reset(spark, root, f"{root}/a")
    assert list((tmp_path / "a").iterdir()) == []


def test_catalogue_errors():
    entries = [catalog.Collection("a", ("x",)), catalog.Collection("b", ("X",))]
    with pytest.raises(ValueError):
        catalog.alias_index(entries)
    with pytest.raises(KeyError):
        catalog.resolve(entries[:1], ["nothing"])


def test_frequencies_and_steps():
    assert scalars.frequency_seconds("5min") == 300 and scalars.horizon_steps(10, 120) == 5
    for bad in ((7, 120), (0, 60)):
        with pytest.raises(ValueError):
            scalars.horizon_steps(*bad)
    with pytest.raises(ValueError):
        scalars.frequency_seconds("soon")


def test_required_columns_and_split_guard(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    assert audit.require(df, ["k"]) is df
    with pytest.raises(ValueError, match="missing columns: w, z"):
        audit.require(df, ["z", "k", "w"])
    with pytest.raises(ValueError):
        windows.entity_split(df, "k", {"train": ["a"], "test": ["a"]})


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ranks_with_ties_nulls_and_one_value(spark, keys):
    rng = np.random.default_rng(5)
    rows = [(int(i % 3), float(v)) for i, v in enumerate(rng.integers(0, 40, 500))] + [(1, None), (2, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {tuple(r[x] for x in keys): (r.p, r.q) for r in ranks.percentiles(df, keys, "v", {"p": 0.5, "q": 0.93}, parts=4).collect()}
    for key, (p, q) in got.items():
        own = [v for k, v in rows if v is not None and (not keys or k == key[0])]
        assert np.allclose([p, q], np.quantile(own, [0.5, 0.93]))
    upto = ranks.running(df.where("v is not null"), keys, "v", {"n": F.lit(1)}, parts=4).collect()
    for r in upto:
        assert r.n == sum(1 for k, v in rows if v is not None and v <= r.v and (not keys or k == r.k))
    placed = ranks.numbered(df.where("v is not null").withColumn("id", F.monotonically_increasing_id()), keys, "v", ("id",), parts=4).collect()
    assert len({(tuple(r[x] for x in keys), r._index) for r in placed}) == 500


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_slices_are_cut_once(spark, keys):
    """Approximate quantiles of a cluster's shuffle differ from reading to reading, so no plan may compute them again."""
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("k"), (F.col("id") % 1009 / 7).alias("v"))
    plan = ranks.value_slices(df, keys, "v")._jdf.queryExecution().toString()
    assert "percentile_approx" not in plan and "ApproximatePercentile" not in plan
    placed = ranks.numbered(df, keys, "v", ("id",)).groupBy(*keys).agg(F.countDistinct("_index").alias("n"), (F.max("_index") + 1).alias("top")).collect()
    assert sum(r.n for r in placed) == sum(r.top for r in placed) == 5000


def test_rows_meet_the_figures_of_their_key_without_a_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"), F.expr("timestamp_seconds(id)").alias("ts"))
    ranges = df.groupBy("k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.min("v").alias("q01"), F.max("v").alias("q99"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (detectors.feature_z_scores(df, "k", ["v"], F.lit(True)), series.standardize(df, "k", "v", F.lit(True)), evidence.current_anomalies(df, ranges, "k", "v", 0.0)):
            assert out.count() == 1000
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeated_rows_keep_their_number_in_targets(spark):
    at = "cast('2024-01-05 05:00:00' as timestamp_ntz)"
    df = spark.sql(f"select {at} as ts, 1 as x union all select {at}, 1")
    events = spark.sql("select 'f' as failure_id, cast('2024-01-05 06:00:00' as timestamp_ntz) as start_ts, cast('2024-01-05 07:00:00' as timestamp_ntz) as end_ts")
    assert [(r.x, r.target, r.failure_id) for r in evaluate.failure_target(df, events, "ts", "2 hours").collect()] == [(1, 1, "f")] * 2


def test_closed_and_half_open_spans(spark):
    t = lambda x: f"cast('2024-01-01 {x}' as timestamp_ntz)"
    rows = spark.sql(f"select {t('01:00:00')} as ts union all select {t('03:00:00')}")
    spans = spark.sql(f"select {t('01:00:00')} as a, {t('03:00:00')} as b")
    assert in_spans(rows, spans, "ts", "a", "b").count() == 1 and in_spans(rows, spans, "ts", "a", "b", closed=True).count() == 2


@pytest.mark.parametrize("kind", [detectors.Dense, detectors.Recurrent])
def test_autoencoder_gradients(kind):
    rng = np.random.default_rng(2)
    model, x = kind(hidden=3), rng.normal(size=(4, 5))
    p = model.start(5)
    slopes = model.slopes(p, x)
    for name in p:
        for _ in range(5):
            at = tuple(int(rng.integers(n)) for n in p[name].shape)
            old = p[name][at]
            loss = []
            for step in (1e-5, -1e-5):
                p[name][at] = old + step
                loss.append(model.errors(p, x).mean())
            p[name][at] = old
            assert abs((loss[0] - loss[1]) / 2e-5 - slopes[name][at]) < 1e-6


@pytest.mark.parametrize("kind", ["dense", "lstm"])
def test_autoencoder_finds_odd_windows(spark, kind):
    t = np.arange(8)
    rows = [("a", i, np.sin(t + i).tolist(), 1) for i in range(200)] + [("a", 900, [6.0, -6.0] * 4, 0), ("b", 1, [0.0] * 8, 0)]
    df = spark.createDataFrame(rows, "entity string, end_index long, values array<double>, fit int")
    out = detectors.autoencoder_scores(df, "entity", "values", "fit", kind, hidden=4, epochs=30).toPandas().set_index(["entity", "end_index"]).score
    assert len(out) == 202 and out[("b", 1)] is None or np.isnan(out[("b", 1)])
    assert out[("a", 900)] > 5 * out["a"].drop(900).max()


def test_lstm_forecasts_learn_a_line(spark):
    rows = [(i, [float(i + k) / 50 for k in range(4)], float(i + 4) / 50, int(i < 80)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double, fit int")
    got = forecasting.lstm_forecasts(df, ["id"], "x", "y", "fit", epochs=60, hidden=6).toPandas()
    assert len(got) == 100 and (got.y - got.y_pred).abs().mean() < 0.3


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    for k, times in enumerate((["2024-01-01 10:00:00", "2024-01-01 12:00:00"], ["2024-01-01 09:00:00", "2024-01-01 11:30:00"])):
        spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        import time

        time.sleep(1.1 * (k == 0))
    twins.with_late(twins.stream(spark, f"{tmp_path}/in", files_per_batch=1), 3600, f"{tmp_path}/on", f"{tmp_path}/late")
    assert spark.read.parquet(f"{tmp_path}/on").count() == 3 and spark.read.parquet(f"{tmp_path}/late").count() == 1


def test_visible_text_of_a_page(spark):
    page = "<title>T &amp; t</title><style>x</style><p>one<b>two</b></p><ul><li>a<li>b</ul><br>end<noscript>no</noscript><meta name='version' content='2'><meta name='other' content='3'>"
    r = text.page_texts(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert (r[0].title, r[0].metadata) == ("T & t", {"version": "2"}) and (r[1].visible, r[1].title) == ("", None)
    assert [x.strip() for x in r[0].visible.split("\n")] == ["T & t", "one two", "", "a", "b", "end"]


def test_early_metric_ranks_before_a_late_one(spark):
    t = lambda m: f"2024-01-01 00:{m:02d}:00"
    rows = [(f"s{i}", t(m), "e", "TREND", name, 0.5, 0.5, "m", "d", "VALID", "x") for i, (m, name) in enumerate([(0, "TP2"), (10, "TP3"), (0, "TP2"), (10, "TP3")])]
    e = spark.createDataFrame(rows, "signal_id string, ts string, entity string, signal_type string, metric_name string, normalized double, confidence double, source_model string, source_dataset string, validity string, description string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    risks = spark.createDataFrame([("e", t(0), 0.81, "CRITICAL", 6), ("e", t(5), 0.9, "CRITICAL", 6), ("e", t(10), 0.99, "CRITICAL", 6)], "entity string, bucket string, risk double, severity string, evidence long").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    rules = incidents.Rules(window_evidence=4)
    w = incidents.detect(risks, e, rules)
    one = w.collect()
    assert len(one) == 1 and one[0].persistence_minutes == 15.0 and one[0].severity == "CRITICAL"
    score = {(r.kind, r.candidate): r.score for r in incidents.candidates(w, risks, e, rules).collect()}
    assert score[("metric", "TP2")] > score[("metric", "TP3")] and ("component", "TP2") not in score
