"""Queries of detectors, forecasts and models; SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.operators import detectors as T
from telemetra.operators import forecasting as P
from telemetra.operators import models as M
from telemetra.operators import windows
from telemetra.plans.catalogue import query, rounded, table

D = "CAST({} AS DOUBLE)".format


@query(f"""WITH x AS (SELECT event_id, value, count(value) OVER l AS n, avg(value) OVER l AS m, CASE WHEN max(value) OVER l = min(value) OVER l THEN 0 ELSE stddev_pop(value) OVER l END AS s FROM events WINDOW l AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    z AS (SELECT event_id, abs(coalesce(CASE WHEN n < 3 THEN 0 WHEN s > 1e-8 THEN (value - m) / s WHEN abs(value - m) <= 1e-8 THEN 0 ELSE (value - m) / 1e-8 END, 0)) AS z FROM x) SELECT event_id, round(z, 6) AS score, CAST(z >= 3 AS INTEGER) AS predicted FROM z""")
def rolling_z_score(spark, d):
    out = windows.causal_rolling(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return rounded(T.rolling_z_score(out, 3.0), "score").select("event_id", "score", "predicted")


FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]
Z = """st AS (SELECT l_returnflag, """ + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FEATURES) + """ FROM lineitem WHERE l_orderkey % 5 < 3 GROUP BY l_returnflag),
    zs AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, """ + ", ".join(f"abs(({f} - m_{f}) / s_{f}) AS z_{f}" for f in FEATURES) + """ FROM lineitem JOIN st USING (l_returnflag))"""


def feature_scores(spark, d):
    return T.feature_z_scores(table(spark, d, "lineitem"), "l_returnflag", FEATURES, F.col("l_orderkey") % 5 < 3)


@query(f"WITH {Z} SELECT l_orderkey, l_linenumber, round(greatest(z_l_quantity, z_l_extendedprice, z_l_discount), 6) AS score FROM zs")
def feature_z_scores(spark, d):
    return rounded(feature_scores(spark, d), "score").select("l_orderkey", "l_linenumber", "score")


TOP = Z + """, tp AS (SELECT * FROM zs ORDER BY greatest(z_l_quantity, z_l_extendedprice, z_l_discount) DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 200),
    fl AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, unnest([{'feature': 'l_quantity', 'z': z_l_quantity}, {'feature': 'l_extendedprice', 'z': z_l_extendedprice}, {'feature': 'l_discount', 'z': z_l_discount}], recursive := true) FROM tp),
    tf AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY z DESC, feature) AS INTEGER) AS position FROM fl QUALIFY position <= 2)"""


@query(f"WITH {TOP} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, feature, round(z, 6) AS feature_score, position FROM tf")
def top_metric_records(spark, d):
    return rounded(T.top_features(feature_scores(spark, d), FEATURES, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], k=2), "feature_score")


@query(f"WITH {TOP} SELECT l_returnflag, feature, count(*) AS mentions, round(avg(z), 6) AS mean_score FROM tf GROUP BY ALL")
def metric_frequency(spark, d):
    top = T.top_features(feature_scores(spark, d), FEATURES, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], k=2)
    return rounded(T.feature_mentions(top, ["l_returnflag"]), "mean_score")


TWO = "tw AS (SELECT event_id, user_id % 4 AS k, value AS a, (event_id * 7919) % 1000 AS b, CAST(event_type = 'error' AS INTEGER) AS y FROM events)"


def two(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("user_id") % 4).alias("k"), F.col("value").alias("a"), (F.col("event_id") * 7919 % 1000).alias("b"), (F.col("event_type") == "error").cast("int").alias("y"))


_share = lambda c: f"sum(CASE WHEN event_id % 10 < 6 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY {c}) / sum(CASE WHEN event_id % 10 < 6 THEN 1 ELSE 0 END) OVER (PARTITION BY k)"


@query(f"WITH {TWO}, e AS (SELECT event_id, greatest({_share('a')}, {_share('b')}) AS e FROM tw) SELECT event_id, round(e, 6) AS ensemble, CAST(e >= 0.95 AS INTEGER) AS predicted FROM e")
def score_ensemble(spark, d):
    return rounded(T.ensemble(two(spark, d), ["k"], "a", "b", F.col("event_id") % 10 < 6, 0.95), "ensemble").select("event_id", "ensemble", "predicted")


@query(f"""WITH {TWO}, m AS (SELECT k, count(*) FILTER (y = 1 AND a >= 50 + 10 * k) AS tp, count(*) FILTER (y = 0 AND a >= 50 + 10 * k) AS fp, count(*) FILTER (y = 0 AND a < 50 + 10 * k) AS tn, count(*) FILTER (y = 1 AND a < 50 + 10 * k) AS fn FROM tw GROUP BY k) SELECT k, tp, fp, tn, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(fp / (fp + tn), 6) AS fpr FROM m""")
def score_bundle(spark, d):
    return rounded(T.evaluate_scores(two(spark, d), ["k"], "y", "a", F.lit(50) + 10 * F.col("k")).drop("f1"), "precision", "recall", "fpr")


@query(f"""WITH {TWO}, m AS (SELECT k, count(*) FILTER (y = 1 AND a >= 60) AS tp, count(*) FILTER (y = 0 AND a >= 60) AS fp, count(*) FILTER (y = 0 AND a < 60) AS tn, count(*) FILTER (y = 1 AND a < 60) AS fn FROM tw GROUP BY k), f AS (SELECT k, tp, fp, 2 * tp / (2 * tp + fp + fn) AS f1, tp / (tp + fn) AS recall, fp / (fp + tn) AS fpr FROM m)
    SELECT k, tp, fp, round(f1, 6) AS f1, CAST(row_number() OVER (ORDER BY round(f1, 9) DESC, round(recall, 9) DESC, round(fpr, 9), k) AS INTEGER) AS position FROM f""")
def global_metrics(spark, d):
    out = T.global_metrics(two(spark, d).withColumn("p", (F.col("a") >= 60).cast("int")), ["k"], "y", "p")
    return rounded(out, "f1").select("k", "tp", "fp", "f1", "position")


@query(f"WITH {TWO}, s AS (SELECT * FROM (VALUES ('low', {D(20)}), ('high', {D(90)})) t(strategy, threshold)) SELECT strategy, count(*) FILTER (y = 1 AND a >= threshold) AS tp, count(*) FILTER (y = 0 AND a >= threshold) AS fp FROM tw, s GROUP BY strategy")
def threshold_strategies(spark, d):
    return T.strategies(two(spark, d), "y", "a", {"low": 20.0, "high": 90.0}).select("strategy", "tp", "fp")


@query(f"""WITH x AS (SELECT user_id, CAST(value > 30 AS INTEGER) AS y, CAST(event_type = 'click' AS INTEGER) AS a, CAST(event_type = 'view' AS INTEGER) AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM x WHERE y = 1), s AS (SELECT user_id, g, max(a) AS a, max(b) AS b FROM g GROUP BY ALL)
    SELECT user_id, count(*) FILTER (a = 1 AND b = 1) AS both, count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b, count(*) FILTER (a = 0 AND b = 0) AS neither, round(coalesce(count(*) FILTER (a = 1 AND b = 1) / nullif(count(*) FILTER (a = 1 OR b = 1), 0), 0), 6) AS jaccard FROM s GROUP BY user_id""")
def segment_agreement(spark, d):
    e = table(spark, d, "events").withColumns({"y": (F.col("value") > 30).cast("int"), "a": (F.col("event_type") == "click").cast("int"), "b": (F.col("event_type") == "view").cast("int")})
    return rounded(T.agreement(e, "user_id", ["ts", "event_id"], "y", "a", "b"), "jaccard")


@query("SELECT user_id, count(*) AS positives FROM events WHERE event_type = 'error' AND user_id % 3 = 0 GROUP BY user_id ORDER BY user_id LIMIT 5")
def labelled_series(spark, d):
    e = table(spark, d, "events").withColumn("y", ((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0)).cast("int"))
    return T.labelled_entities(e, "user_id", "y", 5)


def event_windows(spark, d):
    e = table(spark, d, "events").withColumn("y", (F.col("event_type") == "error").cast("int"))
    return windows.sequence_windows(e, "user_id", ["ts", "event_id"], "value", "y", 8, 4)


@query("""WITH a AS (SELECT user_id, row_number() OVER w AS i, max(CAST(event_type = 'error' AS INTEGER)) OVER f AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)), b AS (SELECT user_id, i - 1 AS end_index, y, min(y) OVER (PARTITION BY user_id) AS least FROM a WHERE i >= 8 AND (i - 8) % 4 = 0)
    SELECT user_id, end_index, y AS window_label FROM b WHERE y = 0 OR least = 1""")
def normal_windows(spark, d):
    return T.normal_only(event_windows(spark, d), "user_id", "window_label").select("user_id", "end_index", "window_label")


def _encoded(spark, d, kind):
    w = event_windows(spark, d).withColumn("user_id", F.col("user_id") % 4).withColumn("fit", (F.col("window_label") == 0).cast("int"))
    w = w.groupBy("user_id", "end_index").agg(F.min("window_values").alias("window_values"), F.max("fit").alias("fit"))
    out = T.autoencoder_scores(w, "user_id", "window_values", "fit", kind, epochs=5, fit_windows=512)
    return out.select("user_id", "end_index", "score", F.size("step_scores").alias("steps"))


@query()
def dense_autoencoder(spark, d):
    return _encoded(spark, d, "dense")


@query()
def lstm_autoencoder(spark, d):
    return _encoded(spark, d, "lstm")


@query("""WITH w AS (SELECT event_type, event_id, value, row_number() OVER s AS n, sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS total, lead(value, 3) OVER s AS y, lead(event_id, 3) OVER s AS tgt FROM events WINDOW s AS (PARTITION BY event_type ORDER BY event_id))
    SELECT event_type, event_id AS input_end, tgt AS target_at, round(total, 4) AS total, y AS target FROM w WHERE n >= 6 AND (n - 6) % 2 = 0 AND y IS NOT NULL""")
def forecasting_windows(spark, d):
    w = P.forecast_windows(table(spark, d, "events"), "event_type", "event_id", ["value"], 6, 3, 2)
    return w.select("event_type", "input_end", "target_at", F.round(F.aggregate("inputs", F.lit(0.0), lambda s, x: s + x[0]), 4).alias("total"), F.col("targets")[0].alias("target"))


@query("""WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_orderkey % 2 = 0) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS scaled FROM lineitem, s""")
def sensor_scale(spark, d):
    out = P.sensor_scale(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], F.col("l_orderkey") % 2 == 0)
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("scaled"))


@query("SELECT l_orderkey, l_linenumber, unnest(['q', 'd']) AS sensor, unnest([l_quantity, l_discount]) AS y_true, unnest([round(l_quantity), l_tax]) AS y_pred, round(unnest([abs(l_quantity - round(l_quantity)), abs(l_discount - l_tax)]), 6) AS absolute_error FROM lineitem")
def prediction_rows(spark, d):
    x = table(spark, d, "lineitem").withColumn("p", F.round("l_quantity"))
    return rounded(P.long_predictions(x, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"], ["p", "l_tax"], ["q", "d"]), "absolute_error")


RUNS = """fc AS (SELECT event_type, CASE WHEN event_id % 10 < 6 THEN 'train' WHEN event_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split, lead(value, 5) OVER w AS y, value AS p, avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS a FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
    mm AS (SELECT model, split, event_type, avg(abs(y - f)) AS mae, sqrt(avg((y - f) * (y - f))) AS rmse, count(*) AS n FROM (SELECT *, unnest(['persistence', 'average']) AS model, unnest([p, a]) AS f FROM fc WHERE y IS NOT NULL) GROUP BY ALL)"""


def runs(spark, d):
    from telemetra.operators import series

    f = series.forecasts(table(spark, d, "events"), "event_type", "event_id", "value").withColumn("split", F.when(F.col("event_id") % 10 < 6, "train").when(F.col("event_id") % 10 < 8, "validation").otherwise("test"))
    return P.run_models(f, {"persistence": lambda x: x.withColumn("y_pred", F.col("persistence")), "average": lambda x: x.withColumn("y_pred", F.col("moving_average"))}, ["event_type"])


@query(f"WITH {RUNS} SELECT model, split, event_type, round(mae, 5) AS mae, round(rmse, 5) AS rmse, n FROM mm")
def horizon_models(spark, d):
    return runs(spark, d).withColumns({c: F.round(c, 5) for c in ("mae", "rmse")})


@query(f"""WITH {RUNS}, b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(rmse, 9), model) AS k FROM mm WHERE split = 'validation') SELECT b.model, event_type, round(b.rmse, 5) AS rmse, round(t.rmse, 5) AS test_rmse FROM b JOIN (SELECT model, event_type, rmse FROM mm WHERE split = 'test') t USING (model, event_type) WHERE k = 1""")
def select_forecast_model(spark, d):
    out = P.select_model(runs(spark, d), ["event_type"])
    return out.select("model", "event_type", F.round("rmse", 5).alias("rmse"), F.round("test_rmse", 5).alias("test_rmse"))


GRID = [0.1, 0.3, 0.5]
GRIDDED = """gr AS (SELECT CASE WHEN event_id % 10 < 6 THEN 'train' WHEN event_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split, unnest(['a', 'b']) AS model, CAST(event_type = 'error' AS INTEGER) AS y, unnest([value / 200, value / 300]) AS s FROM events),
    gt AS (SELECT model, split, threshold, count(*) FILTER (y = 1 AND s >= threshold) AS tp, count(*) FILTER (y = 0 AND s >= threshold) AS fp, count(*) FILTER (y = 0 AND s < threshold) AS tn, count(*) FILTER (y = 1 AND s < threshold) AS fn FROM gr, (SELECT unnest([CAST(0.1 AS DOUBLE), CAST(0.3 AS DOUBLE), CAST(0.5 AS DOUBLE)]) AS threshold) GROUP BY ALL)"""


def gridded(spark, d, name, scale):
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 10 < 6, "train").when(F.col("event_id") % 10 < 8, "validation").otherwise("test").alias("split"), (F.col("event_type") == "error").cast("int").alias("y"), (F.col("value") / scale).alias("s"))
    return P.threshold_rows(e, "y", "s", GRID).withColumn("model", F.lit(name))


@query(f"WITH {GRIDDED} SELECT model, split, threshold, tp, fp, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision FROM gt")
def threshold_sensitivity(spark, d):
    return rounded(gridded(spark, d, "a", 200).unionByName(gridded(spark, d, "b", 300)), "precision").select("model", "split", "threshold", "tp", "fp", "precision")


@query(f"""WITH {GRIDDED}, f AS (SELECT *, 2 * tp / (2 * tp + fp + fn) AS f1, tp / (tp + fp) AS p, tp / (tp + fn) AS r, fp / (fp + tn) AS a FROM gt WHERE split = 'validation' AND threshold = 0.1), k AS (SELECT *, row_number() OVER (ORDER BY round(f1, 9) DESC, round(p, 9) DESC, round(r, 9) DESC, round(a, 9), model) AS k FROM f) SELECT model, round(f1, 6) AS f1 FROM k WHERE k = 1""")
def select_final_tree(spark, d):
    both = gridded(spark, d, "a", 200).unionByName(gridded(spark, d, "b", 300)).where("threshold = 0.1")
    return rounded(P.select_tree(both, []), "f1").select("model", "f1")


@query("""WITH x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id, CASE WHEN i < least(greatest(floor(n * CAST(0.8 AS DOUBLE)), 8), n - 8) THEN 'fit' ELSE 'check' END AS part FROM x""")
def machine_split(spark, d):
    return P.machine_windows(table(spark, d, "events"), "user_id", ["ts", "event_id"], 8).select("event_id", "part")


@query()
def lstm_forecast(spark, d):
    w = P.forecast_windows(table(spark, d, "events"), "event_type", "event_id", ["value"], 6, 3, 2)
    w = w.select("event_type", "input_end", F.transform("inputs", lambda x: x[0]).alias("x"), F.col("targets")[0].alias("y"), (F.col("input_end") % 10 < 8).cast("int").alias("fit"))
    return P.lstm_forecasts(w, ["event_type", "input_end"], "x", "y", "fit", 512, epochs=3).select("event_type", "input_end", "y", "y_pred")


def model_rows(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 100).cast("double").alias("customer"), F.col("o_orderpriority").alias("priority"), (F.col("o_totalprice") + F.xxhash64("o_orderkey") % 30000 > 200000).cast("int").alias("y"))
    return M.stratified_split(x, "o_orderkey", "y")


@query("""WITH c AS (SELECT CAST(o_orderkey % 3 = 0 AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1) SELECT y, unnest(['train', 'validation', 'test']) AS split, unnest([CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT), CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT), n - CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT) - CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT)]) AS n FROM c""")
def stratified_split(spark, d):
    x = table(spark, d, "orders").withColumn("y", (F.col("o_orderkey") % 3 == 0).cast("int"))
    return M.stratified_split(x, "o_orderkey", "y").groupBy("y", "split").agg(F.count("*").alias("n"))


def _model(spark, d, kind):
    rows = model_rows(spark, d)
    fitted = M.fit_classifier(rows.where("split = 'train'"), kind, ["price", "customer"], ["priority"], "y")
    return M.predict(fitted, rows.where("split <> 'train'")).select("o_orderkey", "split", "y", "score", "predicted")


@query()
def logistic_model(spark, d):
    return _model(spark, d, "logistic")


@query()
def forest_model(spark, d):
    return _model(spark, d, "forest")


@query()
def feature_importance(spark, d):
    fitted = M.fit_classifier(model_rows(spark, d).where("split = 'train'"), "forest", ["price", "customer"], ["priority"], "y")
    return spark.createDataFrame(P.importances(fitted, ["price", "customer"]), "feature string, importance double")


RIDGE = """WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), m AS (SELECT avg(x) AS mx, avg(y) AS my, sum((x - (SELECT avg(x) FROM r)) * (y - (SELECT avg(y) FROM r))) / (sum((x - (SELECT avg(x) FROM r)) * (x - (SELECT avg(x) FROM r))) + 50000) AS b FROM r)"""


@query(RIDGE + " SELECT round(b, 3) AS slope, round(my - b * mx, 2) AS intercept FROM m")
def ridge_regression(spark, d):
    m = M.fit_ridge(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", 50000.0)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 3), round(float(m.intercept), 2))], "slope double, intercept double")
