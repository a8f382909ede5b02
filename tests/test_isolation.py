import numpy as np
import pandas as pd

from telemetra.operators import isolation


def test_average_path_of_small_trees():
    assert isolation.average_path(np.array([1, 2])).tolist() == [0.0, 1.0]
    assert abs(isolation.average_path(np.array([256]))[0] - 10.2448) < 1e-3


def test_outliers_score_highest_and_blocks_change_nothing(spark):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"machine": ["a"] * 400 + ["b"] * 100, "id": list(range(500)), "u": rng.normal(size=500), "v": rng.normal(size=500)})
    rows.loc[7, ["u", "v"]] = [9.0, -9.0]
    rows.loc[450, "u"] = np.nan
    rows.loc[451, "u"] = np.inf
    df = spark.createDataFrame(rows)
    one = isolation.isolation_scores(df, "machine", "id", ["u", "v"], trees=50).toPandas().set_index("id").sort_index()
    many = isolation.isolation_scores(df, "machine", "id", ["u", "v"], trees=50, block_rows=30).toPandas().set_index("id").sort_index()
    assert len(one) == 500 and one.score.isna().sum() == 2 and one.score[[450, 451]].isna().all()
    assert one.score.idxmax() == 7 and one.score.dropna().between(0, 1).all()
    assert np.allclose(one.score, many.score, equal_nan=True)


def test_entity_without_training_rows_and_empty_table(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 1.5), ("b", 3, 1.5)], "machine string, id long, u double")
    out = {r.id: r.score for r in isolation.isolation_scores(df, "machine", "id", ["u"], df.machine == "b", trees=5).collect()}
    assert out[1] is None and out[2] == out[3]
    assert isolation.isolation_scores(df.limit(0), "machine", "id", ["u"], trees=5).count() == 0
