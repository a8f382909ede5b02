import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemetra.operators import models, retrieval


def test_front_matter(spark):
    df = spark.createDataFrame([("---\ntitle: A: b\nversion: 1\n---\n\nBody\n---\nmore",), ("plain",), ("---\nopen",)], "t string")
    body, meta = retrieval.front_matter(F.col("t"))
    rows = df.select(body.alias("b"), meta.alias("m")).collect()
    assert rows[0].b == "Body\n---\nmore" and rows[0].m == {"title": "A: b", "version": "1"}
    assert [(r.b, r.m) for r in rows[1:]] == [("plain", {}), ("---\nopen", {})]


def test_packed_chunks(spark):
    text = "intro one\n\n# First  \nA b c\n\nd e F\n\ng h\n## Second\n" + " ".join(f"W{i}" for i in range(11))
    df = spark.createDataFrame([(1, text), (2, None), (3, "  \n\n "), (4, "...")], "doc_id long, t string")
    rows = retrieval.packed_chunks(df, "doc_id", "t", 6, 2).orderBy("doc_id", "position").collect()
    got = [(r.position, r.section, r.chunk) for r in rows if r.doc_id == 1]
    assert got[0] == (0, "Document", "intro one")
    assert got[1] == (1, "First", "A b c\n\nd e F") and got[2] == (2, "First", "e f\n\ng h")
    assert [c for _, s, c in got if s == "Second"] == ["w0 w1 w2 w3 w4 w5", "w4 w5 w6 w7 w8 w9", "w8 w9 w10"]
    assert {r.doc_id for r in rows} == {1, 4}
    assert retrieval.packed_chunks(df.where("false"), "doc_id", "t").count() == 0
    with pytest.raises(ValueError):
        retrieval.packed_chunks(df, "doc_id", "t", 5, 5)


def test_metrics(spark):
    gold = spark.createDataFrame([("q", ["a", "b"]), ("none", ["a"])], "query_id string, expected array<string>")
    found = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("q", "a", 3), ("q", "b", 4)], "query_id string, unit string, position int")
    r = {x.query_id: x for x in retrieval.retrieval_metrics(gold, found, 3).collect()}
    assert (r["q"].precision, r["q"].recall, r["q"].reciprocal_rank) == (pytest.approx(1 / 3), 0.5, 0.5)
    assert r["q"].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert (r["none"].precision, r["none"].recall, r["none"].reciprocal_rank, r["none"].ndcg) == (0, 0, 0, 0)


def test_rerank_and_failures(spark):
    rows = spark.createDataFrame([("q", "disk full error", "disk", 0.9, "a"), ("q", "disk full error", "an error: disk is full", 0.1, "b"), ("q", "disk full error", "disk", 0.9, "0")], "query_id string, query string, text string, score double, chunk_id string")
    assert [r.chunk_id for r in retrieval.lexical_rerank(rows, 2).orderBy("position").collect()] == ["b", "0"]  # two of three terms against one; "error:" is another term
    gold = spark.createDataFrame([(i, "d", ["x"], c) for i, c in enumerate([[], [], [], ["c"], []])], "query_id int, domain string, documents array<string>, chunks array<string>")
    found = spark.createDataFrame([(1, "e", "x", "c"), (2, "d", "y", "c"), (3, "d", "x", "k"), (4, "d", "x", "k")], "query_id int, domain string, document string, chunk string")
    assert [r.failure for r in retrieval.failure_class(gold, found).orderBy("query_id").collect()] == ["no_results", "cross_domain_confusion", "correct_document_not_retrieved", "correct_section_not_retrieved", "relevant_item_ranked_too_low"]
    cite = spark.createDataFrame([("a", 1.0), ("", 1.0), ("b", float("nan"))], "source string, score double")
    assert retrieval.citation_completeness(cite, ["source"]).first()[0] == pytest.approx(1 / 3)
    assert retrieval.citation_completeness(cite.where("false"), ["source"]).first()[0] == 0


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(0)
    x, noise = rng.normal(size=(60, 2)), rng.normal(size=60)
    y = x @ [2.0, -1.0] + 3 + noise
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    m = models.fit_ridge(df, ["a", "b"], "y", 5.0)
    z = x - x.mean(0)
    want = np.linalg.solve(z.T @ z + 5.0 * np.eye(2), z.T @ (y - y.mean()))
    assert np.allclose(m.coefficients.toArray(), want) and m.intercept == pytest.approx(y.mean() - x.mean(0) @ want)


@pytest.mark.parametrize("kind", ["logistic", "boosted"])
def test_classifier(spark, kind):
    rows = [(i, float(i % 7), "ab"[i % 2], int(i % 7 >= 5)) for i in range(210)]
    df = models.stratified_split(spark.createDataFrame(rows, "id int, x double, k string, y int"), "id", "y")
    sizes = {(r.y, r.split): r["count"] for r in df.groupBy("y", "split").count().collect()}
    assert sizes == {(0, "train"): 90, (0, "validation"): 30, (0, "test"): 30, (1, "train"): 36, (1, "validation"): 12, (1, "test"): 12}
    model = models.fit_classifier(df.where("split = 'train'"), kind, ["x"], ["k"], "y")
    test = models.predict(model, df.where("split = 'test'").withColumn("k", F.lit("new")))
    assert test.where("predicted <> y").count() == 0


def test_trees_are_fitted_in_as_many_tasks_as_there_are_cores(spark):
    df = spark.range(300).coalesce(1).select((F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("k"), (F.col("id") % 17 > 8).cast("int").alias("y"))
    spark.sparkContext.setJobGroup("trees", "trees")
    fitted = models.fit_classifier(df, "boosted", ["x"], ["k"], "y")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("trees") for s in tracker.getJobInfo(j).stageIds]
    assert sum(s.numTasks == spark.sparkContext.defaultParallelism for s in stages if s) > 50
    assert models.predict(fitted, df).where("predicted <> y").isEmpty()


def test_a_split_shuffles_the_rows_of_its_bounds_alone(spark):
    df = spark.range(20_000).select("id", F.expr("uuid()").alias("load"), (F.col("id") % 2).cast("int").alias("y"))
    out = models.stratified_split(df, "id", "y")
    assert {(r.y, r.split): r["count"] for r in out.groupBy("y", "split").count().collect()} == {(y, s): n for y in (0, 1) for s, n in (("train", 6000), ("validation", 2000), ("test", 2000))}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "SortMergeJoin" not in plan
    same = spark.range(100).select(F.lit(1).alias("id"), F.lit("a").alias("y"))
    assert sorted((r.split, r["count"]) for r in models.stratified_split(same, "id", "y").groupBy("split").count().collect()) == [("test", 20), ("train", 60), ("validation", 20)]


def test_a_forest_is_the_same_with_the_nodes_of_its_rows_kept(spark):
    df = spark.range(400).select((F.col("id") * 7919 % 101).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("k"), (F.col("id") * 31 % 7 > 3).cast("int").alias("y")).repartition(2).persist()
    kept = models.classifier("forest", "y")
    assert kept.getCacheNodeIds()
    pipe = models.fit_classifier(df, "logistic", ["x"], ["k"], "y")
    rows = type(pipe)(stages=pipe.stages[:-1]).transform(models.balanced(df, "y")).select("features", "y", "weight")
    a, b = (m.setNumTrees(5).fit(rows).toDebugString.split("\n", 1)[1] for m in (kept, models.classifier("forest", "y").setCacheNodeIds(False)))
    assert a == b and "If" in a
    df.unpersist()
