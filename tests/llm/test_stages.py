"""Repeated rows, and nulls in any column, through all stages of the pipeline."""

import corpus_pipeline
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"


def test_repeated_rows_and_null_ids_pass_all_stages(spark):
    source = spark.read.parquet(f"{D}/documents.parquet").orderBy("doc_id").cache()
    plain, stages = {}, dict(corpus_pipeline.STAGES)
    docs = source
    for name in ("toxicity", "quality", "near duplicates", "repeated passages"):
        docs = stages[name](spark, docs, D).cache()
        plain[name] = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    some = sorted(plain["near duplicates"])[:20]
    bare = some[-1]  # loses its id, and is there twice
    odd = source.where(F.col("doc_id").isin(some[:-1]))
    lost = source.where(F.col("doc_id") == bare).withColumn("doc_id", F.lit(None).cast("long"))
    docs = source.where(F.col("doc_id") != bare).unionByName(odd).unionByName(odd).unionByName(lost).unionByName(lost)
    copy = source.where(F.col("doc_id") == some[0]).withColumn("doc_id", F.lit(None).cast("long"))  # a copy of a row with an id
    docs = docs.unionByName(copy.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}))
    docs = docs.repartition(3)
    for name in ("toxicity", "quality", "near duplicates", "repeated passages"):
        docs = stages[name](spark, docs, D).cache()
        if name in ("near duplicates", "repeated passages"):
            rows = [(bare if r.doc_id is None else r.doc_id, (r.text, r.n_chars)) for r in docs.collect()]
            assert len(rows) == len(dict(rows)) and dict(rows) == plain[name], name
    assert docs.where("doc_id is null").count() == 1
    packed = {r.doc_id: r.n for r in stages["packing"](spark, docs, D).groupBy("doc_id").agg((F.sum("length") - F.max("doc_tokens")).alias("n")).collect()}
    assert len(packed) == docs.count() and set(packed.values()) == {0} and sum(k >= 2**62 for k in packed) == 1


def test_stage_alone_with_repeated_rows_and_nulls(spark):
    text = " ".join(f"word{k}" for k in range(90))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text))] * 3 + [(None, text + " a", None, None, None)] * 2 + [(2, None, "en", "s", 0), (None, None, None, None, None), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in once if r.text) == [(1, text)] and sorted(r.doc_id or 0 for r in once if r.text is None) == [0, 2]
    cut = corpus_pipeline.cut_repeats(spark, docs.where("doc_id is not null"), "").collect()
    assert sorted((r.doc_id, r.text) for r in cut) == [(1, text), (2, None)]


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    first, second = (" ".join(f"{w}{k}" for k in range(90)) for w in ("word", "other"))
    rows = [(1, first), (1, None), (2, first + " a"), (2, None), (3, second), (3, ""), (4, second + " b"), (4, first + " c"), (4, "alone")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text or "", r.text is None) for r in kept) == [(1, "", True), (1, first, False), (2, "", True), (3, "", False), (3, second, False), (4, "alone", False)]
