"""The corpus pipeline: toxicity, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and gets all rows that the stage before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm import near, packing, quality, suffixes, toxicity
from telemetra.llm.common import cut, scratch
from telemetra.llm.queries import VOCABULARY, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of the shortest passage that repeats across documents: over 50. Operator 8's 400 bytes hold more words than that.
PASSAGE_WORDS = 51


def _stand_in():
    """The row's id; for rows without one a number from 2**62 up by the text, so that equal texts have the same."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62)))


def _key():
    """A number of id and text; no id counts as an id, no text as a text."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())


def _once(docs: DataFrame) -> DataFrame:
    """docs with one row for each id and text (no id counts as an id). Usually there are no others, and docs is returned as it is."""
    if docs.groupBy(_key().alias("key")).count().where("count > 1").isEmpty():
        return docs
    return cut(docs.withColumn("key", _key()).dropDuplicates(["key"]).select(*COLUMNS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that operator 6 rejects: score 0.7 or more. It learns from the labelled source rows."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _kept_by_score(docs, model.score, lambda s: s < 0.7)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that operator 3 rejects: score under 0.3."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _kept_by_score(docs, lambda texts: model.score(quality.features(texts)), lambda s: s >= 0.3)


def _kept_by_score(docs: DataFrame, score, keep) -> DataFrame:
    """The whole row rides along as the scorer's id, so that a decision needs no join."""
    rows = docs.select(F.struct(*COLUMNS).alias("row"))
    return quality.scored(rows, score, "row", None).where(keep(F.col("score"))).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of operator 9 stays, the one with the smallest id: five-word shingles, similarity 0.8. Rows
    that repeat another one (id and text) go; rows without an id are compared as well, and one stays where its group has no
    row with an id. The operator wants one text for each id, so it gets numbers of id and text: texts that share an id, null
    or empty ones among them, are documents of their own."""
    rows = _once(docs).withColumn("key", _key())
    found = near.near_duplicates(rows, id_column="key").select("key", "component_id")
    kept = found.join(rows.select("key", _stand_in().alias("id")), "key").groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("first"))
    return rows.join(kept.select("first.key"), "key", "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int | None = None) -> DataFrame:
    """Texts without the bytes that operator 8 removes, and without recurring runs of so many words where words is given.
    A character that loses a part of its bytes goes as a whole. Rows that repeat another one (id and text) go first; rows
    without an id take part. The rest of the row rides along, so that a decision needs no join."""
    rest = F.struct("doc_id", "lang", "source", "n_chars", F.col("text").isNull().alias("none"))
    rows = _once(docs).select(F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("id"), "text", rest.alias("row"))
    out = suffixes.remove_repeats(rows, id_column="id", words=words, row_column="row").select("row.*", "n_removed", "kept_text")
    size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("text", F.when(~F.col("none"), F.col("kept_text"))).withColumn("n_chars", size).select(*COLUMNS)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """cut_repeats with passages of over 50 words, however short in bytes."""
    return cut_repeats(spark, docs, sf_dir, PASSAGE_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4 on what is left. Rows without an id have a number from 2**62 up as doc_id."""
    return packing.pack(docs.withColumn("doc_id", _stand_in()), public_tokenizers.path(VOCABULARY))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near duplicates", drop_near_duplicates), ("repeated passages", cut_passages), ("packing", pack)]
#: Learned models, MinHash and byte-level BPE have no SQL; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is written as Parquet and read by the next one."""
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
