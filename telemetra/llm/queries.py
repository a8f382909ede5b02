"""The queries of this subpackage: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm import bpe, counts, lattice, near, packing, quality, suffixes, topk, toxicity, urls

VOCABULARY = "byte_bpe_50k.json"
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaves are made, then, from these, it is edited in three places: the last 5 characters replaced, a
    word put in at a third of it, 40 characters gone at a half."""
    docs, n = table(spark, sf_dir, "documents"), F.length("text")
    change = lambda start, stop, new: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), F.lit(new).alias("text"))
    edits = F.array(change(n - 5, n, "the end."), change(F.floor(n / 3), F.floor(n / 3), " inserted "), change(F.floor(n / 2), F.floor(n / 2) + 40, ""))
    path = public_tokenizers.path(VOCABULARY)
    kept = counts.count_tokens(docs, path, edits=None, trees=True, carry=("text",)).select("doc_id", "text", "leaves", edits.alias("edits"))
    return counts.count_tokens(kept, path, leaves="leaves")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the contract's columns: the language, its calibrated threshold, and the decision by that threshold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_by_language(docs, labels, toxicity.train(docs, labels))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op10_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_lattice_near_dedup, op3_quality_classifier, op4_hilbert_packing, op5_token_counts, op6_toxicity, op7_bpe_codec, op8_suffix_dedup, op9_minhash_near_dedup, op10_pivot_top_k)}

ORACLE_SQL = {
    "op1_url_filter": r"""
        WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM a),
        c AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM b),
        d AS (SELECT *, CASE
            WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM d
    """,
    "op10_pivot_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
