"""Queries over tables that are larger or odder than the driver's small ones, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from telemetra.plans import audits, catalogue, files  # noqa: F401  the others add their queries to the catalogue


@pytest.fixture
def same(spark, tmp_path):
    def compare(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.write.parquet(f"{tmp_path}/{t}.parquet")
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        sql = con.sql(catalogue.ORACLE_SQL[name])
        own = sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).select(*sql.columns).collect()))
        assert own == sorted(sql.fetchall())
        return own

    return compare


def test_class_aware_sample_keeps_positives_beyond_the_most(same, spark):
    """f1's six hours before it hold 2160 of 12,960 events, so that the places of negatives are more than 2000."""
    e = spark.range(12_960).select(F.col("id").alias("event_id"), F.expr("cast(timestamp_seconds(1704369600 + id * 10) as timestamp_ntz)").alias("ts"), F.lit(1.0).alias("value"))
    assert len(same("class_aware_sample", events=e)) == 2160 + 2000


@pytest.mark.parametrize("positives", [0, 3])
def test_class_aware_sample_with_few_positives(same, spark, positives):
    at = F.when(F.col("id") < positives, F.lit("2024-01-04 23:00:00")).otherwise("2024-01-10 00:00:00").cast("timestamp_ntz")
    same("class_aware_sample", events=spark.range(50).select(F.col("id").alias("event_id"), at.alias("ts"), F.lit(1.0).alias("value")))


def test_headings_of_odd_texts(same, spark):
    texts = ["~ a text that begins with a mark", "# a\n## b\n\n~", "#\nnot one", "", None, "a\r# not one", "#\tone\r\n###### six\n####### seven", " # one ", "#  ", "\v# not one", "#\v not one", "# a\u0085b\n#  \n# \r", "\t# not one", "# one\n\n\n", "x # not one"]
    rows = [(k // 2, t) for k, t in enumerate(texts)]
    own = same("markdown_headings", documents=spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(n for _, n in own) >= 8


def test_text_ids_beyond_ten_thousand(same, spark):
    rows = [(k, "a source", "en", 2000) for k in (0, 9_999, 10_000, 12_345, 19_999, 20_000, 31_234)]
    same("text_ids", documents=spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long"))
