import duckdb
import pandas as pd
import pytest

from telemetra.plans import assessments, audits, catalogue, compositions, detections, files, incidents, signals, streams  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region customer lineitem orders events documents embeddings pages benchmark labels".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df):
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    out = [tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert rows(catalogue.QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() >= 0
