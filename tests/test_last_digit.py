from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from telemetra.functions.scalars import rounded_as_sql
from telemetra.operators.incidents import Rules, described
from telemetra.plans import catalogue, compositions, incidents  # noqa: F401  the others add their queries to the catalogue

DATA = "/root/testdata/sf0.01"


def test_halves_are_rounded_as_in_sql(spark):
    values = [(2 * k + 1) / 2e6 for k in range(2000)] + [-(2 * k + 1) / 2e6 for k in range(2000)] + [0.0, 1.5, None, float("inf")]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(rounded_as_sql(F.col("x"), 6).alias("r")).collect()
    assert [r.r for r in got] == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchone()[0] for v in values]


@pytest.mark.parametrize("name", ["signal_confidence", "rca_candidate_ranking"])
def test_rows_equal_sql_to_the_last_digit(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    own, sql = catalogue.QUERIES[name](spark, DATA), con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(tuple(r) for r in own.select(*sql.columns).collect()) == sorted(sql.fetchall())


@pytest.mark.parametrize("name", ["incident_windows", "incident_merge"])
def test_means_of_two_equal_sql_to_the_last_digit(spark, name):
    """The mean of more than two risks depends on the order of the sum, which the SQL leaves open: there the last digit may differ."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    own, sql = catalogue.QUERIES[name](spark, DATA), con.sql(catalogue.ORACLE_SQL[name])
    at, n = sql.columns.index("mean_risk"), sql.columns.index("buckets")
    for x, y in zip(sorted(map(tuple, own.select(*sql.columns).collect())), sorted(sql.fetchall()), strict=True):
        assert x[:at] + x[at + 1 :] == y[:at] + y[at + 1 :] and abs(x[at] - y[at]) < (1.5e-6 if x[n] > 2 else 1e-12)


def test_mean_risk_of_a_window_does_not_depend_on_the_order_of_rows(spark):
    hour = lambda k: datetime(2024, 1, 1, k)
    risks = [("e", hour(0), 0.1, "LOW", 1), ("e", hour(1), 0.2, "LOW", 1), ("e", hour(2), 0.3, "LOW", 1), ("e", hour(3), None, "LOW", 1), ("f", hour(0), None, "LOW", 1)]
    spans = spark.createDataFrame([("e", 1, hour(0), hour(3)), ("f", 1, hour(0), hour(3))], "entity string, incident long, start_ts timestamp_ntz, end_ts timestamp_ntz")
    evidence = spark.createDataFrame([(x, "s", hour(1), "T", "m") for x in "ef"], "entity string, signal_id string, ts timestamp_ntz, signal_type string, metric_name string")
    rules = Rules(bucket_seconds=3600, window_evidence=1)
    for rows in (risks, risks[::-1]):
        one = spark.createDataFrame(rows, "entity string, bucket timestamp_ntz, risk double, severity string, evidence long").coalesce(1)
        got = {r.entity: (r.mean_risk, r.buckets) for r in described(spans, one, evidence, rules).collect()}
        assert got == {"e": ((0.3 + 0.2 + 0.1) / 3, 4), "f": (None, 1)}
