"""Small tables that a plan reads more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.sources.sinks import scratch

#: Rows that go through the driver at most; more are written to the shared folder.
MOST_ROWS = 10_000


def settled(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df computed once, an action of its own: however often the result is read, it has the same rows. A table of no more
    than `most` rows is broadcast where it is joined."""
    rows = df.limit(most + 1).collect()
    if len(rows) <= most:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
    path = f"{scratch(df.sparkSession, 'settled')}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
