"""Rows and intervals that meet, without comparing all of one with all of the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.functions.scalars import micros


def in_spans(rows: DataFrame, spans: DataFrame, ts: str, begin: str, end: str, seconds: int = 3600, keys: tuple[str, ...] = (), closed: bool = False) -> DataFrame:
    """Each row with every span of its keys that begin <= t < end holds for, or t <= end if closed.

    Both sides meet by the number of their time cell, so neither is broadcast nor compared with all of the other.
    """
    cell = lambda x: F.floor(micros(x) / (seconds * 1_000_000))
    cells = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col(begin)), F.greatest(cell(F.col(begin)), cell(F.col(end))))))
    met = rows.withColumn("_cell", cell(F.col(ts))).join(cells, ["_cell", *keys])
    upto = F.col(ts) <= F.col(end) if closed else F.col(ts) < F.col(end)
    return met.where((F.col(ts) >= F.col(begin)) & upto).drop("_cell")
