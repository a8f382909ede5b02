"""The canonical tables that readers produce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ORIGIN = "source_dataset string, source_file string, source_row_id string, quality_flag string, metadata_json string"
_WHEN = "timestamp timestamp_ntz, timestamp_original string, timezone_assumption string"
# Columns of the canonical tables, in order.
SCHEMAS = {
    "metrics": f"event_id string, {_WHEN}, sequence_index long, entity_id string, service_id string, host_id string, metric_name string, metric_value double, metric_type string, unit string, split string, {_ORIGIN}",
    "logs": f"event_id string, {_WHEN}, sequence_index long, entity_id string, service_id string, host_id string, process_id string, request_id string, trace_id string, log_level string, event_type string, event_template string, message string, {_ORIGIN}",
    "traces": f"event_id string, {_WHEN}, trace_id string, span_id string, service_id string, parent_span_id string, operation_name string, duration_ms double, status string, {_ORIGIN}",
    "failures": f"event_id string, {_WHEN}, sequence_index long, entity_id string, target tinyint, failure_type string, label_source string, label_source_type string, {_ORIGIN}",
    "labels": f"label_id string, label_kind string, label_source_type string, label_value string, label_source string, event_id string, {_WHEN}, sequence_index long, timestamp_start timestamp_ntz, timestamp_end timestamp_ntz, start_index long, end_index long, entity_id string, service_id string, {_ORIGIN}",
    "incidents": "incident_id string, timestamp_start timestamp_ntz, timestamp_end timestamp_ntz, start_index long, end_index long, entity_id string, service_id string, incident_type string, severity string, label_source string, label_source_type string, source_dataset string, source_file string, evidence_reference string, quality_flag string, metadata_json string",
}


def shaped(df: DataFrame, kind: str) -> DataFrame:
    """df with exactly the columns of a canonical table; those it lacks are null, its further ones go."""
    cols = [part.strip().split(" ") for part in SCHEMAS[kind].split(",")]
    return df.select(*[(F.col(name) if name in df.columns else F.lit(None)).cast(t).alias(name) for name, t in cols])


def is_valid(kind: str) -> Column:
    """The invariant of a row: a point, or an interval where the table allows one."""
    point = F.col("timestamp").isNotNull() | F.col("sequence_index").isNotNull() if kind in ("metrics", "logs", "failures", "labels") else F.lit(False)
    if kind == "traces":
        return F.coalesce(F.col("duration_ms") >= 0, F.lit(True))
    if kind in ("labels", "incidents"):
        return point | (F.col("timestamp_start").isNotNull() & F.col("timestamp_end").isNotNull()) | (F.col("start_index").isNotNull() & F.col("end_index").isNotNull())
    return point


def validity(df: DataFrame, kind: str) -> DataFrame:
    """One row: how many rows hold the invariant, how many do not."""
    return df.agg(F.count_if(is_valid(kind)).alias("n_valid"), F.count_if(~is_valid(kind)).alias("n_invalid"))
