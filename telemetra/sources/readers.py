"""Readers of the public telemetry and log collections, as canonical tables (see schemas)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.functions.scalars import blank_to_null, parse_double, parse_flag, request_id
from telemetra.sources.scan import below, combine_date_time, csv_rows, parse_timestamp, stem, text_lines, with_times
from telemetra.sources.schemas import shaped

# Sensors, failure columns and units of the collections.
METROPT_CONTINUOUS = ("TP2", "TP3", "H1", "DV_pressure", "Reservoirs", "Oil_temperature", "Motor_current")
METROPT_BINARY = ("COMP", "DV_eletric", "Towers", "MPG", "LPS", "Pressure_switch", "Oil_level", "Caudal_impulses")
METROPT_UNITS = {"Oil_temperature": "celsius", "Motor_current": "ampere"}
METROPT_ENTITY = "metropt_air_compressor_01"
AI4I_FEATURES = {"Air temperature [K]": "K", "Process temperature [K]": "K", "Rotational speed [rpm]": "rpm", "Torque [Nm]": "Nm", "Tool wear [min]": "min"}
AI4I_FAILURES = ("Machine failure", "TWF", "HDF", "PWF", "OSF", "RNF")
LOGHUB_FAMILIES = ("hdfs", "bgl", "openstack", "hadoop", "spark", "zookeeper")


def _id(*parts) -> Column:
    """Parts joined by colons, back slashes turned."""
    return F.regexp_replace(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), r"\\", "/")


def _json(**fields) -> Column:
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def _row_id(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.col("sequence_index").cast("string"))


def _label(df: DataFrame, dataset: str) -> DataFrame:
    return shaped(df.withColumn("label_source_type", F.lit("real")).withColumn("source_dataset", F.lit(dataset)), "labels")


def _optional(df: DataFrame, *names: str) -> DataFrame:
    """With null columns for those of the names that a file lacks."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def nab_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Every CSV (timestamp, value) below root/data is a series; rows whose value is no finite number are left out."""
    data = f"{root.rstrip('/')}/data"
    rows = with_times(csv_rows(spark, data, "timestamp string, value string").withColumnRenamed("timestamp", "_time"), F.col("_time"))
    series = below(F.col("_file"), data)
    rows = rows.withColumn("metric_value", parse_double(F.col("value"))).where("metric_value is not null").withColumn("series", series)
    rows = rows.withColumns({"event_id": _id("nab", F.col("series"), F.col("sequence_index")), "entity_id": F.concat(F.lit("nab:"), F.regexp_replace("series", r"\.csv$", "")), "metric_name": stem(F.col("series")), "metric_type": F.lit("continuous"), "source_dataset": F.lit("nab"), "source_file": F.concat(F.lit("data/"), F.col("series")), "source_row_id": F.col("sequence_index").cast("string"), "metadata_json": _json(nab_series=F.col("series"))})
    return shaped(rows, "metrics")


def nab_labels(spark: SparkSession, root: str) -> DataFrame:
    """Points of labels/combined_labels.json and windows of labels/combined_windows.json."""

    def of(file: str, kind: str) -> DataFrame:
        text = spark.read.text(f"{root.rstrip('/')}/labels/{file}", wholetext=True)
        one = text.select(F.explode(F.from_json("value", f"map<string,array<{kind}>>")).alias("series", "items"))
        return one.select("series", F.posexplode("items").alias("k", "item")).withColumns({"entity_id": F.concat(F.lit("nab:"), F.regexp_replace("series", r"\.csv$", "")), "label_kind": F.lit("anomaly"), "label_source": F.lit(file), "source_file": F.lit(f"labels/{file}"), "source_row_id": F.col("k").cast("string")})

    said = F.lit("timezone unavailable in source; preserving naive timestamp")
    points = of("combined_labels.json", "string")
    points = points.withColumns({"label_id": _id("nab", "label", F.col("series"), F.col("k")), "label_value": F.lit("anomaly"), "timestamp": parse_timestamp(F.col("item")), "timestamp_original": F.trim("item"), "metadata_json": _json(nab_series=F.col("series"), label_representation="point_timestamp")})
    points = points.withColumn("quality_flag", F.when(F.coalesce(F.trim("item"), F.lit("")) == "", "MISSING").when(F.col("timestamp").isNull(), "INVALID").otherwise("VALID")).withColumn("timezone_assumption", F.when(F.col("timestamp").isNotNull(), said))
    spans = of("combined_windows.json", "array<string>")
    spans = spans.withColumns({"label_id": _id("nab", "window", F.col("series"), F.col("k")), "label_value": F.lit("anomaly_window"), "timestamp_start": parse_timestamp(F.get("item", F.lit(0))), "timestamp_end": parse_timestamp(F.get("item", F.lit(1))), "metadata_json": _json(nab_series=F.col("series"), label_representation="scoring_window")})
    both = F.col("timestamp_start").isNotNull() & F.col("timestamp_end").isNotNull()
    spans = spans.withColumn("quality_flag", F.when(both, "VALID").otherwise("INVALID")).withColumn("timezone_assumption", F.when(F.coalesce("timestamp_start", "timestamp_end").isNotNull(), said))
    return _label(points, "nab").unionByName(_label(spans, "nab"))


def smd_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Matrices without a header in train/ and test/: a value for each line and place, the line number is the time."""
    root = root.rstrip("/")
    rows = text_lines(spark, [f"{root}/train", f"{root}/test"]).where("trim(value) <> ''").withColumn("source_file", below(F.col("_file"), root))
    rows = rows.withColumn("split", F.substring_index("source_file", "/", 1)).withColumn("entity_id", stem(F.col("source_file")))
    rows = rows.select("*", F.posexplode(F.split(F.trim("value"), ",")).alias("k", "item")).withColumn("metric_value", parse_double(F.col("item"))).where("metric_value is not null")
    rows = rows.withColumn("metric_name", F.format_string("metric_%02d", "k"))
    rows = rows.withColumns({"event_id": _id("smd", F.col("split"), F.col("entity_id"), F.col("sequence_index"), F.col("metric_name")), "host_id": F.col("entity_id"), "metric_type": F.lit("continuous"), "source_dataset": F.lit("smd"), "source_row_id": F.col("sequence_index").cast("string"), "quality_flag": F.lit("VALID"), "metadata_json": _json(metric_index=F.col("k"), temporal_axis="row_index")})
    return shaped(rows, "metrics")


def parse_interpretation(line: Column) -> Column:
    """"10-12:0,2" as (start, end, metrics); null where the line has another shape."""
    shape = r"^\s*(\d+)\s*-\s*(\d+)\s*:(.*)$"
    part = lambda k: F.regexp_extract(line, shape, k)
    metrics = F.transform(F.filter(F.transform(F.split(part(3), ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("int"))
    return F.when(line.rlike(shape), F.struct(part(1).try_cast("long").alias("start"), part(2).try_cast("long").alias("end"), metrics.alias("metrics")))


def smd_labels(spark: SparkSession, root: str) -> DataFrame:
    """0 or 1 for each line of test_label/, and the intervals of interpretation_label/ with the metrics they affect."""
    root = root.rstrip("/")
    rows = text_lines(spark, f"{root}/test_label").withColumn("target", parse_flag(F.col("value"))).where("target is not null").withColumn("source_file", below(F.col("_file"), root)).withColumn("entity_id", stem(F.col("source_file")))
    points = rows.withColumns({"label_id": _id("smd", "test_label", F.col("entity_id"), F.col("sequence_index")), "label_kind": F.when(F.col("target") == 1, "anomaly").otherwise("normal"), "label_value": F.when(F.col("target") == 1, "anomaly").otherwise("normal"), "label_source": F.lit("test_label/*.txt"), "source_row_id": F.col("sequence_index").cast("string"), "quality_flag": F.lit("VALID"), "metadata_json": _json(split="test", raw_label=F.col("target"), label_representation="point_wise_binary")})
    rows = text_lines(spark, f"{root}/interpretation_label", blank=False).withColumn("x", parse_interpretation(F.col("value"))).where("x is not null").withColumn("source_file", below(F.col("_file"), root)).withColumn("entity_id", stem(F.col("source_file")))
    spans = rows.withColumns({"label_id": _id("smd", "interpretation", F.col("entity_id"), F.col("sequence_index")), "label_kind": F.lit("anomaly"), "label_value": F.lit("affected_metric_interval"), "label_source": F.lit("interpretation_label/*.txt"), "start_index": F.col("x.start"), "end_index": F.col("x.end"), "source_row_id": F.col("sequence_index").cast("string"), "quality_flag": F.lit("VALID"), "metadata_json": _json(affected_metric_indices=F.col("x.metrics"), label_representation="interpretation_interval")}).drop("sequence_index")
    return _label(points, "smd").unionByName(_label(spans, "smd"))


def spacecraft_labels(spark: SparkSession, root: str, spacecraft: str) -> DataFrame:
    """Intervals of labeled_anomalies.csv of one spacecraft (SMAP or MSL); a list that does not parse gives none."""
    own = spacecraft.lower()
    rows = _optional(csv_rows(spark, f"{root.rstrip('/')}/labeled_anomalies.csv"), "chan_id", "class", "num_values", "anomaly_sequences")
    craft = rows.where(F.col("spacecraft") == spacecraft.upper()).withColumnRenamed("sequence_index", "row")
    pairs = F.from_json(F.translate("anomaly_sequences", "()", "[]"), "array<array<bigint>>")
    craft = craft.select("*", F.posexplode(F.filter(pairs, lambda x: F.size(x) == 2)).alias("k", "item")).where("item[0] is not null and item[1] is not null")
    kinds = F.regexp_extract_all("class", F.lit("([A-Za-z_]+)"), 1)
    entity = F.coalesce(F.nullif("chan_id", F.lit("")), F.concat(F.lit(f"{own}_channel_"), "row"))
    craft = craft.withColumns({"entity_id": entity, "label_id": _id(own, "label", entity, F.col("k")), "label_kind": F.lit("anomaly"), "label_value": F.coalesce(F.get(kinds, F.col("k")), F.lit("unknown")), "label_source": F.lit("labeled_anomalies.csv"), "start_index": F.col("item")[0], "end_index": F.col("item")[1], "source_file": F.lit("labeled_anomalies.csv"), "source_row_id": F.col("row").cast("string"), "quality_flag": F.lit("VALID"), "metadata_json": _json(spacecraft=spacecraft.upper(), num_values=F.col("num_values"), telemetry_bundle_present=False, label_join_status="unjoinable_until_telemetry_present")})
    return _label(craft, own)


def metropt_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV with a sensor for each column, turned long; flags are those of the wide row."""
    sensors = METROPT_CONTINUOUS + METROPT_BINARY
    raw = _optional(csv_rows(spark, path), *sensors, "_c0").withColumnRenamed("timestamp", "_time")
    rows = with_times(raw, F.col("_time")).withColumn("source_row_id", _row_id(F.col("_c0")))
    keep = ["timestamp", "timestamp_original", "timezone_assumption", "sequence_index", "source_row_id", "quality_flag", "_file"]
    rows = rows.unpivot(keep, list(sensors), "metric_name", "item").withColumn("metric_value", parse_double(F.col("item"))).where("metric_value is not null")
    kind = F.when(F.col("metric_name").isin(*METROPT_BINARY), "binary_state").otherwise("continuous")
    unit = F.create_map(*[F.lit(x) for pair in METROPT_UNITS.items() for x in pair])
    rows = rows.withColumns({"event_id": _id("metropt", F.col("sequence_index"), F.col("metric_name")), "entity_id": F.lit(METROPT_ENTITY), "host_id": F.lit(METROPT_ENTITY), "metric_type": kind, "unit": F.try_element_at(unit, F.col("metric_name")), "source_dataset": F.lit("metropt"), "source_file": F.substring_index("_file", "/", -1), "metadata_json": _json(sensor_family=kind, source_sensor_name=F.col("metric_name"))})
    return shaped(rows, "metrics")


def _ai4i(spark: SparkSession, path: str) -> DataFrame:
    rows = _optional(csv_rows(spark, path), "UDI", "Product ID", "Type", *AI4I_FEATURES, *AI4I_FAILURES)
    entity = F.coalesce(F.nullif("Product ID", F.lit("")), F.concat(F.lit("ai4i_row_"), "sequence_index"))
    return rows.withColumns({"entity_id": entity, "source_row_id": _row_id(F.col("UDI")), "source_dataset": F.lit("ai4i"), "source_file": F.substring_index("_file", "/", -1), "quality_flag": F.lit("VALID")})


_AI4I_KEEP = ["sequence_index", "entity_id", "source_row_id", "source_dataset", "source_file", "quality_flag", "UDI", "Type"]


def ai4i_metrics(spark: SparkSession, path: str) -> DataFrame:
    rows = _ai4i(spark, path).unpivot(_AI4I_KEEP, [F.col(f"`{c}`") for c in AI4I_FEATURES], "feature", "item").withColumn("metric_value", parse_double(F.col("item"))).where("metric_value is not null")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("feature"), r" \[", "_"), r"\]", ""), r"[ /]", "_")
    unit = F.create_map(*[F.lit(x) for pair in AI4I_FEATURES.items() for x in pair])
    rows = rows.withColumns({"event_id": _id("ai4i", F.col("sequence_index"), F.col("feature")), "metric_name": name, "metric_type": F.lit("continuous"), "unit": F.try_element_at(unit, F.col("feature")), "metadata_json": _json(source_feature_name=F.col("feature"), product_type=F.col("Type"), udi=F.col("UDI"))})
    return shaped(rows, "metrics")


def ai4i_failures(spark: SparkSession, path: str) -> DataFrame:
    modes = F.struct(*[parse_flag(F.col(c)).alias(c) for c in AI4I_FAILURES[1:]])
    rows = _ai4i(spark, path).withColumn("target", parse_flag(F.col("Machine failure"))).where("target is not null")
    rows = rows.withColumns({"event_id": _id("ai4i", "failure", F.col("sequence_index")), "failure_type": F.lit("machine_failure"), "label_source": F.lit("Machine failure"), "label_source_type": F.lit("real"), "metadata_json": _json(product_type=F.col("Type"), failure_modes=modes)})
    return shaped(rows, "failures")


def ai4i_labels(spark: SparkSession, path: str) -> DataFrame:
    rows = _ai4i(spark, path).unpivot(_AI4I_KEEP, [F.col(f"`{c}`") for c in AI4I_FAILURES], "label_source", "item").withColumn("target", parse_flag(F.col("item"))).where("target is not null")
    value = F.when(F.col("target") == 1, "failure").otherwise("normal")
    rows = rows.withColumns({"label_id": _id("ai4i", "label", F.col("label_source"), F.col("sequence_index")), "label_kind": value, "label_value": value, "metadata_json": _json(label_column=F.col("label_source"), raw_label=F.col("target"))})
    return _label(rows, "ai4i")


_LOG_COLUMNS = ("LineId", "Logrecord", "Date", "Time", "Timestamp", "Pid", "Process", "Id", "Level", "Component", "ADDR", "Content", "EventId", "EventTemplate", "Node", "NodeRepeat")


def _loghub(spark: SparkSession, path: str, family: str) -> DataFrame:
    if family not in LOGHUB_FAMILIES:
        raise KeyError(f"unknown log family: {family}")
    raw = _optional(csv_rows(spark, path), *_LOG_COLUMNS)
    both = combine_date_time(F.col("Date"), F.col("Time"))
    original = F.coalesce(F.nullif("Timestamp", F.lit("")), both) if family == "bgl" else both
    rows = with_times(raw.withColumn("_original", original).withColumnRenamed("Timestamp", "_stamp"), F.col("_original"), "UTC" if family == "bgl" else None)
    return rows.withColumns({"source_dataset": F.lit(f"loghub-{family}"), "source_file": F.substring_index("_file", "/", -1), "source_row_id": _row_id(F.col("LineId"))})


def loghub_logs(spark: SparkSession, path: str, family: str) -> DataFrame:
    """A structured log CSV: entity is the node, else the component, else the collection."""
    rows = _loghub(spark, path, family)
    first = lambda *names: blank_to_null(F.coalesce(*[F.nullif(n, F.lit("")) for n in names]))
    component, node = blank_to_null(F.col("Component")), first("Node", "NodeRepeat")
    rows = rows.withColumns({"event_id": _id(f"loghub-{family}", F.col("source_row_id")), "service_id": component, "host_id": node, "entity_id": F.coalesce(node, component, F.lit(f"loghub-{family}:logs")), "process_id": first("Pid", "Process", "Id"), "request_id": request_id(F.col("ADDR"), F.col("Content")), "log_level": blank_to_null(F.col("Level")), "event_type": blank_to_null(F.col("EventId")), "event_template": blank_to_null(F.col("EventTemplate")), "message": F.coalesce("Content", F.lit(""))})
    return shaped(rows.withColumn("metadata_json", _json(family=family, line_id=F.col("LineId"), logrecord=F.col("Logrecord"), addr=F.col("ADDR"), source_event_id=F.col("EventId"))), "logs")


def loghub_labels(spark: SparkSession, path: str, family: str) -> DataFrame:
    """A label for each line where the file has a column Label ("-" is normal); no rows where it has none."""
    rows = _loghub(spark, path, family)
    if "Label" not in rows.columns:
        rows = rows.withColumn("Label", F.lit(None).cast("string")).where(F.lit(False))
    raw = F.coalesce("Label", F.lit(""))
    rows = rows.withColumns({"label_id": _id(f"loghub-{family}", "label", F.col("sequence_index")), "label_kind": F.when(raw == "-", "normal").otherwise("anomaly"), "label_value": F.when(raw == "-", "normal").otherwise(raw), "label_source": F.lit("Label"), "event_id": _id(f"loghub-{family}", F.col("source_row_id")), "entity_id": F.coalesce(F.nullif("Node", F.lit("")), "Component"), "service_id": F.col("Component"), "quality_flag": F.lit("VALID"), "metadata_json": _json(raw_label=raw, family=family)})
    return _label(rows, f"loghub-{family}")


def reader(dataset: str) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Table name → reader of a collection, by its id or alias (case and underscores do not matter)."""
    name = dataset.lower().replace("_", "-")
    known: dict[str, dict] = {
        "nab": {"metrics": nab_metrics, "labels": nab_labels},
        "smd": {"metrics": smd_metrics, "labels": smd_labels},
        "smap": {"labels": lambda s, p: spacecraft_labels(s, p, "SMAP")},
        "msl": {"labels": lambda s, p: spacecraft_labels(s, p, "MSL")},
        "metropt": {"metrics": metropt_metrics},
        "ai4i": {"metrics": ai4i_metrics, "failures": ai4i_failures, "labels": ai4i_labels},
    }
    for f in LOGHUB_FAMILIES:
        known[f"loghub-{f}"] = {"logs": lambda s, p, f=f: loghub_logs(s, p, f), "labels": lambda s, p, f=f: loghub_labels(s, p, f)}
    if name not in known:
        raise KeyError(f"unknown dataset: {dataset}")
    return known[name]
