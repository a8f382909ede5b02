import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from telemetra.sources import readers, scan, schemas, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-01-02 03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)),
        (' "2024-01-02T03:04:05,250" ', dt.datetime(2024, 1, 2, 3, 4, 5, 250000)),
        ("2024-01-02", dt.datetime(2024, 1, 2)),
        ("17/06/09 20:10:40", dt.datetime(2017, 6, 9, 20, 10, 40)),
        ("2005.06.03", dt.datetime(2005, 6, 3)),
        ("081109 203615", dt.datetime(2009, 8, 11, 20, 36, 15)),
        ("1117838570", dt.datetime(2005, 6, 3, 22, 42, 50)),
        ("2024-13-02", None),
        ("2024", None),
        ("", None),
        (None, None),
    ],
)
def test_timestamps(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(scan.parse_timestamp(F.col("x"))).first()[0] == want


def test_nab(spark, tmp_path):
    put(tmp_path / "data/a/one.csv", "timestamp,value\n2024-01-01 00:00:00,1\n2024-01-01 00:10:00,2\n2024-01-01 00:05:00,3\n2024-01-01 00:10:00,4\nbad,5\n2024-01-01 00:20:00,x\n")
    put(tmp_path / "labels/combined_labels.json", json.dumps({"a/one.csv": ["2024-01-01 00:10:00", "bad"]}))
    put(tmp_path / "labels/combined_windows.json", json.dumps({"a/one.csv": [["2024-01-01 00:00:00", "2024-01-01 00:10:00"], []]}))
    rows = readers.nab_metrics(spark, str(tmp_path)).orderBy("sequence_index").collect()
    assert [(r.sequence_index, r.metric_value, r.quality_flag) for r in rows] == [(0, 1.0, "VALID"), (1, 2.0, "VALID"), (2, 3.0, "OUT_OF_ORDER"), (3, 4.0, "DUPLICATE"), (4, 5.0, "INVALID")]
    assert (rows[0].entity_id, rows[0].metric_name, rows[0].event_id, rows[0].source_file) == ("nab:a/one", "one", "nab:a/one.csv:0", "data/a/one.csv")
    labels = readers.reader("NAB")["labels"](spark, str(tmp_path)).collect()
    assert sorted((r.label_value, r.quality_flag) for r in labels) == [("anomaly", "INVALID"), ("anomaly", "VALID"), ("anomaly_window", "INVALID"), ("anomaly_window", "VALID")]


def test_row_index_and_flags_over_blocks(spark, tmp_path):
    lines = [f"2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d},{i}" for i in range(3000)]
    lines[1500] = "2023-12-31 00:00:00,1500"
    put(tmp_path / "data/long.csv", "timestamp,value\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = readers.nab_metrics(spark, str(tmp_path))
        rows = df.orderBy("sequence_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.sequence_index, r.metric_value) for r in rows] == [(i, float(i)) for i in range(3000)]
    assert [r.sequence_index for r in rows if r.quality_flag != "VALID"] == [1500]


def test_smd(spark, tmp_path):
    for part, n in (("train", 30), ("test", 24)):
        put(tmp_path / part / "machine-1-1.txt", "".join(f"{i / 10},{i / 5},{i}\n" for i in range(n)))
    put(tmp_path / "test_label/machine-1-1.txt", "".join(f"{int(10 <= i < 13)}\n" for i in range(24)))
    put(tmp_path / "interpretation_label/machine-1-1.txt", "\n10-12:0,2\nnonsense\n")
    metrics = readers.smd_metrics(spark, str(tmp_path))
    assert metrics.groupBy("split").count().collect() and metrics.count() == 54 * 3
    assert metrics.where("event_id = 'smd:test:machine-1-1:3:metric_02'").first().metric_value == 3.0
    labels = readers.smd_labels(spark, str(tmp_path))
    assert [r.sequence_index for r in labels.where("label_value = 'anomaly'").orderBy("sequence_index").collect()] == [10, 11, 12]
    span = labels.where("start_index is not null").collect()
    assert [(r.start_index, r.end_index, json.loads(r.metadata_json)["affected_metric_indices"]) for r in span] == [(10, 12, [0, 2])]
    assert span[0].source_row_id == "0"
    assert labels.where(~schemas.is_valid("labels")).count() == 0


def test_spacecraft(spark, tmp_path):
    put(tmp_path / "labeled_anomalies.csv", 'chan_id,spacecraft,anomaly_sequences,class,num_values\nP-1,SMAP,"[[1, 2], [3, 4]]",[point],99\nM-1,MSL,"[(5, 6)]",[contextual],9\nP-2,SMAP,bad,[point],1\n')
    rows = readers.reader("smap")["labels"](spark, str(tmp_path)).orderBy("start_index").collect()
    assert [(r.entity_id, r.start_index, r.end_index, r.label_value) for r in rows] == [("P-1", 1, 2, "point"), ("P-1", 3, 4, "unknown")]
    assert [(r.start_index, r.end_index) for r in readers.reader("msl")["labels"](spark, str(tmp_path)).collect()] == [(5, 6)]


def test_metropt(spark, tmp_path):
    names = readers.METROPT_CONTINUOUS + readers.METROPT_BINARY
    row = lambda i, t: f"{i * 10},{t}," + ",".join([str(i + k) for k in range(7)] + [str((i // 4 + k) % 2) for k in range(8)])
    path = put(tmp_path / "m.csv", "," + ",".join(("timestamp", *names)) + "\n" + "\n".join([row(0, "2020-02-01 00:00:00"), row(1, "2020-02-01 00:00:10")]) + "\n")
    rows = readers.metropt_metrics(spark, path).collect()
    assert len(rows) == 30
    got = {(r.sequence_index, r.metric_name): r for r in rows}
    assert got[1, "Motor_current"].metric_value == 7.0 and got[1, "Motor_current"].unit == "ampere" and got[1, "COMP"].metric_type == "binary_state" and got[1, "TP2"].source_row_id == "10"


def test_ai4i(spark, tmp_path):
    head = "UDI,Product ID,Type,Air temperature [K],Process temperature [K],Rotational speed [rpm],Torque [Nm],Tool wear [min],Machine failure,TWF,HDF,PWF,OSF,RNF\n"
    path = put(tmp_path / "ai4i2020.csv", head + "1,M1,M,298.1,308.6,1551,42.8,0,0,0,0,0,0,0\n2,L2,L,298.2,308.7,1408,46.3,3,1,0,1,0,0,0\n")
    assert readers.ai4i_metrics(spark, path).count() == 10
    assert {r.metric_name for r in readers.ai4i_metrics(spark, path).collect()} == {"air_temperature_k", "process_temperature_k", "rotational_speed_rpm", "torque_nm", "tool_wear_min"}
    assert [(r.entity_id, r.target) for r in readers.ai4i_failures(spark, path).orderBy("entity_id").collect()] == [("L2", 1), ("M1", 0)]
    assert readers.ai4i_labels(spark, path).count() == 12


def test_loghub(spark, tmp_path):
    head = "LineId,Logrecord,Date,Time,Pid,Level,Component,ADDR,Content,EventId,EventTemplate\n"
    path = put(tmp_path / "OpenStack_2k.log_structured.csv", head + '1,x,2017-05-16,00:00:00.008,25746,INFO,nova.api,req-38101a0b-2096-447d,"said ""hi"", left",E25,<*>\n')
    r = readers.loghub_logs(spark, path, "openstack").first()
    assert (r.request_id, r.event_type, r.service_id, r.entity_id, r.message, r.timestamp) == ("req-38101a0b-2096-447d", "E25", "nova.api", "nova.api", 'said "hi", left', dt.datetime(2017, 5, 16, 0, 0, 0, 8000))
    assert readers.loghub_labels(spark, path, "openstack").count() == 0
    path = put(tmp_path / "bgl.csv", "LineId,Label,Timestamp,Date,Node,Time,NodeRepeat,Type,Component,Level,Content,EventId,EventTemplate\n1,-,1117838570,2005.06.03,R02,x,R02,RAS,KERNEL,INFO,a,E1,a\n2,KERNDTLB,1117838571,2005.06.03,,x,,RAS,KERNEL,FATAL,b,E2,b\n")
    assert [(r.label_value, r.label_kind) for r in readers.loghub_labels(spark, path, "bgl").orderBy("sequence_index").collect()] == [("normal", "normal"), ("KERNDTLB", "anomaly")]
    assert [r.entity_id for r in readers.loghub_logs(spark, path, "bgl").orderBy("sequence_index").collect()] == ["R02", "KERNEL"]
    with pytest.raises(KeyError):
        readers.reader("nothing")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a/b", 1), ("a:b", 2), (None, 3)], "entity_id string, v int")
    sinks.write_partitioned(df, str(tmp_path / "t"), ("entity_id",))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted((r.v, r.entity_id, r.entity_id_partition) for r in back.collect()) == [(1, "a/b", "a_b"), (2, "a:b", "a_b"), (3, None, "unknown")]
    assert sinks.rows_by_file(spark, str(tmp_path / "t")).agg(F.sum("n")).first()[0] == 3
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert sinks.read_jsonl(spark, str(tmp_path / "j"), "entity_id string, v int").count() == 3
    put(tmp_path / "bad.jsonl", '{"v": 1}\n\n[1]\n')
    with pytest.raises(Exception, match="not a JSON object"):
        sinks.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "v int").collect()
    put(tmp_path / "f/x.bin", "abc")
    put(tmp_path / "f/y.bin", "abcdef")
    got = {r.bytes: r.sha256 for r in sinks.file_manifest(spark, str(tmp_path / "f"), 3).collect()}
    assert got[3].startswith("ba7816bf") and got[6] is None
    new = spark.createDataFrame([("a/b", 9)], df.schema)
    assert sorted(r.v for r in sinks.upsert(df, new, ["entity_id"]).collect()) == [2, 3, 9]
