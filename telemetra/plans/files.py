"""Queries over small files that the query itself writes: readers of collections, documents, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.functions import scalars as S
from telemetra.operators import retrieval as R
from telemetra.operators import text as X
from telemetra.plans.catalogue import query, rounded, table
from telemetra.sources import catalog as C
from telemetra.sources import readers, schemas, sinks

FILES = {
    "nab/data/art/a.csv": "timestamp,value\n2014-04-01 00:00:00,1.5\n2014-04-01 00:05:00,x\n2014-04-01 00:10:00,2\n2014-04-01 00:10:00,3\n2014-04-01 00:07:00,4\n",
    "nab/data/real/b.csv": "timestamp,value\n2014-04-02 00:00:00,-1e3\n",
    "nab/labels/combined_labels.json": '{"art/a.csv": ["2014-04-01 00:10:00"], "real/b.csv": []}',
    "nab/labels/combined_windows.json": '{"art/a.csv": [["2014-04-01 00:05:00.000000", "2014-04-01 00:10:00.000000"]], "real/b.csv": []}',
    "smd/train/machine-1-1.txt": "0.1,0.2\n0.3,0.4\n",
    "smd/test/machine-1-1.txt": "0.5,0.6\n",
    "smd/test_label/machine-1-1.txt": "1\n",
    "smd/interpretation_label/machine-1-1.txt": "10-12:0,2\nbad\n",
    "smap/labeled_anomalies.csv": 'chan_id,spacecraft,anomaly_sequences,class,num_values\nP-1,SMAP,"[[1, 5], [9, 12]]","[point, contextual]",20\nM-1,MSL,"[[2, 3]]",[point],10\n',
    "ai4i/ai4i2020.csv": "UDI,Product ID,Type,Air temperature [K],Process temperature [K],Rotational speed [rpm],Torque [Nm],Tool wear [min],Machine failure,TWF,HDF,PWF,OSF,RNF\n1,M1,M,298.1,308.6,1551,42.8,0,0,0,0,0,0,0\n2,L2,L,298.2,308.7,1408,46.3,3,1,0,1,0,0,0\n",
    "loghub/BGL_2k.log_structured.csv": 'LineId,Label,Timestamp,Date,Node,Time,NodeRepeat,Type,Component,Level,Content,EventId,EventTemplate\n1,-,1117838570,2005.06.03,R02,2005-06-03-15.42.50.675872,R02,RAS,KERNEL,INFO,"ok, req-12345678-ab",E1,ok\n2,APPREAD,1117838571,2005.06.03,,2005-06-03-15.42.51.675872,,RAS,APP,FATAL,bad,E2,bad\n',
    "docs/openstack/nova.md": "---\ndocument_id: nova-1\ntitle: Nova\ndomain: cloud_infrastructure\n---\n\n# Nova guide\n\nFirst  part.\n\n\n\n## Restart\nRestart the service.\n",
    "docs/linux/kernel_notes.txt": "Kernel notes\r\nswap is full\n",
    "docs/docker/alert.html": '<html><head><title>Alert page</title><meta name="technology" content="docker"><meta name="x" content="y"></head><body><script>hidden()</script><h1>Alert</h1><p>Container   down</p></body></html>',
    "docs/retrieval_eval.jsonl": '{"query": "restart nova", "expected_document_ids": ["nova-1"], "domain": "cloud_infrastructure"}\n\n{"query_id": "own", "query": "swap", "expected_document_ids": ["k"]}\n',
    "docs/photo.png": "x",
}
CATALOG = """
datasets:
  - name: nab
    aliases: [numenta]
    access: public
  - name: loghub-bgl
    aliases: [bgl, blue_gene]
    group: loghub
  - name: private-set
    access: manual
"""


def fixture(spark, part: str) -> str:
    root = sinks.scratch(spark, "files")
    for name, text in FILES.items():
        if name.split("/")[0] == part:
            sinks.write_text(spark, f"{root}/{name}", text)
    return f"{root}/{part}"


def values(names: str, *rows: tuple) -> str:
    one = lambda v: "NULL" if v is None else repr(v) if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


@query(values("entity_id, metric_name, moment, sequence_index, metric_value, quality_flag", ("nab:art/a", "a", "2014-04-01 00:00:00", 0, 1.5, "VALID"), ("nab:art/a", "a", "2014-04-01 00:10:00", 2, 2.0, "VALID"), ("nab:art/a", "a", "2014-04-01 00:10:00", 3, 3.0, "DUPLICATE"), ("nab:art/a", "a", "2014-04-01 00:07:00", 4, 4.0, "OUT_OF_ORDER"), ("nab:real/b", "b", "2014-04-02 00:00:00", 0, -1000.0, "VALID")))
def read_nab_metrics(spark, d):
    out = readers.reader("NAB")["metrics"](spark, fixture(spark, "nab"))
    return out.select("entity_id", "metric_name", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("moment"), "sequence_index", "metric_value", "quality_flag")


@query(values("label_kind, entity_id, moment, a, b", ("point", "nab:art/a", "2014-04-01 00:10:00", None, None), ("window", "nab:art/a", None, "2014-04-01 00:05:00", "2014-04-01 00:10:00")))
def read_nab_labels(spark, d):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    out = readers.reader("nab")["labels"](spark, fixture(spark, "nab"))
    kind = F.when(F.col("timestamp_start").isNull(), "point").otherwise("window")
    return out.select(kind.alias("label_kind"), "entity_id", shown("timestamp").alias("moment"), shown("timestamp_start").alias("a"), shown("timestamp_end").alias("b"))


@query(values("split, metric_name, sequence_index, metric_value", ("train", "metric_00", 0, 0.1), ("train", "metric_01", 0, 0.2), ("train", "metric_00", 1, 0.3), ("train", "metric_01", 1, 0.4), ("test", "metric_00", 0, 0.5), ("test", "metric_01", 0, 0.6)))
def read_smd_metrics(spark, d):
    return readers.reader("smd")["metrics"](spark, fixture(spark, "smd")).select("split", "metric_name", "sequence_index", "metric_value")


@query(values("label_kind, label_value, sequence_index, start_index, end_index", ("anomaly", "anomaly", 0, None, None), ("anomaly", "affected_metric_interval", None, 10, 12)))
def read_smd_labels(spark, d):
    return readers.reader("smd")["labels"](spark, fixture(spark, "smd")).select("label_kind", "label_value", "sequence_index", "start_index", "end_index")


@query(values("label_value, start_index, end_index", ("point", 1, 5), ("contextual", 9, 12)))
def read_smap_labels(spark, d):
    return readers.reader("smap")["labels"](spark, fixture(spark, "smap")).select("label_value", "start_index", "end_index")


@query(values("metric_name, sequence_index, metric_value", ("air_temperature_k", 0, 298.1), ("process_temperature_k", 0, 308.6), ("rotational_speed_rpm", 0, 1551.0), ("torque_nm", 0, 42.8), ("tool_wear_min", 0, 0.0), ("air_temperature_k", 1, 298.2), ("process_temperature_k", 1, 308.7), ("rotational_speed_rpm", 1, 1408.0), ("torque_nm", 1, 46.3), ("tool_wear_min", 1, 3.0)))
def read_ai4i_metrics(spark, d):
    return readers.reader("ai4i")["metrics"](spark, fixture(spark, "ai4i")).select("metric_name", "sequence_index", "metric_value")


@query("SELECT 'failures' AS kind, CAST(2 AS BIGINT) AS n, CAST(1 AS BIGINT) AS positives UNION ALL SELECT 'labels', 12, 2")
def read_ai4i_failures(spark, d):
    r, path = readers.reader("ai4i"), fixture(spark, "ai4i")
    one = lambda df, kind, y: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.count_if(y).alias("positives"))
    return one(r["failures"](spark, path), "failures", F.col("target") == 1).unionByName(one(r["labels"](spark, path), "labels", F.col("label_kind") == "failure"))


@query(values("entity_id, log_level, event_type, request_id, message", ("R02", "INFO", "E1", "req-12345678-ab", "ok, req-12345678-ab"), ("APP", "FATAL", "E2", None, "bad")))
def read_loghub_logs(spark, d):
    return readers.reader("loghub_bgl")["logs"](spark, f"{fixture(spark, 'loghub')}/BGL_2k.log_structured.csv").select("entity_id", "log_level", "event_type", "request_id", "message")


@query(values("label_kind, label_value", ("normal", "normal"), ("anomaly", "APPREAD")))
def read_loghub_labels(spark, d):
    return readers.reader("loghub-bgl")["labels"](spark, f"{fixture(spark, 'loghub')}/BGL_2k.log_structured.csv").select("label_kind", "label_value")


@query(values("name, aliases, access, chosen", ("nab", "numenta", "public", True), ("loghub-bgl", "bgl|blue_gene", "public", True), ("private-set", "", "manual", False)))
def dataset_catalog(spark, d):
    known = C.parse_catalog(CATALOG)
    chosen = C.resolve(known, ["Numenta", "LOGHUB"])
    if C.resolve(known, ["blue-gene", "public"]) != ["nab", "loghub-bgl"] or len(C.resolve(known, ["all"])) != 3:
        raise AssertionError("selection")
    return C.catalog_table(spark, known).select("name", "aliases", "access", F.col("name").isin(*chosen).alias("chosen"))


@query(values("name, bytes, format, sha256", *((k.split("/")[-1], len(v), {"md": "markdown", "txt": "text", "html": "html", "jsonl": "jsonl", "png": "png"}[k.rpartition(".")[2]], __import__("hashlib").sha256(v.encode()).hexdigest()) for k, v in FILES.items() if k.startswith("docs/"))))
def file_manifest(spark, d):
    path = fixture(spark, "docs")
    return sinks.list_files(spark, path).join(sinks.file_manifest(spark, path).select("path", "sha256"), "path").drop("path")


@query(values("pattern, files, status", ("pages", 1, "PRESENT"), ("pdf", 0, "INCOMPLETE"), ("texts", 2, "PRESENT")))
def expected_files(spark, d):
    return sinks.expected_files(sinks.list_files(spark, fixture(spark, "docs")), {"texts": r"\.(md|txt)$", "pages": r"\.html$", "pdf": r"\.pdf$"})


@query(values("format, files, bytes", ("markdown", 1, len(FILES["docs/openstack/nova.md"])), ("text", 1, len(FILES["docs/linux/kernel_notes.txt"])), ("html", 1, len(FILES["docs/docker/alert.html"])), ("jsonl", 1, len(FILES["docs/retrieval_eval.jsonl"])), ("png", 1, 1)))
def stage_summary(spark, d):
    return sinks.stage_summary(sinks.list_files(spark, fixture(spark, "docs")))


_sha = lambda x: __import__("hashlib").sha1(x.encode()).hexdigest()[:8]


@query(values("document_id, path, kind, title, domain, content", ("nova-1", "openstack/nova.md", "markdown", "Nova", "cloud_infrastructure", "# Nova guide\n\nFirst part.\n\n## Restart\nRestart the service."), (f"kernel_notes_{_sha('linux/kernel_notes.txt|Kernel Notes')}", "linux/kernel_notes.txt", "text", "Kernel Notes", "operating_system", "Kernel notes\nswap is full"), (f"alert_{_sha('docker/alert.html|Alert page')}", "docker/alert.html", "html", "Alert page", "containers", "Alert page \n Alert \n \n Container down")))
def load_documents(spark, d):
    return C.load_documents(spark, fixture(spark, "docs")).select("document_id", "path", "kind", "title", "domain", "content")


@query(values("query_id, query, documents, domain", ("q0001", "restart nova", "nova-1", "cloud_infrastructure"), ("own", "swap", "k", None)))
def evaluation_records(spark, d):
    return C.evaluation_records(spark, f"{fixture(spark, 'docs')}/retrieval_eval.jsonl").select("query_id", "query", F.array_join("documents", "|").alias("documents"), "domain")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def partitioned_write(spark, d):
    path = sinks.scratch(spark, "written")
    sinks.write_partitioned(table(spark, d, "events"), f"{path}/events", ("event_type",))
    return spark.read.parquet(f"{path}/events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def filtered_scan(spark, d):
    return sinks.filtered_table(spark, f"{d}/events.parquet", {"event_type": "click"}, ["event_id", "user_id"])


@query("SELECT r_regionkey, r_name, 'csv' AS kind FROM region UNION ALL SELECT r_regionkey, r_name, 'parquet' FROM region")
def read_csv_or_parquet(spark, d):
    path, rows = sinks.scratch(spark, "either"), table(spark, d, "region").select("r_regionkey", "r_name")
    sinks.write_artifact(rows, f"{path}/a.csv", "csv")
    sinks.write_artifact(rows, f"{path}/b.csv", "csv")
    sinks.write_artifact(rows.withColumn("more", F.lit(1)), f"{path}/b.parquet", "parquet")
    own = lambda n, k: sinks.read_either(spark, f"{path}/{n}", "r_regionkey int, r_name string").withColumn("kind", F.lit(k))
    return own("a", "csv").unionByName(own("b", "parquet"))


@query("SELECT c_custkey, c_name FROM customer")
def jsonl_roundtrip(spark, d):
    path = f"{sinks.scratch(spark, 'jsonl')}/rows"
    sinks.write_jsonl(table(spark, d, "customer").select("c_custkey", "c_name"), path)
    return sinks.read_jsonl(spark, path, "c_custkey bigint, c_name string")


@query("SELECT 'a' AS k, 2 AS v UNION ALL SELECT 'b', 1 UNION ALL SELECT 'c', 3")
def manifest_upsert(spark, d):
    old, new = (spark.createDataFrame(rows, "k string, v int") for rows in ([("a", 1), ("b", 1)], [("a", 2), ("c", 3)]))
    return sinks.upsert(old, new, ["k"])


@query("SELECT 'events' AS kind, count(*) AS n, count(DISTINCT user_id % 7) AS entities, count(*) FILTER (event_id % 5 = 0) AS n_duplicate FROM events")
def lineage_record(spark, d):
    e = table(spark, d, "events").select(F.col("ts").alias("timestamp"), (F.col("user_id") % 7).cast("string").alias("entity_id"), F.when(F.col("event_id") % 5 == 0, "DUPLICATE").otherwise("VALID").alias("quality_flag"))
    return sinks.lineage(e, "events", "events", "table").select("kind", "n", F.col("n_entities_approx").alias("entities"), "n_duplicate")


@query(values("dataset, status", ("nab", "READY"), ("smd", "INCOMPLETE"), ("opentelemetry-demo", "REFERENCE_READY"), ("cicids2017", "MANUAL_DOWNLOAD"), ("private", "MANUAL_ACCESS"), ("mine", "PRESENT_UNVERIFIED")))
def dataset_status(spark, d):
    rows = spark.createDataFrame([("nab", 0, False, True), ("smd", 2, False, True), ("opentelemetry-demo", 0, False, False), ("cicids2017", 1, True, False), ("private", 1, True, False), ("mine", 0, True, True)], "dataset string, n int, manual boolean, present boolean")
    return rows.select("dataset", sinks.dataset_status(F.col("dataset"), F.col("n"), F.col("manual"), F.col("present")).alias("status"))


@query("SELECT count(*) AS n_valid, CAST(0 AS BIGINT) AS n_invalid FROM events")
def schema_validity(spark, d):
    return schemas.validity(schemas.shaped(table(spark, d, "events").withColumnRenamed("ts", "timestamp"), "metrics"), "metrics")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' AS titled, NOT contains(html, '<title>') AS bare FROM pages")
def page_titles(spark, d):
    return X.page_texts(table(spark, d, "pages")).select("page_id", F.col("title").isNotNull().alias("titled"), F.col("title").isNull().alias("bare"))


@query()
def html_visible_text(spark, d):
    return X.visible_text(table(spark, d, "pages"))


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '\n\s*\n'), lambda p: trim(p, chr(32) || chr(9) || chr(10) || chr(13)) <> '')) AS paragraphs FROM documents""")
def split_paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(R.paragraphs(R.stripped(F.col("text")))).cast("long").alias("paragraphs"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) FILTER (regexp_matches(trim(line), '^#{1,6}\s+.+$')) AS headings FROM l GROUP BY doc_id""")
def markdown_headings(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy("doc_id").agg(F.sum(F.size(R.headings(F.col("text"))).cast("long")).alias("headings"))


@query()
def markdown_chunks(spark, d):
    return R.packed_chunks(table(spark, d, "documents"), "doc_id", "text")


def store(spark, d):
    b = table(spark, d, "benchmark")
    return b.select(F.concat(F.lit("c"), F.lpad(F.col("item_id").cast("string"), 5, "0")).alias("chunk_id"), "text", F.concat(F.lit("d"), F.col("item_id") % 5).alias("document_id"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("domain"))


def questions(spark, d):
    return table(spark, d, "benchmark").where("item_id % 4 = 1").select(F.concat(F.lit("q"), F.lpad(F.col("item_id").cast("string"), 5, "0")).alias("query_id"), F.array_join(F.slice(X.tokens(F.col("text")), 3, 8), " ").alias("query"), F.when(F.col("item_id") % 8 == 1, "odd").alias("wanted"))


_vec = lambda name, ident, source: f"""{name}t AS (SELECT {ident} AS id, sha256(unnest(regexp_extract_all(lower(text), '[a-z0-9_./:-]+'))) AS h FROM {source}), {name}w AS (SELECT id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 384 AS slot, sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS w FROM {name}t GROUP BY ALL HAVING w <> 0),
    {name} AS (SELECT id, slot, CAST(w AS DOUBLE) / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {name}w)"""  # noqa: E731
STORE = f"""so AS (SELECT 'c' || lpad(CAST(item_id AS VARCHAR), 5, '0') AS chunk_id, text, 'd' || (item_id % 5) AS document_id, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS domain FROM benchmark),
    qu AS (SELECT 'q' || lpad(CAST(item_id AS VARCHAR), 5, '0') AS query_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9_./:-]+')[3:10], ' ') AS text, CASE WHEN item_id % 8 = 1 THEN 'odd' END AS wanted FROM benchmark WHERE item_id % 4 = 1), {_vec('cv', 'chunk_id', 'so')}, {_vec('qv', 'query_id', 'qu')},
    pr AS (SELECT qv.id AS query_id, cv.id AS chunk_id, sum(qv.w * cv.w) AS score FROM qv JOIN cv USING (slot) GROUP BY ALL HAVING score >= 0.05)"""


def embed(df, ident, text):
    return X.hashing_embedding(df, ident, text)


@query(f"""WITH {STORE}, k AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS position FROM pr JOIN qu USING (query_id) JOIN so USING (chunk_id) WHERE wanted IS NULL OR wanted = domain) SELECT query_id, chunk_id, round(score, 6) AS score, position FROM k WHERE position <= 3""")
def dense_retrieval(spark, d):
    return rounded(R.retrieve(questions(spark, d), store(spark, d), embed, 3, least=0.05, domain="wanted"), "score")


@query(f"""WITH {STORE}, k AS (SELECT query_id, chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS p FROM pr QUALIFY p <= 6), o AS (SELECT k.*, len(list_intersect(list_distinct(string_split(qu.text, ' ')), regexp_extract_all(lower(so.text), '[a-z0-9_./:-]+'))) / len(list_distinct(string_split(qu.text, ' '))) AS overlap FROM k JOIN qu USING (query_id) JOIN so USING (chunk_id))
    SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, score DESC, chunk_id) AS INTEGER) AS position FROM o QUALIFY position <= 3""")
def reranked_retrieval(spark, d):
    return rounded(R.retrieve(questions(spark, d), store(spark, d), embed, 3, rerank_k=6, least=0.05), "score")


GOLD = "gd AS (SELECT query_id, ['c' || substr(query_id, 2), 'c00002'] AS expected FROM qu)"


def results(spark, d):
    return R.retrieve(questions(spark, d), store(spark, d), embed, 5, least=0.05).withColumnRenamed("chunk_id", "unit")


def gold(spark, d):
    return questions(spark, d).select("query_id", F.array(F.concat(F.lit("c"), F.substring("query_id", 2, 5)), F.lit("c00002")).alias("expected"))


METRICS = f"""WITH {STORE}, {GOLD}, k AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS p FROM pr QUALIFY p <= 5), h AS (SELECT gd.query_id, p FROM gd JOIN k USING (query_id) WHERE list_contains(expected, chunk_id)),
    mt AS (SELECT gd.query_id, count(p) / 5 AS precision, least(count(p) / len(list_distinct(any_value(expected))), 1) AS recall, coalesce(1 / min(p), 0) AS reciprocal_rank, coalesce(sum(1 / log2(p + 1)), 0) / CASE len(list_distinct(any_value(expected))) WHEN 1 THEN 1 ELSE 1 + 1 / log2(3) END AS ndcg FROM gd LEFT JOIN h USING (query_id) GROUP BY gd.query_id)"""


@query(METRICS + " SELECT query_id, precision, recall, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg FROM mt")
def retrieval_metrics(spark, d):
    return rounded(R.retrieval_metrics(gold(spark, d), results(spark, d), 5), "reciprocal_rank", "ndcg")


@query(METRICS + " SELECT 'dense' AS configuration, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr, CAST(0.5 AS DOUBLE) AS latency FROM mt")
def best_configuration(spark, d):
    one = R.retrieval_metrics(gold(spark, d), results(spark, d), 5).agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))
    both = one.select(F.lit("dense").alias("configuration"), "recall", "mrr", F.lit(0.5).alias("latency")).unionByName(one.select(F.lit("slow").alias("configuration"), "recall", "mrr", F.lit(2.0).alias("latency")))
    return R.best_configuration(both)


@query("SELECT round(count(*) FILTER (item_id % 5 <> 0 AND text <> '') / count(*), 6) AS completeness FROM benchmark")
def citation_completeness(spark, d):
    b = table(spark, d, "benchmark").select("text", F.when(F.col("item_id") % 5 != 0, "src").alias("source"), F.lit(0.5).alias("score"))
    return rounded(R.citation_completeness(b, ["text", "source"]), "completeness")


@query(f"""WITH {STORE}, k AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS p FROM pr QUALIFY p <= 2), g AS (SELECT query_id, list(DISTINCT domain) AS dm, list(DISTINCT document_id) AS dc, list(chunk_id) AS ch FROM k JOIN so USING (chunk_id) GROUP BY query_id)
    SELECT query_id, CASE WHEN dm IS NULL THEN 'no_results' WHEN dm <> ['odd'] THEN 'cross_domain_confusion' WHEN NOT list_contains(dc, 'd1') THEN 'correct_document_not_retrieved' WHEN NOT list_contains(ch, 'c00001') THEN 'correct_section_not_retrieved' ELSE 'relevant_item_ranked_too_low' END AS failure FROM qu LEFT JOIN g USING (query_id)""")
def retrieval_failures(spark, d):
    r = R.retrieve(questions(spark, d), store(spark, d), embed, 2, least=0.05).join(store(spark, d), "chunk_id").select("query_id", "domain", F.col("document_id").alias("document"), F.col("chunk_id").alias("chunk"))
    g = questions(spark, d).select("query_id", F.lit("odd").alias("domain"), F.array(F.lit("d1")).alias("documents"), F.array(F.lit("c00001")).alias("chunks"))
    return R.failure_class(g, r)


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'cloud_infrastructure' WHEN event_type = 'view' THEN 'containers' WHEN event_type = 'error' THEN 'industrial' WHEN event_type = 'purchase' THEN 'monitoring' END AS domain FROM events""")
def infer_domain(spark, d):
    words = F.when(F.col("event_type") == "click", "Nova is down").when(F.col("event_type") == "view", "Pod latency").when(F.col("event_type") == "error", "").when(F.col("event_type") == "purchase", "an ALERT").otherwise("none")
    source = F.when(F.col("event_type") == "error", "MetroPT-3")
    e = table(spark, d, "events").withColumns({"w": R.incident_query(words, F.lit(None).cast("string"), F.lit("")), "s": source})
    return e.select("event_id", R.infer_domain(F.col("w"), F.col("s")).alias("domain"))


@query("""WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_./:-]+') AS t FROM benchmark) SELECT item_id, len(t) + greatest(len(t) - 1, 0) AS n, md5(array_to_string(CASE WHEN len(t) < 2 THEN t ELSE list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])) END, ' ')) AS terms_md5 FROM t""")
def expand_terms(spark, d):
    x = table(spark, d, "benchmark").withColumn("e", X.expand_terms(X.tokens(F.col("text"))))
    return x.select("item_id", F.size("e").cast("long").alias("n"), F.md5(F.array_join("e", " ")).alias("terms_md5"))


@query("SELECT count(*) - count(*) FILTER (vec_id % 10 = 0) + 1 AS n, count(*) - count(*) FILTER (vec_id % 10 = 0) + 1 AS n_keys, CAST(1 AS BIGINT) AS n_other_size, CAST(1 AS BIGINT) AS n_zero FROM embeddings")
def vector_store(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (-5, [0.5] * 64)], "vec_id bigint, embedding array<double>")
    kept = R.delete_vectors(R.upsert_vectors(v, odd, "vec_id"), v.where("vec_id % 10 = 0"), "vec_id")
    return R.store_health(kept, 64, "vec_id")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) > 0 AS nonzero, CAST(1 AS DOUBLE) AS length FROM embeddings")
def unit_vectors(spark, d):
    v = table(spark, d, "embeddings").withColumn("u", X.unit_vector(F.col("embedding")))
    return v.select("vec_id", F.lit(True).alias("nonzero"), F.round(F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)), 4).alias("length"))


@query("SELECT item_id, 'x' || (item_id % 3) AS vector FROM benchmark")
def vector_records(spark, d):
    b = table(spark, d, "benchmark").select("item_id")
    return C.vector_records(b, b.withColumn("vector", F.concat(F.lit("x"), F.col("item_id") % 3)), "item_id")


