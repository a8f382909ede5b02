"""Writers, manifests and checks of written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Data that is fetched by hand, and data that is only referred to.
MANUAL_DOWNLOAD, REFERENCE_ONLY = ("cicids2017",), ("opentelemetry-demo",)


def path_part(x: Column) -> Column:
    """A value that is safe in a path; null is "unknown"."""
    return F.regexp_replace(F.coalesce(x.cast("string"), F.lit("unknown")), r"[^A-Za-z0-9_.=-]+|[\\/:]", "_")


def write_partitioned(df: DataFrame, path: str, keys: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Parquet in a folder for each value of the keys' safe spelling (`<key>_partition`); the keys stay columns.

    Rows are rebalanced by the keys: small values share a file, and a value with very many rows is split over tasks.
    """
    named = [f"{k}_partition" for k in keys]
    df = df.withColumns({n: path_part(F.col(k)) for n, k in zip(named, keys, strict=True)})
    out = df.hint("rebalance", *[F.col(n) for n in named]) if named else df
    writer = out.write.mode(mode).option("compression", "snappy")
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "static")
    (writer.partitionBy(*named) if named else writer).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object for each line; blank lines are skipped, any other line is an error."""
    shown = F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80))
    value = F.when(F.trim("value").startswith("{"), F.col("value")).otherwise(F.raise_error(shown))
    rows = spark.read.text(path).where("trim(value) <> ''")
    return rows.select(F.from_json(value, schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def file_manifest(spark: SparkSession, path: str, largest: int = 256 << 20) -> DataFrame:
    """(path, bytes, modified, sha256) of every file below a folder; no digest for files over `largest` bytes.

    Larger files are never loaded: the reader is told to take contents only of the others.
    """
    files = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    names = files().select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    digests = files().where(F.col("length") <= largest).select("path", F.sha2("content", 256).alias("sha256"))
    return names.join(digests, "path", "left")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose keys it lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def rows_by_file(spark: SparkSession, path: str) -> DataFrame:
    """(file, n) of a written Parquet table."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).count().withColumnRenamed("count", "n")


def lineage(df: DataFrame, dataset: str, kind: str, source: str) -> DataFrame:
    """One row on a table: rows, entities, span of time, rows by quality flag."""
    flags = ("VALID", "MISSING", "INVALID", "DUPLICATE", "OUT_OF_ORDER", "IMPUTED")
    count = [F.count_if(F.col("quality_flag") == f).alias(f"n_{f.lower()}") for f in flags]
    return df.agg(F.lit(dataset).alias("dataset"), F.lit(kind).alias("kind"), F.lit(source).alias("source"), F.count("*").alias("n"), F.approx_count_distinct("entity_id").alias("n_entities_approx"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"), *count)


def dataset_status(dataset: Column, n_problems: Column, manual: Column, present: Column) -> Column:
    """READY, REFERENCE_READY, INCOMPLETE, MANUAL_DOWNLOAD, MANUAL_ACCESS or PRESENT_UNVERIFIED."""
    by_hand = F.when(present & (n_problems == 0), "PRESENT_UNVERIFIED").when(dataset.isin(*MANUAL_DOWNLOAD), "MANUAL_DOWNLOAD").otherwise("MANUAL_ACCESS")
    return F.when(manual, by_hand).when(n_problems > 0, "INCOMPLETE").when(dataset.isin(*REFERENCE_ONLY), "REFERENCE_READY").otherwise("READY")


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, local or remote, and the path as it knows it."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir); it goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    system, found = _file_system(spark, path)
    system.mkdirs(found)
    system.deleteOnExit(found)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: several readers, one computation, and no lineage to lose."""
    path = f"{scratch(df.sparkSession, 'kept')}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file with this text, in UTF-8."""
    system, found = _file_system(spark, path)
    out = system.create(found, True)
    out.write(text.encode())
    out.close()


def within(root: str, path: str) -> str:
    """path, or an error where it leads out of root."""
    parts: list[str] = []
    for part in path[len(root) :].split("/") if path.startswith(root.rstrip("/") + "/") else [".."]:
        if part == "..":
            raise ValueError(f"outside of {root}: {path}")
        parts.append(part)
    return path


def reset(spark: SparkSession, root: str, path: str) -> None:
    """An empty folder in place of what is at path, which has to lie below root."""
    system, found = _file_system(spark, within(root, path))
    system.delete(found, True)
    system.mkdirs(found)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, bytes, format) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("name"), "bytes", file_format(name).alias("format"))


# Formats by the end of a file's name.
FORMATS = {"csv": "csv", "json": "json", "jsonl": "jsonl", "txt": "text", "log": "log", "parquet": "parquet", "zip": "archive", "gz": "archive", "md": "markdown", "html": "html", "npy": "numpy"}


def file_format(name: Column) -> Column:
    end = F.lower(F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(""))
    known = F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))
    return F.coalesce(F.element_at(known, end), F.nullif(end, F.lit("")), F.lit("none"))


def stage_summary(files: DataFrame) -> DataFrame:
    """Per format: files and bytes."""
    return files.groupBy("format").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def expected_files(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(pattern, files, status) for each expected regular expression on names: INCOMPLETE where none fits."""
    wanted = files.sparkSession.createDataFrame(sorted(patterns.items()), "pattern string, regex string")
    hits = files.select("name").join(F.broadcast(wanted), F.expr("name rlike regex")).groupBy("pattern").agg(F.count("*").alias("files"))  # a row for each pattern
    out = wanted.select("pattern").join(hits, "pattern", "left").withColumn("files", F.coalesce("files", F.lit(0)))
    return out.withColumn("status", F.when(F.col("files") > 0, "PRESENT").otherwise("INCOMPLETE"))


def read_either(spark: SparkSession, stem: str, schema: str) -> DataFrame:
    """stem.parquet where it is, else stem.csv with a header, in the columns of schema."""
    system, found = _file_system(spark, f"{stem}.parquet")
    if system.exists(found):
        names = [f.name for f in spark.createDataFrame([], schema).schema]
        return spark.read.parquet(f"{stem}.parquet").select(*names)
    return spark.read.schema(schema).csv(f"{stem}.csv", header=True, mode="FAILFAST")


def filtered_table(spark: SparkSession, path: str, equal: dict[str, str], columns: list[str]) -> DataFrame:
    """Columns of the rows that have these values; filters and columns reach the scan."""
    rows = spark.read.parquet(path)
    for k, v in equal.items():
        rows = rows.where(F.col(k) == v)
    return rows.select(*columns)


def write_artifact(df: DataFrame, path: str, kind: str) -> None:
    """A result as csv with a header, json or parquet."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown kind of artifact: {kind}")
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv if kind == "csv" else getattr(writer, kind))(path)


#: Tables of a collection in the order they are written, and the columns each is partitioned by.
WRITE_ORDER = {"metrics": ("source_dataset", "metric_name"), "logs": ("source_dataset",), "traces": ("source_dataset",), "failures": ("source_dataset",), "labels": ("source_dataset", "label_kind"), "incidents": ("source_dataset",)}


def write_collection(tables: dict[str, DataFrame], root: str) -> list[str]:
    """Writes the tables that there are in WRITE_ORDER; the paths."""
    out = []
    for kind, keys in WRITE_ORDER.items():
        if kind in tables:
            write_partitioned(tables[kind], f"{root}/{kind}", keys)
            out.append(f"{root}/{kind}")
    return out
