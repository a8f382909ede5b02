"""The catalogue of collections, and readers of knowledge documents."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.functions.scalars import document_id, normalized_text
from telemetra.operators.retrieval import directory_domain, front_matter
from telemetra.operators.text import page_texts


@dataclass(frozen=True)
class Collection:
    """A collection as the catalogue names it."""

    name: str
    aliases: tuple[str, ...] = ()
    access: str = "public"
    group: str = ""


def parse_catalog(text: str) -> list[Collection]:
    """Entries of a catalogue file: a list of "- name:" blocks with plain or [a, b] values."""
    found: list[dict] = []
    for line in text.splitlines():
        m = re.match(r"^(\s*-\s+|\s+)(\w+):\s*(.*?)\s*$", line)
        if not m:
            continue
        if "-" in m[1]:
            found.append({})
        if found:
            value = m[3].strip()
            found[-1][m[2]] = tuple(x.strip() for x in value[1:-1].split(",") if x.strip()) if value.startswith("[") else value.strip("'\"")
    return [Collection(x["name"], tuple(x.get("aliases", ())), x.get("access", "public"), x.get("group", "")) for x in found if "name" in x]


def alias_index(collections: list[Collection]) -> dict[str, str]:
    """Name of every spelling: case and underscores do not matter. One that two collections share is an error."""
    out: dict[str, str] = {}
    for c in collections:
        for spelling in (c.name, *c.aliases):
            key = spelling.lower().replace("_", "-")
            if out.setdefault(key, c.name) != c.name:
                raise ValueError(f"{spelling} names both {out[key]} and {c.name}")
    return out


def resolve(collections: list[Collection], wanted: list[str]) -> list[str]:
    """Names of a selection, in the order of the catalogue: spellings, "all", "public", or a group's name."""
    index, chosen = alias_index(collections), set()
    for w in wanted:
        key = w.lower().replace("_", "-")
        group = {c.name for c in collections if key == "all" or (key == "public" and c.access == "public") or (c.group and c.group.lower() == key)}
        if not group and key not in index:
            raise KeyError(f"unknown dataset: {w}")
        chosen |= group or {index[key]}
    return [c.name for c in collections if c.name in chosen]


def catalog_table(spark: SparkSession, collections: list[Collection]) -> DataFrame:
    return spark.createDataFrame([(c.name, "|".join(c.aliases), c.access, c.group) for c in collections], "name string, aliases string, access string, group string")


def load_documents(spark: SparkSession, root: str, skip: tuple[str, ...] = ("retrieval_eval.jsonl",)) -> DataFrame:
    """Markdown, text and HTML files below a folder: (document_id, path, kind, title, domain, language, metadata, content).

    Front matter and <meta> names give the metadata; an id, title, domain and language there go before the ones that follow
    from file and folder. Files of other kinds and those of `skip` are left out.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,markdown,txt,html,htm}").select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_name").alias("_name"), "value")
    files = files.where(~F.col("_name").isin(*skip))
    end = F.lower(F.substring_index("_name", ".", -1))
    kind = F.when(end.isin("md", "markdown"), "markdown").when(end.isin("html", "htm"), "html").otherwise("text")
    path = F.regexp_replace(F.element_at(F.split("_file", re.escape(root.rstrip("/").split(":")[-1].lstrip("/")) + "/"), -1), "^/+", "")
    files = files.withColumns({"kind": kind, "path": path})
    body, metadata = front_matter(F.col("value"))
    plain = files.where("kind <> 'html'").select("path", "_name", "kind", F.when(F.col("kind") == "markdown", body).otherwise(F.col("value")).alias("content"), F.when(F.col("kind") == "markdown", metadata).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"), F.lit(None).cast("string").alias("head"))
    pages = files.where("kind = 'html'")
    pages = page_texts(pages.select(F.struct("path", "_name", "kind").alias("id"), "value"), "id", "value").select("id.*", F.col("visible").alias("content"), "metadata", F.col("title").alias("head"))
    rows = plain.unionByName(pages)
    has = lambda k: F.nullif(F.element_at("metadata", F.lit(k)), F.lit(""))
    stem = F.regexp_replace("_name", r"\.[^.]*$", "")
    title = F.coalesce(has("title"), F.col("head"), F.nullif(F.regexp_extract("content", r"(?m)^#\s+(.+)$", 1), F.lit("")), F.initcap(F.translate(stem, "_-", "  ")))
    rows = rows.withColumns({"content": normalized_text(F.col("content")), "title": title, "domain": F.coalesce(has("domain"), directory_domain(F.col("path"))), "language": F.coalesce(has("language"), F.lit("en"))})
    return rows.select(F.coalesce(has("document_id"), document_id(stem, F.col("path"), F.col("title"))).alias("document_id"), "path", "kind", "title", "domain", "language", "metadata", "content")


def evaluation_records(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, documents, chunks, domain) of a JSONL file; rows without an id are numbered by line, from q0001."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    schema = "query_id string, query string, expected_document_ids array<string>, expected_chunk_ids array<string>, domain string"
    rows = lines.select(F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_n"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("_b", "_n", "x.*")
    from pyspark.sql import Window

    number = F.row_number().over(Window.orderBy("_b", "_n"))  # a file of hand-made queries
    none = F.array().cast("array<string>")
    return rows.withColumn("query_id", F.coalesce("query_id", F.concat(F.lit("q"), F.lpad(number.cast("string"), 4, "0")))).select("query_id", "query", F.coalesce("expected_document_ids", none).alias("documents"), F.coalesce("expected_chunk_ids", none).alias("chunks"), "domain")


def vector_records(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks with their vectors; a chunk without one, or a vector without a chunk, is an error when it is read."""
    both = chunks.withColumn("_c", F.lit(1)).join(vectors.withColumn("_v", F.lit(1)), key, "full")
    whole: Column = F.when(F.col("_c").isNull() | F.col("_v").isNull(), F.raise_error(F.concat(F.lit("chunk or vector missing: "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return both.withColumn("_ok", whole).where("_ok").drop("_c", "_v", "_ok")
