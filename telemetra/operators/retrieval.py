"""Markdown parts, packed chunks, reranking and the evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.operators.text import tokens

# A heading, a gap between paragraphs.
HEADING, GAP = r"^#{1,6}\s+(.+)$", r"\n\s*\n"


def stripped(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def front_matter(text: Column) -> tuple[Column, Column]:
    """(body, map of flat keys) of a text with a leading block between two lines of three dashes."""
    shape = r"(?s)^---\n(.*?)---(.*)$"
    has = text.rlike(shape)
    lines = F.filter(F.split(F.regexp_extract(text, shape, 1), "\n"), lambda x: x.rlike(r"^[A-Za-z0-9_]+\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]+:\s*", "")).alias("v")))
    return F.when(has, F.regexp_replace(F.regexp_extract(text, shape, 2), r"^\n+", "")).otherwise(text), F.when(has, F.map_from_entries(F.array_distinct(pairs))).otherwise(F.create_map().cast("map<string,string>"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it, inside of functions too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sections(text: Column, markdown: bool = True) -> Column:
    """array<struct<name, body>>: the text below each heading, under "Document" what is before the first; blank bodies go."""
    whole = F.coalesce(text, F.lit(""))
    if not markdown:
        return F.filter(F.array(F.struct(F.lit("Document").alias("name"), stripped(whole).alias("body"))), lambda s: s["body"] != "")

    def of(lines: Column) -> Column:
        n = F.size(lines)
        places = F.filter(F.sequence(F.lit(1), n), lambda i: stripped(F.element_at(lines, i)).rlike(HEADING))
        named = lambda i: F.when(i == 0, "Document").otherwise(stripped(F.regexp_extract(stripped(F.element_at(lines, F.greatest(i, F.lit(1)))), HEADING, 1)))
        body = lambda i, j: stripped(F.array_join(F.slice(lines, i + 1, j - i - 1), "\n"))
        cut = lambda at: F.zip_with(F.concat(F.array(F.lit(0)), at), F.concat(at, F.array(n + 1)), lambda i, j: F.struct(named(i).alias("name"), body(i, j).alias("body")))
        return F.filter(let(places, cut), lambda s: s["body"] != "")

    return let(F.split(F.regexp_replace(whole, r"\r\n?", "\n"), "\n"), of)


def headings(text: Column) -> Column:
    """The lines that are headings, without spaces of any width around them; only a line feed ends a line."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\p{Zs}+|\p{Zs}+\z", ""))
    return F.filter(lines, lambda x: x.rlike(r"\A#{1,6}[ \t\f\r]+[^\n]+\z"))


def paragraphs(text: Column) -> Column:
    """The stripped parts between blank lines that are not blank."""
    return F.filter(F.transform(F.split(text, GAP), stripped), lambda p: p != "")


def term_windows(terms: Column, size: int, overlap: int) -> Column:
    """Runs of `size` terms joined by spaces, each beginning `overlap` terms before the end of the one before."""
    count = F.greatest(F.ceil((F.size(terms) - overlap) / (size - overlap)).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.array_join(F.slice(terms, k * (size - overlap) + 1, size), " "))


def packed(text: Column, size: int, overlap: int) -> Column:
    """array<string>: paragraphs filled up to `size` terms; a chunk begins with the last terms of the one before it. A longer
    paragraph ends what is open and becomes windows of its terms.

    One fold over the paragraphs and their terms: `done` chunks, `open` text, `terms` of it.
    """
    items = F.transform(paragraphs(text), lambda p: F.struct(p.alias("text"), tokens(p).alias("terms")))
    state = lambda done, open_, terms: F.struct(done.alias("done"), open_.alias("open"), terms.alias("terms"))
    closed = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
    none = F.array().cast("array<string>")

    def add(s: Column, p: Column) -> Column:
        n, held = F.size(p["terms"]), F.size(s["terms"])
        tail = F.slice(s["terms"], F.greatest(held - overlap + 1, F.lit(1)), F.least(held, F.lit(overlap)))
        return (
            F.when(n == 0, s)
            .when(n > size, state(F.concat(closed(s), term_windows(p["terms"], size, overlap)), F.lit(""), none))
            .when((s["open"] != "") & (held + n > size), state(closed(s), F.concat_ws("\n\n", F.nullif(F.array_join(tail, " "), F.lit("")), p["text"]), F.concat(tail, p["terms"])))
            .otherwise(state(s["done"], F.concat_ws("\n\n", F.nullif(s["open"], F.lit("")), p["text"]), F.concat(s["terms"], p["terms"])))
        )

    return F.aggregate(items, state(none, F.lit(""), none), add, closed)


def packed_chunks(docs: DataFrame, id_column: str, text: str, size: int = 160, overlap: int = 30, markdown: bool = True) -> DataFrame:
    """(id, position, section, n_tokens, chunk): positions count through a document. Null and blank texts have none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    whole = docs.select(F.col(id_column).alias("id"), F.posexplode(sections(F.col(text), markdown)).alias("_at", "_s")).select("id", "_at", "_s.*")
    whole = whole.withColumn("_chunks", packed(F.col("body"), size, overlap))
    own = whole.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_at", "name", "_chunks"))).alias("_all"))
    flat = F.flatten(F.transform("_all", lambda s: F.transform(s["_chunks"], lambda c: F.struct(s["name"].alias("section"), c.alias("chunk")))))
    out = own.select("id", F.posexplode(flat).alias("position", "_c"))
    out = out.select("id", F.col("position").cast("long").alias("position"), "_c.section", F.size(tokens(F.col("_c.chunk"))).cast("long").alias("n_tokens"), "_c.chunk")
    return out.withColumnRenamed("id", id_column)


def lexical_rerank(results: DataFrame, k: int, query_id: str = "query_id", query: str = "query", text: str = "text", score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """Results by the share of the query's terms that a text holds, then by score; the first k of each query."""
    q = F.array_distinct(tokens(F.col(query)))
    overlap = F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(F.col(text)))) / F.size(q)).otherwise(F.lit(0.0))
    order = Window.partitionBy(query_id).orderBy(F.desc("overlap"), F.desc(score), tie)
    return results.withColumn("overlap", overlap).withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def retrieval_metrics(gold: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, reciprocal_rank, ndcg) at k, for every row of gold (query_id, expected: array).

    results: (query_id, unit, position from 1). A unit counts once, at its first place; missing places count as misses.
    """
    w = Window.partitionBy("query_id", "unit").orderBy("position")
    top = results.where(F.col("position") <= k).withColumn("_again", F.row_number().over(w) > 1)
    hit = top.join(gold, "query_id").withColumn("hit", F.array_contains("expected", F.col("unit")) & ~F.col("_again"))
    gain = F.when(F.col("hit"), 1 / F.log2(F.col("position") + 1.0)).otherwise(0.0)
    per = hit.groupBy("query_id").agg(F.count_if("hit").alias("hits"), F.min(F.when(F.col("hit"), F.col("position"))).alias("first"), F.sum(gain).alias("dcg"))
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.size(F.array_distinct("expected")), F.lit(k)), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = gold.join(per, "query_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    recall = F.least(hits / F.greatest(F.size(F.array_distinct("expected")), F.lit(1)), F.lit(1.0))
    return out.select("query_id", (hits / F.lit(max(k, 1))).alias("precision"), recall.alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.col("dcg") / best, F.lit(0.0)).alias("ndcg"))


def citation_completeness(results: DataFrame, columns: list[str], score: str = "score") -> DataFrame:
    """One row: the share of results whose columns are all filled and whose score is finite; 0 without results."""
    whole = F.abs(F.coalesce(score, F.lit(float("nan")))) < float("inf")
    for c in columns:
        whole = whole & (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return results.agg(F.coalesce(F.avg(whole.cast("double")), F.lit(0.0)).alias("completeness"))


def failure_class(gold: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, failure) for gold (query_id, domain, documents, chunks: arrays) and results (query_id, domain, document, chunk)."""
    got = results.groupBy("query_id").agg(F.collect_set("domain").alias("_domains"), F.collect_set("document").alias("_documents"), F.collect_set("chunk").alias("_chunks"))
    x = gold.join(got, "query_id", "left")
    kind = (
        F.when(F.col("_domains").isNull(), "no_results")
        .when((F.size("_domains") > 0) & (F.col("_domains") != F.array("domain")), "cross_domain_confusion")
        .when(~F.arrays_overlap("documents", "_documents"), "correct_document_not_retrieved")
        .when((F.size("chunks") > 0) & ~F.arrays_overlap("chunks", "_chunks"), "correct_section_not_retrieved")
        .otherwise("relevant_item_ranked_too_low")
    )
    return x.select("query_id", kind.alias("failure"))


def delete_vectors(store: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    """The store without the rows of these documents (or chunks)."""
    return store.join(gone.select(key).distinct(), key, "left_anti")


def store_health(store: DataFrame, dimension: int, key: str = "chunk_id") -> DataFrame:
    """One row: vectors, distinct keys, vectors of another dimension, vectors of length 0."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return store.agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_keys"), F.count_if(F.size("embedding") != dimension).alias("n_other_size"), F.count_if(norm == 0).alias("n_zero"))


def retrieve(queries: DataFrame, store: DataFrame, embed, k: int, rerank_k: int = 0, least: float = 0.0, domain: str | None = None) -> DataFrame:
    """(query_id, chunk_id, score, position) of the k best chunks of each query (query_id, query[, domain]).

    embed(DataFrame, id, text) gives sparse unit vectors (id, slot, weight), of queries as of the store (chunk_id, text,
    domain). Chunks meet queries by slots they share, so no pair without a common term is made; scores under `least`
    go. A query's domain, where it has one and `domain` names the column, keeps chunks of that domain. With rerank_k,
    max(k, rerank_k) candidates are put in order by shared terms, then by score.
    """
    q = embed(queries, "query_id", "query").withColumnsRenamed({"weight": "_q"})
    c = embed(store, "chunk_id", "text").withColumnsRenamed({"weight": "_c"})
    pairs = q.join(c, "slot").groupBy("query_id", "chunk_id").agg(F.sum(F.col("_q") * F.col("_c")).alias("score")).where(F.col("score") >= least)
    if domain:
        wanted = queries.select("query_id", F.col(domain).alias("_wanted"))
        pairs = pairs.join(wanted, "query_id").join(store.select("chunk_id", F.col("domain").alias("_domain")), "chunk_id").where(F.col("_wanted").isNull() | (F.col("_wanted") == F.col("_domain"))).drop("_wanted", "_domain")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    top = pairs.withColumn("position", F.row_number().over(order)).where(F.col("position") <= max(k, rerank_k))
    if not rerank_k:
        return top
    full = top.drop("position").join(queries.select("query_id", "query"), "query_id").join(store.select("chunk_id", "text"), "chunk_id")
    return lexical_rerank(full.withColumn("score", F.round("score", 9)), k).select("query_id", "chunk_id", "score", "position")


# Words that tell a domain, in the order they are tried.
DOMAIN_WORDS = (
    ("cloud_infrastructure", ("nova",)),
    ("industrial", ("tp2", "tp3", "motor_current")),
    ("containers", ("docker", "container")),
    ("containers", ("kubernetes", "pod")),
    ("databases", ("postgres", "database")),
    ("networking", ("packet", "latency")),
    ("monitoring", ("prometheus", "alert")),
)
DOMAIN_SOURCES = {"cloud_infrastructure": "openstack", "industrial": "metropt"}
# What the folders of a knowledge base are about.
DIRECTORY_DOMAINS = {"openstack": "cloud_infrastructure", "linux": "operating_system", "docker": "containers", "kubernetes": "containers", "databases": "databases", "networking": "networking", "monitoring": "monitoring", "incident_runbooks": "incident_response", "synthetic": "industrial"}


def infer_domain(terms: Column, source: Column) -> Column:
    """The domain that a query's words or its dataset tell, null if none does."""
    out = None
    for name, words in DOMAIN_WORDS:
        has = F.coalesce(F.contains(F.lower(source), F.lit(DOMAIN_SOURCES[name])), F.lit(False)) if name in DOMAIN_SOURCES else F.lit(False)
        for w in words:
            has = has | F.contains(F.lower(terms), F.lit(w))
        out = F.when(has, name) if out is None else out.when(has, name)
    return out


def incident_query(*parts: Column) -> Column:
    """Terms of an incident as one query; empty ones are left out."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), " ")


def directory_domain(path: Column) -> Column:
    """The domain of the last folder in a path that has one, else "general"."""
    known = F.filter(F.reverse(F.split(path, "/")), lambda p: p.isin(*DIRECTORY_DOMAINS))
    names = F.create_map(*(F.lit(x) for kv in DIRECTORY_DOMAINS.items() for x in kv))
    return F.coalesce(F.element_at(names, F.get(known, F.lit(0))), F.lit("general"))


def best_configuration(results: DataFrame, name: str = "configuration") -> DataFrame:
    """The row with the best recall, then reciprocal rank, then the least latency, then the first name."""
    return results.orderBy(F.desc("recall"), F.desc("mrr"), "latency", name).limit(1)


def upsert_vectors(store: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The store with new rows in place of those with their key."""
    return store.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
