"""Retrieval operators: terms, windows, hashing embeddings, exact cosine search, reranking, visible text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_./:-]+)"), 1)


def word_windows(df: DataFrame, text: str, size: int = 160, overlap: int = 30) -> DataFrame:
    """Overlapping runs of tokens with their position; a text without tokens has none."""
    step = size - overlap
    rows = df.withColumn("_t", tokens(F.col(text))).where(F.size("_t") > 0)
    last = F.greatest(F.ceil((F.size("_t") - overlap) / step).cast("int"), F.lit(1))
    rows = rows.withColumn("position", F.explode(F.sequence(F.lit(0), last - 1)))
    return rows.withColumn("chunk", F.array_join(F.slice("_t", F.col("position") * step + 1, size), " ")).drop("_t")


def hashing_embedding(df: DataFrame, id_column: str, text: str, dim: int = 384) -> DataFrame:
    """Signed feature hashing of terms: (id, slot, weight), unit length, sparse."""
    terms = df.select(id_column, F.explode(tokens(F.col(text))).alias("term"))
    h = F.sha2("term", 256)
    slot = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dim))
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("long") % 2 == 0, 1.0).otherwise(-1.0)
    sums = terms.groupBy(id_column, slot.alias("slot")).agg(F.sum(sign).alias("w")).where("w <> 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_column)))
    return sums.withColumn("weight", F.col("w") / norm).drop("w")


#: Queries that one pass over the vectors takes along.
QUERY_BLOCK = 1024


def unit_vector(v: Column) -> Column:
    """A vector by its length; one of length 0 as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """(query_id, vec_id, score, position): queries against all vectors, in blocks of QUERY_BLOCK of them; the score with a
    vector of length 0 is 0."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    unit = lambda df, c: df.withColumn("norm", F.sqrt(dot(F.col(c), F.col(c))))
    q = unit(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "q").withColumnRenamed("norm", "qn")
    blocks = -(-queries.count() // QUERY_BLOCK)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = []
    for b in range(max(blocks, 1)):
        own = q.where(F.pmod(F.xxhash64("query_id"), F.lit(max(blocks, 1))) == b)  # about QUERY_BLOCK rows
        rows = unit(vectors.select("vec_id", "embedding"), "embedding").join(F.broadcast(own), F.col("vec_id") != F.col("query_id"))
        score = F.when((F.col("qn") > 0) & (F.col("norm") > 0), dot(F.col("q"), F.col("embedding")) / (F.col("qn") * F.col("norm"))).otherwise(0.0)
        rows = rows.select("query_id", "vec_id", score.alias("score")).where(F.col("score") >= least)
        out.append(rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k))
    return reduce(DataFrame.unionByName, out)


class _Visible(HTMLParser):
    # Tags without visible text, tags that end a line, names of metadata.
    HIDDEN = ("script", "style", "noscript")
    BLOCKS = ("p", "br", "div", "section", "h1", "h2", "h3", "li")
    NAMES = ("document_id", "domain", "language", "provenance", "source", "source_url", "technology", "title", "version")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.title, self.heads, self.found = [], 0, None, [], {}

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag in self.BLOCKS:
            self.out.append("\n")
        if tag == "title":
            self.title = []
        has = {k: v for k, v in attrs if v}
        name = has.get("name") or has.get("property")
        if tag == "meta" and name in self.NAMES and "content" in has:
            self.found[name] = has["content"]

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0
        if tag in self.BLOCKS and tag != "br":
            self.out.append("\n")
        if tag == "title" and self.title is not None:
            self.heads, self.title = self.title, None

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)
        if self.title is not None:
            self.title.append(data)


def plain_text(text: str) -> str:
    """One kind of line end, single spaces, at most one blank line in a row, nothing at the ends."""
    text = re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def page_texts(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """(id, visible, title, metadata map): what a reader sees of each page, and its <title> and known <meta> names.

    Pieces of text are joined by spaces, block tags by line ends. Null pages give an empty text and no title.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for h in x.iloc[:, 1]:
                p = _Visible()
                p.feed(h or "")
                p.close()
                out.append((plain_text(" ".join(p.out)), plain_text(" ".join(p.heads)) or None, p.found))
            yield pd.DataFrame({"id": x.iloc[:, 0], "visible": [o[0] for o in out], "title": [o[1] for o in out], "metadata": [o[2] for o in out]})

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(id_column, html).mapInPandas(run, f"id {kind}, visible string, title string, metadata map<string,string>").withColumnRenamed("id", id_column)


def visible_text(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    return page_texts(pages, id_column, html).select(id_column, "visible")


def expand_terms(terms: Column) -> Column:
    """The terms, then every pair of neighbours as a_b."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(terms) - 1, F.lit(1))), lambda i: F.concat_ws("_", F.get(terms, i - 1), F.get(terms, i)))
    return F.when(F.size(terms) < 2, terms).otherwise(F.concat(terms, pairs))
