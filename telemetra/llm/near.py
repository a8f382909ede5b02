"""Operator 9: near-duplicate documents by b-bit MinHash, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.llm.common import components, cut, free
from telemetra.llm.words import mix, portions, shingles, words_of

#: Bands, rows a band has, minima that the packed signature keeps, and their low bits that it keeps. A pair of
#: similarity 0.8 shares no band with a probability of (1 - 0.8**6)**84 < 1e-11.
BANDS, ROWS, SIGNED, BITS = 84, 6, 252, 4
#: A candidate is dropped on its signature alone if a pair at the threshold has so few agreeing minima with at most this chance.
TAIL = 1e-12
#: Text and signatures of a block of a family; a family of more blocks is compared bucket by bucket.
BLOCK_BYTES, FAMILY_BLOCKS = 4 << 20, 16
#: The lowest bit of every field of BITS bits.
_LOW = np.uint64(sum(1 << k for k in range(0, 64, BITS)))
_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The MinHash minima of a non-empty set of 64-bit fingerprints."""
    low = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 128):
        np.minimum(low, (h[at : at + 128, None] * _A + _B).min(0), out=low)
    return low


def bands_of(low: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, from whole minima; the band's number is in it."""
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[k::ROWS][:BANDS].astype(np.uint64))
    return key.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of the first SIGNED minima as 64-bit words."""
    low = low[:SIGNED]
    bits = np.zeros(-(-len(low) * BITS // 64) * 64, np.uint8)
    bits[: len(low) * BITS] = ((low[:, None] >> np.arange(BITS, dtype=np.uint32)) & 1).astype(np.uint8).ravel()
    return np.packbits(bits).view(np.int64)


def agreeing(k: int, threshold: float) -> int:
    """Least agreeing minima of k that a pair of this similarity may be expected to have: fewer come with a chance of TAIL at most.

    Unequal minima may agree in their low bits as well, but that is not counted on: a minimum's low bits follow from those
    of its shingle alone, so in a small set they agree in many places or in none.
    """
    least, below = 0, 0.0
    while least < k and (below := below + comb(k, least) * threshold**least * (1 - threshold) ** (k - least)) <= TAIL:
        least += 1
    return least


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """Per document its set's size, a 128-bit digest of the set, its bytes, packed signature and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = [(t or "").encode() for t in batch.column(1).to_pylist()], []
            for p in portions(texts):
                words, at = words_of(texts[p])
                for a, b in zip(at, at[1:], strict=False):
                    own = np.unique(shingles(words[a:b], width))
                    if len(own):
                        low = minima(own)
                        out.append((len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), packed(low).tobytes(), bands_of(low)))
                    else:
                        out.append((0, None, None, None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.array(map(len, texts), pa.int64())], names=["doc_id", "n_shingles", "digest", "sign", "bands", "size"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sign binary, bands array<long>, size long")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets have den * intersection >= num * union. Joins spread a text with many pairs."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, last, own = [], None, None
            b_texts = [t.encode() for t in batch.column(3).to_pylist()]
            a_ids, a_texts = batch.column(0).to_pylist(), batch.column(2)
            for p in portions(b_texts):
                words, at = words_of(b_texts[p])
                for k, (i, j) in enumerate(zip(at, at[1:], strict=False), p.start):
                    if a_ids[k] != last:
                        last, own = a_ids[k], np.unique(shingles(words_of([a_texts[k].as_py().encode()])[0], width))
                    other = np.unique(shingles(words[i:j], width))
                    if _enough(own, other, num, den):
                        kept.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int32())), batch.column(1).take(pa.array(kept, pa.int32()))], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _groups(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows sorted by some columns, each as a whole."""
    rest: list[pd.DataFrame] = []
    for x in batches:
        if not len(x):
            continue
        key = x[columns].to_numpy()
        ends = [*(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(x)]
        if rest and (rest[-1][columns].to_numpy()[-1] != key[0]).any():
            yield pd.concat(rest, ignore_index=True)
            rest = []
        for begin, end in zip([0, *ends], ends, strict=False):
            if begin and rest:
                yield pd.concat(rest, ignore_index=True)
                rest = []
            rest.append(x.iloc[begin:end])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def _across(rest: DataFrame, signs: DataFrame, texts: DataFrame, width: int, num: int, den: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) between documents (doc_id, label, family) of one family and different labels, enough to join what links."""
    rest = rest.join(signs, "doc_id")
    sizes = _bytes(rest).select("family", F.ceil(F.col("bytes") / block_bytes).cast("int").alias("parts"))
    rows = rest.join(texts, "doc_id")
    rows = rows.join(sizes, "family").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "doc_id", "label", "sign", "text")
    rows = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    k, least = SIGNED, agreeing(SIGNED, num / den)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, ["family", "i", "j"]):
            sign = np.frombuffer(b"".join(g.sign), np.uint64).reshape(len(g), -1)
            ids, label, part = g.doc_id.to_numpy(), g.label.to_numpy(), g.part.to_numpy()
            left, right = np.flatnonzero(part == g.i.iloc[0]), np.flatnonzero(part == g.j.iloc[0])
            joined, sets, out = {x: x for x in np.unique(label).tolist()}, {}, []

            def of(x: int) -> int:
                while joined[x] != x:
                    joined[x] = x = joined[joined[x]]
                return x

            def own(at: int) -> np.ndarray:
                if at not in sets:
                    sets[at] = np.unique(shingles(words_of([g.text.iloc[at].encode()])[0], width))
                return sets[at]

            for a in left.tolist():
                x = sign[right] ^ sign[a]
                for shift in range(1, BITS):
                    x |= (sign[right] ^ sign[a]) >> np.uint64(shift)
                unequal = np.bitwise_count(x & _LOW).sum(1, dtype=np.int64)
                for b in right[(k - unequal >= least) & (label[right] != label[a])].tolist():
                    x, y = of(int(label[a])), of(int(label[b]))
                    if x != y and _enough(own(a), own(b), num, den):
                        joined[max(x, y)] = min(x, y)
                        out.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return rows.mapInPandas(run, "a long, b long")


def _bytes(rest: DataFrame) -> DataFrame:
    """(family, bytes): texts and signatures of its documents."""
    return rest.groupBy("family").agg(F.sum(F.col("size") + 300).alias("bytes"))


def _enough(own: np.ndarray, other: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets have den * intersection >= num * union."""
    if den * min(len(own), len(other)) < num * max(len(own), len(other)):
        return False
    both = np.concatenate([own, other])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return den * same >= num * (len(own) + len(other) - same)


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES, family_blocks: int = FAMILY_BLOCKS) -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable by links), kept (id = component_id).

    Words are runs of characters other than space and 0x09-0x0D, A-Z lower-cased. A set holds the distinct runs of
    `width` words; with fewer words the whole sequence as one; none without words or text (null, empty, blank), and
    such a document is linked with nothing. Documents link if den * intersection >= num * union.

    Documents with equal sets are one class from the start. Classes that share a band are candidates. First every
    class is compared with the smallest of its band's bucket; components of the confirmed links are labelled. Buckets
    in which labels still meet make families of labels; inside a family, block against block in separate tasks, every
    pair of different labels whose signatures allow the similarity is compared, and only links that join labels
    leave the task. A family of more than family_blocks blocks is taken apart again into its buckets, since only
    documents that share one can be found to link: a text is then copied once for each block of its mixed buckets, not
    of its whole family. So no link between groups is lost and no group is expanded into rows for all its pairs.
    Fingerprints of words and shingles have 64 bits (see words): sets are equal up to their collisions. Ids are
    integers, one for each text; rows without an id are left out, repeated rows are returned each; further columns
    are not read; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null")
    sized = cut(_scan(docs, width))
    with_words = sized.where("digest is not null")
    classes = with_words.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    signed = cut(with_words.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "sign", "bands", "size"))
    rows = signed.select("doc_id", F.explode("bands").alias("key"))
    shared = cut(rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key", "low"))
    members = cut(rows.join(shared, "key"))
    pairs = members.where("low < doc_id").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    signs = signed.select("doc_id", "sign", "size")
    pairs = cut(_similar(pairs, signs, num / den))
    ids = members.select("doc_id").distinct().hint("merge")  # the same plan at every size
    texts = cut(docs.join(ids, "doc_id", "left_semi"))  # texts are dealt out once; the later joins read these alone
    links = cut(_confirmed(pairs, texts, width, num, den))
    free(pairs)
    label = components(links)
    labelled = members.join(label, members.doc_id == label.node, "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    labelled = cut(labelled)
    free(members)
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key", "x")
    met = cut(labelled.join(mixed, "key"))
    free(labelled)
    family = components(met.select(F.col("x").alias("a"), F.col("label").alias("b")).distinct())
    rest = met.select("doc_id", "label").distinct().join(family, F.col("label") == F.col("node")).select("doc_id", "label", F.col("component").alias("family"))
    great = _bytes(rest.join(signs, "doc_id")).where(F.col("bytes") > family_blocks * block_bytes).select("family")
    apart = rest.join(great, "family", "left_semi").select("doc_id")
    apart = met.join(apart, "doc_id", "left_semi").select("doc_id", "label", F.xxhash64(F.lit(1), "key").alias("family")).distinct()
    rest = cut(rest.join(great, "family", "left_anti").select("doc_id", "label", F.xxhash64(F.lit(0), "family").alias("family")).unionByName(apart))
    free(met)
    if rest.isEmpty():
        more = links.where("false")
    else:
        more = cut(_across(rest, signs, texts, width, num, den, block_bytes))
    free(texts)
    if more.isEmpty():
        final = label
    else:
        final = components(more.unionByName(label.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    found = classes.join(final, classes.rep == final.node, "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = sized.join(found, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id")).withColumnRenamed("doc_id", id_column)


def _similar(pairs: DataFrame, signs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose packed signatures allow the similarity: agreeing low bits, counted by xor and bit counts."""
    both = pairs.join(signs.select(F.col("doc_id").alias("a"), F.col("sign").alias("sign_a")), "a")
    both = both.join(signs.select(F.col("doc_id").alias("b"), F.col("sign").alias("sign_b")), "b")
    k, least = SIGNED, agreeing(SIGNED, threshold)
    #: How many of a byte's fields of BITS bits are zero: those minima agree.
    fields = (np.arange(256)[:, None] >> np.arange(0, 8, BITS)) & ((1 << BITS) - 1)
    zeros = (fields == 0).sum(1).astype(np.uint8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            a = np.frombuffer(b"".join(x.sign_a), np.uint8).reshape(len(x), -1)
            b = np.frombuffer(b"".join(x.sign_b), np.uint8).reshape(len(x), -1)
            equal = zeros[a ^ b].sum(1, dtype=np.int64) - (a.shape[1] * 8 // BITS - k)
            yield x.loc[equal >= least, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")
