"""Operator 4: packing documents into sequences along a Hilbert curve."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.llm.bpe import codec
from telemetra.llm.words import mix, portions, words_of

#: Dimensions of the curve, bits of each, rows of the sample that its ranges are cut by.
DIMS, BITS, SAMPLE = 3, 15, 8192
#: Sequences that a range holds by estimate (four bytes a token) at least, so that its one short sequence is little
#: padding, and bytes of text that it holds at most.
LEAST, MOST = 128, 256 << 20
#: Sequences of one range of the curve have numbers below this; the range's number is above.
RANGE = 1 << 32


def projected(texts: list[bytes]) -> np.ndarray:
    """A text's hashed word vector in a few dimensions: every word adds a random sign to each; by the root of the number of words."""
    words, at = words_of(texts)
    size = np.diff(at)
    h = mix(words + np.uint64(0xD1B54A32D192ED03))
    owner = np.repeat(np.arange(len(texts)), size)
    out = np.stack([np.bincount(owner, ((h >> np.uint64(17 * k)) & np.uint64(1)).astype(np.float64) * 2 - 1, len(texts)) for k in range(DIMS)], 1)
    return out / np.maximum(size, 1)[:, None]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of points with whole coordinates under 2**bits (any number of dimensions)."""
    x = points.T.astype(np.int64).copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo the excess turns from the coarsest bit on
        p = q - 1
        for i in range(n):
            swap = (x[i] & q) == 0
            t = np.where(swap, (x[0] ^ x[i]) & p, 0)
            x[0] = np.where(swap, x[0] ^ t, x[0] ^ p)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def places(texts: list[bytes], ids: np.ndarray, first: int = 0) -> np.ndarray:
    """Sort keys: the Hilbert key, then 16 bits of a hash of the id and the row's place in its batch (`first` is the first
    row's), which spread equal texts over ranges, and repeated rows too."""
    points = np.clip((projected(texts) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    row = np.arange(first, first + len(ids), dtype=np.uint64)
    return hilbert(points) << 16 | (mix(ids.astype(np.uint64) + mix(row)) >> np.uint64(48)).astype(np.int64)


def range_count(n_bytes: int, length: int, partitions: int) -> int:
    """How many ranges the curve is cut into: one for each shuffle partition, fewer on little text, more on very much."""
    return max(1, min(partitions, n_bytes // (4 * length * LEAST)), -(-n_bytes // MOST))


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", ranges: int | None = None) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the tokenizers file at path, then end_id. Documents lie in Hilbert order of their
    projected word vectors and fill sequences without gaps; a document is cut where a sequence is full, and only the
    last sequence of a range of the curve may be short. Null and empty texts have end_id alone. Repeated rows are
    packed each; further columns are not read; an empty table gives an empty result. Ids are integers; rows
    without one are left out.

    The ranges are cut at quantiles of a bounded sample of keys; each task sorts and packs one range as a stream. Every
    range begins with a sequence of its own; how many there are follows from the text's bytes (range_count).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null")
    total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    ranges = ranges or range_count(total.bytes, length, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = [places(texts[p], ids[p], p.start) for p in portions(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.empty(0, np.int64)]))], names=["key"])

    some = docs if total.n <= SAMPLE else docs.sample(min(1.0, SAMPLE / total.n), 17).limit(2 * SAMPLE)
    sample = some.mapInArrow(keyed, "key long").toPandas().key.to_numpy()
    cuts = np.unique(np.quantile(sample, np.linspace(0, 1, ranges + 1)[1:-1]).astype(np.int64)) if len(sample) else np.empty(0, np.int64)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        kind = "<u2" if len(c.pieces) <= 1 << 16 else "<u4"
        for batch in batches:
            texts, all_ids = batch.column(1).to_pylist(), batch.column(0).to_numpy(zero_copy_only=False)
            for p in portions(texts):
                key = places([(t or "").encode() for t in texts[p]], all_ids[p], p.start)
                parts = [c.encode_whole(t).astype(kind).tobytes() for t in texts[p]]
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, key, "right").astype(np.int32)), pa.array(key), pa.array(all_ids[p]), pa.array(parts, pa.binary())], names=["range", "key", "doc_id", "ids"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        kind = "<u2" if len(c.pieces) <= 1 << 16 else "<u4"
        used, own = 0, None
        for batch in batches:
            out: list[tuple] = []
            for r, d, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                used, own = (used if r == own else 0), r
                ids = np.append(np.frombuffer(b, kind), [end_id]).astype("<u4")
                at, raw = 0, ids.tobytes()
                while at < len(ids):
                    n = min(length - used % length, len(ids) - at)
                    out.append((d, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), len(ids), r * RANGE + used // length, used % length))
                    at, used = at + n, used + n
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 7)], names=names)

    rows = docs.mapInArrow(encoded, "range int, key long, doc_id long, ids binary")
    rows = rows.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "key", "doc_id")
    out = rows.mapInArrow(packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_column)
