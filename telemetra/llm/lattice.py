"""Operator 2: embedding near-duplicates by lattice hashing in E8."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.llm.common import components, cut, forest, free
from telemetra.llm.words import mix

#: Hash tables, E8 blocks a table projects to, lattice scale, neighbouring cells that a vector probes besides its own.
#: Two random vectors of cosine 0.95 meet in some cell with a chance of 0.999, measured in tests/llm.
TABLES, BLOCKS, SCALE, PROBES = 8, 2, 2.0, 4
#: Rows of a bucket that are compared with one another at once; linked pairs that are looked at together.
BLOCK_ROWS, SLICE = 2048, 1 << 15


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: (+-1, +-1, 0...) in all places, and (+-1/2)**8 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            r = np.zeros(8)
            r[i], r[j] = a, b
            out.append(r)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2)
    off = x[odd] - r[odd]
    k = np.abs(off).argmax(1)
    r[odd, k] += np.where(off[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8 to the rows of x."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cells(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, probes: int = PROBES) -> np.ndarray:
    """Keys of unit vectors, [vector, table, 1 + probes]: the own cell, then neighbouring cells, the nearest first."""
    n, dim = unit.shape
    rng = np.random.default_rng(dim * 1000 + blocks)
    shell = roots()
    out = np.empty((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        shown = unit @ rng.standard_normal((dim, 8 * blocks)) / scale
        points = np.concatenate([nearest(shown[:, 8 * k : 8 * k + 8]) for k in range(blocks)], 1)
        gain = np.concatenate([(shown - points)[:, 8 * k : 8 * k + 8] @ shell.T for k in range(blocks)], 1)
        best = np.argpartition(-gain, min(probes, gain.shape[1] - 1), axis=1)[:, :probes]
        weight = mix(np.arange(1 + t * 8 * blocks, 1 + (t + 1) * 8 * blocks, dtype=np.uint64)) | np.uint64(1)
        step = (2 * shell).astype(np.int64).view(np.uint64)
        moves = np.concatenate([(step * weight[8 * k : 8 * k + 8]).sum(1, dtype=np.uint64) for k in range(blocks)])
        own = ((2 * points).astype(np.int64).view(np.uint64) * weight).sum(1, dtype=np.uint64)
        out[:, t, 0] = own
        out[:, t, 1:] = own[:, None] + moves[best]
        out[:, t] = mix(out[:, t] + mix(np.array([t * 100_003 + dim], np.uint64)))
    return out


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one batch that have numbers only, as rows of doubles, by length: yields (positions, matrix)."""
    by_length: dict[int, tuple[list, list]] = {}
    for k, v in enumerate(column.to_pylist()):
        if v and None not in v:
            at, rows = by_length.setdefault(len(v), ([], []))
            at.append(k)
            rows.append(v)
    for at, rows in by_length.values():
        x = np.array(rows, np.float64) + 0.0
        good = np.isfinite(x).all(1)
        if good.any():
            yield np.array(at)[good], x[good]


def _packed(vectors: DataFrame, single: bool) -> DataFrame:
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = [None] * len(batch)
            for at, x in matrix(batch.column(1)):
                for k, row, any_ in zip(at.tolist(), x.astype(kind), x.any(1), strict=True):
                    if any_:
                        out[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "bytes"])

    return vectors.mapInArrow(run, "vec_id long, bytes binary")


def near_vectors(vectors: DataFrame, least: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding", tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, probes: int = PROBES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per vector: id, n_links, component_id (smallest id reachable by links, itself included), kept.

    Vectors of one length link if their cosine in double precision is `least` or more. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing. Equal vectors are one class, so that copies are
    never paired. Each class enters its own cell of every table and probes neighbouring cells; what meets in a cell
    with at least one owner is compared. A cell with more than `block_rows` classes is compared in blocks, in
    separate tasks. A pair that meets in several cells counts in the first of them, which its keys tell, so links are
    counted where they are found: what leaves a task are counts and a spanning forest of its links, no pairs. Ids must be
    unique integers; rows without one are left out; further columns are not read; an empty table gives an empty result.
    """
    single = "float" in vectors.schema[vector_column].dataType.simpleString()
    kind, per = np.float32 if single else np.float64, 1 + probes
    rows = cut(_packed(vectors.select(vectors[id_column].cast("long"), vectors[vector_column]).where(vectors[id_column].isNotNull()), single))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for size in x.bytes.map(len).unique():
                own = x[x.bytes.map(len) == size]
                v = np.frombuffer(b"".join(own.bytes), kind).reshape(len(own), -1).astype(np.float64)
                k = cells(_unit(v), tables, blocks, scale, probes)
                yield own.assign(keys=list(k.reshape(len(own), -1).view(np.int64)))

    classes = rows.where("bytes is not null").groupBy("bytes").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = cut(classes.select("bytes", "rep", "copies").mapInPandas(hashed, "bytes binary, rep long, copies long, keys array<long>"))
    owned = classes.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.col("keys")[t * per])).alias("key")).groupBy("key").agg(F.count("*").alias("owners"))
    entered = classes.select("rep", F.posexplode("keys").alias("at", "key"))
    owned = cut(entered.join(owned, "key"))  # an own cell, or a probe of a cell that has an owner
    sizes = owned.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    active = owned.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / block_rows).cast("int"))
    active = active.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    active = active.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "at")
    met = active.join(classes, "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for x in itertools.chain(batches, [None]):
            if x is None:
                x, rest = rest, None
            else:
                x = x if rest is None else pd.concat([rest, x], ignore_index=True)
                last = ((x.key == x.key.iloc[-1]) & (x.i == x.i.iloc[-1]) & (x.j == x.j.iloc[-1])).to_numpy() if len(x) else np.zeros(0, bool)
                x, rest = x[~last], x[last]
            if x is not None and len(x):
                yield _links(x, kind, least, per)

    links = cut(met.mapInPandas(compared, "a long, b long, more long"))
    more = links.where("more is not null").groupBy("a").agg(F.sum("more").alias("more"))
    label = components(links.where("more is null").select("a", "b"))
    found = classes.join(more, classes.rep == more.a, "left").join(label, classes.rep == label.node, "left")
    found = found.select("bytes", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    free(owned)
    out = rows.join(found, "bytes", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).withColumnRenamed("vec_id", id_column)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def _first(x: pd.DataFrame, a: np.ndarray, b: np.ndarray, keys: np.ndarray, per: int) -> np.ndarray:
    """Whether the cell of a group is the first one that its rows a and b meet in: the first table, there the own cell of
    a if b enters it, else that of b. A probe meets an own cell only."""
    out = np.empty(len(a), bool)
    table, cell = x["at"].to_numpy() // per, x.key.to_numpy()
    for k in range(0, len(a), SLICE):
        i, j = a[k : k + SLICE], b[k : k + SLICE]
        ka, kb = (keys[r].reshape(len(r), -1, per) for r in (i, j))
        in_b, in_a = (kb == ka[:, :, :1]).any(2), (ka == kb[:, :, :1]).any(2)
        first = (in_a | in_b).argmax(1)
        row = np.arange(len(i))
        meet = np.where(in_b[row, first], ka[row, first, 0], kb[row, first, 0])
        out[k : k + SLICE] = (first == table[i]) & (meet == cell[i])
    return out


def _links(x: pd.DataFrame, kind: type, least: float, per: int) -> pd.DataFrame:
    """Of whole groups, sorted by (key, i, j): (a, null, how many linked vectors count for a here) and a forest (a, b, null) of the links."""
    v = _unit(np.frombuffer(b"".join(x.bytes), kind).reshape(len(x), -1).astype(np.float64))
    rep, copies, part = x.rep.to_numpy(), x.copies.to_numpy(), x.part.to_numpy()
    keys = np.array(x["keys"].tolist(), np.int64)
    cross = (x.i != x.j).to_numpy()
    new = np.append(True, (np.diff(x.key.to_numpy()) != 0) | (np.diff(x.i.to_numpy()) != 0) | (np.diff(x.j.to_numpy()) != 0))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(x)))
    count, edges = np.zeros(len(x), np.int64), [np.empty((0, 2), np.int64)]
    for n in np.unique(size):
        at = begin[size == n]
        if n == 1:
            continue
        step = max(1, (1 << 20) // (n * max(n, v.shape[1])))
        for k in range(0, len(at), step):
            rows = at[k : k + step, None] + np.arange(n)
            g, i, j = np.nonzero(np.matmul(v[rows], v[rows].transpose(0, 2, 1)) >= least)
            a, b = rows[g, i], rows[g, j]
            good = (rep[a] < rep[b]) & (~cross[a] | (part[a] != part[b]))
            a, b = a[good], b[good]
            good = _first(x, a, b, keys, per)
            a, b = a[good], b[good]
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            if len(a):
                edges.append(forest(pd.DataFrame({"a": rep[a], "b": rep[b]})).to_numpy())
    tree = forest(pd.DataFrame(np.concatenate(edges), columns=["a", "b"]))
    own = np.flatnonzero(count)
    counts = pd.DataFrame({"a": rep[own], "more": count[own]}).groupby("a", as_index=False).sum()
    empty = pd.array([None] * len(tree), "Int64")
    return pd.concat([tree.assign(more=empty).astype("Int64"), counts.assign(b=pd.array([None] * len(counts), "Int64")).astype("Int64")])[["a", "b", "more"]]
