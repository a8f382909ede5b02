"""Operator 8: removal of repeated byte strings by a prefix-free parse.

Let n be the length that counts (400). Rolling-hash triggers make the parse: at every position the 8 bytes from it
are hashed, and the trigger of the string of n bytes at i is the last least hash among the first GAP positions of
it. So a trigger depends on the string alone, and the strings with the same trigger are neighbours. A phrase is the text
from the first of them to the trigger, and the parse goes on behind it; what follows is its parse suffix, of which the
bytes up to the end of the last string count. Equal strings have triggers at the same distance, so a string repeats
another one if the suffixes of their two phrases are equal and their parse suffixes agree for the rest of n bytes.
All that can be equal shares the first n - GAP + 1 bytes of the parse suffix, its key: keys deal the work out.

- A key that occurs once: no string of the phrase occurs again.
- A key whose phrases and parse suffixes are all equal: all of them do.
- Else the key's distinct phrases are a dictionary. The suffix array of the dictionary (prefix doubling over all phrases
  of many keys at once) and the order of the parse suffixes, with the common prefixes of neighbours, combine into corpus
  order: by dictionary suffix first, then by the parse suffix behind it. A string repeats another one if it has n bytes
  in common with a neighbour in that order. A key with more than GROUP distinct phrases is not gathered: its strings
  are counted by a distributed aggregation of fingerprints instead.

Passages are found in the same way, with words in place of bytes: the buffer holds 8 bytes of fingerprint for each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.llm.common import cut, free
from telemetra.llm.words import MIX1, MIX2, fingerprints, word_spans

#: Positions among which a string's trigger is sought; distinct phrases of a key that one task gathers.
GAP, GROUP = 256, 4096
#: GAP for passages, in words.
WORD_GAP = 32
#: Entries whose corpus order one step of a task makes, and symbols of their heads, or more by what is left of the last key.
STEP, STEP_SYMBOLS = 8192, 1 << 19
#: Starts of a text whose triggers are sought at once.
BLOCK = 1 << 17
_SEED = 0x5EED


def _units(text: bytes, words: bool) -> tuple[bytes, int]:
    """The buffer that strings are looked for in, and how many of its bytes are one position: the text, or its words' fingerprints."""
    if not words:
        return text, 1
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(data)
    return (fingerprints(data, starts, ends).tobytes() if len(starts) else b""), 8


def _triggers(buffer: bytes, unit: int, n: int, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triggers of a text with n positions or more; the first and the last start of the strings that have each. A long text
    goes in blocks of starts, so that what is held beside it does not grow with it."""
    count = len(buffer) // unit - n + 1
    found, firsts, before = [], [], -1
    for begin in range(0, count, BLOCK):
        end = min(begin + BLOCK, count) + gap - 1  # of the positions that triggers of this block are sought among
        if unit == 8:
            h = np.frombuffer(buffer, np.uint64)[begin:end]
        else:
            own = np.frombuffer(buffer, np.uint8)[begin : end + 7]
            h = np.ascontiguousarray(np.lib.stride_tricks.as_strided(own, (len(own) - 7, 8), (1, 1))).view(np.uint64).ravel()
        h = (h * MIX1) ^ ((h * MIX1) >> np.uint64(29))
        h = (h * MIX2) & np.uint64(0xFFFFFFFF00000000)
        low = h | np.arange(0xFFFFFFFF - begin, 0xFFFFFFFF - begin - len(h), -1, dtype=np.int64).view(np.uint64)  # the last of equal ones is least
        have = 1
        while have < gap:
            step = min(have, gap - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        at = (np.uint64(0xFFFFFFFF) - (low[:BLOCK] & np.uint64(0xFFFFFFFF))).astype(np.int64)
        new = np.flatnonzero(np.diff(at, prepend=before))
        found.append(at[new])
        firsts.append(begin + new)
        before = at[-1]
    first = np.concatenate(firsts)
    return np.concatenate(found), first, np.append(first[1:] - 1, count - 1)


def _phrases(docs: DataFrame, n: int, gap: int, words: bool) -> DataFrame:
    """The parse: (key, phrase, doc_id, places), a row for each distinct phrase of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_of, phrase_of = xxhash.xxh3_64_intdigest, xxhash.xxh3_64_intdigest
        for batch in batches:
            out: list[list] = [[], [], [], []]
            size = 0

            def flush():
                hashes = [pa.array(np.concatenate(x).view(np.int64)) for x in out[:2]]
                return pa.RecordBatch.from_arrays([*hashes, pa.array(np.concatenate(out[2])), pa.array(out[3], pa.list_(pa.int64()))], names=["key", "phrase", "doc_id", "places"])

            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text, unit = _units((t.as_py() or "").encode(), words)
                if len(text) < n * unit:
                    continue
                at, first, last = _triggers(text, unit, n, gap)
                tail = n - gap + 1
                keys = np.array([key_of(text[a * unit : (a + tail) * unit]) for a in at.tolist()], np.uint64)
                phrases = np.array([phrase_of(text[i * unit : (j + n) * unit], a - i) for a, i, j in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)], np.uint64)
                places = first << 16 | (last - first) << 8 | (at - last)  # both differences are under GAP <= 256
                order = np.lexsort((phrases, keys))
                new = np.append(True, (np.diff(keys[order]) != 0) | (np.diff(phrases[order]) != 0)) if len(at) else np.zeros(0, bool)
                begin = np.flatnonzero(new)
                out[0].append(keys[order][begin])
                out[1].append(phrases[order][begin])
                out[2].append(np.full(len(begin), d, np.int64))
                out[3] += np.split(places[order], begin[1:])
                size += len(at)
                if size > 50_000:
                    yield flush()
                    out, size = [[], [], [], []], 0
            if size:
                yield flush()

    return docs.mapInArrow(run, "key long, phrase long, doc_id long, places array<long>")


def _dictionary(found: DataFrame, docs: DataFrame, n: int, words: bool) -> DataFrame:
    """Distinct phrases (key, phrase, times, doc_id, place) with their text: `starts`, how many strings begin in it, `head`,
    from the first of them to the trigger, `tail`, from there to the end of the last one."""
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("key", "phrase", "times", "place")).alias("own"))
    rows = docs.join(per_doc, "doc_id").select("text", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["key", "phrase", "times", "starts", "head", "tail"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        out: list[list] = [[] for _ in names]
        for batch in batches:
            for t, own in zip(batch.column(0), batch.column(1), strict=True):
                text, unit = _units(t.as_py().encode(), words)
                for x in own.as_py():
                    first = x["place"] >> 16
                    last = first + (x["place"] >> 8 & 255)
                    trigger = last + (x["place"] & 255)
                    row = (x["key"], x["phrase"], x["times"], last - first + 1, text[first * unit : trigger * unit], text[trigger * unit : (last + n) * unit])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    if len(out[0]) == STEP // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
                        out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, "key long, phrase long, times long, starts int, head binary, tail binary")


def suffix_ranks(strings: list[bytes], unit: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Where each string begins in a row of all, an end mark after each, and the rank of the suffix at each place.

    Prefix doubling: ranks by so many symbols, then by twice as many, until the longest string is covered. Equal
    suffixes (of different strings) have equal ranks; end marks have rank 0. A symbol is a byte, or 8 bytes.
    """
    size = np.array([len(x) // unit for x in strings], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    end = np.repeat(begin + size, size + 1)
    at = np.arange(len(end))
    rank = np.zeros(len(end), np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint64 if unit == 8 else np.uint8)
    rank[at < end] = np.unique(flat, return_inverse=True)[1] + 1
    behind = lambda x, k: np.where(at + k <= end, x[np.minimum(at + k, len(x) - 1)], 0)
    span = 1
    if unit == 1:  # seven bytes fit one number
        one = rank
        for k in range(1, 7):
            rank = rank * 257 + behind(one, k)
        span = 7
        rank = np.unique(rank, return_inverse=True)[1]
    while span < size.max(initial=0):
        rank = np.unique(rank * (len(rank) + 1) + behind(rank, span), return_inverse=True)[1]
        span *= 2
    return begin, rank


def sorted_tails(tails: list[bytes], unit: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """The place of each string in sorted order, and common prefixes: level k has the least one of 2**k steps between
    neighbours in that order, step i leading to string i."""
    order = sorted(range(len(tails)), key=tails.__getitem__)
    place = np.empty(len(tails), np.int64)
    place[order] = np.arange(len(tails))
    size = np.array([len(tails[i]) for i in order], np.int64)
    width = int(size.max(initial=1))
    flat = np.frombuffer(b"".join(tails[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(tails), width)
    apart = flat[1:] != flat[:-1]
    first = np.where(apart.any(1), apart.argmax(1), width)
    steps = np.append(0, np.minimum(first, np.minimum(size[1:], size[:-1])) // unit)
    levels = [steps]
    while 2 << len(levels) - 1 <= len(tails):
        k = 1 << len(levels) - 1
        levels.append(np.minimum(levels[-1][:-k], levels[-1][k:]))
    return place, levels


def repeated_starts(group: np.ndarray, starts: np.ndarray, heads: list[bytes], tails: list[bytes], n: int, unit: int = 1) -> np.ndarray:
    """Which starts have n symbols in common with another entry's start of the same group, for all entries in a row."""
    begin, rank = suffix_ranks(heads, unit)
    place, levels = sorted_tails(tails, unit)
    entry = np.repeat(np.arange(len(heads)), starts)
    start = np.arange(len(entry)) - np.repeat(np.cumsum(starts) - starts, starts)
    left = np.array([len(x) // unit for x in heads], np.int64)[entry] - start
    suffix = rank[begin[entry] + start] + group[entry] * (len(rank) + 1)
    order = np.lexsort((place[entry], suffix))  # corpus order: dictionary suffix, then parse suffix
    a, b = order[:-1], order[1:]
    same = suffix[a] == suffix[b]
    a, b = a[same], b[same]
    lo, hi = place[entry[a]] + 1, place[entry[b]] + 1
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    common = np.zeros(len(a), np.int64)
    for k in np.unique(level).tolist():
        own = level == k
        common[own] = np.minimum(levels[k][lo[own]], levels[k][hi[own] - (1 << k)])
    hit = left[a] + common >= n
    out = np.zeros(len(entry), bool)
    out[a[hit]] = out[b[hit]] = True
    return out


def _repeated(batches: Iterator[pa.RecordBatch], n: int, unit: int) -> Iterator[pa.RecordBatch]:
    """Which starts of each phrase are repeated, for rows (key, phrase, times, starts, head, tail) sorted by key."""
    waiting: list[pa.RecordBatch] = []

    def done(rows: pa.Table) -> pa.RecordBatch:
        key, phrase, starts = (rows.column(k).to_numpy() for k in ("key", "phrase", "starts"))
        group = np.cumsum(np.append(0, np.diff(key) != 0))
        again = repeated_starts(group, starts, rows.column("head").to_pylist(), rows.column("tail").to_pylist(), n, unit)
        again |= np.repeat(rows.column("times").to_numpy() > 1, starts)
        parts = [(k, np.packbits(x).tobytes()) for k, x in enumerate(np.split(again, np.cumsum(starts)[:-1])) if x.any()]
        at = np.array([k for k, _ in parts], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(phrase[at]), pa.array([x for _, x in parts], pa.binary())], names=["key", "phrase", "again"])

    symbols = lambda rows: (pc.sum(pc.binary_length(rows.column("head"))).as_py() or 0) // unit
    for batch in (b.slice(k, STEP // 16) for b in batches for k in range(0, len(b), STEP // 16)):
        waiting.append(batch)
        if sum(map(len, waiting)) >= STEP or sum(map(symbols, waiting)) >= STEP_SYMBOLS:
            rows = pa.Table.from_batches(waiting)
            key = rows.column("key").to_numpy()
            whole = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if whole:
                yield done(rows.slice(0, whole))
                waiting = rows.slice(whole).to_batches()
    if sum(map(len, waiting)):
        yield done(pa.Table.from_batches(waiting))


def repeated_spans(docs: DataFrame, n: int = 400, gap: int = GAP, group: int = GROUP, words: bool = False) -> DataFrame:
    """(doc_id, places, again): starts of repeated strings; again is null where all of the phrase's starts are. Positions are bytes, or words."""
    unit = 8 if words else 1
    parse = cut(_phrases(docs, n, gap, words))
    keys = parse.groupBy("key").agg(F.sum(F.size("places")).alias("n"), F.min("phrase").alias("low"), F.max("phrase").alias("high")).where("n > 1")
    keys = keys.select("key", (F.col("low") < F.col("high")).alias("mixed"))
    active = cut(parse.join(keys, "key"))
    free(parse)
    whole = active.where("not mixed").select("doc_id", "places", F.lit(None).cast("binary").alias("again"))
    mixed = active.where("mixed")
    found = mixed.groupBy("key", "phrase").agg(F.sum(F.size("places")).alias("times"), F.min(F.struct("doc_id", F.col("places")[0].alias("place"))).alias("x"))
    entries = cut(_dictionary(found.select("key", "phrase", "times", "x.*"), docs, n, words))
    large = entries.groupBy("key").count().where(F.col("count") > group).select("key")
    small = entries.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    flags = small.mapInArrow(lambda batches: _repeated(batches, n, unit), "key long, phrase long, again binary")

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = xxhash.xxh3_64_intdigest
        for x in batches:
            for at in range(0, len(x), 500):
                part = x.iloc[at : at + 500]
                size = part.starts.to_numpy()
                texts = [a + b for a, b in zip(part["head"], part["tail"], strict=True)]
                rank = np.array([h(t[i * unit : (i + n) * unit], _SEED) for t, s in zip(texts, size.tolist(), strict=True) for i in range(s)], np.uint64)
                yield pd.DataFrame({"key": np.repeat(part.key.to_numpy(), size), "phrase": np.repeat(part.phrase.to_numpy(), size), "times": np.repeat(part.times.to_numpy(), size), "start": np.concatenate([np.arange(s) for s in size]), "size": np.repeat(size, size), "rank": rank.view(np.int64)})

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for places, size in zip(x.starts, x["size"], strict=True):
                f = np.zeros(size, bool)
                f[np.asarray(places, np.int64)] = True
                out.append(np.packbits(f).tobytes())
            yield pd.DataFrame({"key": x.key, "phrase": x.phrase, "again": out})

    spread = entries.join(large, "key", "left_semi").mapInPandas(starts, "key long, phrase long, times long, start long, size long, rank long")
    often = spread.groupBy("key", "rank").agg(F.sum("times").alias("all")).where("all > 1").select("key", "rank")
    spread = spread.join(often, ["key", "rank"]).groupBy("key", "phrase").agg(F.collect_list("start").alias("starts"), F.first("size").alias("size"))
    flags = cut(flags.unionByName(spread.mapInPandas(bits, "key long, phrase long, again binary")))
    free(entries)
    part = mixed.join(flags, ["key", "phrase"]).select("doc_id", "places", "again")
    return whole.unionByName(part)


def remove_repeats(docs: DataFrame, n: int = 400, id_column: str = "doc_id", text_column: str = "text", gap: int = GAP, group: int = GROUP, words: int | None = None, row_column: str | None = None) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept (binary, the remaining bytes),
    kept_text (these without the bytes of characters that lost a part), kept_sha256.

    Every byte that a string of n bytes covers which also starts elsewhere in the corpus, the same document
    included, is removed; strings never cross documents and are judged on the input. Null counts as empty; texts
    under n bytes stay whole. A very long text is one row here, as it is in the table; what is gathered beside it (its places
    in the parse, about one for 75 bytes) is less than the text. A row that repeats another loses all of its bytes, if it has n or more. Ids are integers,
    one for each text; rows without an id are left out; further columns are not read; an empty table gives an empty
    result.

    With words, every run of so many words (WORD_GAP at least) that also starts elsewhere is removed as well, however
    few bytes it has: from its first word's first byte to its last word's last. Words are runs of bytes other than space
    and 0x09-0x0D; equal words make equal runs, whatever white space is between. The column row_column is returned as it is, so that
    what goes with a text needs no join.
    """
    more = [F.col(row_column).alias("row")] if row_column else []
    kind = f", row {docs.schema[row_column].dataType.simpleString()}" if row_column else ""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), *more).where("doc_id is not null")
    spans = repeated_spans(docs.select("doc_id", "text"), n, gap, group).withColumn("n", F.lit(0))
    if words:
        spans = spans.unionByName(repeated_spans(docs.select("doc_id", "text"), words, WORD_GAP, group, True).withColumn("n", F.lit(words)))
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("places", "again", "n")).alias("spans"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batches in slices of about half a million bytes of text."""
        for batch in batches:
            size = np.cumsum([x or 0 for x in pc.binary_length(batch.column(1)).to_pylist()]) >> 19
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(batch)]
            yield from (batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False) if j > i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out: list[tuple] = []
            for d, t, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = (t.as_py() or "").encode()
                edge = np.zeros(len(text) + 1, np.int32)
                spans = spans.as_py() or ()
                if any(s["n"] for s in spans):
                    begin, end = word_spans(np.frombuffer(text, np.uint8))
                for s, place in ((s, place) for s in spans for place in s["places"]):
                    size = s["n"] or n
                    first, more = place >> 16, place >> 8 & 255
                    if first + more + size > (len(begin) if s["n"] else len(text)):  # of another text with this id
                        continue
                    if s["again"] is None:
                        left, right = first, first + more + size - 1
                    else:
                        left = first + np.flatnonzero(np.unpackbits(np.frombuffer(s["again"], np.uint8), count=more + 1))
                        right = left + size - 1
                    np.add.at(edge, begin[left] if s["n"] else left, 1)
                    np.add.at(edge, end[right] if s["n"] else right + 1, -1)
                gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((d, len(text), int(gone.sum()), int((np.diff(gone.view(np.int8), prepend=np.int8(0)) == 1).sum()), kept, kept.decode("utf-8", "ignore"), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.string(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)] + ([batch.column(3)] if row_column else [])
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "kept_sha256"] + (["row"] if row_column else []))

    out = docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans", *(["row"] if row_column else []))
    out = out.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string, kept_sha256 string{kind}")
    return out.withColumnsRenamed({"doc_id": id_column} | ({"row": row_column} if row_column else {}))
