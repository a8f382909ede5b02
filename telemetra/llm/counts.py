"""Operator 5: token counts that follow edits, from a segment tree of pre-token runs for each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.llm.bpe import Codec, codec
from telemetra.llm.words import portions

#: Certain cuts (see bpe) from one leaf's start to the next.
LEAF = 8
LEAVES = "array<struct<chars:bigint,tokens:bigint>>"


def leaves_of(c: Codec, texts: list[str]) -> list[np.ndarray]:
    """Of each text its leaves, rows of (characters, tokens). Leaves begin at certain cuts."""
    sizes: list[list[str]] = []
    for t in texts:
        raw = t.encode()
        at = c.chunks(np.frombuffer(raw, np.uint8))[LEAF - 1 :: LEAF].tolist()
        sizes.append([raw[a:b].decode() for a, b in zip([0, *at], [*at, len(raw)], strict=True)] if raw else [])
    flat = [x for own in sizes for x in own]
    tokens = np.array([len(c.encode_whole(x)) for x in flat], np.int64)
    rows = np.stack([np.array([len(x) for x in flat], np.int64), tokens], 1) if flat else np.zeros((0, 2), np.int64)
    return np.split(rows, np.cumsum([len(own) for own in sizes])[:-1])


class Tree:
    """Sums over leaves of (characters, tokens): a heap-shaped segment tree, its root at 1."""

    def __init__(self, leaves: np.ndarray):
        self.n = len(leaves)
        self.size = 1 << max(0, int(self.n - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + self.n] = leaves
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(1)
            level //= 2

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at a place (the last one for the end), and the characters before it."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if place - before >= self.sums[k, 0] and self.sums[k + 1, 0]:
                before += int(self.sums[k, 0])
                k += 1
        return k - self.size, before

    def put(self, first: int, rows: np.ndarray) -> None:
        """New values for leaves from `first` on, and for the sums above them."""
        lo, hi = first + self.size, first + len(rows) + self.size
        self.sums[lo:hi] = rows
        while lo > 1:
            lo, hi = lo // 2, (hi - 1) // 2 + 1
            self.sums[lo:hi] = self.sums[2 * lo : 2 * hi].reshape(-1, 2, 2).sum(1)

    @property
    def leaves(self) -> np.ndarray:
        return self.sums[self.size : self.size + self.n]


def edit(c: Codec, text: str, tree: Tree, start: int, stop: int, new: str) -> tuple[str, Tree, int]:
    """text[start:stop] = new: the text, the tree, and how many characters were encoded again.

    Only the leaves that the edit touches and one on either side are encoded again, not counting empty leaves, which an
    edit before may have left. A certain cut depends on two
    bytes before it and one after, so the cuts at the ends of that region stay certain. If the region keeps its number
    of leaves (or has fewer), sums are updated on the paths above them; else the tree is laid out anew from its leaves.
    """
    start, stop = min(max(start, 0), len(text)), min(max(stop, start, 0), len(text))
    first, before = tree.find(start)
    last, after = tree.find(stop)
    after += int(tree.leaves[last, 0]) if tree.n else 0
    for k in range(first - 1, -1, -1):
        first, held = k, int(tree.leaves[k, 0])
        before -= held
        if held:
            break
    for k in range(last + 1, tree.n):
        last, held = k, int(tree.leaves[k, 0])
        after += held
        if held:
            break
    region = text[before:start] + new + text[stop:after]
    rows = leaves_of(c, [region])[0]
    room = last - first + 1
    if tree.n and len(rows) <= room:
        tree.put(first, np.concatenate([rows, np.zeros((room - len(rows), 2), np.int64)]))
    else:
        tree = Tree(np.concatenate([tree.leaves[:first], rows, tree.leaves[last + 1 :]]))
    return text[:before] + region + text[after:], tree, len(region)


def count_tokens(docs: DataFrame, path: str, edits: str | None = "edits", id_column: str = "doc_id", text_column: str = "text", trees: bool = False, leaves: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, n_tokens, n_tokens_edited, n_chars_edited, n_chars_encoded, and with `trees` the leaves.

    `edits` names a column array<struct<start, stop, text>>, applied in order, each to the text that the ones before
    left; places are characters and are clipped to the text. Null edits, an empty array or a null replacement text
    (then empty) are allowed; without a column there are no edits. n_chars_encoded is what was encoded for the edits.
    Null and empty texts have no leaves. Repeated rows are counted each; further columns are not read; an empty table
    gives an empty result. A very long text is one row and one tree, of a leaf for about 50 of its bytes.

    The leaves, array<struct<chars, tokens>>, are those after the edits and can be kept beside the edited text. `leaves`
    names a column that has them for the text as it is: then nothing but the regions of the edits is encoded. Leaves
    that do not add up to the text's length (null ones too) are made anew. The columns of `carry` are returned as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            todo = batch.column("edits").to_pylist() if edits else [None] * len(texts)
            kept = _stored(batch.column("leaves"), texts) if leaves else [None] * len(texts)
            fresh = [k for k, own in enumerate(kept) if own is None]
            for p in portions([texts[k] for k in fresh]):
                for k, own in zip(fresh[p], leaves_of(c, [texts[k] for k in fresh[p]]), strict=True):
                    kept[k] = own
            out: list[tuple] = []
            for text, own, rows in zip(texts, todo, kept, strict=True):
                tree, again = Tree(rows), 0
                tokens = int(tree.sums[1, 1])
                for e in own or ():
                    text, tree, n = edit(c, text, tree, e["start"] or 0, e["stop"] or 0, e["text"] or "")
                    again += n
                out.append((tokens, int(tree.sums[1, 1]), len(text), again, tree.leaves[tree.leaves[:, 0] > 0]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            arrays = [batch.column("id"), *(pa.array(x, pa.int64()) for x in cols[:4])]
            names = ["id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_encoded"]
            if trees:
                flat = np.concatenate([*cols[4], np.zeros((0, 2), np.int64)])
                ends = np.cumsum([0, *map(len, cols[4])])
                rows = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["chars", "tokens"])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows))
                names.append("leaves")
            extra = [k for k in batch.schema.names if k.startswith("carried")]
            yield pa.RecordBatch.from_arrays(arrays + [batch.column(k) for k in extra], names=names + extra)

    simple = lambda x: docs.schema[x].dataType.simpleString()
    cols = [docs[id_column].alias("id"), docs[text_column].alias("text")]
    cols += [F.col(edits).cast("array<struct<start:long,stop:long,text:string>>").alias("edits")] if edits else []
    cols += [F.col(leaves).cast(LEAVES).alias("leaves")] if leaves else []
    cols += [docs[x].alias(f"carried{k}") for k, x in enumerate(carry)]
    schema = f"id {simple(id_column)}, n_tokens long, n_tokens_edited long, n_chars_edited long, n_chars_encoded long" + f", leaves {LEAVES}" * trees
    schema += "".join(f", carried{k} {simple(x)}" for k, x in enumerate(carry))
    names = {"id": id_column} | {f"carried{k}": x for k, x in enumerate(carry)}
    return docs.select(*cols).mapInArrow(run, schema).withColumnsRenamed(names)


def _stored(column: pa.ListArray, texts: list[str]) -> list[np.ndarray | None]:
    """The given leaves of each text, None where they are missing or of another length."""
    rows = column.flatten()
    flat = np.stack([rows.field(k).fill_null(0).to_numpy(zero_copy_only=False) for k in ("chars", "tokens")], 1) if len(rows) else np.zeros((0, 2), np.int64)
    size = np.array([n or 0 for n in column.value_lengths().to_pylist()], np.int64)
    given = np.split(flat, np.cumsum(size)[:-1]) if len(texts) else []
    return [g if int(g[:, 0].sum()) == len(t) else None for g, t in zip(given, texts, strict=True)]
