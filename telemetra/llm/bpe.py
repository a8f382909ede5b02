"""Operator 7: byte-level BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged over, so a text may be cut there for
certain. The cuts before white space are made first, with array operations over many texts at once; every distinct
chunk of a portion is looked up in a bounded table. A chunk that is not there goes through the vocabulary's own
pre-token pattern, each pre-token is cut at its forced boundaries, and each fragment is merged alone. Ids are
concatenated. Within a portion equal chunks are found by 64-bit fingerprints and then compared byte by byte; in the
table they are told apart by their bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tiktoken._tiktoken import CoreBPE

from telemetra.llm.words import fingerprints, portions

#: Fixed value: the pre-token pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks that a process keeps; a full table is emptied. Longer chunks are not kept.
TABLE, KEPT = 500_000, 64
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def _characters() -> list[str]:
    """How the vocabulary writes each byte: printable ones as themselves, the others as characters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Codec:
    """Encodes texts to ids and decodes ids, for a tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.written = dict(enumerate(_characters()))
        byte_of = {c: b for b, c in self.written.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pieces = [b""] * (1 + max([*spec["model"]["vocab"].values(), *self.special.values()]))
        self.inside = np.zeros((256, 256), bool)
        for token, k in spec["model"]["vocab"].items():
            if token not in self.special:
                p = self.pieces[k] = bytes(byte_of[c] for c in token)
                self.inside[list(p[:-1]), list(p[1:])] = True
        for token, k in self.special.items():
            self.pieces[k] = token.encode()
        #: The cuts before white space are sure if no token holds such a pair. 0xA0 ends the no-break space, see chunks().
        if self.inside[np.ix_(~_WHITE & (np.arange(256) != 0xA0), _WHITE)].any():
            raise ValueError("this vocabulary has tokens over the start of white space")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in merges]
        if made != sorted(set(made)):
            raise ValueError("this vocabulary's ids do not follow the order of its merges")
        #: Merging the pair with the smallest id first is then merging by rank.
        core = CoreBPE({p: k for k, p in enumerate(self.pieces) if p and k not in self.special.values()}, {}, PATTERN)
        self.merge, self.whole = core.encode_single_piece, core.encode_to_tiktoken_buffer
        self.pattern = regex.compile(PATTERN)
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.table: dict[bytes, bytes] = {}

    def chunks(self, data: np.ndarray) -> np.ndarray:
        """Where white space follows another character: pre-tokens end there, and no merge reaches over it.

        Not after a white character beyond ASCII, since the pattern takes a run of white space as a whole.
        """
        white = _WHITE[data]
        at = np.flatnonzero(white[1:] & ~white[:-1]) + 1
        p1, p2 = data[at - 1], data[np.maximum(at - 2, 0)]
        wide = (p1 >= 0x80) & (np.isin(p2, (0x80, 0x81, 0x9A)) | (p2 == 0xC2) & ((p1 == 0xA0) | (p1 == 0x85)))
        return at[~wide]

    def merged(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks: pre-tokens, their fragments between forced boundaries, and each fragment's merges."""
        found = list(map(self.pattern.findall, map(bytes.decode, chunks)))
        coded = [w.encode() for words in found for w in words]
        joined = b"".join(coded)
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum(list(map(len, coded)), dtype=np.int64)
        cuts = np.append(~self.inside[data[:-1], data[1:]], True) if len(data) else np.zeros(0, bool)
        cuts[ends - 1] = True
        bounds = np.flatnonzero(cuts) + 1
        at = [0, *bounds.tolist()]
        ids = list(map(self.merge, [joined[a:b] for a, b in zip(at, at[1:], strict=False)]))
        size = np.append(0, np.cumsum(list(map(len, ids)), dtype=np.int64))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, size[-1]).tobytes()
        last = np.cumsum(list(map(len, chunks)), dtype=np.int64)  # pre-tokens cover the chunk
        stop = [0, *(4 * size[np.searchsorted(bounds, last, "right")]).tolist()]
        return [flat[a:b] for a, b in zip(stop, stop[1:], strict=False)]

    @staticmethod
    def _unlike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, starts2: np.ndarray, ends2: np.ndarray) -> np.ndarray:
        """Which pieces [start, end), without gaps from 0 on, differ from the pieces [start2, end2)."""
        short = np.minimum(ends - starts, ends2 - starts2)
        moved = np.arange(len(data)) + np.repeat(starts2 - starts, ends - starts)
        good = np.arange(len(data)) < np.repeat(starts + short, ends - starts)
        apart = np.add.reduceat((data != data[np.where(good, moved, 0)]) | ~good, starts)
        return np.flatnonzero((apart > 0) | (ends - starts != ends2 - starts2))

    def _portion(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        bounds = np.cumsum([0, *map(len, texts)])
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        begins = np.zeros(len(data) + 1, bool)
        begins[self.chunks(data)] = begins[bounds] = True
        starts = np.flatnonzero(begins[:-1])
        ends = np.append(starts[1:], len(data))
        _, first, which = np.unique(fingerprints(data, starts, ends), return_index=True, return_inverse=True)
        keys = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        other = self._unlike(data, starts, ends, starts[first][which], ends[first][which])
        for k in other.tolist():  # a fingerprint that two chunks share: the chunk gets an entry of its own
            which[k] = len(keys)
            keys.append(joined[starts[k] : ends[k]])
        table = self.table
        found = list(map(table.get, keys))
        missing = [k for k, x in enumerate(found) if x is None]
        for k, ids in zip(missing, self.merged([keys[k] for k in missing]), strict=True):
            found[k] = ids
            if len(keys[k]) <= KEPT:
                if len(table) >= TABLE:
                    table.clear()
                table[keys[k]] = ids
        size = np.array(list(map(len, found))) // 4
        flat, begin, own = np.frombuffer(b"".join(found), np.uint32), np.cumsum(size) - size, size[which]
        total = np.cumsum(own)
        ids = flat[np.repeat(begin[which] - (total - own), own) + np.arange(total[-1])]
        return ids, np.diff(np.append(0, total)[np.searchsorted(starts, bounds)])

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has. Null counts as the empty text."""
        if not self.special or not any(t and any(x in t for x in self.special) for t in texts):
            parts = [self._portion([(t or "").encode() for t in texts[p]]) for p in portions(texts)]
            return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.empty(0, np.uint32), np.zeros(0, np.int64))
        ids, sizes = [], []
        for t in texts:
            own = [np.array([self.special[x]], np.uint32) if x in self.special else self._portion([x.encode()])[0] for x in self.split.split(t or "") if x]
            ids += own
            sizes.append(sum(map(len, own)))
        return np.concatenate([np.empty(0, np.uint32), *ids]), np.array(sizes, np.int64)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_batch([text])[0]

    def encode_whole(self, text: str | None) -> np.ndarray:
        """The same ids without forced boundaries and tables, by the library's own walk over the text."""
        if not text or any(x in text for x in self.special):
            return self.encode(text)
        return np.frombuffer(self.whole(text, set()), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(4)
def codec(path: str) -> Codec:
    """One codec, with its tables, for each file and process."""
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids; an empty table gives an empty result. Repeated rows give repeated results; other columns, whatever their names,
    are not read. Nothing is shuffled; a task holds one batch of texts and the codec's bounded tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts, sizes, coded, decoded = batch.column(1).to_pylist(), [], [], []
            for p in portions(texts):
                ids, size = c.encode_batch(texts[p])
                sizes += size.tolist()
                for own in np.split(ids.astype("<u4"), np.cumsum(size)[:-1]):
                    coded.append(hashlib.sha256(own.tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(c.decode(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    out = docs.select(docs[id_column], docs[text_column]).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_column)
