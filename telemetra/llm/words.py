"""Vectorised fingerprints of pieces of a byte buffer: no Python object per word.

A piece of up to 8 bytes has a fingerprint that no other piece of its length has: its bytes as one number, sent through
a bijection. A longer one is hashed 8 bytes at a time, each step through that bijection, which is not linear; a piece of
more than LANES * 8 bytes by xxh3. So unlike sums of powers there is no family of equal fingerprints to construct.
"""

from __future__ import annotations

import numpy as np
import xxhash

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Runs of 8 bytes that are hashed with array operations; longer pieces are hashed one by one.
LANES = 8
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the first so many bytes of a little-endian number.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte on as a number; zeros follow the end."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", wide, strides=(1,))


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Of the pieces [start, end) of a buffer of bytes; A-Z counts as a-z if lower."""
    data = _LOWER[data] if lower else data
    at, size = lanes(data), ends - starts
    out = mix(size.astype(np.uint64) * _GOLDEN) ^ (at[starts] & _KEEP[np.minimum(size, 8)])
    out = mix(out)
    more = np.flatnonzero((size > 8) & (size <= 8 * LANES))
    k = 8
    while len(more):
        out[more] = mix(out[more] * _GOLDEN + mix(at[starts[more] + k] & _KEEP[np.minimum(size[more] - k, 8)]))
        k += 8
        more = more[size[more] > k]
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of bytes other than space and 0x09-0x0D."""
    edge = np.diff(WHITE[data].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one buffer, a space after each; where each begins, and the end."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8) if texts else np.empty(0, np.uint8), bounds


def words_of(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints of many texts, in order, and the bounds of each text's words."""
    data, bounds = join(texts)
    starts, ends = word_spans(data) if len(data) else (np.empty(0, np.int64),) * 2
    return (fingerprints(data, starts, ends, lower) if len(starts) else np.empty(0, np.uint64)), np.searchsorted(starts, bounds)


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    return words_of([text], lower)[0]


def portions(texts: list, most: int = 1 << 19):
    """Slices of a list of texts of about so many characters together; a longer text is alone."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield slice(begin, k + 1)
            begin, size = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all runs of so many words, or of the whole sequence where there are fewer words."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * MIX2 + words[k : k + n])
    return out
