"""Hashed words and five-word shingles of groups of texts, as flat numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE = 5
# Odd multipliers of a 64-bit mixing function, and one for each word of a shingle.
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A random-looking permutation of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


# The UTF-8 forms of white space (as str.split takes it) of one byte; of two or three
# bytes, as the leading bytes and the last bytes that may follow.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
_WIDE_SPACES = [
    ([0xC2], [0x85, 0xA0]),
    ([0xE1, 0x9A], [0x80]),
    ([0xE2, 0x80], [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]),
    ([0xE2, 0x81], [0x9F]),
    ([0xE3, 0x80], [0x80]),
]
#: Bytes of words that are hashed at once (a longer word stands alone).
BLOCK = 1 << 17
_BASE = 0x9E3779B97F4A7C15  # a word's hash is a polynomial of its bytes in it, modulo 2^64
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return out.cumprod(dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, BLOCK), _powers(pow(_BASE, -1, 1 << 64), BLOCK)


def word_places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of texts, start and end in them of each word (as str.split
    cuts them), and each text's count of words. A null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    space = _SPACE[data]
    for lead, last in _WIDE_SPACES:
        n = len(lead)
        at = np.flatnonzero(data[: len(data) - n] == lead[0]) if len(data) > n else np.zeros(0, np.int64)
        for k in range(1, n):
            at = at[data[at + k] == lead[k]]
        at = at[np.isin(data[at + n], last)]
        for k in range(n + 1):
            space[at + k] = True
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    word = ~space
    starts = np.flatnonzero(word & (cut[:-1] | np.concatenate([[True], space])[: len(data)]))
    ends = np.flatnonzero(word & (cut[1:] | np.concatenate([space[1:], [True]])[: len(data)])) + 1
    return data, starts, ends, np.diff(np.searchsorted(starts, offsets))


def hash_places(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word. Words are hashed in blocks of bounded size."""
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        at = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, at + BLOCK, side="right")))
        n = int(ends[hi - 1] - at)
        up, down = (_UP, _DOWN) if n <= BLOCK else (_powers(_BASE, n), _DOWN)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data[at : at + n]] * up[:n], out=sums[1:])
        first, last = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = mix((sums[last] - sums[first]) * down[first] + mix((last - first).astype(np.uint64)))
        lo = hi
    return out


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and each text's count."""
    data, starts, ends, counts = word_places(column)
    return hash_places(data, starts, ends), counts


def shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of SHINGLE words; a text of one to four words is
    one run. In order of text and place."""
    short = (counts > 0) & (counts < SHINGLE)
    if short.any():  # fill short texts up with zeros
        padded = np.where(short, SHINGLE, counts)
        to = np.arange(len(words)) + np.repeat(np.cumsum(padded) - padded - (np.cumsum(counts) - counts), counts)
        full = np.zeros(int(padded.sum()), np.uint64)
        full[to] = words
        words, counts = full, padded
    text = np.repeat(np.arange(len(counts)), counts)
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out += mix(words[k : k + n] ^ _PLACES[k]) * _PLACES[k]
    whole = text[:n] == text[SHINGLE - 1 :]
    return mix(out[whole]), text[:n][whole]


def distinct(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes of each text in ascending order, their text and how often they occur."""
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    return hashes[at], text[at], np.diff(np.append(at, len(hashes)))
