"""Helpers for Arrow batches of documents: groups of bounded size and tables of known pieces."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_CHARS = 2_000_000


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives the memory it no longer needs back to the system, before it starts and
    when it ends: Spark's Python workers live on from stage to stage, beside the JVM."""

    def release() -> None:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        release()

    return own


def spans(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of ranges of items that have about `most` together; a larger one stands alone."""
    start = size = 0
    for i, n in enumerate([*sizes, None]):
        if i > start and (n is None or size + n > most):
            yield start, i
            start, size = i, 0
        size += n or 0


def byte_sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def ranges(column: pa.Array, most: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """(start, end) of ranges of an Arrow column of texts with about `most` bytes; a longer text
    stands alone."""
    return spans(byte_sizes(column).tolist(), most)


def groups(column: pa.Array, most: int = GROUP_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, texts) of the `ranges` of a column. Only one range at a time becomes Python
    strings."""
    for start, end in ranges(column, most):
        yield start, end, column.slice(start, end - start).to_pylist()


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + length], one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class Pieces:
    """Ids of pieces of text that were met before. Past `limit` pieces it starts anew, so its
    memory is bounded however many different pieces the corpus has."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 600_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (given as lists of pieces), one after another, and each text's count."""
        pieces = [p for one in split for p in one]
        if len(self.known) > self.limit:
            self._clear()
        codes = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            unknown = [pieces[i] for i in missing.tolist()]
            new = list(dict.fromkeys(unknown))
            flat, lengths = self.encode(new)  # ids of all, one after another, and how many each has
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            codes[missing] = np.fromiter(map(self.known.__getitem__, unknown), np.int64, len(unknown))
        lengths = self.lengths[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        last = np.cumsum([0, *map(len, split)])
        return gather(self.flat, self.starts[codes], lengths), np.diff(ends[last])


def list_column(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
