"""Token ids by the tokenizers library, with every different chunk of text encoded once.

The word vocabulary drops white space, and none of its normalisation or splitting looks
across a space or a line break, so texts are cut at these two characters and the ids of a
chunk don't depend on its neighbours. Letters and punctuation are never one token, and case
is dropped, so a chunk that is a run of letters with punctuation after it has the ids of the
two parts. Everything else is the library's work: small letters that nothing normalises or splits
go to its model at once, as the bytes' characters; of other parts it gets many in one call, with a
digit between them, as it always splits digits off.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.ragged import Pieces, gather, groups
from tallyweave.session import ship


MARK = "0"
CALL = 500
# Small letters, and the characters that stand for those bytes of them which can't be printed.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, (*range(0xDF, 0xF7), *range(0xF8, 0x100))))
PLAIN = re.compile(f"[{LETTERS}]+")
BYTES = {0x9F: 0x141, 0xA0: 0x142, 0xAD: 0x143}
ENDING = re.compile(r"([^\W\d_]+)([.,;:!?|$#*&%]+)")


class Words:
    """Encodes texts without special tokens of the library's own."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(vocabulary)
        marks = self._library([MARK, f"a {MARK} b", f"a{MARK}b"])
        self.mark = marks[0][0] if len(marks[0]) == 1 and all(x.count(marks[0][0]) == 1 for x in marks) else None
        self.cut = self._fits()
        self.model = self.lib.model
        self.plain = self.cut and self._takes_bytes()
        self.parts = Pieces(self._encode_parts)
        self.chunks = Pieces(self._encode_chunks)

    def _fits(self) -> bool:
        """Whether the vocabulary does what the module's text says of it, so that texts may be cut;
        if it doesn't, they are encoded whole."""
        samples = ["The Cat, saw", "ÉTÉ  à\nParis!", "x9 y\tZ#", "don't STOP..."]
        for text, ids in zip(samples, self._library(samples), strict=True):
            parts = [p for w in re.split(r"[ \n]+", text) for p in re.findall(r"[^\W\d_]+|[.,;:!?|$#*&%]+|.", w)]
            if "'" not in text and (ids != self._library([text.lower()])[0] or ids != [i for x in self._library(parts) for i in x]):
                return False
            if ids != [i for x in self._library([w for w in re.split(r"[ \n]+", text) if w]) for i in x]:
                return False
        return self.mark is not None

    def _takes_bytes(self) -> bool:
        """Whether the library's model has the ids of small letters from their bytes alone."""
        samples = [w for a in LETTERS for b in "aeknßéü" for w in (a, a + b, f"{b}{a}{b}er")] + [LETTERS, LETTERS[::-1] * 20]
        return [self._model(w) for w in samples] == self._library(samples)

    def _model(self, part: str) -> list[int]:
        return [t.id for t in self.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(BYTES))]

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths, direct = np.zeros(len(parts), np.int64), [bool(self.plain and PLAIN.fullmatch(p)) for p in parts]
        flats, order = [], [k for k, own in enumerate(direct) if own]
        ids = [self._model(parts[k]) for k in order]
        lengths[order] = np.fromiter(map(len, ids), np.int64, len(ids))
        flats.append(np.fromiter(chain.from_iterable(ids), np.int64))
        plain = [k for k, p in enumerate(parts) if not direct[k] and MARK not in p] if self.mark is not None else []
        for at in range(0, len(plain), CALL):
            some = plain[at : at + CALL]
            flat = np.array(self._library([f" {MARK} ".join(parts[k] for k in some)])[0], np.int64)
            ends = np.append(np.flatnonzero(flat == self.mark), len(flat))
            lengths[some] = np.diff(ends, prepend=-1) - 1
            flats.append(flat[flat != self.mark])
            order += some
        rest = [k for k in range(len(parts)) if MARK in parts[k]] if self.mark is not None else [k for k in range(len(parts)) if not direct[k]]
        for k, ids in zip(rest, self._library([parts[k] for k in rest]), strict=True):
            lengths[k] = len(ids)
            flats.append(np.array(ids, np.int64))
            order.append(k)
        flat, order = np.concatenate([np.zeros(0, np.int64), *flats]), np.array(order, np.int64)
        starts = np.zeros(len(parts), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return gather(flat, starts, lengths), lengths

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = []
        for c in chunks:
            if c.isalpha() and (c.isascii() or PLAIN.fullmatch(c.lower())):
                split.append([c.lower()])
                continue
            m = ENDING.fullmatch(c)
            if m and "\u0130" not in c:  # its small letter has a mark that would join the punctuation
                split.append([m[1].lower(), m[2]] if "\u03a3" not in c else [m[1], m[2]])
            else:
                split.append([c.lower()] if c.isascii() else [c])
        return self.parts.ids(split)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's count."""
        if not self.cut:
            ids = self._library(texts)
            return np.array([i for x in ids for i in x], np.int64), np.fromiter(map(len, ids), np.int64, len(ids))
        return self.chunks.ids([[w for w in t.replace("\n", " ").split(" ") if w] for t in texts])


@lru_cache(maxsize=2)
def _words(vocabulary: str) -> Words:
    return Words(vocabulary)


def place(vocabulary: str | None) -> str:
    if vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(batch: pa.RecordBatch, text: str, vocabulary: str | None, end: int | None):
    """(row, ids as int32) of each row of an Arrow batch; `end` is put after each document."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one thread
    own = _words(place(vocabulary))
    tail = np.array([] if end is None else [end], np.int32)
    for start, stop, texts in groups(batch.column(batch.schema.get_field_index(text))):
        flat, counts = own.encode(texts)
        at = 0
        for row, n in zip(range(start, stop), counts.tolist(), strict=True):
            yield row, np.concatenate([flat[at : at + n], tail])
            at += n


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) of rows that have a doc_id."""
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast(T.LongType()).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )


def token_ids(docs: DataFrame, vocabulary: str | None = None, end: int | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers as binary)."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows, ids = [], []
            size = 0
            for row, x in encoded(b, "text", vocabulary, end):
                rows.append(row)
                ids.append(x.astype("<u4").tobytes())
                size += len(ids[-1])
                if size > 16_000_000:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(ids, pa.binary())], ["doc_id", "ids"])
                    rows, ids, size = [], [], 0
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, ids binary")
