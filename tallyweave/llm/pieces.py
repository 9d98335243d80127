"""SentencePiece (byte-fallback BPE) encoding and decoding with vectorised merge rounds.

A text becomes "▁" + text with spaces as "▁". No piece of such a vocabulary has a "▁" after
another character, nor holds a line break, so text is cut there and each different word is
encoded once. All new words of a group lie in flat numpy arrays of symbols. A round finds
each word's minimum pair rank by a segmented minimum, merges the leftmost such pair of every
word at once, and compacts the arrays; words without a mergeable pair leave. This is the
order in which the library's queue merges: best score first, then leftmost. Where no pair with
the piece that a merge makes could come before that merge's own rank, all pairs of the word with
this rank are merged in the round, from the left: the queue would do the same one after another.
So a long text without spaces takes a round for each rank in it, not for each merge.

Edge cases: null and empty texts have no ids and decode to the empty string. Characters
outside the vocabulary become the ids of their UTF-8 bytes.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.ragged import Pieces, groups, list_column
from tallyweave.session import ship

SPACE = "▁"
#: Runs of spaces go with the word after them.
WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
FOREIGN = 1 << 21  # added to the code points of characters that no piece holds
NEVER = np.iinfo(np.int32).max


class Codec:
    """Encodes and decodes with the vocabulary of one model file."""

    def __init__(self, model: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i)}
        self.byte_ids = np.full(256, lib.unk_id(), np.int32)
        self.table, self.is_byte = [], np.zeros(n, bool)
        for i, p in enumerate(pieces):
            if lib.is_byte(i):
                self.byte_ids[int(p[3:5], 16)], self.is_byte[i] = i, True
                self.table.append(bytes([int(p[3:5], 16)]))
            else:
                self.table.append(p.replace(SPACE, " ").encode())
        for i in special:
            self.table[i] = " ⁇ ".encode() if lib.is_unknown(i) else b""
        self.control = {i for i in special if lib.is_control(i)}
        self.bytes = pa.array(self.table, pa.large_binary())
        #: Whether a text that starts with the piece loses its first character.
        self.lead = np.array([not self.is_byte[i] and i not in special and t[:1] == b" " for i, t in enumerate(self.table)])
        normal = {p: i for i, p in enumerate(pieces) if i not in special and not self.is_byte[i]}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p and len(p) > 1 for p in normal):
            raise ValueError("this vocabulary has pieces that go over the end of a word")
        extra = sorted({c for p in normal for c in p} - normal.keys())
        symbol = normal | {c: n + k for k, c in enumerate(extra)}
        self.size = n + len(extra)
        self.symbols = np.arange(0x110000, dtype=np.int64) + FOREIGN
        for c, i in symbol.items():
            if len(c) == 1:
                self.symbols[ord(c)] = i
        self.extra = {n + k: ord(c) for k, c in enumerate(extra)}
        score = {p: lib.get_score(i) for p, i in normal.items()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                left, right = symbol.get(p[:k]), symbol.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = (order[score[p]], i)
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.keys = keys if len(keys) else np.array([-1])
        self.ranks = np.array([pairs[k][0] for k in keys.tolist()] or [NEVER], dtype=np.int32)
        self.merged = np.array([pairs[k][1] for k in keys.tolist()] or [0], dtype=np.int64)
        self.last = last = np.full(self.size, NEVER, np.int64)  # the least rank of the pairs that a symbol is in
        for k in (self.keys // self.size, self.keys % self.size):
            np.minimum.at(last, k[self.keys >= 0], self.ranks[self.keys >= 0])
        self.words = Pieces(self.encode_words, limit=250_000)

    def _later(self, symbols: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Whether all pairs with the symbols have a higher rank than `ranks`."""
        return self.last[symbols] > ranks

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NEVER where the two don't merge."""
        key = np.where((left < self.size) & (right < self.size), left * self.size + right, -2)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NEVER), self.merged[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and each word's count; by merge rounds over
        all words together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols = self.symbols[points]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, to = np.full(len(symbols), NEVER, np.int32), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            rank[:-1], to[:-1] = self._pairs(symbols[:-1], symbols[1:])
            rank[:-1][word[:-1] != word[1:]] = NEVER
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(symbols)))
            live = np.repeat(best < NEVER, counts)
            if not live.all():  # compaction: finished words leave
                done.append((word[~live], symbols[~live]))
                word, symbols, rank, to = word[live], symbols[live], rank[live], to[live]
                best, counts = best[best < NEVER], counts[best < NEVER]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, counts))
            leftmost = np.concatenate([[True], word[hits[1:]] != word[hits[:-1]]])
            if len(hits) > leftmost.sum():
                # all hits of a word whose merged symbols come later: every other one of a run of neighbours
                apart = np.concatenate([[True], np.diff(hits) > 1]) | leftmost
                run = np.maximum.accumulate(np.where(apart, np.arange(len(hits)), 0))
                later = self._later(to[hits], rank[hits])
                group = np.cumsum(leftmost) - 1
                safe = np.logical_and.reduceat(later, np.flatnonzero(leftmost))[group]
                leftmost |= safe & ((np.arange(len(hits)) - run) % 2 == 0)
            at = hits[leftmost]
            symbols[at] = to[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            word, symbols, rank, to = word[keep], symbols[keep], rank[keep], to[keep]
            at = at - np.arange(len(at))  # one symbol went for each merge before
            for left in (at - 1, at):
                left = left[(left >= 0) & (left < len(symbols) - 1)]
                r, t = self._pairs(symbols[left], symbols[left + 1])
                rank[left], to[left] = np.where(word[left] == word[left + 1], r, NEVER), t
            if len(at) and at[-1] == len(symbols) - 1:
                rank[-1] = NEVER
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word, symbols = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        word, symbols = word[order], symbols[order]
        odd = np.flatnonzero(symbols >= len(self.table))
        if len(odd):  # characters outside the vocabulary become bytes
            own = [self._bytes(s) for s in symbols[odd].tolist()]
            times = np.ones(len(symbols), np.int64)
            times[odd] = list(map(len, own))
            word, symbols, old = np.repeat(word, times), np.repeat(symbols, times), symbols
            symbols[np.repeat(old >= len(self.table), times)] = np.concatenate(own)
        return symbols, np.bincount(word, minlength=len(words))

    def _bytes(self, symbol: int) -> np.ndarray:
        point = self.extra.get(symbol, symbol - FOREIGN)
        return self.byte_ids[np.frombuffer(chr(point).encode(), np.uint8)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's count."""
        return self.words.ids([WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: spaces for "▁", without the one put before the text; bytes that
        are no UTF-8 become U+FFFD each."""
        first = next((k for k, i in enumerate(ids) if i not in self.control), None)
        if first is None:
            return ""
        whole = b"".join(map(self.table.__getitem__, ids))
        try:
            text = whole.decode()
        except UnicodeDecodeError:
            text = self._decode_runs(ids)
        if not self.is_byte[ids[first]] and self.table[ids[first]][:1] == b" " and self.table[ids[first]] != " ⁇ ".encode():
            text = text[1:]
        return text

    def decode_lists(self, lists: pa.ListArray) -> list[str | None]:
        """Texts of lists of ids: the bytes of all pieces are put together at once and cut where the
        lists end; a list that starts with a control piece or holds odd bytes is decoded alone."""
        ends = lists.offsets.to_numpy()
        ids = lists.values.slice(ends[0], ends[-1] - ends[0])
        if ids.null_count or not len(ids):
            return [None if x is None else self.decode(x) for x in lists.to_pylist()]
        ends = ends - ends[0]
        taken = self.bytes.take(ids)
        places = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1, taken.offset * 8)[ends].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        flat = ids.to_numpy()
        heads = flat[np.minimum(ends[:-1], len(flat) - 1)]
        alone = np.isin(heads, list(self.control)).tolist()
        lead, full = self.lead[heads].tolist(), (np.diff(ends) > 0).tolist()
        out = []
        for k, valid in enumerate(lists.is_valid().to_pylist()):
            if not valid or not full[k]:
                out.append("" if valid else None)
                continue
            try:
                text = None if alone[k] else str(data[places[k] : places[k + 1]], "utf-8")
            except UnicodeDecodeError:
                text = None
            if text is None:
                out.append(self.decode(flat[ends[k] : ends[k + 1]].tolist()))
            else:
                out.append(text[1:] if lead[k] else text)
        return out

    def _decode_runs(self, ids: list[int]) -> str:
        out, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.table[i]
                continue
            while run:
                n = 1 if run[0] < 0xC0 else 2 if run[0] < 0xE0 else 3 if run[0] < 0xF0 else 4
                try:
                    out.append(run[:n].decode())
                    run = run[n:]
                except UnicodeDecodeError:
                    out.append("�")
                    run = run[1:]
            if i is not None:
                out.append(self.table[i].decode())
        return "".join(out)


@lru_cache(maxsize=2)
def codec(model: str) -> Codec:
    return Codec(model)


def _place(model: str | None) -> str:
    if model:
        return model
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of each row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        own = codec(_place(model))
        for b in batches:
            for start, end, texts in groups(b.column(1)):
                flat, counts = own.encode(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), list_column(flat, counts)], [key, "ids"])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Adds `decoded`, the text of column `ids` (null ids: null)."""
    ship(encoded.sparkSession)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    at = encoded.columns.index("ids")

    def run(batches):
        own = codec(_place(model))
        for b in batches:
            ids = b.column(at)
            step = max(1, 250_000 // max(1, len(ids.flatten()) // max(1, len(ids))))
            for start in range(0, len(ids), step):
                part = b.slice(start, step)
                texts = own.decode_lists(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
