"""Best-fit packing of documents into sequences of at most CAPACITY tokens.

Documents are cut only if they are longer than a sequence. Pieces are dealt at random into
blocks of bounded size. A block is packed best-fit decreasing and then improved by local
search: pieces of the emptiest sequence are moved, or exchanged one for one or two for one,
into other underfull sequences, each step raising the sum of squared fills, until it is
empty. Sequences that are still not filled are pooled with those of other blocks, dealt anew
and packed again, as long as that saves sequences. A block never has more than about BLOCK
pieces: where pieces don't combine (all of 3,000 tokens), the rounds end with many blocks.

Edge cases: a null or empty text is a piece with only the end id; rows without doc_id are
left out; repeated rows are pieces of their own; an empty table has no sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm import words
from tallyweave.llm.ragged import tidy
from tallyweave.session import ship
from tallyweave.shared import written

CAPACITY = 4096
#: Pieces of a block, and the part of a block's sequences' room that may stay free.
BLOCK, FILLED = 5000, 0.999
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, end: int = 1, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            doc_ids, out = b.column(0).to_pylist(), []
            for row, ids in words.encoded(b, "text", vocabulary, end):
                raw = ids.astype("<u4")
                for k, at in enumerate(range(0, len(raw), capacity)):
                    part = raw[at : at + capacity]
                    out.append((doc_ids[row], k, at, len(part), zlib.crc32(part.tobytes())))
            if out:
                doc, piece, start, length, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return words.documents(docs).mapInArrow(tidy(run), PIECE)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = {}
    mask = 0  # bit f is set if a bin has f free
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = free - n
        if left:
            by_free.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins


def _steps(low: list[int], lengths: list[int]) -> dict[int, list[int]]:
    """One or two items of a bin for each total length that they can have."""
    one = {lengths[i]: [i] for i in low}
    by_length: dict[int, list[int]] = {}
    for i in low:
        by_length.setdefault(lengths[i], []).append(i)
    sizes = sorted(by_length)
    for k, a in enumerate(sizes):
        for b in sizes[k:]:
            if a + b not in one and (a != b or len(by_length[a]) > 1):
                one[a + b] = [by_length[a][0], by_length[b][0 if a != b else 1]]
    return one


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search from the emptiest bin on, until no bin can be emptied or none needs to be.

    A step gives one or two items of the emptiest bin to a fuller one, for one of its items or
    none. As only lengths matter, it is looked up in a table of the most room that any bin
    with an item of a length has (0: no item), not in all pairs of bins."""
    size = np.array(lengths, np.int64)
    bin_of = np.zeros(len(lengths), np.int64)
    for b, items in enumerate(bins):
        bin_of[items] = b
    fill = np.bincount(bin_of, weights=size, minlength=len(bins)).astype(np.int64)
    least = -(-int(fill.sum()) // capacity)
    used, open_ = len(bins), fill < capacity
    for low in np.argsort(fill, kind="stable").tolist():
        if used <= least:
            break
        if not open_[low] or not bins[low]:
            continue
        open_[low] = False
        while bins[low]:
            room = np.where(open_ & (fill >= fill[low]), capacity - fill, 0)
            most = np.zeros(capacity + 1, np.int64)
            most[0] = room.max(initial=0)
            np.maximum.at(most, size, room[bin_of])
            steps = _steps(bins[low], lengths)
            give = np.array(sorted(steps), np.int64)
            best = (0, 0, 0)  # gain, given, taken
            for g in give.tolist():
                take = most[: min(g, capacity + 1)]
                gains = g - np.arange(len(take))
                fits = np.flatnonzero((gains <= take) & ((gains < g) | (len(steps[g]) == 1)))
                if len(fits):
                    best = max(best, (int(gains[fits[0]]), g, int(fits[0])))
            gain, given, taken = best
            if not gain:
                break
            if taken:
                there = np.flatnonzero((size == taken) & (room[bin_of] >= gain))
                j = int(there[np.argmin(room[bin_of[there]])])
                high = int(bin_of[j])
            else:
                there = np.flatnonzero(room >= gain)
                j, high = None, int(there[np.argmin(room[there])])
            items = steps[given]
            bins[low] = [i for i in bins[low] if i not in items] + ([] if j is None else [j])
            bins[high] = [i for i in bins[high] if i != j] + items
            bin_of[items] = high
            if j is not None:
                bin_of[j] = low
            fill[low] -= gain
            fill[high] += gain
            open_[high] = fill[high] < capacity
        used -= not bins[low]
    return [b for b in bins if b]


def pack_block(rows: pd.DataFrame, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, place in the bin and the bin's fill, for each row."""
    lengths = rows.length.tolist()
    bins = improve(best_fit(lengths, capacity), lengths, capacity)
    bin_of, place, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
    for b, items in enumerate(bins):
        at = 0
        for i in items:
            bin_of[i], place[i] = b, at
            at += lengths[i]
        fill[items] = at
    return bin_of, place, fill


def _packer(base: int, blocks: int, capacity: int):
    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row").reset_index(drop=True)
        bins, place, fill = pack_block(rows, capacity)
        return rows.drop(columns="_block").assign(sequence_id=((base + int(key[0])) << 32) + bins, offset=place, fill=fill)

    return block


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `capacity` tokens."""
    spark = pieces.sparkSession
    ship(spark)
    rest = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") == capacity
    columns = [*pieces.columns, "sequence_id", "offset"]
    done = [rest.where(whole).select(*pieces.columns, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = rest.where(~whole)
    schema = T.StructType([*pieces.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_row", "sequence_id", "offset", "fill"))])
    n, base, before = rest.count(), 0, None
    while n:
        blocks = -(-n // BLOCK)
        dealt = rest.withColumn("_block", F.pmod(F.xxhash64("_row", F.lit(base)), F.lit(blocks)))
        packed = written(dealt.groupBy("_block").applyInPandas(_packer(base, blocks, capacity), schema), "packed")
        base += blocks
        filled = F.col("fill") >= FILLED * capacity
        unfilled = packed.where(~filled)
        now = unfilled.agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("bins")).first()
        if blocks == 1 or not now.n or before is not None and now.bins >= before:
            done.append(packed.select(*columns))  # one block, or a round that saved no sequence
            break
        done.append(packed.where(filled).select(*columns))
        rest, n, before = unfilled.select(*pieces.columns, "_row"), now.n, now.bins
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def sequences(docs: DataFrame, packed: DataFrame, end: int = 1, vocabulary: str | None = None) -> DataFrame:
    """(sequence_id, ids array<int>): the packed sequences themselves."""
    ids = words.token_ids(docs, vocabulary, end)
    parts = packed.join(ids, "doc_id").select(
        "sequence_id", "offset", F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))").alias("part")
    )
    merged = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("parts"))

    def run(batches):
        for b in batches:
            lists = [np.frombuffer(b"".join(p["part"] for p in parts), "<u4").astype(np.int32) for parts in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return merged.mapInArrow(tidy(run), "sequence_id long, ids array<int>")
