"""Exact ranked search over words by dual-sorted wavelet trees.

Each task deals the documents that it reads into shards. A shard has the lists of all terms that the
queries ask for, each ordered by falling impact (the part of a score that term and document make),
one after another, as a wavelet tree over the documents' places. A node stands for a range of
places; as the tree keeps the order within a node, a list's postings there are a range whose first
one has the highest impact, so the sum of these heads bounds every score below the node. Nodes are
opened best first, many at a time; a leaf is a document and its bound its score. Nothing below the
k-th best score is opened, and that score goes from shard to shard of a task. The best k of each task
and query are ranked together at the end. Places are ordered by length, so that bounds are tight.

Score: the sum over a query's different terms of w * ((10^9 tf) div (1000 tf + 8 m)), w =
floor(1000 ln((2N+2)/(2df+1))), m = 10 + (90 n N) div L, all over the whole table (see `search`).

Terms are runs of ASCII letters and digits and all other non-ASCII characters; A-Z count as a-z.
Null and empty texts have no term. Rows with one doc_id are documents of their own; a null doc_id
comes after all others of its score. Equal scores go by ascending doc_id. A query without a match
has no row; queries with one id are each answered. Queries are worked on in blocks, so that the terms
sent to the tasks stay bounded; documents aren't shuffled at all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import ship
from tallyweave.shared import Tables

#: Queries of one block.
BLOCK = 4096
#: Documents and postings of a shard, about.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1_000_000
#: Nodes that are opened together at least, and the part of all open ones.
TOGETHER, PART = 64, 8
LAST = np.iinfo(np.int64).max

_IN_TERM = [c >= 0x80 or chr(c).isalnum() for c in range(256)]
_TABLE = bytes(ord(chr(c).lower()) if c < 0x80 and _IN_TERM[c] else c if _IN_TERM[c] else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, and the terms that queries ask for with their counts, of each document."""
    for b in batches:
        for at in range(0, b.num_rows, 512):
            some = b.slice(at, 512)
            n, terms, tfs, ends = [], [], [], [0]
            for text in some.column(1):
                own = words(text.as_py())
                n.append(len(own))
                for word, tf in Counter(own).items():
                    if (term := vocabulary.get(word)) is not None:
                        terms.append(term)
                        tfs.append(tf)
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])


class Shard:
    """The lists of some documents. ids: of the documents; counts: postings of each; lengths: what m is
    made from; the postings' terms and impacts follow each other by document."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, counts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, vocabulary: int):
        order = np.lexsort([ids, lengths])
        self.ids = ids[order]
        places = np.empty(len(ids), np.int64)
        places[order] = np.arange(len(ids))
        doc = np.repeat(places, counts)
        by = np.lexsort([doc, -impacts, terms])
        doc, self.impacts = doc[by], impacts[by]
        self.starts = np.searchsorted(terms[by], np.arange(vocabulary + 1))
        self.n, self.depth = len(doc), max(1, int(len(ids) - 1).bit_length())
        # The wavelet matrix: each level's bits as counts of zeros before a place, and the order of its postings.
        self.zeros_before = np.zeros((self.depth, self.n + 1), np.int32)
        self.order = np.zeros((self.depth + 1, self.n), np.int32)
        self.zeros = np.zeros(self.depth, np.int64)
        now = np.arange(self.n, dtype=np.int32)
        self.order[0] = now
        for level in range(self.depth):
            zero = (doc[now] >> (self.depth - 1 - level)) & 1 == 0
            np.cumsum(zero, out=self.zeros_before[level, 1:])
            self.zeros[level] = self.zeros_before[level, -1]
            now = np.concatenate([now[zero], now[~zero]])
            self.order[level + 1] = now
        # The least id of each node; nodes of a level have their places' first bits as their numbers.
        least = np.full(1 << self.depth, LAST, np.int64)
        least[: len(self.ids)] = self.ids
        self.least = [least]
        for _ in range(self.depth):
            self.least.append(self.least[-1].reshape(-1, 2).min(axis=1))
        self.least = np.concatenate(self.least[::-1])  # level l begins at 2^l - 1

    def _bounds(self, level: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The sum of the heads of the lists in each node."""
        heads = self.order.ravel()[level[:, None] * self.n + np.minimum(low, self.n - 1)]
        return np.where(high > low, self.impacts[heads], 0).sum(axis=1)

    def search(self, terms: np.ndarray, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """The best k of (-score, id), ascending, of this shard's documents and those of `best`."""
        low, high = self.starts[terms], self.starts[terms + 1]
        low, high = low[high > low][None], high[high > low][None]
        level, node = np.zeros(1, np.int64), np.zeros(1, np.int64)
        if not low.size:
            return best
        bound = self._bounds(level, low, high)
        while len(bound):
            worst, last = (-best[-1][0], best[-1][1]) if len(best) == k else (0, -1)
            good = (bound > worst) | ((bound == worst) & (self.least[(1 << level) - 1 + node] < last))
            if not good.all():
                level, node, low, high, bound = level[good], node[good], low[good], high[good], bound[good]
                if not len(bound):
                    break
            take = min(len(bound), max(TOGETHER, len(bound) // PART))
            top = np.argpartition(-bound, take - 1)[:take] if take < len(bound) else np.arange(len(bound))
            lev, lo, hi = level[top][:, None], low[top], high[top]
            at = lev * (self.n + 1)
            lo0, hi0 = self.zeros_before.ravel()[at + lo], self.zeros_before.ravel()[at + hi]
            zeros = self.zeros[lev]
            child_low = np.concatenate([lo0, zeros + lo - lo0])
            child_high = np.concatenate([hi0, zeros + hi - hi0])
            child_level = np.tile(level[top] + 1, 2)
            child_node = np.concatenate([2 * node[top], 2 * node[top] + 1])
            child_bound = self._bounds(child_level, child_low, child_high)
            leaf = child_level == self.depth
            found = leaf & (child_bound > 0) & (child_bound >= worst)
            if found.any():
                own = zip((-child_bound[found]).tolist(), self.ids[child_node[found]].tolist(), strict=True)
                best = sorted([*best, *own])[:k]
            rest = np.flatnonzero(~leaf & (child_bound > 0) & (child_bound >= worst))
            stay = np.ones(len(bound), bool)
            stay[top] = False
            level, node, bound = (np.concatenate([a[stay], b[rest]]) for a, b in ((level, child_level), (node, child_node), (bound, child_bound)))
            low, high = np.concatenate([low[stay], child_low[rest]]), np.concatenate([high[stay], child_high[rest]])
        return best


class _Parts:
    """A shard's documents while they are read."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.docs = self.postings = 0

    def add(self, b: pa.RecordBatch) -> None:
        terms, tfs = b.column("terms"), b.column("tfs")
        counts = np.diff(terms.offsets.to_numpy())
        ids = b.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
        self.parts.append((ids, b.column("n").to_numpy(), counts, terms.flatten().to_numpy(), tfs.flatten().to_numpy()))
        self.docs += b.num_rows
        self.postings += int(counts.sum())

    def shard(self, weights: np.ndarray, documents: int, length: int) -> Shard:
        ids, n, counts, terms, tfs = (np.concatenate(x).astype(np.int64) for x in zip(*self.parts, strict=True))
        m = 10 + (90 * n * documents) // length
        impacts = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, counts)))
        return Shard(ids, m, counts, terms, impacts, len(weights))


def _searched(batches: Iterator[pa.RecordBatch], queries: list[tuple[int, np.ndarray]], weights: np.ndarray, documents: int, length: int, k: int) -> Iterator[pa.RecordBatch]:
    best: list[list[tuple[int, int]]] = [[] for _ in queries]

    def take(parts: _Parts) -> None:
        shard = parts.shard(weights, documents, length)
        for q, (_, terms) in enumerate(queries):
            best[q] = shard.search(terms, best[q], k)

    parts = _Parts()
    for b in batches:
        for at in range(0, b.num_rows, 512):
            parts.add(b.slice(at, 512))
            if parts.docs >= SHARD_DOCS or parts.postings >= SHARD_POSTINGS:
                take(parts)
                parts = _Parts()
    if parts.postings:
        take(parts)
    rows = [(q, doc, -score) for (q, _), own in zip(queries, best, strict=True) for score, doc in own]
    q, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
    ids = pa.array([None if x == LAST else x for x in doc], pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), ids, pa.array(score, pa.int64())], ["query", "doc_id", "score"])


def _block(docs: DataFrame, queries: list[tuple[int, list[bytes]]], k: int, tables: Tables) -> DataFrame:
    """The best k of one block of queries (number, terms): query, doc_id, score, of each task."""
    spark = docs.sparkSession
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, own in queries for w in own}))}
    sent = spark.sparkContext.broadcast(vocabulary)  # bounded by BLOCK queries
    name = f"postings-{queries[0][0]}"
    counted = docs.mapInArrow(lambda x: _counted(x, sent.value), "doc_id long, n long, terms array<int>, tfs array<int>")
    postings = tables.write(counted, name)
    total = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    documents, length = int(total[0]), int(total[1])
    df = np.zeros(len(vocabulary), np.int64)  # one number for each term of the block
    for term, n in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], np.int64)
    asked = [(q, np.array([i for w in own if weights[i := vocabulary[w]] > 0], np.int64)) for q, own in queries]
    told = spark.sparkContext.broadcast(asked)
    return postings.mapInArrow(lambda x: _searched(x, told.value, weights, documents, max(1, length), k), "query long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """query_id, rank (from 1), doc_id, score of each query's k best documents with a score above 0."""
    spark = docs.sparkSession
    ship(spark)
    tables = Tables(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = tables.write(queries.select(F.col(query_id).cast("long").alias("id"), F.col(query_text).alias("text"), F.monotonically_increasing_id().alias("query")), "queries")
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    best = None
    for block in range(blocks):
        own = [(r.query, sorted(set(words(r.text)))) for r in asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).orderBy("query").collect()]
        if own:
            part = _block(rows, own, k, tables)
            best = part if best is None else best.unionByName(part)
    if best is None:
        best = spark.createDataFrame([], "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "id"), "query").select(F.col("id").alias(query_id), "rank", "doc_id", "score")
