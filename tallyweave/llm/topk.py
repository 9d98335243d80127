"""Exact top-k inner product search: columnar branch and bound.

Queries and candidates are dealt into a grid of blocks of bounded size; each cell of the
grid is searched on its own, and the best k of all cells are kept for each query. In a
cell the candidates lie in vertical layout (one row of the matrix for each dimension).
Scores are summed up dimension block by dimension block; after each block, candidates
whose score so far plus the most that the remaining dimensions can add (the product of
the remaining norms) is below the k-th best score known are compacted away.

Edge cases: vectors that are null, or hold nulls or components that aren't finite, take
no part; missing dimensions of shorter vectors count as zeros; an empty vector scores 0
with every other; a row is never its own candidate, but other rows with its vec_id are. A
vec_id that is given several times is a query for each of its rows, each with ranks of its
own; rows without vec_id take no part. Columns of any other name don't matter.
Scores are exact as long as they fit a signed 64-bit integer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import ship
from tallyweave.shared import written

DIM_BLOCK = 16
CANDIDATES = 16_384
QUERIES = 4_096
OUT = "query_row long, query_id long, vec_id long, score long, row long"


def usable(vector: Column) -> Column:
    """Not null, without nulls, NaN or infinities."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def scaled(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    """Dimensions x vectors, short vectors filled up with zeros."""
    out = np.zeros((dims, len(vectors)), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[: len(v), i] = v
    return out


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of `rows` for each of `queries` (columns row, vec_id, v); ties to smaller ids."""
    if not len(queries) or not len(rows):
        return pd.DataFrame({c.split()[0]: [] for c in OUT.split(", ")}, dtype="int64")
    dims = max(max(map(len, queries.v)), max(map(len, rows.v)), 1)
    q, c = _matrix(queries.v, dims), _matrix(rows.v, dims)
    ids, names = rows.vec_id.to_numpy(np.int64), rows.row.to_numpy(np.int64)
    norms = np.sqrt((c.astype(np.float64) ** 2).sum(0))
    order = np.lexsort((ids, -norms))  # long vectors first: they tend to raise the k-th best early
    c, ids, names = np.ascontiguousarray(c[:, order]), ids[order], names[order]
    exact = float(np.abs(q).max()) * float(np.abs(c).max()) * dims < 2**53
    work = np.float64 if exact else np.int64  # doubles hold these sums exactly, and are faster
    q, c = q.astype(work), c.astype(work)
    starts = list(range(0, dims, DIM_BLOCK))
    left = lambda m: np.sqrt(np.cumsum((m.astype(np.float64) ** 2)[::-1], axis=0)[::-1])
    q_left, c_left = left(q), left(c)
    first = min(len(ids), max(256, 4 * k))
    found = []
    for j, (own, query) in enumerate(zip(queries.row.to_numpy(np.int64), queries.vec_id.to_numpy(np.int64), strict=True)):
        head = q[:, j] @ c[:, :first]
        head = head[names[:first] != own]
        floor = np.partition(head, len(head) - k)[len(head) - k] if len(head) >= k else None
        live, score = np.flatnonzero(names != own), None
        for s in starts:
            e = min(s + DIM_BLOCK, dims)
            block = c[s:e] if len(live) == c.shape[1] else c[s:e][:, live]
            part = q[s:e, j] @ block
            score = part if score is None else score + part
            if e < dims and floor is not None:
                most = score + q_left[e, j] * c_left[e, live] * (1 + 1e-9) + 1
                keep = np.flatnonzero(most >= floor)
                if len(keep) < len(live):
                    live, score = live[keep], score[keep]
                if len(score) > 4 * k and e > s:  # the k-th best of lower bounds
                    low = score - q_left[e, j] * c_left[e, live] * (1 + 1e-9) - 1
                    floor = max(floor, np.partition(low, len(low) - k)[len(low) - k])
        best = np.lexsort((names[live], ids[live], -score))[:k]
        found.append(pd.DataFrame({"query_row": own, "query_id": query, "vec_id": ids[live][best], "score": score[best].astype(np.int64), "row": names[live][best]}))
    return pd.concat(found, ignore_index=True)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest integer inner product for
    each row of `vectors` (vec_id, embedding) that `is_query` selects, against all others."""
    ship(vectors.sparkSession)
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v"), is_query.alias("is_query")
    )
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")  # written, so that a row keeps its number
    n = rows.agg(F.count("*"), F.count_if("is_query")).first()
    across, down = max(1, -(-n[0] // CANDIDATES)), max(1, -(-n[1] // QUERIES))
    block = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("row", "vec_id", "v", block(across, 1).alias("a"), each(down).alias("d"))
    queries = rows.where("is_query").select("row", "vec_id", "v", block(down, 2).alias("d"), each(across).alias("a"))

    def cell(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return search_block(left, right, k)

    best = queries.groupBy("a", "d").cogroup(candidates.groupBy("a", "d")).applyInPandas(cell, OUT)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
