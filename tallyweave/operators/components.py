"""Connected components of an undirected graph by alternating large and small stars.

Edges that lie together are put together first: each task gives every CHUNK of its edges' nodes the least
node that they reach inside of it. Only nodes of several chunks join these least nodes, and the rounds
run on such joins alone. Where nothing lies together, they are as many as the edges.

Every step is a grouped minimum and a join on the same key, so neither a hub nor a long
path lands in one task as a whole; the published rounds grow with the square of the
logarithm of the graph's size at most. Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.session import ship
from tallyweave.shared import Tables

#: Edges that a task puts together at a time.
CHUNK = 100_000
#: Joined least nodes that may be broadcast.
BROADCAST = 200_000


def _roots(pairs: Iterator[tuple]) -> dict:
    """The least node that each node reaches by these pairs."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of each chunk of (a, b)."""
    held: list[pa.RecordBatch] = []

    def told() -> pa.RecordBatch:
        kind = held[0].schema.field(0).type
        roots = _roots(p for b in held for p in zip(*[c.to_pylist() for c in b.columns], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(list(roots), kind), pa.array(list(roots.values()), kind)], ["node", "root"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield told()
            held = []
    if held:
        yield told()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:  # each node with its smaller neighbours
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", tables: Tables | None = None) -> DataFrame:
    """(node, component) of every node that has an edge to another; a component is named by
    its least node. Loops, repeated edges and edges with a null end add nothing. tables: where the tables
    that the result is read from are known, so that the caller can drop them."""
    ship(edges.sparkSession)
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    pairs = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).where(F.col("a") != F.col("b"))
    kind, tables = pairs.schema["a"].dataType.simpleString(), tables or Tables(edges.sparkSession)
    chunks = pairs.mapInArrow(_chunks, f"node {kind}, root {kind}")
    nodes = tables.write(chunks.groupBy("node").agg(F.array_sort(F.collect_set("root")).alias("roots")), "nodes")
    own = nodes.select("node", F.get("roots", F.lit(0)).alias("root"))
    joins = nodes.where(F.size("roots") > 1).select(F.get("roots", F.lit(0)).alias("b"), F.explode(F.slice("roots", 2, F.size("roots"))).alias("a"))
    now = tables.write(joins.select("a", "b").distinct(), "edges-0")
    told, rounds = None, 0
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == sums or not sums[0]:
            break
        told = sums
        rounds += 1
        now = tables.write(_star(_star(now, large=True), large=False), f"edges-{rounds}")
        tables.drop(f"edges-{rounds - 1}")
    if not sums[0]:
        return own.withColumnRenamed("root", "component")
    least = now.select(F.col("a").alias("root"), F.col("b").alias("component"))
    least = F.broadcast(least) if sums[0] <= BROADCAST else least  # counted above
    return own.join(least, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
