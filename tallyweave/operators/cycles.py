"""Cycles in groups of directed edges: which edges go back on the path of a depth-first walk.

A walk starts from a group's nodes in sorted order and follows edges in sorted order; an edge to a
node on the walk's path is dropped. An edge can only be dropped inside a strongly connected part, and
what is dropped there depends on nothing outside but the node by which the walk enters the part.

Groups of up to TASK edges are walked whole, many groups in a task, one after another. A larger
group is taken apart first: rounds of joins trim nodes that are on no cycle, give each node the least
node that reaches it, and find by backward steps from these the parts. Only the parts are walked,
each from its entry: its least node, if no other node that reaches it is less, else the least one
with an edge from outside. That is the whole walk's entry wherever there is only one such node. A
part that is too large for a task itself keeps the edges that go forward by (steps from the entry,
node), which leaves no cycle. Rounds grow with the longest path of a large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.session import ship
from tallyweave.shared import Tables

#: Edges that one task walks.
TASK = 1_000_000
#: Hash values by which groups are counted.
SPOTS = 1 << 14
_OUT = "graph_id string, source string, target string, edge_id string, dropped boolean"
_NAMES = ["graph_id", "source", "target", "edge_id"]


def walked(sources: list, targets: list, first=None) -> list[bool]:
    """Which of the edges (sorted by source, target) the walk drops; `first`: where it starts."""
    after: dict = {}
    for i, s in enumerate(sources):
        after.setdefault(s, []).append(i)
    dropped, on_path = [False] * len(sources), {}  # True while a node is on the path
    starts = sorted(set(sources) | set(targets))
    for start in starts if first is None else [first, *starts]:
        if start in on_path:
            continue
        on_path[start], path = True, [(start, iter(after.get(start, ())))]
        while path:
            here, rest = path[-1]
            i = next(rest, None)
            if i is None:
                on_path[here] = False
                path.pop()
                continue
            to = targets[i]
            if to not in on_path:
                on_path[to] = True
                path.append((to, iter(after.get(to, ()))))
            elif on_path[to]:
                dropped[i] = True
    return dropped


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks the groups of sorted rows: graph_id, source, target, edge_id, part, entry."""
    rows: list[tuple] = []
    out: list[tuple] = []

    def closed() -> None:
        marks = walked([r[1] for r in rows], [r[2] for r in rows], rows[0][5])
        out.extend((*r[:4], m) for r, m in zip(rows, marks, strict=True))

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, pa.bool_() if k == 4 else pa.string()) for k, c in enumerate(zip(*out, strict=True))]
        return pa.RecordBatch.from_arrays(columns, [*_NAMES, "dropped"])

    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if rows and (r[0], r[4]) != (rows[0][0], rows[0][4]):
                closed()
                rows = []
            rows.append(r)
            if len(out) >= 20_000:
                yield batch()
                out = []
    if rows:
        closed()
    if out:
        yield batch()


def _walked(edges: DataFrame) -> DataFrame:
    """edges: graph_id, source, target, edge_id, part, entry."""
    ordered = edges.repartition("graph_id", "part").sortWithinPartitions("graph_id", "part", "source", "target", "edge_id")
    return ordered.select(*_NAMES, "part", "entry").mapInArrow(_walks, _OUT)


def _rounds(now: DataFrame, step, tables: Tables, name: str) -> DataFrame:
    """Repeats a step until its table stays the same (told by its row count and hashes)."""
    told, k = None, 0
    now = tables.write(now, f"{name}-0")
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64(*now.columns).cast("decimal(38,0)"))).first()
        if sums == told:
            return now
        told, k = sums, k + 1
        now = tables.write(step(now), f"{name}-{k}")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without the edges of nodes that nothing leads to or from."""
    ins, outs = edges.select("g", F.col("t").alias("s")).distinct(), edges.select("g", F.col("s").alias("t")).distinct()
    return edges.join(ins, ["g", "s"], "left_semi").join(outs, ["g", "t"], "left_semi").select("g", "s", "t")


def least_before(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(g, v, c): the least node that reaches each node, itself counted."""
    nodes = edges.select("g", F.col("s").alias("v")).unionByName(edges.select("g", F.col("t").alias("v"))).distinct()

    def step(now: DataFrame) -> DataFrame:
        come = edges.join(now.withColumnRenamed("v", "s"), ["g", "s"]).select("g", F.col("t").alias("v"), "c")
        return now.unionByName(come).groupBy("g", "v").agg(F.min("c").alias("c"))

    return _rounds(nodes.withColumn("c", F.col("v")), step, tables, name)


def strong_parts(edges: DataFrame, tables: Tables) -> DataFrame:
    """(g, v, part) of the nodes on cycles; a part is named by its least node. edges: g, s, t."""
    parts, k = None, 0
    left = _rounds(edges.where("s <> t").select("g", "s", "t").distinct(), _trimmed, tables, "trim-0")
    while not left.isEmpty():
        color = least_before(left, tables, f"color-{k}")
        inner = left.join(color.select("g", F.col("v").alias("s"), "c"), ["g", "s"]).join(color.select("g", F.col("v").alias("t"), "c"), ["g", "t", "c"])
        inner = tables.write(inner, f"inner-{k}")

        def back(now: DataFrame, inner=inner) -> DataFrame:
            come = inner.join(now.withColumnRenamed("v", "t"), ["g", "c", "t"]).select("g", "c", F.col("s").alias("v"))
            return now.unionByName(come).distinct()

        found = _rounds(color.where("v = c").select("g", "c", "v"), back, tables, f"back-{k}")
        whole = found.join(found.groupBy("g", "c").count().where("count > 1").select("g", "c"), ["g", "c"], "left_semi").select("g", "v", F.col("c").alias("part"))
        parts = whole if parts is None else parts.unionByName(whole)
        done, k = found.select("g", "v"), k + 1
        rest = left.join(done.withColumnRenamed("v", "s"), ["g", "s"], "left_anti").join(done.withColumnRenamed("v", "t"), ["g", "t"], "left_anti")
        left = _rounds(rest.select("g", "s", "t"), _trimmed, tables, f"trim-{k}")
    return parts if parts is not None else edges.select("g", F.col("s").alias("v"), F.col("s").alias("part")).limit(0)


def _steps(edges: DataFrame, tables: Tables) -> DataFrame:
    """(g, part, v, n): steps from the entry inside of a part. edges: g, part, entry, s, t."""
    start = edges.select("g", "part", F.col("entry").alias("v"), F.lit(0).alias("n")).distinct()

    def step(now: DataFrame) -> DataFrame:
        come = edges.join(now.withColumnRenamed("v", "s"), ["g", "part", "s"]).select("g", "part", F.col("t").alias("v"), (F.col("n") + 1).alias("n"))
        return now.unionByName(come).groupBy("g", "part", "v").agg(F.min("n").alias("n"))

    return _rounds(start, step, tables, "steps")


def _taken_apart(edges: DataFrame, task: int) -> DataFrame:
    """The large groups: only their strongly connected parts are walked."""
    tables = Tables(edges.sparkSession)
    edges = tables.write(edges, "large")
    light = edges.select(F.col("graph_id").alias("g"), F.col("source").alias("s"), F.col("target").alias("t")).distinct()
    parts = tables.write(strong_parts(light, tables), "parts")
    ends = lambda own, at: parts.select(F.col("g").alias("graph_id"), F.col("v").alias(at), F.col("part").alias(own))
    both = edges.join(ends("_p", "source"), ["graph_id", "source"], "left").join(ends("part", "target"), ["graph_id", "target"], "left")
    both = tables.write(both, "with-parts")
    entered = both.where(F.col("part").isNotNull() & ~F.equal_null("_p", "part")).groupBy("graph_id", "part").agg(F.min("target").alias("_outer"))
    before = least_before(light, tables, "before").where("v IS NOT NULL").join(parts, ["g", "v"]).groupBy(F.col("g").alias("graph_id"), "part").agg(F.min("c").alias("_before"))
    entries = before.join(entered, ["graph_id", "part"], "left")
    entries = entries.select("graph_id", "part", F.when(F.col("_before") < F.col("part"), F.col("_outer")).otherwise(F.col("part")).alias("entry"))
    inner = tables.write(both.where(F.equal_null("_p", "part") & F.col("part").isNotNull() & (F.col("source") != F.col("target"))).join(entries, ["graph_id", "part"]), "inner")
    others = both.where(~F.equal_null("_p", "part") | F.col("part").isNull() | (F.col("source") == F.col("target")))
    out = others.select(*_NAMES, (F.col("source") == F.col("target")).alias("dropped"))
    sizes = inner.groupBy("graph_id", "part").agg(F.count("*").alias("_n"))
    out = out.unionByName(_walked(inner.join(sizes.where(F.col("_n") <= task), ["graph_id", "part"], "left_semi")))
    huge = inner.join(sizes.where(F.col("_n") > task), ["graph_id", "part"], "left_semi")
    if not huge.isEmpty():
        steps = _steps(huge.select(F.col("graph_id").alias("g"), "part", "entry", F.col("source").alias("s"), F.col("target").alias("t")), tables)
        at = lambda end, n: steps.select(F.col("g").alias("graph_id"), "part", F.col("v").alias(end), F.col("n").alias(n))
        told = huge.join(at("source", "_a"), ["graph_id", "part", "source"]).join(at("target", "_b"), ["graph_id", "part", "target"])
        out = out.unionByName(told.select(*_NAMES, (F.struct("_b", "target") <= F.struct("_a", "source")).alias("dropped")))
    return out


def large_groups(edges: DataFrame, key: str, most: int) -> DataFrame | None:
    """The groups of more than `most` edges (one column), None if there are none. Groups are counted by a few hash values first, and
    one by one only where so many edges share a value."""
    spot = F.pmod(F.xxhash64(key), F.lit(SPOTS))
    full = [r[0] for r in edges.groupBy(spot.alias("_s")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("_s").collect()]  # SPOTS rows at the most
    if not full:
        return None
    large = edges.where(spot.isin(full) if len(full) < SPOTS // 16 else F.lit(True)).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key)
    return None if large.isEmpty() else large


def break_cycles(edges: DataFrame, task: int = TASK) -> DataFrame:
    """graph_id, source, target, edge_id, dropped of every edge, as text; without those dropped no
    group has a cycle. See the module's text for the order that decides."""
    ship(edges.sparkSession)
    edges = edges.select(*[F.col(c).cast("string").alias(c) for c in _NAMES])
    large = large_groups(edges, "graph_id", task)
    whole = lambda rows: _walked(rows.select(*_NAMES, F.lit(0).alias("part"), F.lit(None).cast("string").alias("entry")))
    if large is None:
        return whole(edges)
    return whole(edges.join(large, "graph_id", "left_anti")).unionByName(_taken_apart(edges.join(large, "graph_id", "left_semi"), task))
