"""Process graphs: the records that documents join, with their entities, sources and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import exprs
from tallyweave.operators.components import components
from tallyweave.operators.cycles import TASK, break_cycles, large_groups, walked
from tallyweave.session import ship
from tallyweave.shared import Tables

#: More records than this flag a graph as capped; it stays whole.
CAP = 200


def members(records: DataFrame, edges: DataFrame, join_type: str = "document_join", tables: Tables | None = None) -> DataFrame:
    """(cluster, node_id, is_record): each record is in the cluster of the records that edges of
    `join_type` join it to (its least node names it), alone if there are none; the other nodes that an
    edge of its records has are in it too. records: node_id; edges: source, target, edge_type."""
    joins = edges.where(F.col("edge_type") == join_type).select(F.col("source").alias("a"), F.col("target").alias("b"))
    clusters = components(joins, tables=tables).select(F.col("node").alias("node_id"), F.col("component").alias("cluster"))
    return records.select("node_id").distinct().join(clusters, "node_id", "left").select(F.coalesce("cluster", "node_id").alias("cluster"), "node_id")


def own_edges(records: DataFrame, edges: DataFrame, join_type: str = "document_join", tables: Tables | None = None) -> DataFrame:
    """The edges of each cluster (cluster, source, target, edge_type, edge_id), written once. An edge has a
    record ('record:...') at one end at least and belongs to the cluster of its records. It is looked up
    by one record; by the other one too only where the clusters of both may differ, that is if it doesn't
    join them. No edge is brought to an entity. records: cluster, node_id."""
    at = lambda end, name: records.select(F.col("node_id").alias(end), F.col("cluster").alias(name))
    record = lambda end: F.coalesce(F.startswith(end, F.lit("record:")), F.lit(False))
    own = edges.withColumn("_near", F.when(record("source"), F.col("source")).otherwise(F.col("target"))).join(at("_near", "_a"), "_near", "left")
    two = record("source") & record("target") & (F.col("_a").isNull() | (F.col("edge_type") != join_type))
    own = own.where(two | F.col("_a").isNotNull()).select(F.col("_a").alias("cluster"), "source", "target", "edge_type", "edge_id", two.alias("two"))
    own = (tables or Tables(edges.sparkSession)).write(own, "own-edges")
    sure, open_ = own.where("NOT two").drop("two"), own.where("two").drop("two")
    if open_.isEmpty():
        return sure
    both = open_.join(at("target", "_b"), "target", "left").where(F.coalesce("cluster", "_b").isNotNull() & F.coalesce(F.col("cluster") == F.col("_b"), F.lit(True)))
    return sure.unionByName(both.withColumn("cluster", F.coalesce("cluster", "_b")).drop("_b"))


def _parts(records: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, Tables]:
    """`members` and `own_edges`, written; what they were made from is dropped."""
    tables, joins = Tables(edges.sparkSession), Tables(edges.sparkSession)
    clusters = tables.write(members(records, edges, tables=joins), "clusters")
    joins.drop(*joins.paths)
    own = own_edges(clusters, edges, tables=tables)
    tables.drop()  # its shuffles
    return clusters, own, tables


def process_nodes(records: DataFrame, edges: DataFrame, task: int = TASK) -> tuple[DataFrame, DataFrame]:
    """(cluster, node_id, is_record, is_source, is_sink) of all nodes, and (cluster, source, target,
    edge_id, dropped) of all edges. Sources and sinks are those after cycles are broken."""
    clusters, own, tables = _parts(records, edges)
    return _nodes(clusters, own, task, tables)


def _nodes(clusters: DataFrame, own: DataFrame, task: int, tables: Tables, together: bool = False) -> tuple[DataFrame, DataFrame]:
    """As process_nodes. together: the nodes of a cluster come in one task, for those who put them together anyway."""
    cut = tables.write(break_cycles(own.withColumnRenamed("cluster", "graph_id"), task), "cut-edges").withColumnRenamed("graph_id", "cluster")
    ends = F.explode(F.array(F.struct(F.col("source").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    kept = F.when(F.col("dropped"), 0).otherwise(1)
    seen = cut.select("cluster", kept.alias("k"), ends.alias("e")).select("cluster", F.col("e.n").alias("node_id"), (F.col("e.o") * F.col("k")).alias("o"), (F.col("e.i") * F.col("k")).alias("i"), F.lit(False).alias("r"))
    own = clusters.select("cluster", "node_id", F.lit(0).alias("o"), F.lit(0).alias("i"), F.lit(True).alias("r"))
    rows = seen.unionByName(own)
    rows = rows.repartition("cluster") if together else rows
    sums = rows.groupBy("cluster", "node_id").agg(F.bool_or("r").alias("is_record"), (F.sum("i") == 0).alias("is_source"), (F.sum("o") == 0).alias("is_sink"))
    return sums, cut


_GRAPH = "record_ids array<string>, entity_node_ids array<string>, source_node_ids array<string>, sink_node_ids array<string>, record_count bigint, n_edges bigint, had_cycle boolean"
#: Rows of clusters that are given on at once.
ROWS = 20_000


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each cluster of sorted rows: cluster, is_record, source, target; of a record only source is told."""
    kinds = [*[pa.list_(pa.string())] * 4, pa.int64(), pa.int64(), pa.bool_()]
    names = [c.split()[0] for c in _GRAPH.split(", ")]
    out: list[tuple] = []
    own: list[str] = []  # of one cluster: records, then edges by source and target
    sources: list[str] = []
    targets: list[str] = []

    def closed() -> None:
        nodes, marks = set(own), walked(sources, targets)
        leads = {s for s, m in zip(sources, marks, strict=True) if not m}
        led = {t for t, m in zip(targets, marks, strict=True) if not m}
        every = nodes.union(sources, targets)
        records = sorted(n[n.find(":") + 1 :] for n in nodes)
        out.append((records, sorted(every - nodes), sorted(every - led), sorted(every - leads), len(nodes), len(sources), any(marks)))

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    now, n = None, 0
    for b in batches:
        for cluster, is_record, source, target in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if cluster != now:
                if now is not None:
                    closed()
                if n >= ROWS:
                    yield batch()
                    out, n = [], 0
                now, own, sources, targets = cluster, [], [], []
            n += 1
            if is_record:
                own.append(source)
            else:
                sources.append(source)
                targets.append(target)
    if now is not None:
        closed()
    if out:
        yield batch()


def process_graphs(records: DataFrame, edges: DataFrame, dossier: str, cap: int = CAP, task: int = TASK) -> DataFrame:
    """graph_id, record_ids, entity_node_ids, source_node_ids, sink_node_ids (sorted arrays), record_count,
    n_edges, capped, had_cycle. Node ids of records are 'record:' and the record's id. An array is as
    long as its graph; `process_nodes` has the same as rows. Clusters of up to `task` edges are put together where they are walked."""
    ship(edges.sparkSession)
    clusters, own, tables = _parts(records, edges.withColumn("edge_id", F.lit("")))  # edges are only counted
    large = large_groups(own, "cluster", task)
    pick = lambda rows, how: rows if large is None else rows.join(large, "cluster", how)
    rows = pick(own, "left_anti").select("cluster", F.lit(False).alias("is_record"), "source", "target")
    rows = rows.unionByName(pick(clusters, "left_anti").select("cluster", F.lit(True).alias("is_record"), F.col("node_id").alias("source"), F.lit(None).cast("string").alias("target")))
    rows = rows.repartition("cluster").sortWithinPartitions("cluster", "is_record", "source", "target")
    out = rows.mapInArrow(_graphs, _GRAPH)
    if large is not None:
        out = out.unionByName(_large_graphs(pick(clusters, "left_semi"), pick(own, "left_semi"), task, tables))
    key = F.concat(F.lit(f"{dossier}|"), F.array_join("record_ids", "|"))
    name = F.concat(F.lit("PG-"), F.left(F.replace(exprs.uuid5(key, uuid.NAMESPACE_URL.hex), F.lit("-"), F.lit("")), F.lit(16)))
    return out.select(
        name.alias("graph_id"), "record_ids", "entity_node_ids", "source_node_ids", "sink_node_ids", "record_count", "n_edges", (F.col("record_count") > cap).alias("capped"), "had_cycle",
    )


def _large_graphs(clusters: DataFrame, own: DataFrame, task: int, tables: Tables) -> DataFrame:
    """As _GRAPH says, of clusters that no task walks whole."""
    nodes, cut = _nodes(clusters, own, task, tables, together=True)
    some = lambda test, value=F.col("node_id"): F.array_sort(F.collect_list(F.when(test, value)))
    record = F.expr("substr(node_id, instr(node_id, ':') + 1)")
    told = nodes.groupBy("cluster").agg(
        some(F.col("is_record"), record).alias("record_ids"), some(~F.col("is_record")).alias("entity_node_ids"),
        some(F.col("is_source")).alias("source_node_ids"), some(F.col("is_sink")).alias("sink_node_ids"), F.count_if("is_record").alias("record_count"),
    )
    sums = cut.groupBy("cluster").agg(F.count("*").alias("n_edges"), F.bool_or("dropped").alias("had_cycle"))
    return told.join(sums, "cluster").drop("cluster")
