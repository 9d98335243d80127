"""Record graph: edges between records and entities.

Records: record_id, record_type, date and the ids of documents and entities they name. Nodes
are 'record:<id>' and '<type>:<id>'. Every builder returns source, target, edge_type and
record_ids (sorted, the records that justify the edge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import exprs
from tallyweave.shared import written
from tallyweave.skew import hot_keys

#: Where a caller asks for it (`most`), document ids on more records than this join nothing: they are no ids of one transaction.
FAN_OUT = 20
#: Least and most parts of the rows of hot ids.
PARTS, MOST_PARTS = 8, 1000


def node(kind: str | Column, key: Column) -> Column:
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), key)


def document_ids(records: DataFrame, fields: list[str], *keep: str) -> DataFrame:
    """(record_id, record_type, date, keep..., doc_id) of the different non-blank ids in `fields`, in one namespace."""
    ids = F.array_distinct(F.filter(F.array(*[F.trim(F.col(f)) for f in fields]), lambda x: x.isNotNull() & (x != "")))
    return records.select("record_id", "record_type", "date", *keep, F.explode(ids).alias("doc_id"))


def fan_out(ids: DataFrame) -> DataFrame:
    """Records of each document id."""
    return ids.groupBy("doc_id").agg(F.count_distinct("record_id").alias("n_records"))


def genuine(ids: DataFrame, most: int = FAN_OUT, *keep: str) -> DataFrame:
    """The rows of ids of 2 to `most` records, once each (with each value of `keep`), together by id. Rows are ranked in their id's
    order, and no task passes on more than `most` + 1 records of an id, so an id with very many never
    meets in one task; it shows by its rank that it has too many."""
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("date", F.lit("")), "record_type", "record_id")
    few = ids.withColumn("_k", F.dense_rank().over(order)).where(F.col("_k") <= most + 1).dropDuplicates(["doc_id", "record_id", "_k", *keep])
    own = Window.partitionBy("doc_id")
    sized = few.withColumn("_n", F.size(F.collect_set("record_id").over(own))).withColumn("_most", F.max("_k").over(own))
    return sized.where((F.col("_n") >= 2) & (F.col("_most") <= most)).drop("_k", "_n", "_most")


def by_hotness(ids: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """The rows of ids that a task can hold, those of hot ids (None if there are none), and how many parts the latter ask for."""
    hot = hot_keys(ids.groupBy("doc_id").agg(F.count("*").alias("n")), ["doc_id"])
    if not hot:
        return ids, None, 0
    keys = F.broadcast(ids.sparkSession.createDataFrame([(k,) for k, _ in hot], "doc_id string"))
    return ids.join(keys, "doc_id", "left_anti"), ids.join(keys, "doc_id", "left_semi"), min(MOST_PARTS, max(PARTS, sum(n for _, n in hot)))


def _hot_chain(ids: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """(record_id, next_id) in each id's order, of ids that no task should hold: an id's rows are dealt by ranges of the
    order, and the last row of a range is followed by the first one of the id's next range."""
    place = F.struct(*order)
    rows = ids.distinct().select("doc_id", place.alias("o")).repartitionByRange(parts, "doc_id", "o").withColumn("_part", F.spark_partition_id())
    rows = written(rows, "chain-parts")  # a range stays what it is, however often its rows are read
    several = rows.groupBy("doc_id").agg(F.min("o.record_id").alias("lo"), F.max("o.record_id").alias("hi")).where("lo < hi").select("doc_id")
    rows = rows.join(F.broadcast(several), "doc_id", "left_semi")
    inside = rows.select(F.col("o.record_id").alias("record_id"), F.lead("o.record_id").over(Window.partitionBy("doc_id", "_part").orderBy("o")).alias("next_id"))
    ends = rows.groupBy("doc_id", "_part").agg(F.min("o").alias("lo"), F.max("o").alias("hi"))  # few rows
    between = ends.select(F.col("hi.record_id").alias("record_id"), F.lead("lo.record_id").over(Window.partitionBy("doc_id").orderBy("_part")).alias("next_id"))
    return inside.unionByName(between)


def document_join(ids: DataFrame, most: int | None = FAN_OUT) -> DataFrame:
    """A chain through the records of each document id, by date (null first), type and id: an edge
    between neighbours, not between all pairs. One edge for each pair of records. most: ids of more records
    are left out; None: none are, and hot ids are taken apart into ranges."""
    order = [F.coalesce("date", F.lit("")).alias("date"), F.col("record_type"), F.col("record_id")]
    plain, hot, parts = (genuine(ids, most), None, 0) if most is not None else by_hotness(ids.select("doc_id", "record_id", "record_type", "date"))
    if most is None:
        own, name = Window.partitionBy("doc_id"), F.col("record_id")
        plain = plain.repartition("doc_id").distinct().withColumn("_several", F.min(name).over(own) < F.max(name).over(own)).where("_several")
    chain = plain.select("record_id", F.lead("record_id").over(Window.partitionBy("doc_id").orderBy(*order)).alias("next_id"))
    chain = chain if hot is None else chain.unionByName(_hot_chain(hot, order, parts))
    return chain.where(F.col("next_id").isNotNull()).select(F.col("record_id").alias("source"), F.col("next_id").alias("target")).distinct()


def has_receipt(postings: DataFrame, receipts: DataFrame) -> DataFrame:
    """vendor -> receipt for each posting with the receipt's vendor and document id."""
    keys = ["vendor_id", "doc_id"]
    clean = lambda df, name: df.select(F.trim("vendor_id").alias("vendor_id"), F.trim("doc_id").alias("doc_id"), F.col("record_id").alias(name))
    return clean(postings, "posting_id").join(clean(receipts, "receipt_id"), keys)


def inherited_users(ids: DataFrame, users: DataFrame | None = None, most: int | None = FAN_OUT) -> DataFrame:
    """(record_id, user_id, basis_id): records without a user take the one of their document's
    other records if these name exactly one; basis is the least record that names it.
    users: record_id, user_id (a record's first user); None: `ids` has a column user_id, so that records needn't meet
    their users in a join. most: ids of more records tell nothing; None: all do. What an id's records agree on is worked out where
    they are together already; those of hot ids are summed up in each task and never meet."""
    if users is not None:
        ids = ids.join(users.where(F.col("user_id").isNotNull()).select("record_id", "user_id"), "record_id", "left")
    if most is not None:
        return _told(genuine(ids, most, "user_id"))
    plain, hot, _ = by_hotness(ids.select("doc_id", "record_id", "user_id"))
    told = _told(plain)
    if hot is None:
        return told
    own = hot.groupBy("doc_id", "record_id").agg(F.min("user_id").alias("lo"), F.max("user_id").alias("hi"))
    agreed = own.groupBy("doc_id").agg(F.min("lo").alias("user_id"), F.max("hi").alias("hi"), F.min(F.when(F.col("lo").isNotNull(), F.col("record_id"))).alias("basis_id"))
    agreed = F.broadcast(agreed.where(F.col("user_id") == F.col("hi")).drop("hi"))  # a row for each hot id at the most
    return told.unionByName(own.where(F.col("lo").isNull()).join(agreed, "doc_id").select("record_id", "user_id", "basis_id")).distinct()


def _told(ids: DataFrame) -> DataFrame:
    """What the rows of each id (record_id, user_id) agree on, for those of its records that have no user."""
    own = Window.partitionBy("doc_id")
    basis = F.min(F.when(F.col("user_id").isNotNull(), F.col("record_id"))).over(own)
    has = F.max("user_id").over(Window.partitionBy("doc_id", "record_id"))  # a record may come in several rows
    told = ids.select("record_id", F.min("user_id").over(own).alias("_lo"), F.max("user_id").over(own).alias("_hi"), basis.alias("basis_id"), has.alias("_has"))
    return told.where(F.col("_has").isNull() & (F.col("_lo") == F.col("_hi"))).select("record_id", F.col("_lo").alias("user_id"), "basis_id").distinct()


def references(entities: DataFrame, relationships: DataFrame, kinds: DataFrame) -> DataFrame:
    """record -> entity edges: a relationship label of the record whose value is the entity's id
    and whose expected type is the entity's names the edge; without one it is 'references'.
    entities: record_id, entity_type, entity_id; relationships: record_id, label, value;
    kinds: label, entity_type (a small table)."""
    named = relationships.join(kinds, "label").select("record_id", "entity_type", F.col("value").alias("entity_id"), "label")
    joined = entities.join(named, ["record_id", "entity_type", "entity_id"], "left")
    once = joined.select("record_id", "entity_type", "entity_id", F.coalesce("label", F.lit("references")).alias("edge_type")).distinct()  # where the join has them
    return once.select(
        node("record", F.col("record_id")).alias("source"),
        node(F.col("entity_type"), F.col("entity_id")).alias("target"),
        "edge_type",
        F.array("record_id").alias("record_ids"),
    )


def entity_labels(named: DataFrame) -> DataFrame:
    """(entity_type, entity_id, label): the first non-null label in record_id order."""
    return named.groupBy("entity_type", "entity_id").agg(F.min_by("label", F.when(F.col("label").isNotNull(), F.col("record_id"))).alias("label"))


def induced_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in a group's nodes. edges: source, target, ...; members:
    graph_id, node_id."""
    a = members.select("graph_id", F.col("node_id").alias("source"))
    b = members.select("graph_id", F.col("node_id").alias("target"))
    return edges.join(a, "source").join(b, ["graph_id", "target"])


def degrees(edges: DataFrame, members: DataFrame) -> DataFrame:
    """graph_id, node_id, n_in, n_out inside the group; zeros for nodes without edges."""
    own = induced_edges(edges, members)
    ends = own.select("graph_id", F.col("source").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        own.select("graph_id", F.col("target").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    sums = ends.groupBy("graph_id", "node_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return members.join(sums, ["graph_id", "node_id"], "left").na.fill(0, ["n_in", "n_out"])


def neighbors(edges: DataFrame, nodes: DataFrame, limit: int = 20, edge_type: str | None = None) -> DataFrame:
    """The first `limit` neighbours of each asked node by direction ('in' first), type and id, of one
    edge type if it is given. Both directions are brought to their nodes once; a rank that is the same
    for repeated edges lets each task pass on a node's first ones only."""
    edges = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    side = lambda own, way, other: edges.select(F.col(own).alias("node_id"), F.lit(way).alias("direction"), "edge_type", F.col(other).alias("neighbor"))
    both = side("source", "out", "target").unionByName(side("target", "in", "source"))
    rank = F.dense_rank().over(Window.partitionBy("node_id").orderBy("direction", "edge_type", "neighbor"))
    first = both.withColumn("rank", rank).where(F.col("rank") <= limit).dropDuplicates(["node_id", "rank"])
    return first.join(nodes.select("node_id").distinct(), "node_id", "left_semi")


def distances(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """(start, node_id, length) of the shortest undirected paths of at most `most` edges, by
    frontier joins: each step joins the last frontier and drops what was reached before."""
    from tallyweave.shared import written

    both = written(edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct(), "bfs-edges")
    reached = start.select("start", F.col("start").alias("node_id"), F.lit(0).alias("length"))
    frontier = reached
    for step in range(1, most + 1):
        found = frontier.join(both, frontier["node_id"] == both["source"]).select("start", F.col("target").alias("node_id"), F.lit(step).alias("length")).distinct()
        frontier = written(found.join(reached.select("start", "node_id"), ["start", "node_id"], "left_anti"), "bfs")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def paths(edges: DataFrame, pairs: DataFrame, most: int = 6) -> DataFrame:
    """start, end, length, path: a shortest undirected path for each row of `pairs` (start, end),
    as an array of nodes; of equally short ones the least by its nodes in order. Length and path
    are null where there is none of at most `most` edges (12 at the most); from a node to itself
    the length is 0. Frontier joins from the starts that still have an end to be reached; a node
    keeps one path, so rows grow with the nodes reached, not with the ways to them."""
    from tallyweave.shared import Tables

    tables, kind = Tables(edges.sparkSession), pairs.schema["start"].dataType
    ways = edges.select(F.col("source").alias("node_id"), F.col("target").alias("next"))
    ways = ways.unionByName(ways.select(F.col("next").alias("node_id"), F.col("node_id").alias("next"))).distinct()
    ways = tables.write(ways.where(F.col("node_id") != F.col("next")), "path-edges")
    asked = pairs.where(F.col("start").isNotNull() & F.col("end").isNotNull()).select("start", F.col("end").cast(kind).alias("node_id")).distinct()
    frontier = asked.select("start", F.col("start").alias("node_id"), F.array("start").alias("path")).distinct()
    seen, open_ = frontier, asked
    for step in range(min(most, 12) + 1):
        if step:
            last = frontier.join(open_.select("start").distinct(), "start", "left_semi")
            found = last.join(ways, "node_id").groupBy("start", F.col("next").alias("node_id")).agg(F.min(F.concat("path", F.array("next"))).alias("path"))
            frontier = tables.write(found.join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti"), f"paths-{step}")
            seen = seen.unionByName(frontier)
        open_ = tables.write(open_.join(frontier.select("start", "node_id"), ["start", "node_id"], "left_anti"), f"path-open-{step}")
        if open_.isEmpty() or (step and frontier.isEmpty()):
            break
    known = tables.write(asked.join(seen, ["start", "node_id"]).withColumnRenamed("node_id", "end"), "paths")
    tables.drop(*(name for name in tables.paths if name != "paths"))
    return pairs.select("start", "end").join(known, ["start", "end"], "left").select("start", "end", (F.array_size("path") - 1).alias("length"), "path")


def edge_table(families: list[DataFrame], dossier: str, together: tuple[str, ...] = ()) -> DataFrame:
    """One table of all edge families (source, target, edge_type, record_id): an edge for each of its
    triples, with the sorted records that justify it and an id made of all this. together: columns of
    which every edge has one value only and by which the rows are dealt already, so they aren't shuffled again."""
    rows = families[0]
    for more in families[1:]:
        rows = rows.unionByName(more)
    edges = rows.groupBy(*together, "source", "target", "edge_type").agg(F.array_sort(F.collect_set("record_id")).alias("record_ids")).drop(*together)
    return edges.withColumn("edge_id", exprs.edge_id(dossier, F.col("source"), F.col("target"), F.col("edge_type"), F.col("record_ids")))
