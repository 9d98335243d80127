"""Registered queries about entries: briefs, graph tools, pages and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import exprs, repair
from tallyweave.operators import brief, components, cycles, evidence, graph, processes, profile, rules, store
from tallyweave.plans.catalog import _EDGES, _SHAPES, _VENDORS, _entries, _returned, _vendor_edges
from tallyweave.sources import tables
from tallyweave.sources.tables import SQL as RECORDS
from tallyweave.sources.tables import read

_QUERIES, _SQL = {}, {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_MEMBERS = f"""
WITH RECURSIVE {_EDGES}, r(node, x) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.x), m AS (SELECT node, min(x) AS graph_id FROM r GROUP BY 1)"""


def _members(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    edges = _returned(spark, sf_dir)
    members = components.components(edges).select(F.col("component").alias("graph_id"), F.col("node").alias("node_id"))
    return edges.select(F.col("a").alias("source"), F.col("b").alias("target")), members


@_query(f"{_MEMBERS} SELECT graph_id, a AS source, b AS target FROM e JOIN m ON m.node = e.a")
def G7_subgraph_edges(spark, sf_dir):
    edges, members = _members(spark, sf_dir)
    return graph.induced_edges(edges, members).select("graph_id", "source", "target")


@_query(f"{_MEMBERS} SELECT graph_id, count(*) AS n_nodes, min(node) AS first_node, max(node) AS last_node FROM m GROUP BY 1 ORDER BY 1 LIMIT 50")
def G6_list_process_graphs(spark, sf_dir):
    _, members = _members(spark, sf_dir)
    sums = members.groupBy("graph_id").agg(F.count("*").alias("n_nodes"), F.min("node_id").alias("first_node"), F.max("node_id").alias("last_node"))
    return store.page(sums, ["graph_id"])


@_query(f"""{_MEMBERS}, walk AS (SELECT DISTINCT graph_id AS start, graph_id AS node, [graph_id] AS path FROM m
  UNION ALL SELECT w.start, u.b, list_append(w.path, u.b) FROM walk w JOIN u ON u.a = w.node WHERE len(w.path) <= 6 AND NOT list_contains(w.path, u.b)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY len(path), path) AS n FROM walk)
SELECT graph_id AS start_key, m.node AS end_key, CAST(len(path) - 1 AS INTEGER) AS length, array_to_string(path, ' ') AS path
FROM m LEFT JOIN ranked ON ranked.start = graph_id AND ranked.node = m.node AND n = 1""")
def G10_paths(spark, sf_dir):
    """The way from each group's least order to each of its orders."""
    edges, members = _members(spark, sf_dir)
    found = graph.paths(edges, members.select(F.col("graph_id").alias("start"), F.col("node_id").alias("end")))
    return found.select(F.col("start").alias("start_key"), F.col("end").alias("end_key"), "length", F.array_join("path", " ").alias("path"))


@_query(f"{_MEMBERS} SELECT l_orderkey AS order_key, graph_id, count(*) AS n_lines FROM lineitem JOIN m ON m.node = l_orderkey GROUP BY ALL")
def J5_records_to_graphs(spark, sf_dir):
    _, members = _members(spark, sf_dir)
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node_id"))
    return lines.join(members, "node_id").groupBy(F.col("node_id").alias("order_key"), "graph_id").agg(F.count("*").alias("n_lines"))


_RINGS = """
WITH o AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER w AS next, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
r AS (SELECT CAST(o_custkey AS VARCHAR) AS graph_id, o_orderkey AS source, coalesce(next, first) AS target, next IS NULL AS closes FROM o)"""


def _rings(spark, sf_dir) -> DataFrame:
    """Each customer's orders as a ring: one after another, and the last one before the first."""
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")  # the orders of one customer
    after = F.coalesce(F.lead("o_orderkey").over(own), F.first("o_orderkey").over(own))
    name = lambda c: F.lpad(c.cast("string"), 12, "0")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("graph_id"), name(F.col("o_orderkey")).alias("source"), name(after).alias("target"))
    return rows.withColumn("edge_id", F.concat_ws("-", "source", "target"))


@_query(f"{_RINGS} SELECT graph_id, source, target, closes AS dropped FROM r")
def G5_cycle_breaking(spark, sf_dir):
    cut = cycles.break_cycles(_rings(spark, sf_dir))
    return cut.select("graph_id", F.col("source").cast("long"), F.col("target").cast("long"), "dropped")


_PROCESSES = f"""
WITH {RECORDS}, l AS (SELECT DISTINCT 'record:' || record_id AS node, doc_id, 'vendor:' || vendor_id AS vendor, flag FROM lines), i AS (SELECT 'record:Z' || record_id AS node, doc_id FROM invoices),
n AS (SELECT node, doc_id, NULL AS vendor, NULL AS flag FROM i UNION ALL SELECT * FROM l WHERE doc_id IN (SELECT doc_id FROM i)),
g AS (SELECT doc_id, list_sort(list(DISTINCT substr(node, 8))) AS records, coalesce(list_sort(list(DISTINCT vendor) FILTER (WHERE vendor IS NOT NULL)), []) AS vendors,
  min(node) AS first, count(DISTINCT node) FILTER (WHERE vendor IS NOT NULL) AS n_lines, count(*) FILTER (WHERE flag = 'R') AS n_back, count(DISTINCT vendor) AS n_vendors FROM n GROUP BY 1)"""


def _processes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each order's lines in a chain that ends in its invoice, which pays the lines' vendors; vendors
    lead back to their returned lines, so these orders have cycles."""
    invoices = tables.invoices(spark, sf_dir).select(F.concat(F.lit("record:Z"), "record_id").alias("node_id"), "doc_id", F.lit(None).cast("string").alias("vendor"), F.lit(False).alias("back"), F.lit(True).alias("pays"))
    lines = tables.lines(spark, sf_dir).select(F.concat(F.lit("record:"), "record_id").alias("node_id"), "doc_id", F.concat(F.lit("vendor:"), "vendor_id").alias("vendor"), F.coalesce(F.col("flag") == "R", F.lit(False)).alias("back"), F.lit(False).alias("pays"))
    own = Window.partitionBy("doc_id")
    rows = lines.unionByName(invoices).repartition("doc_id").distinct()  # an order's rows come together once
    rows = rows.withColumn("invoice", F.max(F.when(F.col("pays"), F.col("node_id"))).over(own)).where("invoice IS NOT NULL")
    rows = rows.withColumn("next", F.lead("node_id").over(own.orderBy("node_id"))).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "vendor").orderBy("node_id")))
    edge = lambda test, a, b, kind: F.when(test, F.struct(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(kind).alias("edge_type")))
    some = F.col("vendor").isNotNull()
    edges = F.array(edge(F.col("next").isNotNull(), "node_id", "next", "document_join"), edge(some & (F.col("k") == 1), "invoice", "vendor", "paid_to"), edge(some & F.col("back"), "vendor", "node_id", "has_receipt"))
    edges = rows.select(F.explode(F.array_compact(edges)).alias("e")).select("e.*")
    return rows.select("node_id"), edges.withColumn("edge_id", F.concat_ws("|", "source", "target", "edge_type"))


@_query(f"""{_PROCESSES}, h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('tables|' || array_to_string(records, '|'))) AS x FROM g)
SELECT 'PG-' || left(x, 12) || '5' || substr(x, 14, 3) AS graph_id, array_to_string(records, ' ') AS record_ids, array_to_string(vendors, ' ') AS entity_node_ids, first AS source_node_ids,
  CASE WHEN n_vendors = 0 THEN first ELSE array_to_string(vendors, ' ') END AS sink_node_ids, CAST(len(records) AS BIGINT) AS record_count, n_lines + n_vendors + n_back AS n_edges, len(records) > 4 AS capped, n_back > 0 AS had_cycle FROM h""")
def G4_process_graphs(spark, sf_dir):
    found = processes.process_graphs(*_processes(spark, sf_dir), "tables", cap=4)
    return found.withColumns({c: F.array_join(c, " ") for c in ("record_ids", "entity_node_ids", "source_node_ids", "sink_node_ids")})


_FAMILIES = f"""
WITH {RECORDS}, f AS (
  SELECT 'record:' || record_id AS source, 'vendor:' || vendor_id AS target, 'paid_to' AS edge_type, record_id FROM records WHERE vendor_id IS NOT NULL
  UNION ALL SELECT 'record:' || record_id, 'customer:' || customer_id, 'billed_to', record_id FROM records WHERE customer_id IS NOT NULL
  UNION ALL SELECT 'vendor:' || vendor_id, 'document:' || doc_id, 'documented', record_id FROM records WHERE vendor_id IS NOT NULL)"""


@_query(f"""{_FAMILIES}, e AS (SELECT source, target, edge_type, string_agg(DISTINCT record_id, ',' ORDER BY record_id) AS records FROM f GROUP BY ALL),
h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('tables|' || source || '|' || target || '|' || edge_type || '|' || records)) AS x FROM e)
SELECT left(x, 12) || '5' || substr(x, 14, 3) || substr('89ab', (('0x' || substr(x, 17, 1))::INT & 3) + 1, 1) || substr(x, 18, 15) AS edge_id, source, target, edge_type, records FROM h""")
def G1_edge_table(spark, sf_dir):
    """Records come together with their keys by their order, which their ids and so each of their edges hold: an edge's rows
    are made where they are put together."""
    rows = tables.records(spark, sf_dir).select("record_id", "vendor_id", "customer_id", "doc_id").repartition("doc_id").distinct()
    edge = lambda key, source, target, kind: F.when(F.col(key).isNotNull(), F.struct(source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type")))
    record, vendor = graph.node("record", F.col("record_id")), graph.node("vendor", F.col("vendor_id"))
    families = F.array(
        edge("vendor_id", record, vendor, "paid_to"), edge("customer_id", record, graph.node("customer", F.col("customer_id")), "billed_to"),
        edge("vendor_id", vendor, graph.node("document", F.col("doc_id")), "documented"),
    )
    own = rows.select("doc_id", "record_id", F.explode(families).alias("e")).where("e IS NOT NULL").select("doc_id", "record_id", "e.*")
    edges = graph.edge_table([own], "tables", ("doc_id",))
    return edges.select("edge_id", "source", "target", "edge_type", F.array_join("record_ids", ",").alias("records"))


@_query(f"{_FAMILIES}, n AS (SELECT source AS node_id, record_id FROM f UNION ALL SELECT target, record_id FROM f) SELECT node_id, split_part(node_id, ':', 1) AS node_type, count(DISTINCT record_id) AS n_records FROM n GROUP BY 1")
def G1_node_table(spark, sf_dir):
    """The nodes of the edges of G1_edge_table. Records come together with their keys, not with each end of each edge."""
    rows = tables.records(spark, sf_dir).select("record_id", "vendor_id", "customer_id", "doc_id").repartition("record_id").distinct()
    vendor, customer = F.col("vendor_id").isNotNull(), F.col("customer_id").isNotNull()
    ends = F.array(F.when(vendor | customer, graph.node("record", F.col("record_id"))), graph.node("vendor", F.col("vendor_id")), graph.node("customer", F.col("customer_id")), F.when(vendor, graph.node("document", F.col("doc_id"))))
    once = rows.select("record_id", F.explode(F.array_compact(ends)).alias("node_id")).distinct()
    return once.groupBy("node_id").agg(F.count("record_id").alias("n_records")).select("node_id", F.substring_index("node_id", ":", 1).alias("node_type"), "n_records")


@_query(_VENDORS + f""", rl AS (SELECT 'vendor:' || vendor_id AS node_id, record_id, row_number() OVER (PARTITION BY vendor_id ORDER BY record_id) AS k FROM (SELECT DISTINCT vendor_id, record_id FROM lines))
SELECT node_id, record_id, CAST(k AS INTEGER) AS rank FROM rl WHERE k <= 20""")
def G9_records_for_node(spark, sf_dir):
    rows = tables.lines(spark, sf_dir).select(F.concat(F.lit("vendor:"), "vendor_id").alias("node_id"), "record_id").distinct()
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy("record_id"))  # Spark keeps 20 a task before the shuffle
    return rows.withColumn("rank", rank).where("rank <= 20")


@_query(_VENDORS + """, n AS (SELECT source AS node_id, target, row_number() OVER (PARTITION BY source ORDER BY target) AS k, count(*) OVER (PARTITION BY source) AS n_edges FROM ed WHERE edge_type = 'goods_receipt')
SELECT node_id, n_edges, string_agg(target, '|' ORDER BY target) AS first_edges FROM n WHERE k <= 50 GROUP BY ALL""")
def L11_bounded_edges(spark, sf_dir):
    edges = _vendor_edges(spark, sf_dir).where("edge_type = 'goods_receipt'")
    counts = edges.groupBy(F.col("source").alias("node_id")).agg(F.count("*").alias("n_edges"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("target"))
    few = edges.withColumn("_r", rank).where("_r <= 50").groupBy(F.col("source").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list("target")), "|").alias("first_edges"))
    return counts.join(few, "node_id")


_POINTS = [0.0, 1000.0, 25000.0, 50000.0, 100000.0]


@_query(f"""
WITH {RECORDS}, z AS (SELECT doc_id AS graph_id, coalesce(max(abs(amount)), 0.0) AS score FROM records GROUP BY 1)
SELECT graph_id, score, CAST(len(list_filter([0.0, 1000.0, 25000.0, 50000.0, 100000.0], lambda p: score >= p)) AS INTEGER) AS amount_rank FROM z""")
def A14_amount_rank(spark, sf_dir):
    rows = profile.scores(_entries(spark, sf_dir))
    return rows.select("graph_id", "score", brief.amount_rank(F.col("score"), _POINTS).alias("amount_rank"))


@_query(f"""
WITH {RECORDS}, g AS (SELECT doc_id AS graph_id, list(DISTINCT record_type) AS own, bool_or(vendor_id IS NOT NULL) AS v FROM records GROUP BY 1)
SELECT graph_id, CAST((SELECT count(DISTINCT record_type) FROM records) - len(own) + (NOT v)::INT AS INTEGER) AS absences FROM g""")
def A15_absence_count(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    kinds = entries.agg(F.collect_set("record_type").alias("peers"), F.lit(1).alias("one"))  # a row
    own = entries.groupBy("graph_id").agg(F.collect_set("record_type").alias("own"), F.bool_or(F.col("vendor_id").isNotNull()).alias("v"), F.lit(1).alias("one"))
    return own.join(F.broadcast(kinds), "one").select("graph_id", brief.absence_count(F.col("own"), F.col("peers"), [~F.col("v")]).alias("absences"))


@_query(f"""
WITH {RECORDS} SELECT doc_id AS graph_id, count(*) AS n_evidence, CASE WHEN count(*) >= 3 THEN 'high' WHEN count(*) = 2 THEN 'medium' ELSE 'low' END AS confidence FROM records GROUP BY 1""")
def A16_confidence(spark, sf_dir):
    n = F.count("*")
    return _entries(spark, sf_dir).groupBy("graph_id").agg(n.alias("n_evidence"), F.when(n >= 3, "high").when(n == 2, "medium").otherwise("low").alias("confidence"))


@_query(f"""
WITH {RECORDS}, p AS (SELECT DISTINCT doc_id AS graph_id, 'vendor' AS entity_type, vendor_id AS entity_id FROM records WHERE vendor_id IS NOT NULL
UNION SELECT DISTINCT doc_id, 'customer', customer_id FROM records WHERE customer_id IS NOT NULL),
m AS (SELECT 'vendor' AS entity_type, CAST(s_suppkey AS VARCHAR) AS entity_id, s_name AS label FROM supplier UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name FROM customer)
SELECT graph_id, entity_type, entity_id, label FROM p LEFT JOIN m USING (entity_type, entity_id)""")
def N8_parties(spark, sf_dir):
    return brief.parties(_entries(spark, sf_dir), _masters(spark, sf_dir))


def _masters(spark, sf_dir) -> DataFrame:
    of = lambda t, kind, key, name: read(spark, sf_dir, t).select(F.lit(kind).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), F.col(name).alias("label"))
    return of("supplier", "vendor", "s_suppkey", "s_name").unionByName(of("customer", "customer", "c_custkey", "c_name"))


@_query(f"""
WITH {RECORDS} SELECT doc_id AS graph_id, string_agg(date || ' ' || record_type || ' ' || record_id || ' ' || CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR), chr(10)
  ORDER BY date, record_id, record_type, CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR)) AS timeline FROM records GROUP BY 1""")
def N3_timeline(spark, sf_dir):
    return brief.timeline(_entries(spark, sf_dir))


_WITHIN = "CASE WHEN length({t}) > {n} THEN left({t}, {n} - 6) || ' [...]' ELSE {t} END"
_SECTION = lambda title, t, n: f"'## {title}' || chr(10) || " + _WITHIN.format(t=f"coalesce(nullif({t}, ''), '(none)')", n=n)


@_query(f"""
WITH {RECORDS}, {_SHAPES}, cn AS (SELECT doc_id AS graph_id, count(*) AS n_records FROM records GROUP BY 1),
tl AS (SELECT doc_id AS graph_id, string_agg(date || ' ' || record_type || ' ' || record_id || ' ' || coalesce(CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR), 'n/a'), chr(10)
  ORDER BY date, record_id, record_type, coalesce(CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR), 'n/a')) AS tl FROM records WHERE trim(date) <> '' GROUP BY 1),
p AS (SELECT DISTINCT doc_id AS graph_id, 'vendor' AS entity_type, vendor_id AS entity_id FROM records WHERE vendor_id IS NOT NULL
UNION SELECT DISTINCT doc_id, 'customer', customer_id FROM records WHERE customer_id IS NOT NULL),
m AS (SELECT 'vendor' AS entity_type, CAST(s_suppkey AS VARCHAR) AS entity_id, s_name AS label FROM supplier UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name FROM customer),
wh AS (SELECT graph_id, string_agg(concat_ws(' ', entity_type, entity_id, label), chr(10) ORDER BY concat_ws(' ', entity_type, entity_id, label)) AS who FROM p LEFT JOIN m USING (entity_type, entity_id) GROUP BY 1),
t AS (SELECT graph_id, graph_id || chr(10) || 'shape ' || shape || chr(10) || 'records ' || n_records || chr(10) || 'peers ' || n_entries AS head, tl, who,
  concat_ws(', ', CASE WHEN NOT has_date AND with_date > 0 THEN 'date' END, CASE WHEN NOT has_amount AND with_amount > 0 THEN 'amount' END,
  CASE WHEN NOT has_counterparty AND with_counterparty > 0 THEN 'counterparty' END, CASE WHEN NOT has_document AND with_document > 0 THEN 'document' END) AS lacks
  FROM sh JOIN co USING (graph_id) JOIN sp USING (shape) JOIN cn USING (graph_id) LEFT JOIN tl USING (graph_id) LEFT JOIN wh USING (graph_id))
SELECT graph_id, {_SECTION('Entry', 'head', 800)} || chr(10) || {_SECTION('Timeline', 'tl', 3500)} || chr(10) || {_SECTION('Parties', 'who', 8500)} || chr(10) || {_SECTION('Not present', 'lacks', 900)} AS brief FROM t""")
def N3_entry_briefs(spark, sf_dir):
    return brief.briefs(_entries(spark, sf_dir), _masters(spark, sf_dir))


@_query(f"""
WITH {RECORDS}, t AS (SELECT doc_id AS graph_id, max(abs(amount)) AS score, min(record_id) AS first_record FROM records GROUP BY 1)
SELECT 'large amount' AS title, first_record AS record_id, graph_id FROM t WHERE score > 100000""")
def N9_scored_proposals(spark, sf_dir):
    rows = _entries(spark, sf_dir).groupBy("graph_id").agg(F.max(F.abs("amount")).alias("score"), F.min("record_id").alias("first_record"))

    def scorer(entry: dict) -> list[dict]:  # stands for an outside model
        return [{"title": "large amount", "record_id": entry["first_record"]}] if entry["score"] > 100_000 else []

    found = evidence.scored(rows, scorer, "title string, record_id string")
    known = tables.records(spark, sf_dir).select("record_id", F.col("doc_id").alias("graph_id")).distinct()
    return found.where("error IS NULL").join(known, "record_id").select("title", "record_id", "graph_id")


@_query("SELECT conv_id, turn, role, left(text, 80) AS excerpt FROM conversations ORDER BY conv_id, turn, role, text LIMIT 100")
def L3_preview(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").orderBy("conv_id", "turn", "role", "text").limit(100)
    return rows.select("conv_id", "turn", "role", F.left("text", F.lit(80)).alias("excerpt"))


@_query(f"""
WITH {RECORDS}, s AS (SELECT date, vendor_id, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lines GROUP BY ALL HAVING count(*) >= 2)
SELECT date, vendor_id, n, total FROM s ORDER BY total DESC, date, vendor_id LIMIT 1""")
def L8_best_group(spark, sf_dir):
    sums = tables.lines(spark, sf_dir).groupBy("date", "vendor_id").agg(F.count("*").alias("n"), profile.money_sum("amount").alias("total"))
    return sums.where("n >= 2").orderBy(F.desc("total"), "date", "vendor_id").limit(1)


@_query("""
WITH u AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), t AS (SELECT 'Rolle-U' || user_id || 'x' AS text, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, text, n FROM u JOIN t ON contains(lower(text), 'u' || user_id)""")
def J12_permissions(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    users = events.where("event_type = 'error'").select(F.concat(F.lit("u"), "user_id").alias("user")).distinct()
    rows = events.select(F.col("event_id").alias("perm_id"), F.concat(F.lit("Rolle-U"), "user_id", F.lit("x")).alias("text"))
    return rules.permissions_of(users, rows).groupBy(F.substring("user", 2, 20).cast("long").alias("user_id"), "text").agg(F.count("*").alias("n"))


@_query("SELECT doc_id, text AS repaired, text AS plain, text || '|' || lang || '|' || source AS nested FROM documents")
def F12_mojibake(spark, sf_dir):
    """Texts read in the wrong encoding, alone and inside of structs, lists and maps, and texts as they are,
    with marks or without."""
    docs = read(spark, sf_dir, "documents")
    broken = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    value = F.struct(F.array(broken("text")).alias("a"), F.create_map(broken(F.concat(F.lit("ü"), "lang")), broken("source")).alias("m"))
    rows = docs.select("doc_id", "text", broken("text").alias("broken"), value.alias("value"))
    nested = repair.repaired_value(F.col("value"), rows.schema["value"].dataType)
    rows = rows.select("doc_id", repair.repaired(F.col("broken")).alias("repaired"), repair.repaired(F.col("text")).alias("plain"), nested.alias("n"))
    key = F.get(F.map_keys("n.m"), 0)
    return rows.select("doc_id", "repaired", "plain", F.concat_ws("|", F.get("n.a", 0), F.substring(key, F.lit(2), F.char_length(key)), F.get(F.map_values("n.m"), 0)).alias("nested"))


@_query("""
SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS host, replace(replace(regexp_replace(url, '\\.[^.]*$', ''), '_', ' '), '-', ' ') AS name FROM pages""")
def F15_names_of_urls(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("host"), exprs.dossier_name(F.col("url")).alias("name"))
