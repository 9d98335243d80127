"""Registered queries of the main library, each next to its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import exprs
from tallyweave.operators import components as cc
from tallyweave.operators import evidence, graph, profile, rules, store
from tallyweave.sources import tables
from tallyweave.sources.tables import SQL as RECORDS
from tallyweave.sources.tables import read

FLAGSHIP = "N2_ranked_entries"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Sources and projections


@_query(f"WITH {RECORDS} SELECT record_type, count(*) AS n, count(DISTINCT record_id) AS n_ids FROM records GROUP BY 1")
def U1_union_records(spark, sf_dir):
    return tables.records(spark, sf_dir).groupBy("record_type").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("n_ids"))


_KIND = [("gear", "maintenance"), ("ring", "asset"), ("bolt", "asset"), ("hot", "supply")]


@_query("""
SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%gear%' THEN 'maintenance' WHEN lower(p_name) LIKE '%ring%' THEN 'asset'
  WHEN lower(p_name) LIKE '%bolt%' THEN 'asset' WHEN lower(p_name) LIKE '%hot%' THEN 'supply' ELSE 'master_data' END AS kind FROM part""")
def P3_first_pattern(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", exprs.first_match(F.col("p_name"), _KIND, "master_data").alias("kind"))


@_query("""
SELECT page_id, CASE lower(regexp_extract(url, '(\\.[^./]+)$', 1)) WHEN '.html' THEN 'text/html' WHEN '.net' THEN 'x/net' ELSE 'application/octet-stream' END AS mime FROM pages""")
def P2_mime_type(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", exprs.mime_type(F.col("url"), {".html": "text/html", ".net": "x/net"}).alias("mime"))


@_query("""
SELECT doc_id, length(trim(text)) > 0 AS filled, length(text) - length(replace(text, ',', '')) AS commas FROM documents""")
def P10_non_empty(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    commas = F.char_length("text") - F.char_length(F.replace("text", F.lit(","), F.lit("")))
    return docs.select("doc_id", exprs.non_empty(F.col("text")).alias("filled"), commas.cast("long").alias("commas"))


@_query("SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '7')")
def P15_search_box(spark, sf_dir):
    return read(spark, sf_dir, "supplier").where(F.contains(F.lower("s_name"), F.lit("7"))).select("s_suppkey", "s_name")


@_query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(value, 0.0) AS first_value FROM events""")
def P7_first_non_null(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce("value", F.lit(0.0)).alias("first_value"))


@_query("""
WITH c AS (SELECT conv_id, turn, length(text) AS n, len(string_split(text, ' ')) AS words FROM conversations)
SELECT conv_id, min(turn) AS header_turn FROM c WHERE words >= 2 GROUP BY conv_id""")
def P12_header_row(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumn("words", F.size(F.split("text", " ")))
    return rows.where(F.col("words") >= 2).groupBy("conv_id").agg(F.min("turn").alias("header_turn"))


# Scalar functions


@_query("""
WITH t AS (SELECT o_orderkey, replace(printf('%,.2f', o_totalprice), ',', '_') AS u FROM orders),
g AS (SELECT o_orderkey, replace(replace(replace(u, '.', ';'), '_', '.'), ';', ',') AS text FROM t)
SELECT o_orderkey, text, CAST(replace(replace(text, '.', ''), ',', '.') AS DOUBLE) AS number, CAST(replace(replace(text, '.', ''), ',', '.') AS DOUBLE) AS loose FROM g""")
def F1_german_decimal(spark, sf_dir):
    text = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", "text", exprs.german_decimal(F.col("text")).alias("number"), exprs.loose_float(F.col("text")).alias("loose"))


@_query("""
SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(text, '([A-Z][a-z]{8,9})', 1)), '') IS NOT NULL AS seen,
  CAST(len(list_distinct(regexp_extract_all(text, '([A-Z][a-z]{8,9})', 1))) AS INTEGER) AS n_ids FROM documents""")
def F6_ids_in_text(spark, sf_dir):
    ids = exprs.user_ids(F.col("text"), r"([A-Z][a-z]{8,9})")
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(ids, "").isNotNull().alias("seen"), F.size(ids).alias("n_ids"))


@_query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m') AS period,
  strftime(o_orderdate, '%Y-%m') = '1995-12' OR contains(strftime(o_orderdate, '%Y-%m-%d'), '1996-01') AS around FROM orders""")
def D1_german_dates(spark, sf_dir):
    text = F.date_format("o_orderdate", "dd.MM.yyyy")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", exprs.strict_date(text).alias("iso"))
    around = (exprs.period(F.col("iso")) == "1995-12") | F.contains("iso", F.lit("1996-01"))
    return rows.select("o_orderkey", "iso", exprs.period(F.col("iso")).alias("period"), around.alias("around"))


@_query("""
WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('customer:' || c_custkey)) AS h FROM customer)
SELECT c_custkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab89ab89ab89ab', CAST(strpos('0123456789abcdef', h[17:17]) AS INTEGER), 1)
  || h[18:20] || '-' || h[21:32] AS id FROM h""")
def D6_uuid5(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", exprs.uuid5(F.concat(F.lit("customer:"), "c_custkey")).alias("id"))


@_query("SELECT doc_id, sha256(text) AS digest FROM documents")
def D5_sha256(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@_query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, ';|,')) AS with_mark FROM l GROUP BY 1""")
def F19_split_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("line").rlike("[;,]")).alias("with_mark"))


@_query("""
SELECT s_suppkey, CASE WHEN s_acctbal IS NULL THEN 'n/a' ELSE CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS text, upper(s_name) AS upper_name,
  CASE WHEN length(s_name) > 12 THEN left(s_name, 12) || '...' ELSE s_name END AS cut FROM supplier""")
def F13_money_and_budget(spark, sf_dir):
    cut = F.when(F.char_length("s_name") > 12, F.concat(F.left("s_name", F.lit(12)), F.lit("..."))).otherwise(F.col("s_name"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", exprs.money(F.col("s_acctbal")).alias("text"), F.upper("s_name").alias("upper_name"), cut.alias("cut"))


# Joins and edges

_CHAIN = f"""
WITH {RECORDS}, ids AS (
  SELECT DISTINCT record_id, record_type, date, doc_id FROM records WHERE trim(doc_id) <> ''
  UNION SELECT DISTINCT record_id, record_type, date, 'p' || part_id FROM records WHERE trim(part_id) <> ''
), ok AS (SELECT doc_id FROM ids GROUP BY doc_id HAVING count(DISTINCT record_id) BETWEEN 2 AND 20), k AS (SELECT ids.* FROM ids JOIN ok USING (doc_id))
"""
#: The same with ids of any number of records.
_WHOLE_CHAIN = f"""
WITH {RECORDS}, ids AS (
  SELECT DISTINCT record_id, record_type, date, doc_id FROM records WHERE trim(doc_id) <> ''
  UNION SELECT DISTINCT record_id, record_type, date, 'p' || part_id FROM records WHERE trim(part_id) <> ''
), ok AS (SELECT doc_id FROM ids GROUP BY doc_id HAVING count(DISTINCT record_id) >= 2), k AS (SELECT ids.* FROM ids JOIN ok USING (doc_id))
"""


def _ids(spark, sf_dir, *keep: str) -> DataFrame:
    records = tables.records(spark, sf_dir).withColumn("part_id", F.concat(F.lit("p"), "part_id"))
    return graph.document_ids(records, ["doc_id", "part_id"], *keep)


@_query(_WHOLE_CHAIN + ", c AS (SELECT record_id AS source, lead(record_id) OVER (PARTITION BY doc_id ORDER BY coalesce(date, ''), record_type, record_id) AS target FROM k) SELECT DISTINCT source, target FROM c WHERE target IS NOT NULL")
def J1_document_join(spark, sf_dir):
    return graph.document_join(_ids(spark, sf_dir), most=None)


@_query(f"WITH {RECORDS} SELECT p.vendor_id, p.doc_id, p.record_id AS posting_id, r.record_id AS receipt_id FROM records p JOIN records r ON p.vendor_id = r.vendor_id AND p.doc_id = r.doc_id AND p.record_type = 'vendor_posting' AND r.record_type = 'goods_receipt'")
def J2_has_receipt(spark, sf_dir):
    rows = tables.lines(spark, sf_dir)
    return graph.has_receipt(rows.where("record_type = 'vendor_posting'"), rows.where("record_type = 'goods_receipt'"))


@_query(_WHOLE_CHAIN + """, u AS (SELECT k.*, r.user_id FROM k LEFT JOIN (SELECT record_id, user_id FROM records WHERE user_id IS NOT NULL) r USING (record_id)),
a AS (SELECT doc_id, max(user_id) AS user_id, min(record_id) FILTER (WHERE user_id IS NOT NULL) AS basis_id FROM u GROUP BY doc_id HAVING count(DISTINCT user_id) = 1)
SELECT DISTINCT u.record_id, a.user_id, a.basis_id FROM u JOIN a USING (doc_id) WHERE u.user_id IS NULL""")
def J3_inherited_users(spark, sf_dir):
    return graph.inherited_users(_ids(spark, sf_dir, "user_id"), most=None)


@_query(f"""
WITH {RECORDS} SELECT DISTINCT 'record:' || record_id AS source, 'vendor:' || vendor_id AS target, CASE WHEN record_type = 'vendor_posting' THEN 'paid_to' ELSE 'references' END AS edge_type,
  record_id AS record_ids FROM records WHERE vendor_id IS NOT NULL
UNION ALL SELECT DISTINCT 'record:' || record_id, 'customer:' || customer_id, 'references', record_id FROM records WHERE customer_id IS NOT NULL""")
def J4_references(spark, sf_dir):
    rows = tables.records(spark, sf_dir)
    pick = lambda kind, c: rows.where(F.col(c).isNotNull()).select("record_id", F.lit(kind).alias("entity_type"), F.col(c).alias("entity_id"))
    entities = pick("vendor", "vendor_id").unionByName(pick("customer", "customer_id"))
    labels = rows.where("record_type = 'vendor_posting'").select("record_id", F.lit("paid_to").alias("label"), F.col("vendor_id").alias("value"))
    kinds = spark.createDataFrame([("paid_to", "vendor"), ("posted_by", "user")], "label string, entity_type string")
    return graph.references(entities, labels, kinds).withColumn("record_ids", F.array_join("record_ids", ","))


_FOUND = "WITH q AS (SELECT o_orderkey, ['I-' || o_orderkey, 'I-' || (o_orderkey + 1), 'I-' || o_orderkey] AS record_ids FROM orders WHERE o_orderstatus = 'P')"


def _proposals(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    ids = F.array(*[F.concat(F.lit("I-"), x.cast("string")) for x in (key, key + 1, key)])
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(key.alias("proposal_id"), ids.alias("record_ids"))


@_query(_FOUND + f""", {RECORDS}, u AS (SELECT o_orderkey AS proposal_id, unnest([0, 1]) AS position, unnest(record_ids[1:2]) AS record_id FROM q)
SELECT proposal_id, position, record_id, amount FROM u JOIN records USING (record_id)""")
def J6_rehydrate_evidence(spark, sf_dir):
    return evidence.rehydrated(_proposals(spark, sf_dir), tables.invoices(spark, sf_dir).select("record_id", "amount")).select("proposal_id", "position", "record_id", "amount")


@_query(_FOUND + f""", {RECORDS}, u AS (SELECT o_orderkey AS proposal_id, unnest(record_ids[1:2]) AS record_id FROM q)
SELECT proposal_id, count(*) AS n_cited FROM u LEFT JOIN records r USING (record_id) GROUP BY 1 HAVING count(*) = count(r.amount)""")
def J7_valid_proposals(spark, sf_dir):
    return evidence.valid_proposals(_proposals(spark, sf_dir), tables.invoices(spark, sf_dir))


@_query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def J8_semi_join(spark, sf_dir):
    returned = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf_dir, "part").join(returned, "p_partkey", "left_semi").select("p_partkey", "p_name")


@_query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def J9_anti_join(spark, sf_dir):
    urgent = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_name")


_TYPES = """
t AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag || l_linestatus))) AS types FROM lineitem GROUP BY 1),
s AS (SELECT DISTINCT array_to_string(types, '|') AS shape, types FROM t)"""


@_query(f"""
WITH {_TYPES}, p AS (
  SELECT a.shape, b.shape AS superset, CAST(len(b.types) - len(a.types) AS INTEGER) AS n_extra FROM s a JOIN s b ON list_has_all(b.types, a.types) AND len(b.types) > len(a.types)
), r AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY n_extra, superset) AS k FROM p)
SELECT shape, superset, n_extra FROM r WHERE k = 1""")
def J10_nearest_superset(spark, sf_dir):
    types = F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus")))
    sets = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(types.alias("types"))
    return profile.nearest_supersets(sets.select(F.array_join("types", "|").alias("shape"), "types").distinct())


@_query("""
SELECT u.user_id, e.event_type, count(*) AS n FROM (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)) u JOIN events e USING (user_id) GROUP BY 1, 2""")
def J12_events_of_users(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    first = events.agg(F.min("event_type").alias("event_type"))
    users = events.join(F.broadcast(first), "event_type").select("user_id").distinct()  # first is one row
    return events.join(users, "user_id", "left_semi").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


# Aggregations


@_query(f"""
WITH {RECORDS} SELECT record_type, count(*) AS n_records, count(DISTINCT left(date, 7)) AS n_periods, min(left(date, 7)) AS first_period, max(left(date, 7)) AS last_period FROM records GROUP BY 1""")
def A1_type_counts(spark, sf_dir):
    return profile.type_counts(tables.records(spark, sf_dir))


_QUANTILES = """
SELECT p, v AS value FROM (SELECT amount AS v, row_number() OVER (ORDER BY amount) - 1 AS k, count(*) OVER () AS n FROM {t} WHERE amount IS NOT NULL) r
JOIN (SELECT unnest([0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0])::DOUBLE AS p) q ON k = CAST(round_even(p * (n - 1), 0) AS BIGINT)"""


@_query(f"WITH {RECORDS} {_QUANTILES.format(t='records')}")
def A2_quantiles(spark, sf_dir):
    return profile.quantiles(tables.records(spark, sf_dir), "amount")


@_query(f"""
WITH {RECORDS}, o AS (SELECT vendor_id AS entity_id, record_type AS edge_type, record_id, any_value(date) AS date, any_value(amount) AS amount FROM lines GROUP BY ALL)
SELECT entity_id, count(*) AS n_records, min(date) AS first_date, max(date) AS last_date, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS sum_amount,
  round(CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(amount), 4) AS mean_amount,
  count(*) FILTER (WHERE edge_type = 'vendor_posting') AS vendor_posting, count(*) FILTER (WHERE edge_type = 'goods_receipt') AS goods_receipt, CAST(0 AS BIGINT) AS asset_posting
FROM o GROUP BY 1""")
def A3_entity_profile(spark, sf_dir):
    links = tables.lines(spark, sf_dir).select(F.col("vendor_id").alias("entity_id"), F.col("record_type").alias("edge_type"), "record_id", "date", "amount").dropDuplicates(["entity_id", "edge_type", "record_id"])
    return profile.entity_profile(links, ["vendor_posting", "goods_receipt", "asset_posting"])


@_query(f"""
WITH {RECORDS} SELECT doc_id AS graph_id, count(*) AS n_records, bool_or(coalesce(trim(date) <> '', false)) AS has_date, bool_or(amount IS NOT NULL) AS has_amount,
  bool_or(vendor_id IS NOT NULL OR customer_id IS NOT NULL) AS has_counterparty, bool_or(doc_id IS NOT NULL) AS has_document FROM records GROUP BY 1""")
def A4_completeness(spark, sf_dir):
    return profile.completeness(_entries(spark, sf_dir))


@_query(f"""
WITH {RECORDS}, x AS (SELECT doc_id, unnest(['vendor_id', 'customer_id', 'user_id']) AS field, unnest([vendor_id, customer_id, user_id]) AS v FROM records)
SELECT doc_id AS graph_id, field, count(*) FILTER (WHERE trim(v) <> '') AS filled, count(*) AS applicable FROM x GROUP BY ALL""")
def A5_fill_rates(spark, sf_dir):
    return profile.fill_rates(_entries(spark, sf_dir), ["vendor_id", "customer_id", "user_id"])


def _entries(spark, sf_dir) -> DataFrame:
    """Records with the entry they belong to: here their order."""
    return tables.records(spark, sf_dir).withColumn("graph_id", F.col("doc_id"))


_SHAPES = """
sc AS (SELECT doc_id AS graph_id, record_type, count(*) AS n FROM records GROUP BY ALL),
sh AS (SELECT graph_id, string_agg(record_type || 'x' || n, '|' ORDER BY record_type || 'x' || n) AS shape FROM sc GROUP BY 1),
co AS (SELECT doc_id AS graph_id, bool_or(date IS NOT NULL) AS has_date, bool_or(amount IS NOT NULL) AS has_amount, bool_or(vendor_id IS NOT NULL OR customer_id IS NOT NULL) AS has_counterparty, bool_or(doc_id IS NOT NULL) AS has_document FROM records GROUP BY 1),
sp AS (SELECT shape, count(*) AS n_entries, count(*) FILTER (WHERE has_date) AS with_date, count(*) FILTER (WHERE has_amount) AS with_amount, count(*) FILTER (WHERE has_counterparty) AS with_counterparty, count(*) FILTER (WHERE has_document) AS with_document FROM sh JOIN co USING (graph_id) GROUP BY 1)
"""


@_query(f"WITH {RECORDS}, {_SHAPES} SELECT * FROM sp")
def A6_shape_profile(spark, sf_dir):
    return profile.shape_profile(_entries(spark, sf_dir))


@_query(f"WITH {RECORDS} SELECT doc_id AS graph_id, coalesce(max(abs(amount)), 0.0) AS score FROM records GROUP BY 1")
def A7_entry_scores(spark, sf_dir):
    return profile.scores(_entries(spark, sf_dir))


@_query("""
SELECT n_name AS nation, CASE WHEN c_acctbal < 0 THEN 'negative' ELSE 'positive' END AS sign, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal IS NOT NULL GROUP BY ALL""")
def A8_signed_subtotals(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    rows = read(spark, sf_dir, "customer").join(nations, "c_nationkey").select("nation", F.col("c_acctbal").alias("amount"))
    return profile.subtotals(rows, ["nation"])


@_query(_CHAIN + " SELECT doc_id, count(DISTINCT record_id) AS n_records FROM ids GROUP BY 1")
def A9_fan_out(spark, sf_dir):
    return graph.fan_out(_ids(spark, sf_dir))


@_query(f"WITH {RECORDS} SELECT record_type, nullif(CAST(sum(abs(CAST(amount AS DECIMAL(18,2)))) AS DOUBLE), 0.0) AS at_risk FROM records GROUP BY 1")
def A11_amount_at_risk(spark, sf_dir):
    return tables.records(spark, sf_dir).groupBy("record_type").agg(rules.amount_at_risk().alias("at_risk"))


@_query("SELECT source, lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY ALL")
def A12_manifest_totals(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@_query("""
SELECT 'vendor' AS entity_type, CAST(l_suppkey AS VARCHAR) AS entity_id, any_value(s_name) AS label FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey""")
def A13_entity_labels(spark, sf_dir):
    named = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("label"))
    rows = tables.lines(spark, sf_dir).select("record_id", F.col("vendor_id").cast("long").alias("l_suppkey")).join(named, "l_suppkey", "left")
    return graph.entity_labels(rows.select("record_id", F.lit("vendor").alias("entity_type"), F.col("l_suppkey").cast("string").alias("entity_id"), "label"))


@_query("""
SELECT source, count(*) AS n_labelled, count(*) FILTER (WHERE quality = 0) AS n_flagged, round(count(*) FILTER (WHERE quality = 0) / count(*), 4) AS flag_rate
FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def A17_flag_rates(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    flagged = F.count_if(F.col("quality") == 0)
    return rows.groupBy("source").agg(F.count("*").alias("n_labelled"), flagged.alias("n_flagged"), F.round(flagged / F.count("*"), 4).alias("flag_rate"))


# Ranking, pages, set operations

_RANKED = f"""
WITH {RECORDS}, {_SHAPES}, qv AS ({_QUANTILES.format(t='records')}),
z AS (SELECT doc_id AS graph_id, coalesce(max(abs(amount)), 0.0) AS score FROM records GROUP BY 1),
e AS (SELECT graph_id, score, (SELECT count(*) FROM qv WHERE z.score >= value) AS amount_rank, n_entries,
  CAST((NOT has_date AND with_date > 0)::INT + (NOT has_amount AND with_amount > 0)::INT + (NOT has_counterparty AND with_counterparty > 0)::INT + (NOT has_document AND with_document > 0)::INT AS INTEGER) AS absences
  FROM z JOIN sh USING (graph_id) JOIN co USING (graph_id) JOIN sp USING (shape)),
r AS (SELECT row_number() OVER (ORDER BY amount_rank DESC, n_entries, absences DESC, graph_id) AS rank, * FROM e)
SELECT rank, graph_id, score, amount_rank, n_entries, absences FROM r"""


@_query(_RANKED)
def W2_materiality_ranks(spark, sf_dir):
    return profile.ranked_entries(_entries(spark, sf_dir))


@_query(f"SELECT CAST(rank AS INTEGER) AS rank, graph_id, score, amount_rank, n_entries, absences FROM ({_RANKED}) WHERE rank <= 100")
def N2_ranked_entries(spark, sf_dir):
    return profile.ranked_entries(_entries(spark, sf_dir), most=100)


@_query("SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def Q2_last_write_wins(spark, sf_dir):
    return store.latest(read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], "event_id")


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def L2_page(spark, sf_dir):
    return store.page(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], offset=100)


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def L7_top_amounts(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return store.page(rows, [F.desc("o_totalprice"), "o_orderkey"], limit=5)


@_query("SELECT conv_id, string_agg(turn || ':' || role, '|' ORDER BY turn, role) AS timeline FROM conversations GROUP BY 1")
def L9_timeline(spark, sf_dir):
    steps = F.array_sort(F.collect_list(F.struct("turn", "role")))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(steps.alias("s"))
    return rows.select("conv_id", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["turn"], x["role"])), "|").alias("timeline"))


@_query("SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'O' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'")
def U4_difference(spark, sf_dir):
    pick = lambda s: read(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == s).select("l_suppkey", "l_partkey")
    return pick("O").subtract(pick("F"))


@_query("SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'O' INTERSECT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'")
def U5_intersection(spark, sf_dir):
    pick = lambda s: read(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == s).select("l_suppkey", "l_partkey")
    return pick("O").intersect(pick("F"))


# Graph


def _returned(spark, sf_dir) -> DataFrame:
    """Orders joined by a vendor's returned lines of one day: (a, b) of order keys."""
    rows = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_suppkey", "l_shipdate", "l_orderkey")
    first = rows.groupBy("l_suppkey", "l_shipdate").agg(F.min("l_orderkey").alias("a"))
    return rows.join(first, ["l_suppkey", "l_shipdate"]).where(F.col("a") != F.col("l_orderkey")).select("a", F.col("l_orderkey").alias("b")).distinct()


_EDGES = """
e AS (SELECT DISTINCT a, b FROM (SELECT min(l_orderkey) OVER (PARTITION BY l_suppkey, l_shipdate) AS a, l_orderkey AS b FROM lineitem WHERE l_returnflag = 'R') WHERE a <> b),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"""


@_query(f"WITH RECURSIVE {_EDGES}, r(node, x) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.x) SELECT node, min(x) AS component FROM r GROUP BY 1")
def G3_components(spark, sf_dir):
    return cc.components(_returned(spark, sf_dir))


@_query(f"""
WITH RECURSIVE {_EDGES}, r(node, x) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.x), m AS (SELECT node, min(x) AS component FROM r GROUP BY 1),
d AS (SELECT node, (SELECT count(*) FROM e WHERE b = node) AS n_in, (SELECT count(*) FROM e WHERE a = node) AS n_out FROM m)
SELECT component AS graph_id, node AS node_id, n_in, n_out FROM m JOIN d USING (node)""")
def G4_degrees(spark, sf_dir):
    edges = _returned(spark, sf_dir)
    members = cc.components(edges).select(F.col("component").alias("graph_id"), F.col("node").alias("node_id"))
    return graph.degrees(edges.select(F.col("a").alias("source"), F.col("b").alias("target")), members)


_VENDORS = f"""
WITH {RECORDS}, ed AS (SELECT DISTINCT 'vendor:' || vendor_id AS source, record_type AS edge_type, 'part:' || part_id AS target FROM lines),
al AS (SELECT source AS node_id, 'out' AS direction, edge_type, target AS neighbor FROM ed UNION ALL SELECT target, 'in', edge_type, source FROM ed)"""


def _vendor_edges(spark, sf_dir) -> DataFrame:
    return tables.lines(spark, sf_dir).select(
        F.concat(F.lit("vendor:"), "vendor_id").alias("source"), F.col("record_type").alias("edge_type"), F.concat(F.lit("part:"), "part_id").alias("target")
    ).distinct()


@_query(_VENDORS + """, k AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY direction, edge_type, neighbor) AS rank FROM al)
SELECT node_id, direction, edge_type, neighbor, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 20""")
def G8_neighbors(spark, sf_dir):
    edges = _vendor_edges(spark, sf_dir)
    nodes = edges.select(F.col("source").alias("node_id")).unionByName(edges.select(F.col("target").alias("node_id"))).distinct()
    return graph.neighbors(edges, nodes, limit=20)


@_query(f"""
WITH RECURSIVE {_EDGES}, s AS (SELECT min(a) AS start FROM e), r(start, node, length) AS (SELECT start, start, 0 FROM s UNION SELECT r.start, u.b, r.length + 1 FROM r JOIN u ON u.a = r.node WHERE r.length < 6)
SELECT start, node AS node_id, CAST(min(length) AS INTEGER) AS length FROM r GROUP BY ALL""")
def G10_path_lengths(spark, sf_dir):
    edges = _returned(spark, sf_dir)
    return graph.distances(edges.select(F.col("a").alias("source"), F.col("b").alias("target")), edges.agg(F.min("a").alias("start")), 6)


@_query(_VENDORS + " SELECT source AS node_id, count(*) FILTER (WHERE edge_type = 'goods_receipt') > 0 AS present, count(*) FILTER (WHERE edge_type = 'goods_receipt') AS n_edges FROM ed GROUP BY 1")
def G11_absence_check(spark, sf_dir):
    n = F.count_if(F.col("edge_type") == "goods_receipt")
    return _vendor_edges(spark, sf_dir).groupBy(F.col("source").alias("node_id")).agg((n > 0).alias("present"), n.alias("n_edges"))


# Review rules


@_query(f"""
WITH {RECORDS}, s AS (SELECT vendor_id, count(*) AS n_postings, count(*) FILTER (WHERE amount <> 0 AND CAST(amount AS DECIMAL(18,2)) % 10 = 0) AS n_round,
  nullif(CAST(sum(abs(CAST(amount AS DECIMAL(18,2)))) AS DOUBLE), 0.0) AS amount_at_risk FROM lines WHERE record_type = 'vendor_posting' AND flag <> 'R' GROUP BY 1),
t AS (SELECT s.*, vendor_id NOT IN (SELECT vendor_id FROM lines WHERE record_type = 'goods_receipt' AND amount > 104000) AS without_receipt FROM s)
SELECT vendor_id, n_postings, n_round, amount_at_risk, without_receipt FROM t WHERE without_receipt OR n_round = n_postings""")
def R1_shell_vendors(spark, sf_dir):
    rows = tables.lines(spark, sf_dir)
    return rules.shell_vendors(rows.where("record_type = 'vendor_posting' AND flag <> 'R'"), rows.where("record_type = 'goods_receipt' AND amount > 104000"))


_WORDS = ["Gear", "ring"]


@_query("""
SELECT CAST(p_partkey AS VARCHAR) AS asset_id, p_name AS name, count(*) AS n_postings, nullif(CAST(sum(abs(CAST(l_extendedprice AS DECIMAL(18,2)))) AS DOUBLE), 0.0) AS amount_at_risk
FROM part JOIN lineitem ON l_partkey = p_partkey WHERE lower(p_name) LIKE '%gear%' OR lower(p_name) LIKE '%ring%' GROUP BY p_partkey, p_name""")
def R2_repairs_capitalised(spark, sf_dir):
    assets = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("asset_id"), F.col("p_name").alias("name"))
    postings = tables.lines(spark, sf_dir).select(F.col("part_id").alias("asset_id"), "amount")
    return rules.repairs_capitalised(assets, postings, _WORDS)


@_query(f"""
WITH {RECORDS} SELECT l.record_id, left(i.date, 7) AS booked_period, left(l.date, 7) AS served_period, l.amount FROM lines l JOIN invoices i USING (doc_id) WHERE left(l.date, 7) < left(i.date, 7)""")
def R3_cut_off(spark, sf_dir):
    booked = tables.invoices(spark, sf_dir).select("doc_id", F.col("date").alias("booked"))
    return rules.wrong_period(tables.lines(spark, sf_dir).select("record_id", "doc_id", F.col("date").alias("served"), "amount").join(booked, "doc_id"))


@_query(f"""
WITH {RECORDS} SELECT vendor_id, left(date, 7) AS month, count(*) AS n_payments, CAST(sum(abs(CAST(amount AS DECIMAL(18,2)))) AS DOUBLE) AS combined FROM lines
WHERE abs(amount) >= 9000 AND abs(amount) < 10000 GROUP BY ALL HAVING count(*) >= 2 AND combined >= 10000""")
def R4_split_payments(spark, sf_dir):
    rows = tables.lines(spark, sf_dir).withColumn("month", exprs.period(F.col("date")))
    return rules.split_payments(rows, 9000, 10000, ["vendor_id", "month"], 10000)


# Single records, logs and lookups


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 997 = 0 ORDER BY o_orderkey")
def Q6_point_lookup(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(F.col("o_orderkey") % 997 == 0).select("o_orderkey", "o_custkey", "o_totalprice")


@_query("SELECT count(*) AS n FROM events WHERE event_type = 'purchase'")
def Q5_record_count(spark, sf_dir):
    return read(spark, sf_dir, "events").where("event_type = 'purchase'").agg(F.count("*").alias("n"))


@_query("""
SELECT user_id, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'error') AS n_errors, max_by(event_type, event_id) AS last_status FROM events GROUP BY 1""")
def Q13_run_log(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.max_by("event_type", "event_id").alias("last_status")
    )


@_query("""
WITH c AS (SELECT c_custkey AS k, c_name, c_acctbal FROM customer), d AS (SELECT s_suppkey AS k, s_name AS c_name, s_acctbal AS c_acctbal FROM supplier)
SELECT * FROM d UNION ALL SELECT * FROM c WHERE k NOT IN (SELECT k FROM d)""")
def Q9_upsert(spark, sf_dir):
    table = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_acctbal")
    changes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return store.upsert(table, changes, ["k"])


@_query("""
SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN left(text, 40) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS heading FROM conversations""")
def W4_carry_heading(spark, sf_dir):
    from pyspark.sql import Window

    upto = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)  # one conversation
    heading = F.when(F.col("role") == "user", F.left("text", F.lit(40)))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.last(heading, ignorenulls=True).over(upto).alias("heading"))


@_query("""
SELECT r_name AS region, n_name AS nation, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def J14_attribute_lookup(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    each = lambda t, key, n: read(spark, sf_dir, t).groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(n))
    rows = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    rows = rows.join(each("customer", "c_nationkey", "customers"), "n_nationkey", "left").join(each("supplier", "s_nationkey", "suppliers"), "n_nationkey", "left")
    return rows.na.fill(0, ["customers", "suppliers"]).select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "customers", "suppliers")


@_query(f"""
WITH {RECORDS}, {_SHAPES} SELECT sh.graph_id, CASE WHEN NOT has_counterparty AND with_counterparty > 0 THEN 'counterparty' WHEN NOT has_date AND with_date > 0 THEN 'date' END AS absent
FROM sh JOIN co USING (graph_id) JOIN sp USING (shape) WHERE (NOT has_counterparty AND with_counterparty > 0) OR (NOT has_date AND with_date > 0)""")
def N5_identity_absence(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    rows = profile.shapes(entries).join(profile.completeness(entries), "graph_id").join(profile.shape_profile(entries), "shape")
    lacks = lambda d: ~F.col(f"has_{d}") & (F.col(f"with_{d}") > 0)
    absent = F.when(lacks("counterparty"), "counterparty").when(lacks("date"), "date")
    return rows.select("graph_id", absent.alias("absent")).where(F.col("absent").isNotNull())


@_query(f"""
WITH {RECORDS}, e AS (SELECT DISTINCT doc_id AS graph_id, record_type FROM records), p AS (SELECT DISTINCT record_type FROM e), g AS (SELECT DISTINCT graph_id FROM e)
SELECT g.graph_id, p.record_type AS lacking FROM g, p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph_id = g.graph_id AND e.record_type = p.record_type)""")
def N6_companion_absence(spark, sf_dir):
    kinds = tables.records(spark, sf_dir).select("record_type").distinct().agg(F.collect_set("record_type").alias("all"))  # a few types
    own = tables.records(spark, sf_dir).groupBy(F.col("doc_id").alias("graph_id")).agg(F.collect_set("record_type").alias("own"), F.lit(1).alias("one"))
    rows = own.join(F.broadcast(kinds.withColumn("one", F.lit(1))), "one")
    return rows.select("graph_id", F.explode(F.array_except("all", "own")).alias("lacking"))
