"""Registered queries over rows as files have them, and the reads of stored records.

The rows are made from order tables: German texts in named columns, as the readers give them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import exprs
from tallyweave.operators import brief, envelope, graph, profile, store
from tallyweave.plans.catalog import _SHAPES, _entries
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


def _rows(df: DataFrame, path: str, cells: dict, number) -> DataFrame:
    """File rows with the given columns."""
    pairs = [x for k, v in cells.items() for x in (F.lit(k), v)]
    return df.select(
        F.lit(path).alias("path"), F.lit(None).cast("string").alias("sheet"), number.alias("row_number"),
        F.array(*map(F.lit, cells)).alias("columns"), F.create_map(*pairs).alias("data"), F.lit(None).cast("string").alias("text"),
    )


def _german(amount) -> F.Column:
    return F.translate(F.format_number(amount, 2), ",.", ".,")


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a ledger: composite accounts, dates that aren't dates, blank users."""
    key = F.col("o_custkey").cast("string")
    account = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("1400-1"), F.lpad(key, 5, "0"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("0400-0"), F.lpad(key, 5, "0"))).otherwise(key)
    cells = {
        "BUCHUNGSDATUM": F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")),
        "BELEGDATUM": F.date_format("o_orderdate", "d.M.yy"),
        "BUCHUNGSBETRAG": F.when(F.col("o_orderkey") % 7 == 0, "offen").otherwise(_german("o_totalprice")),
        "SACHKONTONUMMER": account,
        "GEGENKONTO": F.col("o_orderstatus"),
        "BENUTZERKENNUNG": F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(" "),
        "ERFASSER": F.substring("o_orderpriority", 1, 1),
    }
    return _rows(read(spark, sf_dir, "orders"), "/ledger/Sachkontobuchungen.txt", cells, F.col("o_orderkey").cast("int"))


_JOURNAL = """
j AS (SELECT CAST(o_orderkey AS INTEGER) AS row_number, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS booked,
  day(o_orderdate) || '.' || month(o_orderdate) || '.' || strftime(o_orderdate, '%y') AS voucher,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(printf('%.2f', o_totalprice) AS DOUBLE) END AS amount, o_orderkey % 3 AS form, lpad(CAST(o_custkey AS VARCHAR), 5, '0') AS five, CAST(o_custkey AS VARCHAR) AS key,
  o_orderstatus AS other, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS user, left(o_orderpriority, 1) AS writer FROM orders)"""


@_query(f"WITH {_JOURNAL} SELECT row_number, 'journal_entry' AS record_type, coalesce(booked, voucher) AS date, amount, voucher, CASE WHEN amount IS NULL THEN 'offen' END AS kept FROM j")
def P4_ledger_projection(spark, sf_dir):
    rows = envelope.ledger_records(_journal(spark, sf_dir), "d")
    cell = lambda name: F.get(F.filter("cells", lambda x: x["name"] == name), 0)
    kept = F.when(cell("BUCHUNGSBETRAG")["number"].isNull(), cell("BUCHUNGSBETRAG")["text"])
    return rows.select("row_number", "record_type", "date", "amount", cell("BELEGDATUM")["text"].alias("voucher"), kept.alias("kept"))


@_query(f"""
WITH {_JOURNAL}, e AS (
  SELECT row_number, 'account' AS entity_type, CASE form WHEN 0 THEN '1400' WHEN 1 THEN '0400' ELSE key END AS entity_id FROM j
  UNION SELECT row_number, 'customer', '1' || five FROM j WHERE form = 0 UNION SELECT row_number, 'asset', '0400-0' || five FROM j WHERE form = 1
  UNION SELECT row_number, 'account', other FROM j UNION SELECT row_number, 'user', user FROM j WHERE user IS NOT NULL UNION SELECT row_number, 'user', writer FROM j)
SELECT * FROM e""")
def E1_ledger_entities(spark, sf_dir):
    return envelope.entity_rows(envelope.ledger_records(_journal(spark, sf_dir), "d"), "row_number").drop("label")


@_query(f"WITH {_JOURNAL} SELECT row_number, 'posted_by' AS relation, coalesce(user, writer) AS entity_id FROM j UNION ALL SELECT row_number, 'to_account', other FROM j")
def E2_ledger_relations(spark, sf_dir):
    return envelope.relation_rows(envelope.ledger_records(_journal(spark, sf_dir), "d"), "row_number")


@_query(f"""
WITH {_JOURNAL}, n AS (
  SELECT row_number, 'entity:account:' || CASE form WHEN 0 THEN '1400' WHEN 1 THEN '0400' ELSE key END AS target, 'references' AS edge_type FROM j
  UNION SELECT row_number, 'entity:customer:1' || five, 'references' FROM j WHERE form = 0 UNION SELECT row_number, 'entity:asset:0400-0' || five, 'references' FROM j WHERE form = 1
  UNION SELECT row_number, 'entity:account:' || other, 'to_account' FROM j UNION SELECT row_number, 'entity:user:' || coalesce(user, writer), 'posted_by' FROM j
  UNION SELECT row_number, 'entity:user:' || writer, 'references' FROM j WHERE user IS NOT NULL)
SELECT target, edge_type, count(*) AS n_edges FROM n GROUP BY ALL""")
def J4_typed_edges(spark, sf_dir):
    edges = envelope.entity_edges(envelope.ledger_records(_journal(spark, sf_dir), "d"))
    return edges.groupBy("target", "edge_type").agg(F.count("*").alias("n_edges"))


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a CSV file with a type column, names and the columns of several users."""
    key = lambda c: F.col(c).cast("string")
    cells = {
        "ART": F.when(F.col("l_returnflag") == "R", "Kreditor").when(F.col("l_returnflag") == "A", "debitor").otherwise("?"),
        "KONTO": key("l_suppkey"),
        "GEGENKONTO": F.when(F.col("l_linestatus") == "O", "0,0").otherwise(key("l_partkey")),
        "KONTOBEZEICHNUNG": F.concat(F.lit("Konto "), key("l_suppkey")),
        "LIEFERDATUM": F.date_format("l_shipdate", "d.M.yyyy"),
        "NETTOBETRAG": F.when(F.col("l_linenumber") == 1, "-").otherwise(_german("l_extendedprice")),
        "STEUER": _german(F.col("l_extendedprice") * 2),
        "LIEFERANT": F.when(F.col("l_linenumber") > 1, key("l_suppkey")),
        "ERSTELLT_VON": F.concat(F.lit("U"), key("l_linenumber")),
        "MENGE": F.concat(key("l_linenumber"), F.lit(",5")),
    }
    return _rows(read(spark, sf_dir, "lineitem").distinct(), "/in/Kreditoren_Postings.csv", cells, F.col("l_orderkey").cast("int"))


_POSTINGS = "p AS (SELECT DISTINCT * FROM lineitem)"


@_query(f"""
WITH {_POSTINGS} SELECT CAST(l_orderkey AS INTEGER) AS row_number, 'vendor_posting' AS record_type, strftime(l_shipdate, '%Y-%m-%d') AS date, strftime(l_shipdate, '%Y-%m') AS period,
  CASE WHEN l_linenumber = 1 THEN CAST(printf('%.2f', l_extendedprice * 2) AS DOUBLE) ELSE CAST(printf('%.2f', l_extendedprice) AS DOUBLE) END AS amount, 'EUR' AS currency, l_linenumber + CAST(0.5 AS DOUBLE) AS quantity FROM p""")
def P5_csv_projection(spark, sf_dir):
    rows = envelope.csv_records(_postings(spark, sf_dir), "d")
    quantity = F.get(F.filter("cells", lambda x: x["name"] == "MENGE"), 0)["number"]
    return rows.select("row_number", "record_type", "date", "period", "amount", "currency", quantity.alias("quantity"))


@_query(f"""
WITH {_POSTINGS}, e AS (
  SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'vendor' WHEN 'A' THEN 'customer' ELSE 'account' END AS entity_type, CAST(l_suppkey AS VARCHAR) AS entity_id, 'Konto ' || l_suppkey AS label FROM p
  UNION ALL SELECT l_orderkey, 'account', CAST(l_partkey AS VARCHAR), NULL FROM p WHERE l_linestatus <> 'O'
  UNION ALL SELECT l_orderkey, 'vendor', CAST(l_suppkey AS VARCHAR), NULL FROM p WHERE l_linenumber > 1 UNION ALL SELECT l_orderkey, 'user', 'U' || l_linenumber, NULL FROM p)
SELECT entity_type, entity_id, label, count(*) AS n FROM e GROUP BY ALL""")
def E3_csv_entities(spark, sf_dir):
    rows = envelope.entity_rows(envelope.csv_records(_postings(spark, sf_dir), "d"))
    return rows.groupBy("entity_type", "entity_id", "label").agg(F.count("*").alias("n"))


@_query(f"""
WITH {_POSTINGS}, r AS (SELECT 'received_from' AS relation, CAST(l_suppkey AS VARCHAR) AS entity_id FROM p WHERE l_linenumber > 1 UNION ALL SELECT 'created_by', 'U' || l_linenumber FROM p)
SELECT relation, entity_id, count(*) AS n FROM r GROUP BY ALL""")
def E3_csv_relations(spark, sf_dir):
    rows = envelope.relation_rows(envelope.csv_records(_postings(spark, sf_dir), "d"))
    return rows.groupBy("relation", "entity_id").agg(F.count("*").alias("n"))


@_query("""
WITH c AS (SELECT CAST(c_custkey AS INTEGER) AS row_number, 'C-' || c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS account, CAST(printf('%.2f', c_acctbal) AS DOUBLE) AS amount FROM customer)
SELECT row_number, 'open_item' AS record_type, amount, 'customer' AS entity_type, id AS entity_id, account AS account_of FROM c
UNION ALL SELECT row_number, 'open_item', amount, 'account', account, account FROM c""")
def E4_sheet_entities(spark, sf_dir):
    key = F.concat(F.lit("C-"), F.col("c_custkey").cast("string"))
    cells = {"Nr": key, "Hauptkonto": F.col("c_nationkey").cast("string"), "Saldo": _german("c_acctbal")}
    rows = envelope.sheet_records(_rows(read(spark, sf_dir, "customer"), "/in/OP-Liste_Debitoren.xlsx", cells, F.col("c_custkey").cast("int")), "d")
    rows = rows.withColumn("account_of", F.try_element_at("relationships", F.lit("account")))
    return envelope.entity_rows(rows, "row_number", "record_type", "amount", "account_of").drop("label")


@_query("""
SELECT p_partkey, lower(p_name) LIKE '%text' OR lower(p_name) LIKE '%name' AS label, CASE WHEN p_partkey % 2 = 0 THEN 'account' ELSE 'asset' END AS kind,
  CASE WHEN p_partkey % 3 = 0 THEN '(empty)' WHEN p_partkey % 3 = 1 THEN '"(empty)"' ELSE p_name END AS shown FROM part""")
def F14_field_values(spark, sf_dir):
    code = F.when(F.col("p_partkey") % 2 == 0, "040000").otherwise("040000-000001")
    value = F.when(F.col("p_partkey") % 3 == 1, "(empty)").when(F.col("p_partkey") % 3 == 2, F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", envelope.is_label(F.col("p_name")).alias("label"), envelope.node_type(F.lit("asset"), code).alias("kind"), brief.shown(value).alias("shown"))


# Reads of stored records


@_query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey = 7 ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 50 OFFSET 10")
def Q3_records_of_file(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where("l_suppkey = 7").select("l_orderkey", "l_linenumber", "l_partkey")
    return store.page(rows, ["l_orderkey", "l_linenumber", "l_partkey"], offset=10)


@_query(f"WITH {RECORDS} SELECT record_id, date, amount FROM records WHERE record_type = 'invoice'")
def Q4_records_of_type(spark, sf_dir):
    return store.of(tables.records(spark, sf_dir), record_type="invoice").select("record_id", "date", "amount")


@_query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click'")
def Q7_records_in_order(spark, sf_dir):
    return store.of(read(spark, sf_dir, "events"), event_type="click").select("event_id", "user_id", "event_type").orderBy("event_id")


@_query("SELECT user_id, max(ts) AS created_at, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def Q8_newest_first(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("created_at"), F.max_by("event_type", "event_id").alias("status"))
    return rows.orderBy(F.desc("created_at"), "user_id")


@_query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN 'ready' ELSE c_mktsegment END AS status, CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN NULL ELSE c_acctbal END AS balance FROM customer")
def Q10_update_status(spark, sf_dir):
    table = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("balance"))
    keys = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    return store.updated(table, keys, "c_custkey", {"status": F.lit("ready"), "balance": F.lit(None)})


@_query("SELECT k, name FROM (SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT max(c_custkey) + 1, 'new' FROM customer) WHERE k >= (SELECT max(c_custkey) FROM customer)")
def Q15_insert_and_look_up(spark, sf_dir):
    table = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    most = table.agg(F.max("k").alias("m"))
    whole = store.upsert(table, most.select((F.col("m") + 1).alias("k"), F.lit("new").alias("name")), ["k"])
    return whole.join(F.broadcast(most), F.col("k") >= F.col("m"), "left_semi")


@_query("SELECT page_id, url, NULL AS content_rows, 'empty' AS type FROM pages WHERE trim(html) = '' OR html IS NULL UNION ALL SELECT page_id, url, 1, 'text' FROM pages WHERE trim(html) <> ''")
def K3_preview_kinds(spark, sf_dir):
    rows = read(spark, sf_dir, "pages")
    filled = exprs.non_empty(F.col("html"))
    return rows.select("page_id", "url", F.when(filled, 1).alias("content_rows"), F.when(filled, "text").otherwise("empty").alias("type"))


# Windows, lookups and reported limits


@_query(f"WITH {RECORDS}, m AS (SELECT DISTINCT vendor_id, record_id FROM lines WHERE record_type = 'goods_receipt') SELECT vendor_id, CAST(k AS INTEGER) AS k, record_id FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY record_id) AS k FROM m) WHERE k <= 5")
def W6_first_masters(spark, sf_dir):
    rows = tables.lines(spark, sf_dir).where("record_type = 'goods_receipt'").select("vendor_id", "record_id")
    return profile.first_records(rows, "vendor_id", 5)


@_query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations WHERE role = 'user') WHERE k = 1")
def W5_first_user(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").where("role = 'user'")
    first = rows.groupBy("conv_id").agg(F.min_by(F.struct("turn", "text"), F.struct("turn", "text")).alias("f"))
    return first.select("conv_id", "f.turn", "f.text")


@_query(f"WITH {RECORDS}, n AS (SELECT count(DISTINCT doc_id) AS n FROM records) SELECT n AS n_entries, least(n, 500) AS n_analysed, greatest(n - 500, 0) AS n_left, n > 500 AS cap_reached FROM n")
def L6_reported_cap(spark, sf_dir):
    return profile.cap_report(_entries(spark, sf_dir), 500)


@_query("SELECT page_id, min(o.page_id) OVER (PARTITION BY regexp_extract(url, '([^/]*)$', 1)) AS first_page FROM pages o")
def J13_lookup_by_name(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", "url")
    return store.by_basename(rows.select("page_id", F.col("url").alias("path")), rows.select(F.col("page_id").alias("first_page"), F.col("url").alias("path")), "first_page").select("page_id", "first_page")


@_query(f"WITH {RECORDS}, g AS (SELECT doc_id AS graph_id, list(DISTINCT vendor_id) AS vendors FROM records GROUP BY 1) SELECT graph_id, s_suppkey FROM g JOIN supplier ON list_contains(vendors, CAST(s_suppkey AS VARCHAR)) WHERE s_nationkey < 5")
def J15_graphs_of_entities(spark, sf_dir):
    asked = read(spark, sf_dir, "supplier").where("s_nationkey < 5").select("s_suppkey", F.col("s_suppkey").cast("string").alias("vendor_id"))
    members = _entries(spark, sf_dir).select("graph_id", "vendor_id").where(F.col("vendor_id").isNotNull()).distinct()
    return members.join(asked, "vendor_id").select("graph_id", "s_suppkey")


@_query(f"WITH {RECORDS} SELECT record_id AS evidence_record, record_type AS label, 'orders.parquet' AS relative_path, CAST(doc_id AS INTEGER) AS row_start, CAST(doc_id AS INTEGER) AS row_end FROM invoices")
def H1_source_locations(spark, sf_dir):
    rows = tables.invoices(spark, sf_dir).withColumn("source", F.struct(F.lit("orders.parquet").alias("relative_path"), F.col("doc_id").cast("int").alias("row_start"), F.col("doc_id").cast("int").alias("row_end")))
    return rows.select(F.col("record_id").alias("evidence_record"), F.col("record_type").alias("label"), "source.*")


_DATED = RECORDS.replace("records AS (SELECT * FROM invoices", "whole AS (SELECT * FROM invoices") + ", records AS (SELECT * REPLACE (CASE WHEN CAST(doc_id AS BIGINT) % 7 = 0 THEN NULL ELSE date END AS date) FROM whole)"


def _partly_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).withColumn("date", F.when(F.col("doc_id").cast("long") % 7 != 0, F.col("date")))


@_query(f"""
WITH {_DATED}, {_SHAPES}, pa AS (SELECT DISTINCT doc_id AS graph_id, 'vendor ' || vendor_id AS who FROM records WHERE vendor_id IS NOT NULL UNION SELECT DISTINCT doc_id, 'customer ' || customer_id FROM records WHERE customer_id IS NOT NULL),
uses AS (SELECT who, count(DISTINCT record_id) AS n FROM (SELECT record_id, 'vendor ' || vendor_id AS who FROM records WHERE vendor_id IS NOT NULL UNION ALL SELECT record_id, 'customer ' || customer_id FROM records WHERE customer_id IS NOT NULL) GROUP BY 1),
wh AS (SELECT graph_id, string_agg('  ' || who || ': ' || n || ' record(s)', chr(10) ORDER BY '  ' || who || ': ' || n || ' record(s)') AS who FROM pa JOIN uses USING (who) GROUP BY 1),
t AS (SELECT graph_id, 'Entry ' || graph_id || chr(10) || 'Shape occurs ' || n_entries || ' of ' || (SELECT count(*) FROM sh) || ' time(s)' || chr(10)
  || 'Completeness: present=' || coalesce(nullif(concat_ws(',', CASE WHEN has_date THEN 'date' END, CASE WHEN has_amount THEN 'amount' END, CASE WHEN has_counterparty THEN 'counterparty' END, CASE WHEN has_document THEN 'document' END), ''), 'none')
  || ' absent=' || coalesce(nullif(concat_ws(',', CASE WHEN NOT has_date THEN 'date' END, CASE WHEN NOT has_amount THEN 'amount' END, CASE WHEN NOT has_counterparty THEN 'counterparty' END, CASE WHEN NOT has_document THEN 'document' END), ''), 'none')
  || chr(10) || 'Parties:' || chr(10) || coalesce(who, '  none') || chr(10) || 'Not present:' || chr(10)
  || coalesce(nullif(concat_ws(chr(10), CASE WHEN NOT has_date AND with_date > 0 THEN '  date' END, CASE WHEN NOT has_amount AND with_amount > 0 THEN '  amount' END,
     CASE WHEN NOT has_counterparty AND with_counterparty > 0 THEN '  counterparty' END, CASE WHEN NOT has_document AND with_document > 0 THEN '  document' END), ''), '  none') AS s
  FROM sh JOIN co USING (graph_id) JOIN sp USING (shape) LEFT JOIN wh USING (graph_id))
SELECT graph_id, CASE WHEN length(s) > 1600 THEN left(s, 1594) || ' [...]' ELSE s END AS summary FROM t""")
def N4_entry_summaries(spark, sf_dir):
    return brief.summaries(_partly_dated(spark, sf_dir))


@_query(f"""
WITH {_DATED}, {_SHAPES} SELECT graph_id, shape, n_entries, with_date FROM sh JOIN co USING (graph_id) JOIN sp USING (shape) WHERE NOT has_date AND with_date > 0""")
def N5_missing_dates(spark, sf_dir):
    entries = _partly_dated(spark, sf_dir)
    rows = profile.shapes(entries).join(profile.completeness(entries), "graph_id").join(profile.shape_profile(entries), "shape")
    return rows.where("NOT has_date AND with_date > 0").select("graph_id", "shape", "n_entries", "with_date")


@_query("""
WITH l AS (SELECT doc_id, unnest(string_split(replace(text, ', ', '   '), chr(10))) AS line FROM documents), t AS (SELECT doc_id, trim(line) AS line FROM l)
SELECT doc_id, count(*) AS n_lines, min(line) AS first_line FROM t WHERE regexp_matches(line, '^\\S.*\\s{2,}\\S') GROUP BY 1""")
def F19_table_lines(spark, sf_dir):
    lines = exprs.table_lines(F.replace(F.col("text"), F.lit(", "), F.lit("   ")))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(lines).alias("line"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.min("line").alias("first_line"))


@_query("""
WITH s AS (SELECT CAST(l_suppkey AS VARCHAR) AS a, CAST(l_partkey AS VARCHAR) AS b, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT 'supplier:' || a AS source, 'part:' || b AS target, n AS n_records FROM s""")
def H3_edge_payloads(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    row = F.struct("l_orderkey", "l_linenumber", F.monotonically_increasing_id().alias("k")).cast("string")
    edges = graph.edge_table([rows.select(node("supplier", "l_suppkey").alias("source"), node("part", "l_partkey").alias("target"), F.lit("returned").alias("edge_type"), row.alias("record_id"))], "tables")
    return edges.select("source", "target", F.size("record_ids").cast("long").alias("n_records"))
