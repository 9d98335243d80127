"""Registered queries that read export files: the tables are written as files by Spark first.

A file holds the orders of a range of 4,096 keys, so files are bounded and their number grows with the
table. They are read by small ranges, many of each file, which tasks take by the dozen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.functions import exprs
from tallyweave.operators import envelope, preview
from tallyweave.plans.ledgers import _JOURNAL as JOURNAL_SQL
from tallyweave.plans.ledgers import _journal as journal_rows
from tallyweave.shared import new_folder
from tallyweave.sources import delimited, files
from tallyweave.sources.tables import read

_QUERIES, _SQL = {}, {}
FILE = 4096


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


def _files(rows: DataFrame, key: str, line: Column, name: str, header: str | None = None) -> str:
    """Writes a line for each row, in the order of `key`, to files of FILE keys each; returns their folder."""
    folder = new_folder(rows.sparkSession, name)
    part = F.floor(F.col(key) / FILE)
    own = rows.select(part.alias("part"), F.col(key).alias("key"), line.alias("value")).repartition("part").sortWithinPartitions("part", "key", "value")
    if header is not None:
        first = F.row_number().over(Window.partitionBy("part").orderBy("key", "value")) == 1
        own = own.withColumn("value", F.when(first, F.concat(F.lit(header + "\n"), "value")).otherwise(F.col("value")))
    own.select("part", "value").write.partitionBy("part").text(folder)
    return folder


#: Bytes of a range: each file has many.
RANGE = "16k"


def _text(c: str) -> Column:
    return F.col(c).cast("string")


_NUMBERED = """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey // 4096 ORDER BY o_orderkey) AS own, sum(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderkey // 4096 ORDER BY o_orderkey) AS blanks FROM orders)"""


def _blank_before(line: Column) -> Column:
    """Orders whose key is divisible by five have a blank line before them."""
    return F.concat(F.when(F.col("o_orderkey") % 5 == 0, "\n").otherwise(""), line)


@_query(f"""{_NUMBERED} SELECT o_orderkey, CAST(own + blanks AS INTEGER) AS row_number, strftime(o_orderdate, '%d.%m.%Y') AS booked,
  'Auftrag "' || o_orderpriority || '";' || chr(10) || 'Kunde ' || o_custkey AS said, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status FROM o""")
def S4_split_ledger(spark, sf_dir):
    """Ledgers without a header: quoted cells with separators, quotes and line breaks, short rows."""
    said = F.concat(F.lit('"Auftrag ""'), "o_orderpriority", F.lit('"";\nKunde '), _text("o_custkey"), F.lit('"'))
    status = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit(";"), "o_orderstatus"))
    line = _blank_before(F.concat(_text("o_orderkey"), F.lit(";"), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(";"), said, status))
    folder = _files(read(spark, sf_dir, "orders"), "o_orderkey", line, "ledger")
    rows = delimited.scan(spark, folder, {"*": ["SCHLUESSEL", "BUCHUNGSDATUM", "BUCHUNGSTEXT", "STATUS"]}, RANGE)
    cell = lambda name: F.try_element_at("data", F.lit(name))
    return rows.select(cell("SCHLUESSEL").cast("long").alias("o_orderkey"), "row_number", cell("BUCHUNGSDATUM").alias("booked"), cell("BUCHUNGSTEXT").alias("said"), cell("STATUS").alias("status"))


@_query(f"""{_NUMBERED} SELECT o_orderkey, CAST(own + blanks + 1 AS INTEGER) AS row_number, CASE WHEN o_orderkey % 2 = 0 THEN 'é,' || chr(10) || chr(10) || '5" ' || o_orderpriority ELSE '5" ' || o_orderpriority END AS clerk,
  'KONTO|TEXT|WERT' AS columns FROM o""")
def S5_split_csv(spark, sf_dir):
    """CSV files with a header: commas, stray quotes, line breaks and letters that aren't ASCII."""
    quoted = F.concat(F.lit('"é,\n\n5"" '), "o_orderpriority", F.lit('"'))
    clerk = F.when(F.col("o_orderkey") % 2 == 0, quoted).otherwise(F.concat(F.lit('5" '), "o_orderpriority"))
    line = _blank_before(F.concat(_text("o_orderkey"), F.lit(","), clerk, F.lit(",x,too many")))
    folder = _files(read(spark, sf_dir, "orders"), "o_orderkey", line, "csv", "KONTO,TEXT,WERT")
    rows = delimited.scan(spark, folder, ranges=RANGE)
    return rows.select(F.col("data")["KONTO"].cast("long").alias("o_orderkey"), "row_number", F.col("data")["TEXT"].alias("clerk"), F.array_join("columns", "|").alias("columns"))


@_query("""
WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
c AS (SELECT doc_id, k, string_split(line, ' ') AS cells, list_filter(list_transform(string_split(line, ' '), lambda x: trim(x)), lambda x: x <> '') AS full_ FROM r WHERE k < 15),
h AS (SELECT doc_id, k FROM c WHERE len(full_) >= 2 AND len(full_) >= 0.5 * len(cells) AND len(list_filter(full_, lambda x: NOT regexp_matches(x, '^-?[0-9.,]+$'))) >= 0.8 * len(full_) AND len(list_distinct(full_)) >= 0.8 * len(full_))
SELECT doc_id, CAST(min(h.k) AS INTEGER) AS header FROM documents LEFT JOIN h USING (doc_id) GROUP BY doc_id""")
def P12_header_rows(spark, sf_dir):
    """Each document is a sheet, its lines are rows and its words cells."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sheet"), F.posexplode(F.split("text", "\n")).alias("k", "line"))
    found = preview.header_rows(rows.select("sheet", "k", F.split("line", " ").alias("cells")))
    return found.withColumnRenamed("sheet", "doc_id")


_KINDS = ", ".join(f"'{k}'" for k in files.MIME)
_TYPES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in files.MIME.items())


@_query(f"WITH p AS (SELECT p_partkey, [{_KINDS}, '', '.TMP'][p_partkey % {len(files.MIME) + 2} + 1] AS ext FROM part) SELECT p_partkey, CASE ext {_TYPES} ELSE 'application/octet-stream' END AS mime FROM p")
def P2_file_types(spark, sf_dir):
    """The types of the export's own files, whatever the case of their names."""
    ends = F.array(*[F.lit(k.upper() if i % 2 else k) for i, k in enumerate([*files.MIME, "", ".TMP"])])
    path = F.concat(F.lit("a.b/"), "p_name", F.get(ends, (F.col("p_partkey") % (len(files.MIME) + 2)).cast("int")))
    return read(spark, sf_dir, "part").select("p_partkey", exprs.mime_type(path, files.MIME).alias("mime"))


@_query(f"WITH {JOURNAL_SQL} SELECT row_number, coalesce(user, writer) AS user_id FROM j")
def W5_first_user_of_record(spark, sf_dir):
    """The first user among a record's entities, by their order in it."""
    rows = envelope.ledger_records(journal_rows(spark, sf_dir), "d").select("row_number", F.posexplode_outer("entities").alias("k", "e"))  # outer as in entity_rows
    return rows.where("e.entity_type = 'user'").groupBy("row_number").agg(F.min_by("e.entity_id", "k").alias("user_id"))


@_query("""
WITH f AS (SELECT CAST(n_nationkey AS BIGINT) AS file FROM nation UNION ALL SELECT 99), r AS (SELECT c_nationkey AS file, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, c_name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS saldo FROM customer WHERE c_nationkey % 7 <> 6),
s AS (SELECT file, count(*) AS total, string_agg(CASE WHEN file % 3 = 0 THEN 'Kunde ' || c_name ELSE c_name || ';' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE saldo END END, chr(10) ORDER BY k) FILTER (WHERE k > 1 AND k <= 4) AS rows FROM r GROUP BY 1)
SELECT file, CASE WHEN total IS NULL THEN 'empty' WHEN file % 3 = 0 THEN 'text' ELSE 'table' END AS kind, CASE WHEN total IS NULL OR file % 3 = 0 THEN '' ELSE 'NAME;SALDO' END AS headers, coalesce(total, 0) AS total, coalesce(rows, '') AS rows FROM f LEFT JOIN s USING (file)""")
def K3_previews(spark, sf_dir):
    """A file for each nation: tables, running text, or nothing; a page of three rows after the first."""
    rows = read(spark, sf_dir, "customer").where("c_nationkey % 7 <> 6")
    text, name = F.col("c_nationkey") % 3 == 0, F.col("c_name")
    saldo = F.when(F.col("c_custkey") % 2 != 0, F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    rows = rows.select(
        F.col("c_nationkey").cast("long").alias("path"), F.col("c_custkey").alias("row_number"), F.when(text, F.array().cast("array<string>")).otherwise(F.array(F.lit("NAME"), F.lit("SALDO"))).alias("columns"),
        F.create_map(F.lit("NAME"), name, F.lit("SALDO"), saldo).alias("data"), F.when(text, F.concat(F.lit("Kunde "), name)).alias("text"),
    )
    paths = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("path")).unionByName(spark.range(99, 100).select(F.col("id").alias("path")))
    found = preview.previews(paths, rows, 3, 1)
    lines = F.array_join(F.transform(F.coalesce("rows", F.array().cast("array<array<string>>")), lambda r: F.array_join(r, ";")), "\n")
    return found.select(F.col("path").alias("file"), "kind", F.array_join("headers", ";").alias("headers"), "total", lines.alias("rows"))


@_query(f"""
WITH {JOURNAL_SQL}, t AS (SELECT c_custkey, strftime(DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER), '%Y-%m-%d') AS day, CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM customer),
c AS (SELECT s_suppkey, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM supplier),
n AS (SELECT 'posted_by' AS edge_type, 'user:' || coalesce(user, writer) AS target FROM j UNION ALL SELECT 'to_account', 'account:' || other FROM j
  UNION ALL SELECT 'references', 'user:MV-U' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') FROM t UNION ALL SELECT 'received_from', 'vendor:' || s_suppkey FROM c)
SELECT edge_type, target, count(*) AS n_edges FROM n GROUP BY ALL""")
def S10_files_to_edges(spark, sf_dir):
    """Rows of ledgers, CSV files and documents become records of one envelope, and these edges."""
    said = F.concat(F.lit("Freigabe durch MV-U"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit(" am 1.2.2024 über EUR 5,00"))
    none = F.lit(None).cast("string")
    place = [none.alias("sheet"), F.col("c_custkey").cast("int").alias("row_number")]
    documents = read(spark, sf_dir, "customer").select(F.lit("/in/Vermerk.docx").alias("path"), *place, F.array().cast("array<string>").alias("columns"), F.create_map().cast("map<string,string>").alias("data"), said.alias("text"))
    key = F.col("s_suppkey").cast("string")
    folder = _files(read(spark, sf_dir, "supplier"), "s_suppkey", F.concat(key, F.lit(";"), F.translate(F.format_number("s_acctbal", 2), ",.", ".,")), "vendors", "LIEFERANT;BETRAG")
    both = delimited.scan(spark, folder, ranges=RANGE)
    rows = journal_rows(spark, sf_dir).unionByName(documents).unionByName(both.withColumn("path", F.concat("path", F.lit(".csv"))))
    edges = envelope.entity_edges(envelope.records(rows, "d")).select("edge_type", F.expr("substr(target, 8)").alias("target"), "source")
    kinds = (F.col("edge_type") != "references") | F.startswith("target", F.lit("user:MV-"))
    return edges.where(kinds).groupBy("edge_type", "target").agg(F.count("*").alias("n_edges"))


@_query("""
WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN left(props, length(props) - 1) WHEN 1 THEN '[1]' WHEN 2 THEN NULL ELSE props END AS p FROM events)
SELECT event_id, CASE WHEN json_valid(p) AND p LIKE '{%' THEN json_extract_string(p, '$.k') END AS k, CASE WHEN json_valid(p) AND p LIKE '{%' THEN 1 ELSE 0 END AS n FROM t""")
def D10_json_or_nothing(spark, sf_dir):
    """Payloads that are no JSON objects count as empty."""
    kind, props = F.col("event_id") % 5, F.col("props")
    text = F.when(kind == 0, F.left(props, F.char_length(props) - 1)).when(kind == 1, "[1]").when(kind != 2, props)
    data = exprs.json_map(text)
    return read(spark, sf_dir, "events").select("event_id", F.try_element_at(data, F.lit("k")).alias("k"), F.size(data).alias("n"))
