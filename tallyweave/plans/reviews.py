"""Registered queries of review findings with their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators import evidence, findings
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


#: From the rows of checks `e` to the evidence `v` that counts, and what it says of each case.
_PICKED = """
s AS (SELECT case_id, evidence_id, choice, count(*) AS n_records, first(record_id ORDER BY row, record_id) AS record_id, nullif(CAST(sum(abs(CAST(amount AS DECIMAL(18,2)))) AS DOUBLE), 0) AS amount FROM e GROUP BY ALL),
v AS (SELECT * EXCLUDE (choice) FROM s QUALIFY row_number() OVER (PARTITION BY case_id, evidence_id ORDER BY choice) = 1)"""
_COUNTED = "SELECT case_id, count(*) AS evidence_count, string_agg(evidence_id, ',' ORDER BY evidence_id) AS evidence_ids"
_RISK = "nullif(CAST(sum(abs(CAST(amount AS DECIMAL(18,2)))) AS DOUBLE), 0) AS amount_at_risk"


def _case(n: Column, letter: str = "C") -> Column:
    return F.concat(F.lit(letter), n.cast("string"))


def _evidence(found: tuple[DataFrame, DataFrame]) -> DataFrame:
    return found[0].withColumnRenamed("case", "case_id")


def _told(found: tuple[DataFrame, DataFrame]) -> DataFrame:
    return found[1].withColumnRenamed("case", "case_id").withColumn("evidence_ids", F.array_join("evidence_ids", ","))


_VENDORS = f"""
WITH {RECORDS}, p AS (SELECT DISTINCT vendor_id AS case_id, record_id, CAST(doc_id AS BIGINT) AS row, CASE WHEN part_id LIKE '%1' AND CAST(vendor_id AS BIGINT) % 5 = 0 THEN round(amount / 10) * 10 ELSE amount END AS amount,
  CASE WHEN flag = 'R' AND CAST(vendor_id AS BIGINT) % 2 = 0 THEN 'Zahlung' ELSE 'RE' END AS kind FROM lines WHERE record_type = 'vendor_posting'),
c AS (SELECT CAST(s_suppkey AS VARCHAR) AS case_id, 'M' || s_suppkey AS record_id, CAST(s_suppkey AS BIGINT) AS row, 'U' || s_nationkey AS user FROM supplier WHERE s_suppkey % 4 < 2),
a AS (SELECT 'P' || n_nationkey AS record_id, CAST(n_nationkey AS BIGINT) AS row, CASE WHEN n_nationkey = 20 THEN ' ' ELSE 'rolle-u' || n_nationkey || 'x' END AS field FROM nation),
b AS (SELECT c.case_id, a.record_id, a.row FROM c JOIN a ON contains(field, lower(c.user)) OR trim(field) = '' QUALIFY row_number() OVER (PARTITION BY c.case_id ORDER BY a.row) = 1),
t AS (SELECT p.*, row_number() OVER (PARTITION BY case_id ORDER BY row, record_id) AS k FROM p WHERE case_id IN (SELECT case_id FROM c)),
e AS (SELECT case_id, 'E1-1' AS evidence_id, 1 AS choice, record_id, row, amount FROM p WHERE amount <> 0 AND CAST(amount AS DECIMAL(18,2)) % 10 = 0
  UNION ALL SELECT case_id, 'E1-2', 1, record_id, row, NULL FROM c
  UNION ALL SELECT case_id, 'E1-3', 1, record_id, row, amount FROM p WHERE case_id NOT IN (SELECT vendor_id FROM lines WHERE record_type = 'goods_receipt' AND CAST(vendor_id AS BIGINT) % 3 <> 0)
  UNION ALL SELECT case_id, 'E1-4', 1, record_id, row, NULL FROM b
  UNION ALL SELECT case_id, 'E1-5', 1, record_id, row, amount FROM t WHERE kind = 'Zahlung' UNION ALL SELECT case_id, 'E1-5', 2, record_id, row, amount FROM t WHERE k <= 3), {_PICKED}"""


def _vendors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = tables.lines(spark, sf_dir)
    n = F.col("vendor_id").cast("long")
    row = F.struct(F.col("doc_id").cast("long").alias("row"), "record_id").alias("place")
    amount = F.when(F.endswith("part_id", F.lit("1")) & (n % 5 == 0), F.round(F.col("amount") / 10) * 10).otherwise(F.col("amount"))
    kind = F.when((F.col("flag") == "R") & (n % 2 == 0), "Zahlung").otherwise("RE")
    postings = lines.where("record_type = 'vendor_posting'").select(F.col("vendor_id").alias("case"), "record_id", row, amount.alias("amount"), kind.alias("kind")).distinct()
    own = F.concat(F.lit("U"), "s_nationkey")
    changes = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("case"), F.concat(F.lit("M"), "s_suppkey").alias("record_id"), F.struct(F.col("s_suppkey").cast("long").alias("row"), F.concat(F.lit("M"), "s_suppkey").alias("record_id")).alias("place"),
        own.alias("changed_by"), F.when(F.col("s_suppkey") % 4 < 2, own).otherwise("U99").alias("approved_by"),
    )
    receipts = lines.where((F.col("record_type") == "goods_receipt") & (n % 3 != 0)).select(F.col("vendor_id").alias("case"))
    field = F.when(F.col("n_nationkey") == 20, " ").otherwise(F.concat(F.lit("Rolle-U"), "n_nationkey", F.lit("x")))
    name = F.concat(F.lit("P"), "n_nationkey").alias("record_id")
    permissions = read(spark, sf_dir, "nation").select(name, F.struct(F.col("n_nationkey").cast("long").alias("row"), name).alias("place"), field.alias("user_field"))
    return findings.shell_vendor_evidence(postings, changes, receipts, permissions)


@_query(f"{_VENDORS} SELECT * FROM v")
def R1_evidence(spark, sf_dir):
    return _evidence(_vendors(spark, sf_dir))


@_query(f"{_VENDORS}, r AS (SELECT case_id, {_RISK} FROM p GROUP BY 1), f AS ({_COUNTED} FROM v GROUP BY 1) SELECT f.*, CASE WHEN evidence_count >= 3 THEN 'high' ELSE 'medium' END AS confidence, amount_at_risk FROM f LEFT JOIN r USING (case_id)")
def R1_findings(spark, sf_dir):
    return _told(_vendors(spark, sf_dir))


_REPAIRS = f"""
WITH {RECORDS}, a AS (SELECT 'C' || p_partkey % 50 AS case_id, CAST(p_partkey AS VARCHAR) AS asset_id, 'A' || p_partkey AS record_id, CAST(p_partkey AS BIGINT) AS row, CASE WHEN p_partkey % 150 = 7 THEN p_name || ' REPARATUR' WHEN p_partkey % 50 = 9 THEN 'Austausch' ELSE p_name END AS name FROM part),
q AS (SELECT * FROM a WHERE name LIKE '%REPARATUR' OR name = 'Austausch'), l AS (SELECT DISTINCT 'C' || CAST(part_id AS BIGINT) % 50 AS case_id, part_id, record_id, CAST(doc_id AS BIGINT) AS row, amount FROM lines WHERE CAST(part_id AS BIGINT) % 100 <> 9),
j AS (SELECT 'C' || o_orderkey % 50 AS case_id, count(*) AS spent FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 50 <> 7 GROUP BY 1),
e AS (SELECT case_id, 'E2-1' AS evidence_id, 1 AS choice, record_id, row, NULL AS amount FROM q UNION ALL SELECT l.case_id, 'E2-2', 1, l.record_id, l.row, amount FROM l WHERE (case_id, part_id) IN (SELECT (case_id, asset_id) FROM q)
  UNION ALL SELECT case_id, 'E2-3', 1, record_id, row, NULL FROM q), {_PICKED}"""


def _repairs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    key = F.col("p_partkey")
    name = F.when(key % 150 == 7, F.concat("p_name", F.lit(" REPARATUR"))).when(key % 50 == 9, "Austausch").otherwise(F.col("p_name"))
    own = F.concat(F.lit("A"), key).alias("record_id")
    assets = read(spark, sf_dir, "part").select(_case(key % 50).alias("case"), key.cast("string").alias("asset_id"), own, F.struct(key.cast("long").alias("row"), own).alias("place"), name.alias("name"))
    n = F.col("part_id").cast("long")
    postings = tables.lines(spark, sf_dir).where(n % 100 != 9).select(_case(n % 50).alias("case"), F.col("part_id").alias("asset_id"), "record_id", F.struct(F.col("doc_id").cast("long").alias("row"), "record_id").alias("place"), "amount").distinct()
    account = F.when(F.col("o_orderkey") % 50 == 7, F.lit(None)).when(F.col("o_custkey") % 3 == 0, "670000").otherwise("440000")
    journal = read(spark, sf_dir, "orders").select(_case(F.col("o_orderkey") % 50).alias("case"), account.alias("account"))
    return findings.repair_evidence(assets, postings, journal)


@_query(f"{_REPAIRS} SELECT case_id, evidence_id, CASE WHEN evidence_id = 'E2-3' THEN coalesce(spent, 0) ELSE n_records END AS n_records, record_id, amount FROM v LEFT JOIN j USING (case_id)")
def R2_evidence(spark, sf_dir):
    return _evidence(_repairs(spark, sf_dir))


@_query(f"{_REPAIRS}, f AS ({_COUNTED}, max(amount) AS amount_at_risk FROM v GROUP BY 1) SELECT case_id, evidence_count, evidence_ids, CASE WHEN evidence_count >= 2 THEN 'high' ELSE 'medium' END AS confidence, amount_at_risk FROM f")
def R2_findings(spark, sf_dir):
    return _told(_repairs(spark, sf_dir))


_CUT_OFF = f"""
WITH {RECORDS}, i AS (SELECT 'C' || o_custkey % 400 AS case_id, 'I' || o_orderkey AS record_id, CAST(o_orderkey AS BIGINT) AS row, strftime(o_orderdate + INTERVAL 20 DAY, '%d.%m.%Y') AS booked, strftime(o_orderdate, '%Y-%m-%d') AS served, o_totalprice AS amount FROM orders),
late AS (SELECT * FROM i WHERE (booked LIKE '%01.1997' AND served LIKE '1996-12%') OR (booked NOT LIKE '%01.1997' AND booked LIKE '%12.1996')), k AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY row) <= 5),
g AS (SELECT DISTINCT 'C' || CAST(vendor_id AS BIGINT) % 400 AS case_id, record_id, CAST(doc_id AS BIGINT) AS row, amount FROM lines WHERE record_type = 'goods_receipt' AND date LIKE '1996-12%'),
j AS (SELECT 'C' || o_custkey % 400 AS case_id, 'J' || o_orderkey AS record_id, CAST(o_orderkey AS BIGINT) AS row, o_orderdate >= TIMESTAMP '1996-12-01' AND o_orderdate < TIMESTAMP '1997-01-01' AS own FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0),
e AS (SELECT case_id, 'E3-1' AS evidence_id, 1 AS choice, record_id, row, amount FROM late UNION ALL SELECT case_id, 'E3-1', 2, record_id, row, amount FROM k UNION ALL SELECT case_id, 'E3-2', 1, record_id, row, amount FROM g
  UNION ALL SELECT case_id, 'E3-3', 1, record_id, row, amount FROM late UNION ALL SELECT case_id, 'E3-3', 2, record_id, row, amount FROM k UNION ALL SELECT case_id, 'E3-4', 1, record_id, row, NULL FROM j WHERE NOT own),
m AS (SELECT case_id, count(*) AS made FROM j WHERE own GROUP BY 1), {_PICKED}"""


def _cut_off(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    orders, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    case = _case(F.col("o_custkey") % 400).alias("case")
    named = lambda letter: F.concat(F.lit(letter), key).alias("record_id")
    placed = lambda letter: F.struct(key.cast("long").alias("row"), named(letter)).alias("place")
    invoices = orders.select(case, named("I"), placed("I"), F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 20 DAYS"), "dd.MM.yyyy").alias("booked"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("served"), F.lit(None).cast("string").alias("date"), F.col("o_totalprice").alias("amount"))
    receipts = tables.lines(spark, sf_dir).where("record_type = 'goods_receipt'").select(_case(F.col("vendor_id").cast("long") % 400).alias("case"), "record_id", F.struct(F.col("doc_id").cast("long").alias("row"), "record_id").alias("place"), "date", "amount").distinct()
    text = F.when(key % 11 == 0, "Auflösung RÜCKSTELLUNG").when(key % 13 == 0, "arap 1").when(key % 17 == 0, F.lit(None)).otherwise("Miete")
    journal = orders.select(case, named("J"), placed("J"), text.alias("text"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return findings.cut_off_evidence(invoices, receipts, journal, "1997-01", "1996-12")


@_query(f"{_CUT_OFF} SELECT case_id, evidence_id, CASE WHEN evidence_id = 'E3-3' THEN coalesce(made, 0) ELSE n_records END AS n_records, record_id, amount FROM v LEFT JOIN m USING (case_id)")
def R3_evidence(spark, sf_dir):
    return _evidence(_cut_off(spark, sf_dir))


@_query(f"{_CUT_OFF}, f AS ({_COUNTED}, max(amount) FILTER (WHERE evidence_id = 'E3-1') AS amount_at_risk FROM v GROUP BY 1) SELECT case_id, evidence_count, evidence_ids, CASE WHEN evidence_count >= 3 THEN 'high' ELSE 'medium' END AS confidence, amount_at_risk FROM f")
def R3_findings(spark, sf_dir):
    return _told(_cut_off(spark, sf_dir))


_SPLITS = f"""
WITH o AS (SELECT 'C' || o_custkey AS case_id, 'J' || o_orderkey AS record_id, CAST(o_orderkey AS BIGINT) AS row, o_totalprice % 20000 AS amount, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE strftime(o_orderdate, '%Y') END AS date, o_orderstatus AS counter FROM orders WHERE o_orderkey % 4 < 3),
n AS (SELECT * FROM o WHERE amount >= 9000 AND amount < 10000),
g AS (SELECT case_id, date, counter, sum(CAST(amount AS DECIMAL(18,2))) AS combined FROM n GROUP BY ALL HAVING count(*) >= 2), b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY combined DESC, date, counter) = 1),
w AS (SELECT n.*, combined FROM n JOIN b USING (case_id, date, counter)), h AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY amount DESC, row, record_id) AS k FROM n),
d AS (SELECT 'C' || n_nationkey % 7 AS case_id, 'D' || n_nationkey AS record_id, CAST(n_nationkey AS BIGINT) AS row FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 5 = 1),
e AS (SELECT case_id, 'E4-1' AS evidence_id, 1 AS choice, record_id, row, amount FROM w UNION ALL SELECT case_id, 'E4-1', 2, record_id, k, amount FROM h WHERE k <= 3
  UNION ALL SELECT case_id, 'E4-3', 1, record_id, row, amount FROM w WHERE combined >= 10000 UNION ALL SELECT case_id, 'E4-2', 1, record_id, row, NULL FROM d QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY row) = 1), {_PICKED}"""


def _splits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    key = F.col("o_orderkey")
    own = F.concat(F.lit("J"), key).alias("record_id")
    text = F.when(key % 4 == 0, "Zahlung Rechnung").when(key % 4 == 1, "beleg za 12").when(key % 4 == 2, "Überweisung").otherwise("ZAHL")
    journal = read(spark, sf_dir, "orders").select(
        _case(F.col("o_custkey")).alias("case"), own, F.struct(key.cast("long").alias("row"), own).alias("place"), (F.col("o_totalprice") % 20000).alias("amount"), text.alias("text"),
        F.when(key % 9 != 0, F.date_format("o_orderdate", "yyyy")).alias("date"), F.col("o_orderstatus").alias("counter"),
    )
    n = F.col("n_nationkey")
    name = F.concat(F.lit("D"), n).alias("record_id")
    documents = read(spark, sf_dir, "nation").select(
        _case(n % 7).alias("case"), name, F.struct(n.cast("long").alias("row"), name).alias("place"), F.when(n % 3 == 0, "/x/Prüfungsplanung.docx").alias("path"), F.when(n % 5 == 1, "ab 10.000 EUR").alias("text"),
    )
    return findings.split_payment_evidence(journal, documents)


@_query(f"{_SPLITS} SELECT * FROM v")
def R4_evidence(spark, sf_dir):
    return _evidence(_splits(spark, sf_dir))


@_query(f"{_SPLITS}, r AS (SELECT case_id, CAST(sum(combined) AS DOUBLE) AS amount_at_risk FROM g GROUP BY 1), f AS ({_COUNTED} FROM v GROUP BY 1) SELECT f.*, CASE WHEN amount_at_risk IS NULL THEN 'medium' ELSE 'high' END AS confidence, amount_at_risk FROM f LEFT JOIN r USING (case_id)")
def R4_findings(spark, sf_dir):
    return _told(_splits(spark, sf_dir))


_PROPOSED = f"""
WITH {RECORDS}, d AS (SELECT DISTINCT record_id, doc_id, amount FROM records), p AS (SELECT doc_id, list_sort(list(record_id)) AS ids FROM d GROUP BY 1 HAVING max(abs(amount)) > 150000 AND CAST(doc_id AS BIGINT) % 10 <> 3),
h AS (SELECT *, 'AI-' || left(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('tables|' || array_to_string(ids, '|'))), 12) AS finding_id FROM p)"""


def _proposed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Entries of large amounts as proposals that cite their records from the last one on; some cite an
    unknown one too and fall away."""
    records = tables.records(spark, sf_dir).select("record_id", "doc_id", "amount")
    large = records.repartition("doc_id").distinct().groupBy("doc_id").agg(F.max(F.abs("amount")).alias("most"), F.array_sort(F.collect_list("record_id")).alias("ids")).where("most > 150000")
    unknown = F.when(F.col("doc_id").cast("long") % 10 == 3, F.array(F.lit("nowhere"))).otherwise(F.array().cast("array<string>"))
    return evidence.findings(large.select("doc_id", F.concat(F.reverse("ids"), unknown).alias("record_ids")), records.select("record_id", "amount"), "tables")


@_query(f"{_PROPOSED} SELECT finding_id, doc_id, len(ids) AS evidence_count FROM h")
def N9_findings(spark, sf_dir):
    return _proposed(spark, sf_dir)[0]


@_query(f"""{_PROPOSED}, c AS (SELECT finding_id, unnest(list_reverse(ids)) AS record_id, generate_subscripts(ids, 1) AS position FROM h)
SELECT finding_id, finding_id || '-E' || position AS evidence_id, CAST(position AS INTEGER) AS position, record_id, amount FROM c JOIN d USING (record_id)""")
def N9_finding_evidence(spark, sf_dir):
    return _proposed(spark, sf_dir)[1]
