"""Ledger records out of star-schema tables: one envelope for orders and order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def line_id() -> F.Column:
    """A text key of a whole order line (its numbered key isn't unique); no doubles in it."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    return F.concat_ws(
        "-",
        F.lit("L"),
        *("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        cents("l_quantity"),
        cents("l_extendedprice"),
        cents("l_discount"),
        cents("l_tax"),
        F.date_format("l_shipdate", "yyyyMMdd"),
        "l_returnflag",
        "l_linestatus",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as vendor postings (open) and goods receipts (finished)."""
    kind = F.when(F.col("l_linestatus") == "O", "vendor_posting").otherwise("goods_receipt")
    return read(spark, sf_dir, "lineitem").select(
        line_id().alias("record_id"),
        kind.alias("record_type"),
        F.col("l_orderkey").cast("string").alias("doc_id"),
        F.col("l_partkey").cast("string").alias("part_id"),
        F.col("l_suppkey").cast("string").alias("vendor_id"),
        F.lit(None).cast("string").alias("customer_id"),
        F.lit(None).cast("string").alias("user_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_returnflag").alias("flag"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as invoices; the order's priority plays the user who posted it."""
    return read(spark, sf_dir, "orders").select(
        F.concat_ws("-", F.lit("I"), "o_orderkey").alias("record_id"),
        F.lit("invoice").alias("record_type"),
        F.col("o_orderkey").cast("string").alias("doc_id"),
        F.lit(None).cast("string").alias("part_id"),
        F.lit(None).cast("string").alias("vendor_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderpriority").alias("user_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("o_totalprice").alias("amount"),
        F.lit(None).cast("string").alias("flag"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records, of every source, in one envelope."""
    return invoices(spark, sf_dir).unionByName(lines(spark, sf_dir))


#: The same envelope in SQL, for the oracles: named subqueries `lines`, `invoices`, `records`.
SQL = """
lines AS (
  SELECT concat_ws('-', 'L', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_quantity * 100) AS BIGINT),
                   CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT),
                   strftime(l_shipdate, '%Y%m%d'), l_returnflag, l_linestatus) AS record_id,
         CASE WHEN l_linestatus = 'O' THEN 'vendor_posting' ELSE 'goods_receipt' END AS record_type,
         CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(l_partkey AS VARCHAR) AS part_id, CAST(l_suppkey AS VARCHAR) AS vendor_id,
         CAST(NULL AS VARCHAR) AS customer_id, CAST(NULL AS VARCHAR) AS user_id, strftime(l_shipdate, '%Y-%m-%d') AS date,
         l_extendedprice AS amount, l_returnflag AS flag
  FROM lineitem
), invoices AS (
  SELECT 'I-' || o_orderkey AS record_id, 'invoice' AS record_type, CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(NULL AS VARCHAR) AS part_id,
         CAST(NULL AS VARCHAR) AS vendor_id, CAST(o_custkey AS VARCHAR) AS customer_id, o_orderpriority AS user_id,
         strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice AS amount, CAST(NULL AS VARCHAR) AS flag
  FROM orders
), records AS (SELECT * FROM invoices UNION ALL SELECT * FROM lines)
"""
