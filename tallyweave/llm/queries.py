"""The queries of this folder, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import fingerprints, html, linededup, neardups, packing, passages, personal, pieces, quality, search, tokenfiles, topk, turns
from tallyweave.shared import new_folder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    kept = linededup.dedup_lines(docs.withColumn("chars_before", F.char_length("text").cast("long")))
    return kept.select("doc_id", "text", "n_chars", (F.col("chars_before") - F.col("n_chars")).alias("removed_chars"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.decode(pieces.encode(_read(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        F.col("_evidence").alias("evidence"),
        F.col("_host_share").alias("host_share"),
        F.col("_path_share").alias("path_share"),
        F.col("_posterior").alias("posterior"),
        (F.col("_posterior") >= quality.KEEP).cast("int").alias("keep"),
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write(_read(spark, sf_dir, "documents"), new_folder(spark, "token-ids"), end=2)
    return tokenfiles.read(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut(_read(spark, sf_dir, "documents")))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html.extract(_read(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_read(spark, sf_dir, "documents")).drop("text_hash")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = fingerprints.fingerprint_edits(_read(spark, sf_dir, "documents"))
    return edits.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardups.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("rep").alias("copy_of"), "class_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=10)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.personal_data(_read(spark, sf_dir, "documents"))
    counts = [personal.count(F.col("base"), k).alias(f"n_{k}") for k in personal.KINDS]
    every = personal.in_order(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(personal.as_text(F.col("base")), 256).alias("base_sha256"), personal.as_text(every).alias("spans"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    return turns.report(turns.damaged(rows), rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_sentencepiece, op3_quality, op4_token_files, op5_best_fit_packing, op6_html_text, op7_substring_dedup, op8_exact_top_k, op9_fingerprints, op10_near_duplicates, op11_ranked_search, op12_personal_data, op13_conversation_repair)}


#: The terms of a text column, for DuckDB.
_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op11_ranked_search": f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents
), total AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0
), tf AS (
  SELECT row, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d) GROUP BY row, doc_id, n, term
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, total GROUP BY term, n_docs
), q AS (
  SELECT row_number() OVER () AS query, item_id, list_distinct({_TERMS}) AS terms FROM benchmark
), asked AS (
  SELECT query, item_id, unnest(terms) AS term FROM q
), scores AS (
  SELECT query, item_id, row, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term), total GROUP BY query, item_id, row, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id, row) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""",
        "op8_exact_top_k": """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row AS query_row, c.row AS row, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.row <> q.row
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, row) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    }
