"""Cutting spans out of texts, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    """Tells rows with one doc_id but different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(text: Column, spans: Column) -> Column:
    """`text` without `spans`: an array of (start, end) code point places, which may overlap."""
    kept = F.aggregate(  # one pass: what was kept so far, and the place that was reached
        F.array_sort(spans),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))),
    )
    return F.when(F.coalesce(F.size(spans), F.lit(0)) < 1, text).otherwise(kept)


def cut_out(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`docs` with the spans of `found` (doc_id, text_hash, start, end) cut from their texts
    and n_chars brought up to date. Other columns stay, whatever their names are."""
    place = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    spans = found.groupBy(F.col("doc_id").cast("long").alias("doc"), F.col("text_hash").alias("hash")).agg(F.collect_set(place).alias("spans"))
    # the row is packed, so no name of its columns can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc"), text_hash(F.col("text")).alias("hash"))
    rows = rows.join(spans, ["doc", "hash"], "left").select("row", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(without(F.col("row.text"), F.col("spans"))).alias("text"))
    return with_text(rows, docs)


def with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` from rows of (row, text): its new text, and n_chars as it is now."""
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
