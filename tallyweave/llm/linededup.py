"""Removal of runs of lines that the corpus repeats.

A rolling hash over the hashes of neighbouring lines chooses where chunks of lines end, so
the cuts depend on the lines around them and not on their place: inserted lines shift the
chunks after them without changing them. Chunks of two lines and more are grouped by a
128-bit hash; all but the first of a group (by doc_id, then text hash, then place) are
candidates, and one is removed if its bytes equal those of the first.

Edge cases: null and empty texts stay as they are; texts of one line have no chunk of
several lines and stay; rows without doc_id stay; the same row given twice counts as one
and stays twice; columns of any other name may stand beside. The line break at the end of the last line doesn't count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.spans import text_hash, with_text, without
from tallyweave.llm.ragged import tidy
from tallyweave.session import ship
from tallyweave.shared import Tables
from tallyweave.skew import salted_join

#: Lines that the rolling hash covers; one in DIVISOR places is a cut; least and most lines of a chunk.
WINDOW, DIVISOR, LEAST, MOST = 2, 3, 2, 32
BASE = 0x100000001B3
KEY, PLACE = ["doc_id", "text_hash", "chunk"], ["chunk", "start", "end", "lines"]


def chunks(text: str) -> list[tuple[int, int, int]]:
    """(start, end, lines) of the chunks of a text; the end excludes the last line break."""
    lines = text.split("\n")
    if len(lines) < LEAST:
        return [(0, len(text), len(lines))] if text else []
    hashes = [xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")) for line in lines]
    lead = pow(BASE, WINDOW, 1 << 64)
    out, rolling, start, at, n = [], 0, 0, 0, 0
    for i, line in enumerate(lines):
        rolling = (rolling * BASE + hashes[i]) & 0xFFFFFFFFFFFFFFFF
        if i >= WINDOW:
            rolling = (rolling - hashes[i - WINDOW] * lead) & 0xFFFFFFFFFFFFFFFF
        at += len(line) + 1
        n += 1
        if n == MOST or n >= LEAST and ((rolling * 0x9E3779B97F4A7C15) >> 40 & 0xFFFFFF) % DIVISOR == 0:
            out.append((start, at - 1, n))
            start, n = at, 0
    if n:
        out.append((start, at - 1, n))
    return out


def _rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), "text"
    )


def chunk_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, chunk, start, end, lines, h1, h2 of the chunks of several lines."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            found, h1, h2 = [], [], []
            for r, text in enumerate(b.column(2).to_pylist()):
                if "\n" not in text:
                    continue
                for k, (start, end, n) in enumerate(chunks(text)):
                    if n >= LEAST:
                        h = xxhash.xxh3_128_digest(text[start:end].encode("utf-8", "replace"))
                        found.append((r, k, start, end, n))
                        h1.append(h[:8])
                        h2.append(h[8:])
            row, *places = zip(*found, strict=True) if found else [()] * 5
            at = pa.array(row, pa.int64())
            halves = [pa.array(np.frombuffer(b"".join(h), "<i8")) for h in (h1, h2)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(x, pa.int32()) for x in places), *halves], ["doc_id", "text_hash", *PLACE, "h1", "h2"])

    return _rows(docs).mapInArrow(tidy(run), "doc_id long, text_hash long, chunk int, start int, end int, lines int, h1 long, h2 long")


def repeated_chunks(docs: DataFrame, tables: Tables) -> DataFrame:
    """doc_id, text_hash, chunk, start, end, lines and `first` (the same fields) of every chunk
    whose hash came before."""
    made = tables.write(chunk_hashes(docs), "chunk-hashes")
    place = F.struct(*KEY, *PLACE[1:])
    firsts = made.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    firsts = tables.write(firsts, "chunk-firsts")
    again = salted_join(made, firsts.drop("n"), ["h1", "h2"], KEY, firsts).where(place != F.col("first")).select(*KEY, *PLACE[1:], "first").distinct()
    again = tables.write(again, "chunks-again")
    tables.drop("chunk-hashes", "chunk-firsts")
    return again


def unequal(spanned: DataFrame, again: DataFrame) -> DataFrame:
    """Those of `again` whose bytes aren't those of the first chunk with their hash.
    spanned: doc_id, text, and _spans with the places of all chunks that count."""
    ship(spanned.sparkSession)
    texts = spanned.where(F.col("_spans").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), "text", "_spans")

    def run(batches):
        for b in batches:
            found = [
                (doc, h, s["chunk"], text[s["start"] : s["end"]].encode("utf-8", "replace"))
                for doc, h, text, spans in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)
                for s in spans
            ]
            columns = zip(*found, strict=True) if found else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*KEY, "bytes"])

    own = texts.mapInArrow(tidy(run), "doc_id long, text_hash long, chunk int, bytes binary").dropDuplicates(KEY)
    first = own.select(*(F.col(c).alias(f"f_{c}") for c in KEY), F.col("bytes").alias("f_bytes"))
    pairs = again.select(*KEY, *(F.col(f"first.{c}").alias(f"f_{c}") for c in KEY))
    return salted_join(pairs, first, [f"f_{c}" for c in KEY], KEY).join(own, KEY).where(F.col("bytes") != F.col("f_bytes")).select(*KEY)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`docs` without repeated chunks of lines; n_chars follows.

    Texts are shuffled once, to the places of their chunks. The rows are then written with
    these, so that the comparison of bytes and the cut both read them where they are. A
    candidate whose bytes differ (no 128-bit hashes are known to) takes a join of its own."""
    tables = Tables(docs.sparkSession)
    again = repeated_chunks(docs, tables)
    span = lambda chunk, cut: F.struct(*(chunk(c).alias(c) for c in ("start", "end", "chunk")), F.lit(cut).alias("cut"))
    own = again.select("doc_id", "text_hash", span(F.col, True).alias("_span"))
    first = again.select("first.doc_id", "first.text_hash", span(lambda c: F.col(f"first.{c}"), False).alias("_span")).distinct()
    spans = own.unionByName(first).groupBy("doc_id", "text_hash").agg(F.collect_list("_span").alias("_spans"))
    spans = spans.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), text_hash(F.col("text")).alias("_hash"))
    rows = tables.write(packed.join(spans, ["_doc", "_hash"], "left").select("_row", "_spans"), "chunked-rows")
    odd = tables.write(unequal(rows.select("_row.doc_id", "_row.text", "_spans"), again), "chunks-unequal")
    if odd.isEmpty():
        tables.drop("chunks-unequal")
    else:
        other = odd.groupBy("doc_id", "text_hash").agg(F.collect_set("chunk").alias("_other")).withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
        mine = (F.col("_row.doc_id") == F.col("_doc")) & (text_hash(F.col("_row.text")) == F.col("_hash"))
        kept = F.filter("_spans", lambda s: ~F.coalesce(F.array_contains("_other", s["chunk"]), F.lit(False)))
        rows = rows.join(other, mine, "left").select("_row", kept.alias("_spans"))
    tables.drop("chunks-again")
    cut = F.transform(F.filter("_spans", lambda s: s["cut"]), lambda s: F.struct(s["start"].alias("start"), (s["end"] + 1).alias("end")))
    text = F.when(F.col("_spans").isNull(), F.col("_row.text")).otherwise(without(F.col("_row.text"), cut))
    return with_text(rows.select(F.col("_row").alias("row"), text.alias("text")), docs)
