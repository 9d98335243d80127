"""Document fingerprints: bottom-k sketches of five-word shingles, in DataFrame functions only.

A sketch is the sorted array of the k smallest 64-bit shingle hashes. Sketches merge (the
k smallest of a union), so parts of a corpus can be sketched apart. They estimate the
resemblance and containment of two texts and the number of distinct shingles of one.

Edge cases: a null text counts as empty; an empty or blank text has the empty sketch; a
text of one to four words has one shingle, the whole text. Two empty sketches are alike
(1.0), an empty and a full one are not (0.0). Rows without a doc_id have no place in the
order of documents and are left out of `fingerprint_with_next`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
SKETCH = 256
BUCKET = 256
TWO_64 = float(2**64)


def word_hashes(text: Column) -> Column:
    """Hashes of the words (runs without ASCII white space), in order."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column) -> Column:
    """Hashes of all runs of SHINGLE words; a shorter text is one run."""
    several = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - SHINGLE),
        lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(SHINGLE)]),
    )
    whole = F.array(F.aggregate(hashes, F.lit(42).cast("long"), lambda acc, x: F.xxhash64(acc, x)))
    return (
        F.when(F.size(hashes) >= SHINGLE, several)
        .when(F.size(hashes) > 0, whole)
        .otherwise(F.array().cast("array<bigint>"))
    )


def add_sketch(df: DataFrame, text: str, to: str, k: int = SKETCH) -> DataFrame:
    """Adds column `to`: the bottom-k sketch of column `text`."""
    return (
        df.withColumn("_words", word_hashes(F.col(text)))
        .withColumn("_runs", shingle_hashes(F.col("_words")))
        .withColumn(to, F.slice(F.sort_array(F.array_distinct("_runs")), 1, k))
        .drop("_words", "_runs")
    )


def merge(a: Column, b: Column, k: int = SKETCH) -> Column:
    """The sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, keys: list[str], sketch: str, k: int = SKETCH) -> DataFrame:
    """One merged sketch per group. Hashes are made distinct before they are ranked, and
    the ranking keeps k rows for each key and task before its shuffle."""
    hashes = df.select(*keys, F.explode(sketch).alias("_h")).distinct()
    ranked = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h")))
    return ranked.where(F.col("_r") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated Jaccard likeness: the part of the union's k smallest hashes that both have.
    Exact if both texts have at most k shingles together."""
    union = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(shared / F.size(union))
    )


def distinct_shingles(sketch: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(sketch, -1).cast("double") + TWO_64 / 2) / TWO_64
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated part of a's shingles that b has (0 for an empty a)."""
    j = resemblance(a, b, k)
    both = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(sketch: Column) -> Column:
    """16 hex digits for each hash, in order."""
    return F.concat_ws("", F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def next_in_order(keys: DataFrame, key: str, widths: tuple[int, ...] = (4096, 4096)) -> DataFrame:
    """(key, next_key) for distinct long keys in ascending order; the last one's next is null.

    Keys are ordered inside ranges of `width` keys; the last of each range takes the first
    key of the next range, which is found in the same way among the ranges. One task orders
    only the ranges of the last level."""
    keys = keys.select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull()).distinct()
    if not widths:
        return keys.withColumn("next_key", F.lead(key).over(Window.orderBy(key)))
    part = f"{key}_range"  # a name of its own at each level
    ranged = keys.withColumn(part, F.floor(F.col(key) / widths[0]).cast("long"))
    firsts = ranged.groupBy(part).agg(F.min(key).alias("_first"))
    ranges = next_in_order(firsts, part, widths[1:]).withColumnRenamed("next_key", "_next")
    follow = ranges.join(firsts.select(F.col(part).alias("_next"), "_first"), "_next").select(part, "_first")
    within = ranged.withColumn("next_key", F.lead(key).over(Window.partitionBy(part).orderBy(key)))
    return within.join(follow, part, "left").select(key, F.coalesce("next_key", "_first").alias("next_key"))


def fingerprint_with_next(docs: DataFrame, k: int = SKETCH) -> DataFrame:
    """Each document with the text and sketch of the next one in ascending doc_id (after the
    last: the first): doc_id, text, sketch, next_text, next_sketch.

    Texts are shuffled once, to ranges of BUCKET ids. Only the first text of each range
    moves a second time, to the range before it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(
        F.col("doc_id").isNotNull()
    )
    ranged = rows.withColumn("bucket", F.floor(F.col("doc_id") / BUCKET).cast("long")).repartition("bucket")
    firsts = ranged.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("head"))

    ids = rows.select(F.floor(F.col("doc_id") / BUCKET).cast("long").alias("bucket"))
    wrap = ids.agg(F.min("bucket").alias("bucket"), F.max("bucket").alias("before"))  # the first follows the last
    after = (
        next_in_order(ids, "bucket")
        .where(F.col("next_key").isNotNull())
        .select(F.col("next_key").alias("bucket"), F.col("bucket").alias("before"))
        .unionByName(wrap)
    )
    heads = add_sketch(
        firsts.join(after, "bucket").select(F.col("before").alias("bucket"), F.col("head.text").alias("head_text")),
        "head_text",
        "head_sketch",
        k,
    )

    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    within = (
        add_sketch(ranged, "text", "sketch", k)
        .withColumn("follow_text", F.lead("text").over(order))
        .withColumn("follow_sketch", F.lead("sketch").over(order))
    )
    return within.join(heads, "bucket").select(
        "doc_id",
        "text",
        "sketch",
        F.coalesce("follow_text", "head_text").alias("next_text"),
        F.coalesce("follow_sketch", "head_sketch").alias("next_sketch"),
    )


def fingerprint_edits(docs: DataFrame, k: int = SKETCH) -> DataFrame:
    """Fingerprints each document and an edited text of it: its last quarter of code points
    replaced by the first as many of the next document. Carries both sketches."""
    rows = fingerprint_with_next(docs, k).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn(
        "edited",
        F.concat(
            F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut),
            F.substring(F.col("next_text"), F.lit(1), cut),
        ),
    )
    return add_sketch(rows, "edited", "edited_sketch", k).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "sketch",
        "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
