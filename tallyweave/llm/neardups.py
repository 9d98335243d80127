"""Near-duplicate documents by ProbMinHash signatures, banding and verification.

A document is a weighted set of five-word shingles (weight 1 + ln of how often one occurs).
Every shingle is a Poisson process of its weight's rate: its arrivals, seeded by its hash,
fall on the signature's slots in an order of its own, each slot once, and a slot keeps the
shingle that arrives first. A shingle stops as soon as it is later than all slots of its
document. Two slots agree with the probability of the probability Jaccard likeness.

Signatures are cut into bands; equal bands make candidates. A text that repeats shingles has the
bands of a signature with equal weights too (its slots agree with the probability of the Jaccard
likeness of the sets, which is what a link is defined by), so repetitions hide no link. In each
bucket every document is compared with the bucket's first one (a star, not all pairs), on the
whole sets of shingles. The links found make classes. Documents of different classes that still share a
bucket are then compared with each other, except where their sizes, or the number of places
where the parities of their sets differ (no more than the shingles that only one has), prove
that they can't be alike; long texts have as many places as shingles, so that this holds for them
too. So no candidate pair is left out: it is in one class, was compared,
or can't be linked. Exact copies are one document in all of this.

Two documents are linked if the Jaccard likeness of their sets of shingles (as 32-bit
hashes) is at least `least`. A class is a connected component of links, named by its
least doc_id.

Edge cases: a null text counts as empty; empty texts are copies of each other; texts of one
to four words are one shingle. Rows without doc_id are left out; rows that share a doc_id
are one document: what one of their texts is linked to, all of them are. Columns of any other
name don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import ragged, shingles
from tallyweave.operators.components import components
from tallyweave.llm.ragged import tidy
from tallyweave.session import ship
from tallyweave.shared import Tables, written
from tallyweave.skew import salted_join

SLOTS, BANDS, ROWS = 128, 24, 5
LEAST = 0.8
#: Bytes of texts whose shingles are held at once.
GROUP = 1_000_000
#: Places of the parities that any set of shingles has, and most places of one: powers of 2, and at
#: least 64. A set of more shingles than MOST_BITS has that many places, which prove less of it and
#: lose nothing: what isn't proven unlike is verified.
BITS, MOST_BITS = 1024, 1 << 16


def signatures(hashes: np.ndarray, text: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The signature (SLOTS shingle hashes) of each of n texts; zeros for one without shingles."""
    best, kept = np.full((n, SLOTS), np.inf), np.zeros((n, SLOTS), np.uint64)
    flat_best, flat_kept = best.reshape(-1), kept.reshape(-1)
    seed = shingles.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    start = (seed & np.uint64(SLOTS - 1)).astype(np.int64)
    step = ((seed >> np.uint64(7)) & np.uint64(SLOTS - 1)).astype(np.int64) | 1  # odd: it meets every slot
    time, hashes = np.zeros(len(hashes)), hashes.copy()
    for t in range(SLOTS):
        if not len(hashes):
            break
        drawn = shingles.mix(hashes + np.uint64((t + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        uniform = ((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
        time = time - np.log(uniform) / weights * (SLOTS / (SLOTS - t))
        at = text * SLOTS + ((start + t * step) & (SLOTS - 1))
        sooner = np.flatnonzero(time < flat_best[at])
        sooner = sooner[np.lexsort((hashes[sooner], -time[sooner]))]  # the soonest is written last
        flat_best[at[sooner]] = time[sooner]
        flat_kept[at[sooner]] = hashes[sooner]
        go = time < best.max(1)[text]
        hashes, text, weights, time, start, step = (x[go] for x in (hashes, text, weights, time, start, step))
    return kept


def band_keys(kept: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    out = np.zeros((len(kept), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(kept), b + 1, np.uint64)
        for r in range(ROWS):
            key = shingles.mix(key * np.uint64(0x9E3779B97F4A7C15) + kept[:, b * ROWS + r])
        out[:, b] = key
    return out.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, h1 and h2 (128 bits of the text), bands, shingles (sorted 32-bit hashes)."""
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("again"), text).alias("h2"), text.alias("text")
    )

    def run(batches):
        for b in batches:
            for lo, hi in ragged.ranges(b.column(3), GROUP):
                words, counts = shingles.hashed_words(b.column(3).slice(lo, hi - lo))
                h, text, often = shingles.distinct(*shingles.shingles(words, counts))
                keys = band_keys(signatures(h, text, 1 + np.log(often), hi - lo))
                full = np.bincount(text, minlength=hi - lo) > 0
                again = np.bincount(text[often > 1], minlength=hi - lo) > 0
                own = np.flatnonzero(again[text])
                even = band_keys(signatures(h[own], text[own], np.ones(len(own)), hi - lo))
                both = np.concatenate([keys, even], 1)
                taken = np.repeat(np.stack([full, again], 1), BANDS, 1)
                short = (h >> np.uint64(32)).astype("<u4")  # sorted as h is
                once = np.ones(len(short), bool)
                once[1:] = (short[1:] != short[:-1]) | (text[1:] != text[:-1])
                short = short[once]
                cuts = np.searchsorted(text[once], np.arange(hi - lo + 1))
                sets = [short[s:e].tobytes() for s, e in zip(cuts, cuts[1:], strict=False)]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(taken.sum(1))]).astype(np.int32)), pa.array(both[taken])
                )
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(lo, hi - lo) for i in range(3)), lists, pa.array(sets, pa.binary())], ["doc_id", "h1", "h2", "bands", "shingles"]
                )

    return rows.mapInArrow(tidy(run), "doc_id long, h1 long, h2 long, bands array<long>, shingles binary")


def _jaccard(x: bytes, y: bytes) -> float:
    x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of `pairs` (a, b) whose sets of shingles are alike enough, with `likeness`."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    size = lambda c: F.length(c)  # noqa: E731  a set over 1/least times as large can't be alike
    ends = salted_join(pairs.select("a", "b"), left, ["a"], ["b"])  # a bucket's first document may have very many pairs
    rows = salted_join(ends, right, ["b"], ["a"], pairs.groupBy("b").agg(F.count("*").alias("n"))).where((size("x") >= least * size("y")) & (size("y") >= least * size("x")))

    def run(batches):
        for b in batches:
            a, c, x, y = (b.column(i).to_pylist() for i in range(4))
            like = [_jaccard(p, q) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(like, pa.float64())], ["a", "b", "likeness"])

    return rows.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long, likeness double").where(F.col("likeness") >= least)


def sizes_step(n: np.ndarray, least: float) -> np.ndarray:
    """The step of a set of n shingles. Alike sets lie in the same step or in neighbours, as a step
    is the largest ratio of their sizes."""
    return np.floor(np.log(np.maximum(n, 1)) / max(0.01, float(-np.log(least)))).astype(np.int32)


def places_of(step: np.ndarray, least: float) -> np.ndarray:
    """How many places the parities of the sets in a step have: no fewer than shingles, so that
    two sets that differ much differ in many places."""
    most = np.exp(np.minimum((step + 1) * max(0.01, float(-np.log(least))), np.log(MOST_BITS)))
    return np.maximum(BITS, 1 << np.ceil(np.log2(most) - 1e-9).astype(np.int64))


def parities(sets: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n, step, p0 ..., fine, coarse: the size of each set and its step, and for each of BITS
    places whether an odd number of its shingles falls there (by their hash), as 64-bit
    integers; the same for as many places as the sets of its step have, and as those of the step before
    have (empty if BITS). A place where two sets differ holds a shingle that only one of them has."""
    names = [f"p{k}" for k in range(BITS // 64)]

    def run(batches):
        for b in batches:
            for lo, hi in ragged.ranges(b.column(1), GROUP):
                part = b.slice(lo, hi - lo)
                lists = [np.frombuffer(x, "<u4") for x in part.column(1).to_pylist()]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                step = sizes_step(sizes, least)
                own, before = places_of(step, least), places_of(step - 1, least)
                rows, fine, coarse = [], [], []
                for x, m, m2 in zip(lists, own.tolist(), before.tolist(), strict=True):
                    odd = (np.bincount(x & np.uint32(m - 1), minlength=m) & 1).astype(np.uint8)
                    folded = {m: odd}
                    while m > BITS:  # a place of half as many is two of these
                        odd = odd[: m // 2] ^ odd[m // 2 :]
                        m //= 2
                        folded[m] = odd
                    rows.append(odd)
                    for to, at in ((fine, max(folded)), (coarse, m2)):
                        to.append(np.packbits(folded[at]).view("<i8") if at > BITS else np.zeros(0, np.int64))
                packed = np.packbits(np.stack(rows), axis=1).view("<i8")
                columns = [part.column(0), pa.array(sizes), pa.array(step), *(pa.array(np.ascontiguousarray(c)) for c in packed.T)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(pa.array(x, pa.list_(pa.int64())) for x in (fine, coarse))], ["doc_id", "n", "step", *names, "fine", "coarse"]
                )

    kinds = f"doc_id long, n long, step int, {', '.join(f'{c} long' for c in names)}, fine array<long>, coarse array<long>"
    return sets.select("doc_id", "shingles").mapInArrow(tidy(run), kinds)


def unproven(named: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs of documents of different classes in one bucket that neither their sizes nor
    their parities prove unlike. named: key, doc_id, class and the columns of parities(). A bucket's
    documents are dealt by their steps; of a pair, that of the smaller set decides where they meet."""
    marks = [c for c in named.columns if c[0] == "p"]
    left = named.select("key", "step", *(F.col(c).alias(f"a_{c}") for c in ("doc_id", "class", "n", *marks, "fine")))
    cells = [F.struct((F.col("step") - k).alias("step"), F.lit(k == 0).alias("same"), F.col(c).alias("b_fine")) for k, c in enumerate(("fine", "coarse"))]
    right = named.select("key", *(F.col(c).alias(f"b_{c}") for c in ("doc_id", "class", "n", *marks)), F.inline(F.array(*cells)))
    apart = sum(F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in marks)
    finely = F.aggregate(F.zip_with("a_fine", "b_fine", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    smaller, larger = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    most = (1 - least) / (1 + least) * (smaller + larger) + 1e-6  # shingles of one alone that alike sets have
    fits = F.when(F.col("same"), F.col("a_class") < F.col("b_class")).otherwise(F.col("a_class") != F.col("b_class"))
    fits = fits & (smaller >= least * larger) & (apart <= most) & (finely <= most)
    pairs = salted_join(left, right, ["key", "step"], ["a_doc_id"]).where(fits)
    return pairs.select(F.least("a_doc_id", "b_doc_id").alias("a"), F.greatest("a_doc_id", "b_doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, h1, h2, rep (the least doc_id of its exact copies), class_id of each row."""
    tables = Tables(docs.sparkSession)
    made = tables.write(sketch(docs), "neardup-sketches")
    reps = tables.write(made.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "neardup-reps")
    rows = salted_join(made.select("doc_id", "h1", "h2"), reps.drop("n"), ["h1", "h2"], ["doc_id"], reps)
    rows = tables.write(rows.select("doc_id", "h1", "h2", "rep"), "neardup-copies")
    kept = made.join(reps.select("h1", "h2", F.col("rep").alias("doc_id")), ["doc_id", "h1", "h2"], "left_semi")
    keys = tables.write(kept.select("doc_id", F.explode("bands").alias("key")).distinct(), "neardup-bands")
    del kept
    hubs = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where(F.col("n") > 1)
    hubs = tables.write(hubs, "neardup-hubs")
    shared = salted_join(keys, hubs.drop("n"), ["key"], ["doc_id"], hubs)
    shared = tables.write(shared.select("key", "doc_id", "a"), "neardup-buckets")  # key, doc_id, a: buckets of several texts

    stars = tables.write(shared.where(F.col("doc_id") != F.col("a")).select("a", F.col("doc_id").alias("b")).distinct(), "neardup-stars")
    some = reps.select("h1", "h2", F.col("rep").alias("doc_id")).join(shared.select("doc_id").distinct(), "doc_id")
    sets = made.select("doc_id", "h1", "h2", "shingles").join(some, ["doc_id", "h1", "h2"], "left_semi")
    sets = tables.write(sets.select("doc_id", "shingles"), "neardup-sets")
    tables.drop("neardup-sketches", "neardup-bands")
    links = tables.write(verified(stars, sets, least), "neardup-links")
    classes = tables.write(components(links), "neardup-classes")

    # What still shares a bucket across classes.
    named = shared.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("class")
    )
    mixed = named.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n"))
    mixed = tables.write(mixed.where(F.col("lo") < F.col("hi")).select("key", "n"), "neardup-mixed-keys")
    named = salted_join(named, mixed.select("key"), ["key"], ["doc_id"], mixed)
    named = tables.write(named.select("key", "doc_id", "class"), "neardup-mixed")
    marks = parities(sets.join(named.select("doc_id").distinct(), "doc_id", "left_semi"), least)
    named = tables.write(named.join(marks, "doc_id"), "neardup-marks")
    rest = unproven(named, least).join(stars, ["a", "b"], "left_anti")
    rest = tables.write(rest, "neardup-rest")
    more = tables.write(verified(rest, sets, least), "neardup-more-links")
    if not more.isEmpty():
        classes = components(links.select("a", "b").unionByName(more.select("a", "b")))
        classes = tables.write(classes, "neardup-all-classes")
    tables.drop(*(n for n in tables.paths if n not in ("neardup-copies", "neardup-classes", "neardup-all-classes")))
    named = classes.select(F.col("node").alias("rep"), F.col("component").alias("class_id"))
    return rows.join(named, "rep", "left").select("doc_id", "h1", "h2", "rep", F.coalesce("class_id", "rep").alias("class_id"))


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of `docs` whose doc_id is the least of its class, and rows without doc_id. (So a
    row that is given twice stays twice.)"""
    text = F.coalesce("text", F.lit(""))
    first = near_duplicates(docs, least).where(F.col("doc_id") != F.col("class_id")).select(
        F.col("doc_id").alias("_doc"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")
    )
    drop = written(first.distinct(), "neardup-dropped")
    same = (docs["doc_id"] == drop["_doc"]) & (F.xxhash64(text) == drop["_h1"]) & (F.xxhash64(F.lit("again"), text) == drop["_h2"])
    return docs.join(drop, same, "left_anti")
