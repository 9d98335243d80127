"""Duplicate operators against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import fingerprints, linededup, neardups, passages, shingles, spans


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(n))


def shingle_set(text):
    w = (text or "").split()
    return set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()


def test_chunks_shift_with_the_lines():
    lines = [f"line {k * k} of some text" for k in range(40)]
    a, b = "\n".join(lines), "\n".join(["inserted", *lines])
    own = {a[s:e] for s, e, _ in linededup.chunks(a)}
    other = {b[s:e] for s, e, _ in linededup.chunks(b)}
    assert len(own & other) >= len(own) - 2
    for text in (a, b, "", "one", "a\n", "\n\n\n"):
        joined = "\n".join(text[s:e] for s, e, _ in linededup.chunks(text))
        assert joined == text


def brute_lines(rows):
    seen, out = set(), {}
    for key, text in sorted(rows):
        cut = []
        for s, e, n in linededup.chunks(text):
            if n >= 2:
                if text[s:e] in seen:
                    cut.append((s, e + 1))
                seen.add(text[s:e])
        kept, at = "", 0
        for s, e in cut:
            kept, at = kept + text[at:s], e
        out[key] = kept + text[at:]
    return out


def test_line_dedup(docs, empty):
    rows = {(r.doc_id, r.h): r.text for r in docs.where("doc_id is not null and text is not null").withColumn("h", spans.text_hash(F.col("text"))).collect()}
    want = brute_lines([(k, t) for k, t in rows.items()])
    got = linededup.dedup_lines(docs.withColumn("start", F.lit(1)).withColumn("h", spans.text_hash(F.col("text"))))
    assert got.count() == docs.count()
    for r in got.collect():
        if r.doc_id is not None and (r.doc_id, r.h) in want:
            assert r.text == want[(r.doc_id, r.h)]
            assert r.n_chars == len(r.text)
    assert len("".join(want.values())) < len("".join(rows.values()))
    assert linededup.dedup_lines(empty).count() == 0


def test_lines_with_equal_hashes_but_other_bytes_stay(spark, docs, monkeypatch):
    rows = [(k, t, [(0, 3, 0, k > 1)]) for k, t in ((1, "a\nb"), (2, "a\nb"), (3, "a\nc"))]
    spanned = spark.createDataFrame(rows, "doc_id long, text string, _spans array<struct<start:int,end:int,chunk:int,cut:boolean>>")
    keyed = spanned.select("doc_id", spans.text_hash(F.col("text")).alias("text_hash"), F.lit(0).alias("chunk"))
    first = keyed.where("doc_id = 1").select(F.struct("doc_id", "text_hash", "chunk").alias("first"))
    assert [r.doc_id for r in linededup.unequal(spanned, keyed.where("doc_id > 1").crossJoin(first)).collect()] == [3]
    monkeypatch.setattr(linededup, "unequal", lambda _, again: again.select(*linededup.KEY))
    texts = lambda df: sorted((r.text for r in df.where("text is not null").collect()))
    assert texts(linededup.dedup_lines(docs)) == texts(docs)


def test_spans_may_overlap(spark):
    df = spark.createDataFrame([("abcdefgh", [(1, 3), (2, 5), (6, 7)]), ("äö😀x", [(0, 2)]), ("same", [])], "t string, s array<struct<start:int,end:int>>")
    assert [r[0] for r in df.select(spans.without(F.col("t"), F.col("s"))).collect()] == ["afh", "😀x", "same"]


def brute_classes(rows, least=0.8):
    sets = [(i, t or "", shingle_set(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (_, ta, sa) in enumerate(sets):
        for b, (_, tb, sb) in enumerate(sets[:a]):
            if sets[a][0] == sets[b][0] or ta == tb or sa | sb and len(sa & sb) >= least * len(sa | sb):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for k in range(len(sets)):
        groups[find(k)].append(sets[k][0])
    return sorted(sorted(g) for g in groups.values())


def test_near_duplicates(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    got = defaultdict(list)
    found = neardups.near_duplicates(docs.withColumn("rep", F.lit(0)).withColumn("class_id", F.lit("x")))
    for r in found.collect():
        got[r.class_id].append(r.doc_id)
    assert sorted(sorted(g) for g in got.values()) == brute_classes(rows)
    kept = neardups.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert neardups.near_duplicates(empty).count() == 0


def test_recall_and_precision_on_the_documents(spark):
    """All links of the whole table by brute force (shingles that two texts share are looked up)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets, having, links, root = {i: shingle_set(t) for i, t in rows}, defaultdict(list), [], {i: i for i, _ in rows}
    for i, own in sets.items():
        shared = defaultdict(int)
        for x in own:
            for j in having[x]:
                shared[j] += 1
            having[x].append(i)
        links += [(i, j) for j, n in shared.items() if n >= 0.8 * (len(own) + len(sets[j]) - n)]
    empty = [i for i, x in sets.items() if not x]
    links += [(empty[0], i) for i in empty if dict(rows)[i] == dict(rows)[empty[0]]]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in neardups.near_duplicates(docs).collect()}
    assert len(links) > 50
    assert sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)
    assert all(find(i) == find(c) for i, c in got.items())


def test_many_near_copies_are_one_class(spark):
    base = prose(50, 200).split()
    rows = [(k, " ".join([*base[:k], f"edit{k}", *base[k + 1 :]])) for k in range(150)] + [(1000 + k, prose(900 + k, 80)) for k in range(50)]
    got = {r.doc_id: r.class_id for r in neardups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k] for k in range(150)} == {0}
    assert all(got[1000 + k] == 1000 + k for k in range(50))


def shared_prose(common, n, k):
    """n words, of which the first ones are those of `common`, in blocks."""
    return " ".join([*common, *prose(5000 + k, n - len(common)).split()])


@pytest.mark.parametrize("n, share", [(300, 0.75), (3000, 0.75), (3000, 0.9)])
def test_long_texts_of_one_bucket_are_not_all_pairs(spark, n, share):
    """Texts under the likeness that share buckets are proven unlike before they are verified; alike
    ones never are."""
    texts = [shared_prose(prose(4, n).split()[: int(share * n)], n, k) for k in range(100)]
    sets = [np.unique(shingles.shingles(*shingles.hashed_words(pa.array([t])))[0] >> np.uint64(32)).astype("<u4") for t in texts]
    rows = [(k, bytearray(x.tobytes())) for k, x in enumerate(sets)]
    marks = neardups.parities(spark.createDataFrame(rows, "doc_id long, shingles binary"))
    got = neardups.unproven(marks.selectExpr("1L key", "doc_id", "doc_id class", "* except (doc_id)"), 0.8).collect()
    want = {(a, b) for a in range(100) for b in range(a + 1, 100) if neardups._jaccard(rows[a][1], rows[b][1]) >= 0.8}
    assert want <= {(r.a, r.b) for r in got}
    assert len(got) == 4950 if share == 0.9 else len(got) < 50 and not want


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95])
def test_no_alike_sets_are_proven_unlike(spark, least):
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 32, 90_000, dtype=np.uint64).astype("<u4")
    rows = []
    for k in range(160):
        n = int(np.exp(r.uniform(0, np.log(80_000)))) if k % 2 else int(r.choice([1, 2, 900, 1100, 2000, 60_000]))
        own = np.concatenate([base[: n - n // 8], r.integers(0, 1 << 32, n // 8, dtype=np.uint64).astype("<u4")])
        rows.append((k, bytearray(np.unique(own).astype("<u4").tobytes())))
    marks = neardups.parities(spark.createDataFrame(rows, "doc_id long, shingles binary"), least)
    got = {(x.a, x.b) for x in neardups.unproven(marks.selectExpr("1L key", "doc_id", "doc_id class", "* except (doc_id)"), least).collect()}
    want = {(a, b) for a in range(160) for b in range(a + 1, 160) if neardups._jaccard(rows[a][1], rows[b][1]) >= least}
    assert want and want <= got


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    pool = shingles.mix(np.arange(400, dtype=np.uint64) + np.uint64(99))
    w = rng.uniform(0.5, 3, 400)
    likes = []
    for trial in range(40):
        h = shingles.mix(pool + np.uint64(trial))
        a, b = np.arange(0, 300), np.arange(100, 400)
        kept = neardups.signatures(np.concatenate([h[a], h[b]]), np.repeat([0, 1], 300), np.concatenate([w[a], w[b]]), 2)
        likes.append((kept[0] == kept[1]).mean())
    both = np.arange(100, 300)
    x, y = np.zeros(400), np.zeros(400)
    x[:300], y[100:] = w[:300], w[100:]
    want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in both)
    assert np.mean(likes) == pytest.approx(want, abs=0.03)


def brute_windows(h, width):
    out = set()

    def cut(lo, hi):
        if hi - lo + 1 < width:
            return
        c = min(range(lo, hi + 1), key=lambda k: (h[k] >> passages.PLACE, k))
        out.add((lo, c, hi))
        cut(lo, c - 1)
        cut(c + 1, hi)

    cut(0, len(h) - 1)
    return out


@pytest.mark.parametrize("n", [0, 3, 10, 200])
def test_compact_windows_are_the_trees_upper_nodes(n):
    h = shingles.mix(np.arange(n, dtype=np.uint64) * np.uint64(7919))
    if n > 100:
        h[50:70] = h[50]
    left, centre, right = passages.compact_windows(np.concatenate([h, h]), np.repeat([0, 1], n), 9)
    own = {(a, c, b) for a, c, b in zip(left.tolist(), centre.tolist(), right.tolist(), strict=True) if c < n}
    assert own == brute_windows(h.tolist(), 9)
    assert len(left) == 2 * len(own)


def test_repeated_passages(docs, empty):
    found = passages.repeated_passages(docs.withColumn("source", F.lit(3)).withColumn("start", F.lit(3))).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    covered = defaultdict(set)
    for r in found:
        assert r.source < r.doc_id and r.likeness >= 0.8 and r.n_words >= 50
        covered[r.doc_id].update(range(r.start, r.end))
    seen = {}
    for doc in sorted(d for d in texts if d is not None):
        for text in texts[doc]:
            at = [m.span() for m in re.finditer(r"\S+", text)]
            w = text.split()
            for k in range(len(w) - 49):
                run = tuple(w[k : k + 50])
                if seen.setdefault(run, doc) != doc:
                    assert set(range(at[k][0], at[k + 49][1])) <= covered[doc]
    assert 9 in covered and 1 in covered and 8 not in covered
    kept = passages.dedup_passages(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert passages.dedup_passages(empty).count() == 0


def test_passage_after_an_earlier_partial_one(spark):
    """An earlier document with a part of the passage takes the keys; a later one has it twice."""
    rows = []
    for k in range(60):
        passage = prose(900 + k, 60).split()
        part = passage[:40] if k % 2 else passage[10:50]
        for j, own in enumerate((part, passage, passage, [*passage, *prose(9000 + k, 70).split(), *passage])):
            rows.append((10 * k + j, " ".join([*prose(5000 + 10 * k + j, 70).split(), *own, *prose(7000 + 10 * k + j, 70).split()])))
    found = defaultdict(set)
    texts = dict(rows)
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.source < r.doc_id
        found[r.doc_id] |= set(range(r.start, r.end))
    for k in range(60):
        passage = " ".join(prose(900 + k, 60).split())
        for doc in (10 * k + 2, 10 * k + 3):
            for m in re.finditer(re.escape(passage), texts[doc]):
                assert set(range(*m.span())) <= found[doc], doc
        assert not found[10 * k] and not found[10 * k + 1]


def test_alike_passage_that_the_first_documents_of_its_groups_lack(spark):
    """Earlier documents have parts of the passage, whatever two of its shingles one looks for; two later
    ones have it with other words changed, so it has no equal range of 50 words."""
    rows, changed = [], set()
    for k in range(6):
        passage = prose(900 + k, 120).split()
        one, two = list(passage), list(passage)
        for words, places in ((one, (39, 79)), (two, (40, 80))):
            for at in places:
                words[at] = f"changed{k}{at}"
        parts = [passage[i : i + 49] for i in range(72)]
        for j, own in enumerate((*parts, one, two)):
            rows.append((100 * k + j, " ".join([*prose(5000 + 100 * k + j, 70).split(), *own, *prose(7000 + 100 * k + j, 70).split()])))
        changed.add(100 * k + 73)
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found if r.source == r.doc_id - 1 and r.n_words >= 110} == changed


def test_passages_with_words_put_in_and_twice():
    words = lambda seed, n: shingles.mix(np.arange(n, dtype=np.uint64) + np.uint64(seed * 10_000))
    passage, middle, other = words(1, 80), words(2, 7), np.concatenate([words(3, 30), words(1, 80)])
    longer = np.concatenate([words(4, 20), passage[:40], middle, passage[40:]])
    (s, e, s2, e2, like), = passages.common_passages(longer, other)
    assert (s, e, s2, e2) == (20, 107, 30, 110) and like == pytest.approx(72 / 87)
    changed = np.concatenate([passage[:30], middle[:1], passage[31:]])
    twice = np.concatenate([changed, words(5, 100), changed])
    found = passages.common_passages(twice, other)
    assert [f[:4] for f in found] == [(0, 80, 30, 110), (180, 260, 30, 110)]


def test_range_hashes():
    words = shingles.mix(np.arange(300, dtype=np.uint64) % np.uint64(70))
    h = passages.range_hashes(words, 50)
    own = {}
    for k, x in enumerate(h.tolist()):
        assert own.setdefault(tuple(words[k : k + 50].tolist()), x) == x
    assert len(own) == len(set(own.values())) == 70 and len(passages.range_hashes(words[:49], 50)) == 0



def test_fingerprints(docs, empty):
    import struct

    import xxhash

    def long(x):
        return struct.unpack("<q", struct.pack("<Q", x))[0]

    def sketch(text):
        w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text or "") if x]
        h = [long(xxhash.xxh64_intdigest(x.encode(), 42)) for x in w]

        def chain(run):
            seed = 42
            for x in run:
                seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed)
            return long(seed)

        if len(h) >= 5:
            return sorted({chain(h[k : k + 5]) for k in range(len(h) - 4)})[: fingerprints.SKETCH]
        whole = 42
        for x in h:
            whole = chain([whole, x])
        return [whole] if h else []

    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text or "") for r in unique.collect())
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(unique).collect()}
    assert len(got) == len(rows)

    def like(a, b):
        if not a or not b:
            return float(not a and not b)
        union = sorted(set(a) | set(b))[: fingerprints.SKETCH]
        return len(set(a) & set(b) & set(union)) / len(union)

    import hashlib

    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.sketch, r.edited_sketch) == (sketch(text), sketch(edited))
        assert r.near_edited == pytest.approx(like(sketch(text), sketch(edited)))
        assert r.near_next == pytest.approx(like(sketch(text), sketch(after)))
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_sketches_merge(spark, docs):
    parts = fingerprints.add_sketch(docs.where("doc_id in (0, 2, 15)").dropDuplicates(["doc_id"]).select("doc_id", "text", F.lit(1).alias("g")), "text", "sketch")
    merged = fingerprints.merge_groups(parts, ["g"], "sketch").first().sketch
    assert merged == sorted({h for r in parts.collect() for h in r.sketch})[: fingerprints.SKETCH]
    row = parts.agg(F.max(F.when(F.col("doc_id") == 0, F.col("sketch"))).alias("a"), F.max(F.when(F.col("doc_id") == 15, F.col("sketch"))).alias("b"))
    told = row.select(fingerprints.distinct_shingles(F.col("b")).alias("n"), fingerprints.containment(F.col("a"), F.col("a")).alias("c"), fingerprints.containment(F.col("a"), F.col("b")).alias("d")).first()
    assert told.n == pytest.approx(2996, rel=0.2) and told.c == pytest.approx(1.0) and told.d < 0.05


def test_next_in_order_of_sparse_keys(spark):
    keys = [-(10**12), -5, 0, 1, 2, 4095, 4096, 10**6, 10**15]
    df = spark.createDataFrame([(k,) for k in [*keys, 1, None]], "k long")
    got = {r.k: r.next_key for r in fingerprints.next_in_order(df, "k").collect()}
    assert got == dict(zip(keys, [*keys[1:], None], strict=True))


def test_hashed_words_are_those_of_split():
    random.seed(5)
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    signs = [*spaces, *"abcé漢😀", "\u200b", "\u0084", "\u180e", "\ufeff"]
    for _ in range(200):
        texts = ["".join(random.choices(signs, k=random.choice([0, 1, 2, 3, 40]))) for _ in range(random.choice([1, 2, 9]))]
        texts[random.randrange(len(texts))] = None
        column = pa.array(["before all", *texts]).slice(1)
        split = [(t or "").split() for t in texts]
        data, starts, ends, counts = shingles.word_places(column)
        assert [bytes(data[s:e]).decode() for s, e in zip(starts, ends, strict=True)] == [w for t in split for w in t]
        assert counts.tolist() == [len(t) for t in split]
        of = {}
        for w, h in zip((w for t in split for w in t), shingles.hash_places(data, starts, ends).tolist(), strict=True):
            assert of.setdefault(w, h) == h
        assert len(set(of.values())) == len(of)
    large = "x" * (2 * shingles.BLOCK + 1)  # a word of more than one block
    hashes, counts = shingles.hashed_words(pa.array([f"a {large} b {large}", "", large]))
    assert hashes[1] == hashes[3] == hashes[4] and len(set(hashes.tolist())) == 3 and counts.tolist() == [4, 0, 1]


@pytest.mark.parametrize("hops", [1, 64])
def test_nearest_smaller(monkeypatch, hops):
    monkeypatch.setattr(passages, "HOPS", hops)
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 200):
        for keys in (rng.permutation(n), np.arange(n), np.arange(n)[::-1], np.roll(np.arange(n), n // 2)):
            owner = np.sort(rng.integers(0, 3, n))
            before, after = passages.nearest_smaller(keys.astype(np.uint64), owner)
            smaller = [[j for j in range(n) if owner[j] == owner[i] and keys[j] < keys[i]] for i in range(n)]
            assert before.tolist() == [max((j for j in x if j < i), default=-1) for i, x in enumerate(smaller)]
            assert after.tolist() == [min((j for j in x if j > i), default=n) for i, x in enumerate(smaller)]


def test_pairs_of_a_large_group_bring_their_texts_to_few_cells(spark):
    """All pairs among 300 documents, beside many small groups: no pair is lost, and texts aren't brought along once for each pair."""
    rows = [(b, a) for b in range(300) for a in range(b)] + [(1000 + 2 * k + 1, 1000 + 2 * k) for k in range(100)]
    pairs = spark.createDataFrame(rows, "doc_id long, source long")
    sizes = spark.range(2000).selectExpr("id AS doc_id", "1000L AS bytes")
    dealt = passages.in_cells(pairs, sizes).collect()
    assert sorted((r.doc_id, r.source) for r in dealt) == sorted(rows)
    assert len({(r.cell, d) for r in dealt for d in (r.doc_id, r.source)}) <= 300 * 6 + 200


@pytest.mark.parametrize("least", [0.8, 0.6])
def test_no_common_passage_is_proven_away(least, monkeypatch):
    """Passages with words changed, put in and left out are found as they are without the proof."""
    r = np.random.default_rng(5)
    words = lambda n, kinds=1 << 40: shingles.mix(r.integers(0, kinds, n).astype(np.uint64))
    cases = []
    for k in range(400):
        passage = words(int(r.integers(40, 200)), 1 << 40 if k % 4 else 60)
        other = passage.copy()
        other[r.random(len(other)) < 0.01 * (k % 9)] = words(1)[0]
        other = np.delete(other, r.integers(0, len(other), k % 5))
        cases.append((np.concatenate([words(30), passage, words(20)]), np.concatenate([words(50), other, words(60)])))
    got = [passages.common_passages(a, b, least) for a, b in cases]
    told = [passages.may_have_passages(passages.Text(a), passages.Text(b), least) for a, b in cases]
    monkeypatch.setattr(passages, "may_have_passages", lambda *_: True)
    assert got == [passages.common_passages(a, b, least) for a, b in cases]
    assert any(got) and (least < 0.8 or not all(told))


def test_texts_that_repeat_a_line_are_proven_unlike_too():
    r = np.random.default_rng(6)
    words = lambda n: shingles.mix(r.integers(0, 1 << 40, n).astype(np.uint64))
    line = words(12)
    own, other = (passages.Text(np.concatenate([words(200), line, words(30), line, words(200)])) for _ in range(2))
    assert not passages.may_have_passages(own, other, 0.8)
    again = passages.Text(np.concatenate([np.tile(line, 6), words(40)]))
    assert passages.may_have_passages(again, own, 0.8)  # its line may be a passage by itself


def test_further_pairs_come_in_parts_of_bounded_size(spark, monkeypatch):
    rows = [(d, fn, 7 + fn, 0, 10 + 10 * fn, 60) for d in range(30) for fn in range(2)]
    shared = spark.createDataFrame(rows, "doc_id long, fn byte, key long, left int, centre int, right int")
    found = spark.createDataFrame([(29, 0, 90, False)], "doc_id long, first int, last int, equal boolean")  # that of 29 is found already
    pairs = {(d, s) for d in range(29) for s in range(d)}
    for most, parts in ((1000, 1), (300, 3)):
        monkeypatch.setattr(passages, "KEY_PAIRS", most)
        tables = passages.Tables(spark)
        told = [sorted(map(tuple, p.collect())) for p in passages.further_pairs(shared, found, tables)]
        assert len(told) == parts and sorted(sum(told, [])) == sorted(pairs)
        assert not tables.paths  # nothing stays on disk
