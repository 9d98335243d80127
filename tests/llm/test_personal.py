import random
import re

from tallyweave.llm import personal, queries

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(CARD, text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    r = random.Random(1)
    bits = ["a", "Z.", "@", "@@", "b.c", ".", "1", "255", "256.1", "0007", "+", "+1", " ", "-", "(", ")", "4539578763621486", "4539 5787-6362 1486", "é", "%x", "10.0.0.1", "\n", "_", "12.3", "+49 (30) 123456-7"]
    for _ in range(20_000):
        text = "".join(r.choices(bits, k=r.randint(1, 14)))
        assert personal.base_spans(text) == brute(text), text
    for text in ("9" * 50_000, "a" * 200_000, "1." * 50_000, "+1 " * 20_000, "a@" * 50_000, "1 " * 60_000 + "x"):
        personal.base_spans(text)
        personal._others(text, [])


def corpus():
    r = random.Random(5)
    number = lambda k: "".join(r.choices("123456789", k=k))
    docs = [f"word {i} and some more. Call me at: +49 {number(3)} {number(7)} today" for i in range(12)]
    docs += [f"Here it is. Call me at: 0{number(3)} {number(6)}, please" for _ in range(3)]
    docs += [f"mail to: user{i}@mail.example.org thanks" for i in range(8)] + ["we mail to: jane.doe (at) example (dot) org now", "mail to: root@localhost"]
    docs += [f"the total of {number(9)} units" for _ in range(5)] + [f"the total of +1 {number(9)} units" for _ in range(4)]  # mixed: not to be trusted
    docs += [f"seen here {r.choice(['by', 'with'])} +49 {number(9)}" for _ in range(9)] + ["seen here by nobody"] * 60 + [f"seen here by {number(9)}"]
    docs += [None, "", "no data at all", docs[12], "Call me at: tomorrow", "x" * 30_000 + " mail to: a@b"]
    return docs


def by_hand(docs):
    """The same bootstrap in plain Python."""
    kinds, mentions = personal.KINDS, []
    for d, text in enumerate(docs):
        own = personal.base_spans(text or "")
        for k, s, e, seed in [([k], s, e, True) for k, s, e in own] + [(*x, False) for x in personal._others(text or "", own)]:
            mentions.append((d, k, s, e, seed, (text or "")[s:e].lower(), personal.contexts(text or "", s)))
    edges, n = {}, {}
    for _, ks, _, _, seed, value, cs in mentions:
        for c in cs:
            n[c] = n.get(c, 0) + 1
            for k in ks:
                edges[c, value, k] = edges.get((c, value, k), False) or seed
    words = {}
    for c in n:
        size = c.count(" ") + 1
        total = sum(" ".join(w[i : i + size]) == c for t in docs if t for w in [t.lower().split()] for i in range(len(w) - size))
        words[c] = len({v for x, v, _ in edges if x == c}) + max(0, total - n[c])
    seeds = {(c, k): sum(s for (x, _, kk), s in edges.items() if (x, kk) == (c, k)) for c, _, k in edges}
    score = {(c, k): seeds[c, k] / words[c] for c, k in seeds}
    live = {x for x in score if seeds[x] >= personal.LEAST and sum((c, k) == x for c, _, k in edges) >= personal.KEEP * words[x[0]] and seeds[x] >= personal.SEEDED * words[x[0]]}
    for _ in range(personal.ROUNDS):
        best = {}
        for c, v, k in edges:
            if (c, k) in live:
                best[v, k] = max(best.get((v, k), 0), score[c, k])
        score |= {(c, k): sum(1.0 if s else best[v, kk] for (x, v, kk), s in edges.items() if (x, kk) == (c, k)) / words[c] for c, k in live}
    good = {x for x in live if score[x] >= personal.KEEP - 1e-9}
    added = {d: [] for d in range(len(docs))}
    for d, ks, s, e, seed, _, cs in mentions:
        own = [(-score[c, k], kinds.index(k), k) for c in cs for k in ks if (c, k) in good]
        if own and not seed:
            added[d].append((min(own)[2], s, e))
    return {d: sorted(x, key=lambda y: (kinds.index(y[0]), y[1])) for d, x in added.items()}, good


def test_patterns_find_what_seeds_do_not_show(spark):
    docs = corpus()
    want, good = by_hand(docs)
    rows = [(d, t, "k", 1) for d, t in enumerate(docs)]
    found = personal.personal_data(spark.createDataFrame(rows, "doc_id long, text string, kind string, row int").repartition(3)).collect()
    assert {r.doc_id: [tuple(x) for x in r.added] for r in found} == want
    assert {r.doc_id: [tuple(x) for x in r.base] for r in found} == {d: personal.base_spans(t or "") for d, t in enumerate(docs)}
    assert len(found) == len(docs)
    marked = [docs[d][s:e] for d, x in want.items() for _, s, e in x]
    assert "jane.doe (at) example (dot) org" in marked and "root@localhost" in marked
    assert sum(m.startswith("0") for m in marked) == 4 and not any(c.startswith("the total") for c, _ in good) and ("here by", "phone") not in good


def test_no_seeds_and_odd_rows(spark, docs, empty):
    assert personal.personal_data(empty).count() == 0
    found = personal.personal_data(docs).collect()
    assert len(found) == docs.count() and all(r.added == [] for r in found)


def test_the_query_of_a_whole_table(spark):
    at = "/root/testdata/sf0.001"
    import hashlib

    found = queries.op12_personal_data(spark, at).collect()
    texts = dict(spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect())
    assert len(found) == len(texts)
    for r in found:
        own = brute(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in own) for x in personal.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in own).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in own} <= set(r.spans.split(",")) | {""}
