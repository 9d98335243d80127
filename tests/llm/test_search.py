import math
import random
import re
from collections import Counter

import pytest

from tallyweave.llm import queries, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, k):
    own = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in own]
    n, total = sum(x > 0 for x in sizes), sum(sizes)
    df = Counter(w for _, c in own for w in c)
    out = []
    for q, text in queries:
        scores = []
        for (i, c), size in zip(own, sizes):
            m = 100 - 90 + 90 * size * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if c[w])
            if score > 0:
                scores.append((-score, i is None, i, q))
        out += [(q, rank, i, -s) for rank, (s, _, i, _) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return out


def corpus(seed, n):
    r = random.Random(seed)
    names = ["a", "The", "été", "x9", "don't", "zebra", "ONE", "one-two", "Ł", "日本 語", "_", "7"] + [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choices(names, k=r.choice([1, 3, 10, 60, 300]))) for _ in range(n)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(i + 1000, texts[0]) for i in range(30)] + [(3, texts[3])] * 3
    docs += [(None, texts[1]), (None, texts[1]), (-4, texts[1]), (2000, None), (2001, ""), (2002, "!?"), (2003, "long " * 20_000 + "w1")]
    r.shuffle(docs)
    asked = [(q, " ".join(r.choices(names, k=r.randint(1, 12)))) for q in range(25)] + [(5, "w1 w1 W1"), (None, "été"), (90, None), (91, "nowhere"), (92, texts[0])]
    return docs, asked


@pytest.mark.parametrize(("shard", "block"), [(1 << 14, 4096), (7, 4096), (50, 5)])
def test_equal_to_scores_of_all_documents(spark, monkeypatch, shard, block):
    docs, asked = corpus(shard, 200)
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    monkeypatch.setattr(search, "BLOCK", block)
    df = spark.createDataFrame([(i, t, 0, "y") for i, t in docs], "doc_id long, text string, n long, score string").repartition(3)
    want = brute(docs, asked, 10)
    found = search.search(df, spark.createDataFrame(asked, "item_id long, text string"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    docs, asked = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs, asked).count() == 0
    assert search.search(asked.toDF("doc_id", "text"), asked.limit(0)).count() == 0


def test_whole_table(spark):
    import duckdb

    at = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    want = db.sql(queries.oracle_sql()["op11_ranked_search"]).fetchall()
    assert sorted(map(tuple, queries.op11_ranked_search(spark, at).collect())) == sorted(want)
