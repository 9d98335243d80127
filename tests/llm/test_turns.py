import hashlib
import heapq
import random
import zlib

import pytest

from tallyweave.llm import turns
from tallyweave.shared import Tables

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.rstrip(WHITE)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """Cheapest edits by a search over whole audit strings."""
    marks = faults(rows)
    best, queue = {}, [(0, "", 0, "", ())]
    while queue:
        cost, audit, at, last, made = heapq.heappop(queue)
        if best.get((at, last), (cost, audit)) < (cost, audit):
            continue
        best[at, last] = (cost, audit)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, made
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        other = "assistant" if last == "u" else "user"
        heapq.heappush(queue, (cost + 5, audit + "I", at, other[0], (*made, f"{other}:")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, last, made))
            if marks[at] in ("", "truncated"):
                more = 5 if marks[at] else 0
                if role[:1] and role[:1] in follow:
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, role[0], (*made, f"{role}:{text}")))
                heapq.heappush(queue, (cost + 1 + more, audit + "R", at + 1, other[0], (*made, f"{other}:{text}")))
    raise AssertionError


def expected(rows):
    """conv_id -> all columns, rows in any order."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        marks = faults(own)
        cost, audit, made = brute(own)
        numbers = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, *[marks.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def told(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def random_rows(seed, convs, most):
    r = random.Random(seed)
    texts = ["", " \n", None, "Yes.", "No", "Why?", "Go on!  ", "and then\t", "é…", "Fine."]
    roles = ["user", "assistant", "system", None, "", "tool", "User", "admin"]
    return [(c, r.choice([None, *range(6)]) if c % 3 else t, r.choices(roles, [6, 6, 2, 1, 1, 1, 1, 1])[0], r.choice(texts) if r.random() < 0.4 else f"text {t} {r.random()}" + r.choice([".", ""])) for c in range(convs) for t in range(r.randint(1, most))]


@pytest.mark.parametrize("parts", [1, 7])
def test_reports_equal_the_search_over_audits(spark, parts):
    rows = random_rows(parts, 60, 9)
    rows += rows[:5] + [(None, 3, "user", "no id."), (None, None, "system", "no id"), (-5, 2**60 + 1, "user", "a large number?")]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = told(turns.report(spark.createDataFrame(rows, SCHEMA)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == expected(rows)


def test_long_conversations_are_cut_and_put_together(spark, monkeypatch):
    """A conversation over several partitions and many chunks has the audit of the search."""
    r = random.Random(3)
    rows = [(1, t, r.choice(["user", "assistant", "system"]), f"{t}" + r.choice([".", ".", ""])) for t in range(1500)]
    rows += [(1, 7, "user", "again.")] * 40 + [(c, 0, "user", "short.") for c in (0, 2)]
    want = expected(rows)
    monkeypatch.setattr(turns, "BATCH", 300)
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert told(turns.report(df)) == want
        tables = Tables(spark)
        turns.edits(df, tables).count()
        assert tables.read("border").where("conv_id = 1").select("run").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_damage_is_dealt_by_the_hash(spark):
    rows = [(c, t, "assistant" if t % 2 else None, f"Text. {c}?") for c in range(40) for t in range(6)] + [(None, None, None, None)]
    want = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if how == 1 else "".join(x for x in text if x not in ".!?") if how == 2 else text
        want += [(c, t, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    found = turns.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_conversations_without_turns_and_other_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", "x", "y")], SCHEMA + ", n string, edits string")
    ids = spark.createDataFrame([(1,), (2,), (None,)], "conv_id long")
    found = told(turns.report(df, ids))
    assert found[1][5:7] == (2, "D")
    assert found[2] == found[None] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert turns.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "How are you?"), (1, 3, "user", "Well."), (1, 3, "user", "Well.")]
    found = turns.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()
    cost, audit, made = brute([r[1:] for r in rows])
    assert [f"{r.role}:{r.text}" for r in found] == list(made)
    assert "".join(r.edit for r in found) == audit.replace("D", "")
