"""Cycles, strongly connected parts and process graphs."""

import random

import pytest

from tallyweave.operators import cycles, processes
from tallyweave.shared import Tables

SCHEMA = "graph_id string, source string, target string, edge_id string"


def acyclic(edges):
    after = {}
    for s, t in edges:
        after.setdefault(s, set()).add(t)
    left = {x for e in edges for x in e}
    while left:
        free = {n for n in left if not (after.get(n, set()) & left)}
        if not free:
            return False
        left -= free
    return True


def reach(edges):
    nodes = {x for e in edges for x in e}
    out = {n: {n} for n in nodes}
    for _ in nodes:
        for s, t in edges:
            out[s] |= out[t]
    return out


def graphs(seed, n):
    r = random.Random(seed)
    rows = []
    for g in range(n):
        names = [f"n{k}" for k in range(r.randint(2, 8))]
        rows += [(f"g{g}", r.choice(names), r.choice(names), f"e{g}-{k}") for k in range(r.randint(1, 14))]
    return rows


def by_graph(rows):
    out = {}
    for g, *rest in rows:
        out.setdefault(g, []).append(tuple(rest))
    return out


def test_groups_are_walked_in_sorted_order(spark):
    rows = graphs(1, 80)
    found = by_graph([tuple(r) for r in cycles.break_cycles(spark.createDataFrame(rows, SCHEMA)).collect()])
    for g, own in by_graph(rows).items():
        own = sorted(own)
        want = cycles.walked([e[0] for e in own], [e[1] for e in own])
        assert sorted(found[g]) == [(*e, d) for e, d in zip(own, want)]
        assert acyclic([e[:2] for e in found[g] if not e[3]])


def test_large_groups_lose_their_cycles_only_inside_of_parts(spark):
    rows = graphs(2, 12)
    found = by_graph([tuple(r) for r in cycles.break_cycles(spark.createDataFrame(rows, SCHEMA), task=3).collect()])
    parts = by_graph([tuple(r) for r in cycles.strong_parts(spark.createDataFrame(rows, SCHEMA).selectExpr("graph_id g", "source s", "target t"), Tables(spark)).collect()])
    for g, own in by_graph(rows).items():
        told = found[g]
        assert sorted(e[:3] for e in told) == sorted(own)
        assert acyclic([e[:2] for e in told if not e[3]])
        to = reach([e[:2] for e in own])
        assert all(e[0] in to[e[1]] for e in told if e[3])
        assert any(e[3] for e in told) == (not acyclic([e[:2] for e in own]))
        want = {(n, min(m for m in to if m in to[n] and n in to[m])) for n in to if any(m != n and m in to[n] and n in to[m] for m in to)}
        if len(own) > 3:
            assert set(parts.get(g, [])) == want


def test_large_groups_with_one_entry_are_dropped_as_by_the_whole_walk(spark):
    """Rings that are entered by one node from a lesser one, or by their own least node."""
    rows = [("a", "0", "5", "x"), ("a", "5", "7", "y"), ("a", "7", "3", "z"), ("a", "3", "5", "u"), ("a", "3", "9", "v"), ("a", "9", "9", "w")]
    rows += [("b", "8", "2", "x"), ("b", "2", "1", "y"), ("b", "1", "2", "z"), ("b", "1", "8", "u")]
    df = spark.createDataFrame(rows, SCHEMA)
    told = lambda task: sorted(map(tuple, cycles.break_cycles(df, task).collect()))
    assert told(4) == told(100)


def test_a_ring_of_many_edges(spark):
    n = 10_001
    ring = spark.range(n).selectExpr("'g' graph_id", "lpad(string(id), 6, '0') source", f"lpad(string((id + 1) % {n}), 6, '0') target", "string(id) edge_id")
    found = cycles.break_cycles(ring)
    assert [r.edge_id for r in found.where("dropped").collect()] == [str(n - 1)] and found.count() == n


@pytest.mark.parametrize("task", [1, 1000])
def test_process_graphs(spark, task):
    edges = [
        ("record:a", "record:b", "document_join"), ("record:b", "vendor:v", "paid_to"), ("vendor:v", "record:a", "has_receipt"),
        ("vendor:v", "record:c", "has_receipt"), ("record:c", "user:u:1", "posted_by"), ("record:a", "user:u:1", "posted_by"),
    ]
    df = spark.createDataFrame([(*e, f"e{k}") for k, e in enumerate(edges)], "source string, target string, edge_type string, edge_id string")
    nodes = spark.createDataFrame([(f"record:{x}",) for x in "abcd"], "node_id string")
    got = {tuple(r.record_ids): r for r in processes.process_graphs(nodes, df, "d", cap=1, task=task).collect()}
    told = {k: (r.entity_node_ids, r.source_node_ids, r.sink_node_ids, r.n_edges, r.capped, r.had_cycle) for k, r in got.items()}
    assert told == {
        ("a", "b"): (["user:u:1", "vendor:v"], ["record:a"], ["user:u:1", "vendor:v"], 4, True, True),
        ("c",): (["user:u:1", "vendor:v"], ["vendor:v"], ["user:u:1"], 2, False, False),
        ("d",): ([], ["record:d"], ["record:d"], 0, False, False),
    }
    assert all(r.graph_id.startswith("PG-") and len(r.graph_id) == 19 for r in got.values())


def test_sections_keep_their_first_lines(spark):
    from tallyweave.operators import sections

    lines = spark.createDataFrame([("g", 2, f"r{k}", 0, "", "x" * 10) for k in range(9)] + [("h", 2, "r", 0, "", "y")], "graph_id string, section int, a string, n int, b string, line string")
    graphs = spark.createDataFrame([("g",), ("h",), ("i",)], "graph_id string")
    got = {(r.graph_id, r.section): r.text for r in sections.fitted(lines, graphs, sections.BUDGETS | {"Records": 60}).collect()}
    assert got["g", 2] == "\n".join(["x" * 10] * 3 + ["... 6 more"]) and got["h", 2] == "y" and ("i", 2) not in got
    assert got["i", 4] == sections.EMPTY["Relationships"] and got["i", 6] == "\n".join(sections.CONVENTIONS)


def test_edges_between_records_of_two_graphs_belong_to_none(spark):
    edges = [
        ("record:a", "record:b", "document_join"), ("record:a", "record:b", "references"), ("record:b", "record:c", "references"), ("record:x", "record:c", "references"),
        ("record:c", "record:x", "document_join"), ("vendor:v", "document:d", "documented"), ("record:x", "vendor:v", "paid_to"), ("vendor:v", "record:b", "has_receipt"),
    ]
    df = spark.createDataFrame([(*e, f"e{k}") for k, e in enumerate(edges)], "source string, target string, edge_type string, edge_id string")
    records = spark.createDataFrame([("a", "record:a"), ("a", "record:b"), ("c", "record:c")], "cluster string, node_id string")  # x is no record that is known
    got = sorted((r.cluster, r.edge_id) for r in processes.own_edges(records, df).collect())
    assert got == [("a", "e0"), ("a", "e1"), ("a", "e7"), ("c", "e3"), ("c", "e4")]


def test_edges_that_lie_together_need_no_rounds(spark, monkeypatch):
    from tallyweave.operators import components

    stars = []
    monkeypatch.setattr(components, "_star", lambda edges, large, star=components._star: stars.append(large) or star(edges, large))
    chains = [(f"n{g:03}-{k}", f"n{g:03}-{k + 1}") for g in range(200) for k in range(7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chains, "a string, b string").coalesce(1)).collect()}
    assert got == {f"n{g:03}-{k}": f"n{g:03}-0" for g in range(200) for k in range(8)} and not stars
