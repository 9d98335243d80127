"""Operators on small fixtures, and every registered query against its SQL oracle."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import components, evidence, graph, profile, rules, store
from tallyweave.operators.ranks import ranked
from tallyweave.plans import catalog, reports

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_components_match_union_find(spark):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7), (None, 3), (5, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_ranks_and_quantiles(spark):
    values = [5, 1, 7, 3, 2, 6, 4, 4, None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v int")
    got = [r.k for r in ranked(df.where("v is not null"), [F.desc("v"), F.col("k")]).orderBy("rank").collect()]
    assert got == [2, 5, 0, 6, 7, 3, 4, 1]
    seven = spark.createDataFrame([(float(v),) for v in range(1, 8)], "v double")
    assert [r.value for r in profile.quantiles(seven, "v", (0.0, 0.25, 0.5, 1.0)).orderBy("p").collect()] == [1.0, 3.0, 4.0, 7.0]
    assert profile.quantiles(seven.where("v > 9"), "v").count() == 0


def test_document_join_leaves_hubs_out(spark):
    rows = [(f"r{k:02}", "t", "2024-01-01", "hub", None) for k in range(30)] + [("a", "t", None, "d1", "d2"), ("b", "t", "2024-01-02", "d1", " "), ("c", "t", "2024-01-01", "D1", "d2"), ("d", "t", "2023-01-01", None, "d1")]
    df = spark.createDataFrame(rows, "record_id string, record_type string, date string, f string, g string")
    got = {(r.source, r.target) for r in graph.document_join(graph.document_ids(df, ["f", "g"])).collect()}
    assert got == {("a", "d"), ("d", "b"), ("a", "c")}


def test_users_are_inherited_only_if_all_agree(spark):
    df = spark.createDataFrame([(r, "t", "2024", d) for r, d in [("a", "1"), ("b", "1"), ("c", "2"), ("d", "2"), ("e", "2")]], "record_id string, record_type string, date string, f string")
    users = spark.createDataFrame([("a", "u1"), ("c", "u1"), ("d", "u2")], "record_id string, user_id string")
    got = graph.inherited_users(graph.document_ids(df, ["f"]), users).collect()
    assert [tuple(r) for r in got] == [("b", "u1", "a")]


def test_completeness_of_entries(spark):
    rows = [("g1", "M1", "2024-01-05", 100.0, "400001", None, "M1-DOC"), ("g2", "M3", None, None, None, None, " "), ("g2", "M4", "", None, None, "c", None)]
    df = spark.createDataFrame(rows, "graph_id string, record_id string, date string, amount double, vendor_id string, customer_id string, doc_id string")
    got = {r.graph_id: tuple(r)[1:] for r in profile.completeness(df).collect()}
    assert got == {"g1": (1, True, True, True, True), "g2": (2, False, False, True, False)}


def test_split_payments_and_shell_vendors(spark):
    rows = [("200007", "2025-10-14", x) for x in (9780.0, 9820.0, 9750.0, 9690.0)] + [("1", "2025-10-14", 9999.0), ("2", "2025-01-01", 10000.0)]
    df = spark.createDataFrame(rows, "vendor_id string, date string, amount double")
    got = rules.split_payments(df, 9000, 10000, ["vendor_id", "date"], 10000).collect()
    assert [(r.vendor_id, r.n_payments, r.combined) for r in got] == [("200007", 4, 39040.0)]
    found = {r.vendor_id: (r.n_round, r.without_receipt) for r in rules.shell_vendors(df, spark.createDataFrame([("200007",), ("1",)], "vendor_id string")).collect()}
    assert found == {"200007": (4, False), "2": (1, True)}


def test_one_unknown_id_drops_a_proposal(spark):
    cited = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "x"]), (3, [])], "proposal_id int, record_ids array<string>")
    records = spark.createDataFrame([("a",), ("b",)], "record_id string")
    assert [tuple(r) for r in evidence.valid_proposals(cited, records).collect()] == [(1, 2)]
    assert sorted((r.proposal_id, r.position, r.record_id) for r in evidence.rehydrated(cited, records).collect()) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "a")]


def test_a_failing_scorer_spares_the_other_entries(spark):
    def scorer(row):
        if row["k"] == 2:
            raise RuntimeError("no answer")
        return [{"title": f"t{row['k']}"}]

    got = evidence.scored(spark.range(1, 4).withColumnRenamed("id", "k"), scorer, "title string").collect()
    assert sorted((r.title or "", r.error or "") for r in got) == [("", "no answer"), ("t1", ""), ("t3", "")]


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "x")], "k int, seq int, v string")
    now = store.latest(df, ["k"], "seq")
    assert sorted(map(tuple, now.collect())) == [(1, 2, "new"), (2, 1, "x")]
    for version, rows in enumerate([df, now], 1):
        store.save_version({"t": rows}, f"file://{tmp_path}/s", version)
    assert store.load_version(spark, f"file://{tmp_path}/s", ["t"])["t"].count() == 2
    assert [r.k for r in store.page(now, ["k"], limit=0, offset=-3).collect()] == [1]
    store.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":1,"b":null}'


@pytest.fixture(scope="module")
def oracle():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


QUERIES, SQL = catalog.queries() | reports.queries(), catalog.oracle_sql() | reports.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, oracle, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = oracle.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_paths(spark):
    edges = spark.createDataFrame([("a", "c"), ("b", "a"), ("d", "b"), ("d", "c"), ("d", "e"), ("e", "f"), ("x", "y"), ("x", "x")], "source string, target string")
    pairs = [("a", "d"), ("d", "a"), ("a", "f"), ("a", "x"), ("y", "y"), ("y", "x"), ("n", "n"), ("a", None), ("a", "d")]
    found = graph.paths(edges, spark.createDataFrame(pairs, "start string, end string"), 3).collect()
    ways = {("a", "d"): "abd", ("d", "a"): "dba", ("y", "y"): "y", ("y", "x"): "yx", ("n", "n"): "n"}
    want = [(s, e, len(ways[s, e]) - 1, list(ways[s, e])) if (s, e) in ways else (s, e, None, None) for s, e in pairs]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert [r.length for r in graph.paths(edges, spark.createDataFrame([("a", "f")], "start string, end string")).collect()] == [4]
    assert graph.paths(edges.limit(0), spark.createDataFrame([], "start string, end string")).collect() == []


def test_details_bring_edges_to_their_records_once(spark):
    from tallyweave.operators import details

    edges = [("record:1", "vendor:a", "paid_to", "e1", ["1"]), ("record:2", "vendor:a", "paid_to", "e2", ["2", "3"]), ("vendor:a", "user:u", "references", "e3", ["1", "2"]), ("record:9", "user:w", "posted_by", "e4", [])]
    edges = spark.createDataFrame(edges, "source string, target string, edge_type string, edge_id string, record_ids array<string>")
    records = spark.createDataFrame([("1", "x", "2024-01-01", 1.5), ("2", "m", "", 2.0)], "record_id string, record_type string, date string, amount double")
    got = {r.entity: r for r in details.entity_profiles(None, edges, records, ["m"]).collect()}
    told = {k: (r.n_records, r.first_date, r.sum_amount, r.paid_to, r.references, r.posted_by, r.n_masters, r.master_ids, r.n_others) for k, r in got.items()}
    assert told == {"vendor:a": (3, "2024-01-01", 3.5, 2, 1, 0, 1, ["2"], 1), "user:u": (2, "2024-01-01", 3.5, 0, 1, 0, 1, ["2"], 1), "user:w": (0, None, 0.0, 0, 0, 1, 0, [], 0)}
    member = spark.createDataFrame([("1", "g"), ("2", "g"), ("3", "h"), ("1", "g")], "record_id string, graph_id string")
    types = details.entry_edge_types(edges, member)
    assert sorted(tuple(r) for r in types.collect()) == [("g", "paid_to"), ("g", "references"), ("h", "paid_to")]
    assert types._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 3


def test_the_node_table_shuffles_a_record_once(spark):
    found = reports.queries()["G1_node_table"](spark, DATA)
    found.count()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 2


def test_sections_are_put_together_where_an_entrys_rows_are(spark):
    from tallyweave.operators import sections

    rows = [("g", f"r{k}", "x", "p.csv", k, {"DATUM": "2024-01-01", "A": None}) for k in range(5)]
    entries = spark.createDataFrame(rows, "graph_id string, record_id string, record_type string, path string, row_number int, data map<string,string>").repartition("graph_id")
    found = sections.gathered(sections.record_blocks(entries), 2)
    told = {s.section: (s.n_lines, len(s.lines), s.lines[0].line) for s in found.first().told}
    assert told == {1: (5, 2, "2024-01-01  DATUM  r0 x"), 2: (20, 8, "Record r0 (x)")}
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_profiles_of_records_own_edges(spark):
    from tallyweave.operators import details

    links = [("1", "x", "2024-01-01", 1.5, "vendor:a", "paid_to"), ("1", "x", "2024-01-01", 1.5, "vendor:a", "references"), ("2", "m", "", 2.0, "vendor:a", "paid_to"), ("2", "m", "", 2.0, "user:u", "posted_by")]
    links = spark.createDataFrame(links, "record_id string, record_type string, date string, amount double, entity string, edge_type string")
    got = {r.entity: (r.n_records, r.first_date, r.sum_amount, r.paid_to, r.references, r.posted_by, r.n_masters, r.master_ids, r.n_others) for r in details.link_profiles(links, ["m"]).collect()}
    assert got == {"vendor:a": (2, "2024-01-01", 3.5, 2, 1, 0, 1, ["2"], 1), "user:u": (1, None, 2.0, 0, 0, 1, 1, ["2"], 1)}


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")


def test_cited_records_meet_the_table_once(spark):
    from tallyweave.operators import evidence

    records = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("c", 3.0)], "record_id string, amount double")
    proposals = spark.createDataFrame([("x", ["b", "a", "b"]), ("y", ["c", "nowhere"]), ("z", [])], "title string, record_ids array<string>")
    found, rows = evidence.findings(proposals, records, "d")
    assert [(r.title, r.evidence_count) for r in found.collect()] == [("x", 2)]
    assert sorted((r.position, r.record_id, r.amount, r.evidence_id[-3:]) for r in rows.collect()) == [(1, "b", 2.0, "-E1"), (2, "a", 1.0, "-E2")]
    assert _exchanges(rows) <= 4


def test_the_edge_table_shuffles_a_record_once(spark):
    found = reports.queries()["G1_edge_table"](spark, DATA)
    found.count()
    assert _exchanges(found) == 1


def test_references_are_told_apart_where_the_join_has_them(spark):
    entities = spark.createDataFrame([("1", "vendor", "a"), ("1", "vendor", "a"), ("2", "user", "u")], "record_id string, entity_type string, entity_id string")
    labels = spark.createDataFrame([("1", "paid_to", "a")], "record_id string, label string, value string")
    kinds = spark.createDataFrame([("paid_to", "vendor")], "label string, entity_type string")
    found = graph.references(entities, labels, kinds)
    assert sorted(map(tuple, found.collect())) == [("record:1", "vendor:a", "paid_to", ["1"]), ("record:2", "user:u", "references", ["2"])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [record_id" in plan and "Aggregate [source" not in plan


def test_a_user_on_one_row_of_a_record_is_its_own(spark):
    ids = spark.createDataFrame([("1", "x", "", "d", "u"), ("1", "x", "", "d", None), ("2", "x", "", "d", None)], "record_id string, record_type string, date string, doc_id string, user_id string")
    assert [tuple(r) for r in graph.inherited_users(ids).collect()] == [("2", "u", "1")]


def test_ids_of_many_records_join_them_too(spark):
    rows = [(f"r{k:03}", "t", f"2024-01-{k % 28 + 1:02}", "hot") for k in range(900)] + [(f"r{k:03}", "t", f"2024-01-{k % 28 + 1:02}", "warm") for k in range(30)]
    rows += [("x", "t", None, "own"), ("x", "t", "2024", "own"), ("r001", "t", "2024-01-02", "hot")]
    ids = spark.createDataFrame(rows, "record_id string, record_type string, date string, doc_id string")
    want = set()
    for doc in ("hot", "warm"):
        order = sorted({(date, kind, r) for r, kind, date, d in rows if d == doc})
        want |= {(a[2], b[2]) for a, b in zip(order, order[1:])}
    assert graph.by_hotness(ids)[1].select("doc_id").distinct().collect() == [("hot",)]
    found = graph.document_join(ids, most=None).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_ids_of_many_records_tell_their_user(spark):
    rows = [(f"r{k:03}", "u" if k in (3, 5) else None, "hot") for k in range(900)] + [(f"w{k:02}", "v" if k == 7 else None, "warm") for k in range(30)]
    rows += [(f"z{k:03}", f"u{k}" if k < 2 else None, "torn") for k in range(900)] + [("r003", None, "hot")]
    ids = spark.createDataFrame(rows, "record_id string, user_id string, doc_id string").selectExpr("*", "'t' record_type", "'' date")
    got = sorted(map(tuple, graph.inherited_users(ids, most=None).collect()))
    assert got == [(f"r{k:03}", "u", "r003") for k in range(900) if k not in (3, 5)] + [(f"w{k:02}", "v", "w07") for k in range(30) if k != 7]


@pytest.mark.parametrize("name", ["J1_document_join", "J3_inherited_users"])
def test_document_joins_have_no_cap(name):
    assert "BETWEEN" not in catalog.oracle_sql()[name]


def test_process_graphs_bring_an_orders_rows_together_once(spark, monkeypatch):
    from tallyweave.shared import Tables

    records, edges = reports._processes(spark, DATA)
    for rows in (records, edges):
        rows.count()
        assert _exchanges(rows) == 1
    written, dropped = [], []
    monkeypatch.setattr(Tables, "write", lambda self, df, name, write=Tables.write: written.append(name) or write(self, df, name))
    monkeypatch.setattr(Tables, "drop", lambda self, *names, drop=Tables.drop: dropped.extend(names) or drop(self, *names))
    reports.queries()["G4_process_graphs"](spark, DATA).count()
    assert set(written) - set(dropped) == {"clusters", "own-edges"}


def test_what_is_told_of_an_entry_is_worked_out_once(spark):
    from tallyweave.operators import sections

    lines = spark.createDataFrame([("g", 2, "r", 0, "", "x")], "graph_id string, section int, a string, n int, b string, line string")
    found = sections.fitted(lines, lines.select("graph_id"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count(sections.CONVENTIONS[0]) <= 2


def test_details_of_entities_bring_records_together_once(spark):
    from tallyweave.plans import details

    found = details.queries()["A3_entity_details"](spark, DATA)
    found.count()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(source" in x or "Exchange hashpartitioning(edge" in x]
    assert {x.split("hashpartitioning(")[1].split("#")[0] for x in plan.splitlines() if "REPARTITION_BY_COL" in x} == {"record_id"}
