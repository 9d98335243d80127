"""Snapshots, runs of an outside scorer, repairs, previews and records of texts."""

import pytest

from tallyweave.functions import repair
from tallyweave.operators import envelope, evidence, preview, substrings
from tallyweave.operators.snapshots import Conflict, Snapshots


def test_of_two_writers_one_fails_and_readers_keep_to_their_snapshot(spark, tmp_path):
    at = Snapshots(spark, f"file://{tmp_path}/s")
    assert at.current() == 0
    assert at.commit({"t": spark.range(1)}, 0) == 1
    pinned = at.read("t", 1)
    base = at.current()
    assert at.commit({"t": spark.range(2)}, base) == 2
    with pytest.raises(Conflict):
        at.commit({"t": spark.range(3)}, base)
    assert (pinned.count(), at.read("t").count(), at.current()) == (1, 2, 2)


def test_a_rename_never_replaces_a_published_snapshot(spark, tmp_path, monkeypatch):
    """Both writers look before either has published."""
    at = Snapshots(spark, f"file://{tmp_path}/s")
    at.commit({"t": spark.range(1)}, 0)
    late = Snapshots(spark, f"file://{tmp_path}/s")
    monkeypatch.setattr(late, "current", lambda: 0)
    with pytest.raises(Conflict):
        late.commit({"t": spark.range(5)}, 0)
    assert at.read("t").count() == 1


def test_runs_of_a_scorer(spark):
    def entry_scorer(row):
        if row["k"] == 2:
            raise ValueError("no answer")
        return [{"title": f"t{row['k']}"}]

    def stopping_scorer(row):
        raise evidence.StopRun("no access")

    rows = spark.range(1, 5).withColumnRenamed("id", "k").coalesce(1)
    assert sorted(r.title for r in evidence.checked(evidence.scored(rows, entry_scorer, "title string", tries=2)).collect()) == ["t1", "t3", "t4"]
    told = evidence.scored(rows, stopping_scorer, "title string")
    assert [r.error for r in told.collect()] == ["stopped: no access"] * 4
    with pytest.raises(evidence.RunStopped, match="no access"):
        evidence.checked(told)
    with pytest.raises(evidence.RunStopped, match="all 1"):
        evidence.checked(evidence.scored(rows.where("k = 2"), entry_scorer, "title string"))


def test_repairs(spark):
    cases = ["Grüße", "naïve â", "“quoted” – Ünï", "plain", None, "Â", "日本 Ã", "Ã\x8d", "a\nÃ¼"]
    broken = [c if c is None else c.encode().decode("latin-1") for c in cases]
    windows = "“quoted” – Ü".encode().decode("cp1252", "ignore")
    df = spark.createDataFrame([(k, c, b) for k, (c, b) in enumerate(zip(cases, broken))] + [(99, "x", windows)], "k int, whole string, broken string")
    got = {r.k: r for r in df.select("k", repair.repaired(df.whole).alias("whole"), repair.repaired(df.broken).alias("broken")).collect()}
    assert [got[k].broken for k in (0, 1, 3, 4)] == ["Grüße", "naïve â", "plain", None]
    assert got[1].whole == "naïve â" and got[5].whole == "Â" and got[6].whole == "日本 Ã" and got[8].whole == "a\nü"
    good = "“q” Übel"
    row = spark.createDataFrame([(good.replace("”", "").encode().decode("cp1252"),)], "t string")
    assert row.select(repair.repaired(row.t)).first()[0] == good.replace("”", "")
    nested = spark.createDataFrame([({"Ã¼": ["Ã¤", None]}, ("Ã¶", 1)), (None, None)], "m map<string,array<string>>, s struct<a: string, b: int>")
    out = nested.select(*[repair.repaired_value(nested[c], nested.schema[c].dataType).alias(c) for c in nested.columns]).collect()
    assert (out[0].m, tuple(out[0].s), out[1].m, out[1].s) == ({"ü": ["ä", None]}, ("ö", 1), None, None)


def test_names_inside_of_texts(spark):
    names = spark.createDataFrame([(x,) for x in ["U1", "anna", "x", "", None, "zz", "U1"]], "name string")
    texts = spark.createDataFrame([(x,) for x in ["Rolle-u12", "JOHANNAS", "U1", "", None, "ax", "U1"]], "text string")
    got = sorted(map(tuple, substrings.contained(names, texts).collect()))
    assert got == [("U1", "Rolle-u12"), ("U1", "U1"), ("anna", "JOHANNAS"), ("x", "ax")]


def test_previews_and_headers(spark):
    schema = "path string, sheet string, row_number int, columns array<string>, data map<string,string>, text string"
    rows = spark.createDataFrame([("a", None, k, ["X", "Y"], {"X": str(k)}, None) for k in (2, 3, 4)] + [("b", None, 1, [], {}, "words")], schema)
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    got = {r.path: (r.kind, r.headers, r.total, r.rows) for r in preview.previews(files, rows, 2).collect()}
    assert got == {"a": ("table", ["X", "Y"], 3, [["2", ""], ["3", ""]]), "b": ("text", [], 1, [["words"]]), "c": ("empty", [], 0, None)}
    sheets = spark.createDataFrame([("s", 0, ["Banner", "", ""]), ("s", 1, ["Konto", "Name", "Wert"]), ("t", 0, ["1", "2"]), ("t", 20, ["A", "B"])], "sheet string, k int, cells array<string>")
    assert {r.sheet: r.header for r in preview.header_rows(sheets).collect()} == {"s": 1, "t": None}


def test_records_of_all_kinds(spark):
    schema = "path string, sheet string, row_number int, columns array<string>, data map<string,string>, text string"
    rows = spark.createDataFrame([
        ("/x/a.docx", None, 1, [], {}, "MV-U12 zahlt EUR 1.234,50 am 3.2.2024, MV-U12"), ("/x/b.csv", None, 2, ["Kunde"], {"Kunde": "7"}, None),
        ("/x/Sachkonten.txt", None, 1, ["KONTO"], {"KONTO": "9"}, None), ("/x/bad.csv", None, -1, [], {}, "ValueError"),
    ], schema)
    got = {r.path: r for r in envelope.records(rows, "d").collect()}
    assert set(got) == {"/x/a.docx", "/x/b.csv", "/x/Sachkonten.txt"}
    a = got["/x/a.docx"]
    assert (a.record_type, a.date, a.amount, a.currency, [tuple(e) for e in a.entities]) == ("document_text", "2024-02-03", 1234.5, "EUR", [("user", "MV-U12", None)])
    assert [(e.entity_type, e.entity_id) for e in got["/x/b.csv"].entities] == [("customer", "7")]
