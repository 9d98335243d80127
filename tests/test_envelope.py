"""Typed records out of rows of files, on small rows that show each rule."""

import uuid

import pytest

from tallyweave.operators import envelope

ROWS = "path string, sheet string, row_number int, columns array<string>, data map<string,string>, text string"


def rows(spark, path, columns, *lines, sheet=None):
    return spark.createDataFrame([(path, sheet, n, columns, dict(zip(columns, line, strict=False)), None) for n, line in enumerate(lines, 1)], ROWS)


def cells(r):
    return {c.name: c.text if c.number is None else c.number for c in r.cells}


def ids(r):
    return [(e.entity_type, e.entity_id) for e in r.entities]


def test_ledger_records(spark):
    columns = ["Buchungsdatum", "BELEGDATUM", "BUCHUNGSBETRAG", "SACHKONTONUMMER", "GEGENKONTO", "ERFASSER", "BENUTZERKENNUNG", "BUCHUNGSTEXT", "PERIODENCODE", "BUCHUNGSWÄHRUNG"]
    df = rows(
        spark, "/x/Sachkonten/Sachkontobuchungen.txt", columns,
        ("05.03.2024", "04.03.2024", "-1.234,50", "1400-100007", "8400", "E", "U1", "Miete", "2024-03", "EUR"),
        ("", "31.02.2024", "n/a", "040000-000191", "8400", "E", " ", None, "", None),
        ("5.3.24", None, "12", "x", "x", "", "", "", "", ""),
    )
    a, b, c = envelope.ledger_records(df, "d").orderBy("row_number").collect()
    assert (a.record_type, a.date, a.amount, a.currency, a.period, a.text) == ("journal_entry", "2024-03-05", -1234.5, "EUR", "2024-03", "Miete")
    assert ids(a) == [("account", "1400"), ("customer", "100007"), ("account", "8400"), ("user", "E"), ("user", "U1")]
    assert a.relationships == {"posted_by": "U1", "to_account": "8400"}
    assert (b.date, b.amount, cells(b)["BUCHUNGSBETRAG"], b.relationships) == ("2024-02-31", None, "n/a", {"posted_by": "E", "to_account": "8400"})
    assert ids(b)[:2] == [("account", "040000"), ("asset", "040000-000191")]
    assert (c.date, c.amount, ids(c)) == ("5.3.24", 12.0, [("account", "x")])
    space = uuid.uuid5(uuid.NAMESPACE_URL, "dossier:d")
    assert a.record_id == str(uuid.uuid5(space, f"{a.file_id}:1"))


def test_other_ledgers_have_other_relations(spark):
    columns = ["LIEFERANTENKONTONUMMER", "ANLAGENGRUPPE", "GEGENKONTO"]
    of = lambda name: envelope.ledger_records(rows(spark, f"/{name}", columns, ("200001", "040000", "7")), "d").first()
    assert of("Lieferantenbuchungen.txt").relationships == {"paid_to": "200001"}
    assert of("Anlagenbuchungen.txt").relationships == {"capitalized_to": "040000"}
    assert of("Sonstiges.txt").relationships == {} and of("Sonstiges.txt").record_type == "master_data"


def test_csv_records(spark):
    columns = ["KONTO", "ART", "GEGENKONTO", "Kreditor", "KREDITORNAME", "DATUM", "BETRAG_EUR", "GEAENDERT_VON", "Notiz", "Kunde_nr"]
    df = rows(
        spark, "/x/Kreditoren_2024.csv", columns,
        ("200001", "Kreditor", "1600", "K1", "Nord GmbH", "1.2.2024", "1.000,00", "U7", "3,5", "C1"),
        ("200001", "?", "0,0", None, "", "30.13.2024", "abc", "", "4", ""),
    )
    a, b = envelope.csv_records(df, "d").orderBy("row_number").collect()
    assert (a.record_type, a.date, a.period, a.amount, a.currency) == ("vendor_posting", "2024-02-01", "2024-02", 1000.0, "EUR")
    assert [tuple(e) for e in a.entities] == [("vendor", "200001", None), ("account", "1600", None), ("vendor", "K1", "Nord GmbH"), ("user", "U7", None), ("customer", "C1", None)]
    assert a.relationships == {"received_from": "K1", "changed_by": "U7", "sold_to": "C1"} and cells(a)["Notiz"] == 3.5
    assert (b.date, b.amount, b.currency, ids(b), b.relationships) == (None, None, None, [("account", "200001")], {})


@pytest.mark.parametrize(("columns", "line", "relations"), [
    (["lieferant", "kreditor"], ("a", "b"), {"received_from": "a"}),  # the first column wins
    (["bearbeiter", "bearbeiter2"], ("a", "b"), {"processed_by": "b"}),  # a user's column overrides
    (["konto_bearbeiter", "x"], ("a", "b"), {"processed_by": "a"}),  # an account, yet a relation
    (["kreditor_kunde", "kunde"], ("a", "b"), {"received_from": "a", "sold_to": "b"}),  # a column gives one label
])
def test_csv_relations(spark, columns, line, relations):
    assert envelope.csv_records(rows(spark, "/a.csv", columns, line), "d").first().relationships == relations


def test_sheet_records(spark):
    df = rows(spark, "/x/OP-Liste_Debitoren.xlsx", ["Nr", "Konto", "Saldo", "Datum", "Kundenname"], ("D-1", "1400", "12,50", "2024-05-06T00:00:00", "Süd AG"), ("D 2", "", "x", "7.8.2024", None), sheet="S")
    a, b = envelope.sheet_records(df, "d").orderBy("row_number").collect()
    assert (a.record_type, a.date, a.amount, a.relationships) == ("open_item", "2024-05-06", 12.5, {"customer": "Süd AG", "account": "1400"})
    assert ids(a) == [("customer", "D-1"), ("account", "1400"), ("customer", "Süd AG")]
    assert (b.date, b.amount, ids(b)) == ("2024-08-07", None, [])
    bare = envelope.sheet_records(rows(spark, "/Saldenliste.xlsx", ["column_0", "column_1"], ("a", "1"), sheet="S"), "d").first()
    assert bare.entities == [] and bare.record_type == "balance"


def test_entity_edges(spark):
    df = rows(spark, "/Anlagenbuchungen.txt", ["ANLAGENNUMMER", "ANLAGENGRUPPE", "BENUTZERKENNUNG"], ("040000", "040000", "U1"), ("040000-000191", None, None))
    records = envelope.ledger_records(df, "d")
    first = records.where("row_number = 1").first().record_id
    got = {(e.source == f"record:{first}", e.target, e.edge_type) for e in envelope.entity_edges(records).collect()}
    assert got == {(True, "entity:account:040000", "capitalized_to"), (True, "entity:user:U1", "posted_by"), (False, "entity:asset:040000-000191", "references")}


def test_empty_rows_and_bad_files(spark):
    df = rows(spark, "/a.csv", ["KONTO"]).unionByName(spark.createDataFrame([("/b.csv", None, -1, [], {}, "error")], ROWS))
    for read in (envelope.ledger_records, envelope.csv_records, envelope.sheet_records):
        assert read(df, "d").collect() == []
    odd = spark.createDataFrame([("/c.csv", None, 1, [], None, None)], ROWS)
    assert [r.entities for read in (envelope.ledger_records, envelope.csv_records, envelope.sheet_records) for r in read(odd, "d").collect()] == [[], [], []]


def test_first_user_doesnt_filter_by_the_whole_expression_of_the_entities(spark):
    from tallyweave.plans import exports

    plan = exports.queries()["W5_first_user_of_record"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan
    assert not [line for line in plan.splitlines() if ("Filter" in line or "Join" in line) and "regexp_extract" in line]


def test_csv_records_read_a_cell_once_and_carry_only_the_roles_that_are_used(spark):
    from tallyweave.plans import ledgers

    plan = ledgers.queries()["P5_csv_projection"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with") + plan.count("transform(roles") <= 3  # cells, dates, amounts
    assert "stringsplitsql" not in plan
    assert "roles_relations" not in plan and "roles_entities" not in plan
