"""Rows of files as typed records: cells, date, amount, entities and relationships.

Input are rows as the readers of `sources.files` give them (path, sheet, row_number, columns,
data, text). The rules on column names run once for each header (`operators.roles`); a row is read by
the positions of its header's roles. An id keeps the spelling of its file, numbers too.
"""

from __future__ import annotations

import sys
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import exprs
from tallyweave.operators import roles

# Columns and file names of the export formats.
LEDGER_TYPES = {
    "sachkontobuchungen": "journal_entry", "lieferantenbuchungen": "vendor_posting", "kundenbuchungen": "customer_posting", "sachkonten": "master_data",
    "lieferanten": "master_data", "kunden": "master_data", "anlagen": "asset_record", "anlagenbuchungen": "asset_posting",
}
LEDGER_DATES = ["BUCHUNGSDATUM", "BELEGDATUM", "ERFASSUNGSDATUM", "LETZTER_AUSGLEICH", "WERTSTELLUNG"]
LEDGER_FIRST_DATES = ["BUCHUNGSDATUM", "BELEGDATUM", "WERTSTELLUNG"]
LEDGER_NUMBERS = ["BUCHUNGSBETRAG", "BUCHUNGSWERT"]
LEDGER_ENTITIES = {
    "account": ["SACHKONTONUMMER", "GEGENKONTO", "KONTO", "ANLAGENGRUPPE"], "vendor": ["LIEFERANTENKONTONUMMER"], "customer": ["KUNDENKONTONUMMER"],
    "user": ["BENUTZERKENNUNG", "ERFASSER", "GEAENDERT_VON"], "asset": ["ANLAGENNUMMER"],
}
CSV_TYPES = [
    ("stammdatenaenderungen", "master_change"), ("wareneingangsliste", "goods_receipt"), ("warenausgangsliste", "goods_dispatch"), ("fakturajournal", "invoice"),
    ("freigabe-log", "master_data"), ("gesellschafterliste", "master_data"), ("kreditlimitliste", "master_data"), ("buchungen_folgeperiode", "journal_entry"),
    ("saldenliste", "balance"), ("op-liste", "open_item"), ("op_liste", "open_item"), ("berechtigungsauswertung", "permission"), ("sachkonto", "journal_entry"),
    ("kreditoren", "vendor_posting"), ("debitoren", "customer_posting"), ("anlagenspiegel", "asset_record"), ("anlagenbuchung", "asset_posting"),
]
CSV_DATES = ["datum", "date", "genehmigt_am", "erstellt_am", "geaendert_am"]
CSV_AMOUNTS = ["betrag", "wert", "summe", "saldo", "limit", "haben", "soll", "netto", "brutto", "steuer", "mwst", "eur"]
CSV_LABELS = ["name", "bezeichnung", "beschreibung", "text", "bemerkung"]
CSV_ENTITIES = [
    ("konto", "account"), ("sachkonto", "account"), ("gegenkonto", "account"), ("kreditor", "vendor"), ("lieferant", "vendor"), ("debitor", "customer"),
    ("kunde", "customer"), ("kostenstelle", "cost_center"), ("geaendert_von", "user"), ("genehmigt_von", "user"), ("erstellt_von", "user"),
    ("bearbeiter", "user"), ("benutzer", "user"), ("user", "user"), ("anlage", "asset"), ("anlagen_nr", "asset"),
]
CSV_RELATIONS = [
    ("received_from", ["kreditor", "lieferant"]), ("sold_to", ["debitor", "kunde"]), ("changed_by", ["geaendert_von"]), ("approved_by", ["genehmigt_von"]),
    ("created_by", ["erstellt_von"]), ("processed_by", ["bearbeiter"]),
]
CSV_ACCOUNT_TYPES = {"kreditor": "vendor", "debitor": "customer"}
SHEET_TYPES = [
    ("Berechtigungsauswertung", "permission", "user"), ("OP-Liste_Debitoren", "open_item", "customer"), ("OP-Liste_Kreditoren", "open_item", "vendor"),
    ("OP-Liste", "open_item", "vendor"), ("Saldenliste", "balance", "account"), ("Abstimmung", "balance", "account"),
]
SHEET_ENTITIES = [
    ("konto|account|sachkonto|kto", "account"), ("lieferant|kreditor|vendor|supplier", "vendor"), ("kunde|debitor|customer|client", "customer"),
    ("benutzer|user|anwender|erfasser|bearbeiter", "user"),
]
SHEET_AMOUNTS = "betrag|saldo|amount|summe|wert|haben|soll|debit|credit"
SHEET_DATES = "datum|date|buchungsdatum|belegdatum|faelligkeit"
RELATION_TARGETS = {
    "posted_by": "user", "changed_by": "user", "approved_by": "user", "created_by": "user", "processed_by": "user", "paid_to": "vendor", "received_from": "vendor",
    "sold_to": "customer", "to_account": "account", "counter_account": "account", "capitalized_to": "account",
}

_ENTITY = "array<struct<entity_type:string,entity_id:string,label:string>>"
_ISO = r"^\d{4}-\d{2}-\d{2}$"


def _has(name: Column, parts: list[str]) -> Column:
    """Whether a name contains one of the parts, in any case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(name), F.lit(p)) for p in parts])


def is_label(name: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(F.lower(name), F.lit(s)) for s in CSV_LABELS])


def _with_cells(rows: DataFrame, of, date, number) -> DataFrame:
    """Rows with their header's roles (roles_...) and the array of cells (name, text, number), in column
    order. date, number: how a text is read where its column's role allows it. A cell's text is a
    variable of its own, as functions of arrays work out a repeated expression again; its date is
    asked for twice by columns of dates only."""
    rows = roles.with_roles(rows, of, sys.modules[__name__])
    found = F.transform("columns", lambda c: F.try_element_at("data", c))
    values = F.when(F.equal_null(F.map_keys("data"), F.col("columns")), F.map_values("data")).otherwise(found)
    rows = rows.withColumn("_raw", F.transform(values, lambda v: F.nullif(F.trim(v), F.lit(""))))

    def cell(c: Column, v: Column) -> Column:
        day = F.when(c["date"] & v.isNotNull(), date(v))
        counts = (c["number"] == roles.NUMBER) | (c["number"] == roles.NO_DATE) & day.isNull()
        return F.struct(c["name"].alias("name"), F.coalesce(day, v).alias("text"), F.when(counts & v.isNotNull(), number(v)).alias("number"))

    return rows.withColumn("cells", F.zip_with("roles_cells", "_raw", cell)).drop("_raw")


def _first(cells: Column, test) -> Column:
    return F.get(F.filter(cells, test), 0)


def _at(k: Column) -> Column:
    return F.get("cells", k)


def _those(places: str | Column) -> Column:
    """The cells at the places of a role."""
    return F.transform(places, _at)


def _named(name: str) -> Column:
    """Text of the first column of that name in any case, null if blank."""
    return F.get("cells", F.try_element_at("roles_named", F.lit(name)))["text"]


def _relations(pairs: list[tuple[str, Column]]) -> Column:
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _entity(kind: Column, key: Column, label: Column) -> Column:
    return F.struct(kind.alias("entity_type"), key.alias("entity_id"), label.alias("label"))


def ledger_entities() -> Column:
    """By exact column names; a composite account number names a party or asset too. No labels."""
    none = F.lit(None).cast("string")

    def of_cell(e):
        x = _at(e["at"])
        parts = F.transform(exprs.composite_account(x["text"]), lambda p: _entity(p["entity_type"], p["entity_id"], none))
        own = F.when(e["special"], parts).otherwise(F.array(_entity(e["kind"], x["text"], none)))
        return F.when(x["text"].isNotNull(), own).otherwise(F.array().cast(_ENTITY))

    return F.array_distinct(F.flatten(F.transform("roles_entities", of_cell)))


def ledger_relations(stem: Column) -> Column:
    """Who posted, and the other side of a posting, which depends on the ledger's file."""
    of = lambda file, name: F.when(stem == file, _named(name))
    return _relations([
        ("posted_by", F.coalesce(_named("BENUTZERKENNUNG"), _named("ERFASSER"))),
        ("to_account", of("sachkontobuchungen", "GEGENKONTO")),
        ("paid_to", of("lieferantenbuchungen", "LIEFERANTENKONTONUMMER")),
        ("capitalized_to", of("anlagenbuchungen", "ANLAGENGRUPPE")),
    ])


def account_type() -> Column:
    """What the column ART says an account is (vendor or customer), or null."""
    art = F.lower(_first(_those("roles_kinds"), lambda x: x["text"].isNotNull() & x["number"].isNull())["text"])
    return reduce(lambda rest, kv: F.when(art == kv[0], F.lit(kv[1])).otherwise(rest), CSV_ACCOUNT_TYPES.items(), F.lit(None).cast("string"))


def _used(x: Column) -> Column:
    """Cells that may name an entity: filled, not zero (columns of labels have no such role)."""
    return x["text"].isNotNull() & (F.coalesce(x["number"], F.lit(1.0)) != 0)


def csv_entities() -> Column:
    """The first pattern that a column's name contains gives the type; only KONTO itself is retyped
    by ART. The label is the first filled one of the columns called after the id's column, or of any
    name column. Repeated entities of a row stay once."""

    def of_cell(e):
        kind = F.when(e["special"], F.coalesce(F.col("_account_type"), e["kind"])).otherwise(e["kind"])
        label = _first(_those(e["labels"]), lambda x: x["text"].isNotNull() & x["number"].isNull())["text"]
        return _entity(kind, _at(e["at"])["text"], label)

    return F.array_distinct(F.transform(F.filter("roles_entities", lambda e: _used(_at(e["at"]))), of_cell))


def csv_relations() -> Column:
    """Each label's first column that no earlier label took; a column whose entity is of the label
    itself (the users' columns) overrides, the last one."""
    pair = "array<struct<key: string, value: string>>"
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast(pair).alias("pairs"))

    def add(now: Column, x: Column) -> Column:
        first = _first(x["firsts"], lambda f: _used(_at(f["at"])) & ~F.array_contains(now["taken"], f["same"]))
        last = F.try_element_at(F.filter(_those(x["lasts"]), _used), F.lit(-1))["text"]
        own = F.struct(x["label"].alias("key"), F.coalesce(last, _at(first["at"])["text"]).alias("value"))
        took = F.concat(now["taken"], F.filter(F.array(first["same"]), lambda s: s.isNotNull()))
        return F.struct(took.alias("taken"), F.concat(now["pairs"], F.array(own)).alias("pairs"))

    pairs = F.aggregate("roles_relations", start, add)["pairs"]
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def sheet_entities(strategy: Column) -> Column:
    """Patterns in order; the first column of a real header falls back to what its file is about.
    The label is the id."""
    usable = lambda e: _at(e["at"])["text"].isNotNull() & (~e["special"] | strategy.isNotNull() & _at(e["at"])["text"].rlike(r"(?U)^[\w\-]+$"))
    of_cell = lambda e: _entity(F.coalesce(e["kind"], strategy), _at(e["at"])["text"], _at(e["at"])["text"])
    return F.array_distinct(F.transform(F.filter("roles_entities", usable), of_cell))


def sheet_relations(entities: Column) -> Column:
    """The last entity of each type, by its type."""
    kinds = F.array_distinct(F.transform(entities, lambda e: e["entity_type"]))
    last = lambda k: F.try_element_at(F.filter(entities, lambda e: e["entity_type"] == k), F.lit(-1))["entity_id"]
    return F.map_from_entries(F.transform(kinds, lambda k: F.struct(k.alias("key"), last(k).alias("value"))))


def _file() -> tuple[Column, Column]:
    name = F.substring_index("path", "/", -1)
    return name, F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))


def _numbered(rows: DataFrame, dossier: str) -> DataFrame:
    """Rows with the ids of their file and record: from the dossier, path and place alone."""
    space = uuid.uuid5(uuid.NAMESPACE_URL, f"dossier:{dossier}").hex
    place = F.concat_ws(":", "file_id", "sheet", F.col("row_number").cast("string"))
    return rows.where("row_number >= 0").withColumn("file_id", exprs.uuid5(F.col("path"))).withColumn("record_id", exprs.uuid5(place, space))


_OUT = ["record_id", "record_type", "file_id", "path", "sheet", "row_number", "date", "period", "amount", "currency", "text", "cells", "entities", "relationships"]


def ledger_records(rows: DataFrame, dossier: str) -> DataFrame:
    """Records of ledgers described by an index. The date is the first filled one of three columns."""
    _, stem = _file()
    kind = reduce(lambda rest, kv: F.when(stem == kv[0], F.lit(kv[1])).otherwise(rest), LEDGER_TYPES.items(), F.lit("master_data"))
    rows = _with_cells(_numbered(rows, dossier), roles.ledger, exprs.strict_date, exprs.german_decimal)
    out = rows.withColumns({
        "record_type": kind, "amount": F.get(_those("roles_amounts"), 0)["number"], "entities": ledger_entities(), "relationships": ledger_relations(stem),
        "date": _first(_those("roles_dates"), lambda x: x["text"].isNotNull())["text"], "period": _named("PERIODENCODE"),
        "currency": F.coalesce(_named("BUCHUNGSWÄHRUNG"), _named("BUCHUNGSWAEHRUNG")), "text": _named("BUCHUNGSTEXT"),
    })
    return out.select(*_OUT)


def csv_records(rows: DataFrame, dossier: str) -> DataFrame:
    """Records of CSV files: date and amount are the first column's that is called and reads so;
    EUR if there is an amount."""
    name, _ = _file()
    rows = _with_cells(_numbered(rows, dossier), roles.delimited, exprs.loose_date, exprs.german_number)
    date = _first(_those("roles_dates"), lambda x: x["text"].rlike(_ISO) & x["number"].isNull())["text"]
    amount = _first(_those("roles_amounts"), lambda x: x["number"].isNotNull())["number"]
    out = rows.withColumn("_account_type", account_type()).withColumns({
        "record_type": exprs.first_match(name, CSV_TYPES, "master_data"), "date": date, "amount": amount, "entities": csv_entities(), "relationships": csv_relations(),
    })
    return out.withColumn("period", exprs.period(F.col("date"))).withColumn("currency", F.when(F.col("amount").isNotNull(), "EUR")).select(*_OUT)


def _sheet_number(raw: Column) -> Column:
    """German or plain notation."""
    return F.coalesce(exprs.cell_number(raw), F.when(raw.rlike(r"^-?\d+(\.\d+)?$"), raw.try_cast("double")))


def sheet_records(rows: DataFrame, dossier: str) -> DataFrame:
    """Records of workbooks' sheets: numbers wherever they stand, dates stay as they are; an ISO time
    counts as its day."""
    name, _ = _file()
    of = lambda k, default: exprs.first_match(name, [(p[0], p[k]) for p in SHEET_TYPES], default, fold=False)
    rows = _with_cells(_numbered(rows, dossier), roles.sheet, lambda v: F.lit(None).cast("string"), _sheet_number)
    day = lambda x: F.coalesce(exprs.loose_date(x["text"]), F.nullif(F.regexp_extract(x["text"], r"^\d{4}-\d{2}-\d{2}", 0), F.lit("")))
    date = _first(F.transform(_those("roles_dates"), day), lambda d: d.isNotNull())
    amount = _first(_those("roles_amounts"), lambda x: x["number"].isNotNull())["number"]
    out = rows.withColumns({"record_type": of(1, "master_data"), "date": date, "amount": amount, "entities": sheet_entities(of(2, None))})
    return out.withColumns({"relationships": sheet_relations(F.col("entities")), "period": exprs.period(F.col("date")), "currency": F.when(F.col("amount").isNotNull(), "EUR")}).select(*_OUT)


def text_records(rows: DataFrame, dossier: str) -> DataFrame:
    """Records of running text (documents, pages, XML): the users it names, its first amount in euros and
    its first date."""
    none = F.lit(None).cast("string")
    users = F.transform(exprs.user_ids(F.col("text")), lambda u: _entity(F.lit("user"), u, none))
    cells = F.transform("columns", lambda c: F.struct(c.alias("name"), F.nullif(F.trim(F.try_element_at("data", c)), F.lit("")).alias("text"), F.lit(None).cast("double").alias("number")))
    out = _numbered(rows.where("text IS NOT NULL"), dossier).withColumns({
        "record_type": F.lit("document_text"), "cells": cells, "entities": users, "relationships": F.create_map().cast("map<string,string>"),
        "amount": exprs.euro_amount(F.col("text")), "date": exprs.date_in_text(F.col("text")),
    })
    return out.withColumns({"period": exprs.period(F.col("date")), "currency": F.when(F.col("amount").isNotNull(), "EUR")}).select(*_OUT)


def records(rows: DataFrame, dossier: str) -> DataFrame:
    """Rows of files of all kinds as records of one envelope, each by its file's type. Rows that tell of
    an error give none."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    of = {"txt": ledger_records, "csv": csv_records, "xlsx": sheet_records}
    out = text_records(rows.where(~kind.isin(*of)), dossier)
    for name, build in of.items():
        out = out.unionByName(build(rows.where(kind == name), dossier))
    return out


def node_type(entity_type: Column, entity_id: Column) -> Column:
    """An asset without a hyphen is a group of assets, thus an account."""
    return F.when((entity_type == "asset") & ~F.contains(entity_id, F.lit("-")), F.lit("account")).otherwise(entity_type)


def entity_rows(records: DataFrame, *keep: str) -> DataFrame:
    """keep..., entity_type, entity_id, label: a row for each entity. The outer form is used because
    the inner one makes Spark filter by the whole expression of the entities first."""
    return records.select(*keep, F.explode_outer("entities").alias("_e")).where("_e IS NOT NULL").select(*keep, "_e.*")


def relation_rows(records: DataFrame, *keep: str) -> DataFrame:
    """keep..., relation, entity_id: a row for each relationship."""
    return records.select(*keep, F.explode_outer("relationships").alias("relation", "entity_id")).where("relation IS NOT NULL")


def entity_edges(records: DataFrame) -> DataFrame:
    """(source, target, edge_type, record_id): from each record to its entities, by every relationship
    that names the entity and is meant for its type, else as a reference."""
    rows = entity_rows(records, "record_id", "relationships").select("record_id", "relationships", node_type(F.col("entity_type"), F.col("entity_id")).alias("kind"), F.col("entity_id").alias("id"))
    meant = F.create_map(*[F.lit(x) for kv in RELATION_TARGETS.items() for x in kv])
    fits = F.map_keys(F.map_filter("relationships", lambda k, v: (v == F.col("id")) & F.equal_null(F.try_element_at(meant, k), F.col("kind"))))
    kinds = F.when(F.size(fits) > 0, fits).otherwise(F.array(F.lit("references")))
    edges = rows.select(F.concat(F.lit("record:"), "record_id").alias("source"), F.concat_ws(":", F.lit("entity"), "kind", "id").alias("target"), F.explode(kinds).alias("edge_type"), "record_id")
    return edges.distinct()
