"""What the columns of a file are for, worked out once for each different header.

The rules on column names run over the different headers only. Their result, a header's roles by
column position, is joined to the rows, so that a row is read by position and no name is looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.session import ship
from tallyweave.shared import written
from tallyweave.skew import salted_join

#: Headers whose roles are sent to all tasks; with more of them both sides are shuffled.
HEADERS = 10_000
#: How a cell is read as a number: not at all, always, or only if it is no date.
NO_NUMBER, NUMBER, NO_DATE = range(3)

_ENTITY = pa.struct([("at", pa.int32()), ("kind", pa.string()), ("special", pa.bool_()), ("labels", pa.list_(pa.int32()))])
_FIRST = pa.struct([("at", pa.int32()), ("same", pa.int32())])
_RELATION = pa.struct([("label", pa.string()), ("firsts", pa.list_(_FIRST)), ("lasts", pa.list_(pa.int32()))])
_ROLES = pa.struct([
    ("cells", pa.list_(pa.struct([("name", pa.string()), ("date", pa.bool_()), ("number", pa.int32())]))),
    ("dates", pa.list_(pa.int32())), ("amounts", pa.list_(pa.int32())), ("kinds", pa.list_(pa.int32())),
    ("entities", pa.list_(_ENTITY)), ("relations", pa.list_(_RELATION)), ("named", pa.map_(pa.string(), pa.int32())),
])
_SCHEMA = pa.schema([("columns", pa.list_(pa.string())), ("roles", _ROLES)])
SCHEMA = (
    "columns array<string>, roles struct<cells: array<struct<name: string, date: boolean, number: int>>, dates: array<int>, amounts: array<int>, kinds: array<int>, "
    "entities: array<struct<at: int, kind: string, special: boolean, labels: array<int>>>, "
    "relations: array<struct<label: string, firsts: array<struct<at: int, same: int>>, lasts: array<int>>>, named: map<string, int>>"
)


def _where(columns: list[str], test: Callable[[str], bool]) -> list[int]:
    return [k for k, c in enumerate(columns) if test(c)]


def _has(name: str, parts: list[str]) -> bool:
    return any(p in name.lower() for p in parts)


def _roles(columns: list[str], **own) -> dict:
    cells = own.pop("cells")
    return {
        "cells": [{"name": c, "date": d, "number": n} for c, (d, n) in zip(columns, cells, strict=True)],
        "dates": [], "amounts": [], "kinds": [], "entities": [], "relations": [], "named": [],
    } | own


def ledger(columns: list[str], rules) -> dict:
    """By exact column names in any case; the first column of a name counts."""
    up = [c.upper() for c in columns]
    kinds = {name: kind for kind, names in rules.LEDGER_ENTITIES.items() for name in names}
    first = {name: k for k, name in reversed(list(enumerate(up)))}
    return _roles(
        columns,
        cells=[(c in rules.LEDGER_DATES, NUMBER if c in rules.LEDGER_NUMBERS else NO_NUMBER) for c in up],
        entities=[{"at": k, "kind": kinds[c], "special": c == "SACHKONTONUMMER", "labels": []} for k, c in enumerate(up) if c in kinds],
        dates=[first[c] for c in rules.LEDGER_FIRST_DATES if c in first],
        amounts=[first[c] for c in ["BUCHUNGSBETRAG"] if c in first],
        named=[(c, k) for c, k in first.items()],
    )


def delimited(columns: list[str], rules) -> dict:
    """By parts of column names, the first fitting rule of each."""
    low = [c.lower() for c in columns]
    label = [any(c.endswith(s) for s in rules.CSV_LABELS) for c in low]
    date, amount = [_has(c, rules.CSV_DATES) for c in low], [_has(c, rules.CSV_AMOUNTS) for c in low]
    same = {c: k for k, c in reversed(list(enumerate(columns)))}
    order = [p for p, _ in rules.CSV_ENTITIES]

    def labels(k: int) -> list[int]:
        own = columns[k].upper()
        known = [f"{own}NAME", f"{own}_NAME", f"{own}BEZEICHNUNG", "NAME", "BEZEICHNUNG"]
        exact = [j for name in known for j in _where(columns, lambda c, name=name: c.upper() == name)]
        return list(dict.fromkeys(exact + _where(columns, lambda c: c.lower().startswith(low[k]) and "name" in c.lower())))

    entities = []
    for k, c in enumerate(low):
        kind = next((kind for part, kind in rules.CSV_ENTITIES if part in c), None)
        if kind is not None and not label[k]:
            entities.append({"at": k, "kind": kind, "special": c == "konto", "labels": labels(k)})
    relations = []
    for name, parts in rules.CSV_RELATIONS:
        own = [k for k in range(len(columns)) if _has(low[k], parts) and not label[k]]
        sooner = order[: order.index(parts[0])] if len(parts) == 1 else None
        lasts = [] if sooner is None else [k for k in own if not _has(low[k], sooner)]
        if own:
            relations.append({"label": name, "firsts": [{"at": k, "same": same[columns[k]]} for k in own], "lasts": lasts})
    return _roles(
        columns,
        cells=[(d, NUMBER if not d else NO_DATE if a else NO_NUMBER) for d, a in zip(date, amount, strict=True)],
        dates=[k for k, d in enumerate(date) if d], amounts=[k for k, a in enumerate(amount) if a],
        kinds=_where(columns, lambda c: c.lower() == "art"), entities=entities, relations=relations,
    )


def sheet(columns: list[str], rules) -> dict:
    """By patterns in column names; the first column of a real header may be what its file is about."""
    low = [c.lower() for c in columns]
    real = bool(columns) and not columns[0].startswith("column_")
    entities = []
    for k, c in enumerate(low):
        kind = next((kind for pattern, kind in rules.SHEET_ENTITIES if re.search(pattern, c)), None)
        if kind is not None or (real and columns[k] == columns[0]):
            entities.append({"at": k, "kind": kind, "special": kind is None, "labels": []})
    found = lambda pattern: [k for k, c in enumerate(low) if re.search(pattern, c)]
    return _roles(columns, cells=[(False, NUMBER)] * len(columns), dates=found(rules.SHEET_DATES), amounts=found(rules.SHEET_AMOUNTS), entities=entities)


def with_roles(rows: DataFrame, of: Callable[[list[str], object], dict], rules) -> DataFrame:
    """The rows (with `columns`) and their header's roles, a column roles_... for each kind of them, so
    that a plan carries those only that it reads; rows without columns have none."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            headers = b.column(0).to_pylist()
            yield pa.RecordBatch.from_pylist([{"columns": h, "roles": of([c or "" for c in h], rules)} for h in headers], _SCHEMA)

    headers = written(rows.select("columns").where(F.col("columns").isNotNull()).distinct().mapInArrow(run, SCHEMA), "headers")
    headers = headers.select("columns", *[F.col(f"roles.{f.name}").alias(f"roles_{f.name}") for f in _ROLES])
    if headers.count() <= HEADERS:
        return rows.join(F.broadcast(headers), "columns")
    return salted_join(rows, headers, ["columns"], ["path", "row_number"])
