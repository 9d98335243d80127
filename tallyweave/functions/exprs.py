"""Column functions: numbers and dates as bookkeeping exports write them, field access,
identifiers. All are expressions of built-in functions."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of the exports (numbers, and in the functions below cells, dates, users and
# composite accounts).
#: Decimal comma with dots between thousands.
GERMAN_NUMBER = r"^-?\d{1,3}(\.\d{3})*,\d+$"
#: Decimal comma, digits only.
COMMA_NUMBER = r"^-?\d+,\d+$"
EITHER_NUMBER = r"^-?(\d{1,3}(\.\d{3})*|\d+),\d+$"
URL_NAMESPACE = uuid.NAMESPACE_URL.hex


def _double(text: Column) -> Column:
    return text.try_cast("double")


def _comma(text: Column) -> Column:
    return _double(F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def german_decimal(text: Column) -> Column:
    """Number of a delimited export: German notation, a comma alone, or a plain number; null
    if it is none of them."""
    t = F.trim(text)
    return (
        F.when(t.rlike(GERMAN_NUMBER), _comma(t))
        .when(F.contains(t, F.lit(",")) & ~F.contains(t, F.lit(".")), _double(F.replace(t, F.lit(","), F.lit("."))))
        .otherwise(_double(t))
    )


def german_number(text: Column) -> Column:
    """Stricter form for cells of unknown meaning: only with a decimal comma."""
    t = F.trim(text)
    return F.when(F.contains(text, F.lit(",")) & t.rlike(EITHER_NUMBER), _comma(t))  # most cells have no comma


def cell_number(text: Column) -> Column:
    """Number of a spreadsheet cell given as text: one or two decimals after a comma with
    dotted thousands, else a comma number."""
    t = F.trim(text)
    return F.when(t.rlike(r"^-?\d{1,3}(\.\d{3})*,\d{1,2}$") | t.rlike(r"^-?\d+(,\d+)?$") & F.contains(t, F.lit(",")), _comma(t))


def loose_float(text: Column) -> Column:
    """Drops every dot, then reads a comma as the decimal point."""
    return _comma(F.trim(text))


def strict_date(text: Column) -> Column:
    """dd.mm.yyyy as yyyy-mm-dd; the calendar isn't consulted."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.concat_ws("-", F.substring(t, 7, 4), F.substring(t, 4, 2), F.substring(t, 1, 2)))


def loose_date(text: Column, check: bool = True) -> Column:
    """d.m.yyyy as yyyy-mm-dd; with `check` the month, day and year (1900 to 2100) must be
    in range, but not the day within its month."""
    t = F.trim(text)
    day, month, year = F.substring_index(t, ".", 1), F.substring_index(F.substring_index(t, ".", 2), ".", -1), F.left(F.substring_index(t, ".", -1), F.lit(4))
    out = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    ranged = r"^(0?[1-9]|[12]\d|3[01])\.(0?[1-9]|1[0-2])\.(19\d\d|20\d\d|2100)$"
    fits = F.contains(text, F.lit(".")) & t.rlike(ranged if check else r"^\d{1,2}\.\d{1,2}\.\d{4}$")
    return F.when(fits, out)


def date_in_text(text: Column) -> Column:
    """The first German date in running text, zero padded and not validated."""
    found = [F.nullif(F.regexp_extract(text, r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b", k), F.lit("")) for k in (1, 2, 3)]
    return F.concat(found[2], F.lit("-"), F.lpad(found[1], 2, "0"), F.lit("-"), F.lpad(found[0], 2, "0"))


def euro_amount(text: Column) -> Column:
    """The first amount next to a euro sign or EUR: German notation if it has both marks, a
    decimal comma if it has one, and the dot as it is otherwise."""
    before = F.nullif(F.regexp_extract(text, r"(?:EUR|€)\s*(-?[\d.]*\d(?:,\d+)?)", 1), F.lit(""))
    after = F.nullif(F.regexp_extract(text, r"(-?[\d.]*\d(?:,\d+)?)\s*(?:EUR|€)", 1), F.lit(""))
    t = F.coalesce(before, after)
    return F.when(F.contains(t, F.lit(",")), _comma(t)).otherwise(_double(t))


def user_ids(text: Column, pattern: str = r"\b(MV-U\d{2,3})\b") -> Column:
    """Different user ids of a text, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def period(iso_date: Column) -> Column:
    return F.substring(iso_date, 1, 7)


def non_empty(value: Column) -> Column:
    """Not null and not blank; 0 isn't empty."""
    return value.isNotNull() & (F.trim(value.cast("string")) != "")


def field(data: Column, name: str) -> Column:
    """A field of a payload map: the exact name first, else one that differs in case."""
    alike = F.map_values(F.map_filter(data, lambda k, _: F.upper(k) == name.upper()))
    return F.coalesce(data[name], F.get(alike, 0))


def json_map(text: Column) -> Column:
    """A JSON object as a map of texts; anything else (broken JSON, null, other values) is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    whole = F.try_parse_json(text)
    return F.when(whole.isNotNull() & F.startswith(F.ltrim(text), F.lit("{")), F.coalesce(F.from_json(text, "map<string,string>"), empty)).otherwise(empty)


def composite_account(value: Column) -> Column:
    """Entities of an account number: 'account-suffix' also names a customer (suffix 1...), a
    vendor (2...) or an asset (0..., by the whole value)."""
    account = F.regexp_extract(value, r"^(\d+)-(\d{6})$", 1)
    suffix = F.regexp_extract(value, r"^(\d+)-(\d{6})$", 2)
    entity = lambda kind, key: F.struct(F.lit(kind).alias("entity_type"), key.alias("entity_id"))
    first = F.substring(suffix, 1, 1)
    second = (
        F.when(first == "1", F.array(entity("customer", suffix)))
        .when(first == "2", F.array(entity("vendor", suffix)))
        .when(first == "0", F.array(entity("asset", value)))
        .otherwise(F.array().cast("array<struct<entity_type:string,entity_id:string>>"))
    )
    return F.when(suffix == "", F.array(entity("account", value))).otherwise(F.concat(F.array(entity("account", account)), second))


def table_lines(text: Column) -> Column:
    """Lines of page text that look like table rows: two parts, two spaces or more apart."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x.rlike(r"^\S.*\s{2,}\S.*$"))


def delimiter(line: Column) -> Column:
    """The most frequent of ; , and tab in a line; ties go to ; then , and none to ;"""
    times = {d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))) for d in (";", ",", "\t")}
    most = F.greatest(*times.values())
    return F.when(times[";"] == most, F.lit(";")).when(times[","] == most, F.lit(",")).otherwise(F.lit("\t"))


def delimiter_or_default(line: Column) -> Column:
    return F.when(line.rlike("[;,\t]"), delimiter(line)).otherwise(F.lit(";"))


def dossier_name(filename: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), "[_-]", " ")


def money(value: Column) -> Column:
    """Two decimals, 'n/a' for null; rounded as a decimal, half up."""
    return F.coalesce(value.cast("decimal(18,2)").cast("string"), F.lit("n/a"))


def mime_type(path: Column, types: dict[str, str], default: str = "application/octet-stream") -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    return F.coalesce(table[ext], F.lit(default))


def first_match(name: Column, patterns: list[tuple[str, str]], default: str, fold: bool = True) -> Column:
    """The value of the first pattern that `name` contains."""
    name = F.lower(name) if fold else name
    return reduce(lambda rest, p: F.when(F.contains(name, F.lit(p[0])), F.lit(p[1])).otherwise(rest), reversed(patterns), F.lit(default))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """RFC 4122 version 5 of `name` in a namespace given as 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(
        part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), F.lower(F.hex(nibble)), part(18, 3), F.lit("-"), part(21, 12)
    )


def edge_id(dossier: str, source: Column, target: Column, kind: Column, records: Column) -> Column:
    """Deterministic id of an edge: the hex digits of the uuid5 of its parts."""
    name = F.concat_ws("|", F.lit(dossier), source, target, kind, F.array_join(records, ","))
    return F.replace(uuid5(name), F.lit("-"), F.lit(""))
