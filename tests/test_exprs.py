"""Column functions against literal examples."""

import uuid

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import exprs


def values(spark, f, cases):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, x string")
    return [r[1] for r in sorted(df.select("k", f(F.col("x"))).collect())]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (exprs.german_decimal, {"1.234,56": 1234.56, "-1.234.567,8": -1234567.8, "12,5": 12.5, "1000.5": 1000.5, "abc": None, "": None, None: None}),
        (exprs.german_number, {"1.234,56": 1234.56, "12,5": 12.5, "1000.5": None, "77": None}),
        (exprs.loose_float, {"1000.5": 10005.0, "1.234,5": 1234.5, "x": None}),
        (exprs.strict_date, {"31.02.2025": "2025-02-31", "1.2.2025": None, "2025-01-02": None}),
        (exprs.loose_date, {"1.2.2025": "2025-02-01", "31.02.2025": "2025-02-31", "1.13.2025": None, "1.1.1899": None}),
        (exprs.date_in_text, {"am 3.4.2025 und 5.6.2025": "2025-04-03", "nie": None}),
        (exprs.euro_amount, {"EUR 1.234,50 bezahlt": 1234.5, "12,50 € und": 12.5, "EUR 10.000": 10.0, "nichts": None}),
        (exprs.delimiter_or_default, {"a;b,c": ";", "a,b,c;": ",", "a\tb": "\t", "abc": ";"}),
        (exprs.dossier_name, {"my_file-name.zip": "my file name"}),
        (exprs.period, {"2025-02-03": "2025-02"}),
    ],
)
def test_text_functions(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_composite_accounts(spark):
    got = values(spark, exprs.composite_account, ["330000-200007", "230000-100151", "040000-000191", "660000"])
    assert [[tuple(e) for e in row] for row in got] == [
        [("account", "330000"), ("vendor", "200007")],
        [("account", "230000"), ("customer", "100151")],
        [("account", "040000"), ("asset", "040000-000191")],
        [("account", "660000")],
    ]


def test_uuid5(spark):
    names = ["a", "Ümläut", "", "dossier:x"]
    assert values(spark, exprs.uuid5, names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_fields_ignore_case(spark):
    df = spark.sql("SELECT map('Konto', 'a', 'KONTO', 'b') AS m, map('konto', 'c') AS n")
    assert tuple(df.select(exprs.field(F.col("m"), "KONTO"), exprs.field(F.col("n"), "KONTO"), exprs.field(F.col("n"), "X")).first()) == ("b", "c", None)


def test_table_lines(spark):
    assert values(spark, exprs.table_lines, ["Konto   Betrag\nnur Text\n  a  b  "]) == [["Konto   Betrag", "a  b"]]


def test_loose_dates_are_in_range(spark):
    texts = ["1.2.2000", " 31.12.2100 ", "01.09.1900", "0.1.2000", "00.01.2000", "32.1.2000", "1.13.2000", "1.0.2000", "1.1.1899", "1.1.2101", "1.1.20000", "1.1.2000\n", "31.2.2000", "x"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k")
    found = [tuple(r) for r in df.select(exprs.loose_date(F.col("t")), exprs.loose_date(F.col("t"), False)).collect()]
    assert [a for a, _ in found] == ["2000-02-01", "2100-12-31", "1900-09-01", *[None] * 8, "2000-01-01", "2000-02-31", None]
    assert [b for _, b in found][3:11] == ["2000-01-00", "2000-01-00", "2000-01-32", "2000-13-01", "2000-00-01", "1899-01-01", "2101-01-01", None]
