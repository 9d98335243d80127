"""Readers of dossier files on small made-up files."""

import io
import zipfile

import pytest

from tallyweave.sources import files


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))


def packed(entries, **kw):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    write(tmp_path / "Sachkonten/index.xml", "<DataSet><Media><Table><URL>Buchungen.txt</URL><VariableLength><VariableColumn><Name>KONTO</Name></VariableColumn><VariableColumn><Name>TEXT</Name></VariableColumn></VariableLength></Table></Media></DataSet>")
    write(tmp_path / "Sachkonten/Buchungen.txt", '100;"Ümlaut; mit ""Zitat"""\r\n\r\n200\r\n'.encode("cp1252"))
    write(tmp_path / "Liste.csv", "﻿KONTO;NAME\n1;a\n\n2;b;zu viel\n3\n")
    write(tmp_path / "leer.csv", "")
    write(tmp_path / "daten.xml", "<r><x><a>1</a></x><x><a>2</a></x></r>")
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Banner</t></is></c></row><row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c></row><row r="4"><c r="A4"><v>12</v></c><c r="B4"><v>3.5</v></c></row></sheetData></worksheet>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    write(tmp_path / "mappe.xlsx", packed([
        ("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S1" r:id="r1"/><sheet name="S2" r:id="r2"/></sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet1.xml"/></Relationships>'),
        ("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Konto</t></si><si><t>Name</t></si></sst>'),
        ("xl/worksheets/sheet1.xml", sheet),
    ]))
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, s="": f'<w:p>{s}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Kapitel", '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + p("Satz") + f"<w:tbl><w:tr>{cell('A')}{cell('B')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    write(tmp_path / "brief.docx", packed([("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')]))
    return tmp_path


def test_all_readers(spark, folder):
    columns = files.table_columns((folder / "Sachkonten/index.xml").read_text())
    rows = files.normalised(spark, str(folder), columns).collect()
    of = lambda end: sorted(((r.sheet, r.row_number, r.data, r.text) for r in rows if r.path.endswith(end)), key=str)
    assert of(".txt") == [(None, 1, {"KONTO": "100", "TEXT": 'Ümlaut; mit "Zitat"'}, None), (None, 3, {"KONTO": "200", "TEXT": None}, None)]
    assert of(".csv") == [(None, 2, {"KONTO": "1", "NAME": "a"}, None), (None, 4, {"KONTO": "2", "NAME": "b"}, None), (None, 5, {"KONTO": "3", "NAME": None}, None)]
    assert of(".xlsx") == [(s, 4, {"Konto": "12", "Name": "3.5"}, None) for s in ("S1", "S2")]
    assert of(".docx") == [("table 1", 2, {"A": "1", "B": "2"}, "[Table 1, Row 2] A: 1; B: 2"), (None, 2, {}, "[Kapitel] Satz")]
    assert [x[1:] for x in of(".xml")] == [(1, {"a": "1"}, "a: 1"), (2, {"a": "2"}, "a: 2")]


def test_manifest(spark, folder):
    empty = spark.createDataFrame([(f"file:{folder}/leer.csv", 0, b"")], "path string, length long, content binary")  # as unzip() gives it
    got = {r.relative_path: r for r in files.manifest(files.binary_files(spark, str(folder)).unionByName(empty), str(folder)).collect()}
    assert (got["Sachkonten/index.xml"].classification, got["Sachkonten/index.xml"].status) == ("technical_metadata", "excluded")
    assert (got["Sachkonten/Buchungen.txt"].classification, got["Liste.csv"].classification) == ("evidence", "supporting")
    assert got["leer.csv"].reason == "empty file" and got["Liste.csv"].mime == "text/csv"


def test_a_broken_file_leaves_its_error(spark, tmp_path):
    write(tmp_path / "kaputt.xlsx", b"no zip")
    row = files.xlsx_rows(files.binary_files(spark, str(tmp_path))).first()
    assert row.row_number == -1 and "BadZipFile" in row.text


def test_archives(spark, tmp_path):
    link = zipfile.ZipInfo("link")
    link.external_attr = 0o120777 << 16
    cases = {
        "good.zip": packed([("a/b.txt", "x"), ("c.csv", "y")]), "out.zip": packed([("../a", "x")]), "abs.zip": packed([("/etc/x", "x")]),
        "dense.zip": packed([("a", b"\0" * 10**6)]), "many.zip": packed([(str(k), "x") for k in range(15)]), "bad.zip": b"text", "link.zip": packed([(link, "x")]),
    }
    for name, data in cases.items():
        write(tmp_path / name, data)
    zips = files.binary_files(spark, str(tmp_path), "*.zip")
    got = {r.path.rsplit("/", 1)[-1]: r.error for r in files.archive_errors(files.zip_entries(zips), files.LIMITS | {"entries": 10}).collect()}
    assert got == {
        "good.zip": None, "out.zip": "path outside of the archive", "abs.zip": "path outside of the archive", "dense.zip": "compression ratio",
        "many.zip": "too many entries", "bad.zip": "not an archive", "link.zip": "symbolic link",
    }
    assert sorted(r.path.split(".zip/")[1] for r in files.unzip(zips, files.LIMITS | {"entries": 10}).collect()) == ["a/b.txt", "c.csv"]


def test_pages(spark):
    df = spark.createDataFrame([("f", 1, "Konto  Betrag\n1  2\n3  4"), ("f", 2, " "), ("f", 3, "nur Text")], "path string, page int, text string")
    assert sorted((r.page, r.line) for r in files.page_rows(df).collect()) == [(1, 0), (1, 1), (1, 2), (1, 3), (3, 0)]


@pytest.mark.parametrize(("system", "first"), [("", "2024-02-29T12:00:00"), (' date1904="1"', "2028-03-01T12:00:00")])
def test_dates_and_times_of_sheets(spark, tmp_path, system, first):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    text = lambda r, t: f'<c r="{r}1" t="inlineStr"><is><t>{t}</t></is></c>'
    row = '<c r="A2" s="1"><v>45351.5</v></c><c r="B2" s="2"><v>0.25</v></c><c r="C2" s="3"><v>59</v></c><c r="D2" s="0"><v>45351</v></c><c r="E2" s="4"><v>7</v></c>'
    head = "".join(text(r, t) for r, t in zip("ABCDE", ["Tag", "Zeit", "Alt", "Zahl", "Stück"]))
    formats = '<numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0 &quot;days&quot;"/></numFmts>'
    styles = "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, 20, 170, 171))
    (tmp_path / "m.xlsx").write_bytes(packed([
        ("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><workbookPr{system}/><sheets><sheet name="S" r:id="r1"/></sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>'),
        ("xl/styles.xml", f'<styleSheet xmlns="{main}">{formats}<cellXfs>{styles}</cellXfs></styleSheet>'),
        ("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1">{head}</row><row r="2">{row}</row></sheetData></worksheet>'),
    ]))
    data = files.xlsx_rows(files.binary_files(spark, str(tmp_path))).first().data
    assert (data["Tag"], data["Zeit"], data["Zahl"], data["Stück"]) == (first, "06:00:00", "45351", "7")
    assert data["Alt"] == ("1904-02-29T00:00:00" if system else "1900-02-28T00:00:00")


def test_xml_records_sections_and_limits(spark, tmp_path):
    write(tmp_path / "sections.xml", '<?xml version="1.0" encoding="utf-8"?><r xmlns="u"><kopf nr="1">Titel<a x="2">A</a><b>B</b></kopf><fuss/></r>')
    write(tmp_path / "latin.xml", '<?xml version="1.0" encoding="iso-8859-1"?><r>Größe</r>'.encode("latin-1"))
    write(tmp_path / "records.xml", "<r><x k='1'><a>1</a><b><c>deep</c></b></x><x>own<a> </a></x></r>")
    write(tmp_path / "broken.xml", "<r><x></r>")
    df = files.binary_files(spark, str(tmp_path))
    got = {}
    for r in files.xml_rows(df).collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.row_number, r.data, r.text))
    assert sorted(got["sections.xml"]) == [(1, {"section_tag": "kopf"}, "[kopf] Titel a: A; a[x=2] b: B"), (2, {"section_tag": "fuss"}, "[fuss]")]
    assert got["latin.xml"] == [(1, {}, "r: Größe")]
    assert sorted(got["records.xml"], key=str) == [(1, {"a": "1"}, "x[k=1]; a: 1"), (2, {}, "x: own")]
    assert got["broken.xml"][0][0] == -1
    assert all("more than 5 bytes" in r.text for r in files.xml_rows(df, 5).collect())
