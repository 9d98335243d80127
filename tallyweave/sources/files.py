"""Dossier files: archives, inventory, and readers that yield one record envelope.

Spark's binaryFile source lists and reads the files; a task parses whole files (they are
small; row numbers need them whole) with small helpers of the standard library.
"""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import exprs
from tallyweave.session import ship
from tallyweave.sources import delimited

# Limits of archives, folders of ledgers and file types.
LIMITS = {"archive_mb": 100, "total_mb": 500, "entries": 1000, "ratio": 20.0}
LEDGERS = ["sachkonten", "kreditoren", "debitoren", "av"]
MIME = {
    ".txt": "text/plain", ".csv": "text/csv", ".xml": "application/xml", ".pdf": "application/pdf", ".dtd": "application/xml-dtd",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
#: A row of any source: its file, place (sheet and row, page or paragraph), columns in order
#: and values as text; `text` for running text.
ROWS = "path string, sheet string, row_number int, columns array<string>, data map<string,string>, text string"


XML_BYTES = 50 * 2**20
#: Rows of a file that are held at a time.
CHUNK = 20_000
csv.field_size_limit(2**31 - 1)  # a cell may be as long as its file


def binary_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.load(folder).select("path", "length", "content")


def zip_entries(archives: DataFrame) -> DataFrame:
    """path, archive_bytes, name, size, packed, is_link of every entry (without its content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, length, content in frame.itertuples(index=False):
                try:
                    infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
                except zipfile.BadZipFile:
                    out.append((path, length, None, None, None, None))
                    continue
                out += [(path, length, i.filename, i.file_size, i.compress_size, i.external_attr >> 16 & 0o170000 == 0o120000) for i in infos if not i.is_dir()]
            yield pd.DataFrame(out, columns=["path", "archive_bytes", "name", "size", "packed", "is_link"])

    return archives.select("path", "length", "content").mapInPandas(run, "path string, archive_bytes long, name string, size long, packed long, is_link boolean")


def archive_errors(entries: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """path, n_entries, total_bytes, error: the first failed check of each archive (in this
    order), or null. Nothing of an archive with an error is to be read."""
    parts = F.split("name", r"[/\\]")
    outside = F.startswith("name", F.lit("/")) | F.col("name").rlike(r"^[A-Za-z]:") | F.array_contains(parts, "..")
    dense = (F.col("packed") > 0) & (F.col("size") / F.col("packed") > limits["ratio"])
    found = F.when(outside, "path outside of the archive").when(F.col("is_link"), "symbolic link").when(dense, "compression ratio")
    sums = entries.withColumn("_bad", found).groupBy("path").agg(
        F.count("name").alias("n_entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.max("archive_bytes").alias("_own"),
        F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col("name"))).alias("_bad"), F.bool_or(F.col("name").isNull()).alias("_broken"),
    )
    error = (
        F.when(F.col("_broken"), "not an archive")
        .when(F.col("_own") > limits["archive_mb"] * 2**20, "archive too large")
        .when(F.col("n_entries") > limits["entries"], "too many entries")
        .when(F.col("_bad").isNotNull(), F.col("_bad"))
        .when(F.col("total_bytes") > limits["total_mb"] * 2**20, "contents too large")
    )
    return sums.select("path", "n_entries", "total_bytes", error.alias("error"))


def unzip(archives: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """path (archive/entry), length, content of the entries of archives without an error."""
    good = archive_errors(zip_entries(archives), limits).where("error IS NULL").select("path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in frame.itertuples(index=False):
                z = zipfile.ZipFile(io.BytesIO(content))
                for i in z.infolist():
                    if not i.is_dir():
                        data = z.read(i)
                        yield pd.DataFrame([(f"{path}/{i.filename}", len(data), data)], columns=["path", "length", "content"])

    return archives.join(good, "path", "left_semi").select("path", "content").mapInPandas(run, "path string, length long, content binary")


def manifest(files: DataFrame, root: str) -> DataFrame:
    """Inventory: relative_path, file_id, size_bytes, sha256, mime, classification, reason, status.
    (Spark's file source passes over empty files; those of an archive come from `unzip`.)"""
    relative = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/+", "")
    rows = files.select("path", relative.alias("relative_path"), F.length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    name = F.lower(F.substring_index("relative_path", "/", -1))
    folders = F.slice(F.split(F.lower("relative_path"), "/"), 1, F.greatest(F.lit(0), F.size(F.split("relative_path", "/")) - 1))
    technical = (name == "index.xml") | F.endswith(name, F.lit(".dtd"))
    ledger = F.arrays_overlap(folders, F.array(*map(F.lit, LEDGERS))) & (F.endswith(name, F.lit(".txt")) | F.endswith(name, F.lit(".csv")))
    kind = F.when(technical, "technical_metadata").when(ledger & (F.col("size_bytes") > 0), "evidence").otherwise("supporting")
    reason = F.when(technical, "metadata").when(F.col("size_bytes") == 0, "empty file")
    return rows.select(
        "path", "relative_path", exprs.uuid5(F.col("relative_path")).alias("file_id"), "size_bytes", "sha256", exprs.mime_type(F.col("relative_path"), MIME).alias("mime"),
        kind.alias("classification"), reason.alias("reason"), F.when(reason.isNull(), "pending").otherwise("excluded").alias("status"),
    ).orderBy("relative_path")


def _parsed(files: DataFrame, parse: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    """Rows of all files; a file that can't be parsed gives its rows so far and one with its error as
    text and row_number -1, so that errors aren't lost."""
    ship(files.sparkSession)

    names = ["path", "sheet", "row_number", "columns", "data", "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in frame.itertuples(index=False):
                rows = []
                try:
                    for r in parse(path, content):
                        rows.append((path, *r))
                        if len(rows) == CHUNK:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except Exception as e:  # noqa: BLE001  whatever a file holds, it doesn't end the job
                    rows.append((path, None, -1, [], {}, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, ROWS)


def _row(number: int, columns: list[str], values: list[str], sheet: str | None = None, text: str | None = None) -> tuple:
    padded = [*values, *[""] * len(columns)][: len(columns)]
    return sheet, number, columns, {c: v.strip() or None for c, v in zip(columns, padded, strict=True)}, text


def decoded(content: bytes) -> str:
    """Text of a file: UTF-8 (with or without a mark) if its start is, else Windows-1252."""
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            content[:8192].decode(encoding, "strict" if len(content) <= 8192 else "ignore")
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def table_columns(index: str) -> dict[str, list[str]]:
    """Columns of each table (by its file's name) that an index.xml describes; tables
    without columns are left out."""
    local = lambda e: e.tag.rpartition("}")[2].lower()
    named = lambda e, kind: [x.text.strip() for c in e.iter() if local(c) == kind for x in c if local(x) == "name" and x.text]
    out = {}
    for table in (e for e in ET.fromstring(index).iter() if local(e) == "table"):
        url = next((x.text.strip() for x in table.iter() if local(x) == "url" and x.text), None)
        columns = named(table, "variablecolumn") or named(table, "fixedcolumn")
        if url and columns:
            out[url] = columns
    if not out:
        raise ValueError("the index describes no table")
    return out


def ledger_rows(files: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Delimited ledgers without a header (Windows-1252, semicolons), with the columns of their
    index; rows keep their line's number, blank lines count."""

    def parse(path, content):
        own = delimited.columns_of(path, columns)
        for n, values in enumerate(csv.reader(io.StringIO(content.decode("cp1252"), newline=""), delimiter=";"), 1):
            if any(v.strip() for v in values):
                yield _row(n, own, values)

    known = reduce(lambda a, b: a | b, [(F.col("path") == k) | F.endswith("path", F.lit(f"/{k}")) for k in columns], F.lit(False))
    return _parsed(files.where(known), parse)


def csv_rows(files: DataFrame) -> DataFrame:
    """CSV files with a header: encoding and delimiter are sniffed, short rows are filled up,
    long ones cut, blank ones left out; the header is row 1."""

    def parse(path, content):
        text = decoded(content)
        first = text.split("\n", 1)[0]
        mark = max(";,\t", key=lambda d: first.count(d)) if re.search("[;,\t]", first) else ";"
        rows = enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=mark), 1)
        header = [h.strip() for _, h in [next(rows, (1, []))] for h in h]
        for n, values in rows:
            if any(v.strip() for v in values):
                yield _row(n, header, values)

    return _parsed(files, parse)


def header_row(rows: list[list[str]], among: int = 15) -> int | None:
    """Place of the first row that looks like a header: two cells and more, half of them filled,
    four fifths of these text and different."""
    for k, row in enumerate(rows[:among]):
        full = [v for v in row if v.strip()]
        if len(full) < 2 or len(full) < 0.5 * len(row):
            continue
        words = [v for v in full if not re.fullmatch(r"-?[\d.,]+", v.strip())]
        if len(words) >= 0.8 * len(full) and len({v.strip() for v in full}) >= 0.8 * len(full):
            return k
    return None


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


# Numbers of the built-in formats of dates and times.
_DATES, _TIMES = {14, 15, 16, 17, 22}, {18, 19, 20, 21, 45, 46, 47}
_QUOTED = re.compile(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', re.I)


def _formats(styles: bytes | None) -> list[str]:
    """What each cell style shows: 'date', 'time' or '' (any other value)."""
    if styles is None:
        return []
    root = ET.fromstring(styles)
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}

    def kind(n: int) -> str:
        code = _QUOTED.sub("", own.get(n, "")).lower()
        if n in _DATES or re.search("[dy]", code):
            return "date"
        return "time" if n in _TIMES or re.search("[hs]", code) else ""

    formats = root.find(f"{_MAIN}cellXfs")
    return [] if formats is None else [kind(int(x.get("numFmtId", 0))) for x in formats]


def serial_text(value: str, kind: str, from_1904: bool) -> str:
    """A serial number of days as ISO date and time, or as time alone; other text as it is. In the older
    system the 29th of February 1900 counts as a day, so days before March 1900 are one more."""
    try:
        seconds = round(float(value) * 86_400)
    except ValueError:
        return value
    if kind == "time" and 0 <= seconds < 86_400:
        return str((datetime(1904, 1, 1) + timedelta(seconds=seconds)).time())
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30 if seconds >= 60 * 86_400 else 31)
    try:
        return (start + timedelta(seconds=seconds)).isoformat()
    except OverflowError:
        return value


def _sheets(content: bytes) -> Iterator[tuple[str, list[tuple[int, list[str]]]]]:
    """(name, [(row number, cells as text)]) of a workbook's sheets; cached values only. Numbers that a
    date or time format shows are ISO dates and times, by the workbook's date system."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
    kinds = _formats(z.read("xl/styles.xml") if "xl/styles.xml" in names else None)
    book = ET.fromstring(z.read("xl/workbook.xml"))
    own = book.find(f"{_MAIN}workbookPr")
    from_1904 = own is not None and own.get("date1904", "0") in ("1", "true")
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in book.iter(f"{_MAIN}sheet"):
        at = targets[sheet.get(f"{_REL}id")].lstrip("/")
        rows = []
        for row in ET.fromstring(z.read(at if at in names else f"xl/{at}")).iter(f"{_MAIN}row"):
            cells: list[str] = []
            for c in row.iter(f"{_MAIN}c"):
                letters = re.match("[A-Z]+", c.get("r", "A"))[0]
                column = 0
                for x in letters:
                    column = column * 26 + ord(x) - 64
                value = c.find(f"{_MAIN}v")
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                else:
                    text = "" if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text or ""
                    style = int(c.get("s", -1))
                    if text and c.get("t", "n") == "n" and 0 <= style < len(kinds) and kinds[style]:
                        text = serial_text(text, kinds[style], from_1904)
                cells += [""] * (column - 1 - len(cells)) + [text]
            rows.append((int(row.get("r", len(rows) + 1)), cells))
        yield sheet.get("name"), rows


def xlsx_rows(files: DataFrame) -> DataFrame:
    """All sheets of workbooks with their rows' numbers; without a header row the columns are
    column_0, column_1, ... The sheet is part of a row's place, so sheets never collide."""

    def parse(path, content):
        for name, rows in _sheets(content):
            width = max((len(cells) for _, cells in rows), default=0)
            head = header_row([cells for _, cells in rows])
            columns = [f"column_{k}" for k in range(width)]
            if head is not None:
                columns = [v.strip() or columns[k] for k, v in enumerate(rows[head][1])]
            for n, cells in rows[0 if head is None else head + 1 :]:
                if any(v.strip() for v in cells):
                    yield _row(n, columns, cells, sheet=name)

    return _parsed(files, parse)


def docx_rows(files: DataFrame) -> DataFrame:
    """Paragraphs, and table rows as 'column: value; ...', each under its last heading."""

    def parse(path, content):
        body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_WORD}body")
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t")).strip()
        heading, n, tables = "", 0, 0
        for e in body:
            if e.tag == f"{_WORD}p":
                n += 1
                style = e.find(f"{_WORD}pPr/{_WORD}pStyle")
                if style is not None and style.get(f"{_WORD}val", "").lower().startswith("heading") and text(e):
                    heading = text(e)
                elif text(e):
                    yield None, n, [], {}, f"[{heading}] {text(e)}" if heading else text(e)
            elif e.tag == f"{_WORD}tbl":
                tables += 1
                rows = [[text(c) for c in r.iter(f"{_WORD}tc")] for r in e.iter(f"{_WORD}tr")]
                for k, values in enumerate(rows[1:], 2):
                    said = "; ".join(f"{c}: {v}" for c, v in zip(rows[0], values, strict=False) if v)
                    yield _row(k, rows[0], values, sheet=f"table {tables}", text=f"[Table {tables}, Row {k}] {said}")

    return _parsed(files, parse)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _xml_root(content: bytes) -> ET.Element:
    """The root of a document, whatever its declaration says: read as UTF-8, else as Latin-1."""
    try:
        return ET.fromstring(content.decode("utf-8-sig"))
    except (UnicodeDecodeError, ET.ParseError):
        return ET.fromstring(content.decode("latin-1"))


def _element_text(e: ET.Element) -> str:
    """An element's text, its attributes and its children's texts, one level down; its name if there is
    none of them."""
    own = [f"{_local(x.tag)}: {x.text.strip()}" for x in [e, *e] if x.text and x.text.strip()]
    if e.attrib:
        own.insert(int(bool(e.text and e.text.strip())), f"{_local(e.tag)}[{', '.join(f'{k}={v}' for k, v in e.attrib.items())}]")
    return "; ".join(own) or _local(e.tag)


def xml_rows(files: DataFrame, most: int = XML_BYTES) -> DataFrame:
    """Content XML. Children whose names repeat (half as many names as children at most) are records: a row
    each, with their children's texts as fields. Else they are sections: a row each, its text led by its
    name. A root without children is one row. Rows keep the child's number; a file of more than `most` bytes
    leaves a row that says so."""

    def parse(path, content):
        if len(content) > most:
            raise ValueError(f"more than {most} bytes")
        root = _xml_root(content)
        kids = list(root)
        repeats = len({_local(c.tag) for c in kids}) <= len(kids) / 2
        for n, c in enumerate(kids or [root], 1):
            fields = {_local(x.tag): x.text.strip() for x in c if x.text and x.text.strip()}
            if kids and not repeats:
                own = [c.text.strip()] if c.text and c.text.strip() else []
                yield None, n, [], {"section_tag": _local(c.tag)}, " ".join([f"[{_local(c.tag)}]", *own, *map(_element_text, c)])
            else:
                yield None, n, [], fields, _element_text(c)

    return _parsed(files, parse)


def page_rows(pages: DataFrame, least: int = 3) -> DataFrame:
    """One row for each page with text; one more for each table-like line of a page with `least`
    of them. pages: path, page, text (as extracted before)."""
    full = pages.where(F.trim("text") != "")
    lines = full.withColumn("lines", exprs.table_lines(F.col("text"))).where(F.size("lines") >= least)
    return full.select("path", "page", F.lit(0).alias("line"), "text").unionByName(
        lines.select("path", "page", F.posexplode("lines").alias("k", "text")).select("path", "page", (F.col("k") + 1).alias("line"), "text")
    )


def normalised(spark: SparkSession, folder: str, columns: dict[str, list[str]]) -> DataFrame:
    """Rows of all files of a folder: each goes to the reader of its type; metadata, empty files
    and text files outside of ledgers are skipped."""
    files = binary_files(spark, folder)
    kinds = manifest(files, folder).where("status = 'pending'").select("path", "classification")
    live = files.join(kinds, "path")
    of = lambda end: F.endswith(F.lower("path"), F.lit(end))
    out = ledger_rows(live.where(of(".txt") & (F.col("classification") == "evidence")), columns)
    for end, reader in ((".csv", csv_rows), (".xlsx", xlsx_rows), (".docx", docx_rows), (".xml", xml_rows)):
        out = out.unionByName(reader(live.where(of(end))))
    return out
