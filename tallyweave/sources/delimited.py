"""Split scans of large delimited files: many tasks read the ranges of one file.

Spark's text source deals out ranges of files from any store that Spark reads. What a range's first
bytes mean depends on all bytes before it: a line break inside quotes ends no record. So there are
two passes. The first one sums up each range as a function of what stands before it: for a start
outside and inside of quotes, whether its end is inside, and how many records begin in it. These
functions are put together along each file (a few numbers for each range, as many as Spark's
own list of splits), which gives each range its state and the number of its first record. The second
pass parses every range on its own. Only a record that goes over the end of a range comes in
pieces; these are put together by the number of the record, afterwards.

Rows and numbers are those of one reader over the whole file: blank records count but give no row,
quoted cells may hold line breaks, stray quotes inside of unquoted cells are text, short rows are
filled up, long ones cut, cells are trimmed and empty ones null. A file that can't be decoded, or
a record of over MOST characters, gives a row with its error as text and row_number -1.
"""

from __future__ import annotations

import csv
import io
import math
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.session import ship
from tallyweave.shared import Tables

MARKS = ";,\t"
#: Characters of a record that goes over the ends of ranges.
MOST = 1 << 26
#: Ranges whose states are sent to the tasks at a time (a few numbers each).
RANGES = 200_000
ROWS = "path string, sheet string, row_number int, columns array<string>, data map<string,string>, text string"
PIECES = "number long, start long, piece string"
_FIELDS = [
    ("path", pa.string()), ("sheet", pa.string()), ("row_number", pa.int32()), ("columns", pa.list_(pa.string())), ("data", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
]
ROW_SCHEMA = pa.schema(_FIELDS)
PARSED_SCHEMA = pa.schema([*_FIELDS, ("number", pa.int64()), ("start", pa.int64()), ("piece", pa.string())])
#: Tries of both passes, where the ranges changed between them (a cluster that grew or shrank).
TRIES = 3
csv.field_size_limit(2**31 - 1)  # a cell may be as long as its record
BOM = b"\xef\xbb\xbf"
_NOT_CP1252 = re.compile(rb"[\x81\x8d\x8f\x90\x9d]")
_LINES = re.compile(rb"[^\r]*\r(?!\Z)|.+\Z", re.S)


def inside_after(line: bytes, inside: bool, mark: bytes) -> bool:
    """Whether the end of a line is inside of quotes. Quotes count at the start of a cell only."""
    at, n = 0, len(line)
    while True:
        if not inside:
            if not line.startswith(b'"', at):
                at = line.find(mark, at) + 1
                if not at:
                    return False
                continue
            at += 1
        end = line.find(b'"', at)
        if end < 0:
            return True
        if line.startswith(b'"', end + 1):  # a doubled one
            inside, at = True, end + 2
            continue
        inside = False
        at = line.find(mark, end + 1) + 1  # what follows the closing quote belongs to the cell
        if not at or end + 1 >= n:
            return False


def _lines(value: bytes) -> list[bytes]:
    """The lines of what stands between two line feeds: a carriage return of its own ends one too."""
    return [value] if b"\r" not in value[:-1] else _LINES.findall(value)


class _Sums:
    """What the first pass tells of a range."""

    def __init__(self, path: str, start: int):
        self.path, self.start = path, start
        self.ends = {(m, s): s for m in MARKS for s in (False, True)}
        self.records = dict.fromkeys(self.ends, 0)
        self.plain = 0  # lines without quotes since the last one with
        self.utf8 = self.cp1252 = True
        self.head: list[bytes] = []
        self.head_open = start == 0
        self.mark = None

    def _settle(self) -> None:
        for key, inside in self.ends.items():
            if not inside:
                self.records[key] += self.plain
        self.plain = 0

    def add(self, values: list[bytes]) -> None:
        for value in values:
            for line in _lines(value):
                quotes = b'"' in line
                if self.head_open:
                    self._header(line)
                if not quotes:
                    self.plain += 1
                    continue
                self._settle()
                for key, inside in self.ends.items():
                    self.records[key] += not inside
                    self.ends[key] = inside_after(line, inside, key[0].encode())

    def _header(self, line: bytes) -> None:
        if self.mark is None:
            own = line[3:] if line.startswith(BOM) else line
            self.mark, line = best_mark(own.decode("latin-1")), own
            self.inside = False
        self.inside = inside_after(line.rstrip(b"\r"), self.inside, self.mark.encode())
        self.head.append(line)
        self.head_open = self.inside and sum(map(len, self.head)) < MOST

    def row(self) -> dict:
        self._settle()
        return {
            "path": self.path, "start": self.start, "utf8": self.utf8, "cp1252": self.cp1252, "mark": self.mark,
            "head": None if self.start or self.mark is None or self.head_open else b"\n".join(self.head),
            "ends": [self.ends[k] for k in sorted(self.ends)], "records": [self.records[k] for k in sorted(self.records)],
        }


def best_mark(line: str) -> str:
    """The commonest of the marks in a line; the first one of equally common ones."""
    return max(MARKS, key=line.count) if any(m in line for m in MARKS) else ";"


def _order(mark: str, inside: bool) -> int:
    return sorted((m, s) for m in MARKS for s in (False, True)).index((mark, inside))


_SUMS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("utf8", pa.bool_()), ("cp1252", pa.bool_()), ("mark", pa.string()), ("head", pa.binary()), ("ends", pa.list_(pa.bool_())), ("records", pa.list_(pa.int64()))])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Sums | None = None
    for b in batches:
        paths, starts = b.column("path"), b.column("start").to_pylist()
        for first, end in _runs(starts, paths):
            path, start = paths[first].as_py(), starts[first]
            if now is None or (now.path, now.start) != (path, start):
                if now is not None:
                    yield pa.RecordBatch.from_pylist([now.row()], _SUMS)
                now = _Sums(path, start)
            values = b.column("value").slice(first, end - first)
            own = values.to_pylist()
            whole = b"\n".join(own)
            now.cp1252 &= _NOT_CP1252.search(whole) is None
            try:
                whole.decode("utf-8")
            except UnicodeDecodeError:
                now.utf8 = False
            now.add(own)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row()], _SUMS)


def _runs(starts: list[int], paths: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of rows of one range; rows of a range follow each other."""
    names = paths.dictionary_encode().indices.to_pylist() if not isinstance(paths, pa.DictionaryArray) else paths.indices.to_pylist()
    first = 0
    for k in range(1, len(starts) + 1):
        if k == len(starts) or (starts[k], names[k]) != (starts[first], names[first]):
            yield first, k
            first = k


class _Range:
    """Parses the lines of one range. inside: whether it starts inside of quotes, number: of the
    first record that begins in it."""

    def __init__(self, inside: bool, number: int, mark: str, encoding: str):
        self.inside, self.number, self.mark, self.encoding = inside, number, mark, encoding
        self.before, self.head = number - 1, inside  # the first lines belong to a record of a range before
        self.held: list[bytes] = []  # lines of an open record
        self.pieces: list[tuple[int, str]] = []

    def add(self, values: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(number, cells) of the records that end in these lines."""
        own, mark = self.held, self.mark.encode()
        begin = done = 0
        for value in values:
            lines = _lines(value)
            lines[-1] += b"\n"
            for line in lines:
                own.append(line)
                if b'"' in line:
                    self.inside = inside_after(line.rstrip(b"\r\n"), self.inside, mark)
                if not self.inside:
                    done = len(own)
                    if self.head:
                        self.pieces.append((self.before, self._text(own)))
                        self.head, begin = False, done
        self.held = own[done:]
        for cells in csv.reader(map(self._decoded, own[begin:done]), delimiter=self.mark):
            yield self.number, cells
            self.number += 1

    def end(self) -> list[tuple[int, str]]:
        """(number, text) of the pieces of records that go over this range's ends."""
        if self.held:
            self.pieces.append((self.before if self.head else self.number, self._text(self.held)))
        return self.pieces

    def _decoded(self, line: bytes) -> str:
        return line.decode(self.encoding)

    def _text(self, lines: list[bytes]) -> str:
        return b"".join(lines).decode(self.encoding)


def full_row(path: str, number: int, columns: list[str], cells: list[str]) -> dict:
    data = {c: v.strip() or None for c, v in zip(columns, [*cells, *[""] * len(columns)], strict=False)}
    return {"path": path, "sheet": None, "row_number": number, "columns": columns, "data": list(data.items()), "text": None}


def error_row(path: str, error: str) -> dict:
    return {"path": path, "sheet": None, "row_number": -1, "columns": [], "data": [], "text": error}


class RangesChanged(ValueError):
    pass


def _parsed(batches: Iterator[pa.RecordBatch], states: dict, files: dict) -> Iterator[pa.RecordBatch]:
    """The rows of all ranges, and the pieces of records that go over their ends."""
    now, key, out = None, None, []

    def closed() -> list[dict]:
        return [] if now is None else [{"path": key[0], "number": n, "start": key[1], "piece": text} for n, text in now.end()]

    for b in batches:
        paths, starts = b.column("path"), b.column("start").to_pylist()
        for first, end in _runs(starts, paths):
            here = paths[first].as_py(), starts[first]
            if here != key:
                out += closed()
                key, now = here, None
                if files.get(here[0]) is not None:
                    if here not in states:
                        raise RangesChanged(f"the ranges of {here[0]} changed between two passes")
                    mark, encoding, columns, skip = files[here[0]]
                    now = _Range(*states[here], mark, encoding)
            if now is None:
                continue
            values = b.column("value").slice(first, end - first).to_pylist()
            if here[1] == 0 and now.number == 1 and not now.held and values[0].startswith(BOM) and encoding == "utf-8":
                values[0] = values[0][3:]
            for number, cells in now.add(values):
                if number > skip and any(c.strip() for c in cells):
                    out.append(full_row(shown(key[0]), number, columns, cells))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, PARSED_SCHEMA)
                out = []
    out += closed()
    if out:
        yield pa.RecordBatch.from_pylist(out, PARSED_SCHEMA)


def _glued(batches: Iterator[pa.RecordBatch], files: dict) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for path, number, size, parts in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
            mark, _, columns, skip = files[path]
            if parts is None:
                out.append(error_row(shown(path), f"record {number} has {size} characters"))
                continue
            text = "".join(p["piece"] for p in parts)
            cells = next(csv.reader(io.StringIO(text, newline=""), delimiter=mark))
            if number > skip and any(c.strip() for c in cells):
                out.append(full_row(shown(path), number, columns, cells))
        yield pa.RecordBatch.from_pylist(out, ROW_SCHEMA)


def shown(path: str) -> str:
    """A path as Spark's other file sources show it."""
    return re.sub("^file:/+", "file:/", unquote(path))


def columns_of(path: str, columns: dict[str, list[str]]) -> list[str] | None:
    """The columns of a ledger by the end of its path: the longest one given that fits, or those of "*"."""
    fits = [k for k in columns if path == k or path.endswith(f"/{k}")]
    return columns[max(fits, key=len)] if fits else columns.get("*")


def _along(sums: list, columns: dict[str, list[str]] | None) -> tuple[dict, dict, list[dict]]:
    """States of ranges, what is known of files, and rows of errors."""
    states, files, errors = {}, {}, []
    by_path: dict[str, list] = {}
    for row in sums:
        by_path.setdefault(row.path, []).append(row)
    for path, own in by_path.items():
        own.sort(key=lambda r: r.start)
        files[path] = None
        if columns is not None:
            mark, encoding, names, skip = ";", "cp1252", columns_of(shown(path), columns), 0
            if names is None:
                continue
            if not all(r.cp1252 for r in own):
                errors.append(error_row(shown(path), "UnicodeDecodeError: not in Windows-1252"))
                continue
        else:
            encoding = "utf-8" if all(r.utf8 for r in own) else "cp1252" if all(r.cp1252 for r in own) else "latin-1"
            mark, skip = own[0].mark, 1
            if own[0].head is None:
                errors.append(error_row(shown(path), "the header doesn't end in the file's first range"))
                continue
            head = next(csv.reader(io.StringIO(bytes(own[0].head).decode(encoding), newline=""), delimiter=mark), [])
            names = [c.strip() for c in head]
        files[path] = (mark, encoding, names, skip)
        inside, number = False, 1
        for r in own:
            states[path, r.start] = (inside, number)
            k = _order(mark, inside)
            number += r.records[k]
            inside = r.ends[k]
    return states, files, errors


def _ranges_of(spark: SparkSession, size: str | None) -> SparkSession:
    """A session whose text source cuts files into ranges of `size` bytes, but deals many of them to a
    task: neither the tasks nor the files that they write grow in number with the ranges."""
    if size is None:
        return spark
    other = spark.newSession()
    tasks = max(64, 4 * spark.sparkContext.defaultParallelism)
    keys = {"maxPartitionBytes": size, "openCostInBytes": "1k", "maxPartitionNum": str(tasks)}
    for key, value in keys.items():
        other.conf.set(f"spark.sql.files.{key}", value)
    other.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(tasks))
    return other


def _lines_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(paths)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def scan(spark: SparkSession, paths: str | list[str], columns: dict[str, list[str]] | None = None, ranges: str | None = None) -> DataFrame:
    """Rows of delimited files, written once to the shared folder. columns: the columns of ledgers
    (semicolons, Windows-1252, no header) by the ends of their paths, files without are passed over;
    None: CSV files with a header, whose encoding and mark are worked out for each file. ranges: bytes
    of a range ("16k"), where it should be less than the session's splits; what the scan writes is
    still read back by the session's splits."""
    ship(spark)
    for k in range(TRIES):
        try:
            return _scan(spark, paths, columns, ranges)
        except PythonException as e:
            if "RangesChanged" not in str(e) or k == TRIES - 1:
                raise
    raise AssertionError


def _scan(spark: SparkSession, paths: str | list[str], columns: dict[str, list[str]] | None, ranges: str | None = None) -> DataFrame:
    tables, lines = Tables(spark), _lines_of(_ranges_of(spark, ranges), paths)
    sums = tables.write(lines.mapInArrow(_summed, "path string, start long, utf8 boolean, cp1252 boolean, mark string, head binary, ends array<boolean>, records array<long>"), "ranges")
    groups = max(1, math.ceil(sums.count() / RANGES))
    out = None
    for group in range(groups):
        chosen = F.pmod(F.xxhash64("path"), F.lit(groups)) == group
        states, files, errors = _along(sums.where(chosen).collect(), columns)
        sent = spark.sparkContext.broadcast((states, files))
        own = lines if groups == 1 else lines.where(chosen)
        parsed = tables.write(own.mapInArrow(lambda x, sent=sent: _parsed(x, *sent.value), f"{ROWS}, {PIECES}"), f"rows-{group}")
        rows = parsed.where("piece IS NULL").drop("number", "start", "piece")
        parts = parsed.where("piece IS NOT NULL").select("path", "number", "start", "piece")
        sizes = parts.groupBy("path", "number").agg(F.sum(F.char_length("piece")).alias("size"))
        whole = parts.join(sizes.where(F.col("size") <= MOST).select("path", "number"), ["path", "number"], "left_semi")
        whole = whole.groupBy("path", "number").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("parts"))  # a record
        told = sizes.join(whole, ["path", "number"], "left").select("path", "number", "size", "parts")
        rows = rows.unionByName(told.mapInArrow(lambda x, sent=sent: _glued(x, sent.value[1]), ROWS))
        if errors:
            rows = rows.unionByName(spark.createDataFrame([(r["path"], None, -1, [], {}, r["text"]) for r in errors], ROWS))
        out = rows if out is None else out.unionByName(rows)
    tables.drop("ranges")
    return out
