"""Split scans give the rows and numbers of one reader over the whole file."""

import contextlib
import csv
import io
import random

import pytest

from tallyweave.sources import delimited, files

COLUMNS = ["A", "B", "C"]


@contextlib.contextmanager
def small_ranges(spark, size):
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def cells(r, mark):
    out = []
    for _ in range(3):
        text = "".join(r.choices(["a", "é", " ", '"', mark, "\n", "\r\n", "\r", "word", "1,5", ""], k=r.randint(0, 6)))
        kind = r.random()
        if kind < 0.4:
            text = '"' + text.replace('"', '""') + '"' + r.choice(["", "", "x"])  # quoted, sometimes with more behind it
        else:
            text = "".join(c for c in text if c not in mark + "\r\n").lstrip('"')  # stray quotes stay
        out.append(text)
    return mark.join(out)


def content(seed, mark=";", header=""):
    r = random.Random(seed)
    ends = r.choice(["\n", "\r\n"])
    lines = [cells(r, mark) if r.random() < 0.9 else "" for _ in range(40)]
    return header + ends.join(lines) + r.choice(["", ends])


def told(df):
    return sorted(((r.path.rsplit("/", 1)[-1], r.row_number, r.columns, r.data, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [160, 100_000])
def test_ledgers_equal_the_reader_of_whole_files(spark, tmp_path, size):
    for k in range(3):
        (tmp_path / f"L{k}.txt").write_bytes(content(k).encode("cp1252"))
    (tmp_path / "other.txt").write_bytes(b"x;y;z\n")
    columns = {f"L{k}.txt": COLUMNS[: 2 + k % 2] for k in range(3)}
    want = told(files.ledger_rows(files.binary_files(spark, str(tmp_path)), columns))
    with small_ranges(spark, size):
        found = delimited.scan(spark, str(tmp_path), columns)
        assert told(found) == want and len(want) > 60
    assert {r.path for r in found.collect()} == {r.path for r in files.binary_files(spark, str(tmp_path)).collect() if "L" in r.path.rsplit("/", 1)[-1]}


@pytest.mark.parametrize("size", [190, 100_000])
def test_csv_files_equal_the_reader_of_whole_files(spark, tmp_path, size):
    head = 'Konto;"Na""me";Wert\n'
    (tmp_path / "a b.csv").write_bytes(b"\xef\xbb\xbf" + content(1, header=head).encode("utf-8"))
    (tmp_path / "b.csv").write_bytes(content(2, ",", head.replace(";", ",")).encode("cp1252"))
    (tmp_path / "c.csv").write_bytes(content(3, "\t", head.replace(";", "\t")).encode("utf-8") + b"\x81\xff")
    (tmp_path / "d.csv").write_bytes(b"only")
    want = told(files.csv_rows(files.binary_files(spark, str(tmp_path))))
    with small_ranges(spark, size):
        assert told(delimited.scan(spark, str(tmp_path))) == want and len(want) > 60


def test_state_after_a_line_is_that_of_the_reader():
    r = random.Random(4)
    for _ in range(30_000):
        line = "".join(r.choices('a";"', k=r.randint(0, 9)))
        inside = r.random() < 0.5
        rows = list(csv.reader(io.StringIO(('"' if inside else "") + line + "\n#\n", newline=""), delimiter=";"))
        assert delimited.inside_after(line.encode(), inside, b";") == (len(rows) == 1), (line, inside)


def test_errors_and_odd_files(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"a;\x81;c\n")
    (tmp_path / "open.txt").write_bytes(b'a;b;c\n"never;ends\nx;y;z\n')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "open.txt").write_bytes(b"1;2\n")
    with small_ranges(spark, 8):
        rows = told(delimited.scan(spark, str(tmp_path), {"bad.txt": COLUMNS, "open.txt": COLUMNS, "sub/open.txt": ["X", "Y"]}))
    assert [r for r in rows if r[0] == "bad.txt"] == [("bad.txt", -1, [], {}, "UnicodeDecodeError: not in Windows-1252")]
    assert ("open.txt", 1, ["X", "Y"], {"X": "1", "Y": "2"}, None) in rows
    assert ("open.txt", 2, COLUMNS, {"A": "never;ends\nx;y;z", "B": None, "C": None}, None) in rows


def test_records_that_are_too_long_are_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "MOST", 40)
    (tmp_path / "l.txt").write_bytes(b'a;"' + b"x\n" * 50 + b'";c\nd;e;f\n')
    with small_ranges(spark, 16):
        rows = delimited.scan(spark, str(tmp_path), {"l.txt": COLUMNS}).collect()
    assert sorted((r.row_number, r.text) for r in rows)[0] == (-1, "record 1 has 107 characters")
    assert [r.data["A"] for r in rows if r.row_number == 2] == ["d"]


def test_a_cell_longer_than_the_readers_usual_limit(spark, tmp_path):
    (tmp_path / "long.csv").write_bytes(b"a;b\n" + b"x" * 200_000 + b";1\n")
    assert len(files.csv_rows(files.binary_files(spark, str(tmp_path))).first().data["a"]) == 200_000
    assert len(delimited.scan(spark, str(tmp_path)).first().data["a"]) == 200_000


def test_small_ranges_make_neither_tasks_nor_files(spark, tmp_path):
    """120 ranges: the scan's tables have the files of 64 tasks at most, and are read back by the session's own splits."""
    for k in range(4):
        (tmp_path / f"L{k}.txt").write_bytes(b"".join(b'%d;"x\ny";c\n' % n for n in range(250)))
    found = delimited.scan(spark, str(tmp_path), {"*": COLUMNS}, ranges="100")
    rows = found.collect()
    assert sorted((r.path[-6:], r.row_number, r.data["A"], r.data["B"]) for r in rows) == sorted((f"L{k}.txt", n + 1, str(n), "x\ny") for k in range(4) for n in range(250))
    assert 0 < len(found.inputFiles()) <= 64 and found.rdd.getNumPartitions() <= 16
