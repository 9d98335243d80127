"""Token-id files: one zstandard frame for each document, with a dictionary they all share.

A folder holds `dictionary` (trained on serialized ids of a bounded sample of documents)
and data files `ids-*.bin`. A data file is: MAGIC, the dictionary's SHA-256 (32 bytes), the
frames of its documents in ascending doc_id order, then the index as five little-endian
64-bit arrays (doc_id, offset, size, n_tokens, start in the file), their length and
MAGIC again. So a document is read with one seek to the index and one to its frame. Ids
are serialized as unsigned 16-bit integers if the vocabulary allows it, else 32-bit.

Files are cut by ranges of doc_id: the order of the files is that of their first doc_id.
A task writes under a name of its own, and only the names that successful tasks report
are read, so repeated tasks do no harm.

Edge cases: a null or empty text has only the end id; repeated doc_ids are all kept, in
order of their texts; rows without doc_id are left out; an empty table gives no data file; other columns don't
matter. Folders are opened by Arrow, so they need a scheme that it knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import words
from tallyweave.session import ship

MAGIC = b"TWIDS01\n"
#: Bounds of the sample that the dictionary is trained on: documents, and bytes of each.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16_384, 65_536
LEVEL = 3
FIELDS = 5


@dataclass(frozen=True)
class Files:
    """What a write made: the folder, the dictionary, and (name, docs, tokens) in order."""

    folder: str
    dictionary: bytes
    width: int
    files: list[tuple[str, int, int]]


def _fs(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def train(samples: list[bytes]) -> bytes:
    """A dictionary for `samples`; no bytes if there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def sample_ids(rows: DataFrame) -> list[int]:
    """The ids with the least hashes, SAMPLE_DOCS at most. Only ids with hashes under a bound that
    about twice as many have leave their tasks, and no texts."""
    h = F.xxhash64("doc_id")
    share = min(1.0, 2 * SAMPLE_DOCS / max(1, rows.count()))
    low = rows.where(h <= F.lit(min(2**63 - 1, int(-(2**63) + share * (2**64 - 1))))).select("doc_id", h.alias("h")).distinct()
    return [r.doc_id for r in low.orderBy("h", "doc_id").limit(SAMPLE_DOCS).collect()]


def write(docs: DataFrame, folder: str, end: int = 2, vocabulary: str | None = None) -> Files:
    """Encodes all documents and writes them to the new folder."""
    spark = docs.sparkSession
    ship(spark)
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(words.place(vocabulary)).get_vocab_size() <= 1 << 16 else 4
    rows = words.documents(docs)
    some = rows.where(F.col("doc_id").isin(sample_ids(rows))).limit(SAMPLE_DOCS).select("doc_id", F.substring("text", 1, 4 * SAMPLE_BYTES).alias("text"))
    sample = words.token_ids(some, vocabulary, end).collect()
    raw = train([np.frombuffer(r.ids, "<u4").astype(f"<u{width}").tobytes()[:SAMPLE_BYTES] for r in sample])
    own, base = _fs(folder)
    own.create_dir(base)
    with own.open_output_stream(f"{base}/dictionary") as f:
        f.write(raw)

    def run(batches):
        import zstandard

        fs, at = _fs(folder)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw))
        name = f"ids-{uuid.uuid4().hex}.bin"
        index: list[tuple[int, ...]] = []
        out, offset, tokens = None, len(MAGIC) + 32, 0
        for b in batches:
            if out is None and b.num_rows:
                out = fs.open_output_stream(f"{at}/{name}")
                out.write(MAGIC + hashlib.sha256(raw).digest())
            ids_of = b.column(0).to_pylist()
            for row, ids in words.encoded(b, "text", vocabulary, end):
                frame = packer.compress(ids.astype(f"<u{width}").tobytes())
                index.append((ids_of[row], offset, len(frame), len(ids), tokens))
                out.write(frame)
                offset += len(frame)
                tokens += len(ids)
        if out is not None:
            packed = np.array(index, "<i8").T.tobytes()
            out.write(packed + struct.pack("<q", len(index)) + MAGIC)
            out.close()
            yield pa.RecordBatch.from_pylist([{"name": name, "first": index[0][0], "docs": len(index), "tokens": tokens}])

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = sorted(ordered.mapInArrow(run, "name string, first long, docs long, tokens long").collect(), key=lambda r: r.first)
    files = [(r.name, r.docs, r.tokens) for r in made]
    with own.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"width": width, "dictionary_sha256": hashlib.sha256(raw).hexdigest(), "files": files}).encode())
    return Files(folder, raw, width, files)


def open_files(folder: str) -> Files:
    """The files that a finished write left in the folder."""
    fs, at = _fs(folder)
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        told = json.loads(f.read())
    with fs.open_input_stream(f"{at}/dictionary") as f:
        raw = f.read()
    if hashlib.sha256(raw).hexdigest() != told["dictionary_sha256"]:
        raise ValueError("the folder's dictionary isn't the one its files were written with")
    return Files(folder, raw, told["width"], [tuple(x) for x in told["files"]])


def _index(f, sha: bytes) -> np.ndarray:
    """The five index arrays of an open data file."""
    size = f.size()
    f.seek(0)
    if f.read(len(MAGIC) + 32) != MAGIC + sha:
        raise ValueError("written with another dictionary")
    f.seek(size - 8 - len(MAGIC))
    n = struct.unpack("<q", f.read(8))[0]
    f.seek(size - 8 - len(MAGIC) - FIELDS * 8 * n)
    return np.frombuffer(f.read(FIELDS * 8 * n), "<i8").reshape(FIELDS, n)


def read_document(files: Files, name: str, doc_id: int) -> np.ndarray | None:
    """Ids of one document of one file: a look into the index, then one short read."""
    import zstandard

    fs, at = _fs(files.folder)
    with fs.open_input_file(f"{at}/{name}") as f:
        index = _index(f, hashlib.sha256(files.dictionary).digest())
        k = int(np.searchsorted(index[0], doc_id))
        if k == index.shape[1] or index[0][k] != doc_id:
            return None
        f.seek(int(index[1][k]))
        frame = f.read(int(index[2][k]))
    data = zstandard.ZstdDecompressor(dict_data=_dictionary(files.dictionary)).decompress(frame)
    return np.frombuffer(data, f"<u{files.width}").astype(np.uint32)


def read(spark: SparkSession, files: Files) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (32-bit, as binary)."""
    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids binary"
    starts = np.cumsum([0, *(t for _, _, t in files.files)]).tolist()
    rows = [(name, base) for (name, _, _), base in zip(files.files, starts, strict=False)]
    if not rows:
        return spark.createDataFrame([], schema)
    folder, raw, width = files.folder, files.dictionary, files.width

    def run(batches):
        import zstandard

        fs, at = _fs(folder)
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for b in batches:
            for name, base in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                with fs.open_input_file(f"{at}/{name}") as f:
                    index = _index(f, hashlib.sha256(raw).digest())
                    n = index.shape[1]
                    cuts = np.unique(np.concatenate([np.searchsorted(index[4], np.arange(0, index[4][-1] + 1, 2_000_000)), [n]]))
                    for lo, hi in zip([0, *cuts.tolist()], cuts.tolist(), strict=False):
                        if lo == hi:
                            continue
                        f.seek(int(index[1][lo]))
                        data = f.read(int(index[1][hi - 1] + index[2][hi - 1] - index[1][lo]))
                        at0 = int(index[1][lo])
                        ids = []
                        for o, s in zip((index[1][lo:hi] - at0).tolist(), index[2][lo:hi].tolist(), strict=True):
                            one = np.frombuffer(unpack.decompress(data[o : o + s]), f"<u{width}")
                            ids.append(one.astype("<u4").tobytes())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(index[0][lo:hi]), pa.array(index[4][lo:hi] + base), pa.array(index[3][lo:hi]), pa.array(ids, pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )

    names = spark.createDataFrame(rows, "name string, base long").repartition(len(rows))
    return names.mapInArrow(run, schema)
