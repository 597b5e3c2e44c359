"""Token sequences as length-delimited binary records, with an offset index for shuffled reads.

A file is a run of frames, all numbers little-endian:

    payload length  uint64      masked checksum of those 8 bytes   uint32
    payload         bytes       masked checksum of the payload     uint32      0x0A

A payload is: doc_id int64, 1 if there is a doc_id else 0 (uint8), bytes of an id (uint8), the record's number in its file, its
offset there and how many ids lie before it there (uint64 each), then the ids. A masked checksum is CRC-32 rotated right by 15
bits plus 0xA282EAD8, so that a checksum over data that holds checksums stays good. Before the 0x0A, bytes FF, 0A and a first EF
(of a byte order mark, which readers of lines drop) are written as FF 30, FF 31 and FF 32, so 0x0A ends a frame and nothing else.

Files are in ascending order of doc_id, and so are the frames in each. Spark's own text writer and reader make and read the
files, on any store: a frame is a line, whose bytes Spark keeps as they are. So a reader holds a batch of records at a time
and not a file, and Spark may share a file among tasks: a frame says itself where it lies. A task begins a new file,
data/piece=N/part-M, before one would grow beyond `file_bytes`. The index has, for each record, its file (relative to the
folder, which may be moved), offset, length, doc_id and number of ids.

Defined cases: a null or empty text is the end id alone; a null doc_id comes first; rows with the same doc_id are records
next to each other, by the hash of their text, and however many there are, they lie over several tasks; an empty table gives
no records; extra columns are ignored. A damaged frame raises ValueError.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import kernel as K
from .rounds import partitions
from .tokens import encoder, forget

END_ID = 2
FILE_BYTES = 64 << 20
SLICE_BYTES = 4 << 20  # of text, that is encoded at one time
_HEAD, _ROW = struct.Struct("<QI"), struct.Struct("<qBBQQQ")
_INDEX = "file string, record bigint, offset bigint, length bigint, doc_id bigint, n_tokens bigint, before bigint"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    raw = b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))
    raw = raw.replace(b"\xff", b"\xff0").replace(b"\n", b"\xff1")
    return (b"\xff2" + raw[1:] if raw.startswith(b"\xef") else raw) + b"\n"


def unframed(line: bytes, check: bool = True) -> bytes:
    """The payload of a frame without its 0x0A."""
    raw = line.replace(b"\xff2", b"\xef").replace(b"\xff1", b"\n").replace(b"\xff0", b"\xff")
    if len(raw) < _HEAD.size + 4:
        raise ValueError("truncated record")
    size, crc = _HEAD.unpack_from(raw)
    if masked(raw[:8]) != crc:
        raise ValueError("damaged length of a record")
    body = raw[_HEAD.size : -4]
    if len(body) != size:
        raise ValueError("truncated record")
    if check and masked(body) != struct.unpack_from("<I", raw, _HEAD.size + size)[0]:
        raise ValueError("damaged record")
    return body


def parse(content: bytes, at: int = 0, check: bool = True) -> tuple[bytes, int]:
    """The payload of the frame at a place, and where the next one begins."""
    if (end := content.find(b"\n", at)) < 0:
        raise ValueError(f"truncated record at byte {at}")
    return unframed(content[at:end], check), end + 1


def payload(doc_id: int | None, width: int, ids: bytes, record: int = 0, offset: int = 0, before: int = 0) -> bytes:
    return b"".join((_ROW.pack(doc_id or 0, doc_id is not None, width, record, offset, before), ids))


def opened(data: bytes) -> tuple[int | None, np.ndarray, int, int, int]:
    """doc_id, ids, number, offset and number of ids before it of a payload."""
    doc, known, width, *place = _ROW.unpack_from(data)
    return doc if known else None, np.frombuffer(data, f"<u{width}", offset=_ROW.size), *place


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Writes folder/data (record files) and folder/index (Parquet) of docs (doc_id, text)."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        piece, at = 0, 0
        record = size = before = 0  # of the file
        for batch in batches:
            data, off = K.as_bytes(batch.column("text"))
            docs = batch.column("doc_id").to_pylist()
            for a, b, part, cut in K.slices(data, off, SLICE_BYTES):
                packed, bounds = enc.encode_all(part, cut, end)
                packed, bounds, rows, pieces = memoryview(packed), bounds.tolist(), [], []
                for doc, x, y in zip(docs[a:b], bounds, bounds[1:], strict=False):
                    row = frame(payload(doc, width, packed[x:y], record, size, before))
                    if size and size + len(row) > file_bytes:
                        piece, record, size, before = piece + 1, 0, 0, 0
                        row = frame(payload(doc, width, packed[x:y]))
                    record, size, before = record + 1, size + len(row), before + (y - x) // width
                    rows.append(row[:-1])
                    pieces.append(piece)
                numbers = np.arange(at, at + len(rows), dtype=np.int64)
                at += len(rows)
                yield pa.record_batch([pa.array(pieces, pa.int32()), pa.array(numbers), pa.array(rows, pa.binary())], names=["piece", "at", "value"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("copy", F.xxhash64("text"))
    texts = texts.repartitionByRange(partitions(docs), "doc_id", "copy", F.rand(0)).sortWithinPartitions("doc_id", "copy")  # equal rows over several ranges
    made = texts.select("doc_id", "text").mapInArrow(frames, "piece int, at bigint, value binary").sortWithinPartitions("piece", "at")
    made.select("piece", F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").partitionBy("piece").text(f"{folder}/data")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            rows = []
            for file, line in _framed(batch):
                doc, ids, record, offset, before = opened(unframed(line, False))
                rows.append((file, record, offset, len(line) + 1, doc, len(ids), before))
            if rows:
                yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.string(), *[pa.int64()] * 6), strict=True)], names=_INDEX.replace(",", "").split()[::2])

    _lines(docs.sparkSession, f"{folder}/data").mapInArrow(index, _INDEX).write.parquet(f"{folder}/index")


@functools.lru_cache(1000)
def file_order(path: str) -> tuple[int, int]:
    """Files go by their task's number, which has more digits from 100 000 on, then by their number in it."""
    piece = re.search(r"piece=(\d+)/", path)
    return int(re.search(r"part-(\d+)[^/]*$", path)[1]), int(piece[1]) if piece else 0


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """file (relative to the folder) and value of each frame, without its 0x0A: a string of any bytes, as a cast would copy it."""
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "part-*").text(folder)
    return lines.select(F.substring_index("_metadata.file_path", "/", -2).alias("file"), "value")


def _framed(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    return zip(batch.column("file").to_pylist(), batch.column("value").cast(pa.large_binary()).to_pylist(), strict=True)


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(list(paths)).select(F.substring_index("path", "/", -2).alias("file"), "content")


def _bases(index: DataFrame) -> DataFrame:
    """part, piece, base: how many ids lie in the files before each. Tasks' sums are a row each; files are summed within a task."""
    part, piece = (F.regexp_extract("file", f"{name}(\\d+)", 1).cast("int").alias(c) for name, c in (("part-", "part"), ("piece=", "piece")))
    sizes = index.groupBy(part, piece).agg(F.sum("n_tokens").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("first"))
    inside = sizes.select("part", "piece", before(Window.partitionBy("part").orderBy("piece")).alias("inside"))
    return inside.join(tasks, "part").select("part", "piece", (F.col("first") + F.col("inside")).alias("base"))


def read_records(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (packed uint32) from the files, checksums verified.

    The files are read line by line. With wanted (doc_id), the index says which files hold those records and where: no other
    file is opened, and only those records are cut out and checked, but each of these files is loaded whole. start counts the
    ids of all records before it.
    """
    index = spark.read.schema(_INDEX).parquet(f"{folder}/index")
    names = ["part", "piece", "doc_id", "before", "n_tokens", "ids_crc32", "ids"]
    kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary())

    def rows_of(found: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        """A batch for about SLICE_BYTES of lines."""
        rows, size = [], 0
        for file, line in found:
            doc, ids, _, _, before = opened(unframed(line))
            packed = ids.astype("<u4").tobytes()
            rows.append((*file_order(file), doc, before, len(ids), zlib.crc32(packed), packed))
            size += len(line)
            if size >= K.SLICE_BYTES:
                yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            yield from rows_of(_framed(batch))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for file, content, places in zip(batch.column("file").to_pylist(), batch.column("content"), batch.column("places").to_pylist(), strict=True):
                content = content.as_buffer()
                yield from rows_of((file, content[p["offset"] : p["offset"] + p["length"] - 1].to_pybytes()) for p in places)

    schema = "part int, piece int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    if wanted is None:
        found = _lines(spark, f"{folder}/data").mapInArrow(read, schema)
    else:
        places = index.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("places"))
        held = [r[0] for r in places.select("file").collect()]  # names of files, each of which Spark lists anyway
        files = _files(spark, *(f"{folder}/data/{n}" for n in held)) if held else _files(spark, f"{folder}/data").limit(0)
        found = files.join(places, "file").mapInArrow(cut_out, schema)
    return found.join(_bases(index), ["part", "piece"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")
