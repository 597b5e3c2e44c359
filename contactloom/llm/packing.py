"""Packing of documents into fixed-length sequences along a space-filling curve.

Each document becomes a hashed vector of its tokens, projected to DIMS dimensions; its place on a Hilbert curve through that
space is its sort key, so neighbours along the curve are alike. The documents' tokens are laid end to end in that order and
cut every `length` tokens; only the last sequence is shorter. A caller may give an order that goes before the curve, as of
a mix of sources: the curve then holds inside each of its steps. Keys and sizes alone are range-sorted; places come from a
running sum inside each range and the sums of the ranges before it (one number for each range passes through the driver).
Token ids are written once, and joined to their places.

Defined cases: a null or empty text is the end id alone; documents of equal key follow each other by doc_id; rows with the
same doc_id are separate documents; an empty table gives no sequence; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import kernel as K
from .rounds import partitions
from .scratch import Scratch
from .tokens import encoder, forget, id_type, ids32

LENGTH = 1024
END_ID = 0
FEATURES = 1 << 10
DIMS = 4
SLICE_BYTES = 1 << 20  # of text, that is encoded at one time
BITS = 8


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2**bits (rows of x)."""
    x = x.astype(np.uint32)
    dims = x.shape[1]
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(dims):
            hit = (x[:, i] & q) > 0
            swap = np.where(hit, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(hit, low, swap)
            x[:, i] ^= swap
        q = np.uint32(q >> 1)
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint32)
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        turn ^= np.where((x[:, dims - 1] & q) > 0, np.uint32(q - 1), np.uint32(0))
        q = np.uint32(q >> 1)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> np.uint32(b)) & np.uint32(1)).astype(np.int64)
    return key


def curve_keys(ids: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents (ids[cut[i]:cut[i + 1]], none empty), from the mean projection of their hashed tokens."""
    plane = np.random.default_rng(7).standard_normal((FEATURES, DIMS)).astype(np.float32)
    rows = plane[(K.mix(np.arange(1 << 16, dtype=K.U)) % K.U(FEATURES)).astype(np.int64)[ids & 0xFFFF]]
    means = np.add.reduceat(rows, cut[:-1], axis=0, dtype=np.float64) / np.diff(cut)[:, None]
    place = (0.5 + np.arctan(4 * means) / np.pi) * (1 << BITS)
    return hilbert(np.clip(place.astype(np.int64), 0, (1 << BITS) - 1))


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, keep: tuple[str, ...] = (), lead: Column | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (packed) and the kept columns of every piece of
    docs (doc_id, text). With lead, an integer column made of kept ones, documents are in its order, and along the curve only
    among those of one lead."""
    scratch, dtype = Scratch(docs.sparkSession), id_type(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            data, off = K.as_bytes(batch.column("text"))
            for a, b, part, cut in K.slices(data, off, SLICE_BYTES):
                ids, at = enc.encode_all(part, cut, end)
                tokens = at // enc.dtype.itemsize
                keys = curve_keys(np.frombuffer(ids, enc.dtype, tokens[-1]), tokens)
                packed = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(at), ids]).cast(pa.binary())
                yield pa.record_batch([batch.column("doc_id")[a:b], pa.array(keys), pa.array(np.diff(tokens)), packed, *(batch.column(c)[a:b] for c in keep)], names=["doc_id", "key", "n", "ids", *keep])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    encoded = texts.mapInArrow(encode, "doc_id bigint, key bigint, n bigint, ids binary" + kept).withColumn("row", F.monotonically_increasing_id())
    encoded.write.option("compression", "zstd").parquet(path := scratch.path())
    encoded = docs.sparkSession.read.parquet(path)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = np.cumsum(batch.column("n").to_numpy())
            if len(sums):
                yield pa.record_batch([batch.column("row"), pa.array(total + sums - batch.column("n").to_numpy()), pa.array(np.full(len(sums), part, np.int32)), batch.column("n")], names=["row", "before", "part", "n"])
                total += int(sums[-1])

    by = ["lead"] * (lead is not None) + ["key", "doc_id", "row"]
    placing = encoded if lead is None else encoded.withColumn("lead", lead)
    order = placing.select(*by, "n").repartitionByRange(partitions(docs), *by).sortWithinPartitions(*by)
    order = scratch.save(order.mapInArrow(running, "row bigint, before bigint, part int, n bigint"))
    sums, base = {}, 0
    for part, n in sorted(order.groupBy("part").agg(F.sum("n")).collect()):  # a number for each range
        sums[part] = base
        base += n

    def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            pieces = []  # of each row
            for doc, packed, before, part in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "ids", "before", "part")), strict=True):
                made = len(out["doc_id"])
                ids, at, place = ids32(packed, dtype), 0, sums[part] + before
                while at < len(ids):
                    n = min(len(ids) - at, length - place % length)
                    piece = ids[at : at + n].tobytes()
                    for c, v in zip(out, (doc, at, n, zlib.crc32(piece), len(ids), place // length, place % length, piece), strict=True):
                        out[c].append(v)
                    at, place = at + n, place + n
                pieces.append(len(out["doc_id"]) - made)
            of = pa.array(np.repeat(np.arange(len(pieces)), pieces))
            yield pa.record_batch([*(pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in out.items()), *(batch.column(c).take(of) for c in keep)], names=[*out, *keep])

    placed = encoded.select("doc_id", "row", "ids", *keep).join(order.select("row", "before", "part"), "row")
    return placed.mapInArrow(cut_pieces, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary" + kept)
