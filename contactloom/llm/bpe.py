"""Byte-level BPE by a file of ranks: whole texts to token ids, and token ids back to bytes.

The tiktoken library does both. It is given the matches of a pattern one by one, so a text may be cut wherever no match can
cross; long texts are cut there, which bounds the library's working memory and keeps its regular expressions away from the
inputs that they can't take (a run of a million blanks overflows their stack). Each match is still encoded by itself and
whole, also when it is a single run of letters of any length.

Defined cases: a null or empty text has no ids; ids that decode to bytes that are no UTF-8 stay bytes; null ids decode to no
bytes; a null or repeated doc_id is kept as it is; an empty table gives none; only the columns named here are returned.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from . import kernel as K

#: Texts up to so many characters go to the library in one call; longer ones in parts of about this size.
PART_CHARS = 1 << 15
#: Runs of white space from here on are handed over as matches of their own.
LONG_BLANK = 1 << 10
#: The characters with the White_Space property
_BLANK = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters whose class no version of Unicode has changed, and ASCII marks but the apostrophe, which may begin a contraction
_LETTER = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_MARK = r"!-&(-/:-@\[-`{-~\u3001\u3002"
#: Places that no match of the byte-level pattern crosses: before white space that follows anything else, and where letters,
#: digits and marks meet, but for an apostrophe before a letter.
_SAFE = regex.compile(f"(?<=[0-9{_LETTER}{_MARK}])(?=[{_BLANK}])|(?<=[{_LETTER}])(?=[0-9'{_MARK}])|(?<=[0-9])(?=[{_LETTER}'{_MARK}])|(?<=[{_MARK}])(?=[0-9{_LETTER}])")
_BLANKS = regex.compile(f"[{_BLANK}]{{{LONG_BLANK},}}")


@functools.cache
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    """The library's encoding of a file of lines `token in base64, rank`; a worker reads it once."""
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=table, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> Iterator[tuple[str, bool]]:
    """(part, whether it is a single match) of a text, in order; only for the byte-level pattern."""
    at = 0
    for blanks in _BLANKS.finditer(text):
        begin, end = blanks.span()
        if end < len(text):  # the last blank goes with what follows
            end -= 1
        yield from ((p, False) for p in _cut(text, at, begin, size))
        yield text[begin:end], True
        at = end
    yield from ((p, False) for p in _cut(text, at, len(text), size))


def _cut(text: str, at: int, end: int, size: int) -> Iterator[str]:
    while end - at > size:
        place = _SAFE.search(text, at + size, end)
        if place is None or place.start() >= end:
            break
        yield text[at : place.start()]
        at = place.start()
    if at < end:
        yield text[at:end]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.array(ids, "<u4").tobytes()


def encode_text(enc: tiktoken.Encoding, text: str, split: bool = True) -> bytes:
    """Packed ids of a whole text."""
    if not split or len(text) < LONG_BLANK:
        return packed(enc.encode_ordinary(text))
    return b"".join(packed(enc._encode_single_piece(part) if single else enc.encode_ordinary(part)) for part, single in parts(text))


def encode(docs: DataFrame, ranks: str, pattern: str, byte_level: bool = True) -> DataFrame:
    """doc_id, n_tokens and ids (packed little-endian unsigned 32-bit) of docs (doc_id, text).

    byte_level says that the pattern is the usual one of byte-level BPE, for which long texts can be cut; texts go to the
    library whole otherwise.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for batch in batches:
            data, off = K.as_bytes(batch.column("text"))
            for a, b, part, cut in K.slices(data, off):
                raw = part.tobytes()
                ids = [encode_text(enc, raw[cut[i] : cut[i + 1]].decode("utf-8", "replace"), byte_level) for i in range(b - a)]
                yield pa.record_batch([batch.column("doc_id")[a:b], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(work, "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded (raw bytes) of encoded (doc_id, n_tokens, ids).

    Each id stands for fixed bytes, so the ids of a whole batch are looked up at once.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for batch in batches:
            data, off = K.as_bytes(batch.column("ids"))
            for a, b, part, cut in K.slices(data, off):
                ids = np.frombuffer(part.tobytes(), "<u4")
                texts = [enc.decode_bytes(ids[cut[i] // 4 : cut[i + 1] // 4].tolist()) for i in range(b - a)]
                yield pa.record_batch([batch.column("doc_id")[a:b], batch.column("n_tokens")[a:b], batch.column("ids")[a:b], pa.array(texts, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    rows = encoded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(work, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")
