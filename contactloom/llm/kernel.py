"""Vectorised text helpers: words, window hashes and packed key blobs, all over Arrow string arrays.

Everything here works on a slice of documents at once: the texts are one byte array with document offsets, so the cost is
per byte, not per Python call. Hashes depend on content only (never on a salt or a process), so tasks agree on them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at one time; a longer document is a slice of its own.
SLICE_BYTES = 1 << 18

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (shift, xor, multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
#: A value of its own for each byte at each of the first 64 places of a word, and an odd factor for each place of a run: a
#: polynomial modulo 2**64 would give equal sums to some long patterns, whatever its base.
PLACED = mix(np.arange(1, 64 * 256 + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(0x632BE59BD9B4E019))
FACTORS = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F)) | U(1)
BASE = U(0xD6E8FEB86659FD93)
BASE_INV = U(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << int(n - 1).bit_length())
        have = np.full(size, base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 2 * SLICE_BYTES:
            _powers[int(base)] = have
    return have[:n]


def release() -> None:
    """Gives memory that was freed back to the system: a Python worker lives on from task to task, and what the C library keeps
    for it would add up over the stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def as_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each (null is empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def slices(data: np.ndarray, off: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of whole documents of about `size` bytes."""
    at, n = 0, len(off) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def owners(pos: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The document that holds each byte position."""
    return np.searchsorted(off, pos, "right") - 1


@dataclass
class Words:
    """Words (runs of non-space bytes) of a slice: byte spans, document, content hash; `first` has each document's first word."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, off: np.ndarray, lower: bool = False) -> Words:
    n, docs = len(data), len(off) - 1
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, z.astype(U), np.zeros(docs + 1, np.int64))
    if lower:
        data = LOWER[data]
    inner = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    begins = inner.copy()
    begins[1:] &= ~inner[:-1] | cut[1:n]
    ends = inner.copy()
    ends[:-1] &= ~inner[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        z = np.zeros(0, np.int64)
        return Words(z, z, z, z.astype(U), np.zeros(docs + 1, np.int64))
    length = end - start
    at = np.flatnonzero(inner)  # words are exactly the inner bytes, in order
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    within = np.arange(len(at)) - np.repeat(begin, length)
    value = PLACED[((within & 63) << 8) | data[at]]
    if int(length.max()) > 64:
        late = np.flatnonzero(within > 63)
        value[late] = mix(value[late] + (within[late] >> 6).astype(U) * U(0x9E3779B97F4A7C15))
    h = mix(np.add.reduceat(value, begin) + length.astype(U))
    doc = owners(start, off)
    return Words(start, end, doc, h, np.searchsorted(doc, np.arange(docs + 1)))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values (len - k + 1 of them)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    acc = h[:m] * _factor(0)
    for j in range(1, k):
        acc += h[j : j + m] * _factor(j)
    return mix(acc)


def _factor(j: int) -> np.uint64:
    return FACTORS[j] if j < len(FACTORS) else mix(np.array([j + 1], U) * U(0xA0761D6478BD642F))[0] | U(1)


#: Bytes that are hashed together before they enter a sum.
STEP = 8


def eights(data: np.ndarray) -> np.ndarray:
    """Hash of the STEP bytes from each place of a slice of STEP bytes or more."""
    h = BYTE[data]
    for step in (1, 2, 4):  # of 2, 4, 8 bytes from each place
        h = h[:-step] * powers(BASE, STEP)[step] + h[step:]
    return h


class Spans:
    """Hashes of any byte ranges of one slice that have STEP bytes or more, by prefix sums of a polynomial in the mixed hashes
    of the STEP bytes from each place. (A polynomial in the bytes themselves gives equal sums to some long patterns.)"""

    def __init__(self, h: np.ndarray, n: int):
        """h: eights() of the slice, n: its bytes."""
        self.sums = np.zeros(max(n - STEP + 2, 1), U)
        np.cumsum(mix(h) * powers(BASE, len(h)), out=self.sums[1:])
        self.inverse = powers(BASE_INV, len(self.sums))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[np.asarray(b) - (STEP - 1)] - self.sums[a]) * self.inverse[a] + (np.asarray(b) - a).astype(U))


def pack(values: np.ndarray) -> bytes:
    """Values as byte planes: sorted or small ones compress well on their way through a shuffle."""
    v = np.ascontiguousarray(values)
    return v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()


def unpack(blob: bytes, dtype=U) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def member(values: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Which values are in the sorted pool."""
    if not len(pool) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(pool, values)
    at[at == len(pool)] = 0
    return pool[at] == values


def unique_many(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and those of them that occur more than once."""
    keys = np.sort(keys)
    if not len(keys):
        return keys, keys
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    again = np.concatenate((~new[1:], [False])) & new
    return keys[new], keys[again]


def ints(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A bigint column; null counts as the largest value."""
    top = np.iinfo(np.int64).max
    return np.asarray(column.cast(pa.int64()).fill_null(top).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.int64()).fill_null(top).to_numpy())


def spread(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges [lo, hi)."""
    lo, hi = np.clip(lo, 0, n), np.clip(hi, 0, n)
    ok = hi > lo
    d = np.bincount(lo[ok], minlength=n + 1) - np.bincount(hi[ok], minlength=n + 1)
    return np.cumsum(d[:n]) > 0
