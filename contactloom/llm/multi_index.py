"""Approximate nearest neighbours by an inverted multi-index.

The two halves of each vector are quantised separately, so CELLS centroids a half make CELLS**2 cells. The rows of each cell
are stored: a list holds the cells of LIST centroids of the first half, in slices of bounded size. For a query, a heap on the
executors takes the pairs of centroids in the order of their summed distance until the cells taken hold SHARE of all rows (and k others);
the query then goes to the lists of these cells with one bit for each cell, and the rows in them are reranked by true
distance. Centroids are fitted on a sample of at most SAMPLE rows; every row is in the index. Neither rows nor queries
pass through the driver, which gets the sample and CELLS**2 counts.

Measured recall at 10 with these parameters: see the README. Defined cases: vectors that are null, zero or hold a null or
non-finite component take no part; a query's own vec_id is never its candidate; of queries that repeat a vec_id, the
smallest vector is taken; vectors of another number of components are no candidates, each number has an index of its own;
ties go to the smaller vec_id; rows that repeat a vec_id are candidates of their own; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import vectors as V
from .scratch import Scratch

K = 10
CELLS = 256  # centroids of each half
LIST = 8  # centroids of the first half whose cells lie in one list
SAMPLE = 16384  # rows that centroids are fitted on, at most
STEPS = 8  # of k-means
SHARE = 0.35  # of all rows, in the cells that a query takes
WALKS = 64  # queries that one task traverses the index for
_HITS = "query_id bigint, vec_id bigint, score double"

Index = tuple[np.ndarray, np.ndarray]  # centroids of the first and the second half


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T


def fit(sample: np.ndarray, cells: int = CELLS, steps: int = STEPS) -> Index:
    """Centroids of the first and the second half."""
    out, half = [], sample.shape[1] // 2
    for x in (sample[:, :half], sample[:, half:]):
        c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
        for _ in range(steps):
            a = _distances(x, c).argmin(1) if x.shape[1] else np.zeros(len(x), int)
            n = np.bincount(a, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, a, x)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        out.append(c)
    return out[0], out[1]


def assign(x: np.ndarray, index: Index) -> np.ndarray:
    half = x.shape[1] // 2
    return _distances(x[:, :half], index[0]).argmin(1) * len(index[1]) + _distances(x[:, half:], index[1]).argmin(1)


def traverse(q: np.ndarray, index: Index, sizes: np.ndarray, enough: int) -> np.ndarray:
    """Cells in the order of their summed distance until they hold enough rows."""
    half = len(q) // 2
    a, b = _distances(q[None, :half], index[0])[0], _distances(q[None, half:], index[1])[0]
    oa, ob = a.argsort(kind="stable").tolist(), b.argsort(kind="stable").tolist()
    a, b = a.tolist(), b.tolist()
    heap, taken, held = [(a[oa[0]] + b[ob[0]], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = oa[i] * len(b) + ob[j]
        if sizes[cell]:
            taken.append(cell)
            held += sizes[cell]
        if j + 1 < len(b):
            heapq.heappush(heap, (a[oa[i]] + b[ob[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[oa[i + 1]] + b[ob[0]], i + 1, 0))
    return np.array(taken, np.int64)


def nearest(df: DataFrame, k: int = K, every: int = 100, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of df (vec_id, embedding), for queries with vec_id divisible by `every`."""
    scratch = Scratch(df.sparkSession)
    df = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    asked = scratch.save(V.queries(df, every, nonzero=True))
    indexes = {r.d: _fitted(df, r.d) for r in asked.select(F.size("embedding").alias("d")).distinct().collect()}
    stored = scratch.save(_lists(df, indexes))
    sizes = _sizes(stored, indexes)
    return V.ranked(V.meetings(stored, _takers(asked, indexes, sizes, share, k), scratch).mapInArrow(_reranker(k), _HITS), k, "score", "vec_id")


def _fitted(df: DataFrame, dims: int) -> Index:
    rows = df.where((F.size("embedding") == dims) & V.usable(nonzero=True))
    parts = max(1, -(-rows.count() // (SAMPLE // 2)))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == 0).limit(SAMPLE).toArrow()
    x = [x for _, _, x in V.matrices(sample, nonzero=True)]
    return fit(x[0]) if x else (np.zeros((1, dims // 2)), np.zeros((1, dims - dims // 2)))


def _lists(df: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    """Every row in its list, with its cell in the list."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[V.Chunk]:
        for batch in batches:
            for _, ids, x in V.matrices(batch, nonzero=True):
                if x.shape[1] in indexes:
                    index = indexes[x.shape[1]]
                    cell, width = assign(x, index), LIST * len(index[1])
                    yield cell // width, ids, x, (cell % width).astype(np.int32)

    return df.mapInArrow(lambda batches: V.slices(rows(batches)), V.SLICE)


def _sizes(stored: DataFrame, indexes: dict[int, Index]) -> dict[int, np.ndarray]:
    """The number of rows in each cell of each index."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = {d: np.zeros(len(a) * len(b), np.int64) for d, (a, b) in indexes.items()}
        for batch in batches:
            for d, place, more in zip(*(batch.column(n).to_pylist() for n in ("dims", "list", "more")), strict=True):
                sizes[d] += np.bincount(place * LIST * len(indexes[d][1]) + np.frombuffer(more, np.int32), minlength=len(sizes[d]))
        for d, n in sizes.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(at), d, np.int32)), pa.array(at), pa.array(n[at])], names=["dims", "cell", "n"])

    out = {d: np.zeros(len(a) * len(b), np.int64) for d, (a, b) in indexes.items()}
    counts = stored.select("dims", "list", "more").mapInArrow(count, "dims int, cell bigint, n bigint")
    for d, cell, n in counts.groupBy("dims", "cell").agg(F.sum("n")).collect():  # CELLS**2 rows an index
        out[d][cell] = n
    return out


def _takers(asked: DataFrame, indexes: dict[int, Index], sizes: dict[int, np.ndarray], share: float, k: int) -> DataFrame:
    """Every query in the lists of the cells that it takes, with a bit for each of their cells."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[V.Chunk]:
        for batch in batches:
            for place, ids, x in V.matrices(batch, nonzero=True):
                index, held = indexes[x.shape[1]], sizes[x.shape[1]]
                width = LIST * len(index[1])
                least = k + batch.column("copies").to_numpy()[place]  # so that k others are among them
                for i, q, n in zip(ids, x, least, strict=True):
                    cells = traverse(q, index, held, max(int(n), int(np.ceil(share * held.sum()))))
                    lists, at = np.unique(cells // width, return_inverse=True)
                    bits = np.zeros((len(lists), width), bool)
                    bits[at, cells % width] = True
                    yield lists, np.full(len(lists), i), np.repeat(q[None, :], len(lists), 0), np.packbits(bits, axis=1)

    asked = asked.repartition(max(1, -(-asked.count() // WALKS)))
    return asked.mapInArrow(lambda batches: V.slices(walk(batches)), V.SLICE)


def _reranker(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = V.Held(lambda q, v, s: V.best(q, v, s, k))

        def out() -> Iterator[pa.RecordBatch]:
            if (got := held.take()) is not None:
                yield pa.record_batch([pa.array(c) for c in got], names=["query_id", "vec_id", "score"])

        for v, x, cell, ids, q, bits in V.pairs(batches, np.int32, np.uint8):
            taken = np.unpackbits(bits, axis=1)[:, cell[:, 0]].astype(bool) & (ids[:, None] != v[None, :])
            rows, norm = (x * x).sum(1), (q * q).sum(1)
            d = np.where(taken, norm[:, None] + rows[None, :] - 2 * q @ x.T, np.inf)
            limit = np.partition(d, k - 1, axis=1)[:, k - 1] if len(v) > k else np.full(len(ids), np.inf)
            limit = limit + 1e-9 * (norm + rows.max())  # the products are rounded; the scores below are not
            i, j = np.nonzero(taken & ~(d > limit[:, None]))
            for a in range(0, len(i), 1 << 16):
                who, row = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
                held.add(ids[who], v[row], np.sqrt(((q[who] - x[row]) ** 2).sum(1)))
            if held.full():
                yield from out()
        yield from out()

    return search
