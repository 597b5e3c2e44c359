"""Vectors from Arrow lists, stored in slices; blocks of queries; and the join of every block with the slices it asks for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch

#: Bytes of vectors in a slice of a stored list or in a block of queries, and their number.
SLICE_BYTES, SLICE_ROWS = 1 << 19, 2048
#: Bytes of slices that a task fills side by side.
OPEN_BYTES = 1 << 25
#: Bytes of slices that meet the blocks of their list in one partition of the join.
PART_BYTES = 1 << 25
#: Rows that a task holds before it keeps only those that can still matter.
HELD = 1 << 17

#: A slice or block: n vectors of one list; `more` is whatever goes with each of them.
SLICE = "dims int, list int, n int, turn int, ids binary, xs binary, more binary"

Chunk = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # list, id, vector and more of each row


def matrices(batch: pa.RecordBatch | pa.Table, nonzero: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the batch, vec_ids, vectors as double) of each number of components; null, non-finite (and zero) vectors are left out."""
    ids, lists = batch.column("vec_id"), batch.column("embedding")
    if isinstance(lists, pa.ChunkedArray):
        ids, lists = ids.combine_chunks(), lists.combine_chunks()
    place = np.flatnonzero(np.asarray(lists.is_valid()) & np.asarray(ids.is_valid()))
    lists, ids = lists.take(pa.array(place)), ids.take(pa.array(place)).to_numpy(zero_copy_only=False)
    off = np.asarray(lists.offsets)
    flat = lists.values.cast(pa.float64())
    missing = np.asarray(flat.is_null())
    flat = np.where(missing, np.nan, flat.to_numpy(zero_copy_only=False))
    size = np.diff(off)
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        x = flat[off[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(1)
        if nonzero:
            good &= (x != 0).any(1)
        if good.any():
            yield place[rows[good]], ids[rows[good]], np.ascontiguousarray(x[good])


def usable(nonzero: bool = False) -> Column:
    """Whether a row's vector takes part, in SQL."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    ok = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite
    return ok & F.exists("embedding", lambda x: x != 0) if nonzero else ok


def queries(df: DataFrame, every: int, nonzero: bool = False) -> DataFrame:
    """The rows whose vec_id is divisible by `every`, once for each vec_id (of repeated ones, the smallest vector; copies: all of them)."""
    rows = df.where((F.col("vec_id") % every == 0) & usable(nonzero)).groupBy("vec_id")
    return rows.agg(F.min("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"))


def slices(chunks: Iterator[Chunk]) -> Iterator[pa.RecordBatch]:
    """Rows of SLICE, of bounded size however many rows a list has; a task holds OPEN_BYTES of them."""
    held: dict[tuple[int, int], list[tuple]] = {}
    size: dict[tuple[int, int], int] = {}
    task = TaskContext.get()
    turn = (task.partitionId() if task else 0) * 40503

    def out(key: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        nonlocal turn
        ids, x, more = (np.concatenate(c) for c in zip(*held.pop(key), strict=True))
        del size[key]
        step = min(SLICE_ROWS, max(1, SLICE_BYTES // (8 * key[0])))
        for a in range(0, len(ids), step):
            b = slice(a, a + step)
            row = [*key, len(ids[b]), turn % (1 << 31), ids[b].astype(np.int64).tobytes(), x[b].astype(np.float64).tobytes(), more[b].tobytes()]
            turn += 1
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row, [pa.int32()] * 4 + [pa.binary()] * 3, strict=True)], names=["dims", "list", "n", "turn", "ids", "xs", "more"])

    for lists, ids, x, more in chunks:
        order = np.argsort(lists, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1):
            if len(rows):
                key = (x.shape[1], int(lists[rows[0]]))
                held.setdefault(key, []).append((ids[rows], x[rows], more[rows]))
                size[key] = size.get(key, 0) + len(rows) * key[0] * 8
                if size[key] >= SLICE_BYTES:
                    yield from out(key)
        while sum(size.values()) > OPEN_BYTES:
            yield from out(max(size, key=size.get))
    for key in list(held):
        yield from out(key)


def meetings(stored: DataFrame, blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """Every slice of a list with every block of queries that asks for the list: columns of SLICE, and q_ids, q_xs, q_more.

    A list is dealt over as many partitions as its bytes need, and its blocks go to each of them, so that no partition grows
    with the longest list.
    """
    parts = F.greatest(F.ceil(F.sum(F.col("n").cast("bigint") * F.col("dims") * 8) / PART_BYTES), F.lit(1)).cast("int")
    parts = scratch.save(stored.groupBy("dims", "list").agg(parts.alias("parts")))  # a row for each list
    dealt = stored.join(parts, ["dims", "list"]).withColumn("part", F.pmod("turn", "parts"))
    asked = blocks.select("dims", "list", F.col("ids").alias("q_ids"), F.col("xs").alias("q_xs"), F.col("more").alias("q_more"))
    asked = asked.join(parts, ["dims", "list"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.drop("parts").join(asked.drop("parts"), ["dims", "list", "part"])


def pairs(batches: Iterator[pa.RecordBatch], row: np.dtype, query: np.dtype) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, vectors, more) of the slice and of the queries of each row of `meetings`; `row` and `query` are what `more` holds."""
    for batch in batches:
        for r in range(batch.num_rows):
            d = batch.column("dims")[r].as_py()
            got = []
            for names, kind in ((("ids", "xs", "more"), row), (("q_ids", "q_xs", "q_more"), query)):
                ids, x, more = (batch.column(n)[r].as_buffer() for n in names)
                ids = np.frombuffer(ids, np.int64)
                got += [ids, np.frombuffer(x, np.float64).reshape(len(ids), d), np.frombuffer(more, kind).reshape(len(ids), -1)]
            yield tuple(got)


class Held:
    """Columns that a task gathers; `keep` gives the indices of those rows that can still matter."""

    def __init__(self, keep: Callable[..., np.ndarray]):
        self.keep, self.parts, self.n = keep, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.n += len(columns[0])
        if self.n > HELD:
            self._cut()

    def _cut(self) -> None:
        columns = tuple(np.concatenate(c) for c in zip(*self.parts, strict=True))
        rows = self.keep(*columns)
        self.parts, self.n = [tuple(c[rows] for c in columns)], len(rows)

    def full(self) -> bool:
        return self.n > HELD // 2

    def take(self) -> tuple[np.ndarray, ...] | None:
        """All that is held, which is then forgotten."""
        if not self.parts:
            return None
        self._cut()
        out, self.parts, self.n = self.parts[0], [], 0
        return out


def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k first entries of each query by (score ascending, id)."""
    order = np.lexsort((ids, score, q))
    q = q[order]
    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate((start, [len(q)]))))
    return order[rank < k]


def ranked(hits: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """query_id, rank, vec_id, score of the k first hits of each query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
