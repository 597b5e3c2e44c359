"""Exact top-k by inner product, with a uniform threshold in three phases.

The components are split into LISTS lists; a vector's score is the sum of its partial scores in each. Rows are stored in
slices, and every block of queries meets every slice. Phase 1 gathers, for each query, the k best entries of each list and
the list's minimum, and resolves the scores of these entries alone; the k-th best of them is a safe cutoff. Phase 2 sends it
with the query: an entry whose partial scores all lie below an equal share of the cutoff (each measured from the list's
minimum) can't reach it and is never looked at again. Phase 3 resolves the others exactly and ranks them. Neither rows nor
queries nor cutoffs pass through the driver.

Components are turned into floor(scale * x), and all scores are integers. Defined cases: vectors that are null or hold a
null or non-finite component take no part; a query's own vec_id is never its candidate; of queries that repeat a vec_id, the
smallest vector is taken; vectors of another number of components are no candidates; rows that repeat a vec_id are
candidates of their own; ties go to the smaller vec_id; extra columns are ignored. Scores beyond 2**63 aren't supported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import vectors as V
from .scratch import Scratch

K = 10
LISTS = 2
SCALE = 1024
_HITS = "query_id bigint, vec_id bigint, score bigint"
_NONE = np.iinfo(np.int64).min  # the cutoff of a query with fewer than k candidates


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * x)


def _partials(q: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Partial scores (queries by rows) in each list, as exact integers."""
    cuts = np.linspace(0, q.shape[1], LISTS + 1).astype(int)
    bound = max(np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1], 1)
    if bound >= 1 << 53:
        q, x = q.astype(np.int64), x.astype(np.int64)
    return [(q[:, a:b] @ x[:, a:b].T).astype(np.int64) for a, b in zip(cuts, cuts[1:], strict=False)]


def exact_top_k(df: DataFrame, k: int = K, every: int = 100, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of df (vec_id, embedding), for the queries whose vec_id is divisible by `every`."""
    scratch = Scratch(df.sparkSession)
    df = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    asked = scratch.save(V.queries(df, every))
    stored = scratch.save(_slices(df, scale))
    first = V.meetings(stored, _slices(asked, scale), scratch).mapInArrow(_gather(k), "query_id bigint, list int, score bigint")
    cutoffs = _cutoffs(scratch.save(first), k)
    sent = asked.join(cutoffs, F.col("query_id") == F.col("vec_id"), "left").drop("query_id")
    return V.ranked(V.meetings(stored, _slices(sent, scale, ["cutoff", *_LOWS]), scratch).mapInArrow(_resolve(k), _HITS), k, F.desc("score"), "vec_id")


_LOWS = [f"low_{i}" for i in range(LISTS)]


def _slices(df: DataFrame, scale: int, more: list[str] = []) -> DataFrame:  # noqa: B006
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[V.Chunk]:
        for batch in batches:
            for place, ids, x in V.matrices(batch):
                extra = [batch.column(n).fill_null(_NONE).to_numpy(zero_copy_only=False)[place] for n in more]
                yield np.zeros(len(ids), np.int64), ids, _whole(x, scale), np.array(extra, np.int64).reshape(len(more), len(ids)).T

    return df.mapInArrow(lambda batches: V.slices(rows(batches)), V.SLICE)


def _gather(k: int):
    """Phase 1. Of each query: the scores of the best entries of the lists (list null), and the minimum of each list."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = V.Held(lambda q, s: V.best(q, s, -s, k))
        low = V.Held(lambda q, i, s: V.best(q * LISTS + i, s, s, 1))

        def out() -> Iterator[pa.RecordBatch]:
            if (got := top.take()) is not None:
                yield pa.record_batch([pa.array(got[0]), pa.nulls(len(got[0]), pa.int32()), pa.array(got[1])], names=["query_id", "list", "score"])
            if (got := low.take()) is not None:
                yield pa.record_batch([pa.array(got[0]), pa.array(got[1].astype(np.int32)), pa.array(got[2])], names=["query_id", "list", "score"])

        for v, x, _, ids, q, _ in V.pairs(batches, np.int64, np.int64):
            parts, own = _partials(q, x), ids[:, None] == v[None, :]
            best = []
            for i, p in enumerate(parts):
                low.add(ids, np.full(len(ids), i), p.min(1))
                best.append(np.argpartition(np.where(own, _NONE, p), max(0, len(v) - k), axis=1)[:, -k:])
            cols = np.concatenate(best, axis=1)
            pair = np.unique(np.repeat(np.arange(len(ids)), cols.shape[1]) * len(v) + cols.ravel())
            rows, cols = pair // len(v), pair % len(v)
            other = ~own[rows, cols]
            rows, cols = rows[other], cols[other]
            top.add(ids[rows], sum(p[rows, cols] for p in parts))
            if top.full() or low.full():
                yield from out()
        yield from out()

    return lists


def _cutoffs(gathered: DataFrame, k: int) -> DataFrame:
    """query_id, the k-th best score if there are k, and the minimum of each list."""
    best = V.ranked(gathered.where("list is null").withColumn("vec_id", F.lit(0)), k, F.desc("score"))
    best = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("cutoff"))
    lows = gathered.where("list is not null").groupBy("query_id").agg(*(F.min(F.when(F.col("list") == i, F.col("score"))).alias(n) for i, n in enumerate(_LOWS)))
    return lows.join(best, "query_id", "left")


def _resolve(k: int):
    """Phases 2 and 3."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = V.Held(lambda q, v, s: V.best(q, v, -s, k))

        def out() -> Iterator[pa.RecordBatch]:
            if (got := held.take()) is not None:
                yield pa.record_batch([pa.array(c) for c in got], names=["query_id", "vec_id", "score"])

        for v, x, _, ids, q, more in V.pairs(batches, np.int64, np.int64):
            cutoff, low = more[:, 0], more[:, 1:].T
            known = cutoff != _NONE
            share = np.where(known, cutoff - low.sum(0), 0)  # of all lists together, above their minima
            parts = _partials(q, x)
            passing = np.repeat(~known[:, None], len(v), 1)
            for p, lo in zip(parts, low, strict=True):
                passing |= LISTS * (p - lo[:, None]) >= share[:, None]
            at, col = np.nonzero(passing)
            score = sum(p[at, col] for p in parts)
            ok = (score >= cutoff[at]) & (ids[at] != v[col])
            held.add(ids[at[ok]], v[col[ok]], score[ok])
            if held.full():
                yield from out()
        yield from out()

    return resolve
