"""Runs of repeated words: every maximal stretch of a document whose words recur with some period.

A dictionary of basic factors names, for each power of two L, the factors of L words, so that equal names in a document mean
equal factors. Occurrences of a factor that follow each other within 2 * L form arithmetic progressions; from each place one
hop leads to the end of its progression, and the distances before each hop are the proposed periods. (The next occurrence
alone is not enough: in `abababa abababa` every factor of 4 recurs before the period of 7 is over.) Proposals of one period
that overlap are one stretch; it is extended both ways by comparing names of ever smaller factors, and stretches that several
lengths have found count once, with their smallest period.

Factors that don't recur in their document are left out from each level on, so the levels end soon in ordinary text; a
document costs O(n log n) at most, and all documents of a slice are worked on at once. A run never crosses documents.

Words are runs of bytes other than white space, compared by their 64-bit content hash.

Defined cases: a null, empty or blank text has no words and no runs; a null or repeated doc_id is kept; an empty table gives
none; only the columns named here are returned, whatever else the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel as K

#: Words that a run has at least.
MIN_LENGTH = 12
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, n_removed bigint, kept string"


def _level(key: np.ndarray, place: np.ndarray, n: int, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the factors at each of n places, and the places of those that recur, by name and place, with their names."""
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    again = ~(new & np.concatenate((new[1:], [True])))
    label = np.cumsum(new)[again]
    name = spare.copy()
    name[place[again]] = label
    return name, place[again], label


def _proposals(at: np.ndarray, label: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) from places in the order of (label, place): distances up to 2 * size, one for each progression."""
    m = len(at)
    gap = np.zeros(m, np.int64)
    gap[:-1] = np.where((label[1:] == label[:-1]) & (at[1:] - at[:-1] <= 2 * size), at[1:] - at[:-1], 0)
    change = np.flatnonzero(gap[1:] != gap[:-1])  # last index of each run of equal gaps, but the final one
    last = np.append(change, m - 1)[np.searchsorted(change, np.arange(m))]
    end = np.where(gap > 0, np.minimum(last + 1, m - 1), np.arange(m))
    here, found = np.flatnonzero(gap > 0), []
    hop = here
    while len(here):
        reach = at[hop + 1] - at[here]
        ok = reach <= 2 * size
        here, hop = here[ok], hop[ok]
        found.append((at[here], reach[ok]))
        hop = end[hop]
        on = gap[hop] > 0
        here, hop = here[on], hop[on]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _extended(names: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, period: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [lo, hi) grown as far as words that are a period apart are equal."""
    top = len(names) - 1
    lo, hi = lo.copy(), hi.copy()
    for k in range(top, -1, -1):
        name, size = names[k], 1 << k
        live = np.arange(len(lo))
        while len(live):  # one step at the most on each level but the highest
            b = hi[live]
            ok = b + size <= n
            ok[ok] = name[(b - period[live])[ok]] == name[b[ok]]
            live = live[ok]
            hi[live] += size
        live = np.arange(len(lo))
        while len(live):
            a = lo[live] - size
            ok = a >= 0
            ok[ok] = name[a[ok]] == name[(a + period[live])[ok]]
            live = live[ok]
            lo[live] -= size
    return lo, hi


def find_runs(words: np.ndarray, first: np.ndarray, least: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of every run of `least` words or more and two periods or more, in that order.

    words: the words' values; first[d]: where document d begins, and the end of the last one.
    """
    docs, m = len(first) - 1, len(words)
    if not m:
        return (np.zeros(0, np.int64),) * 4
    doc = np.repeat(np.arange(docs), np.diff(first))
    n = m + docs  # after each document stands a word like no other
    place = np.arange(m) + doc
    spare = np.arange(n) + n  # names of what does not recur
    value = words.astype(np.uint64) ^ K.mix(doc.astype(np.uint64) + K.U(1))
    name, at, label = _level(value, place, n, spare)
    names, size, found = [name], 1, []
    while len(at):
        if 3 * (2 * size) > least:  # shorter factors propose nothing that these don't
            i, d = _proposals(at, label, size)
            if len(i):
                order = np.lexsort((i, d))
                i, d = i[order], d[order]
                new = np.concatenate(([True], (d[1:] != d[:-1]) | (i[1:] - i[:-1] > size)))
                lo, period = i[new], d[new]
                hi = i[np.append(np.flatnonzero(new)[1:] - 1, len(i) - 1)] + period + size
                lo, hi = _extended(names, lo, hi, period, n)
                long = hi - lo >= np.maximum(least, 2 * period)
                found.append(np.stack((lo[long], hi[long], period[long])))
        on = np.zeros(n, bool)
        on[at] = True
        at = np.flatnonzero(on)
        at = at[at + size < n]
        at = at[on[at + size]]
        if len(at):
            name, at, label = _level(name[at] * np.int64(2 * n) + name[at + size], at, n, spare)
            names.append(name)
            size *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 4
    lo, hi, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, hi, lo))
    lo, hi, period = lo[order], hi[order], period[order]
    if len(lo):
        one = np.concatenate(([True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
        lo, hi, period = lo[one], hi[one], period[one]
    order = np.lexsort((period, lo))
    lo, hi, period = lo[order], hi[order], period[order]
    which = np.searchsorted(first[1:] + np.arange(1, docs + 1), lo, "right")  # where documents end with the words after them
    return which, lo - which - first[which], hi - lo, period


def _joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the documents' words, joined by one space."""
    if not len(start):
        return np.zeros(0, np.uint8), np.zeros(docs + 1, np.int64)
    size = end - start + 1  # each with a space after it
    ends = np.cumsum(size)
    begin = ends - size
    out = raw[np.minimum(np.repeat(start - begin, size) + np.arange(ends[-1]), len(raw) - 1)]
    out[ends - 1] = 32
    count = np.bincount(doc, minlength=docs)
    last = np.cumsum(count)
    full = np.where(last > 0, ends[np.maximum(last, 1) - 1], 0)
    keep = np.ones(len(out), bool)
    keep[full[count > 0] - 1] = False  # none after the last word
    return out[keep], np.concatenate(([0], full - np.cumsum(count > 0)))


def periodic_runs(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), n_removed and kept of docs (doc_id, text).

    kept is the text, its words joined by one space, without the words that a run has after its first period.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.as_bytes(batch.column("text"))
            for a, b, part, cut in K.slices(data, off):
                w = K.words(part, cut)
                which, start, length, period = find_runs(w.hash, w.first, least)
                at = w.first[which] + start
                gone = K.spread(at + period, at + length, len(w.start))
                text, ends = _joined(part, w.start[~gone], w.end[~gone], w.doc[~gone], b - a)
                offsets = np.searchsorted(which, np.arange(b - a + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(_RUN)))
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))]).cast(pa.binary()).cast(pa.string())
                removed = np.bincount(w.doc[gone], minlength=b - a)
                yield pa.record_batch([batch.column("doc_id")[a:b], pa.array(np.diff(w.first)), runs, pa.array(removed), kept], names=["doc_id", "n_words", "runs", "n_removed", "kept"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(work, SCHEMA)
