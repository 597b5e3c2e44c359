"""Substring dedup by difference-cover anchors.

A window is `WINDOW` consecutive words. Anchors of ANCHOR words are hashed only at word positions whose place modulo PERIOD
lies in the difference cover COVER: for any two positions i and j there is a shift below PERIOD that brings both into the
cover, so two equal windows always share an anchor at the same place inside them. Round 1 finds the anchors that two
documents share. Round 2 extends them: only the windows around a shared anchor are hashed in full and compared, by the
smallest doc_id that holds each. What is left over is exact: a word goes if and only if it lies in a window whose word
sequence also starts in a document with a smaller doc_id.

Defined cases: null or empty text has no words; a text of fewer words than a window loses nothing; within one document a
repeated window removes nothing; rows with the same doc_id are separate documents neither of which is smaller; a null
doc_id counts as larger than any other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel as K, rounds as R

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)  # differences 0..6 modulo 7 all occur
ANCHOR = WINDOW - PERIOD + 1

_SQL = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _anchors(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the anchors that lie in documents with a window, and their hashes."""
    h = K.runs(w.hash, ANCHOR)
    at = np.arange(len(h))
    doc = w.doc[: len(h)]
    size = np.diff(w.first)
    ok = _IN_COVER[(at - w.first[doc]) % PERIOD] & (w.doc[ANCHOR - 1 :] == doc) & (size[doc] >= WINDOW) if len(h) else np.zeros(0, bool)
    at = at[ok]
    return at, h[at]


def _held_twice(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Sorted keys that more than one document holds."""
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], doc[order]
    change = (k[1:] == k[:-1]) & (d[1:] != d[:-1])
    return np.unique(k[1:][change])


def _each(rows: pa.Table):
    """Slices of a group: first row, doc_ids, words."""
    data, off = K.as_bytes(rows["text"])
    ids = K.ints(rows["doc_id"])
    for a, b, part, cut in K.slices(data, off):
        yield a, ids[a:b], part, cut, K.words(part, cut)


def _send_anchors(rows: pa.Table, _: dict) -> R.Keys:
    keys = [np.zeros(0, K.U), *(_anchors(w)[1] for *_, w in _each(rows))]
    return {1: (np.unique(np.concatenate(keys)), None)}


def _full(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every full window and whether it lies in one document."""
    h = K.runs(w.hash, WINDOW)
    return h, (w.doc[: len(h)] == w.doc[WINDOW - 1 :]) if len(h) else np.zeros(0, bool)


def _send_windows(rows: pa.Table, box: dict) -> R.Keys:
    known = box.get(1, np.zeros(0, K.U))
    all_keys, all_docs = [np.zeros(0, K.U)], [np.zeros(0, np.int64)]
    for a, ids, _, _, w in _each(rows):
        at, h = _anchors(w)
        all_keys.append(h)
        all_docs.append(a + w.doc[at])
    known = np.union1d(known, _held_twice(np.concatenate(all_keys), np.concatenate(all_docs)))
    keys, docs = [np.zeros(0, K.U)], [np.zeros(0, np.int64)]
    for a, ids, _, _, w in _each(rows):
        at, h = _anchors(w)
        hit = at[K.member(h, known)]
        full, ok = _full(w)
        near = K.spread(np.maximum(hit - PERIOD + 1, 0), hit + 1, len(full)) & ok
        keys.append(full[near])
        docs.append(ids[w.doc[: len(full)][near]])
    k, d = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((d, k))
    k, d = k[order], d[order]
    at = R.firsts(k)
    return {2: (k[at], d[at])}


def _smaller_elsewhere(kind, keys, senders, vals):
    return {2: vals > R.run_min(keys, vals)}


def _cut(rows: pa.Table, box: dict) -> pa.Table:
    gone_keys = box.get(2, np.zeros(0, K.U))
    parts = list(_each(rows))
    k = np.concatenate([np.zeros(0, K.U), *(_full(w)[0] for *_, w in parts)])
    d = np.concatenate([np.zeros(0, np.int64), *(ids[w.doc[: max(0, len(w.doc) - WINDOW + 1)]] for _, ids, _, _, w in parts)])
    ok = np.concatenate([np.zeros(0, bool), *(_full(w)[1] for *_, w in parts)])
    order = np.argsort(k, kind="stable")
    order = order[ok[order]]
    low = np.zeros(len(k), bool)
    low[order] = d[order] > R.run_min(k[order], d[order])
    low |= ok & K.member(k, gone_keys)
    out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
    at = 0
    for _, ids, part, cut, w in parts:
        m = max(0, len(w.doc) - WINDOW + 1)
        hit = np.flatnonzero(low[at : at + m])
        at += m
        gone = K.spread(hit, hit + WINDOW, len(w.doc))
        keep = ~gone
        begin, end = w.start[keep], w.end[keep]
        last = np.minimum(end + 1, cut[w.doc[keep] + 1])  # with the space byte that follows, if any
        mask = K.spread(begin, last, len(part))
        text = part.copy()
        text[end[end < last]] = 0x20
        place = np.concatenate(([0], np.cumsum(mask)))[cut]
        text = text[mask].tobytes()
        removed = np.bincount(w.doc[gone], minlength=len(ids))
        for i in range(len(ids)):
            kept = text[place[i] : place[i + 1]].removesuffix(b" ")
            out["n_words"].append(int(w.first[i + 1] - w.first[i]))
            out["n_removed"].append(int(removed[i]))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
    kept = pa.array(out.pop("kept"), pa.binary())
    others = {c: rows[c] for c in rows.column_names if c.startswith("keep_")}
    return pa.table({"doc_id": rows["doc_id"].cast(pa.int64()), **{k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()}, "kept": kept.cast(pa.string()), **others})


def substring_dedup(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the kept words joined by one space) and the columns named in keep, of
    every row of docs (doc_id, text)."""
    groups = R.grouped(docs, F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep if c != "text"))

    def last(rows: pa.Table, box: dict) -> pa.Table:
        made = _cut(rows, box)
        return made.append_column("keep_text", rows["text"]) if "text" in keep else made

    got = R.ask(groups, None, _send_anchors, R.shared)
    got = R.ask(groups, got, _send_windows, _smaller_elsewhere)
    order = [c for c in keep if c != "text"] + ["text"] * ("text" in keep)
    kept = "".join(f", `keep_{c}` {'string' if c == 'text' else docs.schema[c].dataType.simpleString()}" for c in order)
    return R.finish(groups, got, last, _SQL + kept).withColumnsRenamed({f"keep_{c}": c for c in keep})
