"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over TRIGGER bytes cuts every text into phrases that begin and end with a trigger window, so the cuts depend
on content alone and the set of phrases is prefix-free. The distinct phrases are the dictionary; a text is its sequence of
phrases, the parse. A repeated string of `LENGTH` bytes is then a suffix of a dictionary phrase, followed by a stretch of
the parse, followed by a prefix of a phrase. Suffixes are compared through the dictionary and the parse, never byte by byte:

1. dictionary: which phrases occur more than once. A window over a phrase that occurs once can't repeat.
2. parse suffixes, cut where they reach LENGTH bytes, in the order of their fingerprints: neighbours that are equal are
   repeated strings of whole phrases, and every byte of them goes. The lowest group that has one is its owner.
3. the rest begins or ends inside a phrase: windows at the rims of step 2. The whole phrases inside them must occur in
   another rim window or in an owner's inner window, or they can't repeat.
4. the windows left, as (suffix of a phrase, parse suffix, prefix of a phrase), in the order of their fingerprints.

Only runs with a common prefix of LENGTH or more matter, so step 2 and 4 keep fingerprint order, not alphabetical order:
equal strings are neighbours in both. Each step is one round of `rounds.ask`, so a passage that a third of all documents
share costs one record per group of documents.

Defined cases: null or empty text has no bytes; a text shorter than LENGTH loses nothing; overlapping occurrences in one
document count; rows with the same doc_id are separate texts; matches never cross documents; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel as K, rounds as R

LENGTH = 400
TRIGGER = K.STEP  # bytes of a trigger window
TRIGGER_BITS = 5  # one window in 2**5 is a trigger

_SQL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, kept binary"
_NONE = np.zeros(0, K.U)


class Part:
    """One slice of texts: triggers and phrase keys."""

    def __init__(self, data: np.ndarray, cut: np.ndarray):
        self.data, self.cut, n = data, cut, len(data)
        h = K.eights(data) if n >= TRIGGER else _NONE
        self.span = K.Spans(h, n)
        if n < TRIGGER:
            self.at = self.doc = np.zeros(0, np.int64)
        else:
            at = np.flatnonzero((h * K.U(0x9E3779B97F4A7C15)) >> K.U(64 - TRIGGER_BITS) == 0)
            doc = K.owners(at, cut)
            ok = at + TRIGGER <= cut[doc + 1]
            self.at, self.doc = at[ok], doc[ok]
        self.end = self.at + TRIGGER
        m = max(0, len(self.at) - 1)
        self.whole = self.doc[:m] == self.doc[1:]
        self.key = self.span(self.at[:m], self.end[1:]) if m else _NONE

    def names(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and key of each parse suffix of repeated phrases, cut where it reaches LENGTH bytes."""
        if len(self.at) < 2:
            z = np.zeros(0, np.int64)
            return z, z, _NONE
        to = np.searchsorted(self.end, self.at + LENGTH)
        i = np.flatnonzero(to < len(self.at))
        i = i[to[i] > i]
        bad = np.concatenate(([0], np.cumsum(~repeated)))
        i = i[(self.doc[i] == self.doc[to[i]]) & (bad[to[i]] == bad[i])]
        a, b = self.at[i], self.end[to[i]]
        return a, b, self.span(a, b)

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Mask of the window starts over no phrase that occurs once."""
        n = len(self.data)
        fits = K.spread(self.cut[:-1], self.cut[1:] - LENGTH + 1, n)
        once = np.flatnonzero(self.whole & ~repeated)
        return fits & ~K.spread(self.end[once + 1] - LENGTH, self.at[once] + 1, n)

    def thin(self) -> np.ndarray:
        """Mask that holds all window starts without a whole phrase inside."""
        n = len(self.data)
        t = np.concatenate(([-1], self.at, [n, n]))
        return K.spread(t[:-2] + 1, t[2:] + TRIGGER - LENGTH, n)

    def rims(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For window starts: whether a whole phrase lies inside, the key of all of them, and the first one's trigger."""
        m = len(self.at)
        if m < 2:
            return np.zeros(len(start), bool), np.zeros(len(start), K.U), np.zeros(len(start), np.int64)
        i = np.searchsorted(self.at, start)
        j = np.searchsorted(self.end, start + LENGTH, "right") - 1  # the last trigger inside: in the same text, as windows are
        has = j > i
        i = np.minimum(i, m - 1)
        return has, self.span(self.at[i], np.where(has, self.end[j], self.end[i])), i


class Group:
    """The texts of a group, and what the rounds so far tell about them."""

    def __init__(self, rows: pa.Table, box: dict):
        data, off = K.as_bytes(rows["text"])
        self.parts = [Part(part, cut) for _, _, part, cut in K.slices(data, off)]
        self.box = box

    @staticmethod
    def join(arrays, none=_NONE) -> np.ndarray:
        return np.concatenate([none, *arrays])

    def split(self, mask: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
        return np.split(mask, np.cumsum(sizes)[:-1]) if sizes else []

    def phrases(self) -> np.ndarray:
        return self.join(p.key[p.whole] for p in self.parts)

    def parse(self) -> None:
        """Which phrases are repeated, from answer 1; the parse suffixes and their names."""
        sizes = [len(p.key) for p in self.parts]
        if R.FLAGS + 1 in self.box:
            mask = R.flagged(self.box[R.FLAGS + 1], sum(sizes))
        else:
            known, twice = K.unique_many(self.phrases())
            known = known[self.box.mask(1, known) | K.member(known, twice)]
            mask = K.member(self.join(p.key for p in self.parts), known)
        self.repeated = self.split(mask, sizes)
        self.named = [p.names(r) for p, r in zip(self.parts, self.repeated, strict=True)]
        self.flags = {R.FLAGS + 1: (R.flags(mask), None)}

    def windows(self) -> None:
        """Window starts by slice, from answers 2 and 3: mask of the inner ones, and starts of owned, rim and bare ones."""
        self.parse()
        sizes = [len(n[2]) for n in self.named]
        key = self.join(n[2] for n in self.named)
        if R.FLAGS + 2 in self.box:
            dup, own = (R.flagged(self.box[R.FLAGS + k], len(key)) for k in (2, 3))
        else:
            names, twice = K.unique_many(key)
            place = np.searchsorted(names, key)
            elsewhere = self.box.mask(2, names)[place]
            dup = elsewhere | K.member(key, twice)
            own = np.zeros(len(key), bool)
            own[np.unique(key, return_index=True)[1]] = True  # the first occurrence in the group
            own &= self.box.mask(3, names)[place] | (dup & ~elsewhere)
        self.flags |= {R.FLAGS + 2: (R.flags(dup), None), R.FLAGS + 3: (R.flags(own), None)}
        self.inner, self.owned, self.rim, self.bare = [], [], [], []
        for p, rep, (a, b, _), d, o in zip(self.parts, self.repeated, self.named, self.split(dup, sizes), self.split(own, sizes), strict=True):
            n = len(p.data)
            inner = K.spread(a[d], b[d] - LENGTH + 1, n)
            self.inner.append(inner)
            self.owned.append(np.flatnonzero(K.spread(a[o], b[o] - LENGTH + 1, n)))
            self.rim.append(np.flatnonzero(p.candidates(rep) & ~inner))
            self.bare.append(np.flatnonzero(p.thin() & inner))

    def cores(self) -> None:
        """Keys of the whole phrases inside owned and rim windows; which of them occur at two places of the group."""
        self.windows()
        self.owned_core = [p.rims(s) for p, s in zip(self.parts, self.owned, strict=True)]
        self.rim_core = [p.rims(s) for p, s in zip(self.parts, self.rim, strict=True)]
        places, first = [], 0
        for p, *cores in zip(self.parts, self.owned_core, self.rim_core, strict=True):
            at = np.concatenate([i[has] + first for has, _, i in cores])
            key = np.concatenate([key[has] for has, key, _ in cores])
            places.append(_distinct(key, at) if len(key) else key)
            first += len(p.at)
        self.known, self.twice = K.unique_many(self.join(places))
        self.rim_keys = np.unique(self.join(key[has] for has, key, _ in self.rim_core))

    def sent(self) -> list[np.ndarray]:
        """Window starts whose fingerprints are compared in the last round, from answers 1 to 4."""
        self.cores()
        if R.FLAGS + 4 in self.box:
            mask = R.flagged(self.box[R.FLAGS + 4], len(self.known))
        else:
            mask = self.box.mask(4, self.known) | K.member(self.known, self.twice)
        self.flags[R.FLAGS + 4] = R.flags(mask), None
        wanted = self.known[mask]
        out = []
        for p, owned, rim, bare, (has_o, key_o, _), (has_r, key_r, _) in zip(self.parts, self.owned, self.rim, self.bare, self.owned_core, self.rim_core, strict=True):
            bare = bare[~p.rims(bare)[0]]  # inner windows without a whole phrase are all sent
            out.append(np.concatenate((rim[~has_r | K.member(key_r, wanted)], owned[has_o & K.member(key_o, wanted)], bare)))
        return out


def _distinct(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The keys of the distinct pairs of key and place."""
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    return key[np.concatenate(([True], (key[1:] != key[:-1]) | (at[1:] != at[:-1])))]


def _send_phrases(rows: pa.Table, box: dict) -> R.Keys:
    return {1: (np.unique(Group(rows, box).phrases()), None)}


def _send_names(rows: pa.Table, box: dict) -> R.Keys:
    g = Group(rows, box)
    g.parse()
    return {2: (np.unique(g.join(n[2] for n in g.named)), None), **g.flags}


def _send_cores(rows: pa.Table, box: dict) -> R.Keys:
    g = Group(rows, box)
    g.cores()
    return {4: (g.known, K.member(g.known, g.rim_keys).astype(np.int64)), **g.flags}


def _send_windows(rows: pa.Table, box: dict) -> R.Keys:
    g = Group(rows, box)
    keys = [p.span(s, s + LENGTH) for p, s in zip(g.parts, g.sent(), strict=True)]
    return {5: (np.unique(g.join(keys)), None), **g.flags}


def _answer(kind, keys, senders, vals):
    if kind == 2:
        both = R.run_sizes(keys) > 1
        return {2: both, 3: both & (senders == R.run_min(keys, senders))}
    if kind == 4:
        return {4: (R.run_sizes(keys) > 1) & (R.run_min(keys, -vals) < 0)}
    return R.shared(kind, keys, senders, vals)


def _cut(rows: pa.Table, box: dict) -> pa.Table:
    g = Group(rows, box)
    sent = g.sent()
    keys = [p.span(s, s + LENGTH) for p, s in zip(g.parts, sent, strict=True)]
    known, twice = K.unique_many(g.join(keys))
    known = known[box.mask(5, known) | K.member(known, twice)]
    out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
    for p, s, key, inner in zip(g.parts, sent, keys, g.inner, strict=True):
        hit = np.concatenate((np.flatnonzero(inner), s[K.member(key, known)]))
        gone = K.spread(hit, hit + LENGTH, len(p.data))
        docs, n = len(p.cut) - 1, len(p.data)
        edge = np.zeros(n + 1, bool)
        edge[p.cut] = True
        begin = np.flatnonzero(gone & (np.concatenate(([True], ~gone[:-1])) | edge[:n]))
        end = np.flatnonzero(gone & (np.concatenate((~gone[1:], [True])) | edge[1:])) + 1
        place = np.concatenate(([0], np.cumsum(~gone)))[p.cut]
        text = p.data[~gone].tobytes()
        first = np.searchsorted(begin, p.cut)
        for i in range(docs):
            kept = text[place[i] : place[i + 1]]
            size = int(p.cut[i + 1] - p.cut[i])
            out["n_bytes"].append(size)
            out["n_removed"].append(size - len(kept))
            out["n_spans"].append(int(first[i + 1] - first[i]))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["spans"].append([{"start": int(x - p.cut[i]), "end": int(y - p.cut[i])} for x, y in zip(begin[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)])
            out["kept"].append(kept)
    kinds = {"kept_sha256": pa.string(), "kept": pa.binary(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
    return pa.table({"doc_id": rows["doc_id"].cast(pa.int64()), **{k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()}})


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and kept (bytes) of every row of docs (doc_id, text)."""
    groups = R.grouped(docs, F.col("text").cast("binary").alias("text"))
    got = R.ask(groups, None, _send_phrases, _answer, masks=True)
    for send in (_send_names, _send_cores, _send_windows):
        got = R.ask(groups, got, send, _answer, masks=True)
    return R.finish(groups, got, _cut, _SQL)
