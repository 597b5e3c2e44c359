"""Rounds of questions between groups of documents.

Documents are hashed by doc_id into groups (one text exchange, which later rounds of the same plan reuse). In a round each
group sends the *distinct* keys that it holds to the partition of the key's range, and gets back those of them that matter
(say, that another group holds as well). A key held by a third of all documents costs at most one record per group, so no
partition grows with the number of its holders; nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .kernel import U, pack, release, unpack

#: Groups for each shuffle partition. Mail goes to the hall of a partition's groups in one row, so the rows of a round
#: are partitions squared at most; the groups of a hall are worked on one after the other, to bound memory.
GROUPS_PER_HALL = 4

#: key messages of a group: kind -> (sorted distinct keys, a value for each or None)
Keys = dict[int, tuple[np.ndarray, np.ndarray | None]]
#: a section of a row of mail: group, kind, keys, values; in an answer by masks, the values are the bucket alone
Section = tuple[int, int, np.ndarray, np.ndarray | None]


class Box(dict):
    """What a group got: kind -> sorted keys, or the flags that it kept; masks for answers that are given by mask."""

    def __init__(self, bits: int):
        super().__init__()
        self.bits = bits
        self.masks: dict[int, dict[int, np.ndarray]] = {}

    def mask(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Which of the sorted keys that the group had sent were answered."""
        out = np.zeros(len(keys), bool)
        at = _bounds(keys, self.bits)
        for b, values in self.masks.get(kind, {}).items():
            out[at[b] : at[b + 1]] = flagged(values, at[b + 1] - at[b])
        return out


def _bounds(keys: np.ndarray, bits: int) -> list[int]:
    """Where the sorted keys of each bucket (their first bits) begin."""
    edges = np.arange(1, 1 << bits, dtype=U) << U(64 - bits)
    return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]


def _bits(df: DataFrame) -> int:
    return max(3, int(partitions(df) - 1).bit_length())


#: Kinds from here on are flags that a group keeps for itself: they come back in their order.
FLAGS = 200

_MAIL = "to int, g array<int>, kind array<int>, keys array<binary>, vals array<binary>"
_MAIL_ARROW = pa.schema([("to", pa.int32()), ("g", pa.list_(pa.int32())), ("kind", pa.list_(pa.int32())), ("keys", pa.list_(pa.binary())), ("vals", pa.list_(pa.binary()))])


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def grouped(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, the columns, the group _g of each row and the hall of the group."""
    n = GROUPS_PER_HALL * partitions(docs)
    docs = docs.select("doc_id", *columns, F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("_g"))
    return docs.withColumn("hall", F.floor(F.col("_g") / GROUPS_PER_HALL).cast("int"))


def _mail(letters: dict[int, list[Section]]) -> pa.Table:
    """A row for each addressee."""
    rows: dict[str, list] = {n: [] for n in _MAIL_ARROW.names}
    for to, sections in letters.items():
        rows["to"].append(to)
        rows["g"].append([g for g, *_ in sections])
        rows["kind"].append([kind for _, kind, *_ in sections])
        rows["keys"].append([pack(keys) for _, _, keys, _ in sections])
        rows["vals"].append([None if vals is None else pack(vals) for *_, vals in sections])
    return pa.table(rows, schema=_MAIL_ARROW)


def _open(mail: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
    for row in zip(*(mail.column(n).to_pylist() for n in _MAIL_ARROW.names[1:]), strict=True):
        for g, kind, keys, vals in zip(*row, strict=True):
            yield g, kind, unpack(keys), None if vals is None else unpack(vals, np.int64)


def _visit(rows: pa.Table, mail: pa.Table | None, bits: int) -> Iterator[tuple[int, pa.Table, Box]]:
    """(group, its rows, its box), one group of a hall after the other."""
    if not len(rows):
        return
    letters: dict[int, dict[int, list[np.ndarray]]] = {}
    boxes: dict[int, Box] = {}
    for g, kind, keys, vals in _open(mail) if mail is not None else ():
        if vals is None:
            letters.setdefault(g, {}).setdefault(kind, []).append(keys)
        else:
            boxes.setdefault(g, Box(bits)).masks.setdefault(kind, {})[int(vals[0])] = keys
    groups = rows["_g"].to_numpy()
    for g in np.unique(groups).tolist():
        box = boxes.pop(g, Box(bits))
        box |= {k: np.concatenate(v) if k >= FLAGS else np.sort(np.concatenate(v)) for k, v in letters.pop(g, {}).items()}
        own = rows.filter(pa.array(groups == g))
        # a shuffle may be read in any order: flags over places need one order in every round
        yield g, own.take(pc.sort_indices(own, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])), box
        del own
        release()


def ask(groups: DataFrame, got: DataFrame | None, send: Callable[[pa.Table, Box], Keys], answer: Callable[[int, np.ndarray, np.ndarray, np.ndarray | None], dict[int, np.ndarray]], masks: bool = False) -> DataFrame:
    """One round. send(rows of a group, its box) gives the group's keys; kinds of 100 or more come back to it as they are.

    answer(kind, keys, senders, vals), keys being sorted, gives for each kind of answer a mask of the records answered. They
    come back as keys, or as masks over the keys sent (one bit a key) for a group that makes its keys anew.
    Returns the mail for the next round.
    """
    bits = _bits(groups)

    def collect(rows: pa.Table, mail: pa.Table | None) -> pa.Table:
        letters: dict[int, list[Section]] = {}
        for g, own, box in _visit(rows, mail, bits):
            for kind, (keys, vals) in send(own, box).items():
                if kind >= 100:
                    letters.setdefault(g % (1 << bits), []).append((g, kind, keys, None))
                    continue
                at = _bounds(keys, bits)
                for b in range(1 << bits):
                    if at[b + 1] > at[b]:
                        part = slice(at[b], at[b + 1])
                        letters.setdefault(b, []).append((g, kind, keys[part], None if vals is None else vals[part]))
        return _mail(letters)

    if got is None:
        sent = groups.groupBy("hall").applyInArrow(lambda rows: collect(rows, None), _MAIL)
    else:
        sent = groups.groupBy("hall").cogroup(got.groupBy("to")).applyInArrow(collect, _MAIL)

    def reply(mail: pa.Table) -> pa.Table:
        """One bucket: the buckets of a partition are answered one after the other, to bound memory."""
        held: dict[int, list[tuple[int, np.ndarray, np.ndarray | None]]] = {}
        letters: dict[int, list[Section]] = {}
        for g, kind, keys, vals in _open(mail):
            if kind >= 100:
                letters.setdefault(g // GROUPS_PER_HALL, []).append((g, kind, keys, None))
            else:
                held.setdefault(kind, []).append((g, keys, vals))
        for kind in list(held):
            parts = held.pop(kind)
            ends = np.cumsum([len(k) for _, k, _ in parts]).tolist()
            keys = np.concatenate([k for _, k, _ in parts])
            senders = np.repeat(np.array([g for g, _, _ in parts], np.int32), [len(k) for _, k, _ in parts])
            vals = None if parts[0][2] is None else np.concatenate([v for *_, v in parts])
            names = [(g, int(k[0] >> U(64 - bits))) for g, k, _ in parts]
            del parts
            order = np.argsort(keys, kind="stable")
            keys, senders, vals = keys[order], senders[order], None if vals is None else vals[order]
            for as_kind, mask in answer(kind, keys, senders, vals).items():
                if masks:
                    back = np.zeros(len(mask), bool)
                    back[order] = mask
                    for (g, b), start, end in zip(names, [0, *ends], ends, strict=False):
                        if back[start:end].any():
                            letters.setdefault(g // GROUPS_PER_HALL, []).append((g, as_kind, flags(back[start:end]), np.array([b])))
                    continue
                if not mask.any():
                    continue
                k, s = keys[mask], senders[mask]
                by = np.argsort(s, kind="stable")  # keys stay sorted within a sender
                k, s = k[by], s[by]
                at = firsts(s)
                for a, b in zip(at, [*at[1:], len(s)], strict=True):
                    letters.setdefault(int(s[a]) // GROUPS_PER_HALL, []).append((int(s[a]), as_kind, k[a:b], None))
            del keys, senders, vals, order
            release()
        return _mail(letters)

    return sent.groupBy("to").applyInArrow(reply, _MAIL)


def flags(mask: np.ndarray) -> np.ndarray:
    """A mask as 64-bit values, to be kept under a kind of FLAGS or more."""
    return np.packbits(np.concatenate((mask, np.zeros(-len(mask) % 64, bool)))).view(U)


def flagged(values: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8))[:n].astype(bool)


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def run_sizes(keys: np.ndarray) -> np.ndarray:
    """For each record, how many records have its key."""
    at = firsts(keys)
    n = np.diff(np.concatenate((at, [len(keys)])))
    return np.repeat(n, n)


def run_min(keys: np.ndarray, vals: np.ndarray) -> np.ndarray:
    """For each record, the smallest value of its key."""
    if not len(keys):
        return vals
    at = firsts(keys)
    return np.repeat(np.minimum.reduceat(vals, at), np.diff(np.concatenate((at, [len(keys)]))))


def shared(kind: int, keys: np.ndarray, senders: np.ndarray, vals: np.ndarray | None) -> dict[int, np.ndarray]:
    """Answers a key that two or more groups have sent to all of them."""
    return {kind: run_sizes(keys) > 1}


def finish(groups: DataFrame, got: DataFrame, last: Callable[[pa.Table, Box], pa.Table], schema: str) -> DataFrame:
    """last(rows of a group, its box) makes the result rows."""
    bits = _bits(groups)

    def work(rows: pa.Table, mail: pa.Table) -> pa.Table:
        made = [last(own, box) for _, own, box in _visit(rows, mail, bits)]
        return pa.concat_tables(made) if made else last(rows, Box(bits))

    return groups.groupBy("hall").cogroup(got.groupBy("to")).applyInArrow(work, schema)
