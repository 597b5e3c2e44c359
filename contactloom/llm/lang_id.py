"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of its labelled text. A text is parsed against each automaton
into phrases, each the longest match that the automaton holds; a language's text needs few phrases. The language with the
fewest phrases, normalised by the size of its sample (phrases * log2(sample) / length), wins. All texts of a slice advance
together, one byte a step, through dense transition tables; texts longer than LANE are parsed by themselves. Every language
with a labelled text is learned; languages are scored LANGUAGES at a time, so that many of them cost more passes, not memory.

Bytes are folded to symbols: A-Z to a-z, every other ASCII byte to one blank, bytes beyond ASCII as they are if a sample
has them.

Defined cases: null texts and texts without a letter are `und`, score 0; extra columns are ignored; rows with the same
doc_id are separate texts; a table without labelled rows yields `und` for all; ties go to the language first by name.
The labelled sample that automata are made of is bounded, by DOCS rows a language, TAKE characters of a row (rows that are
shorter are preferred, so that they are taken whole) and SAMPLE bytes a language. Everything else covers all rows and whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel as K

LANGUAGES = 8  # scored in one pass
DOCS = 128
TAKE = 2000
SAMPLE = 40_000
LANE = 1 << 13
FOLDS, HELD = 3, 1
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")

#: byte -> symbol before the samples are known: 0 blank, 1..26 letters, then bytes beyond ASCII
FOLD = np.zeros(256, np.uint8)
FOLD[65:91] = FOLD[97:123] = np.arange(1, 27)
FOLD[128:] = np.arange(27, 155)


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a sequence: state x symbol -> state, -1 for none; state 0 is the start."""
    size = 2 * len(symbols) + 2
    step = np.full((size, width), -1, np.int32)
    length, link, n, last = [0], [-1], 1, 0
    moves: list[dict[int, int]] = [{}]
    for c in symbols:
        cur = n
        n += 1
        length.append(length[last] + 1)
        link.append(0)
        moves.append({})
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = n
                n += 1
                length.append(length[p] + 1)
                link.append(link[q])
                moves.append(dict(moves[q]))
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    for s, m in enumerate(moves):
        for c, t in m.items():
            step[s, c] = t
    return step[:n]


class Model:
    """Automata of all languages over shared symbols."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        seen = sorted({int(s) for t in samples.values() for s in np.unique(FOLD[np.frombuffer(t, np.uint8)])} | {0})
        self.width = len(seen) + 1  # and one symbol that no sample has
        number = np.full(256, len(seen), np.uint8)
        number[seen] = np.arange(len(seen))
        self.symbol = number[FOLD]
        tables, firsts, self.cost, size = [], [], [], 0
        for name in self.names:
            text = self.symbol[np.frombuffer(samples[name], np.uint8)]
            table = automaton(text.tolist(), self.width)
            outside = np.full((1, self.width), -1, np.int32)  # the state before a text, and after a symbol that the sample lacks
            table = np.concatenate((table, outside)).ravel()
            tables.append(np.where(table < 0, -1, table * self.width + size).astype(np.int32))  # a state is where its row begins
            size += len(table)
            firsts.append(np.where(tables[-1][: self.width] < 0, size - self.width, tables[-1][: self.width]))
            self.cost.append(np.log2(max(2, len(text))))
        self.step, self.first = np.concatenate(tables), np.array(firsts, np.int32)
        self.outside = np.cumsum([len(t) for t in tables]).astype(np.int32) - self.width

    def phrases(self, data: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Phrases of each text against each language."""
        size = np.diff(cut)
        text = self.symbol[data]
        count = np.zeros((len(self.names), len(size)), np.int64)
        order = np.argsort(-size, kind="stable")  # lanes that end first are last
        order = order[np.searchsorted(-size[order], -LANE) :]
        at, n = cut[:-1][order], size[order]
        state = self.outside[:, None].repeat(len(order), axis=1)
        found = np.zeros((len(self.names), len(order)), np.int64)
        steps = int(n[0]) if len(n) else 0
        lanes = np.searchsorted(-n, -np.arange(steps), "left").tolist()  # lanes longer than each step
        for step, m in enumerate(lanes):
            c = text[at[:m] + step].astype(np.int32)
            to = self.step[state[:, :m] + c]
            i, stop = np.nonzero(to < 0)
            if len(i):
                found[i, stop] += 1
                to[i, stop] = self.first[i, c[stop]]  # a new phrase; a symbol that the sample lacks is one by itself
            state[:, :m] = to
        count[:, order] = found
        table = memoryview(self.step)
        for d in np.flatnonzero(size > LANE).tolist():
            symbols = text[cut[d] : cut[d + 1]].tolist()
            for i, now in enumerate(self.outside.tolist()):
                first, phrases = self.first[i].tolist(), 0
                for c in symbols:
                    now = table[now + c]
                    if now < 0:
                        phrases += 1
                        now = first[c]
                count[i, d] = phrases
        return count

    def entropy(self, data: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Bits a byte, languages by texts."""
        return self.phrases(data, cut) * np.array(self.cost)[:, None] / np.maximum(np.diff(cut), 1)


def learn(docs: DataFrame) -> list[Model]:
    """Models from labelled documents that aren't held out, LANGUAGES languages each: for each language one document in each of
    DOCS ranges of hashes, so the choice is spread over the whole table and costs one pass of partial minima; of documents with
    one hash, as of repeated rows, the smallest text is taken."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    h = F.xxhash64("doc_id")
    pick = F.min(F.struct((F.length("text") > TAKE).alias("long"), h.alias("h"), F.substring("text", 1, TAKE).alias("text")))
    rows = labelled.groupBy("lang", F.pmod(h, F.lit(DOCS)).alias("range")).agg(pick.alias("p")).select("lang", "p.h", "p.text")
    samples: dict[str, bytes] = {}
    for lang, _, text in rows.orderBy("lang", "h").toLocalIterator():  # DOCS texts of TAKE characters a language at most
        have = samples.get(lang, b"")
        samples[lang] = (have + b"\n" + text.encode())[:SAMPLE]
    names = sorted(samples)
    return [Model({n: samples[n] for n in names[i : i + LANGUAGES]}) for i in range(0, len(names), LANGUAGES)]


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    predicted = predict(docs.select("doc_id", "text"), learn(docs))
    return predicted.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def predict(docs: DataFrame, models: list[Model], *keep: str) -> DataFrame:
    """doc_id, the kept columns, lang_pred, score and lettered (the text has a letter) from doc_id and text alone. The score is
    how much sooner the winner explains the text than the next language does, 1 - best / second (1 if there is one language)."""
    names = ["doc_id", "text", *(c for c in keep if c != "text")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + ", _best double, _second double, _name string, _lettered boolean"
    found = docs.select(*names, F.lit(None).cast("double").alias("_best"), F.lit(None).cast("double").alias("_second"), F.lit(None).cast("string").alias("_name"), F.lit(None).cast("boolean").alias("_lettered"))
    for model in models or [None]:
        found = found.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), len(names)), schema)
    known = F.coalesce("_lettered", F.lit(False)) & F.col("_name").isNotNull()
    score = F.when(F.col("_second").isNull() | (F.col("_second") == 0), 1.0).otherwise(1 - F.col("_best") / F.col("_second"))
    return found.select("doc_id", *keep, F.when(known, F.col("_name")).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, score).otherwise(0.0).alias("score"), F.col("_lettered").alias("lettered"))


def _scorer(sent, n: int):
    """Updates the two lowest entropies of each text, and the language of the lowest, by the languages of one model. The first
    n columns stay."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            data, off = K.as_bytes(batch.column("text"))
            best, second = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("_best", "_second"))
            name, lettered = batch.column("_name").to_pylist(), batch.column("_lettered").to_pylist()
            for a, b, part, cut in K.slices(data, off, 16 * K.SLICE_BYTES):
                raw = part.tobytes()
                for i in range(a, b):
                    if lettered[i] is None:
                        lettered[i] = bool(_LETTER.search(raw[cut[i - a] : cut[i - a + 1]].decode("utf-8", "replace")))
                if not model:
                    continue
                bits = model.entropy(part, cut)
                low = bits.argmin(0)
                for i, (l, own) in enumerate(zip(low.tolist(), np.sort(bits, axis=0)[:2].T.tolist(), strict=True), a):
                    lowest = sorted([*own, *(x for x in (best[i], second[i]) if x == x)])
                    if not best[i] <= own[0]:  # nan, or higher; names rise from model to model
                        name[i] = model.names[l]
                    best[i] = lowest[0]
                    second[i] = lowest[1] if len(lowest) > 1 else np.nan
            made = [pa.array(best, pa.float64(), from_pandas=True), pa.array(second, pa.float64(), from_pandas=True), pa.array(name, pa.string()), pa.array(lettered, pa.bool_())]
            yield pa.record_batch([*batch.columns[:n], *made], names=batch.schema.names)
        K.release()

    return score
