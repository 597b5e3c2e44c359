"""Conversation repair, periodic runs and byte-level BPE against brute force and the tokenizer library."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from contactloom import ship
from contactloom.llm import bpe, conversations as C, periodic as P
from contactloom.llm.entries import QUERIES, planted

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# conversations

FINAL = re.compile("(s?(ua)+)?")


def least(rows):
    """(cost, audit, turns) by the cheapest way over prefixes: state -> (cost, audit, turns)."""
    best = {"": (0, "", ())}

    def states(b):  # with turns inserted
        for _ in range(3):
            for s, (cost, audit, turns) in list(b.items()):
                for role in ("user", "assistant"):
                    t = step(s, role[0])
                    new = (cost + 5, audit + "I", (*turns, (role, "")))
                    if t is not None and (t not in b or new[:2] < b[t][:2]):
                        b[t] = new
        return b

    def step(s, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((s, initial))

    for role, text, fault in rows:
        after = {}
        for s, (cost, audit, turns) in states(best).items():
            ways = [(s, cost + 2, "D", ())]
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                ways += [(step(s, role[:1]), cost + late, "K", ((role, text),))]
                ways += [(step(s, r[0]), cost + 1 + late, "R", ((r, text),)) for r in ("user", "assistant")]
            for t, c, letter, more in ways:
                new = (c, audit + letter, (*turns, *more))
                if t is not None and (t not in after or new[:2] < after[t][:2]):
                    after[t] = new
        best = after
    return min((v for s, v in states(best).items() if s in ("", "a")), key=lambda v: v[:2])


def judged(rows):
    """What the repair of one conversation's (turn, role, text) gives."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faulty = set(), []
    for _, role, text in rows:
        ends = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else ""
        seen.add((role, text))
        faulty.append((role, text, fault))
    turns = [t for t, *_ in rows if t is not None]
    cost, audit, kept = least(faulty)
    assert FINAL.fullmatch("".join(r[0] for r, _ in kept))
    count = lambda f: sum(x[2] == f for x in faulty)
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in kept))


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        for _ in range((0, 1, 1, 2)[kind] if kind < 4 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def expected(rows):
    by = defaultdict(list)
    for conv, *rest in damage(rows):
        by[conv].append(tuple(rest))
    return {c: judged(by[c]) for c in {r[0] for r in rows}}


COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def as_dict(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def random_conversations(n, seed=3):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ux"])
            rows.append((conv, rng.choice([turn, turn * 2, None]), role, rng.choice(["Hm.", "Ha!", "no end", " ", "", None, "a.\n ", f"t{rng.random()}."])))
    return rows


def test_repair_of_random_conversations(spark):
    rows = random_conversations(600) + [(None, 1, "user", "Q?"), (None, None, "assistant", "A."), (None, 2, "assistant", "A.")]
    df = ship(spark).createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert as_dict(C.repaired_digests(df)) == expected(rows)


def test_repair_of_a_conversation_over_many_tasks(spark):
    """Two conversations of thousands of rows lie over several batches and ranges, one with rows that are the same."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", f"{t}", "Same."])) for t in range(4000)]
    rows += [(8, None, "user", "Again.")] * 300 + [(8, t // 3, rng.choice(["user", "assistant"]), f"{t}?") for t in range(3000)] + random_conversations(50)
    df = ship(spark).createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        assert as_dict(C.repaired_digests(df)) == expected(rows)
        pieces = C.repair_conversations(C.damaged(df)).where("conv_id = 7").collect()
        assert len(pieces) > 5
        assert sorted(p.piece for p in pieces) == list(range(len(pieces)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1500")


def test_repair_of_odd_tables(spark):
    none = ship(spark).createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert C.repaired_digests(none).count() == 0
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "Yes. " * 40_000) for t in range(4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string, cost int")
    assert as_dict(C.repaired_digests(df)) == expected(rows)


def test_runs_go_by_powers():
    runs = ((3, 1), (5, 1000), (C.GONE, 1 << 20), (8, 77))
    slow = C.END
    for symbol, n in reversed(((3, 1), (5, 1000), (C.GONE, 1000), (8, 77))):
        for _ in range(n):
            slow = C._applied(C.power(symbol, 0), slow)
    fast = C.END
    for symbol, n in reversed(runs):
        fast = C.advanced(symbol, n, fast)
    assert [a - b for a, b in zip(fast, slow, strict=True)] == [2 * ((1 << 20) - 1000)] * 4
    assert C._applied(C.matrix(runs), C.END) == fast


def test_op11(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(QUERIES["op11_conversation_repair"](ship(spark), SF)) == expected(rows)


# periodic runs


def naive_runs(words, least=12):
    found, ids = {}, np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0, int)
    for q in range(1, len(words) // 2 + 1):
        differ = np.flatnonzero(np.concatenate(([True], ids[q:] != ids[:-q], [True])))
        for k in np.flatnonzero(np.diff(differ) - 1 + q >= max(least, 2 * q)):  # words between are equal to those q later
            found.setdefault((int(differ[k]), int(differ[k + 1] - differ[k] - 1 + q)), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def periodic_texts(n, seed=1):
    rng, texts = random.Random(seed), []
    for _ in range(n):
        out = []
        for _ in range(rng.randint(0, 4)):
            root = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 25))]
            out += root * rng.randint(1, 5) + root[: rng.randint(0, len(root))]
            out += [rng.choice("abcdé") for _ in range(rng.randint(0, 5))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(out))
    return texts


def test_runs_of_random_texts(spark):
    texts = [*periodic_texts(500), None, "", "  ", "a " * 20_000, "one", "x y " * 6, "abababa" * 2]
    df = ship(spark).createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, runs string")
    for least in (12, 2, 30):
        got = {r.doc_id: r for r in P.periodic_runs(df, least).collect()}
        for i, t in enumerate(texts):
            words = words_of(t)
            runs = naive_runs(words, least) if i != 503 else [(0, 20_000, 1)]
            gone = {j for s, n, q in runs for j in range(s + q, s + n)}
            r = got[i]
            assert [tuple(x) for x in r.runs] == runs, t
            assert (r.n_words, r.n_removed, r.kept.encode()) == (len(words), len(gone), b" ".join(w for j, w in enumerate(words) if j not in gone))


def test_runs_need_more_than_the_next_occurrence(spark):
    text = " ".join("abababa" * 2)
    (row,) = P.periodic_runs(ship(spark).createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert [tuple(x) for x in row.runs] == naive_runs(words_of(text))


def test_runs_of_odd_tables(spark):
    assert P.periodic_runs(ship(spark).createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = [(None, "z " * 12), (None, "z " * 12), (3, None)]
    got = P.periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(len(r.runs) for r in got) == [0, 1, 1]


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_op12(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](ship(spark), SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words, r = plant(doc_id, words_of(text)), got[doc_id]
        runs = naive_runs(words)
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(b" ".join(w for j, w in enumerate(words) if j not in gone))


def test_planted_texts(spark):
    rows = [(i, t) for i, t in enumerate(periodic_texts(120, 9))] + [(5, None), (None, "a b c d")]
    got = planted(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), " ".join(w.decode() for w in words_of(r.text))) for r in got) == sorted((str(i), b" ".join(plant(i, words_of(t)) if i is not None else words_of(t)).decode()) for i, t in rows)


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def bpe_texts():
    rng = random.Random(2)
    alphabet = list("abcXYZ019 ,.'!?\n\t-_é中あ。한  \u0085\U0001f600́") + ["'s", "'ll", "  ", "\r\n", "don't", "<|endoftext|>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(200)]


def test_parts_are_cut_where_no_match_crosses(library):
    for text in bpe_texts():
        for size in (1, 7, 50):
            found = list(bpe.parts(text, size))
            assert "".join(p for p, _ in found) == text
            assert [i for p, _ in found for i in library.encode_ordinary(p)] == library.encode_ordinary(text)


def test_long_texts(spark, library):
    rng = random.Random(4)
    long = [
        "word, and 'another' one's; " * 8000, "".join(rng.choice("abcdefgh") for _ in range(300_000)), "x" + " " * 90_000 + "y\n" + "\n" * 70_000 + " z", "-" * 200_000,
        " " * 5000 + "\t", "中文。" * 40_000, "7" * 100_000 + "a", "a'" * 60_000, "　" * 3000 + "b",
    ]
    rows = [(i, t) for i, t in enumerate([*long, None, "", *bpe_texts()])]
    df = ship(spark).createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()}
    for i, text in rows:
        want = packed(library.encode_ordinary(text or ""))
        assert bytes(got[i].ids) == want, i
        assert (got[i].n_tokens, bytes(got[i].decoded).decode()) == (len(want) // 4, text or "")


def test_a_million_blanks(spark):
    """The library's own regular expression overflows here; the ids have to give the text back."""
    text = "a" + " " * 1_000_000 + "b"
    df = ship(spark).createDataFrame([(1, text), (None, "x"), (None, "x")], "doc_id bigint, text string")
    got = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert {bytes(r.decoded).decode() for r in got} == {text, "x"}
    assert len(got) == 3


def test_bpe_of_odd_tables(spark):
    assert bpe.encode(ship(spark).createDataFrame([], "doc_id bigint, text string"), RANKS, public_tokenizers.PATTERN).count() == 0
    df = spark.createDataFrame([(1, "tail", b"x")], "doc_id bigint, text string, ids binary")
    assert bpe.encode(df, RANKS, public_tokenizers.PATTERN).columns == ["doc_id", "n_tokens", "ids"]
    broken = spark.createDataFrame([(1, 1, packed([187])), (2, 0, None)], "doc_id bigint, n_tokens bigint, ids binary")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(broken, RANKS, public_tokenizers.PATTERN).collect()}
    assert got[2] == b"" and len(got[1]) == 1


def test_op13(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (len(ids := library.encode_ordinary(t or "")), sha(packed(ids)), sha(t or "")) for i, t in docs}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_byte_bpe"](ship(spark), SF).collect()}
    assert got == want
