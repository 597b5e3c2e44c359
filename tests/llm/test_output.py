"""Packing, records, sharding, mixing, searches and language identification, with every defined case."""

import shutil
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contactloom import ship
from contactloom.llm import lang_id, mixing, multi_index, records, sharding, tokens, vectors as vector_lists
from contactloom.llm.multi_index import nearest
from contactloom.llm.packing import hilbert, pack_documents
from contactloom.llm.scratch import Scratch
from contactloom.llm.tokens import encoder
from contactloom.llm.topk import exact_top_k

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello wörld, it's  fine.\n\nOK\ttabs", "", None, "x " * 3000, "no space here　!", "<|endoftext|> a<|startoftext|>b", "don't 12,5 'tis É́ ΑΣ ς", "   ", "\nLine\n", "a" * 5000]
SCHEMA = "doc_id bigint, text string, lang string, source string, key bigint, shard string"


def frame(spark, n=40):
    rows = [(i, TEXTS[i % len(TEXTS)], None, f"src{i % 3}" if i % 7 else None, 1, "x") for i in range(n)]
    return ship(spark).createDataFrame(rows, SCHEMA).repartition(3)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_ids_are_the_librarys(path):
    t, e = Tokenizer.from_file(path), encoder(path)
    for text in TEXTS + ["\n word", " \nword.", "\tTab", "ÿ× ÷a é.", "K K", "it's.", "co-op; re-do:"]:
        assert np.frombuffer(e.encode((text or "").encode()), e.dtype).tolist() == t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_ids_of_many_texts_look_up_each_piece_once(path, monkeypatch):
    t, e = Tokenizer.from_file(path), tokens.Encoder(path)
    looked_up, get = Counter(), tokens.Encoder.__getitem__
    monkeypatch.setattr(tokens.Encoder, "__getitem__", lambda self, piece: looked_up.update([piece]) or get(self, piece))
    texts = [x or "" for x in TEXTS] + ["\n word", " \nword.", "it's. a.b, c", "wide\u00a0 space. here,", "x, " * 2000]
    raw = [x.encode() for x in texts]
    off = np.cumsum([0, *map(len, raw)])
    ids, at = e.encode_all(np.frombuffer(b"".join(raw), np.uint8), off, np.array([7], e.dtype).tobytes())
    ids = np.frombuffer(ids, e.dtype)
    assert [ids[a // e.dtype.itemsize : b // e.dtype.itemsize].tolist() for a, b in zip(at, at[1:], strict=False)] == [t.encode(x, add_special_tokens=False).ids + [7] for x in texts]
    assert looked_up[b" x"] <= 1 and sum(looked_up.values()) < 100  # of 5 000 pieces


def test_hilbert_neighbours_touch():
    grid = np.array([(a, b) for a in range(16) for b in range(16)])
    path = grid[np.argsort(hilbert(grid, 4))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_packing(spark):
    t = Tokenizer.from_file(BYTE)
    want = {i: t.encode(TEXTS[i % len(TEXTS)] or "", add_special_tokens=False).ids + [0] for i in range(40)}
    pieces, rows = defaultdict(list), pack_documents(frame(spark), BYTE).collect()
    sequences = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, ids in want.items():
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    for s, rs in sequences.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or s == len(sequences) - 1
    assert pack_documents(frame(spark).limit(0), BYTE).count() == 0


def test_records_round_trip(spark, tmp_path):
    t = Tokenizer.from_file(WORDS)
    df = frame(spark).unionByName(ship(spark).createDataFrame([(None, "none", None, None, 1, "")], SCHEMA))
    records.write_records(df, str(tmp_path / "r"), WORDS)
    rows, at = {r.doc_id: r for r in records.read_records(spark, str(tmp_path / "r")).collect()}, 0
    for d, text in [(None, "none"), *((i, TEXTS[i % len(TEXTS)]) for i in range(40))]:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    some = records.read_records(spark, str(tmp_path / "r"), ship(spark).createDataFrame([(30,), (3,)], "doc_id bigint"))
    assert {r.doc_id: r.start for r in some.collect()} == {d: rows[d].start for d in (3, 30)}
    records.write_records(frame(spark).limit(0), str(tmp_path / "e"), WORDS)
    assert records.read_records(spark, str(tmp_path / "e")).count() == 0


def test_record_files_are_bounded_and_read_by_the_index(spark, tmp_path):
    """Small files, equal rows in several tasks, a folder that is moved, and reads that open only files with wanted records."""
    t = Tokenizer.from_file(WORDS)
    hot = ship(spark).createDataFrame([(7, "the same row again")] * 3000, "doc_id bigint, text string")
    df = frame(spark, 60).select("doc_id", "text").where("doc_id <> 7").unionByName(hot).repartition(3)
    records.write_records(df, str(tmp_path / "a"), WORDS, file_bytes=2000)
    shutil.move(tmp_path / "a", tmp_path / "b")
    folder = str(tmp_path / "b")
    index = spark.read.parquet(f"{folder}/index").collect()
    held = {}
    for r in index:
        held.setdefault(r.file, []).append(r)
    assert all(sum(r.length for r in rs) <= 2000 or len(rs) == 1 for rs in held.values()) and len(held) > 40
    assert len({records.file_order(f)[0] for f, rs in held.items() if any(r.doc_id == 7 for r in rs)}) > 1
    got, at = sorted(records.read_records(spark, folder).collect(), key=lambda r: r.start), 0
    want = sorted([(i, TEXTS[i % len(TEXTS)]) for i in range(60) if i != 7] + [(7, "the same row again")] * 3000, key=lambda r: r[0])
    assert [r.doc_id for r in got] == [d for d, _ in want]
    for r, (_, text) in zip(got, want, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    where = {r.doc_id: r.file for r in index}
    for name in sorted(held):
        if name not in (where[50], where[3]):
            (tmp_path / "b" / "data" / name).unlink()
    some = records.read_records(spark, folder, ship(spark).createDataFrame([(50,), (3,), (50,), (10**6,)], "doc_id bigint"))
    assert sorted((r.doc_id, r.start) for r in some.collect()) == sorted((r.doc_id, r.start) for r in got if r.doc_id in (3, 50))
    assert records.read_records(spark, folder, ship(spark).createDataFrame([(10**6,)], "doc_id bigint")).count() == 0


def test_a_record_file_is_read_in_parts(spark, tmp_path):
    """One file is shared among tasks, none of which holds it as a row; damage in it is noticed. The least part is 4 KB here."""
    t = Tokenizer.from_file(WORDS)
    texts = [f"{w} " * (i % 50) + TEXTS[i % len(TEXTS)][:300] for i, w in enumerate(["line", "é", "12", "\u0115"] * 100) if TEXTS[i % len(TEXTS)] is not None]
    df = ship(spark).createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 1)
        records.write_records(df, str(tmp_path / "r"), WORDS)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        file = {r.file for r in spark.read.parquet(str(tmp_path / "r/index")).collect()}
        found = records.read_records(spark, str(tmp_path / "r"))
        got, at = sorted(found.collect(), key=lambda r: r.start), 0
        assert len(file) == 1 and "binaryFile" not in found._jdf.queryExecution().toString()
        assert [r.doc_id for r in got] == list(range(len(texts)))
        for r, text in zip(got, texts, strict=True):
            ids = t.encode(text, add_special_tokens=False).ids + [2]
            assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids), crc(ids), np.array(ids, "<u4").tobytes())
            at += len(ids)
        file = tmp_path / "r/data" / file.pop()
        whole = file.read_bytes()
        assert records._lines(spark, str(tmp_path / "r/data")).rdd.getNumPartitions() > 2
        at, seen = 0, []
        while at < len(whole):
            body, after = records.parse(whole, at)
            seen.append(records.opened(body)[2:4] == (len(seen), at))
            at = after
        assert len(seen) == len(texts) and all(seen)
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
        file.write_bytes(whole[: len(whole) // 2] + bytes([whole[len(whole) // 2] ^ 4]) + whole[len(whole) // 2 + 1 :])
        with pytest.raises(Exception, match="record"):
            records.read_records(spark, str(tmp_path / "r")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_frames_are_lines(spark, tmp_path):
    """No frame holds a line end, and one whose length begins like a byte order mark is read as it is."""
    rng, rows = np.random.default_rng(3), []
    for n in [*range(300), 0xBFBBEF - records._ROW.size]:
        body = records.payload(n, 2, rng.choice(np.array([10, 255, 48, 49, 50, 0xEF, 13, 0], np.uint8), n).tobytes() if n < 300 else bytes(n))
        rows.append((records.frame(body), body))
    assert all(f.count(b"\n") == 1 and records.parse(f) == (body, len(f)) for f, body in rows)
    folder = tmp_path / "piece=0"
    folder.mkdir()
    (folder / "part-00000").write_bytes(rows[-1][0] + b"".join(f for f, _ in rows[:-1]))
    got = {bytes(r.value) for r in records._lines(ship(spark), str(tmp_path)).select(F.col("value").cast("binary").alias("value")).collect()}
    assert got == {f[:-1] for f, _ in rows}


def test_damage_is_noticed():
    good = records.frame(records.payload(7, 2, b"abcd"))
    assert records.opened(records.parse(good)[0])[0] == 7
    for i in range(len(good)):
        with pytest.raises(ValueError):
            records.parse(good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :])
    with pytest.raises(ValueError):
        records.parse(good[:-2])


def test_files_go_by_their_number():
    names = [f"s3://b/part-1/part-{n:05d}-ab-c000.txt" for n in (99999, 100000, 3, 100001)]
    assert [n.split("/")[-1][:11] for n in sorted(names, key=records.file_order)] == ["part-00003-", "part-99999-", "part-100000", "part-100001"]


def test_sharding(spark):
    df = frame(spark, 400)
    rows = sharding.shard_documents(df, 5).collect()
    for r in rows:
        text = (TEXTS[r.doc_id % len(TEXTS)] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "bytes", None)
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= max(r.size for r in rows)
    assert len({(r.vslot, r.shard) for r in rows}) == len({r.vslot for r in rows})
    one = ship(spark).createDataFrame([(7, "same") if i % 3 else (7, f"text {i}") for i in range(4000)] + [(None, None)] * 300, "doc_id bigint, text string")
    load = Counter()
    for r in sharding.shard_documents(one, 5).collect():
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= 30
    assert sharding.shard_documents(df.limit(0), 5).count() == 0


def test_slots_are_for_good(spark, monkeypatch):
    """The same records have the same slots in a larger table and under any partitioning, repeated rows too."""
    monkeypatch.setattr(sharding, "BLOCK", 70)
    rows = [(i, 20, i % 3) for i in range(200)] + [(7, 30, 1)] * 300 + [(None, 16, 0)] * 50

    def slots(rows, n):
        df = ship(spark).createDataFrame(rows, "doc_id bigint, size bigint, text_crc32 bigint").repartition(n)
        return Counter(tuple(r) for r in sharding.in_slots(df, Scratch(spark)).select("doc_id", "size", "text_crc32", "vslot").collect())

    one = slots(rows, 1)
    assert sum(one.values()) == len(rows) and len([k for k in one if k[:3] == (7, 30, 1)]) > 250
    assert one == slots(rows, 7)
    assert one <= slots(rows + [(i, 20, 5) for i in range(3000)], 3)


def test_rebalancing_edits_few_slots():
    sizes = {v: (100 + v % 7, 1) for v in range(1000)}
    old = sharding.new_map(sizes, 8, 1000)
    new = sharding.rebalance(old, sizes, 9)
    moved = [v for v in old if old[v] != new[v]]
    load = Counter()
    for v, s in new.items():
        load[s] += sizes[v][0]
    assert all(new[v] == 8 for v in moved) and len(moved) < 130
    assert max(load.values()) <= 1.03 * sum(load.values()) / 9
    assert set(sharding.rebalance(new, sizes, 8).values()) == set(range(8))


def test_schedule_is_fair(spark):
    weights = {"src0": 5, "src1": 2, "src2": 1, mixing.REST: 1}
    slots = sorted(mixing.period(weights), key=lambda x: x[2])
    placed = Counter()
    for n, (s, _, _) in enumerate(slots, 1):
        placed[s] += 1
        assert all(abs(placed[k] - n * w / 9) < 1 for k, w in weights.items())
    rows = mixing.schedule(frame(spark, 300), weights, 4).collect()
    assert len(rows) == 300 and len({r.mix_position for r in rows}) == 300
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in rows)
    for s in weights:
        at = sorted(r.mix_position for r in rows if r.mix_class == s)
        assert [p // 4 for p in at] == sorted(r.mix_slot for r in rows if r.mix_class == s)
    assert mixing.schedule(frame(spark).limit(0), weights).count() == 0


def test_the_mix_of_the_pipeline_loses_no_document(spark):
    import corpus_pipeline

    rows = [(i if i % 50 else None, f"text {i}", "en", None if i == 7 else f"src{i % 20}", i, "x") for i in range(600)]  # one row without source
    got = corpus_pipeline.source_mix(spark, ship(spark).createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    assert sorted(r.key for r in got) == list(range(600))
    assert {r.key: tuple(r[:6]) for r in got} == {r[4]: r for r in rows}
    assert len({r.mix_position for r in got}) == 600
    total, place = sum(mixing.WEIGHTS.values()), {(s, j): slot for s, j, slot in mixing.period(mixing.WEIGHTS)}
    for s, w in mixing.WEIGHTS.items():
        at = sorted(r.mix_position for r in got if (r.source or mixing.REST) == s)
        blocks = [i // mixing.BLOCK for i in range(len(at))]
        assert at == [(b // w * total + place[s, b % w]) * mixing.BLOCK + i % mixing.BLOCK for i, b in enumerate(blocks)]
    packed = corpus_pipeline.packing(spark, ship(spark).createDataFrame(got, SCHEMA + ", mix_slot bigint, mix_position bigint"), "").collect()
    assert {(r.doc_id, r.mix_slot, r.mix_position) for r in packed} == {(r.doc_id, r.mix_slot, r.mix_position) for r in got}


def test_sequences_follow_the_mix(spark):
    import corpus_pipeline

    rows = [(i, f"text {i} " + "word " * (i % 40), "en", f"src{max(0, i % 40 - 20)}", i, "x") for i in range(1600)]  # half of all: src0
    docs = corpus_pipeline.source_mix(spark, ship(spark).createDataFrame(rows, SCHEMA).repartition(3), "")
    got = sorted(corpus_pipeline.packing(spark, docs, "").collect(), key=lambda r: (r.sequence_id, r.offset))
    total = sum(mixing.WEIGHTS.values())
    turns = [r.mix_slot // total for r in got]
    assert turns == sorted(turns) and turns[-1] > 2
    first = Counter(f"src{max(0, d % 40 - 20)}" for d in {r.doc_id for r in got if r.mix_slot < total})
    assert first == {s: w * mixing.BLOCK for s, w in mixing.WEIGHTS.items() if s != mixing.REST}  # the target weights in the first sequences
    places = [(r.mix_slot // total, r.mix_position) for r in got]
    assert places != sorted(places)  # inside a period the curve decides


def test_encoders_hold_little(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_DISTINCT", 50)
    e = encoder(BYTE)
    for i in range(30):
        e.encode_all(np.frombuffer(" ".join(f"w{i}x{j}" for j in range(20)).encode(), np.uint8)[:60], np.array([0, 60]), b"")
        assert len(e) < 50 + 20
    tokens.forget()
    assert not tokens._encoders


def vectors(spark, n=1500, d=6):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, d)).round(1)
    rows = [(i, [float(v) for v in x[i]], i) for i in range(n)]
    rows[5] = (5, None, 0)
    rows[6] = (6, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0)
    rows[7] = (7, [float("nan")] * d, 0)
    rows[8] = (8, [float("inf")] + [0.0] * (d - 1), 0)
    rows[9] = (9, [0.0] * d, 0)
    rows[10] = (10, [1.0], 0)
    rows += [(i + n, rows[20][1], 0) for i in range(30)]  # copies: ties
    return ship(spark).createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int").repartition(4), rows


def usable(rows, zero):
    return {i: np.array(v, float) for i, v, _ in rows if v and len(v) == 6 and None not in v and np.isfinite(v).all() and (zero or any(v))}


def test_exact_top_k(spark):
    df, rows = vectors(spark)
    x = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in usable(rows, True).items()}
    got = defaultdict(list)
    for r in exact_top_k(df, 10, 100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {i for i in x if i % 100 == 0}
    for q in got:
        want = sorted(((-int(v @ x[q]), i) for i, v in x.items() if i != q))[:10]
        assert got[q] == [(i, -s) for s, i in want]
    assert exact_top_k(df.limit(0)).count() == 0
    assert exact_top_k(df.where("vec_id in (100, 200)")).count() == 2


def test_nearest(spark):
    df, rows = vectors(spark)
    x = {i: np.array(v, np.float32).astype(float) for i, v in usable(rows, False).items()}
    got = defaultdict(list)
    for r in nearest(df, 10, 100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in got:
        want = sorted((float(np.sqrt(((v - x[q]) ** 2).sum())), i) for i, v in x.items() if i != q)[:10]
        hits += len({i for _, i in want} & {i for i, _ in got[q]})
        assert [s for _, s in got[q]] == sorted(s for _, s in got[q])
        for i, s in got[q]:
            assert s == pytest.approx(float(np.sqrt(((x[i] - x[q]) ** 2).sum())), abs=1e-12)
    assert hits >= 9 * len(got) and set(got) == {i for i in x if i % 100 == 0}
    assert nearest(df.limit(0)).count() == 0
    assert nearest(df.where("vec_id in (10, 100, 200)")).count() == 2  # 10 has one component
    assert nearest(df.unionByName(df.where("vec_id = 100"))).where("query_id = 100 and vec_id = 100").count() == 0


def test_nearest_takes_all_cells_or_some(spark):
    """With all cells the search is exact; with few it finds less, so cells are left out at this size."""
    df, rows = vectors(spark)
    x = {i: np.array(v, np.float32).astype(float) for i, v in usable(rows, False).items()}
    want = {q: {i for _, i in sorted((float(np.sqrt(((v - x[q]) ** 2).sum())), i) for i, v in x.items() if i != q)[:10]} for q in x if q % 100 == 0}
    found = {}
    for share in (1.0, 0.0):
        hits = [r.vec_id in want[r.query_id] for r in nearest(df, share=share).collect()]
        found[share] = sum(hits) / (10 * len(want))
    assert found[1.0] == 1 and found[0.0] < 1


def test_traversal_is_in_order_of_summed_distance():
    rng = np.random.default_rng(5)
    index = (rng.standard_normal((7, 2)), rng.standard_normal((5, 3)))
    sizes = rng.integers(0, 4, 35)
    q = rng.standard_normal(5)
    sums = ((index[0] - q[:2]) ** 2).sum(1)[:, None] + ((index[1] - q[2:]) ** 2).sum(1)[None, :]
    order = [c for c in sums.ravel().argsort().tolist() if sizes[c]]
    for enough in (1, 9, sizes.sum()):
        n = int(np.searchsorted(np.cumsum(sizes[order]), enough)) + 1
        assert multi_index.traverse(q, index, sizes, enough).tolist() == order[:n]


def test_small_slices_and_little_memory(spark, monkeypatch):
    """Lists in many slices and partitions, and tasks that give away what they hold at once."""
    df, _ = vectors(spark)
    whole = {f: sorted(map(tuple, f(df).collect())) for f in (exact_top_k, nearest)}
    for name, value in (("SLICE_ROWS", 16), ("OPEN_BYTES", 4096), ("PART_BYTES", 8192), ("HELD", 8)):
        monkeypatch.setattr(vector_lists, name, value)
    for f, rows in whole.items():
        assert sorted(map(tuple, f(df).collect())) == rows


def test_language_id(spark):
    docs = ship(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = lang_id.identify(docs).collect()
    assert {r.doc_id for r in rows if r.held_out} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_id_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !? ×", "en"), (4, "the cat and the dog", "en"), (6, "der Hund und die Katze", "de"), (7, "und die", None), (None, "the dog", "en")]
    df = ship(spark).createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in lang_id.identify(df).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3
    learned = {lang for d, t, lang in rows if d and lang and t and zlib.crc32(str(d).encode()) % 3 != 1}
    assert {got[i] for i in (4, 6, 7, None)} <= learned | {"und"}
    assert lang_id.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in lang_id.identify(df.where("lang is null")).collect()} == {"und"}


def test_phrases_against_brute_force(spark, monkeypatch):
    """Greedy longest matches by Python's own search, for short and long texts and more languages than one pass takes."""
    rng = np.random.default_rng(4)
    names = [f"l{i:02d}" for i in range(11)]
    letters = {n: rng.choice(list("abcdefgh "), 5) for n in names}
    make = lambda n, size: "".join(rng.choice(letters[n], size))
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(ids[i], make(names[i % 11], int(rng.integers(1, 300))), names[i % 11]) for i in range(44)]
    rows += [(ids[50], make("l03", 9000), None), (ids[51], "\u00e9\u00e8 a" * 50, None), (ids[52], "A", None)] + [rows[0]] * 3
    monkeypatch.setattr(lang_id, "LANE", 100)
    df = ship(spark).createDataFrame(rows, "doc_id bigint, text string, lang string")
    models = lang_id.learn(df)
    assert [n for m in models for n in m.names] == names and len(models) == 2
    fold = lambda b: 0 if b < 65 or 90 < b < 97 or 122 < b < 128 else b + 32 if b < 97 and b < 91 else b
    samples = {n: b"" for n in names}
    by = {(r[2], r[0]): r[1] for r in rows if r[2]}
    order = {r.doc_id: r.h for r in df.selectExpr("doc_id", "xxhash64(doc_id) h").collect()}
    for n in names:
        picked = {}
        for (lang, d), text in by.items():
            if lang == n:
                picked[order[d] % lang_id.DOCS] = min(picked.get(order[d] % lang_id.DOCS, (order[d], text)), (order[d], text))
        samples[n] = b"".join(b"\n" + text.encode() for _, text in sorted(picked.values()))[: lang_id.SAMPLE]
    held = {n: bytes(map(fold, s)) for n, s in samples.items()}

    def phrases(text, sample):
        count, at = 0, 0
        while at < len(text):
            end = at + 1
            while end < len(text) and text[at:end] in sample and text[at : end + 1] in sample:
                end += 1
            count, at = count + 1, end
        return count

    texts = [r[1].encode() for r in rows]
    cut = np.cumsum([0, *map(len, texts)])
    for model in models:
        got = model.phrases(np.frombuffer(b"".join(texts), np.uint8), cut)
        for i, n in enumerate(model.names):
            assert got[i].tolist() == [phrases(bytes(map(fold, t)), held[n]) for t in texts], n
    bits = {t: {n: phrases(bytes(map(fold, t)), held[n]) * np.log2(len(samples[n])) / len(t) for n in names} for t in texts}
    for r in lang_id.predict(df.select("doc_id", "text"), models, "text").collect():
        low = sorted((v, n) for n, v in bits[r.text.encode()].items())
        assert r.lang_pred == low[0][1] and abs(r.score - (1 - low[0][0] / low[1][0])) < 1e-9


def test_automaton_finds_longest_matches():
    text = [1, 2, 1, 2, 3, 1, 1, 2]
    table = lang_id.automaton(text, 4)
    for a in range(len(text)):
        for b in range(a + 1, len(text) + 1):
            state = 0
            for c in text[a:b]:
                state = table[state, c]
                assert state >= 0
    assert table[table[0, 3], 3] < 0


def test_pipeline_on_a_small_table(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = ship(spark).read.parquet(f"{folder}/documents.parquet")
    ids = None
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        now = {r[0] for r in docs.select("doc_id").distinct().collect()}
        assert now and (ids is None or now <= ids), name
        ids = now
    assert docs.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
