"""Similarity join of documents on their sets of word n-grams.

Sets are ordered rarest n-gram first: by how many groups of documents hold it (counted exactly over all documents, in a round
of `rounds.ask`, on 40 bits of its hash), then by hash. Any fixed total order is right; a good one is fast. Two sets of
Jaccard similarity t share an n-gram among the first n - ceil(t * n) + 1 of each, so only those prefixes are joined. Candidate
pairs pass a length, a positional and a suffix filter (counts of the whole sets by hash range bound their difference) and are
then verified once, on the sets.

Prefix n-grams that one set alone holds are dropped at once. Each list of sets that share an n-gram is joined to two hubs of
it, not to itself: to the most central set, and to one by hash. Sets already in one component need no further comparison, so
rounds of hubs contract groups of near copies with a number of pairs in proportion to the lists. What stays apart is compared
list by list: short lists as pairs, long lists in cells of two blocks of sets, each pair in the list of its first common
n-gram; a cell gives a spanning forest of its links, never its pairs. That is exact: every pair that shares a prefix n-gram is verified or known to be connected.

Numbers of links are counted in such cells too, over the sets of each component: as a number for each set, without pairs.

Defined cases: words are lower-cased over A-Z only; fewer words than an n-gram make one n-gram of all of them; null, empty
or blank texts have an empty set and are linked with nothing; equal sets are one class; rows with the same doc_id and other
texts are separate sets; a null doc_id is kept, with the smallest id of its component or null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kernel as K, rounds as R
from .scratch import Scratch, components

N = 5
PERCENT = 80
#: n-grams are counted by this many bits of their hash, in classes of how many groups hold them
COUNT_BITS = 40
CLASSES = (2, 4, 16, 64)

BIN_BITS = 4  # sets are counted by 2**BIN_BITS ranges of hashes for the suffix filter
PROGRESS = 0.1  # of the sets that stay apart, for another round of hubs
LONG = 64  # a list of more sets is compared in cells
BLOCK, BLOCK_GRAMS = 256, 1 << 19  # sets, and n-grams, of a block of sets that are compared with another
FILTER_BITS = 20  # bits of the filter that spares most texts a join

_DOC = "doc_id bigint, n bigint, row_key bigint, sid bigint, toks array<bigint>, pos array<int>, bins array<int>"


def need(n: int | np.ndarray, percent: int):
    return (percent * n + 99) // 100


def gram_sets(data: np.ndarray, cut: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each document of a slice."""
    w = K.words(data, cut, lower=True)
    h = K.runs(w.hash, n)
    for i in range(len(cut) - 1):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= n:
            yield np.unique(h[a : b - n + 1])
        else:
            yield K.mix(K.runs(w.hash[a:b], b - a) + K.U(b - a)) if b > a else np.zeros(0, K.U)


def set_id(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(rows: pa.Table, n: int) -> list[np.ndarray]:
    data, off = K.as_bytes(rows["text"])
    return [s for _, _, part, cut in K.slices(data, off) for s in gram_sets(part, cut, n)]


def _counted(sets: Iterable[np.ndarray]) -> np.ndarray:
    """The distinct keys under which the n-grams of some sets are counted."""
    return np.unique(np.concatenate([np.zeros(0, K.U), *sets]) & ~K.U((1 << (64 - COUNT_BITS)) - 1))


def prepare(docs: DataFrame, n: int = N, percent: int = PERCENT, key: Column | None = None) -> DataFrame:
    """doc_id, n (set size), row_key, and for the sets that share a prefix n-gram with another: sid, and once in each group the shared
    prefix n-grams, their places, and counts of the set by hash range."""
    groups = R.grouped(docs, F.col("text").cast("string").alias("text"), (F.lit(None) if key is None else key).cast("bigint").alias("row_key"))

    def send(rows: pa.Table, _: dict) -> R.Keys:
        return {1: (_counted(_sets(rows, n)), None)}

    def answer(kind, keys, senders, vals):
        held = R.run_sizes(keys)
        return {i: held >= least for i, least in enumerate(CLASSES)}

    def keep(rows: pa.Table, box: R.Box) -> pa.Table:
        sets, ids = _sets(rows, n), K.ints(rows["doc_id"])
        sid = np.array([set_id(s) for s in sets], np.int64)
        first: dict[int, int] = {}  # of each set, the row of the smallest doc_id
        for i in np.argsort(ids, kind="stable").tolist():
            if len(sets[i]):
                first.setdefault(int(sid[i]), i)
        keys = _counted(sets)
        classes = sum((box.mask(i, keys).astype(np.int8) for i in range(len(CLASSES))), np.zeros(len(keys), np.int8))
        prefix, shared = {}, {}
        for i in first.values():
            s = sets[i]
            held = classes[np.searchsorted(keys, s & ~K.U((1 << (64 - COUNT_BITS)) - 1))]
            order = np.argsort(held, kind="stable")[: len(s) - need(len(s), percent) + 1]  # s is sorted: ties by hash
            prefix[i], shared[i] = s[order], held[order] > 0
        _, twice = K.unique_many(np.concatenate([np.zeros(0, K.U), *prefix.values()]))
        copies = np.isin(sid, [s for s, c in zip(*np.unique(sid, return_counts=True), strict=True) if c > 1])
        out: dict[str, list] = {c: [] for c in ("sid", "toks", "pos", "bins")}
        for i, s in enumerate(sets):
            row: list = [None] * 4
            if len(s):
                head = first[int(sid[i])]
                at = np.flatnonzero(shared[head] | K.member(prefix[head], twice))
                if len(at) or copies[i]:
                    row[0] = int(sid[i])
                if len(at) and i == head:
                    row[1:] = [prefix[i][at].view(np.int64), at.astype(np.int32), np.bincount((s >> K.U(64 - BIN_BITS)).astype(np.int64), minlength=1 << BIN_BITS).astype(np.int32)]
            for c, v in zip(out, row, strict=True):
                out[c].append(v)
        kinds = {"sid": pa.int64(), "toks": pa.list_(pa.int64()), "pos": pa.list_(pa.int32()), "bins": pa.list_(pa.int32())}
        return pa.table({"doc_id": rows["doc_id"].cast(pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "row_key": rows["row_key"], **{c: pa.array(v, kinds[c]) for c, v in out.items()}})

    return R.finish(groups, R.ask(groups, None, send, answer, masks=True), keep, _DOC)


def _passes(percent: int) -> Column:
    """Length, positional and suffix filter for sets u and v that share an n-gram at u.p and v.p. All of it is plain
    arithmetic, so that a join can test it before it makes a row."""
    n, m = F.col("u.n"), F.col("v.n")
    overlap = F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))  # n-grams that they must share
    room = 1 + F.least(n - F.col("u.p") - 1, m - F.col("v.p") - 1)
    apart = sum((F.abs(F.col(f"u.b{i}") - F.col(f"v.b{i}")) for i in range(1 << BIN_BITS)), F.lit(0))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (room >= overlap) & (apart <= n + m - 2 * overlap)


def _pairs(met: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs from rows with two structs u and v (n, sid, p, b0, b1, ...)."""
    near = met.where("u.sid <> v.sid").where(_passes(percent))
    return near.select(F.least("u.sid", "v.sid").alias("a"), F.greatest("u.sid", "v.sid").alias("b")).distinct()


def _dealt(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides with x, y and side: each side of a key is dealt into blocks of bounded size, and every two blocks meet
    in a cell (keys, x, y). So a long list is spread over many tasks, and a row comes up once for each block it meets."""
    sides = []
    for df, c in ((left, "x"), (right, "y")):
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_GRAMS)))
        sides.append(df.groupBy(*keys).agg(blocks.cast("int").alias(f"blocks_{c}")))
    sizes = sides[0].join(sides[1], keys)
    out = []
    for i, (df, own, other) in enumerate(((left, "x", "y"), (right, "y", "x"))):
        meets = F.explode(F.sequence(F.lit(0), F.col(f"blocks_{other}") - 1))
        out.append(df.join(sizes, keys).withColumn(own, F.pmod(F.xxhash64("sid"), F.col(f"blocks_{own}")).cast("int")).withColumn(other, meets).drop("blocks_x", "blocks_y").withColumn("side", F.lit(i)))
    return out[0].unionByName(out[1])


def _shared(grams: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the values of each list that another list holds as well, the bounds of the lists in them, and how many."""
    off = grams.offsets.to_numpy() - grams.offsets[0].as_py()
    values, number, count = np.unique(grams.flatten().to_numpy(), return_inverse=True, return_counts=True)
    many = count[number] > 1
    names = np.cumsum(count > 1) - 1
    return names[number[many]], np.concatenate(([0], np.cumsum(many)))[off], int((count > 1).sum())


def _both(grams: pa.Array, side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each list of side 0 its number, and how many values it has in common with each list of side 1."""
    number, cut, n = _shared(grams)
    right = np.flatnonzero(side == 1)
    held = np.zeros((n, len(right)), np.uint8)
    for j, r in enumerate(right.tolist()):
        held[number[cut[r] : cut[r + 1]], j] = 1
    for i in np.flatnonzero(side == 0).tolist():
        yield i, held[number[cut[i] : cut[i + 1]]].sum(0, dtype=np.int64)


def _linked(cell: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each set of side 0 of a cell its row, the rows of side 1, and which of those it is similar enough to."""
    side, n, sid = (cell[c].to_numpy() for c in ("side", "n", "sid"))
    right = np.flatnonzero(side == 1)
    for i, both in _both(cell["grams"].combine_chunks(), side):
        yield i, right, (both * 100 >= (n[i] + n[right] - both) * percent) & (sid[right] != sid[i])


def _short_pairs(few: DataFrame, apart: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs of different roots in lists of LONG sets at most, so with LONG partners of a row at most."""
    u = few.where(F.col("k") <= LONG).select("tok", "root", F.col("e").alias("u"))
    v = apart.where(F.col("k") <= LONG).select("tok", F.col("root").alias("other"), F.col("e").alias("v"))
    return _pairs(u.join(v, "tok").where("root <> other"), percent)


def _survivors(few: DataFrame, apart: DataFrame, percent: int) -> DataFrame:
    """tok, x, y, side, sid, root, before: the sets of long lists' cells that have a candidate of another root in their cell.
    Rows are (tok, sid, root, n, p, bins, before), `before` being the n-grams of a set's prefix that come before tok."""

    def keep(cell: pa.Table) -> pa.Table:
        side, n, p, root = (cell[c].to_numpy() for c in ("side", "n", "p", "root"))
        bins = cell["bins"].combine_chunks().flatten().to_numpy().reshape(len(side), -1).astype(np.int64)
        right, found = np.flatnonzero(side == 1), np.zeros(len(side), bool)
        for i, both in _both(cell["before"].combine_chunks(), side):
            overlap = -(-(n[i] + n[right]) * percent // (100 + percent))
            ok = (both == 0) & (root[right] != root[i]) & (np.minimum(n[i], n[right]) * 100 >= np.maximum(n[i], n[right]) * percent)
            ok &= 1 + np.minimum(n[i] - p[i] - 1, n[right] - p[right] - 1) >= overlap
            ok &= np.abs(bins[right] - bins[i]).sum(1) <= n[i] + n[right] - 2 * overlap
            found[i] |= ok.any()
            found[right[ok]] = True
        return cell.filter(pa.array(found)).select(["tok", "x", "y", "side", "sid", "root", "before"])

    cells = _dealt(*(df.where(F.col("k") > LONG).drop("k") for df in (few, apart)), ["tok"])
    return cells.groupBy("tok", "x", "y").applyInArrow(keep, "tok bigint, x int, y int, side int, sid bigint, root bigint, before array<bigint>")


def _links_of_cells(survivors: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between survivors whose roots differ. A pair is compared in the list of its first common n-gram alone, so
    once; of the links of a cell a spanning forest is given."""

    def forest(cell: pa.Table) -> pa.Table:
        side, sid, root = (cell[c].to_numpy() for c in ("side", "sid", "root"))
        first = {i: both == 0 for i, both in _both(cell["before"].combine_chunks(), side)}
        up: dict[int, int] = {}

        def top(r: int) -> int:
            while r in up:
                r = up[r]
            return r

        out: list[tuple[int, int]] = []
        for i, right, ok in _linked(cell, percent):
            for j in right[ok & first[i] & (root[right] != root[i])].tolist():
                x, y = top(int(root[i])), top(int(root[j]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    out.append((int(sid[i]), int(sid[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    rows = survivors.join(sets, "sid").withColumn("n", F.size("grams").cast("bigint"))
    return rows.groupBy("tok", "x", "y").applyInArrow(forest, "a bigint, b bigint")


def _count_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """sid and near, the number of rows with another set that is similar enough, of members (root, sid, copies). Only members of
    one root can link, so blocks of each root's sets are compared; what leaves a cell is a number for each set."""

    def count(cell: pa.Table) -> pa.Table:
        copies = cell["copies"].to_numpy()
        found = [(i, int(copies[right[ok]].sum())) for i, right, ok in _linked(cell, percent)]
        return pa.table({"sid": cell["sid"].take(pa.array([i for i, _ in found], pa.int64())), "near": pa.array([k for _, k in found], pa.int64())})

    rows = members.join(sets, "sid").select("root", "sid", "copies", F.size("grams").cast("bigint").alias("n"), "grams")
    return _dealt(rows, rows, ["root"]).groupBy("root", "x", "y").applyInArrow(count, "sid bigint, near bigint").groupBy("sid").agg(F.sum("near").alias("near"))


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """sid and grams of the sets wanted (sid, doc_id), made again from their texts. A bit for each hash of a wanted doc_id
    keeps most other texts out; its size is fixed, and the join after it is exact."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[[r[0] for r in wanted.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).cast("int")).distinct().collect()]] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column("h").to_numpy()]))
            data, off = K.as_bytes(batch.column("text"))
            for a, b, part, cut in K.slices(data, off):
                sets = list(gram_sets(part, cut, n))
                yield pa.record_batch([batch.column("doc_id")[a:b], pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "sid", "grams"])
            K.release()

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(1 << FILTER_BITS)).cast("int").alias("h"))
    return texts.mapInArrow(make, "doc_id bigint, sid bigint, grams array<bigint>").join(wanted.withColumnsRenamed({"doc_id": "rep", "sid": "set"}), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("sid") == F.col("set"))).dropDuplicates(["sid"]).select("sid", "grams")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b and whether they link, from the sets themselves."""
    of = lambda c: sets.select(F.col("sid").alias(c), F.col("grams").alias(f"g{c}"))
    both = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", (both * 100 >= (F.size("ga") + F.size("gb") - both) * percent).alias("ok"))


def _joined(roots: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """sid, root after more links (a, b): only what they join anew is contracted."""
    if roots is None:
        return components(links, scratch).select(F.col("node").alias("sid"), "root")
    a, b = (roots.select(F.col("sid").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    more = components(ends, scratch)
    up = more.select(F.col("node").alias("root"), F.col("root").alias("next"))
    moved = roots.join(up, "root", "left").select("sid", F.coalesce("next", "root").alias("root"))
    return scratch.save(moved.unionByName(more.select(F.col("node").alias("sid"), "root")))


def ngram_jaccard_join(docs: DataFrame, n: int = N, percent: int = PERCENT, links: bool = False, key: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id with an equal set) of every row of docs (doc_id, text).
    With links also n_links, the number of other rows that are similar enough. With key, a bigint of docs, also row_key (that)
    and group_key, a number of the component that holds for rows without doc_id too, null for a row that is alone."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(prepare(docs, n, percent, key))
    reps = scratch.save(rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    one = scratch.save(rows.where("toks is not null").dropDuplicates(["sid"]).select("sid", "n", "toks", "pos", "bins"))
    counts = [F.get("bins", F.lit(i)).alias(f"b{i}") for i in range(1 << BIN_BITS)]
    posts = one.select("sid", "n", "bins", F.explode(F.arrays_zip("toks", "pos")).alias("t"))
    posts = scratch.save(posts.select("sid", F.col("t.toks").alias("tok"), F.struct("n", "sid", F.col("t.pos").alias("p"), *counts).alias("e")))
    total = posts.count()

    stored: list[DataFrame] = []

    def sets_of(sids: DataFrame) -> DataFrame:
        """sid and grams of at least these sets: made once, from their texts."""
        missing = sids.select("sid").distinct().join(reps, "sid")
        for have in stored:
            missing = missing.join(have.select("sid"), "sid", "left_anti")
        stored.append(scratch.save(_sets_of(docs, scratch.save(missing.select("sid", F.col("rep").alias("doc_id"))), n)))
        return reduce(DataFrame.unionByName, stored)

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        return scratch.save(_verify(pairs, sets, percent).where("ok").select("a", "b"))

    roots = tried = None
    slow = False
    for turn in itertools.count():
        if roots is None:
            few = apart = posts.withColumn("root", F.col("sid"))
        else:
            # members of every n-gram's list that aren't in the list's largest component
            apart = posts.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
            sizes = apart.groupBy("tok", "root").agg(F.count(F.lit(1)).alias("k"))
            lists = scratch.save(sizes.groupBy("tok").agg(F.max(F.struct("k", "root")).alias("top"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("tok", "k", F.col("top.root").alias("top"), (F.col("k") * (F.col("k") - F.col("top.k"))).alias("volume")))
            volume = lists.agg(F.sum("volume")).first()[0] or 0
            if not volume:
                break
            apart = scratch.save(apart.join(lists.select("tok", "top", "k"), "tok"))
            few = apart.where("root <> top")
            if slow or volume <= 4 * total:
                pairs = scratch.save(_short_pairs(few, apart, percent).join(tried, ["a", "b"], "left_anti"))
                before = F.transform(F.filter("zip", lambda z: z["pos"] < F.col("e.p")), lambda z: z["toks"])
                listed = apart.where(F.col("k") > LONG).join(one.select("sid", "bins", F.arrays_zip("toks", "pos").alias("zip")), "sid")
                listed = listed.select("tok", "sid", "root", "top", "k", F.col("e.n").alias("n"), F.col("e.p").cast("bigint").alias("p"), "bins", before.alias("before"))
                cells = scratch.save(_survivors(listed.where("root <> top").drop("top"), listed.drop("top"), percent))
                sets = sets_of(cells.select("sid").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("sid"))))
                found = verified(pairs, sets).unionByName(_links_of_cells(cells, sets, percent))
                roots = _joined(roots, scratch.save(found.distinct()), scratch)
                break
        # hubs of a list: the set with the fewest n-grams rarer than it (the most central of near copies), and one by hash
        central, other = F.struct("e.p", F.xxhash64("sid"), "e", "root"), F.struct(F.xxhash64("sid", F.lit(turn)), "e", "root")
        hubs = scratch.save(few.groupBy("tok").agg(F.min(central).alias("lo"), F.min(other).alias("hi")))
        hubs = hubs.select("tok", *(F.struct(F.col(f"{c}.e").alias("e"), F.col(f"{c}.root").alias("root")).alias(c) for c in ("lo", "hi")))
        met = apart.select("tok", "root", F.col("e").alias("u")).join(hubs, "tok").select("root", "u", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("hub"))
        pairs = _pairs(met.where("root <> hub.root").select("u", F.col("hub.e").alias("v")), percent)
        pairs = scratch.save(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = verified(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("sid"))))
        slow = found.count() < PROGRESS * few.select("sid").distinct().count()
        roots = _joined(roots, found, scratch)
    named = scratch.save(reps.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    lowest = scratch.save(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("classes")))
    named = scratch.save(named.join(lowest, "root"))
    out = ["doc_id", "n_shingles", "component_id", "class_id"]
    if links:
        members = named.where("classes > 1").select("root", "sid", "copies")
        near = scratch.save(_count_links(members, sets_of(members), percent))
        named = scratch.save(named.join(near, "sid", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("near", F.lit(0))))
        out.append("n_links")
    if key is not None:
        out += ["row_key", "group_key"]
    alone = rows.where("sid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), "row_key", F.lit(None).cast("bigint").alias("group_key"))
    joined = rows.where("sid is not null").join(named, "sid", "left").withColumnsRenamed({"n": "n_shingles", "rep": "class_id", "root": "group_key"})
    return scratch.save(alone.select(*out).unionByName(joined.select(*out)))
