"""Repair of conversations whose turns are faulty, at the least cost and with an account of each edit.

A conversation is sound if the initials of its roles read `(s?(ua)+)?`: perhaps a system turn, then user and assistant in turn.
Rows that are blank, repeated or cut short are faults. The edits are K (keep, 0), R (another role, 1), D (delete, 2; blank and
repeated rows have to go) and I (an empty turn of the role that is due, 5); a row cut short that stays costs 5 more.

Rows become symbols of role and fault, and equal neighbours a run. A symbol's transition is a matrix over the 4 states of the
pattern in (min, +); a run goes through binary powers of it, which are made once. The costs to go at the ends of runs then tell,
row by row, which edits are on a cheapest way; the first in the order D, I, K, R gives the least audit of all.

Rows are sorted over ranges of (conversation, turn, role, text), so a conversation of any size lies over several tasks. It comes
in chunks that end where an Arrow batch ends. Conversations inside a batch are done at once. Of the others, each chunk has one
4 x 4 matrix; the costs at its end follow from the matrices after it, its first state from the chunks before it, and then each
chunk is edited by itself. Only those matrices and states of one conversation meet in a task.

Defined cases: rows are taken by turn, null first, then by role and text; a null role or text is one blank; rows that are the
same in all columns are counted before anything is sorted, and all but the first are repeated ones; rows whose conv_id is null
are one conversation; no rows give no conversation; only the four columns named here are used, whatever else the table holds.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .rounds import partitions
from .scratch import Scratch

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn; and the role that is due in each
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Faults of a row
SOUND, TRUNCATED, REPEATED, BLANK = range(4)
FAR = 1 << 50
#: A symbol is 0 for rows that have to go, else 1 + 2 * initial + cut short; initials are 0 (another), s, u, a as the states
GONE = 0
Vector = tuple[int, ...]
Run = tuple[int, int]
#: Costs to go at the end of a conversation: the pattern must be over.
END: Vector = (0, 2 * INSERT, INSERT, 0)

_TURNS = "array<struct<role:string,text:string>>"
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "gaps")
PIECE = "conv_id bigint, piece bigint, pieces bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + f", cost bigint, audit string, turns {_TURNS}"
_CHUNK = (
    "conv_id bigint, part int, no bigint, edge boolean, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", first_turn bigint, last_turn bigint, "
    f"first_initial int, last_initial int, symbols binary, copies array<bigint>, matrix array<bigint>, cost bigint, audit string, turns {_TURNS}"
)
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])


def _kept(state: int, initial: int) -> int | None:
    """The state after a row that is kept, if the pattern allows it there."""
    return initial if initial and (initial == DUE[state] or (initial == SYSTEM and state == START)) else None


def _times(a: list[Vector], b: list[Vector]) -> list[Vector]:
    return [tuple(min(x + y for x, y in zip(row, col, strict=True)) for col in zip(*b, strict=True)) for row in a]


def _applied(a: list[Vector], v: Vector) -> Vector:
    return tuple(min(FAR, *(x + y for x, y in zip(row, v, strict=True))) for row in a)


def _inserts() -> list[Vector]:
    """The least cost of inserted turns from state to state."""
    rows = []
    for s in range(4):
        row, at, cost = [FAR] * 4, s, 0
        while cost < row[at]:
            row[at] = cost
            at, cost = DUE[at], cost + INSERT
        rows.append(tuple(row))
    return rows


@functools.cache
def power(symbol: int, k: int) -> list[Vector]:
    """The transition of 2**k rows with a symbol, turns inserted before them included."""
    if k:
        return _times(power(symbol, k - 1), power(symbol, k - 1))
    initial, late = divmod(symbol - 1, 2) if symbol else (0, 0)
    rows = []
    for s in range(4):
        row = [FAR] * 4
        row[s] = DELETE
        if symbol:
            row[DUE[s]] = min(row[DUE[s]], REROLE + CUT_SHORT * late)
            to = _kept(s, initial)
            if to is not None:
                row[to] = min(row[to], KEEP + CUT_SHORT * late)
        rows.append(tuple(row))
    return _times(_inserts(), rows)


def advanced(symbol: int, n: int, v: Vector) -> Vector:
    """Costs to go before a run, from those after it."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            v = _applied(power(symbol, k), v)
    return v


def matrix(runs: tuple[Run, ...]) -> list[Vector]:
    """The transition of all runs."""
    columns = []
    for s in range(4):
        v = tuple(0 if i == s else FAR for i in range(4))
        for symbol, n in reversed(runs):
            v = advanced(symbol, n, v)
        columns.append(v)
    return [tuple(r) for r in zip(*columns, strict=True)]


@functools.lru_cache(1 << 16)
def edits(runs: tuple[Run, ...], state: int, after: Vector, last: bool) -> tuple[str, int, int]:
    """(least audit of a cheapest way through the runs, state after it, cost to go before it)."""
    bounds = [after]
    for symbol, n in reversed(runs):
        bounds.append(advanced(symbol, n, bounds[-1]))
    cost, out = bounds[-1][state], []
    for (symbol, n), v in zip(runs, bounds[-2::-1], strict=True):
        if symbol == GONE:  # a turn that is inserted may as well come later, and D is the first letter
            out.append("D" * n)
            continue
        initial, late = divmod(symbol - 1, 2)
        togo = [v]
        for _ in range(n):
            togo.append(_applied(power(symbol, 0), togo[-1]))
        for here, then in zip(togo[:0:-1], togo[-2::-1], strict=True):
            while True:
                to = _kept(state, initial)
                if here[state] == DELETE + then[state]:
                    out.append("D")
                elif here[state] == INSERT + here[DUE[state]]:
                    out.append("I")
                    state = DUE[state]
                    continue
                elif to is not None and here[state] == KEEP + CUT_SHORT * late + then[to]:
                    out.append("K")
                    state = to
                else:
                    out.append("R")
                    state = DUE[state]
                break
    while last and after[state]:
        out.append("I")
        state = DUE[state]
    return "".join(out), state, cost


def as_runs(symbols: list[int], copies: list[int]) -> tuple[Run, ...]:
    """Runs of the rows' symbols, in which copies of a row follow it as rows that have to go."""
    runs: list[list[int]] = []
    for symbol, n in zip(symbols, copies, strict=True):
        for s, k in ((symbol, 1), (GONE, n - 1)) if symbol else ((GONE, n),):
            if not k:
                continue
            if runs and runs[-1][0] == s:
                runs[-1][1] += k
            else:
                runs.append([s, k])
    return tuple((s, k) for s, k in runs)


def repaired(audit: str, symbols: list[int], copies: list[int], state: int, roles: list[str]) -> tuple[list[str], list[int]]:
    """Role and row (-1: none) of each turn that the audit leaves."""
    out_roles, out_rows = [], []
    letters = iter(audit)
    for i, (symbol, n) in enumerate(zip(symbols, copies, strict=True)):
        for _ in range(n):
            while (letter := next(letters)) == "I":
                state = DUE[state]
                out_roles.append(NAMES[state])
                out_rows.append(-1)
            if letter == "D":
                continue
            if letter == "K":
                state = (symbol - 1) // 2
                out_roles.append(roles[i])
            else:
                state = DUE[state]
                out_roles.append(NAMES[state])
            out_rows.append(i)
    for _ in letters:
        state = DUE[state]
        out_roles.append(NAMES[state])
        out_rows.append(-1)
    return out_roles, out_rows


def _turns(sizes: list[int], roles: list[str], rows: list[int], texts: pa.Array) -> pa.Array:
    """Arrow lists of turns; rows are places in texts, -1 is an empty text."""
    at = pa.array([None if r < 0 else r for r in rows], pa.int64())
    text = texts.take(at).fill_null("")
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(roles, pa.string()), text.cast(pa.string())], fields=list(_TURN)))


def faults(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, fault and initial of the distinct rows."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", F.sha2("text", 256))
    place = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    seen = F.coalesce(F.col("first") < place, F.lit(False))
    ends = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(ends == "", BLANK).when(seen, REPEATED).when(~ends.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    initial = F.substring("role", 1, 1)
    initial = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    return rows.select("conv_id", "turn", "role", "text", "copies", fault.cast("int").alias("fault"), initial.cast("int").alias("initial"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of a batch; the first and the last may go on in other batches."""
    part, no = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = lambda c: batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)  # noqa: E731, B023
        conv, unknown = column("conv_id"), batch.column("conv_id").is_null().to_numpy(zero_copy_only=False)
        turn, timed = column("turn"), ~batch.column("turn").is_null().to_numpy(zero_copy_only=False)
        copies, fault, initial = column("copies"), column("fault"), column("initial")
        n = batch.num_rows
        new = np.concatenate(([True], (conv[1:] != conv[:-1]) | (unknown[1:] != unknown[:-1])))
        at = np.flatnonzero(new)
        ends = np.append(at[1:], n)
        total = lambda x: np.add.reduceat(x.astype(np.int64), at)  # noqa: E731, B023
        legal = np.isin(initial[:-1] * 4 + initial[1:], (SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER))
        broken = copies - 1
        broken[1:] += ~(legal | new[1:])
        fresh = timed.copy()
        fresh[1:] &= new[1:] | ~timed[:-1] | (turn[1:] != turn[:-1])
        earliest = np.minimum.reduceat(np.where(timed, turn, np.iinfo(np.int64).max), at)
        some = total(timed) > 0
        latest = turn[ends - 1]  # null turns come first
        gaps = np.where(some, latest - earliest + 1 - total(fresh), 0)
        symbol = np.where(fault >= REPEATED, GONE, 1 + 2 * initial + (fault == TRUNCATED)).astype(np.uint8)
        counts = {"blank": total(copies * (fault == BLANK)), "duplicate": total((fault == REPEATED) + (copies - 1) * (fault != BLANK)), "truncated": total(fault == TRUNCATED), "illegal": total(broken), "gaps": gaps}
        edge = np.zeros(len(at), bool)
        edge[[0, -1]] = True
        role = batch.column("role").to_pylist()
        matrices, costs, audits, sizes, roles, rows = [], [], [], [], [], []
        kept_symbols, kept_copies = [], []
        for a, b, open_ in zip(at.tolist(), ends.tolist(), edge.tolist(), strict=True):
            s, k = symbol[a:b].tolist(), copies[a:b].tolist()
            runs = as_runs(s, k)
            kept_symbols.append(bytes(s) if open_ else None)
            kept_copies.append(k if open_ else None)
            if open_:
                matrices.append([x for r in matrix(runs) for x in r])
                costs.append(0)
                audits.append(None)
                sizes.append(b - a)
                roles += role[a:b]
                rows += range(a, b)
                continue
            audit, _, cost = edits(runs, START, END, True)
            made, where = repaired(audit, s, k, START, role[a:b])
            matrices.append(None)
            costs.append(cost)
            audits.append(audit)
            sizes.append(len(made))
            roles += made
            rows += [r if r < 0 else a + r for r in where]
        made = {
            "conv_id": batch.column("conv_id").take(pa.array(at)), "part": pa.array(np.full(len(at), part, np.int32)), "no": pa.array(no + np.arange(len(at))), "edge": pa.array(edge),
            **{c: pa.array(v.astype(np.int64)) for c, v in counts.items()}, "first_turn": pa.array(earliest, mask=~some), "last_turn": pa.array(latest, mask=~some),
            "first_initial": pa.array(initial[at].astype(np.int32)), "last_initial": pa.array(initial[ends - 1].astype(np.int32)), "symbols": pa.array(kept_symbols, pa.binary()),
            "copies": pa.array(kept_copies, pa.list_(pa.int64())), "matrix": pa.array(matrices, pa.list_(pa.int64())), "cost": pa.array(costs, pa.int64()), "audit": pa.array(audits, pa.string()),
            "turns": _turns(sizes, roles, rows, batch.column("text")),
        }
        no += len(at)
        yield pa.record_batch(list(made.values()), names=list(made))


def _costs_to_go(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk of a conversation, the costs to go after it."""
    rows = rows.sort_values(["part", "no"])
    v, after = END, []
    for m in rows["matrix"].iloc[::-1]:
        after.append(list(v))
        v = _applied([tuple(int(x) for x in m[i : i + 4]) for i in range(0, 16, 4)], v)
    last = np.arange(len(rows)) == len(rows) - 1
    return pd.DataFrame({"part": rows["part"], "no": rows["no"], "after": after[::-1], "last": last})


def _ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """State after a chunk, and cost to go before it, for each state before it."""
    for df in batches:
        found = [[edits(as_runs(list(s), [int(x) for x in k]), state, tuple(int(x) for x in v), bool(last)) for state in range(4)] for s, k, v, last in zip(df["symbols"], df["copies"], df["after"], df["last"], strict=True)]
        df = df.drop(columns=["symbols", "copies"])
        yield df.assign(to=[[x[1] for x in f] for f in found], togo=[[x[2] for x in f] for f in found])


def _entered(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk of a conversation: its number, the state before it, and what its counts get from the chunk before it."""
    rows = rows.sort_values(["part", "no"]).reset_index(drop=True)
    state, states = START, []
    for to in rows["to"]:
        states.append(state)
        state = int(to[state])
    illegal, gaps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    before = rows["last_turn"].shift()
    for i in range(1, len(rows)):
        a, b = int(rows["last_initial"][i - 1]), int(rows["first_initial"][i])
        illegal[i] = (a, b) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
        x, y = before[i], rows["first_turn"][i]
        if not pd.isna(x) and not pd.isna(y):
            gaps[i] = int(y) - int(x) - (int(y) != int(x))
    cost = np.zeros(len(rows), np.int64)
    cost[0] = int(rows["togo"][0][START])
    return pd.DataFrame({"part": rows["part"], "no": rows["no"], "after": rows["after"], "last": rows["last"], "piece": np.arange(len(rows)), "pieces": len(rows), "state": states, "more_illegal": illegal, "more_gaps": gaps, "first_cost": cost})


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = batch.column("turns")
        flat, starts = turns.values, turns.offsets.to_pylist()
        roles, texts = flat.field("role").to_pylist(), flat.field("text")
        audits, sizes, out_roles, out_rows = [], [], [], []
        for i, (symbols, copies, state, after, last) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("symbols", "copies", "state", "after", "last")), strict=True)):
            audit, _, _ = edits(as_runs(list(symbols), copies), state, tuple(after), last)
            made, where = repaired(audit, list(symbols), copies, state, roles[starts[i] : starts[i + 1]])
            audits.append(audit)
            sizes.append(len(made))
            out_roles += made
            out_rows += [r if r < 0 else starts[i] + r for r in where]
        kept = ["conv_id", "piece", "pieces", *_COUNTS, "cost"]
        yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(audits, pa.string()), _turns(sizes, out_roles, out_rows, texts)], names=[*kept, "audit", "turns"])


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, piece, pieces, blank, duplicate, truncated, illegal, gaps, cost, audit and turns of conversations (conv_id, turn,
    role, text): a row for each, or some pieces of a long one, whose counts add up and whose audits and turns follow each other."""
    scratch, n = Scratch(conversations.sparkSession), partitions(conversations)
    rows = faults(conversations).withColumn("head", F.substring("text", 1, 32))  # texts would be too large for samples of ranges
    rows = rows.repartitionByRange(n, "conv_id", "turn", "role", "head").sortWithinPartitions("conv_id", "turn", "role", "text").drop("head")
    chunks = scratch.save(rows.mapInArrow(_chunks, _CHUNK))
    whole = chunks.where("not edge").select("conv_id", F.lit(0).cast("bigint").alias("piece"), F.lit(1).cast("bigint").alias("pieces"), *_COUNTS, "cost", "audit", "turns")
    edge = chunks.where("edge")
    after = edge.select("conv_id", "part", "no", "matrix").groupBy("conv_id").applyInPandas(_costs_to_go, "part int, no bigint, after array<bigint>, last boolean")
    seams = ["conv_id", "part", "no", "first_turn", "last_turn", "first_initial", "last_initial"]
    ways = edge.select(*seams, "symbols", "copies").join(after, ["part", "no"]).select(*seams, "symbols", "copies", "after", "last")
    ways = ways.mapInPandas(_ways, "conv_id bigint, part int, no bigint, first_turn bigint, last_turn bigint, first_initial int, last_initial int, after array<bigint>, last boolean, to array<int>, togo array<bigint>")
    entered = ways.groupBy("conv_id").applyInPandas(_entered, "part int, no bigint, after array<bigint>, last boolean, piece bigint, pieces bigint, state int, more_illegal bigint, more_gaps bigint, first_cost bigint")
    ready = edge.drop("cost").join(entered, ["part", "no"]).withColumnRenamed("first_cost", "cost")
    ready = ready.withColumn("illegal", F.col("illegal") + F.col("more_illegal")).withColumn("gaps", F.col("gaps") + F.col("more_gaps"))
    done = ready.select("conv_id", "piece", "pieces", *_COUNTS, "cost", "symbols", "copies", "state", "after", "last", "turns").mapInArrow(_edited, PIECE)
    return whole.unionByName(done)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order become their conversation; only the audit and the state of the hash are kept between them."""
    counts = [*_COUNTS, "cost"]
    sums, audit, digest, lines = [0] * len(counts), [], hashlib.sha256(), False
    for batch in batches:
        for conv, piece, pieces, letters, text, size, *values in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "pieces", "audit", "text", "size", *counts)), strict=True):
            sums = [a + b for a, b in zip(sums, values, strict=True)]
            audit.append(letters)
            if size:
                digest.update((b"\n" if lines else b"") + text.encode())
                lines = True
            if piece == pieces - 1:
                columns = [pa.array([conv], pa.int64()), *(pa.array([v], pa.int64()) for v in sums), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])]
                yield pa.record_batch(columns, names=["conv_id", *counts, "audit", "repaired_sha256"])
                sums, audit, digest, lines = [0] * len(counts), [], hashlib.sha256(), False


def digests(pieces: DataFrame) -> DataFrame:
    """A row for each conversation: its counts, audit, and the SHA-256 of its repaired `role:text` lines."""
    counts = [*_COUNTS, "cost"]
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    one = pieces.where("pieces = 1").select("conv_id", *counts, "audit", F.sha2(text, 256).alias("repaired_sha256"))
    many = pieces.where("pieces > 1").select("conv_id", "piece", "pieces", *counts, "audit", text.alias("text"), F.size("turns").alias("size"))
    many = many.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    schema = "conv_id bigint, " + ", ".join(f"{c} bigint" for c in counts) + ", audit string, repaired_sha256 string"
    return one.unionByName(many.mapInArrow(_folded, schema))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of conversations with faults that hang on the CRC-32 of `conv_id:turn` alone (null: one
    blank): rows that are lost, emptied, robbed of their full stops, doubled, or given to the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def repaired_digests(conversations: DataFrame) -> DataFrame:
    """What the repair of damaged conversations gives, for every conv_id there was."""
    found = digests(repair_conversations(damaged(conversations))).withColumnRenamed("conv_id", "found_id").withColumn("found", F.lit(True))
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in (*_COUNTS, "cost")]
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
