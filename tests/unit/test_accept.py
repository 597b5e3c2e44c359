"""The first-accepted rule with N for each category against a loop over the rows."""

import random

import pandas as pd
import pytest

from contactloom.operators import accept
from contactloom.operators.accept import CLEAR, LEARNED, OPEN, OUT, accepted, decide
from contactloom.operators.graph import components


def in_turn(rows, n):
    """rows: {(cat, seq): values}; taken one by one."""
    taken, count, won = set(), {}, set()
    for (cat, seq), values in sorted(rows.items()):
        if count.get(cat, 0) == n or values & taken:
            continue
        taken |= values
        count[cat] = count.get(cat, 0) + 1
        won.add((cat, seq))
    return won


def run(spark, rows, n, **more):
    table = spark.createDataFrame(list(rows), "cat int, seq bigint")
    ids = spark.createDataFrame([(*r, "f", v) for r, values in rows.items() for v in values], "cat int, seq bigint, field string, value string")
    return {tuple(r) for r in accepted(table, ids, n, **more).collect()}


@pytest.mark.parametrize(("seed", "n", "most"), [(0, None, 200_000), (1, 3, 200_000), (2, 9, 200_000), (3, 12, 8)])
def test_as_in_turn(spark, seed, n, most):
    rng = random.Random(seed)
    rows = {(rng.randrange(4), rng.randrange(60)): {str(rng.randrange(60)) for _ in range(rng.randint(0, 3))} for _ in range(120)}
    assert run(spark, rows, n, most=most) == in_turn(rows, n)


def learned_in_turn(rows, n):
    """rows: {(cat, seq): (values, known, mail)}; taken one by one."""
    taken, told, count, out = set(), set(), {}, set()
    for (cat, seq), (values, known, mail) in sorted(rows.items()):
        if count.get(cat, 0) == n or values & taken:
            continue
        if known or values & told:
            if mail:
                told |= values
                out.add((cat, seq, True))
            continue
        taken |= values
        count[cat] = count.get(cat, 0) + 1
        out.add((cat, seq, False))
    return out


@pytest.mark.parametrize(("seed", "n", "most"), [(0, None, 200_000), (1, 3, 200_000), (3, 9, 8), (4, 6, 30)])
def test_learned_as_in_turn(spark, seed, n, most):
    rng = random.Random(seed)
    rows = {}
    for _ in range(150):
        values = {str(rng.randrange(90)) for _ in range(rng.randint(0, 3))}
        rows[rng.randrange(4), rng.randrange(60)] = (values, bool(values) and rng.random() < 0.4, rng.random() < 0.6)
    table = spark.createDataFrame([(*r, known, mail) for r, (_, known, mail) in rows.items()], "cat int, seq bigint, known boolean, mail boolean")
    ids = spark.createDataFrame([(*r, "f", v) for r, (values, *_) in rows.items() for v in values], "cat int, seq bigint, field string, value string")
    want = learned_in_turn(rows, n)
    assert {tuple(r) for r in accept.in_turn(table, ids, n, most=most).collect()} == want
    assert any(learned for *_, learned in want)


def test_a_component_learns_in_turn():
    """A learned row of an unsettled category hides rows of its own category, and keeps those of later ones open."""
    table = [(0, 1, OPEN, True, True, True, "a"), (0, 2, OPEN, True, False, False, "a"), (0, 3, LEARNED, False, True, True, "b"), (0, 4, OPEN, False, False, True, "b"), (1, 1, OPEN, True, False, True, "b"), (1, 2, OPEN, True, False, True, "a")]
    df = pd.DataFrame(table, columns=["cat", "seq", "status", "sure", "known", "mail", "value"]).assign(field="f")
    assert sorted(decide(df).itertuples(index=False, name=None)) == [(0, 1, LEARNED), (0, 2, OUT), (0, 4, LEARNED), (1, 2, LEARNED)]


def test_a_component_is_decided_in_turn():
    """Categories without a settled count keep later categories open, not their own."""
    table = [(0, 1, CLEAR, True, "a"), (0, 2, CLEAR, False, "b"), (0, 3, OPEN, False, "b"), (1, 1, OPEN, False, "b"), (1, 2, OPEN, True, "c"), (2, 1, OPEN, True, "c"), (2, 2, OPEN, True, "a")]
    df = pd.DataFrame(table, columns=["cat", "seq", "status", "sure", "value"]).assign(field="f")
    assert sorted(decide(df).itertuples(index=False, name=None)) == [(0, 3, OUT), (1, 2, CLEAR), (2, 1, OUT), (2, 2, OUT)]


def test_a_row_beyond_n_blocks_no_later_category(spark):
    rows = {(0, i): {f"a{i}"} for i in range(6)} | {(1, 0): {"a5"}, (1, 1): {"a4"}, (1, 2): {"b"}}
    assert run(spark, rows, 5) == in_turn(rows, 5) == {(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (1, 2)}


def test_a_long_chain_takes_few_rounds(spark):
    rows = {(0, i): {str(i), str(i + 1)} for i in range(10_000)}
    told = []
    assert run(spark, rows, None, told=told) == {(0, i) for i in range(0, 10_000, 2)}
    assert len(told) <= 3


def test_a_value_that_all_rows_share(spark):
    rows = {(i % 3, i): {"all", str(i)} for i in range(3000)}
    assert run(spark, rows, 5) == {(0, 0)}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(900, 901), (903, 902), (902, 901), (7, 7)], "a int, b int")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 501)} | {901: 900, 902: 900, 903: 900}
