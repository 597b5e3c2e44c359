"""The first-accepted rule with N for each category, as one fixpoint over all categories.

Rows have a place: the position of their category, then seq. Taken one by one in that order, a row is accepted if it shares no
(field, value) with an accepted row and its category has fewer than N so far. Neither a row that goes nor one beyond N blocks
another. That is a chain of decisions by its nature; here it is a table of verdicts that grows round by round:

- A row is *clear* when no row before it can take one of its values any more. Whether a clear row is accepted is for the count
  of its category alone to say.
- For each category two places bound that count. At or before the N-th row that isn't out yet, every clear row is accepted.
  Behind the N-th clear row every row is out, decided or not. So with small N nearly all rows go in the first round.
- A clear row takes its values from later rows of its own category whether it is within N or not, as these come after it in the
  count. From rows of later categories it takes them once it is surely accepted.
- Rows that an earlier run delivered (`known`) are never accepted, but those with an email (`mail`) are learned in their turn, unless
  they share a value with an accepted row: then all their values are known from there on. So is a row learned that meets a value
  learned before it; one without an email just goes. A learned row hides later ones as a clear one does, and counts for nothing.

A round is two steps of this over whole tables (aggregations of minima, however many rows share a value). What is still open then
hangs together in chains; connected components gather them, and each component of bounded size is decided in order, in a task
of its own. Larger ones go on in steps.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .graph import components
from .tables import cut

#: Identities of a component that one task decides.
COMPONENT_LINKS = 200_000
OPEN, CLEAR, OUT, LEARNED = 0, 1, 2, 3
_ROW = ["cat", "seq"]
_FLAGS = ["known", "mail"]


def _bounds(rows: DataFrame, n: int) -> DataFrame:
    """cat, sure, most: seq of the N-th row that may be accepted and of the N-th clear row of each category that has so many."""

    def nth(part: DataFrame, name: str) -> DataFrame:
        ranked = part.select(*_ROW).withColumn("rank", F.row_number().over(Window.partitionBy("cat").orderBy("seq"))).where(F.col("rank") <= n)
        return ranked.groupBy("cat").agg(F.max("seq").alias(name), F.count(F.lit(1)).alias("k")).where(F.col("k") == n).drop("k")

    return nth(rows.where(~F.col("known") & (F.col("status") != LEARNED)), "sure").join(nth(rows.where(F.col("status") == CLEAR), "most"), "cat", "full")


def _bounded(rows: DataFrame, n: int | None) -> DataFrame:
    """Rows that may still be accepted, with `sure`: the row is within N if it is clear."""
    if n is None:
        return rows.select(*_ROW, *_FLAGS, "status", F.lit(True).alias("sure"))
    marked = rows.drop("sure").join(_bounds(rows, n), "cat", "left")
    kept = marked.where(F.col("most").isNull() | (F.col("seq") <= F.col("most")))
    return kept.select(*_ROW, *_FLAGS, "status", (F.col("sure").isNull() | (F.col("seq") <= F.col("sure"))).alias("sure"))


def _step(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Verdicts of one step: rows that aren't out, with their new status."""
    place = F.struct(*_ROW)
    held = links.join(rows, _ROW)
    is_open, clear, learned = (F.col("status") == k for k in (OPEN, CLEAR, LEARNED))
    low = held.groupBy("field", "value").agg(
        F.min(F.when(is_open, place)).alias("open"), F.min(F.when(~is_open & ~F.col("sure"), F.col("cat"))).alias("unsure"),
        F.min(F.when(clear & F.col("sure"), place)).alias("taken"), F.min(F.when(learned & F.col("sure"), place)).alias("told"),
    )
    own = held.where(~is_open).groupBy("field", "value", "cat").agg(F.min(F.when(clear, F.col("seq"))).alias("own"), F.min(F.when(learned, F.col("seq"))).alias("own_told"))
    asked = held.where(is_open).join(low, ["field", "value"]).join(own, ["field", "value", "cat"], "left")
    before = lambda c, here: F.coalesce(F.col(c) < here, F.lit(False))
    lost, heard = (before(c, place) | before(o, F.col("seq")) for c, o in (("taken", "own"), ("told", "own_told")))
    verdict = asked.groupBy(*_ROW).agg(F.max(lost).alias("lost"), F.max(heard).alias("heard"), F.max(before("open", place) | before("unsure", F.col("cat"))).alias("waits"))
    status = F.when(~is_open, F.col("status")).when(F.col("lost").isNull(), CLEAR).when(F.col("lost") | (F.col("heard") & ~F.col("mail")), OUT)
    status = status.when(F.col("waits"), OPEN).when(F.col("heard") | F.col("known"), LEARNED).otherwise(CLEAR)
    out = rows.join(verdict, _ROW, "left").select(*_ROW, *_FLAGS, status.alias("status"), "sure")
    return out.where(F.col("status") != OUT)


def decide(group: pd.DataFrame) -> pd.DataFrame:
    """Verdicts of the open rows of one component (cat, seq, status, sure, field, value; known and mail where rows are learned),
    taken in order; what hangs on a count of another category that isn't settled stays open."""
    group = group.sort_values(["cat", "seq"], kind="stable")
    taken, told, waiting, unsure, out = set(), set(), set(), {}, []
    for (cat, seq), g in group.groupby(["cat", "seq"], sort=False):
        keys = list(zip(g["field"], g["value"], strict=True))
        status, sure = int(g["status"].iloc[0]), bool(g["sure"].iloc[0])
        known, mail = (c in g and bool(g[c].iloc[0]) for c in _FLAGS)
        if status == OPEN:
            lost, heard = (any(k in s or (cat, k) in s for k in keys) for s in (taken, told))
            if lost or (heard and not mail):
                status = OUT
            elif not any(k in waiting or unsure.get(k, cat) < cat for k in keys):
                status = LEARNED if heard or known else CLEAR
            if status != OPEN:
                out.append((cat, seq, status))
        if status in (CLEAR, LEARNED):
            (taken if status == CLEAR else told).update(keys if sure else [(cat, k) for k in keys])
            for k in () if sure else keys:
                unsure.setdefault(k, cat)
        elif status == OPEN:
            waiting.update(keys)
    return pd.DataFrame(out, columns=["cat", "seq", "status"])


def _decided(rows: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """Verdicts on the open rows whose component is small enough for a task."""
    held = links.join(rows, _ROW)
    asked = held.where(F.col("status") == OPEN).select("field", "value").distinct()
    held = cut(held.join(asked, ["field", "value"], "left_semi").select(F.struct(*_ROW).alias("row"), *_ROW, *_FLAGS, "status", "sure", "field", "value"))
    low = held.groupBy("field", "value").agg(F.min("row").alias("low"))
    roots = components(held.join(low, ["field", "value"]).select(F.col("low").alias("a"), F.col("row").alias("b")))
    held = held.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    small = held.groupBy("root").count().where(F.col("count") <= most).select("root")
    return held.join(small, "root", "left_semi").drop("row").groupBy("root").applyInPandas(decide, "cat int, seq bigint, status int")


def in_turn(rows: DataFrame, ids: DataFrame, n: int | None, most: int = COMPONENT_LINKS, told: list | None = None) -> DataFrame:
    """cat, seq and `learned` of the accepted and the learned ones of rows (cat, seq, known, mail), whose identities are ids (cat,
    seq, field, value). What is behind the N-th accepted row of a category is neither.

    most bounds the identities of a component that goes to one task; each round adds the number of open rows to `told`.
    """
    links = cut(ids.select(F.col("cat").cast("int").alias("cat"), F.col("seq").cast("bigint").alias("seq"), "field", "value").distinct())
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in _FLAGS]
    rows = rows.select(F.col("cat").cast("int").alias("cat"), F.col("seq").cast("bigint").alias("seq"), *flags).where("mail or not known").distinct()
    rows = cut(_bounded(rows.withColumns({"status": F.lit(OPEN), "sure": F.lit(False)}), n))
    while True:
        rows = cut(_bounded(_step(rows, links), n))
        rows = cut(_bounded(_step(rows, links), n))
        left = rows.where(F.col("status") == OPEN).count()
        if told is not None:
            told.append(left)
        if not left:
            return rows.where("sure").select(*_ROW, (F.col("status") == LEARNED).alias("learned"))
        links = cut(links.join(rows.select(*_ROW), _ROW, "left_semi"))
        verdicts = _decided(rows, links, most).withColumnRenamed("status", "new")
        rows = rows.join(verdicts, _ROW, "left").select(*_ROW, *_FLAGS, F.coalesce("new", "status").alias("status"), "sure").where(F.col("status") != OUT)
        rows = cut(_bounded(rows, n))


def accepted(rows: DataFrame, ids: DataFrame, n: int | None, most: int = COMPONENT_LINKS, told: list | None = None) -> DataFrame:
    """cat, seq of the accepted ones of rows (cat, seq), none of which an earlier run knows."""
    no = F.lit(False)
    return in_turn(rows.select(*_ROW, no.alias("known"), no.alias("mail")), ids, n, most, told).select(*_ROW)
