"""Places in an order, without a task that holds all rows of a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import cut

#: Bits of monotonically_increasing_id() that number the rows of a partition.
_ROW_BITS = 33


def ranked(df: DataFrame, order: list[Column], scope: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """df with the place (from 1) of each row within its scope; the order has to be total, or ties get places of some order.

    Rows are dealt to ranges of (scope, order) and numbered where they lie. A range's part of a scope starts after the counts of
    the parts before it, which are a row for each range and scope at most: they are summed and joined back.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    dealt = df.select("*", *(c.alias(k) for c, k in zip(order, keys, strict=True)))
    by = [*scope, *keys]
    dealt = dealt.repartitionByRange(*by).sortWithinPartitions(*by).drop(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumn("_part", F.shiftright("_at", _ROW_BITS)))
    parts = dealt.groupBy(*scope, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy(*scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    names = [f"_s{i}" for i in range(len(scope))]
    parts = parts.withColumnsRenamed({**dict(zip(scope, names, strict=True)), "_part": "_p"})
    on = F.col("_part") == F.col("_p")
    for c, s in zip(scope, names, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(s))
    return dealt.join(parts, on).withColumn(name, F.col("_at") - F.col("_from") + F.col("_before") + 1).select(*df.columns, name)


def median(df: DataFrame, column: str) -> DataFrame:
    """One row, `column`: the exact median of the values that aren't null, null if there is none. Only the one or two values
    in the middle of the order are looked at together."""
    places = ranked(df.select(column).where(F.col(column).isNotNull()), [F.col(column)])
    n = places.agg(F.count(F.lit(1)).alias("n"))
    middle = places.join(F.broadcast(n), F.col("rank").between(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)))  # one row
    return middle.agg(F.avg(column).alias(column))
