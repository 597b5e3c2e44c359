"""Connected components over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b) but the smallest of its component, which is the root of the others.

    In each round nodes hook to their smallest smaller neighbour, follow the hooks to their ends by doubling, and the edges are
    contracted: a path of n nodes takes log n steps. Everything is an aggregation with partial sums or an equi-join.
    """
    merged = None
    tidy = lambda df: cut(df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    edges = tidy(edges.select("a", "b"))
    while edges.limit(1).count():
        hooks = cut(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        moved = True
        while moved:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = cut(hooks.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            moved = bool(jumped.where("moved").limit(1).count())
            hooks = jumped.select("node", "root")
        by_a, by_b = (hooks.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
        edges = tidy(edges.join(by_a, "a", "left").join(by_b, "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
        if merged is None:
            merged = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            merged = cut(merged.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")).unionByName(hooks))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if merged is None else merged
