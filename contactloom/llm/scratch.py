"""Tables in the folder that all executors share, and connected components over them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.tables import shared_folder


class Scratch:
    """Intermediate tables as Parquet under spark.checkpoint.dir: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.n = 0

    def path(self) -> str:
        self.n += 1
        return f"{self.folder}/{self.n}"

    def save(self, df: DataFrame) -> DataFrame:
        df.write.parquet(path := self.path())
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the given tables, or all."""
        for folder in [t.inputFiles()[0].rpartition("/")[0] for t in tables if t.inputFiles()] or [self.folder]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for every node of edges (a, b) that isn't the smallest of its component; root is the smallest.

    Each round hooks every node to its smallest smaller neighbour, follows the hooks to their ends, and contracts the edges;
    all of it are aggregations with partial sums and joins of two scanned tables, which AQE can split when a node is hot.
    """
    merged = None
    edges = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while edges.count():
        hooks = scratch.save(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = scratch.save(hooks.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            moved = jumped.where("moved").limit(1).count()
            hooks = jumped.select("node", "root")
            if not moved:
                break
        by_a, by_b = (hooks.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
        edges = edges.join(by_a, "a", "left").join(by_b, "b", "left").select(F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y"))
        edges = scratch.save(edges.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if merged is None:
            merged = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            merged = scratch.save(merged.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")).unionByName(hooks))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if merged is None else merged
