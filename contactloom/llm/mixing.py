"""Mixing of sources to target weights by proportionate-fair scheduling.

A source with weight w of the total W releases its block j at floor(j * W / w) and must have it placed before
ceil((j + 1) * W / w). In each slot the earliest deadline of the released blocks wins, so at any time every source is less
than one block away from its share. The schedule repeats every W slots: that one period, made from the weights alone, is a
table of W rows; blocks are joined to it. Everything on the data is DataFrame functions.

The order of a source's documents is that of md5(doc_id). A running number within a source comes from counts of hash ranges,
so a source with a third of all rows is never sorted in one task.

Defined cases: sources without a weight, and the null source, are a class of their own that shares the weight `rest`; when
a source has no block left, its slots stay empty and the others keep theirs; the last block of a source may be short; ties
of md5 by doc_id; an empty table has an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .scratch import Scratch

BLOCK = 8  # documents
REST = "(rest)"
#: The hot source at a quarter; each of the others an equal share.
WEIGHTS = {"src0": 19, **{f"src{i}": 3 for i in range(1, 20)}, REST: 3}


def turn(weights: dict[str, int] | None = None) -> Column:
    """The period that a mix_slot lies in: the documents of one hold the target weights."""
    return F.floor(F.col("mix_slot") / sum({REST: 1, **(weights or WEIGHTS)}.values())).cast("bigint")


def period(weights: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, number of its block, slot) of one period: earliest deadline first among released blocks."""
    total = sum(weights.values())
    placed, out = dict.fromkeys(weights, 0), []
    for slot in range(total):
        ready = [(-(-(placed[s] + 1) * total // w), w, s) for s, w in weights.items() if placed[s] < w and placed[s] * total // w <= slot]
        _, _, s = min(ready)
        out.append((s, placed[s], slot))
        placed[s] += 1
    return out


def _numbered(docs: DataFrame, scratch: Scratch, columns: list[str], source: Column) -> DataFrame:
    """Adds `mix_class` and `mix_at`, the running number within it, and `mix_key`."""
    rows = docs.select(*columns, source.alias("mix_class"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("mix_key"))
    rows = scratch.save(rows.withColumn("mix_range", F.substring("mix_key", 1, 3)))  # 4096 ranges
    counts = rows.groupBy("mix_class", "mix_range").agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.partitionBy("mix_class").orderBy("mix_range")) - F.col("k")
    counts = counts.select("mix_class", "mix_range", before.alias("before"))  # 4096 rows for each source at most
    place = F.row_number().over(Window.partitionBy("mix_class", "mix_range").orderBy("mix_key", "doc_id")) - 1
    return rows.withColumn("place", place).join(counts, ["mix_class", "mix_range"]).withColumn("mix_at", F.col("before") + F.col("place")).drop("mix_range", "before", "place")


def schedule(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The kept columns of docs and mix_class, mix_block, mix_release, mix_deadline, mix_slot and mix_position of every row."""
    weights = dict(weights or WEIGHTS)
    weights.setdefault(REST, 1)
    spark: SparkSession = docs.sparkSession
    total = sum(weights.values())
    named = F.when(F.col("source").isin([s for s in weights if s != REST]), F.col("source")).otherwise(F.lit(REST))
    rows = _numbered(docs, Scratch(spark), list(keep), named)
    slots = spark.createDataFrame([(s, weights[s], j, slot) for s, j, slot in period(weights)], "mix_class string, w int, j int, slot int")
    shares = spark.createDataFrame(list(weights.items()), "mix_class string, w int")
    rows = rows.join(F.broadcast(shares), "mix_class").withColumn("mix_block", F.floor(F.col("mix_at") / block))
    rows = rows.withColumn("j", (F.col("mix_block") % F.col("w")).cast("int")).drop("w").join(F.broadcast(slots), ["mix_class", "j"])
    b, w = F.col("mix_block"), F.col("w")
    return rows.select(
        *keep, "mix_class", b.cast("bigint").alias("mix_block"), F.floor(b * total / w).cast("bigint").alias("mix_release"), F.ceil((b + 1) * total / w).cast("bigint").alias("mix_deadline"),
        (F.floor(b / w) * total + F.col("slot")).cast("bigint").alias("mix_slot"), ((F.floor(b / w) * total + F.col("slot")) * block + F.col("mix_at") % block).cast("bigint").alias("mix_position"),
    )


def ordered(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """Every row of docs with all its columns, and its mix_slot and mix_position (in place of columns of these names): in their
    order the target weights hold for as long as every source has blocks; a surplus follows in later periods. No row is left
    out; rows that are equal get places of their own."""
    docs = docs.drop("mix_slot", "mix_position")
    rows = docs.select("doc_id", "source", F.struct(*docs.columns).alias("mix_row"))
    return schedule(rows, weights, block, ("doc_id", "mix_row")).select("mix_row.*", "mix_slot", "mix_position")
