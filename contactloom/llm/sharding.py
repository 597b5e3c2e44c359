"""Sharding through fixed virtual slots.

Records hash into SLOTS slots by doc_id, size and CRC of the text and, of rows that are equal in these, their number among them:
that is the record's slot for good, in any table and however it is partitioned. Bytes and rows are summed for each slot, and a
slot-to-shard map is made from those sums: heaviest slot first, to the lightest shard. The map is a small versioned table;
rebalancing edits it, so only the records of the slots that were edited move. The number of slots bounds all that reaches the
driver.

Defined cases: a null text has no bytes and counts its row's 16; rows with the same doc_id and other texts are records of their
own; repeated rows, however many, spread over the slots; an empty table has an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .scratch import Scratch

SLOTS = 8192
ROW_BYTES = 16
#: Equal rows that one task numbers.
BLOCK = 1 << 16
_MAP = "version int, vslot int, shard int, bytes bigint, rows bigint"

#: vslot -> (bytes, rows), and vslot -> shard
Sizes = dict[int, tuple[int, int]]
Shards = dict[int, int]


def slot_of(*columns, slots: int = SLOTS):
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def in_slots(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds vslot to rows (doc_id, size, text_crc32). Equal rows are counted first, and numbered from their count."""
    record = ["doc_id", "size", "text_crc32"]
    counted = scratch.save(rows.groupBy(*record).agg(F.count(F.lit(1)).alias("k")))
    few = counted.where(F.col("k") <= BLOCK).withColumn("block", F.lit(0).cast("bigint"))
    many = counted.where(F.col("k") > BLOCK).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("k") - 1) / BLOCK))))
    blocks = few.unionByName(many.repartition(*record, "block"))  # the numbers of one record are made in many tasks
    first = F.col("block") * BLOCK
    numbers = F.explode(F.sequence(first, F.least(first + BLOCK, F.col("k")) - 1))
    return scratch.save(blocks.select(*record, numbers.alias("number")).select(*record, slot_of(*record, "number").alias("vslot")))


def slot_sizes(rows: DataFrame) -> Sizes:
    """Sums for each slot of rows (vslot, size): at most SLOTS of them."""
    return {r[0]: (r[1], r[2]) for r in rows.groupBy("vslot").agg(F.sum("size"), F.count(F.lit(1))).collect()}


def new_map(sizes: Sizes, shards: int, slots: int = SLOTS) -> Shards:
    """Heaviest slot first to the lightest shard; empty slots go round."""
    load = [(0, s) for s in range(shards)]
    out = {v: v % shards for v in range(slots)}
    for v in sorted(sizes, key=lambda v: (-sizes[v][0], v)):
        bytes_, s = heapq.heappop(load)
        out[v] = s
        heapq.heappush(load, (bytes_ + sizes[v][0], s))
    return out


def rebalance(old: Shards, sizes: Sizes, shards: int, slack: float = 0.02) -> Shards:
    """Edits a map until no shard is above the mean by more than slack: slots leave the heaviest shard for the lightest."""
    out = dict(old)
    load = dict.fromkeys(range(shards), 0)
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    homeless = []
    for v, s in old.items():
        size = sizes.get(v, (0, 0))[0]
        if s < shards:
            load[s] += size
            held[s].append((size, v))
        else:
            homeless.append((size, v))
    for size, v in sorted(homeless, reverse=True):
        s = min(load, key=lambda s: (load[s], s))
        out[v], load[s] = s, load[s] + size
        held[s].append((size, v))
    limit = (1 + slack) * sum(load.values()) / shards
    for s in held:
        held[s].sort()
    while True:
        top, low = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[top] - load[low]
        move = next((x for x in reversed(held[top]) if 0 < x[0] < gap), None)
        if load[top] <= limit or move is None:
            return out
        held[top].remove(move)
        held[low].append(move)
        held[low].sort()
        load[top], load[low], out[move[1]] = load[top] - move[0], load[low] + move[0], low


def map_table(spark: SparkSession, versions: list[Shards], sizes: Sizes) -> DataFrame:
    """The versions of a map as a table: one row for each slot and version."""
    rows = [(n + 1, v, s, *sizes.get(v, (0, 0))) for n, m in enumerate(versions) for v, s in sorted(m.items())]
    return spark.createDataFrame(rows, _MAP)


def shard_documents(docs: DataFrame, shards: int = 40, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place within the shard), grown_shard, vslot of every row of docs (doc_id, text).

    The map is written under folder (or the session's scratch folder) as version 1.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = in_slots(rows, scratch)
    sizes = slot_sizes(rows)
    shard_map = new_map(sizes, shards)
    table = map_table(spark, [shard_map], sizes)
    table.coalesce(1).write.partitionBy("version").parquet(f"{folder or scratch.path()}/map")
    first, count = {}, dict.fromkeys(range(shards), 0)
    for v, s in sorted(shard_map.items()):
        first[v] = count[s]
        count[s] += sizes.get(v, (0, 0))[1]
    starts = spark.createDataFrame([(v, s, first[v]) for v, s in shard_map.items()], "vslot int, shard int, first bigint")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("place", place).join(F.broadcast(starts), "vslot")  # SLOTS rows
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")
