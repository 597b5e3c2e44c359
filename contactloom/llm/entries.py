"""The registered queries of this subpackage, each over its whole table, and their DuckDB statements where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe
from .conversations import repaired_digests
from .lang_id import identify
from .mixing import schedule
from .multi_index import nearest
from .ngram_jaccard import ngram_jaccard_join
from .oracle import ORACLE  # noqa: F401 (the entry module takes it from here)
from .packing import pack_documents
from .periodic import periodic_runs
from .records import read_records, write_records
from .scratch import Scratch
from .sharding import shard_documents
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .topk import exact_top_k

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), links=True)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans", "kept")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op8_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark).path()
    write_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_records(spark, folder).drop("ids")


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_digests(table(spark, sf_dir, "conversations"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs; from a place on, a tenth of the texts repeats its own words with a period. Place and period hang
    on the CRC-32 of doc_id; a text whose doc_id is null stays as it is."""
    words, h = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("bigint")

    def repeated(w):  # w is bound once: no word is looked for again
        n = F.size(w).cast("bigint")
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = F.floor((n - a) / (3 + g % 8)).cast("bigint") + 1
        tail = F.transform(F.sequence(F.lit(0).cast("bigint"), n - a - 1), lambda i: F.get(w, (a + i % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")).otherwise(F.lit(""))

    made = F.get(F.transform(F.array(words), repeated), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
    length = -F.col("best.shorter")
    exponent = F.floor(1000 * length / F.col("best.period")).cast("bigint")
    return found.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard, op2_substring_dedup, op3_suffix_dedup, op4_packing, op5_sharding, op6_mixing, op7_exact_top_k, op8_lang_id, op9_records, op10_multi_index,
        op11_conversation_repair, op12_periodic_runs, op13_byte_bpe,
    )
}
