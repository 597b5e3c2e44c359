"""A training-corpus pipeline: each stage is one operator over all that the stage before it kept.

Language identification, near duplicates, repeated passages, mixing of sources, packing. run() writes each stage's result as
Parquet in the shared scratch folder and reads it again as the next one's input.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns of any name;
what becomes of them is in its docstring. Extra columns stay as they are until packing, which returns pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from contactloom import ship
from contactloom.llm.lang_id import UNKNOWN, learn, predict
from contactloom.llm.mixing import ordered, turn
from contactloom.llm.ngram_jaccard import ngram_jaccard_join
from contactloom.llm.packing import pack_documents
from contactloom.llm.scratch import Scratch
from contactloom.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _renamed(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with names of our own for all columns but those of documents, and what gives a result of the same columns the old
    names back: operators then see no name that they use themselves."""
    names = [c if c in COLUMNS else f"extra_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda df: df.select(*names).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without text or without a letter, to which no language can be given; all others stay as they are, in
    whatever language, also if there is no labelled row to learn from. Each of repeated rows is judged by itself; a null
    doc_id, lang or source changes nothing."""
    ship(spark)
    named, restored = _renamed(docs)
    others = [c for c in named.columns if c != "doc_id"]
    return restored(predict(named, learn(named), *others).where((F.col("lang_pred") != UNKNOWN) | F.col("lettered")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that with the smallest doc_id (a null one counts as the largest), then
    the smallest hash of its text; of rows with equal doc_id and text one stays. Null, empty and blank texts are near nothing
    and all stay, but for repeated rows."""
    ship(spark)
    named, restored = _renamed(docs)
    copy = F.xxhash64(F.col("text").cast("string"))
    found = Scratch(spark).save(ngram_jaccard_join(named, key=copy))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    best = found.where("group_key is not null").groupBy("group_key").agg(F.min(rank).alias("best"))
    gone = found.join(best, "group_key").where(rank != F.col("best")).select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")).distinct()
    kept = named.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (copy == F.col("gone_key")), "left_anti")
    again = found.groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    if again.limit(1).count():  # the same row more than once: only those rows are gathered
        again = Scratch(spark).save(again.select(F.col("doc_id").alias("again_id"), F.col("row_key").alias("again_key")))
        same = F.col("doc_id").eqNullSafe(F.col("again_id")) & (copy == F.col("again_key"))
        once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return restored(kept)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller doc_id holds as well; a document of which nothing is left goes, and so does
    one without words. A null doc_id counts as the largest; of rows with one doc_id neither is smaller. n_chars follows the
    text; a text from which nothing is cut stays as it was, white space included."""
    ship(spark)
    named, restored = _renamed(docs)
    others = tuple(c for c in named.columns if c not in ("doc_id", "n_chars"))
    cut = substring_dedup(named, others).where("n_words > n_removed")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    made = {"text": text}
    if "n_chars" in named.columns:
        made["n_chars"] = F.length(text).cast(named.schema["n_chars"].dataType)
    return restored(cut.select(*(made[c].alias(c) if c in made else F.col(c) for c in named.columns)))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every document its place in the mix (mix_slot, mix_position), repeated rows too; the surplus of a source comes after
    the periods that all sources fill. The null source and sources without a weight are one class."""
    named, restored = _renamed(docs.drop("mix_slot", "mix_position"))
    mixed = ordered(named)
    names = docs.drop("mix_slot", "mix_position").columns
    return mixed.select(*named.columns, "mix_slot", "mix_position").toDF(*names, "mix_slot", "mix_position")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 tokens in the order of the mix: one period of it after the other, each with the
    target weights, and inside a period along the curve of likeness. Each piece keeps its document's place in the mix. A null or
    empty text is its end id alone; repeated rows are documents of their own; extra columns end here."""
    ship(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("mix_slot", "mix_position"), lead=turn()).drop("ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: SQL has no tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
