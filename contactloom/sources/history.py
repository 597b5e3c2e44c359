"""The history of delivered leads: rows (field, value, run_id), a set for each field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import urls as U
from .commits import Commits

FIELDS = ("ids", "phones", "emails", "keys", "e_ids", "e_phones", "e_keys")
SCHEMA = "field string, value string, run_id string"


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, distinct, and rows that are set aside for their shape (A5)."""
    rows = Commits(spark, path).read("history", SCHEMA + ", updated timestamp")
    good = F.col("field").isin(*FIELDS) & F.coalesce(F.col("value") != "", F.lit(False))
    return rows.where(good).select("field", "value").distinct(), rows.where(~F.coalesce(good, F.lit(False)))


def read_legacy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same from files that hold a JSON object of arrays of strings (ids, phones, …) each. Files of another shape are set
    aside as (path, value), their text as it was: a field that is there has to be an array, and each of its elements a string."""
    files = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("path"))
    # as variants values keep their types, which a schema of strings would not
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.try_variant_get("j", f"$.{f}", "variant").alias("v")) for f in FIELDS))
    raw = files.withColumn("j", F.try_parse_json("value")).withColumn("fields", F.when(F.schema_of_variant("j").startswith("OBJECT"), fields))
    kind = lambda f: F.schema_of_variant(f["v"])
    sound = F.forall("fields", lambda f: f["v"].isNull() | kind(f).isin("ARRAY<STRING>", "ARRAY<VOID>"))
    listed = F.transform("fields", lambda f: F.struct(f["field"].alias("field"), F.coalesce(F.try_variant_get(f["v"], "$", "array<string>"), F.array().cast("array<string>")).alias("values")))
    whole = F.forall(listed, lambda f: F.forall(f["values"], lambda v: v.isNotNull()))  # null is no string
    raw = raw.withColumn("good", F.coalesce(sound & whole, F.lit(False)))
    pairs = F.flatten(F.transform(listed, lambda f: F.transform(f["values"], lambda v: F.struct(f["field"].alias("field"), v.alias("value")))))
    good = raw.where("good").select(F.explode(pairs).alias("p")).select("p.field", "p.value")
    return good.where("value <> ''").distinct(), raw.where("not good").select("path", "value")


def migrate(history: DataFrame) -> DataFrame:
    """Old histories lack e_*: keys whose host is the site of a recorded email become e_keys (D7, by suffixes: equi-joins)."""
    domains = history.where("field = 'emails'").select(F.regexp_extract("value", "@(.*)$", 1).alias("d")).where("d <> ''").distinct()
    keys = history.where("field = 'keys'").select(F.col("value").alias("key"), F.regexp_extract("value", r"^([^|]*)\|", 1).alias("host")).where("host <> ''")
    up = keys.select("key", F.explode(U.suffixes(F.col("host"))).alias("d")).join(domains, "d", "left_semi").select("key")
    down = domains.select(F.explode(U.suffixes(F.col("d"))).alias("host")).distinct()
    down = keys.join(down, "host", "left_semi").select("key")
    found = up.union(down).distinct().select(F.lit("e_keys").alias("field"), F.col("key").alias("value"))
    new = history.where("field = 'e_ids'").limit(1).count() == 0
    return history.unionByName(found).distinct() if new else history


def save_history(new: DataFrame, path: str, run_id: str) -> None:
    """Adds a run's identities in one commit; saving a run again replaces that run only."""
    rows = new.select("field", "value").distinct().select("field", "value", F.lit(run_id).alias("run_id"), F.current_timestamp().alias("updated"))
    Commits(new.sparkSession, path).commit(run_id, {"history": rows})


def reset_history(spark: SparkSession, path: str) -> None:
    """Forgets everything."""
    Commits(spark, path).reset()


def save_bucketed(history: DataFrame, table: str, buckets: int) -> DataFrame:
    """The history as a table in buckets by (field, value): joins to it move the leads' identities only, not the history."""
    rows = history.select("field", "value").distinct().repartition(buckets, "field", "value")
    rows.write.bucketBy(buckets, "field", "value").sortBy("field", "value").mode("overwrite").saveAsTable(table)
    return history.sparkSession.table(table)
