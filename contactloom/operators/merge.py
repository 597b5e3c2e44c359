"""Entity merge: rows of one business become one row, the first seen, with its gaps filled from the later ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import listings as L
from .tables import cut

NEAR = 0.003  # degrees


def with_target(leads: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Adds lead_key and `target`, the seq of the row that each row merges into.

    Merging never leaves a normalised name: the first row of a name takes all rows with its key and those within NEAR of it; a
    row far from it is taken by the first far row with its own key. Rows whose name has no letter or digit only merge by their
    key. First rows are minima that are joined back, so a name that very many rows share is split like any skewed join. Give
    city and category as scope for names that many cities share.
    """
    df = leads.withColumn("nm", L.plain_name(F.col("name"))).withColumn("lead_key", L.lead_key(F.col("name"), F.col("website"), F.col("raw_phones"), F.col("address")))
    df = df.withColumn("nm", F.when(F.col("nm") == "", F.concat(F.lit("|"), "lead_key")).otherwise(F.col("nm")))
    first = df.groupBy(*scope, "nm").agg(F.min_by(F.struct("seq", "lead_key", "lat", "lon", "place_id", "source"), "seq").alias("a0"))
    df = df.join(first, [*scope, "nm"])
    listings = (F.col("a0.place_id") != "") & (F.col("place_id") != "") & (F.col("a0.source") == F.col("source"))
    near = (F.abs(F.col("lat") - F.col("a0.lat")) < NEAR) & (F.abs(F.col("lon") - F.col("a0.lon")) < NEAR)
    df = df.withColumn("near", ~listings & F.coalesce(near, F.lit(False)))
    far = df.where(~F.col("near") & (F.col("lead_key") != F.col("a0.lead_key"))).groupBy(*scope, "nm", "lead_key").agg(F.min("seq").alias("opened"))
    df = df.join(far, [*scope, "nm", "lead_key"], "left")
    target = F.when(F.col("lead_key") == F.col("a0.lead_key"), F.col("a0.seq")).when(F.col("opened") < F.col("seq"), F.col("opened"))
    target = target.when(F.col("near"), F.col("a0.seq")).otherwise(F.col("seq"))
    return df.select(*leads.columns, *(["lead_key"] if "lead_key" not in leads.columns else []), target.alias("target"))


def fill_gaps(targeted: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """One row for each target: its own fields; first non-empty address and website; ordered union of raw contacts, first
    social link per network, sources joined (E2).

    Of each value of a target only its first place is gathered, however many rows hold it.
    """
    gathered = [c for c in ("raw_phones", "raw_emails", "socials") if c in targeted.columns]
    own = [c for c in targeted.columns if c not in ("seq", "target", "address", "website", "source", *gathered, *scope)]
    first_set = lambda c: F.coalesce(F.min_by(F.col(c), F.when(F.col(c) != "", F.col("seq"))), F.lit("")).alias(c)
    merged = targeted.groupBy(*scope, "target").agg(F.min_by(F.struct(*own), "seq").alias("own"), first_set("address"), first_set("website"))

    def held(c: str) -> Column:
        values = F.map_entries(c) if c == "socials" else F.transform(F.array(c) if c == "source" else F.col(c), lambda v: F.struct(v.alias("key"), v.alias("value")))
        return F.transform(values, lambda x, i: F.struct(F.lit(c).alias("kind"), i.alias("pos"), x["key"].alias("key"), x["value"].alias("value")))

    kinds = [*gathered, "source"]
    values = targeted.select(*scope, "target", "seq", F.explode(F.concat(*map(held, kinds))).alias("x")).select(*scope, "target", "seq", "x.*")
    place = F.struct("seq", "pos")
    values = values.groupBy(*scope, "target", "kind", "key").agg(F.min(place).alias("place"), F.min_by("value", place).alias("value"))
    lists = values.groupBy(*scope, "target").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "key", "value"))).alias("all"))
    of = lambda c: F.filter("all", lambda x: x["kind"] == c)
    made = {c: F.transform(of(c), lambda x: x["value"]) for c in kinds}
    made["source"] = F.array_join(made["source"], " + ")
    if "socials" in gathered:
        made["socials"] = F.map_from_entries(F.transform(of("socials"), lambda x: F.struct(x["key"], x["value"])))
    lists = lists.select(*scope, "target", *(v.alias(c) for c, v in made.items()))
    return merged.join(lists, [*scope, "target"]).withColumnRenamed("target", "seq").select("seq", *scope, "own.*", "address", "website", *kinds)


def merge_leads(leads: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return fill_gaps(cut(with_target(leads, scope)), scope)
