"""What was delivered before: identities, anti-joins, what to remember."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import listings as L


def identity_list() -> Column:
    """Array of (field, value) of a lead."""
    return L.identities(*(F.col(c) for c in ("place_id", "map_url", "phone", "email", "website", "lead_key")))


def identities(leads: DataFrame) -> DataFrame:
    """seq, field, value of every lead's identities."""
    return leads.select("seq", F.explode(identity_list()).alias("i")).select("seq", "i.field", "i.value")


def known(leads: DataFrame, history: DataFrame, need_email: bool = False) -> DataFrame:
    """seq of the leads that the history holds (D3, G3): equi-joins on (field, value) only."""
    ids = identities(leads)
    if need_email:
        ids = ids.withColumn("field", F.when(F.col("field") == "emails", F.col("field")).otherwise(F.concat(F.lit("e_"), F.col("field"))))
    return ids.join(history.select("field", "value"), ["field", "value"], "left_semi").select("seq").distinct()


def unseen(leads: DataFrame, history: DataFrame, need_email: bool = False, include_seen: bool = False) -> DataFrame:
    return leads if include_seen else leads.join(known(leads, history, need_email), "seq", "left_anti")


def marked(leads: DataFrame, history: DataFrame, need_email: bool = False, include_seen: bool = False) -> DataFrame:
    """Leads with `known`: whether the history holds them."""
    if include_seen:
        return leads.withColumn("known", F.lit(False))
    held = known(leads, history, need_email).withColumn("known", F.lit(True))
    return leads.join(held, "seq", "left").na.fill(False, ["known"])


def skip_listings(listings: DataFrame, history: DataFrame, need_email: bool = False) -> DataFrame:
    """Listings that need no further work go (C4)."""
    ids = history.where(F.col("field") == ("e_ids" if need_email else "ids")).select(F.col("value").alias("place_id"))
    return listings.join(ids, "place_id", "left_anti")


def to_remember(leads: DataFrame, history: DataFrame) -> DataFrame:
    """field, value that delivered leads add, e_* too for those with an email."""
    ids = identities(leads).join(leads.select("seq", "email"), "seq")
    twins = ids.where("email <> '' and field <> 'emails'").withColumn("field", F.concat(F.lit("e_"), "field"))
    return ids.unionByName(twins).select("field", "value").distinct().join(history, ["field", "value"], "left_anti")


def union_history(*parts: DataFrame) -> DataFrame:
    """Set union."""
    out = parts[0].select("field", "value")
    for p in parts[1:]:
        out = out.unionByName(p.select("field", "value"))
    return out.distinct()
