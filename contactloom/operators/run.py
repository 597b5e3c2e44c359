"""One delivery run: listings of several sources become the accepted leads of each category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import listings as L, urls as U
from ..sources import listings as SL
from . import enrich as N, history as Hist, merge as M, select as S
from .tables import cut

#: seq of a run is the position of the category, then the place in it.
PLACE_BITS = 40


def in_turn(leads: DataFrame, categories: list[str]) -> DataFrame:
    """Leads (seq within their category) of the given categories, with seq anew: one order over all categories."""
    order = leads.sparkSession.createDataFrame([(c, i) for i, c in enumerate(dict.fromkeys(categories))], "category string, cat bigint")
    return leads.join(order, "category").withColumn("seq", F.shiftleft("cat", PLACE_BITS) + F.col("seq")).drop("cat")


def keyed(leads: DataFrame) -> DataFrame:
    """Leads with the key that their website, phones and address give them now; of those that share one in a category, the first."""
    leads = leads.withColumn("lead_key", L.lead_key(F.col("name"), F.col("website"), F.col("raw_phones"), F.col("address")))
    first = leads.groupBy("category", "lead_key").agg(F.min("seq").alias("seq")).select("seq")
    return leads.join(first, "seq", "left_semi")


def lead_run(
    sources: list[DataFrame], categories: list[str], history: DataFrame, domains: DataFrame, region: Column, n: int | None,
    sites: DataFrame | None = None, need_email: bool = False, include_seen: bool = False, **rules: bool | str,
) -> tuple[DataFrame, DataFrame]:
    """The accepted leads of a run, N for each category in the order of the categories (W1), and those it learns from again.

    Sources in turn, most complete rows first; websites cleaned; rows of one business merged; what an earlier run delivered
    left out before any site is looked at; contacts from the sites, validated; rows that qualify accepted in order, where a known
    one with an email tells its identities to the rest of the run. What the next run has to know is remembered() of both.
    """
    rows = in_turn(SL.ordered_by_completeness(SL.union_sources(*sources)), categories)
    rows = cut(M.merge_leads(rows.withColumn("website", U.clean_website(F.col("website"))), ("category",)))
    rows = Hist.unseen(keyed(rows), history, need_email, include_seen)
    if sites is not None:
        rows = N.with_site_contacts(rows, sites)
    done = cut(N.finalize(rows, region, domains).where(S.qualifies(require_email=need_email, **rules)))
    return S.accept_and_learn(Hist.marked(done, history, need_email, include_seen), n, categories)


def remembered(accepted: DataFrame, learned: DataFrame, history: DataFrame) -> DataFrame:
    """field, value that a run adds to the history."""
    return Hist.to_remember(accepted.unionByName(learned), history)
