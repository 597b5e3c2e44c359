"""Which leads are delivered: qualification, de-duplication in order, exactly N, final order, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import listings as L
from .accept import accepted, in_turn
from .history import identity_list
from .rank import median, ranked
from .tables import cut


def qualifies(keep_incomplete: bool = False, require_email: bool = False, require_phone: bool = False, complete: bool = False, website: str = "any") -> Column:
    """The predicate on phone, email, address and website."""
    email, phone, address, site = (F.col(c) != "" for c in ("email", "phone", "address", "website"))
    ok = F.lit(True) if keep_incomplete else phone | email
    for wanted, test in ((require_email, email), (require_phone, phone), (complete, email & phone & address), (website == "yes", site), (website == "no", ~site)):
        if wanted:
            ok = ok & test
    return ok


def first_of_each(ids: DataFrame) -> DataFrame:
    """seq that are accepted when rows (seq, field, value) are taken in order and a row goes if an accepted one shares a value."""
    ids = ids.select(F.lit(0).alias("cat"), "seq", "field", "value")
    return accepted(ids, ids, None).select("seq")


def accept(leads: DataFrame, n: int | None, categories: list[str] | None = None) -> DataFrame:
    """Qualifying leads in the order of seq: no two of a run share an identity, N for each category, categories in order.

    Without categories there is one order and one N for all leads; with them, leads of other categories are left out, and seq
    need only be unique within a category.
    """
    return accept_and_learn(leads.withColumn("known", F.lit(False)), n, categories)[0]


def accept_and_learn(leads: DataFrame, n: int | None, categories: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The same where leads may be `known` from an earlier run (F4 with G4): the accepted leads, and those that the history learns
    from. A known lead with an email adds all its identities to what is known to the rows after it, and so does one that meets
    those, but none that an accepted lead shares an identity with, nor any behind the N-th accepted one of its category."""
    if categories is None:
        placed = leads.withColumn("cat", F.lit(0))
    else:
        order = leads.sparkSession.createDataFrame(list({c: i for i, c in reversed(list(enumerate(categories)))}.items()), "category string, cat int")
        placed = leads.join(order, "category")
    slim = cut(placed.select("cat", "seq", "known", (F.col("email") != "").alias("mail"), identity_list().alias("ids")))
    ids = slim.select("cat", "seq", F.explode("ids").alias("i")).select("cat", "seq", "i.field", "i.value")
    won = in_turn(slim.select("cat", "seq", "known", "mail"), ids, n)
    columns = [c for c in leads.columns if c != "known"]
    return tuple(placed.join(won.where(which), ["cat", "seq"], "left_semi").select(*columns) for which in ("not learned", "learned"))


def top_n(leads: DataFrame, n: int) -> DataFrame:
    """The first N of each category by seq."""
    return leads.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy("seq"))).where(F.col("rank") <= n)


def completeness() -> Column:
    return F.when(F.col("email") != "", 1).otherwise(0) + F.when(F.col("phone") != "", 1).otherwise(0)


def final_order(leads: DataFrame) -> DataFrame:
    """Most complete first, else as they came (F6): sorted, with `position`."""
    return ranked(leads, [-completeness(), F.col("seq")], name="position").orderBy("position")


def export_rows(leads: DataFrame) -> DataFrame:
    """The six columns of an export, as clean cells."""
    status = F.coalesce(F.nullif("website_status", F.lit("")), L.yes_no(F.col("website")))
    cells = {"Name": F.col("name"), "Phone": F.col("phone_display"), "Email": F.coalesce(F.nullif("email", F.lit("")), "email_note"), "Address": F.col("address"), "Website Present": status, "Website": F.col("website")}
    return leads.select(*(L.clip(v).alias(k) for k, v in cells.items()))


def export(leads: DataFrame, folder: str, *label: str, fmt: str = "csv") -> str:
    """Writes under a path of the run's own; an earlier export is never overwritten."""
    name = leads.sparkSession.range(1).select(L.safe_filename(*(F.lit(x) for x in label))).first()[0]
    path = f"{folder}/{name}"
    writer = export_rows(final_order(leads)).write.mode("errorifexists")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
    return path


def summary(leads: DataFrame) -> DataFrame:
    """One row of counts."""
    n = lambda c: F.count_if(c)
    email, phone, site = (F.col(c) != "" for c in ("email", "phone", "website"))
    return leads.agg(
        F.count(F.lit(1)).alias("total"), n(email).alias("with_email"), n(phone).alias("with_phone"), n(site).alias("with_website"), n(~site).alias("no_website"),
        n(F.col("email_note") == "Not found on website").alias("not_found"), n(F.col("email_note").startswith("No website")).alias("no_website_note"), n(email & phone).alias("email_and_phone"),
    )


def run_report(leads: DataFrame, accepted: DataFrame, skipped: DataFrame, requested: int) -> DataFrame:
    """Per category: accepted, skipped, requested, shortfall, sources, share with an email (E5)."""
    sources = leads.select("category", F.explode(F.split("source", r" \+ ")).alias("s")).groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("s")), ", ").alias("sources"))
    got = accepted.groupBy("category").agg(F.count(F.lit(1)).alias("accepted"), F.count_if(F.col("email") != "").alias("with_email"))
    lost = skipped.groupBy("category").agg(F.count(F.lit(1)).alias("skipped"))
    out = sources.join(got, "category", "left").join(lost, "category", "left").na.fill(0, ["accepted", "with_email", "skipped"])
    short = F.greatest(F.lit(0), F.lit(requested) - F.col("accepted"))
    tip = (F.col("accepted") > 0) & (F.col("with_email") < 0.7 * F.col("accepted"))
    return out.select("category", "accepted", "skipped", F.lit(requested).cast("bigint").alias("requested"), short.cast("bigint").alias("shortfall"), "sources", tip.alias("few_emails"))


def city_centre(leads: DataFrame) -> DataFrame:
    """Median lat and lon over distinct listings, if there are 3 of them."""
    rows = leads.where("place_id <> '' and lat is not null and lon is not null").groupBy("place_id").agg(F.min_by(F.struct("lat", "lon"), "seq").alias("p"))
    rows = rows.select("p.lat", "p.lon")
    counted = rows.agg(F.count(F.lit(1)).alias("listings")).where("listings >= 3")
    return counted.crossJoin(median(rows, "lat")).crossJoin(median(rows, "lon"))  # one row each
