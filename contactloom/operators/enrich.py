"""Contacts from fetched pages: which pages of a site count, what they hold, and how leads take it over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import emails as E, fixed, html as H, phones as P, urls as U

MAX_PAGES = 8
CONTACT_PAGES = 3
SITE_PHONES = 3


def parsed(pages: DataFrame) -> DataFrame:
    """Adds `page` (text, links, cf) to pages that can hold a contact; html is parsed once."""
    return pages.where(H.worth_parsing(F.col("html"))).withColumn("page", H.parse("html"))


def parsed_homes(homes: DataFrame) -> DataFrame:
    """Adds `page` to all home pages; it is empty for one that can't hold a contact, whose site has a plan all the same."""
    return homes.withColumn("page", H.parse(F.when(H.worth_parsing(F.col("html")), F.col("html"))))


def contact_links(pages: DataFrame, limit: int = CONTACT_PAGES, key: tuple[str, ...] = ("url",)) -> DataFrame:
    """url, link, rank: the best links of a parsed page to contact pages of the same host.

    Pages of one key, which has the url in it, count together.
    """
    links = pages.select(*key, F.explode("page.links").alias("l"))
    links = links.withColumn("link", H.resolve_url("url", "l.href")).where(F.col("link").rlike("^https?://"))
    links = links.where(U.bare_host(F.col("link")) == U.bare_host(F.col("url")))
    blob = F.lower(F.concat_ws(" ", F.regexp_extract("link", "^[a-z]+://[^/?#]*([^?#]*)", 1), "l.text"))
    hints = F.array(*(F.lit(h) for h in fixed.CONTACT_HINTS))
    score = F.array_min(F.filter(F.transform(hints, lambda h, i: F.when(F.contains(blob, h), i)), lambda i: i.isNotNull()))
    scored = links.withColumn("score", score).where("score is not null").where(F.rtrim("link", F.lit("/")) != F.rtrim("url", F.lit("/")))
    best = scored.groupBy(*key, "link").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("score", "link"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit).select(*key, "link", "rank")


def guessed_links(homes: DataFrame, contacts: DataFrame, limit: int | None = None, key: tuple[str, ...] = ("url",)) -> DataFrame:
    """url, link, rank: usual contact paths of a site that no link named."""
    paths = F.array(*(F.lit(p) for p in fixed.GUESS_PATHS[:limit]))
    root = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    guesses = homes.select(*key, F.posexplode(F.transform(paths, lambda p: F.concat(root, p))).alias("rank", "link"))
    return guesses.join(contacts.select(*key, "link"), [*key, "link"], "left_anti").select(*key, "link", (F.col("rank") + 1).alias("rank"))


def page_plan(homes: DataFrame, key: tuple[str, ...] = ("url",)) -> DataFrame:
    """site url, link, kind, ord: the home page, then contact links, then guesses (from parsed home pages, a plan for each key)."""
    contacts = contact_links(homes, key=key)
    home = homes.select(*key, F.col("url").alias("link"), F.lit(0).alias("kind"), F.lit(0).alias("ord"))
    linked = contacts.select(*key, "link", F.lit(1).alias("kind"), F.col("rank").alias("ord"))
    guessed = guessed_links(homes, contacts, key=key).select(*key, "link", F.lit(2).alias("kind"), (F.col("rank") + 100).alias("ord"))
    return home.unionByName(linked).unionByName(guessed)


def planned_pages(plan: DataFrame, fetched: DataFrame) -> DataFrame:
    """The plan's pages that were fetched (url, …), a trailing / ignored."""
    bare = lambda c: F.rtrim(c, F.lit("/"))
    return plan.withColumn("at", bare(F.col("link"))).join(fetched.withColumn("at", bare(F.col("url"))).drop("url"), "at").drop("at")


def different_plans(planned: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """url, link, kind, ord of plans for each key (with the url in it): equal plans of a URL once, different ones side by side."""
    plans = planned.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("link", "kind", "ord"))).alias("plan"))
    return plans.select("url", "plan").distinct().select("url", F.inline("plan"))


def pages_that_count(pages: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """Pages (url, kind, ord, emails) in visit order: a guess counts only while no page before it gave an email."""
    before = Window.partitionBy("url").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    found = F.coalesce(F.sum(F.size("emails")).over(before), F.lit(0))
    kept = pages.withColumn("found", found).where((F.col("kind") < 2) | (F.col("found") == 0)).drop("found")
    return kept.withColumn("visit", F.row_number().over(Window.partitionBy("url").orderBy("ord"))).where(F.col("visit") <= most)


def page_contacts(pages: DataFrame, region: Column, website: Column) -> DataFrame:
    """Adds emails (visible, then embedded ones of the own domain), phones and social links of parsed pages."""
    hidden = E.trusted(E.embedded_emails(H.unescape_unicode("html")), website)
    return pages.withColumn("emails", F.array_distinct(F.concat(E.visible_emails(F.col("page")), hidden))).withColumn("phones", P.page_phones(F.col("page"), region)).withColumn("socials", social_links(F.col("page")))


def social_links(page: Column) -> Column:
    """Array of (network, href): the first profile link of each network."""
    nets = F.create_map(*(F.lit(x) for pair in fixed.SOCIAL_NETWORKS.items() for x in pair))
    made = F.transform(page["links"], lambda l: F.struct(nets[U.bare_host(l["href"])].alias("network"), l["href"].alias("href")))
    path = lambda h: F.regexp_replace(F.regexp_extract(h, "^(?:[A-Za-z]+:)?//[^/?#]*/*([^?#]*)", 1), "/+$", "")
    good = F.filter(made, lambda m: m["network"].isNotNull() & m["href"].contains("//") & (path(m["href"]) != "") & ~path(m["href"]).rlike("^(share|intent)"))
    names = F.array_distinct(F.transform(good, lambda m: m["network"]))
    return F.transform(names, lambda n: F.get(F.filter(good, lambda m: m["network"] == n), F.lit(0)))


def absorb(pages: DataFrame) -> DataFrame:
    """Per site url: ordered distinct emails and phones, first link of each network, over the pages that count."""

    def ordered(c: str) -> Column:
        return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("visit", F.col(c).alias("v")))), lambda x: x["v"]))

    sites = pages.groupBy("url").agg(F.array_distinct(ordered("emails")).alias("emails"), F.array_distinct(ordered("phones")).alias("phones"), ordered("socials").alias("all"))
    nets = F.array_distinct(F.transform("all", lambda s: s["network"]))
    return sites.select("url", "emails", "phones", F.map_from_arrays(nets, F.transform(nets, lambda n: F.get(F.filter("all", lambda s: s["network"] == n), F.lit(0))["href"])).alias("socials"))


def fetch_outcome(attempts: DataFrame) -> DataFrame:
    """Per site (site, pos, status, is_html, robots_blocked): its state and the first candidate that gave a page."""
    page, stop = F.min(F.when(F.col("is_html"), F.col("pos"))), F.min(F.when(F.col("robots_blocked"), F.col("pos")))
    seen = attempts.groupBy("site").agg(page.alias("page"), stop.alias("stop"), F.max(F.col("status").isNotNull()).alias("answered"))
    ok = F.col("page").isNotNull() & (F.col("stop").isNull() | (F.col("page") < F.col("stop")))
    state = F.when(ok, "ok").when(F.col("stop").isNotNull() | F.col("answered"), "blocked").otherwise("down")
    return seen.select("site", state.alias("site_state"), F.when(ok, F.col("page")).alias("pos"))


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """host, pos, prefix, allow from robots files (host, body), for an agent.

    Lines of agents that follow each other head a group. The first group with a name that the agent's contains counts, else the
    first for all agents. Without either, and for a host without a file, everything is allowed.
    """
    lines = files.select("host", F.posexplode(F.split("body", "\\r?\\n|\\r")).alias("pos", "line"))
    parts = F.regexp_replace("line", "#.*$", "")
    key, value = F.lower(F.trim(F.regexp_extract(parts, "^([^:]*):", 1))), F.trim(F.regexp_extract(parts, "^[^:]*:(.*)$", 1))
    lines = lines.select("host", "pos", key.alias("key"), value.alias("value")).where(F.col("key").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("host").orderBy("pos")  # the lines of one file
    head = F.col("key") == "user-agent"
    lines = lines.withColumn("start", (head & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")).cast("int"))
    lines = lines.withColumn("group", F.sum("start").over(order))
    name = F.lower(F.trim(F.regexp_extract("value", "^[^/]*", 0)))
    own = F.min(F.when(head & (name != "*") & (name != "") & F.contains(F.lit(agent.split("/")[0].lower()), name), F.col("group")))
    chosen = lines.groupBy("host").agg(F.coalesce(own, F.min(F.when(head & (name == "*"), F.col("group")))).alias("group"))
    rules = lines.where(~head).join(chosen, ["host", "group"])
    return rules.select("host", "pos", F.col("value").alias("prefix"), ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"))


def allowed(urls: DataFrame, rules: DataFrame, column: str = "url") -> DataFrame:
    """Rows whose URL the rules (host, pos, prefix, allow) of its host allow: the first matching rule decides, no rule allows.

    In a prefix * stands for any characters and a last $ for the end. The rules of a host are one array, as long as its file.
    """
    cut_short = F.col("prefix").endswith("$")
    text = F.when(cut_short, F.substr("prefix", F.lit(1), F.length("prefix") - 1)).otherwise(F.col("prefix"))
    quoted = F.array_join(F.transform(F.split(text, "[*]"), lambda p: F.concat(F.lit("\\Q"), p, F.lit("\\E"))), ".*")
    pattern = F.when(F.col("prefix").rlike("[*$]"), F.concat(F.lit("(?s)^"), quoted, F.when(cut_short, "$").otherwise("")))
    listed = rules.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("pos", "prefix", "allow", pattern.alias("pattern")))).alias("_rules"))
    path = F.regexp_extract(F.col(column), "^[a-z]+://[^/?#]*(.*)$", 1)
    u = urls.withColumn("_path", F.when(path == "", "/").otherwise(path)).join(listed.withColumnRenamed("host", "_host"), U.hostname(F.col(column)) == F.col("_host"), "left")
    hit = F.filter("_rules", lambda r: F.when(r["pattern"].isNotNull(), F.rlike(F.col("_path"), r["pattern"])).otherwise(F.startswith(F.col("_path"), r["prefix"])))
    return u.where(F.coalesce(F.get(hit, F.lit(0))["allow"], F.lit(True))).select(*urls.columns)


def site_contacts(homes: DataFrame, attempts: DataFrame, fetched: DataFrame, rules: DataFrame, region: Column, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """url, emails, phones and socials of every site that could be read (W2), from its home page (site, url, html), the attempts
    at it (site, pos, status, is_html, robots_blocked), pages that were fetched (url, html) and the rules of hosts.

    A page that is planned and not fetched was tried in vain: it counts as a visit, like one that gave nothing. Pages that the
    rules forbid don't count. An address that isn't `wanted` (by default all are) is none: it ends no search.
    """
    readable = fetch_outcome(attempts).where("site_state = 'ok'").select("site")
    homes = parsed_homes(homes.join(readable, "site", "left_semi").select("url", "html"))
    plan = allowed(page_plan(homes), rules, "link").unionByName(homes.select("url", F.col("url").alias("link"), F.lit(0).alias("kind"), F.lit(0).alias("ord"))).distinct()
    pages = planned_pages(plan, fetched.select("url", "html").unionByName(homes.select("url", "html")))
    held = page_contacts(parsed(pages), region, F.col("url"))
    if wanted:
        held = held.withColumn("emails", F.filter("emails", wanted))
    tried = plan.join(held.select("url", "link", "emails", "phones", "socials"), ["url", "link"], "left")
    none = F.array().cast("array<string>")
    return absorb(pages_that_count(tried.withColumn("emails", F.coalesce("emails", none)).withColumn("phones", F.coalesce("phones", none)).withColumn("socials", F.coalesce("socials", F.array().cast("array<struct<network:string,href:string>>")))))


def with_site_contacts(leads: DataFrame, sites: DataFrame) -> DataFrame:
    """Leads take over what their website gave: emails, up to SITE_PHONES phones after their own, missing networks.

    Sites are distinct, so a chain's site is read once; AQE splits the join where many leads share one.
    """
    found = sites.select(F.col("url").alias("website"), F.col("emails").alias("s_emails"), F.col("phones").alias("s_phones"), F.col("socials").alias("s_socials"))
    none = F.array().cast("array<string>")
    joined = leads.join(found.withColumn("visited", F.lit(True)), "website", "left")
    own = F.coalesce("s_socials", F.create_map().cast("map<string,string>"))
    fresh = F.map_filter(own, lambda k, v: ~F.map_contains_key("socials", k))
    out = joined.withColumn("raw_emails", F.array_distinct(F.concat("raw_emails", F.coalesce("s_emails", none)))).withColumn("raw_phones", F.array_distinct(F.concat("raw_phones", F.slice(F.coalesce("s_phones", none), 1, SITE_PHONES))))
    return out.withColumn("socials", F.map_concat("socials", fresh)).select(*leads.columns)


def second_pass(leads: DataFrame) -> DataFrame:
    """Leads with a website to visit and still no address."""
    return leads.where((F.size("raw_emails") == 0) & (U.normalize_url(F.col("website")) != ""))


def gained_emails(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many leads got a first address between two states."""
    joined = before.select("seq", F.size("raw_emails").alias("n0")).join(after.select("seq", F.size("raw_emails").alias("n1")), "seq")
    return joined.agg(F.count_if((F.col("n0") == 0) & (F.col("n1") > 0)).alias("gained"))


def verify_emails(leads: DataFrame, domains: DataFrame, check_domains: bool = True) -> DataFrame:
    """email, other_emails and email_status from raw_emails: cleaned, of domains that aren't invalid, ranked.

    domains (domain, status) is joined once for each distinct address; a domain that isn't in it is unknown.
    """
    ranked = leads.select("seq", "website", F.posexplode(E.clean_all(F.col("raw_emails"))).alias("pos", "e")).withColumn("domain", E.domain_of(F.col("e")))
    ranked = ranked.join(domains, "domain", "left").withColumn("status", F.coalesce("status", F.lit("unknown")) if check_domains else F.lit("unknown")).where("status <> 'invalid'")
    ranked = ranked.withColumn("key", F.struct(E.email_score(F.col("e"), F.col("website")).alias("s"), "pos", "e", "status"))
    best = ranked.groupBy("seq").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    top = F.get("keys", F.lit(0))
    own = F.when(F.col("website") != "", F.when(top["s"]["other"] == 0, fixed.MATCHES_SITE).otherwise("")).otherwise("")
    label = F.concat(F.when(top["status"] == "ok", fixed.STATUS_OK).otherwise(fixed.STATUS_UNKNOWN), own)
    out = leads.drop("email", "other_emails", "email_status").join(best, "seq", "left")
    out = out.withColumn("email", F.coalesce(top["e"], F.lit(""))).withColumn("email_status", F.when(top.isNull(), "").otherwise(label))
    others = F.transform(F.slice("keys", 2, 1 << 20), lambda k: k["e"])
    return out.withColumn("other_emails", F.coalesce(others, F.array().cast("array<string>"))).drop("keys")


def finalize(leads: DataFrame, region: Column, domains: DataFrame, check_domains: bool = True) -> DataFrame:
    """Raw contacts become the delivered ones: best phone, verified email, notes."""
    best = P.first_valid(F.col("raw_phones"), region)
    out = verify_emails(leads, domains, check_domains).withColumn("best", best)
    for c, f in (("phone", "e164"), ("phone_display", "display"), ("phone_type", "type")):
        out = out.withColumn(c, F.coalesce(F.col(f"best.{f}"), F.lit("")))
    out = out.withColumn("email_note", E.why_no_email(F.col("email"), F.col("raw_emails"), F.col("website"), F.col("site_state")))
    return out.withColumn("website_status", F.when(F.col("website") != "", "Yes").otherwise("No")).drop("best")
