"""URL and website functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed

#: IPv4 ranges that aren't globally reachable
PRIVATE_V4 = (
    r"^(0|10|127|24[0-9]|25[0-5])\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\."
    r"|^192\.0\.[02]\.|^192\.168\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\."
)
V4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"
SCHEME_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
HOST_PART = r"^(\[[^\]]*\]|[^:]*)"


def suffix_pattern(hosts: list[str]) -> str:
    """Matches any of the hosts or a subdomain of one."""
    return r"(^|\.)(" + "|".join(h.replace(".", r"\.") for h in sorted(set(hosts))) + ")$"


SKIP = suffix_pattern(fixed.SKIP_HOSTS)
NOT_OWN = suffix_pattern(fixed.SOCIAL_HOSTS + fixed.PLATFORM_HOSTS)


def hostname(url: Column) -> Column:
    """Lower-case host of a URL, which may lack its scheme; '' if there is none."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("//"), url))
    place = F.regexp_replace(F.regexp_extract(full, SCHEME_HOST, 1), "^.*@", "")
    return F.lower(F.regexp_extract(place, HOST_PART, 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(hostname(url), r"^www\.", "")


def loose_host(url: Column) -> Column:
    """Host by cutting: scheme, path, port and www. go."""
    cut = F.regexp_replace(F.lower(url), "^[a-z]+://", "")
    return F.regexp_replace(F.regexp_extract(cut, "^[^/:]*", 0), r"^www\.", "")


def normalize_url(url: Column) -> Column:
    """The URL if it can be a business website to visit, else '' (B1)."""
    trimmed = F.trim(url)
    full = F.when(trimmed.rlike("(?i)^[a-z]+://"), trimmed).otherwise(F.concat(F.lit("http://"), trimmed))
    host = hostname(full)
    bare = F.regexp_replace(host, r"^www\.", "")
    v6 = host.startswith("[")
    ok = (
        (trimmed != "")
        & full.rlike("(?i)^https?://")
        & (host != "")
        & F.when(v6, host.rlike(r"^\[[23]")).when(host.rlike(V4), ~host.rlike(PRIVATE_V4)).otherwise((host != "localhost") & host.contains("."))
        & ~bare.rlike(SKIP)
    )
    return F.when(ok, full).otherwise(F.lit(""))


def is_social(url: Column) -> Column:
    """Whether a 'website' belongs to a social network, platform or search engine (B2)."""
    host = bare_host(url)
    return host.rlike(NOT_OWN) | host.rlike(fixed.GOOGLE_HOST)


def clean_website(url: Column) -> Column:
    """Only a website of the business's own, with a scheme."""
    w = F.trim(url)
    return F.when((w == "") | is_social(w), F.lit("")).when(w.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), w).otherwise(F.concat(F.lit("http://"), w))


def same_site(domain: Column, website: Column) -> Column:
    """Equal hosts, or one a subdomain of the other."""
    h = loose_host(website)
    return (h != "") & ((domain == h) | domain.endswith(F.concat(F.lit("."), h)) | h.endswith(F.concat(F.lit("."), domain)))


def suffixes(host: Column) -> Column:
    """A host and all its parent domains: same_site as an equality, for joins."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def candidates(url: Column) -> Column:
    """Up to 4 variants: both schemes, with and without www.."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1))
    host = hostname(url)
    rest = F.regexp_replace(url, r"^[A-Za-z]+://[^/?#:]*", "")
    twin = F.when(host.startswith("www."), F.substring(host, 5, 1 << 20)).otherwise(F.concat(F.lit("www."), host))
    other = F.when(scheme == "http", F.lit("https")).otherwise(F.lit("http"))
    return F.array_distinct(F.array(*(F.concat(s, F.lit("://"), h, rest) for s in (scheme, other) for h in (host, twin))))


def place_id(url: Column) -> Column:
    """Listing id from a map URL, else the place name in it, else the URL."""
    found = F.nullif(F.regexp_extract(url, "!1s([^!?&]+)", 1), F.lit(""))
    return F.coalesce(found, F.nullif(F.regexp_extract(url, "/maps/place/([^/]+)/", 1), F.lit("")), url)


def url_coordinate(url: Column, which: str) -> Column:
    """lat or lon from !3d<lat>!4d<lon>."""
    return F.nullif(F.regexp_extract(url, r"!3d(-?[0-9.]+)!4d(-?[0-9.]+)", 1 if which == "lat" else 2), F.lit("")).try_cast("double")
