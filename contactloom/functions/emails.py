"""Email functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .urls import same_site

_AT = r"(?iu)\s*[\[\(\{]\s*(?:" + "|".join(fixed.AT_WORDS) + r")\s*[\]\)\}]\s*"
_DOT = r"(?iu)\s*[\[\(\{]\s*(?:" + "|".join(fixed.DOT_WORDS) + r")\s*[\]\)\}]\s*"


def unquote(text: Column) -> Column:
    """Percent decoding; a bad escape leaves the text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def domain_of(email: Column) -> Column:
    return F.regexp_extract(email, "@(.*)$", 1)


def local_of(email: Column) -> Column:
    return F.regexp_extract(email, "^(.*)@", 1)


def clean_email(raw: Column) -> Column:
    """A normalised address, or null for junk."""
    e = F.lower(F.regexp_replace(F.trim(unquote(raw)), r"""^[.,;:<>()\[\]"']+|[.,;:<>()\[\]"']+$""", ""))
    e = F.trim(F.regexp_extract(F.regexp_replace(e, "^mailto:", ""), r"^[^?]*", 0))
    ok = (
        e.rlike(fixed.EMAIL)
        & ~F.regexp_extract(e, r"([^.]*)$", 1).isin(fixed.FILE_EXTENSIONS)
        & ~e.contains("..")
        & ~domain_of(e).isin(fixed.JUNK_DOMAINS)
        & ~local_of(e).rlike(fixed.JUNK_LOCAL)
    )
    return F.when(ok, e)


def deobfuscate(text: Column) -> Column:
    """Bracketed words for @ and . become the signs (B15); a text without brackets is not searched."""
    found = F.regexp_replace(F.regexp_replace(text, _AT, "@"), _DOT, ".")
    return F.when(text.rlike(r"[\[({]"), found).otherwise(text)


def unglue(found: Column) -> Column:
    """Cuts text that is glued to the end of an address."""
    return F.regexp_replace(found, fixed.GLUED_TLD, "$1")


def find_emails(text: Column) -> Column:
    """Addresses of a text as they stand; one without @ is not searched."""

    def found(t: Column) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(fixed.EMAIL_FIND), F.lit(0)), unglue)

    none = F.array().cast("array<string>")
    return F.get(F.transform(F.array(text), lambda t: F.when(t.contains("@"), found(t)).when(t.isNotNull(), none)), F.lit(0))


def clean_all(raw: Column) -> Column:
    """Cleaned addresses of an array, ordered and distinct."""
    return F.array_distinct(F.filter(F.transform(raw, clean_email), lambda e: e.isNotNull()))


def decode_protected(enc: Column) -> Column:
    """Hex text whose first byte is the key that the others are XORed with (B14); '' if it isn't hex."""
    pair = lambda i: F.conv(F.substr(enc, i, F.lit(2)), 16, 10).cast("int")
    at = F.sequence(F.lit(3), F.greatest(F.length(enc), F.lit(3)), F.lit(2))
    chars = F.transform(at, lambda i: F.chr(pair(i).bitwiseXOR(pair(F.lit(1)))))
    return F.when(enc.rlike("^([0-9A-Fa-f]{2}){2,}$"), F.array_join(chars, "")).otherwise(F.lit(""))


def visible_emails(page: Column) -> Column:
    """Addresses that a visitor sees or can click, from a parsed page (text, links, cf)."""
    hrefs = F.transform(page["links"], lambda x: x["href"])
    mail = F.filter(hrefs, lambda h: h.rlike("(?i)^mailto:"))
    mailed = F.flatten(F.transform(mail, lambda h: F.split(F.regexp_extract(unquote(F.substring(h, 8, 1 << 20)), "^[^?]*", 0), "[,;]")))
    linked = F.filter(hrefs, lambda h: h.contains("/cdn-cgi/l/email-protection#"))
    linked = F.transform(linked, lambda h: decode_protected(F.regexp_extract(h, "#(.*)$", 1)))
    return clean_all(F.concat(mailed, F.transform(page["cf"], decode_protected), linked, find_emails(deobfuscate(page["text"]))))


def embedded_emails(raw: Column) -> Column:
    r"""Addresses in scripts and JSON (B17); raw has its \uXXXX escapes decoded already (html.unescape_unicode)."""
    text = F.regexp_replace(raw, "(?i)" + fixed.ESCAPED_AT, "@")
    text = F.regexp_replace(F.regexp_replace(text, r"\\[nrt]", " "), r"\\/", "/")
    return clean_all(find_emails(text))


def trusted(emails: Column, website: Column) -> Column:
    """Embedded addresses count only on the website's own domain."""
    return F.filter(emails, lambda e: same_site(domain_of(e), website))


def is_certified(domain: Column) -> Column:
    """Certified-mail providers."""
    return F.concat(domain, F.lit(".")).rlike(fixed.CERTIFIED_MAIL)


def email_score(email: Column, website: Column) -> Column:
    """Sorts best first: own domain, not certified mail, a named mailbox."""
    return F.struct(
        F.when((website != "") & same_site(domain_of(email), website), 0).otherwise(1).alias("other"),
        F.when(is_certified(domain_of(email)), 1).otherwise(0).alias("certified"),
        F.when(local_of(email).isin(fixed.ROLE_LOCAL), 1).otherwise(0).alias("role"),
    )


def rank_emails(emails: Column, website: Column) -> Column:
    keyed = F.transform(F.array_distinct(emails), lambda e, i: F.struct(email_score(e, website).alias("s"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda x: x["e"])


def why_no_email(email: Column, raw_emails: Column, website: Column, site_state: Column) -> Column:
    """Why a lead has no email."""
    first, last = fixed.NOTE_UNDELIVERABLE
    note = F.when(email != "", F.lit(""))
    note = note.when(F.size(raw_emails) > 0, F.concat(F.lit(first), F.array_join(F.slice(raw_emails, 1, 2), ", "), F.lit(last)))
    note = note.when(website == "", F.lit(fixed.NOTE_NO_WEBSITE))
    for state, text in fixed.NOTE_BY_STATE.items():
        note = note.when(site_state == state, F.lit(text))
    return note.otherwise(F.lit(fixed.NOTE_OTHER))
