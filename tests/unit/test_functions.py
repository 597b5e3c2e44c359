"""Single functions against hand-written expectations."""

import pytest
from pyspark.sql import functions as F

from contactloom import ship
from contactloom.functions import emails as E, html as H, listings as L, phones as P, urls as U
from contactloom.operators import enrich as N


def one(spark, column):
    return ship(spark).range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Info@Biz.IT", "info@biz.it"), ("%20info@x.com", "info@x.com"), ("mailto:a@b.co?subject=x", "a@b.co"), ("john+tag@x.com", "john+tag@x.com"),
        ("<a@b.com>.", "a@b.com"), ("noreply@x.com", None), ("no-reply@x.com", None), ("x@example.com", None), ("img@2x.png", None), ("a..b@x.com", None),
        ("press.office@x.com", None), ("privacy@x.com", None), ("a@b", None), ("", None), ("100%@x.com", "100%@x.com"),
    ],
)
def test_clean_email(spark, raw, want):
    assert one(spark, E.clean_email(F.lit(raw))) == want


@pytest.mark.parametrize(
    "raw, region, want",
    [
        ("0321 4567890", "PK", ("+923214567890", "Mobile")), ("12345", "PK", None), ("0321 465346", "IT", ("+390321465346", "Landline")),
        ("0321/465346", "IT", ("+390321465346", "Landline")), ("020 7946 0958", "GB", ("+442079460958", "Landline")), ("07400 123456", "GB", ("+447400123456", "Mobile")),
        ("(212) 555-0123", "US", ("+12125550123", "Landline/Mobile")), ("+49 (0)30 123456", "US", ("+4930123456", "Landline")), ("800 123456", "IT", ("+39800123456", "Toll-free")),
        ("020 7946 0958", None, None), ("call me", "GB", None),
    ],
)
def test_normalize_phone(spark, raw, region, want):
    got = one(spark, P.normalize_phone(F.lit(raw), F.lit(region).cast("string")))
    assert (got and (got["e164"], got["type"])) == want


def test_display_stays(spark):
    assert one(spark, P.normalize_phone(F.lit("+92 42 35761234"), F.lit("IT")))["display"] == "+92 42 35761234"


def test_first_valid_takes_whole_before_parts(spark):
    get = lambda *raws: one(spark, P.first_valid(F.array(*map(F.lit, raws)), F.lit("IT"))["e164"])
    assert get("0321/465346") == "+390321465346"
    assert get("bad", "12; 333 1234567") == "+393331234567"
    assert get("+39 0321 465346, +39 333 1234567") == "+390321465346"
    assert get("x") is None


@pytest.mark.parametrize(
    "url, want",
    [
        ("example.it", "http://example.it"), ("https://www.a.com/x", "https://www.a.com/x"), ("ftp://a.com", ""), ("http://localhost/", ""), ("http://192.168.1.1/", ""),
        ("http://172.20.1.1", ""), ("http://8.8.8.8", "http://8.8.8.8"), ("http://[::1]/", ""), ("facebook.com/x", ""), ("http://m.facebook.com/x", ""), ("", ""), ("nodots", ""),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, U.normalize_url(F.lit(url))) == want


def test_social_sites_are_no_websites(spark):
    for url, want in (("https://facebook.com/a", ""), ("booksy.com/x", ""), ("https://www.google.com/maps", ""), ("biz.com", "http://biz.com"), ("https://notfacebook.com", "https://notfacebook.com")):
        assert one(spark, U.clean_website(F.lit(url))) == want


PAGE = """<html><body><a href="mailto:%20one@biz.it,two@biz.it?subject=Hi">m</a><a href="MAILTO:three@biz.it">x</a>
<span data-cfemail="422b2c242d022b366c2b36">[protected]</span> four [at] biz [dot] it five at biz dot it <b>unclosed
<script>var a="six@biz.it</p>"</script><style>seven@biz.it</style><!-- eight@biz.it --> Info@biz.itTel &#110;ine&#64;biz.it
<p>Tel 0321 465346 P.IVA 01234567890 <a href="tel:+39 333 1234567">call</a>
<a href="/contatti#top">Contatti</a><a href="chi">Chi siamo</a><a href="https://other.it/contact">x</a><a href="/news">News</a>
<a href="https://www.facebook.com/biz">f</a><a href="https://facebook.com/other">f</a><a href="https://twitter.com/intent/tweet">t</a><a href="https://x.com/">x</a></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    df = ship(spark).createDataFrame([("https://www.biz.it/", PAGE)], "url string, html string")
    return N.parsed(df).cache()


def test_visible_emails(page):
    got = page.select(E.visible_emails(F.col("page"))).first()[0]
    assert got == ["one@biz.it", "two@biz.it", "three@biz.it", "info@it.it", "four@biz.it", "info@biz.it", "nine@biz.it"]


def test_page_phones(page):
    assert page.select(P.page_phones(F.col("page"), F.lit("IT"))).first()[0] == ["+39 333 1234567", "+390321465346"]


def test_contact_links(page):
    rows = N.contact_links(page, 5).orderBy("rank").collect()
    assert [r.link for r in rows] == ["https://www.biz.it/contatti", "https://www.biz.it/chi"]


def test_social_links(page):
    assert [tuple(s) for s in page.select(N.social_links(F.col("page"))).first()[0]] == [("facebook", "https://www.facebook.com/biz")]


def test_embedded_emails(spark):
    raw = r'{"email":"info@x.it","y":">help@x.it","z":"a\/b\nme@y.it","w":"&#64;"}'
    df = ship(spark).createDataFrame([(raw,)], "t string")
    found = E.embedded_emails(H.unescape_unicode("t"))
    assert df.select(found).first()[0] == ["info@x.it", "help@x.it", "me@y.it"]
    assert df.select(E.trusted(found, F.lit("http://www.x.it/"))).first()[0] == ["info@x.it", "help@x.it"]


def test_rank_puts_certified_mail_last(spark):
    emails = F.array(*map(F.lit, ("a@pec.it", "info@x.it", "mario@x.it", "luca@gmail.com")))
    assert one(spark, E.rank_emails(emails, F.lit("https://x.it"))) == ["mario@x.it", "info@x.it", "luca@gmail.com", "a@pec.it"]


def test_rings(spark):
    assert len(one(spark, L.ring_points(F.lit(45.0), F.lit(9.0), F.lit(15.0)))) == 36
    assert one(spark, L.ring_points(F.lit(45.0), F.lit(9.0), F.lit(4.0))) == []


@pytest.mark.parametrize("category, want", [("Dentists", ([("amenity", "dentist"), ("healthcare", "dentist")], True)), ("shop=tea", ([("shop", "tea")], True)), ("Tea  House", ([("name", "tea house")], False)), ("plumbers", ([("craft", "plumber")], True))])
def test_resolve(category, want):
    assert L.resolve(category) == want


def test_cells(spark):
    assert one(spark, L.clip(F.lit("=1+1\x07"))) == " =1+1"
    assert one(spark, L.clip(F.lit("+39 1"))) == "+39 1"
    assert len(one(spark, L.clip(F.lit("x" * 40000)))) == 32000
    assert one(spark, L.safe_filename(F.lit("São Paulo"), F.lit("Café & Bar!"))) == "são_paulo_café_bar"


@pytest.mark.parametrize(
    "text, want",
    [
        ("host 55.148.143.52 and 8.8.8.8:80", []), ("call +1 (212) 555-0123 or 55.148.143.52", ["+12125550123"]), ("212.555.0123, (212) 555-0123", ["+12125550123"]),
        ("a 4111 1111 1111 1111 b x2125550123 2125550123y", []), ("+49 30 123456; 020 7946 0958", ["+4930123456"]), ("VAT 2125550123", []), ("", []),
    ],
)
def test_text_phones(spark, text, want):
    assert one(spark, P.text_phones(F.lit(text), F.lit("US"))) == want


def test_text_phones_of_whole_documents_against_python(spark):
    """Candidates by Python's regular expressions, one match after the other, then one call for each of them."""
    import re

    docs = ship(spark).read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    vat, quad, number = (re.compile(p, f) for p, f in (("(?i)" + P.fixed.VAT, 0), (P.DOTTED_QUAD, 0), (P.IN_TEXT, 0)))
    seen = [(r.doc_id, m[0]) for r in docs.collect() for m in number.finditer(quad.sub(" ", vat.sub(" ", r.text or "")))]
    valid = spark.createDataFrame(seen, "doc_id bigint, raw string").select("doc_id", P.normalize_phone(F.col("raw"), F.lit("US"))["e164"].alias("phone")).where("phone is not null")
    got = docs.select("doc_id", F.explode(P.text_phones(F.col("text"), F.lit("US"))).alias("phone"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in valid.collect()} and got.count()


@pytest.mark.parametrize("broken", ["<![foo[x]]>", "<![ foo", "<!", "<!-- x", "<a href=", "&#x110000;", "<![CDATA[ y ]]>", "<!DOCTYPE [<!ENTITY"])
def test_malformed_pages_keep_what_was_read(broken):
    assert "before" in H.read_page(f'<p>before <a href="/contact">c</a> {broken} after')["text"]
    assert H.read_page(f'<a href="/contact">c</a>{broken}')["links"][0]["href"] == "/contact"


def test_pages_are_parsed_with_silent_scripts():
    assert H.read_page('a<script>b="</p>"</script><b>c<p>d<p>e')["text"].split() == ["a", "c", "d", "e"]
    assert H.read_page(None) == {"text": "", "links": [], "cf": []}
