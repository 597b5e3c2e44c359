"""Inputs of the registered queries, derived from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.schema import as_leads

LEADS = """
select c_custkey as seq,
  'Biz ' || cast(c_custkey % 61 as string) as name,
  c_mktsegment as category,
  case when c_custkey % 7 = 0 then '' else cast(c_custkey % 90 as string) || ' Main St' end as address,
  case c_custkey % 3 when 0 then 'https://facebook.com/biz' || cast(c_custkey as string)
       when 1 then 'https://www.biz' || cast(c_custkey % 61 as string) || '.co.uk/' else '' end as website,
  case when c_custkey % 9 < 5 then '+44 20 7946 ' || lpad(cast(c_custkey % 700 as string), 4, '0') else '' end as raw_phone,
  case when c_custkey % 17 < 6 then 'Info@biz' || cast(c_custkey % 61 as string) || '.co.uk' else '' end as raw_email,
  case when c_custkey % 11 = 0 then null else cast(45.0 + ((c_custkey % 13) % 4) * 0.002 as double) end as lat,
  case when c_custkey % 11 = 0 then null else cast(8.0 + ((c_custkey % 13) % 4) * 0.002 as double) end as lon,
  case when c_custkey % 7 < 3 then 'OpenStreetMap' else 'Google Places' end as source,
  case when c_custkey % 7 < 3 then 'osm/' || cast(c_custkey as string) else '' end as place_id
from {customer}
"""

MESSY = """
select c_custkey as seq, c_name as name,
  case c_custkey % 14
    when 0 then 'https://www.biz' || cast(c_custkey as string) || '.co.uk/path?q=1'
    when 1 then 'facebook.com/biz1'
    when 2 then 'http://10.0.0.' || cast(c_custkey % 250 as string) || '/'
    when 3 then 'localhost/x'
    when 4 then '  Biz' || cast(c_custkey as string) || '.IT '
    when 5 then 'ftp://files.biz.com/'
    when 6 then 'HTTP://Shop.Biz.de:8080/a#b'
    when 7 then 'https://maps.google.com/maps/place/Foo+Bar/@1,2/data=!4m2!1s0x' || cast(c_custkey as string) || ':0x1!3d45.25!4d-8.5'
    when 8 then ''
    when 9 then 'https://8.8.8.8/x'
    when 10 then 'www.google.co.uk/maps/place/Baz/x'
    when 11 then 'https://m.booksy.com/it/1'
    when 12 then 'http://[fe80::1]/'
    else 'https://user:pw@blog.biz.fr/' end as url,
  case c_custkey % 13
    when 0 then '%20Info@Biz' || cast(c_custkey as string) || '.co.uk'
    when 1 then 'mailto:sales@biz.it?subject=Hi'
    when 2 then 'no-reply@biz.it'
    when 3 then 'privacy.office@biz.it'
    when 4 then 'x@example.com'
    when 5 then 'logo@2x.png'
    when 6 then '<John.Doe+tag@mail.biz.de>,'
    when 7 then 'a..b@biz.de'
    when 8 then 'INFO@pec.studio.it'
    when 9 then 'hello@biz' || cast(c_custkey % 50 as string) || '.com'
    when 10 then 'bad'
    when 11 then 'Write to web [at] biz [dot] it or call'
    else 'info@x' || cast(c_custkey % 50 as string) || '.itTel' end as raw_email,
  case c_custkey % 10
    when 0 then '0321 4567890'
    when 1 then '12345'
    when 2 then '+92 42 35761234'
    when 3 then '020 7946 0' || lpad(cast(c_custkey % 1000 as string), 3, '0')
    when 4 then '0321/465346'
    when 5 then '+39 0321 465346; +39 333 1234567'
    when 6 then '(212) 555-0' || lpad(cast(c_custkey % 1000 as string), 3, '0')
    when 7 then '00 33 6 12 34 56 78'
    when 8 then '0900 12'
    else '+49 (0)30 123456' end as raw_phone,
  case c_custkey % 5 when 0 then 'PK' when 1 then 'IT' when 2 then 'GB' when 3 then 'US' else 'DE' end as region
from {customer}
"""

PAGES = """
select page_id, url, site,
 replace(html, '</body>', '<a href="mailto:%20Sales' || cast(page_id % 5 as string) || '@' || site || '?subject=Hi">m</a> '
  || '<a href="/contact">Contact</a><a href="https://www.facebook.com/p' || cast(page_id as string) || '">f</a>'
  || '<a href="tel:+44 20 7946 ' || lpad(cast(page_id % 10000 as string),4,'0') || '">t</a> desk' || cast(page_id % 3 as string) || ' [at] ' || site || '</body>') as html
from (select page_id, url, html, regexp_extract(url, '^[a-z]+://(?:www[.])?([^/?#:]+)', 1) as site from {pages}) t
"""

#: Numbers of many regions as people write them: raw, region, E.164 and type. Written down by hand, not made from the plans.
WORLD_PHONES = [
    ("+31 20 123 4567", "GB", "+31201234567", "Landline"), ("06-12345678", "NL", "+31612345678", "Mobile"), ("0800 1234", "NL", "+318001234", "Toll-free"), ("088 123 4567", "NL", "+31881234567", "Other"),
    ("044 668 18 00", "CH", "+41446681800", "Landline"), ("+41 79 123 45 67", "DE", "+41791234567", "Mobile"), ("0900 123 456", "CH", "+41900123456", "Other"), ("01 234567890", "AT", "+431234567890", "Landline"),
    ("0664 1234567", "AT", "+436641234567", "Mobile"), ("(02) 9123 4567", "AU", "+61291234567", "Landline"), ("0412 345 678", "AU", "+61412345678", "Mobile"), ("1800 123 456", "AU", "+611800123456", "Toll-free"),
    ("1300 123 456", "AU", "+611300123456", "Other"), ("(416) 555-0123", "CA", "+14165550123", "Landline/Mobile"), ("1-800-555-0199", "CA", "+18005550199", "Toll-free"), ("03-1234-5678", "JP", "+81312345678", "Landline"),
    ("090-1234-5678", "JP", "+819012345678", "Mobile"), ("0120-123-456", "JP", "+81120123456", "Toll-free"), ("050-1234-5678", "JP", "+815012345678", "VoIP"), ("02 123 45 67", "BE", "+3221234567", "Landline"),
    ("0470 12 34 56", "BE", "+32470123456", "Mobile"), ("32 12 34 56", "DK", "+4532123456", "Landline/Mobile"), ("21 23 45 67", "NO", "+4721234567", "Landline"), ("406 12 345", "NO", "+4740612345", "Mobile"),
    ("08-123 456 78", "SE", "+46812345678", "Landline"), ("070-123 45 67", "SE", "+46701234567", "Mobile"), ("050 1234567", "FI", "+358501234567", "Mobile"), ("01 234 5678", "IE", "+35312345678", "Landline"),
    ("085 012 3456", "IE", "+353850123456", "Mobile"), ("21 234 567", "PT", None, None), ("212 345 678", "PT", "+351212345678", "Landline"), ("912 345 678", "PT", "+351912345678", "Mobile"), ("210 1234567", "GR", "+302101234567", "Landline"),
    ("691 234 5678", "GR", "+306912345678", "Mobile"), ("22 123 45 67", "PL", "+48221234567", "Landline"), ("512 345 678", "PL", "+48512345678", "Mobile"), ("212 345 678", "CZ", "+420212345678", "Landline"),
    ("601 123 456", "CZ", "+420601123456", "Mobile"), ("06 1 234 5678", "HU", "+3612345678", "Landline"), ("06 20 123 4567", "HU", "+36201234567", "Mobile"), ("021 123 4567", "RO", "+40211234567", "Landline"),
    ("0712 034 567", "RO", "+40712034567", "Mobile"), ("8 (495) 123-45-67", "RU", "+74951234567", "Landline"), ("+7 912 345-67-89", "RU", "+79123456789", "Mobile"), ("8 800 555 35 35", "RU", "+78005553535", "Toll-free"),
    ("8 701 234 5678", "KZ", "+77012345678", "Mobile"), ("050 123 4567", "UA", "+380501234567", "Mobile"), ("02-123-4567", "IL", "+97221234567", "Landline"), ("050-234-5678", "IL", "+972502345678", "Mobile"),
    ("011 234 5678", "SA", "+966112345678", "Landline"), ("051 234 5678", "SA", "+966512345678", "Mobile"), ("3312 3456", "QA", "+97433123456", "Mobile"), ("2234 5678", "KW", "+96522345678", "Landline"),
    ("02 34567890", "EG", "+20234567890", "Landline"), ("0100 123 4567", "EG", "+201001234567", "Mobile"), ("0650-123456", "MA", "+212650123456", "Mobile"), ("010 123 4567", "ZA", "+27101234567", "Landline"),
    ("071 123 4567", "ZA", "+27711234567", "Mobile"), ("0712 123456", "KE", "+254712123456", "Mobile"), ("010 1234 5678", "CN", "+861012345678", "Landline"), ("131 2345 6789", "CN", "+8613123456789", "Mobile"),
    ("2123 4567", "HK", "+85221234567", "Landline"), ("5123 4567", "HK", "+85251234567", "Mobile"), ("02 2123 4567", "TW", "+886221234567", "Landline"), ("0912 345 678", "TW", "+886912345678", "Mobile"),
    ("6123 4567", "SG", "+6561234567", "Landline"), ("8123 4567", "SG", "+6581234567", "Mobile"), ("03-2385 6789", "MY", "+60323856789", "Landline"), ("012-345 6789", "MY", "+60123456789", "Mobile"),
    ("02 123 4567", "TH", "+6621234567", "Landline"), ("081 234 5678", "TH", "+66812345678", "Mobile"), ("0912 345 678", "VN", "+84912345678", "Mobile"), ("0812-345-678", "ID", "+62812345678", "Mobile"),
    ("(02) 3234 5678", "PH", "+63232345678", "Landline"), ("0905 123 4567", "PH", "+639051234567", "Mobile"), ("01812-345678", "BD", "+8801812345678", "Mobile"), ("09 345 6789", "NZ", "+6493456789", "Landline"),
    ("021 123 4567", "NZ", "+64211234567", "Mobile"), ("55 1234 5678", "MX", "+525512345678", "Landline/Mobile"), ("011 2345-6789", "AR", "+541123456789", "Landline/Mobile"), ("2 2123 4567", "CL", "+56221234567", "Landline"),
    ("321 1234567", "CO", "+573211234567", "Mobile"), ("912 345 678", "PE", "+51912345678", "Mobile"), ("0412-1234567", "VE", "+584121234567", "Mobile"), ("12345", "NL", None, None), ("+999 123 456 789", "US", None, None),
    ("0612345678", "XX", None, None), ("+44 70 1234 5678", "US", "+447012345678", "Other"), ("1 900 234 5678", "US", "+19002345678", "Other"),
]

HISTORY = """
select 'phones' as field, '+442079460' || lpad(cast(c_custkey % 700 as string), 3, '0') as value from {customer} where c_custkey % 10 = 0
"""


def duck(sql: str) -> str:
    """The statement over the tables that DuckDB knows by name."""
    for name in ("customer", "pages", "documents", "nation"):
        sql = sql.replace("{" + name + "}", name)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [n for n in ("customer", "pages", "documents", "nation") if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def raw_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LEADS in the lead schema."""
    df = derived(spark, sf_dir, LEADS)
    one = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.array(c))
    return as_leads(df, raw_phones=one("raw_phone"), raw_emails=one("raw_email"))


def domain_status(leads: DataFrame) -> DataFrame:
    """A status table for two thirds of the domains of LEADS; the others are unknown."""
    domains = leads.select(F.explode("raw_emails").alias("e")).select(F.lower(F.regexp_extract("e", "@(.*)$", 1)).alias("domain")).distinct()
    number = F.regexp_extract("domain", "([0-9]+)", 1).cast("int") % 3
    return domains.withColumn("status", F.when(number == 0, "ok").when(number == 1, "invalid")).where("status is not null")


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LEADS with validated contacts, keys and clean websites, not merged."""
    from ..functions import listings as L, urls as U
    from ..operators import enrich

    leads = raw_leads(spark, sf_dir).withColumn("website", U.clean_website(F.col("website")))
    done = enrich.finalize(leads, F.lit("GB"), domain_status(leads))
    return done.withColumn("lead_key", L.lead_key(F.col("name"), F.col("website"), F.col("raw_phones"), F.col("address")))
