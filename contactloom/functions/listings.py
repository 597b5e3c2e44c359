"""Listing functions: address, entity key, identities, categories, geometry, export cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import fixed
from .urls import bare_host

KM_PER_DEGREE = 111.0


def tag(tags: Column, *keys: str) -> Column:
    """The first non-empty of some tags, else ''."""
    return F.coalesce(*(F.nullif(tags[k], F.lit("")) for k in keys), F.lit(""))


def address(tags: Column) -> Column:
    """addr:full, or its parts that are there."""
    street = F.trim(F.concat_ws(" ", F.nullif(tags["addr:housenumber"], F.lit("")), F.nullif(tags["addr:street"], F.lit(""))))
    parts = [
        F.nullif(tags["addr:unit"], F.lit("")), F.nullif(street, F.lit("")), F.nullif(tag(tags, "addr:suburb", "addr:neighbourhood"), F.lit("")),
        F.nullif(tag(tags, "addr:city", "addr:town", "addr:village"), F.lit("")), F.nullif(tags["addr:state"], F.lit("")), F.nullif(tags["addr:postcode"], F.lit("")),
    ]
    return F.coalesce(F.nullif(tags["addr:full"], F.lit("")), F.concat_ws(", ", *parts))


def plain_name(name: Column) -> Column:
    """Lower-case name without anything but letters, digits and _."""
    return F.regexp_replace(F.lower(name), r"(?U)[^\w]+", "")


def lead_key(name: Column, website: Column, raw_phones: Column, address: Column) -> Column:
    """host|name, or name|last 8 digits of the first phone, or name|address."""
    host, nm = bare_host(website), plain_name(name)
    rest = F.when(F.size(raw_phones) > 0, F.right(F.regexp_replace(F.get(raw_phones, F.lit(0)), "[^0-9]", ""), F.lit(8))).otherwise(F.lower(address))
    return F.when(host != "", F.concat_ws("|", host, nm)).otherwise(F.concat_ws("|", nm, rest))


def identities(place_id: Column, map_url: Column, phone: Column, email: Column, website: Column, key: Column) -> Column:
    """Array of (field, value) that identify a lead; a phone only for one without a website."""
    pairs = {"ids": F.coalesce(F.nullif(place_id, F.lit("")), map_url), "phones": F.when(website == "", phone).otherwise(F.lit("")), "emails": email, "keys": key}
    return F.filter(F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in pairs.items())), lambda x: x["value"] != "")


def category_tags(spark: SparkSession) -> DataFrame:
    """keyword, k, v; aliases and plurals included."""
    rows = [(w, k, v) for w, tags in fixed.CATEGORY_TAGS.items() for k, v in tags]
    rows += [(alias, k, v) for alias, w in fixed.CATEGORY_ALIASES.items() for word, k, v in rows if word == w]
    known = {w for w, *_ in rows}
    rows += [(w + "s", k, v) for w, k, v in rows if w + "s" not in known]
    return spark.createDataFrame(rows, "keyword string, k string, v string")


def resolve(category: str) -> tuple[list[tuple[str, str]], bool]:
    """(key, value) selectors of a category and whether it is known; an unknown one is looked for in names."""
    c = " ".join(category.lower().split())
    c = fixed.CATEGORY_ALIASES.get(c, c)
    for word in (c, c.removesuffix("s")):
        if word in fixed.CATEGORY_TAGS:
            return fixed.CATEGORY_TAGS[word], True
    if "=" in c:
        k, _, v = category.strip().partition("=")
        return [(k.strip(), v.strip())], True
    return [("name", c)], False


def with_selectors(df: DataFrame, column: str = "category") -> DataFrame:
    """df with a row for each selector (k, v) of its category, and whether that is exact, as resolve()."""
    word = F.regexp_replace(F.lower(F.trim(column)), r"\s+", " ")
    known = category_tags(df.sparkSession).withColumnRenamed("keyword", "_word")
    out = df.withColumn("_word", word).join(known, "_word", "left")
    pair, known = F.col(column).contains("="), F.col("k").isNotNull()
    side = lambda p: F.trim(F.regexp_extract(column, p, 1))
    k = F.when(known, F.col("k")).when(pair, side("^([^=]*)=")).otherwise("name")
    v = F.when(known, F.col("v")).when(pair, side("^[^=]*=(.*)$")).otherwise(F.col("_word"))
    return out.select(*df.columns, k.alias("k"), v.alias("v"), (known | pair).alias("exact"))


def ring_points(lat: Column, lon: Column, radius_km: Column, step_km: float = 5.0) -> Column:
    """Array of (ring, lat, lon): 6k points on ring k up to the radius."""
    rings = F.floor(radius_km / step_km).cast("int")
    ks = F.when(rings >= 1, F.sequence(F.lit(1), rings)).otherwise(F.array().cast("array<int>"))

    def ring(k: Column) -> Column:
        def point(i: Column) -> Column:
            angle = F.lit(6.283185307179586) * i / (6 * k)
            d = k * step_km / KM_PER_DEGREE
            return F.struct(k.alias("ring"), (lat + d * F.cos(angle)).alias("lat"), (lon + d * F.sin(angle) / F.greatest(F.lit(0.1), F.cos(F.radians(lat)))).alias("lon"))

        return F.transform(F.sequence(F.lit(0), 6 * k - 1), point)

    return F.flatten(F.transform(ks, ring))


def ring_of(lat: Column, lon: Column, lat0: Column, lon0: Column, step_km: float = 5.0) -> Column:
    """Ring of a place by its distance from a centre."""
    dy = (lat - lat0) * KM_PER_DEGREE
    dx = (lon - lon0) * KM_PER_DEGREE * F.greatest(F.lit(0.1), F.cos(F.radians(lat0)))
    return F.ceil(F.round(F.sqrt(dx * dx + dy * dy) / step_km, 9)).cast("int")


def yes_no(website: Column) -> Column:
    return F.when(website != "", F.lit("Yes")).otherwise(F.lit("No"))


def clip(text: Column) -> Column:
    """A cell: no control characters, 32000 characters, no formula (A10)."""
    t = F.substring(F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""), 1, 32000)
    return F.when(t.rlike("^[=@-]"), F.concat(F.lit(" "), t)).otherwise(t)


def safe_filename(*parts: Column) -> Column:
    """A label for a run or partition."""
    joined = F.regexp_replace(F.concat_ws("_", *parts), r"(?U)[^\w\-]+", "_")
    return F.substring(F.lower(F.regexp_replace(joined, "^_+|_+$", "")), 1, 80)
