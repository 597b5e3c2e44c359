"""Listings to leads: open map elements, place records, map details; their union and order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fixed, listings as L, urls as U
from ..operators.rank import ranked
from .schema import ELEMENT, PLACE, as_leads

#: Rows and boxes of a cell that are compared in one go, and pairs that a task compares.
BLOCK, PAIRS = 4096, 1 << 24


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ELEMENT).json(path)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PLACE).json(path)


def _present(*values: Column) -> Column:
    return F.filter(F.array(*values), lambda x: x.isNotNull() & (x != ""))


def from_elements(elements: DataFrame, category: str | Column = "", city: str = "", country: str = "") -> DataFrame:
    """Open map elements with a name as leads, in the order of `seq` if there is one (A1)."""
    t = F.col("tags")
    coord = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.col("center")[c])
    name = F.trim(L.tag(t, "name", "name:en", "brand", "operator"))
    emails = F.flatten(F.transform(_present(t["email"], t["contact:email"]), lambda e: F.split(e, "[,;]")))
    social = F.filter(F.array(*(F.struct(F.lit(n).alias("k"), t[f"contact:{n}"].alias("v")) for n in ("facebook", "instagram"))), lambda s: s["v"].isNotNull() & (s["v"] != ""))
    ref = F.concat_ws("/", F.lit("https://www.openstreetmap.org"), F.col("type"), F.col("id").cast("string"))
    return as_leads(
        elements.where(name != ""),
        name=name, category=F.lit(category) if isinstance(category, str) else category, city=F.lit(city), country=F.lit(country), address=L.address(t),
        website=F.trim(L.tag(t, "website", "contact:website", "url")), raw_phones=F.array_distinct(_present(t["phone"], t["contact:phone"], t["mobile"], t["contact:mobile"])),
        raw_emails=F.array_distinct(F.filter(F.transform(emails, lambda e: F.trim(e)), lambda e: e != "")), socials=F.map_from_entries(social), lat=coord("lat"), lon=coord("lon"),
        source=F.lit("OpenStreetMap"), map_url=ref,
    )


def from_places(places: DataFrame, category: str | Column = "", city: str = "", country: str = "") -> DataFrame:
    """Place records that are open and named, the first for each URI in the order of `seq` (A2)."""
    name = F.trim(F.coalesce(F.col("displayName.text"), F.lit("")))
    first = F.row_number().over(Window.partitionBy("googleMapsUri").orderBy("seq"))
    rows = places.where(F.coalesce(F.col("businessStatus"), F.lit("")) != "CLOSED_PERMANENTLY")
    named = rows.where(F.coalesce(F.col("googleMapsUri"), F.lit("")) == "").withColumn("first", F.lit(1))
    rows = rows.where(F.coalesce(F.col("googleMapsUri"), F.lit("")) != "").withColumn("first", first).where("first = 1").unionByName(named)
    return as_leads(
        rows.where(name != ""),
        name=name, category=F.lit(category) if isinstance(category, str) else category, city=F.lit(city), country=F.lit(country), address=F.col("formattedAddress"),
        website=F.col("websiteUri"), raw_phones=F.array_distinct(_present(F.col("internationalPhoneNumber"), F.col("nationalPhoneNumber"))),
        lat=F.col("location.latitude"), lon=F.col("location.longitude"), source=F.lit("Google Places"), map_url=F.col("googleMapsUri"),
    )


def from_details(details: DataFrame, category: str | Column = "", city: str = "", country: str = "") -> DataFrame:
    """Map details (name, listed_name, address, phone, website, closed, url) as leads (A3)."""
    name = F.trim(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("listed_name"), F.lit("")))
    return as_leads(
        details.where((name != "") & ~F.coalesce(F.col("closed"), F.lit(False))),
        name=name, category=F.lit(category) if isinstance(category, str) else category, city=F.lit(city), country=F.lit(country), raw_phones=_present(F.col("phone")),
        phone=F.lit(""), source=F.lit("Google Maps"), map_url=F.col("url"), place_id=U.place_id(F.col("url")), lat=U.url_coordinate(F.col("url"), "lat"), lon=U.url_coordinate(F.col("url"), "lon"),
    )


def in_category(elements: DataFrame, selectors: list[tuple[str, str]], exact: bool = True) -> DataFrame:
    """Elements that match any selector; an unknown category is looked for in the name."""
    if not exact:
        return elements.where(F.lower(F.col("tags")["name"]).contains(selectors[0][1].lower()))
    return elements.where(reduce(Column.__or__, (F.col("tags")[k] == v for k, v in selectors)))


def with_category(elements: DataFrame, tags: DataFrame) -> DataFrame:
    """Elements that carry a tag of a (small) category table (k, v)."""
    exploded = elements.select("id", F.explode("tags").alias("k", "v"))
    return elements.join(exploded.join(tags, ["k", "v"], "left_semi").select("id").distinct(), "id", "left_semi")


def in_area(df: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Rows inside a box."""
    return df.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def in_areas(df: DataFrame, areas: DataFrame, cell: float = 0.05) -> DataFrame:
    """df with a row and `area` for each box of areas (area, south, west, north, east) that holds it: many boxes, many rows.

    Boxes are dealt to the cells of a grid, `cell` degrees wide, and rows to their one cell: an equi-join, then the exact test.
    A box that is larger than 2**10 cells is dealt to a grid as much coarser as it needs, each box to one grid only. Rows and boxes
    of a full cell are dealt into blocks of about BLOCK of each, so that many rows at one place are compared by many tasks.
    """
    side = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(cell)) / (32 * cell)))).cast("int")
    boxes = areas.where("north >= south and east >= west").select("area", "south", "west", "north", "east", level.alias("level"))
    width = F.lit(cell) * F.pow(F.lit(2.0), "level")
    line = lambda c: F.floor(F.col(c) / width)
    boxes = boxes.withColumn("gy", F.explode(F.sequence(line("south"), line("north")))).withColumn("gx", F.explode(F.sequence(line("west"), line("east"))))
    levels = [r.level for r in boxes.select("level").distinct().collect()]  # a number for each doubling of the size of boxes
    names = df.columns
    rows = df.where("lat is not null and lon is not null").withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    rows = rows.withColumn("gy", line("lat")).withColumn("gx", line("lon"))
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    keys = ["level", "gy", "gx"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).join(boxes.groupBy(*keys).agg(F.count("*").alias("_m")), keys)
    pairs = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0  # to compare, in all cells
    if pairs > BLOCK**2:
        full = F.broadcast(sizes.where((F.col("_n") > BLOCK) | (F.col("_m") > BLOCK)))  # one cell for BLOCK rows or boxes at most
        hashed = [c for c, kind in df.dtypes if "map<" not in kind]
        tasks = max(-(-pairs // PAIRS), min(-(-pairs // BLOCK**2), df.sparkSession.sparkContext.defaultParallelism))

        def dealt(side: DataFrame, of: list[str], count: str, part: str, other_count: str, other: str) -> DataFrame:
            parts = lambda c: F.coalesce(F.ceil(F.col(c) / BLOCK), F.lit(1))
            own = side.join(full, keys, "left").withColumn(part, F.pmod(F.xxhash64(*of), parts(count)))
            return own.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), parts(other_count) - 1))).drop("_n", "_m").repartition(int(tasks), *keys, "_gr", "_gb")

        rows, boxes = dealt(rows, hashed, "_n", "_gr", "_m", "_gb"), dealt(boxes, ["area", "south", "west", "north", "east"], "_m", "_gb", "_n", "_gr").hint("merge")
        keys += ["_gr", "_gb"]
    return rows.join(boxes, keys).where(inside).select(*names, "area")


def with_region(df: DataFrame, regions: DataFrame, column: str = "country") -> DataFrame:
    """Adds `region`: alias, 2-letter code, or name / 3-letter code of a regions table (code, name, alpha3, supported)."""
    spark = df.sparkSession
    key = F.lower(F.trim(F.col(column)))
    alias = spark.createDataFrame(list(fixed.COUNTRY_ALIASES.items()), "ckey string, alias_code string")
    names = regions.select(F.explode(F.array(F.lower("name"), F.lower("alpha3"), F.lower("code"))).alias("ckey"), F.col("code").alias("name_code")).dropDuplicates(["ckey"])
    known = regions.where("supported").select(F.col("code").alias("region"))
    df = df.withColumn("ckey", key).join(F.broadcast(alias), "ckey", "left").join(names, "ckey", "left")
    two = F.when(F.col("ckey").rlike("^[a-z]{2}$"), F.upper("ckey"))
    df = df.withColumn("code", F.coalesce("alias_code", two, "name_code")).drop("ckey", "alias_code", "name_code")
    return df.join(known, F.col("code") == F.col("region"), "left").drop("code")


def union_sources(*leads: DataFrame) -> DataFrame:
    """All sources, each row with the rank of its source (G1)."""
    return reduce(DataFrame.unionByName, (df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(leads)))


def ordered_by_completeness(leads: DataFrame, scope: tuple[str, ...] = ("category",)) -> DataFrame:
    """seq anew within each category: map listings first as they came, then the most complete rows."""
    score = sum(F.when(x, 1).otherwise(0) for x in (F.col("website") != "", F.size("raw_phones") > 0, F.size("raw_emails") > 0))
    maps = F.col("source") == "Google Maps"
    order = [F.when(maps, 0).otherwise(1), F.when(maps, 0).otherwise(-score), F.col("source_rank"), F.col("seq")]
    return ranked(leads, order, scope, "place").withColumn("seq", F.col("place").cast("bigint")).drop("source_rank", "place")
