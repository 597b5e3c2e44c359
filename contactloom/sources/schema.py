"""The lead table: '' means missing in strings; lat and lon are null when unknown; seq is the order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

STRINGS = [
    "name", "category", "city", "country", "address", "phone", "phone_display", "phone_type", "email", "email_status", "email_note",
    "site_state", "website", "website_status", "source", "map_url", "place_id",
]
LISTS = ["raw_phones", "raw_emails", "other_emails"]
LEAD_SCHEMA = T.StructType(
    [T.StructField("seq", T.LongType())]
    + [T.StructField(c, T.StringType(), False) for c in STRINGS]
    + [T.StructField(c, T.ArrayType(T.StringType()), False) for c in LISTS]
    + [T.StructField("socials", T.MapType(T.StringType(), T.StringType()), False), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]
)
ELEMENT = "type string, id bigint, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
PLACE = (
    "displayName struct<text:string>, formattedAddress string, internationalPhoneNumber string, nationalPhoneNumber string, websiteUri string, "
    "googleMapsUri string, location struct<latitude:double,longitude:double>, businessStatus string"
)


def as_leads(df: DataFrame, **made: Column) -> DataFrame:
    """Selects the lead columns from the given ones, those of df, and defaults."""

    def column(f: T.StructField) -> Column:
        got = made[f.name] if f.name in made else F.col(f.name) if f.name in df.columns else None
        if isinstance(f.dataType, T.StringType):
            return F.coalesce(got, F.lit("")) if got is not None else F.lit("")
        if isinstance(f.dataType, T.ArrayType):
            return F.coalesce(got, F.array().cast(f.dataType)) if got is not None else F.array().cast(f.dataType)
        if isinstance(f.dataType, T.MapType):
            return F.coalesce(got, F.create_map().cast(f.dataType)) if got is not None else F.create_map().cast(f.dataType)
        return got if got is not None else F.lit(None).cast(f.dataType)

    return df.select(*(column(f).alias(f.name) for f in LEAD_SCHEMA))
