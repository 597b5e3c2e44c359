"""Fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import html as H

MAX_BYTES = 1_500_000


def readable(log: DataFrame) -> DataFrame:
    """Rows of a fetch log (…, status, content_type, charset, body) that are pages, with `html` decoded (A4).

    Bodies are cut at MAX_BYTES; UTF-8 bodies are decoded natively, others in the helper.
    """
    page = F.col("status").between(200, 299) & F.coalesce(F.lower("content_type").contains("html"), F.lit(True))
    body = F.substring(F.col("body"), 1, MAX_BYTES)
    plain = F.lower(F.coalesce("charset", F.lit("utf-8"))).isin("utf-8", "utf8") & F.is_valid_utf8(body.cast("string"))
    kept = log.where(page).withColumn("body", body).withColumn("plain", plain)
    native = kept.where("plain").withColumn("html", F.col("body").cast("string"))
    decoded = kept.where("not plain").withColumn("html", H.decode_body("body", "charset"))
    return native.unionByName(decoded).drop("plain", "body")
