"""The one place where pages are parsed: a page becomes its text, its links and its protected addresses in one pass.

Everything after it is native. Pages without any sign of a contact never reach Python: filter with `worth_parsing` first.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_LINK = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])
PAGE = T.StructType([T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(_LINK)), T.StructField("cf", T.ArrayType(T.StringType()))])
_UNICODE = re.compile(r"\\u([0-9a-fA-F]{4})")
_SILENT = ("script", "style")


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.links: list[dict] = []
        self.cf: list[str] = []
        self.open: list[dict] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        if tag in _SILENT:
            self.silent += 1
        if "data-cfemail" in values:
            self.cf.append(values["data-cfemail"])
        if tag == "a" and "href" in values:
            link = {"pos": len(self.links), "href": values["href"], "text": ""}
            self.links.append(link)
            self.open = [link]

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "a":
            self.open = []

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            for link in self.open:
                link["text"] += (" " if link["text"] else "") + data


def read_page(html: str | None) -> dict:
    reader = _Reader()
    try:
        reader.feed(html or "")
        reader.close()
    except AssertionError:  # a declaration that the parser can't read; what came before it counts
        pass
    return {"text": " ".join(reader.text), "links": reader.links, "cf": reader.cf}


@F.pandas_udf(PAGE)
def parse(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(h) for h in html], columns=["text", "links", "cf"])


@F.pandas_udf(T.StringType())
def unescape_unicode(text: pd.Series) -> pd.Series:
    r"""\uXXXX becomes its character; other text stays."""
    return text.map(lambda t: t and _UNICODE.sub(lambda m: chr(int(m[1], 16)), t).encode("utf-8", "replace").decode())


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """Absolute URL of a link without its fragment; null if it can't be read."""

    def one(b, h):
        try:
            return urljoin(b, h.split("#")[0])
        except (ValueError, AttributeError):
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype="object")


@F.pandas_udf(T.StringType())
def decode_body(body: pd.Series, charset: pd.Series) -> pd.Series:
    """Bytes by their declared charset, errors replaced; an unknown charset counts as UTF-8."""

    def one(b, c):
        if b is None:
            return None
        try:
            return bytes(b).decode(c or "utf-8", "replace")
        except LookupError:
            return bytes(b).decode("utf-8", "replace")

    return pd.Series([one(b, c) for b, c in zip(body, charset, strict=True)], dtype="object")


def worth_parsing(html: Column) -> Column:
    """Whether a page can hold an address, number or link at all."""
    return html.rlike(r"(?i)@|mailto:|tel:|cfemail|email-protection|&#x?0*(64|40);|\\u0040|href|[\[({]\s*(at|chiocciola|arroba)|[0-9][0-9 ()./-]{6}")
