"""Phone functions over numbering plans, which are one automaton over digits (numbering.py).

A number is valid if its digits, calling code first, lead to an end of the automaton. The steps are an array that Spark holds as
one constant, so a number is a fold over its digits; regions add to the array, not to the work.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, functions as F

from . import fixed
from .numbering import PLAN, automaton

#: What may be a number in running text: at least 7 digits with usual separators
IN_TEXT = r"(?<![0-9A-Za-z@#/.\-])(?:\+|00)?[(0-9][0-9 ()./\-]{5,22}[0-9](?![0-9A-Za-z@#])"
#: Four numbers up to 255 with dots: a network address
DOTTED_QUAD = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])"
SEPARATORS = r"[;/|]|\s{2,}|,(?=\s*\+)"
_SHAPE = r"^\s*(?:tel:)?\s*(?:\+|00)?[0-9 ()./\-]{5,30}\s*$"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ints(values: list[int]) -> Column:
    """An array that the optimizer folds into one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _end(digits: Column) -> Column:
    """Place in the automaton's ends of a full number; null or -1 if it is none."""
    steps, kinds, _ = automaton()
    state = F.aggregate(F.split(digits, ""), F.lit(1), lambda s, d: F.get(_ints(steps), s * 10 + F.ascii(d) - 48))
    return F.get(_ints(kinds), state)


def _found(full: Column) -> Column:
    """A full number as struct(e164, display, type), null if it isn't valid."""
    ends = automaton()[2]
    made = []
    for kind, groups, code in ends:
        at, pieces = 1, []
        sizes = re.findall(r"(\d+)([ -]?)", groups)
        for i, (size, _) in enumerate(sizes):
            pieces.append({"mark": sizes[i - 1][1] if i else "", "at": at, "n": int(size)})
            at += int(size)
        made.append({"kind": kind, "code": code, "pieces": pieces})
    table = F.from_json(F.lit(json.dumps(made)), "array<struct<kind:string,code:int,pieces:array<struct<mark:string,at:int,n:int>>>>")

    def shown(x: Column) -> Column:
        nsn = F.substr(x["full"], x["end"]["code"] + 1)
        pieces = F.filter(x["end"]["pieces"], lambda g: g["at"] <= F.length(x["full"]) - x["end"]["code"])
        number = F.array_join(F.transform(pieces, lambda g: F.concat(g["mark"], F.substr(nsn, g["at"], g["n"]))), "")
        return F.struct(F.concat(F.lit("+"), x["full"]).alias("e164"), F.concat(F.lit("+"), F.left(x["full"], x["end"]["code"]), F.lit(" "), number).alias("display"), x["end"]["kind"].alias("type"))

    parts = F.struct(full.alias("full"), F.get(table, _end(full)).alias("end"))
    return _let(parts, lambda x: F.when(x["end"].isNotNull(), shown(x)))


def normalize_phone(raw: Column, region: Column) -> Column:
    """struct(e164, display, type) of a valid number, else null (B25). A number without + or 00 is one of its region, with or
    without the trunk prefix."""
    digits = F.regexp_replace(F.regexp_replace(raw, r"\(0\)", ""), "[^0-9]", "")
    abroad = raw.rlike(r"^\s*(?:tel:)?\s*(\+|00)")
    full = F.when(raw.rlike(r"^\s*(?:tel:)?\s*00"), F.substring(digits, 3, 40)).otherwise(digits)
    homes = F.from_json(F.lit(json.dumps({name: {"code": code, "trunk": trunk} for name, (code, trunk, _) in PLAN.items()})), "map<string,struct<code:string,trunk:string>>")

    def tried(v: Column) -> Column:
        """Full numbers that the digits may stand for, the likeliest first."""
        code, trunk = v["home"]["code"], v["home"]["trunk"]
        bare = F.when((trunk != "") & F.startswith(v["digits"], trunk), F.concat(code, F.substr(v["digits"], F.length(trunk) + 1)))
        local = F.array(F.concat(code, v["digits"]), bare)
        return F.filter(F.when(v["abroad"], F.array(v["full"])).otherwise(local), lambda x: x.isNotNull())

    parts = F.struct(digits.alias("digits"), abroad.alias("abroad"), full.alias("full"), F.element_at(homes, F.upper(region)).alias("home"))
    numbers = _let(parts, lambda v: F.filter(F.transform(tried(v), _found), lambda n: n.isNotNull()))
    return F.when(raw.rlike(_SHAPE), F.get(numbers, F.lit(0)))


def phone_parts(raw: Column) -> Column:
    """A raw value whole, then the parts of it: one number is tried before many."""
    return F.concat(F.array(raw), F.split(raw, SEPARATORS))


def first_valid(raws: Column, region: Column) -> Column:
    """The first valid number of an array of raw values, as normalize_phone."""
    tried = F.transform(F.flatten(F.transform(raws, phone_parts)), lambda p: normalize_phone(p, region))
    return F.get(F.filter(tried, lambda n: n.isNotNull()), F.lit(0))


def without_tax_ids(text: Column) -> Column:
    """Blanks out tax numbers, which look like phone numbers."""
    return F.regexp_replace(text, "(?i)" + fixed.VAT, " ")


def text_phones(text: Column, region: Column) -> Column:
    """Valid numbers of running text in E.164, without tax numbers and network addresses."""
    plain = F.regexp_replace(without_tax_ids(text), DOTTED_QUAD, " ")
    seen = F.regexp_extract_all(plain, F.lit(IN_TEXT), F.lit(0))
    found = F.array_distinct(F.filter(F.transform(seen, lambda p: normalize_phone(p, region)["e164"]), lambda p: p.isNotNull()))
    return F.when(text.rlike("[0-9]"), found).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))


def page_phones(page: Column, region: Column) -> Column:
    """tel: links as they are, then valid numbers of the visible text in E.164."""
    tel = F.filter(F.transform(page["links"], lambda x: x["href"]), lambda h: h.rlike("(?i)^tel:"))
    tel = F.transform(tel, lambda h: F.trim(F.substring(h, 5, 1 << 20)))
    return F.array_distinct(F.concat(tel, text_phones(page["text"], region)))
