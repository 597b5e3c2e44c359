"""Numbering plans of regions, and the automaton over digits that they make.

A plan is the calling code, the trunk prefix that is dialled inside the country, and kinds of national numbers: type, patterns and
the groups a number is written in. In a pattern, X is any digit, brackets hold a choice, braces count, and bars separate patterns.
The first kind that matches is the number's. The plans are an approximation of the full metadata: number blocks are coarser, and
numbers of regions that aren't listed are not known.

All plans become one automaton over the digits of a full number, calling code first. It is acyclic and minimal, so a number
costs a table look-up a digit, whatever the number of regions.
"""

from __future__ import annotations

import functools
import re

MOBILE, LAND, EITHER, FREE, VOIP, OTHER = "Mobile", "Landline", "Landline/Mobile", "Toll-free", "VoIP", "Other"

Kind = tuple[str, str, str]
#: North America: one plan for all regions with calling code 1
_NANP: list[Kind] = [(FREE, "8(00|33|44|55|66|77|88)[2-9]X{6}", "3-3-4"), (OTHER, "900[2-9]X{6}", "3-3-4"), (EITHER, "[2-9][0-8]X[2-9]X{6}", "3-3-4")]

#: region: (calling code, trunk prefix, [(type, patterns, groups)])
PLAN: dict[str, tuple[str, str, list[Kind]]] = {
    "AE": ("971", "0", [(MOBILE, "5[024-68]X{7}", "2 3 4"), (FREE, "800X{2,9}", "3 9"), (OTHER, "600X{6}|900X{5,6}", "3 6"), (LAND, "[2-4679][2-8]X{6}", "1 3 4")]),
    "AR": ("54", "0", [(MOBILE, "911X{8}", "1 2 4-4"), (MOBILE, "9[23]X{9}", "1 3 3-4"), (FREE, "800X{7}", "3 3 4"), (EITHER, "11X{8}", "2 4-4"), (EITHER, "[23]X{9}", "3 3-4")]),
    "AT": ("43", "0", [(MOBILE, "6[5-9]X{7,11}", "3 11"), (FREE, "800X{6,10}", "3 10"), (OTHER, "8[12]0X{6,9}|9[03]0X{6,9}", "3 9"), (VOIP, "7[28]0X{6,10}", "3 10"), (LAND, "1X{4,12}", "1 12"), (LAND, "[2-57]X{5,11}", "3 9")]),
    "AU": ("61", "0", [(MOBILE, "4X{8}", "3 3 3"), (FREE, "1800X{6}", "4 3 3"), (OTHER, "1[39]00X{6}", "4 3 3"), (OTHER, "13[1-9]X{3}", "2 2 2"), (LAND, "[2378]X{8}", "1 4 4")]),
    "BD": ("880", "0", [(MOBILE, "1[3-9]X{8}", "4-6"), (LAND, "2X{7,8}", "1-8"), (LAND, "[3-9]X{6,8}", "3-6")]),
    "BE": ("32", "0", [(MOBILE, "4[5-9]X{7}", "3 2 2 2"), (FREE, "800X{5}", "3 2 3"), (OTHER, "90X{6}|70X{6}", "3 2 3"), (LAND, "[2349]X{7}", "1 3 2 2"), (LAND, "[15-8]X{7}", "2 2 2 2")]),
    "BG": ("359", "0", [(MOBILE, "8[789]X{7}|98[89]X{6}", "2 3 4"), (FREE, "800X{5}", "3 2 3"), (OTHER, "90X{6}|700X{5}", "3 2 3"), (LAND, "2X{6,7}", "1 3 4"), (LAND, "[3-9]X{6,7}", "2 3 3")]),
    "BH": ("973", "", [(MOBILE, "3X{7}|66X{6}", "4 4"), (FREE, "80X{6}", "4 4"), (OTHER, "90X{6}", "4 4"), (LAND, "1[367]X{6}|77X{6}", "4 4")]),
    "BR": ("55", "0", [(MOBILE, "[1-9][1-9]9X{8}", "2 5-4"), (FREE, "800X{6,7}", "3 3 4"), (OTHER, "[359]00X{6,7}", "3 3 4"), (LAND, "[1-9][1-9][2-5]X{7}", "2 4-4")]),
    "BY": ("375", "8", [(MOBILE, "(25|29|33|44)X{7}", "2 3-2-2"), (FREE, "80[13]X{7}", "3 3 4"), (LAND, "1[5-7]X{7}|2[1-3]X{7}", "2 3-2-2")]),
    "CA": ("1", "1", _NANP),
    "CH": ("41", "0", [(MOBILE, "7[5-9]X{7}", "2 3 2 2"), (FREE, "800X{6}", "3 3 3"), (OTHER, "84[0248]X{6}|90[016]X{6}", "3 3 3"), (LAND, "[2-6]X{8}|[89]1X{7}", "2 3 2 2")]),
    "CL": ("56", "", [(MOBILE, "9X{8}", "1 4 4"), (FREE, "800X{6}", "3 3 3"), (OTHER, "600X{6,8}", "3 3 4"), (VOIP, "44X{7}", "2 3 4"), (LAND, "2X{8}", "1 4 4"), (LAND, "[3-7]X{8}", "2 3 4")]),
    "CN": ("86", "0", [(MOBILE, "1[3-9]X{9}", "3 4 4"), (FREE, "800X{7}", "3 3 4"), (OTHER, "400X{7}", "3 3 4"), (LAND, "10X{8}|2[0-57-9]X{8}", "2 4 4"), (LAND, "[3-9][1-9]X{8,9}", "3 4 4")]),
    "CO": ("57", "", [(MOBILE, "3X{9}", "3 7"), (FREE, "1800X{7}", "1 3 7"), (LAND, "60[1-8]X{7}", "3 7")]),
    "CZ": ("420", "", [(MOBILE, "60[1-8]X{6}|7[02-9]X{7}", "3 3 3"), (FREE, "800X{6}", "3 3 3"), (OTHER, "9X{8}|8[134]X{7}", "3 3 3"), (LAND, "[2-5]X{8}", "3 3 3")]),
    "DE": ("49", "0", [(MOBILE, "15X{9}|1[67]X{8,9}", "3 8"), (FREE, "800X{7,12}", "3 12"), (VOIP, "32X{9,11}", "3 12"), (OTHER, "900X{7}|1(37|80)X{6,8}", "3 8"), (LAND, "(30|40|69|89)X{4,9}", "2 9"), (LAND, "[2-9]X{5,10}", "3 8")]),
    "DK": ("45", "", [(FREE, "80X{6}", "2 2 2 2"), (OTHER, "90X{6}", "2 2 2 2"), (EITHER, "[2-9]X{7}", "2 2 2 2")]),
    "DZ": ("213", "0", [(MOBILE, "[5-7]X{8}", "3 2 2 2"), (FREE, "800X{6}", "3 2 2 2"), (LAND, "[2-4]X{7}", "2 2 2 2")]),
    "EC": ("593", "0", [(MOBILE, "9X{8}", "2 3 4"), (FREE, "1800X{6,7}", "4 3 4"), (LAND, "[2-7]X{7}", "1-3-4")]),
    "EE": ("372", "", [(MOBILE, "5X{6,7}|8[1-4]X{6}", "4 4"), (FREE, "800X{4,7}", "3 4 3"), (OTHER, "90[0-2]X{4}", "3 4"), (LAND, "[3-7]X{6}", "3 4")]),
    "EG": ("20", "0", [(MOBILE, "1[0-25]X{8}", "2 8"), (FREE, "800X{7}", "3 3 4"), (OTHER, "900X{7}", "3 3 4"), (LAND, "[23]X{8}", "1 8"), (LAND, "[4-9]X{8}", "2 7")]),
    "ES": ("34", "", [(MOBILE, "6X{8}|7[1-4]X{7}", "3 2 2 2"), (FREE, "[89]00X{6}", "3 2 2 2"), (OTHER, "90[1-9]X{6}|80[367]X{6}|70X{7}", "3 2 2 2"), (LAND, "[89][1-8]X{7}", "3 2 2 2")]),
    "FI": ("358", "0", [(MOBILE, "4[0-69]X{4,8}|50X{4,8}", "2 8"), (FREE, "800X{4,6}", "3 6"), (OTHER, "[67]00X{4,6}|(10|20|29|30|71|73|75)X{4,8}", "3 6"), (LAND, "(1[3-79]|[235689])X{5,9}", "2 9")]),
    "FR": ("33", "0", [(MOBILE, "[67]X{8}", "1 2 2 2 2"), (FREE, "80[0-5]X{6}", "1 2 2 2 2"), (VOIP, "9X{8}", "1 2 2 2 2"), (OTHER, "8[129]X{7}|80[6-9]X{6}", "1 2 2 2 2"), (LAND, "[1-5]X{8}", "1 2 2 2 2")]),
    "GB": ("44", "0", [(MOBILE, "7[1-57-9]X{8}", "4 6"), (FREE, "80[08]X{6,7}", "3 3 4"), (VOIP, "56X{8}", "2 4 4"), (OTHER, "70X{8}|84[2-5]X{7}|87[0-3]X{7}|9[018]X{8}|3[0347]X{8}|55X{8}", "3 3 4"), (LAND, "2[03489]X{8}", "2 4 4"), (LAND, "1X{8,9}", "4 6")]),
    "GH": ("233", "0", [(MOBILE, "2[034-8]X{7}|5[03-9]X{7}", "2 3 4"), (FREE, "800X{5}", "3 5"), (LAND, "3X{8}", "2 3 4")]),
    "GR": ("30", "", [(MOBILE, "69X{8}", "3 3 4"), (FREE, "800X{7}", "3 3 4"), (OTHER, "90[19]X{7}|80[16]X{7}|70X{8}", "3 3 4"), (LAND, "21X{8}", "2 4 4"), (LAND, "2[2-8]X{8}", "4 6")]),
    "HK": ("852", "", [(MOBILE, "[569]X{7}", "4 4"), (FREE, "800X{6}", "3 3 3"), (OTHER, "900X{8}", "3 2 3 3"), (LAND, "[23]X{7}", "4 4")]),
    "HR": ("385", "0", [(MOBILE, "9[125789]X{6,7}", "2 3 4"), (FREE, "800X{4,6}", "3 3 3"), (OTHER, "6[01]X{4,6}", "2 2 4"), (LAND, "1X{7}", "1 4 3"), (LAND, "[2-5]X{7}", "2 3 3")]),
    "HU": ("36", "06", [(MOBILE, "[2357]0X{7}|31X{7}", "2 3 4"), (FREE, "[48]0X{6}", "2 3 3"), (OTHER, "9[01]X{6}", "2 3 3"), (VOIP, "21X{7}", "2 3 4"), (LAND, "1X{7}", "1 3 4"), (LAND, "[2-9]X{7}", "2 3 3")]),
    "ID": ("62", "0", [(MOBILE, "8[1-9]X{7,10}", "3-4-4"), (FREE, "800X{5,7}", "3 7"), (LAND, "21X{7,8}", "2 8"), (LAND, "[2-79]X{7,9}", "3 7")]),
    "IE": ("353", "0", [(MOBILE, "8[356-9]X{7}", "2 3 4"), (FREE, "1800X{6}", "4 3 3"), (OTHER, "818X{6}|15[2-9]0X{6}", "3 3 4"), (VOIP, "76X{7}", "2 3 4"), (LAND, "1X{7}", "1 3 4"), (LAND, "[24-79]X{6,8}", "2 3 4")]),
    "IL": ("972", "0", [(MOBILE, "5X{8}", "2-3-4"), (FREE, "180[019]X{6}", "1-3-3-3"), (OTHER, "1700X{6}", "1-3-3-3"), (VOIP, "7[2-9]X{7}", "2-3-4"), (LAND, "[23489]X{7}", "1-3-4")]),
    "IN": ("91", "0", [(MOBILE, "[6-9]X{9}", "5 5"), (FREE, "1800X{6,7}", "4 3 4"), (OTHER, "1860X{7}", "4 3 4"), (LAND, "(11|2[02]|33|4[04])X{8}", "2 4 4"), (LAND, "[1-5]X{9}", "3 3 4")]),
    "IQ": ("964", "0", [(MOBILE, "7[3-9]X{8}", "3 3 4"), (LAND, "1X{7}", "1 3 4"), (LAND, "[2-6]X{7,8}", "2 3 4")]),
    "IR": ("98", "0", [(MOBILE, "9X{9}", "3 3 4"), (LAND, "[1-8]X{9}", "2 4 4")]),
    "IS": ("354", "", [(MOBILE, "6[1-9]X{5}|7[57]X{5}|8[2-9]X{5}", "3 4"), (FREE, "80[0-8]X{4}", "3 4"), (OTHER, "90X{5}", "3 4"), (VOIP, "49X{5}", "3 4"), (LAND, "4[1-8]X{5}|5X{6}", "3 4")]),
    "IT": ("39", "", [(MOBILE, "3X{8,9}", "3 3 4"), (FREE, "800X{6}|803X{3}", "3 3 3"), (VOIP, "55X{8}", "2 4 4"), (OTHER, "84[078]X{6}|89[259]X{3,6}|199X{6}", "3 3 3"), (LAND, "0[26]X{7,9}", "2 4 5"), (LAND, "0[1-9]X{4,9}", "4 7")]),
    "JO": ("962", "0", [(MOBILE, "7[789]X{7}", "1 4 4"), (FREE, "80X{6}", "3 5"), (LAND, "[2356]X{7}", "1 3 4")]),
    "JP": ("81", "0", [(MOBILE, "[789]0X{8}", "2-4-4"), (FREE, "120X{6}", "3-3-3"), (FREE, "800X{7}", "3-3-4"), (VOIP, "50X{8}", "2-4-4"), (OTHER, "570X{6}|990X{6}", "3-3-3"), (LAND, "[36]X{8}", "1-4-4"), (LAND, "[1245789]X{8}", "2-3-4")]),
    "KE": ("254", "0", [(MOBILE, "7X{8}|1[01]X{7}", "3 6"), (FREE, "800X{6}", "3 6"), (LAND, "[24-6]X{6,8}", "2 7")]),
    "KR": ("82", "0", [(MOBILE, "1X{8}", "2-3-4"), (MOBILE, "1X{9}", "2-4-4"), (FREE, "80X{7}", "2-3-4"), (VOIP, "70X{8}", "2-4-4"), (OTHER, "60X{7}", "2-3-4"), (LAND, "2[2-9]X{6}", "1-3-4"), (LAND, "2[2-9]X{7}", "1-4-4"), (LAND, "[3-6][1-5][2-9]X{6}", "2-3-4"), (LAND, "[3-6][1-5][2-9]X{7}", "2-4-4")]),
    "KW": ("965", "", [(MOBILE, "[569]X{7}", "4 4"), (FREE, "18X{5}", "3 4"), (LAND, "2[2-5]X{6}", "4 4")]),
    "KZ": ("7", "8", [(MOBILE, "7(0[0-25-8]|47|7[1578])X{7}", "3 3 4"), (LAND, "7[12]X{8}", "3 3 4")]),
    "LB": ("961", "0", [(MOBILE, "3X{6}", "1 3 3"), (MOBILE, "7[0168]X{6}|81X{6}", "2 3 3"), (LAND, "[14-9]X{6}", "1 3 3")]),
    "LK": ("94", "0", [(MOBILE, "7[0-8]X{7}", "2 3 4"), (LAND, "[1-689]X{8}", "2 3 4")]),
    "LT": ("370", "8", [(MOBILE, "6X{7}", "3 5"), (FREE, "800X{5}", "3 2 3"), (OTHER, "70X{6}|90[0239]X{5}|808X{5}", "3 2 3"), (LAND, "37X{6}|4[156]X{6}", "2 6"), (LAND, "3[148]X{6}|4[02-47-9]X{6}", "3 5"), (LAND, "52X{6}", "1 3 4")]),
    "LU": ("352", "", [(MOBILE, "6[269]1X{6}", "3 3 3"), (FREE, "800X{5}", "3 2 3"), (OTHER, "90[015]X{5}|801X{5}", "3 2 3"), (LAND, "[2-9]X{3,10}", "2 2 2 2 2")]),
    "LV": ("371", "", [(MOBILE, "2X{7}", "2 3 3"), (FREE, "80X{6}", "2 3 3"), (OTHER, "90X{6}|81X{6}", "2 3 3"), (LAND, "6[3-8]X{6}", "2 3 3")]),
    "MA": ("212", "0", [(MOBILE, "[67]X{8}", "3-6"), (FREE, "80X{7}", "2-7"), (OTHER, "89X{7}", "2-7"), (LAND, "5[2-4]X{7}", "4-5")]),
    "MX": ("52", "", [(FREE, "8(00|88)X{7}", "3 3 4"), (OTHER, "900X{7}", "3 3 4"), (EITHER, "(33|55|56|81)X{8}", "2 4 4"), (EITHER, "[2-9]X{9}", "3 3 4")]),
    "MY": ("60", "0", [(MOBILE, "11X{8}", "2-4 4"), (MOBILE, "1[02-46-9]X{7}", "2-3 4"), (FREE, "1[38]00X{6}", "1-3-2-4"), (OTHER, "1600X{6}", "1-3-2-4"), (VOIP, "15X{8}", "2-4 4"), (LAND, "3X{8}", "1-4 4"), (LAND, "[4-79]X{7}", "1-3 4"), (LAND, "8X{7}", "2-3 3")]),
    "NG": ("234", "0", [(MOBILE, "[789][01]X{8}", "3 3 4"), (FREE, "800X{7,11}", "3 4 4"), (LAND, "[1-9]X{6,7}", "1 3 4")]),
    "NL": ("31", "0", [(MOBILE, "6[1-58]X{7}", "1 8"), (FREE, "800X{4,7}", "3 7"), (OTHER, "90[069]X{4,7}", "3 7"), (OTHER, "88X{7}", "2 3 4"), (VOIP, "(85|91)X{7}", "2 3 4"), (LAND, "(10|20|30|40|50|70|[1-57][1-9])X{7}", "2 3 4")]),
    "NO": ("47", "", [(MOBILE, "[49]X{7}", "3 2 3"), (FREE, "80[01]X{5}", "3 2 3"), (OTHER, "8[12]X{6}", "3 2 3"), (LAND, "[2367]X{7}", "2 2 2 2")]),
    "NP": ("977", "0", [(MOBILE, "9[678]X{8}", "3-7"), (LAND, "1X{7}", "1-7"), (LAND, "[2-9]X{7}", "2-6")]),
    "NZ": ("64", "0", [(MOBILE, "2[0-27-9]X{6,8}", "2 3 5"), (FREE, "508X{6}|800X{6,7}", "3 3 4"), (OTHER, "900X{5,7}", "3 3 4"), (LAND, "[34679]X{7}", "1 3 4")]),
    "OM": ("968", "", [(MOBILE, "[79][1-9]X{6}", "4 4"), (FREE, "800X{5,6}", "3 6"), (LAND, "2[2-6]X{6}", "2 6")]),
    "PE": ("51", "0", [(MOBILE, "9X{8}", "3 3 3"), (FREE, "800X{5}", "3 5"), (LAND, "1X{7}", "1 7"), (LAND, "[4-8]X{7}", "2 6")]),
    "PH": ("63", "0", [(MOBILE, "9X{9}", "3 3 4"), (FREE, "1800X{7,9}", "4 3 4"), (LAND, "2X{8}", "1 4 4"), (LAND, "[3-8]X{8}", "2 3 4")]),
    "PK": ("92", "0", [(MOBILE, "3X{9}", "3 7"), (FREE, "800X{5}", "3 5"), (OTHER, "900X{5}", "3 5"), (LAND, "(21|4[1-9]|5[1-7]|61|71|81|91)X{7,8}", "2 8"), (LAND, "2[1-9]X{7,8}|[45]X{8,9}|[6-9]X{7,9}", "3 7")]),
    "PL": ("48", "", [(MOBILE, "(45|5[0137]|6[069]|7[2389]|88)X{7}", "3 3 3"), (FREE, "800X{6}", "3 3 3"), (OTHER, "70X{7}|80[14]X{6}", "3 3 3"), (VOIP, "39X{7}", "2 3 2 2"), (LAND, "[1-9][1-9]X{7}", "2 3 2 2")]),
    "PT": ("351", "", [(MOBILE, "9[1-36]X{7}", "3 3 3"), (FREE, "80[02]X{6}", "3 3 3"), (OTHER, "(808|76[01]|707)X{6}", "3 3 3"), (VOIP, "30X{7}", "3 3 3"), (LAND, "2[12]X{7}", "2 3 4"), (LAND, "2[3-9]X{7}", "3 3 3")]),
    "QA": ("974", "", [(MOBILE, "[35-7]X{7}", "4 4"), (FREE, "800X{4}", "3 4"), (LAND, "4[04]X{6}", "4 4")]),
    "RO": ("40", "0", [(MOBILE, "7X{8}", "3 3 3"), (FREE, "800X{6}", "3 3 3"), (OTHER, "90[0136]X{6}|80[126]X{6}", "3 3 3"), (LAND, "[23]1X{7}", "2 3 4"), (LAND, "[23][3-6]X{7}", "3 3 3")]),
    "RS": ("381", "0", [(MOBILE, "6[0-689]X{6,8}", "2 8"), (FREE, "800X{3,9}", "3 9"), (OTHER, "90[0169]X{3,7}", "3 7"), (LAND, "[1-3]X{6,9}", "2 8")]),
    "RU": ("7", "8", [(MOBILE, "9X{9}", "3 3-2-2"), (FREE, "80[04]X{7}", "3 3-2-2"), (OTHER, "80[39]X{7}", "3 3-2-2"), (LAND, "[348]X{9}", "3 3-2-2")]),
    "SA": ("966", "0", [(MOBILE, "5X{8}", "2 3 4"), (FREE, "800X{7}", "3 3 4"), (OTHER, "92X{7}", "4 5"), (LAND, "1[1-467]X{7}", "2 3 4")]),
    "SE": ("46", "0", [(MOBILE, "7[02369]X{7}", "2 3 2 2"), (FREE, "20X{4,7}", "2 3 4"), (OTHER, "900X{4,7}|77X{7}", "3 3 4"), (LAND, "8X{6,8}", "1 3 3 2"), (LAND, "(1[0-689]|[2-69][0-9])X{5,7}", "2 3 2 2")]),
    "SG": ("65", "", [(MOBILE, "[89]X{7}", "4 4"), (FREE, "1?800X{7}", "4 3 4"), (VOIP, "3X{7}", "4 4"), (OTHER, "1900X{7}|7000X{7}", "4 3 4"), (LAND, "6X{7}", "4 4")]),
    "SI": ("386", "0", [(MOBILE, "(3[01]|4[01]|51|6[458]|7[01])X{6}", "2 3 3"), (FREE, "80X{4,6}", "2 6"), (OTHER, "90X{4,6}", "2 6"), (LAND, "[1-57]X{7}", "1 3 2 2")]),
    "SK": ("421", "0", [(MOBILE, "9X{8}", "3 3 3"), (FREE, "800X{6}", "3 3 3"), (OTHER, "8[5-9]X{7}", "3 3 3"), (LAND, "2X{8}", "1 3 3 2"), (LAND, "[3-5]X{8}", "2 3 2 2")]),
    "TH": ("66", "0", [(MOBILE, "[689]X{8}", "2 3 4"), (FREE, "1800X{6}", "4 3 3"), (OTHER, "1900X{6}", "4 3 3"), (LAND, "2X{7}", "1 3 4"), (LAND, "[3-57]X{7}", "2 3 3")]),
    "TN": ("216", "", [(MOBILE, "[2459]X{7}", "2 3 3"), (FREE, "80X{6}", "2 3 3"), (OTHER, "8[18]X{6}", "2 3 3"), (LAND, "[37]X{7}", "2 3 3")]),
    "TR": ("90", "0", [(MOBILE, "5X{9}", "3 3 2 2"), (FREE, "800X{7}", "3 3 2 2"), (OTHER, "444X{4}", "3 1 3"), (OTHER, "(850|900)X{7}", "3 3 2 2"), (LAND, "[2-4]X{9}", "3 3 2 2")]),
    "TW": ("886", "0", [(MOBILE, "9X{8}", "3 3 3"), (FREE, "80[0-8]X{6}", "3 3 3"), (VOIP, "70X{8}", "2 4 4"), (LAND, "2X{8}", "1 4 4"), (LAND, "[3-8]X{7}", "1 3 4"), (LAND, "4X{8}", "1 4 4")]),
    "TZ": ("255", "0", [(MOBILE, "[67][1-9]X{7}", "3 3 3"), (FREE, "80[08]X{6}", "3 3 3"), (LAND, "2[2-8]X{7}", "2 3 4")]),
    "UA": ("380", "0", [(MOBILE, "(39|50|6[36-8]|7[37]|9[1-9])X{7}", "2 3 4"), (FREE, "800X{6}", "3 3 3"), (OTHER, "900X{6}", "3 3 3"), (VOIP, "89X{7}", "2 3 4"), (LAND, "[3-6]X{8}", "2 3 4")]),
    "UG": ("256", "0", [(MOBILE, "7[0-8]X{7}", "3 6"), (FREE, "800X{6}", "3 6"), (LAND, "[34]X{8}", "3 6")]),
    "US": ("1", "1", _NANP),
    "UY": ("598", "0", [(MOBILE, "9[1-9]X{6}", "2 3 3"), (FREE, "80[05]X{4}", "3 4"), (LAND, "[24]X{7}", "4 4")]),
    "VE": ("58", "0", [(MOBILE, "4(1[246]|2[46])X{7}", "3-7"), (FREE, "800X{7}", "3-7"), (LAND, "2X{9}", "3-7")]),
    "VN": ("84", "0", [(MOBILE, "(3[2-9]|5[25689]|7[06-9]|8[1-9]|9[0-9])X{7}", "2 3 2 2"), (FREE, "1800X{4,6}", "4 6"), (OTHER, "1900X{4,6}", "4 6"), (LAND, "2[48]X{8}", "2 4 4"), (LAND, "2[0-35-79]X{8}", "3 4 3")]),
    "ZA": ("27", "0", [(MOBILE, "6X{8}|7[1-46-9]X{7}|8[1-5]X{7}", "2 3 4"), (FREE, "80X{7}", "2 3 4"), (OTHER, "8[69]X{7}|90X{7}", "2 3 4"), (VOIP, "87X{7}", "2 3 4"), (LAND, "[1-5]X{8}", "2 3 4")]),
}

_ANY = "0123456789"


def _bars(pattern: str) -> list[str]:
    """The parts of a pattern between bars that stand in no parentheses."""
    parts, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def sequences(pattern: str) -> list[tuple[str, ...]]:
    """All sequences of digit sets that a pattern stands for."""
    out: list[tuple[str, ...]] = []
    for part in _bars(pattern):
        if inner := re.search(r"\(([^()]*)\)", part):
            out += [s for choice in inner[1].split("|") for s in sequences(part[: inner.start()] + choice + part[inner.end() :])]
            continue
        found: list[tuple[str, ...]] = [()]
        for atom, low, high, maybe in re.findall(r"(\[[^\]]+\]|[0-9X])(?:\{(\d+)(?:,(\d+))?\}|(\?))?", part):
            digits = _ANY if atom == "X" else re.sub(r"(\d)-(\d)", lambda m: "".join(map(str, range(int(m[1]), int(m[2]) + 1))), atom.strip("[]"))
            least, most = (0, 1) if maybe else (int(low or 1), int(high or low or 1))
            found = [(*s, *[digits] * n) for s in found for n in range(least, most + 1)]
        out += found
    return out


@functools.cache
def automaton() -> tuple[list[int], list[int], list[tuple[str, str, int]]]:
    """(steps, kinds, ends): steps[10 * state + digit] is the next state, 0 for none; state 1 is the first; kinds[state] is a
    place in ends, where the digits so far are a number, else -1; ends are (type, groups, digits of the calling code)."""
    ends: list[tuple[str, str, int]] = []
    items: list[tuple[int, tuple[str, ...]]] = []
    for code, _, kinds in PLAN.values():
        for kind, pattern, groups in kinds:
            end = (kind, groups, len(code))
            if end not in ends:
                ends.append(end)
            items += [(ends.index(end), (*code, *s)) for s in sequences(pattern)]
    steps, marks, known = [0] * 10, [-1], {}

    @functools.cache
    def state(left: tuple[tuple[int, tuple[str, ...]], ...]) -> int:
        """The state of what is left of each pattern, in the order of the kinds."""
        end = next((e for e, s in left if not s), -1)
        row = []
        for digit in _ANY:
            after = tuple(dict.fromkeys((e, s[1:]) for e, s in left if s and digit in s[0]))
            row.append(state(after) if after else 0)
        shape = (end, *row)
        if shape not in known:
            known[shape] = len(marks)
            marks.append(end)
            steps.extend(row)
        return known[shape]

    first = state(tuple(items))
    if first != 1:  # the first state comes last: give it the number 1
        swap = {1: first, first: 1}
        blocks = [steps[10 * i : 10 * i + 10] for i in range(len(marks))]
        blocks[1], blocks[first] = blocks[first], blocks[1]
        marks[1], marks[first] = marks[first], marks[1]
        steps = [swap.get(s, s) for b in blocks for s in b]
    return steps, marks, ends
