"""DuckDB statements that say the same as the registered queries."""

from __future__ import annotations

from ..functions import fixed, urls as U
from . import inputs as I
from .entries import ASKED, CATEGORIES, LINKS, N_LEADS, REGIONS

LEADS, MESSY, PAGES, HISTORY = (I.duck(s) for s in (I.LEADS, I.MESSY, I.PAGES, I.HISTORY))


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(values) -> str:
    return "(" + ", ".join(map(text, values)) + ")"


def host(u: str) -> str:
    full = f"case when contains({u}, '://') then {u} else '//' || {u} end"
    return f"lower(regexp_extract(regexp_replace(regexp_extract({full}, {text(U.SCHEME_HOST)}, 1), '^.*@', ''), {text(U.HOST_PART)}, 1))"


def bare(u: str) -> str:
    return f"regexp_replace({host(u)}, '^www\\.', '')"


def social(u: str) -> str:
    return f"(regexp_matches({bare(u)}, {text(U.NOT_OWN)}) or regexp_matches({bare(u)}, {text(fixed.GOOGLE_HOST)}))"


def website(u: str) -> str:
    w = f"trim({u})"
    return f"case when {w} = '' or {social(w)} then '' when regexp_matches({w}, '(?i)^[a-z][a-z0-9+.\\-]*://') then {w} else 'http://' || {w} end"


def clean_email(raw: str) -> str:
    """Over raw text whose only escape is %20."""
    e = f"lower(regexp_replace(regexp_replace(trim(replace({raw}, '%20', ' ')), '^[.,;:<>()\\[\\]\"'']+', ''), '[.,;:<>()\\[\\]\"'']+$', ''))"
    e = f"trim(regexp_extract(regexp_replace({e}, '^mailto:', ''), '^[^?]*', 0))"
    domain, local = f"regexp_extract({e}, '@(.*)$', 1)", f"regexp_extract({e}, '^(.*)@', 1)"
    return f"""case when regexp_matches({e}, {text(fixed.EMAIL)}) and regexp_extract({e}, '([^.]*)$', 1) not in {words(fixed.FILE_EXTENSIONS)}
      and not contains({e}, '..') and {domain} not in {words(fixed.JUNK_DOMAINS)} and not regexp_matches({local}, {text(fixed.JUNK_LOCAL)}) then {e} end"""


AT = "(?i)\\s*[\\[\\(\\{]\\s*(?:" + "|".join(fixed.AT_WORDS) + ")\\s*[\\]\\)\\}]\\s*"
DOT = "(?i)\\s*[\\[\\(\\{]\\s*(?:" + "|".join(fixed.DOT_WORDS) + ")\\s*[\\]\\)\\}]\\s*"


def deobfuscate(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, {text(AT)}, '@', 'g'), {text(DOT)}, '.', 'g')"


def unglue(t: str) -> str:
    return f"regexp_replace({t}, {text(fixed.GLUED_TLD)}, '\\1')"


#: What the numbers of MESSY may be, as patterns: region: (calling code, trunk prefix, [(type, digits)], [(digits, groups)])
_PLAN = {
    "DE": ("49", "0", [("Mobile", "1(5[0-9]{9}|[67][0-9]{8,9})"), ("Toll-free", "800[0-9]{7,12}"), ("VoIP", "32[0-9]{9,11}"), ("Landline", "[2-9][0-9]{5,10}")],
           [("(1[567][0-9])([0-9]{7,8})", "$1 $2"), ("(30|40|69|89)([0-9]{4,9})", "$1 $2"), ("([2-9][0-9]{2})([0-9]{3,8})", "$1 $2")]),
    "FR": ("33", "0", [("Mobile", "[67][0-9]{8}"), ("Toll-free", "80[0-5][0-9]{6}"), ("VoIP", "9[0-9]{8}"), ("Landline", "[1-5][0-9]{8}")],
           [("([0-9])([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})", "$1 $2 $3 $4 $5")]),
    "GB": ("44", "0", [("Mobile", "7[1-57-9][0-9]{8}"), ("Toll-free", "80[08][0-9]{6,7}"), ("VoIP", "56[0-9]{8}"), ("Landline", "(2[03489][0-9]{8}|1[0-9]{8,9})")],
           [("(2[0-9])([0-9]{4})([0-9]{4})", "$1 $2 $3"), ("(7[0-9]{3})([0-9]{6})", "$1 $2"), ("(1[0-9]{3})([0-9]{5,6})", "$1 $2"), ("(80[08])([0-9]{3})([0-9]{3,4})", "$1 $2 $3")]),
    "IT": ("39", "", [("Mobile", "3[0-9]{8,9}"), ("Toll-free", "80(0[0-9]{6}|3[0-9]{3})"), ("VoIP", "55[0-9]{8}"), ("Landline", "0[1-9][0-9]{4,9}")],
           [("(3[0-9]{2})([0-9]{3})([0-9]{3,4})", "$1 $2 $3"), ("(0[26])([0-9]{4})([0-9]{3,5})", "$1 $2 $3"), ("(0[0-9]{3})([0-9]{3,7})", "$1 $2")]),
    "PK": ("92", "0", [("Mobile", "3[0-9]{9}"), ("Toll-free", "800[0-9]{5}"), ("Landline", "(2[1-9][0-9]{7,8}|4[0-9]{8,9}|5[0-9]{8,9}|[6-9][0-9]{7,9})")],
           [("(3[0-9]{2})([0-9]{7})", "$1 $2"), ("(21|4[1-9]|5[1-7]|61|71|81|91)([0-9]{7,8})", "$1 $2"), ("([2-9][0-9]{2})([0-9]{6,7})", "$1 $2")]),
    "US": ("1", "1", [("Toll-free", "8(00|33|44|55|66|77|88)[2-9][0-9]{6}"), ("Landline/Mobile", "[2-9][0-8][0-9][2-9][0-9]{6}")],
           [("([0-9]{3})([0-9]{3})([0-9]{4})", "$1-$2-$3")]),
}


def phone(raw: str, region: str, part: str) -> str:
    """One field of a valid number (e164, display or type), '' if there is none."""
    digits = f"regexp_replace(regexp_replace({raw}, '\\(0\\)', '', 'g'), '[^0-9]', '', 'g')"
    abroad = f"regexp_matches({raw}, '^\\s*(\\+|00)')"
    full = f"(case when regexp_matches({raw}, '^\\s*00') then substr({digits}, 3) else {digits} end)"
    out = []
    for name, (code, trunk, kinds, groups) in _PLAN.items():
        local = digits
        if name == "US":
            local = f"(case when regexp_full_match({digits}, '1[0-9]{{10}}') then substr({digits}, 2) else {digits} end)"
        elif trunk:
            local = f"regexp_replace({digits}, '^{trunk}', '')"
        nsn = f"(case when {abroad} and starts_with({full}, '{code}') then substr({full}, {len(code) + 1}) when not {abroad} and {region} = '{name}' then {local} end)"
        if part == "type":
            out.append("case " + " ".join(f"when regexp_full_match({nsn}, '{p}') then '{t}'" for t, p in kinds) + " end")
            continue
        shown = f"'+{code}' || {nsn}"
        if part == "display":
            cases = " ".join(f"when regexp_full_match({nsn}, '{p}') then regexp_replace({nsn}, '^{p}$', '{g.replace('$', chr(92))}')" for p, g in groups)
            shown = f"'+{code} ' || case {cases} else {nsn} end"
        valid = " or ".join(f"regexp_full_match({nsn}, '{p}')" for _, p in kinds)
        out.append(f"case when {valid} then {shown} end")
    return f"case when regexp_full_match({raw}, '\\s*(\\+|00)?[0-9 ()./\\-]{{5,30}}\\s*') then coalesce({', '.join(out)}, '') else '' end"


# LEADS with validated contacts; every phone of it is a London number
DELIVERED = f"""delivered as (
  select *, case when raw_phone = '' then '' else replace(raw_phone, ' ', '') end as phone, raw_phone as phone_display,
    case when raw_email = '' or number % 3 = 1 then '' else lower(raw_email) end as email,
    case when {bare('site')} <> '' then {bare('site')} || '|' || nm else nm || '|' || case when raw_phone <> '' then right(replace(raw_phone, ' ', ''), 8) else lower(address) end end as lead_key
  from (select * exclude (website), {website('website')} as site, seq % 61 as number, 'biz' || cast(seq % 61 as string) as nm from ({LEADS}))
), leads as (select *, site as website from delivered)"""

NOTE = """case when email <> '' then '' when raw_email <> '' then 'Found ' || raw_email || ' but that address cannot receive mail'
  when website = '' then 'No website - email not available' else 'Not checked' end"""
IDENTITIES = """identities as (
  select seq, 'ids' as field, place_id as value from leads where place_id <> ''
  union all select seq, 'phones', phone from leads where website = '' and phone <> ''
  union all select seq, 'emails', email from leads where email <> ''
  union all select seq, 'keys', lead_key from leads where lead_key <> '')"""
TARGETS = f"""{DELIVERED}, first as (
  select *, first_value(seq) over w as s0, first_value(lead_key) over w as k0, first_value(lat) over w as lat0, first_value(lon) over w as lon0,
    first_value(place_id) over w as p0, first_value(source) over w as src0
  from leads window w as (partition by nm order by seq rows between unbounded preceding and unbounded following)
), near as (
  select *, coalesce(abs(lat - lat0) < 0.003 and abs(lon - lon0) < 0.003, false) and not (place_id <> '' and p0 <> '' and source = src0) as near from first
), opened as (
  select *, min(case when not near and lead_key <> k0 then seq end) over (partition by nm, lead_key) as opened from near
), targets as (
  select *, case when lead_key = k0 then s0 when opened < seq then opened when near then s0 else seq end as target from opened)"""
URL_ROOT = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
TEXT = "regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', ' ', 'g')"
_ASKED = ["UK", " uae", "de", "USA", "Deu", "xx", "Holland"]
_REGION = ", ".join(f"({text(c)}, {text(n.lower())}, {text(a.lower())}, {c != 'EG'})" for c, n, a in REGIONS)
_ALIAS = ", ".join(f"({text(k)}, {text(v)})" for k, v in fixed.COUNTRY_ALIASES.items())
_CATEGORY = ", ".join(f"({text(w)}, {text(k)}, {text(v)})" for w, tags in fixed.CATEGORY_TAGS.items() for k, v in tags)
QUALIFIES = "(phone <> '' or email <> '')"

ORACLE: dict[str, str] = {
    "a1_map_elements": f"select seq, name, lower(category) as category, address, website, raw_phone as phones, raw_email as emails, lat, lon, 'https://www.openstreetmap.org/node/' || cast(seq as string) as map_url from ({LEADS})",
    "a1_mail_lists": f"""select seq, 'x.it/' || seq % 10 as website, '0info' || seq || '@x.it; b@x.it' || seq % 10 || '; ' || seq % 10 || 'c@x.it' as emails from ({LEADS})""",
    "a2_place_records": f"""select seq, name, address, website, raw_phone as phones, lat, lon, 'maps/' || cast(seq % 500 as string) as map_url, 'Google Places' as source from ({LEADS})
      where seq % 10 <> 3 qualify row_number() over (partition by seq % 500 order by seq) = 1""",
    "a3_map_details": f"""select seq, case when seq % 4 = 0 then 'Listed ' || name else name end as name, raw_phone as phones,
      coalesce(nullif(regexp_extract(url, '!1s([^!?&]+)', 1), ''), nullif(regexp_extract(url, '/maps/place/([^/]+)/', 1), ''), url) as place_id,
      try_cast(nullif(regexp_extract(url, '!3d(-?[0-9.]+)!4d(-?[0-9.]+)', 1), '') as double) as lat, try_cast(nullif(regexp_extract(url, '!3d(-?[0-9.]+)!4d(-?[0-9.]+)', 2), '') as double) as lon, url as map_url
      from ({MESSY}) where seq % 9 <> 1 and seq % 8 <> 0""",
    "a4_readable_pages": """select page_id, url, length(t) as n, md5(t) as digest from (select page_id, url, regexp_replace(html, '[^\\x00-\\x7F]', '?', 'g') as t from pages)
      where page_id % 7 <> 0 and page_id % 5 <> 0""",
    "a5_history_read": f"""select distinct origin, field, value from ({HISTORY}), (values ('runs'), ('old')) o(origin)
      union select 'runs aside', 'unknown', value from ({HISTORY}) union select 'runs aside', field, '' from ({HISTORY}) 
      union select 'old aside', '', unnest(['{{"ids": 7', '{{"ids": [7, "x"], "phones": null}}', '{{"ids": ["x", null]}}', '[]'])""",
    "a8_export_rows": f"""with {DELIVERED} select name, phone_display as phone, coalesce(nullif(email, ''), {NOTE}) as email, address,
      case when website <> '' then 'Yes' else 'No' end as website_present, website from leads""",
    "a9_a10_labels_and_cells": f"""select seq, substr(lower(regexp_replace(regexp_replace(region || '_' || url || '_É 1', '[^\\p{{L}}\\p{{N}}_\\-]+', '_', 'g'), '^_+|_+$', '', 'g')), 1, 80) as label,
      case when seq % 4 = 1 then '+' else ' ' || case seq % 4 when 0 then '=1+' when 2 then '-' else '@' end end || raw_phone || 'x' as cell from ({MESSY})""",
    "b1_b8_urls": f"""with t as (select seq, url, trim(url) as u, case when regexp_matches(trim(url), '(?i)^[a-z]+://') then trim(url) else 'http://' || trim(url) end as full_url,
        regexp_replace(regexp_extract(regexp_replace(lower(url), '^[a-z]+://', ''), '^[^/:]*', 0), '^www\\.', '') as loose from ({MESSY}))
      select seq, case when u <> '' and regexp_matches(full_url, '(?i)^https?://') and {host('full_url')} <> ''
          and case when {host('full_url')} like '[%' then regexp_matches({host('full_url')}, '^\\[[23]') when regexp_matches({host('full_url')}, {text(U.V4)}) then not regexp_matches({host('full_url')}, {text(U.PRIVATE_V4)})
            else {host('full_url')} <> 'localhost' and contains({host('full_url')}, '.') end
          and not regexp_matches({bare('full_url')}, {text(U.SKIP)}) then full_url else '' end as b1_normalized,
        {social('url')} as b2_social, {website('url')} as b3_website, loose as b4_host,
        loose <> '' and (loose = 'blog.biz.fr' or 'blog.biz.fr' like '%.' || loose or loose like '%.blog.biz.fr') as b5_same_site,
        coalesce(nullif(regexp_extract(url, '!1s([^!?&]+)', 1), ''), nullif(regexp_extract(url, '/maps/place/([^/]+)/', 1), ''), url) as b7_place_id,
        try_cast(nullif(regexp_extract(url, '!3d(-?[0-9.]+)!4d(-?[0-9.]+)', 1), '') as double) as b8_lat,
        try_cast(nullif(regexp_extract(url, '!3d(-?[0-9.]+)!4d(-?[0-9.]+)', 2), '') as double) as b8_lon from t""",
    "b6_url_candidates": f"""with t as (select page_id, regexp_extract(url, '^([a-z]+)://', 1) as s, {host('url')} as h, regexp_replace(url, '^[A-Za-z]+://[^/?#:]*', '') as rest from pages),
      v as (select *, case when h like 'www.%' then substr(h, 5) else 'www.' || h end as twin, case when s = 'http' then 'https' else 'http' end as other from t)
      select page_id, pos, s2 || '://' || h2 || rest as candidate from (select page_id, 0 as pos, s as s2, h as h2, rest from v union all select page_id, 1, s, twin, rest from v
        union all select page_id, 2, other, h, rest from v union all select page_id, 3, other, twin, rest from v)""",
    "b12_b19_emails": f"""with t as (select seq, raw_email, {clean_email('raw_email')} as e from ({MESSY}))
      select seq, coalesce(e, '') as b12_clean, {deobfuscate('raw_email')} as b15_text, {unglue('raw_email')} as b16_unglued,
        regexp_matches(regexp_extract(coalesce(e, ''), '@(.*)$', 1) || '.', {text(fixed.CERTIFIED_MAIL)}) as b19_certified from t""",
    "b13_document_emails": f"""with f as (select doc_id, unnest(regexp_extract_all({deobfuscate('text')}, {text(fixed.EMAIL_FIND)})) as found from documents),
      u as (select doc_id, {unglue('found')} as found from f) select distinct doc_id, email from (select doc_id, {clean_email('found')} as email from u) where email is not null""",
    "b14_protected_emails": f"select seq, 'info@biz' || cast(seq % 97 as string) || '.it' as email from ({MESSY})",
    "b17_b18_embedded_emails": f"select page_id, 'info@' || site || '; help@' || site as emails from ({PAGES})",
    "b20_ranked_emails": f"""select seq, case when seq % 2 = 0 then 'luca@shop.' || s || '; info@' || s || '; mario@gmail.com; sales@gmail.com; a@studio.pec.it'
      else 'mario@gmail.com; luca@shop.' || s || '; info@' || s || '; sales@gmail.com; a@studio.pec.it' end as ranked from (select seq, 'biz' || cast(seq % 7 as string) || '.it' as s from ({MESSY}))""",
    "b21_b22_verified_emails": f"""with {DELIVERED} select seq, email, '' as others, case when email = '' then '' else case when number % 3 = 0 then {text(fixed.STATUS_OK)} else {text(fixed.STATUS_UNKNOWN)} end
      || case when website <> '' then {text(fixed.MATCHES_SITE)} else '' end end as email_status, {NOTE} as email_note, case when website <> '' then 'Yes' else 'No' end as website_status from leads""",
    "b23_document_phones": """select distinct doc_id, '+1' || regexp_replace(p, '[^0-9]', '', 'g')[2:] as phone from (
        select doc_id, unnest(regexp_extract_all(text, '\\+1 \\([2-9][0-8][0-9]\\) [2-9][0-9]{2}-[0-9]{4}')) as p from documents)""",
    "b24_tax_ids": f"select seq, 'Call 0321 465346.  REA: NO-12345678  ;  end' as text from ({MESSY})",
    "b25_b26_phones": f"""with t as (select seq, raw_phone, region from ({MESSY})),
      u as (select *, {phone('raw_phone', 'region', 'e164')} as e164, {phone('raw_phone', 'region', 'display')} as display, {phone('raw_phone', 'region', 'type')} as type from t)
      select seq, e164, display, type, case when raw_phone like '%;%' then '+390321465346' else e164 end as best from u""",
    "b27_regions": f"""with c as (select n_nationkey::bigint as id, n_name as country from nation union all select seq, case seq % 7 {' '.join(f'when {i} then {text(a)}' for i, a in enumerate(_ASKED))} end from ({MESSY})),
      r(code, name, alpha3, supported) as (values {_REGION}), a(k, code) as (values {_ALIAS}),
      m as (select c.*, coalesce(a.code, case when regexp_full_match(lower(trim(country)), '[a-z]{{2}}') then upper(trim(country)) end, n.code) as code
        from c left join a on a.k = lower(trim(country)) left join r n on lower(trim(country)) in (n.name, n.alpha3, lower(n.code)))
      select id, country, coalesce(r.code, '') as region from m left join r on r.code = m.code and r.supported""",
    "b28_addresses": f"""select seq, case when seq % 5 = 0 then 'Full 1' else concat_ws(', ', case when seq % 4 = 0 then 'U2' end, cast(seq % 90 as string) || case when seq % 3 = 0 then '' else ' Main St' end,
      case when seq % 2 = 0 then 'Old Town' end, case when seq % 6 = 1 then 'York' else 'Leeds' end, case when seq < 100000 then lpad(cast(seq as string), 5, '0') else substr(cast(seq as string), 1, 5) end) end as address from ({MESSY})""",
    "b29_b30_identities": f"with {DELIVERED}, {IDENTITIES} select * from identities",
    "b31_categories": f"""with t(keyword, k, v) as (values {_CATEGORY}), asked as (select seq, seq % 8 as n, [{', '.join(map(text, ASKED))}][seq % 8 + 1] as category,
        ['dentist', 'law firm', 'beauty salon', 'plumber', 'factory', 'zoo', 'shop = tea', 'night bars'][seq % 8 + 1] as keyword from ({MESSY}))
      select seq, category, k, v, true as exact from asked join t using (keyword) where n < 5
      union all select seq, category, if(n = 6, 'Shop', 'name'), ['zoo', 'Tea', 'night bars'][n - 4], n = 6 from asked where n >= 5""",
    "b32_rings": f"""with p as (select seq, lat, lon, r.range as ring, i.range as i from ({LEADS}), range(1, 4) r, range(0, 18) i where lat is not null and seq % 2 = 0 and i.range < 6 * r.range)
      select seq, ring, count(*) as points, round(avg(lat + ring * 5.0 / 111.0 * cos(2 * pi() * i / (6 * ring))), 6) as mid_lat,
        round(max(lon + ring * 5.0 / 111.0 * sin(2 * pi() * i / (6 * ring)) / greatest(0.1, cos(radians(lat)))), 6) as east from p group by seq, ring""",
    "c1_qualified": f"""with {DELIVERED} select seq, {QUALIFIES} as plain, {QUALIFIES} and email <> '' as email, {QUALIFIES} and phone <> '' as phone,
      email <> '' and phone <> '' and address <> '' as complete, {QUALIFIES} and website <> '' as site, website = '' as no_site from leads""",
    "c2_c3_d4_elements": f"select seq as id, lat, lon from ({LEADS}) where lower(category) = 'building' and lat between 44.999 and 45.0035 and lon between 7.9 and 8.1",
    "c3_areas": f"""with a as (select s_suppkey as area, 44.997::double + (s_suppkey % 7) * 0.0013::double as south, 7.996::double + (s_suppkey % 11) * 0.0009::double as west,
        case when s_suppkey % 50 = 0 then 7.0::double else (s_suppkey % 9 + 1) * 0.0011::double end as size from supplier)
      select area, seq from a join ({LEADS}) l on lat between south and south + size and lon between west and west + size""",
    "c4_skipped_listings": f"select seq, place_id from ({LEADS}) where place_id = '' or seq % 5 <> 0",
    "c5_second_pass": f"select seq, website from ({LEADS}) where raw_email = '' and website <> '' and website not like 'https://facebook%'",
    "c6_allowed_urls": f"select page_id, url from pages where length({host('url')}) % 2 = 1 or starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1), '/a') or not starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1), '/')",
    "c6_robots": f"""with p as (select page_id, url, length({host('url')}) % 3 as k, case when path = '' then '/' else path end as path from (select page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) as path from pages))
      select page_id, url, 'LeadBot/2.0' as agent from p where case when k = 2 then true when k = 1 then not (contains(path, '?') or path like '/en%')
        else path like '/en/%' or not (contains(path, '5') or (path like '/fr/%' and path like '%1' and path <> '/fr/') or false) end
      union all select page_id, url, 'Otherbot' from p where k <> 0""",
    "f1_entity_targets": f"with {TARGETS} select seq, lead_key, target from targets",
    "e2_merged_leads": f"""with {TARGETS},
      phones as (select target, string_agg(raw_phone, '; ' order by first) as phones from (select target, raw_phone, min(seq) as first from targets where raw_phone <> '' group by all) group by target),
      mails as (select target, string_agg(raw_email, '; ' order by first) as emails from (select target, raw_email, min(seq) as first from targets where raw_email <> '' group by all) group by target),
      sources as (select target, string_agg(source, ' + ' order by first) as source from (select target, source, min(seq) as first from targets group by all) group by target),
      filled as (select target, coalesce(min_by(address, seq) filter (where address <> ''), '') as address, coalesce(min_by(website, seq) filter (where website <> ''), '') as website from targets group by target)
      select t.seq, t.name, f.address, f.website, coalesce(p.phones, '') as phones, coalesce(m.emails, '') as emails, s.source, t.lat, t.place_id
      from targets t join filled f on t.seq = f.target join sources s on s.target = t.seq left join phones p on p.target = t.seq left join mails m on m.target = t.seq""",
    "d3_unseen_leads": f"with {DELIVERED}, {IDENTITIES}, h as ({HISTORY}) select seq, phone, website from leads where seq not in (select i.seq from identities i join h using (field, value))",
    "g3_known_leads": f"with {DELIVERED}, {IDENTITIES}, h as ({HISTORY}) select distinct i.seq from identities i join h using (field, value)",
    "g2_g4_a6_new_history": f"""with {DELIVERED}, {IDENTITIES}, h as ({HISTORY}) select field, value from h union select field, value from identities
      union select 'e_' || field, value from identities join leads using (seq) where email <> '' and field <> 'emails'""",
    "d7_migrated_history": f"""with {DELIVERED}, k as (select distinct lead_key as value, split_part(lead_key, '|', 1) as host from leads where seq % 3 = 1),
      m as (select distinct replace(email, '@', '@mail.') as value from leads where email <> '' and seq % 2 = 0), d as (select distinct split_part(value, '@', 2) as d from m)
      select 'keys' as field, value from k union select 'emails', value from m
      union select 'e_keys', k.value from k join d on k.host <> '' and lead_is_site(d.d, k.host)""".replace("lead_is_site(d.d, k.host)", "(d.d = k.host or d.d like '%.' || k.host or k.host like '%.' || d.d) and contains(k.value, '|')"),
    "b9_contact_links": f"""with p as (select distinct url, replace(html, '</body>', {text(LINKS + '</body>')}) as html from pages),
      l as (select url, unnest(regexp_extract_all(html, '<a href="([^"#]*)[^"]*">[^<]*</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) as label from p),
      r as (select url, label, case when href like 'http%' then href when href like '/%' then {URL_ROOT} || href else regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(.*/)', 1) || href end as link from l),
      s as (select url, link, min(list_position(list_transform({[h for h in fixed.CONTACT_HINTS]}, lambda h: contains(lower(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1) || ' ' || label), h)), true)) as score
        from r where {bare('link')} = {bare('url')} group by url, link)
      select url, link, row_number() over (partition by url order by score, link) as rank from s where score > 0 and rtrim(link, '/') <> rtrim(url, '/') qualify rank <= 3""",
    "b10_d8_planned_pages": f"""with h as (select distinct url, {URL_ROOT} as root, contains(html, '</body>') as linked from pages)
      select url, root || '/contact' as link, if(linked, 1, 2) as kind, if(linked, 1, 102) as ord from h union all select url, root || '/kontakt', 2, 106 from h""",
    "w2_site_contacts": f"""with h as (select {URL_ROOT} as root, min(page_id) as site from pages group by 1),
      a as (select site, pos, site + pos * 3 as n from h, (select unnest([0, 1, 2, 3]) as pos)),
      o as (select site from a group by site having min(case when n % 4 = 1 then pos end) is not null and (min(case when n % 11 = 5 then pos end) is null or min(case when n % 4 = 1 then pos end) < min(case when n % 11 = 5 then pos end))),
      t as (select root || '/' as url, {bare("root || '/'")} as host, site % 3 = 0 and {host("root || '/'")} not in (select {host("root || '/'")} from h where site % 5 = 0) as office, site % 4 = 0 as early from h where site in (select site from o))
      select url, case when office then 'office' when early then 'first' else 'help' end || '@' || host as emails from t""",
    "b11_social_links": "select page_id, 'facebook' as network, 'https://www.facebook.com/p' || cast(page_id as string) as href from pages where contains(html, '</body>')",
    "e1_f3_site_contacts": f"""with p as (select page_id, site, contains(html, 'mailto:%20Sales') as made, row_number() over (partition by site order by page_id) as ord, html from ({PAGES})),
      t as (select page_id, site, ord, list_transform(regexp_extract_all({deobfuscate(TEXT)}, {text(fixed.EMAIL_FIND)}), lambda x: {unglue('x')}) as seen from p),
      raws as (select page_id, site, ord, 0 as pos, 'sales' || cast(page_id % 5 as string) || '@' || site as raw from p where made
        union all select page_id, site, ord, unnest(range(1, len(seen) + 1)) as pos, unnest(seen) as raw from t),
      mails as (select page_id, site, ord, mail, min(pos) as pos from (select * exclude (raw), {clean_email('raw')} as mail from raws) where mail is not null group by all),
      k as (select p.page_id, p.site, p.ord, p.made, (select count(*) from mails m where m.page_id = p.page_id) as n from p),
      f as (select *, coalesce(sum(n) over (partition by site order by ord rows between unbounded preceding and 1 preceding), 0) as before from k),
      v as (select *, row_number() over (partition by site order by ord) as visit from f where ord <= 2 or before = 0),
      c as (select site, page_id, ord from v where made and visit <= 8),
      m as (select site, string_agg(mail, '; ' order by place) as emails from (select m.site, mail, min(v.ord * 1000 + m.pos) as place from mails m join v on v.page_id = m.page_id and visit <= 8 group by all) group by site)
      select site, coalesce(emails, '') as emails, coalesce(n_phones, 0) as n_phones, coalesce(facebook, '') as facebook from (select distinct site from p) left join m using (site) left join (select site, count(distinct page_id % 10000) as n_phones, 'https://www.facebook.com/p' || cast(min(page_id) as string) as facebook from c group by site) using (site)""",
    "e3_f2_site_state": """with a as (select page_id as site, p.range as pos, page_id + p.range * 3 as n from pages, range(0, 4) p),
      s as (select site, min(case when n % 4 = 1 then pos end) as page, min(case when n % 11 = 5 then pos end) as stop, max(case when n % 4 <> 0 then 1 else 0 end) as answered from a group by site),
      t as (select *, page is not null and (stop is null or page < stop) as ok from s)
      select site, case when ok then 'ok' when stop is not null or answered = 1 then 'blocked' else 'down' end as site_state, case when ok then page end as pos from t""",
    "d1_d2_enriched_leads": f"""with {DELIVERED} select seq, concat_ws('; ', nullif(raw_email, ''), case when website <> '' then 'desk@' || {bare('website')} end,
        case when website <> '' and raw_email <> 'Info@' || {bare('website')} then 'Info@' || {bare('website')} end) as emails,
      concat_ws('; ', nullif(raw_phone, ''), case when website <> '' then '+44 20 7946 9990; +44 20 7946 9991; +44 20 7946 9992' end) as phones,
      case when website <> '' then 'https://facebook.com/' || {bare('website')} else '' end as facebook from leads""",
    "e7_gained_emails": f"select count(*) as gained from ({LEADS}) where raw_email = '' and seq % 4 = 0",
    "f4_top_n": f"with {DELIVERED} select category, seq, row_number() over (partition by category order by seq) as rank from leads where {QUALIFIES} qualify rank <= {N_LEADS}",
    "f5_g1_ordered_sources": f"""select category, row_number() over (partition by category order by -((website <> '')::int + (raw_phone <> '')::int + (raw_email <> '')::int), case when source = 'OpenStreetMap' then 0 else 1 end, seq) as seq,
      name, source, website from ({LEADS})""",
    "f6_final_order": f"with {DELIVERED} select row_number() over (order by (email <> '')::int + (phone <> '')::int desc, seq) as position, seq, (email <> '')::int + (phone <> '')::int as score, email, phone from leads",
    "e4_summary": f"""with {DELIVERED}, n as (select *, {NOTE} as note from leads) select count(*) as total, count(*) filter (where email <> '') as with_email, count(*) filter (where phone <> '') as with_phone,
      count(*) filter (where website <> '') as with_website, count(*) filter (where website = '') as no_website, count(*) filter (where note = 'Not found on website') as not_found,
      count(*) filter (where starts_with(note, 'No website')) as no_website_note, count(*) filter (where email <> '' and phone <> '') as email_and_phone from n""",
    "e5_run_report": f"""with {DELIVERED}, {IDENTITIES}, h as ({HISTORY}),
      t as (select category, seq, email from leads where {QUALIFIES} qualify row_number() over (partition by category order by seq) <= {N_LEADS}),
      got as (select category, count(*) as accepted, count(*) filter (where email <> '') as with_email from t group by category),
      lost as (select category, count(*) as skipped from leads where seq in (select i.seq from identities i join h using (field, value)) group by category),
      src as (select category, string_agg(distinct source, ', ' order by source) as sources from leads group by category)
      select category, coalesce(accepted, 0) as accepted, coalesce(skipped, 0) as skipped, 10 as requested, greatest(0, 10 - coalesce(accepted, 0)) as shortfall, sources,
        coalesce(accepted, 0) > 0 and coalesce(with_email, 0) < 0.7 * coalesce(accepted, 0) as few_emails from src left join got using (category) left join lost using (category)""",
    "e6_d9_city_rings": f"""with l as ({LEADS}), c as (select median(lat) as lat0, median(lon) as lon0 from l where place_id <> '' and lat is not null),
      d as (select seq, lat0, lon0, (lat - lat0) * 111.0 as dy, (lon - lon0) * 111.0 * greatest(0.1, cos(radians(lat0))) as dx from l, c where lat is not null)
      select seq, lat0, lon0, cast(ceil(round(sqrt(dx * dx + dy * dy) / 0.1, 9)) as int) as ring from d""",
    "h4_unread_places": f"select place_id, seq from ({LEADS}) where place_id <> '' and seq % 2 = 1",
}


_NUMBERS = ", ".join(f"({i}, {text(e or '')}, {text(t or '')})" for i, (_, _, e, t) in enumerate(I.WORLD_PHONES))
ORACLE["b25_world_phones"] = f"select seq, e164, type from ({LEADS}) join (values {_NUMBERS}) n(k, e164, type) on seq % {len(I.WORLD_PHONES)} = k"


def greedy(source: str, n: int | None = None) -> str:
    """CTEs that take the rows of a source (cat, seq, field values) one by one in the order of (cat, seq): `accepted` has those
    that share no value with one taken before, at most n of a cat; a row beyond n isn't taken, so it hides no later one."""
    full = "false" if n is None else f"(s.cat = l.cat and s.k >= {n})"
    refused = f"({full} or list_has_any(s.taken, l.ids))"
    return f"""listed as (select cat, seq, row_number() over (order by cat, seq) as rn, list_filter([case when place_id <> '' then 'i:' || place_id end, case when website = '' and phone <> '' then 'p:' || phone end,
        case when email <> '' then 'e:' || email end, 'k:' || lead_key], lambda v: v is not null) as ids from {source}),
      step as (select 0::bigint as rn, []::varchar[] as taken, -1::bigint as cat, 0::bigint as k, null::bigint as seq union all
        select l.rn, case when {refused} then s.taken else list_concat(s.taken, l.ids) end, l.cat::bigint, case when s.cat = l.cat then s.k else 0 end + case when {refused} then 0 else 1 end,
          case when {refused} then null else l.seq end from step s join listed l on l.rn = s.rn + 1),
      accepted as (select cat, seq from step where seq is not null)"""


def learning(source: str, n: int) -> str:
    """CTEs that take the rows of a source (cat, seq, known, field values) one by one: `verdicts` has the accepted ones, at most n
    of a cat, and the learned ones, which are known or share a value with one learned before, have an email, share no value with
    an accepted row and come before the n-th accepted one of their cat."""
    full, met = f"(s.cat = l.cat and s.k >= {n})", "(l.known or list_has_any(s.told, l.ids))"
    lost = f"({full} or list_has_any(s.taken, l.ids))"
    return f"""listed as (select cat, seq, known, email <> '' as mail, row_number() over (order by cat, seq) as rn, list_filter([case when place_id <> '' then 'i:' || place_id end, case when website = '' and phone <> '' then 'p:' || phone end,
        case when email <> '' then 'e:' || email end, 'k:' || lead_key], lambda v: v is not null) as ids from {source}),
      step as (select 0::bigint as rn, []::varchar[] as taken, []::varchar[] as told, -1::bigint as cat, 0::bigint as k, null::bigint as seq, '' as verdict union all
        select l.rn, case when {lost} or {met} then s.taken else list_concat(s.taken, l.ids) end, case when not {lost} and {met} and l.mail then list_concat(s.told, l.ids) else s.told end,
          l.cat::bigint, case when s.cat = l.cat then s.k else 0 end + case when {lost} or {met} then 0 else 1 end, l.seq::bigint,
          case when {lost} then '' when {met} then case when l.mail then 'learned' else '' end else 'accepted' end from step s join listed l on l.rn = s.rn + 1),
      verdicts as (select cat, seq, verdict from step where verdict <> ''), accepted as (select cat, seq from verdicts where verdict = 'accepted')"""


_CATEGORIES = "[" + ", ".join(map(text, CATEGORIES)) + "]"
ORACLE["f4_accepted_leads"] = f"with recursive {DELIVERED}, qualified as (select 0 as cat, * from leads where {QUALIFIES}), {greedy('qualified')} select seq, lead_key from leads join accepted using (seq)"
ORACLE["f4_categories"] = f"""with recursive {DELIVERED}, qualified as (select list_position({_CATEGORIES}, category) as cat, * from leads where {QUALIFIES}), {greedy('qualified', 3 * N_LEADS)}
  select category, seq, lead_key from leads join accepted using (seq)"""
ORACLE["f4_g4_learned"] = f"""with recursive {DELIVERED}, {IDENTITIES}, h as ({HISTORY}), qualified as (select list_position({_CATEGORIES}, category) as cat, *, seq in (select i.seq from identities i join h using (field, value)) as known
    from leads where {QUALIFIES}), {learning('qualified', 3 * N_LEADS)} select seq, verdict from verdicts"""
#: A run step by step: order of the sources' rows in a category; merge within a category by name, key and place; gaps filled from
#: the others in order; the first row of each key; contacts of sites with an even number; acceptance, where rows of known phones with an email are learned.
ORACLE["w1_lead_table"] = f"""with recursive listed_rows as (
    select *, list_position({_CATEGORIES}, category) as cat, {website('website')} as site, 'biz' || cast(seq % 61 as string) as nm, seq % 61 as number,
      row_number() over (partition by category order by (website <> '')::int + (raw_phone <> '')::int + (raw_email <> '')::int desc, source <> 'OpenStreetMap', seq) as ord from ({LEADS})),
  keyed as (select *, case when {bare('site')} <> '' then {bare('site')} || '|' || nm else nm || '|' || case when raw_phone <> '' then right(replace(raw_phone, ' ', ''), 8) else lower(address) end end as key0 from listed_rows),
  heads as (select cat, nm, min(ord) as o0, arg_min(key0, ord) as k0, arg_min({{'a': lat, 'b': lon}}, ord) as p0, arg_min(place_id, ord) as pl0, arg_min(source, ord) as s0 from keyed group by cat, nm),
  judged as (select k.*, h.o0, h.k0, coalesce(abs(lat - p0.a) < 0.003 and abs(lon - p0.b) < 0.003, false) and not (place_id <> '' and pl0 <> '' and source = s0) as close from keyed k join heads h using (cat, nm)),
  aimed as (select j.*, case when key0 = k0 then o0 else case when f.opened < ord then f.opened when close then o0 else ord end end as target
    from judged j left join (select cat, nm, key0, min(ord) as opened from judged where not close and key0 <> k0 group by all) f using (cat, nm, key0)),
  own as (select * from aimed where ord = target),
  filled as (select cat, target, coalesce(arg_min(address, ord) filter (where address <> ''), '') as address, coalesce(arg_min(site, ord) filter (where site <> ''), '') as website,
      coalesce(arg_min(raw_phone, ord) filter (where raw_phone <> ''), '') as phone0, coalesce(max(lower(raw_email)) filter (where raw_email <> ''), '') as email0 from aimed group by cat, target),
  srcs as (select cat, target, string_agg(source, ' + ' order by o) as sources from (select cat, target, source, min(ord) as o from aimed group by all) group by cat, target),
  merged as (select o.cat, o.ord as seq, o.name, o.category, o.place_id, o.number, o.nm, f.address, f.website, f.phone0, f.email0, s.sources from own o join filled f on f.cat = o.cat and f.target = o.ord join srcs s on s.cat = o.cat and s.target = o.ord),
  named as (select *, case when website <> '' then {bare('website')} || '|' || nm else nm || '|' || case when phone0 <> '' then right(replace(phone0, ' ', ''), 8) else lower(address) end end as lead_key,
      website <> '' and number % 2 = 0 as visited from merged),
  once as (select * from named qualify row_number() over (partition by cat, lead_key order by seq) = 1),
  done as (select *, case when phone0 <> '' then phone0 when visited then '+44 20 7946 9990' else '' end as phone_display, case when number % 3 = 1 then '' when email0 <> '' then email0 when visited then 'info@biz' || number || '.co.uk' else '' end as email from once),
  fresh as (select *, replace(phone_display, ' ', '') as phone, website = '' and replace(phone_display, ' ', '') in (select value from ({HISTORY}) where field = 'phones') as known from done where phone_display <> '' or email <> ''),
  {learning('fresh', N_LEADS)}
  select category, row_number() over (partition by category order by seq) as rank, name, phone_display, email, address, website, sources as source, lead_key, case when visited then {bare('website')} else '' end as facebook from fresh join accepted using (cat, seq)"""
