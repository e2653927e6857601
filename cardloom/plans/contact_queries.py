"""Queries on derived contacts, each with its DuckDB SQL (None where SQL can't express it)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col as C

from ..functions import cleaning as K
from ..functions import fixed as V
from ..functions import places as PL
from ..functions import text as T
from ..operators import dedup, enrich, html, listing, postclean, stats
from ..sources import contacts as contact_io
from .contacts import BASE, CONTACTS, PROFILES, contacts, profiles

EMAIL_RE, STRICT, LOOSE = V.EMAIL, V.STRICT_PHONE, V.LOOSE_PHONE


def quoted(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def per_row(columns):
    """row_id and the columns that the function gives; columns need a session, so they are made when the query runs."""
    return lambda spark, sf: contacts(spark, sf).select("row_id", *(c.alias(n) for n, c in columns().items()))


def on_contacts(f):
    return lambda spark, sf: f(contacts(spark, sf))


def enriched(spark, sf):
    return enrich.enrich(contacts(spark, sf), profiles(spark, sf))


def cleaned(spark, sf):
    d = contacts(spark, sf)
    how = {"name": K.clean_name, "email": K.extract_email, "phone": K.extract_phone, "title": K.clean_plain, "location": K.clean_plain}
    return d.select("row_id", *(f(C(c)).alias(f"clean_{c}") for c, f in how.items()))


def ten(d):
    return f"'+1-' || substr({d},1,3) || '-' || substr({d},4,3) || '-' || substr({d},7,4)"


DIG = r"regexp_replace({c}, '\D', '', 'g')"
NORM = "case when length({d}) = 10 then " + ten("{d}") + " when length({d}) = 11 and {d} like '1%' then " + ten("substr({d}, 2)") + " {rest} end"


def norm(c, rest):
    return NORM.replace("{d}", DIG.format(c=c)).replace("{rest}", rest)


DOMAIN = r"""dom as (select *, case when regexp_matches(d0, '^[a-z0-9.-]+\.[a-z]{2,}$') then d0 end as domain from
 (select *, regexp_replace(nullif(regexp_extract(lower(trim(email)), '^[^@]+@([^@]+)$', 1), ''), '^www\.', '') as d0 from contacts)),
doms as (select *, case when domain is null then 'unknown' when domain in (""" + quoted(V.PERSONAL_DOMAINS) + """) then 'personal' else 'business' end as domain_type from dom),
perdom as (select domain, domain_type, count(*) as contacts, min(row_id) as first_row from doms where domain is not null group by all)"""

LEVEL = "case when n3 = 3 then 'high' when n3 = 2 then 'medium' else 'low' end"
HAS = "(nullif({c}, '') is not null)"
N3 = " + ".join(f"{HAS.format(c=c)}::int" for c in ("name", "email", "phone"))
KEY = r"nullif(regexp_replace(regexp_replace(trim(lower({c})), '\s+', ' ', 'g'), '[^a-z0-9_\s@.-]', '', 'g'), '')"

CLEAN_NAME = rf"""cn as (select row_id, name as o,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '{LOOSE}', '', 'g'), '{EMAIL_RE}', '', 'g'), '(?i)(?:{V.TITLE_SUFFIX})+$', ''), '(?i)(?:{V.CREDENTIAL})+$', ''), '\s+', ' ', 'g')) as e from contacts),
cn2 as (select *, regexp_matches(e, '^(?i:View Profile|Contact Us|Learn More|Click Here|Load More|See Details|Read More|Show More|View All|Download vCard|vCard|Email|Phone|Fax|Address|Office|Location)$') as spam from cn)"""

PLAIN = rf"""cl as (select row_id, location as o, nullif(trim(regexp_replace(regexp_replace(regexp_replace(location, '{LOOSE}', '', 'g'), '{EMAIL_RE}', '', 'g'), '\s+', ' ', 'g')), '') as v,
 len(regexp_extract_all(location, '{LOOSE}'))::int as k from contacts)"""

D1 = """x as (select *, coalesce(nullif(email, ''), coalesce(name, 'undefined') || '_' || coalesce(phone, 'undefined')) as key, """ + N3 + """ as full_ from contacts),
y as (select *, row_number() over (partition by key order by full_ desc, row_id) as rn, min(row_id) over (partition by key) as first_row from x)"""

D2 = """m as (select *, lower(nullif(email, '')) as e from contacts),
a as (select * from (select *, row_number() over (partition by e order by row_id) as rn from m where e is not null) where rn = 1),
b as (select * from (select *, row_number() over (partition by name, profile_url order by row_id) as rn from m where e is null and nullif(name, '') is not null and nullif(profile_url, '') is not null) where rn = 1),
b2 as (select b.* from b where not exists (select 1 from a where a.name = b.name and a.profile_url = b.profile_url and a.row_id < b.row_id)),
r2 as (select row_id from a union all select row_id from b2 union all select row_id from m where e is null and (nullif(name, '') is null or nullif(profile_url, '') is null))"""

# names in these contacts end in a title only when the title is run together with them
SPLIT = r"""sp as (select row_id, trim(name) as n, nullif(regexp_extract(trim(name), '(?i)(Senior\s*Partner|Managing\s*Partner|Senior\s*Associate|Senior\s*Counsel|Of\s*Counsel|Special\s*Counsel|General\s*Counsel|Co-Chair|Vice\s*Chair|Chair|Partner|Associate|Counsel)$', 1), '') as t from contacts)"""

LOCP = r"""lp as (select *, regexp_extract(location, '\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}') <> '' as dirty,
 regexp_replace(location, '\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}', ' ', 'g') as a0 from contacts),
lp1 as (select *, list_contains(regexp_extract_all(a0, '\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}'), '') as z, len(regexp_extract_all(a0, '\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}')) as more,
 regexp_replace(a0, '\+\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{1,9}', ' ', 'g') as c from lp),
lp2 as (select *, list_filter(list_transform(string_split_regex(c, '[\n;|,]'), lambda x: trim(x, chr(10) || ' ')), lambda x: length(x) between 2 and 200 and regexp_matches(x, '[a-zA-Z]')) as parts, trim(regexp_replace(c, '\s+', ' ', 'g')) as s from lp1),
lp3 as (select *, case when len(parts) > 1 then parts[1] when length(s) between 2 and 200 and regexp_matches(s, '[a-zA-Z]') then s end as v, (dirty or more > 0) as has_phone from lp2)"""


def merged(c, extra=""):
    """SQL of J1's rules for one field: o, p, clean and dirty are columns; noise can't arise in these contacts beyond what extra says."""
    same = {"email": "lower(o) = lower(p)", "phone": r"right(regexp_replace(o, '\D', '', 'g'), 10) = right(regexp_replace(p, '\D', '', 'g'), 10)"}.get(c, "o = p")
    return f"""case when o is null and p is not null then 'ENRICHED' when o is null then 'UNCHANGED' when {same} then 'VALIDATED' when p is null then 'UNCHANGED'
 when dirty or (contains(o, p) and length(o) > length(p)) then 'CLEANED' {extra} when contains(lower(p), lower(o)) then 'ENRICHED' when contains(lower(o), lower(p)) then 'VALIDATED' else 'REPLACED' end"""


J1 = f"""{CONTACTS}, {PROFILES}, {SPLIT}, {LOCP},
j as (select c.*, p.profile_url as pu, p.name as p_name, p.email as p_email, p.phone as p_phone, p.title as p_title, p.location as p_location,
 sp.t is not null as n_dirty, trim(left(sp.n, length(sp.n) - length(coalesce(sp.t, '')))) as n_clean, sp.t as n_title, lp3.has_phone as l_dirty, lp3.v as l_clean
 from contacts c left join profiles p on c.profile_url = p.profile_url join sp on sp.row_id = c.row_id join lp3 on lp3.row_id = c.row_id),
long as (
 select row_id, 'name' as field, trim(name) as o, p_name as p, n_clean as clean, n_dirty as dirty from j union all
 select row_id, 'email', email, p_email, null, false from j union all select row_id, 'phone', phone, p_phone, null, false from j union all
 select row_id, 'title', title, p_title, null, false from j union all select row_id, 'location', trim(location), p_location, l_clean, l_dirty from j),
act as (select *, case field when 'email' then {merged("email")} when 'phone' then {merged("phone")} when 'name' then {merged("name", "when regexp_matches(o, '^View') then 'CLEANED'")} else {merged("location")} end as action,
 case when dirty or (contains(o, p) and length(o) > length(p)) then coalesce(case when dirty then clean end, p) end as cleaned_ from long)"""
VALUE = "case action when 'ENRICHED' then p when 'VALIDATED' then o when 'UNCHANGED' then o when 'REPLACED' then p else coalesce(cleaned_, p) end"
CONF = """case when action = 'ENRICHED' then case when o is null then 'high' else 'medium' end when action = 'UNCHANGED' then case when o is null then null else 'medium' end
 when action = 'CLEANED' then case when dirty or (contains(o, p) and length(o) > length(p)) then 'high' else 'medium' end when action = 'REPLACED' then 'low' else 'high' end"""


def long_rows(spark, sf):
    return enrich.actions_long(enriched(spark, sf)).where("field <> 'bio'")


def profile_links(spark, sf):
    """Profiles as links, their position the number that ends the address."""
    return profiles(spark, sf).select(F.col("name").alias("text"), F.regexp_extract("profile_url", r"(\d+)\z", 1).cast("int").alias("position"))


def field_counts(d):
    """How many rows have each field that an enrichment would take."""
    fields = enrich.union_fields(d)
    one = d.agg(*(F.count(T.present(C(f))).alias(f) for f in fields))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), C(f).alias("present")) for f in fields))).alias("x")).select("x.field", "x.present")


def listed(spark, sf):
    """Contacts as listings of pages of ten; some pages repeat their listing's page 1 in addresses, in names alone, or at both ends."""
    d = contacts(spark, sf).select((C("row_id") % 7).alias("listing_id"), (F.floor(C("row_id") / 70) + 1).alias("page_num"), (F.floor(C("row_id") / 7) % 10).alias("position"), "name", "profile_url", "row_id")
    n, at = C("page_num") % 6, C("position").cast("string")
    name = F.when((C("page_num") == 1) | n.isin(2, 3), F.concat(F.lit("Same "), at)).when((n == 4) & C("position").isin(0, 9), F.concat(F.lit("Same "), at)).otherwise(C("name"))
    url = F.when(((C("page_num") == 1) | (n == 2)) & (C("position") > 0), F.concat(F.lit("/same/"), at)).when(C("page_num") == 1, F.lit(None).cast("string")).when(n == 2, F.lit(None).cast("string")).otherwise(C("profile_url"))
    return d.where((n != 5) | (C("position") < 3)).select("listing_id", "page_num", "position", name.alias("name"), url.alias("profile_url"))


LISTED = """l0 as (select row_id % 7 as listing_id, row_id // 70 + 1 as page_num, row_id // 7 % 10 as position, name, profile_url from contacts),
li as (select listing_id, page_num, position, case when page_num = 1 or page_num % 6 in (2, 3) then 'Same ' || position when page_num % 6 = 4 and position in (0, 9) then 'Same ' || position else name end as name,
 case when (page_num = 1 or page_num % 6 = 2) and position > 0 then '/same/' || position when page_num = 1 or page_num % 6 = 2 then null else profile_url end as profile_url from l0 where page_num % 6 <> 5 or position < 3)"""


def cleaned_after(spark, sf):
    """The whole run on contacts: dedup, enrichment, cleaning of what it merged."""
    d = enrich.enrich(dedup.dedup_contacts(contacts(spark, sf)).drop("first_row"), profiles(spark, sf))
    m = d.select("row_id", *(C(f"merged_{c}.value").alias(c) for c in stats.REPORTED))
    how = {"name": K.clean_name, "email": K.extract_email}
    return m.select("row_id", *(f(C(c)).alias(f"clean_{c}") for c, f in how.items()))


def removals_apart(report):
    return report.select(*(c for c in report.columns if c != "removals"), *(C("removals")[k].alias(k) for k in stats.REMOVALS))


# A row per contact and field: o, v (before and after), ex (whether it is taken out of its text, not cleaned), removals by type.
STRICT_TEN = r"regexp_replace(nullif(regexp_extract(phone, '" + STRICT + r"'), ''), '\D', '', 'g')"
CLEANED_ROWS = f"""u as (select row_id, 'name' as field, false as ex, o, case when not spam and e <> '' then e end as v, regexp_matches(o, 'Partner$')::int as ts, regexp_matches(o, ', JD$')::int as cs, 0 as ph, spam::int as sp from cn2
 union all select row_id, 'location', false, o, v, 0, 0, k, 0 from cl union all select row_id, 'title', false, title, title, 0, 0, 0, 0 from contacts
 union all select row_id, 'email', true, email, lower(nullif(regexp_extract(email, '{EMAIL_RE}'), '')), 0, 0, 0, 0 from contacts
 union all select row_id, 'phone', true, phone, {NORM.replace('{d}', STRICT_TEN).replace('{rest}', '')}, 0, 0, 0, 0 from contacts)"""
CHANGED = "(o is not null and (v is null or v <> o))"


#: Fields and the column whose values they are asked to take: their own, and others'.
FIELD_VALUES = [("name", "name"), ("name", "email"), ("name", "phone"), ("name", "location"), ("email", "email"), ("email", "name"), ("phone", "phone"), ("phone", "email"), ("title", "name"), ("profile_url", "profile_url"), ("profile_url", "email")]
VALID = "case when {v} is null or trim({v}) = '' then 'no value' {w} end"
MESSAGE = {
    "name": VALID.replace("{w}", r"when contains({v}, '@') then 'an address, not a name' when regexp_full_match(trim({v}), '\+?[\d\s\-()]{7,}') then 'a phone, not a name' when len(string_split_regex(trim({v}), '\s+')) > 6 then 'more than six words'"),
    "email": VALID.replace("{w}", f"when not regexp_full_match(trim({{v}}), '{EMAIL_RE}') then 'no valid address'"),
    "phone": VALID.replace("{w}", r"when length(regexp_replace({v}, '\D', '', 'g')) not between 7 and 15 then 'not 7 to 15 digits'"), "title": VALID.replace("{w}", ""),
    "profile_url": VALID.replace("{w}", "when {v} not like 'http%' and {v} not like '/%' then 'no valid URL'"),
}

QUERIES = {
    "c1_extract_emails": (per_row(lambda: dict(emails=F.array_join(T.extract_emails(C("email")), ","))), f"{CONTACTS} select row_id, coalesce(lower(nullif(regexp_extract(email, '{EMAIL_RE}'), '')), '') as emails from contacts"),
    "c2_extract_phones": (
        per_row(lambda: dict(phones=F.array_join(T.extract_phones(F.concat_ws(" / ", "phone", "location")), ","))),
        f"""{CONTACTS}, t as (select row_id, concat_ws(' / ', phone, location) as s from contacts),
 a as (select row_id, s, regexp_extract_all(s, '{V.PHONES[0]}') || regexp_extract_all(s, '{V.PHONES[1]}') || regexp_extract_all(s, '{V.PHONES[2]}') as m from t)
 select row_id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ',') as phones from a""",
    ),
    "c3_normalize_phone": (
        per_row(lambda: dict(**{m: T.normalize_phone(C("phone"), m) for m in ("keep", "strict", "display")}, smart=T.normalize_phone(C("phone"), "smart"))),
        f"""{CONTACTS} select row_id, {norm("phone", "else phone")} as keep, {norm("phone", "")} as strict, coalesce({norm("phone", "else phone")}, '') as display,
 case when length({DIG.format(c="phone")}) in (10, 11) then '(' || substr(right({DIG.format(c="phone")}, 10), 1, 3) || ') ' || substr(right({DIG.format(c="phone")}, 10), 4, 3) || '-' || right({DIG.format(c="phone")}, 4)
 when length({DIG.format(c="phone")}) between 7 and 15 then phone end as smart from contacts""",
    ),
    "c4_is_valid_name": (
        per_row(lambda: dict(valid=T.is_valid_name(C("name")))),
        rf"""{CONTACTS} select row_id, coalesce(length(name) between 2 and 50 and lower(name) not in ({quoted(V.NOT_NAMES)}) and {" and ".join(f"not contains(lower(name), '{w}')" for w in V.UI_WORDS)}
 and regexp_matches(name, '[a-zA-Z]') and left(name, 1) = upper(left(name, 1)) and len(string_split_regex(name, '\s+')) <= 5, false) as valid from contacts""",
    ),
    "c5_validate_name": (per_row(lambda: dict(value=T.validate_name(C("name")))), rf"""{CONTACTS} select row_id, case when length(name) between 2 and 100 and lower(trim(name)) not in ({quoted(V.NOT_NAMES)}) and regexp_matches(trim(name), '^[A-Z][a-zA-Z''\-\.\s]{{1,98}}[a-zA-Z]$') then trim(name) end as value from contacts"""),
    "c6_name_from_email": (
        per_row(lambda: dict(value=T.name_from_email(C("email")))),
        rf"""{CONTACTS}, b as (select row_id, split_part(email, '@', 1) as box from contacts), p as (select *, list_filter(string_split_regex(box, '[._-]+'), lambda x: x <> '' and not regexp_matches(x, '^\d+$')) as w from b)
 select row_id, case when length(box) between 2 and 25 and {" and ".join(f"not contains(lower(box), '{w}')" for w in V.ROLE_WORDS)} and len(w) between 1 and 6
 then array_to_string(list_transform(w, lambda x: case when length(x) = 1 then upper(x) || '.' else upper(left(x, 1)) || lower(substr(x, 2)) end), ' ') end as value from p""",
    ),
    "c7_presence_confidence": (per_row(lambda: dict(level=T.presence_confidence(C("name"), C("email"), C("phone")))), f"{CONTACTS} select row_id, {LEVEL} as level from (select row_id, {N3} as n3 from contacts)"),
    "c9_phone_near": (per_row(lambda: dict(value=T.phone_near(C("location")))), f"""{CONTACTS} select row_id, coalesce({", ".join(f"nullif(regexp_extract(location, '{p}'), '')" for p in V.NEAR_PHONES)}) as value from contacts"""),
    "c10_email_domain": (
        per_row(lambda: dict(domain=T.email_domain(C("email")), kind=T.domain_type(T.email_domain(C("email"))), kind_or_null=T.domain_type(T.email_domain(C("email")), missing=None))),
        f"{CONTACTS}, {DOMAIN} select row_id, domain, domain_type as kind, nullif(domain_type, 'unknown') as kind_or_null from doms",
    ),
    "c12_name_variations": (
        per_row(lambda: dict(variations=F.array_join(T.name_variations(F.when(C("name").rlike("^[A-Z][a-z]+ [A-Z][a-z]+$"), C("name"))), "|"))),
        f"""{CONTACTS}, w as (select row_id, string_split(lower(name), ' ') as w, regexp_matches(name, '^[A-Z][a-z]+ [A-Z][a-z]+$') as ok from contacts)
 select row_id, case when ok then w[1] || '.' || w[2] || '|' || w[1] || w[2] || '|' || left(w[1], 1) || w[2] || '|' || w[2] || '|' || w[1] end as variations from w""",
    ),
    "c13_clean_email": (
        per_row(lambda: dict(value=T.clean_email(F.concat(F.when(C("row_id") % 3 == 0, " MailTo:<").when(C("row_id") % 3 == 1, "[").otherwise(""), F.coalesce("email", C("phone")), F.when(C("row_id") % 3 == 0, ">?subject=a@b.co").when(C("row_id") % 3 == 1, ") ").otherwise("?x"))))),
        rf"""{CONTACTS}, a as (select row_id, trim(case row_id % 3 when 0 then ' MailTo:<' when 1 then '[' else '' end || coalesce(email, phone) || case row_id % 3 when 0 then '>?subject=a@b.co' when 1 then ') ' else '?x' end) as v from contacts),
 b as (select row_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '(?i)^mailto:', ''), '\?.*', ''), '^[<\[(\s]+', ''), '[>\])\s]+$', '') as v from a)
 select row_id, case when regexp_full_match(v, '{V.EMAIL}') then lower(v) end as value from b""",
    ),
    "c14_method_confidence": (
        per_row(lambda: dict(email=T.email_confidence(C("email")), phone=T.phone_confidence(C("phone")))),
        f"""{CONTACTS} select row_id, case when email is not null then 80 + case when lower(split_part(email, '@', -1)) in ({quoted(V.PERSONAL_DOMAINS)}) then 10 when email ilike '%.com' then 5 else 0 end - case when instr(email, '@') < 3 then 20 else 0 end end::int as email,
 case when phone is not null then least(100, 85 + case when regexp_matches(phone, '[-.()\\s]') then 5 else 0 end + case when regexp_matches(phone, '^(\\+1|1-)') then 5 else 0 end) end::int as phone from contacts""",
    ),
    "c16_validate_field": (
        lambda s, d: contacts(s, d).select("row_id", *(T.validate_field(F.lit(c), C(v))["message"].alias(c + v[0]) for c, v in FIELD_VALUES)),
        f"{CONTACTS} select row_id, " + ", ".join(f"{MESSAGE[c].replace('{v}', v)} as {c}{v[0]}" for c, v in FIELD_VALUES) + " from contacts",
    ),
    "c17_clean_name": (
        lambda s, d: cleaned(s, d).select("row_id", C("clean_name.value").alias("value"), C("clean_name.modified").alias("modified"), C("clean_name.valid").alias("valid")),
        f"{CONTACTS}, {CLEAN_NAME} select row_id, case when not spam and e <> '' then e end as value, spam or e <> o as modified, not spam and e <> '' as valid from cn2",
    ),
    "c17_clean_fields": (
        lambda s, d: cleaned(s, d).select("row_id", C("clean_email.value").alias("email"), C("clean_phone.value").alias("phone"), C("clean_location.value").alias("location"), F.size("clean_location.removed").alias("removed")),
        f"""{CONTACTS}, {PLAIN} select cl.row_id, lower(nullif(regexp_extract(email, '{EMAIL_RE}'), '')) as email, {norm(f"regexp_extract(phone, '{STRICT}')", "")} as phone, v as location, k as removed from cl join contacts c on c.row_id = cl.row_id""",
    ),
    "c18_name_parts": (
        lambda s, d: contacts(s, d).select("row_id", K.split_name_title(C("name")).alias("x")).select("row_id", "x.name", "x.title", "x.contaminated"),
        f"{CONTACTS}, {SPLIT} select row_id, case when t is null then n else trim(left(n, length(n) - length(t))) end as name, case when t is not null then 'Partner' end as title, t is not null as contaminated from sp",
    ),
    "c19_extract_title": (
        lambda s, d: contacts(s, d).select("row_id", K.extract_title(C("title"), T.no_text(), C("name"), T.no_text()).alias("x")).select("row_id", "x.*"),
        f"""{CONTACTS}, {SPLIT} select c.row_id, coalesce(title, case when t is not null then 'Partner' end) as title, case when title is not null then 'profile-html' when t is not null then 'name-suffix' end as source,
 case when title is not null then 'high' when t is not null then 'medium' end as confidence from contacts c join sp on sp.row_id = c.row_id""",
    ),
    "c20_parse_title": (
        lambda s, d: contacts(s, d).select("row_id", K.parse_title(F.concat_ws(", ", "title", "location")).alias("x")).select("row_id", "x.primary", "x.secondary", F.size("x.roles").alias("roles")),
        rf"""{CONTACTS}, roles as (select row_id, list_filter(list_transform(string_split_regex(concat_ws(', ', title, location), '[,;]'), lambda x: trim(x)), lambda x: x <> '') as a from contacts) select row_id, a[1] as "primary", a[2] as secondary, len(a)::int as roles from roles""",
    ),
    "c21_clean_location": (
        lambda s, d: contacts(s, d).select("row_id", K.clean_location_profile(C("location")).alias("x")).select("row_id", "x.location", "x.several", (F.size("x.removed") > 0).alias("had_noise")),
        f"{CONTACTS}, {LOCP} select row_id, v as location, len(parts) > 1 as several, has_phone as had_noise from lp3",
    ),
    "c22_detect_noise": (per_row(lambda: dict(noise=F.size(K.detect_noise(F.lit("name"), C("name"), C("phone"), C("email"))["items"]))), f"{CONTACTS} select row_id, (case when name like 'View%' then 1 else 0 end)::int as noise from contacts"),
    "c26_normalize_location": (
        lambda s, d: contacts(s, d).select("row_id", K.normalize_location(C("location")).alias("x")).select("row_id", "x.location", "x.changed"),
        rf"""{CONTACTS}, a as (select row_id, location as o, regexp_replace(location, '\+?\d[\d\s\-\(\)\.]{{7,}}', '', 'g') as a from contacts),
 b as (select *, regexp_matches(a, '(?i)Washington,?\s*D\.?C\.?') or regexp_matches(a, '\w+,\s*[A-Z]{{2}}\b') or regexp_matches(a, '\w+,\s*[A-Z][a-z]+') as keeps from a),
 c as (select *, case when keeps then regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(a, '\n+', ', ', 'g'), '\s+', ' ', 'g')), '\s+,\s+', ', ', 'g'), '\s+,', ',', 'g') else trim(regexp_replace(a, '\s+', ' ', 'g')) end as b from b),
 e as (select *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '(?i)Washington\s*,?\s*D\.?\s*C\.?', 'Washington, D.C.', 'g'), '^,\s*|,\s*$', '', 'g'), ',\s*,+', ',', 'g'), '\s{{2,}}', ' ', 'g')) as v from c)
 select row_id, v as location, v <> o as changed from e""",
    ),
    "c27_quality_score": (
        on_contacts(stats.score_contacts),
        rf"""{CONTACTS}, s as (select row_id, (case when not regexp_matches(name, '(?i)\b(Partner|Associate|Counsel|Director|Manager|Of Counsel)$') then 20 else 0 end + case when not regexp_matches(location, '\+?\d+[\d\s\-\(\)]{{7,}}') then 20 else 0 end
 + case when regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]+$') then 30 else 0 end + case when regexp_matches(phone, '^\+\d+[\d\s\-\(\)]+$') then 15 else 0 end + case when phone is not null then 15 else 0 end)::int as score from contacts)
 select row_id, score, case when score >= 80 then 'high' when score >= 60 then 'medium' else 'low' end as overall from s""",
    ),
    "c32_row_title_flags": (per_row(lambda: dict(dirty=F.coalesce(C("name").rlike("(?i)(partner|associate|counsel)"), F.lit(False)) | F.coalesce(C("location").rlike(r"\+\d"), F.lit(False)))), f"{CONTACTS} select row_id, regexp_matches(name, '(?i)(partner|associate|counsel)') or regexp_matches(location, '\\+\\d') as dirty from contacts"),
    "c34_match_key": (per_row(lambda: dict(name=T.match_key(C("name")), phone=T.match_key(C("phone")), location=T.match_key(C("location")))), f"{CONTACTS} select row_id, {', '.join(KEY.format(c=c) + ' as ' + c for c in ('name', 'phone', 'location'))} from contacts"),
    "c35_string_similarity": (
        per_row(lambda: dict(similarity=F.round(T.string_similarity(F.lower("name"), F.regexp_replace(F.split("email", "@")[0], r"[.\d]", " ")), 6))),
        rf"""{CONTACTS}, s as (select row_id, lower(name) as a, regexp_replace(split_part(email, '@', 1), '[.\d]', ' ', 'g') as b from contacts)
 select row_id, round(case when a is not distinct from b then 1.0 when a is null or b is null or a = '' or b = '' then 0.0 else (greatest(length(a), length(b)) - levenshtein(a, b)) / greatest(length(a), length(b))::double end, 6) as similarity from s""",
    ),
    "d1_dedup_contacts": (lambda s, d: dedup.dedup_contacts(contacts(s, d)).select("row_id", "first_row", "name", "email"), f"{CONTACTS}, {D1} select row_id, first_row, name, email from y where rn = 1"),
    "d2_dedup_scrape": (lambda s, d: dedup.dedup_scrape(contacts(s, d)).select("row_id", "email"), f"{CONTACTS}, {D2} select row_id, email from r2 join contacts using (row_id)"),
    "d3_dedup_by_email": (
        lambda s, d: dedup.dedup_by(contacts(s, d), "email"),
        f"""{CONTACTS}, k as (select row_id, {KEY.format(c="email")} as k from contacts), o as (select *, case when k is not null then min(row_id) over (partition by k) end as f from k)
 select row_id, coalesce(f < row_id, false) as duplicate, case when f < row_id then f end as original from o""",
    ),
    "d5_dedup_stats": (
        lambda s, d: dedup.dedup_stats(dedup.dedup_by(contacts(s, d), "email")),
        f"""{CONTACTS}, k as (select {KEY.format(c="email")} as k from contacts), n as (select count(*) as t, count(k) - count(distinct k) as d from k) select t as total, t - d as unique_rows, d as duplicates, round(d / greatest(t, 1), 4) as rate from n""",
    ),
    "j1_enrich": (long_rows, f"{J1} select row_id, field, {VALUE} as value, action, {CONF} as confidence, case when action in ('CLEANED', 'REPLACED') or (action = 'ENRICHED' and o is not null) then o end as original, case when action = 'REPLACED' then field || '_mismatch' end as flag, action = 'REPLACED' as review from act"),
    "j1c_fill_from_profile": (
        lambda s, d: enrich.fill_from_profile(contacts(s, d), profiles(s, d)),
        f"""{CONTACTS}, {PROFILES}, j as (select c.row_id, c.email as e, c.phone as h, c.name as n, p.email as pe, p.phone as ph, p.name as pn from contacts c left join profiles p on c.profile_url = p.profile_url),
 k as (select *, concat_ws(',', case when e is null and pe is not null then 'email' end, case when h is null and ph is not null then 'phone' end, case when n is null and pn is not null then 'name' end) as filled from j)
 select row_id, coalesce(e, pe) as email, coalesce(h, ph) as phone, coalesce(n, pn) as name, case when filled <> '' then 'profile-page' end as source, filled from k""",
    ),
    "j6_needs_visit": (lambda s, d: enrich.needs_visit(contacts(s, d), done=profiles(s, d)).select("row_id", "profile_url"), f"{CONTACTS}, {PROFILES} select row_id, profile_url from contacts where profile_url is not null and email is null and profile_url not in (select profile_url from profiles)"),
    "a1_contact_stats": (on_contacts(stats.contact_stats), f"""{CONTACTS}, x as (select *, {N3} as n3 from contacts) select count(*) as total, count(email) as with_email, count(phone) as with_phone, count(*) filter (email is not null and phone is not null) as with_both,
 count(*) filter (n3 = 3) as complete, count(*) filter (n3 = 3) as high, count(*) filter (n3 = 2) as medium, count(*) filter (n3 < 2) as low from x"""),
    "a2_domain_stats": (on_contacts(stats.domain_stats), f"""{CONTACTS}, {DOMAIN} select sum(contacts)::bigint as parsed, count(*) as unique_domains, count(*) filter (domain_type = 'business') as business_domains,
 sum(case when domain_type = 'business' then contacts else 0 end)::bigint as business_contacts, sum(case when domain_type = 'personal' then contacts else 0 end)::bigint as personal_contacts, (select count(email) from contacts) as with_email from perdom"""),
    "a3_top_domains": (on_contacts(stats.top_domains), f"{CONTACTS}, {DOMAIN} select domain, contacts, round(contacts / (select count(email) from contacts), 4) as share from perdom order by contacts desc, first_row limit 10"),
    "a4_contacts_by_domain": (on_contacts(stats.contacts_by_domain), f"{CONTACTS}, {DOMAIN} select row_id, domain, count(*) over (partition by domain) as contacts from doms where domain is not null"),
    "a5_multi_contact_domains": (on_contacts(stats.multi_contact_domains), f"{CONTACTS}, {DOMAIN} select domain, contacts, domain_type = 'business' as business from perdom where contacts >= 2"),
    "a6_field_success": (on_contacts(stats.field_success), f"{CONTACTS}, u as (" + " union all ".join(f"select '{c}' as field, count({c}) as extracted, count(*) as total from contacts" for c in stats.REPORTED) + ") select field, extracted, total, round(extracted / total, 4) as rate, extracted / total < 0.5 as warn from u"),
    "a7_enrichment_stats": (lambda s, d: stats.enrichment_stats(long_rows(s, d)), f"{J1} select field, action, count(*) as contacts from act group by all"),
    "a8_enrichment_summary": (lambda s, d: stats.enrichment_summary(long_rows(s, d)), f"{J1}, n(action) as (values ('ENRICHED'), ('VALIDATED'), ('CLEANED'), ('REPLACED'), ('UNCHANGED'), ('BOTH_MISSING')) select n.action, count(act.row_id) as fields, round(count(act.row_id) / (select count(*) from act), 4) as share from n left join act using (action) group by 1"),
    "a9_field_breakdown": (
        lambda s, d: stats.field_breakdown(enriched(s, d)).where("field <> 'title'"),
        f"""{J1}, v as (select *, {VALUE} as v from act where field <> 'title') select field, count(o) as original, count(v) as enriched, count(*) filter (action = 'CLEANED') as contaminated, count(*) filter (action = 'REPLACED') as replaced,
 round(count(o) / count(*), 4) as fill_before, round(count(v) / count(*), 4) as fill_after, round((count(v) - count(o)) / count(*), 4) as improvement from v group by 1""",
    ),
    "a10_data_quality": (
        lambda s, d: (lambda c: stats.data_quality(c, T.presence_confidence(C("name"), C("email"), C("phone"))))(contacts(s, d)),
        f"""{CONTACTS}, x as (select *, {N3} as n3 from contacts), q as (select count(*) as n, count(name) / count(*) * 0.3 + count(email) / count(*) * 0.3 + count(phone) / count(*) * 0.2 + count(title) / count(*) * 0.1 + count(location) / count(*) * 0.1 as f,
 case when count(*) filter (n3 < 2) > count(*) filter (n3 = 3) then 'low' when count(*) filter (n3 = 2) > count(*) filter (n3 = 3) then 'medium' else 'high' end as confidence from x)
 select n, round(f, 4) as completeness, confidence, round(f * case confidence when 'high' then 1.0 when 'medium' then 0.8 else 0.6 end * 100, 2) as score from q""",
    ),
    "a10_data_quality_issues": (
        lambda s, d: stats.data_quality(contacts(s, d), T.presence_confidence(C("name"), C("email"), C("phone")), enrich.enrichment_metadata(enriched(s, d))).select("n", "confidence", "issue_count", F.array_join(F.transform("issues", lambda i: F.concat_ws(" ", i["row_id"].cast("string"), i["contact"], i["reason"])), "|").alias("issues")),
        f"""{J1}, x as (select *, {N3} as n3 from contacts), rv as (select row_id, string_agg(field || '_mismatch', ', ' order by list_position(['name', 'email', 'phone', 'title', 'location'], field)) as reason from act where action = 'REPLACED' group by 1),
 t as (select row_id || ' ' || coalesce(name, 'Unknown') || ' ' || reason as t, row_id from rv join contacts using (row_id) order by row_id limit 10)
 select count(*) as n, case when count(*) filter (n3 < 2) > count(*) filter (n3 = 3) then 'low' when count(*) filter (n3 = 2) > count(*) filter (n3 = 3) then 'medium' else 'high' end as confidence, (select count(*) from rv) as issue_count, (select string_agg(t, '|' order by row_id) from t) as issues from x""",
    ),
    "a11_recommendations": (
        lambda s, d: stats.recommendations(long_rows(s, d), contacts(s, d), errors=3, processed=20),
        f"""{J1}, gr as (select row_id, bool_or(action = 'REPLACED') as r, count({CONF}) as k, count(*) filter ({CONF} = 'low') as low from act group by 1),
 m as (select count(*) as n, count(*) filter (r) as r, count(*) filter (k = 0 or 2 * low > k) as low, (select count(email) / count(*) from contacts) as e from gr),
 a as (select unnest(list_filter([case when e < 0.5 then 'low_email_coverage' end, case when r > 0.1 * n then 'many_replacements' end, 'high_error_rate', case when low > 0.2 * n then 'low_confidence' end], lambda x: x is not null)) as recommendation from m)
 select * from a""",
    ),
    "a13_review_queue": (lambda s, d: stats.review_queue(long_rows(s, d)), f"{J1} select row_id, string_agg(field || '_mismatch', ',' order by field) as flags from act where action = 'REPLACED' group by 1"),
    "a14_cleaning_report": (
        lambda s, d: removals_apart(stats.cleaning_report(cleaned(s, d))),
        f"""{CONTACTS}, {CLEAN_NAME}, {PLAIN}, {CLEANED_ROWS} select field, count(*) as total, count(*) filter (ex and v <> o) as extracted, count(*) filter (o is not null and v is null) as nullified, count(*) filter ({CHANGED}) as modified,
 count(*) filter (not ({CHANGED})) as unchanged, sum(case when not ex and {CHANGED} then ts else 0 end)::bigint as "titleSuffix", sum(case when not ex and {CHANGED} then cs else 0 end)::bigint as "credentialSuffix", 0::bigint as email,
 sum(case when not ex and {CHANGED} then ph else 0 end)::bigint as phone, sum(case when not ex and {CHANGED} then sp else 0 end)::bigint as spam, count(*) filter (o is not null and v is null) > 0.1 * count(o) as alert from u group by 1""",
    ),
    "a14_cleaning_summary": (
        lambda s, d: stats.cleaning_summary(cleaned(s, d)),
        f"""{CONTACTS}, {CLEAN_NAME}, {PLAIN}, {CLEANED_ROWS}, rr as (select row_id, bool_or(case when ex then coalesce(v <> o, false) else {CHANGED} end) as m from u group by 1)
 select count(*) as contacts, count(*) filter (m) as contacts_modified, count(*) filter (not m) as contacts_unchanged, (select count(*) filter ({CHANGED}) from u) as fields_modified from rr""",
    ),
    "a17_extraction_quality": (
        lambda s, d: stats.extraction_quality(contacts(s, d).select(F.when(C("row_id") % 3 == 0, C("name")).alias("name"), F.when(C("row_id") % 5 == 0, F.when(C("row_id") % 2 == 0, C("email")).otherwise("no@where")).alias("email"), "row_id")).select("n", "invalid", "score", "band", F.array_join("issues", "|").alias("issues")),
        rf"""{CONTACTS}, rr as (select case when row_id % 3 = 0 then name end as name, case when row_id % 5 = 0 then case when row_id % 2 = 0 then email else 'no@where' end end as email from contacts),
 q as (select count(*) as n, count(name) as a, count(email) as e, count(*) filter (not regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]+$')) as invalid from rr), k as (select *, 100 - case when a < 0.5 * n then 20 else 0 end - case when e < 0.3 * n then 15 else 0 end - case when invalid > 0 then 10 else 0 end as s from q)
 select n, invalid, s::int as score, case when s >= 80 then 'high' when s >= 50 then 'medium' else 'low' end as band,
 concat_ws('|', case when a < 0.5 * n then 'names ' || floor(100 * a / n + 0.5)::bigint || '%' end, case when e < 0.3 * n then 'addresses ' || floor(100 * e / n + 0.5)::bigint || '%' end, case when invalid > 0 then 'invalid addresses' end) as issues from k""",
    ),
    "a18_validation_issues": (on_contacts(stats.validation_issues), rf"""{CONTACTS}, q as (select count(*) as n, count(name) as a, count(profile_url) as u, count(*) filter (regexp_matches(name, '(?i)(partner|associate|counsel)') or regexp_matches(location, '\+\d')) as d from contacts)
 select unnest(list_filter([case when a < 0.8 * n then 'few_names' end, case when u < 0.5 * n then 'few_urls' end, case when d > 0 then 'contaminated:' || d end], lambda x: x is not null)) as issue from q"""),
    "w3_slice_rows": (on_contacts(lambda d: d.orderBy("row_id").offset(20).limit(50).select("row_id", "name")), f"{CONTACTS} select row_id, name from contacts order by row_id limit 50 offset 20"),
    "w4_sample_rows": (on_contacts(lambda d: d.orderBy("row_id").limit(5).select("row_id", "name")), f"{CONTACTS} select row_id, name from contacts order by row_id limit 5"),
    "j2_match_by_name": (
        lambda s, d: enrich.match_profiles_by_name(contacts(s, d).withColumn("profile_url", F.nullif(F.col("profile_url"), F.when(F.col("row_id") % 4 == 0, F.col("profile_url")))), profile_links(s, d)),
        f"""{CONTACTS}, {PROFILES}, c as (select row_id, list_sort(list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(name), '[^a-z\\s]', '', 'g')), '\\s+'), lambda x: length(x) > 1))) as cw from contacts where profile_url is null or row_id % 4 = 0),
 lk as (select lw, min(position) as position from (select list_sort(list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(name), '[^a-z\\s]', '', 'g')), '\\s+'), lambda x: length(x) > 1))) as lw, regexp_extract(profile_url, '(\\d+)$', 1)::int as position from profiles) group by 1),
 m as (select row_id, position, len(list_intersect(cw, lw)) / len(list_distinct(cw || lw)) as score from c, lk where len(list_intersect(cw, lw)) > 0),
 r as (select *, row_number() over (partition by row_id order by score desc, position) as rn from m where score >= 0.8) select row_id, position::int as position, round(score, 4) as score from r where rn = 1""".replace("r as (select *, row_number() over (partition by row_id", "rk as (select *, row_number() over (partition by row_id").replace("from r where rn = 1", "from rk where rn = 1"),
    ),
    "j4_page_fingerprint": (
        lambda s, d: enrich.page_fingerprint_check(listed(s, d), pages=listed(s, d).select("listing_id", (C("page_num") + C("page_num") % 2).alias("page_num")).unionByName(listed(s, d).select("listing_id", "page_num"))),
        f"""{CONTACTS}, {LISTED}, ln as (select *, row_number() over (partition by listing_id, page_num order by position) as rn from li), h as (select listing_id, page_num, string_agg(coalesce(name, ''), '|' order by position) filter (rn <= 5) as ns, string_agg(coalesce(profile_url, name, ''), '|' order by position) filter (rn <= 5) as us,
  arg_max(coalesce(name, '-'), position) as ln, arg_min(coalesce(name, '-'), position) as tn, count(*) as n from ln group by all),
 o as (select listing_id, ns as ns1, us as us1, ln as ln1, tn as tn1, n as n1 from h where page_num = 1),
 gp as (select distinct listing_id, page_num from li union select distinct listing_id, page_num + page_num % 2 from li)
 select listing_id, page_num, case when page_num = 1 then 'first' when n is null then 'empty' when n1 is null then 'valid' when us = us1 then 'duplicate_urls' when ns = ns1 then 'duplicate_names' when ln = ln1 and tn = tn1 and n = n1 then 'duplicate_boundaries' else 'unique' end as verdict
 from gp left join h using (listing_id, page_num) left join o using (listing_id)""",
    ),
    "s7_latest_pattern": (
        lambda s, d: listing.latest_pattern(contacts(s, d).select(T.email_domain(C("email")).alias("domain"), C("row_id").alias("cached_at"), (C("row_id") * 7 % 101).alias("confidence"), C("profile_url").alias("pattern")).where("domain is not null")),
        f"{CONTACTS}, {DOMAIN}, k as (select domain, row_id as cached_at, row_id * 7 % 101 as confidence, profile_url as pattern from doms where domain is not null) select domain, max(cached_at) as cached_at, arg_max(confidence, cached_at) as confidence, max_by(coalesce(pattern, '~'), cached_at) as pattern from k where confidence >= 70 group by 1".replace("max_by(coalesce(pattern, '~'), cached_at) as pattern", "nullif(max_by(coalesce(pattern, '~'), cached_at), '~') as pattern"),
    ),
    "x1_union_pages": (
        lambda s, d: dedup.dedup_scrape(listing.union_pages([contacts(s, d).where(C("row_id") % 2 == 0), contacts(s, d).where(C("row_id") % 2 == 1)])).select("row_id"),
        f"{CONTACTS}, {D2} select row_id from r2",
    ),
    "x3_prefer_stage": (
        lambda s, d: listing.prefer_stage("row_id", contacts(s, d).where(C("row_id") % 3 == 0).select("row_id", F.lit("cleaned").alias("stage")), contacts(s, d).where(C("row_id") % 2 == 0).select("row_id", F.lit("enriched").alias("stage")), contacts(s, d).select("row_id", F.lit("scraped").alias("stage"))),
        f"{CONTACTS} select row_id, case when row_id % 3 = 0 then 'cleaned' when row_id % 2 = 0 then 'enriched' else 'scraped' end as stage from contacts",
    ),
    "s5_export_view": (
        lambda s, d: contact_io.export_view(contacts(s, d), columns=["name", "email", "profile_url"]).withColumnsRenamed({"Name": "name", "Email": "email", "Profile URL": "profile_url"}),
        f"{CONTACTS} select coalesce(name, '') as name, coalesce(email, '') as email, coalesce(profile_url, '') as profile_url from contacts",
    ),
    "h18_fill_missing_fields": (
        lambda s, d: html.fill_missing_fields(contacts(s, d), contacts(s, d).select("row_id", F.concat(F.lit("/p/"), "row_id").alias("profile_url"), F.lit("Fellow").alias("title"), "location")).select("row_id", "profile_url", "title", F.size("methods").alias("filled")),
        f"{CONTACTS} select row_id, coalesce(profile_url, '/p/' || row_id) as profile_url, coalesce(title, 'Fellow') as title, ((profile_url is null)::int + (title is null)::int)::int as filled from contacts",
    ),
    "c24_multi_location": (
        lambda s, d: contacts(s, d).select("row_id", PL.multi_location(C("location"), C("phone")).alias("x")).select("row_id", "x.several", "x.location", "x.phone", F.array_join("x.locations", "|").alias("locations")),
        f"""{CONTACTS}, s as (select row_id, phone, string_split(location, chr(10)) as a from contacts), t as (select *, a[1] as one, a[2] as two, regexp_matches(a[1], '^([A-Z][a-z]+( [A-Z][a-z]+)*(, [A-Z]{{2}})?|Washington, D\\.C\\.)$') as good from s),
 k as (select *, len(a) > 1 and two = 'Frankfurt' as twice, case when len(a) > 1 and two <> 'Frankfurt' then two end as own from t),
 o as (select *, not regexp_matches(one, '^(London|Frankfurt)$') as us1, coalesce(phone like '+1%', false) as us2 from k)
 select row_id, twice as several, case when twice and not us1 and us2 then two else one end as location,
 case when twice then case when not us1 and us2 then phone when us1 then phone else phone end else coalesce(own, phone) end as phone,
 case when twice then case when not us1 and us2 then two || '|' || one else one || '|' || two end else one end as locations from o""",
    ),
    "c25_phone_location_check": (
        lambda s, d: contacts(s, d).select("row_id", PL.phone_location_check(C("phone"), C("location")).alias("x")).select("row_id", "x.*"),
        f"""{CONTACTS}, x as (select row_id, phone as p, location as l, case when regexp_matches(location, 'Washington, D.C.') then 'US' when contains(location, 'Frankfurt') then 'Germany' when contains(location, 'London') then 'UK' else 'US' end as w,
 case substr(phone, 4, 3) when '212' then 'New York' when '312' then 'Chicago' when '202' then 'Washington' when '617' then 'Boston' end as city from contacts),
 y as (select *, case when p is null then 'missing-data' when p not like '+%' then 'no-country-code' when w <> 'US' then 'country-mismatch' when city is not null and not contains(l, city) then 'city-mismatch' end as reason from x)
 select row_id, coalesce(reason = 'city-mismatch', true) as valid, coalesce(reason in ('country-mismatch', 'city-mismatch'), false) as mismatch, reason from y""",
    ),
    "p2_enrich_flow": (
        lambda s, d: enrich.enrich_flow(contacts(s, d), profiles(s, d))["review"].where("field <> 'bio'"),
        f"{J1} select row_id, field, p as value, o as original, field || '_mismatch' as flag from act where action = 'REPLACED'",
    ),
    "x2_union_fields": (
        lambda s, d: field_counts(contacts(s, d).withColumns({"bio": C("title"), "tags": F.array("name"), "_x": C("name"), "domain": C("email")})),
        f"""{CONTACTS}, n as (select count(name) as name, count(email) as email, count(phone) as phone, count(title) as title, count(location) as location, count(profile_url) as profile_url, count(title) as bio from contacts)
 select field, present from n unpivot (present for field in (name, email, phone, title, location, profile_url, bio))""",
    ),
    "c28_post_clean": (lambda s, d: postclean.post_clean(contacts(s, d)), None),
    "a16_post_clean_stats": (lambda s, d: postclean.post_clean_stats(postclean.post_clean(contacts(s, d))), None),
    "a19_noise_summary": (
        lambda s, d: postclean.noise_summary(contacts(s, d).select("row_id", F.lit("name").alias("field"), K.detect_noise(F.lit("name"), C("name"), C("phone"), C("email"))["items"].alias("noise"))),
        f"{CONTACTS} select 'name' as field, count(*) as noisy, 'ui_element' as types from contacts where name like 'View%' having count(*) > 0",
    ),
    "p1_contact_pipeline": (
        lambda s, d: removals_apart(stats.cleaning_report(cleaned_after(s, d), ["name", "email"])),
        None,
    ),
    "j7_duplicate_pairs": (lambda s, d: (lambda c: dedup.duplicate_pairs(c, dedup.dedup_fuzzy(c)))(contacts(s, d)), None),
    "d3_dedup_fuzzy": (on_contacts(dedup.dedup_fuzzy), None),
    "j1a_enrichment_metadata": (
        lambda s, d: enrich.enrichment_metadata(enriched(s, d)).select("row_id", *(C("actions")[c].alias(c) for c in stats.REPORTED), F.array_join(F.array_sort("flags"), ",").alias("flags"), "needs_review", "overall"),
        f"""{J1}, c as (select *, {CONF} as conf from act) select row_id, {", ".join(f"max(action) filter (field = '{c}') as {c}" for c in ("name", "email", "phone", "title", "location"))},
 coalesce(string_agg(field || '_mismatch', ',' order by field) filter (action = 'REPLACED'), '') as flags, bool_or(action = 'REPLACED') as needs_review,
 case when count(conf) = 0 or 2 * count(*) filter (conf = 'low') > count(conf) then 'low' when 2 * count(*) filter (conf = 'high') > count(conf) then 'high' else 'medium' end as overall from c group by 1""",
    ),
    "j1b_fallback_clean": (
        lambda s, d: enrich.fallback_clean(enriched(s, d)),
        f"""{CONTACTS}, {PROFILES}, {SPLIT}, {LOCP} select c.row_id, case when c.profile_url is null then c.name when sp.t is null then sp.n else trim(left(sp.n, length(sp.n) - length(sp.t))) end as name,
 case when c.profile_url is null then c.title else coalesce(c.title, case when sp.t is not null then 'Partner' end) end as title, case when c.profile_url is null then c.location else lp3.v end as location, case when c.profile_url is null then 'no_profile_url' end as reason
 from contacts c join sp using (row_id) join lp3 using (row_id) where c.profile_url is null or c.profile_url not in (select profile_url from profiles)""",
    ),
    "a20_field_coverage": (
        lambda s, d: stats.field_coverage(contacts(s, d)).select("field", "valid", "total", "coverage", F.array_join("samples", "|").alias("samples")),
        rf"""{CONTACTS}, flat as (select row_id, unnest(['name', 'email', 'phone', 'title', 'location']) as field, unnest([name, email, phone, title, location]) as value from contacts),
 v as (select *, case when value is null then false when field = 'name' then not contains(value, '@') and not regexp_full_match(trim(value), '\+?[\d\s\-()]{{7,}}') and len(string_split_regex(trim(value), '\s+')) <= 6 when field = 'email' then regexp_full_match(trim(value), '{EMAIL_RE}')
  when field = 'phone' then length(regexp_replace(value, '\D', '', 'g')) between 7 and 15 else trim(value) <> '' end as ok, row_number() over (partition by field, value is null order by row_id) as rn from flat),
 r as (select *, row_number() over (partition by field, ok order by row_id) as r from v)
 select field, count(*) filter (ok) as valid, count(*) as total, round(count(*) filter (ok) / count(*), 4) as coverage, string_agg(value, '|' order by row_id) filter (ok and r <= 5) as samples from r group by field""".replace(" r as (select *, row_number() over (partition by field, ok", " ranked as (select *, row_number() over (partition by field, ok").replace("from r group by field", "from ranked group by field"),
    ),
}
