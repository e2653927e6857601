"""Queries on listing and profile pages that Spark builds from the customer table, and SQL that says what each page was built from."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import col as C

from ..functions import text as T
from ..functions import urls as U
from ..operators import cards, html, matching, profiles, selectors, trees
from ..sources.contacts import read_pages
from .contacts import BASE, customers

# Parts of a card or page by the customer's number; both engines read these.
PARTS = f"""{BASE},
x as (select k, fname || ' ' || lname as name, lower(fname) || '-' || lower(lname) || '-' || cast(k as varchar(9)) as slug, city,
 lower(fname) || '.' || lower(lname) || cast(k % 400 as varchar(9)) as box, 'firm' || cast((k div 8) % 17 as varchar(9)) || '.com' as site,
 cast(200 + k % 700 as varchar(9)) as area, substr(cast(10000 + k % 10000 as varchar(9)), 2, 4) as line from base)"""
DUCK = PARTS.replace(" div ", " // ")

CARD = """'<div class="card">' ||
 case k % 3 when 0 then '<h3>' || name || '</h3>' when 1 then '<div class="person-name">' || name || '</div>' else '<strong>' || name || ', Jr.</strong>' end ||
 case when k % 4 = 1 then '<a href="#top">Up</a>' else '<a class="more" href="/people/' || slug || '">' || case when k % 6 = 0 then '<img src="/i.png">' else '' end || case when k % 6 = 2 then name else 'View profile' end || '</a>' end ||
 case k % 5 when 0 then '<a href="mailto:' || box || '@' || site || '?subject=Hello">Email</a>' when 1 then '<a href="mailto:' || box || '@' || site || '">Write</a>'
  when 2 then '<p>' || box || '@' || site || '</p>' when 3 then '<i data-email="' || upper(box) || '@' || site || '"></i>' else '' end ||
 case k % 4 when 0 then '<a href="tel:+1-' || area || '-555-' || line || '">Call</a>' when 1 then '<p>(' || area || ') 555-' || line || '</p>' when 3 then '<span class="phone">' || area || '-555-' || line || '</span>' else '' end ||
 case when k % 2 = 0 then '<div class="job-title">Partner</div>' else '' end || case when k % 3 <> 1 then '<span class="office-location">' || city || '</span>' else '' end ||
 case when k % 7 = 0 then '<i data-profile="none" data-link="/bio/' || slug || '"></i>' else '' end || '</div>'"""

PROFILE = """'<html><head><title>' || site || '</title>' ||
 case when k % 4 = 3 then '<script type="application/ld+json">[{"@type":"Thing","name":"no"},{"@type":"Person","name":"' || name || '","email":"' || box || '@ld.net","jobTitle":"Chair","worksFor":{"name":"' || site || '"}}]</script>' else '' end || '</head><body>' ||
 case k % 3 when 0 then '<h1 class="profile-name">' || name || '</h1>' when 1 then '<h1>' || name || '</h1>' else '<div class="person-name">' || name || '</div><h1>Our Team</h1>' end ||
 case k % 4 when 0 then '<p class="position">Managing Partner</p>' when 1 then '<p>Read on</p><p>Senior Counsel</p>' else '' end ||
 case k % 6 when 0 then '<a href="mailto:Desk@other.net">Desk</a><a href="mailto:' || upper(box) || '@' || site || '">Mail</a>' when 1 then '<a href="mailto:desk@other.net">Desk</a><p>' || box || '@' || site || '</p>'
  when 2 then '<p>all@' || site || ' or ' || box || '@' || site || '</p>' when 3 then '<span class="contact-email">desk' || cast(k as varchar(9)) || '@' || site || '</span>' when 4 then '<p>Email: info@' || site || '</p>' else '' end ||
 case k % 5 when 0 then '<a href="tel:1' || area || '555' || line || '">Call</a>' when 1 then '<span class="phone-number">' || area || '.555.' || line || '</span>' when 2 then '<p>Tel: ' || area || '-555-' || line || '</p>' else '' end ||
 case when k % 4 = 2 then '<div itemscope itemtype="https://schema.org/Person"><span itemprop="email">' || box || '@micro.net</span><b itemprop="jobTitle">Fellow</b></div>' else '' end ||
 case when k % 2 = 0 then '<div class="bio">' || name || ' has worked on many matters for clients in ' || city || ' since 1990 or so</div>' else '<p>' || name || ' has, over the course of a long career, worked on a large number of matters for clients of all kinds and sizes.</p>' end ||
 case k % 3 when 0 then '<div class="education"><ul><li>Law School, 1985</li><li> </li><li>College</li></ul></div>' when 1 then '<div><h3>Education</h3><ul><li>University</li></ul></div>' else '' end ||
 case k % 4 when 1 then '<div class="practices"><a>Tax</a><a>Trade</a></div>' when 2 then '<section><h2>Areas of focus</h2><ul><li>Energy</li></ul></section>' else '' end ||
 case when k % 5 = 4 then '<div><h4>Bar Admissions</h4><ul><li>New York</li><li>Ohio</li></ul></div>' else '' end ||
 case k % 4 when 0 then '<span class="office">' || city || '</span>' when 3 then '<p>Location: Lake City.</p>' else '' end || '</body></html>'"""


def built(spark, sf, sql):
    text = f"with {PARTS} {sql}".replace("{", "{{").replace("}", "}}").replace("from customer ", "from {customer} ")
    return spark.sql(text, customer=customers(spark, sf))


def listing_pages(spark, sf):
    """Eight cards a page."""
    d = built(spark, sf, f"select k, k div 8 as page_id, 'https://' || site || '/people?page=' || cast(k div 8 as varchar(9)) as url, {CARD} as card from x")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda c: c["card"]), "")
    return d.groupBy("page_id", "url").agg(F.concat(F.lit("<html><body><div class='list'>"), body, F.lit("</div></body></html>")).alias("html"))


def listing_cards(spark, sf):
    return trees.cards(trees.page_trees(listing_pages(spark, sf)), "card")


def profile_pages(spark, sf):
    return trees.page_trees(built(spark, sf, f"select k as page_id, 'https://www.' || site || '/people/' || slug as url, {PROFILE} as html from x"))


def links_of(spark, sf):
    d = listing_pages(spark, sf)
    return html.html_links(html.html_nodes(d), d)


def social_pages(spark, sf):
    site = "case k % 5 when 0 then 'https://www.linkedin.com/in/' || slug when 1 then 'https://twitter.com/' || slug || '?s=1' when 2 then 'https://facebook.com/' || slug when 3 then 'https://github.com/' || slug else 'https://x.org/' end"
    return built(spark, sf, f"select k as page_id, 'https://' || site || '/' as url, '<p><a href=\"' || {site} || '\">me</a><a href=\"/in/' || slug || '\">in</a></p>' as html from x")


def site_methods(spark, sf):
    """Settings of each site: addresses by link or by text, phones by link on half of the sites, names by place."""
    d = built(spark, sf, "select distinct site as domain, (k div 8) % 17 % 2 as odd from x")
    how = F.array(*(F.struct(F.lit(f).alias("field"), m.alias("method")) for f, m in (("name", F.lit("coordinate-text")), ("email", F.when(C("odd") == 0, "mailto-link").otherwise("regex-email")), ("phone", F.when(C("odd") == 0, "tel-link")))))
    return d.select("domain", F.explode(F.filter(how, lambda h: h["method"].isNotNull())).alias("h"), F.lit(None).cast("int").alias("confidence")).select("domain", "h.field", "h.method", "confidence")


def paged(spark, sf):
    """Pages with page links, controls, totals and hints of endless lists on some, and on all of them what only looks like one."""
    d = built(spark, sf, "select k, 'https://' || site || '/list' as url from x")
    some = lambda n, text, r=0: F.when(C("k") % n == r, text).otherwise("")
    numbers = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), (C("k") % 5).cast("int")), lambda i: i > 0), lambda i: F.concat(F.lit("<a class='page-link' href='?p="), i.cast("string"), F.lit("'>"), i.cast("string"), F.lit("</a>"))), "")
    controls = F.concat(numbers, some(2, "<a class='go' rel='next'>on</a>"), some(3, "<a rel='prev'>back</a>"), some(4, "<button data-page='12'>last</button>", 1), some(6, "<nav class='my-paginator'></nav>", 1), some(8, "<b class='current'>2</b>", 3), some(8, "<b aria-current='page'>7</b>", 5))
    totals = F.concat(some(7, "<p>Page 1 of 30</p>"), some(9, "<div data-total-pages='44'></div>"))
    hints = F.concat(some(4, "<img loading='lazy'>" * 6), some(6, "<script>window.addEventListener('scroll', f)</script>"), some(5, "<div data-infinite></div>"), some(7, "<button>Load More</button>"), some(10, "<li data-index='1'></li>" * 11), some(11, "<i class='observe'></i>"))
    none = F.lit("<a href='/x'>99</a><p>next, previous, IntersectionObserver, infinite-scroll</p><a class='off next disabled'>5</a>")
    return d.select(C("k").alias("page_id"), "url", F.concat(F.lit("<html><body>"), none, controls, totals, hints, F.lit("</body></html>")).alias("html"))


# A page's links: address, text, and (in SQL) the score each should have; None where a page has no such link.
LINK_PARTS = [
    ("'/people/' || slug", "name", "100"), ("'/people/' || slug || '/cv'", "'CV'", "85"), ("'/x/' || slug", "name", "85"), ("'/x'", "'More'", "80"), ("'/y'", "'Search tips'", "70"), ("'/about/us'", "'View details'", "95"),
    ("'/home'", "'Home'", "40"), ("'/menu/bio'", "'Menu of bios'", "65"), ("'https://www.linkedin.com/in/' || slug", "name", "75"), ("'https://instagram.com/' || slug", "'me'", "70"), ("'#'", "'Top'", "40"), ("'mailto:' || box || '@' || site", "'Mail'", "70"),
]
LINKS = "[" + ", ".join(f"{{'n': {i}, 's': {s}, 'u': case when k % {i % 4 + 2} > 0 then {a if a.startswith(chr(39) + 'https') or a.startswith(chr(39) + 'mailto') else chr(39) + 'https://' + chr(39) + ' || site || ' + (chr(39) + '/' + chr(39) + ' || ' if a == chr(39) + '#' + chr(39) else '') + a} end}}" for i, (a, _, s) in enumerate(LINK_PARTS)) + "]"


def linked(spark, sf):
    """Pages of links of many kinds, each twice."""
    each = " || ".join(f"case when k % {i % 4 + 2} > 0 then '<a href=\"' || {a} || '\">' || {t} || '</a>' else '' end" for i, (a, t, _) in enumerate(LINK_PARTS))
    return built(spark, sf, f"select k as page_id, 'https://' || site || '/' as url, {each} || {each} as html from x")


def headed(spark, sf):
    """Profile links in cards, some with a text that says nothing; the card's name stands in a heading or in a part that is called name."""
    link = "'<a href=\"/our-team/' || slug || '\">' || case k % 3 when 0 then 'View' when 1 then '' else name end || '</a>'"
    card = f"case k % 4 when 0 then '<div class=\"outer-card\"><h2>Outer</h2><div class=\"person\"><i class=\"full-name\">' || name || '</i><p>' || {link} || '</p></div></div>' when 1 then '<div class=\"card\">' || {link} || '<h3>' || name || '</h3></div>' when 2 then '<div class=\"team-member\">' || {link} || '</div>' else {link} end"
    return built(spark, sf, f"select k as page_id, 'https://' || site || '/' as url, '<h2>Title</h2>' || {card} || '<a href=\"/realtor/' || slug || '\">' || name || '</a>' as html from x")


def grids(spark, sf):
    """Lists of equal cards after a first sibling that is unlike them, and one odd card at the end."""
    item = "'<li class=\"item\"><a href=\"/p\">' || name || '</a><p>' || city || '</p></li>'"
    odd = "'<li class=\"sep\"><b>1</b><b>2</b><b>3</b><b>4</b><b>5</b><b>6</b><b>7</b><b>8</b><b>9</b></li>'"
    return built(spark, sf, f"select k as page_id, 'https://' || site || '/' as url, '<ul>' || {odd} || repeat({item}, cast(1 + k % 4 as int)) || '</ul>' as html from x")


STEP_FROM = "case k % 4 when 0 then 'https://' || site || '/l?a=7&page=' || cast(k % 9 as varchar(9)) when 1 then 'https://' || site || '/l?start=0' when 2 then 'https://' || site || '/l/' || cast(k % 9 as varchar(9)) else 'https://' || site || '/l?x=1' end"
STEP_TO = "case k % 4 when 0 then 'https://' || site || '/l?a=7&page=' || cast(k % 9 + 1 as varchar(9)) when 1 then 'https://' || site || '/l?start=20' when 2 then 'https://' || site || '/l/' || cast(k % 9 + 1 as varchar(9)) else 'https://' || site || '/l?x=5' end"


def paging(spark, sf):
    """Addresses with what each way of finding a pattern would go by."""
    d = built(spark, sf, """select k, case k % 7 when 2 then 'https://' || site || '/list?page=' || cast(k % 50 as varchar(9)) || '&s=1' when 3 then 'https://' || site || '/list?nr=0' when 5 then 'https://' || site || '/list/page/3' else 'https://' || site || '/list' end as url,
 case when k % 7 = 3 then 'https://' || site || '/list?nr=20' end as next_url, case when k % 7 in (2, 4) then 6 else 0 end as scroll from x""")
    manual, cached = F.create_map(F.lit("offset"), F.lit("skip")), F.struct(F.lit("parameter").alias("type"), F.lit("pg").alias("name"))
    return d.select("k", "url", F.when(C("k") % 7 == 0, manual).alias("manual"), F.when(C("k") % 7 == 1, cached).alias("cached"), "next_url", "scroll")


def joined(*names):
    return lambda d: d.select(*(F.array_join(c, "|").alias(c) if c in names else C(c) for c in d.columns))


def contact_links(spark, sf):
    """Names without a profile address, and the links of the directory that they are in: twenty pages or so."""
    names = built(spark, sf, "select k as row_id, name, cast(null as varchar(9)) as profile_url, k div 154 as directory from x where k % 4 = 1")
    links = html.html_links(html.html_nodes(listing_pages(spark, sf)), listing_pages(spark, sf))
    links = links.where(C("url").contains("/people/")).select("url", "text", F.regexp_extract("url", r"(\d+)$", 1).try_cast("long").alias("pos"))
    return names, links.withColumn("directory", F.expr("pos div 154"))


PLACE = "(k // 8)::bigint as page_id, (row_number() over (partition by k // 8 order by k) - 1)::int as card_index"
URL_HERE = "'https://' || site || '/people/' || slug"
URL = "case when k % 4 <> 1 then 'https://' || site || '/people/' || slug end"
MAIL = "case when k % 5 < 4 then box || '@' || site end"
TEN = "area || '-555-' || line"
PHONE = f"case k % 4 when 0 then '+1-' || {TEN} when 1 then '(' || area || ') 555-' || line when 3 then {TEN} end"
SMART_TEN = "'(' || area || ') 555-' || line"
SMART_PLACE = "case when k % 3 <> 1 and city in ('New York, NY', 'Boston, MA') then city end"

QUERIES = {
    "h2_listing_links": (
        lambda s, d: links_of(s, d).select("page_id", "url", "text", "class", "has_img"),
        f"""with {DUCK} select (k // 8)::bigint as page_id, 'https://' || site || '/people#top' as url, 'Up' as text, '' as class, false as has_img from x where k % 4 = 1
 union all select (k // 8)::bigint, {URL_HERE}, case when k % 6 = 2 then name else 'View profile' end, 'more', k % 6 = 0 from x where k % 4 <> 1
 union all select (k // 8)::bigint, 'mailto:' || box || '@' || site || case when k % 5 = 0 then '?subject=Hello' else '' end, case when k % 5 = 0 then 'Email' else 'Write' end, '', false from x where k % 5 < 2
 union all select (k // 8)::bigint, 'tel:+1-' || {TEN}, 'Call', '', false from x where k % 4 = 0""",
    ),
    "h13_social_links": (
        lambda s, d: (lambda p: html.social_links(html.html_links(html.html_nodes(p), p)))(social_pages(s, d)),
        f"""with {DUCK}, u as (select k, slug, case k % 5 when 0 then 'linkedin' when 1 then 'twitter' when 2 then 'facebook' when 3 then 'github' end as platform from x)
 select k::bigint as page_id, platform, case platform when 'linkedin' then 'https://www.linkedin.com/in/' || slug when 'twitter' then 'https://twitter.com/' || slug || '?s=1' else 'https://' || platform || '.com/' || slug end as url, slug as username from u where platform is not null""",
    ),
    "h26_profile_links": (
        lambda s, d: html.profile_links(links_of(s, d)).select("page_id", "url", "text"),
        f"with {DUCK} select (k // 8)::bigint as page_id, {URL_HERE} as url, case when k % 6 = 2 then name else 'View profile' end as text from x where k % 4 <> 1",
    ),
    "h26_named_profile_links": (
        lambda s, d: (lambda p: (lambda n: html.profile_links(html.html_links(n, p), n))(html.html_nodes(p)).select("page_id", "url", "text"))(headed(s, d)),
        f"""with {DUCK} select k::bigint as page_id, 'https://' || site || '/our-team/' || slug as url, case when k % 3 = 2 or k % 4 in (0, 1) then name when k % 3 = 0 then 'View' end as text from x
 union all select k::bigint, 'https://' || site || '/realtor/' || slug, name from x""",
    ),
    "h3_email_candidates": (
        lambda s, d: cards.email_candidates(listing_cards(s, d)),
        f"""with {DUCK}, c as (select {PLACE}, k, {MAIL} as value from x) select page_id, card_index, 0 as position, value, case k % 5 when 0 then 'email-link-text' when 1 then 'mailto' when 2 then 'text' else 'data-attr' end as source,
 case when k % 5 = 2 then 'medium' else 'high' end as confidence from c where value is not null""",
    ),
    "h4_phone_candidates": (
        lambda s, d: cards.phone_candidates(listing_cards(s, d)),
        rf"""with {DUCK}, c as (select {PLACE}, k, {PHONE} as value from x) select page_id, card_index, 0 as position, value, regexp_replace(value, '\D', '', 'g') as digits, case when k % 4 = 0 then 'tel' else 'text' end as source,
 case when k % 4 = 0 then 'high' else 'medium' end as confidence from c where value is not null""",
    ),
    "h5_name_candidates": (
        lambda s, d: listing_cards(s, d).select("page_id", "card_index", cards.card_name(C("nodes")).alias("name")),
        f"with {DUCK} select {PLACE}, name from x",
    ),
    "h1_html_nodes": (
        lambda s, d: html.html_nodes(listing_pages(s, d)).groupBy("page_id").agg(F.count("*").alias("nodes"), F.count_if(C("tag") == "a").alias("links"), F.sum(F.length("own_text")).alias("chars")),
        f"""with {DUCK} select (k // 8)::bigint as page_id, (3 + sum(3 + (k % 4 <> 1 and k % 6 = 0)::int + (k % 5 < 4)::int + (k % 4 <> 2)::int + (k % 2 = 0)::int + (k % 3 <> 1)::int + (k % 7 = 0)::int))::bigint as nodes, sum(1 + (k % 5 < 2)::int + (k % 4 = 0)::int)::bigint as links,
 sum(length(name) + case when k % 3 = 2 then 5 else 0 end + case when k % 4 = 1 then 2 when k % 6 = 2 then length(name) else 12 end + case when k % 5 < 2 then 5 when k % 5 = 2 then length(box || '@' || site) else 0 end
  + case k % 4 when 0 then 4 when 1 then 14 when 3 then 12 else 0 end + case when k % 2 = 0 then 7 else 0 end + case when k % 3 <> 1 then length(city) else 0 end)::bigint as chars from x group by 1""",
    ),
    "h8_link_scores": (
        lambda s, d: (lambda p: html.link_scores(html.html_links(html.html_nodes(p), p)).select("page_id", "url", "score", "best"))(linked(s, d)),
        f"""with {DUCK}, ll as (select k::bigint as page_id, unnest({LINKS}) as v, k from x), u as (select page_id, v.u as url, v.s::int as score, v.n as n from ll where v.u is not null)
 select page_id, url, score, n = arg_min(n, -1000 * score + n) over (partition by page_id) as best from u""",
    ),
    "h28_pagination_controls": (
        lambda s, d: html.pagination_controls(html.html_nodes(paged(s, d))),
        f"""with {DUCK}, n as (select k, list_sort(list_distinct(range(1, k % 5 + 1) || case when k % 4 = 1 then [12] else [] end)) as ns from x)
 select k::bigint as page_id, array_to_string(list_transform(ns, lambda i: i::varchar), ',') as numbers, coalesce(list_max(ns), case when k % 7 = 0 then 30 when k % 9 = 0 then 44 end)::bigint as max_page, case when k % 8 = 3 then 2 when k % 8 = 5 then 7 end::bigint as current_page,
 k % 2 = 0 as has_next, k % 3 = 0 as has_prev, case when len(ns) > 0 then 'numeric' when k % 2 = 0 or k % 3 = 0 then 'next-prev' else 'none' end as kind, k % 6 = 1 or k % 2 = 0 or len(ns) > 0 as has_pagination from n""",
    ),
    "h29_page_totals": (
        lambda s, d: html.max_page(html.html_nodes(paged(s, d))),
        f"with {DUCK} select k::bigint as page_id, case when k % 7 = 0 then 30 else 44 end::bigint as max_page from x where k % 7 = 0 or k % 9 = 0",
    ),
    "h30_infinite_scroll": (
        lambda s, d: html.infinite_scroll_score(paged(s, d)),
        f"""with {DUCK}, p as (select k, (2 * (k % 4 = 0)::int + 2 * (k % 6 = 0)::int + 2 * (k % 5 = 0)::int + (k % 7 = 0)::int + 2 * (k % 10 = 0)::int + (k % 11 = 0)::int)::int as score from x)
 select k::bigint as page_id, score, score >= 4 as infinite from p""",
    ),
    "u7_compare_urls": (
        lambda s, d: built(s, d, f"select k, {STEP_FROM} as a, {STEP_TO} as b from x").select("k", U.compare_urls(C("a"), C("b")).alias("step")).select("k", "step.*"),
        f"with {DUCK} select k, case k % 4 when 0 then 'parameter' when 1 then 'offset' when 2 then 'path' end as type, case k % 4 when 0 then 'page' when 1 then 'start' end as name, case when k % 4 = 1 then 20 end::bigint as size from x",
    ),
    "h20_apply_field_methods": (
        lambda s, d: cards.apply_field_methods(listing_cards(s, d), site_methods(s, d), U.domain(C("url")), ["name", "email", "phone"]).select("page_id", "card_index", "domain", "name", "email", "phone", F.array_join(F.array_sort(F.map_keys("methods")), ",").alias("fields")),
        f"""with {DUCK}, c as (select {PLACE}, site as domain, case when k % 3 < 2 then name end as name, case when (k // 8) % 17 % 2 = 0 then case when k % 5 < 2 then box || '@' || site end else case when k % 5 = 2 then box || '@' || site end end as email,
 case when (k // 8) % 17 % 2 = 0 and k % 4 = 0 then '+1-' || {TEN} end as phone from x)
 select *, array_to_string(list_filter([case when email is not null then 'email' end, case when name is not null then 'name' end, case when phone is not null then 'phone' end], lambda v: v is not null), ',') as fields
 from c where name is not null or email is not null or phone is not null""",
    ),
    "h27_visit_extract": (
        lambda s, d: cards.visit_extract(profile_pages(s, d)),
        f"""with {DUCK} select k::bigint as page_id, case k % 6 when 0 then 'desk@other.net' when 1 then 'desk@other.net' when 2 then 'all@' || site when 3 then 'desk' || k || '@' || site when 4 then 'info@' || site else case when k % 4 = 2 then box || '@micro.net' end end as email,
 case k % 5 when 0 then '1' || area || '555' || line when 1 then area || '.555.' || line when 2 then {TEN} end as phone, case when k % 3 = 2 then 'Our Team' else name end as name from x""",
    ),
    "h31_repeated_cards": (
        lambda s, d: cards.repeated_cards(listing_pages(s, d)).where(selectors.css(".card")).groupBy("page_id").agg(F.count("*").alias("alike")),
        f"with {DUCK}, p as (select (k // 8)::bigint as page_id, count(*) as n from x group by 1) select page_id, n - 1 as alike from p where n > 1",
    ),
    "h31_cards_after_another": (
        lambda s, d: cards.repeated_cards(grids(s, d)).where("tag = 'li'").select("page_id", "n", "like", "score"),
        f"with {DUCK}, i as (select k, unnest(range(1, k % 4 + 1)) as i from x) select k::bigint as page_id, (11 + 3 * i)::int as n, 11 as like, 100.0::double as score from i",
    ),
    "c15_adjust_confidence": (
        lambda s, d: built(s, d, "select k, case k % 4 when 0 then 'name' when 1 then 'email' when 2 then 'phone' else 'profile_url' end as field, case k % 9 when 0 then name when 1 then box || '@' || site when 2 then area || '-555-' || line when 3 then '/people/' || slug when 4 then box when 5 then 'of one two three four five' when 7 then '' when 8 then lower(name) end as value, 60 + 5 * (k % 9) as base from x").select("k", T.adjust_confidence(C("field"), C("value"), C("base")).cast("int").alias("confidence"), T.confidence_band(T.adjust_confidence(C("field"), C("value"), C("base"))).alias("band")),
        rf"""with {DUCK}, v as (select k, case k % 4 when 0 then 'name' when 1 then 'email' when 2 then 'phone' else 'profile_url' end as field, case k % 9 when 0 then name when 1 then box || '@' || site when 2 then area || '-555-' || line when 3 then '/people/' || slug when 4 then box when 5 then 'of one two three four five' when 7 then '' when 8 then lower(name) end as value, 60 + 5 * (k % 9) as base from x),
 c as (select k, case when value is null or value = '' then 0 else greatest(0, least(100, base + case field
  when 'name' then case when len(string_split(value, ' ')) between 2 and 4 and regexp_full_match(value, '[A-Z]\S*( [A-Z]\S*)*') then 10 when contains(value, '@') or regexp_matches(value, '\d{{3}}[-.\s]?\d{{3}}[-.\s]?\d{{4}}') then -30 when len(string_split(value, ' ')) < 2 then -20 when len(string_split(value, ' ')) > 5 then -15 else 0 end
  when 'email' then case when regexp_full_match(value, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}') then 10 else -20 end
  when 'phone' then case when length(regexp_replace(value, '\D', '', 'g')) between 10 and 11 then 10 else -20 end
  else case when value like '/%' or value like 'http%' then 10 else -10 end end)) end::int as confidence from v)
 select *, case when confidence >= 90 then 'high' when confidence >= 70 then 'medium' else 'low' end as band from c""",
    ),
    "u9_choose_pattern": (
        lambda s, d: U.choose_pattern(paging(s, d)).select("k", C("pattern").alias("p")).select("k", "p.type", "p.name", "p.base_url", "p.page", "p.size", F.round("p.confidence", 2).alias("confidence"), "p.method"),
        f"""with {DUCK}, b as (select k, 'https://' || site as b from x)
 select k, case k % 7 when 0 then 'offset' when 1 then 'parameter' when 2 then 'parameter' when 3 then 'offset' when 4 then 'infinite-scroll' when 5 then 'path' end as type,
  case k % 7 when 0 then 'skip' when 1 then 'pg' when 2 then 'page' when 3 then 'nr' end as name,
  case k % 7 when 0 then b || '/list' when 1 then b || '/list' when 2 then b || '/list?page=' || (k % 50) || '&s=1' when 3 then b || '/list' when 4 then b || '/list' when 5 then '/list/page/{{page}}' end as base_url,
  case k % 7 when 2 then k % 50 when 5 then 3 end::bigint as page, case k % 7 when 0 then 10 when 3 then 20 end::int as size,
  case k % 7 when 2 then 1.0 when 3 then 0.75 when 4 then 0.6 when 5 then 0.35 end::double as confidence,
  case k % 7 when 0 then 'manual' when 1 then 'cache' when 2 then 'url-parameter' when 3 then 'navigation' when 4 then 'infinite-scroll-detection' when 5 then 'url-analysis' end as method from b""",
    ),
    "h7_contacts_from_pages": (lambda s, d: cards.contacts_from_cards(cards.whole_pages(trees.page_trees(read_pages(s, f"{d}/pages.parquet")))), None),
    "h17_listing_cards": (
        lambda s, d: cards.listing_cards(listing_cards(s, d)),
        f"""with {DUCK} select {PLACE}, case when k % 3 < 2 then name end as name, {URL} as profile_url, case when k % 5 < 3 then box || '@' || site end as email, {PHONE} as phone,
 case when k % 2 = 0 then 'Partner' end as title, case when k % 3 <> 1 then city end as location from x""",
    ),
    "h6_profile_url_candidates": (
        lambda s, d: listing_cards(s, d).select("page_id", "card_index", cards.best_profile_link(C("nodes"), C("url")).alias("b")).select("page_id", "card_index", "b.url", "b.text", "b.score"),
        f"""with {DUCK} select {PLACE}, {URL} as url, case when k % 4 <> 1 then case when k % 6 = 2 then name else 'View profile' end end as text, case when k % 4 <> 1 then case when k % 6 = 0 then 1.8 else 1.3 end end::double as score from x""",
    ),
    "h7_contacts_from_cards": (
        lambda s, d: cards.contacts_from_cards(listing_cards(s, d)),
        f"""with {DUCK}, c as (select *, {MAIL} as email, {PHONE} as phone from x)
 select {PLACE}, name, email, phone, {URL} as profile_url, case when email is not null and phone is not null then 'high' when email is not null or phone is not null then 'medium' else 'low' end as confidence,
 case k % 5 when 0 then 'email-link-text' when 1 then 'mailto' when 2 then 'text' when 3 then 'data-attr' end as email_source, case k % 4 when 0 then 'tel' when 1 then 'text' when 3 then 'text' end as phone_source,
 case when k % 4 <> 1 then case when k % 6 = 0 then 1.8 else 1.3 end end::double as profile_url_score, (email is not null)::int as all_emails, (phone is not null)::int as all_phones from c""",
    ),
    "h9_data_urls": (
        lambda s, d: cards.data_urls(listing_cards(s, d)),
        f"with {DUCK} select {PLACE}, case when k % 7 = 0 then 'https://' || site || '/bio/' || slug end as data_url, case when k % 7 = 0 then 'data-link' end as attribute, case when k % 7 = 0 then 85 else 0 end as confidence from x",
    ),
    "h16_smart_contacts": (
        lambda s, d: cards.smart_contacts(listing_cards(s, d)),
        f"""with {DUCK}, c as (select {PLACE}, case when k % 5 < 3 then box || '@' || site end as email, case when k % 3 = 2 then name || ',' else name end as name,
 case k % 4 when 0 then '+1 ' || {SMART_TEN} when 1 then {SMART_TEN} when 3 then {SMART_TEN} end as phone, case when k % 2 = 0 then 'Partner' end as title, {URL} as profile_url, {SMART_PLACE} as location from x)
 select *, (case when email is null then 0 else 35 end + 30 + case when phone is null then 0 else 15 end + case when title is null then 0 else 10 end + case when profile_url is null then 0 else 5 end + case when location is null then 0 else 5 end)::int as score,
 (email is not null)::int as all_emails, (phone is not null)::int as all_phones from c""",
    ),
    "h21_profile_fields": (
        lambda s, d: profiles.profile_fields(profile_pages(s, d)),
        f"""with {DUCK} select k::bigint as page_id, 'https://www.' || site || '/people/' || slug as profile_url, name,
 case k % 6 when 0 then box || '@' || site when 1 then box || '@' || site when 2 then box || '@' || site when 3 then 'desk' || k || '@' || site end as email,
 case when k % 5 < 3 then '+1-' || {TEN} end as phone, case k % 4 when 0 then 'Managing Partner' when 1 then 'Senior Counsel' when 2 then 'Fellow' end as title,
 case k % 4 when 0 then city when 3 then 'Lake City' end as location from x""",
    ),
    "h22_profile_lists": (
        lambda s, d: joined("education", "practice_areas", "bar_admissions")(profiles.profile_lists(profile_pages(s, d))),
        f"""with {DUCK} select k::bigint as page_id, case when k % 2 = 0 then name || ' has worked on many matters for clients in ' || city || ' since 1990 or so' else name || ' has, over the course of a long career, worked on a large number of matters for clients of all kinds and sizes.' end as bio,
 case k % 3 when 0 then 'Law School, 1985|College' when 1 then 'University' end as education, case k % 4 when 1 then 'Tax|Trade' when 2 then 'Energy' end as practice_areas, case when k % 5 = 4 then 'New York|Ohio' end as bar_admissions from x""",
    ),
    "h23_structured_person": (
        lambda s, d: profiles.structured_person(profile_pages(s, d)),
        f"""with {DUCK} select k::bigint as page_id, case when k % 4 = 3 then name end as name, case k % 4 when 3 then box || '@ld.net' when 2 then box || '@micro.net' end as email, null::varchar as telephone,
 case k % 4 when 3 then 'Chair' when 2 then 'Fellow' end as job_title, null::varchar as description, case when k % 4 = 3 then site end as works_for, case k % 4 when 3 then 'json-ld' when 2 then 'microdata' end as source from x""",
    ),
    "h19_label_values": (
        lambda s, d: profiles.label_values(profile_pages(s, d), "phone"),
        f"with {DUCK} select k::bigint as page_id, case when k % 5 = 2 then {TEN} end as phone, case when k % 5 = 2 then 75 end as confidence from x",
    ),
    "c11_business_email": (
        lambda s, d: built(s, d, "select k, case k % 4 when 0 then 'info@' || site when 1 then box || '@' || site when 2 then box || '@other.net' else box end as email, case when k % 3 = 0 then null else site end as site from x").select("k", "email", T.is_business_email(C("email"), C("site")).alias("ok")),
        f"with {DUCK} select k, case k % 4 when 0 then 'info@' || site when 1 then box || '@' || site when 2 then box || '@other.net' else box end as email, k % 4 = 1 or (k % 4 = 2 and k % 3 = 0) as ok from x",
    ),
    "c8_name_near_email": (
        lambda s, d: built(s, d, "select k, 'Kind Regards Here' || chr(10) || name || chr(10) || case when k % 2 = 0 then 'Other Person' || chr(10) else '' end || 'Mail ' || box || '@' || site as text, box || '@' || site as email from x").select("k", T.name_near_email(C("text"), C("email")).alias("b")).select("k", "b.name", F.round("b.score", 6).alias("score")),
        f"""with {DUCK} select k, name, round(case when k % 2 = 0 then greatest(0, 50 - (length(name) + 1 + length('Other Person') + 1 + length('Mail ')) / 2.0) else greatest(0, 50 - (length(name) + 1 + length('Mail ')) / 2.0) end + 40 + 10, 6)::double as score from x""",
    ),
    "c33_classify_link": (
        lambda s, d: built(s, d, "select k, name, case k % 4 when 0 then 'https://' || site || '/people/' || slug when 1 then 'https://linkedin.com/in/' || lower(fname_) when 2 then 'https://twitter.com/' || slug else 'https://' || site || '/a' end as url, case when k % 3 = 0 then name else 'more' end as text from (select *, substr(name, 1, position(' ' in name) - 1) as fname_ from x)").select("k", matching.classify_link(C("url"), C("text"), C("name")).alias("c")).select("k", "c.type", "c.is_profile", "c.name_match", F.round("c.confidence", 6).alias("confidence")),
        f"""with {DUCK} select k, case k % 4 when 0 then 'profile' when 1 then 'linkedin' when 2 then 'twitter' else 'unknown' end as type, k % 4 = 0 as is_profile,
 case k % 4 when 0 then 'exact' when 1 then 'weak' when 2 then 'exact' else case when k % 3 = 0 then 'strong' else 'none' end end as name_match,
 round(0.6 * case k % 4 when 0 then 0.95 when 1 then 0.3 when 2 then 0.95 else 0 end + 0.4 * case when k % 3 = 0 then 1 else 0 end, 6)::double as confidence from x""",
    ),
    "j3_match_profiles_by_url": (
        lambda s, d: matching.match_profiles_by_url(*contact_links(s, d), "directory"),
        f"""with {DUCK}, asked as (select k as row_id, name, lower(split_part(name, ' ', 1)) as f, lower(split_part(name, ' ', 2)) as l, k // 154 as directory from x where k % 4 = 1),
  given as (select k as pos, 'https://' || site || '/people/' || slug as url, case when k % 6 = 2 then name else 'View profile' end as text, k // 154 as directory from x where k % 4 <> 1),
 pairs as (select row_id, pos, url, case when contains(url, f || '-' || n.l) then 0.95 when len(list_filter(string_split_regex(url, '[/\\-_.]'), lambda w: contains(w, f))) > 0 and len(list_filter(string_split_regex(url, '[/\\-_.]'), lambda w: contains(w, n.l))) > 0 then 0.85
   when len(list_filter(string_split_regex(url, '[/\\-_.]'), lambda w: contains(w, n.l))) > 0 then 0.5 when len(list_filter(string_split_regex(url, '[/\\-_.]'), lambda w: contains(w, f))) > 0 then 0.3 else 0 end as u,
   (case when len(list_filter(string_split(lower(text), ' '), lambda w: contains(w, f) or contains(f, w))) > 0 then 0.5 else 0 end + case when len(list_filter(string_split(lower(text), ' '), lambda w: contains(w, n.l) or contains(n.l, w))) > 0 then 0.5 else 0 end) as t
   from asked n join given using (directory)),
 ranked as (select *, row_number() over (partition by row_id order by 0.6 * u + 0.4 * t desc, pos) as rn from pairs where 0.6 * u + 0.4 * t >= 0.5)
 select row_id, url as profile_url, round(0.6 * u + 0.4 * t, 6)::double as confidence, case u when 0.95 then 'exact' when 0.85 then 'strong' when 0.5 then 'partial' when 0.3 then 'weak' end as kind from ranked where rn = 1""",
    ),
}
