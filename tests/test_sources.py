"""Settings, exports, SQL functions, selectors and streams: cases written down by hand, and jobs against their batch forms."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import col as C

from cardloom.functions import sql as sql_functions
from cardloom.functions import text as T
from cardloom.operators import cards, dedup, enrich, flow, html, listing, postclean, stats
from cardloom.operators.fingerprint import page_fingerprint_check
from cardloom.operators.selectors import css
from cardloom.plans import source_queries
from cardloom.sources import contacts as io
from cardloom.sources import export
from cardloom.streaming import jobs

CONTACT = "row_id long, name string, email string, phone string, title string, location string, profile_url string"
PAGE = "page_id long, url string, html string"


@pytest.fixture(autouse=True, scope="module")
def folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (7 - len(r))) for r in rows], CONTACT)


def merge(a, b):
    """The rule in plain Python."""
    return {k: merge(a[k], b[k]) if isinstance(a.get(k), dict) and isinstance(b.get(k), dict) else b[k] if k in b else a[k] for k in {**a, **b}}


def test_settings_merge_at_every_depth(spark):
    default = {"a": 1, "b": {"c": 2, "d": {"e": [1, 2], "f": None, "g": {}}}, "l": [1], "s": "x"}
    own = [
        {}, {"a": None}, {"b": None}, {"b": 5}, {"b": {}}, {"b": {"c": None, "new": {"x": [{}]}}}, {"b": {"d": {"e": [], "g": {"h": 1}}}}, {"b": {"d": "x"}}, {"l": {"0": 1}}, {"z": {"y": {"w": None}}},
        {"s": "it's \"q\" \\ é"}, {"a": 1.5, "l": None},
    ]
    conf = spark.createDataFrame([(f"d{i}.co", json.dumps(o)) for i, o in enumerate(own)] + [("bad.co", "{x"), ("list.co", "[1]"), ("null.co", None)], "domain string, settings string")
    pages = spark.createDataFrame([(i, f"https://www.d{i}.co/p", "") for i in range(len(own))] + [(100, "https://bad.co/", ""), (101, "http://none.co", ""), (102, None, ""), (103, "https://list.co", ""), (104, "https://null.co", "")], PAGE)
    for small in (10, 0):
        got = {r["page_id"]: json.loads(r["settings"]) for r in io.resolve_site_config(pages, conf, default, small).collect()}
        assert got == {i: merge(default, o) for i, o in enumerate(own)} | {i: default for i in range(100, 105)}
    as_variant = io.resolve_site_config(pages, conf.where("domain like 'd%'").select("domain", F.parse_json("settings").alias("settings")), default)
    assert {r["page_id"]: json.loads(r["settings"]) for r in as_variant.where("page_id < 100").collect()} == {i: merge(default, o) for i, o in enumerate(own)}
    assert json.loads(io.resolve_site_config(pages.limit(1), conf, {}).first()["settings"]) == {}


def test_export_values(spark):
    d = spark.sql("""select * from values (1L, '(212) 555-1234', array('a', null, 'b'), timestamp'2025-12-09 18:10:00', 2.0D, named_struct('x', 1), true), (2L, '12125551234', array(), timestamp'2025-01-02 00:05:00', 2.5D, null, null),
      (3L, '+44 20 7946 0958', null, null, null, null, false), (4L, '', array('c'), timestamp'2025-06-01 12:00:00', -3.0D, null, null) as t(row_id, phone, practice_areas, seen_at, score, nested, flag)""")
    got = {r["row_id"]: tuple(r)[1:] for r in export.format_columns(d, ["phone", "practiceAreas", "seenAt", "score", "nested", "flag", "nothing"]).collect()}
    assert got == {
        1: ("+1-212-555-1234", "a, , b", "Dec 9, 2025 6:10 PM", "2", '{"x":1}', "true", ""), 2: ("+1-212-555-1234", "", "Jan 2, 2025 12:05 AM", "2.5", "", "", ""),
        3: ("+44 20 7946 0958", "", "", "", "", "false", ""), 4: ("", "c", "Jun 1, 2025 12:00 PM", "-3", "", "", ""),
    }
    e = spark.sql("select 1L as row_id, 'row' as confidence, named_struct('enrichedAt', 'soon', 'actions', map('name', 'CLEANED', 'email', 'UNCHANGED', 'bio', 'BOTH_MISSING', 'phone', 'ENRICHED'), 'confidence', 'low') as enrichment")
    assert tuple(export.format_columns(e, export.ENRICHMENT_COLUMNS).first())[1:] == ("soon", "name:CLEANED, phone:ENRICHED", "low", "1", "1")
    assert tuple(export.format_columns(e.drop("enrichment"), export.ENRICHMENT_COLUMNS).first())[1:] == ("",) * 5  # a row's own level is not the enrichment's


def test_export_columns(spark):
    d = spark.sql("select 1L as row_id, 'n' as name, cast(null as string) as email, 'd' as domain_type, 'z' as zeta, 'b' as alpha, map('a', 1) as m, 'i' as _inner, 'u' as profile_url, 'x' as enriched_at")
    choose = lambda **how: export.select_export_columns(d, **how)
    assert choose() == ["name", "profileUrl"] and choose(core=True, enrichment=True) == ["name", "profileUrl"]
    assert choose(every=True) == ["name", "profileUrl", "domainType", "alpha", "enrichedAt", "zeta"]
    assert choose(every=True, exclude=["zeta", "profile_url"]) == ["name", "domainType", "alpha", "enrichedAt"]
    assert choose(columns=["zeta", "email", "confidence", "name"]) == ["name", "confidence", "zeta"]
    assert choose(enrichment=True) == ["name", "profileUrl", "actionsSummary", "confidence", "enrichedAt", "fieldsCleanedCount", "fieldsEnrichedCount"]
    assert export.select_export_columns(d.where("row_id > 1"), core=True) == export.CORE_COLUMNS[:5][:4] + ["profileUrl", "location"]
    assert [export.header(x) for x in ("domainType", "profileUrl", "actionsSummary", "name", "allLocations")] == ["Domain Type", "Profile URL", "Actions", "Name", "All Locations"]
    assert export.export_table(d.where("false")).collect() == []


def test_sql_functions_are_the_columns(spark):
    a, b = source_queries.called_in_sql(spark, "/root/testdata/sf0.001"), source_queries.in_columns(spark, "/root/testdata/sf0.001")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    made = sql_functions.register(spark, "t_")
    assert set(made) == {f"t_{n}" for n in [*sql_functions.FUNCTIONS, *sql_functions.TABLES]}
    odd = spark.createDataFrame([("o'neil\\ \"x\" and(1) =(2) in(3)",), (None,), ("",), ("Al O'Neil a@b.co 212-555-1234 c@d.org",)], "x string")
    odd.createOrReplaceTempView("odd_texts")
    got = spark.sql("select t_extract_emails(x) as a, t_match_key(x) as b, t_clean_name(x) as c, t_validate_field('name', x) as d, t_url_params(x) as e from odd_texts").collect()
    from cardloom.functions import cleaning as K
    from cardloom.functions import urls as U

    assert got == odd.select(T.extract_emails(C("x")).alias("a"), T.match_key(C("x")).alias("b"), K.clean_name(C("x")).alias("c"), T.validate_field(F.lit("name"), C("x")).alias("d"), U.params(C("x")).alias("e")).collect()
    assert [(r["position"], r["email"]) for r in spark.sql("select e.* from odd_texts, lateral t_contact_emails(x) as e").collect()] == [(0, "a@b.co"), (1, "c@d.org")]


NODES = """<div id="top" class="card big"><a href="/x" class="Next off" aria-label="Go to NEXT" rel="nofollow next">n</a><button disabled data-page="3">b</button><nav><ul><li class="page-link">1</li></ul></nav><img loading="lazy"></div>"""


@pytest.mark.parametrize("selector,tags", [
    ("a", "a"), (".card", "div"), ("#top.big", "div"), ('a[href]', "a"), ('[aria-label*="next" i]', "a"), ('[aria-label*="next"]', ""), ('a[class*="Next"]:not(.disabled)', "a"), ("a:not(.off)", ""), ('[rel~="next"]', "a"), ('[rel="next"]', ""),
    ("button:not([disabled])", ""), ("[data-page], img", "button img"), ("nav li", "li"), ("div nav li", "li"), ("ul nav", ""), ("li:in(nav)", "li"), ("*[loading=lazy]", "img"), ('[href^="/x"]', "a"), ('[href$="y"]', ""),
])
def test_selectors(spark, selector, tags):
    nodes = html.html_nodes(spark.createDataFrame([(1, "u", NODES)], PAGE))
    assert [r["tag"] for r in nodes.where(css(selector)).orderBy("node_id").collect()] == tags.split()


@pytest.mark.parametrize("selector", ["a > b", "a:hover", "a[", "..x", ".a .b"])
def test_selectors_that_are_not_known(spark, selector):
    with pytest.raises(ValueError):
        css(selector)


def test_link_scores(spark):
    links = [("/people/a", "Jane Doe", 100), ("/profiles/1", "More", 95), ("/s", "Search tips", 70), ("https://linkedin.com/in/x", "Jane Doe", 75), ("https://instagram.com/x", "Jane Doe", 85), ("javascript:void(0)", "Homes", 40), ("/x", "A One Two Three Four", 70), ("mailto:a@b.co", "Write", 70)]
    page = "".join(f'<a href="{h}">{t}</a>' for h, t, _ in links)
    pages = spark.createDataFrame([(1, "https://x.co/", page)], PAGE)
    got = html.link_scores(html.html_links(html.html_nodes(pages), pages)).orderBy("node_id").collect()
    assert [r["score"] for r in got] == [s for *_, s in links] and [r["best"] for r in got] == [True] + [False] * 7


def test_page_controls(spark):
    page = lambda body: f"<html><body>{body}</body></html>"
    bodies = [
        '<a class="page-link">1</a>', '<a href="/99">99</a>', '<a rel="next" class="disabled">x</a>', '<a aria-label="Page 3">3</a><b data-page="0">0</b><i class="active" data-page="2">two</i>', "<p>1-20 of 45</p>",
        '<a><svg data-icon="chevron-right"></svg></a>', '<div class="Paginated"></div><p data-max-page="x"></p><p data-page-count="12"></p>', "",
    ]
    pages = spark.createDataFrame([(i, "https://x.co/", page(b)) for i, b in enumerate(bodies)], PAGE)
    got = {r["page_id"]: tuple(r)[1:] for r in html.pagination_controls(html.html_nodes(pages)).collect()}
    assert got == {
        0: ("1", 1, None, False, False, "numeric", True), 1: ("", None, None, False, False, "none", False), 2: ("", None, None, False, False, "none", False), 3: ("2,3", 3, 2, False, False, "numeric", True),
        4: ("", 3, None, False, False, "none", False), 5: ("", None, None, True, False, "next-prev", True), 6: ("", 12, None, False, False, "none", True), 7: ("", None, None, False, False, "none", False),
    }


def test_first_pages_again(spark):
    page = lambda n, items: [(1, n, k, a, b) for k, (a, b) in enumerate(items)]
    rows = [
        *page(1, [("a", "u1"), ("b", None), ("c", "u3")]), *page(2, [("x", "u1"), ("b", None), ("y", "u3")]), *page(3, [("a", "v1"), ("b", "v2"), ("c", "v3")]), *page(4, [("a", "v1"), ("z", "v2"), ("c", "v3")]),
        *page(5, [("a", "v1"), ("c", "v2")]), *page(6, [("q", "u1"), ("b", "b"), ("c", "u3")]), (2, 2, 0, "a", "u"),
    ]
    d = spark.createDataFrame(rows, "listing_id long, page_num long, position int, name string, profile_url string")
    got = {(r[0], r[1]): r[2] for r in page_fingerprint_check(d, pages=spark.createDataFrame([(1, 7), *{(r[0], r[1]) for r in rows}], "listing_id long, page_num long")).collect()}
    assert got == {(1, 1): "first", (1, 2): "duplicate_urls", (1, 3): "duplicate_names", (1, 4): "duplicate_boundaries", (1, 5): "unique", (1, 6): "duplicate_urls", (1, 7): "empty", (2, 2): "valid"}


def test_page_contacts(spark):
    card = lambda name: f'<div class="card"><h3>{name}</h3><a href="/people/{name}">more</a></div>'
    bodies = [card("Ann") + card("Bo"), '<a href="/people/1">a</a>' * 3, '<a href="/people/1">a</a>' * 2 + "<p>x@y.co x@y.co z@y.co</p>", '<a href="tel:1">c</a>', "<p>none</p>", '<a href="mailto:a@b.co">Ann</a><a href="tel:1">c</a>', None]
    pages = spark.createDataFrame([(i, "https://x.co/l", b) for i, b in enumerate(bodies)], PAGE)
    got = {r["page_id"]: (r["method"], r["contacts"], [tuple(f) for f in r["found"]]) for r in postclean.page_contacts(pages).collect()}
    assert {i: g[:2] for i, g in got.items()} == {0: ("none", 0), 1: ("profile-links", 3), 2: ("email-regex", 2), 3: ("tel-links", 1), 4: ("none", 0), 5: ("mailto-links", 1), 6: ("none", 0)}
    assert got[2][2] == [("x@y.co", None), ("z@y.co", None)] and got[5][2] == [("Ann", "mailto:a@b.co")]
    by_card = {r["page_id"]: (r["contacts"], [tuple(f) for f in r["found"]]) for r in postclean.page_contacts(pages, ".card").collect()}
    assert by_card[0] == (2, [("Ann", "https://x.co/people/Ann"), ("Bo", "https://x.co/people/Bo")]) and by_card[1] == (0, [])


def test_cards_after_an_unlike_sibling(spark):
    item = '<li class="c"><a href="/p">x</a><p>y</p></li>'
    odd = "<li><b></b><b></b><b></b><b></b><b></b><b></b><b></b><b></b></li>"
    found = cards.alike(f"<ul>{odd}{item * 4}</ul>", 65)
    assert [(n, like) for n, like, _ in found] == [(13, 10), (16, 10), (19, 10)] and {s for *_, s in found} == {100.0}
    assert cards.alike(None, 65) == cards.alike("", 65) == cards.alike("<ul><li>a</li><li>b</li></ul>", 65) == []
    many = "<ul>" + "".join(f'<li class="k{i}"><i></i>{"<a></a>" * (i % 37)}</li>' for i in range(3000)) + "</ul>"
    began = datetime.now()
    assert len(cards.alike(many, 65)) > 2900 and (datetime.now() - began).total_seconds() < 10


def test_field_messages(spark):
    cases = [("name", "a@b.co", "an address, not a name"), ("name", "J", None), ("name", "+1 (212) 555-1234", "a phone, not a name"), ("name", "a b c d e f g", "more than six words"), ("email", "a@b", "no valid address"), ("phone", "123456", "not 7 to 15 digits"), ("title", "x", None), ("profile_url", "ftp://x", "no valid URL"), ("profile_url", "/x y", None), ("location", "  ", "no value"), ("name", None, "no value")]
    got = spark.createDataFrame(cases, "f string, v string, m string").select("m", T.validate_field(C("f"), C("v")).alias("r")).collect()
    assert [(r["r"]["valid"], r["r"]["message"]) for r in got] == [(r["m"] is None, r["m"]) for r in got]


def test_merge_keeps_what_was_null(spark):
    c = rows_of(spark, [(1, None, None, "1", None, "", "u"), (2, "Ann LeePartner", "a@x.co", None, None, None, "u")])
    p = spark.createDataFrame([("u", "Ann Lee", "b@x.co", None, None, "Paris", ["Law"], [])], "profile_url string, name string, email string, phone string, title string, location string, education array<string>, bar_admissions array<string>")
    e = enrich.enrich(c, p)
    assert [(r["education"], r["bar_admissions"]) for r in e.collect()] == [(["Law"], [])] * 2
    m = {r["row_id"]: r for r in enrich.enrichment_metadata(e).collect()}
    assert m[1]["audit"] == {"name": None, "email": None} and m[1]["actions"]["location"] == "ENRICHED"  # an empty text was no null
    assert m[2]["audit"] == {"name": "Ann LeePartner", "email": "a@x.co", "location": None} and m[2]["flags"] == ["email_mismatch"]
    x = m[2]["details"]
    assert (x["email"]["old"], x["email"]["new"], x["email"]["source"]) == ("a@x.co", "b@x.co", "profile") and (x["title"]["new"], x["title"]["note"]) == ("Partner", "extracted from the name's end")


def test_names_without_marks_match(spark):
    c = rows_of(spark, [(1, "Pat O'Brien"), (2, "Jean-Luc Roy")])
    links = spark.createDataFrame([(1, "Pat OBrien"), (2, "jeanluc roy")], "position long, text string")
    assert {(r["row_id"], r["position"], r["score"]) for r in enrich.match_profiles_by_name(c, links).collect()} == {(1, 1, 1.0), (2, 2, 1.0)}


def test_reports_of_nothing(spark):
    none = rows_of(spark, []).limit(0)
    q = stats.extraction_quality(none).first()
    assert (q["band"], q["score"], q["issues"]) == ("none", 0, ["no contacts"])
    assert stats.data_quality(none, F.lit("low")).first()["confidence"] == "none"
    assert stats.contact_stats(none).first()["total"] == 0 and flow.contact_pipeline(none)["contacts"].count() == 0
    with pytest.raises(ValueError):
        flow.contact_pipeline(none, skip=("scrape",))


def test_run_over_contacts(spark):
    c = rows_of(spark, [(1, "Ann LeePartner", "a@x.co", None, None, "Paris", "u"), (2, "Ann", "a@x.co"), (3, "Bo", "b@y.co", "2125551234")])
    p = spark.createDataFrame([("u", "Ann Lee", None, "+1-212-555-9999", None, None)], "profile_url string, name string, email string, phone string, title string, location string")
    out = flow.contact_pipeline(c, p)
    assert set(out) == {"contacts", "stats", "enrichment", "post_clean_stats", "cleaning"}
    got = {r["row_id"]: r for r in out["contacts"].collect()}
    assert set(got) == {1, 3} and (got[1]["name"], got[1]["phone"], got[1]["title"]) == ("Ann Lee", "+1-212-555-9999", "Partner")
    assert out["stats"].first()["duplicates_removed"] == 1
    assert flow.contact_pipeline(c, p, skip=("dedup", "enrich", "post_clean", "clean"))["contacts"].collect() == c.collect()


def test_replayed_batches_give_the_batch_rules(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    want = dedup.dedup_fuzzy(source_queries.contacts(spark, sf))
    got = source_queries.fuzzy_streamed(spark, sf)  # three runs, each from the checkpoint of the one before
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.where("duplicate").count() > 5


def test_rebased_patterns(spark):
    cache = spark.createDataFrame([("x.co", "pg", "https://x.co/old", 1, 95), ("x.co", "page", "https://x.co/l", 2, 90), ("x.co", "no", "https://x.co/", 3, 69)], "domain string, name string, base_url string, cached_at long, confidence int")
    pages = spark.createDataFrame([(1, "https://www.x.co/new?page=4&q=a+b&page=5", ""), (2, "https://x.co/l?page=2", ""), (3, "https://q.co/", "")], PAGE)
    assert {r["page_id"]: (r["base_url"], r["changed"]) for r in listing.rebased_pattern(cache, pages).collect()} == {1: ("https://www.x.co/new?q=a+b", True), 2: ("https://x.co/l", False)}
