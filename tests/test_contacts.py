"""Golden cases and small tables for the contact operators."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from cardloom.functions import cleaning as K
from cardloom.functions import text as T
from cardloom.functions import urls as U
from cardloom.operators import cards, dedup, enrich, html, listing, postclean, profiles, stats, trees
from cardloom.plans import registry
from cardloom.plans.contacts import contacts
from cardloom.sources import contacts as io
from cardloom.streaming import jobs

C = F.col


def one(spark, expr, **values):
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return d.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name,clean,title",
    [("Arthur S. AdlerPartner", "Arthur S. Adler", "Partner"), ("John Smith Senior Partner", "John Smith", "Senior Partner"), ("Jane DoeOf Counsel", "Jane Doe", "Of Counsel"), ("Ann Lee", "Ann Lee", None)],
)
def test_split_name_title(spark, name, clean, title):
    x = one(spark, K.split_name_title(C("n")), n=name)
    assert (x["name"], x["title"], x["contaminated"]) == (clean, title, title is not None)


def test_profile_title_wins(spark):
    assert one(spark, K.split_name_title(C("n"), C("p")), n="Robert Brown", p="Managing Partner")["title"] == "Managing Partner"
    x = one(spark, K.extract_title(C("p"), T.no_text(), C("n"), T.no_text()), p="Partner", n="John Smith")
    assert (x["title"], x["source"], x["confidence"]) == ("Partner", "profile-html", "high")


@pytest.mark.parametrize("raw,clean,several", [("New York\n +1-212-558-3960", "New York", False), ("New York\nFrankfurt", "New York", True), ("New York, 125 Broad Street", "New York, 125 Broad Street", False)])
def test_clean_location(spark, raw, clean, several):
    x = one(spark, K.clean_location_profile(C("v")), v=raw)
    assert (x["location"], x["several"]) == (clean, several)


@pytest.mark.parametrize("raw,clean", [("New York\n   +1-212-558-3960", "New York"), ("Washington, D.C.", "Washington, D.C."), ("St. Louis", "St. Louis"), ("Austin, TX", "Austin, TX"), (None, None)])
def test_normalize_location(spark, raw, clean):
    assert one(spark, K.normalize_location(C("v")), v=raw)["location"] == clean


def test_small_text_rules(spark):
    assert one(spark, T.match_key(C("v")), v="(555) 123-4567") == "555 123-4567"
    assert one(spark, T.string_similarity(C("a"), C("b")), a="john doe", b="john d") == 0.75
    assert one(spark, T.name_from_email(C("v")), v="michaelsmith@x.com") == "Michael Smith"
    assert one(spark, T.name_from_email(C("v")), v="a.b_cd@x.com") == "A. B. Cd"
    assert one(spark, T.name_from_email(C("v")), v="info@x.com") is None
    assert one(spark, T.clean_email(C("v")), v="mailto:<A@B.co>?x=1") == "a@b.co"
    assert one(spark, K.detect_noise(F.lit("email"), C("v"), T.no_text(), T.no_text()), v="Email: john@example.com")["clean"] == "john@example.com"
    x = one(spark, K.clean_name(C("v")), v="Ann Lee 212-555-1234 a@b.co PartnerPartner, JD")
    assert x["value"] == "Ann Lee PartnerPartner" and x["modified"]  # titles go before credentials, so the credential shields them
    assert one(spark, K.clean_name(C("v")), v="View Profile")["value"] is None


@pytest.mark.parametrize("url,kind,name", [("https://a.b/c?pageId=1492&pageSize=48&pagingNumber=2", "parameter", "pagingNumber"), ("https://a.b/c?pageId=1492", None, None), ("https://a.b/c?PAGE=1", "parameter", "PAGE"), ("no address", None, None), (None, None, None)])
def test_page_param(spark, url, kind, name):
    x = one(spark, U.page_param(C("u")), u=url)
    assert (x and x["type"], x and x["name"]) == (kind, name)


def test_compare_urls(spark):
    f = lambda a, b: one(spark, U.compare_urls(C("a"), C("b")), a=a, b=b)
    assert f("https://a.b/?page=2", "https://a.b/?page=3")["type"] == "parameter"
    assert f("https://a.b/?from=0", "https://a.b/?from=20")["size"] == 20
    assert f("https://a.b/list/2", "https://a.b/list/3")["type"] == "path"
    assert f("https://a.b/x", "https://a.b/y") is None


CONTACT = "row_id long, name string, email string, phone string, title string, location string, profile_url string"


def table(spark, rows):
    return spark.createDataFrame([tuple(r) + (None,) * (7 - len(r)) for r in rows], CONTACT)


def test_dedup_scrape_is_the_sequential_rule(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["A", "B", "", None]), r.choice(["x@a.co", "X@a.co", "y@a.co", None, ""]), None, None, None, r.choice(["u", "v", None])) for i in range(300)]
    mails, pairs, want = set(), set(), []
    for i, n, e, _, _, _, u in rows:
        if e:
            if e.lower() in mails:
                continue
            mails.add(e.lower())
            if n and u:
                pairs.add((n, u))
        elif n and u:
            if (n, u) in pairs:
                continue
            pairs.add((n, u))
        want.append(i)
    assert sorted(x["row_id"] for x in dedup.dedup_scrape(table(spark, rows)).collect()) == want


def similar(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def sequential(rows):
    """D3 as it is worded: rows in order, each against the unique ones before it."""
    primary, secondary, out = {}, {}, []
    for c in rows:
        found = None
        for k in ("email", "profile_url"):
            if not found and c[k] and (k, c[k]) in primary:
                found = (primary[k, c[k]], "primary", k)
        for k in ("name", "phone"):
            o = secondary.get((k, c[k])) if c[k] and not found else None
            if o and sum(1 if c[f] == o[f] else 0.5 * (similar(c[f], o[f]) >= 0.85) for f in dedup.TEXTS[:5] if c[f] and o[f]) >= 2:
                found = (o["row_id"], "secondary", k)
        if not found:
            primary |= {(k, c[k]): c["row_id"] for k in ("email", "profile_url") if c[k]}
            secondary |= {(k, c[k]): c for k in ("name", "phone") if c[k]}
        out.append((c["row_id"], bool(found), *(found or (None, None, None))))
    return out


@pytest.mark.parametrize("seed,piece", [(2, 1_000_000), (3, 7), (4, 7)])
def test_dedup_fuzzy_is_the_sequential_rule(spark, tmp_path, monkeypatch, seed, piece):
    monkeypatch.setattr(dedup, "PIECE", piece)
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = random.Random(seed)
    names, mails, phones = ["john doe", "john d", "jane roe", "jane rowe", None], ["a@x.co", "A@x.co", "b@x.co", *(f"m{i}@x.co" for i in range(6)), None, None], ["1", "2", None]
    rows = [(i, r.choice(names), r.choice(mails), r.choice(phones), r.choice(["p", None]), r.choice(["ny", "la"]), r.choice(["u1", "u2", None, None, None])) for i in range(90)]
    keys = table(spark, rows).select("row_id", *(T.match_key(C(c)).alias(c) for c in dedup.TEXTS)).collect()
    want = sequential([x.asDict() for x in sorted(keys)])
    assert sorted(tuple(x) for x in dedup.dedup_fuzzy(table(spark, rows)).collect()) == want
    assert any(x[1] for x in want) and dedup.dedup_fuzzy(table(spark, rows).limit(0)).count() == 0


def test_dedup_fuzzy_takes_no_more_rounds_than_pieces(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rounds, write = [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda *a: rounds.append(1) or write(*a))
    # Each row agrees with the one before it alone, so every verdict hangs on all before it.
    words = ["".join(chr(97 + (i * 7 + k * 5 * i) % 26) for k in range(4)) + str(i) * 3 for i in range(40)]
    rows = [(i, "john doe", None, None, words[(i + 1) // 2], words[i // 2], None) for i in range(60)]
    for piece, most in ((1000, 3), (20, 6)):
        monkeypatch.setattr(dedup, "PIECE", piece)
        rounds.clear()
        got = sorted((r["row_id"], r["duplicate"], r["original"]) for r in dedup.dedup_fuzzy(table(spark, rows)).collect())
        assert got == [(i, i % 2 == 1, i - 1 if i % 2 else None) for i in range(60)] and len(rounds) <= most


@pytest.mark.parametrize("seed", range(3))
def test_near_is_the_similarity(seed):
    r = random.Random(seed)
    for _ in range(3000):
        a = "".join(r.choice("abc1") for _ in range(r.randint(1, 24)))
        b = list(a)
        for _ in range(r.randint(0, 5)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 1)] = r.choice(["", "a", "x"])
        b = "".join(b) or "x"
        d = round((1 - similar(a, b)) * max(len(a), len(b)))
        assert dedup.near(a, b) == ((max(len(a), len(b)) - d) / max(len(a), len(b)) >= 0.85)


def test_customers_are_dealt_out(spark):
    d = contacts(spark, "/root/testdata/sf0.01")
    assert d.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and d.select("row_id").distinct().count() == d.count() == 1650


def test_max_page_beyond_its_bound(spark, tmp_path):
    spark.createDataFrame([(i, "", "") for i in (0, 99_990, 99_991, 149_999)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["max_page"] for r in registry.queries()["h29_max_page"](spark, str(tmp_path)).collect()}
    assert got == {0: None, 99_990: 9999, 99_991: 10_000, 149_999: 15_000}
    said = spark.sql("select 'page 1 of 10000' as t").select(html.max_page_from_text(F.col("t")).alias("a"), html.max_page_from_text(F.col("t"), None).alias("b")).first()
    assert tuple(said) == (None, 10_000)


def test_links_and_controls_parse_pages_once(spark):
    pages = spark.createDataFrame([(1, "https://x.co/a", "<img><a href='/b'><img><img>b</a><a href=' '>no</a><p><img></p><a class='next' href='/c'>c</a><p>Page 1 of 7</p>"), (2, "https://x.co/", "")], "page_id long, url string, html string")
    links = html.html_links(html.html_nodes(pages), pages)
    assert sorted((r["url"], r["text"], r["has_img"]) for r in links.collect()) == [("https://x.co/b", "b", True), ("https://x.co/c", "c", False)]
    controls = html.pagination_controls(html.html_nodes(pages))
    assert [(r["page_id"], r["max_page"]) for r in controls.collect()] == [(1, 7)]
    for d in (links, controls):
        assert d._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def planned(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_profile_values_are_worked_out_once(spark):
    t = trees.page_trees(spark.createDataFrame([(1, "https://x.co/a", "")], "page_id long, url string, html string"))
    fields = t.select(profiles.profile_phone(C("nodes")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert fields.count("Phone|Tel|Telephone") == 1


def test_profile_title_below_a_heading_takes_one_pass(spark):
    page = "<h1>Ann Lee</h1>" + "<p>Read on</p>" * 4000 + "<p>Senior Counsel</p><h1>Other</h1><p>Partner</p>"
    t = trees.page_trees(spark.createDataFrame([(1, "https://x.co/a", page), (2, "https://x.co/b", "<h1>A</h1><p>x y z</p><h1>B</h1><p>Partner</p>")], "page_id long, url string, html string"))
    began = time.time()
    assert [r[0] for r in t.orderBy("page_id").select(profiles.profile_title(C("nodes"))).collect()] == ["Senior Counsel", None]
    assert time.time() - began < 20


def test_label_is_looked_for_once(spark):
    t = trees.page_trees(spark.createDataFrame([(1, "u", "<b>Phone:</b><i>212-555-1234</i>"), (2, "u", "<p>Tel: 212-555-9999</p>"), (3, "u", "")], "page_id long, url string, html string"))
    d = profiles.label_values(t, "phone").select("page_id", "phone")
    assert {r[0]: r[1] for r in d.collect()} == {1: "212-555-1234", 2: "212-555-9999", 3: None}
    assert d._jdf.queryExecution().analyzed().toString().count("^(phone|telephone") == 1


def test_microdata_finds_its_box_once(spark):
    t = trees.page_trees(spark.createDataFrame([(1, "u", "<b itemprop='name'>No</b><div itemtype='https://schema.org/Person'><b itemprop='name'>Ann</b><i itemprop='jobTitle'>Chair</i></div><b itemprop='email'>no</b>")], "page_id long, url string, html string"))
    d = profiles.structured_person(t)
    assert tuple(d.first())[1:] == ("Ann", None, None, "Chair", None, None, "microdata")
    assert d._jdf.queryExecution().analyzed().toString().count("itemtype") == 1


def test_named_links_and_repeated_cards_parse_pages_once(spark):
    pages = spark.createDataFrame([(1, "https://x.co/", "<div class='card'><h2>Out</h2><div class='person'><i class='name'>In</i><p><a href='/people/a'>View</a></p></div></div><div class='card'><a href='/people/b'>View</a></div><a href='/people/c'>View</a>"), (2, "https://x.co/", "<h2>T</h2>")], "page_id long, url string, html string")
    nodes = html.html_nodes(pages)
    links = html.profile_links(html.html_links(nodes, pages), nodes)
    assert {r["url"][-1]: r["text"] for r in links.collect()} == {"a": "In", "b": "View", "c": "View"}
    assert planned(links).count("MapInArrow") == 2  # links, then cards and headings
    alike = registry.queries()["h31_cards_after_another"](spark, "/root/testdata/sf0.001")
    assert planned(alike).count("MapInArrow") == 1


def test_post_clean_works_values_out_once(spark):
    c = table(spark, [(1, "Ann Lee", "ann@x.co", "+1-212-555-1234", None, "London\n+44 20 7946 0018\nNew York, NY\n+1-212-555-1234", None), (2, "Bob", None, "+49 69 123456", None, "Boston, MA", None), (3, None, None, None, None, None, None)])
    d = postclean.post_clean(c)
    got = d.orderBy("row_id").select("location", "score", "overall", "phone_reason", "other_locations").collect()
    assert [tuple(r) for r in got] == [("New York, NY", 100, "high", None, ["London"]), ("Boston, MA", 70, "medium", None, []), (None, 15, "low", "missing-data", [])]
    plan = planned(d)
    assert plan.count("aggregate(") == 1 and plan.count(r"^\+?1(\d{3})") == 1 and plan.count("regexp_extract_all(") == 1  # the places, the area code, the runs of digits
    assert planned(postclean.post_clean_stats(d)).count("aggregate(") == 1


def test_cleaning_works_values_out_once(spark):
    c = table(spark, [(1, "Ann Lee, JDPartner 212-555-1234", "x Ann@X.co", "call 212-555-1234", None, "Paris ann@x.co", None), (2, "Bob Ray", "none", "+1-212-555-1234", "", "Rome", None), (3, None, None, None, None, None, None)])
    cleaned = c.select("row_id", K.clean_name(C("name")).alias("clean_name"), K.extract_email(C("email")).alias("clean_email"), K.extract_phone(C("phone")).alias("clean_phone"), *(K.clean_plain(C(x)).alias(f"clean_{x}") for x in ("title", "location")))
    report, summary = stats.cleaning_report(cleaned), stats.cleaning_summary(cleaned)
    assert {r["field"]: (r["total"], r["extracted"], r["nullified"], r["modified"]) for r in report.collect()} == {"name": (3, 0, 0, 1), "email": (3, 1, 1, 2), "phone": (3, 1, 0, 1), "title": (3, 0, 0, 0), "location": (3, 0, 0, 1)}
    assert summary.first().asDict() == {"contacts": 3, "contacts_modified": 1, "contacts_unchanged": 2, "fields_modified": 5}
    name = c.select(K.clean_name(C("name")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert name.count("regexp_extract_all(") == 4  # phones, addresses, titles, credentials
    assert planned(summary).count("LogicalRDD") == 1  # one pass, and no row a field


def test_compared_urls_are_parsed_once(spark):
    rows = [("https://x.co/l?a=7&page=2", "https://x.co/l?a=7&page=3"), ("https://x.co/l?start=0", "https://x.co/l?start=20"), ("https://x.co/l/8", "https://x.co/l/9"), ("https://x.co/l?x=1", "https://x.co/l?x=5"), (None, "https://x.co/l?page=1"), ("https://x.co/l", None)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").select("i", U.compare_urls(C("a"), C("b")).alias("s"))
    assert [r["s"] and tuple(r["s"]) for r in d.orderBy("i").collect()] == [("parameter", "page", None), ("offset", "start", 20), ("path", None, None), None, None, None]
    assert d._jdf.queryExecution().analyzed().toString().count("QUERY") == 2  # one a side


def test_name_near_email_works_values_out_once(spark):
    rows = [(1, "Kind Regards\nAnn Lee\nOther Person\nMail ann.lee@x.co", "ann.lee@x.co"), (2, "ann.lee@x.co first", "ann.lee@x.co"), (3, None, "a@x.co"), (4, "Ann Lee", "zed@x.co")]
    d = spark.createDataFrame(rows, "i int, text string, email string").select("i", T.name_near_email(C("text"), C("email")).alias("b"))
    assert [r["b"] and tuple(r["b"]) for r in d.orderBy("i").collect()] == [("Ann Lee", 50 - (7 + 1 + 12 + 1 + 5) / 2 + 40 + 10), None, None, None]
    said = d._jdf.queryExecution().analyzed().toString()
    assert said.count("instr(lower(") == 1 and said.count("[._-]+") == 1


def test_row_ids_of_a_stream_do_not_go_through_the_driver(spark, tmp_path):
    rows = table(spark, [(i, f"Ann {i}", f"a{i}@x.co", None, None, None, None) for i in range(50)])
    rows.write.parquet(f"{tmp_path}/rows")
    rows.select("row_id").where("row_id % 2 = 0").write.parquet(f"{tmp_path}/ids")
    stored, ids = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("rows", "ids"))
    held = dedup.holders(stored, stored.where("row_id < 10"), small=0)
    for d, want in ((dedup.of_rows(stored, ids), list(range(0, 50, 2))), (held, list(range(10)))):
        assert sorted(r["row_id"] for r in d.collect()) == want
    assert "Broadcast" not in dedup.of_rows(stored, ids)._jdf.queryExecution().executedPlan().toString()


def test_nodes_of_small_pages_share_batches(spark):
    pages = spark.range(3000).select(C("id").alias("page_id"), F.when(C("id") % 7 > 0, F.lit("<p>a<b>x</b></p>")).alias("html")).coalesce(1)
    got = html.html_nodes(pages).groupBy("page_id").agg(F.count("*").alias("n"), F.max("last_id").alias("last")).collect()
    assert sorted(map(tuple, got)) == [(i, 2, 1) for i in range(3000) if i % 7]


def test_merge_rules(spark):
    c = table(spark, [(1, "Ann Lee", None, "+1-212-555-1234", None, "NY", "u1"), (2, "Bob RayPartner", "wrong@x.co", None, None, "Paris", "u2"), (3, "Cy", None, None, None, None, "u3"), (4, "Di", None, None, None, None, None)])
    p = spark.createDataFrame([("u1", "Ann Lee", "ann@x.co", "(212) 555-1234", None, "NY, New York"), ("u2", "Bob Ray", "bob@x.co", None, None, "London"), (None, "Zed", None, None, None, None)], "profile_url string, name string, email string, phone string, title string, location string")
    got = {(x["row_id"], x["field"]): (x["value"], x["action"], x["confidence"]) for x in enrich.actions_long(enrich.enrich(c, p)).collect()}
    assert got[1, "email"] == ("ann@x.co", "ENRICHED", "high")
    assert got[1, "phone"] == ("+1-212-555-1234", "VALIDATED", "high")
    assert got[1, "location"] == ("NY, New York", "ENRICHED", "medium")
    assert got[2, "name"] == ("Bob Ray", "CLEANED", "high")
    assert got[2, "title"][0] == "Partner"
    assert got[2, "email"] == ("bob@x.co", "REPLACED", "low")
    assert got[3, "name"] == ("Cy", "UNCHANGED", "medium") and got[4, "email"] == (None, "UNCHANGED", None)
    m = {x["row_id"]: x for x in enrich.enrichment_metadata(enrich.enrich(c, p)).collect()}
    assert m[2]["needs_review"] and "email_mismatch" in m[2]["flags"] and m[2]["audit"]["email"] == "wrong@x.co"
    f = {x["row_id"]: x for x in enrich.fallback_clean(enrich.enrich(c, p)).collect()}
    assert f[4]["reason"] == "no_profile_url" and f[3]["reason"] is None


PAGE = """<html><body><script>var a='no@no.co'</script><div class="card"><h2 class="name">Dr. Ann Lee</h2><a class="email" href="mailto:Ann@x.co?subject=a">Ann@x.co</a>
<a href="tel:+1-212-555-1234">call</a><p>bob [at] x [dot] co</p><a href="/people/ann-lee"><img src="a.png">Ann Lee</a><a href="https://linkedin.com/in/annlee">in</a></div>
<nav><a class="page-link" href="?page=1">1</a><a class="page-link" href="?page=2">2</a><a rel="next" href="?page=2">next</a></nav><br></body></html>"""


def test_pages_to_contacts(spark):
    pages = spark.createDataFrame([(1, "https://x.co/list?page=1", PAGE), (2, "https://x.co/", None), (3, "https://x.co/e", "")], "page_id long, url string, html string")
    nodes = html.html_nodes(pages)
    links = html.html_links(nodes, pages)
    whole = cards.whole_pages(trees.page_trees(pages))
    assert {x["value"]: x["source"] for x in cards.email_candidates(whole).collect()} == {"ann@x.co": "mailto", "bob@x.co": "obfuscated"}  # a link's text is not a call to write
    assert [x["source"] for x in cards.phone_candidates(whole).collect()] == ["tel"]
    got = {x["page_id"]: x for x in cards.contacts_from_cards(whole).collect()}
    assert (got[1]["name"], got[1]["email"], got[1]["phone"], got[1]["profile_url"]) == ("Ann Lee", "ann@x.co", "+1-212-555-1234", "https://x.co/people/ann-lee") and got[2]["email"] is None
    assert [x["url"] for x in html.profile_links(links).collect()] == ["https://x.co/people/ann-lee"]
    assert [(x["platform"], x["username"]) for x in html.social_links(links).collect()] == [("linkedin", "annlee")]
    best = html.link_scores(links).orderBy(F.desc("score"), "node_id").first()
    assert best["url"] == "https://x.co/people/ann-lee"
    p = html.pagination_controls(nodes).first()
    assert (p["numbers"], p["max_page"], p["has_next"], p["kind"]) == ("1,2", 2, True, "numeric")


PROFILE = """<html><head><script type="application/ld+json">{"@type": "Person", "name": "Ann Lee", "worksFor": {"name": "X"}}</script></head><body><div class="profile-header"><h1>Ann Lee</h1><p>Read on</p>
<p>Senior Counsel</p></div><a href="mailto:info@x.co">desk</a><p>all@x.co, ann.lee@x.co</p><p>Tel: (212) 555-1234</p><div><h3>Education</h3><ul><li>A</li><li>B</li></ul></div><span class="office">Paris</span></body></html>"""


def test_profile_pages(spark):
    pages = spark.createDataFrame([(1, "https://www.x.co/people/ann-lee", PROFILE), (2, None, None), (3, "https://x.co/", "no tags"), (4, "https://x.co/", '<script type="application/ld+json">{broken</script><p>Email: Bo@x.co</p>')], "page_id long, url string, html string")
    t = trees.page_trees(pages)
    got = {x["page_id"]: x for x in profiles.profile_fields(t).collect()}
    assert tuple(got[1])[2:] == ("Ann Lee", "ann.lee@x.co", "+1-212-555-1234", "Senior Counsel", "Paris")
    assert tuple(got[2])[1:] == (None,) * 6 and got[4]["email"] == "bo@x.co"
    lists = {x["page_id"]: x for x in profiles.profile_lists(t).collect()}
    assert lists[1]["education"] == ["A", "B"] and lists[2]["bio"] is None
    person = {x["page_id"]: x for x in profiles.structured_person(t).collect()}
    assert (person[1]["name"], person[1]["works_for"], person[1]["source"]) == ("Ann Lee", "X", "json-ld") and person[4]["source"] is None


def test_name_near_email(spark):
    f = lambda t, e: one(spark, T.name_near_email(C("t"), C("e")), t=t, e=e)
    assert f("Bob Stone\nAnn Lee\nann.lee@x.co", "ann.lee@x.co")["name"] == "Ann Lee"
    assert f("ann.lee@x.co", "ann.lee@x.co") is None and f(None, "a@x.co") is None


def test_listing(spark):
    rows = [(1, n, v) for n, v in ((1, True), (2, True), (3, False), (4, True), (5, False), (6, False), (7, True))] + [(2, 1, False)]
    got = {x["listing_id"]: (x["last_page"], x["confirmed"]) for x in listing.page_boundary(spark.createDataFrame(rows, "listing_id long, page_num long, valid boolean")).collect()}
    assert got == {1: (4, True), 2: (0, True)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"contacts": [{"name": "Ann", "email": "", "profileUrl": "u"}, {"name": "Bob"}]}')
    (tmp_path / "b.json").write_text('[{"name": "Cy", "phone": "1"}]')
    a = io.read_contacts(spark, str(tmp_path / "a.json")).collect()
    assert [(x["name"], x["email"], x["profile_url"]) for x in sorted(a)] == [("Ann", None, "u"), ("Bob", None, None)]
    assert [x["phone"] for x in io.read_contacts(spark, str(tmp_path / "b.json")).collect()] == ["1"]
    every = io.read_contacts(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], "json").collect()
    assert sorted((x["row_id"], x["name"]) for x in every) == [(0, "Ann"), (1, "Bob"), (1 << 33, "Cy")]
    d = io.read_contacts(spark, str(tmp_path / "a.json"))
    assert io.write_contacts(d, str(tmp_path / "out"), "test").first()["total"] == 2
    assert io.export_view(d).columns == ["Name", "Profile URL"]
    io.append_export(io.export_view(d), str(tmp_path / "csv"))
    io.append_export(io.export_view(d), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv")).count() == 4
    pages = spark.createDataFrame([(1, "https://www.x.co/a", ""), (2, "https://y.co/", "")], "page_id long, url string, html string")
    conf = spark.createDataFrame([("x.co", {"card": ".c", "kind": None})], "domain string, settings map<string,string>")
    got = {x["page_id"]: x["settings"] for x in io.resolve_site_config(pages, conf, {"card": ".d", "kind": "k", "wait": "1"}).collect()}
    assert got == {1: {"card": ".c", "kind": None, "wait": "1"}, 2: {"card": ".d", "kind": "k", "wait": "1"}}


def test_streams(spark, tmp_path):
    rows = [(1, "Ann", "a@x.co"), (2, "Ann", "A@x.co"), (3, "Bob", None), (4, "Bob", None), (5, "AnnPartner", "b@x.co")]
    table(spark, rows).repartition(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(CONTACT).parquet(str(tmp_path / "in"))
    for k, (job, mode) in enumerate(((jobs.stream_dedup(source()), "append"), (jobs.stream_fuzzy_dedup(source()), "append"), (jobs.stream_stats(source()), "complete"))):
        q = job.writeStream.format("memory").queryName(f"out{k}").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c{k}")).start()
        q.awaitTermination()
    assert spark.table("out0").count() == 3
    assert sorted(tuple(x) for x in spark.table("out1").collect()) == [(1, False, None, None, None), (2, True, 1, "primary", "email"), *((i, False, None, None, None) for i in (3, 4, 5))]
    near = [(1, "Ann Lee", "a@x.co", "1", None, "Paris"), (2, "ann lee", "b@x.co", "2", None, "Rome"), (3, "ANN LEE", "b@x.co", None, None, None), (4, None, None, None, None, None)]
    table(spark, near).repartition(1).write.parquet(str(tmp_path / "near"))
    q = jobs.stream_fuzzy_dedup(spark.readStream.schema(CONTACT).parquet(str(tmp_path / "near")), "name").writeStream.format("memory").queryName("names").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cn")).start()
    q.awaitTermination()
    assert {x["row_id"]: (x["original"], x["match_type"]) for x in spark.table("names").where("duplicate").collect()} == {3: (2, "secondary")} and spark.table("names").count() == 4
    assert sum(x["contacts"] for x in spark.table("out2").collect()) == 5
    jobs.stream_clean_append(source(), str(tmp_path / "clean"), str(tmp_path / "cc")).awaitTermination()
    assert "AnnPartner" not in {x["name"] for x in spark.read.parquet(str(tmp_path / "clean")).collect()}


def test_match_by_name_is_brute_force(spark):
    r = random.Random(3)
    word = lambda: r.choice(["ann", "bob", "cy", "di", "ed", "flo", "gus"])
    cs = [(i, " ".join(word() for _ in range(r.randint(1, 5)))) for i in range(40)]
    ls = [(i, " ".join(word() for _ in range(r.randint(1, 5)))) for i in range(40)]
    want = {}
    for (i, a), (j, b) in itertools.product(cs, ls):
        x, y = set(a.split()), set(b.split())
        s = len(x & y) / len(x | y)
        if s >= 0.8 and (i not in want or (-s, j) < want[i]):
            want[i] = (-s, j)
    links = spark.createDataFrame([(j, b) for j, b in ls], "position long, text string")
    got = {x["row_id"]: x["position"] for x in enrich.match_profiles_by_name(table(spark, cs), links).collect()}
    assert got == {i: j for i, (_, j) in want.items()}
