"""Contacts of listing cards and smart fields, as expressions over the nodes inside a card.

Null or empty pages have no cards; cards without a field have null there; ties go to the first in document order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.text import any_of, digits, first_match, let, matches, presence_confidence, present
from .html import SOCIAL, absolute, parse
from .labels import LABELS, label_value
from .trees import attr, class_part, distinct_by_value, first, has_class, holds, href, in_order, is_link, joined_url, page_text, texts, within

HEADINGS = ("h1", "h2", "h3", "h4", "h5")


def bare(c: Column, scheme: str) -> Column:
    """A link without its scheme and query."""
    return F.trim(F.split(F.regexp_replace(c, f"(?i){scheme}:", ""), r"\?")[0])


def listing_cards(cards: DataFrame) -> DataFrame:
    """page_id, card_index, name, profile_url, email, phone, title, location of each card."""
    n = F.col("nodes")
    link = first(n, lambda x: is_link(x) & ~href(x).rlike("^(mailto:|tel:|#)") & ~href(x).endswith(".vcf") & (href(x) != ""))
    to = href(link)
    url = F.when(to.startswith("/"), F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), to)).when(to.startswith("http"), to)
    mail = first(n, lambda x: is_link(x) & href(x).startswith("mailto:"))
    tel = first(n, lambda x: is_link(x) & href(x).startswith("tel:"))
    email = F.when(mail.isNotNull(), bare(href(mail), "mailto")).otherwise(first_match(F.col("text"), V.EMAIL))
    phone = F.when(tel.isNotNull(), F.regexp_replace(href(tel), "^tel:", "")).otherwise(first_match(F.col("text"), V.LISTING_PHONE))
    text_of = lambda test: present(first(n, test)["text"])
    return cards.select(
        "page_id", "card_index", text_of(lambda x: x["tag"].isin(*HEADINGS) | class_part(x, "name")).alias("name"), url.alias("profile_url"), present(email).alias("email"), present(phone).alias("phone"),
        text_of(lambda x: class_part(x, "title", "position")).alias("title"), text_of(lambda x: class_part(x, "location", "office")).alias("location"),
    )


def best_profile_link(nodes: Column, url: Column) -> Column:
    """H6: struct(url, text, score) of the link that looks most like a profile's, or null: 1 for a known part of the address (2 if it
    ends in it), 0.5 for an image inside, 0.5 for a class that names persons, 0.3 for a text of 3 to 49 characters."""
    def best(images: Column) -> Column:
        links = F.filter(nodes, lambda x: is_link(x) & (href(x) != "") & ~href(x).rlike("^(mailto|tel):"))
        found = F.transform(links, lambda x: F.struct(x["n"].alias("n"), absolute(href(x), url).alias("to"), x["text"].alias("text"), x["cls"].alias("cls"), F.exists(images, lambda i: (i > x["n"]) & (i <= x["last"])).alias("image")))
        scored = F.filter(F.transform(found, lambda s: F.struct((-score(s)).alias("minus"), s["n"].alias("n"), s["to"].alias("url"), F.substring(s["text"], 1, 100).alias("text"))), lambda s: s["minus"].isNotNull())
        return F.array_min(scored)

    def score(s: Column) -> Column:
        part = let(F.lower(s["to"]), lambda low: F.coalesce(*(F.when(low.contains(p.lower()), F.when(s["to"].contains(p + "/") | s["to"].endswith(p), 2.0).otherwise(1.0)) for p in V.PROFILE_PARTS)))
        extra = F.when(s["image"], 0.5).otherwise(0.0) + F.when(s["cls"].rlike("(?i)name|person|attorney|lawyer|agent"), 0.5).otherwise(0.0)
        return part + extra + F.when(F.length(s["text"]).between(3, 49), 0.3).otherwise(0.0)

    images = F.transform(F.filter(nodes, lambda d: d["tag"] == "img"), lambda d: d["n"])
    return let(let(images, best), lambda m: F.when(m.isNotNull(), F.struct(m["url"].alias("url"), m["text"].alias("text"), F.round(-m["minus"], 1).alias("score"))))


def found_as(values: Column, source: str) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias("v"), F.lit(source).alias("source")))


def card_emails(nodes: Column, text: Column, url: Column) -> Column:
    """array<struct<v, source>>: addresses of a card by seven sources in order, lower-cased; the first source keeps an address."""
    links = F.filter(nodes, is_link)
    called = F.filter(links, lambda x: F.lower(x["text"]).isin(V.MAIL_LINKS))
    mailed = lambda x: F.lower(href(x)).contains("mailto:")
    by_name = F.transform(called, lambda x: F.when(mailed(x), F.struct(F.lower(bare(href(x), "mailto")).alias("v"), F.lit("email-link-text").alias("source"))).otherwise(F.struct(F.lower(first_match(href(x), V.EMAIL)).alias("v"), F.lit("email-link-href").alias("source"))))
    lower = lambda c: F.transform(c, lambda v: F.lower(v))
    spelled = F.zip_with(F.zip_with(matches(text, V.SPELLED_MAIL, 1), matches(text, V.SPELLED_MAIL, 2), lambda a, b: F.concat(a, F.lit("@"), b)), matches(text, V.SPELLED_MAIL, 3), lambda a, b: F.concat(a, F.lit("."), b))
    given = F.filter(F.transform(nodes, lambda x: F.lower(F.trim(F.coalesce(present(attr(x, "data-email")), attr(x, "data-mail"))))), lambda v: v.rlike(V.EMAIL))
    every = F.concat(
        F.filter(by_name, lambda x: x["v"].contains("@")), found_as(F.transform(F.filter(links, lambda x: href(x).startswith("mailto:")), lambda x: F.lower(bare(href(x), "mailto"))), "mailto"),
        found_as(lower(matches(text, V.EMAIL)), "text"), found_as(given, "data-attr"), found_as(lower(spelled), "obfuscated"),
        found_as(lower(F.flatten(F.transform(links, lambda x: matches(F.coalesce(F.try_url_decode(absolute(href(x), url)), F.lit("")), V.EMAIL)))), "encoded-href"),
    )
    return distinct_by_value(F.filter(every, lambda x: present(x["v"]).isNotNull()))


def card_phones(nodes: Column, text: Column) -> Column:
    """array<struct<v, source, shown>>: phones of a card by four sources in order; v is their digits, ten at least."""
    tel = F.transform(F.filter(nodes, lambda x: is_link(x) & href(x).startswith("tel:")), lambda x: F.trim(F.regexp_replace(href(x), "^tel:", "")))
    said = F.flatten(F.array(*(matches(text, p) for p in V.CARD_PHONES)))
    given = F.filter(F.transform(nodes, lambda x: F.trim(F.coalesce(present(attr(x, "data-phone")), present(attr(x, "data-tel")), attr(x, "data-telephone")))), lambda v: v.isNotNull())
    hinted = F.filter(texts(nodes, lambda x: has_class(x, "telephone") | class_part(x, "phone", "tel-")), lambda t: F.length(digits(t)) <= 11)
    shown = lambda c, source: F.transform(c, lambda p: F.struct(digits(p).alias("v"), F.lit(source).alias("source"), p.alias("shown")))
    every = F.concat(shown(tel, "tel"), shown(said, "text"), shown(given, "data-attr"), shown(hinted, "class-hint"))
    return distinct_by_value(F.filter(every, lambda x: F.length(x["v"]) >= 10))


def card_name(nodes: Column) -> Column:
    """H5 on a card: the first good text by groups of selectors, then selectors, then document order."""
    is_tag = lambda *t: lambda x: x["tag"].isin(*t)
    named = lambda x: class_part(x, "name") & ~class_part(x, "username", "filename")
    to = lambda p: lambda x: is_link(x) & href(x).contains(p)
    tests = [*(is_tag(f"h{k}") for k in range(1, 5)), *((lambda x, c=c: has_class(x, c)) for c in ("name", "attorney-name", "lawyer-name", "agent-name", "person-name")), named]
    tests += [*(to(p) for p in ("/lawyer/", "/attorney/", "/Lawyers/", "/agent/", "/profile/", "/people/")), is_tag("strong"), is_tag("b"), lambda x: has_class(x, "title"), lambda x: class_part(x, "title")]
    every = F.filter(F.flatten(F.array(*(texts(nodes, t) for t in tests))), lambda t: F.length(t).between(2, 100) & ~F.lower(t).isin(V.CARD_NOT_NAMES))
    clean = F.transform(every, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"(?i)^(attorney|lawyer|agent|broker|realtor|mr\.|mrs\.|ms\.|dr\.)\s+", ""), r"(?i),?\s*(jr\.?|sr\.?|ii|iii|iv|esq\.?|phd|md)\.?\z", "")))
    return F.get(F.filter(clean, lambda t: F.length(t).between(2, 100) & (F.size(F.split(t, r"\s+")) <= 5) & t.rlike(r"^[A-Z][A-Za-z\s'\-.]*\z")), 0)


def best_by(found: Column, order: dict[str, int]) -> Column:
    """The first of the sources that weigh most."""
    weight = lambda s: F.coalesce(*(F.when(s == k, v) for k, v in order.items()), F.lit(0))
    return F.array_min(F.transform(found, lambda x, i: F.struct((-weight(x["source"])).alias("w"), i.alias("i"), x.alias("x"))))["x"]


def contacts_from_cards(cards: DataFrame) -> DataFrame:
    """H7: a contact per card with the sources of its fields, counts of what was found, and C7 as confidence."""
    n = F.col("nodes")
    found = cards.withColumns({"e_": card_emails(n, F.col("text"), F.col("url")), "p_": card_phones(n, F.col("text")), "u_": best_profile_link(n, F.col("url")), "name": card_name(n)})
    e = best_by(F.col("e_"), {"email-link-text": 4, "email-link-href": 4, "mailto": 3, "data-attr": 2, "text": 1, "obfuscated": 1, "encoded-href": 1})
    p = best_by(F.col("p_"), {"tel": 3, "data-attr": 2, "text": 1, "class-hint": 1})
    d = found.withColumns({"e": e, "p": p})
    return d.select(
        "page_id", "card_index", "name", F.col("e.v").alias("email"), F.col("p.shown").alias("phone"), F.col("u_.url").alias("profile_url"), presence_confidence(F.col("name"), F.col("e.v"), F.col("p.shown")).alias("confidence"),
        F.col("e.source").alias("email_source"), F.col("p.source").alias("phone_source"), F.col("u_.score").alias("profile_url_score"), F.size("e_").alias("all_emails"), F.size("p_").alias("all_phones"),
    )


def whole_pages(trees: DataFrame) -> DataFrame:
    """Each page as one card, for rules that take a page as well as a card."""
    return trees.select("page_id", "url", F.lit(0).alias("card_index"), "nodes", page_text(F.col("nodes")).alias("text"))


def email_candidates(cards: DataFrame) -> DataFrame:
    """H3: page_id, card_index, position, value, source, confidence of every address; high but for text, spelled and encoded ones."""
    d = cards.select("page_id", "card_index", F.posexplode(card_emails(F.col("nodes"), F.col("text"), F.col("url"))).alias("position", "e"))
    return d.select("page_id", "card_index", "position", F.col("e.v").alias("value"), "e.source", F.when(F.col("e.source").isin("text", "obfuscated", "encoded-href"), "medium").otherwise("high").alias("confidence"))


def phone_candidates(cards: DataFrame) -> DataFrame:
    """H4: page_id, card_index, position, value, digits, source, confidence of every phone; high for tel links and data attributes."""
    d = cards.select("page_id", "card_index", F.posexplode(card_phones(F.col("nodes"), F.col("text"))).alias("position", "p"))
    return d.select("page_id", "card_index", "position", F.col("p.shown").alias("value"), F.col("p.v").alias("digits"), "p.source", F.when(F.col("p.source").isin("tel", "data-attr"), "high").otherwise("medium").alias("confidence"))


def data_urls(cards: DataFrame) -> DataFrame:
    """H9: the first address that a node's data attributes hold, by attribute order, made absolute, with its confidence."""
    v = lambda x: F.coalesce(*(F.when(attr(x, a).rlike("^(/|http)"), F.struct(attr(x, a).alias("value"), F.lit(a).alias("attribute"))) for a in V.URL_ATTRIBUTES))
    found = F.get(F.filter(F.transform("nodes", v), lambda s: s.isNotNull()), 0)
    return cards.select("page_id", "card_index", joined_url(found["value"], F.col("url")).alias("data_url"), found["attribute"].alias("attribute"), F.when(found.isNotNull(), 85).otherwise(0).alias("confidence"))


def smart_phone(c: Column) -> Column:
    d = digits(c)
    shown = lambda x: F.concat(F.lit("("), F.substring(x, 1, 3), F.lit(") "), F.substring(x, 4, 3), F.lit("-"), F.substring(x, 7, 4))
    return F.when(F.length(d) == 10, shown(d)).when((F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("+1 "), shown(F.substring(d, 2, 10)))).when(F.length(d).between(7, 15), F.trim(c))


def smart_emails(nodes: Column, text: Column) -> Column:
    """Distinct addresses: mailto links, then texts and addresses of links, then text."""
    links = F.filter(nodes, is_link)
    mail = F.filter(F.transform(F.filter(links, lambda x: href(x).startswith("mailto:")), lambda x: F.lower(bare(href(x), "mailto"))), lambda v: v.contains("@"))
    other = F.flatten(F.transform(links, lambda x: F.array(F.lower(first_match(x["text"], V.EMAIL)), F.when(~href(x).startswith("mailto:"), F.lower(first_match(href(x), V.EMAIL))))))
    return F.array_distinct(F.filter(F.concat(mail, other, F.transform(matches(text, V.EMAIL), lambda v: F.lower(v))), lambda v: v.isNotNull()))


def smart_phones(nodes: Column, text: Column) -> Column:
    """Distinct phones of 7 to 15 digits: text by three patterns, then tel links."""
    said = F.flatten(F.array(*(matches(text, p) for p in V.SMART_PHONES)))
    tel = F.transform(F.filter(nodes, lambda x: is_link(x) & href(x).startswith("tel:")), lambda x: F.regexp_replace(href(x), "^tel:", ""))
    return F.array_distinct(F.filter(F.transform(F.concat(said, tel), smart_phone), lambda v: v.isNotNull()))


def counted(words: list[str], text: Column) -> Column:
    """How many of the words the text holds; 0 without a text."""
    return F.greatest(F.size(F.filter(F.lit(words), lambda w: F.contains(text, w))), F.lit(0))


def highest(nodes: Column, tests: list, text_ok, score) -> Column:
    """The text of the node of the best score; ties to the earlier test, then to the earlier node."""
    rank = lambda x: F.coalesce(*(F.when(t(x), k) for k, t in enumerate(tests)))
    seen = F.filter(F.transform(nodes, lambda x: F.struct((-score(x)).alias("s"), rank(x).alias("k"), x["n"].alias("n"), x["text"].alias("text"))), lambda s: s["k"].isNotNull() & text_ok(s["text"]))
    return F.array_min(seen)["text"]


def smart_title(nodes: Column, *other: Column) -> Column:
    """The text most like a job title, but for the given texts."""
    parts = ("title", "position", "role", "job", "designation")
    tests = [*((lambda x, p=p: class_part(x, p)) for p in parts), *((lambda x, t=t: x["tag"] == t) for t in ("p", "span", "div"))]
    low = [w.lower() for w in V.JOB_WORDS]

    def score(x: Column) -> Column:
        t, c = x["text"], F.lower(x["cls"])
        s = 20 * counted(low, F.lower(t)) + sum((F.when(c.contains(p), w).otherwise(0) for p, w in zip(parts, (30, 30, 25, 25), strict=False)), F.lit(0))
        return s + F.when(F.length(t).between(10, 60), 15).otherwise(0) - F.when(t.rlike(r"\d{4}"), 20).otherwise(0) - F.when(t.contains("@"), 50).otherwise(0)

    good = lambda t: F.length(t).between(5, 150) & (counted(low, F.lower(t)) > 0) & ~F.lower(t).isin(*(F.lower(F.coalesce(o, F.lit(""))) for o in other))
    return highest(nodes, tests, good, score)


CITY_STATE = r"[A-Z][a-z]+,\s*[A-Z]{2}"


def smart_location(nodes: Column, *other: Column) -> Column:
    """The text most like a place, but for the given texts."""
    tests = [*((lambda x, p=p: class_part(x, p)) for p in ("location", "city", "address", "geo", "place")), *((lambda x, t=t: x["tag"] == t) for t in ("span", "p", "div"))]

    def score(x: Column) -> Column:
        t, c = x["text"], F.lower(x["cls"])
        s = 15 * counted(V.PLACE_SIGNS, t) + F.when(t.rlike(CITY_STATE), 30).otherwise(0) + sum((F.when(c.contains(p), w).otherwise(0) for p, w in (("location", 40), ("city", 35), ("address", 30))), F.lit(0))
        return s - F.when(F.length(t) > 50, 10).otherwise(0)

    good = lambda t: F.length(t).between(2, 100) & ((counted(V.PLACE_SIGNS, t) > 0) | t.rlike(CITY_STATE)) & ~F.lower(t).isin(*(F.lower(F.coalesce(o, F.lit(""))) for o in other))
    return highest(nodes, tests, good, score)


def smart_profile_url(nodes: Column, url: Column) -> Column:
    """The link of the best score by path, text and a name around it, made absolute; none without a score."""
    paths = {"profile": 40, "people": 40, "user": 35, "staff": 35, "member": 30, "attorney": 40, "bio": 35}
    said = {"view profile": 30, "read more": 20, "learn more": 15}

    def score(x: Column) -> Column:
        h, t = F.lower(href(x)), F.lower(x["text"])
        s = sum((F.when(h.contains(f"/{p}/"), w).otherwise(0) for p, w in paths.items()), F.lit(0)) + sum((F.when(t.contains(p), w).otherwise(0) for p, w in said.items()), F.lit(0))
        return s + F.when(class_part(x, "name") | within(x, nodes, lambda a: class_part(a, "name")), 25).otherwise(0)

    links = F.filter(nodes, lambda x: is_link(x) & (href(x) != "") & ~any_of([href(x).rlike(f"(?i){p}") for p in SOCIAL.values()]) & ~href(x).rlike("^(mailto|tel):"))
    best = F.array_min(F.filter(F.transform(links, lambda x: F.struct((-score(x)).alias("s"), x["n"].alias("n"), href(x).alias("to"))), lambda s: s["s"] < 0))
    return joined_url(best["to"], url)


def smart_name(nodes: Column) -> Column:
    """The first good text of name-like elements, else the first text of two to four words that is no title or place, else the
    first such text; tidied and in title case. Nearness on the screen is not known here."""
    low = [w.lower() for w in V.JOB_WORDS]
    good = lambda t: F.length(t).between(2, 100) & t.rlike("[a-zA-Z]") & (F.length(digits(t)) <= F.length(t) / 2) & ~F.lower(t).isin(V.SMART_NOT_NAMES) & (F.size(F.split(t, r"\s+")) <= 6) & ~F.exists(F.split(t, r"\s+"), lambda w: F.length(w) > 25) & ~t.contains("@")
    tests = [*((lambda x, p=p: class_part(x, p)) for p in ("name", "person", "author")), *((lambda x, t=t: x["tag"] == t) for t in (*HEADINGS, "strong", "b"))]
    named = in_order(nodes, tests, lambda t: good(t) & ((counted(low, F.lower(t)) == 0) | (F.size(F.split(t, " ")) <= 3)), every=True)
    own = F.filter(F.transform(nodes, lambda x: x["own"]), lambda t: good(t) & (counted(low, F.lower(t)) == 0) & (counted(V.PLACE_SIGNS, t) == 0))
    text = F.coalesce(named, F.get(F.filter(own, lambda t: F.size(F.split(t, r"\s+")).between(2, 4)), 0), F.get(own, 0))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)^(Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Prof\.?)\s*", ""), r"(?i)\s*(Jr\.?|Sr\.?|III?|IV)\z", ""))
    return present(F.array_join(F.transform(F.split(tidy, " "), lambda w: F.when(F.length(w) <= 2, F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000))))), " "))


def smart_contacts(cards: DataFrame) -> DataFrame:
    """H10 to H15 of each card with a score from 0 to 100."""
    n = F.col("nodes")
    d = cards.withColumns({"e_": smart_emails(n, F.col("text")), "p_": smart_phones(n, F.col("text")), "name": smart_name(n), "profile_url": smart_profile_url(n, F.col("url"))})
    d = d.withColumns({"email": F.get("e_", 0), "phone": F.get("p_", 0)})
    d = d.withColumns({"title": smart_title(n, F.col("name"), F.col("email")), "location": smart_location(n, F.col("name"), F.col("email"))})
    weights = {"email": 35, "name": 30, "phone": 15, "title": 10, "profile_url": 5, "location": 5}
    score = sum((F.when(F.col(c).isNotNull(), w).otherwise(0) for c, w in weights.items()), F.lit(0))
    return d.select("page_id", "card_index", *weights, score.alias("score"), F.size("e_").alias("all_emails"), F.size("p_").alias("all_phones"))


def by_method(nodes: Column, text: Column, url: Column) -> dict[str, Column]:
    """What each method of H20 finds on a card. Methods that need a place on the screen take the first heading or name (`coordinate-text`)."""
    mail = first(nodes, lambda x: is_link(x) & href(x).startswith("mailto:"))
    tel = first(nodes, lambda x: is_link(x) & href(x).startswith("tel:"))
    link = first(nodes, lambda x: is_link(x) & (href(x) != "") & ~href(x).rlike("^(mailto:|tel:|#|javascript:)"))
    return {
        "mailto-link": F.lower(bare(href(mail), "mailto")), "regex-email": F.lower(first_match(text, V.EMAIL)), "tel-link": F.regexp_replace(href(tel), "^tel:", ""), "regex-phone": first_match(text, V.LOOSE_PHONE),
        "href-link": joined_url(href(link), url), "coordinate-text": first(nodes, lambda x: x["tag"].isin(*HEADINGS) | class_part(x, "name"))["text"],
    }


def apply_field_methods(cards: DataFrame, config: DataFrame, domain: Column, fields: list[str]) -> DataFrame:
    """For each card the fields by the method that its domain's settings (domain, field, method, confidence or null) name, with
    methods, a map of field to method and confidence (85 by default). Cards without any field go; of two settings of a field the least
    method counts; a domain without settings gives no rows."""
    per = config.groupBy("domain", "field").agg(F.min(F.struct("method", F.coalesce("confidence", F.lit(85)).alias("confidence"))).alias("how"))
    per = per.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("field", "how"))).alias("how_"))  # a row per domain
    d = cards.withColumn("domain", domain).join(per, "domain").withColumns({f"m_{k}": present(v) for k, v in by_method(F.col("nodes"), F.col("text"), F.col("url")).items()})
    names = tuple(by_method(F.col("nodes"), F.col("text"), F.col("url")))
    how = lambda f, k: F.col("how_")[f]["method"] == k
    value = {f: F.coalesce(*(F.when(how(f, k), F.col(f"m_{k}")) for k in names), *(F.when(how(f, "label-value"), label_value(F.col("nodes"), f)) for _ in range(f in LABELS))) for f in fields}
    d = d.withColumns({f: v for f, v in value.items()}).where(F.coalesce(*(F.col(f) for f in fields)).isNotNull())
    got = F.map_filter("how_", lambda k, v: F.array_contains(F.filter(F.array(*(F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields)), lambda x: x.isNotNull()), k))
    return d.select("page_id", "card_index", "domain", *fields, got.alias("methods"))


def visit_extract(trees: DataFrame) -> DataFrame:
    """page_id, email (the first of high confidence, else the first), phone (the first), name (the first of eight selectors, 3 to 100
    characters and five words at most) of each visited page."""
    d = whole_pages(trees)
    e, p = card_emails(F.col("nodes"), F.col("text"), F.col("url")), card_phones(F.col("nodes"), F.col("text"))
    d = d.withColumns({"e_": e, "p_": p})
    sure = F.get(F.filter("e_", lambda x: ~x["source"].isin("text", "obfuscated", "encoded-href")), 0)["v"]
    token = lambda t: lambda x: has_class(x, t)
    tests = [lambda x: x["tag"] == "h1", *map(token, ("attorney-name", "lawyer-name", "profile-name", "name")), lambda x: class_part(x, "name"), *map(token, ("bio-name", "person-name"))]
    name = in_order(F.col("nodes"), tests, lambda t: F.length(t).between(3, 100) & (F.size(F.split(t, r"\s+")) <= 5))
    return d.select("page_id", F.coalesce(sure, F.get("e_", 0)["v"]).alias("email"), F.get("p_", 0)["shown"].alias("phone"), name.alias("name"))


#: Elements that are no cards.
NO_CARDS = frozenset({"html", "head", "body", "script", "style", "meta", "link", "title", "br"})
MAIL_IN, PHONE_IN = re.compile(V.EMAIL), re.compile(r"[\d\s\-().+]{7,}")
#: What the score compares: parents (tag and classes, three up), number and tags of children, classes, links inside, address, phone.
Look = tuple[tuple[tuple[str, frozenset], ...], int, tuple[tuple[str, int], ...], frozenset, int, bool, bool]


def looks(rows: list[tuple]) -> dict[int, Look]:
    """The look of each parsed element that has children, in one pass up the tree: links add up from below, parents from above."""
    links, kids = [int(r[3] == "a") for r in rows], [[] for _ in rows]
    for i in range(len(rows) - 1, -1, -1):
        if (up := rows[i][1]) >= 0:
            links[up] += links[i]
            kids[up].append(rows[i][3])
    own = [(r[3], frozenset(r[4].split())) for r in rows]
    out = {}
    for i, r in enumerate(rows):
        if kids[i] and r[3] not in NO_CARDS:
            parents, up = [], r[1]
            while up >= 0 and len(parents) < 3:
                parents.append(own[up])
                up = rows[up][1]
            out[i] = (tuple(parents), len(kids[i]), tuple(sorted(Counter(kids[i]).items())), own[i][1], links[i] - (r[3] == "a"), bool(MAIL_IN.search(r[6])), bool(PHONE_IN.search(r[6])))
    return out


def likeness(a: Look, b: Look) -> float:
    """Points of two elements of one tag: tag 20, parents up to three 15 (half as much again with a class in common), number of children 15,
    tags of children 15, classes 15, links 10, address and phone 5 each."""
    both = list(zip(a[0], b[0], strict=False))
    parents = sum((1.5 if p[1] & q[1] else 1.0) if p[0] == q[0] else 0.0 for p, q in both) / max(len(both), 1)
    x, y = dict(a[2]), dict(b[2])
    tags = sum(min(x.get(t, 0), y.get(t, 0)) / max(x.get(t, 0), y.get(t, 0)) for t in x | y) / max(len(x | y), 1)
    classes = 2 * len(a[3] & b[3]) / (len(a[3]) + len(b[3])) if a[3] or b[3] else 1.0
    links = 5 + max(0, 5 - abs(a[4] - b[4])) if (a[4] > 0) == (b[4] > 0) else 0
    return 20 + 15 * parents + 15 * max(0.0, 1 - abs(a[1] - b[1]) / 10) + 15 * tags + 15 * classes + links + 5 * (a[5] == b[5]) + 5 * (a[6] == b[6])


def alike(html: str | None, least: float) -> list[tuple[int, int, float]]:
    """(element, the earlier one that it is like, score) of a page."""
    return alike_in(parse(html), least)


def alike_in(rows: list[tuple], least: float) -> list[tuple[int, int, float]]:
    """alike() over a page's parsed elements.

    Siblings of one tag with equal looks are settled by a table. A new look is compared with the block's leaders, those before it that are like
    none before them, and joins the first of enough points or leads itself. Leaders differ from one another in children or links, so their number
    grows with the root of the block's elements at most, and a list of equal cards costs its length.
    """
    out = []
    blocks: dict[tuple, tuple[dict, list]] = {}
    for i, look in looks(rows).items():
        known, leaders = blocks.setdefault((rows[i][1], rows[i][3]), ({}, []))
        if look not in known:
            best = next(((j, s) for j, other in leaders if (s := likeness(look, other)) >= least), None)
            known[look] = best or (i, likeness(look, look))
            if best is None:
                leaders.append((i, look))
        j, score = known[look]
        if j != i:
            out.append((i, j, round(score, 4)))
    return out


def repeated_cards(pages: DataFrame, least: float = 65.0) -> DataFrame:
    """page_id, n, like, score, tag, class: elements that look like an earlier sibling of their tag, by structure alone (`likeness`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = ((p, parse(html)) for p, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            found = [(p, *x, rows[x[0]][3], rows[x[0]][4]) for p, rows in parsed for x in alike_in(rows, least)]
            cols = list(zip(*found, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string()), strict=True)], names=["page_id", "n", "like", "score", "tag", "class"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, n int, like int, score double, tag string, class string")
