"""The pass over merged contacts: places, phones, domains and a score, with a log of what was done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.cleaning import normalize_location, quality_score
from ..functions.places import country_code, country_of, multi_location, phone_location_check
from ..functions.text import domain_type, email_domain, matches, present
from .fingerprint import page_fingerprint_check
from .html import absolute, html_nodes, page_text_of
from .selectors import css


def post_clean(contacts: DataFrame, us_first: bool = True) -> DataFrame:
    """Several places resolved (C24), the phone checked (C25), the place normalised (C26), the domain classified (C10), the row scored.

    Adds domain, domain_type, score, overall, phone_reason, other_locations and operations. A place keeps its field if none was recognised.
    """
    d = contacts.withColumn("m_", multi_location(F.col("location"), F.col("phone"), us_first))
    d = d.withColumns({"place_": F.coalesce(F.col("m_.location"), F.col("location")), "paired_": country_of(country_code(F.get(F.col("m_.pairs"), 0)["phone"]))})
    d = d.withColumn("fits_", phone_location_check(F.col("phone"), F.col("place_"), F.col("paired_")))
    d = d.withColumn("n_", normalize_location(F.col("place_"))).withColumn("domain", email_domain(F.col("email"))).withColumn("domain_type", domain_type(F.col("domain")))
    d = d.withColumn("q_", quality_score(F.col("name"), F.col("n_.location"), F.col("email"), F.col("phone"), ~F.col("fits_.mismatch")))
    done = F.array(F.when(F.col("m_.several"), F.lit("multi-location")), F.when(F.col("fits_.mismatch"), F.col("fits_.reason")), F.when(F.col("n_.changed"), F.lit("location-normalized")), F.when(F.col("domain").isNotNull(), F.lit("domain-classified")))
    others = F.slice(F.col("m_.locations"), 2, 1000)
    out = [F.col("n_.location").alias("location") if c == "location" else F.col(c) for c in contacts.columns]
    return d.select(*out, "domain", "domain_type", "q_.score", "q_.overall", F.col("fits_.reason").alias("phone_reason"), others.alias("other_locations"), F.filter(done, lambda x: x.isNotNull()).alias("operations"))


def post_clean_stats(cleaned: DataFrame) -> DataFrame:
    """One row of how often each operation and each level came up."""
    ops = ["multi-location", "country-mismatch", "city-mismatch", "location-normalized", "domain-classified"]
    return cleaned.agg(F.count("*").alias("total"), *(F.count_if(F.array_contains("operations", o)).alias(o.replace("-", "_")) for o in ops), *(F.count_if(F.col("overall") == k).alias(k) for k in ("high", "medium", "low")))


def noise_summary(long: DataFrame) -> DataFrame:
    """Per field the values with noise; long: row_id, field, noise (array of type and matched)."""
    return long.where(F.size("noise") > 0).groupBy("field").agg(F.count("*").alias("noisy"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("noise", lambda n: n["type"]))))), ",").alias("types"))


def page_contacts(pages: DataFrame, card_selector: str | None = None, first: int = 10) -> DataFrame:
    """What a page counts as contacts: page_id, method, contacts, found (the first ones in order: name, profile_url).

    With a card selector its elements; else mailto links, else the first of the known profile paths with three links, else distinct addresses
    in the text, else tel links. A card's name is its first heading, name-like element or link with a text. Every page gives a row.
    """
    nodes = html_nodes(pages).join(pages.select(F.col("page_id").cast("long"), F.col("url").alias("base_")), "page_id")
    text = F.col("text")
    to = F.when(F.col("attrs")["href"].isNotNull(), absolute(F.col("attrs")["href"], F.col("base_")))
    if card_selector:
        d = nodes.where(css(card_selector)).select("page_id", F.col("node_id").alias("card_"), F.col("last_id").alias("end_"))
        kinds = [css(x) for x in ("h1", "h2", "h3", "h4", ".name", '[class*="name"]', "a")]
        rank = F.coalesce(*(F.when(k, i) for i, k in enumerate(kinds)))
        link = css(", ".join(f'a[href*="{x}"]' for x in ("/profile", "/people/", "/attorney", "/lawyer", "/team/", "/bio/")) + ", a")
        inside = nodes.where(rank.isNotNull() | link).select("page_id", "node_id", "text", rank.alias("rank_"), F.when(link, to).alias("to_"))
        inside = d.join(inside, "page_id").where((F.col("node_id") > F.col("card_")) & (F.col("node_id") <= F.col("end_"))).groupBy("page_id", "card_").agg(
            F.min(F.when(F.col("rank_").isNotNull() & (text != ""), F.struct("rank_", "node_id", "text")))["text"].alias("name"), F.min(F.when(F.col("to_").isNotNull(), F.struct("node_id", "to_")))["to_"].alias("profile_url"),
        )
        rows = d.join(inside, ["page_id", "card_"], "left").select("page_id", F.lit(0).alias("k_"), F.col("card_").alias("at_"), "name", "profile_url")
    else:
        kinds = ['a[href^="mailto:"]', *V.CONTACT_LINKS]
        hits = F.filter(F.array(*(F.when(css(c), F.lit(i)) for i, c in enumerate(kinds)), F.when(css('a[href^="tel:"]'), F.lit(len(kinds) + 1))), lambda x: x.isNotNull())
        links = nodes.where("tag = 'a'").select("page_id", F.explode(hits).alias("k_"), F.col("node_id").alias("at_"), present(text).alias("name"), to.alias("profile_url"))
        body = nodes.groupBy("page_id").agg(page_text_of().alias("t_"))
        said = body.select("page_id", F.lit(len(kinds)).alias("k_"), F.posexplode(F.array_distinct(matches(F.col("t_"), V.EMAIL))).alias("at_", "name"), F.lit(None).cast("string").alias("profile_url"))
        rows = links.unionByName(said)
    per = rows.groupBy("page_id", "k_").agg(F.count("*").alias("contacts"), F.slice(F.array_sort(F.collect_list(F.struct("at_", "name", "profile_url"))), 1, first).alias("found"))
    enough = per.where(F.lit(True) if card_selector else ~F.col("k_").between(1, len(V.CONTACT_LINKS)) | (F.col("contacts") >= 3))
    best = enough.groupBy("page_id").agg(F.min(F.struct("k_", "contacts", "found")).alias("m"))
    methods = {0: "card-selector"} if card_selector else {0: "mailto-links", len(V.CONTACT_LINKS) + 1: "email-regex", len(V.CONTACT_LINKS) + 2: "tel-links"}
    method = F.coalesce(*(F.when(F.col("m.k_") == k, v) for k, v in methods.items()), F.when(F.col("m.k_").isNotNull(), "profile-links"), F.lit("none"))
    d = pages.select(F.col("page_id").cast("long")).join(best, "page_id", "left")
    found = F.transform(F.coalesce("m.found", F.array().cast("array<struct<at_:int,name:string,profile_url:string>>")), lambda x: F.struct(x["name"].alias("name"), x["profile_url"].alias("profile_url")))
    return d.select("page_id", method.alias("method"), F.coalesce("m.contacts", F.lit(0)).cast("long").alias("contacts"), found.alias("found"))


def page_contact_count(pages: DataFrame, least: int = 1, card_selector: str | None = None) -> DataFrame:
    """Contacts of a page and whether they are enough."""
    return page_contacts(pages, card_selector).select("page_id", "contacts", (F.col("contacts") >= least).alias("valid"))


def stored_listings(pages: DataFrame, least: int = 1, card_selector: str | None = None) -> DataFrame:
    """What W1 asks of stored pages (page_id, listing_id, page_num, url, html): listing_id, page_num, valid. A page is valid if it has
    enough contacts (H32) and they are not those of its listing's page 1 (J4)."""
    d = pages.select("page_id", "listing_id", "page_num").join(page_contacts(pages, card_selector), "page_id")
    rows = d.select("listing_id", "page_num", F.posexplode("found").alias("position", "c")).select("listing_id", "page_num", "position", "c.*")
    verdict = page_fingerprint_check(rows, pages=d.select("listing_id", "page_num"))
    good = F.col("verdict").isin("first", "valid", "unique")
    return d.select("listing_id", "page_num", "contacts").join(verdict, ["listing_id", "page_num"]).select("listing_id", "page_num", ((F.col("contacts") >= least) & good).alias("valid"))
