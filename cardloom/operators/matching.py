"""Profile links for names: scores of a link by its address and text, and the best link of each contact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.text import any_of, present


def plain_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[^a-z\s]", ""))


def name_parts(name: Column) -> Column:
    """Words of two letters or more."""
    return F.filter(F.split(plain_name(name), r"\s+"), lambda p: F.length(p) > 1)


def link_match(name: Column, url: Column, text: Column) -> Column:
    """struct(total, url_score, text_score, kind): 0.6 of how the address holds the name (whole 0.95, first and last 0.85, last 0.5,
    first 0.3) and 0.4 of the share of the name's parts that the text holds. Missing values score 0, kind none."""
    parts, low = name_parts(name), F.lower(url)
    first, last = F.get(parts, 0), F.try_element_at(parts, F.lit(-1))
    pieces = F.filter(F.split(low, r"[/\-_.]"), lambda p: F.length(p) > 2)
    has = lambda w: F.coalesce(F.exists(pieces, lambda p: p.contains(w)), F.lit(False))
    whole = F.coalesce((plain_name(name) != "") & low.contains(F.regexp_replace(plain_name(name), r"\s+", "-")), F.lit(False))
    by_url = F.when(whole, F.lit(0.95)).when(has(first) & has(last), 0.85).when(has(last), 0.5).when(has(first), 0.3).otherwise(0.0)
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda p: F.length(p) > 2)
    hit = F.size(F.filter(parts, lambda p: F.exists(words, lambda w: w.contains(p) | p.contains(w))))
    by_text = F.coalesce(F.when((F.size(parts) > 0) & present(text).isNotNull(), hit / F.size(parts)), F.lit(0.0))
    kind = F.when(by_url == 0.95, "exact").when(by_url == 0.85, "strong").when(by_url == 0.5, "partial").when(by_url == 0.3, "weak").when(by_text >= 0.9, "strong").when(by_text >= 0.5, "partial").otherwise("none")
    return F.struct((by_url * 0.6 + by_text * 0.4).alias("total"), by_url.alias("url_score"), by_text.alias("text_score"), kind.alias("kind"))


def classify_link(url: Column, text: Column, name: Column) -> Column:
    """struct(type, is_profile, name_match, confidence): profile by the address's parts, else linkedin or twitter, else unknown."""
    low = F.coalesce(F.lower(url), F.lit(""))
    profile = any_of([low.contains(p.lower()) for p in V.PROFILE_PARTS])
    kind = F.when(profile, "profile").when(low.contains("linkedin.com"), "linkedin").when(low.contains("twitter.com") | low.contains("x.com"), "twitter").otherwise("unknown")
    m = link_match(name, url, text)
    return F.struct(kind.alias("type"), profile.alias("is_profile"), m["kind"].alias("name_match"), m["total"].alias("confidence"))


def match_profiles_by_url(contacts: DataFrame, links: DataFrame, scope: str) -> DataFrame:
    """row_id, profile_url, confidence, kind for contacts without a profile address that have a name: the best link (total of 0.5
    or more) of the same scope (a page or site), ties to the least pos. Names of fewer than two letters match nothing.

    A total of 0.5 needs the name's first or last part, or the whole name, in the address, so contacts and links meet in an equi-join
    on the scope and the part's first three letters (two, if it has no more), never pair by pair.
    """
    def grams(c: Column, size: int) -> Column:
        return F.when(F.length(c) >= size, F.transform(F.sequence(F.lit(1), F.length(c) - (size - 1)), lambda i: F.substring(c, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    parts, slug = name_parts(F.col("name")), F.regexp_replace(plain_name(F.col("name")), r"\s+", "-")
    starts = F.when(F.size(parts) > 0, F.array(F.substring(F.get(parts, 0), 1, 3), F.substring(F.try_element_at(parts, F.lit(-1)), 1, 3))).otherwise(F.array(F.substring(slug, 1, 3)))
    wanted = contacts.where(present(F.col("profile_url")).isNull() & present(F.col("name")).isNotNull())
    asked = wanted.select("row_id", "name", F.col(scope).alias("scope_"), F.explode(F.array_distinct(starts)).alias("g_")).where(F.length("g_") >= 2)
    low = F.lower(F.col("url"))
    given = links.select(F.col(scope).alias("scope_"), "pos", "url", "text", F.explode(F.array_distinct(F.concat(grams(low, 2), grams(low, 3)))).alias("g_"))
    pairs = asked.join(given, ["scope_", "g_"]).select("row_id", "name", "pos", "url", "text").distinct()
    m = pairs.withColumn("m", link_match(F.col("name"), F.col("url"), F.col("text"))).where("m.total >= 0.5")
    best = m.groupBy("row_id").agg(F.min(F.struct((-F.col("m.total")).alias("t"), "pos", "url", F.col("m.kind").alias("kind"))).alias("b"))
    return best.select("row_id", F.col("b.url").alias("profile_url"), F.round(-F.col("b.t"), 6).alias("confidence"), F.col("b.kind").alias("kind"))
