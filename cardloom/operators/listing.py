"""Listings: page boundaries, page numbers, unions of stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import domain, page_param, params, with_query


def page_boundary(pages: DataFrame, cap: int = 500) -> DataFrame:
    """Per listing the last valid page before two empty ones in a row, whether that was confirmed, and whether the cap cut it.

    pages: listing_id, page_num, valid. Pages that aren't stored count as empty.
    """
    d = pages.where(F.col("page_num").between(1, cap))
    w = Window.partitionBy("listing_id").orderBy("page_num")
    v = d.where("valid").withColumn("next_", F.lead("page_num").over(w))
    gap = F.coalesce(F.col("next_"), F.lit(cap + 3)) - F.col("page_num") > 2
    ends = v.where(gap).groupBy("listing_id").agg(F.min("page_num").alias("last_page"))
    out = d.select("listing_id").distinct().join(ends, "listing_id", "left")
    last = F.coalesce("last_page", F.lit(0))
    return out.select("listing_id", last.alias("last_page"), (last < cap - 1).alias("confirmed"), (last >= cap).alias("capped"))


def page_number(pages: DataFrame, length: int = 12) -> DataFrame:
    """The page number of an address: its page parameter, else its place by address among those of its site.

    A site's addresses are ranked in pieces, by their first `length` characters after the site: within a piece by a window, before it by
    the counts of the pieces that sort before, so a site of any share of all pages is spread over tasks.
    """
    site = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    d = pages.withColumn("site_", site).withColumn("given_", F.when(page_param(F.col("url"))["type"] == "parameter", page_param(F.col("url"))["value"]))
    d = d.withColumn("piece_", F.left("url", F.length("site_") + length))
    counts = d.groupBy("site_", "piece_").agg(F.count("*").alias("n_"))
    before = Window.partitionBy("site_").orderBy("piece_").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("site_").alias("s_"), F.col("piece_").alias("p_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    ranked = d.withColumn("r_", F.row_number().over(Window.partitionBy("site_", "piece_").orderBy("url", "page_id")))
    both = ranked.join(counts, ranked["site_"].eqNullSafe(counts["s_"]) & ranked["piece_"].eqNullSafe(counts["p_"]))
    return both.select("page_id", F.coalesce("given_", F.col("before_") + F.col("r_")).alias("page_num"))


def union_pages(parts: list[DataFrame]) -> DataFrame:
    """All parts by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def prefer_stage(key: str, *stages: DataFrame) -> DataFrame:
    """X3 by row: each row from the first stage that has it (cleaned before enriched before scraped)."""
    marked = [s.withColumn("stage_", F.lit(i)) for i, s in enumerate(stages)]
    every = union_pages(marked)
    first = every.groupBy(key).agg(F.min("stage_").alias("first_"))
    return every.join(first, key).where("stage_ = first_").drop("stage_", "first_")


def latest_pattern(cache: DataFrame) -> DataFrame:
    """Per domain the newest pattern with a confidence of 70 or more."""
    rest = [c for c in cache.columns if c not in ("domain", "cached_at")]
    d = cache.where("confidence >= 70").groupBy("domain").agg(F.max(F.struct("cached_at", *rest)).alias("m"))
    return d.select("domain", "m.*")


def rebased_pattern(cache: DataFrame, pages: DataFrame, small: int = 200_000) -> DataFrame:
    """S7 on read: page_id, url, name, base_url, changed: the newest pattern of each page's domain (cache: domain, name, base_url, cached_at,
    confidence) with its base put onto the page's own address: site and path, and the parameters but the pattern's own. Pages of unknown domains
    are left out; of a repeated parameter every value goes."""
    known = latest_pattern(cache.select("domain", "name", "base_url", "cached_at", "confidence"))
    known = F.broadcast(known) if known.count() <= small else known
    d = pages.select("page_id", "url").withColumn("domain", domain(F.col("url"))).join(known, "domain")
    base = with_query(F.col("url"), F.filter(params(F.col("url")), lambda p: p["name"] != F.col("name")))
    return d.select("page_id", "url", "name", base.alias("base_url"), (base != F.coalesce("base_url", F.lit(""))).alias("changed"))
