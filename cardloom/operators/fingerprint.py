"""Whether a page of a listing shows its first page again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import present


def page_fingerprint_check(rows: DataFrame, first: int = 5, pages: DataFrame | None = None) -> DataFrame:
    """listing_id, page_num, verdict: a page against page 1 of its listing.

    rows: listing_id, page_num, position, name, profile_url. `first` for page 1; `empty` for a page of `pages` (listing_id, page_num) without
    rows; `valid` where page 1 has none; duplicate_urls for the first addresses (a missing one stands as its name), duplicate_names for the
    first names, duplicate_boundaries for the first and last name and an equal number; else unique. A page's first rows are by position.
    """
    none, page = F.lit(""), ["listing_id", "page_num"]
    end = lambda f: f(F.struct("position", "name"))["name"]
    heads = rows.withColumn("r_", F.row_number().over(Window.partitionBy(*page).orderBy("position"))).where(F.col("r_") <= first)  # a limit that tasks apply before the shuffle
    heads = heads.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("r_", "name", "profile_url"))).alias("h"))
    joined = lambda f: F.array_join(F.transform("h", f), "|")
    heads = heads.select(*page, joined(lambda x: F.coalesce(present(x["profile_url"]), x["name"], none)).alias("urls"), joined(lambda x: F.coalesce(x["name"], none)).alias("names"))
    head = rows.groupBy(*page).agg(end(F.max).alias("last"), end(F.min).alias("top"), F.count(F.lit(1)).alias("n")).join(heads, page)
    one = head.where("page_num = 1").select("listing_id", *(F.col(c).alias(f"{c}1") for c in ("urls", "names", "last", "top", "n")))
    head = pages.select("listing_id", "page_num").distinct().join(head, ["listing_id", "page_num"], "left") if pages is not None else head
    d = head.join(one, "listing_id", "left")
    same_end = lambda c: F.col(c).eqNullSafe(present(F.col(f"{c}1")))
    verdict = (
        F.when(F.col("page_num") == 1, "first").when(F.col("n").isNull(), "empty").when(F.col("n1").isNull(), "valid").when(F.col("urls") == F.col("urls1"), "duplicate_urls")
        .when(F.col("names") == F.col("names1"), "duplicate_names").when(same_end("top") & same_end("last") & (F.col("n") == F.col("n1")), "duplicate_boundaries").otherwise("unique")
    )
    return d.select("listing_id", "page_num", verdict.alias("verdict"))
