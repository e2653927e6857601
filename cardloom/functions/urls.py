"""Listing addresses as Column expressions and row operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed as V
from .text import let, no_text, present

# Sites whose way of paging is known.
KNOWN_SITES = {
    "sullcrom.com": "infinite-scroll", "skadden.com": "infinite-scroll", "weil.com": "infinite-scroll", "paulweiss.com": "pagination",
    "kirkland.com": "pagination", "linklaters.com": "pagination", "clearygottlieb.com": "pagination", "debevoise.com": "pagination",
    "cravath.com": "pagination", "compass.com": "pagination", "zillow.com": "pagination", "realtor.com": "pagination",
}
SIZE_PARAMS = ["pageSize", "limit", "perPage", "count", "size", "results", "show", "per_page", "page_size"]
PARAM = "struct<pos:int,name:string,value:string>"


def lowered(names: list[str]) -> list[str]:
    return [*dict.fromkeys(n.lower() for n in names)]


def param_type(name: Column) -> Column:
    """Page, offset or size by a case-insensitive list, else null."""
    n = F.lower(name)
    return F.when(n.isin(lowered(V.PAGE_PARAMS)), "page").when(n.isin(lowered(V.OFFSET_PARAMS)), "offset").when(n.isin(lowered(SIZE_PARAMS)), "size")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def domain(url: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def params(url: Column) -> Column:
    """The query's (pos, name, value) in order; names and values are decoded; no query, or no address, gives an empty array."""
    parts = F.filter(F.split(F.try_parse_url(url, F.lit("QUERY")), "&"), lambda p: p != "")
    decoded = lambda c: F.coalesce(F.try_url_decode(c), c)
    one = lambda p, i: F.struct(i.alias("pos"), decoded(F.substring_index(p, "=", 1)).alias("name"), F.when(F.instr(p, "=") > 0, decoded(F.substr(p, F.instr(p, "=") + 1))).otherwise("").alias("value"))
    return F.coalesce(F.transform(parts, one), F.array().cast(f"array<{PARAM}>"))


def url_params(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row per query parameter."""
    return pages.select(id_col, F.explode(params(F.col(url_col))).alias("p")).select(id_col, "p.pos", "p.name", "p.value")


def page_param(url: Column) -> Column:
    """U4: struct(type, name, value) of the first numeric page or offset parameter, or null."""
    good = F.filter(params(url), lambda p: param_type(p["name"]).isin("page", "offset") & p["value"].rlike(r"^\d+\z"))
    first = F.get(good, 0)
    kind = F.when(param_type(first["name"]) == "page", "parameter").otherwise("offset")
    return F.when(first.isNotNull(), F.struct(kind.alias("type"), first["name"].alias("name"), first["value"].cast("long").alias("value")))


def suggest_pagination(url: Column) -> Column:
    """struct(type, confidence): a known site's (it or a domain under it), else pagination if a page or offset parameter stands in the query, else single-page."""
    d = domain(url)
    known = F.coalesce(*(F.when((d == s) | d.endswith("." + s), F.lit(t)) for s, t in KNOWN_SITES.items()))
    paged = F.exists(params(url), lambda p: param_type(p["name"]).isin("page", "offset"))
    kind = F.coalesce(known, F.when(paged, "pagination"), F.lit("single-page"))
    return F.struct(kind.alias("type"), F.when(known.isNotNull() | paged, "high").otherwise("low").alias("confidence"))


def path_page(url: Column) -> Column:
    """struct(pattern, page) of a path that holds /page/N or /p/N; the pattern replaces the first /N of the path."""
    path = F.try_parse_url(url, F.lit("PATH"))
    n = present(F.regexp_extract(path, r"(?i)/(?:page|p)/(\d+)", 1))
    before = F.regexp_extract(path, r"^(.*?)/\d+", 1)
    after = F.regexp_extract(path, r"^.*?/\d+(.*)\z", 1)
    return F.when(n.isNotNull(), F.struct(F.concat(before, F.lit("/{page}"), after).alias("pattern"), n.cast("long").alias("page")))


def query_text(ps: Column) -> Column:
    return F.array_join(F.transform(ps, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")


def with_query(url: Column, ps: Column) -> Column:
    q = query_text(ps)
    return F.when(q == "", F.regexp_replace(url, r"\?.*", "")).otherwise(F.concat(F.regexp_replace(url, r"\?.*", ""), F.lit("?"), q))


def base_url(url: Column, drop: list[str] | None = None) -> Column:
    """The address without page and offset parameters (exact names), or without those named; not an address: unchanged."""
    names = drop or [*V.PAGE_PARAMS, *V.OFFSET_PARAMS]
    return F.when(host(url).isNull(), url).otherwise(with_query(url, F.filter(params(url), lambda p: ~p["name"].isin(names))))


def set_param(url: Column, name: Column, value: Column) -> Column:
    """The address with one parameter set: in place of its first occurrence, else at the end; further ones go."""
    ps = params(url)
    at = F.array_position(F.transform(ps, lambda p: p["name"]), name)
    put = F.struct(F.lit(0).alias("pos"), name.alias("name"), value.alias("value"))
    kept = F.filter(ps, lambda p: (p["name"] != name) | (p["pos"] == at - 1))
    changed = F.transform(kept, lambda p: F.when(p["name"] == name, put).otherwise(p))
    return with_query(url, F.when(F.coalesce(at, F.lit(0)) > 0, changed).otherwise(F.concat(ps, F.array(put))))


def page_urls(patterns: DataFrame, first: int, last: int) -> DataFrame:
    """U8: a row per page of each (type, name, url, size) pattern: parameter, offset ((n - 1) * size) or path ({page} in url)."""
    each = patterns.withColumn("page", F.explode(F.sequence(F.lit(first), F.lit(last))))
    n = F.col("page").cast("string")
    skip = ((F.col("page") - 1) * F.col("size")).cast("string")
    out = F.when(F.col("type") == "parameter", set_param(F.col("url"), F.col("name"), n)).when(F.col("type") == "offset", set_param(F.col("url"), F.col("name"), skip))
    return each.withColumn("page_url", out.when(F.col("type") == "path", F.replace(F.col("url"), F.lit("{page}"), n)))


PATTERN = "struct<type:string,name:string,base_url:string,page:bigint,size:int,confidence:double,method:string>"


def choose_pattern(d: DataFrame) -> DataFrame:
    """Adds `pattern`, how a listing is paged, by the first of: settings by hand (`manual`, a map of page, offset, cursor or path to a
    name), a `cached` struct(type, name), a numeric parameter of the `url`, the change from it to the next page's address (`next_url`), a
    `scroll` score of 4 or more, a page number in the path. Null if none says so. Inputs may be null."""
    url, manual, cached, scroll_score = (F.col(c) for c in ("url", "manual", "cached", "scroll"))
    d = d.withColumns({"own_": page_param(url), "step_": compare_urls(url, F.col("next_url")), "path_": path_page(url), "base_": base_url(url)})
    plain, null = F.regexp_replace(url, r"[?#].*", ""), lambda t: F.lit(None).cast(t)

    def pattern(kind: Column, name: Column, base: Column, page: Column, size: Column, confidence: Column, method: str) -> Column:
        return F.struct(kind.alias("type"), name.alias("name"), base.alias("base_url"), page.cast("long").alias("page"), size.cast("int").alias("size"), confidence.cast("double").alias("confidence"), F.lit(method).alias("method")).cast(PATTERN)

    by_hand = [
        F.when(manual[k].isNotNull(), pattern(F.lit(t), manual[k], plain if k != "path" else manual[k], null("long"), F.lit(10) if k == "offset" else null("int"), null("double"), "manual"))
        for k, t in (("page", "parameter"), ("offset", "offset"), ("cursor", "cursor"), ("path", "path"))
    ]
    known = F.when(cached.isNotNull(), pattern(cached["type"], cached["name"], F.col("base_"), null("long"), null("int"), null("double"), "cache"))
    own, step, path = F.col("own_"), F.col("step_"), F.col("path_")
    by_param = F.when(own.isNotNull(), pattern(own["type"], own["name"], url, own["value"], null("int"), F.lit(1.0), "url-parameter"))
    sure = lambda method, kind: pattern_confidence(F.lit(method), kind, F.lit(method == "navigation"), F.lit(False), F.lit(method == "navigation")) / 100
    by_next = F.when(step.isNotNull(), pattern(step["type"], step["name"], plain, null("long"), step["size"], sure("navigation", step["type"]), "navigation"))
    by_scroll = F.when(scroll_score >= 4, pattern(F.lit("infinite-scroll"), null("string"), url, null("long"), null("int"), scroll_score / 10, "infinite-scroll-detection"))
    by_path = F.when(path.isNotNull(), pattern(F.lit("path"), null("string"), path["pattern"], path["page"], null("int"), sure("url-analysis", F.lit("path")), "url-analysis"))
    return d.withColumn("pattern", F.coalesce(*by_hand, known, by_param, by_next, by_scroll, by_path)).drop("own_", "step_", "path_", "base_")


def pattern_confidence(method: Column, kind: Column, has_controls: Column, has_max: Column, has_next: Column) -> Column:
    """40/35/30/15 by method, 20/15 by type, 20 controls, 15 a greatest page, 10 a next link; at most 100."""
    s = F.when(method == "manual", 40).when(method == "cache", 35).when(method == "navigation", 30).when(method == "url-analysis", 15).otherwise(0)
    s = s + F.when(kind.isin("parameter", "path"), 20).when(kind == "offset", 15).otherwise(0)
    return F.least(F.lit(100), s + F.when(has_controls, 20).otherwise(0) + F.when(has_max, 15).otherwise(0) + F.when(has_next, 10).otherwise(0))


def overall_confidence(method: Column, found: Column, confirmed: Column, true_max: Column, capped: Column) -> Column:
    """30 for a pattern, 20/18/20/15 by method, 25 confirmed boundary, 15 a greatest page, 10 not capped."""
    s = F.when(found, 30).otherwise(0) + F.when(method.isin("manual", "navigation"), 20).when(method == "cache", 18).when(method == "url-analysis", 15).otherwise(0)
    return F.least(F.lit(100), s + F.when(confirmed, 25).otherwise(0) + F.when(true_max > 0, 15).otherwise(0) + F.when(~F.coalesce(capped, F.lit(False)), 10).otherwise(0))


def compare_urls(a: Column, b: Column) -> Column:
    """struct(type, name, size) of the first numeric parameter that changed from a to b: by one (or to 1) a page, from nothing by 2 to 100 an offset of that size; else the path's number that grew by one."""
    key = lambda p: F.concat(p["name"], F.lit("#"), p["pos"].cast("string"))
    numbers = lambda u: F.filter(params(u), lambda p: p["value"].rlike(r"^\d+\z"))
    old = F.map_from_entries(F.transform(numbers(a), lambda p: F.struct(key(p), p["value"].cast("long"))))

    def steps(old: Column) -> Column:
        """Parameters of b: name, before and by how much they grew."""
        return F.transform(numbers(b), lambda p: let(F.try_element_at(old, key(p)), lambda was: F.struct(p["name"].alias("name"), was.alias("was"), (p["value"].cast("long") - was).alias("step"))))

    paged = F.get(F.filter(let(old, steps), lambda p: (p["step"] == 1) | ((p["was"] == 0) & p["step"].between(2, 100))), 0)
    found = let(paged, lambda p: F.when(p.isNotNull(), F.struct(F.when(p["step"] == 1, "parameter").otherwise("offset").alias("type"), p["name"].alias("name"), F.when(p["step"] > 1, p["step"]).alias("size"))))
    in_path = lambda u: F.regexp_extract(F.try_parse_url(u, F.lit("PATH")), r"/(\d+)(?:/|\z)", 1)
    number = lambda c: F.try_to_number(c, F.lit("999999999"))
    path = let(in_path(a), lambda n: F.when((n != "") & (number(in_path(b)) == number(n) + 1), F.struct(F.lit("path").alias("type"), no_text().alias("name"), F.lit(None).cast("long").alias("size"))))
    return F.coalesce(found, path)


def path_prefix(url: Column) -> Column:
    """The path up to the first profile-like segment, or null."""
    segments = F.split(F.try_parse_url(url, F.lit("PATH")), "/")
    at = F.array_position(F.transform(segments, lambda s: F.lower(s).rlike(r"^(people|attorneys?|lawyers?|agents?|team|profiles?|staff|members?|professionals)\z")), True)
    return F.when(at > 0, F.array_join(F.slice(segments, 1, at.cast("int")), "/"))
