"""Reports over contacts. Each is one aggregate, or an aggregate per key and a roll-up of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import quality_score
from ..functions.text import any_of, domain_type, email_domain, presence_confidence, present, validate_field

REPORTED = ["name", "email", "phone", "title", "location"]


def has(c: str) -> Column:
    return present(F.col(c)).isNotNull()


def share(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 4)


def contact_stats(df: DataFrame, extracted: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """A1: one row of counts. Levels are the rows' own `confidence`, else C7's; sources count where there is a `source` column; with the
    rows before dedup, also total_extracted and duplicates_removed, with the pages (one row each), pages_scraped."""
    level = F.col("confidence") if "confidence" in df.columns else presence_confidence(F.col("name"), F.col("email"), F.col("phone"))
    sources = [F.count_if(F.col("source") == k).alias(f"from_{k}") for k in ("html", "pdf", "merged")] if "source" in df.columns else []
    out = df.agg(
        F.count("*").alias("total"), F.count_if(has("email")).alias("with_email"), F.count_if(has("phone")).alias("with_phone"), F.count_if(has("email") & has("phone")).alias("with_both"),
        F.count_if(has("name") & has("email") & has("phone")).alias("complete"), *(F.count_if(level == k).alias(k) for k in ("high", "medium", "low")), *sources,
    )
    if pages is not None:
        out = out.crossJoin(pages.agg(F.count("*").alias("pages_scraped")))  # single rows
    if extracted is not None:
        out = out.crossJoin(extracted.agg(F.count("*").alias("total_extracted"))).withColumn("duplicates_removed", F.col("total_extracted") - F.col("total"))
    return out


def with_domain(df: DataFrame, personal: DataFrame | None = None, small: int = 200_000) -> DataFrame:
    """df with domain and domain_type. P3: `personal` (domain) has further domains of private persons; up to `small` of them (counted) are
    broadcast, more are joined by a shuffle, in which missing domains take no part."""
    d = df.withColumn("domain", email_domain(F.col("email")))
    kind = domain_type(F.col("domain"))
    if personal is None:
        return d.withColumn("domain_type", kind)
    own = personal.select(F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", "").alias("domain")).where("domain <> ''").distinct().withColumn("private_", F.lit(True))
    own = F.broadcast(own) if own.count() <= small else own
    known = d.where("domain is not null").join(own, "domain", "left").withColumn("domain_type", F.when(F.col("private_"), "personal").otherwise(kind)).drop("private_")
    return known.unionByName(d.where("domain is null").withColumn("domain_type", kind))


def domain_counts(df: DataFrame, personal: DataFrame | None = None) -> DataFrame:
    """A row per domain: contacts, first_row, domain_type."""
    return with_domain(df, personal).where("domain is not null").groupBy("domain", "domain_type").agg(F.count("*").alias("contacts"), F.min("row_id").alias("first_row"))


def domain_stats(df: DataFrame, personal: DataFrame | None = None) -> DataFrame:
    """A2: one row: addresses, distinct domains, business domains, contacts of either kind."""
    n = F.coalesce(F.sum("contacts"), F.lit(0))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("domain_type") == k, F.col("contacts"))), F.lit(0))
    rolled = domain_counts(df, personal).agg(n.alias("parsed"), F.count("*").alias("unique_domains"), F.count_if(F.col("domain_type") == "business").alias("business_domains"), of("business").alias("business_contacts"), of("personal").alias("personal_contacts"))
    return rolled.crossJoin(df.agg(F.count_if(has("email")).alias("with_email")))  # two single rows


def top_domains(df: DataFrame, n: int = 10, business: bool = False) -> DataFrame:
    """A3: the most frequent domains, ties to the one seen first, with their share of all addresses (or of business contacts)."""
    per = domain_counts(df)
    per = per.where("domain_type = 'business'") if business else per
    whole = per.agg(F.sum("contacts").alias("whole")) if business else df.agg(F.count_if(has("email")).alias("whole"))
    top = per.orderBy(F.desc("contacts"), "first_row").limit(n)
    return top.crossJoin(F.broadcast(whole)).select("domain", "contacts", share(F.col("contacts"), F.col("whole")).alias("share"))


def contacts_by_domain(df: DataFrame) -> DataFrame:
    """A4: contacts with their domain and its number of contacts."""
    return with_domain(df).where("domain is not null").join(domain_counts(df).select("domain", "contacts"), "domain").select("row_id", "domain", "contacts")


def multi_contact_domains(df: DataFrame, least: int = 2) -> DataFrame:
    """A5: domains with at least so many contacts."""
    return domain_counts(df).where(F.col("contacts") >= least).select("domain", "contacts", (F.col("domain_type") == "business").alias("business"))


def field_success(df: DataFrame, fields: list[str] = REPORTED) -> DataFrame:
    """Per field how many rows have it, of how many, and a warning under half."""
    rows = df.agg(F.count("*").alias("total"), *(F.count_if(has(c)).alias(c) for c in fields))
    d = rows.select("total", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("extracted")) for c in fields))).alias("x")).select("x.field", "x.extracted", "total")
    return d.withColumn("rate", share(F.col("extracted"), F.col("total"))).withColumn("warn", F.col("rate") < 0.5)


def enrichment_stats(long: DataFrame) -> DataFrame:
    """Per field and action the number of contacts."""
    return long.groupBy("field", "action").agg(F.count("*").alias("contacts"))


def contacts_by_action(long: DataFrame) -> DataFrame:
    """How many contacts have at least one field of each action."""
    kinds = ("ENRICHED", "VALIDATED", "CLEANED", "REPLACED")
    per = long.groupBy("row_id").agg(*(F.coalesce(F.bool_or(F.col("action") == k), F.lit(False)).alias(k) for k in kinds))
    return per.agg(F.count("*").alias("processed"), *(F.count_if(k).alias(k.lower()) for k in kinds))


def flag_counts(long: DataFrame) -> DataFrame:
    """How often each flag was raised."""
    return long.where("flag is not null").groupBy("flag").agg(F.count("*").alias("contacts"))


def enrichment_rate(enriched: DataFrame) -> DataFrame:
    """How many of all contacts met a profile."""
    return enriched.agg(F.count("*").alias("total"), F.count_if("has_profile").alias("enriched")).select("total", "enriched", share(F.col("enriched"), F.col("total")).alias("rate"))


def enrichment_summary(long: DataFrame) -> DataFrame:
    """Per action its count and share of all fields; BOTH_MISSING is listed with none."""
    actions = F.explode(F.array(*(F.lit(a) for a in ("ENRICHED", "VALIDATED", "CLEANED", "REPLACED", "UNCHANGED", "BOTH_MISSING"))))
    counts = long.groupBy("action").agg(F.count("*").alias("n"))
    named = long.sparkSession.range(1).select(actions.alias("action"))
    whole = counts.agg(F.sum("n").alias("whole"))
    return named.join(counts, "action", "left").crossJoin(F.broadcast(whole)).select("action", F.coalesce("n", F.lit(0)).alias("fields"), share(F.coalesce("n", F.lit(0)), F.col("whole")).alias("share"))


def field_breakdown(enriched: DataFrame) -> DataFrame:
    """Per field original and merged presence, cleaned rows, fill rates and improvement."""
    per = [
        F.struct(F.lit(c).alias("field"), has(c).alias("o"), F.col(f"merged_{c}.value").isNotNull().alias("e"), F.col(f"merged_{c}.action").alias("a"))
        for c in REPORTED
    ]
    d = enriched.select(F.explode(F.array(*per)).alias("x")).select("x.*")
    o, e, n = F.count_if("o"), F.count_if("e"), F.count("*")
    return d.groupBy("field").agg(
        o.alias("original"), e.alias("enriched"), F.count_if(F.col("a") == "CLEANED").alias("contaminated"), F.count_if(F.col("a") == "REPLACED").alias("replaced"),
        share(o, n).alias("fill_before"), share(e, n).alias("fill_after"), share(e - o, n).alias("improvement"),
    )


def data_quality(df: DataFrame, level: Column, review: DataFrame | None = None, first: int = 10) -> DataFrame:
    """A10: weighted completeness, prevailing confidence (none for an empty table) and score of a table; `level` is each row's confidence.
    With `review` (row_id, needs_review, flags), also the number of issues and the first ones by row_id: contact and reason."""
    weights = {"name": 0.3, "email": 0.3, "phone": 0.2, "title": 0.1, "location": 0.1}
    d = df.withColumn("level_", level).agg(F.count("*").alias("n"), *(F.count_if(has(c)).alias(c) for c in weights), *(F.count_if(F.col("level_") == k).alias(f"l_{k}") for k in ("high", "medium", "low")))
    full = sum((F.col(c) / F.greatest(F.col("n"), F.lit(1)) * w for c, w in weights.items()), F.lit(0.0))
    overall = F.when(F.col("n") == 0, "none").when(F.col("l_low") > F.col("l_high"), "low").when(F.col("l_medium") > F.col("l_high"), "medium").otherwise("high")
    factor = F.when(overall == "high", 1.0).when(overall == "medium", 0.8).otherwise(0.6)
    out = d.select("n", F.round(full, 4).alias("completeness"), overall.alias("confidence"), F.round(full * factor * 100, 2).alias("score"))
    if review is not None:
        bad = df.select("row_id", F.coalesce(present(F.col("name")), F.lit("Unknown")).alias("contact")).join(review.where("needs_review").select("row_id", "flags"), "row_id")
        bad = bad.withColumn("reason", F.when(F.size("flags") > 0, F.array_join("flags", ", ")).otherwise("needs review"))
        some = bad.orderBy("row_id").limit(first).agg(F.array_sort(F.collect_list(F.struct("row_id", "contact", "reason"))).alias("issues"))  # `first` rows
        out = out.crossJoin(bad.agg(F.count("*").alias("issue_count"))).crossJoin(some)  # single rows
    return out


def recommendations(long: DataFrame, df: DataFrame, processed: int | None = None, errors: int = 0) -> DataFrame:
    """What the figures call for, or success: addresses under half, over 10 % of contacts with a replaced field, errors over 10 % of
    what was processed, over 20 % of contacts of low confidence."""
    per = long.groupBy("row_id").agg(F.coalesce(F.bool_or(F.col("action") == "REPLACED"), F.lit(False)).alias("r"), F.count("confidence").alias("k"), F.count_if(F.col("confidence") == "low").alias("low"))
    m = per.agg(F.count("*").alias("n"), F.count_if("r").alias("r"), F.count_if((F.col("k") == 0) | (2 * F.col("low") > F.col("k"))).alias("low"))
    d = m.crossJoin(df.agg(F.count("*").alias("rows"), F.count_if(has("email")).alias("mail")))  # two single rows
    often = F.lit(errors) > 0.1 * (F.lit(processed) if processed is not None else F.col("n"))
    said = F.array(
        F.when((F.col("mail") < 0.5 * F.col("rows")) | (F.col("rows") == 0), F.lit("low_email_coverage")), F.when(F.col("r") > 0.1 * F.col("rows"), F.lit("many_replacements")), F.when(F.lit(errors > 0) & often, F.lit("high_error_rate")),
        F.when(F.col("low") > 0.2 * F.col("rows"), F.lit("low_confidence")),
    )
    said = F.filter(said, lambda x: x.isNotNull())
    return d.select(F.explode(F.when(F.size(said) == 0, F.array(F.lit("success"))).otherwise(said)).alias("recommendation"))


def error_summary(errors: DataFrame, first: int = 5) -> DataFrame:
    """Per type the number of errors and the messages of the first ones by row_id."""
    firsts = F.slice(F.array_sort(F.collect_list(F.when(F.col("r_") <= first, F.struct("row_id", "message")))), 1, first)
    ranked = errors.withColumn("r_", F.row_number().over(Window.partitionBy("type").orderBy("row_id"))).where(F.col("r_") <= first)
    samples = ranked.groupBy("type").agg(firsts.alias("f")).select("type", F.transform("f", lambda x: x["message"]).alias("samples"))
    return errors.groupBy("type").agg(F.count("*").alias("errors")).join(samples, "type")


def review_queue(long: DataFrame) -> DataFrame:
    """Contacts to look at with their flags in field order."""
    return long.where("review").groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_list("flag")), ",").alias("flags"))


EXTRACTED = ("email", "phone")
REMOVALS = ("titleSuffix", "credentialSuffix", "email", "phone", "spam")


def _of_type(kind: str):
    return lambda r: r["type"] == kind


def _changed(taken: Column, original: Column, value: Column, modified: Column) -> Column:
    """Whether a field counts as modified: what is taken out of its text also does when nothing was found."""
    return original.isNotNull() & F.when(taken, value.isNull() | modified).otherwise(modified)


def cleaning_report(cleaned: DataFrame, fields: list[str] = REPORTED) -> DataFrame:
    """Per field of clean_<field> structs: extracted (addresses and phones that were changed), nullified, modified, unchanged (what
    was empty counts as such), removals by type, and an alert over 10 % nullified."""
    kinds = [F.size(F.filter(F.col("rm"), _of_type(k))).alias(k) for k in REMOVALS]
    d = cleaned.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"clean_{c}.value").alias("v"), F.col(f"clean_{c}.original").alias("o"), F.col(f"clean_{c}.modified").alias("m"), F.col(f"clean_{c}.removed").alias("rm")) for c in fields))).alias("x")).select("x.*")
    had, gone = F.col("o").isNotNull(), F.col("o").isNotNull() & F.col("v").isNull()
    taken = F.col("field").isin(*EXTRACTED)
    changed = _changed(taken, F.col("o"), F.col("v"), F.col("m"))
    out = d.select("field", had.alias("had"), gone.alias("gone"), changed.alias("changed"), taken.alias("taken"), *(F.when(~taken & had & F.col("m"), k).otherwise(0).alias(n) for k, n in zip(kinds, REMOVALS, strict=True)))
    return out.groupBy("field").agg(
        F.count("*").alias("total"), F.count_if(F.col("taken") & F.col("changed") & ~F.col("gone")).alias("extracted"), F.count_if("gone").alias("nullified"), F.count_if("changed").alias("modified"), F.count_if(~F.col("changed")).alias("unchanged"),
        F.map_from_arrays(F.array(*map(F.lit, REMOVALS)), F.array(*map(F.sum, REMOVALS))).alias("removals"), (F.count_if("gone") > 0.1 * F.count_if("had")).alias("alert"),
    )


def cleaning_summary(cleaned: DataFrame, fields: list[str] = REPORTED) -> DataFrame:
    """Rows and fields modified. A value that was only given up doesn't make its row a modified one, but its field."""
    row = any_of([F.coalesce(F.col(f"clean_{c}.modified"), F.lit(False)) for c in fields])
    each = [_changed(F.lit(c in EXTRACTED), *(F.col(f"clean_{c}.{k}") for k in ("original", "value", "modified"))) for c in fields]
    d = cleaned.select(row.alias("row"), sum((F.when(c, 1).otherwise(0) for c in each), F.lit(0)).alias("fields"))
    return d.agg(F.count("*").alias("contacts"), F.count_if("row").alias("contacts_modified"), F.count_if(~F.col("row")).alias("contacts_unchanged"), F.coalesce(F.sum("fields"), F.lit(0)).alias("fields_modified"))


def extraction_quality(df: DataFrame) -> DataFrame:
    """100, less 20 for names under half, 15 for addresses under 30 %, 10 for any invalid address, with the issues; high from 80, medium
    from 50, else low; an empty table is none with a score of 0."""
    bad = F.count_if(has("email") & ~F.col("email").rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+\z"))
    d = df.agg(F.count("*").alias("n"), F.count_if(has("name")).alias("names"), F.count_if(has("email")).alias("mails"), bad.alias("invalid"))
    rate = lambda c: F.floor(100 * F.col(c) / F.greatest(F.col("n"), F.lit(1)) + 0.5).cast("string")
    cases = [(F.col("names") < 0.5 * F.col("n"), 20, F.concat(F.lit("names "), rate("names"), F.lit("%"))), (F.col("mails") < 0.3 * F.col("n"), 15, F.concat(F.lit("addresses "), rate("mails"), F.lit("%"))), (F.col("invalid") > 0, 10, F.lit("invalid addresses"))]
    s = sum((-F.when(c, n).otherwise(0) for c, n, _ in cases), F.lit(100))
    empty = F.col("n") == 0
    issues = F.when(empty, F.array(F.lit("no contacts"))).otherwise(F.filter(F.array(*(F.when(c, t) for c, _, t in cases)), lambda x: x.isNotNull()))
    return d.select("n", "invalid", F.when(empty, 0).otherwise(s).alias("score"), F.when(empty, "none").when(s >= 80, "high").when(s >= 50, "medium").otherwise("low").alias("band"), issues.alias("issues"))


def validation_issues(df: DataFrame) -> DataFrame:
    """Names under 80 %, urls under half, contaminated rows."""
    dirty = F.col("name").rlike(r"(?i)(partner|associate|counsel)") | F.col("location").rlike(r"\+\d")
    d = df.agg(F.count("*").alias("n"), F.count_if(has("name")).alias("names"), F.count_if(has("profile_url")).alias("urls"), F.count_if(dirty).alias("dirty"))
    issues = F.array(F.when(F.col("names") < 0.8 * F.col("n"), F.lit("few_names")), F.when(F.col("urls") < 0.5 * F.col("n"), F.lit("few_urls")), F.when(F.col("dirty") > 0, F.concat(F.lit("contaminated:"), F.col("dirty").cast("string"))))
    return d.select(F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))


def field_coverage(df: DataFrame, fields: list[str] = REPORTED) -> DataFrame:
    """Per field the valid rows and coverage, and the first five valid samples by row_id."""
    x = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields)))
    d = df.select("row_id", x.alias("x")).select("row_id", "x.*").withColumn("ok", validate_field(F.col("field"), F.col("value"))["valid"])
    first = Window.partitionBy("field").orderBy("row_id")  # a row limit in the window leaves five rows of each field per task
    some = d.where("ok").withColumn("r", F.row_number().over(first)).where("r <= 5").groupBy("field").agg(F.array_sort(F.collect_list(F.struct("r", "value"))).alias("s"))
    counts = d.groupBy("field").agg(F.count_if("ok").alias("valid"), F.count("*").alias("total"), share(F.count_if("ok"), F.count("*")).alias("coverage"))
    return counts.join(some.select("field", F.transform("s", lambda x: x["value"]).alias("samples")), "field", "left")


def score_contacts(df: DataFrame) -> DataFrame:
    """C27 for a table: row_id, score, overall; without a phone check the phone is taken to fit if it is there."""
    q = quality_score(*(F.col(c) for c in ("name", "location", "email", "phone")), phone_fits=has("phone"))
    return df.select("row_id", q.alias("q")).select("row_id", "q.score", "q.overall")
