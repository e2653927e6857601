"""Profiles joined to contacts under an auditable merge, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clean_location_profile, detect_noise, split_name_title
from ..functions.text import digits, no_text, present
from .fingerprint import page_fingerprint_check  # noqa: F401
from .matching import plain_name
from .postclean import post_clean

FIELDS = ["name", "email", "phone", "title", "location", "bio"]
LISTS = ["education", "practice_areas", "bar_admissions"]


def no_list() -> Column:
    return F.lit(None).cast("array<string>")


def outcome(value: Column, action: str, confidence: str | None, original: Column | None = None, removed: Column | None = None, flag: Column | None = None) -> Column:
    original, flag = (no_text() if c is None else c for c in (original, flag))
    removed = no_list() if removed is None else removed
    return F.struct(
        value.alias("value"), F.lit(action).alias("action"), F.lit(confidence).cast("string").alias("confidence"), original.alias("original"),
        removed.alias("removed"), flag.alias("flag"), F.lit(action == "REPLACED").alias("review"),
    )


def agree(field: str, a: Column, b: Column) -> Column:
    if field == "email":
        return F.lower(a) == F.lower(b)
    if field == "phone":
        return (F.right(digits(a), F.lit(10)) == F.right(digits(b), F.lit(10))) & (digits(a) != "")
    return a == b


def decide(field: str, o: Column, p: Column, clean: Column, dirty: Column, removed: Column, noise: Column) -> Column:
    """The first rule that holds, from the trimmed original and profile values and what the cleaners found."""
    more = F.contains(o, p) & (F.length(o) > F.length(p))
    return (
        F.when(o.isNull() & p.isNotNull(), outcome(p, "ENRICHED", "high"))
        .when(o.isNull(), outcome(no_text(), "UNCHANGED", None))
        .when(agree(field, o, p), outcome(o, "VALIDATED", "high"))
        .when(p.isNull(), outcome(o, "UNCHANGED", "medium"))
        .when(dirty | more, outcome(F.coalesce(F.when(dirty, clean), p), "CLEANED", "high", o, removed))
        .when(F.size(noise) > 0, outcome(p, "CLEANED", "medium", o, F.transform(noise, lambda n: n["matched"])))
        .when(F.contains(F.lower(p), F.lower(o)), outcome(p, "ENRICHED", "medium", o))
        .when(F.contains(F.lower(o), F.lower(p)), outcome(o, "VALIDATED", "medium"))
        .otherwise(outcome(p, "REPLACED", "low", o, flag=F.lit(f"{field}_mismatch")))
    )


def enrich(contacts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Contacts left-joined to their profile (one per url, the least by value if repeated). Adds has_profile and, per field, merged_<field>,
    a struct of value, action, confidence, original, removed, flag and review. An extracted title fills a title that is still missing. The
    lists of LISTS that a contact doesn't have come from the profile as they are; an empty list is one."""
    lists = [c for c in LISTS if c in profiles.columns]
    cols = [c for c in FIELDS if c in profiles.columns] + lists
    one = profiles.where(F.col("profile_url").isNotNull()).groupBy("profile_url").agg(F.min(F.struct(*cols)).alias("profile_"))
    d = contacts.join(one, "profile_url", "left")
    value = lambda c: present(F.trim(F.col(c) if c in contacts.columns else no_text()))
    d = d.withColumns({f"o_{c}": value(c) for c in FIELDS} | {f"p_{c}": present(F.trim(F.col(f"profile_.{c}") if c in cols else no_text())) for c in FIELDS})
    d = d.withColumns({"n_": split_name_title(F.col("o_name")), "l_": clean_location_profile(F.col("o_location"))})  # once, the rules refer to them
    d = d.withColumns({f"z_{c}": detect_noise(F.lit(c), F.col(f"o_{c}"), F.col("o_phone"), F.col("o_email"))["items"] for c in FIELDS})
    has_phone = F.exists(F.col("l_.removed"), lambda x: x.startswith("phone: "))
    found = {"name": (F.col("n_.name"), F.col("n_.contaminated"), no_list()), "location": (F.col("l_.location"), has_phone, F.col("l_.removed"))}
    for c in FIELDS:
        clean, dirty, removed = found.get(c, (no_text(), F.lit(False), no_list()))
        d = d.withColumn(f"merged_{c}", decide(c, F.col(f"o_{c}"), F.col(f"p_{c}"), clean, dirty, removed, F.col(f"z_{c}")))
    taken = (F.col("merged_name.action") == "CLEANED") & F.col("n_.contaminated")
    title = F.coalesce(F.col("merged_title.value"), F.when(taken, F.col("n_.title")))
    d = d.withColumn("merged_title", F.col("merged_title").withField("value", title)).withColumn("has_profile", F.col("profile_").isNotNull())
    filled = {c: F.coalesce(F.col(c), F.col(f"profile_.{c}")) if c in contacts.columns else F.col(f"profile_.{c}") for c in lists}
    own = [filled.pop(c).alias(c) if c in filled else F.col(c) for c in contacts.columns]
    return d.select(*own, *(v.alias(c) for c, v in filled.items()), "has_profile", *(f"merged_{c}" for c in FIELDS))


def actions_long(enriched: DataFrame) -> DataFrame:
    """A row per contact and field: row_id, field, value, action, confidence, original, flag, review."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"merged_{c}").alias("m")) for c in FIELDS)))
    return enriched.select("row_id", pairs.alias("x")).select("row_id", F.col("x.field").alias("field"), "x.m.value", "x.m.action", "x.m.confidence", "x.m.original", "x.m.flag", "x.m.review")


def majority_confidence(levels: Column) -> Column:
    """Low if more than half are low, high if more than half are high, else medium; none at all: low."""
    known = F.filter(levels, lambda x: x.isNotNull())
    n = lambda k: F.size(F.filter(known, lambda x: x == k))
    return F.when(F.size(known) == 0, "low").when(2 * n("low") > F.size(known), "low").when(2 * n("high") > F.size(known), "high").otherwise("medium")


def enrichment_metadata(enriched: DataFrame) -> DataFrame:
    """Actions, removed noise ("x from field"), flags, review, overall confidence and that of each field, details, and the audit map.

    details: per field old and new value, what was removed, action, source (profile or original) and a note where a title came from the name.
    audit: the originals of changed fields; a field that was null and is filled keeps its key, with null.
    """
    m = lambda k: [F.col(f"merged_{c}.{k}") for c in FIELDS]
    names = F.array(*(F.lit(c) for c in FIELDS))
    none = F.array().cast("array<string>")
    said = lambda c: F.transform(F.coalesce(F.col(f"merged_{c}.removed"), none), lambda x: F.concat(x, F.lit(f" from {c}")))
    removed = F.concat(*(said(c) for c in FIELDS))
    raw = {c: F.col(c) if c in enriched.columns else no_text() for c in FIELDS}
    filled = {c: (F.col(f"merged_{c}.action") == "ENRICHED") & raw[c].isNull() if c in enriched.columns else F.lit(False) for c in FIELDS}
    audit = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"merged_{c}.original").alias("was"), filled[c].alias("filled")) for c in FIELDS))
    audit = F.map_from_entries(F.transform(F.filter(audit, lambda e: e["was"].isNotNull() | e["filled"]), lambda e: F.struct(e["field"], e["was"])))

    def detail(c: str) -> Column:
        x = F.col(f"merged_{c}")
        source = F.when(x["action"].isin("VALIDATED", "UNCHANGED"), "original").otherwise("profile")
        note = F.when((x["action"] == "UNCHANGED") & x["original"].isNull() & raw[c].isNull() & x["value"].isNotNull(), "extracted from the name's end") if c == "title" else no_text()
        return F.struct(F.coalesce(x["original"], present(raw[c])).alias("old"), F.coalesce(x["removed"], none).alias("removed"), x["value"].alias("new"), x["action"].alias("action"), source.alias("source"), note.alias("note"))

    sure = F.map_filter(F.map_from_arrays(names, F.array(*m("confidence"))), lambda k, v: v.isNotNull())
    return enriched.select(
        "row_id", F.map_from_arrays(names, F.array(*m("action"))).alias("actions"), removed.alias("removed"),
        F.filter(F.array(*m("flag")), lambda x: x.isNotNull()).alias("flags"), F.exists(F.array(*m("review")), lambda x: x).alias("needs_review"),
        majority_confidence(F.array(*m("confidence"))).alias("overall"), sure.alias("confidences"), F.map_from_arrays(names, F.array(*map(detail, FIELDS))).alias("details"), audit.alias("audit"),
    )


def fallback_clean(enriched: DataFrame) -> DataFrame:
    """Rows with an address that met no profile get the cleaned name and location; rows without an address stay, with a reason."""
    d = enriched.where(~F.col("has_profile")).withColumns({"n_": split_name_title(F.col("name")), "l_": clean_location_profile(F.col("location"))})
    url = present(F.col("profile_url")).isNotNull()
    return d.select(
        "row_id", F.when(url, F.col("n_.name")).otherwise(F.col("name")).alias("name"), F.when(url, F.coalesce(present(F.col("title")), F.col("n_.title"))).otherwise(F.col("title")).alias("title"),
        F.when(url, F.col("l_.location")).otherwise(F.col("location")).alias("location"), F.when(~url, "no_profile_url").alias("reason"),
    )


def fill_from_profile(contacts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Only missing email, phone and name are filled; the source says from where."""
    one = profiles.where(F.col("profile_url").isNotNull()).groupBy("profile_url").agg(F.min(F.struct("email", "phone", "name")).alias("p_"))
    d = contacts.join(one, "profile_url", "left")
    own = {c: present(F.col(c)) for c in ("email", "phone", "name")}
    filled = F.concat_ws(",", *(F.when(v.isNull() & F.col(f"p_.{c}").isNotNull(), F.lit(c)) for c, v in own.items()))
    return d.select("row_id", *(F.coalesce(v, F.col(f"p_.{c}")).alias(c) for c, v in own.items()), F.when(filled != "", "profile-page").alias("source"), filled.alias("filled"))


def words_of(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(plain_name(c), r"\s+"), lambda w: F.length(w) > 1))


def match_profiles_by_name(contacts: DataFrame, links: DataFrame, least: float = 0.8) -> DataFrame:
    """Contacts without an address to the link whose words overlap most (Jaccard), at least `least`, ties to the first position.

    Rows meet only in words they share, so nothing is compared that has none in common; rows with equal word sets count once.
    """
    side = lambda d, ident, text: d.select(F.array_sort(words_of(F.col(text))).alias("w"), F.col(ident).alias("ident")).where(F.size("w") > 0)
    c = side(contacts.where(present(F.col("profile_url")).isNull()), "row_id", "name")
    li = side(links, "position", "text").groupBy("w").agg(F.min("ident").alias("position"))
    distinct = c.select("w").distinct()
    # a Jaccard of t needs one of the first n - ceil(t n) + 1 words of either sorted set in the other's
    heads = lambda w: F.slice(w, 1, (F.size(w) - F.ceil(F.size(w) * least) + 1).cast("int"))
    a = distinct.select(F.col("w").alias("cw"), F.explode(heads(F.col("w"))).alias("t"))
    b = li.select(F.col("w").alias("lw"), "position", F.explode(heads(F.col("w"))).alias("t"))
    both = a.join(b, "t").select("cw", "lw", "position").distinct()
    score = F.size(F.array_intersect("cw", "lw")) / F.size(F.array_union("cw", "lw"))
    best = both.withColumn("score", score).where(F.col("score") >= least).groupBy("cw").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("position"))).alias("m"))
    return c.join(best, c["w"] == best["cw"]).select(F.col("ident").alias("row_id"), F.col("m.position").alias("position"), F.round(-F.col("m.s"), 4).alias("score"))


def needs_visit(contacts: DataFrame, even_with_email: bool = False, done: DataFrame | None = None) -> DataFrame:
    """Rows with an address and, unless told otherwise, no email; minus the urls already done."""
    d = contacts.where(present(F.col("profile_url")).isNotNull())
    d = d if even_with_email else d.where(present(F.col("email")).isNull())
    return d.join(done.select("profile_url").distinct(), "profile_url", "left_anti") if done is not None else d


CORE = ["name", "email", "phone", "title", "location", "profile_url"]
ASIDE = {"row_id", "enrichment", "domain", "domain_type", "confidence", "source"}


def union_fields(contacts: DataFrame) -> list[str]:
    """The fields to enrich: the core fields, then the table's other plain columns in order, without ids, metadata and nested ones."""
    plain = [f.name for f in contacts.schema if f.name not in ASIDE and not f.name.startswith("_") and not f.dataType.typeName() in ("struct", "array", "map")]
    return list(dict.fromkeys([*CORE, *plain]))


def enrich_flow(contacts: DataFrame, profiles: DataFrame) -> dict[str, DataFrame]:
    """The tables of an enrichment run: contacts (merged, places and phones cleaned and scored), report (actions per field) and
    review (the fields that a person should look at, with both values)."""
    d = enrich(contacts, profiles)
    merged = d.select("row_id", *(F.col(f"merged_{c}.value").alias(c) for c in FIELDS[:5]), "profile_url")
    rows = actions_long(d)
    review = rows.where("review").select("row_id", "field", "value", "original", "flag")
    return {"contacts": post_clean(merged), "report": rows.groupBy("field", "action").agg(F.count("*").alias("contacts")), "review": review}
