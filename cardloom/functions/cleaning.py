"""Repair of contaminated fields as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .text import any_of, digits, first_match, let, matches, no_text, normalize_phone, present

REMOVED = "array<struct<type:string,value:string>>"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def typed(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))


def result(original: Column, value: Column, removed: Column, modified: Column, valid: Column) -> Column:
    return F.struct(value.alias("value"), original.alias("original"), F.coalesce(modified, F.lit(False)).alias("modified"), F.coalesce(removed, F.array().cast(REMOVED)).alias("removed"), F.coalesce(valid, F.lit(False)).alias("valid"))


def without(c: Column, pattern: str) -> Column:
    """struct(gone, left): the matches, and the text without them."""
    return F.struct(matches(c, pattern).alias("gone"), F.regexp_replace(c, pattern, "").alias("left"))


def strip_all(c: Column, ends: str) -> Column:
    """struct(gone, left): the given ends in the order in which they were taken off, and the value without any number of them."""
    tail = first_match(c, rf"(?i)(?:{ends})+\z")
    return F.struct(F.reverse(matches(tail, rf"(?i){ends}")).alias("gone"), F.regexp_replace(c, rf"(?i)(?:{ends})+\z", "").alias("left"))


def clean_name(name: Column) -> Column:
    """C17 for names: without phones, addresses, repeated title and credential ends; interface phrases give null."""
    empty = F.array().cast("array<string>")

    def shown(v: Column, gone: list[Column], e: Column, spam: Column) -> Column:
        phones, emails, titles, credentials = gone
        credentials = F.transform(credentials, lambda x: F.regexp_replace(F.regexp_replace(x, r"^,?\s*", ""), r"(?i)(?<!esq|jr|sr)\.\z", ""))
        removed = F.concat(*(typed(k, F.coalesce(x, empty)) for k, x in (("phone", phones), ("email", emails), ("titleSuffix", titles), ("credentialSuffix", credentials), ("spam", F.when(spam, F.array(e))))))
        return let(spam | (e == ""), lambda bad: result(v, F.when(~bad, e), removed, F.when(bad, True).otherwise(v != e), ~bad))

    def last(v: Column, cuts: list[Column]) -> Column:
        return let(squeeze(cuts[-1]["left"]), lambda e: let(e.rlike(V.NAME_SPAM), lambda spam: shown(v, [c["gone"] for c in cuts], e, spam)))

    def cut(v: Column) -> Column:
        return let(
            without(v, V.LOOSE_PHONE),
            lambda a: let(without(a["left"], V.EMAIL), lambda b: let(strip_all(b["left"], V.TITLE_SUFFIX), lambda c: let(strip_all(c["left"], V.CREDENTIAL), lambda d: last(v, [a, b, c, d])))),
        )

    return let(present(name), cut)


def clean_plain(text: Column) -> Column:
    """C17 for titles and locations: without phones and addresses."""
    def shown(v: Column, a: Column, b: Column) -> Column:
        removed = F.concat(typed("phone", a["gone"]), typed("email", b["gone"]))
        return let(squeeze(b["left"]), lambda e: result(v, present(e), removed, v != e, e != ""))

    return let(present(text), lambda v: let(without(v, V.LOOSE_PHONE), lambda a: let(without(a["left"], V.EMAIL), lambda b: shown(v, a, b))))


def taken(text: Column, found: Callable[[Column], Column]) -> Column:
    """C17 for what is taken out of its text."""
    return let(present(text), lambda v: let(found(v), lambda x: result(v, x, F.array().cast(REMOVED), x.isNotNull() & (x != v), x.isNotNull())))


def extract_email(text: Column) -> Column:
    """C17 for addresses: the first one in lower case."""
    return taken(text, lambda v: F.lower(first_match(v, V.EMAIL)))


def extract_phone(text: Column) -> Column:
    """C17 for phones: the first strict one, normalised."""
    return taken(text, lambda v: let(first_match(v, V.STRICT_PHONE), lambda p: normalize_phone(p, "strict")))


def normalize_title(title: Column) -> Column:
    """Known titles in their usual form, others with every word capitalised."""
    t = F.trim(title)
    known = F.create_map(*(F.lit(x) for k in V.TITLES for x in (k.lower(), k)))
    caps = F.array_join(F.transform(matches(t, r"\w+|\W+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))), "")
    return F.coalesce(F.try_element_at(known, F.lower(t)), present(caps))


def good_name(name: Column) -> Column:
    """2 to 100 characters, a capital first, at least 70 % ASCII letters apart from spaces."""
    letters, solid = F.length(F.regexp_replace(name, "[^a-zA-Z]", "")), F.length(F.regexp_replace(name, r"\s", ""))
    return F.coalesce(F.length(name).between(2, 100) & name.rlike("^[A-Z]") & (letters * 10 >= solid * 7), F.lit(False))


def split_name_title(name: Column, profile_title: Column | None = None) -> Column:
    """struct(name, title, contaminated)."""
    ends = [rf"(?i){p}\z" for p in V.TITLE_ENDS]

    def parts(n: Column) -> Column:
        title = normalize_title(F.coalesce(*(F.trim(first_match(n, p, 1)) for p in ends)))
        if profile_title is not None:
            title = F.coalesce(normalize_title(present(profile_title)), title)
        cut = reduce(lambda other, p: F.when(n.rlike(p), F.trim(F.regexp_replace(n, p, ""))).otherwise(other), reversed(ends), n)
        ended = any_of([F.coalesce(n.rlike(p), F.lit(False)) for p in ends])
        return let(squeeze(cut), lambda clean: let(good_name(clean), lambda ok: F.struct(F.when(ok, clean).otherwise(n).alias("name"), F.when(n.isNotNull(), title).alias("title"), (ok & ended).alias("contaminated"))))

    return let(present(F.trim(name)), parts)


def extract_title(profile_title: Column, structured: Column, name: Column, bio: Column) -> Column:
    """struct(title, source, confidence) from the profile, JSON-LD, the name's end or the biography, first that has one."""
    in_bio = first_match(bio, r"(?i)\b(?:is|as)\s+an?\s+((?:senior|managing)?\s*(?:partner|associate|counsel))\b", 1)
    suffix = split_name_title(name)["title"]
    pick = lambda t, s, c: F.when(t.isNotNull(), F.struct(t.alias("title"), F.lit(s).alias("source"), F.lit(c).alias("confidence")))
    none = F.struct(no_text().alias("title"), no_text().alias("source"), no_text().alias("confidence"))
    return F.coalesce(
        pick(normalize_title(present(F.trim(profile_title))), "profile-html", "high"), pick(normalize_title(present(F.trim(structured))), "structured-data", "high"),
        pick(suffix, "name-suffix", "medium"), pick(normalize_title(in_bio), "bio", "low"), none,
    )


def parse_title(title: Column) -> Column:
    """C20: struct(primary, secondary, roles) of a title cut at commas and semicolons."""
    roles = F.filter(F.transform(F.split(title, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.get(roles, 0).alias("primary"), F.get(roles, 1).alias("secondary"), roles.alias("roles"))


def titles_match(a: Column, b: Column) -> Column:
    """C20: equal once normalised; missing titles match nothing."""
    return F.coalesce(F.lower(normalize_title(present(a))) == F.lower(normalize_title(present(b))), F.lit(False))


def good_location(c: Column) -> Column:
    n = F.length(digits(c))
    return F.coalesce(F.length(c).between(2, 200) & c.rlike("[a-zA-Z]") & ~n.between(10, 12), F.lit(False))


def clean_location_profile(location: Column) -> Column:
    """struct(location, removed, several, locations): phones by three patterns in turn, addresses and labels become spaces; split at line feeds,
    semicolons, pipes and commas unless a digit follows; of several valid parts the first is the location; invalid gives null."""
    none = F.array().cast("array<string>")
    phones = lambda p: lambda c: F.struct(F.transform(matches(c, p), lambda x: F.concat(F.lit("phone: "), x)).alias("gone"), F.regexp_replace(c, p, " ").alias("left"))

    def rest(c: Column, removed: list[Column]) -> Column:
        mails = F.transform(matches(c, V.EMAIL), lambda x: F.concat(F.lit("email: "), x))
        plain = reduce(lambda t, p: F.regexp_replace(t, p, " "), V.LOCATION_LABELS, F.regexp_replace(c, V.EMAIL, " "))
        return let(plain, lambda t: let(valid_parts(t), lambda parts: placed(t, parts, F.coalesce(F.concat(*removed, mails), none))))

    def valid_parts(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, r"[\n;|,](?!\s*\d)"), lambda x: F.trim(x)), lambda x: (x != "") & good_location(x))
        return let(parts, lambda ps: F.when((F.size(ps) == 0) & good_location(t), F.array(t)).otherwise(ps))

    def placed(t: Column, parts: Column, removed: Column) -> Column:
        value = F.when(F.size(parts) > 1, F.get(parts, 0)).otherwise(squeeze(t))
        return let(value, lambda v: F.struct(F.when(good_location(v), v).alias("location"), removed.alias("removed"), F.coalesce(F.size(parts) > 1, F.lit(False)).alias("several"), F.coalesce(parts, none).alias("locations")))

    one, two, three = (phones(p) for p in V.LOCATION_PHONES)
    return let(one(present(F.trim(location))), lambda a: let(two(a["left"]), lambda b: let(three(b["left"]), lambda c: rest(c["left"], [a["gone"], b["gone"], c["gone"]]))))


def detect_noise(field: Column, value: Column, phone: Column, email: Column) -> Column:
    """struct(items, clean): interface phrases (reported), labels (stripped), the row's own phone or address in another field, and artifacts (cleaned)."""
    def found(v: Column) -> Column:
        item = lambda kind, found: F.when(found.isNotNull(), F.struct(F.lit(kind).alias("type"), found.alias("matched")))
        own_phone = F.when((field != "phone") & (F.length(digits(phone)) >= 10) & F.contains(digits(v), F.right(digits(phone), F.lit(10))), first_match(v, V.LOCATION_PHONES[0]))
        own_email = F.when((field != "email") & F.contains(F.lower(v), F.lower(present(email))), first_match(v, V.EMAIL))
        items = [item("ui_element", first_match(v, p)) for p in V.NOISE_UI] + [item("label", first_match(v, p)) for p in V.NOISE_LABELS]
        items += [item("duplicate_phone", own_phone), item("duplicate_email", own_email)]
        artifacts = [(r"\n{3,}", "newlines"), (r" {3,}", "spaces"), (r"&[a-z]+;|&#\d+;", "entity"), (r"<[^>]+>", "tag")]
        items += [item(f"artifact_{n}", first_match(v, p)) for p, n in artifacts]
        clean = reduce(lambda c, p: F.regexp_replace(c, p, ""), V.NOISE_LABELS, v)
        clean = squeeze(F.regexp_replace(F.regexp_replace(clean, r"<[^>]+>", " "), r"&[a-z]+;|&#\d+;", " "))
        return F.struct(F.filter(F.array(*items), lambda x: x.isNotNull()).alias("items"), clean.alias("clean"))

    return let(F.trim(value), found)


def is_only_noise(clean: Column) -> Column:
    """Fewer than two characters are left."""
    return F.coalesce(F.length(F.trim(clean)) < 2, F.lit(True))


def normalize_location(location: Column) -> Column:
    """struct(location, changed, phones): phone-like runs go, white space is evened out, Washington, D.C. gets its usual form."""
    run = r"\+?\d[\d\s\-\(\)\.]{7,}"
    runs = lambda v: F.transform(F.filter(matches(v, run), lambda p: F.length(digits(p)) >= 7), lambda x: F.trim(x))

    def evened(a: Column) -> Column:
        keeps = any_of([a.rlike(p) for p in V.PRESERVED_PLACES])
        gentle = F.trim(F.regexp_replace(F.regexp_replace(a, r"\n+", ", "), r"\s+", " "))
        gentle = F.regexp_replace(F.regexp_replace(gentle, r"\s+,\s+", ", "), r"\s+,", ",")
        b = F.when(keeps, gentle).otherwise(squeeze(a))
        c = F.regexp_replace(b, r"(?i)Washington\s*,?\s*D\.?\s*C\.?", "Washington, D.C.")
        c = F.regexp_replace(F.regexp_replace(c, r"^,\s*|,\s*\z", ""), r",\s*,+", ",")
        return F.trim(F.regexp_replace(c, r"\s{2,}", " "))

    def shown(v: Column, phones: Column, c: Column) -> Column:
        return F.struct(c.alias("location"), F.coalesce(c != v, F.lit(False)).alias("changed"), F.coalesce(phones, F.array().cast("array<string>")).alias("phones"))

    def parts(v: Column, phones: Column) -> Column:
        return let(let(F.when(F.size(phones) > 0, F.regexp_replace(v, run, "")).otherwise(v), evened), lambda c: shown(v, phones, c))

    return let(present(location), lambda v: let(runs(v), lambda phones: parts(v, phones)))


def quality_score(name: Column, location: Column, email: Column, phone: Column, phone_fits: Column) -> Column:
    """struct(score, overall): 20 name without title, 20 location without phone, 30 address, 15 phone with country code, 15 phone fits the place."""
    points = [
        (20, present(name).isNotNull() & ~name.rlike(r"(?i)\b(Partner|Associate|Counsel|Director|Manager|Of Counsel)\z")),
        (20, present(location).isNotNull() & ~location.rlike(r"\+?\d+[\d\s\-\(\)]{7,}")),
        (30, email.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+\z")), (15, phone.rlike(r"^\+\d+[\d\s\-\(\)]+\z")), (15, phone_fits),
    ]
    score = sum((F.when(c, n).otherwise(0) for n, c in points), F.lit(0))
    return let(score, lambda s: F.struct(s.alias("score"), F.when(s >= 80, "high").when(s >= 60, "medium").otherwise("low").alias("overall")))
