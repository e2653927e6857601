"""Contact text as Column expressions. Empty text counts as missing unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V

def no_text() -> Column:
    return F.lit(None).cast("string")


def present(c: Column) -> Column:
    """Null for empty text."""
    return F.nullif(c, F.lit(""))


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return let(F.regexp_extract(c, pattern, group), present)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body refers to it; plans stay as small as what is written."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def title_case(c: Column) -> Column:
    """First letter upper, the others lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 10_000)))


def extract_emails(text: Column, domain: str | None = None) -> Column:
    """Distinct addresses in lower case, in order; with a domain, those that end in it."""
    found = F.array_distinct(F.transform(matches(text, V.EMAIL), F.lower))
    found = F.filter(found, lambda e: e.endswith("@" + domain.lower())) if domain else found
    return F.coalesce(found, F.array().cast("array<string>"))


def extract_phones(text: Column) -> Column:
    """Distinct matches of three patterns, pattern by pattern."""
    return F.coalesce(F.array_distinct(F.concat(*(matches(text, p) for p in V.PHONES))), F.array().cast("array<string>"))


def dashed(ten: Column) -> Column:
    return F.concat(F.lit("+1-"), F.substring(ten, 1, 3), F.lit("-"), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4))


def normalize_phone(phone: Column, mode: str = "keep") -> Column:
    """10 digits, or 11 that begin with 1, as +1-AAA-BBB-CCCC. Others: kept (`keep`), null (`strict`), or kept with '' for
    missing (`display`); `smart` gives (AAA) BBB-CCCC, 7 to 15 digits as they are, else null."""
    d = digits(phone)
    ten = F.when(F.length(d) == 10, d).when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10))
    if mode == "smart":
        shown = F.concat(F.lit("("), F.substring(ten, 1, 3), F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4))
        return F.coalesce(shown, F.when(F.length(d).between(7, 15), present(phone)))
    out = dashed(ten)
    if mode == "strict":
        return out
    return F.coalesce(out, present(phone), F.lit("") if mode == "display" else no_text())


def any_of(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs)


def is_valid_name(text: Column) -> Column:
    """C4: 2 to 50 characters, no blacklisted term, no word of the interface, a letter, a first character that is its own upper case, at most 5 words."""
    low, first = F.lower(text), F.substring(text, 1, 1)
    ok = F.length(text).between(2, 50) & ~low.isin(V.NOT_NAMES) & ~any_of([F.contains(low, F.lit(w)) for w in V.UI_WORDS])
    return F.coalesce(ok & text.rlike("[a-zA-Z]") & (first == F.upper(first)) & (F.size(F.split(text, r"\s+")) <= 5), F.lit(False))


def validate_name(text: Column) -> Column:
    """The trimmed name if it looks like one, else null."""
    t = F.trim(text)
    return F.when(F.length(text).between(2, 100) & ~F.lower(t).isin(V.NOT_NAMES) & t.rlike(V.NAME), t)


def name_from_email(email: Column) -> Column:
    """A name from the mailbox: parts between dots, dashes and underscores; a long single part is split after a known first name or in the middle."""
    box = F.split(email, "@")[0]
    low = F.lower(box)
    parts = F.filter(F.split(box, "[._-]+"), lambda p: (p != "") & ~p.rlike(r"^\d+\z"))
    one = parts[0]
    known = F.coalesce(
        *(
            F.when(F.startswith(F.lower(one), F.lit(n)) & (F.length(one) >= len(n) + 2), F.concat(F.lit(n.capitalize() + " "), title_case(F.substring(one, len(n) + 1, 10_000))))
            for n in V.FIRST_NAMES
        )
    )
    mid = F.ceil(F.length(one) / 2).cast("int")
    halves = F.concat(title_case(F.substr(one, F.lit(1), mid)), F.lit(" "), title_case(F.substr(one, mid + 1)))
    name = F.array_join(F.transform(parts, lambda p: F.when(F.length(p) == 1, F.concat(F.upper(p), F.lit("."))).otherwise(title_case(p))), " ")
    out = F.when(F.size(parts) == 0, no_text()).when((F.size(parts) == 1) & (F.length(one) > 8), F.coalesce(known, halves)).when(F.size(parts) <= 6, name)
    return F.when(F.length(box).between(2, 25) & ~any_of([F.contains(low, F.lit(w)) for w in V.ROLE_WORDS]), out)


def presence_confidence(name: Column, email: Column, phone: Column) -> Column:
    """High with all three, medium with two, else low."""
    n = sum((F.when(present(c).isNotNull(), 1).otherwise(0) for c in (name, email, phone)), F.lit(0))
    return F.when(n == 3, "high").when(n == 2, "medium").otherwise("low")


def phone_near(text: Column) -> Column:
    """The first match of the first pattern that matches."""
    return F.coalesce(*(first_match(text, p) for p in V.NEAR_PHONES))


def email_domain(email: Column) -> Column:
    """The normalised domain of an address, or null."""
    said = F.regexp_replace(first_match(F.lower(F.trim(email)), r"^[^@]+@([^@]+)\z", 1), r"^www\.", "")
    return let(said, lambda d: F.when(d.rlike(r"^[a-z0-9.-]+\.[a-z]{2,}\z"), d))


def domain_type(domain: Column, more_personal: list[str] | None = None, missing: str | None = "unknown") -> Column:
    """Personal, business, or what `missing` says for no domain (C10b: null)."""
    return F.when(domain.isNull(), F.lit(missing)).when(domain.isin(V.PERSONAL_DOMAINS + (more_personal or [])), "personal").otherwise("business")


def clean_email(text: Column) -> Column:
    """Without mailto:, query and surrounding brackets; null if no address is left."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^mailto:", ""), r"\?.*", ""), r"^[<\[(\s]+|[>\])\s]+\z", "")
    return F.when(t.rlike(rf"^{V.EMAIL}\z"), F.lower(t))


def name_variations(name: Column) -> Column:
    """Mailbox forms of a name, in order and distinct: f.l, fl, Fl, l, f, then with a middle name f.m.l and Fml (m and F as
    initials); title words don't count, one word gives itself, null gives null."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(name, rf"(?i)\b({'|'.join(V.NAME_TITLES)})\b", ""), r"[^a-zA-Z\s]", ""))
    w = F.filter(F.split(F.lower(clean), r"\s+"), lambda x: x != "")
    f, last, m = F.get(w, 0), F.try_element_at(w, F.lit(-1)), F.substring(F.get(w, 1), 1, 1)
    i = F.substring(f, 1, 1)
    two = F.array(F.concat(f, F.lit("."), last), F.concat(f, last), F.concat(i, last), last, f)
    three = F.array(F.concat(f, F.lit("."), m, F.lit("."), last), F.concat(i, m, last))
    return F.when(name.isNull(), F.lit(None).cast("array<string>")).when(F.size(w) < 2, F.array(F.lower(clean))).when(F.size(w) == 2, F.array_distinct(two)).otherwise(F.array_distinct(F.concat(two, three)))


def is_business_email(email: Column, domain: Column | None = None) -> Column:
    """C11: a well-formed address without the parts of made-up ones and, with a domain, of that domain (a null domain asks for none)."""
    low = F.lower(email)
    ok = F.trim(email).rlike(rf"^{V.EMAIL}\z") & ~any_of([F.contains(low, F.lit(p)) for p in V.FAKE_MAIL])
    if domain is not None:
        ok = ok & F.coalesce(low.endswith(F.concat(F.lit("@"), F.lower(domain))), F.lit(True))
    return F.coalesce(ok, F.lit(False))


def name_near_email(text: Column, email: Column) -> Column:
    """struct(name, score) of the capitalised run of one to five words before an address that scores best, or null: up to 50 for
    nearness of its line, up to 40 for the parts of the mailbox it shares, 10 for two words; ties to the nearest line, then the first in it."""
    lines = lambda before: F.reverse(F.filter(F.transform(F.split(before, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    terms = F.filter(F.split(F.lower(F.split(email, "@")[0]), "[._-]+"), lambda t: F.length(t) >= 2)

    def scored(backwards: Column, terms: Column, line: Column, k: Column) -> Column:
        # where the line's text stands last before the address
        apart = F.length(line) + F.instr(backwards, F.reverse(line)) - 1

        def one(near: Column, run: Column, i: Column) -> Column:
            def points(words: Column) -> Column:
                shared = F.size(F.filter(terms, lambda t: F.exists(words, lambda w: w.contains(t) | t.contains(w))))
                return near + F.when(F.size(terms) > 0, shared / F.size(terms) * 40).otherwise(0.0) + F.when(F.size(words) >= 2, 10.0).otherwise(0.0)

            return F.struct((-let(F.split(F.lower(run), r"\s+"), points)).alias("s"), k.alias("k"), i.alias("i"), run.alias("name"))

        runs = F.filter(matches(line, r"\b([A-Z][a-z]+(?:[\s'-][A-Z][a-z]+){0,4})\b", 1), is_valid_name)
        return let(F.greatest(F.lit(0.0), F.lit(50.0) - apart / 2), lambda near: F.transform(runs, lambda run, i: one(near, run, i)))

    def best(before: Column, terms: Column) -> Column:
        return let(F.reverse(before), lambda backwards: F.array_min(F.flatten(F.transform(lines(before), lambda line, k: scored(backwards, terms, line, k)))))

    before = let(F.instr(F.lower(text), F.lower(email)), lambda at: F.when(at > 0, F.substr(text, F.lit(1), at - 1)))
    found = let(before, lambda b: let(terms, lambda t: best(b, t)))
    return let(found, lambda x: F.when(x.isNotNull(), F.struct(x["name"].alias("name"), (-x["s"]).alias("score"))))


def match_key(c: Column) -> Column:
    """Lower case, squeezed, only word characters, space, @, dot and dash; null if nothing is left."""
    return present(F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), r"\s+", " "), r"[^\w\s@.-]", ""))


def string_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 if equal, 0 if a side is empty or missing."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(a.eqNullSafe(b), 1.0).when(present(a).isNull() | present(b).isNull(), 0.0).otherwise((most - F.levenshtein(a, b)) / most)


def email_confidence(email: Column) -> Column:
    """C14 for addresses: 80, +10 for a known provider or .org/.edu/.gov, +5 for another .com, -30 for many @, -20 for a short mailbox."""
    d = F.lower(F.substring_index(email, "@", -1))
    s = F.lit(80) + F.when(d.isin(V.PERSONAL_DOMAINS) | d.rlike(r"\.(org|edu|gov)\z"), 10).when(d.endswith(".com"), 5).otherwise(0)
    s = s - F.when(F.length(email) - F.length(F.translate(email, "@", "")) > 1, 30).otherwise(0) - F.when(F.instr(email, "@") < 3, 20).otherwise(0)
    return F.when(email.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), s)))


def phone_confidence(phone: Column) -> Column:
    """C14 for phones: 85, +5 if formatted, +5 for a leading +1 or 1-."""
    s = F.lit(85) + F.when(phone.rlike(r"[-.()\s]"), 5).otherwise(0) + F.when(phone.rlike(r"^(\+1|1-)"), 5).otherwise(0)
    return F.when(phone.isNotNull(), F.least(F.lit(100), s))


def adjust_confidence(field: Column, value: Column, base: Column) -> Column:
    """A method's confidence after a look at the value, between 0 and 100; 0 without a value. Names: +10 for two to four capitalised
    words, else -30 for an @ or a phone, -20 for one word, -15 for over five. Addresses and phones of 10 or 11 digits: +10, else -20.
    URLs from / or http: +10, else -10. Other fields keep it."""
    words = F.split(F.trim(value), r"\s+")
    n = F.size(words)
    name = F.when(n.between(2, 4) & F.forall(words, lambda w: w.rlike("^[A-Z]")), 10).when(value.contains("@") | value.rlike(r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}"), -30).when(n < 2, -20).when(n > 5, -15).otherwise(0)
    mail = F.when(F.trim(value).rlike(rf"^{V.EMAIL}\z"), 10).otherwise(-20)
    phone = F.when(F.length(digits(value)).between(10, 11), 10).otherwise(-20)
    url = F.when(value.startswith("/") | value.startswith("http"), 10).otherwise(-10)
    change = F.when(field == "name", name).when(field == "email", mail).when(field == "phone", phone).when(field == "profile_url", url).otherwise(0)
    return F.when(present(value).isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), base + change)))


def confidence_band(score: Column) -> Column:
    """High from 90, medium from 70, else low."""
    return F.when(score >= 90, "high").when(score >= 70, "medium").otherwise("low")


def validate_field(field: Column, value: Column) -> Column:
    """struct(valid, message) by field name: any text will do but for names (no @, no phone, six words at most), addresses, phones
    (7 to 15 digits) and profile_url (from http or /); no message for what is valid."""
    v = present(F.regexp_replace(value, r"^\s+|\s+\z", ""))
    wrong = lambda test, text: F.when(test, F.lit(text))
    name = F.coalesce(wrong(v.contains("@"), "an address, not a name"), wrong(v.rlike(r"^\+?[\d\s\-()]{7,}\z"), "a phone, not a name"), wrong(F.size(F.split(v, r"\s+")) > 6, "more than six words"))
    other = F.when(field == "name", name).when(field == "email", wrong(~v.rlike(rf"^{V.EMAIL}\z"), "no valid address")).when(field == "phone", wrong(~F.length(digits(v)).between(7, 15), "not 7 to 15 digits"))
    message = F.when(v.isNull(), F.lit("no value")).otherwise(other.when(field == "profile_url", wrong(~v.startswith("http") & ~v.startswith("/"), "no valid URL")))
    return F.struct(message.isNull().alias("valid"), message.alias("message"))
