"""Fields of profile pages, as expressions over a page's nodes (see trees.page_trees).

A rule with several selectors takes the first node of each in turn. Missing or empty pages give null fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.text import any_of, digits, first_match, is_business_email, let, matches, name_variations, normalize_phone, present
from .labels import label_value
from .trees import attr, class_part, first, has_class, href, in_order, is_link, page_text, texts, within

PERSON = "array<struct<`@type`:string,name:string,email:string,telephone:string,jobTitle:string,description:string,worksFor:struct<name:string>>>"


def cls(*tokens: str) -> list:
    return [lambda n, t=t: has_class(n, t) for t in tokens]


def part(*parts: str) -> list:
    return [lambda n, p=p: class_part(n, p) for p in parts]


def prop(*names: str) -> list:
    return [lambda n, p=p: attr(n, "itemprop") == p for p in names]


def tagged(*tags: str):
    return lambda n: n["tag"].isin(*tags)


def both(*tests):
    def test(n: Column) -> Column:
        out = tests[0](n)
        for t in tests[1:]:
            out = out & t(n)
        return out

    return test


def under(nodes: Column, token: str):
    return lambda n: within(n, nodes, lambda a: has_class(a, token))


def profile_name(nodes: Column) -> Column:
    """The first of eight name selectors, else the first h1 of 3 to 99 characters."""
    h1 = tagged("h1")
    named = [*(both(h1, t) for t in cls("name", "lawyer-name", "attorney-name", "profile-name")), *(both(h1, under(nodes, c)) for c in ("profile-header", "bio-header")), *cls("person-name"), *prop("name"), both(h1, *part("name"))]
    head = let(first(nodes, h1)["text"], lambda t: F.when(F.length(t).between(3, 99), t))
    return F.coalesce(in_order(nodes, named, lambda t: F.length(t) > 0), head)


def profile_title(nodes: Column) -> Column:
    """The first of eight title selectors (1 to 99 characters), else a short text with a title's word below the first h1."""
    tests = [*cls("title", "job-title", "position", "role"), *prop("jobTitle"), both(*part("title"), lambda n: n["tag"] != "title"), both(*cls("subtitle"), under(nodes, "profile-header")), both(*cls("title"), under(nodes, "bio-header"))]
    beside = lambda n, head: (n["up"] == head["up"]) & (n["n"] > head["n"])
    next_h1 = lambda head: F.coalesce(first(nodes, lambda n: (n["tag"] == "h1") & beside(n, head))["n"], F.lit(2**31 - 1))
    below = lambda n, head, end: beside(n, head) & (n["n"] < end) & F.length(n["text"]).between(3, 49) & any_of([F.lower(n["text"]).contains(w) for w in V.HEADING_TITLES])
    # The heading and the end of its part are worked out once a page, not once a node.
    said = let(first(nodes, tagged("h1")), lambda head: let(next_h1(head), lambda end: first(nodes, lambda n: below(n, head, end))["text"]))
    return F.coalesce(in_order(nodes, tests, lambda t: F.length(t).between(1, 99)), said)


def profile_location(nodes: Column) -> Column:
    """The first of six location selectors, else what follows a label in the text."""
    tests = [*cls("location", "office"), *part("location", "office"), *prop("addressLocality", "workLocation")]
    said = F.trim(first_match(page_text(nodes), r"(?:Office|Location)\s*:?\s*([A-Z][a-zA-Z\s,]+)", 1))
    return F.coalesce(in_order(nodes, tests, lambda t: F.length(t) > 0), said)


def profile_bio(nodes: Column) -> Column:
    """The first bio element of 51 characters or more, else the first paragraph of 101 to 1999 without legal text; 1000 characters at most."""
    tests = [*cls("bio", "biography", "about", "description", "profile-description"), *prop("description"), both(tagged("p"), under(nodes, "profile-content")), *cls("bio-content")]
    plain = F.get(F.filter(texts(nodes, tagged("p")), lambda t: F.length(t).between(101, 1999) & ~t.contains("Copyright") & ~t.contains("Privacy Policy")), 0)
    return F.substring(F.coalesce(in_order(nodes, tests, lambda t: F.length(t) > 50), plain), 1, 1000)


def items_in(nodes: Column, box: Column, tags: tuple[str, ...], most: int) -> Column:
    """Texts of the items inside a node, null if there are no items."""
    inside = F.filter(nodes, lambda n: n["tag"].isin(*tags) & (n["n"] > box["n"]) & (n["n"] <= box["last"]))
    return let(inside, lambda xs: F.when(box.isNotNull() & (F.size(xs) > 0), F.filter(F.transform(xs, lambda n: n["text"]), lambda t: F.length(t).between(1, most))))


def listed(nodes: Column, tests: list, words: tuple[str, ...], tags: tuple[str, ...] = ("li",), most: int = 100_000, whole: bool = False) -> Column:
    """Items of the first selector whose first node has any (with `whole`, else its text), else of the parent of the first heading that
    holds a word and has items beside it."""
    def of(box: Column) -> Column:
        items = items_in(nodes, box, tags, most)
        return F.coalesce(items, F.when(F.length(box["text"]) > 0, F.array(box["text"]))) if whole else items

    tries = [let(first(nodes, t), of) for t in tests]
    heads = F.filter(nodes, lambda n: n["tag"].isin("h2", "h3", "h4") & any_of([F.lower(n["text"]).contains(w) for w in words]))
    parents = F.transform(heads, lambda h: items_in(nodes, F.get(nodes, h["up"]), tags, most))
    return F.coalesce(*tries, F.get(F.filter(parents, lambda x: x.isNotNull()), 0))


def profile_lists(trees: DataFrame) -> DataFrame:
    """page_id, bio, education, practice_areas, bar_admissions."""
    n = F.col("nodes")
    return trees.select(
        "page_id", profile_bio(n).alias("bio"), listed(n, [*cls("education", "credentials"), *part("education")], ("education",), whole=True).alias("education"),
        listed(n, [*cls("practice-areas", "practices"), *part("practice"), *cls("areas-of-focus", "expertise")], ("practice", "areas", "expertise"), ("li", "a"), 99).alias("practice_areas"),
        listed(n, [*cls("bar-admissions", "admissions"), *part("admission"), *cls("credentials", "licenses")], ("bar", "admission", "license")).alias("bar_admissions"),
    )


def structured_person(trees: DataFrame) -> DataFrame:
    """page_id and the person of the first JSON-LD script (an object or one of an array), else of microdata; broken JSON counts as none."""
    raw = first_match(F.col("html"), r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", 1)
    ld = F.get(F.filter(F.from_json(raw, PERSON), lambda x: x["@type"] == "Person"), 0)
    n = F.col("nodes")
    micro = lambda p, box: first(n, lambda x: (attr(x, "itemprop") == p) & (x["n"] > box["n"]) & (x["n"] <= box["last"]))["text"]
    fields = ("name", "email", "telephone", "jobTitle", "description")
    person = let(first(n, lambda x: attr(x, "itemtype").contains("Person")), lambda box: F.when(box.isNotNull(), F.struct(*(micro(f, box).alias(f) for f in fields))))
    d = trees.withColumns({"ld_": ld, "micro_": person})
    pick = lambda f: F.when(F.col("ld_").isNotNull(), F.col(f"ld_.{f}")).otherwise(F.col(f"micro_.{f}"))
    source = F.when(F.col("ld_").isNotNull(), "json-ld").when(F.col("micro_").isNotNull(), "microdata")
    return d.select("page_id", *(pick(f).alias({"jobTitle": "job_title"}.get(f, f)) for f in fields), F.col("ld_.worksFor.name").alias("works_for"), source.alias("source"))


def host_domain(url: Column) -> Column:
    """The page's host in lower case without www."""
    return present(F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1)), r"www\.", ""))


def marked_text(nodes: Column, test, data: str) -> Column:
    """The text of the first node that passes, else its data attribute."""
    return let(first(nodes, test), lambda n: F.coalesce(present(n["text"]), attr(n, data)))


def profile_email(nodes: Column, url: Column, forms: Column, text: Column) -> Column:
    """A mailto link of the page's domain (else the first), an address of the domain in the text (by the forms of the name, C12), one in a
    mail element, one after a label; the first that is a business address (C11) of the domain."""
    domain = host_domain(url)
    ours = lambda e: F.coalesce(F.lower(e).endswith(F.concat(F.lit("@"), domain)), F.lit(True))
    mailed = F.transform(F.filter(nodes, lambda n: is_link(n) & href(n).startswith("mailto:")), lambda n: F.trim(F.split(F.regexp_replace(href(n), "^mailto:", ""), r"\?")[0]))
    mailto = F.coalesce(F.get(F.filter(mailed, lambda e: domain.isNotNull() & ours(e)), 0), F.get(mailed, 0))
    said = F.filter(matches(text, V.EMAIL), lambda e: domain.isNotNull() & ours(e))
    by_name = F.get(F.filter(F.transform(forms, lambda v: F.get(F.filter(said, lambda e: F.lower(e).contains(v)), 0)), lambda e: e.isNotNull()), 0)
    marked = []
    for test in [*cls("email", "contact-email"), *part("email"), lambda n: attr(n, "data-email").isNotNull(), *prop("email")]:
        marked.append(let(first_match(marked_text(nodes, test, "data-email"), V.EMAIL), lambda e: F.when(ours(e), e)))
    labelled = first_match(text, rf"(?i)(?:Email|E-mail)\s*:?\s*({V.EMAIL})", 1)
    good = lambda c: let(c, lambda e: F.when(is_business_email(e, domain), F.lower(e)))
    return F.coalesce(good(mailto), good(F.coalesce(by_name, F.get(said, 0))), good(F.coalesce(*marked)), good(F.when(ours(labelled), labelled)))


def profile_phone(nodes: Column) -> Column:
    """The first tel link, else a phone in a phone element, else one after a label; as +1-AAA-BBB-CCCC where it has 10 digits."""
    tel = present(F.trim(F.regexp_replace(href(first(nodes, lambda n: is_link(n) & href(n).startswith("tel:"))), "^tel:", "")))
    marked = []
    for test in [*cls("phone", "tel", "contact-phone"), *part("phone"), lambda n: attr(n, "data-phone").isNotNull(), *prop("telephone")]:
        marked.append(first_match(marked_text(nodes, test, "data-phone"), V.PROFILE_PHONE))
    labelled = first_match(page_text(nodes), rf"(?i)(?:Phone|Tel|Telephone)\s*:?\s*({V.PROFILE_PHONE})", 1)
    return let(F.coalesce(tel, *marked, labelled), normalize_phone)


def profile_fields(trees: DataFrame) -> DataFrame:
    """page_id, profile_url, name, email, phone, title, location of each profile page: the right side of an enrichment."""
    n = F.col("nodes")
    d = trees.withColumns({"name": profile_name(n), "text_": page_text(n)})
    d = d.withColumn("forms_", name_variations(F.col("name")))
    return d.select("page_id", F.col("url").alias("profile_url"), "name", profile_email(n, F.col("url"), F.col("forms_"), F.col("text_")).alias("email"), profile_phone(n).alias("phone"), profile_title(n).alias("title"), profile_location(n).alias("location"))


def label_values(trees: DataFrame, field: str) -> DataFrame:
    """page_id and the value of a field by its label in the text nodes: what follows the colon (over two characters), else the first
    of the next four texts of 3 to 99 characters that is no label itself. Confidence 75. What stands to the right on screen is not known here."""
    d = trees.select("page_id", label_value(F.col("nodes"), field).alias(field))
    return d.select("page_id", field, F.when(F.col(field).isNotNull(), 75).alias("confidence"))
