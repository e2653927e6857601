"""Stored pages to rows: one parsing job inside tasks, everything after it is DataFrame work on its nodes."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.text import any_of, first_match, let, matches, present
from .selectors import css, whole_number

NODES = "page_id long, node_id int, parent_id int, path string, tag string, class string, attrs map<string,string>, text string, own_text string, last_id int"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "noscript"}
#: Nodes from which on a batch of html_nodes goes out; it ends with a page.
BATCH = 1000


class Tree(HTMLParser):
    """Collects [parent, path, tag, attrs, texts, own texts] per element; text of hidden elements is left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        up = self.open[-1] if self.open else -1
        path = (self.nodes[up][1] if up >= 0 else "") + "/" + tag
        self.nodes.append([up, path, tag, {k: v or "" for k, v in attrs}, [], []])
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]][2] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if self.open and not any(self.nodes[i][2] in HIDDEN for i in self.open):
            self.nodes[self.open[-1]][5].append(data)
            for i in self.open:
                self.nodes[i][4].append(data)


def parse(html: str | None) -> list[tuple]:
    """(node, parent, path, tag, class, attributes, text, own text) of each element in document order; parent -1 is the page."""
    t = Tree()
    t.feed(html or "")
    t.close()
    squeeze = lambda parts: " ".join(" ".join(parts).split())
    return [(i, up, path, tag, a.get("class", ""), a, squeeze(x), squeeze(own)) for i, (up, path, tag, a, x, own) in enumerate(t.nodes)]


def last_inside(parents: list[int]) -> list[int]:
    """The last node inside each, from the nodes' parents in document order."""
    last = list(range(len(parents)))
    for i in range(len(parents) - 1, -1, -1):
        if (up := parents[i]) >= 0:
            last[up] = max(last[up], last[i])
    return last


def html_nodes(pages: DataFrame) -> DataFrame:
    """H1: a row per element of page_id, html; last_id is the last one inside. Filter pages first: filters don't move below this job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.int32()]
        names = ["page_id", "node_id", "parent_id", "path", "tag", "class", "attrs", "text", "own_text", "last_id"]
        for batch in batches:
            held: list[tuple] = []
            for k, (i, html) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), 1):
                rows = parse(html)
                held.extend((i, *r, end) for r, end in zip(rows, last_inside([r[1] for r in rows]), strict=True))
                if held and (len(held) >= BATCH or k == len(batch)):  # a batch for each small page would cost more than the page
                    cols = list(zip(*held, strict=True))
                    cols[6] = [list(a.items()) for a in cols[6]]
                    held = []
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, NODES)


def absolute(href: Column, url: Column) -> Column:
    """href against the page's address."""
    site = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(url, r"^(https?://[^/?#]+(?:/[^?#]*)?/)", 1)
    folder = F.when(folder == "", F.concat(site, F.lit("/"))).otherwise(folder)
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(url, "^(https?:)", 1), href))
        .when(href.startswith("/"), F.concat(site, href)).when(href.startswith("?") | href.startswith("#"), F.concat(F.regexp_replace(url, r"[?#].*", ""), href)).otherwise(F.concat(folder, href))
    )


def html_links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """H2: page_id, node_id, href, url (absolute), text, class, has_img of every link."""
    link = F.when(F.col("tag") == "a", F.struct("node_id", F.trim(F.col("attrs")["href"]).alias("href"), "text", "class"))
    holder = F.when(F.col("tag") == "a", F.col("node_id")).otherwise(F.col("parent_id")).alias("holder_")
    # Links and images come from one pass, as nodes are parsed anew for each.
    d = nodes.where("tag in ('a', 'img')").groupBy("page_id", holder).agg(F.collect_list(link).alias("links_"), F.bool_or(F.col("tag") == "img").alias("has_img"))
    d = d.select("page_id", "has_img", F.explode("links_").alias("l")).where("l.href <> ''").select("page_id", "l.*", "has_img")
    out = d.join(pages.select("page_id", F.col("url").alias("base")), "page_id")
    return out.select("page_id", "node_id", "href", absolute(F.col("href"), F.col("base")).alias("url"), "text", "class", "has_img")


SOCIAL = {"linkedin": r"linkedin\.com/(?:in|company)/([^/?#\"']+)", "twitter": r"(?:twitter|x)\.com/([^/?#\"']+)", "facebook": r"facebook\.com/([^/?#\"']+)", "github": r"github\.com/([^/?#\"']+)"}


def social_links(links: DataFrame) -> DataFrame:
    """page_id, platform, url, username."""
    found = F.array(*(F.when(F.col("url").rlike(p), F.struct(F.lit(k).alias("platform"), F.regexp_extract("url", p, 1).alias("username"))) for k, p in SOCIAL.items()))
    return links.select("page_id", "url", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("s")).select("page_id", "s.platform", "url", "s.username")


def link_scores(links: DataFrame) -> DataFrame:
    """H8: page_id, url, score, node_id, best of each distinct link of a page; `best` marks the page's best one (ties to the first).

    70; +15 for a profile's address, +10 for a word that asks to look, +15 for two to four capitalised words, -30 for scripts, bare marks
    and words of navigation, -10 for the three networks; between 0 and 100. A direct hit on the screen is not known here.
    """
    t, low = F.lower("text"), F.lower("url")
    words = F.split(F.trim("text"), r"\s+")
    named = F.size(words).between(2, 4) & F.forall(words, lambda w: w.rlike(r"^[A-Z][a-z]+\z"))
    s = F.lit(70) + F.when(any_of([low.contains(p) for p in V.LINK_PATHS]), 15).otherwise(0) + F.when(any_of([t.contains(w) for w in V.LINK_WORDS]), 10).otherwise(0) + F.when(named, 15).otherwise(0)
    aside = low.contains("javascript:") | (F.col("href") == "#") | any_of([t.contains(w) for w in V.NAVIGATION_WORDS])
    s = s - F.when(aside, 30).otherwise(0) - F.when(any_of([low.contains(w) for w in V.SOCIAL_SITES]), 10).otherwise(0)
    first = links.groupBy("page_id", "url").agg(F.min(F.struct("node_id", "text", "href")).alias("m")).select("page_id", "url", "m.*")  # an address counts once, as it first stands
    d = first.select("page_id", "url", F.greatest(F.lit(0), F.least(F.lit(100), s)).alias("score"), "node_id")
    top = d.groupBy("page_id").agg(F.min(F.struct(-F.col("score"), "node_id")).alias("top_"))
    return d.join(top, "page_id").withColumn("best", F.col("node_id") == F.col("top_.node_id")).drop("top_")


#: Cards that a generic link takes its name from, and where in them.
CARDS, CARD_NAMES = '.card, .member, .attorney, .lawyer, .team-member, .person, [class*="card"]', 'h2, h3, h4, .name, [class*="name"]'


def profile_links(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The links of a page that lead to profiles, each address once as it first stands; a text that is short or says only "view" or
    the like gives way to the heading of the nearest card around it, if `nodes` (with last_id) are given; '' becomes null."""
    low = F.lower("url")
    d = links.where(any_of([low.contains(p.lower()) for p in V.VISITED_PATHS])).groupBy("page_id", "url").agg(F.min_by("text", "node_id").alias("text"), F.min("node_id").alias("node_id"))
    if nodes is not None:
        generic = (F.length("text") < 3) | F.lower("text").isin(V.GENERIC_LINKS)
        # Cards and headings of a page come from one pass, as nodes are parsed anew for each; a page is one record of the input.
        card, heading = F.when(css(CARDS), F.struct("node_id", "last_id")), F.when(css(CARD_NAMES), F.struct("node_id", "text"))
        marks = nodes.select("page_id", card.alias("card_"), heading.alias("name_")).where("card_ is not null or name_ is not null").groupBy("page_id").agg(F.collect_list("card_").alias("cards_"), F.array_sort(F.collect_list("name_")).alias("names_"))
        around = F.filter("cards_", lambda c: (c["node_id"] <= F.col("node_id")) & (F.col("node_id") <= c["last_id"]))
        name = let(F.array_max(around), lambda c: F.get(F.filter("names_", lambda h: (h["node_id"] > c["node_id"]) & (h["node_id"] <= c["last_id"])), 0)["text"])
        d = d.join(marks, "page_id", "left").withColumn("text", F.when(generic, F.coalesce(name, F.col("text"))).otherwise(F.col("text")))
    return d.select("page_id", "url", present(F.col("text")).alias("text"), "node_id")


def max_page_from_text(text: Column, most: int | None = 9999) -> Column:
    """H29: "page X of Y" in four forms, else total over page size of "a-b of n", from 1 to `most` (None: any number)."""
    said = [r"(?i)page\s+\d+\s+of\s+(\d+)", r"(?i)showing page\s+\d+\s+of\s+(\d+)", r"(?i)\d+\s+of\s+(\d+)\s+pages", r"(?i)page\s+\d+/(\d+)"]
    good = lambda n: F.when((n > 0) & (n <= most if most else F.lit(True)), n)
    whole = lambda p, g: first_match(text, p, g).try_cast("long")
    r = r"(?i)(\d+)-(\d+)\s+of\s+(\d+)"
    size = whole(r, 2) - whole(r, 1) + 1
    return F.coalesce(*(good(whole(p, 1)) for p in said), good(F.ceil(F.when(size > 0, whole(r, 3) / size)).cast("long")))


def page_text_of(text: str = "text") -> Column:
    """An aggregate over a page's nodes: the text of its body, or of all its outermost elements in order where no body is marked."""
    tops = F.array_sort(F.collect_list(F.when(F.col("parent_id") == -1, F.struct("node_id", text))))
    return F.coalesce(F.min(F.when(F.col("tag") == "body", F.struct("node_id", text)))[text], F.array_join(F.transform(tops, lambda x: x[text]), " "))


def _said() -> list[Column]:
    """Aggregates over a page's nodes that H29 goes by; _max_page() reads them."""
    number = whole_number(F.coalesce(*(present(F.col("attrs")[a]) for a in ("data-total-pages", "data-max-page", "data-page-count"))))
    return [page_text_of().alias("text_"), F.min(F.when(number.between(1, 9999), F.struct("node_id", number.alias("n")))).alias("data_")]


def _max_page() -> Column:
    return F.coalesce(max_page_from_text(F.col("text_")), F.col("data_.n"))


def max_page(nodes: DataFrame) -> DataFrame:
    """H29 for pages: page_id, max_page by the body's text, else by the first element whose data attributes give one; pages without are left out."""
    d = nodes.groupBy("page_id").agg(*_said())
    return d.select("page_id", _max_page().alias("max_page")).where("max_page is not null")


def pagination_controls(nodes: DataFrame) -> DataFrame:
    """Per page the numbers its page links show (1 to 9999), the greatest one (else H29's), the current one, next and previous, the
    kind of control and whether there is any. Whether an element can be seen is not known here."""
    shown, data = whole_number(F.col("text")), whole_number(F.col("attrs")["data-page"])
    in_range = lambda n: F.when(n.between(1, 9999), n)
    link = css(V.PAGE_LINKS)
    at = [F.min(F.when(css(c), F.struct("node_id", F.coalesce(F.when(shown > 0, shown), F.when(data > 0, data)).alias("n")))).alias(f"at{k}_") for k, c in enumerate(V.CURRENT_PAGE)]
    per = nodes.groupBy("page_id").agg(
        F.collect_set(F.when(link, in_range(shown))).alias("a_"), F.collect_set(F.when(link, in_range(data))).alias("b_"), F.bool_or(css(V.NEXT_PAGE) | (css('svg[data-icon="chevron-right"]:in(a)'))).alias("has_next"),
        F.bool_or(css(V.PREVIOUS_PAGE)).alias("has_prev"), F.bool_or(css(V.PAGE_NAVIGATION)).alias("in_"), *at, *_said(),
    )
    per = per.withColumn("numbers", F.array_sort(F.array_union("a_", "b_")))
    numeric = F.size("numbers") > 0
    kind = F.when(numeric, "numeric").when(F.col("has_next") | F.col("has_prev"), "next-prev").otherwise("none")
    return per.withColumn("said_", _max_page()).select(
        "page_id", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"), F.coalesce(F.array_max("numbers"), F.col("said_")).alias("max_page"), F.coalesce(*(F.col(f"at{k}_.n") for k in range(len(at)))).alias("current_page"),
        "has_next", "has_prev", kind.alias("kind"), (F.col("in_") | F.col("has_next") | numeric).alias("has_pagination"),
    )


def visible_text(html: Column) -> Column:
    """Text of a page by patterns, for rules over stored HTML: no scripts and styles, tags as spaces, white space squeezed."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"\s+", " "))


def page_content_stats(pages: DataFrame) -> DataFrame:
    """has_content (over 100 characters), distinct addresses, contacts (mailto links or addresses) and the digest of the first 1000 characters."""
    t = visible_text(F.col("html"))
    d = pages.select("page_id", t.alias("t"), F.size(F.array_distinct(matches(t, V.EMAIL))).alias("emails"), F.regexp_count("html", F.lit(r"(?i)href=.mailto:")).alias("m"))
    return d.select("page_id", (F.length("t") > 100).alias("has_content"), F.col("emails"), F.greatest("m", "emails").alias("contacts"), F.md5(F.substring("t", 1, 1000)).alias("digest"))


def infinite_scroll_score(pages: DataFrame) -> DataFrame:
    """Static hints of endless lists, by selectors: over five lazy elements 2, a script that listens for scrolling 2, a load zone 2, a
    button for more 1, over ten indexed rows 2, observed elements 1; found from 4. Pages without elements score 0."""
    nodes = html_nodes(pages)
    any_, times = lambda c: F.coalesce(F.bool_or(c), F.lit(False)), lambda c: F.count_if(css(c))
    button = css(V.LOAD_BUTTONS) | (F.col("tag").eqNullSafe("button") & F.contains("text", F.lit("Load More")))
    per = nodes.groupBy("page_id").agg(times(V.LAZY).alias("lazy"), any_(css(V.LOAD_ZONES)).alias("zone"), any_(button).alias("button"), times("[data-index]").alias("rows"), any_(css("[data-observe], .observe")).alias("seen"))
    scripts = matches(F.col("html"), r"(?is)<script[^>]*>(.*?)</script>", 1)
    listens = F.exists(scripts, lambda s: (s.contains("addEventListener") | s.contains("onscroll")) & (s.contains("scroll") | s.contains("loadMore")))
    d = pages.select(F.col("page_id").cast("long"), F.coalesce(listens, F.lit(False)).alias("listens")).join(per, "page_id", "left")
    points = lambda c, n: F.when(c, n).otherwise(0)
    s = points(F.col("lazy") > 5, 2) + points(F.col("listens"), 2) + points(F.col("zone"), 2) + points(F.col("button"), 1) + points(F.col("rows") > 10, 2) + points(F.col("seen"), 1)
    return d.select("page_id", s.alias("score"), (s >= 4).alias("infinite"))


def fill_missing_fields(d: DataFrame, found: DataFrame, key: str = "row_id") -> DataFrame:
    """Only missing url, title and location are filled, with method fallback-dom and confidence 70 for each."""
    f = found.select(key, *(F.col(c).alias(f"f_{c}") for c in ("profile_url", "title", "location")))
    j = d.join(f, key, "left")
    gaps = {c: present(F.col(c)).isNull() & F.col(f"f_{c}").isNotNull() for c in ("profile_url", "title", "location")}
    methods = F.map_from_entries(F.filter(F.array(*(F.when(g, F.struct(F.lit(c).alias("field"), F.struct(F.lit("fallback-dom").alias("method"), F.lit(70).alias("confidence")).alias("how"))) for c, g in gaps.items())), lambda x: x.isNotNull()))
    filled = {c: F.coalesce(present(F.col(c)), F.col(f"f_{c}")).alias(c) for c in gaps}
    return j.select(*(filled.get(c, F.col(c)) for c in d.columns), methods.alias("methods"))
