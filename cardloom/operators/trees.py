"""Stored pages as one array of nodes each, parsed once; every rule after it is a Column expression over that array."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, let, present
from .html import absolute, last_inside, parse

#: n: place in the document; up: parent; last: last node inside; own: text outside of its children.
NODE = "struct<n:int,up:int,last:int,tag:string,cls:string,attrs:map<string,string>,text:string,own:string>"
Test = Callable[[Column], Column]


def page_trees(pages: DataFrame) -> DataFrame:
    """page_id, url, html, nodes (in document order; empty for missing or empty html)."""
    node = pa.struct([("n", pa.int32()), ("up", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("cls", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("own", pa.string())])

    def tree(html: str | None) -> list[dict]:
        rows = parse(html)
        last = last_inside([r[1] for r in rows])
        return [{"n": i, "up": up, "last": last[i], "tag": tag, "cls": c, "attrs": list(a.items()), "text": t, "own": own} for i, up, _, tag, c, a, t, own in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([tree(h) for h in part.column(2).to_pylist()], pa.list_(node))], names=["page_id", "url", "html", "nodes"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, f"page_id long, url string, html string, nodes array<{NODE}>")


def cards(trees: DataFrame, token: str) -> DataFrame:
    """page_id, url, card_index, nodes (those inside), text of every element whose class list holds the token."""
    d = trees.select("page_id", "url", "nodes", F.posexplode(F.filter("nodes", lambda n: has_class(n, token))).alias("card_index", "c"))
    inside = F.filter("nodes", lambda n: (n["n"] > F.col("c.n")) & (n["n"] <= F.col("c.last")))
    return d.select("page_id", "url", "card_index", inside.alias("nodes"), F.col("c.text").alias("text"))


def has_class(n: Column, token: str) -> Column:
    return n["cls"].contains(token) & F.array_contains(F.split(n["cls"], r"\s+"), token)  # few nodes pass the first test, and only these are split


def class_part(n: Column, *parts: str) -> Column:
    return any_of([n["cls"].contains(p) for p in parts])


def attr(n: Column, name: str) -> Column:
    return n["attrs"][name]


def href(n: Column) -> Column:
    return F.coalesce(n["attrs"]["href"], F.lit(""))


def is_link(n: Column) -> Column:
    return (n["tag"] == "a") & n["attrs"]["href"].isNotNull()


def within(n: Column, nodes: Column, test: Test) -> Column:
    """Whether an ancestor passes the test."""
    return F.exists(nodes, lambda a: (a["n"] < n["n"]) & (n["n"] <= a["last"]) & test(a))


def holds(n: Column, nodes: Column, test: Test) -> Column:
    """Whether a descendant passes the test."""
    return F.exists(nodes, lambda d: (d["n"] > n["n"]) & (d["n"] <= n["last"]) & test(d))


def first(nodes: Column, test: Test) -> Column:
    """The first node that passes, or null."""
    return F.get(F.filter(nodes, lambda n: test(n)), 0)


def texts(nodes: Column, test: Test) -> Column:
    return F.transform(F.filter(nodes, lambda n: test(n)), lambda n: n["text"])


def in_order(nodes: Column, tests: list[Test], good: Callable[[Column], Column], every: bool = False) -> Column:
    """The text of the first node of the first test whose text is good; with `every`, of all nodes of a test and not of its first alone."""
    def of(test: Test) -> Column:
        if every:
            return F.get(F.filter(texts(nodes, test), good), 0)
        return let(first(nodes, test)["text"], lambda t: F.when(good(t), t))

    return F.coalesce(*(of(t) for t in tests))


def page_text(nodes: Column) -> Column:
    """The visible text of the page, white space squeezed: of its body, or of everything where no body is marked."""
    return F.coalesce(first(nodes, lambda n: n["tag"] == "body")["text"], F.array_join(texts(nodes, lambda n: n["up"] == -1), " "))


def distinct_by_value(found: Column) -> Column:
    """Of structs with a field v, the first of each v."""
    return let(found, lambda f: let(F.transform(f, lambda x: x["v"]), lambda v: F.filter(f, lambda x, i: F.array_position(v, x["v"]) == i + 1)))


def joined_url(link: Column, url: Column) -> Column:
    return F.when(present(link).isNotNull(), absolute(link, url))
