"""CSS selectors as conditions on rows of `html_nodes`, for rules that the rest of a plan counts, orders or joins.

Known: a tag, `*`, `.class`, `#id`, `[attribute]`, `[attribute op "value" i]` with the operators = *= ^= $= ~=, `:not(...)` of these, ancestors
by tag (`nav a`), `:in(tag)` for an element below a tag, and lists with commas. Anything else is an error when the plan is built.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = re.compile(
    r"""(?P<tag>^[a-zA-Z][\w-]*|^\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)"""
    r"""|\[(?P<name>[\w-]+)(?:(?P<op>[*^$~]?=)(?P<q>["']?)(?P<value>[^"'\]]*)(?P=q)(?P<fold>\s+i)?)?\]|:not\((?P<no>[^()]*)\)|:in\((?P<inside>[\w-]+)\)"""
)


def _holds(value: Column, op: str | None, wanted: str, fold: bool) -> Column:
    if op is None:
        return value.isNotNull()
    value, wanted = (F.lower(value), wanted.lower()) if fold else (value, wanted)
    tests = {"=": lambda: value == wanted, "*=": lambda: value.contains(wanted), "^=": lambda: value.startswith(wanted), "$=": lambda: value.endswith(wanted), "~=": lambda: F.array_contains(F.split(value, r"\s+"), wanted)}
    return F.lit(False) if op in ("*=", "^=", "$=") and not wanted else tests[op]()


def _simple(text: str) -> Column:
    """One element's own conditions."""
    at, tests = 0, []
    while at < len(text):
        m = PART.match(text, at) if at == 0 or text[at] in ".#[:" else None
        if not m:
            raise ValueError(f"selector not understood at {text[at:]!r} in {text!r}")
        at = m.end()
        if m["tag"]:
            tests.append(F.lit(True) if m["tag"] == "*" else F.col("tag") == m["tag"].lower())
        elif m["cls"]:
            tests.append(F.col("class").contains(m["cls"]) & F.array_contains(F.split("class", r"\s+"), m["cls"]))
        elif m["id"]:
            tests.append(F.col("attrs")["id"] == m["id"])
        elif m["no"]:
            tests.append(~css(m["no"]))
        elif m["inside"]:
            tests.append(F.col("path").contains(f"/{m['inside'].lower()}/"))
        else:
            tests.append(_holds(F.col("attrs")[m["name"].lower()], m["op"], m["value"] or "", bool(m["fold"])))
    return reduce(lambda a, b: a & b, tests)


def _split(text: str, sign: str) -> list[str]:
    """text cut at a sign that stands outside of brackets and quotes."""
    out, depth, quote, at = [""], 0, "", 0
    while at < len(text):
        c = text[at]
        quote = "" if c == quote else quote or (c if c in "\"'" else "")
        depth += 0 if quote else (c in "[(") - (c in "])")
        if c == sign and not depth and not quote:
            out.append("")
        else:
            out[-1] += c
        at += 1
    return [x.strip() for x in out if x.strip()]


def css(text: str) -> Column:
    """Whether a node row (tag, class, attrs, path) matches the selector; never null."""
    def one(selector: str) -> Column:
        *above, last = _split(selector, " ")
        tests = [_simple(last)]
        for tag in above:
            if not re.fullmatch(r"[a-zA-Z][\w-]*", tag):
                raise ValueError(f"only tags may stand before a space: {selector!r}")
        if above:
            tests.append(F.col("path").rlike("(^|/)" + "/(.*/)?".join(t.lower() for t in above) + "/"))
        return reduce(lambda a, b: a & b, tests)

    return F.coalesce(reduce(lambda a, b: a | b, map(one, _split(text, ","))), F.lit(False))


def whole_number(c: Column) -> Column:
    """The whole number that a text begins with, or null."""
    return F.regexp_extract(c, r"^\s*([+-]?\d{1,18})", 1).try_cast("long")
