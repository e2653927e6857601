"""Secret scans by multipart credential linking.

Strong spans (assignments, access ids, long hex) are always reported. Weak parts - user names, opaque strings, endpoints -
are reported only when complementary parts stand within one scope. Candidates are found inside tasks; the linking is a
Spark interval join: candidates are dealt to (document, bucket) cells as wide as the scope, each cell keeps the first and
last position of each role, and a weak part looks at its own cell and the two beside it. So no pairs of candidates arise.

Null text counts as empty; null ids, repeated rows and rows with one id and other texts each give their own row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import keep, text_key

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG = re.compile(r"[A-Za-z0-9+/_-]{20,}")
IDENT = re.compile(r"""(?:user_?name|user|login|client_?id|account(?:_?id)?|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""", re.I | re.A)
ENDPOINT = re.compile(r"""(?:[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]{4,}|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,})""", re.I | re.A)
WORDS = ("passw", "secret", "token", "api")
IDENTS = ("user", "login", "client", "account", "access")
#: In the order of the contract, then the parts that linking adds.
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")

SCANNED = (
    "row_id_ long, key_ long, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "base array<struct<start:int,kind:int,stop:int>>, weak array<struct<start:int,kind:int,stop:int>>"
)


def bits(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def scan(text: str) -> tuple[list, list]:
    """Strong and weak spans of one text as (start, kind, end) in code points."""
    base, weak = [], []
    low = text.lower()
    if any(w in low for w in WORDS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    runs = [(m.start(), m.end()) for m in LONG.finditer(text)]
    for a, b in runs:  # every long hex run lies in such a run
        base += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 32]
    base.sort()
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    if any(w in low for w in IDENTS):
        weak += [(m.start(), 3, m.end()) for m in IDENT.finditer(text)]
    for a, b in runs:
        s = text[a:b]
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and bits(s) >= 3.5:
            k = bisect_left(starts, b)  # strong spans that begin before its end
            if not k or reach[k - 1] <= a:
                weak.append((a, 4, b))
    if "://" in text or "host" in low or "endpoint" in low or "server" in low:
        weak += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return base, sorted(weak)


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        found = [scan(t or "") for t in batch.column(2).to_pylist()]
        counts = [Counter(k for _, k, _ in b) for b, _ in found]
        as_rows = lambda xs: [{"start": a, "kind": k, "stop": b} for a, k, b in xs]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)),
                pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]),
                pa.array([as_rows(b) for b, _ in found], span), pa.array([as_rows(w) for _, w in found], span),
            ],
            names=["row_id_", "key_", "n_assign", "n_access", "n_hex", "base_sha256", "base", "weak"],
        )


def confirmed(scanned: DataFrame, scope: int) -> DataFrame:
    """Weak parts with their complements within the scope: row_id_, key_, added (array of spans)."""
    cell = F.floor(F.col("s.start") / scope).cast("long")
    role = F.col("s.kind")
    name, secret = role.isin(1, 3), role.isin(0, 2, 4)
    linked = scanned.where(F.size("weak") > 0)
    parts = linked.select("row_id_", "key_", F.explode(F.concat("base", "weak")).alias("s")).distinct().withColumn("cell", cell)
    cells = parts.where(name | secret).groupBy("row_id_", "key_", "cell").agg(
        *(f(F.when(which, F.col("s.start"))).alias(f"{n}_{e}") for n, which in (("name", name), ("secret", secret)) for e, f in (("lo", F.min), ("hi", F.max)))
    )
    weak = parts.where(role >= 3).withColumn("at", F.explode(F.array(*(F.col("cell") + d for d in (-1, 0, 1)))))
    w, c = weak.alias("w"), cells.alias("c")
    pairs = w.join(c, F.col("w.row_id_").eqNullSafe(F.col("c.row_id_")) & (F.col("w.key_") == F.col("c.key_")) & (F.col("w.at") == F.col("c.cell")))
    near = lambda n: F.coalesce(  # noqa: E731  the cell's own parts, or the nearest end of the one beside it
        F.when(F.col("w.at") == F.col("w.cell"), F.col(f"c.{n}_lo").isNotNull())
        .when(F.col("w.at") < F.col("w.cell"), F.col("w.s.start") - F.col(f"c.{n}_hi") <= scope)
        .otherwise(F.col(f"c.{n}_lo") - F.col("w.s.start") <= scope),
        F.lit(False),
    )
    met = pairs.groupBy(F.col("w.row_id_").alias("row_id_"), F.col("w.key_").alias("key_"), F.col("w.s").alias("s")).agg(F.max(near("name")).alias("n"), F.max(near("secret")).alias("x"))
    kind = F.col("s.kind")
    good = F.when(kind == 3, F.col("x")).when(kind == 4, F.col("n")).otherwise(F.col("n") & F.col("x"))
    return met.where(good).groupBy("row_id_", "key_").agg(F.collect_list("s").alias("added"))


def link_credentials(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """One row per row of docs: id, counts and digest of the strong spans, and `found`, all spans sorted by (start, kind)."""
    rows = docs.select(F.col(id_col).cast("long").alias("row_id_"), text_key(F.col(text_col)).alias("key_"), F.col(text_col).cast("string").alias("t_"))
    scanned = keep(rows.mapInArrow(_scan, SCANNED), "spans")
    a, b = scanned.alias("a"), confirmed(scanned, scope).alias("b")
    out = a.join(b, F.col("a.row_id_").eqNullSafe(F.col("b.row_id_")) & (F.col("a.key_") == F.col("b.key_")), "left")
    spans = F.array_sort(F.concat(F.col("a.base"), F.coalesce(F.col("b.added"), F.expr("array()").cast("array<struct<start:int,kind:int,stop:int>>"))))
    return out.select(F.col("a.row_id_").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("found"))


def spans_text(found: str = "found"):
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.col(found), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op7_linked_secrets(spark, sf_dir: str) -> DataFrame:
    from .base import table

    out = link_credentials(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans_text().alias("spans"))
