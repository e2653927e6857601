"""Audit of how filters interact, with exact copies found in radix tries.

Each text gets a mask of the filters that it fails. Filters A to D look at the text alone. E, a copy of a text of a smaller id,
needs all texts: they are dealt out by ranges of prefixes and put whole into compressed tries, one for each range, whose terminals
hold the smallest id of their text. Walking the tries gives the flags; the masks are then reduced to counts for each part.

Ranges are adaptive: a prefix that weighs more than a range's share is cut further by its next character, by a bounded sample of texts. What
is still heavier than a trie may be (SLOT bytes) is dealt out by a digest of the whole text besides, so that equal texts meet and
a long common beginning doesn't bring unequal ones into one task. The bounds decide where a text goes, never what is found.
A batch sends equal texts once, with all their ids. Digests of more than one in HOT of all rows (HOT of them at most,
counted) are also salted: their tries find the smallest id of each salt, a second level that of all.

Filters: A under 50 words; B fewer than 65 in 100 words distinct; C over 5 in 100 code points are A-Z; D a sign of `#$%&*|`; E.
Words are what stands between ASCII white space. Null text counts as empty; a null part is the empty string; a null id is no smaller and no
larger than others and has no label; repeated rows of the smallest id don't fail E; repeated labels count if any does; an empty table
gives an empty result; ids are read as long; further columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby, permutations
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import keep, table

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: The sample's rows and characters of each, ranges at most about, bytes of texts in a trie, hot share (one in so many), rows of a broadcast.
SAMPLE, PREFIX, RANGES, SLOT, HOT, SMALL = 20_000, 64, 1024, 16 << 20, 2000, 200_000
CAPITALS, SIGNS = bytes(range(65, 91)), b"#$%&*|"


def text_mask(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()  # bytes are split at ASCII white space
    few = len(words) < 50
    dull = 100 * len(set(words)) < 65 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 5 * len(text)
    odd = len(raw.translate(None, SIGNS)) < len(raw)
    return few | dull << 1 | loud << 2 | odd << 3


class Trie:
    """A compressed trie: a node is [label, children by first character, terminal or -1]; smallest[t] is the least id at terminal t."""

    def __init__(self):
        self.root, self.smallest = ["", {}, -1], []

    def insert(self, text: str, least: int | None) -> int:
        """The terminal of text, with least taken into its smallest id."""
        node, at = self.root, 0
        while at < len(text):
            below = node[1].get(text[at])
            if below is None:
                node[1][text[at]] = node = [text[at:], {}, -1]
                break
            label = below[0]
            if not text.startswith(label, at):
                k = common(label, text, at)
                upper = [label[:k], {label[k]: below}, -1]
                below[0] = label[k:]
                node[1][text[at]] = below = upper
            node, at = below, at + len(below[0])
        if node[2] < 0:
            node[2] = len(self.smallest)
            self.smallest.append(None)
        t, old = node[2], self.smallest[node[2]]
        if least is not None and (old is None or least < old):
            self.smallest[t] = least
        return t

    def walk(self) -> Iterator[tuple[int, str]]:
        """Each terminal with its text."""
        stack = [(self.root, "")]
        while stack:
            (label, children, t), before = stack.pop()
            text = before + label
            if t >= 0:
                yield t, text
            stack += [(c, text) for c in children.values()]


def common(label: str, text: str, at: int) -> int:
    """How many first characters of label stand in text at `at`: some, but not all."""
    low, high = 0, 1
    while text.startswith(label[low:high], at + low):
        low, high = high, min(len(label), 2 * high)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if text.startswith(label[low:mid], at + low) else (low, mid)
    return low


def adaptive_ranges(sample: list[tuple[str, int]], share: float, depth: int = PREFIX) -> tuple[list[str], list[int]]:
    """Prefixes at which ranges begin, ascending, and the weight of each range, what lies before the first one included.

    A character's texts join the range before it while it is light; those of a heavy one are cut by the next character.
    """
    bounds, weights = [], [0]

    def cut(items: list[tuple[str, int]], k: int) -> None:
        for head, group in groupby(items, key=lambda x: x[0][: k + 1]):
            group = list(group)
            weight = sum(w for _, w in group)
            if weights[-1] and weights[-1] + weight > share:
                bounds.append(head)
                weights.append(0)
            if weight > share and k + 1 < depth and len(head) > k:
                cut(group, k + 1)
            else:
                weights[-1] += weight

    cut(sorted(sample), 0)
    return bounds, weights


def _dealer(bounds: list[str], parts: list[int]):
    """Rows (id_, part_, t_, salts_) to records of slot_, salt_, hot_, t_, mask_, ids_, parts_: equal texts of a batch are one."""
    first = np.cumsum([0, *parts]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list] = {}
            for i, part, text, salts in zip(*(batch.column(n).to_pylist() for n in ("id_", "part_", "t_", "salts_")), strict=True):
                ids, names, _ = by.setdefault(text, ([], [], salts))
                ids.append(i)
                names.append(part)
            rows = []
            for text, (ids, names, salts) in by.items():
                r = bisect_right(bounds, text[:PREFIX])
                slot = first[r] + (crc32(text.encode()) % parts[r] if parts[r] > 1 else 0)
                rows.append((slot, crc32(repr((ids[0], names[0])).encode()) % salts if salts else 0, bool(salts), text, text_mask(text), ids, names))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = (pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["slot_", "salt_", "hot_", "t_", "mask_", "ids_", "parts_"])

    return run


FOUND = "id_ long, part_ string, mask_ int, slot_ int, salt_ int, term_ int, t_ string, min_ long"
FOUND_TYPES = [("id_", pa.int64()), ("part_", pa.string()), ("mask_", pa.int32()), ("slot_", pa.int32()), ("salt_", pa.int32()), ("term_", pa.int32()), ("t_", pa.string()), ("min_", pa.int64())]


def _least(ids: list[int | None]) -> int | None:
    return min((i for i in ids if i is not None), default=None)


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records in the order of their slots and salts to a row per document; a hot text's terminal adds a row with t_ and min_."""

    def done(place: tuple[int, int], trie: Trie, held: list) -> Iterator[pa.RecordBatch]:
        hot = {t for t, *_, h in held if h}
        out: list[tuple] = [(None, None, None, *place, t, text, trie.smallest[t]) for t, text in trie.walk() if t in hot] if hot else []
        for t, mask, ids, parts, h in held:
            least = trie.smallest[t]
            out += [(i, p, mask | (COPY if i is not None and not h and i > least else 0), *place, t if h else None, None, None) for i, p in zip(ids, parts, strict=True)]
            if len(out) >= 20_000:
                yield record(out)
                out = []
        yield record(out)

    def record(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(FOUND_TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, FOUND_TYPES, strict=True)], [n for n, _ in FOUND_TYPES])

    place, trie, held = None, Trie(), []
    for batch in batches:
        for slot, salt, hot, text, mask, ids, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (slot, salt) != place:
                if held:
                    yield from done(place, trie, held)
                place, trie, held = (slot, salt), Trie(), []
            held.append((trie.insert(text, _least(ids)), mask, ids, parts, hot))
    if held:
        yield from done(place, trie, held)


def _smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hot texts' rows (slot_, salt_, term_, t_, min_) in the order of their slots, to the smallest id of each text for each of its rows."""

    def done(trie: Trie, held: list) -> pa.RecordBatch:
        cols = list(zip(*((*place, trie.smallest[t]) for t, place in held), strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["hslot_", "hsalt_", "hterm_", "least_"])

    last, trie, held = None, Trie(), []
    for batch in batches:
        for slot, salt, term, text, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if slot != last:
                yield done(trie, held)
                last, trie, held = slot, Trie(), []
            held.append((trie.insert(text, least), (slot, salt, term)))
    yield done(trie, held)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", slot: int = SLOT, hot: int = HOT, ranges: int = RANGES) -> DataFrame:
    """One row per document: id_ (long), part_, mask_ (bit k: it fails the k-th filter)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id_"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part_"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t_"))
    rows = rows.withColumn("d_", F.xxhash64("t_"))
    weights = keep(rows.groupBy("d_").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("t_")).cast("long").alias("bytes"), F.min(F.left("t_", F.lit(PREFIX))).alias("head")), "weights")
    total, mass = weights.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("bytes") + 64), F.lit(0))).first()
    heavy = weights.where(F.col("n") * hot > total).select("d_", F.ceil(F.col("n") * hot / F.lit(max(total, 1))).cast("int").alias("salts_"))
    sample = [(r["head"], r["bytes"] + 64) for r in weights.orderBy(F.xxhash64("d_"), "d_").limit(SAMPLE).select("head", "bytes").collect()]
    seen = sum(w for _, w in sample)
    bounds, of_range = adaptive_ranges(sample, max(seen / ranges, 1))
    parts = [max(1, -(-2 * w * mass // max(seen, 1) // slot)) for w in of_range]
    dealt = rows.join(F.broadcast(heavy), "d_", "left").select("id_", "part_", "t_", "salts_")
    dealt = dealt.mapInArrow(_dealer(bounds, parts), "slot_ int, salt_ int, hot_ boolean, t_ string, mask_ int, ids_ array<long>, parts_ array<string>")
    found = keep(dealt.repartition("slot_", "salt_").sortWithinPartitions("slot_", "salt_").mapInArrow(_flagged, FOUND), "flags")
    least = found.where("t_ is not null").select("slot_", "salt_", "term_", "t_", "min_").repartition("slot_").sortWithinPartitions("slot_")
    least = least.mapInArrow(_smallest, "hslot_ int, hsalt_ int, hterm_ int, least_ long")
    own = found.where("t_ is null")
    copies = own.where("term_ is not null").join(least, [F.col("slot_") == F.col("hslot_"), F.col("salt_") == F.col("hsalt_"), F.col("term_") == F.col("hterm_")])
    mask = F.col("mask_").bitwiseOR(F.when(F.col("id_") > F.col("least_"), COPY).otherwise(0)).alias("mask_")
    return own.where("term_ is null").select("id_", "part_", "mask_").unionByName(copies.select("id_", "part_", mask))


def _tables() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of each row, and for each measure a row of zeros and ones over the 32 masks."""
    masks, rows = np.arange(1 << len(FILTERS)), []
    hits: dict[str, list] = {n: [] for n in ("kept", "removed", "redundant", "unique_fails")}
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails, gone = masks & bit > 0, masks & before > 0
            rows.append(("".join(order), step))
            for n, hit in (("kept", masks & (before | bit) == 0), ("removed", fails & ~gone), ("redundant", fails & gone), ("unique_fails", masks == bit)):
                hits[n].append(hit)
            before |= bit
    return rows, {n: np.array(h, np.int64) for n, h in hits.items()}


AUDIT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _orders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A part's counts by mask to its rows, one for each order and step."""
    rows, hits = _tables()
    last = np.array([FILTERS.index(o[s - 1]) for o, s in rows])
    for frame in frames:
        for part, counts in zip(frame["part_"], frame["counts_"], strict=True):
            n = np.zeros((1 << len(FILTERS), 3), np.int64)
            for c in counts:
                n[c["mask_"]] += (c["n"], c["good"], c["toxic"])
            out = {k: hits[k] @ n[:, 0] for k in hits} | {"good_lost": hits["removed"] @ n[:, 1], "toxic_lost": hits["removed"] @ n[:, 2]}
            out["shapley"] = np.bincount(last, out["removed"], len(FILTERS)).astype(np.int64)[last]
            yield pd.DataFrame({"part": part, "filter_order": [o for o, _ in rows], "step": np.array([s for _, s in rows], np.int32)} | {k: out[k] for k in AUDIT})


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", small: int = SMALL, **options) -> DataFrame:
    """part, filter_order, step and the counts of AUDIT; labels has doc_id, quality and toxic."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id_"))
    known = keep(known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "labels")
    rows = failures(docs, id_col, text_col, part_col, **options)
    marked = rows.where("id_ is not null").join(F.broadcast(known) if known.count() <= small else known, F.col("id_") == F.col("label_id_"), "left").select("part_", "mask_", "good", "toxic")
    marked = marked.unionByName(rows.where("id_ is null").select("part_", "mask_", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic")))
    reduced = marked.groupBy("part_", "mask_").agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")))
    counts = reduced.groupBy("part_").agg(F.collect_list(F.struct("mask_", "n", "good", "toxic")).alias("counts_"))  # 32 masks at most
    return counts.mapInPandas(_orders, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in AUDIT))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


ORACLE = r"""with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, coalesce(doc_id > min(doc_id) over (partition by coalesce(text, '')), false) as fe from documents),
w as (select doc_id, part, t, fe, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from t),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
f as (select w.doc_id, part, (len(ws) < 50)::int + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int
   + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * fe::int as m, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from w left join l on w.doc_id = l.doc_id),
c as (select part, m, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, m),
e as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, b)),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits from e a, e b, e c, e d, e
      where a.b + b.b + c.b + d.b + e.b = 31 and a.b <> b.b and (a.b | b.b | c.b | d.b | e.b) = 31),
s as (select filter_order, step, bits[step] as bit, list_sum(bits[1 : step - 1])::int as was from (select *, unnest([1, 2, 3, 4, 5]) as step from o)),
r as (select part, filter_order, step, bit, sum(n * ((m & (coalesce(was, 0) | bit)) = 0)::int)::bigint as kept,
   sum(n * ((m & bit) > 0 and (m & coalesce(was, 0)) = 0)::int)::bigint as removed, sum(n * ((m & bit) > 0 and (m & coalesce(was, 0)) > 0)::int)::bigint as redundant,
   sum(n * (m = bit)::int)::bigint as unique_fails, sum(good * ((m & bit) > 0 and (m & coalesce(was, 0)) = 0)::int)::bigint as good_lost,
   sum(toxic * ((m & bit) > 0 and (m & coalesce(was, 0)) = 0)::int)::bigint as toxic_lost from c, s group by part, filter_order, step, bit)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from r"""
