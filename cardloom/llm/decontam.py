"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are cut into words (ASCII letters lowered, digits, and everything beyond ASCII). What counts is a shared span of
`span` words. Word k-grams are hashed, and of the hashes in every `span - k + 1` consecutive k-grams the least is kept, so
any two texts that share `span` words keep the same k-gram inside it. The kept k-grams of the documents meet those of the
benchmark's windows in a hash join; each meeting is extended to the whole window and compared word by word, so hashes
never decide. A benchmark item of fewer than `span` words is one window of its own length: its own hash takes the place
of the k-gram, and documents then offer their runs of all such lengths in one further pass.

The benchmark's windows are broadcast where they are `block_rows` distinct ones at most: what leaves the scan is then one row
for each hit, and a hot passage that many documents share stays where its documents are. A larger benchmark meets the
documents' fingerprints, each with the few words around it, in a shuffled join whose skewed keys AQE splits. Either way each
document is read once for k-grams, once for short runs if there are any, and once for its count of words.

Null text has no words; an item without words has no windows; an item with a null id marks words but is not named;
repeated rows give a row each; empty tables are fine; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ascii_lower, table, text_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lowering, for counting.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), GAPS), lambda w: w != "")


def windows_of(items: DataFrame, id_col: str, text_col: str, span: int, k: int) -> DataFrame:
    """Distinct windows: len, body (words joined by a space), shift and print_ of the kept k-gram, ids (its items)."""
    w = items.select(F.col(id_col).cast("string").alias("item_"), words(F.col(text_col)).alias("w_")).where(F.size("w_") > 0)
    n = F.least(F.size("w_"), F.lit(span))
    each = w.select("item_", n.alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w_") - n + 1), lambda i: F.slice("w_", i, n))).alias("s_"))
    runs = each.groupBy("len", "s_").agg(F.collect_set("item_").alias("ids"))
    grams = F.transform(F.sequence(F.lit(0), F.lit(span - k)), lambda i: F.xxhash64(*(F.xxhash64(F.get("s_", i + j)) for j in range(k))))
    least = F.array_min(grams)
    full = runs.where(F.col("len") == span).select("len", "s_", "ids", least.alias("print_"), (F.array_position(grams, least) - 1).cast("int").alias("shift"))
    short = runs.where(F.col("len") < span).select("len", "s_", "ids", F.xxhash64(F.array_join("s_", " ")).alias("print_"), F.lit(0).alias("shift"))
    return full.unionByName(short).select("len", F.array_join("s_", " ").alias("body"), "shift", "print_", "ids")


def fingerprints(base: DataFrame, span: int, k: int) -> DataFrame:
    """id_, key_, w_, spot, h, n: the kept k-grams of each document."""
    width = span - k + 1
    hashes = F.transform("w_", lambda w: F.xxhash64(w))
    # a k-gram's hash from those of its words, so that each word is hashed once
    grams = F.transform(F.sequence(F.lit(0), F.size("x_") - k), lambda i: F.xxhash64(*(F.get("x_", i + j) for j in range(k))))
    g = base.where(F.size("w_") >= span).withColumn("x_", hashes).withColumn("g_", grams)
    # the least of the run of k-grams that begins at i, then a k-gram is kept if it is the least of some run it is in
    g = g.withColumn("m_", F.transform(F.sequence(F.lit(0), F.size("g_") - width), lambda i: F.least(*(F.get("g_", i + j) for j in range(width)))))
    # a run keeps its first least k-gram; it is a new one if the least has changed or if the one before has just left the run
    fresh = lambda m, i: (i == 0) | (m != F.get("m_", i - 1)) | (F.get("g_", i - 1) == m)
    kept = F.filter(F.transform("m_", lambda m, i: F.struct(F.when(fresh(m, i), m).alias("h"), i.alias("i"))), lambda s: s["h"].isNotNull())
    g = g.select("id_", "key_", "w_", "g_", F.explode(kept).alias("p_"))
    spot = F.coalesce(*(F.when(F.get("g_", F.col("p_.i") + j) == F.col("p_.h"), F.col("p_.i") + j) for j in range(width)))
    return g.select("id_", "key_", "w_", spot.alias("spot"), F.col("p_.h").alias("h"), F.lit(span).alias("n"))


def short_runs(base: DataFrame, lengths: list[int]) -> DataFrame:
    """id_, key_, w_, spot, h, n: every run of the given lengths."""
    def runs(n: int) -> Column:
        none = F.array().cast("array<struct<spot:int,h:bigint,n:int>>")
        return F.when(F.size("w_") >= n, F.transform(F.sequence(F.lit(0), F.size("w_") - n), lambda i: F.struct(i.alias("spot"), F.xxhash64(F.array_join(F.slice("w_", i + 1, F.lit(n)), " ")).alias("h"), F.lit(n).alias("n")))).otherwise(none)

    return base.select("id_", "key_", "w_", F.explode(F.flatten(F.array(*map(runs, lengths)))).alias("r")).select("id_", "key_", "w_", "r.spot", "r.h", "r.n")


def hits(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, span: int, k: int, lengths: list[int], small: bool) -> DataFrame:
    """id_, key_, at, len, ids: every occurrence of every window."""
    base = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("t_"))
    base = base.select("id_", text_key(F.col("t_")).alias("key_"), words(F.col("t_")).alias("w_"))
    short = [n for n in lengths if n < span]
    out = []
    for d, some in ([(fingerprints(base, span, k), F.col("len") == span)] if span in lengths else []) + ([(short_runs(base, short), F.col("len") < span)] if short else []):
        d = d.withColumns({"size_": F.size("w_"), "from_": F.lit(0)})
        if not small:  # only the words that a window around the spot may hold go through the shuffle
            d = d.withColumn("from_", F.greatest(F.col("spot") - (span - k), F.lit(0)))
            d = d.withColumn("w_", F.slice("w_", F.col("from_") + 1, F.lit(2 * span)))
        part = windows.where(some).withColumnRenamed("len", "n")
        met = d.join(F.broadcast(part) if small else part, (d["h"] == part["print_"]) & (d["n"] == part["n"])).drop(part["n"])
        at = F.col("spot") - F.col("shift")
        met = met.where((at >= 0) & (at + F.col("n") <= F.col("size_")))
        out.append(met.where(F.array_join(F.slice("w_", at - F.col("from_") + 1, F.col("n")), " ") == F.col("body")).select("id_", "key_", at.alias("at"), F.col("n").alias("len"), "ids"))
    return reduce(DataFrame.unionByName, out) if out else None


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", span: int = 10, k: int = 5, block_rows: int = 500_000,
) -> DataFrame:
    """One row per row of docs: id_, key_, n_words, at_ (array of struct<at, len>, null if none), items_ (sorted item ids)."""
    windows = windows_of(items, item_id_col, item_text_col, span, k)
    sizes = {r["len"]: r["n"] for r in windows.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most `span` rows
    small = sum(sizes.values()) <= block_rows
    base = docs.select(F.col(id_col).alias("id_"), text_key(F.col(text_col)).alias("key_"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(ANY_WORD)), F.lit(0)).cast("long").alias("n_words"))
    found = hits(docs, windows, id_col, text_col, span, k, sorted(sizes, reverse=True), small)
    if found is None:
        return base.withColumn("at_", F.lit(None).cast("array<struct<at:int,len:int>>")).withColumn("items_", F.lit(None).cast("array<string>"))
    per = found.groupBy(F.col("id_").alias("hit_id_"), F.col("key_").alias("hit_key_")).agg(
        F.collect_set(F.struct("at", "len")).alias("at_"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items_")
    )
    return base.join(per, base["id_"].eqNullSafe(per["hit_id_"]) & (base["key_"] == per["hit_key_"]), "left").select("id_", "key_", "n_words", "at_", "items_")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("at_", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))))
    n_hit = F.when(F.col("at_").isNull(), 0).otherwise(hit).cast("long")
    ids = F.coalesce(F.col("items_"), F.expr("array()").cast("array<string>"))
    return out.select(
        F.col("id_").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""with d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
bn as (select item_id, w, least(len(w), 10) as n from b where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(w[p : p + n - 1], ' ') as t from (select *, unnest(range(1, len(w) - n + 2)) as p from bn)),
ns as (select distinct n from bw),
dp as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, ns where len(w) >= n),
dw as (select doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') as t from dp),
h as (select distinct dw.doc_id, dw.n, dw.p, bw.item_id from dw join bw on dw.n = bw.n and dw.t = bw.t),
hw as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(p, p + n)) as x from h) group by 1),
hi as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as s from (select distinct doc_id, item_id::varchar as i from h where item_id is not null) group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(hw.n_hit, 0)::bigint as n_hit, coalesce(hi.n_items, 0)::bigint as n_items,
 sha256(coalesce(hi.s, '')) as items_sha256, coalesce(hw.n_hit, 0) > 0 as contaminated
from d left join hw using (doc_id) left join hi using (doc_id)"""
