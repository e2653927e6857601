"""Line dedup over overlapping three-line windows, in DataFrame functions only.

A text is split at line feeds. Every three consecutive lines, not all of them empty, form a window. Among equal windows of
the whole corpus the one that stands first, by (document id, line), stays; every later one is removed, and what is removed
from a text is the union of the positions its later windows cover. A text of fewer than three lines is one window of its
own, equal only to texts of the same lines.

Windows are compared by a 64-bit and an independent 32-bit hash of their lines. Counting them is a hash aggregate
with map-side combining, so a window that a third of all rows share costs one row per task; only repeated windows meet
the documents' windows again, in an equi-join whose skewed keys AQE splits.

Null text gives null, with no lines; a null id stands before all others; repeated rows (same id, same text) count as one
text and are treated alike; an empty table gives an empty result; other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import table, text_key


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per window: w1, w2 (hashes), id_, key_, pos, span (its lines)."""
    lines = docs.select(F.col(id_col).alias("id_"), text_key(F.col(text_col)).alias("key_"), F.split(F.col(text_col), "\n", -1).alias("l_"))
    at = lines.where(F.col("l_").isNotNull()).select("id_", "key_", "l_", F.least(F.size("l_"), F.lit(3)).alias("span"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("l_") - 3, F.lit(0)))).alias("pos"))
    three = [F.get("l_", F.col("pos") + k) for k in range(3)]
    some = F.coalesce(*three) != ""
    for t in three[1:]:
        some = some | F.coalesce(t != "", F.lit(False))
    return at.where(some).select(F.xxhash64("span", *three).alias("w1"), F.hash("span", *three).alias("w2"), "id_", "key_", "pos", "span")


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_, key_, covered: the sorted positions that later windows cover, for the texts that have any."""
    windows = _windows(docs, id_col, text_col)
    place = F.struct("id_", "key_", "pos")
    repeated = windows.groupBy("w1", "w2").agg(F.min(place).alias("first_"), F.max(place).alias("last_")).where(~F.col("first_").eqNullSafe(F.col("last_"))).select("w1", "w2", "first_")
    later = windows.join(repeated, ["w1", "w2"]).where(~place.eqNullSafe(F.col("first_")))
    starts = later.groupBy("id_", "key_").agg(F.collect_set("pos").alias("starts_"), F.max("span").alias("span"))
    spread = F.flatten(F.transform("starts_", lambda p: F.sequence(p, p + F.col("span") - 1)))
    return starts.select("id_", "key_", F.array_sort(F.array_distinct(spread)).alias("covered"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text rewritten, and lines_total_, lines_removed_ (long)."""
    d = docs.withColumn("dedup_key_", text_key(F.col(text_col)))
    c = covered_lines(docs, id_col, text_col).withColumnsRenamed({"id_": "dedup_id_", "key_": "dedup_match_"})
    both = d.join(c, d[id_col].eqNullSafe(c["dedup_id_"]) & (d["dedup_key_"] == c["dedup_match_"]), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered"))
    text = F.when(F.col("covered").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    total = F.when(F.col(text_col).isNull(), 0).otherwise(F.length(F.col(text_col)) - F.length(F.translate(F.col(text_col), "\n", "")) + 1).cast("long")
    removed = F.coalesce(F.size("covered"), F.lit(0)).cast("long")
    return both.select(*(text.alias(n) if n == text_col else d[n] for n in docs.columns), total.alias("lines_total_"), removed.alias("lines_removed_"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("lines_total_").alias("n_lines"), F.col("lines_removed_").alias("n_removed"), sha(F.col("text")).alias("text_sha256"))


def sha(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


SQL_LINES = """
l as (select doc_id, text, string_split(text, chr(10)) as a from documents),
w as (select doc_id, text, p, n, n || ':' || array_to_string(a[p : p + 2], chr(10)) as t
      from (select doc_id, text, a, least(len(a), 3) as n, unnest(range(1, greatest(len(a) - 1, 2))) as p from l where text is not null)),
f as (select *, min({'d': doc_id, 'p': p}) over (partition by t) as first_one from w where t not in ('1:', '2:' || chr(10), '3:' || chr(10) || chr(10))),
c as (select doc_id, text, list_distinct(flatten(list(range(p, p + n)))) as cov
      from f where first_one <> {'d': doc_id, 'p': p} group by doc_id, text)"""

ORACLE = f"""with {SQL_LINES}
select l.doc_id, coalesce(len(l.a), 0)::bigint as n_lines, coalesce(len(c.cov), 0)::bigint as n_removed,
 sha256(coalesce(case when c.cov is null then l.text else
   array_to_string(list_transform(list_filter(range(1, len(l.a) + 1), lambda i: not list_contains(c.cov, i)), lambda i: l.a[i]), chr(10)) end, '')) as text_sha256
from l left join c on l.doc_id is not distinct from c.doc_id and l.text = c.text"""
