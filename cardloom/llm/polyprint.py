"""Exact dedup by composable polynomial fingerprints.

A text's UTF-8 bytes are cut into pieces. A piece b_0 ... b_m of bytes has the hash sum(b_i * B^(m-i)) mod p, and the hash of
two pieces one after another is h(x) * B^len(y) + h(y): a document's fingerprint is the sum of its pieces' hashes, each
shifted by the number of bytes behind it. Pieces are hashed wherever they lie, in any order, and meet as numbers in a sum that
combines map-side; `fingerprints_of_pieces` does so for documents that are stored in pieces. Two primes and the length make
the fingerprint.

Equal fingerprints are not taken for equal texts: within each group every document is compared with the one of the largest
id, piece by piece (no task holds a whole text for it). Those that differ form a group of their own, until none differs.
A group's comparisons are dealt out by salts, so copies that are a third of all rows are spread over tasks; the row that they
are compared with goes to each salt.

Null text counts as empty, and empty texts are equal to one another; a null id stands before all others; of repeated rows (same id,
same text) one stays; an empty table gives an empty result; further columns of the input, whatever their names, pass through `drop_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import keep, table, text_key

#: Bytes of a piece, and (prime, base) of each hash; a prime is under 2^31, so that a piece's products add up within 64 bits.
PIECE = 65_536
HASHES = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 48_271))
#: Comparisons of one salt; rows of a table that may be broadcast; and the share of all rows (one in so many) from which a group is hot.
SALT, SMALL, HOT = 256, 200_000, 2000
GROUP = ["f1_", "f2_", "n_"]


def piece_hash(hashes=HASHES, size: int = PIECE):
    """A function for mapInArrow: binary column `piece_` to h1_, h2_; the other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = []
        for p, b in hashes:
            x = [1]
            while len(x) < size:
                x.append(x[-1] * b % p)
            powers.append(np.array(x[::-1], np.uint64))
        for batch in batches:
            at = batch.schema.get_field_index("piece_")
            col = batch.column(at)
            texts = [np.frombuffer(x.as_buffer(), np.uint8) for x in col]
            out = [pa.array([int(t @ w[size - len(t) :]) % p for t in texts], pa.int64()) for (p, _), w in zip(hashes, powers, strict=True)]
            names = [n for n in batch.schema.names if n != "piece_"]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + out, [*names, "h1_", "h2_"])

    return run


def shifted(h: str, after: str, prime: int, base: int) -> Column:
    """h * base^after mod prime, by the binary digits of after."""
    squares = [base % prime]
    while len(squares) < 40:
        squares.append(squares[-1] ** 2 % prime)
    power = F.aggregate(
        F.sequence(F.lit(0), F.lit(39)), F.col(h),
        lambda acc, k: F.when(F.getbit(F.col(after), k) == 1, acc * F.get(F.lit(squares), k) % F.lit(prime)).otherwise(acc),
    )
    return F.when(F.col(after) == 0, F.col(h)).otherwise(power)


def _hashed(pieces: DataFrame, keys: list[str], hashes, size: int) -> DataFrame:
    """One row per document from rows of keys, after_ (bytes behind the piece) and piece_: keys, f1_, f2_."""
    schema = ", ".join(f"{n} {pieces.schema[n].dataType.simpleString()}" for n in [*keys, "after_"])
    hashed = pieces.select(*keys, "after_", "piece_").mapInArrow(piece_hash(hashes, size), f"{schema}, h1_ long, h2_ long")
    sums = [(F.sum(shifted(f"h{i}_", "after_", p, b)) % F.lit(p)).alias(f"f{i}_") for i, (p, b) in enumerate(hashes, 1)]
    return hashed.groupBy(*keys).agg(*sums)


def _pieces(docs: DataFrame, id_col: str, text_col: str, size: int, *more: Column) -> DataFrame:
    """id_, key_, n_ (bytes), more, i_, after_ and piece_ of each text; each text has a piece, if an empty one."""
    rows = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t_"))
    rows = rows.select("id_", text_key(F.col("t_")).alias("key_"), F.octet_length("t_").cast("long").alias("n_"), *more, F.col("t_").cast("binary").alias("b_"))
    last = F.floor((F.greatest(F.col("n_"), F.lit(1)) - 1) / size).cast("int")
    cut = rows.withColumn("i_", F.explode(F.sequence(F.lit(0), last))).withColumn("piece_", F.substring("b_", F.col("i_") * size + 1, F.lit(size)))
    return cut.withColumn("after_", F.greatest(F.col("n_") - (F.col("i_").cast("long") + 1) * size, F.lit(0))).drop("b_")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes=HASHES, size: int = PIECE) -> DataFrame:
    """One row per document: row_ (tells rows apart), id_, key_, sha256_, n_ (bytes), f1_, f2_."""
    pieces = _pieces(docs, id_col, text_col, size, F.monotonically_increasing_id().alias("row_"), F.sha2(F.col("t_"), 256).alias("sha256_"))
    return _hashed(pieces, ["row_", "id_", "key_", "sha256_", "n_"], hashes, size)


def fingerprints_of_pieces(pieces: DataFrame, id_col: str, no_col: str, text_col: str, hashes=HASHES, size: int = PIECE) -> DataFrame:
    """id_, n_, f1_, f2_ of documents that are stored as numbered pieces of any length; the same as of the whole texts.

    Only hashes and lengths of pieces meet in a document's window, never texts.
    """
    p = pieces.select(F.col(id_col).alias("id_"), F.col(no_col).alias("no_"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("b_"))
    p = p.withColumn("len_", F.length("b_").cast("long"))
    p = p.withColumn("i_", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.col("len_"), F.lit(1)) - 1) / size).cast("int"))))
    p = p.select("id_", "no_", "i_", F.substring("b_", F.col("i_") * size + 1, F.lit(size)).alias("piece_")).withColumn("len_", F.length("piece_").cast("long"))
    schema = ", ".join(f"{n} {p.schema[n].dataType.simpleString()}" for n in ("id_", "no_", "i_", "len_"))
    h = p.select("id_", "no_", "i_", "len_", "piece_").mapInArrow(piece_hash(hashes, size), f"{schema}, h1_ long, h2_ long")
    behind = Window.partitionBy("id_").orderBy(F.desc("no_"), F.desc("i_")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("after_", F.coalesce(F.sum("len_").over(behind), F.lit(0)))
    sums = [(F.sum(shifted(f"h{i}_", "after_", q, b)) % F.lit(q)).alias(f"f{i}_") for i, (q, b) in enumerate(hashes, 1)]
    return h.groupBy("id_").agg(F.sum("len_").alias("n_"), *sums)


def with_groups(rows: DataFrame, groups: DataFrame, on: list[str], total: int, small: int = SMALL, how: str = "left") -> DataFrame:
    """rows joined to groups (which has a size_). A small table of groups is broadcast, its rows being counted.

    Of a large one only the hot groups are: those of more than one in HOT of all rows, so HOT of them at most; the rest
    are joined by shuffles, in which no key has more rows than that.
    """
    if groups.count() <= small:
        return rows.join(F.broadcast(groups), on, how)
    hot = groups.where(F.col("size_") * HOT > total)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(groups.where(F.col("size_") * HOT <= total), on, how)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def _differing(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, size: int, small: int) -> DataFrame:
    """The rows of members (id_, key_, group, size_, top_id_, top_key_, copies_) whose text differs from that of their group's top."""
    pieces = _pieces(docs, id_col, text_col, size).drop("after_")
    want = members.withColumnsRenamed({"id_": "mid_", "key_": "mkey_", "n_": "mn_"})
    want = F.broadcast(want) if members.count() <= small else want
    found = pieces.join(want, pieces["id_"].eqNullSafe(want["mid_"]) & (pieces["key_"] == want["mkey_"]) & (pieces["n_"] == want["mn_"])).drop("mid_", "mkey_", "mn_")
    if members.where("copies_ > 1").limit(1).count():  # repeated rows: one of them stands for all
        found = found.dropDuplicates(["id_", "key_", *GROUP, "i_"])
    found = keep(found, "pieces")
    salts = F.ceil(F.col("size_") / SALT).cast("int")
    top = F.col("id_").eqNullSafe(F.col("top_id_")) & (F.col("key_") == F.col("top_key_"))
    rest = found.where(~top).withColumn("salt_", F.pmod(F.xxhash64("id_", "key_"), salts).cast("int")).select("id_", "key_", *GROUP, "copies_", "i_", "salt_", "piece_")
    tops = found.where(top).select(*GROUP, "i_", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt_"), F.col("piece_").alias("other_"))
    on = [*GROUP, "i_", "salt_"]
    both = rest.join(tops.withColumnsRenamed({c: f"t{c}" for c in on}), [F.col(c) == F.col(f"t{c}") for c in on] + [F.col("piece_") != F.col("other_")])
    return both.select("id_", "key_", *GROUP, "copies_").distinct()


def _tops(rows: DataFrame, on: list[str]) -> DataFrame:
    """Groups of more than one row: on, size_, top_ (the largest id, among equal ones the largest row)."""
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("size_"), F.max(F.struct("id_", "row_", "key_")).alias("top_")).where("size_ > 1")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes=HASHES, size: int = PIECE, small: int = SMALL) -> DataFrame:
    """One row per document: id_, key_, sha256_, keep_id_, group_size_ (long), kept_ (boolean)."""
    rows = keep(fingerprints(docs, id_col, text_col, hashes, size), "fingerprints")
    total = rows.count()
    groups = keep(_tops(rows, GROUP), "groups")
    # The documents of these groups, repeated rows once.
    pending = with_groups(rows, groups.select(*GROUP, "size_"), GROUP, total, small, "inner")
    pending = keep(pending.groupBy("id_", "key_", *GROUP).agg(F.count(F.lit(1)).alias("copies_")), "members")
    moved, step = None, 0
    while True:
        tops = keep(pending.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("size_"), F.max(F.struct("id_", "key_")).alias("top_")).where("size_ > 1"), "tops")
        members = with_groups(pending, tops.select(*GROUP, "size_", F.col("top_.id_").alias("top_id_"), F.col("top_.key_").alias("top_key_")), GROUP, total, small, "inner")
        pending = keep(_differing(docs, keep(members, "compared"), id_col, text_col, size, small), "differing")
        if pending.isEmpty():
            break
        step += 1
        here = pending.withColumn("class_", F.lit(step))
        moved = here if moved is None else moved.unionByName(here)
    on = GROUP
    if moved is not None:  # texts that only share a fingerprint: the last group that a document was moved to is its class
        m = moved.groupBy("id_", "key_", *GROUP).agg(F.max("class_").alias("class_")).withColumnsRenamed({c: f"m{c}" for c in ["id_", "key_", *GROUP]})
        same = rows["id_"].eqNullSafe(m["mid_"])
        for c in ["key_", *GROUP]:
            same = same & (rows[c] == m[f"m{c}"])
        rows = keep(rows.join(m, same, "left").select(rows["*"], F.coalesce("class_", F.lit(0)).alias("class_")), "classed")
        on = [*GROUP, "class_"]
        groups = keep(_tops(rows, on), "groups")
    out = with_groups(rows, groups, on, total, small)
    lone = F.col("size_").isNull()
    return out.select(
        "id_", "key_", "sha256_", F.when(lone, F.col("id_")).otherwise(F.col("top_.id_")).alias("keep_id_"), F.coalesce("size_", F.lit(1)).cast("long").alias("group_size_"),
        (lone | (F.col("row_") == F.col("top_.row_"))).alias("kept_"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat an id and a text, any one."""
    c = keep(classes(docs, id_col, text_col, **options), "classes")
    stay = c.where("kept_").select(F.col("id_").alias("stay_id_"), F.col("key_").alias("stay_key_"))
    d = docs.withColumn("copy_key_", text_key(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    out = d.join(stay, d[id_col].eqNullSafe(stay["stay_id_"]) & (d["copy_key_"] == stay["stay_key_"]), "left_semi")
    if c.groupBy("id_", "key_").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates([id_col, "copy_key_"])
    return out.select(*docs.columns)


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id_").alias("doc_id"), F.col("keep_id_").alias("keep_id"), F.col("group_size_").alias("group_size"), F.col("kept_").alias("kept"), F.col("sha256_").alias("text_sha256"))


ORACLE = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
 row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))"""
