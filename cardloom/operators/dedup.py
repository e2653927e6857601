"""First-seen dedup of contacts. Order is `row_id`; every rule is exact and partitioned by its key, none collects a table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_key, present
from ..sources.shared import written

TEXTS = ["name", "email", "phone", "title", "location", "profile_url"]


def contact_key() -> Column:
    """D1's key: the address, else name and phone, a missing one written out so that it differs from the other."""
    shown = lambda c: F.coalesce(F.col(c), F.lit("undefined"))
    return F.coalesce(present(F.col("email")), F.concat(shown("name"), F.lit("_"), shown("phone")))


def completeness() -> Column:
    """How many of name, address and phone a row has."""
    return sum((F.when(present(F.col(c)).isNotNull(), 1).otherwise(0) for c in ("name", "email", "phone")), F.lit(0))


def dedup_contacts(df: DataFrame) -> DataFrame:
    """Per address (else name and phone) the most complete row, ties to the earliest; `first_row` is where the key first stood."""
    d = df.withColumn("key_", contact_key())
    best = F.struct(-completeness(), F.col("row_id"))  # an aggregate, so that one large group costs one row per task
    pick = d.groupBy("key_").agg(F.min(best).alias("best_"), F.min("row_id").alias("first_row"))
    pick = pick.select(F.col("best_.row_id").alias("row_id"), "first_row")
    return df.join(pick, "row_id")


def dedup_scrape(df: DataFrame) -> DataFrame:
    """With an address the first of it; without, the first per (name, url) unless an accepted row with an address had that pair; neither: kept."""
    email, name, url = F.lower(present(F.col("email"))), present(F.col("name")), present(F.col("profile_url"))
    d = df.withColumns({"e_": email, "n_": name, "u_": url})
    mailed = d.where("e_ is not null")
    kept = mailed.groupBy("e_").agg(F.min("row_id").alias("row_id")).select("row_id")
    accepted = mailed.join(kept, "row_id", "left_semi")
    pairs = accepted.where("n_ is not null and u_ is not null").groupBy("n_", "u_").agg(F.min("row_id").alias("taken_"))
    bare = d.where("e_ is null")
    both = bare.where("n_ is not null and u_ is not null")
    first = both.groupBy("n_", "u_").agg(F.min("row_id").alias("row_id")).join(pairs, ["n_", "u_"], "left").where("taken_ is null or taken_ > row_id").select("row_id")
    rest = bare.where("n_ is null or u_ is null").select("row_id")
    return df.join(kept.unionByName(first).unionByName(rest), "row_id", "left_semi")


#: Row ids that a task goes through in order; what stands before them reaches it as the latest unique row of each key.
PIECE = 200_000
KEYS = ("email", "profile_url", "name", "phone")
VERDICT = "original long, match_type string, match_key string"


def near(a: str, b: str) -> bool:
    """Whether two texts have a similarity (C35) of 0.85; equal ends count for nothing and are left out of the table."""
    most = max(len(a), len(b))
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if (most - abs(len(x) - len(y))) / most < 0.85:
        return False
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        if (most - min(row)) / most < 0.85:
            return False
    return (most - row[-1]) / most >= 0.85


def agree(a: tuple, b: tuple) -> bool:
    """Whether two rows' first five texts have two points: 1 for equal, 0.5 for near."""
    pairs = [(x, y) for x, y in zip(a, b, strict=True) if x and y]
    points, rest = sum(x == y for x, y in pairs), [p for p in pairs if p[0] != p[1]]
    for k, (x, y) in enumerate(rest):
        if points >= 2 or points + 0.5 * (len(rest) - k) < 2:
            break
        points += 0.5 * near(x, y)
    return points >= 2


def _fold(rows: pa.Table, carried: pa.Table) -> pa.Table:
    """The rule over the rows of one piece in order, after the latest unique rows before it."""
    texts = lambda t: zip(*(t.column(c).to_pylist() for c in TEXTS[:5]), strict=True)
    held = {(k, v): (i, t) for k, v, i, t in zip(*(carried.column(c).to_pylist() for c in ("kind", "value", "row_id")), texts(carried), strict=True)}
    rows = rows.sort_by("row_id")
    out = []
    for i, known, keys, t in zip(rows.column("row_id").to_pylist(), rows.column("known").to_pylist(), zip(*(rows.column(k).to_pylist() for k in KEYS), strict=True), texts(rows), strict=True):
        found = None
        for k, v in enumerate(keys):
            o = held.get((KEYS[k], v)) if v and not known else None
            if o and (k < 2 or agree(t, o[1])):
                found = (o[0], "primary" if k < 2 else "secondary", KEYS[k])
                break
        if not found:
            held.update({(k, v): (i, t) for k, v in zip(KEYS, keys, strict=True) if v})
        out.append(found or (None, None, None))
    for k, (name, kind) in enumerate((("original", pa.int64()), ("match_type", pa.string()), ("match_key", pa.string()))):
        rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array([x[k] for x in out], kind))
    return rows.set_column(rows.schema.get_field_index("was"), "was", rows.column("unique")).set_column(rows.schema.get_field_index("unique"), "unique", pa.array([x[0] is None for x in out], pa.bool_()))


def _carried(state: DataFrame) -> DataFrame:
    """For each piece the latest unique row before it of each key that its rows have: piece, kind, value, row_id and texts."""
    o = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in KEYS)))
    held = F.when(F.col("unique"), F.struct("row_id", *(TEXTS[:5])))
    last = state.select("piece", held.alias("held"), o.alias("o")).where("o.value is not null").groupBy("o.kind", "o.value", "piece").agg(F.max("held").alias("held"))
    earlier = Window.partitionBy("kind", "value").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return last.withColumn("held", F.last("held", ignorenulls=True).over(earlier)).where("held is not null").select("piece", "kind", "value", "held.*")


def dedup_fuzzy(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """D3: each row against the unique rows before it, by address or url, then, with two points of agreement, by name or phone, where
    the latest unique row of the key counts: row_id, duplicate, original, match_type, match_key.

    The rule is sequential, but what a row finds depends on earlier rows alone, so its answer is the one marking of unique rows that
    it gives back unchanged. Rows are cut into pieces of row ids; each task goes through a piece in order, after the latest unique rows
    that the last round's marks leave before it, until no mark changes. All pieces up to the first one that a round changes are right
    after it and rest, so there are no more rounds than pieces, and no key or group of rows is held by a task beyond its piece. Needs a
    checkpoint directory. Rows without keys are unique; ids are distinct and not null. Rows of `known`, of smaller ids, were found to be
    unique before: they are compared with and get no verdict.
    """
    side = lambda d, k: d.select("row_id", *(match_key(F.col(c)).alias(c) for c in TEXTS), F.lit(k).alias("known"))
    rows = side(df, False) if known is None else side(df, False).unionByName(side(known, True))
    none = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in VERDICT.split(", ")]
    state = written(rows.select(F.floor(F.col("row_id") / PIECE).alias("piece"), "*", F.lit(False).alias("unique"), F.lit(False).alias("was"), *none), "marks")
    done = None
    while True:
        left = state if done is None else state.where(F.col("piece") > done)
        before = _carried(state if done is not None else state.limit(0)).where(F.lit(True) if done is None else F.col("piece") > done)
        folded = left.groupBy("piece").cogroup(before.groupBy("piece")).applyInArrow(_fold, state.schema)
        folded = folded if done is None else folded.unionByName(state.where(F.col("piece") <= done).withColumn("was", F.col("unique")))
        state = written(folded, "marks", state)
        changed = state.agg(F.min(F.when(F.col("unique") != F.col("was"), F.col("piece"))), F.min("piece"), F.max("piece")).first()
        done = changed[1] if done is None else changed[0]
        if done is None or done == changed[2]:
            break
    return state.where("not known").select("row_id", F.col("original").isNotNull().alias("duplicate"), "original", "match_type", "match_key")


def of_rows(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df with one of the row ids. Ids grow with the rows while their compressed files look small enough to broadcast; merged, none of them goes
    through the driver."""
    return df.join(ids.hint("merge"), "row_id", "left_semi")


def holders(known: DataFrame, df: DataFrame, small: int = 200_000) -> DataFrame:
    """The rows of known that share a key with any row of df: all that D3 can compare df's rows with."""
    pairs = lambda d: F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), match_key(F.col(k)).alias("value")) for k in KEYS)))
    keys = df.select(pairs(df).alias("o")).where("o.value is not null").select("o.kind", "o.value").distinct()
    keys = F.broadcast(keys) if keys.count() <= small else keys
    ids = known.select("row_id", pairs(known).alias("o")).select("row_id", "o.kind", "o.value").join(keys, ["kind", "value"], "left_semi").select("row_id").distinct()
    return of_rows(known, ids)


def duplicate_pairs(df: DataFrame, checked: DataFrame) -> DataFrame:
    """Each duplicate of D3 with the row it repeats."""
    d = checked.where("duplicate").select("row_id", "original", "match_type", "match_key")
    names = df.select("row_id", "name", "email")
    return d.join(names, "row_id").join(names.select(F.col("row_id").alias("original"), F.col("name").alias("original_name"), F.col("email").alias("original_email")), "original")


def dedup_by(df: DataFrame, key: str) -> DataFrame:
    """D3 with one primary key: row_id, duplicate, original."""
    k = df.select("row_id", match_key(F.col(key)).alias("k"))
    first = k.where("k is not null").groupBy("k").agg(F.min("row_id").alias("original"))
    out = k.join(first, "k", "left")
    dup = F.coalesce(F.col("original") < F.col("row_id"), F.lit(False))
    return out.select("row_id", dup.alias("duplicate"), F.when(dup, F.col("original")).alias("original"))


def dedup_stats(checked: DataFrame) -> DataFrame:
    """Total, unique, duplicates and rate of a checked table."""
    n, d = F.count("*"), F.count_if("duplicate")
    return checked.agg(n.alias("total"), (n - d).alias("unique_rows"), d.alias("duplicates"), F.round(d / F.greatest(n, F.lit(1)), 4).alias("rate"))


def first_seen_content(pages: DataFrame, id_col: str, digest_col: str) -> DataFrame:
    """Id, digest, duplicate: whether an earlier page had the digest."""
    first = pages.groupBy(digest_col).agg(F.min(id_col).alias("first_"))
    return pages.join(first, digest_col, "left").select(id_col, digest_col, (F.col("first_") < F.col(id_col)).alias("duplicate"))
