"""N-gram Jaccard join over count vectors in R-trees.

A document's set holds its distinct `width`-word shingles; two link at 100 |A & B| >= percent |A | B|. Each set's shingles are
hashed into groups, and the counts per group are a point. Two points bound the overlap of their sets by the sum of their
coordinate minima, and so does a point and a tree node that keeps the greatest count of each group. Trees are packed by size
and counts; queries go down the nodes that the bound leaves open, and the pairs that reach the leaves are compared in full.

One tree over a large corpus would not do: with hashed groups, counts of equally long texts differ by little, and every
query would visit every leaf (see README). So trees are built over documents that agree in a whole group of a finer hashing:
linked sets of a and b shingles differ in D = (100 - percent) (a + b) / (100 + percent) shingles at most, and each of these
spoils one group. Sets are thus hashed into more than D groups, their number fixed by a band of sizes (a set also takes part
in the next bands that it may link with), and a group's key is a hash of the shingles in it. Of its non-empty groups, by
index, a set offers the first D + 1 + spare; linked sets then share at least spare + 1 keys, so each may put aside the `spare`
keys that are most frequent in the corpus, by exact counts. A passage that many documents share therefore draws them
together only where nearly all of a text is that passage. A set with too few non-empty groups offers keys of other hashings
too, and, if these are all alike, meets the others of its kind in one group.

1. Documents with equal sets are one node from here on, so exact copies make no pairs.
2. Keys are counted, and of each set the rarest D + 1 stay. Keys that only one set holds vanish, and of keys with the same
   members one is left. Each node is bounded and compared with the hub (least node) it shares most keys with. Linked components follow.
3. What a group still holds in different components is compared: members outside its largest component are looked up in
   trees over all members. A first pass, over points alone, finds the members that have an open pair; those that share groups
   are drawn together, so that each is in one group from here on. A second pass, over these and their sets, compares the open
   pairs and gives the links that join components, never more than members. Groups are cut into
   blocks of bounded size, so one that a third of all nodes belong to is spread over tasks.
Every link between different sets is thus found or lies inside a component that other links have already joined.

Words are runs of anything but ASCII white space, A-Z lowered; fewer words than a shingle give one shingle of them all; texts
without words, and null, have an empty set and link with nothing. Repeated rows and rows that share an id each keep a row; the
component id is the least id that is not null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import ascii_lower, drop, keep, same, table, text_key, turn_to

GROUPS = 64
#: Rows of one side of a cell, and the count from which a point says "so many or more".
CELL, FULL = 256, 65_535
#: Nodes up to which a list of ids may be broadcast.
SMALL = 200_000
#: Lists of keys that a set may have; with percent from 20 up there are fewer.
LISTS = 64
#: A band of sizes ends where the next size is more than RISE times its first; hashings tried for sets with empty groups.
RISE, HASHINGS = 1.5, 3
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def word_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = F.filter(F.split(ascii_lower(F.col(text_col).cast("string")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select(F.col(id_col).cast("long").alias("id_"), text_key(F.col(text_col)).alias("key_"), F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<long>")).alias("w_"))


def mixed(parts: list[np.ndarray]) -> np.ndarray:
    v = np.zeros(len(parts[0]), np.uint64)
    for i, p in enumerate(parts):
        v = (v + p) * ODD[i % 4]
        v ^= v >> np.uint64(29 + i % 3)
    return v


def shingle_sets(col: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row's word hashes."""
    h = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))
    with np.errstate(over="ignore"):
        every = mixed([h[i : len(h) - width + 1 + i] for i in range(width)]) if len(h) >= width else h[:0]
        lo = 0
        for hi in ends:
            n = hi - lo
            if n >= width:
                yield np.unique(every[lo : hi - width + 1])
            else:
                yield mixed([h[j : j + 1] for j in range(lo, hi)] + [np.full(1, n, np.uint64)]) if n else h[:0]
            lo = hi


def points_of(sets: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS) for s in sets]).clip(max=FULL).astype("<u2") if sets else np.zeros((0, GROUPS), "<u2")


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of coordinate minima of rows; without a bound where both sides are full."""
    least = np.minimum(a, b)
    if (full := least == FULL).any():
        least[full] = 1 << 40
    return least.sum(1, dtype=np.int64)


def edges_upto(n: int) -> np.ndarray:
    """Least sizes of the bands, until past n."""
    e = [1, 2]
    while e[-1] <= n:
        e.append(max(e[-1] + 1, int(e[-1] * RISE)))
    return np.array(e, np.int64)


def most_apart(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """In how many shingles linked sets of a and b shingles may differ."""
    return (100 - percent) * (a + b) // (100 + percent)


class Lists:
    """Keys offered by the sets of a batch: of each list its set, how many keys of it must stay, and the keys."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.n = np.array([len(x) for x in sets], np.int64)
        self.all = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        edges = edges_upto(200 * int(self.n.max(initial=1)) // percent + 2)
        own = np.searchsorted(edges, self.n, "right") - 1
        with np.errstate(over="ignore"):
            for up in range(len(edges) - 1):
                c = np.minimum(own + up, len(edges) - 2)
                take = (self.n > 0) & ((100 * self.n >= percent * edges[c]) if up else True) & (own + up < len(edges) - 1)
                if not take.any():
                    break
                top = edges[c + 1] - 1
                apart = most_apart(self.n, np.minimum(100 * self.n // percent, top), percent)
                take &= apart > 0  # sets that may not differ are equal, and equal sets are one node
                most = most_apart(top, top, percent) + 1
                spare = -(-most // 5)
                groups = most + spare + 1 + (most + spare) // 16
                self.offer(take, c, apart, spare, groups)

    def offer(self, take: np.ndarray, band: np.ndarray, apart: np.ndarray, spare: np.ndarray, groups: np.ndarray) -> None:
        for hashing in range(HASHINGS):
            d = np.flatnonzero(take)
            if not len(d):
                return
            n, k = self.n[d], groups[d]
            x = self.all[np.repeat(take, self.n)]
            mix = (x ^ (x >> np.uint64(31))) * ODD[hashing]
            mix ^= mix >> np.uint64(29)
            first = np.cumsum(k) - k
            slot = (mix % np.repeat(k, n).astype(np.uint64)).astype(np.int64) + np.repeat(first, n)
            sums = np.zeros(int(k.sum()), np.uint64)
            np.add.at(sums, slot, mix * ODD[3])
            full = np.flatnonzero(np.bincount(slot, minlength=len(sums)))
            owner = np.repeat(np.arange(len(d)), k)[full]
            have = np.bincount(owner, minlength=len(d))
            rank = np.arange(len(full)) - np.repeat(np.cumsum(have) - have, have)
            need = apart[d] + 1 + spare[d]
            used = rank < need[owner]
            full, owner = full[used], owner[used]
            keys = mixed([sums[full], (full - first[owner]).astype(np.uint64), (band[d][owner] * HASHINGS + hashing).astype(np.uint64)])
            offered = np.minimum(have, need)
            self.parts.append((d, np.maximum(offered - spare[d], 0), offered, keys))
            take = take & False
            take[d[have < need]] = True
        d = np.flatnonzero(take)
        if len(d):
            self.parts.append((d, np.ones(len(d), np.int64), np.ones(len(d), np.int64), mixed([band[d].astype(np.uint64), np.full(len(d), 7, np.uint64)])))

    def arrow(self) -> pa.Array:
        """array<struct<keep, keys>> of each set."""
        d, keep_, size, keys = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.zeros(0, np.int64) for i in range(4))
        order = np.argsort(d, kind="stable")
        starts = (np.cumsum(size) - size)[order]
        size = size[order]
        ends = np.cumsum(size)
        keys = keys[np.repeat(starts - (ends - size), size) + np.arange(int(size.sum()))].view(np.int64)
        inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(keys))
        outer = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(self.n)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(outer), pa.StructArray.from_arrays([pa.array(keep_[order].astype(np.int32)), inner], names=["keep", "keys"]))


def features(words: DataFrame, width: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("sets")
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                batch = whole.slice(lo, 1000)
                sets = list(shingle_sets(batch.column(2), width))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([p.tobytes() for p in points_of(sets)], pa.binary()), Lists(sets, percent).arrow(),
                    ],
                    names=["id_", "key_", "n", "set_", "point", "lists"],
                )

    return words.mapInArrow(run, "id_ long, key_ long, n long, set_ binary, point binary, lists array<struct<keep:int,keys:array<long>>>")


def shared_keys(reps: DataFrame) -> DataFrame:
    """key, row_, hub (its least member), members: the groups of two nodes or more, one of those with the same members."""
    lists = reps.select((F.col("row_") * LISTS).alias("first_"), F.posexplode("lists").alias("list", "l_")).select((F.col("first_") + F.col("list")).alias("list_"), "l_.keep", F.size("l_.keys").alias("size"), "l_.keys")
    offers = lists.select("list_", F.explode("keys").alias("key"))  # two numbers a row: the widest table of the join
    often = keep(offers.groupBy("key").agg(F.count("*").alias("often")).where("often > 1"), "often")
    both = offers.join(often, "key").join(lists.select("list_", "keep", "size"), "list_")
    of_list = Window.partitionBy("list_")
    ranked = both.withColumn("place", F.row_number().over(of_list.orderBy("often", "key"))).withColumn("alone", F.col("size") - F.count("*").over(of_list))
    kept = keep(ranked.where(F.col("place") + F.col("alone") <= F.col("keep")).select("key", F.floor(F.col("list_") / LISTS).alias("row_")), "keys")
    drop(often)
    hashed = F.xxhash64("row_")
    per = kept.groupBy("key").agg(F.count("*").alias("members"), F.min("row_").alias("hub"), F.bit_xor(hashed).alias("h1"), F.sum(F.shiftrightunsigned(hashed, 20)).alias("h2")).where("members > 1")
    one = per.groupBy("members", "hub", "h1", "h2").agg(F.min("key").alias("key"), F.count("*").alias("alike"))
    groups = keep(kept.join(one.select("key", "members", "hub", "alike"), "key"), "groups")
    drop(kept)
    return groups


def possible(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of a and b shingles with so many in common, at most, may link."""
    return (100 + percent) * overlap >= percent * (a + b)


class CountTree:
    """An R-tree over count points: nodes keep the greatest count of each group and the range of set sizes."""

    FAN = 8

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        halves = points[:, : GROUPS // 2].sum(1)
        self.order = np.lexsort((halves, np.floor(8 * np.log(np.maximum(sizes, 1)))))  # sort, tile, pack: size bands, then counts
        top, lo, hi = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(top, lo, hi)]
        while len(top) > self.FAN:
            at = np.arange(0, len(top), self.FAN)
            top, lo, hi = np.maximum.reduceat(top, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            self.levels.append((top, lo, hi))

    def pairs(self, points: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, datum and bound of the pairs that the bound leaves open."""
        top = len(self.levels[-1][1])
        q, node = np.repeat(np.arange(len(sizes)), top), np.tile(np.arange(top), len(sizes))
        for level in range(len(self.levels) - 1, -1, -1):
            high, lo, hi = self.levels[level]
            size = sizes[q]
            near = (100 * hi[node] >= percent * size) & (percent * lo[node] <= 100 * size)
            q, node = q[near], node[near]
            bound = np.concatenate([overlap(points[q[i : i + 8192]], high[node[i : i + 8192]]) for i in range(0, len(q), 8192)] or [np.zeros(0, np.int64)])
            open_ = possible(bound, sizes[q], lo[node], percent)
            q, node, bound = q[open_], node[open_], bound[open_]
            if level:
                below = len(self.levels[level - 1][1])
                q = np.repeat(q, self.FAN)
                node = (node[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                q, node = q[node < below], node[node < below]
        return q, self.order[node], bound


def numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def blobs(col: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<u2").reshape(-1, width).astype(np.int64)


def bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their points leave open."""
    side = lambda k: nodes.select(F.col("row_").alias(k), F.col("n").alias(f"n{k}"), F.col("point").alias(f"p{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = numbers(batch, "a", "b", "na", "nb")
            ok = possible(overlap(blobs(batch.column("pa"), GROUPS), blobs(batch.column("pb"), GROUPS)), na, nb, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    fits = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(fits).select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def link(a: pa.Scalar, b: pa.Scalar, percent: int) -> bool:
    """Whether two sets of sorted hashes link."""
    x, y = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
    return 100 * common >= percent * (len(x) + len(y) - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    side = lambda k: sets.select(F.col("row_").alias(k), F.col("s").alias(f"s{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = numbers(batch, "a", "b")
            good = np.array([link(x, y, percent) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)], bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def sets_of(docs: DataFrame, id_col: str, text_col: str, width: int, rows: DataFrame, need: DataFrame) -> DataFrame:
    """row_ and s (its shingles) of the needed nodes, from their texts; a node may come more than once, once from a task."""
    wanted = keep(rows.join(need, "row_", "left_semi").select("row_", F.col("id_").alias("w_id_"), F.col("key_").alias("w_key_")), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
    d = docs.select(F.col(id_col).cast("long").alias("d_id_"), F.col(text_col).cast("string").alias("d_text_"), text_key(F.col(text_col)).alias("d_key_"))
    texts = d.join(side, d["d_id_"].eqNullSafe(side["w_id_"]) & (d["d_key_"] == side["w_key_"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            ids, sets = [], []
            for i, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(2), width), strict=True):
                if i not in given:
                    given.add(i)
                    ids.append(i)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["row_", "s"])

    hashed = word_hashes(texts.select("row_", "d_text_"), "row_", "d_text_").select(F.col("id_").alias("row_"), "key_", "w_")
    return keep(hashed.mapInArrow(run, "row_ long, s binary"), "sets")


def components(links: DataFrame) -> DataFrame:
    """row_ and comp (its least node) for every node of a link: large and small stars by turns until nothing moves."""
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    before = last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        if last is not None:
            drop(last)
        last = e
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("h"), F.max(F.xxhash64("v", "u")).alias("m")).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("row_"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("row_"), F.col("v").alias("comp")).distinct())


def crossing(members: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int, sets: DataFrame | None = None) -> DataFrame:
    """Pairs inside a group but across components that their points leave open: without `sets` the members (key, row_) that have any,
    with `sets` links (a, b) that join all components which the pairs' sets link."""
    m = members.join(labels, "row_", "left").withColumn("comp", F.coalesce("comp", "row_"))
    per = m.groupBy("key", "comp").agg(F.count("*").alias("c"))
    split = per.groupBy("key").agg(F.sum("c").alias("all_"), F.max(F.struct("c", "comp")).alias("big")).where(F.col("all_") > F.col("big.c")).select("key", "all_", F.col("big.comp").alias("big"), (F.col("all_") - F.col("big.c")).alias("out_"))
    m = m.join(split, "key").join(nodes.select("row_", "n", "point"), "row_")
    m = m.withColumn("s", F.lit(None).cast("binary")) if sets is None else m.join(sets, "row_")
    parts, blocks = F.ceil(F.col("all_") / CELL).cast("int"), F.ceil(F.col("out_") / CELL).cast("int")
    own = lambda k, seed: F.pmod(F.xxhash64(F.lit(seed), "row_"), k).cast("int")
    upto = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    cols = ["key", "row_", "comp", "n", "point", "big", "s"]
    queries = m.where("comp != big").withColumn("qb", own(blocks, 1)).withColumn("tb", upto(parts)).select(*cols, "qb", "tb", F.lit(1).alias("asks"))
    targets = m.withColumn("tb", own(parts, 2)).withColumn("qb", upto(blocks)).select(*cols, "qb", "tb", F.lit(0).alias("asks"))
    dealt = queries.unionByName(targets).repartition("key", "qb", "tb").sortWithinPartitions("key", "qb", "tb", "asks")

    first_pass = sets is None  # tasks must not hold on to a DataFrame

    def solve(cell: pa.Table) -> pa.RecordBatch | None:
        row, comp, n, big, asks = (cell.column(c).to_numpy() for c in ("row_", "comp", "n", "big", "asks"))
        point = blobs(cell.column("point"), GROUPS)
        q, t = np.flatnonzero(asks == 1), np.flatnonzero(asks == 0)
        if not len(q) or not len(t):
            return None
        i, j, bound = CountTree(point[t], n[t]).pairs(point[q], n[q], percent)
        i, j = q[i], t[j]
        ok = comp[i] != comp[j]
        ok &= (comp[j] == big[j]) | (row[i] < row[j])  # of two that both ask, one way is enough
        i, j, bound = i[ok], j[ok], bound[ok]
        if first_pass:
            some = np.unique(row[np.concatenate([i, j])])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), cell.column("key")[0].as_py())), pa.array(some)], names=["key", "row_"])
        order = np.argsort(n[i] + n[j] - 2 * bound, kind="stable")  # the likeliest first, the more of the others needs no look
        up: dict[int, int] = {}

        def top(c: int) -> int:
            while (d := up.get(c, c)) != c:
                up[c] = up.get(d, d)
                c = d
            return c

        own, found = cell.column("s"), []
        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            p, r = top(int(comp[x])), top(int(comp[y]))
            if p != r and link(own[x], own[y], percent):
                up[p] = r
                found.append((row[x], row[y]))
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key, qb, tb = numbers(batch, "key", "qb", "tb")
            cut = np.flatnonzero((key[1:] != key[:-1]) | (qb[1:] != qb[:-1]) | (tb[1:] != tb[:-1])) + 1
            if held and len(key):
                last = held[-1]
                if tuple(last.column(c)[-1].as_py() for c in ("key", "qb", "tb")) != (key[0], qb[0], tb[0]):
                    cut = np.concatenate([[0], cut])
            at = 0
            for c in cut:
                held.append(batch.slice(at, c - at))
                if (out := solve(pa.Table.from_batches(held).combine_chunks())) is not None:
                    yield out
                held, at = [], c
            held.append(batch.slice(at))
        if held and (out := solve(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield out

    return dealt.mapInArrow(run, "key long, row_ long" if first_pass else "a long, b long").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id_, key_ (hash of its text), n_shingles, component_id, and component_, which tells components apart whose ids are all null (null for empty sets)."""
    whole = keep(features(word_hashes(docs, id_col, text_col), width, percent).withColumn("row_", F.monotonically_increasing_id()), "points")
    classes = keep(whole.where("n > 0").groupBy("set_").agg(F.min("row_").alias("node"), F.min("id_").alias("least_")), "classes")
    # Copies are named by their numbers, so that the lists needn't be shuffled to drop them where the copies are few enough to broadcast.
    copies = keep(whole.select("set_", "row_").join(classes.select("set_", "node"), "set_").where("row_ != node").select("row_"), "copies")
    copies = F.broadcast(copies) if copies.count() <= SMALL else copies
    held = shared_keys(whole.where("n > 0").select("row_", "lists").join(copies, "row_", "left_anti"))
    rows = keep(whole.drop("lists"), "rows")
    drop(whole)  # the lists are the widest part by far
    near = held.select("row_").distinct()
    nodes = keep(rows.select("row_", "n", "point").join(near, "row_", "left_semi"), "nodes")

    def sets(need: DataFrame) -> DataFrame:
        """Sets are made for the nodes of open pairs alone, which the points have left."""
        return sets_of(docs, id_col, text_col, width, rows, need)

    most = held.where("row_ != hub").groupBy("row_", "hub").agg(F.sum("alike").alias("c")).groupBy("row_").agg(F.max(F.struct("c", -F.col("hub"))).alias("m"))
    first = keep(bounded(most.select(F.col("row_").alias("a"), (-F.col("m.col2")).alias("b")), nodes, percent), "open")
    ends = first.select(F.explode(F.array("a", "b")).alias("row_")).distinct()
    labels = components(keep(verified(first, sets(ends), percent), "links"))
    open_ = keep(crossing(held.select("key", "row_"), labels, nodes, percent), "open")
    hubs = open_.groupBy("key").agg(F.min("row_").alias("b"))
    near_ = keep(components(open_.join(hubs, "key").where("row_ != b").select(F.col("row_").alias("a"), "b")).select(F.col("comp").alias("key"), "row_"), "members")
    one_set = sets(near_.select("row_")).dropDuplicates(["row_"])
    more = keep(crossing(near_, labels, nodes, percent, one_set), "links")
    stars = labels.where("row_ != comp").select(F.col("row_").alias("a"), F.col("comp").alias("b"))
    labels = components(stars.unionByName(more))
    named_ = classes.join(labels.withColumnRenamed("row_", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named_.groupBy("comp").agg(F.min("least_").alias("component_id"))
    final = named_.join(least, "comp").select(F.col("set_").alias("c_set_"), "component_id", F.col("comp").alias("component_"))
    out = rows.join(final, rows["set_"] == final["c_set_"], "left")
    return out.select("id_", "key_", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id_")).alias("component_id"), "component_")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each component: the one of its least id (null ids last), of repeated ids the least text hash; columns as they are."""
    found = keep(jaccard_components(docs, id_col, text_col, **how), "found")
    first = found.where("component_ is not null").groupBy("component_").agg(F.min(F.struct(F.col("id_").isNull().alias("none"), "id_", "key_")).alias("m"))
    stays = found.where("component_ is null").select("id_", "key_").distinct().unionByName(first.select("m.id_", "m.key_"))
    f, k = found.select("id_", "key_").distinct().alias("f"), stays.alias("k")
    goes = keep(f.join(k, F.col("f.id_").eqNullSafe(F.col("k.id_")) & F.col("f.key_").eqNullSafe(F.col("k.key_")), "left_anti").select(F.col("f.id_").alias("g_id_"), F.col("f.key_").alias("g_key_")), "goes")
    marked = docs.withColumn("text_key_", text_key(F.col(text_col)))
    side = F.broadcast(goes) if goes.count() <= SMALL else goes
    kept = marked.join(side, marked[id_col].eqNullSafe(side["g_id_"]) & marked["text_key_"].eqNullSafe(side["g_key_"]), "left_anti")
    if not found.groupBy("id_", "key_").count().where("count > 1").isEmpty():  # only then are there repeated rows to drop
        kept = kept.dropDuplicates([id_col, "text_key_"])
    return kept.select(*docs.columns)


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    out = jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)
    return out.select(F.col("id_").alias("doc_id"), "n_shingles", "component_id")
