"""Exact top-k search by a Voronoi kNN join.

Inner products become distances by one more coordinate: with M the greatest norm of the data of one length, |q' - x'|^2 = |q|^2 + M^2 - 2 q.x.
Pivots, a bounded sample of distinct vectors, cut the space into cells. Of each cell Spark keeps a summary: the number of
data and the least distances to its pivot, and, for queries, the greatest. From these alone the queries of every cell get a
bound on the distance of their k-th best datum, and by the triangle inequality they need a datum at distance d from the pivot of
its cell only if d >= |pivot, pivot| - radius of the queries - bound. Near cells form groups of at most `group_queries` queries,
and a datum goes to each group with a cell that needs it. What a group needs is counted, then dealt out over parts of at most
`unit_rows` data; its queries go to each of these. A group and a part meet in a task through a cogroup, whatever the tables' sizes: what
travels is N data for each group and all queries for each part, so nothing is broadcast and neither side grows with the other's cells.
There the bounds of single cells apply again; what they leave open is matrix products in slices, of which the
k best are kept, and the best k over all parts are ranked in a window.

Summaries are at most `pivots` rows of k + 1 numbers for each length of vectors: the k + 1 nearest different ids, of which a
query's own is one at most. Vectors become floor(256 x) first; scores are exact integers, held at the ends of a long beyond it.
Vectors of different lengths never meet. Null vectors, and those that hold null or non-finite components, take no part;
of a repeated query id the least vector asks; repeated candidates each count as a row, and rows of the query's id are no
candidates; a null id is no query and no
candidate; with fewer than k candidates all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import keep, table

#: Beyond this, sums in doubles might round, and Python's integers take their place; up to SINGLE, floats are exact.
EXACT, SINGLE = float(1 << 52), float(1 << 24)

#: Bytes of vectors that a group's queries or a part's data have at most.
MOST_BYTES = 32_000_000


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float = 256.0) -> DataFrame:
    """vid, v (array<double> of whole numbers) of the rows that take part."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    ok = df.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return ok.select(F.col(id_col).cast("long").alias("vid"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        some = np.flatnonzero(sizes == dim)
        part = batch.column(1).take(pa.array(some))
        yield int(dim), batch.column(0).to_numpy(zero_copy_only=False)[some].astype(np.int64), matrix(part).reshape(len(some), int(dim))


class Cells:
    """Pivots of each dimension, in the space with one more coordinate."""

    def __init__(self, pivots: dict[int, np.ndarray], top2: dict[int, float]):
        self.top2 = top2
        self.p = {d: np.column_stack([p, self.last(d, p)]) for d, p in pivots.items()}

    def last(self, dim: int, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top2[dim] - (x * x).sum(1), 0))

    @staticmethod
    def square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T

    def apart(self, dim: int) -> np.ndarray:
        return np.sqrt(np.maximum(self.square(self.p[dim], self.p[dim]), 0))

    def slack(self, dim: int) -> float:
        """More than the rounding of four distances between vectors of the greatest norm."""
        return 8 * math.sqrt((dim + 8) * np.finfo(float).eps * self.top2[dim])

    def nearest(self, dim: int, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        y = np.column_stack([x, np.zeros(len(x)) if query else self.last(dim, x)])
        c, d2 = np.zeros(len(x), np.int64), np.zeros(len(x))
        for lo in range(0, len(x), 1024):
            d = self.square(y[lo : lo + 1024], self.p[dim])
            c[lo : lo + 1024] = d.argmin(1)
            d2[lo : lo + 1024] = d.min(1)
        return c, np.sqrt(np.maximum(d2, 0))


def kind(top2: float) -> str:
    """The narrowest type that holds whole numbers of vectors of at most this square."""
    return "<i2" if top2 < 32_000.0**2 else "<i4" if top2 < 2_000_000_000.0**2 else "<f8"


def binaries(x: np.ndarray) -> pa.Array:
    """The rows of a matrix, as bytes."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(x.tobytes())])


def joined(col: pa.Array) -> bytes:
    """The bytes of all rows in one."""
    return b"".join(col.to_pylist())


def assign(df: DataFrame, cells: Cells, kinds: dict[int, str], query: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, x in by_dim(batch):
                c, d = cells.nearest(dim, x, query)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), dim, np.int32)), pa.array(c.astype(np.int32)), pa.array(d), pa.array(ids), binaries(x.astype(kinds[dim]))], names=["dim", "cell", "d", "vid", "v"])

    return df.select("vid", "v").mapInArrow(run, "dim int, cell int, d double, vid long, v binary")


def some_vectors(data: DataFrame, most: int) -> DataFrame:
    """dim, v of about `most` rows of each vector length, the first by their hashes.

    Spark cuts ranks before the shuffle up to 1000 only; beyond it, all rows of a length would go to one task. So several buckets of hashes give 500 each.
    """
    buckets = -(-most // 500)
    by_hash = Window.partitionBy("dim", "bucket").orderBy("h", "vid")
    hashed = data.select(F.size("v").alias("dim"), "vid", "v", F.xxhash64("v").alias("h")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    return hashed.withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= -(-most // buckets)).select("dim", "v")


def near_cells(points: np.ndarray, weights: np.ndarray, most: int) -> list[np.ndarray]:
    """Cells halved, by weight and along the coordinate in which they lie farthest apart, until each part weighs `most` at most or is one cell."""
    todo, out = [np.arange(len(points))], []
    while todo:
        some = todo.pop()
        if len(some) == 1 or weights[some].sum() <= most:
            out.append(some)
            continue
        some = some[np.argsort(points[some, np.ptp(points[some], axis=0).argmax()], kind="stable")]
        heavy = weights[some].cumsum()
        cut = min(max(int(np.searchsorted(heavy, heavy[-1] / 2)), 1), len(some) - 1)
        todo += [some[cut:], some[:cut]]
    return out


def places(hit: np.ndarray) -> np.ndarray:
    """np.flatnonzero where few are set, eight at a time."""
    n = len(hit) // 8 * 8
    some = (np.flatnonzero(hit[:n].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([some[hit[some]], n + np.flatnonzero(hit[n:])])


def best_rows(y: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, width: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, data row and score of the k best data of each query, but for those of its own id; x is in the order of its ids, so the first of a tie wins."""
    norm = lambda m: math.sqrt((m.astype(float) ** 2).sum(1).max(initial=0))
    bound = norm(y) * norm(x) * (1 + 1e-9)
    if bound >= EXACT:
        return best_exact(y, qid, x, xid, k)
    y, x = (m.astype(np.float32 if bound < SINGLE else float) for m in (y, x))
    first, last = np.searchsorted(xid, qid, "left"), np.searchsorted(xid, qid, "right")
    most = min(1024, len(y)) * min(width, len(x))
    found, space, over = [], np.empty(most, y.dtype), np.empty(most, bool)  # used again and again: new ones each time cost more than their comparison
    for lo in range(0, len(y), 1024):
        q, f, t = y[lo : lo + 1024], first[lo : lo + 1024], last[lo : lo + 1024]
        top, at = np.full((len(q), k), -np.inf, y.dtype), np.full((len(q), k), -1)
        for c in range(0, len(x), width):
            w = min(width, len(x) - c)
            s = np.matmul(q, x[c : c + w].T, out=space[: len(q) * w].reshape(len(q), w))
            for i in np.flatnonzero((f < t) & (f < c + width) & (t > c)):
                s[i, max(f[i] - c, 0) : t[i] - c] = -np.inf
            hit = np.greater(s, top[:, -1:], out=over[: len(q) * w].reshape(len(q), w))
            if s.shape[1] > k and np.count_nonzero(hit) > 8 * k * len(q):  # too many to sort: the first k of each row, of ties the first
                least = np.partition(s, -k, axis=1)[:, -k, None]
                more, tie = s > least, s == least
                hit &= more | (tie & (tie.cumsum(1) <= k - more.sum(1)[:, None]))
            r, j = divmod(places(hit.ravel()), s.shape[1])
            if not len(r):
                continue
            row = np.concatenate([np.repeat(np.arange(len(q)), k), r])
            score, col = np.concatenate([top.ravel(), s[r, j]]), np.concatenate([at.ravel(), c + j])
            order = np.lexsort((col, -score, row))
            n = k + np.bincount(r, minlength=len(q))
            keep = order[((n.cumsum() - n)[:, None] + np.arange(k)).ravel()]
            top, at = score[keep].reshape(-1, k), col[keep].reshape(-1, k)
        i, j = np.nonzero(at >= 0)
        found.append((lo + i, at[i, j], top[i, j].astype(np.int64)))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def best_exact(y: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole, found = np.frompyfunc(int, 1, 1), []
    x = whole(x).T
    for i in range(len(y)):
        s = np.clip(whole(y[i]) @ x, -(2**63), 2**63 - 1).astype(np.int64)
        others = np.flatnonzero(xid != qid[i])
        take = others[np.argsort(-1 - s[others], kind="stable")[:k]]
        found.append((np.full(len(take), i), take, s[take]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = 50, pivots: int | None = None, query_block: int = 128, part_rows: int = 2048,
          group_queries: int = 16384, unit_rows: int = 32768) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by `every`, its k best other rows.

    Pivots grow with the root of the rows, from 48 up; bounds between all pairs of them are held by the driver and each task, so they
    end at 2048. They decide what is pruned, never what is found. Rows travel in blocks of at most `query_block` queries and `part_rows` data.
    """
    spark = df.sparkSession
    data = whole_vectors(df, id_col, vec_col)
    queries = data.where(F.pmod("vid", F.lit(every)) == 0).groupBy("vid").agg(F.min("v").alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stat = {r["dim"]: (r["n"], r["top2"]) for r in data.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(squares).alias("top2")).collect()}  # one row per vector length
    pivots = pivots or min(2048, max(48, math.isqrt(sum(n for n, _ in stat.values())) // 8))
    sample: dict[int, list] = {d: [] for d in stat}
    for r in some_vectors(data, 4 * pivots).collect():  # bounded for each vector length
        sample[r["dim"]].append(r["v"])
    points = {d: np.unique(np.array(rows, float).reshape(len(rows), d), axis=0) for d, rows in sample.items()}
    points = {d: p[np.linspace(0, len(p) - 1, min(pivots, len(p))).astype(int)] for d, p in points.items()}
    cells, kinds = Cells(points, {d: t for d, (_, t) in stat.items()}), {d: kind(t) for d, (_, t) in stat.items()}
    fit = {d: max(1, MOST_BYTES // (max(1, d) * np.dtype(t).itemsize)) for d, t in kinds.items()}  # vectors in MOST_BYTES
    held = keep(assign(data, cells, kinds, False), "cells")
    asked = keep(assign(queries, cells, kinds, True), "queries")
    closest = Window.partitionBy("dim", "cell").orderBy("d", "vid")
    least = held.groupBy("dim", "cell", "vid").agg(F.min("d").alias("d")).withColumn("r", F.row_number().over(closest)).where(F.col("r") <= k + 1)
    near: dict[int, list] = {}
    for r in least.select("dim", "cell", "vid", "d").collect():  # k + 1 rows of each cell
        near.setdefault(r["dim"], []).append((r["cell"], r["vid"], r["d"]))
    radii: dict[int, dict[int, tuple[int, float]]] = {}
    for r in asked.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("d").alias("far")).collect():  # as many
        radii.setdefault(r["dim"], {})[r["cell"]] = (r["n"], r["far"])
    reach: dict[int, np.ndarray] = {}  # for the queries of each cell, and each cell: the least distance from its pivot that is needed
    low: dict[int, np.ndarray] = {}  # the same for each group
    first: dict[int, np.ndarray] = {}  # group of each cell; a cell of more than group_queries queries has `slots` from there on
    slots: dict[int, np.ndarray] = {}
    for dim, of_dim in radii.items():
        apart = cells.apart(dim)
        c, ids, d = (np.array(x) for x in zip(*near[dim], strict=True))
        reach[dim] = np.full(apart.shape, np.inf)
        for g, (_, far) in of_dim.items():
            upper = far + apart[g][c] + d
            order = np.argsort(upper)
            once = np.sort(np.unique(ids[order], return_index=True)[1])
            bound = upper[order[once[k]]] if len(once) > k else np.inf  # one of the k + 1 ids may be the query's
            reach[dim][g] = apart[g] - far - bound - 1e-6 * (1 + apart[g]) - cells.slack(dim)
        full = np.array(sorted(of_dim))
        weights = np.array([of_dim[g][0] for g in full])
        most = min(group_queries, fit[dim])
        first[dim], slots[dim] = np.zeros(len(apart), np.int64), np.ones(len(apart), np.int64)
        rows: list[np.ndarray] = []
        for some in near_cells(cells.p[dim][full], weights, most):
            first[dim][full[some]] = len(rows)
            slots[dim][full[some]] = n = max(1, -(-int(weights[some].sum()) // most)) if len(some) == 1 else 1
            rows += [reach[dim][full[some]].min(0)] * n
        low[dim] = np.array(rows)

    def wanted(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        """Dimension, group and rows that it needs."""
        dims, cell, d = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for dim in np.unique(dims):
            of_dim = np.flatnonzero(dims == dim)
            for g, from_ in enumerate(low.get(int(dim), ())):
                yield int(dim), g, of_dim[d[of_dim] >= from_[cell[of_dim]]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[int, int], int] = {}
        for batch in batches:
            for dim, g, go in wanted(batch):
                n[dim, g] = n.get((dim, g), 0) + len(go)
        yield pa.RecordBatch.from_pydict({"dim": pa.array([x for x, _ in n], pa.int32()), "g": pa.array([g for _, g in n], pa.int32()), "n": pa.array(list(n.values()), pa.int64())})

    needs = held.select("dim", "cell", "d").mapInArrow(count, "dim int, g int, n long").groupBy("dim", "g").agg(F.sum("n").alias("n"))
    need = {(r["dim"], r["g"]): r["n"] for r in needs.collect()}  # a row of each group
    even = max(4096, -(-sum(need.values()) // (4 * spark.sparkContext.defaultParallelism)))  # smaller parts where there are few
    size = {dim: min(unit_rows, even, n) for dim, n in fit.items()}
    parts = {(dim, g): max(1, -(-need.get((dim, g), 0) // size[dim])) for dim in low for g in range(len(low[dim]))}
    block = {dim: max(1, min(part_rows, n // 8)) for dim, n in size.items()}

    def packed(batch: pa.RecordBatch, some: np.ndarray, dim: int, g: int, part: int) -> pa.RecordBatch:
        cell, d, ids = (batch.column(i).to_numpy(zero_copy_only=False)[some].astype(t).tobytes() for i, t in ((1, "<i4"), (2, "<f8"), (3, "<i8")))
        of = [pa.array([x], pa.int32()) for x in (dim, g, part)]
        return pa.RecordBatch.from_arrays([*of, *(pa.array([x], pa.binary()) for x in (cell, d, ids, joined(batch.column(4).take(pa.array(some)))))], names=["dim", "g", "part", "cells", "ds", "ids", "m"])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[tuple[int, int], int] = {}  # blocks of a group go to its parts in turn, from one that the task's first id says
        for batch in batches:
            for dim, g, go in wanted(batch):
                for lo in range(0, len(go), block[dim]):
                    some = go[lo : lo + block[dim]]
                    turn[dim, g] = (turn[dim, g] if (dim, g) in turn else batch.column(3)[int(some[0])].as_py() * 2654435761 >> 7) + 1
                    yield packed(batch, some, dim, g, turn[dim, g] % parts[dim, g])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell, _, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for dim in map(int, np.unique(dims)):
                of_dim = np.flatnonzero(dims == dim)
                spot = ids[of_dim].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                group = first[dim][cell[of_dim]] + (spot % slots[dim][cell[of_dim]].astype(np.uint64)).astype(np.int64)
                for g in map(int, np.unique(group)):
                    go = of_dim[group == g]
                    step = min(query_block, fit[dim])
                    for lo in range(0, len(go), step):
                        yield packed(batch, go[lo : lo + step], dim, g, parts[dim, g])

    shape = "dim int, g int, part int, cells binary, ds binary, ids binary, m binary"
    n_tasks = min(20_000, max(1, sum(parts.values())))
    blocks = held.mapInArrow(replicate, shape).repartition(n_tasks, "dim", "g", "part")
    spread = asked.mapInArrow(gather, shape).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("part") - 1))).repartition(n_tasks, "dim", "g", "part")

    def solve(key: tuple, datum: pa.Table, query: pa.Table) -> pa.Table:
        dim, out = key[0].as_py(), []
        if datum.num_rows and query.num_rows:
            read = lambda t, name, of: np.frombuffer(joined(t.column(name)), of)
            xid, qid, qcell = read(datum, "ids", "<i8"), read(query, "ids", "<i8"), read(query, "cells", "<i4")
            order = np.argsort(xid, kind="stable")
            x, xid = read(datum, "m", kinds[dim]).reshape(len(xid), dim)[order], xid[order]
            y = read(query, "m", kinds[dim]).reshape(len(qid), dim)
            xcell, d = read(datum, "cells", "<i4")[order], read(datum, "ds", "<f8")[order]
            jobs, most = [], (np.zeros(len(qid), bool), np.zeros(len(xid), bool))  # cells that need more than half of the data go together
            for g in np.unique(qcell):
                asks, open_ = qcell == g, d >= reach[dim][g][xcell]
                if 2 * np.count_nonzero(open_) > len(xid):
                    most[0][asks], most[1][open_] = True, True
                else:
                    jobs.append((asks, open_))
            for asks, open_ in [*jobs, most]:
                q, c = np.flatnonzero(asks), np.flatnonzero(open_)
                if len(q) and len(c):
                    i, j, s = best_rows(y[q], qid[q], x[c], xid[c], k)
                    out.append((qid[q][i], xid[c][j], s))
        ids, found, scores = (np.concatenate(z) for z in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": ids, "vec_id": found, "score": scores})

    at = ("dim", "g", "part")
    found = blocks.groupBy(*at).cogroup(spread.groupBy(*at)).applyInArrow(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
 where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e::double[], c.e::double[])::bigint as score
 from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5"""
