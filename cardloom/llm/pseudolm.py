"""Language-model scores by masked pseudo-likelihood.

A small network predicts every word and mark from the two before and the two after it: the embeddings of the four, one table for each
place, are summed and squashed, and the word's probability is that of its class times that within the class. A document's
score is the sum of the logarithms over its words, each predicted with itself left out.

The vocabulary counts all words of all documents. Its classes and the words in each grow with the fourth root of their total,
so the number of words with an id of their own grows with its square root, up to MOST_CLASSES squared; all others share the buckets of the first class. A
bucket's probability is dealt among its words by their counts: the words without an id meet the full table of counts in a
join, and each document sums the logarithms. Texts are split once, into runs that name each of their words once; counts and ids come from the runs,
and ids are kept in the shared folder for training and scoring.

Training passes over every word of every document once: each task runs Adam over its own documents in numpy from common
starting values, in steps that grow as it goes on, where embeddings move in the steps that meet them, and Spark averages the tasks' parameters, weighted by
their words, in sums of WIDE parameters a row; what tasks send grows with the corpus, what reaches the driver is one model.
Scoring is another pass; only a row of figures for each document meets its sum.

Null and blank texts have no words, a score of 0 and no score per word; repeated rows are scored alike; over an empty
table nothing is trained and the result is empty; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop, keep, table

WORD = re.compile(r"\w+|[^\w\s]")
#: Marks that are looked for in texts without other characters; marks of other texts are gathered from them, if no more than so many.
ASCII_MARKS, FEW_MARKS = [c for c in map(chr, range(128)) if WORD.match(c) and not re.match(r"\w", c)], 64
#: Least classes and words in each, size of the hidden layer, words of context on either side, most words in a step of training.
CLASSES, MEMBERS, HIDDEN, SIDE, STEP = 32, 32, 16, 2, 16_384
VOCAB = CLASSES * MEMBERS
#: Classes at most, so that a model has 65 000 words with an id of their own and 5 million parameters; all other words keep their exact counts.
MOST_CLASSES = 256
#: A task's first steps are of FIRST words and double after every SAME of them, up to STEP; words that a task should train on at least.
FIRST, SAME, TASK_WORDS = 64, 64, 4_000_000
#: Words without an id of their own whose bucket a task remembers; parameters in a row of the sums; texts in a run of ids, and words after which
#: a run of split texts ends; words whose probabilities are worked out at once, so that they stay in the processor's cache.
KNOWN, WIDE, RUN, RUN_WORDS, BLOCK = 300_000, 64, 500, 1_000_000, 512
#: Sums of exponentials within these are taken as they are; else scores are shifted by their largest first.
LEAST, LARGEST = 1e-30, 1e30
PLACES = [-2, -1, 1, 2]


def shapes(side: int) -> dict[str, tuple[int, ...]]:
    """Of the parameters for so many classes of so many words."""
    return {"e": (len(PLACES), side * side + 1, HIDDEN), "h": (HIDDEN,), "c": (HIDDEN, side), "cb": (side,), "m": (side, HIDDEN, side), "mb": (side, side)}


def side_of(total: int) -> int:
    """Classes, and words in each, for a corpus of so many words."""
    return min(MOST_CLASSES, max(CLASSES, int(np.ceil(total**0.25))))


def step_size(done: int, most: int = STEP) -> int:
    """Words of a step after so many steps."""
    return min(most, FIRST << min(done // SAME, 30))


def words(text: str | None) -> list[str]:
    """What WORD finds in the lower-cased text: marks are set apart by spaces, as that takes a third of the time."""
    t = (text or "").lower()
    if t.isascii():
        marks = [c for c in ASCII_MARKS if c in t]
    else:
        marks = [c for c in set(t) if not (c.isalnum() or c == "_" or c.isspace())]
        if len(marks) > FEW_MARKS:
            return WORD.findall(t)
    for c in marks:
        t = t.replace(c, f" {c} ")
    return t.split()


class Places(dict):
    """Word to its place among the different words met so far."""

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        return i


class Vocabulary(dict):
    """Word to id; words without one go to a bucket."""

    def __init__(self, frequent: list[str], side: int = CLASSES, buckets: dict[int, int] | None = None, total: int = 0):
        super().__init__((w, side + i) for i, w in enumerate(frequent))
        self.frequent, self.side, self.buckets, self.total = frequent, side, buckets or {}, total
        self.most, self.type = KNOWN + len(frequent), "H" if side * side < 1 << 16 else "I"
        self.share = np.array([-np.log(max(1, self.buckets.get(i, 1))) for i in range(side)])  # a word's count comes with the join

    def __missing__(self, word: str) -> int:
        i = zlib.crc32(word.encode()) % self.side
        if len(self) < self.most:
            self[word] = i
        return i

    def __reduce__(self):
        return Vocabulary, (self.frequent, self.side, self.buckets, self.total)

    def flat(self, runs: list[bytes]) -> np.ndarray:
        """Ids of all texts, with padding between them."""
        pad = array(self.type, [self.side**2] * SIDE).tobytes()
        return np.frombuffer(pad + pad.join(runs) + pad, self.type)


def start(side: int = CLASSES, seed: int = 11) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    return {k: (r.normal(scale=0.1, size=s) if len(s) > 1 and k != "cb" else np.zeros(s)).astype(np.float32) for k, s in shapes(side).items()}


def hidden(p: dict[str, np.ndarray], ids: np.ndarray, at: np.ndarray):
    """For the words at the given places, by id in order: their order, ids, ids around them, and the hidden layer, a column a word, over a row of ones."""
    order = np.argsort(ids[at], kind="stable")
    at = at[order]
    around = [ids[at + o] for o in PLACES]
    h = p["h"] + sum(e.take(x, 0) for e, x in zip(p["e"], around, strict=True))
    out = np.ones((HIDDEN + 1, len(at)), h.dtype)
    out[:-1] = np.tanh(h, out=h).T
    return order, ids[at], around, out


def heads(x: np.ndarray) -> np.ndarray:
    """Where a value begins, of values in order."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def pieces(p: dict[str, np.ndarray], y: np.ndarray, h: np.ndarray, shift: bool):
    """The two softmaxes for words by id in order, BLOCK of them at once: from, to, and for each softmax its scores, which the next piece overwrites,
    and their parts: the class (None: the softmax over classes), from and to within the piece, and the weights with the bias as last row."""
    side, n = len(p["cb"]), len(y)
    c, m = np.concatenate([p["c"], p["cb"][None]]), np.concatenate([p["m"], p["mb"][:, None]], 1)
    buffers, classes = np.empty((2, BLOCK, side), h.dtype), y // side
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        edge = [*heads(classes[a:b]).tolist(), b - a]
        both = [(buffers[0, : b - a], [(None, 0, b - a, c)]), (buffers[1, : b - a], [(k := int(classes[a + lo]), lo, hi, m[k]) for lo, hi in zip(edge, edge[1:])])]
        for z, parts in both:
            for _, lo, hi, w in parts:
                np.matmul(h[:, a + lo : a + hi].T, w, out=z[lo:hi])
            if shift:
                z -= z.max(1, keepdims=True)
        yield a, b, both


def in_range(sums: np.ndarray) -> bool:
    return bool(LEAST < sums.min() and sums.max() < LARGEST)


def log_likelihood(p: dict[str, np.ndarray], ids: np.ndarray, at: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """Of the words at the given places; `share` is added for each bucket."""
    side = len(p["cb"])
    out, share, row = np.empty(len(at), np.float64), np.broadcast_to(share, side), np.arange(BLOCK)
    for lo in range(0, len(at), STEP):
        order, y, _, h = hidden(p, ids, at[lo : lo + STEP])
        branch, one = (y // side, y % side), np.ones(side, h.dtype)
        for shift in (False, True):
            own, sums = np.zeros(len(y), h.dtype), np.empty((2, len(y)), h.dtype)
            with np.errstate(over="ignore"):
                for a, b, both in pieces(p, y, h, shift):
                    for (z, _), j, s in zip(both, branch, sums, strict=True):
                        own[a:b] += z[row[: b - a], j[a:b]]
                        np.matmul(np.exp(z, out=z), one, out=s[a:b])
            if in_range(sums):
                break
        out[lo + order] = own - np.log(sums).sum(0) + np.where(y < side, share[y % side], 0.0)
    return out


def slopes(p: dict[str, np.ndarray], ids: np.ndarray, at: np.ndarray, shift: bool = False) -> dict:
    """The gradient; that of the embeddings as rows and their values, for each place."""
    side, n = len(p["cb"]), len(at)
    _, y, around, h = hidden(p, ids, at)
    kind = h.dtype.type
    scale, one, sums = kind(1 / n), np.ones(side, kind), np.empty((2, n), kind)
    dh, c, m = np.zeros((HIDDEN, n), kind), np.zeros((HIDDEN + 1, side), kind), np.zeros((side, HIDDEN + 1, side), kind)
    back = np.empty((HIDDEN, BLOCK), kind)
    with np.errstate(all="ignore"):
        for a, b, both in pieces(p, y, h, shift):
            for (z, parts), total in zip(both, sums, strict=True):  # the exponentials stay as they are, what is narrower is divided by their sum
                s = scale / np.matmul(np.exp(z, out=z), one, out=total[a:b])
                by, d = h[:, a:b] * s, back[:, : b - a]
                for k, lo, hi, w in parts:
                    to = c if k is None else m[k]
                    to += by[:, lo:hi] @ z[lo:hi]
                    np.matmul(w[:-1], z[lo:hi].T, out=d[:, lo:hi])
                d *= s
                dh[:, a:b] += d
    if not shift and not in_range(sums):
        return slopes(p, ids, at, True)
    head = heads(y)  # less what belongs to the words themselves, added up by word and by class
    k, j = np.divmod(y[head], side)
    own, first = np.add.reduceat(h, head, 1) * scale, heads(k)
    m[k, :, j] -= own.T
    c[:, k[first]] -= np.add.reduceat(own, first, 1)
    dh -= np.repeat((p["c"][:, k] + p["m"][k, :, j].T) * scale, np.diff(np.append(head, n)), 1)
    dh *= 1 - h[:-1] * h[:-1]
    g, rows = {"c": c[:-1], "cb": c[-1], "m": m[:, :-1], "mb": m[:, -1], "h": dh.sum(1), "e": []}, np.ascontiguousarray(dh.T)
    for x in around:
        order = np.argsort(x, kind="stable")
        x = x[order]
        head = heads(x)
        g["e"].append((x[head], np.add.reduceat(rows.take(order, 0), head)))
    return g


def gradient(p: dict[str, np.ndarray], ids: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    g = slopes(p, ids, at)
    e = np.zeros_like(p["e"])
    for k, (x, d) in enumerate(g["e"]):
        e[k][x] = d
    return g | {"e": e}


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float = 0.01):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        self.spare = {k: np.empty_like(x) for k, x in p.items() if k != "e"}

    def step(self, g: dict) -> None:
        self.t += 1
        rate = np.float32(self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t) / (1 + self.t / 400))
        for k, x in self.p.items():
            if k == "e":
                for x_, m_, v_, (rows, d) in zip(x, self.m[k], self.v[k], g[k], strict=True):
                    m, v = m_.take(rows, 0), v_.take(rows, 0)
                    by = self.change(m, v, d, np.empty_like(d), rate)
                    m_[rows], v_[rows] = m, v
                    x_[rows] = x_.take(rows, 0) - by
            else:
                x -= self.change(self.m[k], self.v[k], g[k], self.spare[k], rate)

    @staticmethod
    def change(m: np.ndarray, v: np.ndarray, d: np.ndarray, out: np.ndarray, rate: np.float32) -> np.ndarray:
        """Moves both averages; what the parameters go down by, in `out`."""
        np.subtract(d, m, out=out)
        out *= np.float32(0.1)
        m += out
        np.multiply(d, d, out=out)
        out -= v
        out *= np.float32(0.001)
        v += out
        np.sqrt(v, out=out)
        out += np.float32(1e-8)
        np.divide(m, out, out=out)
        out *= rate
        return out


def split(docs: DataFrame) -> DataFrame:
    """A row per run of texts: r_ (its first row's own number), i_ and size (words) of each text, the run's different words w and their counts n, and
    ids, the place in w of each word, in two bytes or four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            i, texts, lo = batch.column(0), batch.column(1), 0
            while lo < batch.num_rows:
                places, ids, size = Places(), array("I"), []
                while lo + len(size) < batch.num_rows and len(size) < RUN and len(ids) < RUN_WORDS:
                    before = len(ids)
                    ids.extend(map(places.__getitem__, words(texts[lo + len(size)].as_py())))
                    size.append(len(ids) - before)
                own = np.frombuffer(ids, np.uint32)
                n = np.bincount(own, minlength=len(places))
                own = own.astype(np.uint16) if len(places) <= 1 << 16 else own
                values = [at, i[lo : lo + len(size)].to_pylist(), size, list(places), n, own.tobytes()]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=["r_", "i_", "size", "w", "n", "ids"])
                at, lo = at + len(size), lo + len(size)

    return docs.select("i_", "t_").mapInArrow(run, "r_ long, i_ array<long>, size array<int>, w array<string>, n array<long>, ids binary")


def counted(runs: DataFrame) -> DataFrame:
    """w, n: every word of the runs."""
    each = runs.select(F.explode(F.arrays_zip("w", "n")).alias("x"))
    return keep(each.groupBy(F.col("x.w").alias("w")).agg(F.sum("x.n").alias("n")), "words")


def word_counts(docs: DataFrame) -> DataFrame:
    """w, n: every word of the column t_."""
    return counted(split(docs.select(F.lit(0).cast("long").alias("i_"), "t_")))


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    side = side_of(total)
    top = [(r["w"], r["n"]) for r in counts.orderBy(F.desc("n"), "w").limit(side * side - side).collect()]
    bucket = F.crc32(F.col("w").cast("binary")) % side
    buckets = {r["b"]: r["n"] for r in counts.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect()}  # `side` rows
    for w, n in top:
        buckets[zlib.crc32(w.encode()) % side] -= n
    return Vocabulary([w for w, _ in top], side, buckets, total)


def encode(runs: DataFrame, held) -> DataFrame:
    """A row per text of the runs, kept: r_ (its own number), i_, ids, rare (the words without an id of their own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for batch in batches:
            for j in range(batch.num_rows):
                at, i, size, w, places = (batch.column(k)[j] for k in range(5))
                w, n = w.values, len(i)
                known = np.fromiter(map(v.__getitem__, w.to_pylist()), v.type, len(w))
                places = np.frombuffer(places.as_buffer(), np.uint16 if len(w) <= 1 << 16 else np.uint32)
                own, end = known[places], np.concatenate([[0], np.cumsum(size.values)])
                rare = own < v.side
                before = np.concatenate([[0], np.cumsum(rare)])[end]
                ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((end * own.itemsize).astype(np.int32)), pa.py_buffer(own)])
                rare = pa.ListArray.from_arrays(pa.array(before, pa.int32()), w.take(pa.array(places[rare])))
                yield pa.RecordBatch.from_arrays([pa.array(at.as_py() + np.arange(n)), i.values, ids, rare], names=["r_", "i_", "ids", "rare"])

    columns = runs.select("r_", "i_", "size", "w", "ids")
    return keep(columns.mapInArrow(run, "r_ long, i_ long, ids binary, rare array<string>"), "ids")


def train(coded: DataFrame, held, step: int | None = None) -> dict[str, np.ndarray]:
    """The average of the tasks' models. A task's steps grow by how many it has taken, or are all of `step` words, whatever the table's size."""
    texts, side, total = coded.select("ids"), held.value.side, held.value.total
    if (tasks := max(1, total // TASK_WORDS)) < texts.rdd.getNumPartitions():
        texts = texts.coalesce(tasks)
    names = [f"x{j}" for j in range(WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p, n = held.value, start(side), 0
        adam, r = Adam(p), np.random.default_rng(3)
        for batch in batches:
            for lo in range(0, batch.num_rows, RUN):
                ids = v.flat(batch.column(0)[lo : lo + RUN].to_pylist())
                at = np.flatnonzero(ids < side * side)
                r.shuffle(at)
                k = 0
                while k < len(at):
                    now = step or step_size(adam.t)
                    adam.step(slopes(p, ids, at[k : k + now]))
                    k += now
                n += len(at)
        if n:
            flat = np.concatenate([p[k].ravel() for k in p]).astype(float) * n
            rows = np.concatenate([flat, np.zeros(-len(flat) % WIDE)]).reshape(-1, WIDE)
            columns = [np.arange(len(rows)), np.full(len(rows), n), *rows.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["i", "n", *names])

    sums = texts.mapInArrow(run, "i long, n long, " + ", ".join(f"{x} double" for x in names)).groupBy("i")
    mean = sums.agg(*((F.sum(x) / F.sum("n")).alias(x) for x in names)).toPandas()  # one value per parameter
    if not len(mean):
        return start(side)
    flat, out, lo = mean.sort_values("i")[names].to_numpy(np.float32).ravel(), {}, 0
    for k, s in shapes(side).items():
        n = int(np.prod(s))
        out[k], lo = flat[lo : lo + n].reshape(s), lo + n
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", step: int | None = None) -> DataFrame:
    """One row per row of docs: id_, n_tokens, log_likelihood (sum), per_token."""
    sc = docs.sparkSession.sparkContext
    d = docs.select(F.col(id_col).cast("long").alias("i_"), F.col(text_col).cast("string").alias("t_"))
    runs = keep(split(d), "runs")
    counts = counted(runs)
    held = sc.broadcast(vocabulary(counts))
    coded = encode(runs, held)
    drop(runs)
    model = sc.broadcast(train(coded, held, step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = held.value, model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, RUN):
                part = batch.slice(lo, RUN)
                runs = part.column(2).to_pylist()
                ids = v.flat(runs)
                ll = np.concatenate([[0.0], np.cumsum(log_likelihood(p, ids, np.flatnonzero(ids < v.side**2), v.share))])
                n = np.array([len(x) for x in runs], np.int64) // ids.itemsize
                end = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(ll[end] - ll[end - n])], names=["r_", "id_", "n_tokens", "ll"])

    scored = coded.select("r_", "i_", "ids").mapInArrow(run, "r_ long, id_ long, n_tokens long, ll double")
    rare = coded.select("r_", F.explode("rare").alias("w")).join(counts.where("n > 1"), "w")  # the logarithm of 1 is 0
    total = F.col("ll") + F.coalesce("own", F.lit(0.0))
    out = scored.join(rare.groupBy("r_").agg(F.sum(F.log("n")).alias("own")), "r_", "left")
    return out.select("id_", "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("per_token"))


def op8_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    out = score_documents(table(spark, sf_dir, "documents"))
    return out.select(F.col("id_").alias("doc_id"), "n_tokens", F.round("log_likelihood", 3).alias("log_likelihood"), F.round("per_token", 5).alias("per_token"))
