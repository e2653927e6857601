"""Toxicity from class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary texts, of the same three parts. A bigram keeps its discounted share of what its
class saw after a word; what is left goes to the class's words, counted by how many different words each follows; what their
discount leaves goes to a spelling of the word, letter by letter, from the letters before it. Spelling backs off from
`LETTERS` letters to fewer, by continuation counts again, and its lowest orders are counts that both classes share. So an
expression that a class has often is told from one it never has, a rare or unseen word is judged by the stem it shares with
others, and what neither class has seen costs both the same. Discounts are n1 / (n1 + 2 n2) of each class and order.

A text's evidence is the difference of its two length-normalised log-likelihoods: over all words, and, as toxic expressions
are short, over its highest word, run of three words and three highest words. A logistic curve over these and the length,
fitted on labelled texts that gave no counts, makes it a probability.

The classifier is fitted on a bounded sample: of each class at most `per_class` labelled documents, those with the least
hash of their id; two thirds give counts, one third the curve. Counting runs in Spark; the model is the table of words,
bigrams and letter runs of that sample that occur twice or more, so its size is bounded by the sample. Scoring is one pass
over the documents without a shuffle.

Null or wordless text has no evidence and gets the curve's value at zero; without labels of both classes every score is the
share of toxic labels (0 if there are none). A document labelled more than once is toxic if any label says so; null labels
count for nothing; repeated rows are scored alike; an empty table gives an empty result; other columns
pass through, but for one named toxicity_, which is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import keep, table, turn_to

WORD = re.compile(r"\w+")
#: Letters of the longest run that spelling counts, and up to which orders both classes share their counts.
LETTERS, SHARED = 5, 2
FIRST, LAST = "\x02", "\x03"
#: Numbers that describe a text.
FEATURES = 5
#: Spelled words that a worker remembers; only for speed.
REMEMBERED = 200_000
#: Texts that a task scores at a time.
SLICE = 512


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn_to("toxicity")
    for batch in batches:
        seen: Counter = Counter()
        for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = words(t)
            seen.update({(y, h, x) for h, x in zip(["", *w], w, strict=False)})  # a text counts an expression once
        keys = list(seen)
        cols = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["y", "h", "w", "n"])


STEP = np.uint64(0x9E3779B97F4A7C15)


class Runs:
    """The letters of some words, each between FIRST and LAST, and codes of the runs of letters that end at each place."""

    def __init__(self, some: list[str]):
        self.letters = np.frombuffer("".join([FIRST + w + LAST for w in some]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        size = np.array([len(w) + 2 for w in some])
        self.head = np.cumsum(size) - size
        self.word = np.repeat(np.arange(len(some)), size)
        self.start = self.head[self.word]
        self.at = np.arange(len(self.letters))

    def orders(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each order k: k, places where a run of k letters ends (no run is FIRST alone), and codes of the run, of all but its last letter and of all but its first."""
        run, power = np.zeros(len(self.at), np.uint64), np.uint64(1)
        for k in range(1, LETTERS + 1):
            whole = np.flatnonzero((self.at - k + 1 >= self.start) & (self.at > self.start))
            shorter = run
            with np.errstate(over="ignore"):
                run = run + np.where(self.at - k + 1 >= self.start, self.letters[np.maximum(self.at - k + 1, 0)], np.uint64(0)) * power
                power = power * STEP
            yield k, whole, run[whole], shorter[whole - 1] if k > 1 else np.zeros(len(whole), np.uint64), shorter[whole]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From w, n0, n1: how often each class has each run."""
    for batch in batches:
        r, n = Runs(batch.column(0).to_pylist()), [batch.column(k).to_numpy() for k in (1, 2)]
        for k, at, run, before, after in r.orders() if len(batch) else ():
            code, one, inverse = np.unique(run, return_index=True, return_inverse=True)
            sums = [np.bincount(inverse, x[r.word[at]], len(code)).astype(np.int64) for x in n]
            cols = [code, before[one], after[one]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(code), k, np.int32)), *(pa.array(c.view(np.int64)) for c in cols), pa.array((at - k + 1 == r.start[at])[one]), *map(pa.array, sums)],
                names=["k", "code", "before", "after", "head", "n0", "n1"],
            )


class Level:
    """One order of spelling: each run's discounted share in both classes, and the mass that a run of one letter less leaves."""

    def __init__(self, code: np.ndarray, counts: np.ndarray, before: np.ndarray, place: np.ndarray, totals: np.ndarray, discounts: np.ndarray):
        at = np.argsort(place)
        self.place, total = place[at], totals[at]
        up = np.argsort(code)
        self.code = code[up]
        under = np.searchsorted(self.place, before)
        part = np.maximum(counts - discounts, 0) / np.maximum(total[under], 1e-9)
        self.part = part[up]
        self.left = np.stack([1 - np.bincount(under, part[:, y], len(place)) for y in (0, 1)], 1)
        self.left[total <= 0] = 1.0

    @staticmethod
    def find(table: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        j = np.minimum(np.searchsorted(table, code), len(table) - 1)
        return j, table[j] == code


class Spelling:
    """Log-likelihoods of words, letter by letter."""

    def __init__(self, levels: list[Level], alphabet: int):
        self.levels, self.alphabet = levels, alphabet

    def logs(self, some: list[str]) -> np.ndarray:
        """A row per word: ordinary, toxic."""
        return np.concatenate([np.zeros((0, 2)), *(self.some(some[lo : lo + 8192]) for lo in range(0, len(some), 8192))])

    def some(self, words_: list[str]) -> np.ndarray:
        r = Runs(words_)
        p = np.full((len(r.at), 2), 1.0 / self.alphabet)
        for level, (_, where, run, before, _) in zip(self.levels, r.orders(), strict=False):
            at, known = level.find(level.place, before)
            go = np.flatnonzero(known)
            j, there = level.find(level.code, run[go])
            p[where[go]] = np.where(there[:, None], level.part[j], 0.0) + level.left[at[go]] * p[where[go]]
        logs = np.log(np.maximum(p, 1e-300))
        logs[r.head] = 0
        return np.add.reduceat(logs, r.head)


class Model:
    """Log-likelihood ratios: of words, of the mass each history leaves, and of the bigrams that are kept."""

    def __init__(self, unigrams, bigrams, followed: np.ndarray, discounts: np.ndarray, spelling: Spelling):
        """Arrow tables - unigrams: w, f0, f1 (words each class saw it follow), n0, n1; bigrams: h, w, n0, n1; followed: sums of f0, f1; discounts: of words and of pairs, for both classes."""
        self.spelling, self.remembered = spelling, {}
        names = unigrams["w"].to_pylist()
        self.at = {w: i + 1 for i, w in enumerate(names)}
        size = len(self.at) + 1
        both = lambda t, a, b: np.stack([t[a].to_numpy(), t[b].to_numpy()], 1).astype(float)
        f = both(unigrams, "f0", "f1")
        own = np.maximum(f - discounts[0], 0) / np.maximum(followed, 1)
        self.rest = 1 - own.sum(0)  # what the words leave to spelling
        p = np.concatenate([[[1.0, 1.0]], own + self.rest * np.exp(spelling.logs(names))])
        self.word = np.log(p[:, 1]) - np.log(p[:, 0])
        h, w = (np.array([self.at.get(x, 0) for x in bigrams[c].to_pylist()], np.int64) for c in ("h", "w"))
        known = (h > 0) & (w > 0)
        h, w = h[known], w[known]
        n = np.concatenate([[[0.0, 0.0]], both(unigrams, "n0", "n1")])
        part = np.maximum(both(bigrams, "n0", "n1")[known] - discounts[1], 0) / np.maximum(n[h], 1)
        mass = np.maximum(1 - np.stack([np.bincount(h, part[:, y], size) for y in (0, 1)], 1), 1e-6)
        self.left = np.log(mass[:, 1]) - np.log(mass[:, 0])
        logs = np.log(part + mass[h] * p[w])
        kept = logs[:, 1] - logs[:, 0] - self.left[h] - self.word[w]
        order = np.argsort(h * size + w)
        self.code, self.kept, self.size = (h * size + w)[order], kept[order], size
        self.curve, self.middle = np.zeros(1 + FEATURES), np.zeros(FEATURES)

    def unknown(self, some: list[str]) -> None:
        """Spell the words that are not remembered."""
        if len(self.remembered) > REMEMBERED:
            self.remembered.clear()
        new = list({w for w in some if w not in self.remembered})
        with np.errstate(divide="ignore"):
            logs = self.spelling.logs(new) + np.log(np.maximum(self.rest, 1e-12))
        self.remembered.update(zip(new, (logs[:, 1] - logs[:, 0]).tolist(), strict=True))

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """For each text: the ratio per word, over the word and the run of three words where it is highest, over the three highest words, and the log of the length."""
        at, out = self.at, np.zeros((len(texts), FEATURES))
        for lo in range(0, len(texts), 256):
            some = [words(t) for t in texts[lo : lo + 256]]
            n = np.array([len(w) for w in some])
            flat = [x for w in some for x in w]
            ids = np.array([at.get(x, 0) for x in flat], np.int64)
            if not len(ids):
                continue
            full = n > 0
            starts = (np.cumsum(n) - n)[full]
            h = np.concatenate([[0], ids[:-1]])
            h[starts] = 0
            strange = np.flatnonzero(ids == 0)
            odd = [flat[i] for i in strange]
            self.unknown(odd)
            s = self.word[ids] + self.left[h]
            s[strange] += np.array([self.remembered[x] for x in odd])
            if len(self.code):
                code = h * self.size + ids
                j = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
                s += np.where((self.code[j] == code) & (h > 0), self.kept[j], 0.0)
            m = n[full]
            left = np.repeat(starts + m, m) - np.arange(len(s))  # words from here to the end of the text
            three = s + np.where(left > 1, np.append(s[1:], 0), 0) + np.where(left > 2, np.append(s[2:], [0, 0])[: len(s)], 0)
            three = np.where(left >= np.minimum(3, np.repeat(m, m)), three / np.minimum(3, np.repeat(m, m)), -np.inf)
            doc = np.repeat(np.arange(len(m)), m)
            high = s[np.lexsort((-s, doc))]
            best3 = [high[starts + np.minimum(k, m - 1)] * (m > k) for k in range(3)]
            rows = lo + np.flatnonzero(full)
            out[rows, 0] = np.add.reduceat(s, starts) / m
            out[rows, 1] = np.maximum.reduceat(s, starts)
            out[rows, 2] = np.maximum.reduceat(three, starts)
            out[rows, 3] = sum(best3) / np.minimum(m, 3)
            out[rows, 4] = np.log(m)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + (x - self.middle) @ self.curve[1:], -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Newton steps for the logistic curve, on scaled features with a slight ridge."""
        self.middle, scale = x.mean(0), x.std(0) + 1e-9
        a = np.column_stack([np.ones(len(x)), (x - self.middle) / scale])
        b = np.zeros(a.shape[1])
        ridge = 0.05 * np.eye(len(b))
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            b += np.linalg.solve((a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, a.T @ (weight * (y - p)) - ridge @ b)
        self.curve = np.concatenate([b[:1], b[1:] / scale])


def discount(ones: float, twos: float) -> float:
    """The usual estimate from how many things were seen once and twice; a half where that says nothing."""
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def seen(*names: str) -> list[Column]:
    return [F.count_if(F.col(n) == k).alias(f"{n}_{k}") for n in names for k in (1, 2)]


def discounts_of(row, *names: str) -> np.ndarray:
    return np.array([discount(row[f"{n}_1"], row[f"{n}_2"]) for n in names])


def spelling_of(words_: DataFrame) -> Spelling:
    """From w, n0, n1: counts of all runs of up to LETTERS letters, of which the codes of those seen twice come to the driver."""
    one = [F.any_value(c).alias(c) for c in ("before", "after", "head")]
    counts = words_.select("w", "n0", "n1").mapInArrow(_runs, "k int, code long, before long, after long, head boolean, n0 long, n1 long")
    raw = keep(counts.groupBy("k", "code").agg(*one, F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "runs")
    held = (F.col("k") == LETTERS) | F.col("head")
    longer = raw.where("k > 1").groupBy((F.col("k") - 1).alias("k"), F.col("after").alias("code")).agg(F.count_if(F.col("n0") > 0).alias("n0"), F.count_if(F.col("n1") > 0).alias("n1"))
    cols = ["k", "code", "before", "n0", "n1"]
    some = raw.where(held).select(*cols).unionByName(raw.where(~held).drop("n0", "n1").join(longer, ["k", "code"]).select(*cols))
    pooled = F.col("k") <= SHARED
    some = keep(some.select("k", "code", "before", *(F.when(pooled, F.col("n0") + F.col("n1")).otherwise(F.col(n)).alias(n) for n in ("n0", "n1"))), "letters")
    cut = {r["k"]: discounts_of(r, "n0", "n1") for r in some.groupBy("k").agg(*seen("n0", "n1")).collect()}  # LETTERS rows
    before = some.groupBy("k", F.col("before").alias("code")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 2").toArrow()
    kept = some.where("n0 + n1 >= 2").toArrow()  # both are bounded by the sample's words
    column = lambda t, c: t.column(c).to_numpy()
    levels = []
    for k in range(1, LETTERS + 1):
        own, up = kept.filter(pc.equal(kept["k"], k)), before.filter(pc.equal(before["k"], k))
        if not len(own):
            break
        both = lambda t: np.stack([column(t, "n0"), column(t, "n1")], 1).astype(float)
        levels.append(Level(column(own, "code").view(np.uint64), both(own), column(own, "before").view(np.uint64), column(up, "code").view(np.uint64), both(up), cut[k]))
    return Spelling(levels, some.where("k = 1").count() + 1)


def counted(both: DataFrame) -> Model:
    """The model of a table h, w, n0, n1: in how many texts of each class w follows h."""
    words_ = keep(both.groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count_if(F.col("n0") > 0).alias("f0"), F.count_if(F.col("n1") > 0).alias("f1")), "words")
    t = words_.agg(F.sum("f0").alias("f0"), F.sum("f1").alias("f1"), *seen("f0", "f1")).first()
    pair = discounts_of(both.agg(*seen("n0", "n1")).first(), "n0", "n1")
    uni = words_.where("n0 + n1 >= 2").orderBy("w").toArrow()
    bi = both.where("greatest(n0, n1) >= 2").orderBy("h", "w").toArrow()
    return Model(uni, bi, np.array([t["f0"] or 0, t["f1"] or 0], float), np.stack([discounts_of(t, "f0", "f1"), pair]), spelling_of(words_))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> Model | float:
    """The model, or a constant score where the labels don't hold both classes."""
    lab = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("l_id_")).agg(F.max(label_col).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    by_hash = F.xxhash64("l_id_")
    pick = lab.where("y = 1").orderBy(by_hash, "l_id_").limit(per_class).unionByName(lab.where("y = 0").orderBy(by_hash, "l_id_").limit(per_class))
    chosen = [(r["l_id_"], r["y"]) for r in pick.collect()]  # at most 2 * per_class rows
    if not chosen or len({y for _, y in chosen}) < 2:
        return share
    small = docs.sparkSession.createDataFrame(chosen, "l_id_ long, y int")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "l_id_"), F.lit(3))
    texts = docs.select(F.col(id_col).alias("d_id_"), F.col(text_col).alias("t_")).join(F.broadcast(small), F.col("d_id_") == F.col("l_id_"))
    pairs = texts.where(fold > 0).select("y", "t_").mapInArrow(_pairs, "y int, h string, w string, n long")
    model = counted(keep(pairs.groupBy("h", "w").agg(*(F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1))), "pairs"))
    spread = evidence(texts.where(fold == 0).select("y", "t_"), model, "t_").select("y", "__evidence").orderBy("y", "__evidence").toPandas()
    if spread["y"].nunique() < 2:
        return share
    y = spread["y"].to_numpy(float)
    taken = Counter(v for _, v in chosen)
    model.fit(np.stack(spread["__evidence"].to_numpy()), y, np.where(y == 1, sizes[1] / taken[1], sizes[0] / taken[0]))
    return model


def evidence(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("toxicity")
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):  # so that few texts stand in Python at a time
                batch = whole.slice(lo, SLICE)
                x = held.value.evidence(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(x), pa.list_(pa.float64())), pa.array(held.value.score(x), pa.float64())], names=[*batch.schema.names, "__evidence", "toxicity_"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `__evidence` array<double>, toxicity_ double")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4000) -> DataFrame:
    """docs with toxicity_ (0 to 1), fitted on the given labels and the documents they name."""
    docs = docs.drop("toxicity_")
    model = fit(docs, labels, id_col, text_col, label_col, per_class)
    if isinstance(model, float):
        return docs.withColumn("toxicity_", F.lit(model))
    return evidence(docs, model, text_col).drop("__evidence")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


#: From this score on a document counts as toxic.
THRESHOLD = 0.3


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    out = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    s = F.col("toxicity_")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("score"), (s >= THRESHOLD).cast("int").alias("predicted"))
