"""Exact dedup, fill-in-the-middle and the filter audit against plain Python and their SQL."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cardloom.llm import fimscatter, polyprint, radixaudit
from cardloom.llm.radixaudit import Trie, adaptive_ranges, text_mask

LONG = "long wörds 日本 " * 20_000
ODD = [
    (1, "a"), (2, "a"), (2, "a"), (None, "a"), (3, None), (4, ""), (5, "b " * 70), (6, "b " * 70), (7, LONG), (8, LONG), (9, LONG + "x"), (9, LONG[:-1] + "y"), (10, "é" * 65_536), (11, "é" * 65_536),
    (12, "é"), (None, None), (13, "<P> x"), (14, "<S"), (15, "ab\x00c"), (16, "ab\x00d"), (-4, "b"), (17, "A lot OF SHOUTING"), (18, "😀" * 9), (19, "< P>"), (20, "x"), (20, "y"),
]


@pytest.fixture(autouse=True, scope="module")
def folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def brute_classes(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    out = []
    for t, ids in by.items():
        top = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out.append((i, top, len(ids), first and i == top, sha(t)))
            first = first and i != top
    return Counter(out)


def classes(spark, rows, **options):
    return Counter(tuple(r) for r in polyprint.classes(frame(spark, rows), **options).select("id_", "keep_id_", "group_size_", "kept_", "sha256_").collect())


@pytest.mark.parametrize("options", [{}, {"small": 0}, {"size": 1000}, {"hashes": ((3, 2), (2, 1)), "size": 50_000}, {"hashes": ((1, 1), (1, 1)), "small": 0}])
def test_classes(spark, options):
    assert classes(spark, ODD, **options) == brute_classes(ODD)


def test_one_hot_text_in_many_salts(spark, monkeypatch):
    monkeypatch.setattr(polyprint, "SALT", 7)
    monkeypatch.setattr(polyprint, "HOT", 3)
    rows = [(i, "hot") for i in range(300)] + [(i, f"t{i // 2}") for i in range(300, 340)] + [(5, "hot")] * 9
    assert classes(spark, rows) == classes(spark, rows, small=0) == brute_classes(rows)


def test_same_id_and_length_but_other_text(spark):
    rows = [(1, "ab"), (1, "ba"), (1, "ab"), (2, "ba"), (None, "ab")]
    assert classes(spark, rows, hashes=((1, 1), (1, 1))) == brute_classes(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, quality int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert polyprint.classes(docs).count() == polyprint.drop_copies(docs).count() == fimscatter.restored(fimscatter.fill_in_middle(docs)).count() == radixaudit.audit(docs, labels).count() == 0


def test_what_stays_keeps_its_columns(spark):
    docs = frame(spark, [(i, t, k, f"{k}") for k, (i, t) in enumerate(ODD)], "doc_id long, text string, size_ int, top_ string")
    got = polyprint.drop_copies(docs)
    assert got.columns == docs.columns
    assert Counter((r[0], r[1] or "") for r in got.collect()) == Counter((max((i for i, x in ODD if (x or "") == t and i is not None), default=None), t) for t in {t or "" for _, t in ODD})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=9), max_size=6))
def test_pieces_compose(pieces):
    """The hash of the whole is the sum of the pieces' hashes, each shifted by what is behind it."""
    for p, b in polyprint.HASHES:
        value = lambda x: sum(c * pow(b, len(x) - 1 - i, p) for i, c in enumerate(x)) % p  # noqa: B023, E731
        behind = [sum(map(len, pieces[k + 1 :])) for k in range(len(pieces))]
        assert value(b"".join(pieces)) == sum(value(x) * pow(b, n, p) for x, n in zip(pieces, behind, strict=True)) % p


def test_stored_pieces_have_the_fingerprint_of_the_whole(spark):
    texts = {1: LONG, 2: "x" * 99_999, 3: "", 4: "é\n" * 70_001}
    cut = [(i, k, t[a : a + w]) for i, t in texts.items() for w in (7_001 * i,) for k, a in enumerate(range(0, max(len(t), 1), w))]
    whole = polyprint.fingerprints(frame(spark, list(texts.items()))).select("id_", "n_", "f1_", "f2_")
    parts = polyprint.fingerprints_of_pieces(frame(spark, cut, "d long, no int, body string"), "d", "no", "body")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.select("id_", "n_", "f1_", "f2_").collect()))
    for i, n, f1, _ in whole.collect():
        p, b = polyprint.HASHES[0]
        h = 0
        for c in texts[i].encode():
            h = (h * b + c) % p
        assert (n, f1) == (len(texts[i].encode()), h)


def brute_fim(i, text):
    t, d = text or "", hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", t
    return (n, "spm", f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}") if h[3] % 100 < 20 else (n, "psm", f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}")


@pytest.mark.parametrize("block", [1, 7, 1000, fimscatter.BLOCK])
def test_fill_in_middle(spark, block):
    rows = [(i, t if block > 7 or len(t or "") < 999 else t[:99]) for i, t in ODD] + [(100 + k, "<" * (k % 5) + "S>" * (k % 3) + f"word{k} é" + "<P" * (k % 2)) for k in range(150)]
    docs = frame(spark, [(i, t, 3) for i, t in rows], "doc_id long, text string, n int")
    out = fimscatter.restored(fimscatter.transformed(fimscatter.planned(docs), block), block=block).collect()
    want = Counter((i, t, *brute_fim(i, t), t or "") for i, t in rows)
    assert Counter((r["doc_id"], r["text"], r["fim_n"], r["fim_form"], r["fim_output"], r["fim_restored"]) for r in out) == want
    assert {r["n"] for r in out} == {3} and {f for *_, f, _, _ in want} == {"plain", "psm", "spm"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="aé😀<>PSM", max_size=12), st.integers(0, 12), st.integers(0, 12), st.integers(0, 2)), max_size=6), st.integers(1, 40))
def test_scatter_and_gather(texts, block):
    texts = [(t, *sorted((min(a, len(t)), min(b, len(t)))), 0 if any(m in t for m in fimscatter.MARKS) else f) for t, a, b, f in texts]
    raw = [t.encode() for t, *_ in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    cuts = fimscatter.byte_cuts(data, np.array([len(t) for t, *_ in texts], np.int64), np.array([x[1:3] for x in texts], np.int64).reshape(-1, 2), block)
    form = np.array([f for *_, f in texts], np.int64)
    out, ends = fimscatter.scatter(data, offsets, cuts[:, 0], cuts[:, 1], form, block)
    want = [t if f == 0 else f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}" if f == 1 else f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}" for t, a, b, f in texts]
    assert [bytes(out[s:e]).decode() for s, e in zip(ends, ends[1:], strict=False)] == want
    back, at = fimscatter.gather(out, ends, form, block)
    assert [bytes(back[s:e]).decode() for s, e in zip(at, at[1:], strict=False)] == [t for t, *_ in texts]


def brute_mask(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return (len(w) < 50) + 2 * (100 * len(set(w)) < 65 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + 8 * bool(re.search("[#$%&*|]", t))


def brute_failures(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    return [(i, s or "", brute_mask(t or "") + 16 * (i is not None and i > least[t or ""])) for i, t, s in rows]


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    by = defaultdict(list)
    for i, s, m in brute_failures(rows):
        by[s].append((m, i in good and i is not None, i in toxic and i is not None))
    out = set()
    for part, docs in by.items():
        table, shapley = [], Counter()
        for order in permutations("ABCDE"):
            before = 0
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                gone = [d for d in docs if d[0] & bit and not d[0] & before]
                table.append(("".join(order), step, sum(not d[0] & (before | bit) for d in docs), len(gone), sum(bool(d[0] & bit and d[0] & before) for d in docs), sum(d[0] == bit for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), name))
                shapley[name] += len(gone)
                before |= bit
        out |= {(part, *t[:-1], shapley[t[-1]]) for t in table}
    return out


WORDS = "one two three four five six seven eight nine ten "
AUDITED = [(i, t, ("p", "q", None, "")[k % 4]) for k, (i, t) in enumerate(ODD)] + [(100 + k, WORDS * (k % 9) + "X" * (k % 40) + "#" * (k % 7 == 0), "pq"[k % 2]) for k in range(120)]
AUDITED += [(300 + k, (WORDS + str(k // 2)) * 8, "r") for k in range(40)] + [(None, WORDS, "r")] * 2
LABELS = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 330, 2)] + [(2, 1, None), (None, 1, 1), (8, 0, 1), (8, 1, 0)]


@pytest.mark.parametrize("options", [{}, {"small": 0}, {"slot": 50, "hot": 10}, {"ranges": 3, "hot": 50, "slot": 4000}])
def test_audit(spark, options):
    docs = frame(spark, [(*r, 1, 2) for r in AUDITED], "doc_id long, text string, source string, good int, mask_ int")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = radixaudit.failures(docs, **{k: v for k, v in options.items() if k != "small"}).collect()
    assert Counter(map(tuple, rows)) == Counter(brute_failures(AUDITED))
    got = radixaudit.audit(docs, labels, **options).collect()
    assert len(got) == 600 * 4 and {tuple(r) for r in got} == brute_audit(AUDITED, LABELS)


def test_queries_and_their_sql(spark, tmp_path):
    frame(spark, AUDITED, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    c = duckdb.connect()
    for n in ("documents", "labels"):
        c.sql(f"create view {n} as select * from '{tmp_path}/{n}.parquet/*.parquet'")
    for query, sql in ((polyprint.op11_exact_dedup, polyprint.ORACLE), (fimscatter.op12_fill_in_middle, fimscatter.ORACLE), (radixaudit.op13_filter_audit, radixaudit.ORACLE)):
        got = query(spark, str(tmp_path))
        want = c.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall()
        assert Counter(map(tuple, got.collect())) == Counter(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abé", max_size=8), st.one_of(st.none(), st.integers(-3, 9))), max_size=30))
def test_trie(rows):
    trie = Trie()
    ends = [trie.insert(t, i) for t, i in rows]
    assert dict(trie.walk()) == dict(zip(ends, (t for t, _ in rows), strict=True))
    for (t, _), e in zip(rows, ends, strict=True):
        assert trie.smallest[e] == min((i for x, i in rows if x == t and i is not None), default=None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abc", max_size=6), st.integers(1, 9)), max_size=40), st.integers(1, 30))
def test_ranges_ascend_and_are_light(sample, share):
    bounds, weights = adaptive_ranges(sample, share, 6)
    assert bounds == sorted(set(bounds)) and len(weights) == len(bounds) + 1 and sum(weights) == sum(w for _, w in sample)
    heaviest = Counter()
    for t, w in sample:
        heaviest[t] += w
    assert all(w <= max(share, 2 * max(heaviest.values(), default=0)) + share for w in weights)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab AB#\n\x1c\xa0 ", max_size=200))
def test_masks(text):
    assert text_mask(text) == brute_mask(text)
