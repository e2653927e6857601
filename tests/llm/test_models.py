"""Trained operators: held-out accuracy and the properties that any fit must keep."""

import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from cardloom.llm import licenses, pseudolm, toxickn

DOCS = "doc_id long, text string, score_ int, y int"


def words(r, n, tag="w"):
    return [f"{tag}{r.randrange(300)}" for _ in range(n)]


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        w = words(r, r.randint(5, 60))
        bad = r.random() < 0.3
        if bad:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(["vilea", "vileb", "vilec"]))
        rows.append((i, " ".join(w).capitalize() + ".", 0, 1))
        labels.append((i, int(bad)))
    rows += [(900, None, 0, 1), (901, "", 0, 1), (902, "!?", 0, 1), (None, "vilea vileb", 0, 1), rows[0], (903, "w1 " * 5000, 0, 1)]
    labels += [(5, None), (6, labels[6][1]), (None, 1), (9999, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark, labelled):
    docs, labels = labelled
    known = labels.where(~toxickn.held_out(F.col("doc_id")))
    out = toxickn.score_toxicity(docs, known)
    assert out.columns == [*docs.columns, "toxicity_"] and out.count() == docs.count()
    got = out.join(labels.where("toxic is not null"), "doc_id").where(toxickn.held_out(F.col("doc_id"))).collect()
    right = sum((x["toxicity_"] >= 0.3) == bool(x["toxic"]) for x in got)
    assert right / len(got) > 0.9
    scores = [x["toxicity_"] for x in out.collect()]
    assert all(0 <= s <= 1 for s in scores)


def test_toxicity_without_labels(spark, labelled):
    docs, labels = labelled
    assert {x["toxicity_"] for x in toxickn.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {x["toxicity_"] for x in toxickn.score_toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxickn.score_toxicity(docs.limit(0), labels).count() == 0


def test_evidence_is_that_of_plain_kneser_ney(spark):
    r = random.Random(8)
    stems = ["ko", "lumi", "tra", "venda"]
    word = lambda y: r.choice(stems) + r.choice(["n", "ra", "sti"]) if r.random() < 0.8 else ("vile" if y else "fair") + r.choice("abcdef")
    texts = [(i % 3 == 0, " ".join(word(i % 3 == 0) for _ in range(r.randint(1, 12)))) for i in range(60)]
    pairs: dict = {}
    for y, t in texts:
        w = t.split()
        for k in {*zip(["", *w], w, strict=False)}:
            pairs.setdefault(k, [0, 0])[y] += 1
    model = toxickn.counted(spark.createDataFrame([(h, w, *n) for (h, w), n in pairs.items()], "h string, w string, n0 long, n1 long"))
    ratio = brute.toxic_ratio(pairs)
    for t in [t for _, t in texts[:20]] + ["vilex", "fairq lumira", "zzz", "vilea vileb", "kon trara é"]:
        w = t.split()
        want = [ratio(h, x) for h, x in zip(["", *w], w, strict=False)]
        x = model.evidence([t, None, ""])
        assert x[0, 0] == pytest.approx(np.mean(want)) and x[0, 1] == pytest.approx(max(want)) and x[0, 4] == pytest.approx(np.log(len(w)))
        assert not x[1:].any()
    assert ratio("", "vilex") > 1 > -1 > ratio("", "fairq")


def brute_licenses(model, text, least=0.5, share=0.6):
    at, out = 0, []
    for line in (text or "").split("\n"):
        if hit := model.name(line, least, share):
            out.append((at, at + len(line), hit[0]))
        at += len(line) + 1
    return out


def test_license_scan(spark):
    r = random.Random(2)
    rows = []
    for i in range(60):
        lines = [" ".join(words(r, r.randint(0, 15))) for _ in range(r.randint(1, 5))]
        if i % 3 == 0:
            lines.insert(r.randrange(len(lines) + 1), r.choice(licenses.NOTICES[r.choice(list(licenses.NOTICES))]))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "no license here, sorry"), (103, "MIT"), (None, "Released under the MIT License."), rows[0], rows[0], (104, "Released under the\nMIT License."), (105, "x\n" * 4000)]
    docs = spark.createDataFrame([(d, t, 0, 1) for d, t in rows], DOCS)
    model = licenses.train(docs, "doc_id", "text")
    out = licenses.scan_licenses(docs, model=model).collect()
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((x["id_"], [(s["start"], s["stop"], s["family"]) for s in x["found"]]) for x in out), key=key) == sorted(((d, brute_licenses(model, t)) for d, t in rows), key=key)
    for family, notices in licenses.NOTICES.items():
        for n in notices:
            assert brute_licenses(model, f"w1 w2\n{n}\nw3")[0][2] == family
    assert all(not brute_licenses(model, t) for d, t in rows if t and d is not None and d < 60 and d % 3)
    assert licenses.scan_licenses(docs.limit(0), model=model).count() == 0


def test_wrapped_notices_are_found(spark):
    wrapped = {
        "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
        "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License",
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met",
        "mit": "Released under the\nMIT License.",
    }
    rows = [(i, f"w1 w2\n{t}\n\nw3 w4") for i, t in enumerate(wrapped.values())] + [(9, "Released under the\n\nMIT License."), (10, "w5 w6\nw7")]
    docs = spark.createDataFrame([(d, t, 0, 1) for d, t in rows], DOCS)
    out = {x["id_"]: [(s["family"], s["start"], s["stop"]) for s in x["found"]] for x in licenses.scan_licenses(docs, wrapped=True).collect()}
    assert out == {i: [(f, 6, 6 + len(t))] for i, (f, t) in enumerate(wrapped.items())} | {9: [], 10: []}


def test_notices_hold_a_core_word():
    assert all(any(c in n.lower() for c in licenses.CORE) for ns in licenses.NOTICES.values() for n in ns)


def test_pseudo_likelihood(spark):
    r = random.Random(3)
    cycle = [f"c{i}" for i in range(12)]
    rows = [(i, " ".join(cycle[(i + k) % 12] for k in range(r.randint(20, 60)))) for i in range(600)]
    mixed = [(1000 + i, " ".join(r.choice(cycle) for _ in range(40))) for i in range(10)]
    odd = [(2000, None), (2001, ""), (2002, "..."), (None, "c1 c2 c3"), rows[0]]
    docs = spark.createDataFrame([(d, t, 0, 1) for d, t in rows + mixed + odd], DOCS).coalesce(1)
    out = pseudolm.score_documents(docs, step=64).collect()
    assert len(out) == docs.count()
    by = {x["id_"]: x for x in out}
    assert by[2000]["n_tokens"] == 0 and by[2001]["log_likelihood"] == 0 and by[2002]["n_tokens"] == 3 and by[2000]["per_token"] is None
    ordered, random_ = np.mean([by[i]["per_token"] for i in range(300)]), np.mean([by[1000 + i]["per_token"] for i in range(10)])
    assert ordered > random_ + 0.3 and ordered > -np.log(12)
    assert pseudolm.score_documents(docs.limit(0)).count() == 0


def test_pseudo_likelihood_counts_marks(spark):
    docs = spark.createDataFrame([(1, "...", 0, 1), (2, "Is it, c1?", 0, 1), (3, " \n", 0, 1)], DOCS)
    by = {x["id_"]: x for x in pseudolm.score_documents(docs).collect()}
    assert [by[i]["n_tokens"] for i in (1, 2, 3)] == [3, 5, 0]
    assert by[1]["log_likelihood"] < 0 and by[1]["per_token"] is not None and by[3]["per_token"] is None


def test_pseudo_likelihood_at_the_production_step(spark):
    r = random.Random(3)
    cycle = [f"c{i}" for i in range(12)]
    rows = [(i, " ".join(cycle[(i + k) % 12] for k in range(r.randint(20, 60)))) for i in range(300)]
    mixed = [(1000 + i, " ".join(r.choice(cycle) for _ in range(40))) for i in range(10)]
    by = {x["id_"]: x for x in pseudolm.score_documents(spark.createDataFrame([(d, t, 0, 1) for d, t in rows + mixed], DOCS)).collect()}
    ordered, random_ = np.mean([by[i]["per_token"] for i in range(300)]), np.mean([by[1000 + i]["per_token"] for i in range(10)])
    assert ordered > random_ + 0.3 and ordered > -np.log(12)


def test_words_of_a_bucket_share_it_by_their_counts(spark):
    r = random.Random(5)
    common = [f"c{i}" for i in range(pseudolm.VOCAB - pseudolm.MEMBERS)] * 12
    r.shuffle(common)
    same = [w for w in (f"r{i}" for i in range(200)) if zlib.crc32(w.encode()) % pseudolm.MEMBERS == 7][:2]
    rows = [(1, same[0]), (2, same[1]), (3, f"{same[1]} " * 7)] + [(10 + i, " ".join(common[i::40])) for i in range(40)]
    by = {x["id_"]: x["log_likelihood"] for x in pseudolm.score_documents(spark.createDataFrame([(d, t, 0, 1) for d, t in rows], DOCS)).collect()}
    assert by[2] - by[1] == pytest.approx(np.log(8), abs=1e-5)


def test_vocabulary_grows_with_the_corpus(spark):
    docs = spark.range(300).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5999)), lambda i: F.concat(F.lit("w"), i % 4000)), " ").alias("t_"))
    v = pseudolm.vocabulary(pseudolm.word_counts(docs))
    assert v.total == 1_800_000 and len(v.frequent) == 37 * 36 and sum(v.buckets.values()) == 1_800_000 - 37 * 36 * 600
    assert pseudolm.side_of(16 * v.total) == 74


def test_gradient_is_that_of_the_score():
    r = np.random.default_rng(0)
    ids = np.concatenate([[pseudolm.VOCAB] * 2, r.integers(0, pseudolm.VOCAB, 40), [pseudolm.VOCAB] * 2]).astype(np.int16)
    at = np.flatnonzero(ids < pseudolm.VOCAB)
    p = {k: v.astype(np.float64) for k, v in pseudolm.start().items()}
    loss = lambda: -pseudolm.log_likelihood(p, ids, at, 0.0).mean()
    g = pseudolm.gradient(p, ids, at)
    for k, i in (("e", (0, int(ids[5]), 3)), ("h", (2,)), ("c", (1, 4)), ("m", (int(ids[7]) // 32, 3, int(ids[7]) % 32)), ("cb", (5,))):
        was, d = p[k][i], 1e-2
        p[k][i] = was + d
        up = loss()
        p[k][i] = was - d
        down = loss()
        p[k][i] = was
        assert abs((up - down) / (2 * d) - g[k][i]) < 2e-4


def test_license_query_is_every_run_of_lines(spark):
    """The mode of the query: what the classifier names among all runs and templates confirm, with nothing lost to the words asked for first."""
    r = random.Random(5)
    filler = "the of and license work under terms free software permission here public version may use".split()
    every = [n for ns in licenses.NOTICES.values() for n in ns]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(r.randint(0, 9)):
            kind = r.random()
            if kind < 0.35:
                w = [x for x in r.choice(every).split() if r.random() > 0.12]
                cut = sorted(r.sample(range(len(w) + 1), min(len(w), r.randint(0, 3))))
                lines += [" ".join(w[a:b]) for a, b in zip([0, *cut], [*cut, len(w)], strict=True)]
            elif kind < 0.5:
                lines.append("")
            else:
                lines.append(" ".join(r.choice(filler) for _ in range(r.randint(1, 12))))
        texts.append("\n".join(lines))
    texts += [every[0] + "\n" + every[0], every[1].replace(" ", "\n"), "x\n" * 30 + every[9] + "\ny" * 30, None, "", "\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = licenses.train(docs, "doc_id", "text")
    got = {x["id_"]: [(s["family"], s["start"], s["stop"]) for s in x["found"]] for x in licenses.scan_licenses(docs, model=model, wrapped=True).collect()}
    want = {i: brute.notices(model, t) for i, t in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) > 30


def test_license_scan_of_a_very_long_text(spark):
    text = "license work\n" * 20_000 + "Released under the MIT License.\n" + "x " * 200_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = licenses.scan_licenses(docs, wrapped=True).first()["found"]
    assert [text[s["start"] : s["stop"]] for s in found if s["family"] == "mit"] == ["Released under the MIT License."]


def plain_score(p, v, counts, text):
    """A document's score, word by word, from a model's parameters and the table of counts."""
    side = len(p["cb"])
    ids = [v[w] for w in pseudolm.words(text)]
    around = [side * side] * pseudolm.SIDE
    padded, total = around + ids + around, 0.0
    for i, (w, y) in enumerate(zip(pseudolm.words(text), ids, strict=True)):
        at = i + pseudolm.SIDE
        h = np.tanh(p["h"] + sum(p["e"][k][padded[at + o]] for k, o in enumerate((-2, -1, 1, 2))))
        c = h @ p["c"] + p["cb"]
        m = h @ p["m"][y // side] + p["mb"][y // side]
        share = np.log(counts[w] / sum(n for x, n in counts.items() if v[x] == y)) if y < side else 0.0
        total += c[y // side] - np.log(np.exp(c).sum()) + m[y % side] - np.log(np.exp(m).sum()) + share
    return total


def test_pseudo_likelihood_is_the_sum_over_words(spark, monkeypatch):
    r = random.Random(9)
    frequent, rare = [f"f{i}" for i in range(1100)], [f"r{i}" for i in range(400)]
    texts = [" ".join(r.choice(rare) if r.random() < 0.1 else r.choice(frequent[: 20 if r.random() < 0.5 else 1100]) for _ in range(r.randint(1, 60))) + r.choice(["", ".", " ?!"]) for _ in range(250)] + [None, "", "r1", "f1 " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    seen, real = {}, pseudolm.train

    def kept(coded, held, step=None):
        seen["v"], seen["p"] = held.value, real(coded, held, step)
        return seen["p"]

    monkeypatch.setattr(pseudolm, "train", kept)
    got = {x["id_"]: x["log_likelihood"] for x in pseudolm.score_documents(docs).collect()}
    counts = Counter(w for t in texts for w in pseudolm.words(t))
    p = {k: x.astype(float) for k, x in seen["p"].items()}
    for i, t in enumerate(texts):
        want = plain_score(p, seen["v"], counts, t)
        assert got[i] == pytest.approx(want, rel=2e-4, abs=2e-3), i
    assert any(seen["v"][w] < seen["v"].side for w in counts)


def test_steps_grow_alike_at_every_size():
    sizes = [pseudolm.step_size(k) for k in range(1000)]
    assert sizes[0] == 64 and sizes[64] == 128 and sizes[-1] == pseudolm.STEP and sizes == sorted(sizes)


def test_words_are_what_the_pattern_finds():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(every), 60):
        t = " ".join(f"a{c}b{c}{c} {c}" for c in every[lo : lo + 60])
        assert pseudolm.words(t) == pseudolm.WORD.findall(t.lower()), lo
    many = "".join(every[0x2190:0x2400]) + "x"
    assert pseudolm.words(many) == pseudolm.WORD.findall(many.lower()) and len(pseudolm.words(many)) > pseudolm.FEW_MARKS
    assert pseudolm.words(None) == pseudolm.words(" \n\x1c\x85") == []


def test_runs_hold_every_text_once(spark, monkeypatch):
    """Texts are split once: counts and ids both come from the runs, which end after RUN texts or RUN_WORDS words."""
    r = random.Random(4)
    texts = [" ".join(r.choice("ab") + str(r.randrange(40)) for _ in range(r.randrange(30))) + r.choice(["", "!", " é—"]) for _ in range(1200)] + [None, "", "long " * 1_100_000, " ".join(f"u{i}" for i in range(70_000)), "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i_ long, t_ string").coalesce(1)
    got, sizes, numbers = {}, [], set()
    for x in pseudolm.split(docs).collect():
        w, ids, at = x["w"], np.frombuffer(x["ids"], np.uint16 if len(x["w"]) <= 1 << 16 else np.uint32), 0
        assert list(np.bincount(ids, minlength=len(w))) == x["n"] and len(set(w)) == len(w)
        sizes.append(len(x["i_"]))
        for k, (i, n) in enumerate(zip(x["i_"], x["size"], strict=True)):
            got[i], at = [w[j] for j in ids[at : at + n]], at + n
            numbers.add(x["r_"] + k)
    assert got == {i: pseudolm.words(t) for i, t in enumerate(texts)} and len(numbers) == len(texts)
    assert sizes == [500, 500, 203, 2]


@pytest.mark.parametrize("wide", [1, 400])
def test_scores_out_of_range_are_shifted(wide):
    """Exponentials are taken without a shift where their sums allow it; with weights too large for that, scores and slopes stay what doubles give."""
    r = np.random.default_rng(2)
    ids = np.concatenate([[pseudolm.VOCAB] * 2, r.integers(0, pseudolm.VOCAB, 1500), [pseudolm.VOCAB] * 2]).astype(np.uint16)
    at = np.flatnonzero(ids < pseudolm.VOCAB)
    p = {k: x * np.float32(wide if k in ("c", "m") else 5) for k, x in pseudolm.start().items()}
    double = {k: x.astype(float) for k, x in p.items()}
    want, got = pseudolm.log_likelihood(double, ids, at, 0.0), pseudolm.log_likelihood(p, ids, at, 0.0)
    assert np.isfinite(got).all() and np.abs(got - want).max() < 1e-5 * max(10, np.abs(want).max())
    g, d = pseudolm.gradient(p, ids, at), pseudolm.gradient(double, ids, at)
    assert all(np.abs(g[k] - d[k]).max() < 1e-4 * max(1e-2, np.abs(d[k]).max()) for k in g)
    _, y, _, h = pseudolm.hidden(p, ids, at)
    seen = [z.max() for _, _, both in pseudolm.pieces(p, y, h, False) for z, _ in both]
    assert len(seen) == 2 * 3 and (max(seen) > 88) == (wide == 400)
