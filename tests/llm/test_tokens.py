"""Packing and compressed ids against the tokenizers library itself."""

import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cardloom.llm import fitpack, repair
from cardloom.llm.chunkcodec import codec

Tokenizer = pytest.importorskip("tokenizers").Tokenizer
ODD = [
    None, "", " ", "\n", "a  b", " lead", "trail ", "tab\tand nbsp", "it's we'll\n\nDon't", "x\n y \n z", "é ́a", "<|endoftext|> <|endoftext|>", "\x1c a\x1cb \x85 c",
    "Σίσυφος ΣΊΣΥΦΟΣ İstanbul ǅ", "日本語 テキスト", "a" * 5000, "word " * 4000, "1234 5 6,7 ... !!! ???", "　wide　space", "ﬁ ① ½", "😀 👩‍👩‍👧 ok",
]


@lru_cache
def whole(name):
    t = Tokenizer.from_file(fitpack.public(name))
    t.encode_special_tokens = True
    return t


def raw(name, texts):
    t = whole(name)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_give_the_librarys_ids(name, spaced):
    got = [np.frombuffer(b, "<u4").tolist() for b in codec(fitpack.public(name), spaced).encode(ODD)]
    assert got == raw(name, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab C'sé\n\t  \x1c1.,́ΣI", max_size=40), max_size=5))
def test_pieces_on_random_texts(texts):
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        assert [np.frombuffer(b, "<u4").tolist() for b in codec(fitpack.public(name), spaced).encode(texts)] == raw(name, texts)


def test_queries_give_the_untouched_librarys_ids(spark, tmp_path):
    texts = ["plain words", "a <|endoftext|> b", "x<|endoftext|>\ny", "<|startoftext|>É <|ENDOFTEXT|>", None, "", *ODD[10:13]]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        lib = Tokenizer.from_file(fitpack.public(name))
        got = [np.frombuffer(b, "<u4").tolist() for b in codec(fitpack.public(name), spaced, True).encode(texts)]
        assert got == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    crc = lambda name, end: {i: zlib.crc32(np.array([*Tokenizer.from_file(fitpack.public(name)).encode(t or "", add_special_tokens=False).ids, end], "<u4").tobytes()) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["ids_crc32"] for r in fitpack.op5_packing(spark, str(tmp_path)).collect()} == crc("byte_bpe_50k.json", 0)
    assert {r["doc_id"]: r["ids_crc32"] for r in repair.op10_repair_ids(spark, str(tmp_path)).collect()} == crc("word_bpe_49k.json", 1)


def frame(spark, texts):
    rows = [(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[8], (8, "other text of the same id", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, row_ int")


def test_packing(spark):
    docs = frame(spark, ODD)
    size = 256
    out = fitpack.pack(docs, fitpack.public("byte_bpe_50k.json"), size=size, with_ids=True).collect()
    texts = [r["text"] for r in docs.collect()]
    want = Counter(np.array([*x, 0], "<u4").tobytes() for x in raw("byte_bpe_50k.json", texts))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["id_"], r["key_"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for rows in by_doc.values():
        copies = Counter(r["piece"] for r in rows)
        assert len(set(copies.values())) == 1
        one = {r["piece"]: r for r in rows}
        whole = b"".join(bytes(one[p]["ids"]) for p in sorted(one))
        want[whole] -= copies[0]
        assert [one[p]["start"] for p in sorted(one)] == np.cumsum([0, *(one[p]["length"] for p in sorted(one))])[:-1].tolist()
        assert all(one[p]["length"] == size for p in list(sorted(one))[1:])
    assert not +want and not -want
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert len(by_seq) <= -(-sum(r["length"] for r in out) // size) + 2


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=12))
def test_plan_places_every_length_once(counts):
    used = Counter()
    for lengths, times in fitpack.plan(counts, 64):
        assert sum(lengths) <= 64 and times > 0
        for v in lengths:
            used[v] += times
    assert used == Counter(counts)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=7), st.integers(1, 40))
def test_complements_find_a_filling_wherever_there_is_one(counts, gap):
    left = np.zeros(41, np.int64)
    for v, n in counts.items():
        left[v] = n
    every = [v for v, n in counts.items() for _ in range(n)]
    there = any(sum(c) == gap for k in (1, 2, 3) for c in combinations(every, k))
    found, before = fitpack.Complements(left).fill(left, gap), left.copy()
    assert (found is not None) == there and (left == before).all()
    if found:
        assert sum(found) == gap and not Counter(found) - Counter(every)


def test_plan_fills_exact_triples():
    assert len(fitpack.plan({30: 4, 20: 4, 14: 4}, 64)) == 1


def test_empty_tables(spark):
    docs = frame(spark, ODD).limit(0)
    assert fitpack.pack(docs, fitpack.public("byte_bpe_50k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=300))
def test_repair_round_trip(ids):
    x = np.array([*ids, 1], np.uint32)
    symbols, rules = repair.compress(x, 100, 1, rounds=4, per_round=3, least=2)
    assert repair.expand(symbols, rules, 100).tolist() == x.tolist()
    assert not (rules[:, 0] == 1).any()
    spans = repair.spans_of(rules, 100)
    for k, r in enumerate(rules):
        assert spans[k] == len(repair.expand(np.array([100 + k], np.uint16), rules, 100))
    if len(ids) > 50:
        assert len(symbols) < len(x)
    done, _ = repair.compress(x, 100, 1, per_round=3, least=2)
    pairs = Counter((a, b) for a, b in zip(done[:-1].tolist(), done[1:].tolist(), strict=True) if a != 1)
    runs = {p for p in pairs if p[0] == p[1]}  # a run of one symbol holds overlapping pairs
    assert all(n < 3 or p in runs for p, n in pairs.items())
    at = len(x) // 3
    assert repair.span_of(symbols, rules, spans, 100, at, 7).tolist() == x[at : at + 7].tolist()


def test_compressed_ids(spark, tmp_path):
    docs = frame(spark, ODD)
    path = str(tmp_path / "ids")
    repair.write_ids(docs, path, fitpack.public("word_bpe_49k.json"), block_tokens=700)
    out = sorted(repair.read_ids(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], set()).add(tuple([*raw("word_bpe_49k.json", [r["text"]])[0], 1]))
    ids = [r["id_"] for r in out]
    assert len(out) == docs.count() and ids[0] is None and ids[1:] == sorted(ids[1:])
    at = 0
    for r in out:
        own = np.frombuffer(r["ids"], "<u4")
        assert r["start"] == at and r["n_tokens"] == len(own) and zlib.crc32(own.tobytes()) == r["ids_crc32"] and tuple(own.tolist()) in texts[r["id_"]]
        at += len(own)
    stored = {}
    for r in out:
        stored.setdefault(r["id_"], []).append(np.frombuffer(r["ids"], "<u4").tolist())
    for start, length in ((0, 1 << 40), (3, 5), (700, 300), (10**6, 2)):
        some = {}
        for r in repair.read_span(spark, path, [2, 8, 15, 16, 99], start, length).collect():
            some.setdefault(r["id_"], []).append(np.frombuffer(r["ids"], "<u4").tolist())
        assert {i: sorted(x) for i, x in some.items()} == {i: sorted(x[start : start + length] for x in stored[i]) for i in (2, 8, 15, 16)}
    empty = str(tmp_path / "none")
    repair.write_ids(docs.limit(0), empty, fitpack.public("word_bpe_49k.json"))
    assert repair.read_ids(spark, empty).count() == 0
