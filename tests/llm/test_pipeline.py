"""Each stage of the pipeline against plain Python, on its own input."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline as P
from cardloom.llm import registry, toxickn


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(7)
    d = tmp_path_factory.mktemp("tables")
    items = [(i, " ".join(f"b{r.randrange(500)}" for _ in range(20))) for i in range(5)]
    rows, labels = [], []
    for i in range(150):
        lines = [" ".join(f"w{r.randrange(800)}" for _ in range(r.randint(3, 12))) for _ in range(r.randint(1, 6))]
        bad = r.random() < 0.25
        if bad:
            lines[0] += " vilea vileb vilea"
        if i % 20 == 3:
            lines.append(items[i % 5][1])
        if i % 15 == 4:
            lines += ["same one here", "same two here", "same three here"]
        rows.append((i, "\n".join(lines), "en", "s", None))
        labels.append((i, 0, int(bad)))
        if i % 10 == 5:
            rows.append((1000 + i, "\n".join(lines) + " x", "en", "s", 3))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (None, "w1 w2", "en", "s", 5), rows[2], rows[2]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def pairs(df):
    return [(x["doc_id"], x["text"]) for x in df.collect()]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = P.toxicity(spark, docs, folder)
    assert kept.columns == P.COLUMNS
    left = dict(pairs(kept))
    toxic = {x["doc_id"] for x in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    clean = {d for d, _ in pairs(docs) if d not in toxic and (d is None or d < 1000)}
    assert len(toxic & set(left)) <= 0.1 * len(toxic) and len(clean - set(left)) <= 0.05 * len(clean)

    out = P.line_dedup(spark, docs, folder)
    distinct = list(dict.fromkeys(pairs(docs)))
    assert out.columns == P.COLUMNS and sorted(set(pairs(out)), key=str) == sorted(set(brute.deduped_lines(distinct)), key=str)
    assert out.count() == docs.count()

    out = P.near_duplicates(spark, docs, folder)
    comps = brute.components(pairs(docs), 5, 80)
    empty = {(d, t) for d, t in pairs(docs) if not brute.shingles(t, 5)}
    assert out.columns == P.COLUMNS and out.count() == len({c for _, n, c in comps if n}) + len(empty)
    assert {d for d, t in pairs(out) if brute.shingles(t, 5)} == {c for _, n, c in comps if n}

    out = P.decontamination(spark, docs, folder)
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = {d for d, _, n, _ in brute.contamination(pairs(docs), items) if n}
    assert hit and out.columns == P.COLUMNS and sorted(pairs(out), key=str) == sorted(((d, t) for d, t in pairs(docs) if d not in hit), key=str)

    out = P.packing(spark, docs, folder).collect()
    assert len({(x["doc_id"]) for x in out}) == len({d for d, _ in pairs(docs)})


def test_whole_run(spark, folder):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    got = {x["doc_id"] for x in P.run(spark, folder).collect()}
    assert got == {x["doc_id"] for x in docs.collect()}


def test_every_query_is_registered():
    names = registry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names) and toxickn.THRESHOLD == 0.3


def test_empty_corpus(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
