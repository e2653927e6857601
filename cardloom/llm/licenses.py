"""License scans: a trained paragraph classifier confirmed by template comparison.

Texts are cut into paragraphs (lines). A multinomial logistic regression over hashed word 1- to 3-grams names the license
family of a paragraph or none. It is trained here: on notices of each family, worn down by dropped and swapped words and
foreign words around them, and, for the unknown class, on paragraphs of the corpus (a bounded sample that holds no license
word) and on parts of them mixed with license words. A temperature, fitted on held-back variants, calibrates its
probabilities; under `least` a paragraph stays unknown. A prediction counts only if the paragraph also holds most of the
word pairs of one of the family's notices (`share`), which names the matching template.

Notices wrapped over several lines are found too (`wrapped`): the classifier scores every run of up to RUN lines without a blank one
between them, and every whole block between blank lines; what it names and a template confirms is taken, shortest runs first, and
grows by the lines next to it that hold more of the notice.

Scoring is one pass over all documents without a shuffle. To hold `share` of a notice's pairs, a paragraph must hold at least one of
any set of pairs that is larger than what may be missing; texts, and runs of lines, without a word of such a set can't be confirmed
and are passed over by a substring test.

Null and empty texts have no paragraphs; repeated rows give a row each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import table, text_key

#: Short public notices by family, as they stand in texts.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 3.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}
FAMILIES = [*NOTICES, "unknown"]
#: Every notice holds one of these, in any case.
CORE = ("licen", "permission", "redistribut")
WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")
SIZE = 1 << 14
#: Lines of a sliding run.
RUN = 12


def words(s: str) -> list[str]:
    return WORD.findall(s.lower())


def grams(w: list[str]) -> list[int]:
    return sorted({zlib.crc32(" ".join(w[i : i + n]).encode()) % SIZE for n in (1, 2, 3) for i in range(len(w) - n + 1)})


def pairs(w: list[str]) -> set[tuple[str, ...]]:
    return set(zip(w, w[1:], strict=False)) or {tuple(w)}


TEMPLATES = [(f, k, pairs(words(t))) for f, ts in NOTICES.items() for k, t in enumerate(ts)]


def anchors(share: float) -> list[set[str]]:
    """For each template words of which a text must hold one to hold `share` of its pairs."""
    out = []
    for _, _, t in TEMPLATES:
        most = sorted(t, key=lambda q: (-max(map(len, q)), q))
        spare = sum(1 for n in range(len(t)) if n / len(t) >= share)  # so many pairs may be missing
        out.append({max(q, key=len) for q in most[: spare + 1]})
    return out


def runs(split: list[list[str]], hot: list[int], most: int = RUN) -> set[tuple[int, int]]:
    """The runs of lines (first, last) to be scored, by their words: those of up to `most` lines, and whole blocks, that hold a hot line."""
    out = set()
    for k in hot:
        if split[k]:
            first = last = k
            while first and split[first - 1]:
                first -= 1
            while last + 1 < len(split) and split[last + 1]:
                last += 1
            out |= {(a, b) for a in range(max(first, k - most + 1), k + 1) for b in range(k, min(last, a + most - 1) + 1)} | {(first, last)}
    return out


class Passage:
    """Hashed n-grams of a text's words, of which any run of lines takes a part."""

    def __init__(self, split: list[list[str]]):
        self.words = [x for w in split for x in w]
        self.at = np.cumsum([0, *map(len, split)]).tolist()
        hashed = lambda n: np.array([zlib.crc32(" ".join(self.words[i : i + n]).encode()) % SIZE for i in range(len(self.words) - n + 1)], np.int64)
        self.codes = [hashed(n) for n in (1, 2, 3)]

    def grams(self, a: int, b: int) -> tuple[list[str], np.ndarray]:
        """Words and distinct n-grams of the lines a to b."""
        lo, hi = self.at[a], self.at[b + 1]
        return self.words[lo:hi], np.unique(np.concatenate([c[lo : max(lo, hi - k)] for k, c in enumerate(self.codes)]))


class Classifier:
    """Sparse multinomial logistic regression with a temperature."""

    def __init__(self, foreign: list[str], seed: int = 7, variants: int = 60, epochs: int = 12):
        r = random.Random(seed)
        filler = [w for p in foreign for w in words(p)][:20_000] or ["lorem", "ipsum", "dolor"]
        some = lambda lo, hi: [r.choice(filler) for _ in range(r.randint(lo, hi))]
        rows: list[tuple[list[int], int]] = []
        for y, family in enumerate(NOTICES):
            for notice in NOTICES[family]:
                for _ in range(variants):
                    w = [x for x in words(notice) if r.random() > 0.07]
                    if len(w) > 2 and r.random() < 0.3:
                        i = r.randrange(len(w) - 1)
                        w[i], w[i + 1] = w[i + 1], w[i]
                    rows.append((grams(some(0, 12) + w + some(0, 12)), y))
        bait = [x for ts in NOTICES.values() for t in ts for x in words(t)]
        unknown = len(FAMILIES) - 1
        for p in foreign:
            w = words(p)
            rows.append((grams(w), unknown))
            w = w[:30]
            for _ in range(r.randint(0, 4)):
                w.insert(r.randint(0, len(w)), r.choice(bait))
            rows.append((grams(w), unknown))
        r.shuffle(rows)
        held, rows = rows[::5], [x for i, x in enumerate(rows) if i % 5]
        self.w, self.b, self.heat = np.zeros((SIZE, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32), 1.0
        for epoch in range(epochs):
            r.shuffle(rows)
            step = 0.5 / (1 + epoch)
            for x, y in rows:
                p = self.probabilities(x)
                p[y] -= 1
                self.w[x] -= step * p / max(1, len(x)) ** 0.5
                self.b -= 0.1 * step * p
        logits = np.array([self.logits(x) for x, _ in held])
        ys = np.array([y for _, y in held], int)

        def loss(heat: float) -> float:
            z = logits / heat
            z = z - z.max(1, keepdims=True)
            return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(ys)), ys]).mean())

        if len(held):
            self.heat = min((0.25 * 1.15**k for k in range(25)), key=loss)

    def logits(self, x: list[int]) -> np.ndarray:
        return self.w[x].sum(0) / max(1, len(x)) ** 0.5 + self.b

    def probabilities(self, x: list[int]) -> np.ndarray:
        z = self.logits(x) / self.heat
        z = np.exp(z - z.max())
        return z / z.sum()

    def name(self, paragraph: str, least: float, share: float) -> tuple[str, int, float] | None:
        """Family, template and probability of a paragraph that is confirmed."""
        w = words(paragraph)
        return self.name_words(w, grams(w), least, share)

    def name_words(self, w: list[str], x: list[int] | np.ndarray, least: float, share: float) -> tuple[str, int, float] | None:
        p = self.probabilities(x)
        y = int(p.argmax())
        if y == len(FAMILIES) - 1 or p[y] < least:
            return None
        have = pairs(w)
        match, template = max((len(t & have) / len(t), -k) for f, k, t in TEMPLATES if f == FAMILIES[y])
        return (FAMILIES[y], -template, float(p[y])) if match >= share else None


def train(docs: DataFrame, id_col: str, text_col: str, sample: int = 400, paragraphs: int = 1000) -> Classifier:
    """On the notices and on at most `paragraphs` paragraphs without a license word of at most `sample` documents, least hashes first."""
    keyed = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), text_key(F.col(text_col)).alias("k"), F.col(text_col).alias("t"))
    chosen = [tuple(r) for r in keyed.select("h", "k").orderBy("h", "k").limit(sample).collect()]  # at most `sample` pairs of hashes
    some = keyed.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "h long, k long").distinct()), ["h", "k"])
    p = some.select(F.explode(F.split("t", "\n")).alias("p")).where(F.trim("p") != "").distinct()
    p = p.where(~F.lower("p").rlike("|".join(CORE))).orderBy(F.xxhash64("p")).limit(paragraphs)
    return Classifier(sorted(r["p"] for r in p.collect()))


def find(m: Classifier, lines: list[str], least: float, share: float, wrapped: bool, needed: set[str] | None = None) -> list[tuple[int, int, tuple[str, int, float]]]:
    """First and last line and name of each notice; with `needed`, runs that hold none of these words are passed over."""
    split = [words(x) for x in lines]
    if not wrapped:
        return [(k, k, hit) for k, w in enumerate(split) if w and (hit := m.name(lines[k], least, share))]
    hot = [k for k, x in enumerate(lines) if needed is None or any(w in low for low in (x.lower(),) for w in needed)]
    passage, found, free = Passage(split), [], [True] * len(lines)
    for a, b in sorted(runs(split, hot), key=lambda x: (x[1] - x[0], x)):
        if all(free[a : b + 1]) and (hit := m.name_words(*passage.grams(a, b), least, share)):
            t = next(t for f, k, t in TEMPLATES if (f, k) == hit[:2])
            held = lambda a, b: len(t & pairs([x for w in split[a : b + 1] for x in w]))  # noqa: B023, E731
            while b + 1 < len(lines) and split[b + 1] and free[b + 1] and held(a, b + 1) > held(a, b):
                b += 1
            while a and split[a - 1] and free[a - 1] and held(a - 1, b) > held(a, b):
                a -= 1
            free[a : b + 1] = [False] * (b + 1 - a)
            found.append((a, b, hit))
    return sorted(found)


SCHEMA = "id_ long, n_paragraphs long, found array<struct<start:int,stop:int,family:string,template:int,probability:double>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, share: float = 0.6, model: Classifier | None = None, wrapped: bool = False) -> DataFrame:
    """One row per row of docs: id_, n_paragraphs (lines that aren't blank), found (spans of confirmed lines or, if `wrapped`, runs of lines)."""
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, some = held.value, anchors(share)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("family", pa.string()), ("template", pa.int32()), ("probability", pa.float64())]))
        for batch in batches:
            counts, found = [], []
            for t in batch.column(1).to_pylist():
                lines = (t or "").split("\n")
                counts.append(sum(1 for x in lines if x and not x.isspace()))
                spans, low = [], (t or "").lower()
                if needed := {w for ws in some for w in ws if w in low}:
                    at = [0]
                    for x in lines:
                        at.append(at[-1] + len(x) + 1)
                    for a, b, hit in find(m, lines, least, share, wrapped, needed):
                        spans.append({"start": at[a], "stop": at[b + 1] - 1, "family": hit[0], "template": hit[1], "probability": hit[2]})
                found.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["id_", "n_paragraphs", "found"])

    return docs.select(F.col(id_col).cast("long").alias("i_"), F.col(text_col).cast("string").alias("t_")).mapInArrow(run, SCHEMA)


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"), wrapped=True)
    families = F.array_sort(F.array_distinct(F.transform("found", lambda s: s["family"])))
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["family"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return out.select(F.col("id_").alias("doc_id"), "n_paragraphs", F.size("found").cast("long").alias("n_notices"), F.array_join(families, ",").alias("families"), spans.alias("spans"))
