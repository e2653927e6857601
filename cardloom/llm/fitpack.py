"""Best-fit packing by exact complements.

Every document is a run of token ids with an end id; only runs longer than a sequence are cut, the first piece taking the
remainder. Pieces go to the plan as counts per length, a table of at most `size` rows whatever the corpus. The plan takes
lengths from the longest down and closes each gap exactly with one, two or three available lengths, found in an index of
single lengths, pair sums and, through these, triple sums; where none fits exactly the longest length that fits is added and
the search goes on. A pattern is used as often as its counts allow, so the plan is a table of patterns, not of documents.

Spark then deals the pieces to the plan's places: ranks within a length come from row numbers inside small cells (length,
bucket) plus the cells' offsets, with buckets in proportion to the length's count, so that a length that a third of all
documents share is spread over many tasks. The cells' counts are at most `size` + `CELLS` rows.

Null text is an empty document: its end id alone. Null and repeated ids are packed like any others; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import keep, table, text_key
from .chunkcodec import codec

#: Cells that lengths are split into, besides one for each length.
CELLS = 4096


def pieces_of(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, size: int, end_id: int, with_ids: bool, added: bool = False) -> DataFrame:
    """A row per piece: id_, key_, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = codec(tokenizer, True, added), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for i, k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids_of.encode(batch.column(2).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    m = (n % size or size) if at == 0 and n > size else min(size, n - at)
                    part = ids[4 * at : 4 * (at + m)]
                    for c, v in zip(cols, (i, k, piece, at, m, zlib.crc32(part), part if with_ids else None), strict=True):
                        c.append(v)
                    at, piece = at + m, piece + 1
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id_", "key_", "piece", "start", "length", "ids_crc32", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id_"), text_key(F.col(text_col)).alias("key_"), F.col(text_col).cast("string").alias("t_"))
    out = rows.mapInArrow(cut, "id_ long, key_ long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


class Complements:
    """Sums of the lengths that a plan starts with, hashed: for each sum the shorter part of every pair; a single is its own sum, and a
    triple is a length and a pair of no longer ones. What is left of each length decides whether an entry can still be used."""

    def __init__(self, counts: np.ndarray):
        self.have = np.flatnonzero(counts)
        held = counts > 0
        self.pairs: dict[int, np.ndarray] = {}
        for total in range(2, len(counts)):
            x = self.have[: np.searchsorted(self.have, total // 2, side="right")]
            if len(x := x[held[total - x]]):
                self.pairs[total] = x

    def pair(self, left: np.ndarray, total: int, most: int) -> tuple[int, ...] | None:
        """The most plentiful pair with that sum, none longer than `most`."""
        if (x := self.pairs.get(total)) is None:
            return None
        y = total - x
        n = np.where(x == y, left[x] // 2, np.minimum(left[x], left[y]))
        n[y > most] = 0
        k = int(n.argmax())
        return (int(y[k]), int(x[k])) if n[k] > 0 else None

    def fill(self, left: np.ndarray, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to gap."""
        if left[gap]:
            return (gap,)
        if found := self.pair(left, gap, gap):
            return found
        for x in self.have[: np.searchsorted(self.have, gap)][::-1]:
            if 3 * x < gap:  # the longest of three
                break
            if left[x]:
                left[x] -= 1
                found = self.pair(left, gap - int(x), int(x))
                left[x] += 1
                if found:
                    return (int(x), *found)
        return None


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; every counted piece has exactly one place."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    index, out = Complements(left), []
    for top in range(size, 0, -1):
        while left[top]:
            used, now = [top], left.copy()
            now[top] -= 1
            gap = size - top
            while gap:
                if fill := index.fill(now, gap):
                    used += fill
                    break
                fits = np.flatnonzero(now[: gap + 1])
                if not len(fits):
                    break
                used.append(int(fits[-1]))
                now[fits[-1]] -= 1
                gap -= int(fits[-1])
            need = Counter(used)
            times = int(min(left[v] // n for v, n in need.items()))
            for v, n in need.items():
                left[v] -= n * times
            out.append((tuple(used), times))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks with the first sequence and the offset: sorted by (length, first rank)."""
    rows, given, seq = [], Counter(), 0
    for used, times in patterns:
        at = 0
        for v in used:
            rows.append((v, given[v], seq, at))
            given[v] += times
            at += v
        seq += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 48) + a[:, 1], "rank": a[:, 1], "seq": a[:, 2], "offset": a[:, 3]}


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0, with_ids: bool = False, added: bool = False) -> DataFrame:
    """One row per piece: id_, key_, piece, start, length, ids_crc32, (ids,) sequence_id, offset. `added` as in chunkcodec."""
    p = keep(pieces_of(docs, tokenizer, id_col, text_col, size, end_id, with_ids, added), "pieces")
    counts = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    per_cell = max(64, sum(counts.values()) // CELLS)
    cells = np.ones(size + 1, np.int64)
    for v, n in counts.items():
        cells[v] = -(-n // per_cell)
    by_length = F.array(*(F.lit(int(c)) for c in cells))
    dealt = p.withColumn("cell_", F.pmod(F.xxhash64("id_", "key_", "piece"), F.get(by_length, F.col("length").cast("int"))).cast("int"))
    sizes = sorted((r["length"], r["cell_"], r["n"]) for r in dealt.groupBy("length", "cell_").agg(F.count("*").alias("n")).collect())  # at most size + CELLS
    first, before, last = {}, 0, None
    for length, cell, n in sizes:
        before = 0 if length != last else before
        first[(length << 32) + cell], before, last = before, before + n, length
    cell_key, cell_first = np.array(sorted(first), np.int64), np.array([first[k] for k in sorted(first)], np.int64)
    to = places(plan(counts, size))
    kept = [c for c in p.columns]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, cell, row = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "cell_", "row_"))
            rank = cell_first[np.searchsorted(cell_key, (length << 32) + cell)] + row - 1
            j = np.searchsorted(to["key"], (length << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(to["seq"][j] + rank - to["rank"][j]), pa.array(to["offset"][j])], names=[*kept, "sequence_id", "offset"]
            )

    order = Window.partitionBy("length", "cell_").orderBy("id_", "key_", "piece")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema) + ", sequence_id long, offset long"
    return dealt.withColumn("row_", F.row_number().over(order)).mapInArrow(seat, schema)


def op5_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), tokenizer or public("byte_bpe_50k.json"), added=True)
    return out.select(F.col("id_").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
