"""Token ids in Re-Pair compressed shards, written to and read from the shared folder.

Documents are dealt by range of id and sorted, so shard after shard holds them in ascending order. A task encodes its
documents and closes a block whenever it holds `block_tokens` ids. In each block the frequent pairs of ids are replaced by
new symbols, the most frequent first, round after round, many pairs in a round, until no pair stands `least` times or all
16-bit symbols are taken; no pair begins with the end id, so every document begins at a symbol.

File format: Parquet, one row per block - shard, block, n_tokens; per document doc_ids, keys, first symbol (`sym_at`) and
first id within the block (`tok_at`); `rules` (pairs of unsigned 16-bit symbols, the k-th defines symbol first_rule + k),
`spans` (ids that each rule expands to, unsigned 32-bit) and `symbols` (unsigned 16-bit), all little-endian. `read_span`
decodes a part of a document from its own symbols alone: `spans` tells where its ids lie without expanding what stands before.
Blocks are written by Spark's committer, so a lost executor leaves no partial file behind.

Null text is empty (its end id alone); null ids come first; repeated rows are written one after another; an empty table
gives no blocks; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import new_path, table, text_key
from .chunkcodec import codec
from .fitpack import public

BLOCK = "shard int, block int, n_tokens long, first_rule int, doc_ids array<long>, keys array<long>, sym_at array<int>, tok_at array<int>, rules binary, spans binary, symbols binary"


def compress(ids: np.ndarray, first_rule: int, end_id: int, rounds: int | None = None, per_round: int = 4096, least: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (uint16) and rules (k x 2, uint16) of one block."""
    x, rules = ids.astype(np.uint16), np.zeros((0, 2), np.uint16)
    room = 65_536 - first_rule
    for _ in count() if rounds is None else range(rounds):
        take = min(per_round, room - len(rules))
        if len(x) < 2 or take <= 0:
            break
        code = (x[:-1].astype(np.uint32) << 16) | x[1:]
        open_ = x[:-1] != end_id
        seen, n = np.unique(code[open_], return_counts=True)
        often = np.flatnonzero(n >= least)
        if not len(often):
            break
        pick = seen[often[np.argsort(-n[often], kind="stable")[:take]]]
        slot = lambda c: (c * np.uint32(2654435761)) >> np.uint32(13)
        held = np.full(1 << 19, -1, np.int32)
        held[slot(pick)[::-1]] = np.arange(len(pick), dtype=np.int32)[::-1]  # of pairs with one slot the most frequent stays
        at = held[slot(code)]
        hit = np.flatnonzero((at >= 0) & open_ & (pick[at] == code))
        starts = np.flatnonzero(np.diff(hit, prepend=-2) != 1)  # runs of overlapping pairs: every other one, from the left
        run = np.repeat(hit[starts], np.diff(starts, append=len(hit)))
        hit = hit[(hit - run) % 2 == 0]
        used, which = np.unique(at[hit], return_inverse=True)
        x = x.copy()
        x[hit] = (first_rule + len(rules) + which).astype(np.uint16)
        rest = np.ones(len(x), bool)
        rest[hit + 1] = False
        x = x[rest]
        rules = np.concatenate([rules, np.stack([pick[used] >> 16, pick[used] & 0xFFFF], 1).astype(np.uint16)])
    return x, rules


def spans_of(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids that each rule expands to; a rule only uses earlier ones."""
    n: list[int] = []
    for a, b in rules.tolist():
        n.append((n[a - first_rule] if a >= first_rule else 1) + (n[b - first_rule] if b >= first_rule else 1))
    return np.array(n, np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    x = symbols
    while len(x) and (deep := x >= first_rule).any():
        at = np.cumsum(1 + deep) - (1 + deep)
        out = np.empty(len(x) + int(deep.sum()), np.uint16)
        out[at[~deep]] = x[~deep]
        r = rules[x[deep].astype(np.int64) - first_rule]
        out[at[deep]], out[at[deep] + 1] = r[:, 0], r[:, 1]
        x = out
    return x


def write_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, vocab: int = 49_408, block_tokens: int = 1_000_000, added: bool = False) -> None:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, shard = codec(tokenizer, False, added), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        ids: list[int] = []
        keys: list[int] = []
        parts: list[bytes] = []
        held = block = 0

        def close() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(parts), "<u4")
            tok_at = np.cumsum([0, *(len(p) // 4 for p in parts)])[:-1]
            symbols, rules = compress(x, vocab, end_id)
            spans = spans_of(rules, vocab)
            width = np.where(symbols >= vocab, spans[np.maximum(symbols.astype(np.int64) - vocab, 0)] if len(spans) else 1, 1)
            sym_at = np.searchsorted(np.cumsum(width) - width, tok_at)
            row = {
                "shard": shard, "block": block, "n_tokens": len(x), "first_rule": vocab, "doc_ids": ids, "keys": keys, "sym_at": sym_at.tolist(), "tok_at": tok_at.tolist(),
                "rules": rules.astype("<u2").tobytes(), "spans": spans.astype("<u4").tobytes(), "symbols": symbols.astype("<u2").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            for i, k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids_of.encode(batch.column(2).to_pylist()), strict=True):
                ids.append(i)
                keys.append(k)
                parts.append(b + end)
                held += len(b) // 4 + 1
                if held >= block_tokens:
                    yield close()
                    ids, keys, parts, held, block = [], [], [], 0, block + 1
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("i_"), text_key(F.col(text_col)).alias("k_"), F.col(text_col).cast("string").alias("t_"))
    rows.repartitionByRange("i_", "k_").sortWithinPartitions("i_", "k_").mapInArrow(encode, BLOCK).write.parquet(path)


ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("first_rule", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))]
    + [("sym_at", pa.list_(pa.int32())), ("tok_at", pa.list_(pa.int32())), ("rules", pa.binary()), ("spans", pa.binary()), ("symbols", pa.binary())]
)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: id_, key_, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    blocks = spark.read.schema(BLOCK).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                symbols, rules = np.frombuffer(r["symbols"], "<u2"), np.frombuffer(r["rules"], "<u2").reshape(-1, 2)
                raw = expand(symbols, rules, r["first_rule"]).astype("<u4").tobytes()
                tok = [*r["tok_at"], r["n_tokens"]]
                own = [raw[4 * a : 4 * b] for a, b in zip(tok, tok[1:])]
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["shard"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["keys"], pa.int64()),
                        pa.array(r["tok_at"], pa.int64()), pa.array([len(o) // 4 for o in own], pa.int64()), pa.array([zlib.crc32(o) for o in own], pa.int64()),
                        pa.array(own if with_ids else [None] * n, pa.binary()),
                    ],
                    names=["shard", "block", "id_", "key_", "at", "n_tokens", "ids_crc32", "ids"],
                )

    docs = blocks.mapInArrow(decode, "shard int, block int, id_ long, key_ long, at long, n_tokens long, ids_crc32 long, ids binary")
    # ids before each block: within the shard, before the shard within its thousand, and before the thousand
    group = F.floor(F.col("shard") / 1024)
    sizes = blocks.select("shard", "block", "n_tokens", group.alias("group"))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("group", "shard").agg(F.sum("n_tokens").alias("n"))
    groups = shards.groupBy("group").agg(F.sum("n").alias("n")).select("group", upto(Window.orderBy("group")).alias("g_before"))
    shards = shards.select("group", "shard", upto(Window.partitionBy("group").orderBy("shard")).alias("s_before")).join(groups, "group")
    b = sizes.withColumnRenamed("n_tokens", "n").select("shard", "block", upto(Window.partitionBy("shard").orderBy("block")).alias("b_before"))
    base = b.join(shards, "shard").select("shard", "block", (F.col("b_before") + F.col("s_before") + F.col("g_before")).alias("before"))
    out = docs.join(base, ["shard", "block"]).select("id_", "key_", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")


def span_of(symbols: np.ndarray, rules: np.ndarray, spans: np.ndarray, first_rule: int, start: int, length: int) -> np.ndarray:
    """Ids start to start + length of what the symbols stand for; only the symbols that cover them are expanded."""
    width = np.where(symbols >= first_rule, spans[np.maximum(symbols.astype(np.int64) - first_rule, 0)] if len(spans) else 1, 1)
    end = np.cumsum(width, dtype=np.int64)
    a, b = np.searchsorted(end, start, side="right"), np.searchsorted(end, start + length)
    before = int(end[a - 1]) if a else 0
    return expand(symbols[a : b + 1], rules, first_rule)[start - before : start - before + length]


def read_span(spark: SparkSession, path: str, wanted: list[int], start: int = 0, length: int = 1 << 62) -> DataFrame:
    """id_, key_, ids (little-endian unsigned 32-bit) from `start` on, at most `length`, of the documents with the given ids.

    Only blocks that hold one of them leave the scan. Ids that no document has give no row; a start past a document's end gives no ids."""
    some = spark.read.schema(BLOCK).parquet(path).where(F.arrays_overlap("doc_ids", F.array(*(F.lit(int(i)) for i in wanted)).cast("array<long>")))
    asked = set(wanted)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                symbols, rules, spans = np.frombuffer(r["symbols"], "<u2"), np.frombuffer(r["rules"], "<u2").reshape(-1, 2), np.frombuffer(r["spans"], "<u4")
                sym, tok, out = [*r["sym_at"], len(symbols)], [*r["tok_at"], r["n_tokens"]], []
                for j, i in enumerate(r["doc_ids"]):
                    if i in asked:
                        n = max(0, min(length, tok[j + 1] - tok[j] - start))
                        ids = span_of(symbols[sym[j] : sym[j + 1]], rules, spans, r["first_rule"], start, n) if n else symbols[:0]
                        out.append((i, r["keys"][j], ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], names=["id_", "key_", "ids"])

    return some.mapInArrow(decode, "id_ long, key_ long, ids binary")


def op10_repair_ids(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = new_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer or public("word_bpe_49k.json"), added=True)
    return read_ids(spark, path).select(F.col("id_").alias("doc_id"), "start", "n_tokens", "ids_crc32")
