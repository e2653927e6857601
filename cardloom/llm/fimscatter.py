"""Fill-in-the-middle transformation by displacement scatter.

The rows of an Arrow batch lie one after another in one buffer of bytes. Two cuts part each text into prefix, middle and suffix; in
the output each part stands at another place, so all bytes of a part move by one number. A difference array holds the change of
that number where a part begins; its cumulative sum gives every byte of the batch its shift, and one numpy scatter writes the
batch's outputs. The way back finds the three markers in an output, and the same sums, read the other way round, gather the text.

The buffer is walked in blocks of bytes, the shift being carried from one to the next, so a task needs its batch twice and a
block's numbers, however long a text is.

Null text counts as empty, an empty text is plain; a null id is hashed as no digits; repeated rows give equal rows; an empty table gives
an empty result; further columns pass through unchanged, but for names that end as this module's own (`fim_...`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import table

MARKS = ("<P>", "<S>", "<M>")
#: Of 100: texts that stay plain from here on, and transformed ones that have the suffix first below here.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
BLOCK = 1 << 20
PLAIN, PSM, SPM = "plain", "psm", "spm"


def shares(key: Column) -> list[Column]:
    """The first four groups of eight hex digits of the key's sha256, as numbers."""
    digest = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """docs with fim_text, fim_n (code points), fim_a and fim_b (the cuts) and fim_form."""
    d = docs.withColumn("fim_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    d = d.withColumn("fim_n", F.char_length("fim_text").cast("long")).withColumn("fim_h", F.array(*shares(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))))
    h = [F.get("fim_h", F.lit(k)) for k in range(4)]
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains("fim_text", F.lit(m))
    form = F.when((F.col("fim_n") == 0) | marked | (h[2] % 100 >= PLAIN_FROM), PLAIN).when(h[3] % 100 < SUFFIX_FIRST, SPM).otherwise(PSM)
    cuts = [h[0] % (F.col("fim_n") + 1), h[1] % (F.col("fim_n") + 1)]
    return d.select(*docs.columns, "fim_text", "fim_n", F.least(*cuts).alias("fim_a"), F.greatest(*cuts).alias("fim_b"), form.alias("fim_form"))


def byte_cuts(data: np.ndarray, n: np.ndarray, cuts: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Places in data of cuts in code points: cuts is (texts, k) and ascending in each row, n has the texts' code points."""
    targets = ((np.cumsum(n) - n)[:, None] + cuts).ravel()
    out, seen, done = np.full(len(targets), len(data), np.int64), 0, 0
    for at in range(0, len(data), block):
        heads = np.flatnonzero((data[at : at + block] & 0xC0) != 0x80)
        to = np.searchsorted(targets, seen + len(heads))  # a code point that starts here
        out[done:to] = at + heads[targets[done:to] - seen]
        done, seen = to, seen + len(heads)
    return out.reshape(cuts.shape)


def shifts(begins: np.ndarray, moves: np.ndarray, size: int, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks (start, destinations): byte i goes to i + the move of the last part that begins at or before it.

    begins is ascending; where several parts begin at one place all but the last are empty.
    """
    change = np.diff(moves, prepend=0)
    carried = 0
    for at in range(0, size, block):
        end = min(size, at + block)
        lo, hi = np.searchsorted(begins, [at, end])
        step = np.zeros(end - at, np.int64)
        np.add.at(step, begins[lo:hi] - at, change[lo:hi])
        step[0] += carried
        np.cumsum(step, out=step)
        carried = int(step[-1])
        yield at, step + np.arange(at, end)


def scatter(data: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, form: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of a batch and their offsets; a and b are places in data, form is 0 (plain), 1 (psm) or 2 (spm)."""
    start, end = offsets[:-1], offsets[1:]
    size = np.where(form > 0, 9, 0)
    ends = np.cumsum(end - start + size)
    out_start = ends - (end - start + size)
    pre, mid, suf = a - start, b - a, end - b
    # Where the parts stand in the output: plain has no markers; psm is P prefix S suffix M middle; spm is S suffix P prefix M middle.
    to_pre = out_start + np.select([form == 1, form == 2], [3, 6 + suf], 0)
    to_mid = out_start + np.where(form > 0, 9 + pre + suf, pre)
    to_suf = out_start + np.select([form == 1, form == 2], [6 + pre, 3], pre + mid)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    begins = np.stack([start, a, b], 1).ravel()
    moves = np.stack([to_pre - start, to_mid - a, to_suf - b], 1).ravel()
    for at, to in shifts(begins, moves, len(data), block):
        out[to] = data[at : at + len(to)]
    for mark, before in zip(MARKS, (to_pre, to_suf, to_mid), strict=True):
        for k, c in enumerate(mark.encode()):
            out[before[form > 0] - 3 + k] = c
    return out, np.concatenate([[0], ends])


def gather(out: np.ndarray, offsets: np.ndarray, form: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The texts back from outputs and forms alone, with their offsets."""
    start, end = offsets[:-1], offsets[1:]
    spots = [[] for _ in MARKS]
    for at in range(0, len(out), block):
        piece = out[at : at + block + 2]
        heads = np.flatnonzero(piece[:-2] == ord("<")) if len(piece) > 2 else np.zeros(0, np.int64)
        heads = heads[piece[heads + 2] == ord(">")]
        for k, m in enumerate(MARKS):
            spots[k].append(at + heads[piece[heads + 1] == ord(m[1])])
    moved = form > 0
    first = [np.zeros(len(form), np.int64) for _ in MARKS]
    for k, s in enumerate(spots):
        s = np.concatenate(s) if s else np.zeros(0, np.int64)
        first[k][moved] = s[np.searchsorted(s, start[moved])]
    p, s, m = first
    # Parts in the output, and where each stands in the text.
    pre, suf = (p + 3, np.where(form == 1, s, m)), (s + 3, np.where(form == 1, m, p))
    n_pre, n_suf, n_mid = pre[1] - pre[0], suf[1] - suf[0], end - (m + 3)
    length = np.where(moved, end - start - 9, end - start)
    ends = np.cumsum(length)
    text_start = ends - length
    begins = text_start[:, None] + np.stack([0 * n_pre, np.where(moved, n_pre, 0), np.where(moved, n_pre + n_mid, 0)], 1)
    source = np.stack([np.where(moved, pre[0], start), np.where(moved, m + 3, start), np.where(moved, suf[0], start)], 1)
    back = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for at, frm in shifts(begins.ravel(), (source - begins).ravel(), len(back), block):
        back[at : at + len(frm)] = out[frm]
    return back, np.concatenate([[0], ends])


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary or string column's bytes and offsets from 0."""
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def _column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Bytes and offsets as a string column."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))


def _forms(col: pa.Array) -> np.ndarray:
    return np.array([(PLAIN, PSM, SPM).index(f) for f in col.to_pylist()], np.int64)


def _added(batch: pa.RecordBatch, drop: set[str], name: str, col: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in drop]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), col], [*names, name])


def _schema(df: DataFrame, drop: set[str], name: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in drop), f"{name} string"])


def transformed(plans: DataFrame, block: int = BLOCK) -> DataFrame:
    """What `planned` returns, with fim_output in place of fim_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            data, offsets = _bytes(x.column("fim_text"))
            n, a, b = (x.column(c).to_numpy() for c in ("fim_n", "fim_a", "fim_b"))
            at = byte_cuts(data, n, np.stack([a, b], 1), block)
            yield _added(x, {"fim_text"}, "fim_output", _column(*scatter(data, offsets, at[:, 0], at[:, 1], _forms(x.column("fim_form")), block)))

    return plans.mapInArrow(run, _schema(plans, {"fim_text"}, "fim_output"))


def restored(out: DataFrame, output_col: str = "fim_output", form_col: str = "fim_form", block: int = BLOCK) -> DataFrame:
    """out with fim_restored: each output's text again, from output and form alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield _added(x, set(), "fim_restored", _column(*gather(*_bytes(x.column(output_col)), _forms(x.column(form_col)), block)))

    return out.mapInArrow(run, _schema(out, set(), "fim_restored"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """docs with fim_n, fim_a, fim_b, fim_form and fim_output."""
    return transformed(planned(docs, id_col, text_col, seed))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = restored(transformed(planned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")))
    whole = F.col("fim_form") != PLAIN
    return out.select(
        "doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.when(whole, F.col("fim_a")).alias("prefix_chars"), F.when(whole, F.col("fim_b") - F.col("fim_a")).alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"), F.sha2("fim_restored", 256).alias("restored_sha256"),
    )


ORACLE = f"""with t as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as d from documents),
h as (select *, ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2, ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4 from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
 case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= {PLAIN_FROM} then 'plain' when h4 % 100 < {SUFFIX_FIRST} then 'spm' else 'psm' end as form from h),
p as (select *, substring(t, 1, a) as pre, substring(t, a + 1, b - a) as mid, substring(t, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
 sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
 sha256(t) as restored_sha256 from p"""
