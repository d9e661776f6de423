"""Packing documents into training windows by non-negative least squares (operator 1).

Texts are tokenised once; a document is cut into full windows and a rest. Lengths of the rests are counted in
classes; for each shallow combination of classes (one to three pieces) that fills a window, a repeat count is
solved so that the combinations use up the histogram, by non-negative least squares. The mixture is dealt out in
shards of bounded size: each shard rounds the repeat counts down to what it has, and packs what is left greedily,
first whole (best fit), then by cutting at marks every ``STEP`` ids. The crc of each cut piece follows from the
crcs up to those marks, so ids never leave the task that made them.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from meshline.llm.shared import materialize, slices, table
from meshline.llm.tokens import END_ID, text_or_empty, word_tokenizer

WINDOW, STEP, CLASS = 2048, 32, 8
#: Rests per shard: bounds what one task holds.
SHARD_ROWS = 40_000

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, marks binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# --- crc32 of a part from the crcs of what ends before and at its end -------------------------------------------


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


@lru_cache(maxsize=None)
def _zeros(power: int) -> tuple[int, ...]:
    """The operator over GF(2) that appends ``2**power`` zero bytes to a crc32's message."""
    if power == 0:
        one = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
        for _ in range(3):
            one = [_times(one, one[i]) for i in range(32)]
        return tuple(one)
    half = list(_zeros(power - 1))
    return tuple(_times(half, half[i]) for i in range(32))


def crc_part(before: int, to_end: int, n_bytes: int) -> int:
    """crc32 of the last ``n_bytes`` of a message, given the crc32 of all of it and of what comes before."""
    power = 0
    while n_bytes:
        if n_bytes & 1:
            before = _times(list(_zeros(power)), before)
        n_bytes >>= 1
        power += 1
    return to_end ^ before


# --- pieces ------------------------------------------------------------------------------------------------------


def pieces(df: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """Full windows and a rest of every document's ids (end id included); a rest carries crcs at every ``STEP``."""

    def run(batches):
        tokens = word_tokenizer(vocabulary)
        for batch in batches:
            for part in slices(batch, size=1_000_000):
                ids, ends = tokens.encode(text_or_empty(part), END_ID)
                ids = ids.astype("<u4")
                out = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    for at in range(a, b, window):
                        to, crc, marks = min(at + window, b), 0, []
                        if to - at == window:
                            crc = zlib.crc32(ids[at:to])
                        else:
                            for k in range(at, to, STEP):
                                crc = zlib.crc32(ids[k : min(k + STEP, to)], crc)
                                marks.append(crc)
                        out.append((doc, at - a, to - at, crc, b - a, np.array(marks, "<u4").tobytes()))
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "marks"],
                )

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


# --- the mixture -------------------------------------------------------------------------------------------------


def combinations(classes: int) -> list[tuple[int, ...]]:
    """One to three classes, in descending order, that add up to ``classes``."""
    out: list[tuple[int, ...]] = [(classes,)]
    out += [(a, classes - a) for a in range((classes + 1) // 2, classes)]
    for a in range((classes + 2) // 3, classes - 1):
        out += [(a, b, classes - a - b) for b in range((classes - a + 1) // 2, min(a, classes - a - 1) + 1)]
    return out


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, tolerance: float = 1e-4) -> np.ndarray:
    """min |A x - target| over x >= 0 (active sets); column j of A counts the classes of ``columns[j]``."""
    n, m = len(target), len(columns)
    rows = np.concatenate([np.array(c) - 1 for c in columns])
    cols = np.repeat(np.arange(m), [len(c) for c in columns])
    x, active = np.zeros(m), np.zeros(m, bool)
    left, scale = target.astype(float).copy(), max(float(target.max(initial=0)), 1.0)
    for _ in range(4 * n):
        gain = np.bincount(cols, left[rows], minlength=m) / np.sqrt(np.bincount(cols, minlength=m))
        gain[active] = -1
        j = int(gain.argmax())
        if gain[j] <= tolerance * scale:
            break
        active[j] = True
        while True:
            use = np.flatnonzero(active)
            a = np.zeros((n, len(use)))
            for k, u in enumerate(use):
                for c in columns[u]:
                    a[c - 1, k] += 1
            s = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(use)), a.T @ target)
            if (s > 0).all():
                x[:] = 0
                x[use] = s
                break
            bad = s <= 0
            step = (x[use][bad] / np.maximum(x[use][bad] - s[bad], 1e-12)).min()
            x[use] = np.maximum(x[use] + step * (s - x[use]), 0)
            drop = use[bad & (x[use] <= 1e-9)]
            if not len(drop):
                drop = use[[int(np.flatnonzero(bad)[0])]]
            active[drop] = False
            x[drop] = 0
        left = target - a @ x[use]
    return x


def mixture(histogram: dict[int, int], classes: int) -> list[tuple[tuple[int, ...], float]]:
    """Combinations with positive repeat counts (per rest) for a histogram of length classes."""
    counts = np.array([histogram.get(c + 1, 0) for c in range(classes)], dtype=float)
    total = counts.sum()
    if not total:
        return []
    columns = combinations(classes)
    return [(c, float(v)) for c, v in zip(columns, nnls(columns, counts / total * 1000) / 1000, strict=True) if v > 1e-9]


# --- dealing a shard ---------------------------------------------------------------------------------------------


def pack_shard(lengths: np.ndarray, mix, window: int = WINDOW, grain: int = CLASS, step: int = STEP):
    """Placements (row, from, to, sequence, offset) of all rests of a shard; ``from`` and ``to`` count within the rest."""
    n, classes = len(lengths), -(-lengths // grain)
    piles = {c: list(np.flatnonzero(classes == c)[::-1]) for c in np.unique(classes).tolist()}
    placed, used = [], []

    def put(row: int, a: int, b: int, seq: int) -> None:
        placed.append((row, a, b, seq, used[seq]))
        used[seq] += b - a

    for combo, per_rest in mix:
        need = {c: combo.count(c) for c in combo}
        repeats = min([int(per_rest * n), *(len(piles.get(c, ())) // k for c, k in need.items())])
        for _ in range(repeats):
            used.append(0)
            for c in combo:
                row = piles[c].pop()
                put(row, 0, int(lengths[row]), len(used) - 1)
    rest = sorted((r for p in piles.values() for r in p), key=lambda r: (-lengths[r], r))
    # best fit: open windows by free room
    open_: dict[int, list[int]] = {}
    plan: list[list[int]] = []
    for row in rest:
        size = int(lengths[row])
        room = next((f for f in range(size, min(size + 65, window)) if open_.get(f)), None)
        room = next((f for f in range(size, window) if open_.get(f)), None) if room is None else room
        if room is None:
            plan.append([])
            k, room = len(plan) - 1, window
        else:
            k = open_[room].pop()
        plan[k].append(row)
        if room > size:
            open_.setdefault(room - size, []).append(k)
    loose = []
    for rows in plan:
        total = int(sum(lengths[r] for r in rows))
        if total >= window - step // 2:
            used.append(0)
            for r in rows:
                put(r, 0, int(lengths[r]), len(used) - 1)
        else:
            loose += rows
    # what fits nowhere is laid end to end and cut at the marks
    seq = None
    for row in loose:
        at, size = 0, int(lengths[row])
        while at < size:
            if seq is None or used[seq] >= window:
                used.append(0)
                seq = len(used) - 1
            free = window - used[seq]
            to = size if size - at <= free else at + (at + free - at) // step * step if at % step == 0 else at
            if to <= at:
                seq = None
                continue
            put(row, at, to, seq)
            at = to
    return placed


def pack(df: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pack all of ``df(doc_id, text)`` into sequences of at most ``window`` ids; one row per piece.

    A null or empty text has the end id alone. Repeated rows (and rows with a null ``doc_id``) are documents of
    their own. Further columns are ignored. An empty table gives an empty result. Every sequence is filled from
    offset 0 without gaps; sequence ids are unique but not dense.
    """
    spark = df.sparkSession
    cut = materialize(pieces(df, vocabulary, window).withColumn("piece_key", F.xxhash64("doc_id", "start", "ids_crc32")))
    rests = cut.filter(F.col("length") < window)
    counts = rests.groupBy(F.ceil(F.col("length") / CLASS).cast("int").alias("c")).count().collect()
    mix = mixture({r["c"]: r["count"] for r in counts}, window // CLASS)
    shards = max(1, -(-sum(r["count"] for r in counts) // SHARD_ROWS))
    sent = spark.sparkContext.broadcast(mix)

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        lengths, number = pdf["length"].to_numpy(), int(pdf["shard"].iloc[0])
        out = []
        docs, starts, crcs, totals, marks = (pdf[c].to_numpy() for c in ("doc_id", "start", "ids_crc32", "doc_tokens", "marks"))
        for row, a, b, seq, offset in pack_shard(lengths, sent.value, window):
            crc = int(crcs[row])
            if a or b < lengths[row]:
                m = np.frombuffer(marks[row], "<u4")
                before, end = int(m[a // STEP - 1]) if a else 0, int(m[-(-b // STEP) - 1])
                crc = crc_part(before, end, 4 * (b - a))
            out.append((docs[row], starts[row] + a, b - a, crc, totals[row], (number << 32) + seq, offset))
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    dealt = rests.withColumn("shard", F.pmod("piece_key", F.lit(shards)).cast("int"))
    packed = dealt.select("shard", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "marks")
    packed = packed.groupBy("shard").applyInPandas(shard, PACKED)
    full = cut.filter(F.col("length") == window).select(
        "doc_id", "start", F.col("length").cast("long"), "ids_crc32", "doc_tokens",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return packed.unionByName(full)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
