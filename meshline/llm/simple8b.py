"""Simple-8b word-aligned coding of token ids, written to and read from files (operator 5).

A 64-bit little-endian word holds a 4-bit selector (top) and 60 bits of payload: as many values as the selector
says, the first one lowest. Values of 60 bits or more escape: the word's payload is the all-ones mark of the
one-value selector, and the value itself stands in a list after the words. Values are cut into blocks of
``BLOCK``; the index holds each block's first word and first escape, so blocks decode alone and in bulk.

File format, one record after another, each ended by one 0x0A byte (little-endian)::

    u32 magic "MS9B" | u32 range | u32 record | u32 documents | u32 blocks | u32 words | u32 escapes | u64 values
    documents x (i64 doc_id, u64 values, u8 has_id) | blocks x (u32 first word, u32 first escape)
    words x u64 | escapes x u64 | 0x0A

Files are written by Spark's own committer and read by its binary reader: lost executors and any file system it
knows are taken care of. Document order is that of the ranges' and records' numbers, whatever files are called.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meshline.llm.shared import materialize, shared_dir, slices, table
from meshline.llm.tokens import END_ID, text_or_empty, word_tokenizer

#: How many values of how many bits each selector packs.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK, MAGIC, HEAD = 1024, b"MS9B", struct.Struct("<4sIIIIIIQ")
MARK = np.uint64((1 << 60) - 1)
#: By bit length: the narrowest of the widths that holds it.
_NARROWEST = np.array([next((w for w in sorted(set(WIDTHS.tolist())) if w >= b), 60) for b in range(66)], np.uint8)
DOC = np.dtype([("doc_id", "<i8"), ("values", "<u8"), ("has_id", "u1")])


def encode(values: np.ndarray, blocks: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes and the block index of ``values`` (unsigned 64-bit), some blocks at a time."""
    parts, w, e = [], 0, 0
    for at in range(0, len(values), blocks * BLOCK):
        words, escapes, index = _encode(values[at : at + blocks * BLOCK])
        parts.append((words, escapes, index + np.array([w, e], "<u4")))
        w, e = w + len(words), e + len(escapes)
    if not parts:
        return _encode(values)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every block takes its next word at the same time: a step packs one word of each block that still has values."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n, blocks = len(values), -(-len(values) // BLOCK)
    escaped = values >= MARK
    plain = np.where(escaped, MARK, values)
    # the narrowest width that holds each value; blocks lie in rows, with room for a word that runs over the end
    width = np.zeros((blocks, BLOCK + COUNTS[0]), np.uint8)
    flat = np.zeros(blocks * BLOCK, np.uint8)
    flat[:n] = _NARROWEST[np.frexp(plain.astype(np.float64))[1]]
    width[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    chosen = np.empty((blocks, BLOCK), np.uint8)
    before = np.zeros((blocks, width.shape[1] + 1), np.int32)
    for s in range(15, -1, -1):  # the selector with most values wins
        np.cumsum(width <= WIDTHS[s], axis=1, out=before[:, 1:])
        k = COUNTS[s]
        np.putmask(chosen, before[:, k : k + BLOCK] - before[:, :BLOCK] == k, s)
    chosen = chosen.ravel()[:n]
    taken = np.minimum(COUNTS[chosen], np.minimum((np.arange(n) // BLOCK + 1) * BLOCK, n) - np.arange(n))
    firsts, cursor = [], np.arange(blocks) * BLOCK
    last = np.minimum(cursor + BLOCK, n)
    while len(cursor):
        firsts.append(cursor)
        cursor = cursor + taken[cursor]
        more = cursor < last
        cursor, last = cursor[more], last[more]
    first = np.sort(np.concatenate(firsts)) if firsts else np.empty(0, np.int64)
    selector, count = chosen[first], taken[first]
    words = selector.astype(np.uint64) << np.uint64(60)
    slot = np.arange(n) - np.repeat(first, count)
    shift = (slot * np.repeat(WIDTHS[selector], count)).astype(np.uint64)
    if len(words):
        words |= np.bitwise_or.reduceat(plain << shift, first)
    starts = np.arange(blocks) * BLOCK
    index = np.stack([np.searchsorted(first, starts), np.concatenate([[0], np.cumsum(escaped)])[starts]], axis=1)
    return words, values[escaped], index.astype("<u4")


def decode(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of whole blocks of words, all at once.

    A block's last word may have room for more values than are left; its count is cut at the block's end.
    """
    words = np.asarray(words, dtype=np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    ends = np.cumsum(count)
    if len(ends) and (ends[-1] > n or n > BLOCK):
        # blocks are decoded in turn so far as their lengths go; within a block counts are exact up to its last word
        count = _cut(count, n)
    slot = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    shift = (slot * np.repeat(WIDTHS[selector], count)).astype(np.uint64)
    mask = ((np.uint64(1) << WIDTHS[selector].astype(np.uint64)) - np.uint64(1)) & MARK
    out = (np.repeat(words, count) >> shift) & np.repeat(mask, count)
    out[np.repeat(selector < 2, count)] = 0
    if len(escapes):
        out[np.flatnonzero(out == MARK)] = escapes
    return out


def _cut(count: np.ndarray, n: int) -> np.ndarray:
    """Counts with each block's last word cut to what is left of the block."""
    count, at, i = count.copy(), 0, 0
    ends = np.cumsum(count)
    done = 0
    while done < n:
        left = min(BLOCK, n - done)
        j = int(np.searchsorted(ends, at + left))  # the word in which the block ends
        over = int(ends[j] - at - left)
        count[j] -= over
        at, done, i = int(ends[j]), done + left, j + 1
    return count[:i]


def to_record(doc_ids: list[int | None], lengths: np.ndarray, values: np.ndarray, place: tuple[int, int] = (0, 0)) -> bytes:
    """A record; ``place`` is the number of its range and its own number there."""
    words, escapes, index = encode(values)
    docs = np.zeros(len(doc_ids), DOC)
    docs["doc_id"], docs["values"] = [d or 0 for d in doc_ids], lengths
    docs["has_id"] = [d is not None for d in doc_ids]
    head = HEAD.pack(MAGIC, *place, len(docs), len(index), len(words), len(escapes), len(values))
    parts = [head, docs.tobytes(), index.tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(), b"\n"]
    return b"".join(parts)


def records(content: bytes):
    """``(place, doc_ids, lengths, values)`` of each record of a file."""
    at = 0
    while at < len(content):
        magic, range_, record, docs, blocks, words, escapes, n = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no record at byte {at}")
        at += HEAD.size
        table_ = np.frombuffer(content, DOC, docs, at)
        at += docs * DOC.itemsize + blocks * 8
        w = np.frombuffer(content, "<u8", words, at)
        at += words * 8
        e = np.frombuffer(content, "<u8", escapes, at)
        at += escapes * 8 + 1
        ids = [int(d) if h else None for d, h in zip(table_["doc_id"], table_["has_id"], strict=True)]
        yield (range_, record), ids, table_["values"].astype(np.int64), decode(w, e, n)


def write_ids(df: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Tokenise ``df(doc_id, text)`` and write its ids in ascending ``doc_id`` order as files under ``path``.

    Ranges of ``doc_id`` are dealt out and sorted by Spark; each task streams its range into records of some 4 MB of
    text (one very long text at least). Null texts count as empty (the end id alone); rows with a null ``doc_id`` come
    first; rows that share an id are all written, in the order of their texts' hashes, and may lie in several ranges.
    Further columns, whatever their names, are ignored; an empty table gives no record.
    """

    def run(batches):
        tokens, place, n = word_tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch):
                ids, ends = tokens.encode(text_or_empty(part), end_id)
                record = to_record(part.column("doc_id").to_pylist(), np.diff(ends), ids, (place, n))
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array([record[:-1]], pa.binary())], names=["record"])

    docs = df.select(F.col("doc_id").cast("long"), "text")
    # rows that share an id are told apart, so that a range can end between them
    docs = docs.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), "h", "row"]
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    binary = ranged.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    binary.write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", 8).text(path)


def _per_file(spark: SparkSession, path: str, rows, kinds: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                for got in rows(content.as_buffer().to_pybytes()):
                    got = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(got, kinds, strict=True)], names=[n for n, _ in kinds])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files alone: ``range``, ``record``, ``seq`` (place in the record), ``doc_id``, ``ids``."""

    def rows(content: bytes):
        for (range_, record), ids, lengths, values in records(content):
            ends = np.cumsum(lengths)
            cut = zip(ids, (ends - lengths).tolist(), ends.tolist(), strict=True)
            yield [(range_, record, seq, doc, values[a:b].astype(np.int64)) for seq, (doc, a, b) in enumerate(cut)]

    kinds = [*((n, pa.int64()) for n in ("range", "record", "seq", "doc_id")), ("ids", pa.list_(pa.int64()))]
    return _per_file(spark, path, rows, kinds, "range long, record long, seq long, doc_id long, ids array<long>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_ids``, with ``n_tokens`` and the ids' ``ids_crc32``, and ``own``: ids before it in its file, whose first
    record is ``record``."""

    def rows(content: bytes):
        own, first = 0, None
        for place, ids, lengths, values in records(content):
            first = first or place
            small, at, out = values.astype("<u4"), 0, []
            for doc, n in zip(ids, lengths.tolist(), strict=True):
                out.append((*first, doc, n, zlib.crc32(small[at : at + n]), own))
                at, own = at + n, own + n
            yield out

    names = ("range", "record", "doc_id", "n_tokens", "ids_crc32", "own")
    return _per_file(spark, path, rows, [(n, pa.int64()) for n in names], ", ".join(f"{n} long" for n in names))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_ids(table(spark, sf_dir, "documents"), path)
    docs = materialize(read_digests(spark, path))
    # files are summed within their range, and ranges, one row each, in one task
    files = docs.groupBy("range", "record").agg(F.sum("n_tokens").alias("n"))
    inside = Window.partitionBy("range").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = files.groupBy("range").agg(F.sum("n").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    files = files.select("range", "record", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("before")).join(ranges, "range")
    return docs.join(files, ["range", "record"]).select(
        "doc_id", (F.col("earlier") + F.col("before") + F.col("own")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )
