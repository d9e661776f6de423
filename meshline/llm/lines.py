"""Reversible line deduplication (operator 12): exact reference counts by line, and sharded cuckoo filters over them.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case. An index holds how many
documents have each key (``refs``, by the key's 128-bit XXH3 digest; equal digests count as equal keys), and for each
shard of keys a cuckoo filter of those that ``least_docs`` documents or more have. Documents are inserted and deleted
again; counts, filters and what is dropped then are as if the deleted ones had never been there, because texts are
only cut when they are read through the index.

A filter may hold a key by accident. Since the counts are exact, each shard also lists the indexed keys that its
filter holds wrongly (``wrong``, some in ten thousand of its keys), so filter and list together are exact for every
indexed document. They are broadcast while they are within ``FILTER_BYTES``; beyond that lines are joined with the
counts themselves.

Defined results: a null or empty text is one empty line; empty keys are neither counted nor dropped; a row is a
document, whatever its id (null, shared or repeated); a document counts once however often it repeats a line; texts
of any length are cut whole; an empty table gives an empty result; other columns, of any name, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from meshline.llm.shared import bounded_batches, free_name, materialize, slices, table

#: Documents that a dropped line is found in, at least.
LEAST_DOCS = 10
#: Keys of a shard, about; a shard is worked on as a whole.
SHARD_KEYS, LEAST_SHARDS = 200_000, 64
#: Most bytes of filters and lists that are broadcast.
FILTER_BYTES = 64_000_000
BLANKS = " \t\n\x0b\x0c\r"
SLOTS, KICKS = 4, 500
KEY = np.dtype([("k1", "<u8"), ("k2", "<u8")])


@dataclass(frozen=True)
class LineIndex:
    """``refs``: shard, k1, k2, refs. ``filters``: shard, buckets (16-bit fingerprints), wrong (keys held by accident)."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    least_docs: int


# --- lines and keys ---


def coded_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All lines in turn, each text's bounds in them, each line's key by number, the keys' digests, and which keys are empty."""
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    bounds = np.asarray(split.offsets, np.int64)
    lines = split.flatten()
    coded = pc.ascii_lower(pc.ascii_trim(lines, characters=BLANKS)).dictionary_encode()
    keys = coded.dictionary.cast(pa.binary())
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys.to_pylist())), KEY)
    return lines, bounds - bounds[0], np.asarray(coded.indices, np.int64), digests, np.asarray(pc.binary_length(keys)) == 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            _, bounds, codes, digests, empty = coded_lines(part.column("text"))
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            n = np.bincount(np.unique(doc * len(digests) + codes) % len(digests), minlength=len(digests))
            keep = ~empty
            columns = digests["k1"].view(np.int64)[keep], digests["k2"].view(np.int64)[keep], n[keep]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "refs"])


def key_counts(docs: DataFrame) -> DataFrame:
    """How many rows of ``docs`` have each key; keys are counted within a slice of texts before they are shuffled."""
    bounded_batches(docs.sparkSession)
    counted = docs.select("text").mapInArrow(_counted, "k1 long, k2 long, refs long")
    return counted.groupBy("k1", "k2").agg(F.sum("refs").alias("refs"))


# --- cuckoo filters ---


def _fingerprints(k2: np.ndarray) -> np.ndarray:
    return (k2 % np.uint64(65535)).astype(np.int64) + 1


def _places(k1: np.ndarray, prints: np.ndarray, buckets: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """A key's two buckets (``buckets`` is a power of two); either follows from the other and the fingerprint."""
    mask = np.asarray(buckets, np.int64) - 1
    first = (k1 >> np.uint64(24)).astype(np.int64) & mask
    return first, first ^ ((prints * 0x5BD1E995 >> 13) & mask)


def _held(table: np.ndarray, offset, keys: np.ndarray, buckets) -> np.ndarray:
    """Whether the filter (buckets from ``offset`` on in ``table``) holds each key."""
    prints = _fingerprints(keys["k2"])
    first, second = _places(keys["k1"], prints, buckets)
    wanted = prints[:, None].astype(table.dtype)
    return ((table[offset + first] == wanted) | (table[offset + second] == wanted)).any(axis=1)


def cuckoo_insert(table: np.ndarray, keys: np.ndarray) -> bool:
    """Put the keys' fingerprints into ``table`` (buckets x ``SLOTS``, 0: free); False where one finds no place."""
    buckets = len(table)
    prints = _fingerprints(keys["k2"])
    rows = table.tolist()
    chance = np.random.default_rng(0)
    for print_, *places in zip(prints.tolist(), *(p.tolist() for p in _places(keys["k1"], prints, buckets)), strict=True):
        at = places[0] if 0 in rows[places[0]] else places[1]
        for _ in range(KICKS):
            row = rows[at]
            if 0 in row:
                row[row.index(0)] = print_
                break
            out = int(chance.integers(SLOTS))
            print_, row[out] = row[out], print_
            at ^= (print_ * 0x5BD1E995 >> 13) & (buckets - 1)
        else:
            return False
    table[:] = rows
    return True


def cuckoo_delete(table: np.ndarray, keys: np.ndarray) -> None:
    """Take one fingerprint of each key out; the keys must be in the filter."""
    prints = _fingerprints(keys["k2"])
    for print_, *places in zip(prints, *_places(keys["k1"], prints, len(table)), strict=True):
        at = next(p for p in places if (table[p] == print_).any())
        table[at, int(np.argmax(table[at] == print_))] = 0


def cuckoo_of(keys: np.ndarray) -> np.ndarray:
    buckets = 1 << max(0, int(np.ceil(np.log2(max(1, len(keys)) / SLOTS / 0.9))))
    while not cuckoo_insert(found := np.zeros((buckets, SLOTS), np.uint16), keys):
        buckets *= 2
    return found


def _updated(least: int):
    """A shard's filter after its keys' counts went from ``before`` to ``after``."""

    def update(group: tuple, old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        named = np.empty(len(keys), KEY)
        named["k1"], named["k2"] = keys["k1"].to_numpy().view(np.uint64), keys["k2"].to_numpy().view(np.uint64)
        was, now = keys["before"].to_numpy() >= least, keys["after"].to_numpy() >= least
        if len(old):
            held = np.frombuffer(old["buckets"].iloc[0], np.uint16).reshape(-1, SLOTS).copy()
            cuckoo_delete(held, named[was & ~now])
            if not cuckoo_insert(held, named[now & ~was]):
                held = cuckoo_of(named[now])
        else:
            held = cuckoo_of(named[now])
        rest = named[~now & (keys["after"].to_numpy() > 0)]
        wrong = rest[_held(held, 0, rest, len(held))]
        return pd.DataFrame({"shard": [group[0]], "buckets": [held.tobytes()], "wrong": [wrong.tobytes()]})

    return update


# --- the index ---


def _index(spark: SparkSession, counts: DataFrame, filters: DataFrame | None, shards: int, least_docs: int) -> LineIndex:
    """``counts``: k1, k2, before, after."""
    shards = max(shards, LEAST_SHARDS)
    counts = counts.withColumn("shard", F.col("k1").bitwiseAND(shards - 1).cast("int"))
    kinds = "shard int, buckets binary, wrong binary"
    old = spark.createDataFrame([], kinds) if filters is None else filters
    new = old.groupBy("shard").cogroup(counts.groupBy("shard")).applyInPandas(_updated(least_docs), kinds)
    refs = counts.filter("after > 0").select("shard", "k1", "k2", F.col("after").alias("refs"))
    return LineIndex(refs, materialize(new), shards, least_docs)


def build(docs: DataFrame, least_docs: int = LEAST_DOCS) -> LineIndex:
    """The index of all rows of ``docs``."""
    counts = materialize(key_counts(docs).select("k1", "k2", F.lit(0).cast("long").alias("before"), F.col("refs").alias("after")))
    return _index(docs.sparkSession, counts, None, _shards(counts), least_docs)


def _shards(counts: DataFrame) -> int:
    return 1 << max(0, (max(1, counts.count()) - 1) // SHARD_KEYS).bit_length()


def _changed(index: LineIndex, docs: DataFrame, sign: int) -> LineIndex:
    new = key_counts(docs).select("k1", "k2", F.lit(0).cast("long").alias("before"), (sign * F.col("refs")).alias("change"))
    old = index.refs.select("k1", "k2", F.col("refs").alias("before"), F.lit(0).cast("long").alias("change"))
    summed = old.unionByName(new).groupBy("k1", "k2").agg(F.sum("before").alias("before"), F.sum("change").alias("change"))
    counts = materialize(summed.select("k1", "k2", "before", F.greatest(F.lit(0), F.col("before") + F.col("change")).alias("after")))
    shards = max(_shards(counts), LEAST_SHARDS)
    # more shards than before: every filter is built anew
    return _index(docs.sparkSession, counts, index.filters if shards <= index.shards else None, max(shards, index.shards), index.least_docs)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with the rows of ``docs`` too."""
    return _changed(index, docs, 1)


def delete(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index without the rows of ``docs``, which must have been inserted before; counts don't go below 0."""
    return _changed(index, docs, -1)


# --- reading through the index ---


def _dropper(filters: list) -> tuple:
    """All shards' filters in one table: where each starts, its size, and the keys held wrongly, sorted."""
    tables = [np.frombuffer(f.buckets, np.uint16).reshape(-1, SLOTS) for f in filters]
    shards = max((f.shard for f in filters), default=-1) + 1
    start, size = np.zeros(shards, np.int64), np.ones(shards, np.int64)
    at = 1  # bucket 0 is empty and stands for shards without keys
    for f, t in zip(filters, tables, strict=True):
        start[f.shard], size[f.shard] = at, len(t)
        at += len(t)
    wrong = np.sort(np.frombuffer(b"".join(f.wrong for f in filters), KEY))
    return np.concatenate([np.zeros((1, SLOTS), np.uint16), *tables]), start, size, wrong


def _frequent(held: tuple, digests: np.ndarray, shards: int) -> np.ndarray:
    table, start, size, wrong = held
    shard = (digests["k1"] & np.uint64(shards - 1)).astype(np.int64)
    there = shard < len(start)
    shard = np.where(there, shard, 0)
    if not len(start):
        return np.zeros(len(digests), bool)
    found = there & _held(table, start[shard], digests, size[shard])
    found[found] = ~np.isin(digests[found], wrong)
    return found


def _cut(batch: pa.RecordBatch, lines: pa.Array, bounds: np.ndarray, drop: np.ndarray) -> list[pa.Array]:
    """Texts without the lines to drop, and how many lines they had and lost."""
    kept = ~drop
    ends = np.concatenate([[0], np.cumsum(kept)])[bounds]
    left = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), lines.filter(pa.array(kept)))
    n = np.diff(bounds)
    return [pc.binary_join(left, "\n"), pa.array(n), pa.array(n - np.diff(ends))]


def _with(batch: pa.RecordBatch, at: int, found: list[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    columns = [*batch.columns, *found[1:]]
    columns[at] = found[0]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def clean(docs: DataFrame, index: LineIndex, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``docs``, all of them in the index, with the frequent lines cut out of ``text``; adds ``n_lines`` and ``n_dropped``.

    ``n_lines`` counts lines before any are dropped. Where ``docs`` has columns of these names, ``_`` follows the names
    of the new ones.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    out, at = docs.withColumns({c: F.lit(0).cast("long") for c in names}).schema, docs.columns.index("text")
    size = index.filters.agg(F.sum(F.length("buckets") + F.length("wrong"))).first()[0] or 0
    shards = index.shards
    if size <= filter_bytes:
        held = spark.sparkContext.broadcast(_dropper(index.filters.collect()))

        def cut(batches):
            for batch in batches:
                for part in slices(batch):
                    lines, bounds, codes, digests, empty = coded_lines(part.column("text"))
                    drop = (_frequent(held.value, digests, shards) & ~empty)[codes]
                    found = _cut(part, lines, bounds, drop)
                    yield _with(part, at, found, pa.schema([*part.schema, pa.field(names[0], pa.int64()), pa.field(names[1], pa.int64())]))

        return docs.mapInArrow(cut, out)
    return _clean_by_join(docs, index, names, out, at)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            _, bounds, codes, digests, empty = coded_lines(part.column("text"))
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            no = np.arange(len(codes)) - bounds[doc]
            keep = ~empty[codes]
            key = digests[codes[keep]]
            columns = part.column("digest").take(pa.array(doc[keep])), pa.array(no[keep]), pa.array(key["k1"].view(np.int64)), pa.array(key["k2"].view(np.int64))
            yield pa.RecordBatch.from_arrays(list(columns), ["digest", "no", "k1", "k2"])


def _clean_by_join(docs: DataFrame, index: LineIndex, names: tuple[str, str], out, at: int) -> DataFrame:
    """By joins alone: lines with their counts, then each text (by its SHA-256) with the numbers of its lines to drop."""
    digest, gone = free_name(docs, "digest"), free_name(docs, "gone")
    keyed = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    listed = keyed.select("text", F.col(digest).alias("digest")).mapInArrow(_listed, "digest string, no long, k1 long, k2 long")
    frequent = index.refs.filter(F.col("refs") >= index.least_docs).select("k1", "k2")
    found = listed.join(frequent, ["k1", "k2"], "left_semi").groupBy("digest").agg(F.collect_set("no").alias(gone))
    joined = keyed.join(found.withColumnRenamed("digest", digest), digest, "left").drop(digest)

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                split = pc.split_pattern(pc.fill_null(part.column("text"), ""), "\n")
                bounds = np.asarray(split.offsets, np.int64)
                bounds = bounds - bounds[0]
                lost = pc.fill_null(part.column(part.num_columns - 1), [])
                which = np.asarray(lost.flatten()) + np.repeat(bounds[:-1], np.asarray(pc.list_value_length(lost)))
                drop = np.zeros(bounds[-1], bool)
                drop[which.astype(np.int64)] = True
                rest = part.select(range(part.num_columns - 1))
                found = _cut(rest, split.flatten(), bounds, drop)
                yield _with(rest, at, found, pa.schema([*rest.schema, pa.field(names[0], pa.int64()), pa.field(names[1], pa.int64())]))

    return joined.mapInArrow(cut, out)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines that ten documents or more have."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = clean(docs, build(docs))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
line AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM doc),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM line),
many AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= {LEAST_DOCS})
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (m.key IS NOT NULL))::BIGINT AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (m.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN many m USING (key) GROUP BY r, doc_id"""
