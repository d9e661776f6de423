"""Removal of long repeated byte strings by difference-cover suffix sorting (operator 2).

Equal strings of ``SPAN`` bytes have equal anchors (see ``anchors``), so what can be equal at all is found by
grouping anchors instead of all suffixes:

* an anchor's hash that occurs once: none of its strings repeats;
* all the bytes that its strings cover occur again around another anchor: all of them repeat;
* the rest, each text once, is suffix-sorted in shards of bounded size that hold all strings of an anchor hash:
  triples at two of three places are sorted and named, the names sorted by recursion, the remaining suffixes merged
  in, and neighbours in the order compared by the bytes of their prefixes. A hash with more text than a shard takes is
  instead dealt out string by string.

The same finds repeated runs of words: a text is then the sequence of its words' 64-bit hashes instead of its bytes
(words are what ASCII white space leaves; equal hashes count as equal words), and lengths are counted in words.

Spans of text travel once per distinct text, whole documents once, at the end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from meshline.llm.anchors import anchors, digests, gram_hashes
from meshline.llm.shared import coded_words, free_name, give_back, materialize, slices, table

SPAN, GRAM = 400, 128
#: Passages: repeated runs of so many words, found by grams of so many.
PASSAGE_WORDS, PASSAGE_GRAM = 50, 24
#: Bytes a shard should hold and that are sorted at once (about 100 bytes of memory each), and the most that packed
#: triples of ranks allow; a hash with more than half of the latter goes string by string.
SHARD_BYTES, MOST_BYTES = 500_000, (1 << 21) - 8
#: Spans to look up are broadcast up to this many, and joined by shuffle beyond.
BROADCAST_SPANS = 50_000


# --- suffix sorting ---------------------------------------------------------------------------------------------


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the keys (of equal ones: any), a name from 1 for each key in that order, and how many names there are."""
    order = np.argsort(keys)
    names = np.empty(len(keys), np.int64)
    ordered = keys[order]
    names[order] = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])])
    return order, names, int(names.max(initial=0))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` (values 1 to 2**21 - 1, as many at most) in ascending order."""
    n = len(s)
    if n > 1 << 21:
        raise ValueError("too long for packed triples")
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    p = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    one, two, zero = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    order, names, count = _named(p[sample] << 42 | p[sample + 1] << 21 | p[sample + 2])
    if count < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    rests = zero[np.argsort(p[zero] << 21 | rank[zero + 1])]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    below = np.searchsorted(p[ones] << 21 | rank[ones + 1], p[rests] << 21 | rank[rests + 1])
    triple = lambda i: p[i] << 42 | p[i + 1] << 21 | rank[i + 2]
    below = below + np.searchsorted(triple(twos), triple(rests))
    out = np.empty(n, np.int64)
    spot = below + np.arange(len(rests))
    out[spot] = rests
    free = np.ones(n, bool)
    free[spot] = False
    out[free] = sampled
    return out


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, span: int) -> np.ndarray:
    """Where the ``span`` bytes at ``a`` and ``b`` are the same."""
    if span < 8 or data.dtype != np.uint8:
        same = np.ones(len(a), bool)
        for i in range(span):
            same &= data[a + i] == data[b + i]
        return same
    eights = np.lib.stride_tricks.as_strided(np.ascontiguousarray(data)[: len(data) - 7].view(np.uint8), (len(data) - 7, 8), (1, 1))
    eights = np.ascontiguousarray(eights).view(np.uint64).ravel()
    same = np.ones(len(a), bool)
    for i in [*range(0, span - 8, 8), span - 8]:
        same &= eights[a + i] == eights[b + i]
    return same


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes, or words by their order, as numbers from 1."""
    return (data.astype(np.int64) if data.dtype == np.uint8 else np.unique(data, return_inverse=True)[1]) + 1


def repeated_starts(data: np.ndarray, starts: np.ndarray, span: int, order: np.ndarray | None = None) -> np.ndarray:
    """Flags of those ``starts`` in ``data`` whose ``span`` units also start at another of them."""
    wanted = np.zeros(len(data), bool)
    wanted[starts] = True
    order = suffix_array(_letters(data)) if order is None else order
    order = order[wanted[order]]
    h = gram_hashes(data, span)
    # a hash tells most neighbours apart; what it doesn't is compared byte by byte
    near = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    near = near[_equal(data, order[near], order[near + 1], span)]
    found = np.zeros(len(data), bool)
    found[order[near + 1]] = True
    found[order[near]] = True
    return found[starts]


def runs(flags: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Byte intervals covered by the strings that start where ``flags`` is set."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > span)
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(at) - 1]])
    return [(int(at[a]), int(at[b]) + span) for a, b in zip(first, last, strict=True)]


# --- the operator ------------------------------------------------------------------------------------------------


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in turn, and where each ends."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(t) for t in raw])


def as_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words in turn, and where each text ends."""
    words, codes, bounds = coded_words(texts)
    # an array of objects takes a tenth of the time of to_pylist
    names = words.cast(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    some = (np.asarray(pc.binary_length(words)) > 0)[codes]
    return hashes[codes][some], np.concatenate([[0], np.cumsum(some)])[bounds[1:]]


def _anchored(docs: DataFrame, span: int, gram: int, view=as_bytes) -> DataFrame:
    """Anchors of all texts: hash ``h``, ``key`` of the text, first place ``lo``, number of places ``n``, ``size`` of the
    text that the strings at these places take, and its ``digest``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, size=500_000):
                data, ends = view(part.column("text"))
                t, first, last, h = anchors(data, ends, span, gram)
                begin, stop = np.concatenate([[0], ends])[t], np.minimum(last + span, ends[t])
                columns = [
                    pa.array(h.view(np.int64)), part.column("key").take(pa.array(t)), pa.array((first - begin).astype(np.int32)),
                    pa.array((last - first + 1).astype(np.int32)), pa.array((stop - first).astype(np.int32)),
                    pa.array(digests(data.tobytes(), first * data.itemsize, stop * data.itemsize), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "key", "lo", "n", "size", "digest"])

    return docs.select("key", "text").mapInArrow(run, "h long, key long, lo int, n int, size int, digest binary")


def _cut_out(view):
    """The asked-for spans of each text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, size=1_000_000):
                hs, ds, bs, ns = [], [], [], []
                data, ends = view(part.column("text"))
                for begin, asked in zip([0, *ends[:-1].tolist()], part.column("asked").to_pylist(), strict=True):
                    for a in asked:
                        hs.append(a["h"])
                        ds.append(a["digest"])
                        ns.append(a["n"])
                        bs.append(data[begin + a["lo"] : begin + a["lo"] + a["size"]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hs, pa.int64()), pa.array(ds, pa.binary()), pa.array(ns, pa.int32()), pa.array(bs, pa.binary())],
                    names=["h", "digest", "n", "bytes"],
                )

    return run


def _sorted_shard(span: int, kind: type):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "digest"], kind="stable", ignore_index=True)
        out: list[tuple[bytes, list[dict]]] = []

        def solve(rows: pd.DataFrame) -> None:
            data = np.frombuffer(b"".join(rows["bytes"]), kind)
            lens, n = np.array([len(b) for b in rows["bytes"]]) // data.itemsize, rows["n"].to_numpy()
            begin = np.cumsum(lens) - lens
            row = np.repeat(np.arange(len(n)), n)
            starts = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            fits = starts + span <= (begin + lens)[row]
            flags = np.zeros(len(starts), bool)
            flags[fits] = repeated_starts(data, starts[fits], span)
            at = 0
            for digest, k in zip(rows["digest"], n.tolist(), strict=True):
                if mine := [{"a": a, "b": b} for a, b in runs(flags[at : at + k], span)]:
                    out.append((digest, mine))
                at += k

        # hashes are independent of each other: as many as fit are sorted together
        sizes = pdf["bytes"].map(len).groupby(pdf["h"], sort=False).sum()
        first, total, rows = 0, 0, 0
        counts = pdf.groupby("h", sort=False).size()
        for size, count in zip(sizes.tolist(), counts.tolist(), strict=True):
            if total and total + size > min(SHARD_BYTES, MOST_BYTES):
                solve(pdf.iloc[first:rows])
                first, total = rows, 0
            total, rows = total + size, rows + count
        if rows > first:
            solve(pdf.iloc[first:rows])
        give_back()
        return pd.DataFrame(out, columns=["digest", "found"])

    return run


def _strings(span: int, size: int):
    """Each string, by its digest, of units of ``size`` bytes: for hashes with more text than a shard takes."""

    def run(batches):
        for batch in batches:
            for digest, n, raw in zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "bytes")), strict=True):
                at = range(min(n, len(raw) // size - span + 1))
                names = [xxhash.xxh3_128_digest(raw[i * size : (i + span) * size]) for i in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), pa.array([digest] * len(at), pa.binary()), pa.array(at, pa.int32())], names=["string", "digest", "at"]
                )

    return run


def repeats(df: DataFrame, span: int = SPAN, gram: int = GRAM, view=as_bytes) -> DataFrame:
    """``df(key, text)`` with unique keys to ``key`` and ``found``: intervals ``a`` to ``b`` (of bytes, or of words where
    ``view`` is ``as_words``) covered by repeated strings of ``span`` units."""
    kind = np.uint8 if view is as_bytes else np.uint64
    unit = np.dtype(kind).itemsize
    # 1. hashes of anchors that occur more than once; the anchors are stored, as texts take longer to go through again
    places = materialize(_anchored(df, span, gram, view))
    twice = materialize(places.groupBy("h").count().filter("count > 1").select("h"))
    some = materialize(places.join(twice, "h"))
    # 2. distinct texts around them
    texts = some.groupBy("h", "digest").agg(F.count("*").alias("copies"), F.min(F.struct("key", "lo", "n", "size")).alias("one"))
    texts = materialize(texts.select("h", "digest", "copies", "one.*"))
    kinds = texts.groupBy("h").agg(F.count("*").alias("kinds"), (F.sum("size") * unit).alias("bytes")).filter("kinds > 1")
    doubt = materialize(texts.join(materialize(kinds), "h"))
    asked = doubt.groupBy("key").agg(F.collect_list(F.struct("h", "digest", "lo", "n", "size")).alias("asked"))
    asked = materialize(asked)
    count, total = doubt.agg(F.count("*"), F.coalesce(F.sum("size") * unit, F.lit(0))).first()
    if count <= BROADCAST_SPANS:
        asked = F.broadcast(asked)
    cut = materialize(df.select("key", "text").join(asked, "key").select("text", "asked").mapInArrow(_cut_out(view), "h long, digest binary, n int, bytes binary"))
    # 3. suffix order of bounded shards; hashes beyond a shard string by string
    large = materialize(kinds.filter(F.col("bytes") > MOST_BYTES // 2).select("h"))
    shards = max(1, -(-total // SHARD_BYTES))
    small = cut.join(large, "h", "left_anti").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    found_kind = "digest binary, found array<struct<a:int,b:int>>"
    found = small.repartition(shards, "shard").groupBy("shard").applyInPandas(_sorted_shard(span, kind), found_kind)
    if large.head(1):
        rows = cut.join(large, "h", "left_semi").select("digest", "n", "bytes")
        strings = materialize(rows.mapInArrow(_strings(span, unit), "string binary, digest binary, at int"))
        again = materialize(strings.groupBy("string").count().filter("count > 1").select("string"))
        more = strings.join(again, "string").groupBy("digest").agg(
            F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + span).alias("b"))).alias("found")
        )
        found = found.unionByName(more)
    # 4. verdicts back to all places of a text
    partly = materialize(found).withColumnRenamed("digest", "_d")
    # of a text that occurs again every string does
    every = F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("b")))
    verdicts = texts.join(partly, F.col("digest") == F.col("_d"), "left").select(
        "h", "digest", F.when(F.col("copies") > 1, every).otherwise(F.col("found")).alias("found")
    )
    verdicts = materialize(verdicts.filter(F.col("found").isNotNull()))
    placed = some.join(verdicts, ["h", "digest"]).select("key", "lo", F.explode("found").alias("f"))
    placed = placed.select("key", F.struct((F.col("lo") + F.col("f.a")).alias("a"), (F.col("lo") + F.col("f.b")).alias("b")).alias("f"))
    return placed.groupBy("key").agg(F.collect_list("f").alias("found"))


def _merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Disjoint intervals, in order."""
    out: list[list[int]] = []
    for a, b in sorted((f["a"], f["b"]) for f in (found if found is not None else ())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: Bytes between words, as ``as_words`` cuts texts.
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _word_places(raw: bytes, intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals of words as intervals of bytes, from the first word's start to the last one's end."""
    if not intervals:
        return []
    blank = np.concatenate([[True], BLANK[np.frombuffer(raw, np.uint8)], [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])  # a start and an end of each word
    return [(int(edges[2 * a]), int(edges[2 * b - 1])) for a, b in intervals]


def _rows(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with one more column that tells all its rows apart, and its name.

    It is the id where ids are unique and none is null; else rows are numbered once and stored.
    """
    row = free_name(df, "_row")
    most, null = df.select(F.col("doc_id").alias("i")).groupBy("i").count().agg(F.max("count"), F.max(F.col("i").isNull())).first()
    if most is None or (most == 1 and not null):
        return df.withColumn(row, F.col("doc_id").cast("long")), row
    return materialize(df.withColumn(row, F.monotonically_increasing_id())), row


def removals(df: DataFrame, span: int = SPAN, gram: int = GRAM, words: int | None = None, word_gram: int = PASSAGE_GRAM) -> DataFrame:
    """Per row of ``df(doc_id, text)``: ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``spans`` (byte intervals).

    Every byte is removed that lies in a ``span``-byte string which starts anywhere else too. With ``words``, ``n_passages``
    and ``passages`` (byte intervals) follow: runs of so many words or more that occur again, of whatever length in bytes;
    they are reported and not removed. Null texts
    are empty; texts under ``span`` bytes lose nothing. Very long texts are read in whole, a batch holding one at
    least. Repeated rows are copies of each other and come back each; null ids are kept; further columns, whatever
    their names, are ignored; an empty table gives an empty result.
    """
    interval = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": interval}
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>"
    if words:
        kinds |= {"n_passages": pa.int64(), "passages": interval}
        schema += ", n_passages long, passages array<struct<a:long,b:long>>"

    def run(batches):
        told = lambda intervals: [{"a": a, "b": b} for a, b in intervals]
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text, found, *more in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw, gone, at, kept = text.encode("utf-8", "surrogatepass"), _merged(found), 0, hashlib.sha256()
                    for a, b in gone:
                        kept.update(raw[at:a])
                        at = b
                    kept.update(raw[at:])
                    rows.append((doc, len(raw), sum(b - a for a, b in gone), len(gone), kept.hexdigest(), told(gone)))
                    for passed in more:
                        places = _word_places(raw, _merged(passed))
                        rows[-1] += (len(places), told(places))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds)
                )

    docs, row = _rows(df.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")))
    keyed = docs.select(F.col(row).alias("key"), "text")
    found = [materialize(repeats(keyed, span, gram))]
    if words:
        found.append(materialize(repeats(keyed, words, word_gram, as_words)))
    for i, one in enumerate(found):
        docs = docs.join(one.select(F.col("key").alias(row), F.col("found").alias(f"_found{i}")), row, "left")
    return docs.select("doc_id", "text", *(f"_found{i}" for i in range(len(found)))).mapInArrow(run, schema)


def passages(df: DataFrame, words: int = PASSAGE_WORDS, gram: int = PASSAGE_GRAM) -> DataFrame:
    """``doc_id`` and ``passages`` of each row that has some: intervals of words, counted from 0, that lie in runs of
    ``words`` words or more which occur again, of whatever length in bytes. Rows and texts are taken as ``removals`` does."""
    docs, row = _rows(df.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")))
    found = repeats(docs.select(F.col(row).alias("key"), "text"), words, gram, as_words)
    kind = "array<struct<a:int,b:int>>"

    @F.pandas_udf(kind)
    def joined(lists: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in _merged(list(x))] for x in lists])

    named = docs.select(F.col(row).alias("key"), "doc_id")
    return found.join(named, "key").select("doc_id", joined("found").alias("passages"))


def remove(df: DataFrame, words: int = PASSAGE_WORDS, gram: int = PASSAGE_GRAM) -> DataFrame:
    """The rows of ``df`` with repeated passages taken out of ``text``; all columns kept, in their order.

    Every word goes that lies in a run of ``words`` words which starts anywhere else too, with the white space inside the
    runs; runs of any length in bytes are found. Null texts stay null. Further columns may have any names.
    """

    @F.pandas_udf("string")
    def without(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, f in zip(texts, found, strict=True):
            if text is None:
                out.append(None)
                continue
            raw, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
            for a, b in _word_places(raw, _merged(list(f))):
                kept.append(raw[at:a])
                at = b
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    docs, row = _rows(df)
    found = materialize(repeats(docs.select(F.col(row).alias("key"), F.coalesce("text", F.lit("")).alias("text")), words, gram, as_words))
    mark = free_name(docs, "_found")
    without = without.asNondeterministic()  # else filters on the text run it again, in a worker of their own
    joined = docs.join(found.select(F.col("key").alias(row), F.col("found").alias(mark)), row, "left")
    # texts that have nothing to lose don't go to Python
    cut = without(F.when(F.col(mark).isNotNull(), F.col("text")), mark)
    return joined.withColumn("text", F.when(F.col(mark).isNull(), F.col("text")).otherwise(cut)).select(*df.columns)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"), words=PASSAGE_WORDS)
