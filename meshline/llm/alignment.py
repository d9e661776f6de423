"""Cross-tokenizer alignment (operator 13): tokens of two vocabularies over the same bytes, and how often ids meet.

Equal texts are brought together by a shuffle on the whole text and tokenised and aligned once; pair counts are weighted
by how many rows have the text, and its measures are joined back to all of them.

A is a byte-level BPE, B a SentencePiece BPE with byte fallback; both see a space and the text. A text is cut before
each space or line break that follows no white space. Neither vocabulary has a token across such a cut (A's
pre-tokenizer cuts there, and of B's pieces none has a space or line break after something else, which is checked when
the model is read), so both tokenisations have an end there, and the ids, groups and links of a text are those of its
cuts in turn. A cut is tokenised and aligned once for as long as a worker's memo, bounded in bytes, holds it.

Two tokens are linked where their byte ranges overlap. Every stretch between neighbouring ends of either tokenisation
lies in one token of A and one of B, and no two stretches lie in the same two, so a text has as many links as it has
distinct ends, and groups as it has ends of both.

Defined results: a null or empty text, and one whose tokens' bytes are not a space and the text (B has no mark for
U+2581, which stands for a space), has no tokens: zeros, and an empty string instead of a digest. Null, shared and
repeated ids are no matter, rows with equal texts get equal measures; texts of any length are taken whole; an empty
table gives an empty result; other columns, of any name, stay as they are.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from meshline.llm.shared import bounded_batches, free_name, materialize, slices, table
from meshline.llm.tokens import _byte_letters, gathered

#: Most id pairs whose counts are broadcast (16 bytes each and the highest count of each B id).
BROADCAST_PAIRS = 2_000_000
#: Bytes of a worker's memo of cuts.
MEMO_BYTES = 160_000_000
MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def cut_places(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where cuts start in the UTF-8 bytes ``flat``: at the texts' ``starts``, and before each space or line break that
    follows a byte that ends no white space: an ASCII letter, digit or mark, a letter of two bytes but those led by C2,
    or one of three bytes led by E4 or more."""
    at = np.flatnonzero((flat == 0x20) | (flat == 0x0A))
    at = at[at > 0]
    last, second, third = flat[at - 1], flat[np.maximum(at - 2, 0)], flat[np.maximum(at - 3, 0)]
    plain = (last > 0x20) & (last < 0x7F) | (second >= 0xC3) & (second <= 0xDF) & (last >= 0x80) | (third >= 0xE4) & (last >= 0x80) & (second >= 0x80)
    return np.union1d(starts, at[plain])


class Aligner:
    """Both tokenizers, and a memo of cuts: their counts, groups as text, and linked pairs of ids."""

    def __init__(self, path_a: str, path_b: str, most_bytes: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = {c: b for b, c in _byte_letters().items()}
        names = {i: w for w, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(letters[c] for c in names[i]) if all(c in letters for c in names.get(i, "")) and i in names else b"" for i in range(max(names) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        crossing = [p for p in pieces if "▁" in p.lstrip("▁") or "\n" in p]
        if crossing:
            raise ValueError(f"pieces with white space after something else: {crossing[:5]}")
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        self.most = most_bytes
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.counts: list[np.ndarray] = []  # n_a, n_b, n_groups, n_links and whether the bytes differ, by entry
        self.groups: list[str] = []
        self.pairs: list[np.ndarray] = []  # a << 32 | b of each link, by entry in turn
        self.taken = 0

    def _b_ids(self, cuts: list[bytes]) -> list[list[int]]:
        """B puts a space before what it reads: it is given a cut without its space, or loses that space again."""
        texts = [c.decode() for c in cuts]
        ids = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        for i, t in enumerate(texts):
            if t == " ":
                ids[i] = [self.space]  # nothing is left to read
            elif t[0] != " ":
                ids[i] = ids[i][1:] if ids[i][:1] == [self.space] else self._fail(t)
        return ids

    def _fail(self, text: str) -> list[int]:
        raise ValueError(f"no end before {text[:20]!r}")

    def _learn(self, cuts: list[bytes]) -> None:
        """Tokenise and align new cuts, all at once."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([c.decode() for c in cuts], add_special_tokens=False)]
        ids_b = self._b_ids(cuts)
        name_a, name_b = self.bytes_a, self.bytes_b
        bad = np.array([b"".join([name_a[i] for i in x]) != c or b"".join([name_b[i] for i in y]) != c for c, x, y in zip(cuts, ids_a, ids_b, strict=True)])
        for i in np.flatnonzero(bad):
            ids_a[i], ids_b[i] = [], []
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        size = np.where(bad, 0, [len(c) for c in cuts])
        end = np.cumsum(size)
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        ends = np.union1d(ends_a, ends_b)
        both = np.intersect1d(ends_a, ends_b)
        pairs = flat_a[np.searchsorted(ends_a, ends)] << 32 | flat_b[np.searchsorted(ends_b, ends)] if len(ends) else np.empty(0, np.int64)
        links = np.diff(np.searchsorted(ends, end, side="right"), prepend=0)
        groups = np.diff(np.searchsorted(both, end, side="right"), prepend=0)
        # groups as text: the first and last token of each on either side
        last_a, last_b = np.searchsorted(ends_a, both) + 1, np.searchsorted(ends_b, both) + 1
        text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        said, fa, fb = [], 0, 0
        for la, lb in zip(last_a.tolist(), last_b.tolist(), strict=True):
            said.append(f"{text_a[fa] if la - fa == 1 else ','.join(text_a[fa:la])}|{text_b[fb] if lb - fb == 1 else ','.join(text_b[fb:lb])}")
            fa, fb = la, lb
        first = 0
        for g in groups.tolist():
            self.groups.append(";".join(said[first : first + g]))
            first += g
        for c in cuts:
            self.memo[c] = len(self.memo)
        self.counts.append(np.stack([n_a, n_b, groups, links, bad.astype(np.int64)], axis=1))
        self.pairs.append(pairs)
        self.taken += 260 * len(cuts) + int(size.sum()) * 6

    def _digest(self, entries: np.ndarray, at_once: int = 100_000) -> str:
        """SHA-256 of a text's groups, some cuts at a time."""
        said = hashlib.sha256()
        for at in range(0, len(entries), at_once):
            part = ";".join([self.groups[e] for e in entries[at : at + at_once].tolist()])
            said.update((";" + part if at else part).encode())
        return said.hexdigest()

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For each text n_a, n_b, n_groups, n_links and its groups' digest; pairs of all texts in turn and their bounds."""
        spaced = pc.cast(pc.binary_join_element_wise("", pc.fill_null(texts, ""), " "), pa.large_binary())
        _, offsets, data = spaced.buffers()
        offsets = np.frombuffer(offsets, np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
        flat = np.frombuffer(data, np.uint8)[: offsets[-1]]
        starts = cut_places(flat[offsets[0] :], offsets[:-1] - offsets[0]) + offsets[0]
        bounds = np.append(np.searchsorted(starts, offsets[:-1]), len(starts))
        cuts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, offsets[-1])), data])
        coded = cuts.dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64)
        if self.taken > self.most:
            self._forget()
        known = self.memo
        if new := [c for c in names if c not in known]:
            for at in range(0, len(new), 20_000):
                self._learn(new[at : at + 20_000])
        self.counts, self.pairs = [np.concatenate(self.counts)], [np.concatenate(self.pairs)]
        counts, pairs = self.counts[0], self.pairs[0]
        entry = np.array([known[c] for c in names], np.int64)
        sums = np.add.reduceat(counts[entry[codes]], bounds[:-1]) if len(bounds) > 1 else np.zeros((0, 5), np.int64)
        none = (sums[:, 4] > 0) | (np.diff(offsets) <= 1)
        sums[none] = 0
        entries = entry[codes]
        digests = ["" if none[i] else self._digest(entries[bounds[i] : bounds[i + 1]]) for i in range(len(none))]
        ends = np.cumsum(counts[:, 3])
        kept = np.repeat(~none, np.diff(bounds))
        flat_pairs, at = gathered(pairs, ends - counts[:, 3], ends, entry[codes[kept]])
        inside = np.concatenate([[0], np.cumsum(np.where(none, 0, np.diff(bounds)))])
        return sums[:, :4], digests, flat_pairs, at[inside]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for all tasks of a Python worker."""
    return Aligner(path_a, path_b)


def _measured(path_a: str, path_b: str):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            for part in slices(batch, size=2_000_000):
                sums, digests, pairs, bounds = both.align(part.column("text"))
                text = np.repeat(np.arange(len(sums)), np.diff(bounds))
                # a text's links, a pair of ids at a time
                codes, which = np.unique(pairs, return_inverse=True)
                each, n = np.unique(text * max(1, len(codes)) + which, return_counts=True)
                owner, which = each // max(1, len(codes)), each % max(1, len(codes))
                cuts = np.searchsorted(owner, np.arange(len(sums) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v)) for v in (codes[which], n)]
                columns = [part.column("digest"), part.column("n"), *(pa.array(c) for c in sums.T), pa.array(digests, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "n", *MEASURES, "groups_sha256", "pairs", "times"])

    return measure


def distinct_texts(docs: DataFrame) -> DataFrame:
    """Each text once, with how many rows have it, brought together by the text itself; null and empty ones left out."""
    named = docs.select("text").filter("text IS NOT NULL AND text <> ''")
    return named.groupBy("text").agg(F.count("*").alias("n")).withColumn("digest", F.sha2("text", 256))


def align_texts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Each text by its SHA-256, stored: the rows that have it (``n``), its measures, and its pairs of ids (``a << 32 | b``) with how many links each has."""
    spark = docs.sparkSession
    bounded_batches(spark, 2_000_000)
    a, b = default_vocabularies()
    kinds = "digest string, n long, " + ", ".join(f"{m} long" for m in MEASURES) + ", groups_sha256 string, pairs array<long>, times array<long>"
    return materialize(distinct_texts(docs).select("text", "digest", "n").mapInArrow(_measured(path_a or a, path_b or b), kinds))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of pairs, summed within a batch."""
    for batch in batches:
        lists = batch.column("pairs")
        n = np.repeat(np.asarray(batch.column("n")), np.asarray(pc.list_value_length(lists)))
        codes, which = np.unique(np.asarray(lists.flatten()), return_inverse=True)
        total = np.zeros(len(codes), np.int64)
        np.add.at(total, which, np.asarray(batch.column("times").flatten()) * n)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(total)], ["pair", "count"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """How many links of all rows hold each pair of ids linked, and whether no pair with its B id has more."""
    counted = aligned.select("n", "pairs", "times").mapInArrow(_summed, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    best = counted.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counted.withColumn("b", b).join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``docs`` with the measures of their texts; ``_`` follows a new column's name where ``docs`` has it already.

    Counts of pairs are broadcast where there are ``broadcast_pairs`` of them at most, and else joined.
    """
    aligned = align_texts(docs, path_a, path_b)
    counts = materialize(pair_counts(aligned))
    score = _by_broadcast if counts.count() <= broadcast_pairs else _by_join
    scored = score(aligned, counts)
    names = {m: free_name(docs, m) for m in (*MEASURES, "n_best", "count_sum", "groups_sha256")}
    key = free_name(docs, "digest")
    found = scored.select(F.col("digest").alias(key), *[F.col(m).alias(f"{key}_{m}") for m in names])
    joined = docs.withColumn(key, F.sha2("text", 256)).join(found, key, "left")
    filled = [F.coalesce(f"{key}_{m}", F.lit("" if m == "groups_sha256" else 0)).alias(name) for m, name in names.items()]
    return joined.select(*docs.columns, *filled)


def _by_broadcast(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    spark = aligned.sparkSession
    told = counts.toPandas().sort_values("pair")
    held = spark.sparkContext.broadcast((told["pair"].to_numpy(), told["count"].to_numpy(), told["best"].to_numpy()))

    def score(batches):
        pair, count, best = held.value
        for batch in batches:
            lists, times = batch.column("pairs"), np.asarray(batch.column("times").flatten())
            at = np.searchsorted(pair, np.asarray(lists.flatten()))
            bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (times * best[at], times * count[at])]
            found = [pa.array(s[bounds[1:]] - s[bounds[:-1]]) for s in sums]
            rest = [c for c in batch.schema.names if c not in ("pairs", "times", "n")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *found], [*rest, "n_best", "count_sum"])

    kinds = "digest string, " + ", ".join(f"{m} long" for m in MEASURES) + ", groups_sha256 string, n_best long, count_sum long"
    return aligned.mapInArrow(score, kinds)


def _by_join(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    each = aligned.select("digest", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("digest", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    sums = each.join(counts, "pair").groupBy("digest").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    )
    return aligned.drop("pairs", "times", "n").join(sums, "digest", "left")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's alignment measures."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs).select("doc_id", *MEASURES, "n_best", "count_sum", "groups_sha256")
