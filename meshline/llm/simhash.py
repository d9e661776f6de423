"""SimHash near-duplicates by the generalised pigeonhole principle (operator 10).

Whole texts become 64-bit majority fingerprints. Distinct fingerprints within a radius are linked:

* the bits are grouped into partitions, correlated bits together (statistics of a bounded sample);
* each partition gets its own threshold; thresholds may differ and may be -1 (unused), and sum to
  ``radius - partitions + 1``, so that any two fingerprints within the radius agree on at least one partition up
  to its threshold. Dynamic programming picks the thresholds with the least estimated work;
* partition values are probed with all values within the threshold, and each candidate is verified;
* a partition value that many fingerprints share would make a square number of pairs. All fingerprints that
  meet there are linked through common values one bit away instead (two words differ in at most 2 bits exactly
  when both are at most one bit from a third), which is exact for radius 2 and linear in their number.

The sample decides only how much work the search does, never its result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meshline.llm.graph import connected_components
from meshline.llm.shared import free_name, materialize, row_key, slices, table

BITS = 64


def shingle_hashes(text: str, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words (ASCII lower case, ASCII white space), repeats included."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    pairs = zip(starts[: 1 - shingle].tolist(), (starts[shingle:] - 1).tolist(), strict=False)
    return np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64, len(words) - shingle + 1)


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; a text without words has fingerprint 0."""
    h = shingle_hashes(text, shingle, seed)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(df: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id`` and ``fp`` (64 bits as a signed long) of each row's whole ``text``; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fps = [fingerprint(t or "", shingle, seed) for t in part.column("text").to_pylist()]
                signed = np.array(fps, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(signed)], names=["doc_id", "fp"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def bit_groups(bits: np.ndarray, n: int) -> list[list[int]]:
    """``n`` groups of about equal size; each grows from a free bit by the bits most correlated with it."""
    centred = bits - bits.mean(axis=0) if len(bits) else np.zeros((1, BITS))
    scale = np.sqrt((centred**2).sum(axis=0)) + 1e-9
    near = np.abs(centred.T @ centred / np.outer(scale, scale))
    free, groups = list(range(BITS)), []
    for i in range(n):
        group = [free.pop(0)]
        while len(group) < BITS // n + (i < BITS % n):
            best = max(free, key=lambda b: (near[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def thresholds(close: list[list[float]], widths: list[int], radius: int, rows: int) -> tuple[float, list[int]]:
    """Least work and the thresholds for it; ``close[i][t]``: share of pairs within ``t`` bits on partition i.

    Work counts probes made and candidates expected. A table over (partitions so far, sum so far) holds the best.
    """
    need, best = radius - len(widths) + 1, {0: (0.0, [])}
    for i, width in enumerate(widths):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (work, chosen) in best.items():
            for t in range(-1, radius + 1):
                own = 0.0 if t < 0 else rows * ball(width, t) + rows * rows / 2 * close[i][t]
                if total + t not in step or work + own < step[total + t][0]:
                    step[total + t] = (work + own, [*chosen, t])
        best = step
    return best[need]


def plan(sample: np.ndarray, rows: int, radius: int = 2) -> list[tuple[list[int], int]]:
    """Bit groups and their thresholds for ``rows`` distinct fingerprints, by a bounded sample of them."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for n in range(max(1, min(2, radius)), radius + 3):
        groups = bit_groups(bits, n)
        close = []
        for g in groups:
            if len(bits) > 1:
                x, y = bits[:-1, g], bits[1:, g]
                p = np.clip(np.vstack([x, y]).mean(axis=0), 0.02, 0.98)
                spread = np.array([1.0])  # distance of two independent values, bit by bit
                for q in 2 * p * (1 - p):
                    spread = np.convolve(spread, [1 - q, q])
                close.append([float(spread[: t + 1].sum()) for t in range(radius + 1)])
            else:
                close.append([ball(len(g), t) / 2.0 ** len(g) for t in range(radius + 1)])
        work, chosen = thresholds(close, [len(g) for g in groups], radius, rows)
        if best is None or work < best[0]:
            best = work, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(bits) -> int:
    """Bit 0 is the most significant one, as in the printed fingerprint."""
    return _signed(sum(1 << (BITS - 1 - b) for b in bits))


def links(fps: DataFrame, radius: int = 2, sample_rows: int = 4096, dense: int = 32) -> DataFrame:
    """Links ``a``, ``b`` that join distinct fingerprints ``fp`` as all pairs within ``radius`` would.

    A pair found by a probe is emitted itself; where over ``dense`` fingerprints share a partition value they are
    linked through their smallest common neighbour, which keeps every component and makes a link a row at most.
    """
    spark = fps.sparkSession
    if radius > 2:
        raise ValueError("crowded values are linked exactly for radius 0 to 2 only")
    if radius == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    rows = fps.count()
    some = fps.orderBy(F.xxhash64("fp")).limit(sample_rows).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    parts = plan(some, rows, radius)

    keyed = probed = None
    for i, (bits, t) in enumerate(parts):
        own = fps.select(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("key"), "fp")
        keyed = own if keyed is None else keyed.unionByName(own)
        flips = [_mask(c) for r in range(t + 1) for c in combinations(bits, r)]
        if len(flips) > 1:
            own = own.withColumn("flip", F.explode(F.array(*[F.lit(f) for f in flips])))
            own = own.select("part", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), "fp")
        probed = own if probed is None else probed.unionByName(own)
    keyed, probed = materialize(keyed), materialize(probed)
    crowded = materialize(keyed.groupBy("part", "key").count().filter(F.col("count") > dense).select("part", "key"))
    meets = ["part", "key"]
    quiet = materialize(keyed.join(crowded, meets, "left_anti"))
    pairs = (
        probed.withColumnRenamed("fp", "a")
        .join(quiet.withColumnRenamed("fp", "b"), meets)
        .filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    near = materialize(probed.join(crowded, meets, "left_semi").select("fp").distinct())
    one_off = [0, *(_mask([b]) for b in range(BITS))]
    if radius == 1:  # neighbours at one bit are listed outright
        direct = near.select("fp", F.explode(F.array(*[F.lit(f) for f in one_off])).alias("flip"))
        direct = direct.select(F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("flip")).alias("b"))
        found = direct.join(near.select(F.col("fp").alias("b")), "b", "left_semi").filter("a < b").select("a", "b")
    else:
        spread = near.select("fp", F.explode(F.array(*[F.lit(f) for f in one_off])).alias("flip"))
        spread = spread.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"), "fp")
        hubs = materialize(
            spread.groupBy("middle").agg(F.min("fp").alias("hub"), F.max("fp").alias("top")).filter("hub < top")
        )
        found = spread.join(hubs, "middle").filter("fp > hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return materialize(pairs.unionByName(found.distinct()))


def near_duplicates(df: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of each row of ``df(doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` that can be reached over links between fingerprints at most
    ``radius`` bits apart. Equal fingerprints are always linked. A null or wordless text has fingerprint 0; a row
    with a null ``doc_id`` takes part and gets the smallest id it reaches (null if there is none). Repeated rows
    come back as often as they came; further columns are ignored; an empty table gives an empty result.
    """
    marked = materialize(fingerprints(df, shingle, seed))
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    labels = connected_components(links(fps.select("fp"), radius))
    linked = fps.join(labels, fps.fp == labels.id, "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("component")
    )
    linked = materialize(linked)
    ids = materialize(linked.groupBy("component").agg(F.min("least_id").alias("component_id")))
    of_fp = materialize(linked.join(ids, "component").select("fp", "component_id"))
    return marked.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# --- documents that are similar as wholes -------------------------------------------------------------------------


BANDS, LEAST = 16, 3


def band_fingerprints(hashes: np.ndarray, bands: int = BANDS, least: int = LEAST) -> list[int]:
    """SimHashes of small samples of a text's distinct shingles: per band, of its ``least`` smallest hashes.

    Two texts with shingle similarity s agree on a band with about s ** least; a text with too few shingles for
    a band has it from what there is.
    """
    distinct = np.unique(hashes)
    band = (distinct >> np.uint64(64 - bands.bit_length() + 1)).astype(np.int64)
    mixed = distinct * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    out = []
    for b in range(bands):
        own = np.sort(mixed[band == b])[:least]
        if len(own):
            bits = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            fp = int.from_bytes(np.packbits(bits * 2 > len(own)).tobytes(), "big")
            out.append((fp & ~(2 * bands - 1)) | (2 * b) | 1)
    return out


#: One in so many documents has its shingles counted, shingles kept of them, and rows of a shingle and size that meet in one task.
SAMPLE, FREQUENT, TOGETHER = 6, 200_000, 1_000


def frequent_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes (ascending) that one in ``SAMPLE`` documents holds more than once, and their counts in it: the most frequent ones.

    The share is the same at every size, so a shingle's crowd is known from the same number of rows on. They decide only
    which shingles count as rare, so how much work the search does, never its result.
    """

    def hashes(batches):
        for batch in batches:
            for part in slices(batch, size=1_000_000):
                each = [np.unique(shingle_hashes(t or "", shingle)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each).view(np.int64))], names=["h"])

    counts = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(hashes, "h long").groupBy("h").count()
    counts = materialize(counts.filter("count > 1"))
    # how many shingles have each count tells which ones are kept, so that no more than these come to the driver; of the
    # last count a share of them by hash
    tiers = counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).limit(FREQUENT).collect()
    least, share, left = tiers[-1]["count"] if tiers else 0, 1.0, FREQUENT
    for tier in tiers:
        if tier["n"] > left:
            least, share = tier["count"], left / tier["n"]
            break
        left -= tier["n"]
    wanted = (F.col("count") > least) | ((F.col("count") == least) & (F.pmod("h", F.lit(1_000_000)) < share * 1_000_000))
    rows = counts.filter(wanted).toPandas()
    h, n = rows["h"].to_numpy(np.int64).view(np.uint64), rows["count"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def rare_prefix(distinct: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similar: float) -> np.ndarray:
    """The rarest of a text's ``distinct`` (ascending) shingles, rarest first, in an order common to all texts.

    Two texts whose similarity is at least ``similar`` share one of these; the smaller of them has it so early that
    it and what follows is at least ``2 * similar / (1 + similar)`` of its shingles.
    """
    known, counts = frequent
    weight = np.zeros(len(distinct), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
        weight = np.where(known[at] == distinct, counts[at], 0)
    return distinct[np.argsort(weight, kind="stable")][: int(len(distinct) * (1 - similar) + 1e-6) + 1]


def similar_documents(df: DataFrame, shingle: int = 5, similar: float = 0.8) -> DataFrame:
    """``doc_id`` and ``component_id`` of each distinct id of ``df``: documents linked by shingle similarity.

    Documents are linked if the Jaccard similarity of their sets of ``shingle``-word shingles, counted exactly, is at
    least ``similar``. Equal texts (after lower-casing A-Z and joining words with one blank) are linked first and
    compared once. Texts whose SimHash fingerprints (operator 10's, of three words) are linked, at two or fewer differing
    bits, are compared (``fingerprint_pairs``). Texts that share the SimHash of a band of their shingles are compared with the band's first one and
    with a neighbour by size, which links most groups at a cost that grows with rows. What these leave apart is then
    joined on the rarest shingles of each text (``rare_links``), which misses no pair, and compared too.
    Texts without words are equal to each other. Null ids are left out; a repeated id takes part with its smallest text.
    """

    def marks(batches):
        for batch in batches:
            for part in slices(batch, size=500_000):
                rows = []
                common = sent.value
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = (text or "").encode().lower().split()
                    h = np.unique(shingle_hashes(text or "", shingle))
                    bands = np.array(band_fingerprints(h), np.uint64).view(np.int64)
                    fp = _signed(fingerprint(text or ""))
                    rows.append((doc, xxhash.xxh3_128_digest(b" ".join(words)), len(h), bands, rare_prefix(h, common, similar).view(np.int64), fp))
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "same", "n", "bands", "rare", "fp"]
                )

    def alike(batches):
        sets: dict[str, np.ndarray] = {}  # a hub's text comes up again and again
        held = 0

        def of(text: str) -> np.ndarray:
            nonlocal held
            if text not in sets:
                if held > 4_000_000:
                    sets.clear()
                    held = 0
                sets[text] = np.unique(shingle_hashes(text, shingle))
                held += len(text)
            return sets[text]

        for batch in batches:
            for part in slices(batch, "text_b", 1_000_000):
                keep = []
                for x, y in zip(part.column("text_a").to_pylist(), part.column("text_b").to_pylist(), strict=True):
                    x, y = of(x or ""), of(y or "")
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= similar * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    docs = df.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    sent = df.sparkSession.sparkContext.broadcast(frequent_shingles(docs, shingle))
    marked = materialize(docs.mapInArrow(marks, "doc_id long, same binary, n long, bands array<long>, rare array<long>, fp long"))
    repeated = bool(marked.groupBy("doc_id").count().filter("count > 1").head(1))

    def verified(pairs: DataFrame) -> DataFrame:
        ends = materialize(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
        texts = docs.join(ends, "doc_id", "left_semi")  # read twice rather than stored
        texts = texts.groupBy("doc_id").agg(F.min("text").alias("text")) if repeated else texts
        both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(alike, "a long, b long"))

    first = materialize(marked.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp")))
    banded = first.select("rep", "n", F.explode("bands").alias("band"))
    hubs = materialize(banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("k")).filter("k > 1"))
    shared = materialize(banded.join(hubs, "band").select("band", "hub", "rep", "n", "k"))
    to_hub = shared.filter("rep > hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    # neighbours in order of size; crowded bands are walked in slices, so that no task gets a whole one
    walk = shared.withColumn("slice", F.when(F.col("k") <= 64, F.lit(0)).otherwise(F.pmod(F.xxhash64("rep"), F.ceil(F.col("k") / 64))))
    step = Window.partitionBy("band", "slice").orderBy("n", "rep")
    beside = walk.select(F.lag("rep").over(step).alias("a"), F.col("rep").alias("b")).filter("a IS NOT NULL")
    beside = beside.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(to_hub.unionByName(beside).unionByName(fingerprint_pairs(first)).distinct())
    labels = connected_components(verified(pairs))
    labelled = materialize(first.join(labels, first.rep == labels.id, "left").select("same", "rep", F.coalesce("component", "rep").alias("part")))
    rare = materialize(marked.join(labelled.withColumnRenamed("rep", "doc_id"), ["same", "doc_id"]).select(F.col("doc_id").alias("rep"), "part", "n", "rare"))
    more = verified(rare_links(rare, similar))
    parts = labelled.groupBy("rep").agg(F.min("part").alias("part"))
    ends = more.join(parts.select(F.col("rep").alias("a"), F.col("part").alias("part_a")), "a")
    ends = ends.join(parts.select(F.col("rep").alias("b"), F.col("part").alias("part_b")), "b")
    wider = connected_components(materialize(ends.select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))))
    labelled = materialize(labelled.join(wider, F.col("part") == wider.id, "left").select("same", F.coalesce("component", "part").alias("component_id")))
    return marked.join(labelled, "same").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def fingerprint_pairs(first: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of ``first(rep, fp)``: each text with the first one of its fingerprint, and the first ones of
    fingerprints that ``links`` joins."""
    fps = materialize(first.groupBy("fp").agg(F.min("rep").alias("hub")))
    same = first.join(fps, "fp").filter("rep > hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    hub = lambda end: fps.select(F.col("fp").alias(end), F.col("hub").alias(f"hub_{end}"))
    near = links(fps.select("fp")).join(hub("a"), "a").join(hub("b"), "b")
    return same.unionByName(near.select(F.least("hub_a", "hub_b").alias("a"), F.greatest("hub_a", "hub_b").alias("b")))


def rare_links(rare: DataFrame, similar: float) -> DataFrame:
    """Pairs ``a``, ``b`` of different parts of ``rare(rep, part, n, rare)`` that may be similar; misses none that are.

    The first shingle two texts share in the common order has at most ``left`` shingles from it on in either, and a
    similarity of ``similar`` needs ``similar / (1 + similar)`` of both sizes in common: so the smaller text has it
    among its first few, and a text looks only for smaller sizes that leave enough. Sizes are cut to classes that the
    larger text names outright, and what is left of a crowded shingle and class is dealt out by row.
    """
    need, slack = similar / (1 + similar), 1e-6
    rows = rare.select("rep", "part", "n", F.posexplode("rare").alias("at", "token"))
    spread = rows.groupBy("token").agg(F.min("part").alias("least"), F.max("part").alias("top")).filter("least < top").select("token")
    live = materialize(rows.join(materialize(spread), "token").withColumn("left", F.col("n") - F.col("at")))
    size = lambda n: F.floor(F.log(n.cast("double")) * 20)  # noqa: E731  (classes 5 % wide; rises with n)
    small = live.filter(F.col("left") + slack >= F.col("n") * 2 * need).withColumn("size", size(F.col("n")))
    held = small.groupBy("token", "size").agg(F.ceil(F.count("*") / TOGETHER).alias("deals"))
    most = F.floor(F.least(F.col("n").cast("double"), (F.col("left") + slack) / need - F.col("n")))
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * similar - slack))
    large = live.withColumn("most", most).filter(F.col("most") >= least)
    large = large.withColumn("size", F.explode(F.sequence(size(least), size(F.col("most")))))
    held = materialize(held)
    large = large.join(held, ["token", "size"]).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
    small = small.join(held, ["token", "size"]).withColumn("deal", F.pmod(F.xxhash64("rep"), F.col("deals")))
    x = small.select("token", "size", "deal", F.col("rep").alias("x"), F.col("part").alias("part_x"), F.col("n").alias("n_x"), F.col("left").alias("left_x"))
    y = large.select("token", "size", "deal", F.col("rep").alias("y"), F.col("part").alias("part_y"), F.col("n").alias("n_y"), F.col("left").alias("left_y"))
    apart = (F.col("part_x") != F.col("part_y")) & (F.col("n_x") <= F.col("n_y"))
    enough = F.least("left_x", "left_y") + slack >= (F.col("n_x") + F.col("n_y")) * need
    met = x.join(y, ["token", "size", "deal"]).filter(apart & enough)
    return materialize(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def without_near_duplicates(df: DataFrame, shingle: int = 5, similar: float = 0.8) -> DataFrame:
    """The rows of ``df`` that come first in their group of near duplicates: smallest id, null ids last.

    Rows are told apart by id and text: equal ones are copies, of which one stays; rows that share an id or have none
    are compared by their texts like any others. Further columns may have any names; an empty table gives an empty one.
    """
    key = free_name(df, "_key")
    keyed = df.withColumn(key, row_key(df))
    twice = keyed.groupBy(key).count().filter("count > 1").head(1)
    if twice:  # stored, so that which of the equal rows stays is settled once
        keyed = materialize(keyed.dropDuplicates([key]))
    plain = df.select("doc_id").groupBy("doc_id").count().agg(F.max("count").alias("most"), F.max(F.col("doc_id").isNull()).alias("null")).first()
    if not twice and plain["most"] in (None, 1) and not plain["null"]:
        groups = similar_documents(df, shingle, similar)
        gone = materialize(groups.filter("component_id < doc_id").select("doc_id"))
        gone = gone.select(F.col("doc_id").alias(key))
        return df.join(gone, F.col("doc_id") == F.col(key), "left_anti")
    groups = similar_documents(keyed.select(F.col(key).alias("doc_id"), "text"), shingle, similar)
    ids = keyed.select(F.col(key).alias("k"), F.col("doc_id").alias("id"))
    first = groups.join(ids, F.col("doc_id") == F.col("k")).groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "k")).alias("f"))
    stay = materialize(first.select(F.col("f.k").alias(key)))
    return keyed.join(stay, key, "left_semi").select(*df.columns)
