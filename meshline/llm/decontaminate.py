"""Benchmark decontamination by SimHash of item-sized windows (operator 3), with DataFrame functions only.

A benchmark item of n words is looked for in every run of n words of a document that could match it: the runs
that put a five-word shingle shared with the item where the item has it. (A run without any shared shingle has
similarity 0, so this leaves out nothing that counts.) Each such window gets a 64-bit SimHash of its weighted
shingles. Fingerprints are cut into ``BLOCKS`` blocks; two within ``RADIUS`` bits agree up to
``RADIUS // BLOCKS`` bits on at least one block, so items are indexed under all values that near to each of their
blocks, and every fingerprint within the radius is met. What is met is verified: the exact weighted Jaccard
similarity of the shingle counts of window and item has to reach ``SIMILAR``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meshline.llm.shared import free_name, materialize, row_key, table

SHINGLE, SIMILAR = 5, 0.8
#: A similarity of 0.8 is 9 to 10 differing bits on average, with a deviation of 3; 27 bits lie over five above.
RADIUS, BLOCKS, BITS = 27, 8, 64
#: Items are broadcast up to this many shingles, and joined by shuffle beyond.
BROADCAST_SHINGLES = 2_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(w: Column) -> Column:
    """Structs of consecutive words; none where there are fewer than ``SHINGLE`` words."""
    n = F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(w, i + 1, n).alias(f"w{i}") for i in range(SHINGLE)])


def _hash(prefix: str = "") -> Column:
    return F.xxhash64(*[F.col(f"{prefix}w{i}") for i in range(SHINGLE)])


def shingle_rows(df: DataFrame, key: str) -> DataFrame:
    """``key``, ``at`` (first word's number) and ``h`` of every shingle."""
    rows = df.select(key, F.posexplode(_shingles(F.col("words"))).alias("at", "s"))
    return rows.select(key, "at", F.xxhash64(*[F.col(f"s.w{i}") for i in range(SHINGLE)]).alias("h"))


def simhash_columns(h: Column, weight: Column) -> Column:
    """64-bit SimHash of a group's weighted hashes: a bit is 1 if over half of the weight has it set."""
    total = F.sum(weight)
    bit = lambda i: F.when(
        F.sum(F.when(h.bitwiseAND(F.lit(_one(i))) != 0, weight).otherwise(0)) * 2 > total, F.lit(_one(i))
    ).otherwise(F.lit(0))
    out = bit(0)
    for i in range(1, BITS):
        out = out.bitwiseOR(bit(i))
    return out


def _one(i: int) -> int:
    return 1 << i if i < 63 else -(1 << 63)


def _block(fp: Column, b: int) -> Column:
    width = BITS // BLOCKS
    return F.shiftrightunsigned(fp, b * width).bitwiseAND(F.lit((1 << width) - 1))


def find(docs: DataFrame, items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``doc_id``, ``item_id``, ``at_word``, ``similarity`` of the best window of each contaminated document and item.

    The first of equally good windows is given. Items under five words (or null) are no evidence and match nothing;
    null or short documents match nothing; very long ones are read in whole. Of rows that share a ``doc_id``, each text
    is looked at for itself, and the best window of any counts; of items that share an ``item_id`` likewise. Rows with a
    null ``doc_id`` or ``item_id`` are left out. Further columns, whatever their names, are ignored; an empty table on
    either side gives an empty result.
    """
    rows = docs.filter(F.col("doc_id").isNotNull()).select(row_key(docs).alias("row"), "doc_id", "text")
    found = windows_found(rows, items.filter(F.col("item_id").isNotNull()), similar)
    ids = rows.select("row", F.col("doc_id").alias("id")).join(found.select("row").distinct(), "row", "left_semi").distinct()
    best = found.join(ids, "row").groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.max(F.struct("similarity", -F.col("start"))).alias("b"))
    return best.select(
        "doc_id", "item_id", F.greatest(-F.col("b.col2"), F.lit(0)).cast("long").alias("at_word"),
        F.round("b.similarity", 6).alias("similarity"),
    )


def windows_found(rows: DataFrame, items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``row``, ``item_id``, ``start``, ``similarity`` of the best window for each row of ``rows(row, text)`` and item.

    Equal rows (one ``row`` and text) count as one. ``start`` may be negative where an item's head is missing.
    """
    docs = rows.select(F.col("row").alias("doc_id"), words(F.col("text")).alias("words"))
    bench = items.select("item_id", words(F.col("text")).alias("words"))
    # texts that share an id are items of their own until the end
    bench = bench.filter(F.size("words") >= SHINGLE).withColumn("n", F.size("words"))
    bench = bench.select(F.xxhash64("item_id", F.col("item_id").isNull(), "words").alias("of"), "item_id", "words", "n").dropDuplicates(["of"])
    names = bench.select("of", F.col("item_id").alias("name"))
    bench = bench.select(F.col("of").alias("item_id"), "words", "n")
    grams = materialize(
        shingle_rows(bench, "item_id").join(bench.select("item_id", "n"), "item_id")
        .groupBy("item_id", "n", "h").agg(F.collect_set("at").alias("places"), F.count("*").alias("weight"))
    )
    n_grams = grams.count()
    small = n_grams <= BROADCAST_SHINGLES
    near = (lambda d: F.broadcast(d)) if small else (lambda d: d)

    # shared shingles, then the windows that line up with them
    known = grams.select("h").distinct()
    rows = shingle_rows(docs, "doc_id")
    hits = materialize(rows.join(near(known), "h", "left_semi").dropDuplicates(["doc_id", "at", "h"]))
    aligned = hits.join(near(grams.select("h", "item_id", "n", "places")), "h")
    aligned = aligned.select("doc_id", "item_id", "n", "at", F.explode("places").alias("place"))
    aligned = aligned.select("doc_id", "item_id", "n", (F.col("at") - F.col("place")).alias("start"))
    windows = materialize(aligned.groupBy("doc_id", "item_id", "n", "start").agg(F.count("*").alias("lined")))

    # the texts of the few documents that have windows
    wanted = windows.select("doc_id").distinct()
    texts = docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    cut = windows.select("doc_id", "n", "start").distinct().join(texts, "doc_id")
    begin = F.greatest(F.col("start"), F.lit(0))
    cut = cut.select("doc_id", "n", "start", F.slice("words", begin + 1, F.col("n") + F.least(F.col("start"), F.lit(0))).alias("words"))
    cut = cut.filter(F.size("words") >= SHINGLE)
    grains = cut.select("doc_id", "n", "start", F.inline(_shingles(F.col("words"))))
    grains = grains.select("doc_id", "n", "start", _hash().alias("h"))
    grains = materialize(grains.groupBy("doc_id", "n", "start", "h").agg(F.count("*").alias("weight")))
    marked = grains.groupBy("doc_id", "n", "start").agg(simhash_columns(F.col("h"), F.col("weight")).alias("fp"), F.sum("weight").alias("total"))

    own = grams.groupBy("item_id", "n").agg(simhash_columns(F.col("h"), F.col("weight")).alias("item_fp"), F.sum("weight").alias("item_total"))
    own = materialize(own)
    width = BITS // BLOCKS
    flips = [sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(width), r)]
    index = own.select("*", F.posexplode(F.array(*[_block(F.col("item_fp"), b) for b in range(BLOCKS)])).alias("block", "value"))
    index = index.withColumn("flip", F.explode(F.array(*[F.lit(f).cast("long") for f in flips])))
    index = index.select("item_id", "n", "item_fp", "item_total", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    probes = marked.select("*", F.posexplode(F.array(*[_block(F.col("fp"), b) for b in range(BLOCKS)])).alias("block", "value"))
    # an item is compared with the windows that line up with it
    probes = probes.join(windows.select("doc_id", "item_id", "n", "start"), ["doc_id", "n", "start"])
    met = probes.join(index, ["item_id", "n", "block", "value"])
    met = met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    met = met.groupBy("doc_id", "n", "start", "item_id").agg(F.max("total").alias("total"), F.max("item_total").alias("item_total"))

    # exact weighted Jaccard: sum of the smaller weights over the sum of the larger ones
    weights = grams.select("item_id", "h", F.col("weight").alias("item_weight"))
    shared = met.join(grains, ["doc_id", "n", "start"]).join(near(weights), ["item_id", "h"])
    scored = shared.groupBy("doc_id", "item_id", "start").agg(
        F.sum(F.least("weight", "item_weight")).alias("both"), F.max(F.col("total") + F.col("item_total")).alias("all")
    )
    scored = scored.withColumn("similarity", F.col("both") / (F.col("all") - F.col("both"))).filter(F.col("similarity") >= similar)
    scored = materialize(scored).join(names, F.col("item_id") == F.col("of"))
    best = scored.select(F.col("doc_id").alias("row"), F.col("name").alias("item_id"), F.struct("similarity", (-F.col("start")).alias("back")).alias("b"))
    best = best.groupBy("row", "item_id").agg(F.max("b").alias("b"))
    return best.select("row", "item_id", (-F.col("b.back")).alias("start"), F.col("b.similarity").alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` in whose own text no benchmark item was found, those with null or repeated ids included.

    All columns are kept, whatever their names; items with a null id count too.
    """
    key = free_name(docs, "_row")
    keyed = docs.withColumn(key, row_key(docs))
    found = windows_found(keyed.select(F.col(key).alias("row"), "text"), items, similar)
    gone = materialize(found.select(F.col("row").alias(key)).distinct())
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same by brute force over the lined-up windows: no fingerprints, every window compared with its item.
ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
bw AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 5),
ds AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)),
bs AS (SELECT item_id, n, i - 1 AS pos, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, n, w, unnest(range(1, len(w) - 3)) AS i FROM bw)),
windows AS (SELECT DISTINCT d.doc_id, b.item_id, b.n, d.pos - b.pos AS start FROM ds d JOIN bs b USING (s)),
inside AS (SELECT x.doc_id, x.item_id, x.start, d.s, count(*) AS k FROM windows x JOIN ds d ON d.doc_id = x.doc_id AND d.pos >= x.start AND d.pos <= x.start + x.n - 5 GROUP BY ALL),
item AS (SELECT item_id, s, count(*) AS k FROM bs GROUP BY ALL),
both_ AS (SELECT i.doc_id, i.item_id, i.start, sum(least(i.k, t.k)) AS m FROM inside i JOIN item t ON t.item_id = i.item_id AND t.s = i.s GROUP BY ALL),
sizes AS (SELECT doc_id, item_id, start, sum(k) AS k FROM inside GROUP BY ALL),
totals AS (SELECT item_id, sum(k) AS k FROM item GROUP BY ALL),
scored AS (SELECT b.doc_id, b.item_id, b.start, b.m::DOUBLE / (s.k + t.k - b.m)::DOUBLE AS similarity FROM both_ b JOIN sizes s USING (doc_id, item_id, start) JOIN totals t ON t.item_id = b.item_id)
SELECT doc_id, item_id, greatest(min(start) FILTER (WHERE similarity = best), 0)::BIGINT AS at_word, round(max(similarity), 6) AS similarity
FROM (SELECT *, max(similarity) OVER (PARTITION BY doc_id, item_id) AS best FROM scored WHERE similarity >= 0.8) GROUP BY doc_id, item_id"""
