"""Document fingerprints by consistent weighted sampling (operator 4), with DataFrame functions only.

A text's terms are its five-word shingles, weighted by how often they occur. For a term of weight S and a sample,
hashes give r and c ~ Gamma(2, 1) and b ~ U(0, 1); t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1). The
term with the smallest a is the sample, together with its t: two texts pick the same with a probability equal to
their generalised Jaccard similarity. A term draws ``ROUNDS`` times; each draw goes to one of ``BINS`` samples of its
round, chosen by hash (one-permutation sampling); a sample that got no term takes that of the next one of its
round that has. A fingerprint is the list of ``ROUNDS * BINS`` samples, four hex digits each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from meshline.llm.shared import in_order, materialize, table

SHINGLE, ROUNDS, BINS, DIGITS = 5, 8, 8, 4
#: Bits that hold ln a (offset, in units of 2**-38) above a sample's 16 bits.
OFFSET, UNIT = 64.0, float(1 << 38)


BLANKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """A text's words; a text without any has one empty word."""
    return F.split(F.btrim(text, F.lit(BLANKS)), r"[ \t\n\x0B\f\r]+")


def n_shingles(w: Column) -> Column:
    """Fewer words than a shingle has make one shingle."""
    return F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))


def shingles(w: Column, first: Column, count: Column) -> Column:
    """Array of structs of ``count`` consecutive word shingles from number ``first`` on."""
    return F.arrays_zip(*[F.slice(w, first + (i + 1), F.greatest(count, F.lit(0))).alias(f"w{i}") for i in range(SHINGLE)])


def term() -> Column:
    return F.xxhash64(*[F.col(f"w{i}") for i in range(SHINGLE)])


def _unit_interval(h: Column, shift: int, bits: int) -> Column:
    part = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return (part.cast("double") + F.lit(0.5)) / F.lit(float(1 << bits))


def draw(term: Column, log_weight: Column, round_no: int) -> tuple[Column, Column]:
    """The bin of a term's draw, and ln a with the sample's 16 bits packed so that the least number wins."""
    one, two = F.xxhash64(term, F.lit(2 * round_no)), F.xxhash64(term, F.lit(2 * round_no + 1))
    r = -F.ln(_unit_interval(one, 0, 21) * _unit_interval(one, 21, 21))
    log_c = F.ln(-F.ln(_unit_interval(one, 42, 21) * _unit_interval(two, 0, 21)))
    b = _unit_interval(two, 21, 30)
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b + F.lit(1.0))
    bin_no = F.shiftrightunsigned(two, 51).bitwiseAND(F.lit(BINS - 1))
    name = F.xxhash64(term, t, F.lit(round_no)).bitwiseAND(F.lit(0xFFFF))
    place = ((F.greatest(log_a, F.lit(-OFFSET)) + F.lit(OFFSET)) * F.lit(UNIT)).cast("long")
    return bin_no, F.shiftleft(place, 16).bitwiseOR(name)


PLACES = [(i, b) for i in range(ROUNDS) for b in range(BINS)]


def sampled(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """The least draw of each sample over the rows (``term``, ``log_weight``) of a key, as columns ``m<round>_<bin>``."""
    drawn = weighted
    for i in range(ROUNDS):
        at, packed = draw(F.col("term"), F.col("log_weight"), i)
        drawn = drawn.withColumn(f"at{i}", at).withColumn(f"s{i}", packed)
    least = [F.min(F.when(F.col(f"at{i}") == b, F.col(f"s{i}"))).alias(f"m{i}_{b}") for i, b in PLACES]
    return drawn.groupBy(*keys).agg(*least)


def printed(sample: dict[tuple[int, int], Column]) -> Column:
    """The fingerprint's digits; an empty sample takes the next full one of its round."""

    def one(i: int, b: int) -> Column:
        full = F.coalesce(*[sample[i, (b + k) % BINS] for k in range(BINS)])
        return F.lpad(F.lower(F.hex(full.bitwiseAND(F.lit(0xFFFF)))), DIGITS, "0")

    return F.concat(*[one(i, b) for i, b in PLACES])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints."""
    n = ROUNDS * BINS
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(n - 1)),
        F.lit(0),
        lambda total, i: total
        + F.when(a.substr(i * DIGITS + 1, F.lit(DIGITS)) == b.substr(i * DIGITS + 1, F.lit(DIGITS)), 1).otherwise(0),
    )
    return same / F.lit(float(n))


def fingerprints(df: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each row's whole ``text``; null counts as empty, equal texts get equal ones.

    The general operator: no neighbours, no edits. Repeated rows come back as often as they came.
    """
    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("doc_hash", F.xxhash64("text"))
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = docs.dropDuplicates(["doc_hash"]).repartition(parts, "doc_hash").select("doc_hash", words(F.col("text")).alias("words"))
    rows = w.select("doc_hash", F.inline(shingles(F.col("words"), F.lit(0), n_shingles(F.col("words"))))).select("doc_hash", term().alias("term"))
    weighted = rows.groupBy("doc_hash", "term").agg(F.ln(F.count("*").cast("double")).alias("log_weight"))
    found = sampled(weighted, ["doc_hash"]).select("doc_hash", printed({p: F.col(f"m{p[0]}_{p[1]}") for p in PLACES}).alias("fingerprint"))
    return docs.select("doc_id", "doc_hash").join(found, "doc_hash").select("doc_id", "fingerprint")


def neighbours(keys: DataFrame) -> DataFrame:
    """Add ``next_id``, ``next_hash``: the next key in descending order; after the last comes the first.

    Ranges of bounded size are walked on their own; one row per range meets in a single task.
    """
    parts = in_order(keys, "id", "doc_hash")
    own = F.struct("id", "doc_hash")
    inside, across = Window.partitionBy("range_no").orderBy("id", "doc_hash"), Window.orderBy("range_no")
    ends = parts.groupBy("range_no").agg(F.max(own).alias("last"))
    everything = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "range_no", F.coalesce(F.lag("last").over(across), F.max("last").over(everything)).alias("before")
    )
    return (
        parts.withColumn("lower", F.lag(own).over(inside))
        .join(ends, "range_no")
        .withColumn("lower", F.coalesce("lower", "before"))
        .select(*keys.columns, F.col("lower.id").alias("next_id"), F.col("lower.doc_hash").alias("next_hash"))
    )


def with_edits(df: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited texts, and likenesses, as the query returns them.

    Documents are ordered by ``doc_id``, rows that repeat an id by a hash of their text, null ids first (as the
    smallest). Repeated rows come back as often as they came, all with one result. An empty text has edited text
    ''. Further columns are ignored. An empty table gives an empty result.
    """
    smallest = -(1 << 63)
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select(
        "doc_id", F.coalesce("doc_id", F.lit(smallest)).alias("id"), F.xxhash64("text").alias("doc_hash"), "text"
    )
    per_key = docs.select("id", "doc_hash", F.char_length("text").cast("long").alias("n_chars"))
    keys = materialize(per_key.groupBy("id", "doc_hash").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("copies")))
    chain = materialize(neighbours(keys))
    repeated = keys.agg(F.max("copies")).first()[0]
    unique = docs.select("id", "doc_hash", "text")
    if repeated and repeated > 1:
        unique = unique.dropDuplicates(["id", "doc_hash"])
    unique = unique.repartition(parts, "id", "doc_hash")
    ask = chain.select(
        F.col("id").alias("for_id"), F.col("doc_hash").alias("for_hash"), F.floor(F.col("n_chars") / 3).cast("int").alias("need"),
        F.col("next_id").alias("id"), F.col("next_hash").alias("doc_hash"),
    )
    heads = unique.join(ask, ["id", "doc_hash"]).select(
        F.col("for_id").alias("id"), F.col("for_hash").alias("doc_hash"), "need",
        F.col("text").substr(F.lit(1), F.col("need")).alias("head"),
    )
    prefix = F.col("text").substr(F.lit(1), F.char_length("text") - F.col("need"))
    both = unique.join(heads, ["id", "doc_hash"]).select("id", "doc_hash", "text", prefix.alias("prefix"), F.concat(prefix, "head").alias("edited"))
    digests = both.select("id", "doc_hash", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))

    # what lies wholly in the kept words is the same in both texts, and is drawn for once
    w = both.select("id", "doc_hash", words(F.col("text")).alias("own"), words(F.col("edited")).alias("new"), (F.size(words(F.col("prefix"))) - 1).alias("kept"))
    whole = (F.size("own") >= SHINGLE) & (F.size("new") >= SHINGLE)
    w = w.withColumn("same", F.when(whole, F.greatest(F.col("kept") - (SHINGLE - 1), F.lit(0))).otherwise(0))
    w = w.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    of = F.when(F.col("kind") == 2, F.col("new")).otherwise(F.col("own"))
    first = F.when(F.col("kind") == 0, 0).otherwise(F.col("same"))
    count = F.when(F.col("kind") == 0, F.col("same")).otherwise(n_shingles(F.col("words")) - F.col("same"))
    w = w.select("id", "doc_hash", "kind", "same", of.alias("words")).select("id", "doc_hash", "kind", F.inline(shingles(F.col("words"), first, count)))
    rows = w.select("id", "doc_hash", "kind", term().alias("term"))
    times = rows.groupBy("id", "doc_hash", "term").agg(
        F.count(F.when(F.col("kind") != 2, 1)).alias("in_own"), F.count(F.when(F.col("kind") != 1, 1)).alias("in_new")
    )
    part = lambda kind, n: F.struct(F.lit(kind).alias("kind"), F.ln(F.col(n).cast("double")).alias("log_weight"))
    parts_of = (
        F.when(F.col("in_own") == F.col("in_new"), F.array(part(0, "in_own"))).when(F.col("in_new") == 0, F.array(part(1, "in_own")))
        .when(F.col("in_own") == 0, F.array(part(2, "in_new"))).otherwise(F.array(part(1, "in_own"), part(2, "in_new")))
    )
    least = sampled(times.select("id", "doc_hash", "term", F.inline(parts_of)), ["id", "doc_hash", "kind"])
    for_text = lambda other: [F.min(F.when(F.col("kind") != other, F.col(f"m{i}_{b}"))).alias(f"{'on'[other % 2]}{i}_{b}") for i, b in PLACES]
    signed = least.groupBy("id", "doc_hash").agg(*for_text(2), *for_text(1)).select(
        "id", "doc_hash", printed({p: F.col(f"o{p[0]}_{p[1]}") for p in PLACES}).alias("fingerprint"),
        printed({p: F.col(f"n{p[0]}_{p[1]}") for p in PLACES}).alias("edited_fingerprint"),
    )
    done = materialize(signed.join(digests, ["id", "doc_hash"]))
    after = done.select(F.col("id").alias("next_id"), F.col("doc_hash").alias("next_hash"), F.col("fingerprint").alias("next_fingerprint"))
    result = done.join(chain, ["id", "doc_hash"]).join(after, ["next_id", "next_hash"])
    result = result.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return result.select(
        F.when(F.col("id") != smallest, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint",
        "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))
