"""Fingerprints of a network's inputs: djb2 digests of texts joined in order, without bringing the texts together.

djb2 is a polynomial in 33 modulo 2**32, so the digest of a joined text follows from each piece's own value, its length,
and how many characters come after it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshline.functions.scalars import half_up
from meshline.sources.stored import stored

#: The digest's start, factor and modulus, and the version of the fingerprint's layout.
START, FACTOR, MASK, VERSION = 5381, 33, (1 << 32) - 1, 6
#: 33 is 1 + 2**5, so its powers modulo 2**32 repeat after 2**27.
PERIOD_BITS, DIGIT = 27, 9


def _times(a: Column, b: Column) -> Column:
    """A product modulo 2**32 that never leaves 64 bits."""
    high = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(MASK), 16)
    return (high + a * b.bitwiseAND(0xFFFF)).bitwiseAND(MASK)


def _power(n: Column) -> Column:
    """33 to the ``n``, modulo 2**32, by three digits of ``DIGIT`` bits of ``n``, whose powers are listed."""
    out = None
    for low in range(0, PERIOD_BITS, DIGIT):
        listed = F.expr(f"array({', '.join(f'{pow(FACTOR, k << low, 1 << 32)}L' for k in range(1 << DIGIT))})")
        own = F.get(listed, F.shiftright(n, low).bitwiseAND((1 << DIGIT) - 1).cast("int"))
        out = own if out is None else _times(out, own)
    return out


def _value(text: Column) -> Column:
    """A text's polynomial, from 0."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: (h * FACTOR + F.ascii(c)).bitwiseAND(MASK))


def _hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 8, "0")


def digest(text: Column) -> Column:
    """djb2 of one text as eight hexadecimal digits (characters beyond the basic plane count once)."""
    return _hex((_times(_power(F.char_length(text).cast("long")), F.lit(START)) + _value(text)).bitwiseAND(MASK))


def joined_digests(texts: DataFrame, separator: str, rows_per_range: int = 1_000_000) -> DataFrame:
    """``key``, ``hash``: djb2 of each key's ``texts(key, place, text)`` joined by ``separator`` in the order of ``place``.

    Rows are dealt by ranges of their order: a range tells its value and length for each key, and only these meet.
    """
    n = max(1, -(-texts.count() // rows_per_range))
    sized = texts.select("key", "place", F.char_length("text").cast("long").alias("length"), _value(F.col("text")).alias("value"))
    dealt = stored(sized.repartitionByRange(n, "key", "place").withColumn("range", F.spark_partition_id()))
    gap = len(separator)
    after = lambda *by: Window.partitionBy("key", *by)

    def shifted(df: DataFrame, w: Window) -> DataFrame:
        """Values moved up by what comes behind them in the window."""
        # the whole less what lies up to the row: a sum over what follows would be made anew for each row
        size = F.sum(F.col("length") + gap)
        behind = size.over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - size.over(w.rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumn("behind", behind).withColumn("value", _times(_power(F.col("behind")), F.col("value")))

    # each piece but a key's last is followed by the separator, whose own value stands below it
    mark = reduce(lambda h, c: (h * FACTOR + ord(c)) & MASK, separator, 0)
    rows = shifted(dealt, after("range").orderBy("place"))
    marked = F.col("value") + F.when(F.col("behind") > 0, _times(_power(F.col("behind") - gap), F.lit(mark))).otherwise(0)
    parts = rows.withColumn("value", marked).groupBy("key", "range").agg(
        (F.sum("value") % (MASK + 1)).alias("value"), (F.sum(F.col("length") + gap) - gap).alias("length")
    )
    whole = shifted(parts, after().orderBy("range"))
    marked = F.col("value") + F.when(F.col("behind") > 0, _times(_power(F.col("behind") - gap), F.lit(mark))).otherwise(0)
    sums = whole.withColumn("value", marked).groupBy("key").agg((F.sum("value") % (MASK + 1)).alias("value"), (F.sum(F.col("length") + gap) - gap).alias("length"))
    return sums.select("key", _hex((_times(_power(F.col("length")), F.lit(START)) + F.col("value")).bitwiseAND(MASK)).alias("hash"))


def number(c: Column) -> Column:
    """A number as text, whole ones without a point."""
    return F.regexp_replace(c.cast("string"), "\\.0$", "")


def place_text(lng: Column, lat: Column) -> Column:
    """Coordinates to five digits."""
    return F.concat(number(half_up(lng, 5)), F.lit(","), number(half_up(lat, 5)))


def fingerprints(keys: DataFrame, parts: dict[str, DataFrame], plain: dict[str, Column]) -> DataFrame:
    """``key``, a digest for each of ``parts(key, place, text)`` and of ``plain`` (texts of columns of ``keys``), and ``fp`` over all.

    A key without rows in a part has the digest of the empty text there. Only ``key`` and the digests are returned.
    """
    out = keys
    for name, texts in parts.items():
        out = out.join(joined_digests(texts, ";").withColumnRenamed("hash", name), "key", "left").withColumn(name, F.coalesce(name, F.lit(f"{START:08x}")))
    for name, text in plain.items():
        out = out.withColumn(name, digest(text))
    names = [*parts, *plain]
    whole = digest(F.concat_ws("|", F.lit(str(VERSION)), *names))
    return out.select("key", *names, F.concat(F.lit(f"v{VERSION}-"), whole).alias("fp"))
