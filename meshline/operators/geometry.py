"""Polyline and ring algebra over exploded rows (a key, ``seq``, ``x``, ``y``)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def _walk(key: str) -> Window:
    return Window.partitionBy(key).orderBy("seq")


def bounds(points: DataFrame, *key: str) -> DataFrame:
    return points.groupBy(*key).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def segments(lines: DataFrame, key: str = "line") -> DataFrame:
    """Consecutive points of a polyline: ``x``, ``y`` to ``x2``, ``y2``, and ``length``."""
    w = _walk(key)
    s = lines.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).filter(F.col("x2").isNotNull())
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    return s.withColumn("length", F.sqrt(dx * dx + dy * dy))


def lengths(lines: DataFrame, key: str = "line") -> DataFrame:
    return segments(lines, key).groupBy(key).agg(F.sum("length").alias("length"))


def without_repeats(lines: DataFrame, key: str = "line") -> DataFrame:
    """Points that equal the one before are dropped."""
    w = _walk(key)
    same = (F.lag("x").over(w) == F.col("x")) & (F.lag("y").over(w) == F.col("y"))
    return lines.withColumn("same", F.coalesce(same, F.lit(False))).filter(~F.col("same")).drop("same")


def ring_areas(rings: DataFrame, key: str = "ring") -> DataFrame:
    """Signed shoelace area of closed rings (the last point joins the first)."""
    w = _walk(key)
    first = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx = F.coalesce(F.lead("x").over(w), F.first("x").over(first))
    ny = F.coalesce(F.lead("y").over(w), F.first("y").over(first))
    crossed = rings.withColumn("nx", nx).withColumn("ny", ny)
    return crossed.groupBy(key).agg((F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2.0).alias("area"))


def chaikin(lines: DataFrame, key: str = "line", closed: bool = True) -> DataFrame:
    """One pass of corner cutting: two points at a quarter and three quarters of each side."""
    w = _walk(key)
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    if closed:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        nx, ny = F.coalesce(nx, F.first("x").over(whole)), F.coalesce(ny, F.first("y").over(whole))
    sides = lines.withColumn("nx", nx).withColumn("ny", ny).filter(F.col("nx").isNotNull())
    cut = sides.withColumn("t", F.explode(F.array(F.lit(0.25), F.lit(0.75))))
    at = (F.col("seq") * 2 + F.when(F.col("t") > 0.5, 1).otherwise(0)).alias("seq")
    mix = lambda a, b: F.col(a) * (F.lit(1.0) - F.col("t")) + F.col(b) * F.col("t")
    return cut.select(key, at, mix("x", "nx").alias("x"), mix("y", "ny").alias("y"))


def despike(lines: DataFrame, key: str = "line", cosine: float = -0.85) -> DataFrame:
    """One simultaneous pass: inner points where the course turns back sharply are dropped."""
    w = _walk(key)
    p = lines.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w)).withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w))
    ax, ay, bx, by = F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    norm = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    turn = F.when(norm > 0, (ax * bx + ay * by) / norm)
    return p.filter(F.coalesce(turn >= cosine, F.lit(True))).select(*lines.columns)


def points_in_rings(points: DataFrame, rings: DataFrame, side: float = 250.0) -> DataFrame:
    """Even-odd test: (point id, ring) for each point inside a ring.

    Ring edges and points meet by horizontal bands of ``side``, so a point only sees edges at its height.
    """
    w = Window.partitionBy("ring").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = rings.withColumn("x2", F.coalesce(F.lead("x").over(w), F.first("x").over(whole))).withColumn("y2", F.coalesce(F.lead("y").over(w), F.first("y").over(whole)))
    low, high = F.floor(F.least("y", "y2") / side), F.floor(F.greatest("y", "y2") / side)
    e = e.withColumn("band", F.explode(F.sequence(low, high))).select("ring", "band", "x", "y", "x2", "y2")
    p = points.select("id", F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("y") / side).alias("band"))
    met = p.join(e, "band").filter((F.col("y") > F.col("py")) != (F.col("y2") > F.col("py")))
    at = (F.col("x2") - F.col("x")) * (F.col("py") - F.col("y")) / (F.col("y2") - F.col("y")) + F.col("x")
    crossed = met.filter(F.col("px") < at).groupBy("id", "ring").agg(F.count("*").alias("n"))
    return crossed.filter(F.col("n") % 2 == 1).select("id", "ring")


def clip_half(lines: DataFrame, key: str, axis: str, bound: float, keep_above: bool) -> DataFrame:
    """One half-plane of rectangle clipping of closed rings: kept points, and crossings in place of the others."""
    other = "y" if axis == "x" else "x"
    w = _walk(key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = lines.withColumn("pa", F.coalesce(F.lag(axis).over(w), F.last(axis).over(whole))).withColumn("pb", F.coalesce(F.lag(other).over(w), F.last(other).over(whole)))
    inside = lambda c: F.col(c) >= bound if keep_above else F.col(c) <= bound
    t = (F.lit(bound) - F.col("pa")) / (F.col(axis) - F.col("pa"))
    hit = F.struct(F.lit(0).alias("k"), F.lit(bound).alias("a"), (F.col("pb") + t * (F.col(other) - F.col("pb"))).alias("b"))
    own = F.struct(F.lit(1).alias("k"), F.col(axis).alias("a"), F.col(other).alias("b"))
    out = F.when(inside(axis) & ~inside("pa"), F.array(hit, own)).when(inside(axis), F.array(own)).when(inside("pa"), F.array(hit)).otherwise(F.array().cast("array<struct<k:int,a:double,b:double>>"))
    cut = p.withColumn("o", F.explode(out)).select(key, F.col("seq").alias("_s"), F.col("o.k").alias("_k"), F.col("o.a").alias(axis), F.col("o.b").alias(other))
    return cut.select(key, F.row_number().over(Window.partitionBy(key).orderBy("_s", "_k")).cast("long").alias("seq"), "x", "y")


def clip(rings: DataFrame, x0: float, y0: float, x1: float, y1: float, key: str = "line") -> DataFrame:
    """Rings clipped to a rectangle; those left with under three points are dropped."""
    for axis, bound, above in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):
        rings = clip_half(rings, key, axis, bound, above)
    return rings.withColumn("n", F.count("*").over(Window.partitionBy(key))).filter("n >= 3").drop("n")


def segment_distance(px: Column, py: Column, x: Column, y: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Distance of a point from a segment, and where along it (0 to 1) the nearest place is."""
    dx, dy = x2 - x, y2 - y
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x) * dx + (py - y) * dy) / n))).otherwise(F.lit(0.0))
    ex, ey = px - (x + t * dx), py - (y + t * dy)
    return F.sqrt(ex * ex + ey * ey), t


def project(points: DataFrame, lines: DataFrame, key: str = "line") -> DataFrame:
    """The nearest segment of its polyline for each point (``key``, ``id``, ``px``, ``py``); the first of equals."""
    met = points.join(segments(lines, key), key)
    d, t = segment_distance(F.col("px"), F.col("py"), F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    best = met.withColumn("d", d).withColumn("t", t).groupBy(key, "id").agg(F.min(F.struct("d", "seq", "t")).alias("b"))
    return best.select(key, "id", F.col("b.d").alias("distance"), F.col("b.seq").alias("segment"), F.col("b.t").alias("t"))


def self_crossings(lines: DataFrame, key: str = "line") -> DataFrame:
    """Proper crossings of non-adjacent segments of a polyline."""
    s = segments(lines, key)
    a = s.select(key, F.col("seq").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by"))
    b = s.select(key, F.col("seq").alias("j"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("x2").alias("dx"), F.col("y2").alias("dy"))
    met = a.join(b, key).filter(F.col("j") > F.col("i") + 1)
    rx, ry, sx, sy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("dx") - F.col("cx"), F.col("dy") - F.col("cy")
    cross = rx * sy - ry * sx
    qx, qy = F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")
    t, u = (qx * sy - qy * sx) / cross, (qx * ry - qy * rx) / cross
    hit = met.filter(cross != 0).withColumn("t", t).withColumn("u", u).filter("t > 0 AND t < 1 AND u > 0 AND u < 1")
    return hit.groupBy(key).agg(F.count("*").alias("crossings"))


def at_arc(lines: DataFrame, targets: DataFrame, key: str = "line") -> DataFrame:
    """Points at given arc lengths (``targets``: key, ``arc``) along polylines; beyond the ends nothing."""
    w = _walk(key)
    s = segments(lines, key).withColumn("to", F.sum("length").over(w)).withColumn("from", F.col("to") - F.col("length"))
    met = s.join(targets, key).filter((F.col("arc") >= F.col("from")) & (F.col("arc") < F.col("to")) & (F.col("length") > 0))
    t = (F.col("arc") - F.col("from")) / F.col("length")
    return met.select(key, "arc", (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"))


def densify(lines: DataFrame, step: float, key: str = "line") -> DataFrame:
    """Equispaced points: n = max(1, round(length / step)) parts; the last end is left out."""
    n = F.greatest(F.lit(1), F.floor(F.col("length") / step + 0.5)).cast("long")
    parts = lengths(lines, key).withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return at_arc(lines, parts.select(key, "i", (F.col("length") * F.col("i") / F.col("n")).alias("arc")), key)


def decimate(lines: DataFrame, most: int = 32, key: str = "line") -> DataFrame:
    """At most ``most`` points at uniform indices round(i * (n - 1) / (most - 1))."""
    n = F.count("*").over(Window.partitionBy(key))
    at = F.row_number().over(_walk(key)) - 1
    p = lines.withColumn("n", n).withColumn("at", at)
    want = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (F.col("n") - 1) / F.lit(float(most - 1)) + 0.5))
    return p.filter((F.col("n") <= most) | F.array_contains(want, F.col("at").cast("long"))).select(*lines.columns)


def offset_points(lines: DataFrame, by: float, key: str = "line", floor: float = 0.5) -> DataFrame:
    """Polylines shifted to the side: mitred at inner points, with the miter's cosine not under ``floor``."""
    w = _walk(key)
    unit = segments(lines, key)
    nx, ny = -(F.col("y2") - F.col("y")) / F.col("length"), (F.col("x2") - F.col("x")) / F.col("length")
    normals = unit.select(key, "seq", F.when(F.col("length") > 0, nx).otherwise(0.0).alias("nx"), F.when(F.col("length") > 0, ny).otherwise(0.0).alias("ny"))
    p = lines.join(normals, [key, "seq"], "left")
    p = p.withColumn("mx", F.lag("nx").over(w)).withColumn("my", F.lag("ny").over(w))
    ax, ay = F.coalesce("mx", "nx", F.lit(0.0)), F.coalesce("my", "ny", F.lit(0.0))
    bx, by_ = F.coalesce("nx", "mx", F.lit(0.0)), F.coalesce("ny", "my", F.lit(0.0))
    sx, sy = ax + bx, ay + by_
    n = F.sqrt(sx * sx + sy * sy)
    ux, uy = F.when(n > 0, sx / n).otherwise(ax), F.when(n > 0, sy / n).otherwise(ay)
    cos = F.greatest(F.lit(floor), ux * ax + uy * ay)
    return p.select(key, "seq", (F.col("x") + ux * by / cos).alias("x"), (F.col("y") + uy * by / cos).alias("y"))


def lattice_cuts(lines: DataFrame, cell: float, key: str = "line") -> DataFrame:
    """Where segments cross multiples of ``cell`` in x: (key, seq, k, t)."""
    s = segments(lines, key).filter(F.col("x") != F.col("x2"))
    low, high = F.ceil(F.least("x", "x2") / cell), F.floor(F.greatest("x", "x2") / cell)
    c = s.filter(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
    t = (F.col("k") * F.lit(cell) - F.col("x")) / (F.col("x2") - F.col("x"))
    return c.withColumn("t", t).filter("t > 0 AND t < 1").select(key, "seq", "k", "t")


def chain_arcs(arcs: DataFrame, gap: float, key: str = "line") -> DataFrame:
    """Arcs kept in order at least ``gap`` apart: the running maximum of arc - i gap, plus i gap."""
    w = _walk(key).rowsBetween(Window.unboundedPreceding, 0)
    i = (F.row_number().over(_walk(key)) - 1) * F.lit(gap)
    return arcs.withColumn("i", i).withColumn("spread", F.max(F.col("arc") - F.col("i")).over(w) + F.col("i")).select(key, "seq", "spread")


def simplify(lines: DataFrame, eps: float, key: str = "line") -> DataFrame:
    """Douglas-Peucker by distance from the chord's line: split at the farthest point over ``eps``, the first of equals.

    The recursion depends on its own splits, so a polyline is the unit of work; each is bounded by its own points.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable", ignore_index=True)
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        kept, todo = np.zeros(len(x), bool), [(0, len(x) - 1)]
        kept[[0, -1]] = True
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            dx, dy = x[b] - x[a], y[b] - y[a]
            n = np.sqrt(dx * dx + dy * dy)
            px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
            d = np.abs(dx * py - dy * px) / n if n else np.sqrt(px * px + py * py)
            m = int(d.argmax())
            if d[m] > eps:
                kept[a + 1 + m] = True
                todo += [(a, a + 1 + m), (a + 1 + m, b)]
        return pdf[kept]

    chosen = lines.select(key, "seq", "x", "y")
    return chosen.groupBy(key).applyInPandas(keep, chosen.schema)
