"""Bodies with holes from rings, and farthest pairs: spatial joins whose pairs follow what really lies together.

Rings are rows ``ring``, ``seq``, ``x``, ``y``; the last vertex may repeat the first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from meshline.sources.stored import dealt, stored

#: Fixed value: vertices of a ring that vote on whether it lies in another one.
VOTES = 7
#: Fixed value: about so many marks are compared in one call.
PIECE = 20_000


def ring_sides(rings: DataFrame) -> DataFrame:
    """Each ring's distinct vertices, numbered ``i`` from 0 of ``n``, with the next one (``x2``, ``y2``) around it.

    Rings with under three distinct vertices are left out.
    """
    w = Window.partitionBy("ring").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = (F.first("x").over(whole) == F.col("x")) & (F.first("y").over(whole) == F.col("y"))
    closing = first & F.lead("seq").over(w).isNull() & F.lag("seq").over(w).isNotNull()
    open_ = rings.withColumn("closing", closing).filter("NOT closing")
    n = F.count("*").over(Window.partitionBy("ring"))
    told = open_.select(
        "ring", (F.row_number().over(w) - 1).cast("long").alias("i"), n.alias("n"), "x", "y",
        F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("x2"), F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("y2"),
    )
    return told.filter("n >= 3")


def ring_measures(sides: DataFrame) -> DataFrame:
    """``ring``, ``n``, ``area`` (whatever the orientation), box ``x0`` to ``y1``, and the first vertex (``ax``, ``ay``)."""
    double = F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))
    box = [F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")]
    return sides.groupBy("ring").agg(F.count("*").alias("n"), (F.abs(double) / 2.0).alias("area"), *box, F.min_by("x", "i").alias("ax"), F.min_by("y", "i").alias("ay"))


def boxes_around(measures: DataFrame) -> DataFrame:
    """``inner``, ``outer``: rings and the larger ones whose boxes hold theirs.

    A ring lies in the (at most four) cells of a grid whose side is its own size, a power of two. An inner ring is looked
    up by one corner, in the grids of its own size and above; there are as many grids as powers in use.
    """
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    level = F.when(size > 0, F.ceil(F.log2(size))).otherwise(-1000).cast("int")
    m = stored(measures.withColumn("level", level))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level")))
    o = m.withColumn("i", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("j", F.explode(F.sequence(cell("y0"), cell("y1"))))
    o = o.select("level", "i", "j", *[F.col(c).alias(f"o_{c}") for c in ("ring", "area", "x0", "y0", "x1", "y1")])
    levels = sorted(r.level for r in m.select("level").distinct().collect())  # powers of two that sizes fall under
    own = m.withColumnRenamed("level", "own").withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]))).filter("level >= own")
    met = own.withColumn("i", cell("x0")).withColumn("j", cell("y0")).join(o, ["level", "i", "j"])
    within = "ring <> o_ring AND o_area > area AND x0 >= o_x0 AND y0 >= o_y0 AND x1 <= o_x1 AND y1 <= o_y1"
    return met.filter(within).select(F.col("ring").alias("inner"), F.col("o_ring").alias("outer"))


def containments(sides: DataFrame, measures: DataFrame) -> DataFrame:
    """``inner``, ``outer``: rings that lie in a larger one, by the vote of up to ``VOTES`` vertices spread over the inner one.

    A vertex meets the outer ring's sides at its own height: a ring of n sides has about the root of n bands.
    """
    k = F.least(F.lit(VOTES), F.greatest(F.lit(1), F.col("n")))
    spread = F.exists(F.sequence(F.lit(0), k - 1), lambda s: F.floor(s * F.col("n") / k) == F.col("i"))
    votes = sides.filter(spread).select(F.col("ring").alias("inner"), "i", F.col("x").alias("px"), F.col("y").alias("py"), k.alias("k"))
    own = measures.select("ring", F.col("y0").alias("low"), F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-300)).alias("high"), F.ceil(F.sqrt("n")).alias("bands"))
    band = lambda y: F.least(F.col("bands") - 1, F.greatest(F.lit(0), F.floor((y - F.col("low")) / F.col("high") * F.col("bands"))))
    banded = sides.join(own, "ring").filter("y <> y2")
    banded = banded.withColumn("band", F.explode(F.sequence(band(F.least("y", "y2")), band(F.greatest("y", "y2")))))
    banded = banded.select(F.col("ring").alias("outer"), "band", "x", "y", "x2", "y2")
    asked = boxes_around(measures).join(votes, "inner").join(own.withColumnRenamed("ring", "outer"), "outer").withColumn("band", band(F.col("py")))
    met = asked.join(banded, ["outer", "band"]).filter("(y > py) <> (y2 > py)")
    left = F.col("px") < F.try_divide((F.col("x2") - F.col("x")) * (F.col("py") - F.col("y")), F.col("y2") - F.col("y")) + F.col("x")
    inside = met.filter(left).groupBy("inner", "outer", "i").agg(F.count("*").alias("sides"), F.first("k").alias("k")).filter("sides % 2 = 1")
    return inside.groupBy("inner", "outer").agg(F.count("*").alias("votes"), F.first("k").alias("k")).filter("votes * 2 > k").select("inner", "outer")


def decomposed(rings: DataFrame) -> DataFrame:
    """Each ring's place in bodies: ``ring``, ``area``, ``ax``, ``ay``, ``depth`` (rings around it), ``parent`` (the smallest
    of them, by number of equals; null: none), and ``body``.

    A ring at an even depth outlines a body, one at an odd depth is a hole in the body of its parent. Which rings were
    given as one feature is no matter.
    """
    sides = stored(ring_sides(rings))
    measures = stored(ring_measures(sides))
    sized = measures.select(F.col("ring").alias("outer"), F.col("area").alias("o_area"))
    held = containments(sides, measures).join(sized, "outer").groupBy("inner").agg(F.count("*").alias("depth"), F.min(F.struct("o_area", "outer"))["outer"].alias("parent"))
    told = measures.join(held, F.col("ring") == F.col("inner"), "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    return told.select("ring", "area", "ax", "ay", "depth", "parent", F.when(F.col("depth") % 2 == 0, F.col("ring")).otherwise(F.col("parent")).alias("body"))


def water_bodies(rings: DataFrame) -> DataFrame:
    """``body`` (its outline's ring), ``area`` of the outline, its first vertex (``ax``, ``ay``), and its ``holes``."""
    placed = stored(decomposed(rings))
    holes = placed.filter("depth % 2 = 1").groupBy("body").agg(F.count("*").alias("holes"))
    outer = placed.filter("depth % 2 = 0").select("body", "area", "ax", "ay")
    return outer.join(holes, "body", "left").withColumn("holes", F.coalesce("holes", F.lit(0)))


def kept_bodies(bodies: DataFrame, most: int | None = None, share: float | None = None, least: float | None = None) -> DataFrame:
    """The largest bodies: of at least ``share`` of the largest one's area, at least ``least``, at most ``most`` of them.

    Of equal areas the outline that starts farther left, then lower, comes first. Without a bound all are kept.
    """
    if share is not None:
        largest = bodies.agg(F.max("area").alias("largest"))
        bodies = bodies.crossJoin(F.broadcast(largest)).filter(F.col("area") >= F.col("largest") * share).drop("largest")  # one row
    if least is not None:
        bodies = bodies.filter(F.col("area") >= least)
    return bodies if most is None else bodies.orderBy(F.desc("area"), "ax", "ay", "body").limit(most)


# --- farthest pairs ---


def _hull(points: np.ndarray) -> np.ndarray:
    """Row numbers of the corners of the convex hull of distinct points."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    if len(order) < 3:
        return order

    def half(rows) -> list[int]:
        out: list[int] = []
        for r in rows:
            while len(out) > 1:
                a, b = points[out[-1]] - points[out[-2]], points[r] - points[out[-1]]
                if a[0] * b[1] - a[1] * b[0] > 0:
                    break
                out.pop()
            out.append(int(r))
        return out

    return np.unique(half(order) + half(order[::-1]))


def farthest_pairs(marks: DataFrame) -> DataFrame:
    """``node``, ``a``, ``b``, ``distance``: the farthest two of each node's ``marks(node, id, x, y)``, ``a`` < ``b``.

    Only corners of a hull can be farthest: of a node's marks, cut in pieces of about ``PIECE``, the corners are kept, and
    the corners of their union are compared. Many nodes come in one call; few marks are compared as they are. Of marks at one place the smallest id stands for all, of equal distances the smallest ids; where all marks
    are at one place, ``a`` and ``b`` are the same. Where marks lie on a circle, all of them are corners.
    """
    place = stored(marks.groupBy("node", "x", "y").agg(F.min("id").alias("id")))
    sizes = place.groupBy("node").agg(F.ceil(F.count("*") / PIECE).alias("pieces")).filter("pieces > 1")
    kinds = "node long, x double, y double, id long"

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[_hull(pdf[["x", "y"]].to_numpy(float))][["node", "x", "y", "id"]]

    def pair(p: np.ndarray, ids: np.ndarray) -> tuple:
        if len(p) > 500:
            kept = _hull(p)
            p, ids = p[kept], ids[kept]
        order = np.argsort(ids, kind="stable")
        p, ids = p[order], ids[order]
        best = (0.0, ids[0], ids[0])
        for i in range(len(p) - 1):  # a row at a time: memory stays that of the corners
            d = np.sqrt(((p[i + 1 :] - p[i]) ** 2).sum(axis=1))
            j = int(d.argmax())
            if d[j] > best[0]:
                best = (float(d[j]), ids[i], ids[i + 1 + j])
        return best[1], best[2], best[0]

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable", ignore_index=True)
        nodes, p, ids = pdf["node"].to_numpy(), pdf[["x", "y"]].to_numpy(float), pdf["id"].to_numpy()
        starts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
        rows = [(nodes[a], *pair(p[a:b], ids[a:b])) for a, b in zip(starts, np.r_[starts[1:], len(nodes)], strict=True)]
        return pd.DataFrame(rows, columns=["node", "a", "b", "distance"])

    crowd = place.join(sizes, "node").withColumn("piece", F.pmod(F.xxhash64("x", "y"), F.col("pieces"))).groupBy("node", "piece").applyInPandas(corners, kinds)
    left = place.join(sizes, "node", "left_anti").select("node", "x", "y", "id").unionByName(crowd)
    rows = place.count()
    bucket = F.pmod(F.xxhash64("node"), F.lit(max(1, -(-rows // PIECE))))
    return dealt(left.withColumn("bucket", bucket), rows, "bucket", each=PIECE).groupBy("bucket").applyInPandas(pairs, "node long, a long, b long, distance double")
