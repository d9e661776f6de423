"""Nodes near places, spurs of traversals, and labels under cutouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from meshline.operators.labels import LETTER
from meshline.operators.layout import nearest, nearest_by


def nearest_serving(points: DataFrame, nodes: DataFrame, node_lines: DataFrame, radius: float) -> DataFrame:
    """``id``, ``node``, ``serves``: for each of ``points(id, line, x, y)`` the nearest of ``nodes(id, x, y)`` that its line
    has an edge at (``node_lines(node, line)``), within three times ``radius``; else the nearest of all within ``radius``.

    Of equally near nodes the smallest. Points far from every node are left out.
    """
    served = nodes.select("id", "x", "y").join(node_lines.select(F.col("node").alias("id"), "line").distinct(), "id")
    own = nearest_by(points, served, 3 * radius, "line").select("id", F.col("node").alias("own"))
    other = nearest(points, nodes, radius).select("id", "node")
    both = own.join(other, "id", "full")
    return both.select("id", F.coalesce("own", "node").alias("node"), F.col("own").isNotNull().alias("serves"))


def grid_candidates(points: DataFrame, closed: DataFrame, cell: float, columns: int, rows: int, most: float) -> DataFrame:
    """``id``, ``place``, ``col``, ``row``: the open grid nodes nearer than ``most`` cells to ``points(id, x, y)``, nearest first.

    ``closed(col, row)`` are taken; of equally near nodes the one in the earlier column, then row, comes first.
    """
    span = lambda c, n: F.sequence(F.greatest(F.lit(0), F.floor(F.col(c) / cell - most)), F.least(F.lit(n - 1), F.ceil(F.col(c) / cell + most)))
    on = (F.col("x") > -most * cell) & (F.col("x") < (columns - 1 + most) * cell) & (F.col("y") > -most * cell) & (F.col("y") < (rows - 1 + most) * cell)
    each = points.filter(on).withColumn("col", F.explode(span("x", columns))).withColumn("row", F.explode(span("y", rows)))
    dx, dy = F.col("col") * cell - F.col("x"), F.col("row") * cell - F.col("y")
    near = each.withColumn("d", F.sqrt(dx * dx + dy * dy)).filter(F.col("d") < most * cell).join(closed.select("col", "row").distinct(), ["col", "row"], "left_anti")
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "col", "row")).cast("long")
    return near.select("id", place.alias("place"), "col", "row")


def without_spurs(steps: DataFrame, stops: DataFrame) -> DataFrame:
    """``net``, ``line``, ``place``, ``edge``, ``reversed``: ``steps(net, line, step, edge, reversed)`` without there-and-back pairs
    over one edge, again and again, but where the line stops at its far end (``stops(net, line, edge, at_from, at_to)``).

    A step and the last one left before it go together, so each traversal is read once; its steps come together for that.
    """
    flags = stops.groupBy("net", "line", "edge").agg(F.max("at_from").alias("at_from"), F.max("at_to").alias("at_to"))
    met = steps.join(flags, ["net", "line", "edge"], "left")
    far = F.coalesce(F.when(F.col("reversed"), F.col("at_from")).otherwise(F.col("at_to")), F.lit(False))
    per = met.groupBy("net", "line").agg(F.array_sort(F.collect_list(F.struct("step", "edge", "reversed", far.alias("far")))).alias("all"))
    last = lambda left: F.element_at(left, -1)
    back = lambda left, s: (F.size(left) > 0) & (last(left)["edge"] == s["edge"]) & (last(left)["reversed"] != s["reversed"]) & ~last(left)["far"]
    none = F.slice("all", 1, 0)
    left = F.aggregate("all", none, lambda acc, s: F.when(back(acc, s), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s))))
    return per.select("net", "line", F.posexplode(left).alias("place", "s")).select("net", "line", F.col("place").cast("long").alias("place"), "s.edge", "s.reversed")


def label_boxes(labels: DataFrame, scale: float = 1.0) -> DataFrame:
    """``id``, ``ax``, ``ay``, box: what the text of ``labels(id, text, ax, ay, x, y, size, align)`` covers in the world.

    A text stands on its place's baseline: four fifths of its size above, one below; ``align`` is left, center or right.
    """
    ox, oy, w, h = F.col("ax") + F.col("x") * scale, F.col("ay") + F.col("y") * scale, F.length("text") * F.lit(LETTER * scale), F.col("size") * scale
    left = F.when(F.col("align") == "center", ox - w / 2).when(F.col("align") == "right", ox - w).otherwise(ox)
    return labels.select("id", "ax", "ay", left.alias("x0"), (oy - h * 0.8).alias("y0"), (left + w).alias("x1"), (oy + h * 0.2).alias("y1"))


def hidden_labels(boxed: DataFrame, cutouts: DataFrame, side: float) -> DataFrame:
    """``id`` of the labels whose place lies in one of ``cutouts(x0, y0, x1, y1)``, or whose box overlaps one; they meet by cells."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / side), F.floor(F.col(b) / side)))
    cut = cutouts.withColumn("i", span("x0", "x1")).withColumn("j", span("y0", "y1"))
    cut = cut.select("i", "j", *[F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")])
    # the place may lie outside the label's box
    wide = boxed.withColumns({"l": F.least("x0", "ax"), "t": F.least("y0", "ay"), "r": F.greatest("x1", "ax"), "b": F.greatest("y1", "ay")})
    met = wide.withColumn("i", span("l", "r")).withColumn("j", span("t", "b")).join(cut, ["i", "j"])
    under = "(ax BETWEEN o_x0 AND o_x1 AND ay BETWEEN o_y0 AND o_y1) OR (x0 < o_x1 AND x1 > o_x0 AND y0 < o_y1 AND y1 > o_y0)"
    return met.filter(under).select("id").distinct()
