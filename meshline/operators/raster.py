"""Sparse rasters, histograms and density grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from meshline.sources.stored import stored


def _offsets(pairs: list[tuple[int, int]]):
    return F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in pairs]))


def mask(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Distinct cells inside the raster."""
    return cells.filter((F.col("col") >= 0) & (F.col("col") < width) & (F.col("row") >= 0) & (F.col("row") < height)).select("col", "row").distinct()


def boundary_edges(cells: DataFrame) -> DataFrame:
    """Directed unit edges around cells, the cell on the left: one for each side without a neighbour."""
    sides = [(0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0)]
    names = ("dx", "dy", "ax", "ay", "bx", "by")
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s, strict=True)]) for s in sides]))
    e = cells.withColumn("s", each).select(
        (F.col("col") + F.col("s.dx")).alias("ncol"), (F.col("row") + F.col("s.dy")).alias("nrow"),
        (F.col("col") + F.col("s.ax")).alias("x"), (F.col("row") + F.col("s.ay")).alias("y"),
        (F.col("col") + F.col("s.bx")).alias("x2"), (F.col("row") + F.col("s.by")).alias("y2"),
    )
    taken = cells.select(F.col("col").alias("ncol"), F.col("row").alias("nrow"))
    return e.join(taken, ["ncol", "nrow"], "left_anti").select("x", "y", "x2", "y2")


def mask_area(edges: DataFrame) -> DataFrame:
    """The area inside all boundary edges; no order is needed."""
    return edges.agg((F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2.0).alias("area"))


def dilate(cells: DataFrame, k: int = 1, size: int = 1000) -> DataFrame:
    around = [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1)]
    grown = cells.withColumn("o", _offsets(around)).select((F.col("col") + F.col("o.dx")).alias("col"), (F.col("row") + F.col("o.dy")).alias("row"))
    return mask(grown, size, size)


def erode(cells: DataFrame, k: int = 1) -> DataFrame:
    """Cells whose whole neighbourhood is set; outside the raster counts as not set."""
    around = [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1)]
    voted = cells.withColumn("o", _offsets(around)).select((F.col("col") + F.col("o.dx")).alias("col"), (F.col("row") + F.col("o.dy")).alias("row"))
    full = voted.groupBy("col", "row").count().filter(F.col("count") == len(around))
    return full.select("col", "row")


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int = 96) -> DataFrame:
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(column) - low) / (high - low) * bins))).cast("long")
    return values.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(points: DataFrame, low: float, high: float, bins: int = 96) -> DataFrame:
    b = lambda c: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(c) - low) / (high - low) * bins))).cast("long")
    return points.groupBy(b("x").alias("bx"), b("y").alias("by")).agg(F.count("*").alias("n"))


def smooth(bins: DataFrame, kernel: list[float], size: int) -> DataFrame:
    """A histogram smoothed by a kernel, edges clamped; the kernel is quantised, so sums agree."""
    k = len(kernel) // 2
    weights = F.explode(F.array(*[F.struct(F.lit(i - k).alias("d"), F.lit(w).alias("w")) for i, w in enumerate(kernel)]))
    spread = bins.withColumn("o", weights)
    at = F.least(F.lit(size - 1), F.greatest(F.lit(0), F.col("bin") + F.col("o.d"))).cast("long")
    return spread.groupBy(at.alias("bin")).agg(F.sum(F.col("n") * F.col("o.w")).alias("n"))


def smooth_2d(grid: DataFrame, kernel: list[float], size: int) -> DataFrame:
    """A sparse grid (``bx``, ``by``, ``n``) smoothed along x, then along y; a cell beyond an edge reads as the edge's cell.

    Each cell sends its share to the few cells that read it, so empty cells cost nothing; cells that read only empty
    ones have no row.
    """
    k = len(kernel) // 2
    weights = F.explode(F.array(*[F.struct(F.lit(i).alias("to"), F.lit(j - k).alias("d"), F.lit(w).alias("w")) for i in range(-k, k + 1) for j, w in enumerate(kernel)]))
    for c in ("bx", "by"):
        other = "by" if c == "bx" else "bx"
        sent = grid.withColumn("o", weights).withColumn("target", F.col(c) + F.col("o.to"))
        reads = F.least(F.lit(size - 1), F.greatest(F.lit(0), F.col("target") + F.col("o.d"))) == F.col(c)
        heard = sent.filter(F.col("target").between(0, size - 1) & reads)
        grid = heard.groupBy(F.col("target").cast("long").alias(c), other).agg(F.sum(F.col("n") * F.col("o.w")).alias("n"))
    return grid.select("bx", "by", "n")


def cumulative(bins: DataFrame) -> DataFrame:
    """Share of all up to and including each bin; bins are few by construction."""
    w = Window.orderBy("bin")
    return bins.select("bin", (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("cdf"))


def excess(grid: DataFrame, bins: int = 96, beta: float = 0.5, cap: float = 4.0) -> DataFrame:
    """Excess density of grid cells: min(cap, (1 - beta) + beta * n / mean over all cells)."""
    total = grid.agg(F.sum("n").alias("total"))
    return grid.crossJoin(F.broadcast(total)).select("bx", "by", F.least(F.lit(cap), F.lit(1 - beta) + F.col("n") * (bins * bins) / F.col("total") * beta).alias("density"))


def scanline_spans(rings: DataFrame, ring: str = "ring") -> DataFrame:
    """Even-odd fill: spans (``row``, ``x0``, ``x1``) of each row's middle inside closed rings."""
    w = Window.partitionBy(ring).orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = rings.withColumn("x2", F.coalesce(F.lead("x").over(w), F.first("x").over(whole))).withColumn("y2", F.coalesce(F.lead("y").over(w), F.first("y").over(whole)))
    low, high = F.ceil(F.least("y", "y2") - 0.5), F.ceil(F.greatest("y", "y2") - 0.5) - 1
    c = e.filter(low <= high).withColumn("row", F.explode(F.sequence(low, high)))
    at = (F.col("x2") - F.col("x")) * (F.col("row") + 0.5 - F.col("y")) / (F.col("y2") - F.col("y")) + F.col("x")
    c = c.select(ring, "row", at.alias("at"))
    rank = Window.partitionBy(ring, "row").orderBy("at")
    pairs = c.withColumn("i", F.row_number().over(rank)).withColumn("x1", F.lead("at").over(rank)).filter("i % 2 = 1")
    return pairs.select(ring, "row", F.col("at").alias("x0"), "x1")


def components(cells: DataFrame, rounds: int = 200) -> DataFrame:
    """4-connected components of cells: ``col``, ``row``, ``component`` (smallest cell number in it).

    Labels spread to neighbours and jump to the label of their label's cell, so rounds grow slowly with the extent;
    every round is stored, which cuts its lineage.
    """
    number = F.col("row") * F.lit(1 << 20) + F.col("col")
    now = stored(cells.select(number.alias("id"), "col", "row", number.alias("label")))
    around = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]
    for _ in range(rounds):
        sent = now.withColumn("o", _offsets(around)).select(
            ((F.col("row") + F.col("o.dy")) * F.lit(1 << 20) + F.col("col") + F.col("o.dx")).alias("id"), "label"
        )
        least = sent.groupBy("id").agg(F.min("label").alias("least"))
        spread = now.join(least, "id").select("id", "col", "row", F.col("label").alias("old"), F.col("least").alias("label"))
        jump = spread.select(F.col("id").alias("label"), F.col("label").alias("jumped"))
        after = stored(spread.join(jump, "label").select("id", "col", "row", F.col("jumped").alias("label"), "old"))
        moved = after.filter("label != old").head(1)
        now = after.drop("old")
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select("col", "row", F.col("label").alias("component"))


def component_boxes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("component").agg(
        F.min("col").alias("col0"), F.min("row").alias("row0"), F.max("col").alias("col1"), F.max("row").alias("row1"), F.count("*").alias("cells")
    )
