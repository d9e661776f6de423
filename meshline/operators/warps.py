"""Warps that give crowded places more room: separable along the axes with an exact inverse, and by a displacement field.

Points are rows ``net``, ``id``, ``x``, ``y``; each network has a warp of its own, on one canvas. What a warp knows is of
a fixed size (``bins``), whatever the number of points.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from meshline.sources.stored import stored


def _kernel(sigma: float) -> list[float]:
    """Gaussian weights to three sigmas, kept to twelve digits."""
    r = max(1, math.ceil(3 * sigma))
    return [math.floor(math.exp(-(i * i) / (2 * sigma * sigma)) * 1e12 + 0.5) / 1e12 for i in range(-r, r + 1)]


def _bin(c: Column, low: float, high: float, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((c - low) / (high - low) * bins))).cast("int")


def axis_knots(points: DataFrame, axis: str, low: float, high: float, bins: int = 96, sigma: float = 2.5, beta: float = 0.7, alpha: float = 0.6, most: float = 8.0, least: float = 0.0) -> DataFrame:
    """``net``, ``rho``, ``cdf``: a network's share of room by bin, and its running sum from 0 to 1.

    A smoothed histogram (edges repeat their bins) is mixed with an even one, then cut to the shares that keep the local
    scale between ``least`` and ``most``, by clipping and dividing by the sum, 16 times or until the sum is 1.
    """
    kernel = _kernel(sigma)
    r, weight = len(kernel) // 2, sum(kernel)
    counts = points.groupBy("net", _bin(F.col(axis), low, high, bins).alias("bin")).agg(F.count("*").cast("double").alias("n"))
    per = counts.groupBy("net").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"))  # bins at most
    at = lambda i: F.coalesce(F.try_element_at("h", i.cast("int")), F.lit(0.0))
    every = F.sequence(F.lit(0), F.lit(bins - 1))
    full = per.select("net", F.transform(every, at).alias("h"))
    inside = lambda i: F.greatest(F.lit(0), F.least(F.lit(bins - 1), i))
    steps, ks = F.sequence(F.lit(-r), F.lit(r)), F.array(*[F.lit(k) for k in kernel])
    smooth = F.transform(every, lambda i: F.aggregate(steps, F.lit(0.0), lambda v, j: v + F.get("h", inside(i + j)) * F.get("ks", j + r)) / F.lit(weight))
    smoothed = full.withColumn("ks", ks).withColumn("hs", smooth)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    mixed = smoothed.withColumn("sum", total("hs")).withColumn("rho", F.transform("hs", lambda v: F.lit((1 - beta) / bins) + F.lit(beta) * v / F.col("sum")))
    cap, floor = (most - (1 - alpha)) / (alpha * bins), max(0.0, (least - (1 - alpha)) / (alpha * bins))
    clip = lambda c: F.transform(c, lambda v: F.greatest(F.lit(floor), F.least(F.lit(cap), v)))

    # each round is a column of its own: the sum is worked out once
    out = mixed.select("net", "rho")
    for _ in range(16):
        out = out.withColumn("rho", clip(F.col("rho"))).withColumn("sum", total("rho"))
        out = out.withColumn("rho", F.when(F.abs(F.col("sum") - 1) < 1e-9, F.col("rho")).otherwise(F.transform("rho", lambda v: v / F.col("sum"))))
    cdf = F.aggregate("rho", F.array(F.lit(0.0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))
    out = stored(out.select("net", "rho", cdf.alias("cdf")))
    norm = F.element_at("cdf", -1)
    return out.select("net", F.transform("rho", lambda v: v / norm).alias("rho"), F.transform("cdf", lambda v: v / norm).alias("cdf"))


def warped(value: Column, rho: Column, cdf: Column, low: float, high: float, alpha: float = 0.6) -> Column:
    """A coordinate's new place; beyond the canvas the outermost bins' scales go on."""
    bins = F.size(rho)
    t = (value - low) / (high - low)
    i = F.least(bins - 1, F.floor(t * bins)).cast("int")
    inner = F.get(cdf, i) + (t * bins - i) * F.get(rho, i)
    share = F.when(t <= 0, t * bins * F.get(rho, F.lit(0))).when(t >= 1, 1 + (t - 1) * bins * F.get(rho, bins - 1)).otherwise(inner)
    return (1 - alpha) * value + alpha * (low + (high - low) * share)


def unwarped(value: Column, rho: Column, cdf: Column, low: float, high: float, alpha: float = 0.6) -> Column:
    """The place that ``warped`` takes to ``value``: its bin by binary search over the warped bin ends, then one division."""
    bins, width = F.size(rho), high - low
    # the ends' images ascend: (1 - alpha) t + alpha cdf, in canvas widths
    image = lambda k: (1 - alpha) * k / bins + alpha * F.get(cdf, k)
    t = (value - low) / width
    halve = F.aggregate(
        F.sequence(F.lit(1), F.lit(20)), F.struct(F.lit(0).alias("lo"), bins.alias("hi")),
        lambda s, _: F.when(s["hi"] - s["lo"] <= 1, s).when(
            image(((s["lo"] + s["hi"]) / 2).cast("int")) <= t, F.struct(((s["lo"] + s["hi"]) / 2).cast("int").alias("lo"), s["hi"].alias("hi"))
        ).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).cast("int").alias("hi"))),
    )["lo"]
    k = F.when(t <= 0, 0).when(t >= 1, bins - 1).otherwise(halve)
    slope = (1 - alpha) / bins + alpha * F.get(rho, k)
    return low + width * (k / bins + (t - image(k)) / (slope * bins))


def separable(points: DataFrame, x0: float, y0: float, x1: float, y1: float, **options) -> DataFrame:
    """``net``, ``rho_x``, ``cdf_x``, ``rho_y``, ``cdf_y``: the warp of each network in the box."""
    x, y = axis_knots(points, "x", x0, x1, **options), axis_knots(points, "y", y0, y1, **options)
    named = lambda d, a: d.select("net", F.col("rho").alias(f"rho_{a}"), F.col("cdf").alias(f"cdf_{a}"))
    return named(x, "x").join(named(y, "y"), "net")


def applied(points: DataFrame, warp: DataFrame, x0: float, y0: float, x1: float, y1: float, alpha: float = 0.6, back: bool = False) -> DataFrame:
    """``points`` with ``x`` and ``y`` warped, or taken ``back``; networks without a warp stay as they are."""
    move = unwarped if back else warped
    met = points.join(warp, "net", "left")
    side = lambda a, low, high: F.when(F.col(f"rho_{a}").isNull(), F.col(a)).otherwise(move(F.col(a), F.col(f"rho_{a}"), F.col(f"cdf_{a}"), low, high, alpha))
    return met.select(*[side("x", x0, x1).alias("x") if c == "x" else side("y", y0, y1).alias("y") if c == "y" else F.col(c) for c in points.columns])


# --- displacement field ---


def _smooth(h: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Along the first axis, edges repeated."""
    r = len(kernel) // 2
    padded = np.pad(h, ((r, r), (0, 0)), mode="edge")
    return sum(k * padded[i : i + len(h)] for i, k in enumerate(kernel)) / kernel.sum()


def excess_grid(h: np.ndarray, sigma: float, beta: float, most: float) -> np.ndarray:
    """Excess density of a histogram (rows: y): smoothed, mixed with an even one, cut at ``most``, centred on 0."""
    kernel = np.array(_kernel(sigma))
    hs = _smooth(_smooth(h.T, kernel).T, kernel)
    rho = np.minimum((1 - beta) + beta * hs / (hs.mean() or 1.0), most)
    return rho - rho.mean()


def push_field(e: np.ndarray, width: float, height: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """What every cell's excess pushes at every other one: away from it, by a Gaussian of radius ``reach`` in pixels."""
    rad = max(1, math.ceil(3 * reach / min(width, height)))
    o = np.arange(-rad, rad + 1)
    dy, dx = np.meshgrid(o * height, o * width, indexing="ij")
    w = np.floor(np.exp(-(dx * dx + dy * dy) / (2 * reach * reach)) * 1e12 + 0.5) / 1e12
    b = len(e)
    out = []
    for part in (-dx * w, -dy * w):
        spread = np.pad(e, rad)
        field = np.zeros_like(e)
        for i in range(2 * rad + 1):
            for j in np.flatnonzero(part[i]):
                field += part[i, j] * spread[i : i + b, j : j + b]
        out.append(field)
    return out[0], out[1]


def safe_strength(fx: np.ndarray, fy: np.ndarray, width: float, height: float, wanted: float) -> float:
    """The most of ``wanted`` at which x + strength F(x) cannot fold: 0.9 over the greatest norm of F's gradient."""
    inner = slice(1, -1)
    grads = [(f[inner, 2:] - f[inner, :-2]) / (2 * width) for f in (fx, fy)] + [(f[2:, inner] - f[:-2, inner]) / (2 * height) for f in (fx, fy)]
    most = math.sqrt(max(float(sum(g * g for g in grads).max()), 0.0))
    return min(wanted, 0.9 / most) if most > 0 else wanted


def flow(points: DataFrame, x0: float, y0: float, x1: float, y1: float, rounds: int = 1, bins: int = 96, sigma: float = 2.5, beta: float = 0.7, alpha: float = 0.8, most: float = 8.0, reach: float | None = None) -> list[DataFrame]:
    """The displacement of each round: ``net``, ``i``, ``j`` and the moves at the cell's four corners (``x00`` to ``y11``), strength included.

    A round counts its network's points by cell, makes the field of that one grid, and moves the points on for the next.
    """
    width, height = (x1 - x0) / bins, (y1 - y0) / bins
    reach = reach or (x1 - x0) / 12
    names = [f"{a}{v}{u}" for a in "xy" for v in (0, 1) for u in (0, 1)]

    def field(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.zeros((bins, bins))
        np.add.at(h, (pdf["row"].to_numpy(), pdf["col"].to_numpy()), pdf["n"].to_numpy())
        fx, fy = push_field(excess_grid(h, sigma, beta, most), width, height, reach)
        strength = safe_strength(fx, fy, width, height, alpha)
        j, i = np.meshgrid(np.arange(bins - 1), np.arange(bins - 1), indexing="ij")
        out = {"net": pdf["net"].iloc[0], "i": i.ravel(), "j": j.ravel()}
        for a, f in (("x", fx), ("y", fy)):
            for v in (0, 1):
                for u in (0, 1):
                    out[f"{a}{v}{u}"] = (strength * f)[v : bins - 1 + v, u : bins - 1 + u].ravel()
        return pd.DataFrame(out)

    steps: list[DataFrame] = []
    for k in range(rounds):
        cells = points.groupBy("net", _bin(F.col("y"), y0, y1, bins).alias("row"), _bin(F.col("x"), x0, x1, bins).alias("col")).agg(F.count("*").alias("n"))
        kinds = "net long, i long, j long, " + ", ".join(f"{n} double" for n in names)
        steps.append(stored(cells.groupBy("net").applyInPandas(field, kinds)))  # at most bins x bins rows a network
        if k < rounds - 1:
            points = stored(moved(points, steps[-1:], x0, y0, x1, y1, bins))
    return steps


def moved(points: DataFrame, steps: list[DataFrame], x0: float, y0: float, x1: float, y1: float, bins: int = 96) -> DataFrame:
    """``points`` moved by each round's field in turn, read between the four cells around; outside the canvas the edge's holds."""
    for step in steps:
        u, v = (F.greatest(F.lit(0.0), F.least(F.lit(bins - 1.0), (F.col(c) - low) / ((high - low) / bins) - 0.5)) for c, low, high in (("x", x0, x1), ("y", y0, y1)))
        at = points.withColumn("_u", u).withColumn("_v", v)
        at = at.withColumn("i", F.least(F.lit(bins - 2), F.floor("_u"))).withColumn("j", F.least(F.lit(bins - 2), F.floor("_v")))
        met = at.join(step, ["net", "i", "j"], "left").withColumn("_u", F.col("_u") - F.col("i")).withColumn("_v", F.col("_v") - F.col("j"))
        near = lambda c, t: F.col(f"_{c}") if t else 1 - F.col(f"_{c}")
        move = lambda a: F.coalesce(sum(F.col(f"{a}{q}{p}") * near("u", p) * near("v", q) for q in (0, 1) for p in (0, 1)), F.lit(0.0))
        points = met.select(*[(F.col(c) + move(c)).alias(c) if c in ("x", "y") else F.col(c) for c in points.columns])
    return points
