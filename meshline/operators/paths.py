"""Drawn and support paths of many networks: coincident runs, planar parts, contracted chains, shortest paths.

Paths are rows ``net``, ``edge``, ``seq``, ``x``, ``y``. Positions are told apart by eighths of a pixel (``vx``, ``vy``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshline.functions.scalars import half_up
from meshline.sources.stored import stored

#: Fixed value: vertices within an eighth of a pixel are one.
EIGHTHS = 8.0


def eighth(column: str) -> Column:
    return half_up(F.col(column) * EIGHTHS).cast("long")


def _steps(paths: DataFrame) -> DataFrame:
    """Path points with the next one (``x2``, ``y2``; null at the end)."""
    w = Window.partitionBy("net", "edge").orderBy("seq")
    return paths.select("net", "edge", "seq", "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))


# --- coincident runs ---


def lattice_split(paths: DataFrame, step: float) -> DataFrame:
    """Vertices of each path with a further one wherever it crosses a multiple of ``step`` in x or y; repeats are dropped.

    Crossings are absolute, so paths over the same course get the same vertices wherever their own lie.
    """
    own = _steps(paths)

    def cuts(a: str, b: str) -> Column:
        low, high, way = F.ceil(F.least(a, b) / step), F.floor(F.greatest(a, b) / step), F.col(b) - F.col(a)
        lines = F.transform(F.sequence(low, high), lambda k: (k * F.lit(step) - F.col(a)) / way)
        return F.when((F.abs(way) >= 1e-9) & (low <= high), lines).otherwise(F.array().cast("array<double>"))

    inner = F.filter(F.concat(cuts("x", "x2"), cuts("y", "y2")), lambda t: (t > 1e-9) & (t < 1 - 1e-9))
    every = F.when(F.col("x2").isNull(), F.array(F.lit(0.0))).otherwise(F.concat(F.array(F.lit(0.0)), inner))
    at = lambda a, b: F.when(F.col("t") == 0, F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * F.col("t"))
    cut = own.withColumn("t", F.explode(every)).select("net", "edge", "seq", "t", at("x", "x2").alias("x"), at("y", "y2").alias("y"))
    keyed = cut.withColumn("vx", eighth("x")).withColumn("vy", eighth("y"))
    w = Window.partitionBy("net", "edge").orderBy("seq", "t")
    same = (F.lag("vx").over(w) == F.col("vx")) & (F.lag("vy").over(w) == F.col("vy"))
    fresh = keyed.withColumn("same", F.coalesce(same, F.lit(False))).filter("NOT same").drop("same")
    return fresh.withColumn("pos", F.row_number().over(w).cast("long")).select("net", "edge", "pos", "x", "y", "vx", "vy")


def unit_segments(vertices: DataFrame) -> DataFrame:
    """``net``, ``edge``, ``pos``, ``a``, ``b``: neighbouring vertices of each path, and ``low`` <= ``high``, the same in either direction."""
    w = Window.partitionBy("net", "edge").orderBy("pos")
    here = F.struct("vx", "vy")
    s = vertices.select("net", "edge", "pos", here.alias("a"), F.lead(here).over(w).alias("b")).filter("b IS NOT NULL")
    return s.withColumn("low", F.least("a", "b")).withColumn("high", F.greatest("a", "b"))


def coincident_runs(paths: DataFrame, nodes: DataFrame, step: float) -> DataFrame:
    """Each unit segment once, in runs of neighbouring segments that the same edges draw.

    A segment belongs to the first edge by number that draws it, at its first place there. A run ends where that edge's
    segments belong to another one, where the set of ``owners`` changes, and at each of ``nodes(net, x, y)``.
    Rows: ``net``, ``edge``, ``run``, ``pos``, ``a``, ``b``, ``low``, ``high``, ``owners``. All owners of one segment
    come together; there are as many as there are paths over one place.
    """
    units = unit_segments(lattice_split(paths, step))
    owners = units.groupBy("net", "low", "high").agg(
        F.array_join(F.array_sort(F.collect_set("edge")), ",").alias("owners"), F.min(F.struct("edge", "pos")).alias("first")
    )
    at_nodes = nodes.select("net", F.struct(eighth("x").alias("vx"), eighth("y").alias("vy")).alias("a"), F.lit(True).alias("node")).distinct()
    told = units.join(owners, ["net", "low", "high"]).join(at_nodes, ["net", "a"], "left")
    own = F.col("first") == F.struct("edge", "pos")
    told = told.withColumn("own", own)
    w = Window.partitionBy("net", "edge").orderBy("pos")
    goes_on = F.coalesce(F.lag("own").over(w) & (F.lag("owners").over(w) == F.col("owners")), F.lit(False)) & F.col("node").isNull()
    runs = told.withColumn("start", F.when(F.col("own") & ~goes_on, 1).otherwise(0)).withColumn("run", F.sum("start").over(w))
    return runs.filter("own").select("net", "edge", "run", "pos", "a", "b", "low", "high", "owners")


def run_ends(runs: DataFrame) -> DataFrame:
    """One row per run: its segments, its owners, and the vertices at its ends."""
    return runs.groupBy("net", "edge", "run").agg(
        F.count("*").alias("segments"), F.first("owners").alias("owners"), F.min_by("a", "pos").alias("start"), F.max_by("b", "pos").alias("end")
    )


def run_lines(runs: DataFrame, edge_lines: DataFrame) -> DataFrame:
    """``net``, ``edge``, ``run``, ``line``: the union of the owners' lines (``edge_lines(net, edge, line)``)."""
    owners = run_ends(runs).select("net", "edge", "run", F.explode(F.split("owners", ",")).alias("owner"))
    lines = edge_lines.select("net", F.col("edge").cast("string").alias("owner"), "line")
    return owners.join(lines, ["net", "owner"]).select("net", "edge", "run", "line").distinct()


def run_chains(paths: DataFrame, runs: DataFrame, step: float) -> DataFrame:
    """``net``, ``edge``, ``pos``, ``run_edge``, ``run``, ``reversed``: the runs along each edge, told where they change."""
    units = unit_segments(lattice_split(paths, step))
    named = runs.select("net", "low", "high", F.col("a").alias("run_a"), F.col("edge").alias("run_edge"), "run")
    met = units.join(named, ["net", "low", "high"]).withColumn("reversed", F.col("a") != F.col("run_a"))
    return _changes(met.select("net", "edge", "pos", "run_edge", "run", "reversed"), ["net", "edge"], ["pos"])


def _changes(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Rows that differ from the one before in ``run_edge``, ``run`` or ``reversed``."""
    w = Window.partitionBy(*key).orderBy(*order)
    same = [F.lag(c).over(w) == F.col(c) for c in ("run_edge", "run", "reversed")]
    return rows.withColumn("same", F.coalesce(same[0] & same[1] & same[2], F.lit(False))).filter("NOT same").drop("same")


def remapped_traversals(steps: DataFrame, chains: DataFrame) -> DataFrame:
    """``net``, ``line``, ``place``, ``run_edge``, ``run``, ``reversed``: traversals ``steps(net, line, step, edge, reversed)`` over runs.

    A step backwards takes its edge's runs backwards; a run that goes on from step to step is told once.
    """
    s = steps.select("net", "line", "step", "edge", F.col("reversed").alias("back"))
    met = s.join(chains, ["net", "edge"]).withColumn("order", F.when(F.col("back"), -F.col("pos")).otherwise(F.col("pos")))
    turned = met.withColumn("reversed", F.col("reversed") != F.col("back"))
    kept = _changes(turned.select("net", "line", "step", "order", "run_edge", "run", "reversed"), ["net", "line"], ["step", "order"])
    place = F.row_number().over(Window.partitionBy("net", "line").orderBy("step", "order")).cast("long")
    return kept.select("net", "line", place.alias("place"), "run_edge", "run", "reversed")


# --- planar parts ---


#: Fixed value: so many segments of a net are compared without cells.
FEW = 256


def crossings(paths: DataFrame, side: float, margin: float = 4.0) -> DataFrame:
    """Proper crossings of different edges of a net, over ``margin`` from all their ends, as two rows each: ``edge``,
    ``d`` along it, and the crossing's key and place.

    In a net of over ``FEW`` segments they meet by square cells of ``side`` that their boxes touch; a pair is told in the
    first cell that both have. ``side`` should be of the order of a segment's length, since a longer one is in many cells.
    """
    w = Window.partitionBy("net", "edge").orderBy("seq")
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    seg = _steps(paths).filter("x2 IS NOT NULL").withColumn("length", F.sqrt(dx * dx + dy * dy))
    seg = seg.withColumn("to", F.sum("length").over(w)).withColumn("total", F.sum("length").over(Window.partitionBy("net", "edge")))
    for k, v in (("x", "i"), ("y", "j")):
        seg = seg.withColumn(f"{v}0", F.floor(F.least(k, f"{k}2") / side)).withColumn(f"{v}1", F.floor(F.greatest(k, f"{k}2") / side))
    seg = seg.withColumn("many", F.count("*").over(Window.partitionBy("net")) > FEW)
    span = lambda c: F.explode(F.when(F.col("many"), F.sequence(f"{c}0", f"{c}1")).otherwise(F.array(F.lit(0).cast("long"))))
    spread = seg.withColumn("i", span("i")).withColumn("j", span("j"))
    names = [c for c in spread.columns if c not in ("net", "i", "j")]
    a, b = (spread.select("net", "i", "j", *[F.col(c).alias(f"{s}_{c}") for c in names]) for s in "ab")
    first = ~F.col("a_many") | ((F.col("i") == F.greatest("a_i0", "b_i0")) & (F.col("j") == F.greatest("a_j0", "b_j0")))
    met = a.join(b, ["net", "i", "j"]).filter("a_edge < b_edge").filter(first)
    rx, ry, sx, sy = (F.col(f"{s}_{k}2") - F.col(f"{s}_{k}") for s in "ab" for k in "xy")
    cross = rx * sy - ry * sx
    qx, qy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    hit = met.filter(F.abs(cross) >= 1e-12).withColumn("t", F.try_divide(qx * sy - qy * sx, cross)).withColumn("u", F.try_divide(qx * ry - qy * rx, cross))
    hit = hit.filter("t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1")
    for s, t in (("a", "t"), ("b", "u")):
        hit = hit.withColumn(f"{s}_d", F.col(f"{s}_to") - F.col(f"{s}_length") + F.col(t) * F.col(f"{s}_length"))
        hit = hit.filter((F.col(f"{s}_d") > margin) & (F.col(f"{s}_d") < F.col(f"{s}_total") - margin))
    hit = hit.withColumn("px", F.col("a_x") + F.col("t") * rx).withColumn("py", F.col("a_y") + F.col("t") * ry)
    pair = F.struct("a_edge", "a_seq", "b_edge", "b_seq").alias("pair")
    both = F.explode(F.array(*[F.struct(F.col(f"{s}_edge").alias("edge"), F.col(f"{s}_d").alias("d")) for s in "ab"]))
    return hit.select("net", both.alias("e"), eighth("px").alias("vx"), eighth("py").alias("vy"), "px", "py", pair).select("net", "e.*", "vx", "vy", "px", "py", "pair")


def crossing_nodes(cuts: DataFrame) -> DataFrame:
    """One node per eighth of a pixel, where the first pair of segments by number meets there."""
    return cuts.groupBy("net", "vx", "vy").agg(F.min(F.struct("pair", "px", "py")).alias("m")).select("net", "vx", "vy", F.col("m.px").alias("x"), F.col("m.py").alias("y"))


def planar_parts(paths: DataFrame, cuts: DataFrame) -> DataFrame:
    """``net``, ``edge``, ``part``, ``d0``, ``d1`` along the edge, and the crossings at the ends (null: the edge's own end).

    Along an edge a cut less than a pixel behind the last one kept, or at the same crossing, is left out; an edge's cuts
    come together for that.
    """
    here = F.array_sort(F.collect_list(F.struct("d", "vx", "vy")))
    each = cuts.groupBy("net", "edge").agg(here.alias("cuts"))
    last = lambda kept: F.element_at(kept, -1)
    near = lambda kept, c: ((last(kept)["vx"] == c["vx"]) & (last(kept)["vy"] == c["vy"])) | (c["d"] - last(kept)["d"] < 1)
    kept = F.aggregate(F.slice("cuts", 2, F.size("cuts")), F.slice("cuts", 1, 1), lambda acc, c: F.when(near(acc, c), acc).otherwise(F.concat(acc, F.array(c))))
    end = lambda d: F.array(F.struct(d.alias("d"), F.lit(None).cast("long").alias("vx"), F.lit(None).cast("long").alias("vy")))
    totals = _totals(paths).join(each.withColumn("kept", kept), ["net", "edge"], "left")
    none = F.slice(end(F.lit(0.0)), 1, 0)
    stops = F.concat(end(F.lit(0.0)), F.coalesce("kept", none), end(F.col("total")))
    cut = totals.withColumn("stops", stops).withColumn("part", F.explode(F.sequence(F.lit(0), F.size("stops") - 2)))
    at = lambda k, c: F.col("stops")[F.col("part") + k][c]
    ends = [at(k, c).alias(f"{c}{k}") for k in (0, 1) for c in ("vx", "vy")]
    return cut.select("net", "edge", F.col("part").cast("long").alias("part"), at(0, "d").alias("d0"), at(1, "d").alias("d1"), *ends)


def _totals(paths: DataFrame) -> DataFrame:
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    return _steps(paths).groupBy("net", "edge").agg(F.coalesce(F.sum(F.sqrt(dx * dx + dy * dy)), F.lit(0.0)).alias("total"))


def sliced(paths: DataFrame, parts: DataFrame) -> DataFrame:
    """The points of each part: ``net``, ``edge``, ``part``, ``seq``, ``x``, ``y``.

    Every segment tells, by itself, which parts begin, end, or have a vertex on it.
    """
    w = Window.partitionBy("net", "edge").orderBy("seq")
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    seg = _steps(paths).filter("x2 IS NOT NULL").withColumn("length", F.sqrt(dx * dx + dy * dy))
    last = F.lead("seq").over(w).isNull()
    seg = seg.withColumn("to", F.sum("length").over(w)).withColumn("end", last).withColumn("first", F.lag("seq").over(w).isNull())
    seg = seg.withColumn("from", F.col("to") - F.col("length"))
    met = seg.join(parts.select("net", "edge", "part", "d0", "d1"), ["net", "edge"]).filter("d0 <= to AND d1 >= from")
    # an arc lies on the first segment that reaches it
    on = lambda d: ((F.col(d) > F.col("from")) | F.col("first")) & ((F.col(d) <= F.col("to")) | F.col("end"))
    share = lambda d: F.when(F.col("length") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(d) - F.col("from")) / F.col("length")))).otherwise(0.0)
    point = lambda rank, arc, x, y: F.struct(F.lit(rank).alias("rank"), arc.alias("arc"), x.alias("x"), y.alias("y"))
    cut = lambda rank, d: F.when(on(d), point(rank, F.col(d), F.col("x") + share(d) * (F.col("x2") - F.col("x")), F.col("y") + share(d) * (F.col("y2") - F.col("y"))))
    inner = F.when((F.col("to") > F.col("d0") + 1e-9) & (F.col("to") < F.col("d1") - 1e-9), point(1, F.col("to"), F.col("x2"), F.col("y2")))
    listed = F.filter(F.array(cut(0, "d0"), inner, cut(2, "d1")), lambda p: p.isNotNull())
    each = met.select("net", "edge", "part", F.col("seq").alias("own"), F.explode(listed).alias("p"))
    seq = F.row_number().over(Window.partitionBy("net", "edge", "part").orderBy("p.rank", "p.arc", "own")) - 1
    return each.select("net", "edge", "part", seq.cast("long").alias("seq"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))


# --- contraction of chains ---


def _doubled(darts: DataFrame) -> DataFrame:
    """Darts with their chain's end, by pointer doubling.

    ``darts``: ``net``, ``edge``, ``way`` (0: from a to b), ``tail``, ``head``, ``inner`` (the chain goes on at ``head``) and the
    dart that follows (``next_edge``, ``next_way``). A round doubles what a dart has seen of its chain: its ``end``, its
    ``last`` edge, how many darts are ``left`` behind this one, and the two greatest inner nodes (``top``). Where a chain
    goes round in a ring, ``done`` stays false, and all its darts come to know its two greatest nodes.
    """
    top = F.when(F.col("inner"), F.array("head")).otherwise(F.array().cast("array<long>"))
    now = stored(darts.select("net", "edge", "way", "tail", F.col("head").alias("end"), F.col("edge").alias("last"), F.lit(0).cast("long").alias("left"),
                              (~F.col("inner")).alias("done"), top.alias("top"), "next_edge", "next_way", F.lit(True).alias("fresh")))
    open_ = now.filter("NOT done").count()
    while open_:
        ahead = now.select("net", F.col("edge").alias("next_edge"), F.col("way").alias("next_way"), *[F.col(c).alias(f"n_{c}") for c in ("end", "last", "left", "done", "top")],
                           F.col("next_edge").alias("n_edge"), F.col("next_way").alias("n_way"))
        going = now.filter("NOT done").join(ahead, ["net", "next_edge", "next_way"])
        both = F.slice(F.sort_array(F.array_union("top", "n_top"), asc=False), 1, 2)
        moved = going.select("net", "edge", "way", "tail", F.col("n_end").alias("end"), F.col("n_last").alias("last"), (F.col("left") + F.col("n_left") + F.lit(1)).alias("left"),
                             F.col("n_done").alias("done"), both.alias("top"), F.col("n_edge").alias("next_edge"), F.col("n_way").alias("next_way"),
                             (both != F.col("top")).alias("fresh"))
        now = stored(now.filter("done").unionByName(moved))
        before = open_
        open_, fresh = now.agg(F.count_if(~F.col("done")), F.count_if(~F.col("done") & F.col("fresh"))).first()
        # chains that end lose open darts in each round; what is left are rings, whose greatest nodes have gone round
        if open_ == before and not fresh:
            break
    return now


def _darts(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Both directions of ``edges(net, edge, a, b)``; a chain goes on at heads that aren't ``anchors(net, node)``."""
    ways = [F.struct(F.lit(k).alias("way"), F.col(t).alias("tail"), F.col(h).alias("head")) for k, t, h in ((0, "a", "b"), (1, "b", "a"))]
    d = edges.select("net", "edge", F.explode(F.array(*ways)).alias("d")).select("net", "edge", "d.*")
    d = d.join(anchors.select("net", F.col("node").alias("head"), F.lit(False).alias("inner")).distinct(), ["net", "head"], "left")
    d = d.withColumn("inner", F.coalesce("inner", F.lit(True)))
    nxt = d.select("net", F.col("tail").alias("head"), F.col("edge").alias("next_edge"), F.col("way").alias("next_way"))
    met = d.filter("inner").join(nxt, ["net", "head"]).filter("edge <> next_edge")
    rest = d.filter("NOT inner").withColumn("next_edge", F.lit(None).cast(d.schema["edge"].dataType)).withColumn("next_way", F.lit(None).cast("int"))
    return met.select(rest.columns).unionByName(rest)


def chain_anchors(edges: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Nodes that stay: of a degree other than two, with unlike ``lines`` on their two edges, or ``protected(net, node)``."""
    ends = edges.select("net", F.explode(F.array("a", "b")).alias("node"), "lines")
    per = ends.groupBy("net", "node").agg(F.count("*").alias("degree"), F.min("lines").alias("l"), F.max("lines").alias("m"))
    kept = per.filter("degree <> 2 OR l <> m").select("net", "node")
    return kept if protected is None else kept.unionByName(protected.select("net", "node")).distinct()


def contracted(edges: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Chains of ``edges(net, edge, a, b, lines)`` through nodes of degree two with equal lines, in order.

    ``net``, ``chain`` (its first edge), ``place``, ``edge``, ``reversed``, ``start``, ``end``. No chain comes back to its
    start: of a loop at one node the greatest inner node stays, of a ring without any the two greatest, as if nodes were
    taken out one by one in ascending order. A chain starts at its smaller end, between equal ends at its smaller edge.
    """
    edges = stored(edges)
    anchors = stored(chain_anchors(edges, protected))
    walked = _doubled(_darts(edges, anchors))
    loops = walked.join(anchors.withColumnRenamed("node", "tail"), ["net", "tail"], "left_semi").filter("done AND end = tail AND left > 0")
    more = loops.select("net", F.explode(F.slice("top", 1, 1)).alias("node")).unionByName(walked.filter("NOT done").select("net", F.explode("top").alias("node")))
    anchors = stored(anchors.unionByName(more.distinct()))
    walked = _doubled(_darts(edges, anchors))
    # an edge's two darts look both ways: what one of them ends at is where the other one's chain starts
    away = walked.groupBy("net", "edge").agg(*[F.max_by(c, F.when(F.col("way") == k, 1)).alias(f"{c}{k}") for k in (0, 1) for c in ("end", "last", "left")])
    forth = F.struct("end1", "last1") <= F.struct("end0", "last0")
    pick = lambda c: F.when(forth, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    other = F.when(forth, F.col("end0")).otherwise(F.col("end1"))
    return away.select("net", pick("last").alias("chain"), pick("left").alias("place"), "edge", (~forth).alias("reversed"), pick("end").alias("start"), other.alias("end"))


def chain_points(points: DataFrame, chains: DataFrame) -> DataFrame:
    """``net``, ``chain``, ``seq``, ``x``, ``y``: the points of each chain's edges (``points(net, edge, seq, x, y)``) in turn, shared ends once."""
    met = points.join(chains, ["net", "edge"]).withColumn("order", F.when(F.col("reversed"), -F.col("seq")).otherwise(F.col("seq")))
    w = Window.partitionBy("net", "chain").orderBy("place", "order")
    joint = F.col("place") > F.lag("place").over(w)
    kept = met.withColumn("joint", F.coalesce(joint, F.lit(False))).filter("NOT joint")
    return kept.select("net", "chain", (F.row_number().over(w) - 1).cast("long").alias("seq"), "x", "y")


# --- shortest paths ---


def shortest(edges: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """``net``, ``line``, ``source``, ``node``, ``distance``, ``via``: least distances up to ``most`` from each source, within a line.

    ``edges(net, line, edge, a, b, length)`` are taken in both directions; a line's edges are its own, and one line stands
    for all where no line binds. Lengths are positive, so that ``via``, the last edge (the smallest of equals), leads back
    to the source. Nodes whose distance has fallen are the next round's frontier; every round is stored.
    """
    if edges.filter("NOT length > 0").head(1):
        raise ValueError("lengths must be positive")
    there = edges.select("net", "line", "edge", F.col("a").alias("node"), F.col("b").alias("to"), "length")
    both = stored(there.unionByName(edges.select("net", "line", "edge", F.col("b").alias("node"), F.col("a").alias("to"), "length")))
    key = ["net", "line", "source", "node"]
    best = stored(sources.select("net", "line", F.col("node").alias("source"), "node").distinct().withColumn("distance", F.lit(0.0))
                  .withColumn("via", F.lit(None).cast(edges.schema["edge"].dataType)).withColumn("fresh", F.lit(True)))
    while best.filter("fresh").head(1):
        front = best.filter("fresh").select("net", "line", "source", "node", F.col("distance").alias("so_far"))
        reach = front.join(both, ["net", "line", "node"]).withColumn("distance", F.col("so_far") + F.col("length")).filter(F.col("distance") <= most)
        found = reach.select("net", "line", "source", F.col("to").alias("node"), F.struct("distance", F.col("edge").alias("via")).alias("new"), F.lit(None).cast("double").alias("old"))
        known = best.select(*key, F.struct("distance", "via").alias("new"), F.col("distance").alias("old"))
        least = known.unionByName(found).groupBy(*key).agg(F.min("new").alias("m"), F.max("old").alias("old"))
        fresh = F.col("old").isNull() | (F.col("m.distance") < F.col("old"))
        best = stored(least.select(*key, F.col("m.distance").alias("distance"), F.col("m.via").alias("via"), fresh.alias("fresh")))
    return best.drop("fresh")


def traced(best: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``net``, ``line``, ``source``, ``target``, ``back`` (0: the last step), ``edge``, ``reversed``: the steps to ``targets(net, line, source, node)``.

    Targets are followed back over ``via``, all at once; those that aren't reached have no steps.
    """
    ends = edges.select("net", "line", F.col("edge").alias("via"), "a", "b")
    hops = stored(best.filter("via IS NOT NULL").join(ends, ["net", "line", "via"]))
    at = stored(targets.select("net", "line", "source", F.col("node").alias("target"), "node"))
    steps, back = None, 0
    while True:
        step = at.join(hops, ["net", "line", "source", "node"])
        step = stored(step.select("net", "line", "source", "target", F.lit(back).cast("long").alias("back"), F.col("via").alias("edge"), (F.col("a") == F.col("node")).alias("reversed"),
                                  F.when(F.col("a") == F.col("node"), F.col("b")).otherwise(F.col("a")).alias("node")))
        if not step.head(1):
            break
        steps = step if steps is None else steps.unionByName(step)
        at, back = step.select("net", "line", "source", "target", "node"), back + 1
    return (steps if steps is not None else step).drop("node")
