"""Entry tables of networks: which nodes, stations and groups belong together, what is served, how edges are ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshline.sources.stored import dealt, stored


def node_groups(stations: DataFrame, members: DataFrame) -> DataFrame:
    """``node``, ``grp`` of the nodes of constructed ``stations(id, seq, constructed, nodes)`` by ``members(id, grp)``.

    Where several stations claim a node, the last one by ``seq`` has it. Stations without a group have no node here.
    """
    owned = stations.filter("constructed").join(members, "id").select("seq", "grp", F.explode("nodes").alias("node"))
    return owned.groupBy("node").agg(F.max_by("grp", "seq").alias("grp"))


def served_stations(stations: DataFrame, combos: DataFrame, routes: DataFrame, route_nodes: DataFrame | None = None) -> DataFrame:
    """``id`` of constructed stations with a node at an end of a combo, or among the own ``route_nodes(route, node)``, of a
    route that isn't temporary."""
    nodes = stations.filter("constructed").select("id", "seq", F.explode("nodes").alias("node")).groupBy("node").agg(F.max_by("id", "seq").alias("id"))
    real = combos.join(routes.filter("NOT temp").select("route"), "route", "left_semi")
    touched = real.select(F.explode(F.array("start_node", "end_node")).alias("node"))
    if route_nodes is not None:
        touched = touched.unionByName(route_nodes.join(routes.filter("NOT temp").select("route"), "route", "left_semi").select("node"))
    return nodes.join(touched, "node", "left_semi").select("id").distinct()


def served_members(members: DataFrame, served: DataFrame) -> DataFrame:
    """``grp``, ``served``: how many members of each group are served, groups with none included."""
    marked = members.join(served.select("id", F.lit(1).alias("one")), "id", "left")
    return marked.groupBy("grp").agg(F.count("one").alias("served"))


def resolved_groups(given: DataFrame, stations: DataFrame, built: DataFrame) -> DataFrame:
    """``grp``, ``name``, ``lng``, ``lat`` of given groups that have members and a place, else the ``built`` ones.

    ``given(grp, name, other_name, lng, lat, ids)``; a missing place is the mean of the known members, a missing name the
    other one, then the first member's, then the group's id.
    """
    known = stations.select("id", F.col("name").alias("station_name"), F.col("lng").alias("x"), F.col("lat").alias("y"))
    rows = given.select("grp", F.posexplode("ids").alias("pos", "id")).join(known, "id", "left")
    means = rows.groupBy("grp").agg(
        F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.max(F.when(F.col("pos") == 0, F.col("station_name"))).alias("first_name")
    )
    whole = F.col("lng").isNotNull() & F.col("lat").isNotNull()
    valid = given.join(means, "grp").select(
        "grp", F.coalesce(F.nullif("name", F.lit("")), F.nullif("other_name", F.lit("")), "first_name", F.col("grp").cast("string")).alias("name"),
        F.when(whole, F.col("lng")).otherwise(F.col("mean_x")).alias("lng"), F.when(whole, F.col("lat")).otherwise(F.col("mean_y")).alias("lat"),
    ).filter("lng IS NOT NULL")
    return valid if valid.head(1) else built


def upper_median(column: str) -> Column:
    """The value at place n // 2 of the ascending order, as an aggregate that Spark merges from partial ones."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def positioning_candidates(combos: DataFrame, groups: DataFrame, least: float = 10_000.0, times: float = 8.0) -> DataFrame:
    """Legs longer than ``least`` and ``times`` their route's median leg, of which no reverse leg between groups exists.

    ``groups(node, grp)``; a node without a group stands for itself.
    """
    at = lambda c, g: groups.select(F.col("node").alias(c), F.col("grp").alias(g))
    own = lambda g, c: F.coalesce(F.concat(F.lit("g"), F.col(g)), F.concat(F.lit("n"), F.col(c)))
    legs = combos.join(at("start_node", "gs"), "start_node", "left").join(at("end_node", "ge"), "end_node", "left")
    legs = legs.select("route", "start_node", "end_node", "distance", own("gs", "start_node").alias("a"), own("ge", "end_node").alias("b"))
    medians = combos.groupBy("route").agg(upper_median("distance").alias("median"))
    far = legs.join(medians, "route").filter((F.col("distance") > least) & (F.col("median") > 0) & (F.col("distance") > F.col("median") * times))
    back = legs.select("route", F.col("a").alias("b"), F.col("b").alias("a")).distinct()
    return far.join(back, ["route", "a", "b"], "left_anti").select("route", "start_node", "end_node", "distance")


def flattened(features: DataFrame) -> DataFrame:
    """``id``, ``part``, ``rings`` of ``features(id, kind, polygons)``: polygons, and each part of a multipolygon."""
    some = features.filter(F.col("kind").isin("Polygon", "MultiPolygon"))
    parts = F.when(F.col("kind") == "Polygon", F.slice("polygons", 1, 1)).otherwise(F.col("polygons"))
    return some.select("id", F.posexplode(parts).alias("part", "rings"))


def drawn(edge_lines: DataFrame, traversals: DataFrame) -> DataFrame:
    """The ``edge_lines(line, u, v)`` that are drawn: those a traversal uses, and all of lines without a traversal."""
    used = edge_lines.join(traversals.select("line", "u", "v"), ["line", "u", "v"], "left_semi")
    free = edge_lines.join(traversals.select("line"), "line", "left_anti")
    return used.unionByName(free)


def framed(points: DataFrame, key: str, margin: float, width: float, height: float) -> DataFrame:
    """Bounding box of each key's points, widened by ``margin`` and kept on the canvas: ``x``, ``y``, ``w``, ``h``."""
    b = points.groupBy(key).agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d"))
    low = lambda c: F.greatest(F.lit(0.0), F.col(c) - margin)
    high = lambda c, most: F.least(F.lit(most), F.col(c) + margin)
    sides = b.select(key, low("a").alias("x"), low("b").alias("y"), high("c", width).alias("x1"), high("d", height).alias("y1"))
    return sides.select(key, "x", "y", (F.greatest("x", "x1") - F.col("x")).alias("w"), (F.greatest("y", "y1") - F.col("y")).alias("h"))


def _over(low: str, high: str, size: float) -> Column:
    return F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))


def boxes_hit(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """``box``, ``id`` of the ``points(id, x, y)`` inside ``boxes(box, x0, y0, x1, y1)``, met by square cells of ``size``."""
    spread = boxes.withColumn("i", _over("x0", "x1", size)).withColumn("j", _over("y0", "y1", size))
    p = points.select("id", "x", "y", F.floor(F.col("x") / size).alias("i"), F.floor(F.col("y") / size).alias("j"))
    return p.join(spread, ["i", "j"]).filter("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").select("box", "id")


def boxes_met(boxes: DataFrame, size: float) -> DataFrame:
    """``a`` < ``b``: boxes that overlap or touch, met by cells; a pair is told in the first cell that both have."""
    spread = boxes.withColumn("i", _over("x0", "x1", size)).withColumn("j", _over("y0", "y1", size))
    spread = dealt(spread, boxes.count(), "i", "j", each=2_000)  # few bytes that make many pairs
    a, b = (spread.select("i", "j", *[F.col(c).alias(f"{s}_{c}") for c in ("box", "x0", "y0", "x1", "y1")]) for s in "ab")
    first = (F.col("i") == F.floor(F.greatest("a_x0", "b_x0") / size)) & (F.col("j") == F.floor(F.greatest("a_y0", "b_y0") / size))
    meet = "a_box < b_box AND a_x0 <= b_x1 AND b_x0 <= a_x1 AND a_y0 <= b_y1 AND b_y0 <= a_y1"
    return a.join(b, ["i", "j"]).filter(meet).filter(first).select(F.col("a_box").alias("a"), F.col("b_box").alias("b"))


def ranked(df: DataFrame, order: list, name: str = "rank", within: list[str] | None = None, rows: int = 1_000_000) -> DataFrame:
    """Add the place from 1 in ``order`` (which has no ties), over all rows or ``within`` columns of few values.

    Rows are dealt out by ranges of the order and numbered inside them; what lies before a range is summed from one row
    per range (and value of ``within``), so that no task gets all rows.
    """
    within = within or []
    n = max(1, -(-df.count() // rows))
    dealt = stored(df.repartitionByRange(n, *within, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(*within, "_range").count()
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*within, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*within, "_range").orderBy(*order)
    out = dealt.withColumn("_own", F.row_number().over(inside)).join(counts, [*within, "_range"])
    return out.withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_range")


def middle_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key``, ``upper_median`` (place n // 2 from 0), ``median`` of the values, by their places: no task holds a key's values."""
    placed = ranked(df.select(key, value), [value], within=[key])
    sizes = placed.groupBy(key).agg(F.max("rank").alias("n"))
    upper, lower = F.floor(F.col("n") / 2) + 1, F.floor((F.col("n") + 1) / 2)
    middle = placed.join(F.broadcast(sizes), key).filter((F.col("rank") == upper) | (F.col("rank") == lower))  # a row per key
    return middle.groupBy(key).agg(F.max(value).alias("upper_median"), ((F.min(value) + F.max(value)) / 2.0).alias("median"))


def edge_orderings(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """``method``, ``u``, ``v``, ``rank`` of ``edges(u, v, lines)`` in four orders: most lines, least straight length,
    greatest degree of an end, greatest sum of lines at an end (the other end breaks ties, then the ends' numbers)."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"), "lines").groupBy("node").agg(F.count("*").alias("deg"), F.sum("lines").alias("ldeg"))
    at = ends.join(positions, "node")
    side = lambda c: at.select(F.col("node").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in ("deg", "ldeg", "x", "y")])
    e = edges.join(side("u"), "u").join(side("v"), "v")
    length = F.sqrt(F.pow(F.col("u_x") - F.col("v_x"), 2) + F.pow(F.col("u_y") - F.col("v_y"), 2))
    pair = lambda k: (-F.greatest(f"u_{k}", f"v_{k}"), -F.least(f"u_{k}", f"v_{k}"))
    none = F.lit(0)
    keys = {"NUM_LINES": (-F.col("lines"), none), "LENGTH": (F.round(length, 9), none), "ADJ_ND_DEGREE": pair("deg"), "ADJ_ND_LDEGREE": pair("ldeg")}
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), a.cast("double").alias("k1"), b.cast("double").alias("k2")) for m, (a, b) in keys.items()]))
    listed = e.select("u", "v", rows.alias("r")).select("u", "v", "r.*")
    return ranked(listed, ["k1", "k2", "u", "v"], within=["method"]).select("method", "u", "v", "rank")


def scorecard(edges_before: DataFrame, edges_after: DataFrame, steps: DataFrame) -> DataFrame:
    """One row: share of edges saved, share of ``steps(dx, dy)`` that lie on a multiple of 45 degrees, and how many steps."""
    saved = edges_before.agg(F.count("*").alias("n")).crossJoin(edges_after.agg(F.count("*").alias("m")))  # one row each
    straight = (F.col("dx") == 0) | (F.col("dy") == 0) | (F.abs("dx") == F.abs("dy"))
    told = steps.agg(F.avg(straight.cast("int")).alias("octilinear"), F.count("*").alias("steps"))
    return saved.crossJoin(told).select((F.lit(1.0) - F.col("m") / F.col("n")).alias("edges_saved"), "octilinear", "steps")
