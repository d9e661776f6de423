"""Stations, route visits, undirected edges and lines of transit networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meshline.operators.entry import ranked
from meshline.sources.stored import dealt, stored

EARTH = 6371000.0


def quantised(x: Column, unit: float = 1e9) -> Column:
    """Rounded half up to 1/unit, so that transcendental results agree between engines."""
    return F.floor(x * F.lit(unit) + F.lit(0.5)) / F.lit(unit)


def metres_between(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Equirectangular distance with a quantised cosine of the mean latitude."""
    k = quantised(F.cos((lat1 + lat2) / 2.0 * F.lit(3.141592653589793 / 180.0)))
    rad = F.lit(3.141592653589793 / 180.0)
    dx, dy = (lng2 - lng1) * rad * k * F.lit(EARTH), (lat2 - lat1) * rad * F.lit(EARTH)
    return F.sqrt(dx * dx + dy * dy)


def station_groups(stations: DataFrame) -> DataFrame:
    """Constructed stations by group: name of the first by id, mean position, member count."""
    return (
        stations.filter("constructed").groupBy("grp")
        .agg(F.min_by("name", "id").alias("name"), F.avg("lng").alias("lng"), F.avg("lat").alias("lat"), F.count("*").alias("members"))
    )


def visits(stops: DataFrame) -> DataFrame:
    """Consecutive calls at one group become one visit, a stop if any of them stops (gaps and islands)."""
    w = Window.partitionBy("route").orderBy("seq")
    new = F.when(F.lag("grp").over(w) == F.col("grp"), 0).otherwise(1)
    islands = stops.withColumn("new", new).withColumn("visit", F.sum("new").over(w))
    return islands.groupBy("route", "visit").agg(F.first("grp").alias("grp"), F.bool_or("is_stop").alias("is_stop"))


def stop_visits(visited: DataFrame) -> DataFrame:
    """Visits that stop, consecutive ones at one group merged again."""
    w = Window.partitionBy("route").orderBy("visit")
    kept = visited.filter("is_stop").withColumn("before", F.lag("grp").over(w))
    kept = kept.filter(F.col("before").isNull() | (F.col("before") != F.col("grp")))
    return kept.select("route", F.row_number().over(w).cast("long").alias("visit"), "grp")


def steps(visited: DataFrame) -> DataFrame:
    """Each visit with the next one of its route: ``a`` to ``b``."""
    w = Window.partitionBy("route").orderBy("visit")
    paired = visited.select("route", "visit", F.col("grp").alias("a"), F.lead("grp").over(w).alias("b"), "is_stop", F.lead("is_stop").over(w).alias("b_stop"))
    return paired.filter(F.col("b").isNotNull())


def edges(stepped: DataFrame) -> DataFrame:
    """Undirected edges: canonical ends, routes over it, whether any route stops at each end, first orientation."""
    u, v = F.least("a", "b"), F.greatest("a", "b")
    keyed = stepped.withColumn("u", u).withColumn("v", v)
    at_u = F.when(F.col("a") == F.col("u"), F.col("is_stop")).otherwise(F.col("b_stop"))
    at_v = F.when(F.col("a") == F.col("u"), F.col("b_stop")).otherwise(F.col("is_stop"))
    # one row per edge and route first: the distinct count then adds up small rows
    per_route = keyed.groupBy("u", "v", "route").agg(
        F.bool_or(at_u).alias("at_u"), F.bool_or(at_v).alias("at_v"), F.min(F.struct("route", "visit", "a")).alias("first")
    )
    return per_route.groupBy("u", "v").agg(
        F.count("*").alias("routes"), F.bool_or("at_u").alias("stop_u"), F.bool_or("at_v").alias("stop_v"), F.min("first")["a"].alias("from_grp")
    )


def edge_lines(stepped: DataFrame) -> DataFrame:
    return stepped.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "route").distinct()


def canonical_lines(routes: DataFrame, lines: DataFrame) -> DataFrame:
    """Routes with one bullet, colour and edge set collapse to the smallest id; blank bullets and edgeless ones never do."""
    key = F.concat_ws("|", F.col("u").cast("string"), F.col("v").cast("string"))
    sets = lines.groupBy("route").agg(F.array_join(F.array_sort(F.collect_set(key)), ",").alias("signature"))
    named = routes.filter(~F.col("temp")).join(sets, "route", "left")
    # what never collapses takes no part in the grouping; signatures meet by their digests
    merged = named.filter((F.trim("bullet") != "") & F.col("signature").isNotNull())
    keyed = merged.select("route", "bullet", F.lower("color").alias("shade"), F.sha2("signature", 256).alias("set"))
    least = keyed.groupBy("bullet", "shade", "set").agg(F.min("route").alias("line"))
    same = [keyed[c].eqNullSafe(least[c]) for c in ("bullet", "shade", "set")]
    told = keyed.join(least, same[0] & same[1] & same[2]).select("route", "line")
    return named.select("route").join(told, "route", "left").select("route", F.coalesce("line", "route").alias("line"))


def longest_traversals(stepped: DataFrame, lines: DataFrame) -> DataFrame:
    """Per line the route with most steps, the smallest id of equals."""
    counts = stepped.groupBy("route").agg(F.count("*").alias("n_steps")).join(lines, "route")
    best = counts.groupBy("line").agg(F.max(F.struct("n_steps", (-F.col("route")).alias("r"))).alias("b"))
    return best.select("line", (-F.col("b.r")).alias("route"), F.col("b.n_steps").alias("n_steps"))


def linked_groups(groups: DataFrame, edged: DataFrame) -> DataFrame:
    """Groups without an edge are pruned."""
    ends = edged.select(F.col("u").alias("grp")).unionByName(edged.select(F.col("v").alias("grp"))).distinct()
    return groups.join(ends, "grp", "left_semi")


def transfers(groups: DataFrame, edged: DataFrame | None = None, within: float = 400.0, least: float = 0.1) -> DataFrame:
    """Pairs of groups over ``least`` and at most ``within`` metres apart that no edge joins.

    Positions are put in cells as wide as the distance (in latitude, and in longitude at 80 degrees at most), so only
    neighbouring cells meet; there is no product of all groups.
    """
    side = within / EARTH * 180.0 / 3.141592653589793
    wide = side / 0.17
    celled = groups.select("grp", "lng", "lat", F.floor(F.col("lng") / wide).alias("cx"), F.floor(F.col("lat") / side).alias("cy"))
    near = [F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    spread = celled.withColumn("d", F.explode(F.array(*near))).select(
        F.col("grp").alias("a"), F.col("lng").alias("lng_a"), F.col("lat").alias("lat_a"),
        (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"),
    )
    met = spread.join(celled, ["cx", "cy"]).filter(F.col("a") < F.col("grp"))
    met = met.withColumn("metres", metres_between(F.col("lng_a"), F.col("lat_a"), F.col("lng"), F.col("lat")))
    pairs = met.filter((F.col("metres") > least) & (F.col("metres") <= within)).select("a", F.col("grp").alias("b"), "metres")
    if edged is not None:
        pairs = pairs.join(edged.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_anti")
    return pairs


def slot_offsets(lines: DataFrame, spacing: float = 6.0) -> DataFrame:
    """Lines of an edge side by side: (i - (n - 1) / 2) * spacing in order of the line. No task holds an edge's lines."""
    return _slots(stored(lines.select("u", "v", "route")), spacing).drop("n")


def _slots(lines: DataFrame, spacing: float) -> DataFrame:
    """``u``, ``v``, ``route``, ``slot``, ``offset``, and ``n``, the lines on the edge."""
    sizes = lines.groupBy("u", "v").agg(F.count("*").alias("n"))
    placed = ranked(lines, ["route"], "place", ["u", "v"]).join(sizes, ["u", "v"])
    slot = F.col("place") - 1
    return placed.select("u", "v", "route", slot.alias("slot"), ((slot - (F.col("n") - 1) / 2.0) * spacing).alias("offset"), "n")


def canonical_offsets(lines: DataFrame, spacing: float = 6.0) -> DataFrame:
    """A line's offset on the edge with the longest bundle that it is on (smallest edge of equals)."""
    lines = stored(lines.select("u", "v", "route"))
    slots = dealt(_slots(lines, spacing), lines.count(), "route")
    best = slots.groupBy("route").agg(F.max(F.struct("n", (-F.col("u")).alias("mu"), (-F.col("v")).alias("mv"), "offset")).alias("b"))
    return best.select("route", (-F.col("b.mu")).alias("u"), (-F.col("b.mv")).alias("v"), F.col("b.offset").alias("offset"))


def line_degrees(lines: DataFrame) -> DataFrame:
    """Lines on the edges at each node, and how many distinct ones."""
    ends = lines.select(F.explode(F.array("u", "v")).alias("node"), "route")
    per = ends.groupBy("node", "route").agg(F.count("*").alias("k"))
    return per.groupBy("node").agg(F.sum("k").alias("degree"), F.count("*").alias("lines"))


def connections(stepped: DataFrame) -> DataFrame:
    """Which lines pass from one edge to another at a node: (node, edge, next edge) with the number of passes."""
    w = Window.partitionBy("route").orderBy("visit")
    here = F.concat_ws("|", F.least("a", "b"), F.greatest("a", "b"))
    keyed = stepped.select("route", "visit", F.col("b").alias("node"), here.alias("edge"))
    paired = keyed.withColumn("next_edge", F.lead("edge").over(w)).filter(F.col("next_edge").isNotNull() & (F.col("next_edge") != F.col("edge")))
    return paired.groupBy("node", F.least("edge", "next_edge").alias("edge_a"), F.greatest("edge", "next_edge").alias("edge_b")).agg(F.count("*").alias("passes"))


def inversions(ordered: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Pairs i < j of a sequence with value_i > value_j, per key; sequences are short, pairs stay within a key."""
    a, b = ordered.select(key, F.col(at).alias("i"), F.col(value).alias("p")), ordered.select(key, F.col(at).alias("j"), F.col(value).alias("q"))
    pairs = a.join(b, key).filter((F.col("i") < F.col("j")) & (F.col("p") > F.col("q")))
    return pairs.groupBy(key).agg(F.count("*").alias("inversions"))


def order_importance(edged: DataFrame, lengths: DataFrame) -> DataFrame:
    """Edges in drawing order: most routes first, then the shorter one, then by id."""
    rows = edged.join(lengths, ["u", "v"])
    return ranked(rows, [F.desc("routes"), "length", "u", "v"]).select("u", "v", "rank")


def discontinuities(stepped: DataFrame) -> DataFrame:
    """Steps that do not start where the one before ended."""
    w = Window.partitionBy("route").orderBy("visit")
    return stepped.withColumn("end", F.lag("b").over(w)).filter(F.col("end").isNotNull() & (F.col("end") != F.col("a"))).select("route", "visit", "end", "a")


def crop(stepped: DataFrame, inside: DataFrame) -> DataFrame:
    """Steps with an end among ``inside(grp)``: the sub-network one hop around it."""
    near = lambda c: inside.select(F.col("grp").alias(c), F.lit(True).alias(f"_{c}")).distinct()
    met = stepped.join(near("a"), "a", "left").join(near("b"), "b", "left").filter("_a OR _b")
    return met.select(*stepped.columns).distinct()


#: Public tile schemas in order of preference, the layers that mean water, those that tell the schema, and
#: the green ones to ask for.
SCHEMAS = (
    ("protomaps", ("water",), ("natural",), ("natural", "landuse")),
    ("openmaptiles", ("water",), ("landcover", "park"), ("landcover", "park", "landuse")),
    ("mapbox", ("water",), ("landuse", "landcover"), ("landuse", "landcover")),
)


def probe(layers: DataFrame, own: tuple = (), schemas: tuple = SCHEMAS) -> DataFrame:
    """The first schema that each ``source`` has a water layer and a telling layer of, and which of its layers to ask for.

    Schemas of a map's own come before the public ones: the caller names them, as (id, water layers, telling layers,
    green layers). Water layers come first, then green ones, in the schema's order.
    """
    has = lambda names: F.bool_or(F.col("name").isin(*names))
    every = [*own, *schemas]
    flags = [(has(water) & has(need)).alias(f"_{name}") for name, water, need, _ in every]
    first = F.coalesce(*[F.when(F.col(f"_{s[0]}"), F.lit(s[0])) for s in every])
    wanted = F.create_map(*[x for name, water, _, green in every for x in (F.lit(name), F.array(*[F.lit(c) for c in dict.fromkeys([*water, *green])]))])
    told = layers.groupBy("source").agg(*flags, F.collect_set("name").alias("_names")).select("source", first.alias("schema"), "_names")
    there = F.filter(F.element_at(wanted, F.col("schema")), lambda n: F.array_contains("_names", n))
    return told.filter(F.col("schema").isNotNull()).select("source", "schema", there.alias("layers"))


def padded_bounds(points: DataFrame, key: str, share: float) -> DataFrame:
    """Bounding box per key, widened on each side by a share of its extent."""
    b = points.groupBy(key).agg(F.min("x").alias("a0"), F.min("y").alias("b0"), F.max("x").alias("a1"), F.max("y").alias("b1"))
    w, h = (F.col("a1") - F.col("a0")) * share, (F.col("b1") - F.col("b0")) * share
    return b.select(key, (F.col("a0") - w).alias("x0"), (F.col("b0") - h).alias("y0"), (F.col("a1") + w).alias("x1"), (F.col("b1") + h).alias("y1"))


def harvested(demand: DataFrame, stations: DataFrame, key: str, most: float = 12.0) -> DataFrame:
    """The area to harvest per key: around demand points by a tenth, else around stations by 15 %; too large ones go.

    An extent above ``most`` degrees on either axis comes from places that aren't set yet.
    """
    a = padded_bounds(demand, key, 0.1).withColumn("from_demand", F.lit(True))
    b = padded_bounds(stations, key, 0.15).join(a.select(key), key, "left_anti").withColumn("from_demand", F.lit(False))
    return a.unionByName(b).filter((F.col("x1") - F.col("x0") <= most) & (F.col("y1") - F.col("y0") <= most))
