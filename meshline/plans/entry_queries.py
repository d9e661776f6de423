"""Queries of the entry tables, orders and further scalars, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshline.functions import scalars as S
from meshline.operators import entry as E, geometry as G, network as N
from meshline.plans.queries import query, r6
from meshline.sources import network as V
from meshline.sources.stored import dealt

#: Stations with two nodes each (some claimed twice), combos between nodes, and routes, from the star tables.
STATION = """st AS (SELECT s_suppkey AS id, s_suppkey AS seq, s_nationkey::BIGINT AS grp, s_name AS name, s_acctbal >= 0 AS constructed,
 [s_suppkey % 60, s_suppkey % 60 + 60] AS nodes FROM supplier),
combo AS (SELECT l_orderkey AS route, l_suppkey % 60 AS start_node, l_partkey % 60 + 60 AS end_node, l_extendedprice AS distance FROM lineitem),
real_ AS (SELECT o_orderkey AS route FROM orders WHERE o_orderstatus <> 'P')"""
NODES = "node_grp AS (SELECT node, arg_max(grp, seq) AS grp FROM (SELECT seq, grp, unnest(nodes) AS node FROM st WHERE constructed) GROUP BY node)"
SERVED = """owner AS (SELECT node, arg_max(id, seq) AS id FROM (SELECT id, seq, unnest(nodes) AS node FROM st WHERE constructed) GROUP BY node),
served AS (SELECT DISTINCT id FROM owner JOIN (SELECT start_node AS node FROM combo JOIN real_ USING (route) UNION SELECT end_node FROM combo JOIN real_ USING (route)
 UNION SELECT o_custkey % 120 FROM orders WHERE o_orderkey % 50 = 0 AND o_orderstatus <> 'P') USING (node))"""


def _stations(spark, d):
    k = F.col("s_suppkey")
    return V.table(spark, d, "supplier").select(
        k.alias("id"), k.alias("seq"), F.col("s_nationkey").cast("long").alias("grp"), F.col("s_name").alias("name"),
        (F.col("s_acctbal") >= 0).alias("constructed"), F.array(k % 60, k % 60 + 60).alias("nodes"),
    )


def _combos(spark, d):
    li = V.table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("route"), (F.col("l_suppkey") % 60).alias("start_node"), (F.col("l_partkey") % 60 + 60).alias("end_node"), F.col("l_extendedprice").alias("distance"))


def _own_nodes(spark, d):
    """Nodes that a route names itself, whether or not a combo ends there."""
    return V.table(spark, d, "orders").filter("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("route"), (F.col("o_custkey") % 120).alias("node"))


@query(f"WITH {STATION}, {NODES} SELECT node, grp FROM node_grp")
def node_groups(spark, d):
    s = _stations(spark, d)
    return E.node_groups(s.drop("grp"), s.select("id", "grp"))


@query(f"WITH {STATION}, {SERVED} SELECT id FROM served")
def served_stations(spark, d):
    return E.served_stations(_stations(spark, d), _combos(spark, d), V.routes(spark, d), _own_nodes(spark, d))


@query(f"WITH {STATION}, {SERVED} SELECT grp, count(served.id) AS served FROM st LEFT JOIN served USING (id) GROUP BY grp")
def served_members(spark, d):
    s = _stations(spark, d)
    return E.served_members(s.select("id", "grp"), E.served_stations(s, _combos(spark, d), V.routes(spark, d), _own_nodes(spark, d)))


@query("""WITH given AS (SELECT n_nationkey::BIGINT AS grp, CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 4 = 1 THEN '' ELSE n_name END AS name, n_nationkey % 3 = 0 AS placed,
 [n_nationkey + 1, n_nationkey + 26, 90000] AS ids FROM nation),
m AS (SELECT g.grp, avg(s.lng) AS lng, avg(s.lat) AS lat, any_value(s.name) FILTER (WHERE s.id = g.first_id) AS first_name FROM (SELECT *, unnest(ids) AS id, ids[1] AS first_id FROM given) g LEFT JOIN station s ON s.id = g.id GROUP BY g.grp)
SELECT grp, coalesce(nullif(name, ''), first_name, grp::VARCHAR) AS name, round(CASE WHEN placed THEN grp::DOUBLE ELSE m.lng END, 9) AS lng, round(CASE WHEN placed THEN 45e0 ELSE m.lat END, 9) AS lat
FROM given JOIN m USING (grp) WHERE placed OR m.lng IS NOT NULL""", "station")
def resolved_groups(spark, d):
    k, s = F.col("n_nationkey"), V.stations(spark, d)
    given = V.table(spark, d, "nation").select(
        k.cast("long").alias("grp"), F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "").otherwise(F.col("n_name")).alias("name"), F.lit(None).cast("string").alias("other_name"),
        F.when(k % 3 == 0, k.cast("double")).alias("lng"), F.when(k % 3 == 0, 45.0).alias("lat"), F.array(k + 1, k + 26, F.lit(90000)).alias("ids"),
    )
    out = E.resolved_groups(given, s, N.station_groups(s))
    return out.select("grp", "name", F.round("lng", 9).alias("lng"), F.round("lat", 9).alias("lat"))


@query(f"""WITH {STATION}, {NODES}, leg AS (SELECT c.*, coalesce('g' || a.grp, 'n' || start_node) AS ga, coalesce('g' || b.grp, 'n' || end_node) AS gb FROM combo c
 LEFT JOIN node_grp a ON a.node = start_node LEFT JOIN node_grp b ON b.node = end_node),
mid AS (SELECT route, list_sort(list(distance))[count(*) // 2 + 1] AS median FROM combo GROUP BY route)
SELECT route, start_node, end_node, distance FROM leg JOIN mid USING (route) WHERE distance > 10000 AND median > 0 AND distance > 3 * median
 AND NOT EXISTS (SELECT 1 FROM leg r WHERE r.route = leg.route AND r.ga = leg.gb AND r.gb = leg.ga)""")
def positioning_candidates(spark, d):
    s = _stations(spark, d)
    return E.positioning_candidates(_combos(spark, d), E.node_groups(s.drop("grp"), s.select("id", "grp")), times=3.0)


@query("""WITH c AS (SELECT floor(cos(avg(lat) * 3.141592653589793 / 180) * 1e9 + 0.5) / 1e9 AS k FROM station)
SELECT id, round(6371000e0 * lng * 3.141592653589793 * k / 180, 3) AS x, round(6371000e0 * lat * 3.141592653589793 / 180, 3) AS y FROM station, c""", "station")
def metres_projection(spark, d):
    s = V.stations(spark, d)
    x, y = S.metres(F.col("lng"), F.col("lat"), F.col("lat0"))
    mean = F.broadcast(s.agg(F.avg("lat").alias("lat0")))  # one row
    return s.crossJoin(mean).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("SELECT col, row, round(-74.3e0 + col / 1000e0 * 0.6e0, 9) AS lng, round(40.4e0 + row / 1000e0 * 0.7e0, 9) AS lat FROM cell", "cell")
def corner_places(spark, d):
    at = lambda c, low, more: S.corner_place(F.col(c), F.lit(1000.0), F.lit(low), F.lit(low) + F.lit(more))
    c = V.cells(spark, d)
    return c.select("col", "row", F.round(at("col", -74.3, 0.6), 9).alias("lng"), F.round(at("row", 40.4, 0.7), 9).alias("lat"))


FEATURE = """feature AS (SELECT p_partkey AS id, (ARRAY['Polygon','MultiPolygon','Point','LineString'])[p_size % 4 + 1] AS kind, [p_size, p_size + 1, p_size + 2] AS polygons,
 (ARRAY['water','parks','other'])[p_partkey % 3 + 1] AS layer FROM part)"""


def _features(spark, d):
    p, n = V.table(spark, d, "part"), F.col("p_size")
    pick = lambda names, i: F.get(F.array(*[F.lit(x) for x in names]), i)
    return p.select(
        F.col("p_partkey").alias("id"), pick(("Polygon", "MultiPolygon", "Point", "LineString"), n % 4).alias("kind"), F.array(n, n + 1, n + 2).alias("polygons"),
        pick(("water", "parks", "other"), F.col("p_partkey") % 3).alias("layer"),
    )


FLAT = "flat AS (SELECT id, layer, unnest(CASE kind WHEN 'Polygon' THEN polygons[1:1] ELSE polygons END) AS ring, unnest(CASE kind WHEN 'Polygon' THEN [0] ELSE [0, 1, 2] END) AS part FROM feature WHERE kind IN ('Polygon', 'MultiPolygon'))"


@query(f"WITH {FEATURE}, {FLAT} SELECT id, part, ring FROM flat")
def flattened_polygons(spark, d):
    return E.flattened(_features(spark, d)).withColumnRenamed("rings", "ring")


@query(f"WITH {FEATURE}, {FLAT} SELECT CASE layer WHEN 'parks' THEN 'green' ELSE layer END AS category, count(*) AS polygons, sum(ring)::BIGINT AS total FROM flat WHERE layer <> 'other' GROUP BY layer")
def feature_buckets(spark, d):
    f = _features(spark, d)
    marked = f.select("id", S.feature_category(F.col("layer"), F.create_map(F.lit("kind"), F.lit("none"))).alias("category"))
    flat = E.flattened(f).join(marked.filter("category IS NOT NULL"), "id")
    return flat.groupBy("category").agg(F.count("*").alias("polygons"), F.sum("rings").alias("total"))


@query("""SELECT c_custkey, abs(c_acctbal - (c_acctbal + (c_custkey % 3) * 6e-7)) <= 1e-6 AS alike FROM customer""")
def boxes_alike(spark, d):
    x = F.col("c_acctbal")
    other = x + F.col("c_custkey") % 3 * 6e-7
    return V.table(spark, d, "customer").select("c_custkey", S.boxes_alike([x, F.lit(1.0), x, F.lit(2.0)], [other, F.lit(1.0), other, F.lit(2.0)]).alias("alike"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey % 500 AS line, l_suppkey AS u, l_partkey % 100 AS v FROM lineitem), t AS (SELECT DISTINCT line, u, v FROM e WHERE line % 2 = 0 AND u % 3 = 0)
SELECT * FROM e WHERE (line, u, v) IN (SELECT (line, u, v) FROM t) OR line NOT IN (SELECT line FROM t)""")
def drawn_lines(spark, d):
    e = V.table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("line"), F.col("l_suppkey").alias("u"), (F.col("l_partkey") % 100).alias("v")).distinct()
    return E.drawn(e, e.filter("line % 2 = 0 AND u % 3 = 0"))


@query("""SELECT label, round(greatest(0, min(x) - 50), 6) AS x, round(greatest(0, min(y) - 50), 6) AS y, round(least(2700, max(x) + 50) - greatest(0, min(x) - 50), 6) AS w,
 round(least(1500, max(y) + 50) - greatest(0, min(y) - 50), 6) AS h FROM point GROUP BY label""", "point")
def content_frames(spark, d):
    return E.framed(V.points(spark, d), "label", 50.0, 2700.0, 1500.0).select("label", *[r6(c) for c in ("x", "y", "w", "h")])


BOX = "box AS (SELECT c_custkey AS box, c_custkey * 37 % 2600 AS x0, c_custkey * 91 % 2600 AS y0, c_custkey * 37 % 2600 + 20 + c_custkey % 90 AS x1, c_custkey * 91 % 2600 + 30 AS y1 FROM customer)"


def _boxes(spark, d):
    k = F.col("c_custkey")
    x, y = k * 37 % 2600, k * 91 % 2600
    return V.table(spark, d, "customer").select(k.alias("box"), x.alias("x0"), y.alias("y0"), (x + 20 + k % 90).alias("x1"), (y + 30).alias("y1"))


@query(f"WITH {BOX} SELECT box, id FROM box JOIN point ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1", "point")
def area_hits(spark, d):
    return E.boxes_hit(V.points(spark, d), _boxes(spark, d), 60.0)


@query(f"WITH {BOX} SELECT a.box AS a, b.box AS b FROM box a JOIN box b ON a.box < b.box AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def boxes_met(spark, d):
    return E.boxes_met(_boxes(spark, d), 60.0)


@query("""WITH e AS (SELECT l_suppkey AS u, 1000000 + l_partkey % 97 AS v, count(DISTINCT l_orderkey % 50) AS lines FROM lineitem GROUP BY ALL),
n AS (SELECT node, count(*) AS deg, sum(lines) AS ldeg, (node * 13 % 101)::DOUBLE AS x, (node * 7 % 103)::DOUBLE AS y FROM (SELECT u AS node, lines FROM e UNION ALL SELECT v, lines FROM e) GROUP BY node),
k AS (SELECT e.u, e.v, e.lines, a.deg AS ad, b.deg AS bd, a.ldeg AS al, b.ldeg AS bl, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 9) AS len FROM e JOIN n a ON a.node = e.u JOIN n b ON b.node = e.v)
SELECT 'NUM_LINES' AS method, u, v, row_number() OVER (ORDER BY lines DESC, u, v) AS rank FROM k UNION ALL SELECT 'LENGTH', u, v, row_number() OVER (ORDER BY len, u, v) FROM k
UNION ALL SELECT 'ADJ_ND_DEGREE', u, v, row_number() OVER (ORDER BY greatest(ad, bd) DESC, least(ad, bd) DESC, u, v) FROM k
UNION ALL SELECT 'ADJ_ND_LDEGREE', u, v, row_number() OVER (ORDER BY greatest(al, bl) DESC, least(al, bl) DESC, u, v) FROM k""")
def edge_orderings(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") % 97 + 1000000).alias("v"), (F.col("l_orderkey") % 50).alias("line"))
    e = li.groupBy("u", "v").agg(F.countDistinct("line").alias("lines"))
    n = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return E.edge_orderings(e, n.select("node", (F.col("node") * 13 % 101).cast("double").alias("x"), (F.col("node") * 7 % 103).cast("double").alias("y")))


@query("""SELECT o_custkey AS station, count(*) AS marks, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS rank FROM orders GROUP BY o_custkey""")
def placement_order(spark, d):
    n = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("station")).agg(F.count("*").alias("marks"))
    return E.ranked(n, [F.desc("marks"), "station"])


@query("""SELECT l_orderkey, l_linenumber, ((l_partkey % 8 - l_suppkey % 8 + 8) % 8)::BIGINT AS distance FROM lineitem""")
def circular_distances(spark, d):
    dist = S.circular_distance(F.col("l_suppkey") % 8, F.col("l_partkey") % 8, F.lit(8))
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", dist.cast("long").alias("distance"))


@query("""WITH d AS (SELECT event_id, (user_id % 21 - 10) / 10e0 AS p FROM events)
SELECT event_id, CASE WHEN p < -0.92e0 THEN 6e0 WHEN p < -0.38e0 THEN 0.5e0 ELSE 0.15e0 END AS step, round(0.15e0 + 5.85e0 * p * p, 9) AS angle, round(greatest(0, 0.8e0 * (1 + p)), 9) AS warp_alpha,
 round(CASE WHEN p <= 0 THEN 0.05e0 - 0.1e0 * p ELSE 0.05e0 * (1 - p) END, 9) AS affinity, round(greatest(1, 6 * pow(6e0, p)), 6) AS box_expand, round(greatest(1, 1.5e0 * pow(3e0, p)), 6) AS box_growth FROM d""")
def turn_and_slider_factors(spark, d):
    p = F.col("p")
    e = V.table(spark, d, "events").select("event_id", ((F.col("user_id") % 21 - 10) / 10.0).alias("p"))
    sliders = [F.round(v, 9 if k in ("warp_alpha", "affinity") else 6).alias(k) for k, v in S.slider_values(p).items()]
    return e.select("event_id", S.corner_factor(p).alias("step"), F.round(S.angle_factor(p), 9).alias("angle"), *sliders)


@query("""WITH d AS (SELECT event_id, (user_id % 7 - 3)::DOUBLE AS x, (event_id % 5 - 2)::DOUBLE AS y FROM events)
SELECT event_id, greatest(0, abs(x) * 3e0 + abs(y) * 3e0 + least(abs(x), abs(y)) * -2.5e0 + CASE WHEN abs(x) <> abs(y) AND x <> 0 AND y <> 0 THEN 1e0 ELSE 0e0 END - 0.5e0) AS least_cost,
 round(sqrt(x * x + y * y) / 4e0 * 2.5e0, 9) AS move FROM d""")
def grid_costs(spark, d):
    x, y = F.col("x"), F.col("y")
    e = V.table(spark, d, "events").select("event_id", (F.col("user_id") % 7 - 3).cast("double").alias("x"), (F.col("event_id") % 5 - 2).cast("double").alias("y"))
    return e.select("event_id", S.heuristic(x, y, 3.0, 3.0, -2.5, 1.0, 0.5).alias("least_cost"), F.round(S.move_penalty(F.sqrt(x * x + y * y), 4.0, 2.5), 9).alias("move"))


@query("""SELECT id, floor(x * 8 + 0.5)::BIGINT || ',' || floor(y * 8 + 0.5)::BIGINT AS key FROM point""", "point")
def vertex_keys(spark, d):
    return V.points(spark, d).select("id", S.vertex_key(F.col("x"), F.col("y")).alias("key"))


@query("""SELECT p_partkey, p_name AS name, p_retailprice * 1000e0 / 7e0 AS dx, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size / -4e0 END AS dy, p_size::VARCHAR AS width FROM part""")
def parsed_elements(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    p = dealt(p, p.count(), each=10_000)  # few bytes, much to parse
    shift = F.concat((F.col("p_retailprice") * 1000.0 / 7.0).cast("string"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit(", "), (F.col("p_size") / -4.0).cast("string"))))
    tag = F.concat(F.lit("<g name=\"old\" data-name = '"), F.col("p_name"), F.lit("' width=\""), F.col("p_size"), F.lit('" transform="rotate(4) translate( '), shift, F.lit(' )">'))
    a = p.select("p_partkey", S.attributes(tag).alias("a"))
    at = S.translation(F.col("a")["transform"])
    return a.select("p_partkey", F.col("a")["data-name"].alias("name"), at[0].alias("dx"), at[1].alias("dy"), F.col("a")["width"].alias("width"))


@query("""SELECT p_partkey, '{"map":[["type","' || p_type || '"],["brand","' || p_brand || '"]]}' AS text, p_type AS type FROM part""")
def maps_as_json(spark, d):
    p = V.table(spark, d, "part")
    text = p.select("p_partkey", S.map_json(F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))).alias("text"))
    return text.select("p_partkey", "text", S.json_map(F.col("text"))["type"].alias("type"))


@query("""SELECT p_partkey, p_size % 3 <> 0 AND p_size % 4 <> 2 AND p_size % 3 <> p_size % 4 AS splits FROM (SELECT * FROM part)""")
def trunk_splits(spark, d):
    n = F.col("p_size")
    # trunk {1, 2, 3}: one branch has 1 and 3 (or 0, 1, 3), the other has 2 (or lacks it, or shares 1)
    a = F.when(n % 3 == 0, F.array(F.lit(0), F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(3)))
    b = F.when(n % 4 == 2, F.array(F.lit(3))).when(n % 3 == n % 4, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    return V.table(spark, d, "part").select("p_partkey", S.splits_trunk(F.array(F.lit(1), F.lit(2), F.lit(3)), a, b).alias("splits"))


@query("""WITH RECURSIVE s AS (SELECT p_partkey, [(p_size % 7 + 1)::DOUBLE, (p_size % 5 + 1)::DOUBLE, (p_size % 11 + 1)::DOUBLE, 4e0] AS v FROM part),
r(k, i, rho) AS (SELECT p_partkey, 0, list_transform(v, lambda x: x / (v[1] + v[2] + v[3] + v[4])) FROM s UNION ALL SELECT k, i + 1, CASE WHEN abs(c[1] + c[2] + c[3] + c[4] - 1) < 1e-9 THEN c
 ELSE list_transform(c, lambda x: x / (c[1] + c[2] + c[3] + c[4])) END FROM (SELECT k, i, list_transform(rho, lambda x: greatest(0.1e0, least(0.35e0, x))) AS c FROM r WHERE i < 16))
SELECT k AS p_partkey, round(rho[1], 6) AS r1, round(rho[2], 6) AS r2, round(rho[3], 6) AS r3, round(rho[4], 6) AS r4 FROM r WHERE i = 16""")
def water_filled_shares(spark, d):
    n = F.col("p_size")
    v = [((n % m) + 1).cast("double") for m in (7, 5, 11)] + [F.lit(4.0)]
    total = v[0] + v[1] + v[2] + v[3]
    s = V.table(spark, d, "part").select("p_partkey", S.water_filled(F.array(*[x / total for x in v]), 0.1, 0.35).alias("rho"))
    return s.select("p_partkey", *[F.round(F.col("rho")[i], 6).alias(f"r{i + 1}") for i in range(4)])


@query("""WITH s AS (SELECT event_id, (user_id % 10)::DOUBLE AS a, (event_id % 13)::DOUBLE AS b, value / 10 AS c FROM events), seg AS (SELECT event_id, a, b, c, a + 20 AS a2, b + 5 AS b2 FROM s),
t AS (SELECT event_id, c, b, a2, b2, a, greatest(0, least(1, ((0 - a) * 20 + (c - b) * 5) / 425e0)) AS u FROM seg)
SELECT event_id, round(sqrt(pow(0 - (a + u * 20), 2) + pow(c - (b + u * 5), 2)), 6) AS distance FROM t""")
def segment_distances(spark, d):
    e = V.table(spark, d, "events").select("event_id", (F.col("user_id") % 10).cast("double").alias("a"), (F.col("event_id") % 13).cast("double").alias("b"), (F.col("value") / 10).alias("c"))
    return e.select("event_id", F.round(S.segment_distance(F.lit(0.0), F.col("c"), F.col("a"), F.col("b"), F.col("a") + 20, F.col("b") + 5), 6).alias("distance"))


@query("""WITH b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), a AS (SELECT DISTINCT l_suppkey, l_partkey % 10 FROM lineitem)
SELECT round(1 - (SELECT count(*) FROM a)::DOUBLE / (SELECT count(*) FROM b), 9) AS edges_saved, round(avg(CASE WHEN dx = 0 OR dy = 0 OR abs(dx) = abs(dy) THEN 1 ELSE 0 END), 9) AS octilinear, count(*) AS steps
FROM (SELECT l_linenumber - 4 AS dx, l_quantity::BIGINT % 7 - 3 AS dy FROM lineitem)""")
def network_scorecard(spark, d):
    li = V.table(spark, d, "lineitem")
    steps = li.select((F.col("l_linenumber") - 4).alias("dx"), (F.col("l_quantity").cast("long") % 7 - 3).alias("dy"))
    out = E.scorecard(li.select("l_suppkey", "l_partkey").distinct(), li.select("l_suppkey", (F.col("l_partkey") % 10).alias("p")).distinct(), steps)
    return out.select(F.round("edges_saved", 9).alias("edges_saved"), F.round("octilinear", 9).alias("octilinear"), "steps")


@query("""SELECT event_id, s AS steps, CASE WHEN s = 0 THEN -1 ELSE [0.95e0, 0.6e0, 0.05e0, 0e0][s] + (0.95e0 - 0.05e0) END AS bend, round(w * w * (3e0 - w * 2e0), 9) AS smooth
FROM (SELECT event_id, least(abs(event_id % 8 - user_id % 8), 8 - abs(event_id % 8 - user_id % 8)) AS s, greatest(0e0, least(1e0, (value - 50e0) / 300e0)) AS w FROM events)""")
def turns_and_blends(spark, d):
    e = V.table(spark, d, "events")
    steps = S.turn_steps(F.col("event_id") % 8, F.col("user_id") % 8)
    bend = F.when(steps == 0, F.lit(-1.0)).otherwise(S.bend_weight(steps))  # there is no such bend
    return e.select("event_id", steps.alias("steps"), bend.alias("bend"), F.round(S.smoothstep((F.col("value") - 50.0) / 300.0), 9).alias("smooth"))


@query("""SELECT line, seq, x, y FROM (SELECT *, lag({'x': x, 'y': y}) OVER (PARTITION BY line ORDER BY seq) AS p FROM (SELECT line, seq, floor(x / 24e0) AS x, floor(y / 200e0) AS y FROM polyline))
WHERE p IS NULL OR p <> {'x': x, 'y': y}""", "polyline")
def points_without_repeats(spark, d):
    """Points on a coarse lattice, where many follow an equal one."""
    p = V.polylines(spark, d).select("line", "seq", F.floor(F.col("x") / 24.0).cast("double").alias("x"), F.floor(F.col("y") / 200.0).cast("double").alias("y"))
    return G.without_repeats(p)
