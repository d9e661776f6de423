"""Registered queries of placement, merging and painting."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshline.operators import layout as L, network as N, raster as R
from meshline.plans.queries import EDGE, GROUP, LINE, NEAR, STEP, query, r6
from meshline.sources import network as V


def lines_of(spark, d):
    return N.edge_lines(N.steps(N.visits(V.stops(spark, d))))


@query("""SELECT p.id, arg_min(q.id, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y))) AS node, round(min(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y))), 6) AS distance
FROM point p JOIN (SELECT * FROM point WHERE label = 0) q ON abs(p.x-q.x) <= 300 AND abs(p.y-q.y) <= 300 WHERE sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) <= 300 GROUP BY p.id""", "point")
def nearest_nodes(spark, d):
    p = V.points(spark, d)
    return L.nearest(p, p.filter("label = 0"), 300.0).select("id", "node", r6("distance"))


NEST = """nest AS (SELECT c_custkey AS id, c_custkey % 701 AS x0, c_custkey % 503 AS y0, c_custkey % 701 + 1 + c_custkey % 89 AS x1, c_custkey % 503 + 1 + c_custkey % 97 AS y1 FROM customer)"""


@query(f"""WITH {NEST}, h AS (SELECT a.id, b.id AS o, (b.x1-b.x0)*(b.y1-b.y0) AS area FROM nest a JOIN nest b ON b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1
 AND (b.x1-b.x0)*(b.y1-b.y0) > (a.x1-a.x0)*(a.y1-a.y0)), m AS (SELECT id, count(*) AS depth, arg_min(o, area * 1000000000 + o) AS parent FROM h GROUP BY id)
SELECT n.id, coalesce(depth, 0) AS depth, coalesce(parent, -1) AS parent FROM nest n LEFT JOIN m USING (id)""")
def body_nesting(spark, d):
    k = F.col("c_custkey")
    b = V.table(spark, d, "customer").select(
        k.alias("id"), (k % 701).alias("x0"), (k % 503).alias("y0"), (k % 701 + 1 + k % 89).alias("x1"), (k % 503 + 1 + k % 97).alias("y1")
    )
    return L.nested_boxes(b, 64.0)


@query("SELECT p_partkey AS id, p_retailprice AS area FROM part WHERE p_retailprice >= 0.4e0 * (SELECT max(p_retailprice) FROM part)")
def largest_bodies(spark, d):
    parts = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("area"))
    return L.keep_largest(parts, share=0.4)


@query("""SELECT owners, count(*) AS segments FROM (SELECT key, string_agg(owner, ',' ORDER BY owner) AS owners FROM
 (SELECT DISTINCT l_partkey AS key, lpad((l_suppkey % 7)::VARCHAR, 2, '0') AS owner FROM lineitem) GROUP BY key) GROUP BY owners""")
def segment_owners(spark, d):
    li = V.table(spark, d, "lineitem")
    return L.owner_sets(li.select(F.col("l_partkey").alias("key"), F.lpad((F.col("l_suppkey") % 7).cast("string"), 2, "0").alias("owner")))


@query("WITH " + LINE + """, e AS (SELECT u, v, count(*) AS routes, abs(u - v)::DOUBLE AS length FROM line WHERE u <> v GROUP BY u, v), t AS (SELECT u AS node, length, routes FROM e UNION ALL SELECT v, length, routes FROM e),
p AS (SELECT node, avg(length) AS gap, sum(routes) AS n FROM t GROUP BY node)
SELECT node, round(gap, 6) AS gap, greatest(1, floor(n * least(8e0, greatest(0.25e0, (SELECT avg(gap) FROM p) / gap)) + 0.5e0))::BIGINT AS weight FROM p""", "stop")
def crowding_weights(spark, d):
    e = lines_of(spark, d).filter("u != v").groupBy("u", "v").agg(F.count("*").alias("routes")).withColumn("length", F.abs(F.col("u") - F.col("v")).cast("double"))
    return L.crowding(e).select("node", r6("gap"), "weight")


@query("""WITH a AS (SELECT l_partkey AS cell, min(l_quantity) AS d FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS cell, min(l_quantity) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(a.cell, b.cell) AS cell, CASE WHEN b.cell IS NULL OR a.d <= b.d THEN 'a' ELSE 'b' END AS side FROM a FULL JOIN b ON a.cell = b.cell""")
def candidate_split(spark, d):
    li = V.table(spark, d, "lineitem")
    of = lambda flag: li.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("cell")).agg(F.min("l_quantity").alias("d"))
    return L.split_between(of("A"), of("R"))


@query("""WITH b AS (SELECT label, avg(x) - 200e0 AS x0, avg(y) - 200e0 AS y0, avg(x) + 200e0 AS x1, avg(y) + 200e0 AS y1 FROM point GROUP BY label)
SELECT p.id, round(any_value(p.x) + sum(greatest(-1e0, least(1e0, (p.x-(b.x0+b.x1)/2e0)/((b.x1-b.x0)/2e0)))*(b.x1-b.x0)/2e0*0.3e0), 3) AS x,
 round(any_value(p.y) + sum(greatest(-1e0, least(1e0, (p.y-(b.y0+b.y1)/2e0)/((b.y1-b.y0)/2e0)))*(b.y1-b.y0)/2e0*0.3e0), 3) AS y FROM point p, b GROUP BY p.id""", "point")
def box_warp(spark, d):
    p = V.points(spark, d)
    m = lambda c, s: (F.avg(c) + F.lit(s)).alias
    b = p.groupBy("label").agg(m("x", -200.0)("x0"), m("y", -200.0)("y0"), m("x", 200.0)("x1"), m("y", 200.0)("y1"))
    return L.expand_boxes(p, b).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("WITH " + LINE + """, s AS (SELECT u, v, string_agg(route::VARCHAR, ',' ORDER BY route) AS k FROM line GROUP BY u, v), e AS (SELECT u AS node, k FROM s UNION ALL SELECT v, k FROM s)
SELECT node, count(*) AS degree FROM e GROUP BY node HAVING count(*) <> 2 OR count(DISTINCT k) <> 1""", "stop")
def merge_anchors(spark, d):
    return L.merge_anchors(lines_of(spark, d))


@query("""WITH w(k, dx, dy) AS (VALUES (0,1,0),(1,1,1),(2,0,1),(3,-1,1),(4,-1,0),(5,-1,-1),(6,0,-1),(7,1,-1)), b AS (SELECT c AS col, r AS "row" FROM range(60) x(c), range(40) y(r))
SELECT col, "row", k::BIGINT AS direction, col+dx AS to_col, "row"+dy AS to_row FROM b, w WHERE col+dx BETWEEN 0 AND 59 AND "row"+dy BETWEEN 0 AND 39""")
def octilinear_grid(spark, d):
    return L.grid_ports(60, 40, spark)


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS a, 1000000000 + o_orderkey AS b FROM orders UNION SELECT 1000000000 + o_orderkey, o_custkey FROM orders),
r(node, steps) AS (SELECT c_custkey, 0 FROM customer WHERE c_acctbal > 9000 UNION SELECT e.b, r.steps + 1 FROM r JOIN e ON e.a = r.node WHERE r.steps < 3)
SELECT node, min(steps)::BIGINT AS steps FROM r GROUP BY node""")
def reach_shells(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("u"), (F.col("o_orderkey") + 1000000000).alias("v"))
    return L.nearest_shells(o, V.table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("node")), 3)


@query("""SELECT label, 'M' || string_agg(printf('%.1f', floor(round(x, 6)*10e0+0.5e0)/10e0) || ',' || printf('%.1f', floor(round(y, 6)*10e0+0.5e0)/10e0), 'L' ORDER BY id) || 'Z' AS path FROM point GROUP BY label""", "point")
def backdrop_paths(spark, d):
    return L.svg_path(V.points(spark, d).withColumnRenamed("id", "seq"), "label")


@query("WITH " + GROUP + ", " + NEAR + """ SELECT n.a, n.b, printf('<line x1="%.1f" y1="%.1f" x2="%.1f" y2="%.1f"/>', floor(round(p.lng*100, 6)*10e0+0.5e0)/10e0, floor(round(p.lat*100, 6)*10e0+0.5e0)/10e0, floor(round(q.lng*100, 6)*10e0+0.5e0)/10e0, floor(round(q.lat*100, 6)*10e0+0.5e0)/10e0) AS svg
FROM near n JOIN grp_ p ON p.grp = n.a JOIN grp_ q ON q.grp = n.b WHERE metres > 0.1 AND metres <= 9000""", "station")
def transfer_connectors(spark, d):
    g = N.station_groups(V.stations(spark, d))
    return L.transfer_svg(N.transfers(g, within=9000.0).select("a", "b"), g.select("grp", (F.col("lng") * 100).alias("x"), (F.col("lat") * 100).alias("y")))


@query("""SELECT 'customer' AS part, count(*) AS rows, sum(('0x' || substr(md5(c_custkey || '|' || c_name), 1, 8))::BIGINT)::BIGINT AS digest FROM customer
UNION ALL SELECT 'nation', count(*), sum(('0x' || substr(md5(n_nationkey || '|' || n_name), 1, 8))::BIGINT)::BIGINT FROM nation""")
def input_fingerprints(spark, d):
    return L.input_fingerprint({"customer": (V.table(spark, d, "customer"), ["c_custkey", "c_name"]), "nation": (V.table(spark, d, "nation"), ["n_nationkey", "n_name"])})


@query("""SELECT o_orderstatus AS layer, o_orderkey AS seq, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS z FROM orders""")
def paint_order(spark, d):
    return L.painted(V.table(spark, d, "orders").select(F.col("o_orderstatus").alias("layer"), F.col("o_orderkey").alias("seq")))


@query("""WITH w(k, i, j) AS (VALUES (0,1,0),(1,1,1),(2,0,1),(3,-1,1),(4,-1,0),(5,-1,-1),(6,0,-1),(7,1,-1)), c AS (SELECT id, k, x + i * 60e0 AS px, y + j * 60e0 AS py FROM point, w),
o AS (SELECT c.id, c.k, count(*) AS cost FROM c JOIN point m ON abs(c.px - m.x) < 30 AND abs(c.py - m.y) < 30 AND m.id <> c.id GROUP BY ALL)
SELECT id, arg_min(k, coalesce(cost, 0) * 10 + k)::BIGINT AS anchor, min(coalesce(cost, 0)) AS overlaps FROM c LEFT JOIN o USING (id, k) GROUP BY id""", "point")
def label_anchors(spark, d):
    p = V.points(spark, d)
    return L.label_anchor(p, p, 60.0)


@query("WITH " + STEP + """, s AS (SELECT a AS node, b::DOUBLE AS x, (route % 1000)::DOUBLE AS y FROM step) SELECT node, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS degree FROM s GROUP BY node""", "stop")
def intersection_smoothing(spark, d):
    s = N.steps(N.visits(V.stops(spark, d)))
    return L.smoothed_nodes(s.select(F.col("a").alias("node"), F.col("b").cast("double").alias("x"), (F.col("route") % 1000).cast("double").alias("y"))).select("node", r6("x"), r6("y"), "degree")


@query()
def force_relaxation(spark, d):
    g = N.station_groups(V.stations(spark, d)).select(F.col("grp").alias("node"), (F.col("lng") * 100).alias("x"), (F.col("lat") * 100).alias("y"))
    return L.relax(g, lines_of(spark, d).select("u", "v").distinct()).select("node", r6("x"), r6("y"))


@query()
def line_orderings(spark, d):
    """Every customer's orders as a network of their own."""
    owner = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("route"), F.col("o_custkey").alias("network"))
    return L.line_orders(lines_of(spark, d).join(owner, "route"))


@query(f"""WITH RECURSIVE {V.SQL['cell']}, {EDGE}, coded AS (SELECT *, (y * 1073741824 + x) * 4 + CASE WHEN y2 < y THEN 0 WHEN x2 < x THEN 1 WHEN x2 > x THEN 2 ELSE 3 END AS e FROM edge),
turned AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY e) AS o, row_number() OVER (PARTITION BY x2, y2 ORDER BY e) AS i FROM coded),
follow AS (SELECT a.e, a.x, a.y, b.e AS nxt FROM turned a JOIN turned b ON b.x = a.x2 AND b.y = a.y2 AND b.o = a.i),
walk AS (SELECT e AS ring, 0 AS seq, e, x, y, nxt FROM follow UNION ALL SELECT ring, seq + 1, f.e, f.x, f.y, f.nxt FROM walk w JOIN follow f ON f.e = w.nxt WHERE w.nxt > w.ring)
SELECT 0::BIGINT AS network, ring::BIGINT AS ring, seq::BIGINT AS seq, x::BIGINT AS x, y::BIGINT AS y FROM walk WHERE ring IN (SELECT ring FROM walk WHERE nxt = ring)""")
def stitched_rings(spark, d):
    """The whole raster."""
    return L.stitch_rings(R.boundary_edges(V.cells(spark, d)).withColumn("network", F.lit(0).cast("long")))


@query("""WITH g AS (SELECT least(95, greatest(0, floor(x / 2700e0 * 96)))::BIGINT AS bx, least(95, greatest(0, floor(y / 2700e0 * 96)))::BIGINT AS "by", count(*) AS n FROM point GROUP BY 1, 2),
k(dd, w) AS (VALUES (-2, 0.0625e0), (-1, 0.25e0), (0, 0.375e0), (1, 0.25e0), (2, 0.0625e0)), i AS (SELECT unnest(range(96)) AS i),
m AS (SELECT i, least(95, greatest(0, i + dd)) AS j, sum(w) AS w FROM i, k GROUP BY 1, 2)
SELECT a.i AS bx, b.i AS "by", round(sum(n * a.w * b.w), 6) AS n FROM g JOIN m a ON a.j = g.bx JOIN m b ON b.j = g."by" GROUP BY 1, 2""", "point")
def smoothed_grid(spark, d):
    grid = R.histogram_2d(V.points(spark, d), 0.0, 2700.0)
    return R.smooth_2d(grid, [0.0625, 0.25, 0.375, 0.25, 0.0625], 96).select("bx", "by", r6("n"))
