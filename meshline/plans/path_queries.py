"""Registered queries of drawn paths: coincident runs, planar parts, contracted chains, shortest paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from meshline.operators import drawn as D, paths as P
from meshline.plans.queries import query
from meshline.sources import network as V

#: Lattice step of the coincident merge: half a cell of the 16 pixel grid.
STEP = 8.0


def r4(name: str) -> Column:
    """Four digits, halves upwards, by one formula that both engines compute alike."""
    return (F.floor(F.col(name) * 1e4 + 0.5) / 1e4).alias(name)


def four(expression: str) -> str:
    return f"floor(({expression}) * 1e4 + 0.5e0) / 1e4"


#: Where runs end: the items that are nodes, at the first point of their leg.
NODE = "is_node AND seq = 0"


def grid(spark, d):
    return V.grid_paths(spark, d).withColumn("line", F.col("route") % 5).withColumn("reversed", F.col("route") % 2 == 1)


UNIT = """st AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM gridpath WINDOW w AS (PARTITION BY net, edge ORDER BY seq)),
cut AS (SELECT net, edge, seq, 0e0 AS t, x, y FROM st UNION ALL SELECT net, edge, seq, t, x + (x2 - x) * t, y + (y2 - y) * t FROM (SELECT *, unnest(list_concat(
 CASE WHEN abs(x2-x) >= 1e-9 THEN list_transform(range(ceil(least(x,x2)/8)::BIGINT, floor(greatest(x,x2)/8)::BIGINT + 1), lambda k: (k*8e0-x)/(x2-x)) ELSE [] END,
 CASE WHEN abs(y2-y) >= 1e-9 THEN list_transform(range(ceil(least(y,y2)/8)::BIGINT, floor(greatest(y,y2)/8)::BIGINT + 1), lambda k: (k*8e0-y)/(y2-y)) ELSE [] END)) AS t
 FROM st WHERE x2 IS NOT NULL) WHERE t > 1e-9 AND t < 1 - 1e-9),
vert AS (SELECT net, edge, row_number() OVER (PARTITION BY net, edge ORDER BY seq, t) AS pos, vx, vy FROM (SELECT *, lag({'x': vx, 'y': vy}) OVER (PARTITION BY net, edge ORDER BY seq, t) AS p
 FROM (SELECT *, floor(x*8+0.5e0)::BIGINT AS vx, floor(y*8+0.5e0)::BIGINT AS vy FROM cut)) WHERE p IS NULL OR p <> {'x': vx, 'y': vy}),
unit AS (SELECT *, least(a, b) AS low, greatest(a, b) AS high FROM (SELECT net, edge, pos, {'x': vx, 'y': vy} AS a, lead({'x': vx, 'y': vy}) OVER (PARTITION BY net, edge ORDER BY pos) AS b FROM vert) WHERE b IS NOT NULL)"""
RUN = UNIT + """, owner AS (SELECT net, low, high, array_to_string(list_sort(list(DISTINCT edge)), ',') AS owners, min({'edge': edge, 'pos': pos}) AS f FROM unit GROUP BY ALL),
node AS (SELECT DISTINCT net, {'x': floor(x*8+0.5e0)::BIGINT, 'y': floor(y*8+0.5e0)::BIGINT} AS a FROM gridpath WHERE is_node AND seq = 0),
told AS (SELECT u.*, o.owners, o.f = {'edge': edge, 'pos': pos} AS own, n.a IS NOT NULL AS node FROM unit u JOIN owner o USING (net, low, high) LEFT JOIN node n ON n.net = u.net AND n.a = u.a),
run AS (SELECT *, sum(CASE WHEN own AND NOT goes THEN 1 ELSE 0 END) OVER (PARTITION BY net, edge ORDER BY pos) AS run FROM (SELECT *, coalesce(lag(own) OVER w AND lag(owners) OVER w = owners, false) AND NOT node AS goes
 FROM told WINDOW w AS (PARTITION BY net, edge ORDER BY pos)) QUALIFY own)"""
RUN = RUN.replace(" QUALIFY own)", "), owned AS (SELECT * FROM run WHERE own)")


@query("WITH " + RUN + """ SELECT net, edge, run::BIGINT AS run, count(*) AS segments, any_value(owners) AS owners, arg_min(a, pos).x AS start_x, arg_min(a, pos).y AS start_y,
 arg_max(b, pos).x AS end_x, arg_max(b, pos).y AS end_y FROM owned GROUP BY ALL""", "item", "gridpath")
def coincident_runs(spark, d):
    return D.run_ends(grid(spark, d), NODE, STEP)


CHAIN = RUN + """, met AS (SELECT u.net, u.edge, u.pos, r.edge AS run_edge, r.run, u.a <> r.a AS reversed FROM unit u JOIN owned r USING (net, low, high)),
chain AS (SELECT * EXCLUDE (p) FROM (SELECT *, lag({'e': run_edge, 'r': run, 'v': reversed}) OVER (PARTITION BY net, edge ORDER BY pos) AS p FROM met) WHERE p IS NULL OR p <> {'e': run_edge, 'r': run, 'v': reversed})"""


@query("WITH " + CHAIN + """, step AS (SELECT DISTINCT net, route % 5 AS line, edge AS step, edge, route % 2 = 1 AS back FROM gridpath),
turned AS (SELECT s.net, s.line, s.step, CASE WHEN back THEN -pos ELSE pos END AS o, run_edge, run, reversed <> back AS reversed FROM step s JOIN chain USING (net, edge)),
kept AS (SELECT * FROM (SELECT *, lag({'e': run_edge, 'r': run, 'v': reversed}) OVER (PARTITION BY net, line ORDER BY step, o) AS p FROM turned) WHERE p IS NULL OR p <> {'e': run_edge, 'r': run, 'v': reversed})
SELECT net, line, row_number() OVER (PARTITION BY net, line ORDER BY step, o) AS place, run_edge, run::BIGINT AS run, reversed FROM kept""", "item", "gridpath")
def remapped_traversals(spark, d):
    return D.remapped_traversals(grid(spark, d), NODE, STEP)


@query("WITH " + RUN + """ SELECT DISTINCT net, edge, run::BIGINT AS run, line FROM (SELECT net, edge, run, unnest(string_split(owners, ',')) AS owner FROM owned)
 JOIN (SELECT DISTINCT net AS n, edge::VARCHAR AS owner, route % 5 AS line FROM gridpath) l USING (owner) WHERE net = n""", "item", "gridpath")
def run_lines(spark, d):
    return D.run_lines(grid(spark, d), NODE, STEP)


ARC = """st AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM crosspath WINDOW w AS (PARTITION BY net, edge ORDER BY seq)),
seg AS (SELECT *, sum(length) OVER (PARTITION BY net, edge ORDER BY seq ROWS UNBOUNDED PRECEDING) AS t1, sum(length) OVER (PARTITION BY net, edge) AS total FROM (SELECT *, sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) AS length FROM st WHERE x2 IS NOT NULL)),
hit AS (SELECT * FROM (SELECT a.net, a.edge AS ea, b.edge AS eb, a.seq AS sa, b.seq AS sb, ((b.x-a.x)*(b.y2-b.y)-(b.y-a.y)*(b.x2-b.x))/((a.x2-a.x)*(b.y2-b.y)-(a.y2-a.y)*(b.x2-b.x)) AS t,
 ((b.x-a.x)*(a.y2-a.y)-(b.y-a.y)*(a.x2-a.x))/((a.x2-a.x)*(b.y2-b.y)-(a.y2-a.y)*(b.x2-b.x)) AS u, a.x AS ax, a.y AS ay, a.x2-a.x AS rx, a.y2-a.y AS ry, a.t1-a.length AS fa, a.length AS la, a.total AS ta,
 b.t1-b.length AS fb, b.length AS lb, b.total AS tb FROM seg a JOIN seg b ON a.net = b.net AND a.edge < b.edge WHERE abs((a.x2-a.x)*(b.y2-b.y)-(a.y2-a.y)*(b.x2-b.x)) >= 1e-12)
 WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 AND fa+t*la > 4 AND fa+t*la < ta-4 AND fb+u*lb > 4 AND fb+u*lb < tb-4),
place AS (SELECT *, ax+t*rx AS px, ay+t*ry AS py, floor((ax+t*rx)*8e0+0.5e0)::BIGINT AS vx, floor((ay+t*ry)*8e0+0.5e0)::BIGINT AS vy FROM hit),
cuts AS (SELECT net, ea AS edge, fa+t*la AS d, vx, vy FROM place UNION ALL SELECT net, eb, fb+u*lb, vx, vy FROM place),
kept AS (SELECT net, edge, list_reduce(list_transform(list_sort(list({'d': d, 'vx': vx, 'vy': vy})), lambda c: [c]),
 lambda s, c: CASE WHEN (s[-1].vx = c[1].vx AND s[-1].vy = c[1].vy) OR c[1].d - s[-1].d < 1 THEN s ELSE list_concat(s, c) END) AS k FROM cuts GROUP BY net, edge),
tot AS (SELECT net, edge, coalesce(sum(sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y))), 0) AS total FROM st GROUP BY net, edge),
stop AS (SELECT net, edge, list_concat([{'d': 0e0, 'vx': NULL::BIGINT, 'vy': NULL::BIGINT}], coalesce(k, []), [{'d': total, 'vx': NULL, 'vy': NULL}]) AS s FROM tot LEFT JOIN kept USING (net, edge)),
part AS (SELECT net, edge, i - 1 AS part, s[i].d AS d0, s[i+1].d AS d1, s[i].vx AS vx0, s[i].vy AS vy0, s[i+1].vx AS vx1, s[i+1].vy AS vy1 FROM (SELECT *, unnest(range(1, len(s))) AS i FROM stop))"""


def planar(spark, d):
    paths = V.crossing_paths(spark, d)
    return paths, P.planar_parts(paths, P.crossings(paths, 64.0))


@query("WITH " + ARC + f""" SELECT net, edge, part, {four('d0')} AS d0, {four('d1')} AS d1, coalesce(vx0, -1) AS vx0, coalesce(vy0, -1) AS vy0, coalesce(vx1, -1) AS vx1, coalesce(vy1, -1) AS vy1
FROM part""", "item", "crosspath")
def planar_parts(spark, d):
    ends = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("vx0", "vy0", "vx1", "vy1")]
    return planar(spark, d)[1].select("net", "edge", "part", r4("d0"), r4("d1"), *ends)


FIRST_PAIR = "{'a': ea, 'b': sa, 'c': eb, 'd': sb}"


@query("WITH " + ARC + f" SELECT net, vx, vy, {four(f'arg_min(px, {FIRST_PAIR})')} AS x, {four(f'arg_min(py, {FIRST_PAIR})')} AS y FROM place GROUP BY net, vx, vy", "item", "crosspath")
def crossing_nodes(spark, d):
    nodes = P.crossing_nodes(P.crossings(V.crossing_paths(spark, d), 64.0))
    return nodes.select("net", "vx", "vy", r4("x"), r4("y"))


@query("WITH " + ARC + """, on_ AS (SELECT p.net, p.edge, part, d0, d1, s.* EXCLUDE (net, edge), s.t1 - s.length AS f, s.seq = min(s.seq) OVER w AS first, s.seq = max(s.seq) OVER w AS last
 FROM part p JOIN seg s USING (net, edge) WINDOW w AS (PARTITION BY p.net, p.edge)),
pt AS (SELECT net, edge, part, 0 AS k, d0 AS arc, seq, CASE WHEN length > 0 THEN x + greatest(0, least(1, (d0-f)/length))*(x2-x) ELSE x END AS x, CASE WHEN length > 0 THEN y + greatest(0, least(1, (d0-f)/length))*(y2-y) ELSE y END AS y
 FROM on_ WHERE (d0 > f OR first) AND (d0 <= t1 OR last)
 UNION ALL SELECT net, edge, part, 1, t1, seq, x2, y2 FROM on_ WHERE t1 > d0 + 1e-9 AND t1 < d1 - 1e-9
 UNION ALL SELECT net, edge, part, 2, d1, seq, CASE WHEN length > 0 THEN x + greatest(0, least(1, (d1-f)/length))*(x2-x) ELSE x END, CASE WHEN length > 0 THEN y + greatest(0, least(1, (d1-f)/length))*(y2-y) ELSE y END
 FROM on_ WHERE (d1 > f OR first) AND (d1 <= t1 OR last))
SELECT net, edge, part, row_number() OVER (PARTITION BY net, edge, part ORDER BY k, arc, seq) - 1 AS seq, """ + f"{four('x')} AS x, {four('y')} AS y FROM pt", "item", "crosspath")
def planar_points(spark, d):
    paths, parts = planar(spark, d)
    return P.sliced(paths, parts).select("net", "edge", "part", "seq", r4("x"), r4("y"))


ENDS = """ends AS (SELECT net, unnest([a, b]) AS node, lines FROM walk), per AS (SELECT net, node FROM ends GROUP BY net, node HAVING count(*) <> 2 OR min(lines) <> max(lines)),
dart AS (SELECT net, edge, 0 AS way, a AS tail, b AS head FROM walk UNION ALL SELECT net, edge, 1, b, a FROM walk),
nx AS (SELECT d.net, d.edge, d.way, d.tail, d.head, n.edge AS next_edge, n.way AS next_way FROM dart d LEFT JOIN dart n ON d.net = n.net AND d.head = n.tail AND n.edge <> d.edge
 AND NOT EXISTS (SELECT 1 FROM per p WHERE p.net = d.net AND p.node = d.head)),
go AS (SELECT net, edge, way, tail, edge AS at_edge, way AS at_way, head, 0 AS k FROM nx UNION SELECT g.net, g.edge, g.way, g.tail, n.edge, n.way, n.head, k + 1
 FROM go g JOIN nx m ON m.net = g.net AND m.edge = g.at_edge AND m.way = g.at_way JOIN nx n ON n.net = m.net AND n.edge = m.next_edge AND n.way = m.next_way WHERE k < 250 AND NOT (n.edge = g.edge AND n.way = g.way)),
far AS (SELECT g.net, g.edge, g.way, g.tail, g.k, g.head, m.next_edge IS NULL AS done FROM go g JOIN nx m ON m.net = g.net AND m.edge = g.at_edge AND m.way = g.at_way),
seen AS (SELECT net, edge, way, any_value(tail) AS tail, bool_or(done) AS done, max(k) AS k, arg_max(head, k) AS fin, list_reverse_sort(list(head) FILTER (NOT done)) AS inside FROM far GROUP BY net, edge, way),
more AS (SELECT net, inside[1] AS node FROM seen WHERE done AND fin = tail AND k > 0 AND EXISTS (SELECT 1 FROM per p WHERE p.net = seen.net AND p.node = seen.tail)
 UNION SELECT net, unnest(inside[1:2]) FROM seen WHERE NOT done),
anch AS (SELECT * FROM per UNION SELECT * FROM more),
nx2 AS (SELECT d.net, d.edge, d.way, d.tail, d.head, n.edge AS next_edge, n.way AS next_way FROM dart d LEFT JOIN dart n ON d.net = n.net AND d.head = n.tail AND n.edge <> d.edge
 AND NOT EXISTS (SELECT 1 FROM anch p WHERE p.net = d.net AND p.node = d.head)),
go2 AS (SELECT net, edge AS chain, tail AS start, edge, way, head, 0 AS place FROM nx2 WHERE EXISTS (SELECT 1 FROM anch p WHERE p.net = nx2.net AND p.node = nx2.tail)
 UNION ALL SELECT g.net, chain, start, n.edge, n.way, n.head, place + 1 FROM go2 g JOIN nx2 m ON m.net = g.net AND m.edge = g.edge AND m.way = g.way JOIN nx2 n ON n.net = m.net AND n.edge = m.next_edge AND n.way = m.next_way),
both_ AS (SELECT *, arg_max(head, place) OVER (PARTITION BY net, chain, start) AS fin FROM (SELECT * FROM go2)),
pick AS (SELECT net, chain, place, edge, way = 1 AS reversed, start, fin AS "end" FROM both_ QUALIFY row_number() OVER (PARTITION BY net, edge ORDER BY start, chain, way) = 1)"""


@query("WITH RECURSIVE " + ENDS.replace("ends AS", "ends AS", 1) + """ SELECT net, chain, place::BIGINT AS place, edge, reversed, start, "end" FROM pick""", "walk")
def contracted_chains(spark, d):
    return P.contracted(V.walk_edges(spark, d))


@query("WITH RECURSIVE " + ENDS + """, pt AS (SELECT p.net, chain, place, CASE WHEN reversed THEN 1 - k ELSE k END AS o, CASE WHEN k = 0 THEN a ELSE b END AS node FROM pick p JOIN walk w USING (net, edge), (VALUES (0), (1)) v(k))
SELECT net, chain, row_number() OVER (PARTITION BY net, chain ORDER BY place, o) - 1 AS seq, node * 3e0 AS x, node % 7 * 5e0 AS y FROM pt WHERE place = 0 OR o = 1""", "walk")
def chain_points(spark, d):
    edges = V.walk_edges(spark, d)
    at = lambda k, n: F.struct(F.lit(k).cast("long").alias("seq"), (F.col(n) * 3.0).alias("x"), (F.col(n) % 7 * 5.0).alias("y"))
    points = edges.select("net", "edge", F.explode(F.array(at(0, "a"), at(1, "b"))).alias("p")).select("net", "edge", "p.*")
    return P.chain_points(points, P.contracted(edges))


def line_edges(spark, d):
    return V.walk_edges(spark, d).withColumn("line", F.explode(F.split("lines", ",")))


ADJ = """adj AS (SELECT net, line, edge, a AS node, b AS nxt, length FROM le UNION ALL SELECT net, line, edge, b, a, length FROM le)"""
REACH = """le AS (SELECT net, unnest(string_split(lines, ',')) AS line, edge, a, b, length FROM walk), """ + ADJ + """, src AS (SELECT DISTINCT net, line, node FROM adj WHERE node % 40 = 0),
dist USING KEY (net, line, source, node) AS (SELECT net, line, node AS source, node, 0e0 AS distance FROM src UNION
 SELECT d.net, d.line, d.source, a.nxt, min(d.distance + a.length) FROM dist d JOIN adj a ON a.net = d.net AND a.line = d.line AND a.node = d.node
 LEFT JOIN recurring.dist k ON k.net = d.net AND k.line = d.line AND k.source = d.source AND k.node = a.nxt
 WHERE d.distance + a.length <= 150 AND (k.distance IS NULL OR d.distance + a.length < k.distance) GROUP BY ALL),
best AS (SELECT d.net, d.line, d.source, d.node, any_value(d.distance) AS distance, min(a.edge) AS via FROM dist d LEFT JOIN (SELECT p.net, p.line, p.source, a.nxt, a.edge, p.distance + a.length AS distance
 FROM dist p JOIN adj a ON a.net = p.net AND a.line = p.line AND a.node = p.node) a ON a.net = d.net AND a.line = d.line AND a.source = d.source AND a.nxt = d.node AND a.distance = d.distance GROUP BY 1, 2, 3, 4)"""


@query("WITH RECURSIVE " + REACH + " SELECT net, line, source, node, distance, CASE WHEN node <> source THEN via ELSE -1 END AS via FROM best", "walk")
def shortest_paths(spark, d):
    edges = line_edges(spark, d)
    ends = edges.select("net", "line", F.explode(F.array("a", "b")).alias("node")).filter("node % 40 = 0")
    return P.shortest(edges, ends, 150.0).withColumn("via", F.coalesce("via", F.lit(-1)))


@query("WITH RECURSIVE " + REACH + """, fine AS (SELECT * FROM best WHERE node <> source),
trace AS (SELECT net, line, source, node AS target, 0 AS back, node, via FROM fine WHERE node % 3 = 0 UNION ALL
 SELECT t.net, t.line, t.source, t.target, back + 1, f.node, f.via FROM trace t JOIN le e ON e.net = t.net AND e.line = t.line AND e.edge = t.via
 JOIN fine f ON f.net = t.net AND f.line = t.line AND f.source = t.source AND f.node = CASE WHEN e.a = t.node THEN e.b ELSE e.a END)
SELECT t.net, t.line, source, target, back::BIGINT AS back, via AS edge, e.a = t.node AS reversed FROM trace t JOIN le e ON e.net = t.net AND e.line = t.line AND e.edge = t.via""", "walk")
def traced_paths(spark, d):
    edges = line_edges(spark, d)
    ends = edges.select("net", "line", F.explode(F.array("a", "b")).alias("node")).filter("node % 40 = 0")
    best = P.shortest(edges, ends, 150.0)
    return P.traced(best, edges, best.filter("node <> source AND node % 3 = 0").select("net", "line", "source", "node"))
