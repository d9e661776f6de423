"""Registered queries of label packing and of combo geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshline.operators import corridors as C, labels as L
from meshline.plans.queries import query
from meshline.sources import network as V

LABELS = """lab AS (SELECT id, repeat('m', (3 + id % 9)::INT) AS label, x, y FROM point),
mark AS (SELECT id, k AS mark, x + 16e0 * k * (1 + id % 2) + CASE WHEN id % 5 = 0 THEN 14e0 ELSE 0e0 END AS x, y + 4e0 * k AS y FROM point, range(3) t(k) WHERE k <= id % 3),
anch AS (SELECT id, label, CASE WHEN n >= 2 AND d > 110.25e0 THEN mx ELSE x END AS ax, CASE WHEN n >= 2 AND d > 110.25e0 THEN my ELSE y END AS ay FROM (SELECT l.*, n, m.d, m.mx, m.my FROM lab l JOIN
 (SELECT m.id, count(*) AS n, min({'d': (m.x-l.x)*(m.x-l.x)+(m.y-l.y)*(m.y-l.y), 'mark': mark, 'mx': m.x, 'my': m.y}) AS m FROM mark m JOIN lab l USING (id) GROUP BY m.id) USING (id))),
cand AS (SELECT id, c, ax + length(label)*6e0*wx + ox*12e0 AS x0, ay + hy*13e0 + oy*12e0 AS y0, length(label)*6e0 AS w, rank FROM anch, (VALUES (0,0.0e0,-0.5e0,1.0e0,0.0e0,1), (1,-1,-0.5,-1,0,1), (2,-0.5,-1,0,-1,2),
 (3,-0.5,0,0,1,2), (4,0,-1,0.7,-0.7,3), (5,-1,-1,-0.7,-0.7,3), (6,0,0,0.7,0.7,3), (7,-1,0,-0.7,0.7,3)) p(c, wx, hy, ox, oy, rank)),
box AS (SELECT id, c, x0, y0, x0 + w AS x1, y0 + 13e0 AS y1, rank FROM cand),
cover AS (SELECT id, min(x) - 2.4499999999999997e0 AS x0, min(y) - 2.4499999999999997e0 AS y0, max(x) + 2.4499999999999997e0 AS x1, max(y) + 2.4499999999999997e0 AS y1 FROM mark GROUP BY id),
seg AS (SELECT * FROM (SELECT id AS seg, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM point WHERE id % 5 = 0 WINDOW w AS (PARTITION BY label ORDER BY id)) WHERE x2 IS NOT NULL)"""


def _turn(o: str, a: str, b: str) -> str:
    (ox, oy), (ax, ay), (bx, by) = (p.split() for p in (o, a, b))
    return f"(({by}-{oy})*({ax}-{ox})-({ay}-{oy})*({bx}-{ox}) > 0)"


def _crossed() -> str:
    p, q, corners = "s.x s.y", "s.x2 s.y2", ["b.x0 b.y0", "b.x1 b.y0", "b.x1 b.y1", "b.x0 b.y1"]
    sides = zip(corners, corners[1:] + corners[:1], strict=True)
    return " OR ".join(f"({_turn(c, d, p)} <> {_turn(c, d, q)} AND {_turn(p, q, c)} <> {_turn(p, q, d)})" for c, d in sides)


def parts(spark, d):
    p = V.points(spark, d)
    labels = p.select("id", F.repeat(F.lit("m"), (3 + F.col("id") % 9).cast("int")).alias("label"), "x", "y")
    k = F.explode(F.sequence(F.lit(0), (F.col("id") % 3).cast("int")))
    m = p.withColumn("mark", k)
    x = F.col("x") + F.lit(16.0) * F.col("mark") * (1 + F.col("id") % 2) + F.when(F.col("id") % 5 == 0, 14.0).otherwise(0.0)
    marks = m.select("id", "mark", x.alias("x"), (F.col("y") + F.lit(4.0) * F.col("mark")).alias("y"))
    segments = L.chain_segments(p.filter("id % 5 = 0").withColumnRenamed("label", "line"))
    return labels, marks, segments


@query("WITH " + LABELS + f""" SELECT b.id, b.c::BIGINT AS c, (30 * (SELECT count(*) FROM cover m WHERE b.x0 < m.x1 AND b.x1 > m.x0 AND b.y0 < m.y1 AND b.y1 > m.y0) + 12 * (SELECT count(*) FROM seg s
 WHERE greatest(s.x, s.x2) >= b.x0 AND least(s.x, s.x2) <= b.x1 AND greatest(s.y, s.y2) >= b.y0 AND least(s.y, s.y2) <= b.y1
 AND ((s.x BETWEEN b.x0 AND b.x1 AND s.y BETWEEN b.y0 AND b.y1) OR (s.x2 BETWEEN b.x0 AND b.x1 AND s.y2 BETWEEN b.y0 AND b.y1) OR {_crossed()})) + b.rank)::BIGINT AS cost FROM box b""", "point")
def label_costs(spark, d):
    labels, marks, segments = parts(spark, d)
    return L.place_costs(L.candidates(L.anchors(labels, marks)), marks, segments).select("id", F.col("c").cast("long").alias("c"), "cost")


@query()
def packed_labels(spark, d):
    """The greedy choice depends on what was chosen before; a test holds it against the loop."""
    labels, marks, segments = parts(spark, d)
    costs = L.place_costs(L.candidates(L.anchors(labels, marks)), marks, segments)
    return L.packed(costs, L.longest_first(labels))


NEAR = "sqrt(({0}.x-{1}.x)*({0}.x-{1}.x)+({0}.y-{1}.y)*({0}.y-{1}.y)) <= {2}"
FIRST, LAST, START, END = "s.pts[1]", "s.pts[-1]", "n.pts[1]", "n.pts[-1]"
REPEATS = f"""(({NEAR.format(START, FIRST, '2e-4')} AND {NEAR.format(END, LAST, '2e-4')}) OR ({NEAR.format(START, LAST, '2e-4')} AND {NEAR.format(END, FIRST, '2e-4')})
 OR ({NEAR.format(LAST, START, '1e-5')} AND {NEAR.format(END, FIRST, '2e-4')}))"""
COURSE = f"""line AS (SELECT route, combo, pos, grp, list_filter(c, lambda p, i: i = 1 OR p <> c[i-1]) AS pts FROM (SELECT k.*, grp, CASE WHEN reversed THEN list_reverse(coords) ELSE coords END AS c FROM combo k JOIN track USING (track))),
course AS (SELECT route, combo, list_reduce(list_prepend({{'pts': []::STRUCT(x DOUBLE, y DOUBLE)[], 'grp': NULL::BIGINT}}, list({{'pts': pts, 'grp': grp}} ORDER BY pos)), lambda s, n:
 {{'pts': CASE WHEN CASE WHEN n.grp IS NOT NULL THEN s.grp IS NULL OR n.grp <> s.grp ELSE len(s.pts) < 2 OR NOT {REPEATS} END
  THEN list_concat(s.pts, CASE WHEN len(s.pts) > 0 AND s.pts[-1] = n.pts[1] THEN n.pts[2:] ELSE n.pts END) ELSE s.pts END, 'grp': coalesce(n.grp, s.grp)}}).pts AS pts FROM line GROUP BY route, combo)"""


def courses(spark, d):
    combos = V.combos(spark, d)
    steps = combos.select("route", "combo", F.posexplode("path").alias("pos", "s")).select("route", "combo", "pos", "s.track", "s.reversed")
    return combos, C.combo_courses(steps, V.tracks(spark, d), "route", "combo", rows=3 * V.table(spark, d, "lineitem").count())


@query("WITH " + COURSE + " SELECT route, combo, i - 1 AS seq, pts[i].x AS x, pts[i].y AS y FROM (SELECT *, unnest(range(1, len(pts) + 1)) AS i FROM course)", "item", "combo")
def combo_courses(spark, d):
    c = courses(spark, d)[1].select("route", "combo", F.posexplode("course").alias("seq", "p"))
    return c.select("route", "combo", F.col("seq").cast("long").alias("seq"), "p.x", "p.y")


@query("WITH " + COURSE + """, grp_ AS (SELECT s_suppkey AS node, s_nationkey::BIGINT AS g FROM supplier),
found AS (SELECT a.g AS a, b.g AS b, arg_min(pts, {'r': route, 'c': combo}) AS pts FROM (SELECT DISTINCT route, combo, start_node, end_node FROM combo) JOIN course USING (route, combo)
 JOIN grp_ a ON a.node = start_node JOIN grp_ b ON b.node = end_node WHERE a.g <> b.g AND len(pts) >= 2 GROUP BY ALL),
edge AS (SELECT DISTINCT least(a.s_nationkey, b.s_nationkey)::BIGINT AS a, greatest(a.s_nationkey, b.s_nationkey)::BIGINT AS b FROM supplier a JOIN supplier b ON a.s_nationkey <> b.s_nationkey AND (a.s_suppkey + b.s_suppkey) % 3 = 0),
met AS (SELECT e.a, e.b, coalesce(f.pts, list_reverse(r.pts)) AS pts FROM edge e LEFT JOIN found f ON f.a = e.a AND f.b = e.b LEFT JOIN found r ON r.a = e.b AND r.b = e.a)
SELECT a, b, i - 1 AS seq, pts[i].x AS x, pts[i].y AS y FROM (SELECT *, unnest(range(1, len(pts) + 1)) AS i FROM met)""", "item", "combo")
def edge_corridors(spark, d):
    combos, drawn = courses(spark, d)
    groups = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").cast("long").alias("grp"))
    side = lambda c: groups.select((F.col("node") % 3).alias("m") if c == "a" else F.pmod(-F.col("node"), F.lit(3)).alias("m"), F.col("grp").alias(c)).distinct()
    edges = side("a").join(side("b"), "m").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = C.attached(edges, C.corridors(combos, drawn, groups)).select("a", "b", F.posexplode("course").alias("seq", "p"))
    return met.select("a", "b", F.col("seq").cast("long").alias("seq"), "p.x", "p.y")
