"""Registered queries of nodes near places, spurs and hidden labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshline.operators import nearby as N
from meshline.plans.queries import query
from meshline.sources import network as V


@query("""WITH node AS (SELECT id, x, y FROM point WHERE id % 4 = 0), nl AS (SELECT id AS node, id % 3 AS line FROM node UNION SELECT id, id % 5 FROM node),
d AS (SELECT p.id, n.id AS node, sqrt((p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y)) AS d, EXISTS (SELECT 1 FROM nl WHERE nl.node = n.id AND nl.line = p.id % 5) AS s FROM point p JOIN node n ON abs(p.x-n.x) <= 240 AND abs(p.y-n.y) <= 240),
b AS (SELECT id, min({'d': d, 'n': node}) FILTER (s AND d <= 240) AS own, min({'d': d, 'n': node}) FILTER (d <= 80) AS other FROM d GROUP BY id)
SELECT id, coalesce(own.n, other.n) AS node, own IS NOT NULL AS serves FROM b WHERE own IS NOT NULL OR other IS NOT NULL""", "point")
def nearest_serving_nodes(spark, d):
    p = V.points(spark, d)
    nodes = p.filter("id % 4 = 0").select("id", "x", "y")
    lines = nodes.select(F.col("id").alias("node"), F.explode(F.array(F.col("id") % 3, F.col("id") % 5)).alias("line"))
    return N.nearest_serving(p.withColumn("line", F.col("id") % 5), nodes, lines, 80.0)


@query("""WITH g AS (SELECT id, col, r AS "row", sqrt((col*40e0-x)*(col*40e0-x)+(r*40e0-y)*(r*40e0-y)) AS d FROM point, range(50) a(col), range(50) b(r) WHERE abs(col*40-x) < 100 AND abs(r*40-y) < 100)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY d, col, "row") AS place, col, "row" FROM g WHERE d < 100 AND NOT EXISTS (SELECT 1 FROM cell c WHERE c.col % 50 = g.col AND c."row" = g."row" AND c.col < 200)""", "point", "cell")
def grid_candidates(spark, d):
    closed = V.cells(spark, d).filter("col < 200").select((F.col("col") % 50).alias("col"), "row")
    return N.grid_candidates(V.points(spark, d), closed, 40.0, 50, 50, 2.5)


@query("""WITH s AS (SELECT net, route AS line, seq AS step, part % 3 AS edge, supp % 2 = 0 AS reversed FROM item), f AS (SELECT DISTINCT net, route AS line, part % 3 AS edge, part % 3 = 1 AS at_from, route % 4 = 0 AS at_to FROM item),
l AS (SELECT net, line, list({'edge': edge, 'reversed': reversed, 'far': CASE WHEN reversed THEN at_from ELSE at_to END} ORDER BY step) AS a FROM s JOIN f USING (net, line, edge) GROUP BY net, line),
r AS (SELECT net, line, list_reduce(list_prepend([]::STRUCT(edge BIGINT, reversed BOOLEAN, far BOOLEAN)[], list_transform(a, lambda x: [x])), lambda k, n: CASE WHEN len(k) > 0 AND k[-1].edge = n[1].edge AND k[-1].reversed <> n[1].reversed AND NOT k[-1].far
 THEN k[1:len(k)-1] ELSE list_concat(k, n) END) AS k FROM l)
SELECT net, line, i - 1 AS place, k[i].edge AS edge, k[i].reversed AS reversed FROM (SELECT *, unnest(range(1, len(k) + 1)) AS i FROM r)""", "item")
def spurless_traversals(spark, d):
    i = V._items(spark, d)
    steps = i.select("net", F.col("route").alias("line"), F.col("seq").alias("step"), (F.col("part") % 3).alias("edge"), (F.col("supp") % 2 == 0).alias("reversed"))
    stops = steps.select("net", "line", "edge", (F.col("edge") == 1).alias("at_from"), (F.col("line") % 4 == 0).alias("at_to"))
    return N.without_spurs(steps, stops)


@query("""WITH b AS (SELECT id, x AS ax, y AS ay, x + 4e0*1.25e0 AS ox, y - 3e0*1.25e0 AS oy, (3 + id % 9)*7.5e0 AS w, (9 + id % 4)*1.25e0 AS h FROM point),
l AS (SELECT id, ax, ay, CASE id % 3 WHEN 0 THEN ox - w/2 WHEN 1 THEN ox - w ELSE ox END AS x0, oy - h*0.8e0 AS y0, w, oy + h*0.2e0 AS y1 FROM b),
c AS (SELECT x - 30 AS x0, y - 20 AS y0, x + 5 AS x1, y + 60 AS y1 FROM point WHERE id % 20 = 0)
SELECT id FROM l WHERE EXISTS (SELECT 1 FROM c WHERE (ax BETWEEN c.x0 AND c.x1 AND ay BETWEEN c.y0 AND c.y1) OR (l.x0 < c.x1 AND l.x0 + w > c.x0 AND l.y0 < c.y1 AND l.y1 > c.y0))""", "point")
def hidden_labels(spark, d):
    p = V.points(spark, d)
    align = F.when(F.col("id") % 3 == 0, "center").when(F.col("id") % 3 == 1, "right").otherwise("left")
    text = F.repeat(F.lit("m"), (3 + F.col("id") % 9).cast("int"))
    labels = p.select("id", text.alias("text"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.lit(4.0).alias("x"), F.lit(-3.0).alias("y"), (9 + F.col("id") % 4).alias("size"), align.alias("align"))
    cut = p.filter("id % 20 = 0").select((F.col("x") - 30).alias("x0"), (F.col("y") - 20).alias("y0"), (F.col("x") + 5).alias("x1"), (F.col("y") + 60).alias("y1"))
    return N.hidden_labels(N.label_boxes(labels, 1.25), cut, 64.0)
