"""Registered queries of bodies, farthest pairs and warps."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshline.operators import bodies as B, warps as W
from meshline.plans.path_queries import four, r4
from meshline.plans.queries import query
from meshline.sources import network as V

PLACED = """side AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM shape WINDOW w AS (PARTITION BY ring ORDER BY i)),
m AS (SELECT ring, abs(sum(x*y2-x2*y))/2 AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, arg_min(x, i) AS ax, arg_min(y, i) AS ay FROM side GROUP BY ring),
near AS (SELECT a.ring AS inner_, b.ring AS outer_ FROM m a JOIN m b ON b.area > a.area AND a.x0 >= b.x0 AND a.y0 >= b.y0 AND a.x1 <= b.x1 AND a.y1 <= b.y1),
vote AS (SELECT inner_, outer_, v.i FROM near JOIN side v ON v.ring = inner_ AND list_contains(list_transform(range(7), lambda s: floor(s * 8 / 7)::BIGINT), v.i)
 JOIN side s ON s.ring = outer_ AND (s.y > v.y) <> (s.y2 > v.y) AND v.x < (s.x2-s.x)*(v.y-s.y)/(s.y2-s.y)+s.x GROUP BY ALL HAVING count(*) % 2 = 1),
held AS (SELECT inner_, outer_ FROM vote GROUP BY ALL HAVING count(*) * 2 > 7),
up AS (SELECT inner_, count(*) AS depth, arg_min(outer_, {'a': area, 'r': outer_}) AS parent FROM held JOIN m ON m.ring = outer_ GROUP BY inner_),
placed AS (SELECT ring, area, ax, ay, coalesce(depth, 0) AS depth, parent, CASE WHEN coalesce(depth, 0) % 2 = 0 THEN ring ELSE parent END AS body FROM m LEFT JOIN up ON inner_ = ring),
body AS (SELECT p.body, p.area, p.ax, p.ay, (SELECT count(*) FROM placed h WHERE h.body = p.body AND h.depth % 2 = 1) AS holes FROM placed p WHERE p.depth % 2 = 0)"""


@query("WITH " + PLACED + " SELECT ring, depth, coalesce(parent, -1) AS parent, body FROM placed", "shape")
def ring_places(spark, d):
    return B.decomposed(V.shapes(spark, d)).select("ring", "depth", F.coalesce("parent", F.lit(-1)).alias("parent"), "body")


@query("WITH " + PLACED + " SELECT body, area, ax, ay, holes FROM body", "shape")
def water_bodies(spark, d):
    return B.water_bodies(V.shapes(spark, d))


@query("WITH " + PLACED + " SELECT body, area, holes FROM body WHERE area >= 20 AND area >= (SELECT max(area) FROM body) * 0.05e0 ORDER BY area DESC, ax, ay, body LIMIT 40", "shape")
def kept_bodies(spark, d):
    return B.kept_bodies(B.water_bodies(V.shapes(spark, d)), most=40, share=0.05, least=20.0).select("body", "area", "holes")


@query("""WITH d AS (SELECT a.line AS node, a.seq AS a, b.seq AS b, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) AS d FROM polyline a JOIN polyline b ON a.line = b.line AND a.seq <= b.seq)
SELECT node, a, b, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY node ORDER BY d DESC, a, b) = 1""", "polyline")
def farthest_pairs(spark, d):
    marks = V.polylines(spark, d).select(F.col("line").alias("node"), F.col("seq").alias("id"), "x", "y")
    return B.farthest_pairs(marks).select("node", "a", "b", F.round("distance", 6).alias("distance"))


BOX = (0.0, 0.0, 2700.0, 2700.0)


def _axis(axis: str) -> str:
    """The warp's shares and running sums along one axis, as ``axis_knots`` makes them, in list functions."""
    kernel = W._kernel(2.5)
    r, weight = len(kernel) // 2, sum(kernel)
    cap, low = (8.0 - 0.4) / (0.6 * 96), 0.0
    ctes = [
        f"""h{axis} AS (SELECT label, list(coalesce(n, 0)::DOUBLE ORDER BY b) AS h FROM (SELECT DISTINCT label FROM point), range(96) t(b)
 LEFT JOIN (SELECT label AS l, least(95, greatest(0, floor(({axis} - 0e0) / 2700e0 * 96)))::BIGINT AS bin, count(*) AS n FROM point GROUP BY ALL) ON l = label AND bin = b GROUP BY label)""",
        f"""s{axis} AS (SELECT label, list_transform(range(96), lambda i: list_reduce(list_prepend(0e0, list_transform(range(-{r}, {r + 1}),
 lambda j: h[greatest(0, least(95, i + j)) + 1] * ({kernel!r})[j + {r + 1}]::DOUBLE)), lambda a, b: a + b) / {weight!r}::DOUBLE) AS hs FROM h{axis})""",
        f"r{axis}0 AS (SELECT label, list_transform(hs, lambda v: {(1 - 0.7) / 96!r}::DOUBLE + 0.7e0 * v / list_reduce(list_prepend(0e0, hs), lambda a, b: a + b)) AS rho FROM s{axis})",
    ]
    for k in range(16):
        ctes += [
            f"c{axis}{k} AS (SELECT label, list_transform(rho, lambda v: greatest({low!r}::DOUBLE, least({cap!r}::DOUBLE, v))) AS rho FROM r{axis}{k})",
            f"""r{axis}{k + 1} AS (SELECT label, CASE WHEN abs(t - 1) < 1e-9 THEN rho ELSE list_transform(rho, lambda v: v / t) END AS rho
 FROM (SELECT *, list_reduce(list_prepend(0e0, rho), lambda a, b: a + b) AS t FROM c{axis}{k}))""",
        ]
    ctes.append(f"k{axis} AS (SELECT label, rho, list_transform(range(97), lambda i: list_reduce(list_prepend(0e0, rho[1:i]), lambda a, b: a + b)) AS cdf FROM r{axis}16)")
    ctes.append(f"n{axis} AS (SELECT label, list_transform(rho, lambda v: v / cdf[97]) AS rho_{axis}, list_transform(cdf, lambda v: v / cdf[97]) AS cdf_{axis} FROM k{axis})")
    return ",\n".join(ctes)


def _place(axis: str) -> str:
    t, i = f"({axis} / 2700e0)", f"least(95, floor({axis} / 2700e0 * 96))::BIGINT"
    share = f"CASE WHEN {t} <= 0 THEN {t}*96*rho_{axis}[1] WHEN {t} >= 1 THEN 1 + ({t}-1)*96*rho_{axis}[96] ELSE cdf_{axis}[{i} + 1] + ({t}*96 - {i})*rho_{axis}[{i} + 1] END"
    return f"0.4e0 * {axis} + 0.6e0 * (2700e0 * ({share}))"


def _points(spark, d):
    return V.points(spark, d).withColumnRenamed("label", "net")


@query("WITH " + _axis("x") + ",\n" + _axis("y") + f" SELECT p.id, p.label AS net, {four(_place('x'))} AS x, {four(_place('y'))} AS y FROM point p JOIN nx USING (label) JOIN ny USING (label)", "point")
def density_warp(spark, d):
    p = _points(spark, d)
    return W.applied(p, W.separable(p, *BOX), *BOX).select("id", "net", r4("x"), r4("y"))


@query("SELECT id, round(x, 5) AS x, round(y, 5) AS y FROM point", "point")
def density_unwarp(spark, d):
    """There and back again: the places are the old ones."""
    p = _points(spark, d)
    warp = W.separable(p, *BOX)
    return W.applied(W.applied(p, warp, *BOX), warp, *BOX, back=True).select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query()
def density_flow(spark, d):
    p = _points(spark, d)
    steps = W.flow(p, *BOX, rounds=2, bins=32, reach=300.0)
    return W.moved(p, steps, *BOX, bins=32).select("id", "net", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
