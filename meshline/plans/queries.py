"""Registered queries of the network, geometry, raster and scalar operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meshline.functions import scalars as S
from meshline.operators import entry as E, geometry as G, network as N, raster as R
from meshline.sources import network as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name; ``views`` are the derived tables that its SQL needs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            head = ", ".join(V.SQL[v] for v in views)
            body = sql.strip()
            if head:
                start = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
                body = f"{start}{head}, {body.removeprefix(start)}" if body.startswith(start) else f"WITH {head} {body}"
            ORACLE_SQL[f.__name__] = body
        return f

    return add


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


# --- network -----------------------------------------------------------------------------------------------------

VISIT = """visit AS (SELECT route, visit, any_value(grp) AS grp, bool_or(is_stop) AS is_stop FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY route ORDER BY seq) AS visit FROM (
 SELECT *, CASE WHEN lag(grp) OVER (PARTITION BY route ORDER BY seq) = grp THEN 0 ELSE 1 END AS fresh FROM stop)) GROUP BY route, visit)"""
STEP = VISIT + """, step AS (SELECT * FROM (SELECT route, visit, grp AS a, lead(grp) OVER w AS b, is_stop, lead(is_stop) OVER w AS b_stop
 FROM visit WINDOW w AS (PARTITION BY route ORDER BY visit)) WHERE b IS NOT NULL)"""
LINE = STEP + """, line AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v, route FROM step)"""
GROUP = """grp_ AS (SELECT grp, arg_min(name, id) AS name, avg(lng) AS lng, avg(lat) AS lat, count(*) AS members FROM station WHERE constructed GROUP BY grp)"""


@query("WITH " + GROUP + " SELECT grp, name, round(lng, 6) AS lng, round(lat, 6) AS lat, members FROM grp_", "station")
def station_groups(spark, d):
    return N.station_groups(V.stations(spark, d)).select("grp", "name", r6("lng"), r6("lat"), "members")


@query("WITH " + VISIT + " SELECT route, visit::BIGINT AS visit, grp, is_stop FROM visit", "stop")
def route_visits(spark, d):
    return N.visits(V.stops(spark, d)).select("route", "visit", "grp", "is_stop")


@query("WITH " + VISIT + """, k AS (SELECT *, lag(grp) OVER (PARTITION BY route ORDER BY visit) AS p FROM visit WHERE is_stop)
SELECT route, row_number() OVER (PARTITION BY route ORDER BY visit) AS visit, grp FROM k WHERE p IS NULL OR p <> grp""", "stop")
def stop_only_visits(spark, d):
    return N.stop_visits(N.visits(V.stops(spark, d)))


@query("WITH " + STEP + """, per AS (SELECT least(a,b) AS u, greatest(a,b) AS v, route, bool_or(CASE WHEN a <= b THEN is_stop ELSE b_stop END) AS su,
 bool_or(CASE WHEN a <= b THEN b_stop ELSE is_stop END) AS sv, min({'route': route, 'visit': visit, 'a': a}) AS f FROM step GROUP BY ALL)
SELECT u, v, count(*) AS routes, bool_or(su) AS stop_u, bool_or(sv) AS stop_v, min(f).a AS from_grp FROM per GROUP BY u, v""", "stop")
def transit_edges(spark, d):
    return N.edges(N.steps(N.visits(V.stops(spark, d))))


@query("WITH " + LINE + """, sig AS (SELECT route, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT route, u || '|' || v AS k FROM line) GROUP BY route),
n AS (SELECT r.*, sig.s FROM route r LEFT JOIN sig USING (route) WHERE NOT temp)
SELECT route, CASE WHEN trim(bullet) <> '' AND s IS NOT NULL THEN min(route) OVER (PARTITION BY bullet, lower(color), s) ELSE route END AS line FROM n""", "stop", "route")
def canonical_lines(spark, d):
    return N.canonical_lines(V.routes(spark, d), N.edge_lines(N.steps(N.visits(V.stops(spark, d)))))


@query("WITH " + STEP + """, c AS (SELECT route, count(*) AS n FROM step GROUP BY route), l AS (SELECT route, route % 500 AS line FROM route)
SELECT line, arg_min(route, n * -1000000000 + route) AS route, max(n) AS n_steps FROM c JOIN l USING (route) GROUP BY line""", "stop", "route")
def longest_traversals(spark, d):
    lines = V.routes(spark, d).select("route", (F.col("route") % 500).alias("line"))
    return N.longest_traversals(N.steps(N.visits(V.stops(spark, d))), lines)


@query("WITH " + STEP + ", " + GROUP + " SELECT grp, members FROM grp_ WHERE grp IN (SELECT a FROM step UNION SELECT b FROM step)", "stop", "station")
def linked_groups(spark, d):
    edged = N.edges(N.steps(N.visits(V.stops(spark, d))))
    return N.linked_groups(N.station_groups(V.stations(spark, d)), edged).select("grp", "members")


NEAR = """near AS (SELECT a.grp AS a, b.grp AS b, sqrt(dx*dx+dy*dy) AS metres FROM (SELECT a.grp, b.grp, a, b,
 (b.lng-a.lng)*(3.141592653589793e0/180e0)*(floor(cos((a.lat+b.lat)/2e0*(3.141592653589793e0/180e0))*1e9+0.5e0)/1e9)*6371000e0 AS dx,
 (b.lat-a.lat)*(3.141592653589793e0/180e0)*6371000e0 AS dy FROM grp_ a JOIN grp_ b ON a.grp < b.grp))"""


@query("WITH " + GROUP + ", " + NEAR + " SELECT a, b, round(metres, 3) AS metres FROM near WHERE metres > 0.1 AND metres <= 9000", "station")
def transfer_pairs(spark, d):
    return N.transfers(N.station_groups(V.stations(spark, d)), within=9000.0).select("a", "b", F.round("metres", 3).alias("metres"))


@query("WITH " + GROUP + ", " + NEAR + ", " + LINE + """, busy AS (SELECT u, v FROM line GROUP BY u, v HAVING count(*) >= 160) SELECT a, b FROM near
 WHERE metres > 0.1 AND metres <= 9000 AND NOT EXISTS (SELECT 1 FROM busy WHERE u = a AND v = b)""", "station", "stop")
def transfers_without_edges(spark, d):
    busy = N.edges(N.steps(N.visits(V.stops(spark, d)))).filter("routes >= 160")
    return N.transfers(N.station_groups(V.stations(spark, d)), busy, within=9000.0).select("a", "b")


@query("WITH " + LINE + """ SELECT u, v, route, row_number() OVER w - 1 AS slot, (row_number() OVER w - 1 - (count(*) OVER (PARTITION BY u, v) - 1) / 2e0) * 6e0 AS "offset"
 FROM line WINDOW w AS (PARTITION BY u, v ORDER BY route)""", "stop")
def slot_offsets(spark, d):
    return N.slot_offsets(N.edge_lines(N.steps(N.visits(V.stops(spark, d)))))


@query("WITH " + LINE + """, s AS (SELECT *, count(*) OVER (PARTITION BY u, v) AS n, row_number() OVER (PARTITION BY u, v ORDER BY route) - 1 AS slot FROM line)
SELECT route, u, v, (slot - (n - 1) / 2e0) * 6e0 AS "offset" FROM s QUALIFY row_number() OVER (PARTITION BY route ORDER BY n DESC, u, v) = 1""", "stop")
def canonical_offsets(spark, d):
    return N.canonical_offsets(N.edge_lines(N.steps(N.visits(V.stops(spark, d)))))


@query("WITH " + LINE + """, e AS (SELECT u AS node, route FROM line UNION ALL SELECT v, route FROM line)
SELECT node, count(*) AS degree, count(DISTINCT route) AS lines FROM e GROUP BY node""", "stop")
def line_degrees(spark, d):
    return N.line_degrees(N.edge_lines(N.steps(N.visits(V.stops(spark, d)))))


@query("WITH " + STEP + """, k AS (SELECT route, b AS node, least(a,b) || '|' || greatest(a,b) AS e, lead(least(a,b) || '|' || greatest(a,b)) OVER (PARTITION BY route ORDER BY visit) AS f FROM step)
SELECT node, least(e, f) AS edge_a, greatest(e, f) AS edge_b, count(*) AS passes FROM k WHERE f IS NOT NULL AND e <> f GROUP BY ALL""", "stop")
def line_connections(spark, d):
    return N.connections(N.steps(N.visits(V.stops(spark, d))))


@query("""SELECT a.route, count(*) AS inversions FROM stop a JOIN stop b ON a.route = b.route AND a.seq < b.seq AND a.grp > b.grp GROUP BY a.route""", "stop")
def inversion_counts(spark, d):
    return N.inversions(V.stops(spark, d), "route", "seq", "grp")


@query("WITH " + STEP + " SELECT route, visit::BIGINT AS visit, p AS \"end\", a FROM (SELECT *, lag(b) OVER (PARTITION BY route ORDER BY visit) AS p FROM step WHERE is_stop) WHERE p IS NOT NULL AND p <> a", "stop")
def traversal_discontinuities(spark, d):
    return N.discontinuities(N.steps(N.visits(V.stops(spark, d))).filter("is_stop"))


@query("WITH " + STEP + " SELECT DISTINCT route, visit::BIGINT AS visit, a, b FROM step WHERE a < 3 OR b < 3", "stop")
def subgraph_crop(spark, d):
    inside = V.stations(spark, d).filter("grp < 3").select("grp").distinct()
    return N.crop(N.steps(N.visits(V.stops(spark, d))), inside).select("route", "visit", "a", "b")


@query("WITH " + LINE + """, e AS (SELECT u, v, count(*) AS routes FROM line GROUP BY u, v)
SELECT u, v, row_number() OVER (ORDER BY routes DESC, abs(u - v), u, v) AS rank FROM e""", "stop")
def edge_importance(spark, d):
    edged = N.edges(N.steps(N.visits(V.stops(spark, d))))
    return N.order_importance(edged, edged.select("u", "v", F.abs(F.col("u") - F.col("v")).alias("length")))


# --- geometry ----------------------------------------------------------------------------------------------------

SEG = """seg AS (SELECT *, sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) AS length FROM (SELECT line, seq, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2
 FROM polyline WINDOW w AS (PARTITION BY line ORDER BY seq)) WHERE x2 IS NOT NULL)"""


@query("SELECT line, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1 FROM polyline GROUP BY line", "polyline")
def bounding_boxes(spark, d):
    return G.bounds(V.polylines(spark, d), "line").select("line", *[r6(c) for c in ("x0", "y0", "x1", "y1")])


@query("WITH " + SEG + " SELECT line, round(sum(length), 4) AS length FROM seg GROUP BY line", "polyline")
def polyline_lengths(spark, d):
    return G.lengths(V.polylines(spark, d)).select("line", F.round("length", 4).alias("length"))


@query("""SELECT line AS ring, round(sum(x*ny-nx*y)/2e0, 3) AS area FROM (SELECT line, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny
 FROM polyline WINDOW w AS (PARTITION BY line ORDER BY seq)) GROUP BY line""", "polyline")
def ring_areas(spark, d):
    return G.ring_areas(V.polylines(spark, d).withColumnRenamed("line", "ring")).select("ring", F.round("area", 3).alias("area"))


@query("""SELECT line, seq * 2 + k AS seq, round(x*(1e0-t)+nx*t, 6) AS x, round(y*(1e0-t)+ny*t, 6) AS y FROM (SELECT line, seq, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx,
 coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM polyline WINDOW w AS (PARTITION BY line ORDER BY seq)), (VALUES (0, 0.25e0), (1, 0.75e0)) v(k, t)""", "polyline")
def chaikin_pass(spark, d):
    return G.chaikin(V.polylines(spark, d)).select("line", F.col("seq").cast("long").alias("seq"), r6("x"), r6("y"))


@query("""SELECT line, seq FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM polyline WINDOW w AS (PARTITION BY line ORDER BY seq))
WHERE coalesce(CASE WHEN sqrt((x-px)*(x-px)+(y-py)*(y-py))*sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)) > 0 THEN
((x-px)*(nx-x)+(y-py)*(ny-y))/(sqrt((x-px)*(x-px)+(y-py)*(y-py))*sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y))) END >= -0.85e0, true)""", "polyline")
def despike_pass(spark, d):
    return G.despike(V.polylines(spark, d)).select("line", "seq")


BOX = """box AS (SELECT label AS ring, min(x) AS x0, min(y) AS y0, avg(x) AS x1, avg(y) AS y1 FROM point GROUP BY label),
ring AS (SELECT ring, unnest([1,2,3,4]) AS seq, unnest([x0,x1,x1,x0]) AS x, unnest([y0,y0,y1,y1]) AS y FROM box)"""


def boxes(spark, d) -> DataFrame:
    b = V.points(spark, d).groupBy(F.col("label").alias("ring")).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.avg("x").alias("x1"), F.avg("y").alias("y1"))
    corner = lambda i, x, y: F.struct(F.lit(i).alias("seq"), F.col(x).alias("x"), F.col(y).alias("y"))
    return b.select("ring", F.inline(F.array(corner(1, "x0", "y0"), corner(2, "x1", "y0"), corner(3, "x1", "y1"), corner(4, "x0", "y1"))))


@query("WITH " + BOX + """ SELECT p.id, b.ring FROM point p JOIN box b ON p.y >= b.y0 AND p.y < b.y1 AND p.x >= b.x0 AND p.x < b.x1""", "point")
def points_in_rings(spark, d):
    return G.points_in_rings(V.points(spark, d), boxes(spark, d))


@query("WITH " + SEG + """, t AS (SELECT line, line * 1e0 % 24e0 * 30e0 AS px, 200e0 AS py, line AS id FROM polyline GROUP BY line),
m AS (SELECT s.*, t.id, t.px, t.py, greatest(0e0, least(1e0, CASE WHEN (x2-x)*(x2-x)+(y2-y)*(y2-y) > 0 THEN ((px-x)*(x2-x)+(py-y)*(y2-y))/((x2-x)*(x2-x)+(y2-y)*(y2-y)) ELSE 0e0 END)) AS t FROM seg s JOIN t USING (line)),
q AS (SELECT *, sqrt((px-(x+t*(x2-x)))*(px-(x+t*(x2-x)))+(py-(y+t*(y2-y)))*(py-(y+t*(y2-y)))) AS dd FROM m)
SELECT line, id, round(dd, 6) AS distance, seq AS segment FROM q QUALIFY row_number() OVER (PARTITION BY line, id ORDER BY dd, seq) = 1""", "polyline")
def project_points(spark, d):
    lines = V.polylines(spark, d)
    targets = lines.select("line").distinct().select("line", F.col("line").alias("id"), (F.col("line") * 1.0 % 24.0 * 30.0).alias("px"), F.lit(200.0).alias("py"))
    return G.project(targets, lines).select("line", "id", r6("distance"), "segment")


@query("WITH " + SEG.replace("polyline", "(SELECT label AS line, row_number() OVER (PARTITION BY label ORDER BY id) AS seq, x, y FROM point)") + """, h AS (SELECT a.line, (b.x-a.x)*(b.y2-b.y)-(b.y-a.y)*(b.x2-b.x) AS tn, (b.x-a.x)*(a.y2-a.y)-(b.y-a.y)*(a.x2-a.x) AS un, (a.x2-a.x)*(b.y2-b.y)-(a.y2-a.y)*(b.x2-b.x) AS c
 FROM seg a JOIN seg b ON a.line = b.line AND b.seq > a.seq + 1)
SELECT line, count(*) AS crossings FROM h WHERE c <> 0 AND tn/c > 0 AND tn/c < 1 AND un/c > 0 AND un/c < 1 GROUP BY line""", "point")
def self_crossings(spark, d):
    at = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    p = V.points(spark, d).select(F.col("label").alias("line"), at.alias("seq"), "x", "y")
    return G.self_crossings(p)


@query("WITH " + SEG + """, c AS (SELECT *, sum(length) OVER (PARTITION BY line ORDER BY seq ROWS UNBOUNDED PRECEDING) AS t1 FROM seg),
n AS (SELECT line, sum(length) AS total, greatest(1, floor(sum(length)/500e0+0.5e0))::BIGINT AS n FROM seg GROUP BY line),
p AS (SELECT line, total*i/n AS arc FROM (SELECT line, total, n, unnest(range(n)) AS i FROM n))
SELECT line, round(arc, 4) AS arc, round(x+(arc-(t1-length))/length*(x2-x), 3) AS x, round(y+(arc-(t1-length))/length*(y2-y), 3) AS y FROM p JOIN c USING (line) WHERE arc >= t1-length AND arc < t1 AND length > 0""", "polyline")
def densified_polylines(spark, d):
    return G.densify(V.polylines(spark, d), 500.0).select("line", F.round("arc", 4).alias("arc"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("""SELECT line, seq FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY line) AS n FROM polyline)
WHERE n <= 32 OR list_contains(list_transform(range(32), lambda k: floor(k*(n-1)/31e0+0.5e0)::BIGINT), i)""", "polyline")
def decimated_polylines(spark, d):
    return G.decimate(V.polylines(spark, d)).select("line", "seq")


@query("WITH " + SEG + """, c AS (SELECT line, seq, x, x2, unnest(range(ceil(least(x,x2)/24e0)::BIGINT, floor(greatest(x,x2)/24e0)::BIGINT+1)) AS k FROM seg WHERE x <> x2)
SELECT line, seq, k, round((k*24e0-x)/(x2-x), 6) AS t FROM c WHERE (k*24e0-x)/(x2-x) > 0 AND (k*24e0-x)/(x2-x) < 1""", "polyline")
def lattice_cuts(spark, d):
    return G.lattice_cuts(V.polylines(spark, d), 24.0).select("line", "seq", "k", r6("t"))


@query("""SELECT line, seq, round(max(x - i) OVER (PARTITION BY line ORDER BY seq ROWS UNBOUNDED PRECEDING) + i, 6) AS spread
FROM (SELECT line, seq, x, (row_number() OVER (PARTITION BY line ORDER BY seq) - 1) * 5e0 AS i FROM polyline)""", "polyline")
def chain_arcs(spark, d):
    return G.chain_arcs(V.polylines(spark, d).withColumnRenamed("x", "arc"), 5.0).select("line", "seq", r6("spread"))


def _clip_sql(x0: float, y0: float, x1: float, y1: float) -> str:
    """The four half-planes in turn: kept points, and where a side crosses the bound the crossing."""
    steps, last = [], "polyline"
    for k, (a, b, bound, sign) in enumerate((("x", "y", x0, ">="), ("x", "y", x1, "<="), ("y", "x", y0, ">="), ("y", "x", y1, "<="))):
        steps.append(f"""p{k} AS (SELECT *, {a} {sign} {bound!r}::DOUBLE AS here, pa {sign} {bound!r}::DOUBLE AS there FROM (SELECT *, coalesce(lag({a}) OVER w, last_value({a}) OVER a_) AS pa,
 coalesce(lag({b}) OVER w, last_value({b}) OVER a_) AS pb FROM {last} WINDOW w AS (PARTITION BY line ORDER BY seq), a_ AS (PARTITION BY line ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))""")
        steps.append(f"""c{k} AS (SELECT line, row_number() OVER (PARTITION BY line ORDER BY seq, k) AS seq, x, y FROM (SELECT line, seq, 1 AS k, x, y FROM p{k} WHERE here
 UNION ALL SELECT line, seq, 0, {', '.join(f"{bound!r}::DOUBLE" if c == a else f"pb + ({bound!r}::DOUBLE - pa) / ({a} - pa) * ({b} - pb)" for c in "xy")} FROM p{k} WHERE here <> there))""")
        last = f"c{k}"
    return ", ".join(steps)


@query("WITH " + _clip_sql(100.0, 50.0, 500.0, 200.0) + " SELECT line, seq, round(x, 6) AS x, round(y, 6) AS y FROM c3 WHERE line IN (SELECT line FROM c3 GROUP BY line HAVING count(*) >= 3)", "polyline")
def clipped_rings(spark, d):
    return G.clip(V.polylines(spark, d), 100.0, 50.0, 500.0, 200.0).select("line", "seq", r6("x"), r6("y"))


@query("WITH " + SEG + """, nv AS (SELECT line, seq, CASE WHEN length > 0 THEN -(y2-y)/length ELSE 0 END AS nx, CASE WHEN length > 0 THEN (x2-x)/length ELSE 0 END AS ny FROM seg),
q AS (SELECT p.line, p.seq, p.x, p.y, nx, ny, lag(nx) OVER w AS mx, lag(ny) OVER w AS my FROM polyline p LEFT JOIN nv USING (line, seq) WINDOW w AS (PARTITION BY line ORDER BY seq)),
s AS (SELECT *, coalesce(mx, nx, 0) AS ax, coalesce(my, ny, 0) AS ay, coalesce(mx, nx, 0) + coalesce(nx, mx, 0) AS sx, coalesce(my, ny, 0) + coalesce(ny, my, 0) AS sy FROM q),
u AS (SELECT *, CASE WHEN sqrt(sx*sx+sy*sy) > 0 THEN sx/sqrt(sx*sx+sy*sy) ELSE ax END AS ux, CASE WHEN sqrt(sx*sx+sy*sy) > 0 THEN sy/sqrt(sx*sx+sy*sy) ELSE ay END AS uy FROM s)
SELECT line, seq, round(x + ux*3e0/greatest(0.5e0, ux*ax+uy*ay), 6) AS x, round(y + uy*3e0/greatest(0.5e0, ux*ax+uy*ay), 6) AS y FROM u""", "polyline")
def offset_polylines(spark, d):
    return G.offset_points(V.polylines(spark, d), 3.0).select("line", "seq", r6("x"), r6("y"))


@query("""WITH RECURSIVE n AS (SELECT line, seq, x, y, row_number() OVER (PARTITION BY line ORDER BY seq) AS i FROM polyline),
cut(line, a, b) AS (SELECT line, 1::BIGINT, max(i) FROM n GROUP BY line UNION ALL SELECT line, unnest([a, m]), unnest([m, b]) FROM (
 SELECT line, a, b, arg_max(i, {'d': d, 'first': -i}) AS m, max(d) AS far FROM (SELECT c.line, c.a, c.b, p.i, CASE WHEN sqrt((e.x-s.x)*(e.x-s.x)+(e.y-s.y)*(e.y-s.y)) > 0
 THEN abs((e.x-s.x)*(p.y-s.y)-(e.y-s.y)*(p.x-s.x))/sqrt((e.x-s.x)*(e.x-s.x)+(e.y-s.y)*(e.y-s.y)) ELSE sqrt((p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y)) END AS d
 FROM cut c JOIN n s ON s.line = c.line AND s.i = c.a JOIN n e ON e.line = c.line AND e.i = c.b JOIN n p ON p.line = c.line AND p.i > c.a AND p.i < c.b) GROUP BY line, a, b) WHERE far > 20)
SELECT DISTINCT n.line, n.seq, n.x, n.y FROM (SELECT line, unnest([a, b]) AS i FROM cut) JOIN n USING (line, i)""", "polyline")
def simplified_polylines(spark, d):
    return G.simplify(V.polylines(spark, d), 20.0)


# --- raster ------------------------------------------------------------------------------------------------------

EDGE = """edge AS (SELECT col+ax AS x, "row"+ay AS y, col+bx AS x2, "row"+by_ AS y2 FROM cell, (VALUES (0,-1,0,0,1,0),(1,0,1,0,1,1),(0,1,1,1,0,1),(-1,0,0,1,0,0)) s(dx,dy,ax,ay,bx,by_)
 WHERE NOT EXISTS (SELECT 1 FROM cell c WHERE c.col = cell.col+dx AND c."row" = cell."row"+dy))"""
AROUND = "(VALUES (-1),(0),(1)) i(dx), (VALUES (-1),(0),(1)) j(dy)"


@query("WITH " + EDGE + " SELECT x, y, x2, y2 FROM edge", "cell")
def boundary_edges(spark, d):
    return R.boundary_edges(V.cells(spark, d))


@query("WITH " + EDGE + " SELECT sum(x*y2-x2*y)/2e0 AS area FROM edge", "cell")
def mask_area(spark, d):
    return R.mask_area(R.boundary_edges(V.cells(spark, d)))


@query(f'SELECT DISTINCT col+dx AS col, "row"+dy AS "row" FROM cell, {AROUND} WHERE col+dx BETWEEN 0 AND 999 AND "row"+dy BETWEEN 0 AND 999', "cell")
def dilated_cells(spark, d):
    return R.dilate(V.cells(spark, d), 1, 1000)


@query(f'WITH grown AS (SELECT DISTINCT col+dx AS col, "row"+dy AS "row" FROM cell, {AROUND} WHERE col+dx BETWEEN 0 AND 999 AND "row"+dy BETWEEN 0 AND 999) SELECT col+dx AS col, "row"+dy AS "row" FROM grown, {AROUND} GROUP BY 1, 2 HAVING count(*) = 9', "cell")
def closed_cells(spark, d):
    """Morphological closing: dilate, then erode."""
    return R.erode(R.dilate(V.cells(spark, d), 1, 1000), 1)


@query("SELECT least(95, greatest(0, floor((x - 0e0) / 2700e0 * 96)))::BIGINT AS bin, count(*) AS n FROM point GROUP BY 1", "point")
def histogram_1d(spark, d):
    return R.histogram(V.points(spark, d), "x", 0.0, 2700.0)


@query("SELECT least(95, greatest(0, floor(x / 2700e0 * 96)))::BIGINT AS bx, least(95, greatest(0, floor(y / 2700e0 * 96)))::BIGINT AS by, count(*) AS n FROM point GROUP BY 1, 2", "point")
def histogram_2d(spark, d):
    return R.histogram_2d(V.points(spark, d), 0.0, 2700.0)


HIST = "h AS (SELECT least(95, greatest(0, floor(x / 2700e0 * 96)))::BIGINT AS bin, count(*) AS n FROM point GROUP BY 1)"


@query("WITH " + HIST + """ SELECT least(95, greatest(0, bin + dd))::BIGINT AS bin, round(sum(n * w), 6) AS n FROM h,
 (VALUES (-2, 0.0625e0), (-1, 0.25e0), (0, 0.375e0), (1, 0.25e0), (2, 0.0625e0)) k(dd, w) GROUP BY 1""", "point")
def smoothed_histogram(spark, d):
    bins = R.histogram(V.points(spark, d), "x", 0.0, 2700.0)
    return R.smooth(bins, [0.0625, 0.25, 0.375, 0.25, 0.0625], 96).select("bin", r6("n"))


@query("WITH " + HIST + " SELECT bin, round(sum(n) OVER (ORDER BY bin) / (sum(n) OVER ())::DOUBLE, 6) AS cdf FROM h", "point")
def density_cdf(spark, d):
    return R.cumulative(R.histogram(V.points(spark, d), "x", 0.0, 2700.0)).select("bin", r6("cdf"))


@query("""WITH g AS (SELECT least(95, greatest(0, floor(x / 2700e0 * 96)))::BIGINT AS bx, least(95, greatest(0, floor(y / 2700e0 * 96)))::BIGINT AS "by", count(*) AS n FROM point GROUP BY 1, 2)
SELECT bx, "by", round(least(4e0, 0.5e0 + n * 9216 / (SELECT sum(n) FROM g)::DOUBLE * 0.5e0), 6) AS density FROM g""", "point")
def excess_density(spark, d):
    return R.excess(R.histogram_2d(V.points(spark, d), 0.0, 2700.0)).select("bx", "by", r6("density"))


@query("WITH " + BOX + """ SELECT ring, "row", round(x0, 6) AS x0, round(x1, 6) AS x1 FROM (SELECT ring, x0, x1, unnest(range(ceil(y0 - 0.5e0)::BIGINT, ceil(y1 - 0.5e0)::BIGINT)) AS "row" FROM box)""", "point")
def scanline_fill(spark, d):
    return R.scanline_spans(boxes(spark, d)).select("ring", "row", r6("x0"), r6("x1"))


@query("""WITH RECURSIVE c AS (SELECT DISTINCT l_orderkey % 997 AS col, l_partkey % 991 AS "row" FROM lineitem),
n AS (SELECT "row" * 1048576 + col AS id, col, "row" FROM c),
e AS (SELECT a.id AS a, b.id AS b FROM n a, (VALUES (1), (-1), (1048576), (-1048576)) s(dd) JOIN n b ON b.id = a.id + dd),
r(id, seen) AS (SELECT id, id FROM n UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT n.col, n."row", min(seen) AS component FROM r JOIN n USING (id) GROUP BY n.col, n."row" """)
def cell_components(spark, d):
    return R.components(V.cells(spark, d))


# --- scalars and text --------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, lpad(lower(to_hex(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(c_name, ''), lambda c: ord(c)::BIGINT)), lambda h, x: (h * 33 + x) & 4294967295))), 8, '0') AS hash FROM customer""")
def djb2_hashes(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", S.djb2(F.col("c_name")).alias("hash"))


@query("SELECT o_orderkey, floor(o_totalprice / 7e0 * 100000e0 + 0.5e0) / 100000e0 AS v, floor(-o_totalprice / 100e0 + 0.5e0) AS w FROM orders")
def half_up_rounding(spark, d):
    p = F.col("o_totalprice")
    return V.table(spark, d, "orders").select("o_orderkey", S.half_up(p / 7.0, 5).alias("v"), S.half_up(-p / 100.0).alias("w"))


@query("""SELECT route, CASE WHEN regexp_matches(c, '^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$') THEN c ELSE '#888888' END AS strict, CASE WHEN c LIKE '#%' THEN c ELSE '#' || c END AS prefixed
FROM (SELECT route, CASE WHEN route % 2 = 0 THEN color ELSE substr(color, 2) END AS c FROM route)""", "route")
def colors(spark, d):
    c = V.routes(spark, d).select("route", F.when(F.col("route") % 2 == 0, F.col("color")).otherwise(F.col("color").substr(F.lit(2), F.lit(9))).alias("c"))
    return c.select("route", S.strict_color(F.col("c")).alias("strict"), S.prefixed_color(F.col("c")).alias("prefixed"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped, length(url) * 6 AS width FROM pages""")
def xml_escapes(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.md5(S.xml_escape(F.col("html"))).alias("escaped"), S.text_width(F.col("url")).cast("long").alias("width"))


@query("""WITH v AS (SELECT id, x - 1350e0 AS dx, y - 1350e0 AS dy FROM point), u AS (SELECT id, dx, dy, unnest(range(8)) AS i,
 unnest([dx*1e0+dy*0e0, dx*0.7071067811865476e0+dy*0.7071067811865476e0, dx*0e0+dy*1e0, dx*-0.7071067811865476e0+dy*0.7071067811865476e0, dx*-1e0+dy*0e0, dx*-0.7071067811865476e0+dy*-0.7071067811865476e0, dx*0e0+dy*-1e0, dx*0.7071067811865476e0+dy*-0.7071067811865476e0]) AS t FROM v)
SELECT id, arg_max(i, t)::BIGINT AS direction, round(1.4142135623730951e0*least(abs(any_value(dx)),abs(any_value(dy)))+abs(abs(any_value(dx))-abs(any_value(dy))), 6) AS octilinear,
 CASE WHEN any_value(dx) = greatest(any_value(dx),any_value(dy),-any_value(dx),-any_value(dy)) THEN 'E' WHEN any_value(dy) = greatest(any_value(dx),any_value(dy),-any_value(dx),-any_value(dy)) THEN 'S'
 WHEN -any_value(dx) = greatest(any_value(dx),any_value(dy),-any_value(dx),-any_value(dy)) THEN 'W' ELSE 'N' END AS cardinal FROM u GROUP BY id""", "point")
def directions(spark, d):
    dx, dy = F.col("x") - 1350.0, F.col("y") - 1350.0
    return V.points(spark, d).select(
        "id", S.nearest_direction(dx, dy).cast("long").alias("direction"), F.round(S.octilinear_distance(dx, dy), 6).alias("octilinear"), S.cardinal(dx, dy).alias("cardinal")
    )


@query("""WITH s AS (SELECT id, label, x, y, floor(degrees(atan2(y-1350e0, x-1350e0))*1e6+0.5e0)/1e6 AS deg FROM point)
SELECT id, round(least(((deg % 45e0) + 45e0) % 45e0, 45e0 - ((deg % 45e0) + 45e0) % 45e0), 4) AS off_grid, row_number() OVER (PARTITION BY label ORDER BY deg DESC, id) AS place FROM s""", "point")
def angular_order(spark, d):
    dx, dy = F.col("x") - 1350.0, F.col("y") - 1350.0
    p = V.points(spark, d).withColumn("deg", F.floor(F.degrees(F.atan2(dy, dx)) * 1e6 + 0.5) / 1e6)
    w = Window.partitionBy("label").orderBy(F.desc("deg"), "id")
    return p.select("id", F.round(S.off_grid_degrees(dx, dy), 4).alias("off_grid"), F.row_number().over(w).cast("long").alias("place"))


@query("""WITH b AS (SELECT min(lng) AS x0, min(lat) AS y0, max(lng) AS x1, max(lat) AS y1 FROM station), k AS (SELECT *, floor(cos((y0+y1)/2e0*(3.141592653589793e0/180e0))*1e9+0.5e0)/1e9 AS k FROM b),
s AS (SELECT *, least(2376e0/greatest((x1-x0)*k,1e-9), 2376e0/greatest(y1-y0,1e-9)) AS s FROM k)
SELECT id, round(1350e0+(lng-(x0+x1)/2e0)*k*s, 4) AS px, round(1350e0-(lat-(y0+y1)/2e0)*s, 4) AS py FROM station, s""", "station")
def projected_stations(spark, d):
    st = V.stations(spark, d)
    box = st.agg(F.struct(F.min("lng").alias("x0"), F.min("lat").alias("y0"), F.max("lng").alias("x1"), F.max("lat").alias("y1")).alias("b"))
    x, y = S.fit_projection(F.col("lng"), F.col("lat"), F.col("b"), 2700.0, 2700.0)
    return st.crossJoin(F.broadcast(box)).select("id", F.round(x, 4).alias("px"), F.round(y, 4).alias("py"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'water' WHEN event_type = 'click' THEN 'green' WHEN lower(k) IN ('park','forest') THEN 'green' END AS category
FROM (SELECT *, CASE user_id % 4 WHEN 0 THEN 'Park' WHEN 1 THEN 'WATER' WHEN 2 THEN 'road' ELSE 'forest' END AS k FROM events)""")
def feature_categories(spark, d):
    e = V.table(spark, d, "events")
    layer = F.when(F.col("event_type") == "view", "water").when(F.col("event_type") == "click", "parks").otherwise("other")
    kind = F.when(F.col("user_id") % 4 == 0, "Park").when(F.col("user_id") % 4 == 1, "WATER").when(F.col("user_id") % 4 == 2, "road").otherwise("forest")
    return e.select("event_id", S.feature_category(layer, F.create_map(F.lit("kind"), kind)).alias("category"))


KEYS = "CASE WHEN {0} % 5 = 0 THEN NULL WHEN {0} % 5 < 3 THEN 's:' || {0} % 3 ELSE 'm:' || {0} % 3 END"


@query(f"""SELECT event_id, CASE WHEN q THEN 'restore' WHEN b IS NULL OR b = n THEN 'keep' WHEN n LIKE 's:%' AND b LIKE 'm:%' AND s THEN 'restore' ELSE 'clear' END AS action FROM
 (SELECT event_id, value < 10 AS q, {KEYS.format('user_id')} AS b, coalesce({KEYS.format('event_id')}, 's:0') AS n, event_type = 'click' AS s FROM events)""")
def area_lifecycle(spark, d):
    e = V.table(spark, d, "events")
    key = lambda c: F.when(F.col(c) % 5 == 0, F.lit(None)).when(F.col(c) % 5 < 3, F.concat(F.lit("s:"), F.col(c) % 3)).otherwise(F.concat(F.lit("m:"), F.col(c) % 3))
    return e.select("event_id", S.lifecycle(F.col("value") < 10, key("user_id"), F.coalesce(key("event_id"), F.lit("s:0")), F.col("event_type") == "click").alias("action"))


LAYERS = ("water", "parks", "landuse", "natural", "landcover", "park", "ocean_foundations", "road", "label", "building", "rail")


@query(f"""WITH layer AS (SELECT DISTINCT p_partkey % 97 AS source, (ARRAY{list(LAYERS)!r})[p_size % 11 + 1] AS name FROM part),
sig(rank, schema, water, need, asked) AS (VALUES (1, 'own', ['water','ocean_foundations'], ['parks','ocean_foundations'], ['water','ocean_foundations','parks','landuse']),
 (2, 'protomaps', ['water'], ['natural'], ['water','natural','landuse']), (3, 'openmaptiles', ['water'], ['landcover','park'], ['water','landcover','park','landuse']),
 (4, 'mapbox', ['water'], ['landuse','landcover'], ['water','landuse','landcover'])),
m AS (SELECT source, rank, schema, list_filter(any_value(asked), lambda a: list_contains(list(name), a)) AS layers
 FROM layer, sig GROUP BY ALL HAVING bool_or(list_contains(water, name)) AND bool_or(list_contains(need, name)))
SELECT source, arg_min(schema, rank) AS schema, array_to_string(arg_min(layers, rank), ',') AS layers FROM m GROUP BY source""")
def schema_probe(spark, d):
    names = F.array(*[F.lit(x) for x in LAYERS])
    layers = V.table(spark, d, "part").select((F.col("p_partkey") % 97).alias("source"), F.get(names, F.col("p_size") % 11).alias("name"))
    own = (("own", ("water", "ocean_foundations"), ("parks", "ocean_foundations"), ("parks", "landuse")),)
    return N.probe(layers.distinct(), own).withColumn("layers", F.array_join("layers", ","))


@query("""WITH p AS (SELECT c_nationkey::BIGINT AS city, c_acctbal/1000e0 AS x, c_custkey%110/10e0 AS y, 0.1e0 AS pad FROM customer WHERE c_nationkey % 2 = 0
 UNION ALL SELECT c_nationkey, c_custkey%70/10e0, c_acctbal/3000e0, 0.15e0 FROM customer),
b AS (SELECT city, pad, min(x)-pad*(max(x)-min(x)) AS x0, min(y)-pad*(max(y)-min(y)) AS y0, max(x)+pad*(max(x)-min(x)) AS x1, max(y)+pad*(max(y)-min(y)) AS y1 FROM p GROUP BY city, pad)
SELECT city, pad = 0.1e0 AS from_demand, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM b
WHERE x1 - x0 <= 12 AND y1 - y0 <= 12 AND (pad = 0.1e0 OR city NOT IN (SELECT city FROM b WHERE pad = 0.1e0))""")
def harvest_bounds(spark, d):
    c = V.table(spark, d, "customer").withColumn("city", F.col("c_nationkey").cast("long"))
    demand = c.filter("city % 2 = 0").select("city", (F.col("c_acctbal") / 1000.0).alias("x"), (F.col("c_custkey") % 110 / 10.0).alias("y"))
    stations = c.select("city", (F.col("c_custkey") % 70 / 10.0).alias("x"), (F.col("c_acctbal") / 3000.0).alias("y"))
    return N.harvested(demand, stations, "city").select("city", "from_demand", *[r6(k) for k in ("x0", "y0", "x1", "y1")])


@query("""SELECT o_orderpriority AS k, list_sort(list(o_totalprice))[count(*)//2 + 1] AS upper_median, median(o_totalprice) AS median FROM orders GROUP BY 1""")
def medians(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_totalprice").alias("p"))
    return E.middle_values(o, "k", "p")
