"""Network-shaped views of the star-schema tables: stations, route visits, polylines, points, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meshline.sources.stored import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, ``grp``, ``name``, ``lng``, ``lat``: suppliers as stations, nations as station groups."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.col("s_nationkey").cast("long").alias("grp"), F.col("s_name").alias("name"),
        (k * 37 % 1000 / F.lit(1000.0) - F.lit(74.5)).alias("lng"), (k * 91 % 1000 / F.lit(1000.0) + F.lit(40.2)).alias("lat"),
        (F.col("s_acctbal") >= 0).alias("constructed"),
    )


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``route``, ``seq``, ``grp``, ``is_stop``: the items of an order as the ordered calls of a route."""
    li = table(spark, sf_dir, "lineitem")
    calls = dealt(li.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")), li.count(), "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return calls.select(
        F.col("l_orderkey").alias("route"), F.row_number().over(order).cast("long").alias("seq"),
        F.col("s_nationkey").cast("long").alias("grp"), (F.col("l_quantity") > 10).alias("is_stop"),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``route``, ``bullet``, ``color``, ``temp``: orders as routes."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("route"), F.col("o_orderpriority").alias("bullet"),
        F.concat(F.lit("#"), F.substring(F.md5(F.col("o_orderstatus")), 1, 6)).alias("color"),
        (F.col("o_orderstatus") == "P").alias("temp"),
    )


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line``, ``seq``, ``x``, ``y``: a user's events in time; x in hours from the start of 2024."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("line"), F.row_number().over(order).cast("long").alias("seq"),
        (t.cast("double") / F.lit(3600000000.0)).alias("x"), F.col("value").alias("y"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, ``x``, ``y``: the first two dimensions of the vectors on a canvas of 2,700 pixels."""
    e = table(spark, sf_dir, "embeddings")
    px = lambda i: (F.element_at("embedding", i).cast("double") + F.lit(1.0)) * F.lit(1350.0)
    return e.select(F.col("vec_id").alias("id"), px(1).alias("x"), px(2).alias("y"), F.col("label").cast("long").alias("label"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``col``, ``row``: distinct cells of a sparse raster of 1,000 x 1,000, of all order items."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") % 997).alias("col"), (F.col("l_partkey") % 991).alias("row")).distinct()


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's items in turn, each at a place of its own city (``net``, a customer)."""
    li = table(spark, sf_dir, "lineitem")
    li = dealt(li, li.count(), "l_orderkey").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.select(
        F.col("o_custkey").alias("net"), F.col("l_orderkey").alias("route"), F.row_number().over(order).cast("long").alias("seq"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), (F.col("l_quantity") > 40).alias("is_node"),
    )


def _by_net(spark: SparkSession, sf_dir: str, each: int) -> DataFrame:
    """Items dealt by city: cities are many and small, and each step of path operators stays inside one.

    Joins on a city and more keys then take both sides as they lie. The setting decides where rows meet, never a result.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return dealt(_items(spark, sf_dir), table(spark, sf_dir, "lineitem").count(), "net", each=each)


def grid_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``net``, ``route``, ``edge``, ``seq``, ``x``, ``y``, ``is_node``: from item to item of an order, along x and then y, on a grid of 16 pixels."""
    w = Window.partitionBy("net", "route").orderBy("seq")  # an order is one city's
    i = _by_net(spark, sf_dir, 100_000).withColumn("x", F.col("part") % 12 * 16.0).withColumn("y", F.col("supp") % 9 * 16.0)
    i = i.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).filter("x2 IS NOT NULL")
    corner = lambda k, x, y: F.struct(F.lit(k).cast("long").alias("seq"), F.col(x).alias("x"), F.col(y).alias("y"))
    corners = F.explode(F.array(corner(0, "x", "y"), corner(1, "x2", "y"), corner(2, "x2", "y2")))
    edge = (F.col("route") * 64 + F.col("seq")).alias("edge")
    return i.select("net", "route", edge, corners.alias("p"), "is_node").select("net", "route", "edge", "p.*", "is_node")


def crossing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``net``, ``edge``, ``seq``, ``x``, ``y``: an order's items as one polyline, straight from place to place."""
    i = _by_net(spark, sf_dir, 30_000)  # pairs, cuts and parts are many rows for each item
    return i.select("net", F.col("route").alias("edge"), "seq", (F.col("part") % 199 * 3.0).alias("x"), (F.col("supp") % 97 * 5.0).alias("y"))


def walk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``net``, ``edge``, ``a`` < ``b``, ``lines``, ``length``: places that follow one another in a user's events, each pair once."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", (F.col("event_id") * 7919 % 211).alias("place"))
    e = e.withColumn("to", F.lead("place").over(w)).filter(F.col("to") != F.col("place"))
    each = e.groupBy(F.col("user_id").alias("net"), F.least("place", "to").alias("a"), F.greatest("place", "to").alias("b"))
    met = each.agg(F.min("event_id").alias("edge"), F.when(F.max("value") > 95, "1,2").otherwise("1").alias("lines"), (F.floor(F.min("value")) + 1).cast("double").alias("length"))
    return met.select("net", "edge", "a", "b", "lines", "length")


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ring``, ``seq``, ``x``, ``y``: an octagon for each customer, of many sizes, on a lattice of 50; even ones repeat their first vertex."""
    k = F.col("c_custkey")
    corners = [(3, 0), (2, 2), (0, 3), (-2, 2), (-3, 0), (-2, -2), (0, -3), (2, -2)]
    listed = F.array(*[F.struct(F.lit(i).cast("long").alias("seq"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for i, (a, b) in enumerate([*corners, corners[0]])])
    each = F.explode(F.when(k % 2 == 0, listed).otherwise(F.slice(listed, 1, 8)))
    c = table(spark, sf_dir, "customer").select(k.alias("ring"), (1 + k * k % 83).alias("r"), each.alias("p"))
    at = lambda centre, way: (centre * 50.0 + F.col("r") * F.col(way))
    return c.select("ring", "p.seq", at(F.col("ring") % 64, "p.a").alias("x"), at(F.floor(F.col("ring") / 64), "p.b").alias("y"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``track``, ``grp`` (null outside stations), ``coords``: parts as short tracks on a lattice, so that many meet end to end."""
    k = F.col("p_partkey")
    point = lambda x, y: F.struct((x / 1000.0).alias("x"), (y / 1000.0).alias("y"))
    x, y = k % 6, k % 5
    coords = F.array(point(x, y), point(x + 1, y), point(x + 1, y), point(x + 1, y + k % 3))
    return table(spark, sf_dir, "part").select(k.alias("track"), F.when(k % 4 == 0, k % 7).alias("grp"), coords.alias("coords"))


def combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``route``, ``combo``, ``start_node``, ``end_node``, ``path``: from item to item of an order, over three tracks."""
    w = Window.partitionBy("route").orderBy("seq")
    i = _items(spark, sf_dir).withColumn("to", F.lead("supp").over(w)).withColumn("next", F.lead("part").over(w)).filter("to IS NOT NULL")
    step = lambda k, back: F.struct(k.alias("track"), back.alias("reversed"))
    # the third one is the first on its way back
    path = F.array(step(F.col("part"), F.lit(False)), step(F.col("next"), F.col("is_node")), step(F.col("part"), F.lit(True)))
    return i.select("route", F.col("seq").alias("combo"), F.col("supp").alias("start_node"), F.col("to").alias("end_node"), path.alias("path"))


#: The same views in DuckDB, as common table expressions.
SQL = {
    "station": """station AS (SELECT s_suppkey AS id, s_nationkey::BIGINT AS grp, s_name AS name, (s_suppkey*37%1000)/1000e0-74.5e0 AS lng,
 (s_suppkey*91%1000)/1000e0+40.2e0 AS lat, s_acctbal >= 0 AS constructed FROM supplier)""",
    "stop": """stop AS (SELECT l_orderkey AS route, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
 s_nationkey::BIGINT AS grp, l_quantity > 10 AS is_stop FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)""",
    "route": """route AS (SELECT o_orderkey AS route, o_orderpriority AS bullet, '#' || substr(md5(o_orderstatus), 1, 6) AS color, o_orderstatus = 'P' AS temp FROM orders)""",
    "polyline": """polyline AS (SELECT user_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
 (epoch_us(ts) - 1704067200000000)::DOUBLE / 3600000000e0 AS x, value AS y FROM events)""",
    "point": """point AS (SELECT vec_id AS id, (embedding[1]::DOUBLE + 1e0) * 1350e0 AS x, (embedding[2]::DOUBLE + 1e0) * 1350e0 AS y, label::BIGINT AS label FROM embeddings)""",
    "item": """item AS (SELECT o_custkey AS net, l_orderkey AS route, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
 l_partkey AS part, l_suppkey AS supp, l_quantity > 40 AS is_node FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "gridpath": """leg AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM (SELECT *, part % 12 * 16e0 AS x, supp % 9 * 16e0 AS y FROM item) WINDOW w AS (PARTITION BY route ORDER BY seq)),
gridpath AS (SELECT net, route, route * 64 + seq AS edge, unnest([0, 1, 2]) AS seq, unnest([x, x2, x2]) AS x, unnest([y, y, y2]) AS y, is_node FROM leg WHERE x2 IS NOT NULL)""",
    "crosspath": """crosspath AS (SELECT net, route AS edge, seq, part % 199 * 3e0 AS x, supp % 97 * 5e0 AS y FROM item)""",
    "walk": """walk AS (SELECT user_id AS net, min(event_id) AS edge, least(place, nxt) AS a, greatest(place, nxt) AS b, CASE WHEN max(value) > 95 THEN '1,2' ELSE '1' END AS lines, floor(min(value)) + 1e0 AS length
 FROM (SELECT *, lead(place) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM (SELECT *, event_id * 7919 % 211 AS place FROM events)) WHERE nxt <> place GROUP BY ALL)""",
    "shape": """shape AS (SELECT c_custkey AS ring, unnest(range(8)) AS i, c_custkey % 64 * 50e0 + (1 + c_custkey * c_custkey % 83) * unnest([3e0, 2, 0, -2, -3, -2, 0, 2]) AS x,
 floor(c_custkey / 64) * 50e0 + (1 + c_custkey * c_custkey % 83) * unnest([0e0, 2, 3, 2, 0, -2, -3, -2]) AS y FROM customer)""",
    "combo": """track AS (SELECT p_partkey AS track, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 7 END AS grp,
 [{'x': x/1000e0, 'y': y/1000e0}, {'x': (x+1)/1000e0, 'y': y/1000e0}, {'x': (x+1)/1000e0, 'y': (y+p_partkey%3)/1000e0}] AS coords FROM (SELECT *, p_partkey % 6 AS x, p_partkey % 5 AS y FROM part)),
combo AS (SELECT route, seq AS combo, supp AS start_node, nxt AS end_node, unnest([part, np, part]) AS track, unnest([false, is_node, true]) AS reversed, unnest([0, 1, 2]) AS pos
 FROM (SELECT *, lead(supp) OVER w AS nxt, lead(part) OVER w AS np FROM item WINDOW w AS (PARTITION BY route ORDER BY seq)) WHERE nxt IS NOT NULL)""",
    "cell": """cell AS (SELECT DISTINCT l_orderkey % 997 AS col, l_partkey % 991 AS row FROM lineitem)""",
}
