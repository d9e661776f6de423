"""Registered queries of fingerprints and of results gated by them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meshline.operators import fingerprints as P
from meshline.plans.queries import query
from meshline.sources import network as V
from meshline.sources.cached import ResultStore
from meshline.sources.stored import folder

R5 = "regexp_replace((floor({0} * 100000e0 + 0.5e0) / 100000e0)::VARCHAR, '\\.0$', '')"
AT = R5.format("lng") + " || ',' || " + R5.format("lat")
DJB2 = "lpad(lower(to_hex(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)), lambda h, x: (h * 33 + x) & 4294967295))), 8, '0')"
TEXTS = f"""st AS (SELECT grp AS key, string_agg(concat_ws('|', id::VARCHAR, {AT}, grp::VARCHAR, 'constructed', '', '', name), ';' ORDER BY id) AS t FROM station WHERE constructed GROUP BY grp),
ro AS (SELECT c_nationkey::BIGINT AS key, string_agg(concat_ws('|', route::VARCHAR, bullet, color, '', ''), ';' ORDER BY route) AS t FROM route JOIN orders ON o_orderkey = route JOIN customer ON c_custkey = o_custkey WHERE NOT temp GROUP BY ALL),
gr AS (SELECT grp AS key, grp::VARCHAR || '|' || string_agg(id::VARCHAR, ',' ORDER BY id) AS t FROM station GROUP BY grp),
tx AS (SELECT DISTINCT grp AS key, coalesce(st.t, '') AS s, coalesce(ro.t, '') AS r, coalesce(gr.t, '') AS g FROM station LEFT JOIN st ON st.key = grp LEFT JOIN ro ON ro.key = grp LEFT JOIN gr ON gr.key = grp),
dg AS (SELECT key, {DJB2.format('s')} AS stations, {DJB2.format('r')} AS routes, {DJB2.format('g')} AS groups, {DJB2.format("'0.06|0.8|0.05|4|1.2||l|' || key % 4")} AS options,
 {DJB2.format("CASE WHEN key % 2 = 0 THEN 'geo:' || key % 5 || ':' || key % 3 ELSE 'nogeo' END")} AS geo FROM tx)"""


def texts(df, key, place, *columns):
    return df.select(F.col(key).cast("long").alias("key"), F.col(place).alias("place"), F.concat_ws("|", *columns).alias("text"))


def station_texts(stations):
    s = stations.filter("constructed")
    return texts(s, "grp", "id", F.col("id").cast("string"), P.place_text(F.col("lng"), F.col("lat")), F.col("grp").cast("string"), F.lit("constructed"), F.lit(""), F.lit(""), "name")


@query("WITH " + TEXTS + f" SELECT key, stations, routes, groups, options, geo, 'v6-' || {DJB2.format(chr(39) + '6|' + chr(39) + ' || concat_ws(' + chr(39) + '|' + chr(39) + ', stations, routes, groups, options, geo)')} AS fp FROM dg", "station", "route")
def layout_fingerprints(spark, d):
    st, customers = V.stations(spark, d), V.table(spark, d, "customer")
    owner = V.table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("route"), F.col("c_nationkey").alias("city"))
    routes = V.routes(spark, d).filter("NOT temp").join(owner, "route")
    members = st.groupBy("grp").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    keys = st.select(F.col("grp").alias("key")).distinct()
    parts = {
        "stations": station_texts(st), "routes": texts(routes, "city", "route", F.col("route").cast("string"), "bullet", "color", F.lit(""), F.lit("")),
        "groups": texts(members, "grp", "grp", F.col("grp").cast("string"), "ids"),
    }
    k = F.col("key")
    geo = F.when(k % 2 == 0, F.concat(F.lit("geo:"), k % 5, F.lit(":"), k % 3)).otherwise("nogeo")
    return P.fingerprints(keys, parts, {"options": F.concat(F.lit("0.06|0.8|0.05|4|1.2||l|"), k % 4), "geo": geo})


@query("""SELECT grp AS key, count(*) AS members, round(min(lng), 6) AS x0, round(max(lat), 6) AS y1, NOT bool_or(id % 11 = 0) AS kept FROM station GROUP BY grp HAVING count(*) FILTER (constructed) > 0""", "station")
def cached_layouts(spark, d):
    """Two refreshes of one store: the second one, with more stations, only computes the cities that have some of these."""
    store = ResultStore(spark, f"{folder(spark)}/cache-{uuid.uuid4().hex}")
    st = V.stations(spark, d)

    def fp(stations):
        whole = texts(stations, "grp", "id", F.col("id").cast("string"), P.place_text(F.col("lng"), F.col("lat")), "name")
        return P.joined_digests(whole, ";").withColumnRenamed("hash", "fp")

    def layout(stations, kept):
        def compute(keys):
            own = stations.join(keys, F.col("grp") == F.col("key"), "left_semi").groupBy(F.col("grp").alias("key"))
            made = own.agg(F.count("*").alias("members"), F.round(F.min("lng"), 6).alias("x0"), F.round(F.max("lat"), 6).alias("y1"), F.count_if("constructed").alias("some"))
            return made.filter("some > 0").drop("some").withColumn("kept", F.lit(kept))

        return compute

    first = st.filter("id % 11 <> 0")
    store.refresh("layout", fp(first), layout(first, True))
    return store.refresh("layout", fp(st), layout(st, False))
