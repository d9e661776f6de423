"""Registered queries of scenes from markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshline.operators import scene as S
from meshline.plans.queries import query
from meshline.sources import network as V


def drawings(spark, d):
    """One SVG text per user: a land rectangle, a group of circles for the events and a label in nested groups."""
    e = V.table(spark, d, "events").withColumn("v", F.floor("value").cast("int"))
    dot = F.concat(F.lit('<circle cx="'), F.col("event_id") % 800, F.lit("\" cy = '"), F.col("event_id") % 600, F.lit("' r=\"2\""), F.when(F.col("v") > 300, ' fill="red"').otherwise(""), F.lit("/>"))
    dots = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", dot.alias("s")))), lambda s: s["s"]), "")
    kind = F.min("event_type")
    u = F.col("user_id")
    text = F.concat(
        F.lit('<svg viewBox="0 0 800 600"><rect width="800" height="600" fill="#f4f1ea"/><g class="edges x" stroke="#123" transform="translate(10,-5)">'), dots,
        F.lit("<g class='stations' fill=\"#00f\"><g transform=\"translate("), u % 50, F.lit(" 7.5)\"><text x='1' y='2' text-anchor='end'>"), kind, F.lit(" &amp; &lt;"), u,
        F.lit('&gt;</text></g></g></g><path d="M0,0L5,5" fill-rule="evenodd"/></svg>'),
    )
    return e.groupBy("user_id").agg(text.alias("svg")).select(u.alias("id"), "svg")


DOTS = """dot AS (SELECT user_id AS id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, floor(value) > 300 AS red FROM events),
usr AS (SELECT user_id AS id, count(*) AS n, min(event_type) AS kind FROM events GROUP BY user_id)"""


@query("WITH " + DOTS + """ SELECT id, 0::BIGINT AS seq, 'scene' AS kind, '-' AS layer, false AS world_scale, '-' AS fill, '-' AS stroke, '-' AS body, 800e0 AS a, 600e0 AS b FROM usr
UNION ALL SELECT id, 1, 'rect', 'background', false, '#f4f1ea', 'none', '-', 800, 600 FROM usr
UNION ALL SELECT id, n + 1, 'circle', 'edges', true, CASE WHEN red THEN 'red' ELSE 'none' END, '#123', '-', event_id % 800, event_id % 600 FROM dot
UNION ALL SELECT id, n + 2, 'text', 'stations', true, '#00f', '-', kind || ' & <' || id || '>', 10e0 + id % 50, 2.5e0 FROM usr
UNION ALL SELECT id, n + 3, 'path', 'background', false, 'none', 'none', 'M0,0L5,5', 0, 0 FROM usr""")
def scene_primitives(spark, d):
    p = S.primitives(drawings(spark, d))
    at = lambda *names: F.coalesce(*[F.try_element_at("numbers", F.lit(n)) for n in names], F.lit(0.0))
    given = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return p.select(
        "id", "seq", "kind", given("layer"), F.coalesce("world_scale", F.lit(False)).alias("world_scale"), given("fill"), given("stroke"), given("body"),
        at("ax", "cx", "width").alias("a"), at("ay", "cy", "height").alias("b"),
    )


@query("""WITH html AS (SELECT regexp_replace(html, '<script>.*?</script>', '<script></script>', 'gs') AS html FROM pages), tag AS (SELECT unnest(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS t FROM html)
SELECT lower(regexp_extract(t, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, count(*) AS elements, sum(len(regexp_extract_all(t, '\\s[a-zA-Z-]+="')))::BIGINT AS attributes FROM tag GROUP BY 1""")
def page_elements(spark, d):
    return S.element_counts(V.table(spark, d, "pages").select(F.col("html").alias("text")))
