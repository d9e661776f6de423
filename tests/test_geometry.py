"""Known shapes and invariants of operators that SQL cannot check, or checks only in part."""

import math

from pyspark.sql import functions as F

from meshline.operators import geometry as G, layout as L, network as N, raster as R


def line(spark, *points, key=1):
    return spark.createDataFrame([(key, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "line long, seq long, x double, y double")


def test_clip_square_to_half(spark):
    got = G.clip(line(spark, (0, 0), (4, 0), (4, 4), (0, 4)), 0.0, 0.0, 2.0, 4.0)
    assert {(r.x, r.y) for r in got.collect()} == {(0, 0), (2, 0), (2, 4), (0, 4)}


def test_clip_drops_what_lies_outside(spark):
    assert G.clip(line(spark, (5, 5), (6, 5), (6, 6)), 0.0, 0.0, 1.0, 1.0).count() == 0


def test_simplify_keeps_ends_and_spike(spark):
    got = G.simplify(line(spark, (0, 0), (1, 0.1), (2, 5), (3, 0.1), (4, 0)), 1.0).orderBy("seq").collect()
    assert [r.seq for r in got] == [0, 2, 4]


def test_simplify_single_point(spark):
    assert G.simplify(line(spark, (1, 1)), 1.0).count() == 1


def test_offset_of_straight_line(spark):
    got = G.offset_points(line(spark, (0, 0), (1, 0), (2, 0)), 2.0).orderBy("seq").collect()
    assert [(r.x, r.y) for r in got] == [(0, 2), (1, 2), (2, 2)]


def test_square_area_and_chaikin(spark):
    square = line(spark, (0, 0), (2, 0), (2, 2), (0, 2))
    assert G.ring_areas(square, "line").first().area == 4
    assert G.chaikin(square).count() == 8


def test_one_cell_has_four_edges_and_area_one(spark):
    edges = R.boundary_edges(spark.createDataFrame([(3, 4)], "col long, row long"))
    assert edges.count() == 4 and R.mask_area(edges).first().area == 1


def test_rings_close_and_hold_the_mask(spark):
    # a long bar, a ring of cells with a hole, and cells that meet at corners only
    bar = [(1, 100 + c, 200) for c in range(150)]
    frame = [(1, c, r) for c in range(3) for r in range(3) if (c, r) != (1, 1)]
    corners = [(2, 5 + i, 5 + i) for i in range(4)] + [(2, 6, 5), (2, 9, 5)]
    cells = spark.createDataFrame(bar + frame + corners, "network long, col long, row long")
    for network, rings in ((1, 3), (2, None)):
        mine = cells.filter(F.col("network") == network).select("col", "row")
        edges = R.boundary_edges(mine).withColumn("network", F.lit(network).cast("long"))
        found = {}
        for r in sorted(L.stitch_rings(edges).collect(), key=lambda r: (r.ring, r.seq)):
            found.setdefault(r.ring, []).append((r.x, r.y))
            assert r.seq == len(found[r.ring]) - 1
        steps = [(*a, *b) for ring in found.values() for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
        assert sorted(steps) == sorted((e.x, e.y, e.x2, e.y2) for e in edges.collect())
        assert all(min(ring, key=lambda p: (p[1], p[0])) == ring[0] for ring in found.values())
        assert sum(a * d - b * c for a, b, c, d in steps) / 2 == R.mask_area(edges).first().area == mine.count()
        assert rings is None or len(found) == rings


def test_boundaries_that_do_not_close_are_in_no_ring(spark):
    edges = [(1, 0, 0, 1, 0), (1, 1, 0, 1, 1), (1, 1, 1, 0, 1), (1, 7, 7, 8, 7), (1, 8, 7, 8, 8)]
    rows = spark.createDataFrame(edges, "network long, x long, y long, x2 long, y2 long")
    assert L.stitch_rings(rows).count() == 0
    assert L.stitch_rings(rows.unionByName(spark.createDataFrame([(1, 0, 1, 0, 0)], rows.schema))).count() == 4
    assert L.stitch_rings(rows.limit(0)).count() == 0


def test_erode_undoes_dilate_of_one_cell(spark):
    cell = spark.createDataFrame([(5, 5)], "col long, row long")
    assert [tuple(r) for r in R.erode(R.dilate(cell, 1, 20)).collect()] == [(5, 5)]


def test_components_join_across_a_long_path(spark):
    cells = [(i, 0) for i in range(30)] + [(0, 5)]
    got = R.components(spark.createDataFrame(cells, "col long, row long"))
    assert got.select("component").distinct().count() == 2


def test_visits_merge_runs_and_keep_returns(spark):
    stops = spark.createDataFrame([(1, i, g, s) for i, (g, s) in enumerate([(1, True), (1, False), (2, False), (1, True)])], "route long, seq long, grp long, is_stop boolean")
    got = [(r.grp, r.is_stop) for r in N.visits(stops).orderBy("visit").collect()]
    assert got == [(1, True), (2, False), (1, True)]
    assert [r.grp for r in N.stop_visits(N.visits(stops)).collect()] == [1]


def test_transfers_are_within_distance(spark):
    g = spark.createDataFrame([(1, -74.0, 40.0), (2, -74.0, 40.003), (3, -74.0, 40.1)], "grp long, lng double, lat double")
    got = N.transfers(g).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]
    assert math.isclose(got[0].metres, 333.58, abs_tol=0.1)
