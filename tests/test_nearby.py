"""Spurs against removal pair by pair, and nodes and labels by known cases."""

import collections

import numpy as np

from meshline.operators import nearby as N


def test_spurs_go_pair_by_pair(spark):
    gen = np.random.default_rng(3)
    steps = [(n, line, i, int(gen.integers(0, 2)), bool(gen.random() < 0.5)) for n in range(2) for line in range(20) for i in range(int(gen.integers(1, 25)))]
    flags = {(n, line, e): (bool(gen.random() < 0.3), bool(gen.random() < 0.3)) for n in range(2) for line in range(20) for e in range(2) if gen.random() < 0.8}
    want = collections.defaultdict(list)
    for n, line, _, e, back in steps:
        want[n, line].append((e, back))
    for key, left in want.items():
        i = 0
        while i + 1 < len(left):
            (e, back), (f, forth) = left[i : i + 2]
            at_from, at_to = flags.get((*key, e), (False, False))
            if e == f and back != forth and not (at_from if back else at_to):
                del left[i : i + 2]
                i = 0
            else:
                i += 1
    s = spark.createDataFrame(steps, "net long, line long, step long, edge long, reversed boolean")
    stops = spark.createDataFrame([(*k, *v) for k, v in flags.items()], "net long, line long, edge long, at_from boolean, at_to boolean")
    got = collections.defaultdict(list)
    for r in N.without_spurs(s, stops).orderBy("net", "line", "place").collect():
        got[r.net, r.line].append((r.edge, r.reversed))
    assert got == {k: v for k, v in want.items() if v}


def test_a_served_node_is_taken_from_farther_away(spark):
    points = spark.createDataFrame([(1, "A", 0.0, 0.0), (2, "B", 0.0, 0.0), (3, "A", 500.0, 0.0), (4, "C", 9.0, 0.0)], "id long, line string, x double, y double")
    nodes = spark.createDataFrame([(10, 5.0, 0.0), (11, 25.0, 0.0), (12, -31.0, 0.0), (13, 5.0, 0.0)], "id long, x double, y double")
    lines = spark.createDataFrame([(11, "A"), (11, "A"), (12, "B")], "node long, line string")
    got = {r.id: (r.node, r.serves) for r in N.nearest_serving(points, nodes, lines, 10.0).collect()}
    assert got == {1: (11, True), 2: (10, False), 4: (10, False)}


def test_candidates_are_open_near_and_in_order(spark):
    points = spark.createDataFrame([(1, 4.0, 0.0), (2, 900.0, 0.0)], "id long, x double, y double")
    closed = spark.createDataFrame([(0, 0)], "col long, row long")
    got = [(r.id, r.place, r.col, r.row) for r in N.grid_candidates(points, closed, 10.0, 3, 2, 1.2).orderBy("id", "place").collect()]
    assert got == [(1, 1, 1, 0), (1, 2, 0, 1), (1, 3, 1, 1)]


def test_labels_under_cutouts(spark):
    rows = [(1, "abc", 0.0, 0.0, 5.0, 0.0, 10, "left"), (2, "abc", 0.0, 0.0, 5.0, 0.0, 10, "right"), (3, "", 100.0, 0.0, 0.0, -50.0, 10, "left")]
    boxed = N.label_boxes(spark.createDataFrame(rows, "id long, text string, ax double, ay double, x double, y double, size long, align string"))
    told = {r.id: (r.x0, r.y0, r.x1, r.y1) for r in boxed.collect()}
    assert told == {1: (5, -8, 23, 2), 2: (-13, -8, 5, 2), 3: (100, -58, 100, -48)}
    cut = spark.createDataFrame([(10.0, 1.0, 30.0, 5.0), (99.0, -1.0, 101.0, 1.0)], "x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.id for r in N.hidden_labels(boxed, cut, 16.0).collect()) == [1, 3]
