"""Label packing against one label at a time, and combo geometry by known cases."""

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from meshline.operators import corridors as C, labels as L


def one_at_a_time(labels, marks, segments):
    """``labels``: {id: (text, x, y)}, ``marks``: {id: [(x, y)]}; the place and cost that each label takes."""
    covers = [(min(x for x, _ in m) - L.MARK, min(y for _, y in m) - L.MARK, max(x for x, _ in m) + L.MARK, max(y for _, y in m) + L.MARK) for m in marks.values()]

    def over(a, b):
        return a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1]

    def hits(s, b):
        (x, y), (x2, y2) = s
        if max(x, x2) < b[0] or min(x, x2) > b[2] or max(y, y2) < b[1] or min(y, y2) > b[3]:
            return False
        inside = [b[0] <= px <= b[2] and b[1] <= py <= b[3] for px, py in s]
        turn = lambda o, p, q: (q[1] - o[1]) * (p[0] - o[0]) - (p[1] - o[1]) * (q[0] - o[0]) > 0
        corners = [(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])]
        sides = zip(corners, corners[1:] + corners[:1], strict=True)
        return any(inside) or any(turn(c, d, s[0]) != turn(c, d, s[1]) and turn(*s, c) != turn(*s, d) for c, d in sides)

    out, placed = {}, []
    for i in sorted((i for i in labels if i in marks), key=lambda i: (-len(labels[i][0]), i)):
        text, x, y = labels[i]
        near = min(marks[i], key=lambda m: (m[0] - x) ** 2 + (m[1] - y) ** 2)
        if len(marks[i]) > 1 and (near[0] - x) ** 2 + (near[1] - y) ** 2 > L.SLID**2:
            x, y = near
        best = None
        for c, (wx, hy, ox, oy, rank) in enumerate(L.PLACES):
            x0, y0 = x + len(text) * 6 * wx + ox * 12, y + 13 * hy + oy * 12
            box = (x0, y0, x0 + len(text) * 6, y0 + 13)
            cost = 100 * sum(over(box, b) for b in placed) + 30 * sum(over(box, b) for b in covers) + 12 * sum(hits(s, box) for s in segments) + rank
            if best is None or cost < best[1]:
                best = (c, cost, box)
        out[i] = best[:2]
        placed.append(best[2])
    return out


def test_packing_as_one_label_at_a_time(spark):
    gen = np.random.default_rng(5)
    labels = {i: ("m" * int(gen.integers(1, 12)), float(x), float(y)) for i, (x, y) in enumerate(gen.uniform(0, 420, (90, 2)))}
    marks = {i: [(x + float(a), y + float(b)) for a, b in gen.uniform(-25, 25, (int(gen.integers(1, 4)), 2))] for i, (_, x, y) in labels.items() if i % 11}
    ends = gen.uniform(0, 420, (30, 4)).tolist() + [[50, 0, 50, 400], [0, 60, 400, 60], [7, 7, 7, 7]]
    segments = [((a, b), (c, d)) for a, b, c, d in ends]
    lab = spark.createDataFrame([(i, *v) for i, v in labels.items()], "id long, label string, x double, y double")
    mark = spark.createDataFrame([(i, k, x, y) for i, m in marks.items() for k, (x, y) in enumerate(m)], "id long, mark int, x double, y double")
    seg = spark.createDataFrame([(i, *map(float, e)) for i, e in enumerate(ends)], "seg long, x double, y double, x2 double, y2 double")
    anchored = L.anchors(lab, mark)
    costs = L.place_costs(L.candidates(anchored), mark, seg, side=40.0)
    order = L.longest_first(lab.join(mark, "id", "left_semi"))
    got = {r.id: (r.c, r.cost) for r in L.packed(costs, order, side=40.0).collect()}
    assert got == one_at_a_time(labels, marks, segments)


def test_lines_meet_boxes_without_lists_of_pairs(spark):
    """Ends and corners on a lattice, so that many touch; the same for each pair as by columns, in few numbers for each."""
    gen = np.random.default_rng(9)
    low, size = gen.integers(0, 8, (60, 2)), gen.integers(0, 4, (60, 2))
    box = pd.DataFrame(np.c_[low, low + size].astype(float), columns=["x0", "y0", "x1", "y1"])
    seg = pd.DataFrame(gen.integers(-2, 13, (120, 4)).astype(float), columns=["x", "y", "x2", "y2"])
    met = spark.createDataFrame(box.assign(id=range(60))).crossJoin(spark.createDataFrame(seg)).filter(L.segment_meets_box(*map(F.col, ("x", "y", "x2", "y2"))))
    want = {r["id"]: r["n"] for r in met.groupBy("id").agg(F.count("*").alias("n")).collect()}
    b = {k: box[k].to_numpy()[:, None] for k in box}
    assert L._crossed(b, {k: seg[k].to_numpy() for k in seg}).tolist() == [want.get(i, 0) for i in range(60)]
    long = {k: np.repeat(v, 5000) for k, v in (("x", -50.0), ("y", -50.0), ("x2", 50.0), ("y2", 50.0))}
    tracemalloc.start()
    assert L._crossed(b, long).shape == (60,)
    assert tracemalloc.get_traced_memory()[1] < 70 * 60 * 5000
    tracemalloc.stop()


def test_labels_of_a_block_choose_by_what_lies_near():
    gen = np.random.default_rng(4)
    at, size = np.round(gen.uniform(-60, 60, (900, 2)), 1), np.round(gen.uniform(1, 25, (900, 2)), 1)
    pdf = pd.DataFrame({"id": np.arange(900) // 3, "c": np.arange(900) % 3, "x0": at[:, 0], "y0": at[:, 1], "x1": at[:, 0] + size[:, 0], "y1": at[:, 1] + size[:, 1],
                        "cost": gen.integers(0, 40, 900), "place": np.arange(900) // 3 + 1, "block": 0})
    got = L._choose(pdf.sample(frac=1, random_state=1))
    held, want = [], []
    for i in range(300):
        own = pdf[pdf["id"] == i]
        cost = [int(r.cost) + 100 * sum(r.x0 < h.x1 and r.x1 > h.x0 and r.y0 < h.y1 and r.y1 > h.y0 for h in held) for r in own.itertuples()]
        k = int(np.argmin(cost))
        held.append(list(own.itertuples())[k])
        want.append((i, k, cost[k]))
    assert [tuple(map(int, r)) for r in got[["id", "c", "cost"]].itertuples(index=False)] == want


def course(spark, tracks, path):
    point = lambda p: {"x": p[0] / 1000, "y": p[1] / 1000}
    t = spark.createDataFrame([(k, g, [point(p) for p in c]) for k, (g, c) in tracks.items()], "track string, grp string, coords array<struct<x:double,y:double>>")
    s = spark.createDataFrame([(1, i, k, back) for i, (k, back) in enumerate(path)], "route long, pos long, track string, reversed boolean")
    got = C.combo_courses(s, t, "route").first()
    return [(round(p.x * 1000), round(p.y * 1000)) for p in got.course] if got else None


def test_tracks_chain_and_shared_points_are_told_once(spark):
    tracks = {"a": (None, [(0, 0), (5, 0), (5, 0), (10, 0)]), "b": (None, [(20, 0), (10, 0)])}
    assert course(spark, tracks, [("a", False), ("b", True)]) == [(0, 0), (5, 0), (10, 0), (20, 0)]
    assert course(spark, tracks, [("none", False), ("a", True)]) == [(10, 0), (5, 0), (0, 0)]


def test_the_way_back_is_not_drawn_again(spark):
    tracks = {"a": (None, [(0, 0), (10, 0)]), "b": (None, [(10, 0), (10, 5), (0, 0)]), "c": (None, [(0, 0), (5, 1), (10, 0)]), "d": (None, [(50, 0), (60, 0)])}
    assert course(spark, tracks, [("a", False), ("b", False)]) == [(0, 0), (10, 0)]
    assert course(spark, tracks, [("a", False), ("c", False), ("a", True)]) == [(0, 0), (10, 0)]
    assert course(spark, tracks, [("a", False), ("d", False)]) == [(0, 0), (10, 0), (50, 0), (60, 0)]


def test_tracks_of_one_station_are_drawn_once(spark):
    tracks = {"p": ("g1", [(0, 0), (1, 0)]), "q": ("g1", [(1, 0), (2, 0)]), "r": ("g2", [(9, 0), (10, 0)]), "m": (None, [(1, 0), (9, 0)])}
    assert course(spark, tracks, [("p", False), ("q", False), ("m", False), ("r", False)]) == [(0, 0), (1, 0), (9, 0), (10, 0)]
    assert course(spark, tracks, [("p", False), ("r", False), ("q", False)]) == [(0, 0), (1, 0), (9, 0), (10, 0), (1, 0), (2, 0)]


def test_first_corridor_of_either_direction(spark):
    kind = "array<struct<x:double,y:double>>"
    combos = spark.createDataFrame([(2, 1, "n1", "n2"), (1, 1, "n1", "n2"), (1, 2, "n3", "n1"), (1, 3, "n1", "n4"), (1, 4, "n2", "n9")], "route long, combo long, start_node string, end_node string")
    p = lambda *v: [{"x": float(x), "y": 0.0} for x in v]
    courses = spark.createDataFrame([(2, 1, p(0, 9)), (1, 1, p(0, 1, 2)), (1, 2, p(5, 4)), (1, 3, p(3, 2)), (1, 4, p(1, 1))], f"route long, combo long, course {kind}")
    groups = spark.createDataFrame([("n1", 1), ("n2", 2), ("n3", 3), ("n4", 1)], "node string, grp long")
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    got = {(r.a, r.b): r.course and [q.x for q in r.course] for r in C.attached(edges, C.corridors(combos, courses, groups)).collect()}
    assert got == {(1, 2): [0, 1, 2], (1, 3): [4, 5], (2, 3): None}
