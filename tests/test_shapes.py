"""Bodies, farthest pairs and warps: known cases, and versions over all pairs or in plain numpy."""

import numpy as np
import pytest

from meshline.operators import bodies as B, warps as W


def rect(x0, y0, x1, y1, back=False):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return ring[::-1] if back else ring


def table(spark, rings):
    rows = [(r, i, float(x), float(y)) for r, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "ring long, seq long, x double, y double")


def bodies(spark, *rings):
    return {r.body: (r.area, r.holes) for r in B.water_bodies(table(spark, rings)).collect()}


@pytest.mark.parametrize(
    ("rings", "want"),
    [
        ([rect(0, 0, 1, 1), rect(10, 10, 13, 13)], {0: (1, 0), 1: (9, 0)}),
        ([rect(0, 0, 2, 3), rect(10, 0, 12, 3, back=True)], {0: (6, 0), 1: (6, 0)}),
        ([rect(0, 0, 10, 10), rect(3, 3, 6, 6)], {0: (100, 1)}),
        ([rect(0, 0, 100, 100), rect(20, 20, 80, 80), rect(40, 40, 60, 60)], {0: (10_000, 1), 2: (400, 0)}),
        ([rect(0, 0, 10, 10), rect(0, 0, 10, 10)], {0: (100, 0), 1: (100, 0)}),
        # a hole that touches the outline at its first vertex, and at three of them
        ([rect(0, 0, 100, 100), [(40, 100), (20, 80), (60, 80), (40, 100)]], {0: (10_000, 1)}),
        ([rect(0, 0, 100, 100), [(0, 10), (30, 10), (30, 30), (0, 30), (20, 22), (22, 20), (20, 18), (0, 10)]], {0: (10_000, 1)}),
        # the box lies inside, the ring does not
        ([[(0, 0), (100, 0), (100, 100), (90, 100), (90, 10), (0, 10), (0, 0)], rect(20, 50, 40, 70)], {0: (1900, 0), 1: (400, 0)}),
        ([[(0, 0), (1, 1)], rect(5, 5, 6, 6)], {1: (1, 0)}),
    ],
)
def test_bodies(spark, rings, want):
    assert bodies(spark, *rings) == want


def test_no_rings(spark):
    assert B.water_bodies(table(spark, [rect(0, 0, 1, 1)]).limit(0)).count() == 0


def test_a_deep_nest_of_all_sizes(spark):
    """Every power of two, so that outer rings are far larger than the cells their inner ones lie in."""
    rings = [rect(-(2.0**k), -(2.0**k), 2.0**k, 2.0**k) for k in range(-5, 15)] + [rect(3000.5, 3000.5, 3000.75, 3000.75)]
    got = {r.ring: (r.depth, r.parent) for r in B.decomposed(table(spark, rings)).collect()}
    assert got == {i: (19 - i, i + 1 if i < 19 else None) for i in range(20)} | {20: (3, 17)}


def test_largest_bodies(spark):
    made = B.water_bodies(table(spark, [rect(0, 0, 10, 10), rect(20, 0, 21, 5), rect(30, 0, 31, 0.5), rect(-9, 0, 1 - 9, 5)]))
    areas = lambda df: sorted(r.area for r in df.collect())
    assert areas(B.kept_bodies(made)) == [0.5, 5, 5, 100] == areas(B.kept_bodies(made, share=0.0))
    assert areas(B.kept_bodies(made, share=0.01)) == [5, 5, 100] and areas(B.kept_bodies(made, share=0.1)) == [100]
    assert areas(B.kept_bodies(made, least=1.0)) == [5, 5, 100]
    assert {r.body for r in B.kept_bodies(made, most=2).collect()} == {0, 3}


def test_farthest_pairs_over_all_pairs(spark):
    gen = np.random.default_rng(4)
    rows = [(n, int(i), float(x), float(y)) for n in range(4) for i, (x, y) in enumerate(gen.integers(0, 30, (60, 2)))]
    rows += [(10, 7, 1.0, 1.0), (11, 3, 2.0, 2.0), (11, 1, 2.0, 2.0), *[(12, i, float(i), 3.0) for i in range(9)], *[(13, i, float(i % 2), float(i // 2 % 2)) for i in range(8)]]
    want = {}
    for n in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == n)
        pairs = [(-np.hypot(b[1] - a[1], b[2] - a[2]), a[0], b[0]) for i, a in enumerate(own) for b in own[i:]]
        d, a, b = min((round(float(d), 9), a, b) for d, a, b in pairs)
        want[n] = (a, b, -d)
    df = spark.createDataFrame(rows, "node long, id long, x double, y double").repartition(5)
    got = {r.node: (r.a, r.b, round(r.distance, 9)) for r in B.farthest_pairs(df).collect()}
    assert got == want


BOX = (0.0, 0.0, 800.0, 600.0)


@pytest.fixture(scope="module")
def cloud(spark):
    gen = np.random.default_rng(9)
    spots = np.concatenate([gen.normal((200, 200), 15, (300, 2)), gen.uniform((0, 0), (800, 600), (100, 2)), [[-50, 700], [900, -20], [0, 0], [800, 600]]])
    rows = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(spots)] + [(2, i, 100.0, 100.0 + i) for i in range(3)]
    return spark.createDataFrame(rows, "net long, id long, x double, y double"), spots


def test_warp_gives_room_to_crowds_and_keeps_order(spark, cloud):
    df, spots = cloud
    warp = W.separable(df, *BOX)
    got = {r.id: (r.x, r.y) for r in W.applied(df, warp, *BOX).filter("net = 1").collect()}
    new = np.array([got[i] for i in range(len(spots))])
    for axis in (0, 1):
        order = np.argsort(spots[:, axis], kind="stable")
        assert (np.diff(new[order, axis]) >= 0).all()
    assert np.std(new[:300, 0]) > 2 * np.std(spots[:300, 0])
    assert np.allclose(new[-2:], spots[-2:])  # the canvas's corners stay
    back = W.applied(W.applied(df, warp, *BOX), warp, *BOX, back=True)
    assert all(abs(r.x - spots[r.id][0]) < 1e-6 and abs(r.y - spots[r.id][1]) < 1e-6 for r in back.filter("net = 1").collect())
    none = warp.filter("net = 3")
    assert W.applied(df, none, *BOX).exceptAll(df).count() == 0


def test_flow_as_in_plain_numpy_and_without_folds(spark, cloud):
    df, spots = cloud
    bins, reach = 24, 90.0
    steps = W.flow(df, *BOX, rounds=2, bins=bins, reach=reach)
    got = {r.id: (r.x, r.y) for r in W.moved(df, steps, *BOX, bins=bins).filter("net = 1").collect()}
    w, h = 800 / bins, 600 / bins
    pos = spots.copy()
    for _ in range(2):
        grid = np.zeros((bins, bins))
        for x, y in pos:
            grid[min(bins - 1, max(0, int(np.floor(y / h)))), min(bins - 1, max(0, int(np.floor(x / w))))] += 1
        e = W.excess_grid(grid, 2.5, 0.7, 8.0)
        assert abs(e.mean()) < 1e-12
        fx, fy = np.zeros((bins, bins)), np.zeros((bins, bins))
        for qy in range(bins):
            for qx in range(bins):
                dy, dx = np.meshgrid((qy - np.arange(bins)) * h, (qx - np.arange(bins)) * w, indexing="ij")
                near = (np.abs(dy / h) <= np.ceil(3 * reach / min(w, h))) & (np.abs(dx / w) <= np.ceil(3 * reach / min(w, h)))
                k = np.where(near, np.exp(-(dx * dx + dy * dy) / (2 * reach * reach)), 0) * e
                fx[qy, qx], fy[qy, qx] = (k * dx).sum(), (k * dy).sum()
        a = W.safe_strength(fx, fy, w, h, 0.8)
        out = []
        for x, y in pos:
            u, v = min(max(x / w - 0.5, 0), bins - 1), min(max(y / h - 0.5, 0), bins - 1)
            i, j = min(bins - 2, int(u)), min(bins - 2, int(v))
            s, t = u - i, v - j
            at = lambda f: f[j, i] * (1 - s) * (1 - t) + f[j, i + 1] * s * (1 - t) + f[j + 1, i] * (1 - s) * t + f[j + 1, i + 1] * s * t  # noqa: B023, E731
            out.append((x + a * at(fx), y + a * at(fy)))
        pos = np.array(out)
        # no cell of the moved lattice turns over
        gx, gy = np.meshgrid((np.arange(bins) + 0.5) * w, (np.arange(bins) + 0.5) * h)
        mx, my = gx + a * fx, gy + a * fy
        assert ((mx[1:, 1:] - mx[1:, :-1]) * (my[1:, 1:] - my[:-1, 1:]) - (my[1:, 1:] - my[1:, :-1]) * (mx[1:, 1:] - mx[:-1, 1:]) > 0).all()
    assert max(abs(pos[i] - np.array(p)).max() for i, p in got.items()) < 1e-6
