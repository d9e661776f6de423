"""Plans that keep work spread: rows dealt by their number, and no further exchange inside what they are dealt by."""

import re

import numpy as np
import pytest

from meshline.operators import bodies as B, fingerprints as H, labels as L, layout as Y, network as N, paths as P
import meshline.plans.path_queries  # noqa: F401  (registers)
from meshline.plans.queries import QUERIES
from meshline.sources import network as V
from meshline.sources.stored import dealt

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> list[str]:
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))]


def test_digests_sum_what_lies_before_a_row(spark):
    rows = [(k, i, f"text {i}") for k in (1, 2) for i in range(50)]
    got = H.joined_digests(spark.createDataFrame(rows, "key long, place long, text string"), ";", rows_per_range=7)
    assert "following$()), 1" not in plan(got) and "1, unboundedfollowing" not in plan(got)  # such a frame is summed anew for each row
    want = {}
    for k in (1, 2):
        h = 5381
        for c in ";".join(t for key, _, t in rows if key == k):
            h = (h * 33 + ord(c)) & 0xFFFFFFFF
        want[k] = f"{h:08x}"
    assert {r["key"]: r["hash"] for r in got.collect()} == want


def test_powers_of_long_texts(spark):
    n = [0, 1, 511, 512, 262143, 262144, 2**27 - 1, 2**27, 2**27 + 5]
    got = spark.createDataFrame([(x,) for x in n], "n long").select("n", H._power(H.F.col("n")).alias("p")).collect()
    assert {r.n: r.p for r in got} == {x: pow(33, x, 1 << 32) for x in n}


def test_rows_are_dealt_by_their_number(spark):
    df = spark.range(1000).withColumn("k", H.F.col("id") % 7)
    assert dealt(df, 1000, "k", each=100).rdd.getNumPartitions() == 10
    assert dealt(df, 0).rdd.getNumPartitions() == 1


@pytest.fixture
def three(monkeypatch):
    """The small tables would be one task."""
    monkeypatch.setattr(V, "dealt", lambda df, rows, *key, each=0: df.repartition(3, *key))


def test_calls_of_a_route_stay_together(spark, three):
    """Windows, edges and degrees work inside what calls are dealt by; one exchange, by number, and small sums after it."""
    lines = N.edge_lines(N.steps(N.visits(V.stops(spark, DATA))))
    assert "REPARTITION_BY_NUM" in plan(lines)
    assert exchanges(lines) == ["l_orderkey, 3"]
    assert sorted(exchanges(N.line_degrees(lines))) == ["l_orderkey, 3", "node, 4"]


@pytest.mark.parametrize("name", ["slot_offsets", "canonical_offsets"])
def test_lines_of_an_edge_are_no_one_window(spark, name):
    assert "windowspecdefinition(u" not in re.sub(r"#\d+L?", "", plan(QUERIES[name](spark, DATA))).replace("windowspecdefinition(u, v, _range", "")


@pytest.mark.parametrize("name", ["coincident_runs", "run_lines", "remapped_traversals", "planar_points", "planar_parts", "crossing_nodes"])
def test_paths_stay_in_their_net(spark, three, name):
    """Orders meet items by key, then all of it by net: vertices, pairs and parts are not dealt again."""
    assert set(exchanges(QUERIES[name](spark, DATA))) <= {"l_orderkey, 3", "o_orderkey, 3", "net, 3"}


def test_nets_with_many_segments_meet_by_cells(spark, monkeypatch):
    paths = V.crossing_paths(spark, DATA)
    rows = lambda df: sorted(map(tuple, df.collect()))
    few = rows(P.crossing_nodes(P.crossings(paths, 64.0)))
    monkeypatch.setattr(P, "FEW", 5)
    assert rows(P.crossing_nodes(P.crossings(paths, 64.0))) == few


def test_labels_are_placed_in_blocks(spark, monkeypatch):
    """A chain of labels, each over the next: blocks of 20, not a round for each."""
    calls = []
    monkeypatch.setattr(L, "stored", lambda df, f=L.stored: calls.append(1) or f(df))
    monkeypatch.setattr(L, "BLOCK", 20)
    costs = [(i, c, i * 4.0 + 7 * c, 0.0, i * 4.0 + 7 * c + 10, 5.0, c + 1) for i in range(60) for c in range(2)]
    df = spark.createDataFrame(costs, "id long, c int, x0 double, y0 double, x1 double, y1 double, cost long")
    got = {r.id: (r.c, r.cost) for r in L.packed(df, spark.createDataFrame([(i, i + 1) for i in range(60)], "id long, place long"), 16.0).collect()}
    want, held = {}, []
    for i in range(60):
        own = [(k + 100 * sum(x0 < h + 10 and x0 + 10 > h for h in held), c, x0) for j, c, x0, _, _, _, k in costs if j == i]
        cost, c, x0 = min(own)
        want[i] = (c, cost)
        held.append(x0)
    assert got == want and len(calls) <= 4


def test_boxes_are_counted_without_pairs(spark):
    gen = np.random.default_rng(5)
    low, size = gen.integers(0, 100, (300, 2)), gen.integers(1, 60, (300, 2))
    rows = [(i, *map(int, a), *map(int, a + b)) for i, (a, b) in enumerate(zip(low, size, strict=True))]
    got = Y.nested_boxes(spark.createDataFrame(rows, "id long, x0 long, y0 long, x1 long, y1 long"), 16.0)
    assert "FlatMapCoGroupsInPandas" in plan(got) and "Join" not in plan(got)
    area = lambda b: (b[3] - b[1]) * (b[4] - b[2])
    for r in got.collect():
        a = rows[r.id]
        over = [b for b in rows if area(b) > area(a) and b[1] <= a[1] and b[2] <= a[2] and b[3] >= a[3] and b[4] >= a[4]]
        assert (r.depth, r.parent) == (len(over), min(((area(b), b[0]) for b in over), default=(0, -1))[1])


def test_pairs_of_boxes_are_dealt_by_number(spark):
    import meshline.plans.entry_queries  # noqa: F401  (registers)

    assert "REPARTITION_BY_NUM" in plan(QUERIES["boxes_met"](spark, DATA))
    assert "REPARTITION_BY_NUM" in plan(QUERIES["parsed_elements"](spark, DATA))


def test_marks_of_many_nodes_come_in_one_call(spark, monkeypatch):
    gen = np.random.default_rng(6)
    rows = [(n, i, *map(float, gen.integers(0, 50, 2))) for n in range(40) for i in range(30)] + [(99, i, *map(float, gen.normal(0, 9, 2))) for i in range(300)]
    monkeypatch.setattr(B, "PIECE", 100)
    got = B.farthest_pairs(spark.createDataFrame(rows, "node long, id long, x double, y double"))
    assert "SPARK_PARTITION_ID" not in plan(got)
    for r in got.collect():
        own = [x for x in rows if x[0] == r.node]
        most = max(((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 for a in own for b in own)
        assert abs(r.distance - most) < 1e-9


def test_nearest_nodes_are_looked_up_near_by(spark, monkeypatch):
    gen = np.random.default_rng(7)
    nodes = [(i, *map(float, np.round(gen.normal(0, 3, 2), 1))) for i in range(400)] + [(400, 90.0, 0.0), (401, 90.0, 0.0)]
    points = [(i, *map(float, np.round(gen.normal(0, 30, 2), 1))) for i in range(300)]
    sides = []
    monkeypatch.setattr(Y, "celled", lambda df, side, *xy, f=Y.celled: sides.append(side) or f(df, side, *xy))
    kinds = "id long, x double, y double"
    got = {r.id: (r.node, r.distance) for r in Y.nearest(spark.createDataFrame(points, kinds), spark.createDataFrame(nodes, kinds), 64.0).collect()}
    want = {}
    for i, x, y in points:
        d, n = min((float(np.sqrt((x - a) * (x - a) + (y - b) * (y - b))), k) for k, a, b in nodes)
        if d <= 64:
            want[i] = (n, d)
    assert got == want and min(sides) <= 4


def test_networks_are_ordered_many_in_one_call(spark):
    lines = spark.createDataFrame([(n, 1, 2, r) for n in range(50) for r in (3, 1, 2)], "network long, u long, v long, route long")
    got = Y.line_orders(lines)
    assert "groupBy" not in plan(got) and "bucket" in plan(got)
    assert sorted((r.network, r.route, r.place) for r in got.collect()) == [(n, r, r - 1) for n in range(50) for r in (1, 2, 3)]
