"""Path operators: known shapes, and step-by-step versions of what they do at once."""

import collections

import numpy as np
import pytest

from meshline.operators import paths as P


def table(spark, paths):
    """``paths``: {(net, edge): points}."""
    rows = [(n, e, i, float(x), float(y)) for (n, e), points in paths.items() for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "net long, edge long, seq long, x double, y double")


def nodes(spark, points):
    return spark.createDataFrame([(1, float(x), float(y)) for x, y in points], "net long, x double, y double")


def runs_of(spark, paths, at, step=8.0):
    runs = P.coincident_runs(table(spark, paths), nodes(spark, at), step)
    return runs, {(r.edge, r.run): r for r in P.run_ends(runs).collect()}


def test_shared_stretch_becomes_one_run(spark):
    paths = {(1, 1): [(0, 0), (32, 0)], (1, 2): [(8, 0), (24, 0), (24, 16)]}
    runs, ends = runs_of(spark, paths, [(0, 0), (32, 0)])
    told = {k: (r.owners, r.segments, tuple(r.start), tuple(r.end)) for k, r in ends.items()}
    assert told == {
        (1, 1): ("1", 1, (0, 0), (64, 0)), (1, 2): ("1,2", 2, (64, 0), (192, 0)), (1, 3): ("1", 1, (192, 0), (256, 0)), (2, 1): ("2", 2, (192, 0), (192, 128)),
    }
    lines = spark.createDataFrame([(1, 1, "A"), (1, 2, "B")], "net long, edge long, line string")
    got = collections.defaultdict(set)
    for r in P.run_lines(runs, lines).collect():
        got[r.edge, r.run].add(r.line)
    assert got == {(1, 1): {"A"}, (1, 2): {"A", "B"}, (1, 3): {"A"}, (2, 1): {"B"}}


def test_runs_end_at_nodes_and_vertices_of_other_phase_meet(spark):
    # the same course with vertices at other places, the other way round
    paths = {(1, 1): [(0, 0), (5, 0), (32, 0)], (1, 2): [(32, 0), (13, 0), (0, 0)]}
    _, ends = runs_of(spark, {k: [p for p in v if p[0] % 8 == 0] for k, v in paths.items()}, [(16, 0)])
    assert {k: (r.owners, r.segments) for k, r in ends.items()} == {(1, 1): ("1,2", 2), (1, 2): ("1,2", 2)}


def test_traversals_are_remapped_in_their_direction(spark):
    paths = {(1, 1): [(0, 0), (16, 0)], (1, 2): [(16, 0), (0, 0), (0, 16)]}
    df = table(spark, paths)
    runs = P.coincident_runs(df, nodes(spark, [(0, 0), (16, 0)]), 8.0)
    steps = spark.createDataFrame([(1, "A", 0, 1, False), (1, "A", 1, 2, False), (1, "B", 0, 2, True)], "net long, line string, step long, edge long, reversed boolean")
    got = P.remapped_traversals(steps, P.run_chains(df, runs, 8.0)).orderBy("line", "place").collect()
    told = [(r.line, r.run_edge, r.run, r.reversed) for r in got]
    assert told == [("A", 1, 1, False), ("A", 1, 1, True), ("A", 2, 1, False), ("B", 2, 1, True), ("B", 1, 1, False)]


def random_paths(seed, nets=3, edges=8):
    gen = np.random.default_rng(seed)
    return {(n, n * 100 + e): [tuple(p) for p in gen.integers(0, 40, (int(gen.integers(2, 6)), 2)) * 8] for n in range(nets) for e in range(edges)}


def test_every_segment_lies_in_one_run(spark):
    paths = random_paths(1)
    df = table(spark, paths)
    units = P.unit_segments(P.lattice_split(df, 8.0)).select("net", "low", "high")
    runs = P.coincident_runs(df, nodes(spark, []), 8.0)
    assert runs.count() == runs.select("net", "low", "high").distinct().count() == units.distinct().count()
    chains = P.run_chains(df, runs, 8.0)
    assert {(r.net, r.edge) for r in chains.collect()} == {(r.net, r.edge) for r in P.unit_segments(P.lattice_split(df, 8.0)).collect()}


def test_two_crossing_edges_become_four_parts(spark):
    df = table(spark, {(1, 1): [(0, 50), (100, 50)], (1, 2): [(50, 0), (50, 100)], (1, 3): [(0, 90), (100, 90)], (2, 4): [(50, 0), (50, 100)]})
    cuts = P.crossings(df, 30.0)
    parts = sorted((r.edge, r.part, r.d0, r.d1, r.vx1) for r in P.planar_parts(df, cuts).collect())
    assert parts == [(1, 0, 0, 50, 400), (1, 1, 50, 100, None), (2, 0, 0, 50, 400), (2, 1, 50, 90, 400), (2, 2, 90, 100, None), (3, 0, 0, 50, 400), (3, 1, 50, 100, None), (4, 0, 0, 100, None)]


def test_touches_near_ends_are_no_crossings(spark):
    df = table(spark, {(1, 1): [(0, 50), (100, 50)], (1, 2): [(50, 47), (50, 100)]})
    assert P.crossings(df, 30.0).count() == 0


def test_no_crossing_is_left_and_lengths_stay(spark):
    df = table(spark, random_paths(2))
    parts = P.planar_parts(df, P.crossings(df, 64.0))
    cut = P.sliced(df, parts)
    again = cut.selectExpr("net", "edge * 1000 + part AS edge", "seq", "x", "y")
    # an edge's crossings with itself are not looked for
    assert P.crossings(again, 64.0).filter("floor(pair.a_edge / 1000) <> floor(pair.b_edge / 1000)").count() == 0
    length = lambda d, key: {r.e: r.total for r in P._totals(d).groupBy(key).agg({"total": "sum"}).toDF("e", "total").collect()}
    before, after = length(df, "edge"), length(again, (again["edge"] / 1000).cast("long"))
    assert before.keys() == after.keys() and all(abs(before[e] - after[e]) < 1e-6 for e in before)


def one_by_one(edges, protected=()):
    """Nodes taken out in ascending order, again and again, as long as one can be; edges keep the first ones they are made of."""
    edges = {e: [a, b, lines, [(e, a, b)]] for e, a, b, lines in edges}
    while True:
        at = collections.defaultdict(list)
        for e, (a, b, _, _) in edges.items():
            at[a].append(e), at[b].append(e)
        for n in sorted(at):
            if n in protected or len(at[n]) != 2 or at[n][0] == at[n][1]:
                continue
            (a1, b1, l1, c1), (a2, b2, l2, c2) = (edges[e] for e in at[n])
            o1, o2 = a1 if b1 == n else b1, a2 if b2 == n else b2
            if l1 == l2 and o1 != o2:
                for e in at[n]:
                    del edges[e]
                edges[min(at[n])] = [o1, o2, l1, (c1 if b1 == n else c1[::-1]) + (c2 if a2 == n else c2[::-1])]
                break
        else:
            return {frozenset(e for e, _, _ in c): {a, b} for a, b, _, c in edges.values()}


CASES = {
    "chain": [(1, 1, 2, "A"), (2, 3, 2, "A"), (3, 3, 4, "A")],
    "ring": [(i, i, i % 6 + 1, "A") for i in range(1, 7)],
    "loop at a node": [(1, 1, 2, "A"), (2, 2, 3, "A"), (3, 3, 4, "A"), (4, 4, 2, "A")],
    "unlike lines": [(1, 1, 2, "A"), (2, 2, 3, "A,B"), (3, 3, 4, "A,B")],
    "two edges between two nodes": [(1, 1, 2, "A"), (2, 1, 2, "A")],
    "star": [(1, 1, 9, "A"), (2, 2, 9, "A"), (3, 3, 9, "A"), (4, 3, 4, "A")],
    "long": [(i, i, i + 1, "A") for i in range(1, 40)],
}


@pytest.mark.parametrize("name", [*CASES, "random"])
def test_contraction_as_one_by_one(spark, name):
    if name == "random":
        gen = np.random.default_rng(6)
        pairs = {tuple(sorted(gen.choice(60, 2, replace=False).tolist())) for _ in range(64)}
        edges = [(i, a, b, str(gen.choice(["A", "A", "A", "B"]))) for i, (a, b) in enumerate(sorted(pairs))]
        edges += [(100 + i, 100 + i, 100 + (i + 1) % 5, "A") for i in range(5)] + [(200 + i, 200 + i, 200 + (i + 1) % 13, "A") for i in range(13)]
        protected = [5, 9]
    else:
        edges, protected = CASES[name], []
    df = spark.createDataFrame([(1, *e) for e in edges], "net long, edge long, a long, b long, lines string")
    got = P.contracted(df, spark.createDataFrame([(1, n) for n in protected], "net long, node long")).collect()
    chains = collections.defaultdict(dict)
    for r in got:
        chains[r.chain, r.start, r.end][r.place] = (r.edge, r.reversed)
    ends = {e: (a, b) for e, a, b, _ in edges}
    for (_, start, end), parts in chains.items():
        at = start
        for place in range(len(parts)):
            edge, back = parts[place]
            a, b = ends[edge][::-1] if back else ends[edge]
            assert at == a
            at = b
        assert at == end
    assert {frozenset(e for e, _ in c.values()): {s, t} for (_, s, t), c in chains.items()} == one_by_one(edges, protected)


def test_paths_within_a_line_and_a_cap(spark):
    edges = [("A", 1, 1, 2, 5.0), ("A", 2, 2, 3, 5.0), ("A", 3, 1, 3, 20.0), ("B", 3, 1, 3, 20.0), ("A", 4, 3, 4, 9.0), ("A", 5, 2, 4, 14.0)]
    df = spark.createDataFrame([(1, *e) for e in edges], "net long, line string, edge long, a long, b long, length double")
    src = spark.createDataFrame([(1, "A", 1), (1, "B", 1)], "net long, line string, node long")
    best = P.shortest(df, src, 19.5)
    assert {(r.line, r.node): (r.distance, r.via) for r in best.collect()} == {("A", 1): (0, None), ("B", 1): (0, None), ("A", 2): (5, 1), ("A", 3): (10, 2), ("A", 4): (19, 4)}
    steps = P.traced(best, df, spark.createDataFrame([(1, "A", 1, 4), (1, "B", 1, 3)], "net long, line string, source long, node long"))
    assert sorted((r.back, r.edge, r.reversed) for r in steps.collect()) == [(0, 4, False), (1, 2, False), (2, 1, False)]
    with pytest.raises(ValueError):
        P.shortest(df.withColumn("length", df["length"] * 0), src, 1.0)
