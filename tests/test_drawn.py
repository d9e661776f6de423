"""Runs told net by net in numpy, against the same by joins and windows."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import meshline.plans.path_queries  # noqa: F401  (registers)
from meshline.operators import drawn as D, paths as P
from meshline.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def drawn(spark, seed, scale, nets=12):
    """Random paths over few places, straight and slanting, some of one point, with lines and directions."""
    gen, rows = np.random.default_rng(seed), []
    for n in range(nets):
        for e in range(int(gen.integers(1, 9))):
            points = gen.integers(-3, 4, (int(gen.integers(1, 6)), 2)) * scale
            slant = gen.random() < 0.5
            if not slant:
                points = np.repeat(points, 2, axis=0)[1:]
                points[1::2, 1] = points[0:-1:2, 1] if len(points) > 1 else points[1::2, 1]
            rows += [(n, n * 100 + e, i, float(x), float(y), bool(gen.random() < 0.2), e % 3, e % 2 == 1) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "net long, edge long, seq long, x double, y double, is_node boolean, line long, reversed boolean").repartition(3)


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def told(table):
    return sorted(repr(tuple(r.values())) for r in table.to_pylist())


@pytest.mark.parametrize(("seed", "scale"), [(1, 8.0), (2, 5.5), (3, 12.0)])
def test_runs_as_by_joins(spark, monkeypatch, seed, scale):
    paths = drawn(spark, seed, scale).cache()
    runs = P.coincident_runs(paths, paths.filter("is_node").select("net", "x", "y"), 8.0).cache()
    corners = [F.col(f"{e}.v{k}").alias(f"{e}_{k}") for e in ("start", "end") for k in "xy"]
    steps = paths.select("net", "line", F.col("edge").alias("step"), "edge", "reversed").distinct()
    want = {
        "ends": P.run_ends(runs).select("net", "edge", "run", "segments", "owners", *corners),
        "lines": P.run_lines(runs, paths.select("net", "edge", "line").distinct()),
        "traversals": P.remapped_traversals(steps, P.run_chains(paths, runs, 8.0)),
    }
    want = {k: rows(df) for k, df in want.items()}
    for name, f in (("ends", D.run_ends), ("lines", D.run_lines), ("traversals", D.remapped_traversals)):
        assert rows(f(paths, "is_node", 8.0)) == want[name]
    # here, a few nets at a time, and where a number for all columns has no room
    p = paths.toPandas().sort_values(["net", "edge", "seq"], ignore_index=True).rename(columns={"is_node": "node"})
    p["place"] = p.groupby("net").cumcount() + 1
    monkeypatch.setattr(D, "POINTS", 40)
    for room in (D.ROOM, 1 << 12, 1):
        monkeypatch.setattr(D, "ROOM", room)
        parts = list(D._whole_nets(iter(pa.RecordBatch.from_pandas(p[i : i + 7]) for i in range(0, len(p), 7))))
        assert len(parts) > 2 and sum(len(q["net"]) for q in parts) == len(p)
        for name in want:
            assert told(pa.concat_tables([pa.table(getattr(D.Drawn(q, 8.0), name)()) for q in parts])) == want[name]


def test_nothing_and_places_that_are_null(spark):
    kinds = "net long, edge long, seq long, x double, y double, is_node boolean"
    assert D.run_ends(spark.createDataFrame([], kinds), "is_node", 8.0).count() == 0
    one = [(1, 1, 0, 0.0, 0.0, None), (1, 1, 1, None, 0.0, None), (1, 1, 2, 8.0, 0.0, None), (2, 1, 0, 0.0, 0.0, True), (None, 1, 0, 0.0, 0.0, True), (None, 1, 1, 8.0, 0.0, True)]
    got = D.run_ends(spark.createDataFrame(one, kinds), "is_node", 8.0).collect()
    assert [(r.net, r.segments, r.start_x, r.end_x) for r in got] == [(1, 2, 0, 64)]
    got = D.run_ends(spark.createDataFrame(one[:2], kinds), "is_node", 8.0).collect()
    assert [(r.segments, r.end_x, r.end_y) for r in got] == [(1, None, 0)]


@pytest.mark.parametrize("name", ["coincident_runs", "run_lines", "remapped_traversals"])
def test_segments_are_not_joined(spark, name):
    """One join, of items and orders; unit segments are neither sorted nor met by Spark."""
    plan = re.sub(r"#\d+L?", "", QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString())
    assert plan.count("Join") == 1 and plan.count("MapInArrow") == 1 and plan.count("Window [") <= 3
