"""Results under fingerprints: what is computed again, what is kept, what is left when nothing comes of it."""

import pytest
from pyspark.sql import functions as F

from meshline.operators import fingerprints as P
from meshline.sources.cached import ResultStore


def djb2(text):
    h = 5381
    for c in text:
        h = (h * 33 + ord(c)) & 0xFFFFFFFF
    return f"{h:08x}"


def keys(spark, **fps):
    return spark.createDataFrame([(int(k[1:]), v) for k, v in fps.items()], "key long, fp string")


@pytest.fixture
def store(spark, tmp_path):
    return ResultStore(spark, f"file://{tmp_path}/cache")


def computing(asked, spark):
    """Computes a row per key but for key 9, of which nothing comes, and notes what it was asked for."""

    def compute(wanted):
        asked.append(sorted(r.key for r in wanted.collect()))
        return wanted.filter("key <> 9").withColumn("round", F.lit(len(asked)))

    return compute


def rows(df):
    return {r.key: r["round"] for r in df.collect()}


def test_only_changed_keys_are_computed_again(spark, store):
    asked = []
    compute = computing(asked, spark)
    wanted = keys(spark, k1="a", k2="b", k3="c")
    assert store.read("layout", wanted) is None
    assert rows(store.refresh("layout", wanted, compute)) == {1: 1, 2: 1, 3: 1}
    assert rows(store.refresh("layout", wanted, compute)) == {1: 1, 2: 1, 3: 1}
    assert asked == [[1, 2, 3]]  # nothing was read or computed the second time
    changed = keys(spark, k1="a", k2="new", k4="d")
    assert rows(store.refresh("layout", changed, compute)) == {1: 1, 2: 2, 4: 2}
    assert asked[1:] == [[2, 4]]
    assert rows(store.read("layout", wanted)) == {1: 1, 3: 1}  # the old fingerprint of 2 is a miss
    assert sorted(r.key for r in store.hits("layout", changed).collect()) == [1, 2, 4]
    other = ResultStore(spark, store.root, version="2")
    assert other.hits("layout", changed).count() == 0 and rows(other.read("layout", changed)) == {}


def test_keys_without_rows_are_asked_for_again(spark, store):
    asked = []
    compute = computing(asked, spark)
    wanted = keys(spark, k1="a", k9="x")
    assert rows(store.refresh("geo", wanted, compute)) == {1: 1} == rows(store.refresh("geo", wanted, compute))
    assert asked == [[1, 9], [9]]


def test_empty_selections_leave_another_layouts_ones(spark, store):
    area = lambda *k: spark.createDataFrame([(x, 1) for x in k], "key long, round int")
    store.put_selections("sel", keys(spark, k1="a", k2="a"), area(1, 2))
    store.put_selections("sel", keys(spark, k1="nogeo", k2="a"), area())
    assert rows(store.read("sel", keys(spark, k1="a", k2="a"))) == {1: 1}
    store.put_selections("sel", keys(spark, k1="b"), area(1))
    assert rows(store.read("sel", keys(spark, k1="a"))) == {} and rows(store.read("sel", keys(spark, k1="b"))) == {1: 1}


def test_prune_and_a_second_writer(spark, store):
    compute = computing([], spark)
    wanted = keys(spark, k1="a", k2="b", k3="c")
    store.refresh("sub", wanted, compute)
    store.prune("sub", spark.createDataFrame([(1,), (3,), (7,)], "key long"))
    assert rows(store.read("sub", wanted)) == {1: 1, 3: 1}
    with pytest.raises(RuntimeError):
        store._publish("sub", store.entries("sub"), 1)


@pytest.mark.parametrize("rows_per_range", [1_000_000, 3])
def test_digests_of_joined_texts(spark, rows_per_range):
    texts = {1: ["abc", "", "d|e", "été"], 2: ["x" * 500] * 9, 3: [""], 4: ["", ""]}
    df = spark.createDataFrame([(k, i, t) for k, v in texts.items() for i, t in enumerate(v)], "key long, place long, text string").repartition(4)
    for separator in (";", ", ", ""):
        got = {r.key: r.hash for r in P.joined_digests(df, separator, rows_per_range).collect()}
        if separator:
            assert got == {k: djb2(separator.join(v)) for k, v in texts.items() if ord(max("".join(v) or "a")) < 256}


def test_fingerprint_changes_with_each_input_and_not_with_row_order(spark):
    part = lambda *t: spark.createDataFrame([(1, i, x) for i, x in enumerate(t)], "key long, place long, text string")
    one = spark.createDataFrame([(1, "l")], "key long, o string")
    fp = lambda s, r, o="l": P.fingerprints(one.withColumn("o", F.lit(o)), {"stations": s, "routes": r}, {"options": F.col("o")}).first()
    a, b = part("s1", "s2"), part("r1")
    base = fp(a, b)
    assert base.stations == djb2("s1;s2") and base.routes == djb2("r1") and base.fp == "v6-" + djb2("|".join(["6", base.stations, base.routes, base.options]))
    assert fp(a.orderBy(F.desc("place")), b) == base
    assert len({base.fp, fp(part("s1", "s3"), b).fp, fp(a, part("r2")).fp, fp(a, b, "d").fp, fp(a, part("r1").limit(0)).fp}) == 5
