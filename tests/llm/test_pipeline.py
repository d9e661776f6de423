"""The corpus pipeline's stages, each on its own input."""

import corpus_pipeline
from meshline.llm import packing

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[2] < counts[1] and counts[-1] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    want = {r.doc_id: r.n for r in packing.pieces(docs).groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()}
    got = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()}
    assert got == want and len(got) == counts[-1]


def test_empty_and_null_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, 0)], docs.schema))
    for d in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, DATA)
        assert d.count() == 0


def test_near_duplicates_are_linked_by_fingerprints(spark, monkeypatch):
    """The stage takes operator 10's fingerprints and links; what they propose is compared exactly."""
    from meshline.llm import simhash

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(reversed(words)), " ".join(words)]
    seen = []
    monkeypatch.setattr(simhash, "links", lambda fps, *a, f=simhash.links: seen.append({r.fp for r in fps.collect()}) or f(fps, *a))
    kept = simhash.without_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
    assert seen == [{simhash._signed(simhash.fingerprint(t)) for t in texts}]


def test_repeats_are_cut_out_by_one_python_step(spark):
    """Filters on the cut text don't run the step again, which took a second worker for each task that outlives the stage."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = corpus_pipeline.no_repeats(spark, docs, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_stages_read_ranges_one_after_another(spark):
    """Side by side, each thread keeps a direct buffer as large as the longest range."""
    from meshline.llm.shared import VECTORED, bounded_batches

    spark.conf.unset(VECTORED)
    bounded_batches(spark)
    assert spark.conf.get(VECTORED) == "false"
    spark.conf.set(VECTORED, "true")
    bounded_batches(spark)
    assert spark.conf.get(VECTORED) == "true"  # a session that asks for them keeps them
    spark.conf.unset(VECTORED)
