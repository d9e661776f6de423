"""Cases that lost rows or links once, and stages of the pipeline against brute force, word by word."""

import collections
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from meshline.llm import decontaminate, language, quality, simhash, suffixes

rng = np.random.default_rng(7)
WORDS = ["".join(rng.choice(list("abcdefghijklmnoprstu"), rng.integers(2, 9))) for _ in range(4000)]


def text(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def table(spark, rows, more="key string, found int, score double, lang_pred string, _row int, _key int"):
    """Rows (doc_id, text) with columns whose names the operators might use themselves."""
    tail = ("k", 3, -7.0, "mine", 1, 2)
    return spark.createDataFrame([(*r, "en", "s", 5, *tail) for r in rows], f"doc_id long, text string, lang string, source string, n_chars int, {more}")


@pytest.mark.parametrize("longest", [9, 3])
def test_passages_of_fifty_words_go_and_shorter_ones_stay(spark, longest, monkeypatch):
    """Also where fifty words are far fewer bytes than usual, and where a hash has more text than a shard takes."""
    if longest == 3:
        monkeypatch.setattr(suffixes, "MOST_BYTES", 3000)
    gen = np.random.default_rng(longest)
    words = sorted({"".join(gen.choice(list("abcdefghijklmnoprstu"), gen.integers(1, longest))) for _ in range(4000)})

    def text(seed, n):
        gen = np.random.default_rng(seed)
        return "".join(w + gap for w, gap in zip(gen.choice(words, n), gen.choice([" ", " ", " ", "\n", "  ", "\t"], n), strict=True))

    passage, short, edge = text(1, 60), text(2, 49), text(5, 50)
    rows = [(i, f"{text(100 + i, 60)} {passage} {text(200 + i, 40)}") for i in range(6)]
    rows += [(10 + i, f"{text(300 + i, 60)} {short} {text(400 + i, 40)}") for i in range(6)]
    rows += [(20, text(3, 90)), (21, f"{passage} {text(4, 30)} {passage}"), (22, edge), (23, "  " + edge + " x"), (24, "a " * 70), (25, None), (26, "ü " * 30)]
    docs = table(spark, rows)
    got = {r.doc_id: r for r in corpus_pipeline.no_repeats(spark, docs, "").collect()}
    split = {doc: (t or "").split() for doc, t in rows}
    grams = collections.Counter(tuple(w[i : i + 50]) for w in split.values() for i in range(len(w) - 49))
    told = collections.Counter({r.doc_id: len(r.passages) for r in suffixes.passages(docs).collect()})
    for doc, t in rows:
        w, keep = split[doc], np.ones(len(split[doc]), bool)
        for i in range(len(w) - 49):
            if grams[tuple(w[i : i + 50])] > 1:
                keep[i : i + 50] = False
        assert told[doc] == (np.diff(np.concatenate([[1], keep.astype(int)])) == -1).sum()
        if not keep.any():
            assert doc not in got
            continue
        assert got[doc].text.split() == [x for x, k in zip(w, keep, strict=True) if k] and (not keep.all() or got[doc].text == t)
        assert got[doc].n_chars == len(got[doc].text) and got[doc].key == "k" and got[doc].found == 3
    assert told[21] == 2 and told[10] == 0 and told[24] == 1 and 22 not in got


def test_rows_without_ids_or_with_shared_ids(spark):
    item = text(9, 30)
    bench = spark.createDataFrame([(1, item), (1, text(10, 25)), (None, text(11, 25))], "item_id long, text string")
    rows = [(None, text(20, 50)), (None, text(21, 50)), (None, f"{text(22, 40)} {item}"), (7, text(23, 50)), (7, text(24, 50)), (7, f"{item} {text(25, 9)}")]
    docs = table(spark, [*rows, (8, text(26, 40)), (8, text(26, 40)), (9, None), (10, text(11, 25)), (11, text(10, 25))])
    once = simhash.without_near_duplicates(docs)
    assert once.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in once.collect()), key=repr) == sorted([*rows, (8, text(26, 40)), (9, None), (10, text(11, 25)), (11, text(10, 25))], key=repr)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    want = [r for r in rows if item not in r[1]] + [(8, text(26, 40))] * 2 + [(9, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find(docs, bench).collect()) == [(7, 1), (11, 1)]


def test_near_copies_without_ids_are_found(spark):
    base = text(30, 200)
    near = base.replace(base.split()[100], "other", 1)
    docs = table(spark, [(None, base), (5, near), (None, text(31, 80)), (6, text(31, 80) + " end")])
    assert sorted(r.doc_id for r in simhash.without_near_duplicates(docs).collect()) == [5, 6]


def test_columns_with_names_of_outputs_stay(spark):
    docs = table(spark, [(i, text(i, 60)) for i in range(20)])
    got = corpus_pipeline.known_language(spark, docs, "").collect()
    assert len(got) == 20 and {(r.score, r.lang_pred) for r in got} == {(-7.0, "mine")}


def test_as_many_languages_as_pay_for_themselves():
    models = np.random.default_rng(3).dirichlet(np.full(400, 0.02), 6).astype(np.float32)
    for langs in range(1, 7):
        counts = np.rint(models[:langs].sum(axis=0) * 3000)[None, :].astype(np.float32)
        share = language.mixtures(counts, models + 1e-7)[0]
        assert (share > 0.02).sum() == langs and abs(share[:langs] - 1 / langs).max() < 0.1


def test_mixtures_by_hand():
    """Each document's EM and penalised choice, one document and one language at a time."""
    gen = np.random.default_rng(5)
    model = gen.dirichlet(np.full(40, 0.3), 4).astype(np.float32)
    counts = np.stack([gen.multinomial(60, p) for p in (model[0], model[1] / 2 + model[2] / 2, model[3])]).astype(np.float32)

    def em(c, theta, times):
        for _ in range(times):
            mixed = [sum(theta[j] * model[j, k] for j in range(4)) for k in range(40)]
            theta = [theta[j] * sum(c[k] * model[j, k] / max(mixed[k], 1e-12) for k in range(40)) / c.sum() for j in range(4)]
            theta = [t / sum(theta) for t in theta]
        return theta

    for c, got in zip(counts, language.mixtures(counts, model), strict=True):
        full = em(c, [0.25] * 4, language.ROUNDS)
        order = sorted(range(4), key=lambda j: -full[j])
        best, value = None, -np.inf
        for size in range(1, 5):
            theta = [full[j] if j in order[:size] else 0 for j in range(4)]
            theta = em(c, [t / sum(theta) for t in theta], 3 if size > 1 else 0)
            v = sum(c[k] * np.log(max(sum(theta[j] * model[j, k] for j in range(4)), 1e-12)) for k in range(40)) - 0.5 * (size - 1) * np.log(c.sum())
            if v <= value:
                break
            best, value = theta, v
        assert np.allclose(got, best, atol=1e-3)


def words_of(t):
    return re.findall("[^ \t\n\v\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def alike(a, b):
    """Weighted Jaccard similarity of the five-word shingles of two lists of words."""
    x, y = (collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (a, b))
    both = sum((x & y).values())
    return both / max(1, sum(x.values()) + sum(y.values()) - both)


def test_benchmark_stage_over_all_windows(spark):
    """Every window of an item's length in every document (cut off at its ends), whether or not anything lines up."""
    items = [(i, text(700 + i, n)) for i, n in enumerate((60, 45, 90, 30, 8, 5))] + [(6, text(1, 3)), (7, None), (8, "again again " * 30)]

    def edited(words, kind, at):
        w = list(words)
        if kind == "change":
            w[at] = "changed"
        elif kind == "insert":
            w.insert(at, "inserted")
        elif kind == "delete":
            del w[at]
        elif kind == "swap":
            w[at], w[at + 1] = w[at + 1], w[at]
        return w

    rows, doc = [], 0
    for i, t in items[:6]:
        w = t.split()
        for kind in ("same", "change", "insert", "delete", "swap"):
            for at in (1, len(w) // 2, len(w) - 2):
                rows.append((doc, " ".join([text(800 + doc, 25), *edited(w, kind, at), text(900 + doc, 20)]).upper() if doc % 3 == 0 else " ".join([*edited(w, kind, at), text(900 + doc, 9)])))
                doc += 1
    rows += [(doc, text(5, 120)), (doc + 1, None), (doc + 2, ""), (doc + 3, "again " * 59), (doc + 4, text(700, 30)), (doc + 5, text(1, 3))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in rows:
        w = words_of(t)
        for _, item in items:
            v = words_of(item)
            if len(v) >= 5 and any(alike(w[max(0, i) : i + len(v)], v) >= 0.8 for i in range(1 - len(v), len(w))):
                want.add(d)
    docs = table(spark, rows)
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert {d for d, _ in rows} - kept == want and 18 < len(want) < doc


def test_quality_query_by_hand(spark):
    """Every document against every labelled vector, sorted, and the nearest ones' labels weighted."""
    data = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in quality.op6_quality_knn(spark, data).collect()}
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    fitted = sorted(d for d in labels if d in rows)  # fewer than PER_CLASS, so all of them
    model = quality.fit(spark.read.parquet(f"{data}/documents.parquet"), spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    assert len(model.vectors) == len(fitted) and [int(v) for v in model.y] == [labels[d] for d in fitted]

    def vector(t):
        v = (quality.features([t])[0] * model.idf) @ model.axes
        return v / max(float(np.sqrt((v * v).sum())), 1e-9)

    known = [(vector(rows[d]), labels[d]) for d in fitted]
    for d, t in rows.items():
        own = vector(t)
        near = sorted(((float(own @ v), y) for v, y in known), key=lambda x: -x[0])[: quality.NEIGHBOURS]
        weight = [max(c, 1e-6) ** 8 for c, _ in near]
        score = sum(w * y for w, (_, y) in zip(weight, near, strict=True)) / sum(weight)
        assert abs(got[d].score - score) < 0.02 and got[d].predicted == int(got[d].score >= 0.3)
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
