"""Line deduplication against a plain count of lines, and its reversal."""

import collections
import hashlib

import numpy as np
import pytest

from meshline.llm import lines

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def key(line):
    return line.strip(BLANK).translate(LOWER)


def plain(rows, least, against=None):
    n = collections.Counter(k for _, t in (against or rows) for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for doc, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if n[key(x)] < least]
        out.append((doc, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    gen = np.random.default_rng(4)
    pool = [f"Line {i} of some text" for i in range(60)] + ["ÉTÉ", "été", "  menu\t", "MENU", "Menu\r", "\x0b", "a", "A", "日本　"]
    out = [(int(i), "\n".join(gen.choice(pool, gen.integers(1, 25)))) for i in range(80)]
    long = "\n".join(f"unique {i}" for i in range(40_000)) + "\nmenu"
    return [*out, (None, "menu\nof no id"), (5, "menu\nshared id"), (90, None), (91, ""), (92, "\n\n"), (93, long), (94, long), *[(95, "menu\ncopy")] * 4]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1.5, "mine") for r in rows], "doc_id long, text string, n_lines double, digest string").repartition(3)


def read(df):
    new = [c for c in df.columns if c.startswith("n_lines_") or c == "n_dropped"]
    assert all((r.n_lines, r.digest) == (1.5, "mine") for r in df.collect())
    return sorted(((r.doc_id, r[new[0]], r[new[1]], r.text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("filter_bytes", [lines.FILTER_BYTES, 0])
def test_lines_of_many_documents_go(spark, rows, filter_bytes):
    docs = table(spark, rows)
    got = lines.clean(docs, lines.build(docs, 9), filter_bytes)
    assert got.columns == ["doc_id", "text", "n_lines", "digest", "n_lines_", "n_dropped"]
    assert read(got) == plain(rows, 9)


def test_deletion_reverses_insertion(spark, rows):
    first, second, third = rows[:50], rows[50:70], rows[70:]
    index = lines.insert(lines.build(table(spark, first), 6), table(spark, second))
    docs = table(spark, first)
    assert read(lines.clean(docs, index)) == plain(first, 6, first + second)
    grown = lines.insert(index, table(spark, third))
    assert read(lines.clean(table(spark, rows), grown)) == plain(rows, 6)
    back = lines.delete(lines.delete(grown, table(spark, third)), table(spark, second))
    assert read(lines.clean(docs, back)) == plain(first, 6)
    alone = lines.build(docs, 6)
    held = lambda x: sorted((r.k1, r.k2, r.refs) for r in x.refs.collect())
    assert held(back) == held(alone)
    gone = lines.delete(back, docs)
    assert gone.refs.count() == 0 and read(lines.clean(docs, gone)) == plain(first, 10**9)


def test_empty_table(spark, rows):
    docs = table(spark, rows)
    index = lines.build(docs.limit(0))
    assert lines.clean(docs.limit(0), index).count() == 0
    assert read(lines.clean(docs, lines.insert(index, docs))) == plain(rows, lines.LEAST_DOCS)


def keys(seed, n):
    out = np.empty(n, lines.KEY)
    out["k1"], out["k2"] = np.random.default_rng(seed).integers(0, 2**63, (2, n), dtype=np.int64).astype(np.uint64)
    return out


def test_filter_holds_what_was_inserted_and_not_deleted():
    a, b, c = keys(1, 3000), keys(2, 500), keys(3, 200_000)
    held = lines.cuckoo_of(np.concatenate([a, b]))
    assert lines._held(held, 0, a, len(held)).all() and lines._held(held, 0, b, len(held)).all()
    assert lines._held(held, 0, c, len(held)).mean() < 5e-4
    lines.cuckoo_delete(held, b)
    assert lines._held(held, 0, a, len(held)).all() and lines._held(held, 0, b, len(held)).mean() < 0.01
    assert (held > 0).sum() == 3000
    assert not lines.cuckoo_insert(held, keys(4, 20_000)) and (held > 0).sum() == 3000


def test_keys_that_a_filter_holds_by_accident_are_listed(spark):
    """As many frequent keys as it takes for accidents, with the same fingerprints looked for among the others."""
    import pandas as pd

    many, few = keys(5, 4000), keys(6, 300_000)
    both = np.concatenate([many, few])
    n = np.where(np.arange(len(both)) < len(many), 10, 9)
    frame = pd.DataFrame({"k1": both["k1"].view(np.int64), "k2": both["k2"].view(np.int64), "before": 0, "after": n})
    got = lines._updated(10)((0,), pd.DataFrame({"buckets": []}), frame)
    wrong = np.frombuffer(got["wrong"][0], lines.KEY)
    held = lines._dropper(list(got.itertuples()))
    assert len(wrong) and np.isin(wrong, few).all()
    found = lines._held(held[0], held[1][0], both, held[2][0])
    assert found[: len(many)].all() and found[len(many) :].sum() == len(wrong)
    assert (found & ~np.isin(both, wrong)).sum() == len(many)


def test_query_has_digests_of_what_is_left(spark):
    data = "/root/testdata/sf0.001"
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.op12_line_dedup(spark, data).collect())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in plain(rows, 10))
    assert got == want and any(r[2] for r in got)
