"""Operators of the llm subpackage against brute force, on small tables with nulls, blanks, ties and repeated rows."""

import collections
import hashlib
import re
import textwrap
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from meshline.llm import decontaminate, fingerprint, language, licenses, packing, quality, simhash, simple8b, suffixes, tokens, toxicity
from meshline.llm.shared import shared_dir

WORDS = "the of and river stone cold bright lamp seven under walks green paper wind slow".split()


def text(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, blank and very long texts, copies, near copies, repeated rows, and clashing extra columns."""
    rows = [(i, text(i, 30 + 7 * i), "en" if i % 2 else None, "s", None) for i in range(20)]
    long = text(99, 60)
    near = long.replace("river", "rivers", 1)
    rows += [(20, None, None, None, None), (21, "", "en", "s", 0), (22, " \n\t ", "en", "s", 3), (23, long, "en", "s", 1), (24, long, "en", "s", 1)]
    rows += [(25, near, "en", "s", 1), (26, text(5, 20_000), "en", "s", 1), (27, "Éa Ünï 日本 ﬁn don't <|endoftext|>\x1fx", "fr", "s", 1)]
    rows += [(None, "a text without an id", "en", "s", 1), (28, "again", "en", "s", 1), (28, "again", "en", "s", 1), (28, "other words", "en", "s", 1)]
    extra = [(*r, 0.5, "label", 7) for r in rows]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, start int"
    return spark.createDataFrame(extra, kinds).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def ids_of(texts):
    t = tokens.WordTokenizer().whole
    return [np.array([*e.ids, 1], "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


# --- op1 ---


def test_packing_covers_every_id_once(docs, empty):
    assert packing.pack(empty).count() == 0
    got = packing.pack(docs).collect()
    fill, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None and r.doc_id != 28:
            by_doc[int(r.doc_id)].append(r)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    want = pairs(docs)
    for (doc, _), ids in zip(want, ids_of([t for _, t in want]), strict=True):
        if doc is None or doc == 28:
            continue
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in got) == sum(len(i) for i in ids_of([t for _, t in want]))


def test_packing_of_awkward_lengths_cuts_and_pads_little():
    for lengths in (np.full(900, 1500), np.full(500, 1025), np.array([2047] * 5 + [1] * 3), np.array([7])):
        h = collections.Counter((-(-lengths // packing.CLASS)).tolist())
        placed = packing.pack_shard(lengths, packing.mixture(h, 2048 // packing.CLASS))
        used, seen = collections.Counter(), collections.defaultdict(list)
        for row, a, b, seq, offset in placed:
            assert offset == used[seq]
            used[seq] += b - a
            seen[row].append((a, b))
        for row, parts in seen.items():
            parts.sort()
            assert parts[0][0] == 0 and parts[-1][1] == lengths[row]
            assert all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
            assert all(b % packing.STEP == 0 or b == lengths[row] for _, b in parts)
        assert sum(used.values()) == lengths.sum() and max(used.values()) <= 2048
        if len(lengths) > 100:
            assert len(used) * 2048 <= 1.03 * lengths.sum() + 2048


@given(st.binary(max_size=300), st.integers(0, 70))
@settings(max_examples=50, deadline=None)
def test_crc_of_a_part(data, cut):
    data = data[: len(data) // 4 * 4]
    cut = min(cut * 4, len(data))
    assert packing.crc_part(zlib.crc32(data[:cut]), zlib.crc32(data), len(data) - cut) == zlib.crc32(data[cut:])


# --- op2 ---


def brute_removals(rows, span):
    count = collections.Counter(r[i : i + span] for _, t in rows for r in [t.encode()] for i in range(len(r) - span + 1))
    out = []
    for doc, t in rows:
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - span + 1):
            if count[raw[i : i + span]] > 1:
                gone[i] += 1
                gone[i + span] -= 1
        gone = np.cumsum(gone)[: len(raw)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_match_brute_force(docs, empty):
    assert suffixes.removals(empty).count() == 0
    for span, gram in ((400, 128), (60, 20)):
        got = suffixes.removals(docs, span, gram).drop("spans").collect()
        assert sorted(map(tuple, got), key=repr) == brute_removals(pairs(docs), span)


def test_texts_are_searched_for_anchors_once(docs, monkeypatch):
    calls = []
    monkeypatch.setattr(suffixes, "_anchored", lambda *a, f=suffixes._anchored: calls.append(a[1]) or f(*a))
    suffixes.removals(docs, words=suffixes.PASSAGE_WORDS)
    assert calls == [suffixes.SPAN, suffixes.PASSAGE_WORDS]


def test_removed_texts_keep_rows_and_columns(docs):
    got = suffixes.remove(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert {r.text for r in got.filter("doc_id = 20").collect()} == {None}


def test_hashes_beyond_a_shard(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MOST_BYTES", 3000)
    base = text(1, 300)
    rows = [(i, base[i : i + 250] + str(i) * 9) for i in range(40)]
    got = suffixes.removals(spark.createDataFrame(rows, "doc_id long, text string"), 60, 20).drop("spans").collect()
    assert sorted(map(tuple, got), key=repr) == brute_removals(rows, 60)


def test_query_reports_passages_of_fifty_words_under_the_byte_span(spark, docs, tmp_path):
    """Passages of 60 words and under 400 bytes that lie in several texts: no byte of them goes, but they are told."""
    names = [f"{a}{b}" for a in "bcdfglmnpr" for b in ("a", "ei", "oü", "u")]
    draw = lambda seed, n: np.random.default_rng(seed).choice(names, n).tolist()
    rows = pairs(docs)
    for p in range(3):
        passage = draw(p, 60)
        assert len(" ".join(passage).encode()) < 300
        # white space is not part of a word, so passages that are laid out in another way are the same
        rows += [(100 * p + i + 100, " ".join(draw(9000 + 10 * p + i, 70)) + " \n"[i % 2] + (" ", "\t")[i % 2].join(passage) + " " + " ".join(draw(9500 + 10 * p + i, 40))) for i in range(4)]
    rows += [(500, "  " + " ".join(draw(9900, 49)) + " x"), (501, " ".join(draw(9900, 49)) + " y")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = suffixes.op2_suffix_dedup(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_removals(rows, 400)
    split = [(doc, t, list(re.finditer(rb"[^ \t\n\v\f\r]+", t.encode()))) for doc, t in rows]
    grams = collections.Counter(tuple(m[0] for m in w[i : i + 50]) for _, _, w in split for i in range(len(w) - 49))
    want = []
    for doc, t, w in split:
        at = np.zeros(len(w) + 2, int)
        for i in range(len(w) - 49):
            if grams[tuple(m[0] for m in w[i : i + 50])] > 1:
                at[i + 1 : i + 51] = 1
        edges = np.flatnonzero(np.diff(at))
        want.append((doc, len(t.encode()), len(edges) // 2, [(w[a].start(), w[b - 1].end()) for a, b in edges.reshape(-1, 2).tolist()]))
    assert sorted(((r.doc_id, r.n_bytes, r.n_passages, [(x.a, x.b) for x in r.passages]) for r in got), key=repr) == sorted(want, key=repr)
    told = {r.doc_id: r for r in got}
    assert all(told[100 * p + i + 100].n_passages == 1 and told[100 * p + i + 100].n_removed == 0 for p in range(3) for i in range(4))
    assert told[500].n_passages == told[501].n_passages == 0 and told[5].n_passages == told[26].n_passages == 1


@given(st.lists(st.integers(1, 3), max_size=80))
@settings(max_examples=80, deadline=None)
def test_suffix_array(s):
    want = sorted(range(len(s)), key=lambda i: s[i:])
    assert suffixes.suffix_array(np.array(s, dtype=np.int64)).tolist() == want


# --- op3 ---


def test_decontamination_finds_exact_and_near_items(spark, docs, empty):
    item = "quiet harbour lights drift over seven cold stones while slow green rivers carry paper boats toward the open sea tonight"
    near = item.replace("seven", "eight")
    rows = [(1, f"{text(1, 50)} {item.upper()}! {text(2, 50)}"), (2, f"{text(3, 9)} {item} {item}"), (3, text(4, 200)), (4, None), (5, ""), (1, f"{text(1, 50)} {item.upper()}! {text(2, 50)}"), (6, near)]
    d = spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, item_id int, words string")
    bench = spark.createDataFrame([(1, item, "x"), (2, "too short", "x"), (3, None, "x"), (None, item, "x"), (4, item, "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (r.at_word, r.similarity) for r in decontaminate.find(d, bench).collect()}
    assert {k for k, v in got.items() if v[1] == 1} == {(1, 1), (1, 4), (2, 1), (2, 4)}
    assert got[(1, 1)][0] == 50 and got[(2, 1)][0] == 9
    assert all(k[0] != 6 for k in got)  # one word of twenty changes five of sixteen shingles
    kept = decontaminate.clean(d, bench)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.find(d, bench.limit(0)).count() == 0 and decontaminate.find(empty, bench).count() == 0


# --- op4 ---


def test_fingerprints_and_edits(docs, empty):
    assert fingerprint.with_edits(empty).count() == 0
    got = fingerprint.with_edits(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[23].fingerprint == by_id[24].fingerprint and by_id[20].fingerprint == by_id[21].fingerprint
    unique = sorted((d, t) for d, t in pairs(docs) if d is not None and d < 28)
    for (below, head), (doc, t) in zip(unique, unique[1:], strict=False):
        k = len(t) // 3
        edited = t[: len(t) - k] + head[:k]
        assert by_id[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and by_id[doc].n_chars == len(t)
        assert below < doc
    assert by_id[24].near_next == 1.0  # next is its copy
    assert all(0 <= r.near_edited <= 1 and len(r.fingerprint) == 256 for r in got)
    assert fingerprint.fingerprints(docs).count() == docs.count()


def test_collision_rate_is_generalised_jaccard(spark):
    rows = []
    for i in range(60):
        a = text(i, 120).split()
        b = a[: 40 + i] + text(1000 + i, 80 - i).split() + a[:10] * (i % 3)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    fp = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    grams = lambda t: collections.Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4))
    off = []
    for i in range(60):
        a, b = grams(rows[2 * i][1]), grams(rows[2 * i + 1][1])
        true = sum((a & b).values()) / sum((a | b).values())
        x, y = fp[2 * i], fp[2 * i + 1]
        off.append(sum(x[k : k + 4] == y[k : k + 4] for k in range(0, 256, 4)) / 64 - true)
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.12


# --- op5 ---


def test_token_files_round_trip(spark, docs, empty):
    path = shared_dir(spark)
    simple8b.write_ids(docs, path)
    got = sorted(((r.doc_id is not None, r.doc_id, r.ids) for r in simple8b.read_ids(spark, path).collect()), key=repr)
    rows = pairs(docs)
    want = sorted(((d is not None, d, i.tolist()) for (d, _), i in zip(rows, ids_of([t for _, t in rows]), strict=True)), key=repr)
    assert got == want
    order = [(r.doc_id is not None, r.doc_id or 0) for r in simple8b.read_ids(spark, path).orderBy("range", "record", "seq").collect()]
    assert order == sorted(order)
    nothing = shared_dir(spark)
    simple8b.write_ids(empty, nothing)
    assert simple8b.read_ids(spark, nothing).count() == 0


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=3000))
@settings(max_examples=40, deadline=None)
def test_simple8b(values):
    v = np.array(values, dtype=np.uint64)
    (place, _, _, back), = simple8b.records(simple8b.to_record([5], np.array([len(v)]), v, (3, 100_000)))
    assert place == (3, 100_000) and back.tolist() == values


def test_op5_query(spark):
    from meshline.llm.simple8b import op5_token_binary

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op5_token_binary(spark, "/root/testdata/sf0.001").collect()}
    at = 0
    for r, ids in zip(rows, ids_of([r.text for r in rows]), strict=True):
        assert got[r.doc_id] == (at, len(ids), zlib.crc32(ids))
        at += len(ids)


# --- op6, op9 ---


def test_quality_learns_and_survives_odd_rows(spark, docs, empty):
    rows = [(i, text(i, 60)) for i in range(60)] + [(100 + i, " ".join(f"{w}%%% |" for w in text(i, 60).split())) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i < 100 else 0) for i, _ in rows if i % 3] + [(3, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(d, labels)
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    assert all((got[i] >= 0.3) == (i < 100) for i, _ in rows if i % 3 == 0)
    odd = quality.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(empty, model).count() == 0
    assert quality.fit(d, labels.limit(0)) == 0.5 and quality.fit(d, labels.filter("quality = 1")) == 1.0


def test_toxic_spans(spark, docs, empty):
    rng = np.random.default_rng(3)
    texts, y = [], []
    for i in range(160):
        w = text(i, 40).split()
        if i % 2:
            for k in rng.choice(40, 3, replace=False):
                w[k] = "Vile," if k % 2 else "rotten"
        texts.append(" ".join(w))
        y.append(i % 2)
    chain = toxicity.train(texts, y)
    d = spark.createDataFrame([(1, "the river is vile and cold."), (2, text(900, 300)), (3, "Rotten stone")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.tag(d, chain).collect()}
    assert got[1].score >= 0.7 > got[2].score and got[3].score >= 0.7
    assert [(s.start, s.end) for s in got[1].spans] == [(13, 17)] and got[2].spans == []
    odd = toxicity.tag(docs, chain).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.tag(empty, chain).count() == 0 and toxicity.tag(d, None).filter("score > 0").count() == 0


def test_toxic_spans_after_blanks(spark):
    chain = toxicity.Chain()
    chain.weights[0]["vile"], chain.bias = 12.0, -6.0
    rows = [(1, " \nthe river vile"), (2, "the river vile\t "), (3, " "), (4, "  vile the"), (5, "the river vile")]
    got = {r.doc_id: r for r in toxicity.tag(spark.createDataFrame(rows, "doc_id long, text string"), chain).collect()}
    spans = {d: [(s.start, s.end) for s in r.spans] for d, r in got.items()}
    assert spans == {1: [(12, 16)], 2: [(10, 14)], 3: [], 4: [(2, 6)], 5: [(10, 14)]}
    assert got[1].score == got[2].score == got[5].score


def test_chain_marginals_match_enumeration():
    chain = toxicity.Chain()
    chain.move = np.array([[0.3, -0.7], [0.2, 0.9]])
    e = np.array([0.5, -1.0, 2.0, 0.1, -0.4])
    starts = np.array([0, 3])
    p, z = chain.marginals(e, starts)
    for a, b, k in ((0, 3, 0), (3, 5, 1)):
        total, on = 0.0, np.zeros(b - a)
        for m in range(2 ** (b - a)):
            tags = [(m >> i) & 1 for i in range(b - a)]
            w = np.exp(sum(e[a + i] for i, t in enumerate(tags) if t) + sum(chain.move[s, t] for s, t in zip(tags, tags[1:], strict=False)))
            total += w
            on += w * np.array(tags)
        assert np.allclose(p[a:b], on / total) and np.isclose(z[k], np.log(total))


# --- op7 ---


def test_languages_and_mixtures(spark, docs, empty):
    words = {"en": "the of and that with from this have".split(), "xx": "zu dön krä mölk vün täg".split()}
    make = lambda lang, s, n: " ".join(np.random.default_rng(s).choice(words[lang], n))
    train = spark.createDataFrame([(i, make(l, i, 60), l) for i in range(40) for l in ("en", "xx")] + [(99, None, "en"), (98, "abc", None)], "doc_id long, text string, lang string")
    langs, model = language.fit(train)
    assert langs == ["en", "xx"]
    rows = [(1, make("en", 500, 30)), (2, make("xx", 501, 30)), (3, make("en", 502, 90) + " " + make("xx", 503, 60)), (4, None), (5, "123 !!"), (6, "")]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), langs, model).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "xx" and got[1].lang_set == ["en"]
    assert sorted(got[3].lang_set) == ["en", "xx"] and 0.4 < got[3].score < 0.8
    assert [got[i].lang_pred for i in (4, 5, 6)] == ["und"] * 3 and got[4].score == 0
    assert language.predict(docs, langs, model).count() == docs.count()
    assert language.predict(empty, langs, model).count() == 0
    assert language.predict(docs, *language.fit(train.limit(0))).filter("lang_pred != 'und'").count() == 0


# --- op8 ---


def test_license_rules(spark, docs, empty):
    assert all(re.search(licenses.HINT, s) for s in licenses.SENTENCES)
    header = (
        'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n'
        "You may obtain a copy of the License at\n"
    )
    bsd = {i: s.format("the University of Somewhere") for s, i in licenses.SENTENCES.items() if i.startswith("BSD")}
    two = [bsd[k] for k in ("BSDHead", "BSDSource", "BSDBinary")]
    numbered = [bsd["BSDHead"], *[f"({k}) {bsd[i]}" for k, i in enumerate(("BSDSource", "BSDBinary", "BSDNames"), 1)], bsd["BSDAsIs"]]
    rows = [
        (1, "Some words.\nReleased under the MIT License.\nMore."), (2, header), (3, ".\n".join(two) + ". "), (4, ".\n".join([*two, bsd["BSDNames"]])), (5, None), (6, ""),
        (7, "MIT License is a license"), (8, ";\n".join(numbered)), (9, "Foo is released under the MIT License."), (10, "// SPDX-License-Identifier: MIT"),
        (11, "This project is licensed under the MIT License - see the LICENSE file for details."), (12, "Licensed under the Apache License, Version 2.0 or the MIT license"),
        (13, "This code is licensed under CC BY-SA 4.0."), (14, "SPDX-License-Identifier: GPL-2.0-or-later */"),
        (15, "To the extent possible under law, A. Person has waived all copyright and related or neighboring rights to this work."),
        (16, "Neither the name of " + "very " * 40 + "nor the names of its contributors may be used"),
    ]
    got = licenses.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rule int")).collect()
    found = sorted((r.doc_id, r.rule) for r in got)
    assert found == [
        (1, "mit-notice"), (2, "apache-2.0-short-header"), (3, "bsd-2-clause"), (4, "bsd-3-clause"), (8, "bsd-3-clause-text"), (9, "mit-notice"), (10, "spdx-mit"), (11, "mit-notice"),
        (12, "apache-2.0-notice"), (12, "mit-notice"), (13, "cc-by-sa-4.0-notice"), (14, "spdx-gpl-2.0-or-later"), (15, "cc0-1.0-waiver"),
    ]
    assert {(r.first_word, r.n_words) for r in got if r.doc_id in (1, 9)} == {(2, 5)}
    assert licenses.scan(docs).count() == 0 and licenses.scan(empty).count() == 0


def test_places_of_many_sentences(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BLOCK", 4)
    gen = np.random.default_rng(1)
    want, parts, at = [], [], 0
    for i in range(40):
        filler = ["word"] * int(gen.integers(0, 5))
        parts += [*filler, "released under the MIT license." if i % 3 else "Licensed under CC BY 4.0\n"]
        want.append((at + len(filler), 5 if i % 3 else 6))
        at += len(filler) + want[-1][1]
    got = licenses.scan(spark.createDataFrame([(1, " ".join(parts))], "doc_id long, text string")).collect()
    assert sorted((r.first_word, r.n_words) for r in got) == want


GPL = """This program is free software{mark} you can redistribute it and/or modify it under the terms of the {name}General Public License as published by the Free Software Foundation{comma} either version {v} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name}General Public License for more details."""
VERBATIM = {
    "gpl-3.0-header": GPL.format(mark=":", name="GNU ", comma=",", v=3),
    "gpl-2.0-header": GPL.format(mark=";", name="GNU ", comma=";", v=2),
    "agpl-3.0-header": GPL.format(mark=":", name="GNU Affero ", comma=",", v=3),
    "lgpl-2.1-header": GPL.replace("This program", "This library").format(mark=";", name="GNU Lesser ", comma=";", v=2.1),
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mit-text": """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}


def test_licenses_are_found_however_they_are_wrapped(spark):
    rows = []
    for rule, whole in VERBATIM.items():
        for width, lead in ((10_000, ""), (78, ""), (70, " * "), (60, "# "), (16, "// "), (1, "")):
            lines = [line for part in whole.split("\n\n") for line in [*textwrap.wrap(part, width, break_long_words=False), ""]]
            rows.append((rule, "Some words of a file\n" + "\n".join(lead + line for line in lines) + "\nint main()"))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.rule for r in got if r.doc_id != r.rule} == set()
    assert collections.Counter(r.doc_id for r in got) == dict.fromkeys(VERBATIM, 6)


# --- op10 ---


def brute_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, radius):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fl = sorted(fps)
    for i, a in enumerate(fl):
        for b in fl[:i]:
            if bin(a ^ b).count("1") <= radius:
                parent[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_near_duplicates_match_brute_force(docs, empty):
    assert simhash.near_duplicates(empty).count() == 0
    rows = pairs(docs)
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    root = brute_components({f for _, f in fps}, 2)
    least = {}
    for d, f in fps:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    want = sorted(((d, f"{f:016x}", least.get(root[f])) for d, f in fps), key=repr)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == want


@pytest.mark.parametrize("dense", [2, 32])
@pytest.mark.parametrize("radius", [1, 2])
def test_links_keep_components(spark, dense, radius):
    rng = np.random.default_rng(radius)
    fps = set()
    for _ in range(12):
        base = int(rng.integers(0, 1 << 63))
        for _ in range(int(rng.integers(1, 30))):
            flips = rng.choice(64, int(rng.integers(0, 4)), replace=False)
            fps.add(base ^ sum(1 << int(b) for b in flips))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = simhash.links(spark.createDataFrame(signed, "fp long"), radius, dense=dense).collect()
    parent = {f: f for f, in signed}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in got:
        assert bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= radius
        parent[top(r.a)] = top(r.b)
    root = brute_components(fps, radius)
    assert len({top(f) for f, in signed}) == len(set(root.values()))


def test_whole_documents_that_are_similar(spark, docs):
    base = [f"{w}{i}" for i, w in enumerate(text(7, 200).split())]
    rows = [(i, " ".join([*base[: 20 * i], f"new{i}", *base[20 * i + 1 :]])) for i in range(8)] + [(50, text(8, 200)), (51, None), (52, "")]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(8)} == {0} and got[50] == 50 and got[52] == 51
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [*range(21), 23, *([25] if 25 in ids else []), 26, 27, 28, 28]


def brute_groups(texts, similar=0.8):
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in ((d, t.split()) for d, t in texts)}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both >= similar * (len(sets[a]) + len(sets[b]) - both):
                a_, b_ = root(a), root(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {d: root(d) for d in sets}


def test_similar_documents_under_a_template(spark):
    """A template that a third of the rows hold, pairs and revisions over it, against all pairs."""
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    template, rows = fresh(170), []
    for _ in range(40):  # strangers at under 0.8 and one partner each at a little over it
        own = fresh(30)
        rows += [own + template, own[:21] + fresh(9) + template]
    for _ in range(10):  # revisions: each near the one before, ends far apart
        words = fresh(25) + template
        for k in range(4):
            rows.append(list(words))
            words[175 - 11 * k : 186 - 11 * k] = fresh(11)
    rows += [fresh(int(rng.integers(1, 200))) for _ in range(240)]
    order = rng.permutation(len(rows))
    texts = [(int(d), " ".join(r)) for d, r in zip(order, rows, strict=True)]
    got = simhash.similar_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    want = brute_groups(texts)
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) < len(texts) - 40
