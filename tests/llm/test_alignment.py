"""Alignment of two tokenizers against whole texts tokenised and compared pair by pair."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest

from meshline.llm import alignment as al

NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def whole():
    """Tokens of a whole text by either library: (id, first byte, last byte) of each, or none."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = al.default_vocabularies()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in kept} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in kept)}

    def spans(ids, names):
        at, out = 0, []
        for i, name in zip(ids, names, strict=True):
            out.append((i, at, at + len(name)))
            at += len(name)
        return out

    def tokens(text):
        if not text:
            return [], []
        e = a.encode(" " + text, add_special_tokens=False)
        name_a = [bytes(letter[c] for c in t) for t in e.tokens]
        ids_b = b.encode(text)
        pieces = [b.id_to_piece(i) for i in ids_b]
        name_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
        if not b"".join(name_a) == b"".join(name_b) == (" " + text).encode():
            return [], []
        return spans(e.ids, name_a), spans(ids_b, name_b)

    return tokens


def plain(rows, whole):
    found, counts = [], collections.Counter()
    for doc, text in rows:
        a, b = whole(text)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 3000 else swept(a, b)
        counts.update(links)
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, at = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(t[0]) for t in side if at < t[2] <= end) for side in (a, b)) if len(a) < 3000 else (at, end))
            at = end
        if len(a) >= 3000:
            groups = cut_up(a, b, groups)
        found.append((doc, a, b, groups, links))
    best = collections.defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(
        (
            (d, len(a), len(b), len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
            for d, a, b, g, k in found
        ),
        key=repr,
    )


def swept(a, b):
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        out.append((a[i][0], b[j][0]))
        end_a, end_b = a[i][2], b[j][2]
        i, j = i + (end_a <= end_b), j + (end_b <= end_a)
    return out


def cut_up(a, b, spans):
    side = [collections.deque(a), collections.deque(b)]
    out = []
    for _, end in spans:
        parts = []
        for s in side:
            ids = []
            while s and s[0][2] <= end:
                ids.append(str(s.popleft()[0]))
            parts.append(",".join(ids))
        out.append("|".join(parts))
    return out


ODD = [
    None, "", " ", "  ", "\n", "\n\n", "\t", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\xa0 b", "a　 b", "　", "a  b", "x\x85 y", "né à ça ", "日本 語\n本", "don't I'll we've 'tis",
    "a\x00b", "<|endoftext|> x <s> </s> <unk> <0x0A>", "under▁score", "▁", "é ́ x", "ﬁn ½ ²", "😀 👩‍👩 ok", "    indent\n\n\n        more   \n", "1234 5 67,8.90 $%&*", "\r\nline\r\n", "\x7f \x1f x", "—dash “quoted” …", "a﻿ b",
]


@pytest.fixture(scope="module")
def rows():
    gen = np.random.default_rng(2)
    words = "the of café naïve über Straße l'été 漢字 don't HTTP x_y 3.14 ... — token tokens alignment antidisestablishmentarianism \t \n ▁".split(" ")
    out = [(i, t) for i, t in enumerate(ODD)]
    out += [(100 + i, " ".join(gen.choice(words[:-1], gen.integers(1, 40)))) for i in range(40)]
    return [*out, *[(200, "the same text again")] * 7, (None, "the same text again"), (None, "no id"), (201, "very " * 30_000 + "long"), (202, "ab" * 20_000), (203, " ".join(gen.choice(words, 30)))]


def read(df):
    return sorted(((r.doc_id, *(r[n] for n in NAMES)) for r in df.collect()), key=repr)


def test_cuts_are_ends_of_both(whole, rows):
    gen = np.random.default_rng(1)
    texts = [t for _, t in rows if t and len(t) < 2000]
    texts += ["".join(gen.choice(list("ab é漢.,'\n\t \xa0　 1"), 60)) for _ in range(300)]
    for text in texts:
        flat = np.frombuffer((" " + text).encode(), np.uint8)
        cuts = set(al.cut_places(flat, np.array([0])).tolist())
        for side in whole(text):
            assert not side or cuts <= {t[1] for t in side}


def test_measures_by_brute_force(spark, rows, whole):
    want = plain(rows, whole)
    docs = spark.createDataFrame([(*r, "mine", 3) for r in rows], "doc_id long, text string, digest string, N_A int").repartition(3)
    for broadcast_pairs in (al.BROADCAST_PAIRS, 0):
        got = al.align(docs, broadcast_pairs=broadcast_pairs)
        assert got.columns == ["doc_id", "text", "digest", "N_A", "n_a_", *NAMES[1:]]
        assert {(r.digest, r.N_A) for r in got.collect()} == {("mine", 3)}
        assert read(got.drop("N_A").withColumnRenamed("n_a_", "n_a")) == want
    assert al.align(docs.limit(0)).count() == 0


def test_memo_is_bounded_and_forgets(rows, whole):
    texts = [t for _, t in rows if t and len(t) < 2000]
    small, large = al.Aligner(*al.default_vocabularies(), most_bytes=1), al.Aligner(*al.default_vocabularies())
    for i in range(0, len(texts), 5):
        part = pa.array(texts[i : i + 5])
        x, y = small.align(part), large.align(part)
        assert len(small.memo) < len(large.memo) or i == 0
        assert x[1] == y[1] and all((p == q).all() for p, q in zip((x[0], x[2], x[3]), (y[0], y[2], y[3]), strict=True))


def test_query(spark, whole):
    data = "/root/testdata/sf0.001"
    got = read(al.op13_tokenizer_alignment(spark, data))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert got == plain(rows, whole) and sum(r[1] for r in got)
