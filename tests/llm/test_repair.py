"""Conversation repair against a plain search over edits, row by row."""

import collections
import hashlib
import heapq
import itertools
import zlib

import duckdb
import numpy as np
import pytest

from meshline.llm import repair as rp

BLANK = " \t\n\x0b\x0c\r"
LEGAL = {"": "su", "s": "u", "u": "a", "a": "u"}


def search(rows):
    """The cheapest audit by best-first search over (cost, audit): rows are (initial, must go, cut short)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, steps = heapq.heappop(heap)
        if (at, last) in seen and at < len(rows) + 1:
            continue
        seen.add((at, last))
        if at == len(rows) + 1:
            return cost, audit, steps
        if at == len(rows):
            if last in ("", "a"):
                heapq.heappush(heap, (cost, audit, at + 1, last, steps))
        else:
            initial, gone, short = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, steps))
            if not gone:
                if initial in LEGAL[last] and initial:
                    heapq.heappush(heap, (cost + 3 * short, audit + "K", at + 1, initial, (*steps, (at, None))))
                for to in "ua":
                    if to in LEGAL[last]:
                        heapq.heappush(heap, (cost + 3 + 3 * short, audit + "R", at + 1, to, (*steps, (at, to))))
        for to in "ua":
            if to in LEGAL[last]:
                heapq.heappush(heap, (cost + 3, audit + "I", at, to, (*steps, (None, to))))
    raise AssertionError


def plain(table):
    by = collections.defaultdict(list)
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        by[conv]
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        by[conv] += [(turn is not None, turn or 0, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv, rows in by.items():
        rows.sort()
        seen, told = set(), []
        n = collections.Counter()
        for _, _, role, text in rows:
            solid = text.strip(BLANK)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            told.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(told))
        turns = [t for some, t, _, _ in rows if some]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, steps = search(told)
        full = {"u": "user", "a": "assistant"}
        lines = [f"{full[to] if to else rows[at][2]}:{rows[at][3] if at is not None else ''}" for at, to in steps]
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    gen = np.random.default_rng(3)
    out = []
    for conv in range(120):
        for turn in range(int(gen.integers(0, 12))):
            turn_ = None if gen.random() < 0.05 else int(turn + 3 * (gen.random() < 0.1))
            role = gen.choice(["user", "assistant", "system", "tool", "", "User", None, "superuser"], p=[0.4, 0.34, 0.1, 0.04, 0.03, 0.03, 0.03, 0.03])
            text = gen.choice(["Fine.", "Again!", "What?", "cut off", "", " \t\n", "Ends. \n", None, "été\xa0", "a\nb?\r\n"], p=[0.2, 0.2, 0.2, 0.15, 0.05, 0.03, 0.05, 0.02, 0.05, 0.05])
            out.append((conv, turn_, role, text))
    out += [(None, 1, "user", "No id."), (None, None, "assistant", "no turn"), (-5, -2, "user", "Negative."), (-5, 7, "assistant", "Far.")]
    out += [(500, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(300)] + [(501, 1, "user", "Same.")] * 70 + [(502, 1, "assistant", "x" * 50_000 + "."), (502, 2, "user", "")]
    out += [(503, None, None, None)] * 3
    return out


KINDS = "conv_id long, turn long, role string, text string"


def read(df):
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_rows", [rp.BLOCK_ROWS, 5])
def test_repairs_by_search(spark, rows, block_rows):
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], KINDS + ", n int, letters string").repartition(5)
    assert read(rp.repair(rp.damaged(df), block_rows=block_rows)) == plain(rows)


def test_query_and_sql_agree_on_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, KINDS)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = [tuple(v) for v in con.execute(rp.oracle()).fetchall()]
    names = [d[0] for d in con.description]
    assert names == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(want, key=repr) == plain(rows)


def test_empty_table_and_dropped_conversations(spark):
    empty = spark.createDataFrame([], KINDS)
    assert rp.repair(rp.damaged(empty)).count() == 0
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = read(rp.repair(rp.damaged(spark.createDataFrame([(conv, 0, "user", "Gone.")], KINDS))))
    assert got == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_every_parse_gives_the_same_matrix():
    gen = np.random.default_rng(8)
    plain_ = rp.Grammar([])
    rounds = [{0 << 32 | 1: 9, 8 << 32 | 8: 10}, {9 << 32 | 2: 11, 10 << 32 | 10: 12}, {11 << 32 | 12: 13}]
    packed = rp.Grammar(rounds)
    for _ in range(200):
        letters = "".join(gen.choice(list(rp.LETTERS), gen.integers(1, 30)))
        a, b = plain_.matrix(letters), packed.matrix(letters)
        reach = [(p, q) for p in range(4) for q in range(4) if a.cost[p][q] < rp.NEVER]
        assert a.cost == b.cost and all(a.audit(p, q) == b.audit(p, q) for p, q in reach)
        for p in range(4):  # the kept order is that of the audits
            ends = [q for q in range(4) if (p, q) in reach]
            assert sorted(ends, key=lambda q: a.rank[p][q]) == sorted(ends, key=lambda q: a.audit(p, q))


def test_pairs_are_replaced_from_left_to_right():
    codes, bounds = rp.encoded(["xxxxx", "", "xx", "sxx", "x"], [{8 << 32 | 8: 9}])
    assert [codes[a:b].tolist() for a, b in itertools.pairwise(bounds)] == [[9, 9, 8], [], [9], [0, 9], [8]]


def test_grammar_learns_common_pairs(spark):
    seqs = spark.createDataFrame([("suauaua", 10), ("ua", 100), ("xxxxxxxx", 3), ("o", 5)], "letters string, n long")
    rounds = rp.grammar(seqs)
    number = {c: i for i, c in enumerate(rp.LETTERS)}
    assert number["u"] << 32 | number["a"] in rounds[0] and number["x"] << 32 | number["x"] in rounds[0]
    codes, bounds = rp.encoded(["suauaua", "xxxxxxxx"], rounds)
    assert np.diff(bounds).max() <= 2 and len(rounds) <= rp.ROUNDS
