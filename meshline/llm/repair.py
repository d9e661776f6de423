"""Conversation structure repair (operator 11): cheapest edits to a legal role sequence, over a grammar of conversations.

A conversation's rows become letters: ``s``, ``u``, ``a`` or ``o`` by the role's initial (``o``: any other), in capitals
where the text is cut short, and ``x`` where the row has to go. Legal sequences of role initials are ``(s?(ua)+)?``, an
automaton of four states. A letter has a transfer matrix in the (min, +) sense: the least cost of getting from one state
to another over that row, with any insertions before it, and the edits ("audit") that do it.

Letters of all conversations are compressed by Re-Pair: in each round the commonest pairs of neighbouring symbols, counted
over all distinct sequences with their multiplicity, become rules. A rule's matrix is the product of its two symbols'
matrices, evaluated bottom-up once and shared by all conversations. Its audits are ropes: each entry keeps only the state
in the middle, and is spelled out when it is asked for.

Ties go to the audit that is least in ASCII order. Audits between two states over the same rows never are prefixes of one
another (each ends with a row's letter, and has one for each row), and from one state different end states have different
audits (an audit's letters determine the states), so it is enough to keep the order of a row's four entries: that of a
product follows from the orders of its factors, without looking at the audits.

Conversations of any length are cut into blocks of ``BLOCK_ROWS`` rows or ``BLOCK_BYTES`` of text. Rows are dealt by ranges
of their order, so that one conversation's rows are spread over tasks; blocks are read backwards for the least cost from
each state to the end, and forwards for the choice, one at a time. Only the digest of a repaired conversation has to read
its texts in turn, a block at a time.

Defined results: nulls count as one space (conversation and turn only in the damage's key and in the order, where nulls
come first; a null conversation is one of its own); rows of the same turn are taken in the order of role and text;
repeated rows are rows of their own; texts of any length are taken whole; an empty table gives an empty result; other
columns are no matter.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from meshline.llm.shared import bounded_batches, materialize, table

KEEP, REROLE, DELETE, INSERT = "KRDI"
#: What edits cost; CUT is what an undeleted row whose text is cut short adds.
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
CUT = 3
#: States: nothing yet, after the system's row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: What the end of a conversation adds from each state.
CLOSING = ("", "II", "I", "")
LETTERS = "suaoSUAOx"
NEVER = 1 << 60
#: Rounds of the grammar, and rules of one round at most: a grammar has ``ROUNDS * RULES`` rules at most.
ROUNDS, RULES = 8, 64
BLOCK_ROWS, BLOCK_BYTES = 4096, 1_000_000
#: Blank bytes, and the last character that is none, as patterns.
SOLID = "[^\\x20\\x09-\\x0D]"
MEMO = 20_000


# --- damage and faults ---


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` after damage, with ``n`` equal rows; a row that is dropped leaves ``n`` = 0."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text, role = said("text"), said("role")
    text = F.when(fate.isin(0, 1), "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(fate == 0, "").when(fate == 4, "user").otherwise(role)
    n = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), n.cast("long").alias("n"))


def _faults(rows: DataFrame) -> DataFrame:
    """Equal rows together (``n`` of them), with the ``letter`` of the first one; the others are duplicates in any case."""
    each = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    # nulls come first: (0, null) is less than (1, turn)
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    said = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    each = materialize(each.withColumn("said", said))
    first = each.filter("n > 0").groupBy("conv_id", "said").agg(F.min(place).alias("first"))
    joined = each.alias("e").join(first.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("e.said") == F.col("f.said")), "left")
    # the white space that is stripped is no part of a fault
    last = F.regexp_extract("text", f"({SOLID})[\\x20\\x09-\\x0D]*\\z", 1)
    fault = F.when(last == "", "b").when(F.col("first") != place, "d").when(~last.isin(".", "!", "?"), "t").otherwise("")
    return joined.select("e.conv_id", "e.turn", "role", "text", "n", fault.alias("fault"))


def letter(role: str, fault: str) -> str:
    if fault in ("b", "d"):
        return "x"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if fault == "t" else initial


# --- transfer matrices ---


class Matrix:
    """Least costs between states, the order of each row's audits, and how each audit comes about.

    ``made`` has an entry's audit itself in a letter's matrix, and the state in the middle in a product of two.
    """

    __slots__ = ("cost", "rank", "made", "parts")

    def __init__(self, cost, rank, made, parts=None):
        self.cost, self.rank, self.made, self.parts = cost, rank, made, parts

    def __matmul__(self, other: Matrix) -> Matrix:
        cost, rank, made = [], [], []
        for p in range(4):
            c, r = self.cost[p], self.rank[p]
            best = [min((min(c[m] + other.cost[m][q], NEVER), r[m], m) for m in range(4)) for q in range(4)]
            mid = [b[2] for b in best]
            order = sorted(range(4), key=lambda q: (best[q][0] == NEVER, r[mid[q]], other.rank[mid[q]][q]))  # noqa: B023
            cost.append([b[0] for b in best])
            rank.append([order.index(q) for q in range(4)])
            made.append(mid)
        return Matrix(cost, rank, made, (self, other))

    def audit(self, start: int, end: int) -> str:
        """An entry spelled out; the parts still to be spelled stand on a list, so that depth is no matter."""
        out, rest = [], [(self, start, end)]
        while rest:
            m, p, q = rest.pop()
            if m.parts is None:
                out.append(m.made[p][q])
            else:
                mid = m.made[p][q]
                rest += [(m.parts[1], mid, q), (m.parts[0], p, mid)]
        return "".join(out)


def letter_matrix(symbol: str) -> Matrix:
    """Insertions before the row, then what is done with the row."""
    inserted = [{START: 0, USER: 1, ASSISTANT: 2}, {SYSTEM: 0, USER: 1, ASSISTANT: 2}, {USER: 0, ASSISTANT: 1}, {ASSISTANT: 0, USER: 1}]
    role, more = symbol.lower(), CUT if symbol.isupper() else 0
    entries: list[dict[int, tuple[int, str]]] = [{} for _ in range(4)]
    for p in range(4):
        for m, k in inserted[p].items():
            edits = [(m, COST[DELETE], DELETE)]
            if symbol != "x":
                edits += [(to, COST[KEEP] + more, KEEP) for (at, r), to in STEP.items() if at == m and r == role]
                edits += [(to, COST[REROLE] + more, REROLE) for (at, r), to in STEP.items() if at == m and r != "s"]
            for q, cost, name in edits:
                found = (cost + k * COST[INSERT], INSERT * k + name)
                entries[p][q] = min(entries[p].get(q, (NEVER, "")), found)
    cost = [[e.get(q, (NEVER, ""))[0] for q in range(4)] for e in entries]
    made = [[e.get(q, (NEVER, ""))[1] for q in range(4)] for e in entries]
    rank = []
    for c, a in zip(cost, made, strict=True):
        order = sorted(range(4), key=lambda q: (c[q] == NEVER, a[q]))  # noqa: B023
        rank.append([order.index(q) for q in range(4)])
    return Matrix(cost, rank, made)


#: What the end adds: cost by state, and whether nothing but the empty audit may follow.
CLOSING_COST = [len(c) * COST[INSERT] for c in CLOSING]


# --- Re-Pair ---


def replaced(codes: np.ndarray, bounds: np.ndarray, rules: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences (``bounds`` in ``codes``) with each pair ``left << 32 | right`` of ``rules`` replaced, from left to right."""
    if len(codes) < 2 or not rules:
        return codes, bounds
    pairs = codes[:-1].astype(np.int64) << 32 | codes[1:]
    known = np.array(sorted(rules), np.int64)
    at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
    hit = known[at] == pairs
    ends = bounds[1:-1]
    hit[ends[(ends > 0) & (ends < len(codes))] - 1] = False  # a pair within one sequence
    # of hits that follow each other every second one counts
    place = np.arange(len(hit))
    run = np.maximum.accumulate(np.where(hit, -1, place))
    hit &= (place - run) % 2 == 1
    new = codes.copy()
    new[:-1][hit] = np.array([rules[k] for k in known.tolist()], codes.dtype)[at[hit]]
    kept = np.ones(len(codes), bool)
    kept[1:][hit] = False
    return new[kept], np.concatenate([[0], np.cumsum(kept)])[bounds]


def encoded(sequences: list[str], rounds: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of each sequence under a grammar given by its rounds' rules."""
    number = {c: i for i, c in enumerate(LETTERS)}
    codes = np.array([number[c] for s in sequences for c in s], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sequences])]).astype(np.int64)
    for rules in rounds:
        codes, bounds = replaced(codes, bounds, rules)
    return codes, bounds


def _pair_counts(rounds: list[dict[int, int]]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, bounds = encoded(batch.column("letters").to_pylist(), rounds)
            weight = np.repeat(np.asarray(batch.column("n")), np.diff(bounds))
            inside = np.ones(max(0, len(codes) - 1), bool)
            ends = bounds[1:-1]
            inside[ends[(ends > 0) & (ends < len(codes))] - 1] = False
            pairs, which = np.unique((codes[:-1] << 32 | codes[1:])[inside], return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, which, weight[:-1][inside])
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    return count


def grammar(sequences: DataFrame, rounds: int = ROUNDS, rules: int = RULES) -> list[dict[int, int]]:
    """Rules of each round by pair, learned from all ``sequences`` (``letters``, ``n``).

    A round takes the commonest pairs that occur twice or more, but none that begins as another one of the round ends.
    """
    found: list[dict[int, int]] = []
    new = len(LETTERS)
    for _ in range(rounds):
        counted = sequences.mapInArrow(_pair_counts(found), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        # pairs are at most the square of the symbols, which the parameters bound
        commonest = counted.filter("n > 1").orderBy(F.desc("n"), "pair").limit(4 * rules).collect()
        taken: dict[int, int] = {}
        lefts, rights = set(), set()
        for r in commonest:
            left, right = r.pair >> 32, r.pair & 0xFFFFFFFF
            if len(taken) < rules and right not in lefts and left not in rights and (left != right or left not in lefts | rights):
                taken[r.pair] = new
                lefts.add(left), rights.add(right)
                new += 1
        if not taken:
            break
        found.append(taken)
    return found


class Grammar:
    """Matrices of all symbols, bottom-up, and of whole sequences, with a bounded memo."""

    def __init__(self, rounds: list[dict[int, int]]):
        self.rounds = rounds
        self.matrices = [letter_matrix(c) for c in LETTERS]
        for rules in rounds:
            for pair, symbol in sorted(rules.items(), key=lambda x: x[1]):
                assert symbol == len(self.matrices)
                self.matrices.append(self.matrices[pair >> 32] @ self.matrices[pair & 0xFFFFFFFF])
        self.memo: dict[str, Matrix] = {}

    def matrix(self, letters: str) -> Matrix:
        """The product over a block's letters (at least one)."""
        if letters not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            codes, _ = encoded([letters], self.rounds)
            parts = [self.matrices[c] for c in codes]
            while len(parts) > 1:  # neighbours two by two: the depth stays small
                parts = [parts[i] @ parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
            self.memo[letters] = parts[0]
        return self.memo[letters]


def _key(rounds: list[dict[int, int]]) -> tuple:
    return tuple(tuple(sorted(r.items())) for r in rounds)


@lru_cache(maxsize=2)
def _grammar(key: tuple) -> Grammar:
    """One for all tasks of a Python worker."""
    return Grammar([dict(r) for r in key])


# --- blocks ---

BLOCK = (
    "conv_id long, place struct<range int, no long>, letters string, roles array<string>, texts array<string>, copies array<long>, "
    "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"
)
PAIRS = {"su", "ua", "au"}


class _Block:
    """Rows of one conversation in their order, of one range."""

    def __init__(self, conv, range_no: int, no: int):
        self.conv, self.place = conv, {"range": range_no, "no": no}
        self.letters, self.roles, self.texts, self.copies = [], [], [], []
        self.n = self.bytes = self.turns = self.illegal = 0
        self.faults: Counter = Counter()
        self.low = self.high = None  # turns, which ascend
        self.first = self.last = None  # initials at the ends

    def add(self, turn, role: str, text: str, n: int, fault: str) -> None:
        if not n:
            return
        initial = role[:1]
        self.letters.append(letter(role, fault) + "x" * (n - 1))
        self.roles.append(role), self.texts.append(text), self.copies.append(n)
        if turn is not None:
            self.turns += self.high != turn
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.faults[fault] += 1
        self.faults["b" if fault == "b" else "d"] += n - 1
        if self.last is not None:
            self.illegal += self.last + initial not in PAIRS
        else:
            self.first = initial
        self.illegal += n - 1  # no role may follow itself
        self.last = initial
        self.n += n
        self.bytes += len(text) + len(role)

    def row(self) -> list:
        f = self.faults
        return [
            self.conv, self.place, "".join(self.letters), self.roles, self.texts, self.copies, self.low, self.high, self.turns,
            f["b"], f["d"], f["t"], self.illegal, self.first, self.last,
        ]


def _blocks(block_rows: int, block_bytes: int, arrow: pa.Schema):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, out, size, no = None, [], 0, 0

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "fault", "range_no")]
            for conv, turn, role, text, n, fault, range_no in zip(*columns, strict=True):
                more = n
                while True:
                    if block is None or block.conv != conv or block.n >= block_rows or block.bytes >= block_bytes:
                        if block is not None:
                            out.append(block.row())
                            size += block.bytes + 200
                        block, no = _Block(conv, range_no, no), no + 1
                        if size > 4_000_000:
                            yield batch_of(out)
                            out, size = [], 0
                    step = min(more, block_rows)
                    # copies after the first are duplicates, or blank like it
                    block.add(turn, role, text, step, fault if more == n or fault == "b" else "d")
                    more -= step
                    if more <= 0:
                        break
        if block is not None:
            out.append(block.row())
        if out:
            yield batch_of(out)

    return cut


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stored blocks of conversations in order; a conversation without rows after damage has an empty one."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    found = materialize(_faults(rows))
    n, size = found.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = 1 + max(n // 100_000, size // 32_000_000)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = found.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("range_no", F.spark_partition_id())
    schema = spark.createDataFrame([], BLOCK).schema
    return materialize(dealt.mapInArrow(_blocks(block_rows, block_bytes, to_arrow_schema(schema)), schema))


# --- choice and repair ---


def _to_go(key: tuple):
    """Per block, read backwards: the end state to choose for each start state."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, here, left = _grammar(key), object(), CLOSING_COST
        for batch in batches:
            chosen = []
            for conv, letters in zip(batch.column("conv_id").to_pylist(), batch.column("letters").to_pylist(), strict=True):
                if conv != here:
                    here, left = conv, CLOSING_COST
                if letters:
                    m = known.matrix(letters)
                    best = [min((min(m.cost[p][q] + left[q], NEVER), m.rank[p][q], q) for q in range(4)) for p in range(4)]
                    left = [b[0] for b in best]
                    chosen.append([b[2] for b in best])
                else:
                    chosen.append([0, 1, 2, 3])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("place"), pa.array(chosen, pa.list_(pa.int32()))], ["conv_id", "place", "chosen"]
            )

    return read


FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Repair:
    """One conversation, a block at a time."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.audit = conv, START, 0, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None
        self.said, self.any = hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.said.update(f"\n{role}:{text}".encode() if self.any else f"{role}:{text}".encode())
        self.any = True

    def edit(self, audit: str, rows: Iterator[tuple[str, str]]) -> None:
        """Spell out what an audit leaves of the rows."""
        for edit in audit:
            role, text = next(rows) if edit != INSERT else ("", "")
            if edit == DELETE:
                continue
            if edit != KEEP:
                role = "assistant" if self.state == USER else "user"
            self.state = STEP[self.state, role[:1]]
            self.put(role, text)
        self.audit.append(audit)

    def add(self, b: dict, chosen: list[int], known: Grammar) -> None:
        if not b["letters"]:
            return
        m, end = known.matrix(b["letters"]), chosen[self.state]
        self.cost += m.cost[self.state][end]
        rows = ((r, t) for r, t, n in zip(b["roles"], b["texts"], b["copies"], strict=True) for _ in range(n))
        self.edit(m.audit(self.state, end), rows)
        self.blank, self.duplicate, self.truncated = self.blank + b["blank"], self.duplicate + b["duplicate"], self.truncated + b["truncated"]
        self.illegal += b["illegal"] + (self.last is not None and self.last + b["first"] not in PAIRS)
        self.last = b["last"]
        if b["low"] is not None:
            self.turns += b["turns"] - (b["low"] == self.high)
            self.low = b["low"] if self.low is None else self.low
            self.high = b["high"]

    def row(self) -> list:
        closing = CLOSING[self.state]
        self.cost += len(closing) * COST[INSERT]
        self.edit(closing, iter(()))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.said.hexdigest()]


def _repairs(key: tuple, arrow: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, here, chosen = _grammar(key), None, None
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                if here is None or here.conv != b["conv_id"]:
                    if here is not None:
                        out.append(here.row())
                    here = _Repair(b["conv_id"])
                if b["chosen"] is not None:
                    chosen = b["chosen"]
                else:
                    here.add(b, chosen, known)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)
        if here is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(here.row(), arrow, strict=True)], schema=arrow)

    return read


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per ``conv_id`` of ``rows`` (as ``damaged`` gives them): faults, the least cost, its audit, and the repaired digest."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    bounded_batches(spark)
    cut = blocks(rows, block_rows, block_bytes)
    sequences = materialize(cut.filter("letters <> ''").groupBy("letters").agg(F.count("*").alias("n")))
    key = _key(grammar(sequences))
    ends = cut.select("conv_id", "place", "letters").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("place"))
    chosen = ends.mapInArrow(_to_go(key), "conv_id long, place struct<range int, no long>, chosen array<int>")
    # a block's choice comes before the block itself
    both = cut.withColumn("chosen", F.lit(None).cast("array<int>")).unionByName(chosen, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "place", F.col("chosen").isNull())
    schema = spark.createDataFrame([], FOUND).schema
    return ordered.mapInArrow(_repairs(key, to_arrow_schema(schema)), schema)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation after damage: its faults and the cheapest repair."""
    return repair(damaged(table(spark, sf_dir, "conversations")))


def oracle() -> str:
    """The same by one step a row over the four states, for engines whose recursion carries structures."""
    kind = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"

    def then(state: str, edit: str, line: str, when: str = "true", more: str = "0") -> str:
        said = f"{state}.r || chr(10) || {line}" if line else f"{state}.r"
        return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {COST[edit]} + {more}, 'a': {state}.a || '{edit}', 'r': {said}}}::{kind} END"

    least = lambda *of: f"list_min([{', '.join(of)}])"
    own, cut = "role || ':' || text", f"cut * {CUT}"
    kept = lambda s, r: then(s, KEEP, own, f"NOT gone AND i = '{r}'", cut)
    named = lambda s, r: then(s, REROLE, f"'{r}:' || text", "NOT gone", cut)
    return f"""WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
 xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
  lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END),
  4294967295) % 20 AS fate FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
 unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM src WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM hurt),
told AS (SELECT *, left(role, 1) AS i, CASE WHEN ending = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN ending NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
 lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM placed),
line AS (SELECT *, fault IN ('b', 'd') AS gone, (fault = 't')::INT AS cut FROM told),
conv AS (SELECT s.conv_id, coalesce(max(l.turn) - min(l.turn) + 1 - count(DISTINCT l.turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
 count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(l.pos) AS n
 FROM (SELECT DISTINCT conv_id FROM conversations) s LEFT JOIN line l ON s.conv_id IS NOT DISTINCT FROM l.conv_id GROUP BY s.conv_id),
step AS (SELECT conv_id, n, 0::BIGINT AS done, {{'c': 0, 'a': '', 'r': ''}}::{kind} AS s0, NULL::{kind} AS s1, NULL::{kind} AS s2, NULL::{kind} AS s3 FROM conv
 UNION ALL SELECT conv_id, n, done + 1, {then('i0', DELETE, '')}, {least(then('i1', DELETE, ''), kept('i0', 's'))},
  {least(then('i2', DELETE, ''), *[f(s, r) for s in ('i0', 'i1', 'i3') for f, r in ((kept, 'u'), (named, 'user'))])},
  {least(then('i3', DELETE, ''), kept('i2', 'a'), named('i2', 'assistant'))}
 FROM (SELECT * EXCLUDE (e3), {least('e3', then('i2', INSERT, "'assistant:'"))} AS i3 FROM (SELECT t.conv_id, n, done, l.* EXCLUDE (conv_id), s0 AS i0, s1 AS i1,
  {least('s2', *[then(s, INSERT, "'user:'") for s in ('s0', 's1', 's3')])} AS i2, s3 AS e3 FROM step t JOIN line l ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND l.pos = t.done + 1))),
closed AS (SELECT conv_id, {least('s0', 's3', then('s2', INSERT, "'assistant:'"), then('u1', INSERT, "'assistant:'"))} AS f FROM (SELECT *, {then('s1', INSERT, "'user:'")} AS u1 FROM step WHERE done = n))
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, f.c AS cost, f.a AS audit, sha256(substr(f.r, 2)) AS repaired_sha256
FROM conv c JOIN closed f ON c.conv_id IS NOT DISTINCT FROM f.conv_id"""
