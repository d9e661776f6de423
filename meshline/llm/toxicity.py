"""Toxic spans by a linear-chain conditional random field (operator 9).

Labels mark documents; tokens get theirs from a bounded sample of labelled documents (``per_class`` of each, by
hash): words, and words with starts, nearly all of whose contexts are toxic documents, far beyond chance, are toxic tokens there. On the sample's sentences a two-tag chain is trained with features of the
word, its affixes and its neighbours. Every document is tagged over its whole text; forward-backward marginals
give the offending spans and, added up as evidence and calibrated on the sample, the document's score.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from meshline.llm.quality import balanced_sample
from meshline.llm.shared import remainder, slices, table, words_of
from meshline.llm.tokens import text_or_empty

PER_CLASS, THRESHOLD, SURE, SEEN = 800, 0.7, 0.3, 3
STARTS = (4, 5, 6, 7)


def plain(word: str) -> str:
    return word.lower().strip(string.punctuation)


def ends_sentence(word: str) -> bool:
    return word[-1:] in ".!?"


def units(word: str) -> list[str]:
    """A plain word and its starts."""
    return [word, *(f"{word[:k]}-" for k in STARTS if len(word) > k)]


#: Features of a token: its word, its starts, its end; and of its left and its right neighbour.
KINDS = ("word", *(f"start{k}" for k in STARTS), "end", "left", "right")
OWN = len(KINDS) - 2


def values(w: str) -> list[str]:
    """A plain word's value of each kind; a start that is the whole word is none."""
    return [w, *(w[:k] if len(w) > k else "" for k in STARTS), w[-4:], w, w]


class Chain:
    """``weights`` (of the toxic tag against the other, per kind of feature and value), ``bias``, ``move`` (2 x 2 log weights)."""

    def __init__(self):
        self.weights: list[dict[str, float]] = [{} for _ in KINDS]
        self.bias, self.move = 0.0, np.zeros((2, 2))
        self.slope, self.base = 4.0, -4.0
        self.scores: dict[str, tuple[float, float, float]] = {}

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k in ("weights", "bias", "move", "slope", "base")} | {"scores": {}}

    @staticmethod
    def evidence(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Per text the logarithm of 1 + its tokens' -log(1 - p), over tokens with a marginal of at least ``SURE``."""
        doubt = np.where(p >= SURE, np.minimum(-np.log1p(-np.minimum(p, 1 - 1e-9)), 5.0), 0.0)
        total = np.concatenate([[0], np.cumsum(doubt)])
        return np.log1p(np.maximum(total[bounds[1:]] - total[bounds[:-1]], 0))

    def of_text(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.base, -30, 30)))

    def calibrate(self, evidence: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression of text labels on their evidence (Newton steps with a small ridge)."""
        x, theta = np.stack([evidence, np.ones(len(y))], axis=1), np.array([self.slope, self.base])
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            grad = x.T @ (weight * (y - q)) - 0.1 * theta
            theta = theta + np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(2), grad).clip(-2, 2)
        if theta[0] > 0:
            self.slope, self.base = float(theta[0]), float(theta[1])

    def of_word(self, word: str) -> tuple[float, float, float]:
        found = self.scores.get(word)
        if found is None:
            if len(self.scores) > 200_000:
                self.scores.clear()
            each = [d.get(v, 0.0) for d, v in zip(self.weights, values(plain(word)), strict=True)]
            found = self.scores[word] = (sum(each[:OWN]), each[OWN], each[OWN + 1])
        return found

    def potentials(self, words: list[str], codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log weight of the toxic tag against the other for each token; neighbours count within a sentence."""
        own, left, right = np.array([self.of_word(w) for w in words] or [(0, 0, 0)], dtype=np.float64).T
        e = own[codes] + self.bias
        inner = ~first[1:]
        e[1:] += np.where(inner, left[codes[:-1]], 0)
        e[:-1] += np.where(inner, right[codes[1:]], 0)
        return e

    def marginals(self, e: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of each token, and the log normaliser of each sentence; all sentences advance together."""
        n = len(e)
        lens = np.diff(np.concatenate([starts, [n]]))
        order = np.argsort(-lens, kind="stable")
        s, longest = starts[order], int(lens.max(initial=0))
        live = np.searchsorted(-lens[order], -np.arange(longest), side="left")
        m = self.move
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        z = np.zeros(len(starts))
        if not n:
            return np.zeros(0), z
        ahead[s, 1] = e[s]
        for t in range(1, longest):
            at = s[: live[t]] + t
            p = ahead[at - 1]
            ahead[at, 0] = np.logaddexp(p[:, 0] + m[0, 0], p[:, 1] + m[1, 0])
            ahead[at, 1] = np.logaddexp(p[:, 0] + m[0, 1], p[:, 1] + m[1, 1]) + e[at]
        for t in range(longest - 2, -1, -1):
            at = s[: live[t + 1]] + t
            q, en = behind[at + 1], e[at + 1]
            behind[at, 0] = np.logaddexp(q[:, 0] + m[0, 0], q[:, 1] + en + m[0, 1])
            behind[at, 1] = np.logaddexp(q[:, 0] + m[1, 0], q[:, 1] + en + m[1, 1])
        last = starts + lens - 1
        z = np.logaddexp(ahead[last, 0], ahead[last, 1])
        both = ahead + behind
        p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50)))
        self._ahead, self._behind = ahead, behind
        return p, z


def tokens_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``words_of`` without the empty words that white space at a text's ends brings."""
    words, codes, bounds = words_of(texts)
    if "" in words:
        some = codes != words.index("")
        bounds = np.concatenate([[0], np.cumsum(some)])[bounds]
        codes = codes[some]
    return words, codes, bounds


def sentence_starts(words: list[str], codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sentences start, and the same as flags: at a text's start and after a word that ends one."""
    stop = np.fromiter(map(ends_sentence, words), np.bool_, len(words))
    first = np.zeros(len(codes), bool)
    first[1:] = stop[codes[:-1]] if len(codes) else False
    first[bounds[:-1][bounds[:-1] < len(codes)]] = True
    return np.flatnonzero(first), first


def telling_units(texts: list[str], y: list[int], share: float = 0.9, chance: float = 0.01) -> set[str]:
    """Words, and starts of words, that mark toxic texts: at least ``share`` of their contexts are toxic, beyond chance.

    A context is a word with its left neighbour, so that copies of a text count once. Against a word's number of
    contexts and the toxic share of all contexts, the bound on the binomial tail has to lie under ``chance`` spread
    over all words.
    """
    contexts: list[set[tuple[str, str]]] = [set(), set()]
    for t, k in zip(texts, y, strict=True):
        w = [plain(x) for x in t.split()]
        contexts[k].update(zip(["", *w], w, strict=False))
    count: list[dict[str, int]] = [{}, {}]
    for k in (0, 1):
        for _, w in contexts[k]:
            for u in units(w):
                count[k][u] = count[k].get(u, 0) + 1
    p = len(contexts[1]) / max(1, len(contexts[0]) + len(contexts[1]))
    need = np.log((len(count[0].keys() | count[1].keys()) + 1) / chance)

    def beyond(w: str, c: int) -> bool:
        n = c + count[0].get(w, 0)
        q = c / n
        other = (1 - q) * np.log((1 - q) / (1 - p)) if q < 1 else 0.0
        return q >= share and q > p and n * (q * np.log(q / p) + other) > need

    return {w for w, c in count[1].items() if w and 0 < p < 1 and beyond(w, c)}


def train(texts: list[str], y: list[int], rounds: int = 50, rate: float = 1.0, others: float = 1.0) -> Chain | None:
    """A chain from document labels; None if they mark no words (the score is then 0).

    A sentence of the texts that aren't toxic counts ``others`` times: as often as the sample has too few of them.
    """
    toxic = telling_units(texts, y)
    if not toxic:
        return None
    words, codes, bounds = tokens_of(pa.array(texts, pa.string()))
    marks = np.fromiter((any(u in toxic for u in units(plain(w))) for w in words), np.bool_, len(words))
    all_codes = codes
    label = marks[codes] & np.repeat(np.array(y, bool), np.diff(bounds))
    starts, first = sentence_starts(words, codes, bounds)
    number = np.cumsum(first) - 1
    hit = np.zeros(len(starts), bool)
    hit[number[marks[codes]]] = True
    # all sentences with a marked token, toxic or not, and up to 24 others for each
    rest = np.flatnonzero(~hit)
    keep = hit.copy()
    keep[rest[:: max(1, len(rest) // (24 * max(1, int(hit.sum())) + 1))]] = True
    weight = np.where(np.repeat(np.array(y, bool), np.diff(bounds)), 1.0, others)
    use = keep[number]
    codes, label, first, weight = codes[use], label[use], first[use], weight[use]
    starts = np.flatnonzero(first)
    # features that occur SEEN times have a weight of their own, at 0 is one that stays 0
    times = np.bincount(codes, minlength=len(words)).tolist()
    counted: list[dict[str, int]] = [{} for _ in KINDS]
    for w, n in zip(words, times, strict=True):
        if n:
            for d, v in zip(counted, values(plain(w)), strict=True):
                d[v] = d.get(v, 0) + n
    known, size = [], 1
    for d in counted:
        known.append({v: size + i for i, v in enumerate(v for v, n in d.items() if v and n >= SEEN)})
        size += len(known[-1])
    slots = np.array([[d.get(v, 0) for d, v in zip(known, values(plain(w)), strict=True)] for w in words])
    chain, emit = Chain(), np.zeros(size)
    grad2, bias2, move2 = np.full(size, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    pair = np.flatnonzero(~first[1:])
    for _ in range(rounds):
        e = emit[slots[codes, :OWN]].sum(axis=1) + chain.bias
        e[pair + 1] += emit[slots[codes[pair], OWN]]
        e[pair] += emit[slots[codes[pair + 1], OWN + 1]]
        p, z = chain.marginals(e, starts)
        d = (label - p) * weight
        g = np.zeros(size)
        for k in range(OWN):
            g += np.bincount(slots[codes, k], d, minlength=size)
        g += np.bincount(slots[codes[pair], OWN], d[pair + 1], minlength=size)
        g += np.bincount(slots[codes[pair + 1], OWN + 1], d[pair], minlength=size)
        g -= 0.01 * emit
        zs = z[np.cumsum(first) - 1][pair]
        gm = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                lp = chain._ahead[pair, a] + chain.move[a, b] + (e[pair + 1] if b else 0) + chain._behind[pair + 1, b] - zs
                gm[a, b] = (weight[pair] * ((label[pair] == a) & (label[pair + 1] == b)) - weight[pair] * np.exp(lp)).sum()
        gm -= 0.01 * chain.move
        g[0] = 0
        grad2 += g * g
        bias2 += d.sum() ** 2
        move2 += gm * gm
        emit += rate * g / np.sqrt(grad2)
        chain.bias += rate * d.sum() / np.sqrt(bias2)
        chain.move += rate * gm / np.sqrt(move2)
    chain.weights = [{v: float(emit[i]) for v, i in d.items()} for d in known]
    _, first = sentence_starts(words, all_codes, bounds)
    p, _ = chain.marginals(chain.potentials(words, all_codes, first), np.flatnonzero(first))
    del chain._ahead, chain._behind
    chain.calibrate(chain.evidence(p, bounds), np.array(y, float), np.where(np.array(y, bool), 1.0, others))
    return chain


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Chain | None:
    rows = balanced_sample(docs, labels, label, per_class).orderBy("doc_id").collect()  # bounded by per_class
    y = [r["y"] for r in rows]
    n = {r[label]: r["count"] for r in labels.groupBy(label).count().collect() if r[label] in (0, 1)}
    if not (y.count(0) and y.count(1)):
        return None
    return train([r["text"] for r in rows], y, others=n[0] / n[1] * y.count(1) / y.count(0))


def tag(df: DataFrame, chain: Chain | None, sure: float = 0.5) -> DataFrame:
    """``doc_id``, ``score`` and ``spans`` (code point ``start``, ``end``, mean marginal ``p``) of each whole ``text``.

    A span is a run of tokens with marginals of at least ``sure``. ``score`` is the calibrated chance given the evidence of
    all tokens with a marginal of at least ``SURE``. Null and empty texts, or no chain: score 0, no spans.
    """
    sent = df.sparkSession.sparkContext.broadcast(chain)

    def spans_of(text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
        out: list[list] = []
        for i, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
            if p[i] >= sure:
                if out and out[-1][3] == i - 1:
                    out[-1][1], out[-1][3] = m.end(), i
                    out[-1][2].append(float(p[i]))
                else:
                    out.append([m.start(), m.end(), [float(p[i])], i])
        return [(a, b, float(np.mean(q))) for a, b, q, _ in out]

    def run(batches):
        c = sent.value
        for batch in batches:
            for part in slices(batch):
                texts = text_or_empty(part)
                n = len(texts)
                scores, spans = np.zeros(n), [[] for _ in range(n)]
                words, codes, bounds = tokens_of(texts)
                if c is not None and len(codes):
                    starts, first = sentence_starts(words, codes, bounds)
                    p, _ = c.marginals(c.potentials(words, codes, first), starts)
                    scores = c.of_text(c.evidence(p, bounds))
                    hits = np.concatenate([[0], np.cumsum(p >= sure)])
                    for i in np.flatnonzero(hits[bounds[1:]] > hits[bounds[:-1]]):
                        found = spans_of(texts[int(i)].as_py(), p[bounds[i] : bounds[i + 1]])
                        spans[i] = [{"start": a, "end": b, "p": q} for a, b, q in found]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                    names=["doc_id", "score", "spans"],
                )

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>"
    )


def op9_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = fit(docs.select("doc_id", "text"), labels.filter(remainder("doc_id", 3) != 1))
    return tag(docs, chain).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "spans",
    )
