"""Quality scores by nearest-neighbour voting over latent-semantic vectors (operator 6).

Texts become weighted counts of hashed byte trigrams and a few layout terms; a truncated singular value
decomposition of a bounded, class-balanced sample of labelled documents (``per_class`` each, by hash) gives the
latent space. The sample's vectors are broadcast (bounded by that parameter); every document's cosine products
with all of them are computed exactly, block by block, and the nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from meshline.llm.shared import materialize, remainder, slices, table
from meshline.llm.tokens import text_or_empty

GRAMS, EXTRA, RANK, NEIGHBOURS, PER_CLASS = 4096, 4, 64, 15, 800
THRESHOLD = 0.3


def features(texts: list[str]) -> np.ndarray:
    """Root shares (texts x terms) of hashed byte trigrams, and of words that repeat, shout or carry no letter."""
    data = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\0\0".join([*data, b"\0\0"]), np.uint8).astype(np.uint32)
    key = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    lens = np.array([len(d) + 2 for d in data])
    doc = np.repeat(np.arange(len(data)), lens)[: len(key)]
    use = (raw[:-2] != 0) & (raw[1:-1] != 0) & (raw[2:] != 0)
    key = ((key * np.uint32(0x9E3779B1)) >> np.uint32(20))[use]
    out = np.bincount(doc[use] * GRAMS + key, minlength=len(data) * GRAMS).reshape(len(data), GRAMS)
    out = out / np.maximum(out.sum(axis=1, keepdims=True), 1)
    extra = np.zeros((len(data), EXTRA))
    for i, t in enumerate(texts):
        w = t.split()
        n = max(1, len(w))
        extra[i] = (
            sum(map(eq, w, w[1:])) / n,
            sum(map(str.isupper, w)) / n,
            1 - sum(map(str.isalpha, w)) / n,
            1 / (1 + len(w) / 10),
        )
    return np.sqrt(np.concatenate([out, extra], axis=1)).astype(np.float32)


def balanced_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``doc_id``, ``text``, ``y`` of about ``per_class`` labelled documents of each class, by a hash of the id.

    A document with contradictory labels, a null label or a null text is left out; repeated labels count once.
    """
    y = labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_y"))
    y = y.filter(F.col("y") == F.col("_y")).select("doc_id", F.col("y").cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    if not counts:
        return docs.select("doc_id", "text", F.lit(0).alias("y")).limit(0)
    share = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, per_class / n))])
    drawn = y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("y")) * 1_000_000)
    # about per_class ids of each of two classes, whatever the input: small enough to send to every task
    return docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(materialize(drawn)), "doc_id")


class Neighbours:
    """The latent space and the labelled vectors in it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rank: int = RANK, seed: int = 0):
        present = (x > 0).sum(axis=0)
        self.idf = (np.log((1 + len(x)) / (1 + present)) + 1).astype(np.float32)
        self.idf[-EXTRA:] = 4.0  # layout terms weigh as a rare term does
        w = x * self.idf
        w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
        rank = max(1, min(rank, *w.shape))
        # randomised range finder, then the exact decomposition of the small rest
        q = np.random.default_rng(seed).standard_normal((w.shape[1], min(rank + 16, *w.shape))).astype(np.float32)
        for _ in range(3):
            q, _ = np.linalg.qr(w.T @ (w @ q))
        _, _, v = np.linalg.svd(w @ q, full_matrices=False)
        self.axes = np.ascontiguousarray((q @ v[:rank].T).astype(np.float32))
        self.vectors, self.y = self._unit(w @ self.axes), y.astype(np.float32)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def score(self, texts: list[str], k: int = NEIGHBOURS) -> np.ndarray:
        near = self._unit((features(texts) * self.idf) @ self.axes) @ self.vectors.T
        k = min(k, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 1e-6) ** 8
        return np.clip((weight * self.y[top]).sum(axis=1) / weight.sum(axis=1), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Neighbours | float:
    """A model, or the constant score where the labels hold fewer than two classes (0.5 without any)."""
    rows = balanced_sample(docs, labels, label, per_class).orderBy("doc_id").collect()  # bounded by per_class
    y = np.array([r["y"] for r in rows])
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.5
    x = np.concatenate([features([r["text"] for r in rows[i : i + 128]]) for i in range(0, len(rows), 128)])
    return Neighbours(x, y)


def score(df: DataFrame, model: Neighbours | float) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of each row's whole ``text``; a null text counts as empty."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            for part in slices(batch):
                texts = text_or_empty(part).to_pylist()
                if isinstance(m, float):
                    s = np.full(len(texts), m)
                else:
                    s = np.concatenate([m.score(texts[i : i + 128]) for i in range(0, len(texts), 128)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(s.astype(np.float64))], names=["doc_id", "score"]
                )

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs.select("doc_id", "text"), labels.filter(remainder("doc_id", 5) != 0))
    return score(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
