"""Language identification as inference of multilingual mixtures (operator 7).

A document's letter trigrams are drawn from a mixture of the languages' trigram distributions; expectation-
maximisation estimates the proportions, and the set of languages is the one with the best penalised likelihood
(each further language costs half the logarithm of the number of trigrams).

The language models are counts from a bounded sample of labelled documents (``docs_per_lang`` a language, by hash);
every document is predicted from its whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from meshline.llm.shared import remainder, slices, table
from meshline.llm.tokens import text_or_empty

BUCKETS, ROUNDS = 4096, 8
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000))
    return _LETTERS[0]


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Hashed trigram counts (texts x BUCKETS) around each letter; anything but a letter counts as one blank."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer(" ".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    plain = np.where(letter, codes, 32).astype(np.uint32)
    key = plain[:-2] * np.uint32(0x9E3779B1) ^ plain[1:-1] * np.uint32(0x85EBCA77) ^ plain[2:] * np.uint32(0xC2B2AE3D)
    key = (key * np.uint32(0x27D4EB2F)) >> np.uint32(20)
    lens = np.array([len(t) + 1 for t in low])
    doc = np.repeat(np.arange(len(low)), lens)[: len(key)]
    use = letter[1:-1]
    flat = np.bincount(doc[use] * BUCKETS + key[use], minlength=len(low) * BUCKETS)
    return flat.reshape(len(low), BUCKETS).astype(np.float32)


def groups_of(texts: list[str], most: int = 128):
    for at in range(0, len(texts), most):
        yield texts[at : at + most]


def fit(df: DataFrame, docs_per_lang: int = 2000) -> tuple[list[str], np.ndarray]:
    """Languages (by name) and log probabilities of trigram buckets, from ``df(doc_id, text, lang)``.

    About ``docs_per_lang`` documents a language are taken by a hash of ``doc_id``; every language of the column has a
    model. Rows without text or language are left out. Counts are summed in Spark, in whole millionths so that their
    order doesn't matter; the driver gets one row of ``BUCKETS`` sums a language.
    """
    known = df.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = known.groupBy("lang").agg((F.lit(float(docs_per_lang)) / F.count("*") * 1_000_000).alias("share"))
    # one row a language, as in the model that every task gets
    drawn = known.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share"))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
                for at in range(0, len(texts), 128):
                    c = trigram_counts(texts[at : at + 128])
                    # every document counts alike, so that a few long ones don't make a language
                    c = np.rint(c / np.maximum(c.sum(axis=1, keepdims=True), 1) * 1e6).astype(np.int64)
                    for lang, row in zip(langs[at : at + 128], c, strict=True):
                        sums[lang] = sums.get(lang, 0) + row
        for lang, row in sums.items():
            lists = pa.ListArray.from_arrays([0, len(row)], pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array([lang]), lists], names=["lang", "sums"])

    parts = drawn.select("lang", "text").mapInArrow(run, "lang string, sums array<long>")
    cells = parts.select("lang", F.posexplode("sums").alias("bucket", "n")).filter("n > 0").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    total: dict[str, np.ndarray] = {}
    for r in cells.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).collect():
        total[r["lang"]] = np.zeros(BUCKETS)
        for bucket, n in r["cells"]:
            total[r["lang"]][bucket] = n / 1e6
    langs = sorted(total)
    model = np.stack([(total[x] + 0.02) / (total[x] + 0.02).sum() for x in langs]) if langs else np.zeros((0, BUCKETS))
    return langs, model.astype(np.float32)


def mixtures(counts: np.ndarray, model: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Proportions (documents x languages) of the best language set: 0 for languages outside it.

    Languages are added in order of their share in the full mixture, for as long as the penalised likelihood rises.
    """
    n = counts.sum(axis=1, keepdims=True)
    safe = np.maximum(n, 1)

    def em(theta: np.ndarray, times: int, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        for _ in range(times):
            theta = theta * ((counts[of] / np.maximum(theta @ model, 1e-12)) @ model.T) / safe[of]
            theta /= np.maximum(theta.sum(axis=1, keepdims=True), 1e-12)
        return theta

    langs = model.shape[0]
    full = em(np.full((len(counts), langs), 1 / langs, np.float32), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    best, best_value = np.zeros_like(full), np.full(len(counts), -np.inf)
    grows = np.arange(len(counts))  # documents whose last language paid for itself
    for size in range(1, langs + 1):
        mine, top = counts[grows], order[grows, :size]
        theta = np.zeros((len(grows), langs), np.float32)
        np.put_along_axis(theta, top, np.maximum(np.take_along_axis(full[grows], top, 1), 1e-6), 1)
        theta /= theta.sum(axis=1, keepdims=True)
        theta = em(theta, 3 if size > 1 else 0, grows)
        fit_ = np.einsum("ij,ij->i", mine, np.log(np.maximum(theta @ model, 1e-12)))
        value = fit_ - 0.5 * (size - 1) * np.log(safe[grows, 0])
        better = value > best_value[grows]
        grows, theta, value = grows[better], theta[better], value[better]
        best[grows], best_value[grows] = theta, value
        if not len(grows):
            break
    return best


OUTPUTS = ("lang_pred", "score", "lang_set")


def predict(df: DataFrame, langs: list[str], model: np.ndarray, outputs: tuple[str, str, str] = OUTPUTS) -> DataFrame:
    """All columns of ``df`` and ``lang_pred``, ``score``, ``lang_set`` (or the given names) from its whole ``text``.

    ``lang_pred`` is the language with the largest share, ``score`` that share, ``lang_set`` the selected languages.
    A null text, one without a letter, or a model without languages gives ``und``, score 0 and no language. Each row is
    predicted for itself, repeated ones alike; very long texts are counted in whole; an empty table gives an empty
    result. Columns of ``df`` that have the name of an output are replaced by it: give other names to keep them.
    """
    sent = df.sparkSession.sparkContext.broadcast((langs, model))
    lower = [c.lower() for c in outputs]
    kept = df.drop(*[c for c in df.columns if c.lower() in lower])

    def run(batches):
        names, probs = sent.value
        for batch in batches:
            for part in slices(batch):
                pred, score, sets = [], [], []
                for texts in groups_of(text_or_empty(part).to_pylist()):
                    counts = trigram_counts(texts)
                    if not names:
                        shares = np.zeros((len(texts), 1))
                    else:
                        shares = mixtures(counts, probs)
                    some = counts.sum(axis=1) > 0
                    for ok, row in zip(some.tolist(), shares, strict=True):
                        top = int(row.argmax())
                        ok = ok and bool(names)
                        pred.append(names[top] if ok else "und")
                        score.append(min(1.0, float(row[top])) if ok else 0.0)
                        sets.append([names[i] for i in np.flatnonzero(row > 0)] if ok else [])
                columns = [*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *outputs])

    schema = StructType([*kept.schema, *StructType.fromDDL("a string, b double, c array<string>")])
    for field, name in zip(schema.fields[-3:], outputs, strict=True):
        field.name = name
    schema.names = [f.name for f in schema.fields]
    return kept.mapInArrow(run, schema)


def identify(df: DataFrame, train: DataFrame | None = None, docs_per_lang: int = 2000, outputs: tuple[str, str, str] = OUTPUTS) -> DataFrame:
    """Fit on ``train(doc_id, text, lang)`` (default: the rows of ``df`` that aren't held out) and predict ``df``."""
    train = df.filter(remainder("doc_id", 5) != 0) if train is None else train
    return predict(df, *fit(train.select("doc_id", "text", "lang"), docs_per_lang), outputs)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, model = fit(docs.filter(remainder("doc_id", 5) != 0))
    return predict(docs.select("doc_id", "text"), langs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "lang_set"
    )
