"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Fit, on at most ``max_rows`` labelled rows (those of the smallest hashes of
their ids): document counts of every hashed n-gram in both classes give the
log-count ratios; the ``n_features`` n-grams that tell the classes apart most
(by the likelihood ratio of their counts) are kept; a logistic regression is
fitted on presence times ratio. The ratio is then folded into the weight, so a
score is the sum of the weights of the n-grams present in the whole text.

Only the bounded sample of ids is broadcast and only its features over the kept
n-grams reach the driver. Scoring is one pass of an Arrow UDF without a shuffle.

Defined results: a null or empty text scores as the intercept does; without
labels of both classes every score is 0; labels that are null are not learnt
from; labels of one id that disagree both count; an empty table scores nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from orrery.llm import ngrams, shared

SIZES = (4, 5, 6)
BITS = 20
MAX_ROWS = 20_000
N_FEATURES = 4096


@dataclass(frozen=True)
class Model:
    """slots: for each hash its place in ``weights`` (the last place, of weight 0, if it has none)."""

    slots: np.ndarray
    weights: np.ndarray
    intercept: float
    trained: bool

    def present(self, text: str) -> np.ndarray:
        """Which of the kept n-grams occur in the text."""
        seen = np.zeros(len(self.weights), dtype=bool)
        for h in ngrams.codes(ngrams.folded(text), SIZES, BITS):
            seen[self.slots[h]] = True
        seen[-1] = False
        return seen

    def score(self, text: str) -> float:
        if not self.trained:
            return 0.0
        z = self.intercept + float(self.weights[self.present(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, toxic, clean): in how many of the task's texts of each class the n-gram occurs."""
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        for text, label in zip(ngrams.texts(batch.column("text")), batch.column("label").to_pylist(), strict=True):
            seen = np.zeros(1 << BITS, dtype=bool)
            for h in ngrams.codes(ngrams.folded(text), SIZES, BITS):
                seen[h] = True
            counts[label] += seen
    found = np.flatnonzero(counts.sum(axis=0))
    for part in np.array_split(found, max(1, len(found) // 100_000)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(counts[1, part]), pa.array(counts[0, part])], names=["hash", "toxic", "clean"]
        )


def _logistic(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights on presence * ratio, and the intercept, by accelerated gradient steps with a small ridge.

    Each class weighs one half, so that 0.5 is the border between them however rare one is.
    """
    share = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    at = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    size = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), size)
    x = ratios[at]
    norm = np.sqrt(max(np.bincount(row, x * x, len(rows)).max(initial=0), 1.0))
    x = x / norm
    w, b = np.zeros(len(ratios)), 0.0
    pw, pb = w, b
    ridge, rate = 1e-6, 4.0 / 2
    for k in range(rounds):
        vw, vb = w + (k / (k + 3)) * (w - pw), b + (k / (k + 3)) * (b - pb)
        z = np.bincount(row, x * vw[at], len(rows)) + vb
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * share
        pw, pb = w, b
        w = vw - rate * (np.bincount(at, x * g[row], len(ratios)) + ridge * vw)
        b = vb - rate * g.sum()
    return w * ratios / norm, b


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, n_features: int = N_FEATURES) -> Model:
    """``docs``: doc_id, text. ``labels``: doc_id, label (0 or 1); only these rows are learnt from."""
    spark = docs.sparkSession
    chosen = (
        labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .select("doc_id", F.col("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(max_rows)  # the documented bound; it also bounds what is broadcast
    )
    t = shared.Tables(spark)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    once = joined.groupBy("doc_id", "label").agg(F.min(F.struct("text")).alias("least"))  # so that the bound holds where ids repeat
    sample = t.write(once.select("least.text", "label").repartition(8), "sample")
    try:
        counted = (
            sample.mapInArrow(_counted, "hash long, toxic long, clean long")
            .groupBy("hash")
            .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        )
        n_toxic, n_clean = sample.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
        slots = np.full(1 << BITS, n_features, dtype=np.int32)
        if not n_toxic or not n_clean:
            return Model(slots, np.zeros(n_features + 1), 0.0, False)
        p, q = F.col("toxic") + F.lit(1.0), F.col("clean") + F.lit(1.0)
        share = (p + q) / (n_toxic + n_clean + 2.0)
        gain = p * F.log(p / (share * (n_toxic + 1.0))) + q * F.log(q / (share * (n_clean + 1.0)))
        best = counted.orderBy(gain.desc(), "hash").limit(n_features).collect()
        hashes = np.array([r["hash"] for r in best], dtype=np.int64)
        toxic = np.array([r["toxic"] for r in best], dtype=float)
        clean = np.array([r["clean"] for r in best], dtype=float)
        ratios = np.zeros(n_features + 1)
        ratios[: len(best)] = np.log((toxic + 1) / (n_toxic + 1)) - np.log((clean + 1) / (n_clean + 1))
        slots[hashes] = np.arange(len(best))
        blank = Model(slots, np.zeros(n_features + 1), 0.0, True)
        sent = spark.sparkContext.broadcast(blank)

        def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [np.flatnonzero(sent.value.present(x)).astype(np.int16) for x in ngrams.texts(batch.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), pa.array([r.tobytes() for r in rows], type=pa.binary())], names=["label", "at"]
                )

        got = sample.mapInArrow(featured, "label int, at binary").collect()
    finally:
        t.keep_only()
    rows = [np.frombuffer(r["at"], dtype=np.int16).astype(np.int64) for r in got]
    weights, intercept = _logistic(rows, np.array([r["label"] for r in got], dtype=float), ratios)
    return Model(slots, weights, float(intercept), True)


def scorer(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of each whole text, 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        return pa.array([sent.value.score(t) for t in ngrams.texts(column)], type=pa.float64())

    return score(shared.col(text_col))
