"""Language identification by hierarchical discrimination.

A text's features are its hashed byte n-grams, as shares of their number. The
family is predicted first, by one-versus-one linear support vector machines
between families; then one-versus-one machines between the languages of that
family choose among the closely related. All machines are linear in the shares,
so a text is scored by looking up its n-grams' weights and averaging.

Fit on a sample of at most ``per_language`` rows of each language, those whose hashes
of id, text and language are least, and of at most ``max_rows`` in all: what reaches
the driver doesn't grow with the table. At most ``max_languages`` are learnt, the most
frequent (ties by name); of others nothing is predicted. Counts of the languages
cover all rows allowed for training. Codes that no family lists are taken
together by their first letter, so machines grow with families and with the
languages of each. Prediction is one pass of an Arrow UDF without a shuffle.

Defined results: ``und`` with score 0 for a text that is null or has no letter,
or if there was nothing to learn from; the only language known scores 1; rows that
repeat id, text and language are learnt from once, and every language that is learnt
has a row in the sample, however often one id is there;
repeated rows and null ids are predicted like any other; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from orrery.llm import ngrams

# Families of languages by their ISO 639-1 codes. Codes not listed are families by first letter.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}

SIZES = (1, 2, 3)
BITS = 14
PER_LANGUAGE = 1000
MAX_ROWS = 20_000
MAX_LANGUAGES = 64
UND = "und"
#: What may be a letter: also digits of some kinds, which str.isalpha tells apart.
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def family(lang: str, families: dict[str, tuple[str, ...]] = FAMILIES) -> str:
    code = re.split(r"[-_]", lang.lower())[0]
    return next((name for name, codes in families.items() if code in codes), f"other {code[:1]}")


def shares(text: str) -> np.ndarray:
    """The share of each hashed n-gram in the text."""
    total = np.zeros(1 << BITS)
    for h in ngrams.codes(ngrams.folded(text), SIZES, BITS):
        total += np.bincount(h, minlength=1 << BITS)
    return total / max(1.0, total.sum())


Rows = list[tuple[np.ndarray, np.ndarray]]


def svm(rows: Rows, y: np.ndarray, epochs: int = 12, c: float = 1.0) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss by dual coordinate descent.

    ``rows`` are sparse, (places, shares) each; ``y`` is -1 or 1. Every feature is
    scaled by its spread, and all rows by the same factor to a mean length of 1.
    """
    size, n = 1 << BITS, len(rows)
    total, squares = np.zeros(size), np.zeros(size)
    for at, x in rows:
        total[at] += x
        squares[at] += x * x
    scale = 1 / (np.sqrt(np.maximum(0, squares / n - (total / n) ** 2)) + 1e-3 / size)
    norm = np.sqrt(1 + (squares * scale * scale).sum() / n)
    scale /= norm
    z = [(x * scale[at]).astype(np.float32) for at, x in rows]
    one = 1 / norm
    diag = np.array([float(v @ v) for v in z]) + one * one + 0.5 / c
    alpha, w, b = np.zeros(n), np.zeros(size), 0.0
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(n).tolist():
            at = rows[i][0]
            g = y[i] * (float(z[i] @ w[at]) + one * b) - 1 + alpha[i] / (2 * c)
            step = (max(0.0, alpha[i] - g / diag[i]) - alpha[i]) * y[i]
            if step:
                w[at] += step * z[i]
                b += step * one
                alpha[i] += step * y[i]
    return w * scale, b * one


@dataclass(frozen=True)
class Machines:
    """One-versus-one machines between ``names``; column k of ``weights`` is of pair k."""

    names: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray

    def choose(self, margins: np.ndarray) -> tuple[str, float]:
        """The name with most wins (ties: the larger sum of margins), and its confidence."""
        if len(self.names) == 1:
            return self.names[0], 1.0
        wins, total = np.zeros(len(self.names)), np.zeros(len(self.names))
        least = np.full(len(self.names), np.inf)
        for k, (a, b) in enumerate(combinations(range(len(self.names)), 2)):
            m = float(margins[k])
            wins[a if m > 0 else b] += 1
            total[a] += m
            total[b] -= m
            least[a], least[b] = min(least[a], m), min(least[b], -m)
        best = max(range(len(self.names)), key=lambda i: (wins[i], total[i]))
        return self.names[best], float(1 / (1 + np.exp(-4 * np.clip(least[best], -100, 100))))


def _machines(rows: Rows, of: np.ndarray, names: list[str]) -> Machines:
    made = []
    for a, b in combinations(names, 2):
        chosen = np.flatnonzero((of == a) | (of == b))
        made.append(svm([rows[i] for i in chosen], np.where(of[chosen] == a, 1.0, -1.0)))
    weights = np.stack([w for w, _ in made], axis=1) if made else np.zeros((1 << BITS, 0))
    return Machines(tuple(names), weights.astype(np.float32), np.array([b for _, b in made]))


@dataclass(frozen=True)
class Model:
    """top: machines between families. within: for each family, those between its languages."""

    top: Machines | None
    within: dict[str, Machines]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All machines' weights side by side, and their biases: the families', then each family's in order."""
        parts = [self.top, *self.within.values()] if self.top else []
        return np.hstack([m.weights for m in parts]), np.concatenate([m.bias for m in parts])

    def predict(self, text: str | None, table: tuple[np.ndarray, np.ndarray]) -> tuple[str, float]:
        if not text or not self.top or not has_letter(text):
            return UND, 0.0
        weights, bias = table
        total, n = np.zeros(weights.shape[1]), 0
        for h in ngrams.codes(ngrams.folded(text), SIZES, BITS):
            if weights.shape[1]:
                total += weights.take(h, axis=0).sum(axis=0, dtype=np.float64)
            n += len(h)
        margins = total / max(1, n) + bias
        at = len(self.top.bias)
        name, sure = self.top.choose(margins[:at])
        for key, machines in self.within.items():
            if key == name:
                lang, surer = machines.choose(margins[at : at + len(machines.bias)])
                return lang, sure * surer
            at += len(machines.bias)
        raise KeyError(name)


def fit(
    docs: DataFrame,
    per_language: int = PER_LANGUAGE,
    families: dict[str, tuple[str, ...]] = FAMILIES,
    max_rows: int = MAX_ROWS,
    max_languages: int = MAX_LANGUAGES,
) -> Model:
    """``docs``: doc_id, text, lang, only rows to learn from."""
    hashed = F.xxhash64("doc_id", "lang", F.md5(F.col("text").cast("binary")))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", hashed)
    every = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("low"))
    counts = every.orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not counts:
        return Model(None, {})
    wanted = max(1, min(per_language, max_rows // len(counts)))
    # hashes below a share of all that holds a few times the rows wanted, and each language's least; of these the least are taken
    share = lambda n: min((1 << 64) - 1, 4 * (wanted + 25) * (1 << 64) // n)
    near = lambda r: max(r["low"], share(r["n"]) - (1 << 63))
    bounds = F.create_map(*(v for r in counts for v in (F.lit(r["lang"]), F.lit(near(r)).cast("long"))))
    narrow = known.where(F.col("h") <= bounds[F.col("lang")]).select("lang", "h").distinct()
    least = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    few = narrow.withColumn("k", least).where(F.col("k") <= wanted)
    limits = {r["lang"]: r["h"] for r in few.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    limit = F.create_map(*(v for lang, h in limits.items() for v in (F.lit(lang), F.lit(h).cast("long"))))
    sample = known.where(F.col("h") <= limit[F.col("lang")]).dropDuplicates(["lang", "h"]).select("lang", "text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shares(t) for t in ngrams.texts(batch.column("text"))]
            at = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang"),
                    pa.array([a.astype(np.uint16).tobytes() for a in at], type=pa.binary()),
                    pa.array([r[a].astype(np.float32).tobytes() for r, a in zip(rows, at, strict=True)], type=pa.binary()),
                ],
                names=["lang", "at", "share"],
            )

    got = sample.mapInArrow(featured, "lang string, at binary, share binary").collect()
    got.sort(key=lambda r: (r["lang"], r["at"], r["share"]))
    rows = [
        (np.frombuffer(r["at"], dtype=np.uint16).astype(np.int32), np.frombuffer(r["share"], dtype=np.float32)) for r in got
    ]
    langs = np.array([r["lang"] for r in got])
    of = np.array([family(lang, families) for lang in langs])
    top = _machines(rows, of, sorted(set(of)))
    within = {}
    for name in top.names:
        own = np.flatnonzero(of == name)
        within[name] = _machines([rows[i] for i in own], langs[own], sorted(set(langs[own])))
    return Model(top, within)


def predictor(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A struct of lang_pred and score for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model, model.table() if model.top else None))
    made = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(made)
    def predict(column: pa.Array) -> pa.Array:
        fitted, weights = shared.value
        got = [fitted.predict(t.as_py(), weights) for t in column]
        return pa.StructArray.from_arrays(
            [pa.array([g[0] for g in got], type=pa.string()), pa.array([g[1] for g in got], type=pa.float64())],
            names=["lang_pred", "score"],
        )

    return predict(F.col("`" + text_col.replace("`", "``") + "`"))
