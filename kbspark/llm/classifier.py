"""Quality classifier: regularised quadratic discriminant over text statistics.

Each class of labelled documents gets a mean and a covariance of transformed statistics of
its whole texts; covariances are shrunk towards that of all labelled documents and towards
a multiple of the identity. The score compares the two log densities, computed from
Mahalanobis distances with Cholesky factors that are kept with the model.

Defined results: null and empty texts have the statistics of an empty text; labels that are
null are not used, and of several labels of a document the highest counts; a class
without examples takes the distribution of all examples, and without any label every score
is the prior 0.5; repeated rows count as often as they come; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm.common import staged
from kbspark.llm.tokens import byte_values, find_words, mix, pieces, separators, word_hashes

CUT = 0.3
FOLDS, HELD_OUT = 5, 0
POOLED, ROUND = 0.1, 0.02  # shrinkage towards the common covariance, and towards its mean variance
NAMES = (
    "log_words", "word_length", "symbols", "capitals", "digits", "shouts", "stops", "other_ascii",
    "line_length", "distinct", "adjacent", "first_letters",
)
_CLASSES = {"symbols": b"#*$%&|<>", "shouts": b"!?", "stops": b".,", "lines": b"\n"}


def _byte_classes() -> np.ndarray:
    """Class of every byte: 0 other, then symbols, shouts, stops, lines, capitals, digits, white space, following bytes."""
    out = np.zeros(256, dtype=np.int64)
    for i, chars in enumerate(_CLASSES.values(), 1):
        out[list(chars)] = i
    out[65:91], out[48:58] = 5, 6
    out[[32, 9, 11, 12, 13]] = 7
    out[128:192] = 8
    out[97:123], out[192:] = 9, 9
    return out


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for every text."""
    seps, values, classes = separators("space"), byte_values(False), _byte_classes()
    parts = []
    for piece in pieces(texts):
        n = piece.rows
        row = np.repeat(np.arange(n), np.diff(piece.offsets))
        c = np.bincount(row * 10 + classes[piece.data], minlength=10 * n).reshape(n, 10).astype(float)
        words = find_words(piece, seps)
        hashes, of, count = word_hashes(piece, words, values), words.row, words.counts.astype(float)
        chars = c.sum(1) - c[:, 8]
        inner = np.maximum(chars - c[:, 7] - c[:, 4], 1.0)
        # Distinct words: sorted by row, then by the top bits of the hash.
        keyed = np.sort((of.astype(np.uint64) << np.uint64(40)) | (mix(hashes) >> np.uint64(24)))
        fresh = np.ones(len(keyed), bool)
        fresh[1:] = keyed[1:] != keyed[:-1]
        distinct = np.bincount((keyed[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
        twin = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        adjacent = np.bincount(of[1:][twin], minlength=n)
        upper = (piece.data[words.starts] >= 65) & (piece.data[words.starts] <= 90)
        first = np.bincount(of[upper], minlength=n)
        some = np.maximum(count, 1.0)
        log = np.log
        parts.append(np.stack([
            log(1 + count), log(1 + inner / some), log(0.005 + c[:, 1] / inner), log(0.02 + c[:, 5] / inner),
            log(0.01 + c[:, 6] / inner), log(0.005 + c[:, 2] / inner), log(0.02 + c[:, 3] / some), log(0.01 + c[:, 0] / inner),
            log(1 + some / (1 + c[:, 4])), log(0.05 + distinct / np.maximum(some, 1.0) ** 0.85), log(0.01 + adjacent / some),
            log(0.05 + first / some)], axis=1))
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def text_statistics(texts: pa.Array) -> pa.Array:
    found = statistics(texts)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(NAMES)), pa.int32()), pa.array(found.ravel()))


@dataclass
class Model:
    """Class means, inverse Cholesky factors, log determinants and log odds of the classes."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    log_odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        dens = [-0.5 * (((x - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets)]
        return 1.0 / (1.0 + np.exp(-np.clip(dens[1] - dens[0] + self.log_odds, -30.0, 30.0)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Number, sum and sum of products of the statistics (column ``x``) for every ``quality``.

    One aggregation over all labelled rows; two rows of fixed width come to the driver.
    """
    d = len(NAMES)
    x = [F.get("x", i) for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
    out = {}
    for r in rows.filter(F.col("quality").isin(0, 1)).groupBy("quality").agg(F.count("*").alias("n"), *sums).collect():
        p = np.zeros((d, d))
        for i, j in pairs:
            p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        out[r["quality"]] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(d)]), p)
    return out


def fit(rows: DataFrame, pooled: float = POOLED, rounded: float = ROUND) -> Model:
    """Model from the columns ``x`` and ``quality`` of all labelled rows."""
    found, d = moments(rows), len(NAMES)
    everything = [sum(part) for part in zip(*found.values())] if found else [0.0, np.zeros(d), np.zeros((d, d))]

    def normal(n: float, s: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = s / max(n, 1.0)
        return mean, p / max(n, 1.0) - np.outer(mean, mean)

    mean, common = normal(*everything)
    spread = max(np.trace(common) / d, 1e-6)
    means, factors, logdets = [], [], []
    for label in (0, 1):
        m, cov = normal(*found[label]) if label in found else (mean, common)
        cov = (1 - pooled - rounded) * cov + pooled * common + rounded * spread * np.eye(d)
        chol = np.linalg.cholesky((cov + cov.T) / 2)
        means.append(m)
        factors.append(np.linalg.inv(chol))
        logdets.append(2 * float(np.log(np.diag(chol)).sum()))
    odds = np.log((found[1][0] + 1) / (found[0][0] + 1)) if len(found) == 2 else 0.0
    return Model(means, factors, logdets, float(odds))


def scorer(model: Model):
    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        flat = np.asarray(x.flatten(), dtype=float).reshape(-1, len(NAMES))
        return pa.array(model.scores(flat))

    return score


def held_out(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(text) % FOLDS == HELD_OUT


def training_labels(labels: DataFrame) -> DataFrame:
    """(_id, quality) outside the held-out fold, one row per document."""
    return labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").alias("_id")).agg(F.max("quality").alias("quality"))


def fit_documents(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on ``docs`` whose label is known and not held out."""
    ids = training_labels(labels)
    rows = docs.select("doc_id", text_statistics("text").alias("x"))
    return fit(rows.join(ids, F.col("doc_id") == F.col("_id")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Texts are read once: their statistics are staged, fitted and scored from there.
    """
    found = staged(docs.select("doc_id", text_statistics("text").alias("x")), "statistics")
    model = fit(found.join(training_labels(labels), F.col("doc_id") == F.col("_id")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)("x").alias("score")).withColumn(
        "predicted", (F.col("score") >= CUT).cast("int"))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, columns unchanged."""
    model = fit_documents(docs, labels)
    return docs.filter(scorer(model)(text_statistics("text")) >= CUT)
