"""Quality by regularised quadratic discriminant analysis over document statistics.

Each class has a Gaussian over transformed statistics of the whole text. A class's
covariance is shrunk toward the pooled one and that toward its diagonal, so that it
stays invertible however few rows a class has; its Cholesky factor is computed once
and a document's score is the difference of two Mahalanobis log-densities.

The sums that the covariances need are added up over every labelled row, without
sampling: only (statistics + 1)^2 numbers a class reach the driver, at any size.

Defined results: null text counts as empty and is scored like any text; labels
that are null are left out, several labels of one document count by their highest;
repeated rows are scored each; with no label of one class every score is the
share of the class that there is (0.5 without any labels); other columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, documents_of, map_batches

#: Names of the statistics, in order.
STATISTICS = ["log_bytes", "log_words", "log_lines", "word_bytes", "upper", "digits", "spaces", "stops", "commas", "symbols", "marks", "pipes", "other", "non_ascii", "entropy", "distinct_words", "distinct_lines", "longest_word", "line_words", "digit_words"]
_CLASS = np.full(256, 8, dtype=np.int64)  # 8: letters in lower case, as all letters' first bytes beyond ASCII
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\v\f", b".?", b",;:", b"#$%&*@^~+=<>\\/_", b"!", b"|")):
    _CLASS[list(_chars)] = _k
for _b in range(128):
    if _CLASS[_b] == 8 and not chr(_b).isalpha():
        _CLASS[_b] = 9
_CLASS[128:192] = 10  # later bytes of a letter


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text: logarithms of counts, log-odds of shares."""
    raw = (text or "").encode()
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=11)
    words = raw.split()
    lines = raw.split(b"\n")
    letters = max(1.0, n - kinds[10])
    p = counts[counts > 0] / max(1, n)
    share = lambda part, whole, least=0.002: math.log((part / max(1, whole) + least) / (1 - min(1.0, part / max(1, whole)) + least))
    several = [x for x in lines if x]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    return [
        math.log1p(n), math.log1p(len(words)), math.log(len(lines)), math.log1p(float(lengths.mean())),
        share(kinds[0], letters), share(kinds[1], letters), share(kinds[2], letters), share(kinds[3], letters), share(kinds[4], letters), share(kinds[5], letters),
        share(kinds[6], letters), share(kinds[7], letters), share(kinds[9], letters), share(kinds[10], n, 0.02),
        float(-(p * np.log(p)).sum()), share(len(set(words)), len(words), 0.02), share(len(set(several)), len(several), 0.05),
        math.log1p(float(lengths.max())), math.log1p(len(words) / len(lines)), share(float((lengths > 30).sum()), len(words)),
    ]


def describe(docs: DataFrame) -> DataFrame:
    """The statistics of each document: ``doc_id``, ``x``."""
    return map_batches(documents_of(docs), lambda ids, texts: (ids, [statistics(t) for t in texts]), "doc_id long, x array<double>", ["doc_id", "x"])


def moments(labelled: DataFrame) -> dict[int, np.ndarray]:
    """Count, sums and sums of products of (1, x) by label, over all rows of ``label``, ``x``."""
    d = len(STATISTICS) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                x = np.column_stack([np.ones(b.num_rows), np.asarray(b.column("x").flatten()).reshape(b.num_rows, d - 1)])
                y = np.asarray(b.column("label"))
                for k in np.unique(y):
                    own = x[y == k]
                    sums[int(k)] = sums.get(int(k), 0) + own.T @ own
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * (d * d), pa.int32()), pa.array(range(d * d), pa.int32()), pa.array(s.ravel())], names=["label", "cell", "value"])

    rows = labelled.mapInArrow(partial, "label int, cell int, value double").groupBy("label", "cell").agg(F.sum("value").alias("value")).collect()
    out: dict[int, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.label, np.zeros(d * d))[r.cell] = r.value
    return {k: v.reshape(d, d) for k, v in out.items()}


class Discriminant:
    """Shrunk class Gaussians with their Cholesky factors.

    ``to_pooled`` shrinks a class's covariance toward the pooled one, ``to_diagonal``
    the result toward its diagonal.
    """

    def __init__(self, sums: dict[int, np.ndarray], to_pooled: float = 0.05, to_diagonal: float = 0.02) -> None:
        counts = {k: float(s[0, 0]) for k, s in sums.items()}
        total = sum(counts.values())
        self.constant = counts.get(1, 0.0) / total if total else 0.5
        self.classes: list[tuple] = []
        if min(counts.get(0, 0), counts.get(1, 0)) < 1:
            return
        means = {k: s[0, 1:] / counts[k] for k, s in sums.items()}
        covs = {k: s[1:, 1:] / counts[k] - np.outer(means[k], means[k]) for k, s in sums.items()}
        pooled = sum(counts[k] * covs[k] for k in covs) / total
        for k in (0, 1):
            cov = (1 - to_pooled) * covs[k] + to_pooled * pooled
            cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + 1e-4 * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.classes.append((means[k], np.linalg.inv(factor), -float(np.log(np.diag(factor)).sum()) + math.log(counts[k] / total)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of statistics."""
        if not self.classes:
            return np.full(len(x), self.constant)
        log = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in self.classes]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """The highest label of each document: ``doc_id``, ``label``."""
    return labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))


def fit(described: DataFrame, labels: DataFrame, **shrinkage: float) -> Discriminant:
    """Fits on every described row that has a label (``doc_id``, ``label``)."""
    return Discriminant(moments(described.join(labels, "doc_id").select("label", "x")), **shrinkage)


def predict(described: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id``, ``score``: the probability of quality 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("x").flatten()).reshape(b.num_rows, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return described.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Scores every document by a model of the labelled ones outside the held-out third."""
    described = Scratch(docs.sparkSession, "quality").keep(describe(docs))
    training = one_label(labels, "quality").where(crc_mod("doc_id", 3) != 1)
    scored = predict(described, fit(described, training))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
