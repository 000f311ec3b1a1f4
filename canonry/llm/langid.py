"""Language identification by sparse multinomial logistic regression.

Features are character n-grams (one to three) of the lower-cased text, hashed into
a fixed number of cells and weighted by TF-IDF. The weights are trained with
follow-the-regularised-leader and an elastic-net penalty, which leaves most of them
at zero; a temperature fitted on rows set aside then calibrates the probabilities.

Document frequencies are counted over every training document. The weights are
fitted on a bounded sample of the labelled ones: ``sample_rows`` in expectation,
chosen by a hash of the id. The training split, the sample and the rows set aside
depend on ids alone, so every run learns the same model.

Defined results: text that is null or has no letter gets ``und`` with score 0; with
no training rows every text gets ``und``; a null id belongs to the training part;
null languages are not learned; repeated rows count each; other columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_batches

UNDETERMINED = "und"
BITS = 15  #: log2 of the number of n-gram cells
CELLS = 1 << BITS
SHORT = 4096  #: code points below which sorting a text's n-grams is cheaper than counting into all cells
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_letter = regex.compile(r"\p{L}").search
#: Share of the training texts that hold an n-gram from which it is a familiar one.
FAMILIAR = 0.005


def cells(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram cells of a text and how often each occurs."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32)
    grams, gram = [], np.zeros(len(codes), dtype=np.uint32)
    for n in range(min(3, len(codes))):
        gram = gram[: len(codes) - n] * _MIX[1] + codes[n:] + np.uint32(n)
        hashed = gram * _MIX[0]
        hashed ^= hashed >> np.uint32(15)
        grams.append((hashed * _MIX[2]) >> np.uint32(32 - BITS))
    if len(codes) < SHORT:
        return np.unique(np.concatenate(grams), return_counts=True)
    counts = np.zeros(CELLS, dtype=np.int64)
    for g in grams:
        counts += np.bincount(g, minlength=CELLS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _letters() -> np.ndarray:
    """Which code points are letters or marks on them, made on first use."""
    if not _LETTERS:
        table = np.zeros(0x110000, bool)
        table[[ord(c) for c in regex.findall(r"[\p{L}\p{M}]", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000)))))]] = True
        _LETTERS.append(table)
    return _LETTERS[0]


_LETTERS: list[np.ndarray] = []


def letter_trigrams(text: str) -> np.ndarray:
    """The cells of a text's trigrams of letters, each run of anything else as one blank."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _letters()[codes]
    kept = is_letter | np.concatenate([[True], is_letter[:-1]])
    codes = np.where(is_letter, codes, np.uint32(32))[kept]
    gram = np.zeros(len(codes), dtype=np.uint32)
    for n in range(3):
        if len(codes) <= n:
            return np.zeros(0, np.uint32)
        gram = gram[: len(codes) - n] * _MIX[1] + codes[n:] + np.uint32(n)
    hashed = gram * _MIX[0]
    hashed ^= hashed >> np.uint32(15)
    return (hashed * _MIX[2]) >> np.uint32(32 - BITS)


def weights(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of a text's cells with sublinear frequencies, of length 1."""
    v = (1.0 + np.log(counts)) * idf[found]
    return v / (math.sqrt(float(v @ v)) or 1.0)


def frequencies(training: DataFrame) -> tuple[int, np.ndarray]:
    """The number of training texts and, for each cell, how many of them hold it: one row a cell reaches the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS + 1, dtype=np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                seen[cells(t or "")[0]] += 1
                seen[CELLS] += 1
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(seen[found])], names=["cell", "n"])

    rows = training.select("text").mapInArrow(partial, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS + 1, dtype=np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return int(out[CELLS]), out[:CELLS]


class SparseSoftmax:
    """Multinomial logistic regression trained by FTRL-proximal with an elastic net."""

    def __init__(self, langs: list[str], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05) -> None:
        self.langs, self.alpha, self.beta, self.l1, self.l2 = langs, alpha, beta, l1, l2
        self.z = np.zeros((CELLS, len(langs)))
        self.n = np.zeros((CELLS, len(langs)))
        self.temperature = 1.0
        self.w: np.ndarray | None = None

    def _weights(self, found) -> np.ndarray:
        z, n = self.z[found], self.n[found]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, found: np.ndarray, v: np.ndarray, label: int) -> None:
        w = self._weights(found)
        p = _softmax(v @ w)
        p[label] -= 1.0
        g = v[:, None] * p[None, :]
        n = self.n[found]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[found] += g - sigma * w
        self.n[found] = n + g * g

    def finish(self) -> None:
        self.w = self._weights(slice(None)).astype(np.float32)

    def calibrate(self, logits: np.ndarray, labels: np.ndarray) -> None:
        """The temperature of least log loss, by golden-section search over its logarithm."""

        def loss(log_t: float) -> float:
            s = logits / math.exp(log_t)
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).sum())

        if len(labels):
            a, b, g = -4.0, 3.0, (math.sqrt(5) - 1) / 2
            for _ in range(60):
                c, d = b - g * (b - a), a + g * (b - a)
                a, b = (a, d) if loss(c) < loss(d) else (c, b)
            self.temperature = math.exp((a + b) / 2)

    def predict(self, text: str | None, idf: np.ndarray) -> tuple[str, float]:
        if not text or not self.langs or not _letter(text):
            return UNDETERMINED, 0.0
        found, counts = cells(text)
        p = _softmax(weights(found, counts, idf) @ self.w[found] / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


class Model:
    def __init__(self, idf: np.ndarray, softmax: SparseSoftmax, familiar: np.ndarray) -> None:
        self.idf, self.softmax, self.familiar = idf.astype(np.float32), softmax, familiar

    def strangeness(self, text: str | None) -> float:
        """The share of a text's letter trigrams that too few training texts hold: near 0 in the languages learned, over a half in letter noise. 0 without letters."""
        found = letter_trigrams(text or "")
        return float(1.0 - self.familiar[found].mean()) if len(found) else 0.0

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.softmax.predict(text, self.idf)


def _learn(data: pa.Table, idf: np.ndarray, epochs: int, set_aside: float) -> SparseSoftmax:
    """The fitted and calibrated regression of ``lang``, ``cells``, ``counts``, in the order of ``data``."""
    langs = sorted(set(data.column("lang").to_pylist()))
    softmax = SparseSoftmax(langs)
    rows = [(np.asarray(c.values), weights(np.asarray(c.values), np.asarray(n.values), idf), langs.index(k.as_py())) for k, c, n in zip(data.column("lang"), data.column("cells"), data.column("counts"), strict=True)]
    order = np.random.default_rng(7).permutation(len(rows))
    held = order[: int(set_aside * len(rows))]
    for _ in range(epochs):
        for i in order[len(held) :]:
            softmax.learn(*rows[i])
    softmax.finish()
    if len(held):
        softmax.calibrate(np.array([rows[i][1] @ softmax.w[rows[i][0]] for i in held]), np.array([rows[i][2] for i in held]))
    return softmax


def fit(training: DataFrame, sample_rows: int = 6000, epochs: int = 3, set_aside: float = 0.2) -> Model:
    """Fits on ``doc_id``, ``text``, ``lang`` of the training part.

    The sample, some ``sample_rows`` rows whatever the table's size, comes together in
    one task, which learns from it; the driver gets the weights that are not zero.
    """
    rows, seen = frequencies(training)
    idf = np.log((1.0 + rows) / (1.0 + seen)) + 1.0
    part = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit("langid")), F.lit(1_000_000))
    sample = map_batches(
        training.where(part < math.ceil(1e6 * min(1.0, sample_rows / max(1, rows)))).select("doc_id", "text", "lang"),
        lambda ids, texts, langs: (ids, langs, *map(list, zip(*([x.tolist() for x in cells(t or "")] for t in texts), strict=True))),
        "doc_id long, lang string, cells array<int>, counts array<int>",
        ["doc_id", "lang", "cells", "counts"],
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            softmax = _learn(pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("lang", "ascending")]), idf, epochs, set_aside)
            for k, lang in enumerate(softmax.langs):
                used = np.flatnonzero(softmax.w[:, k])
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([softmax.temperature]), pa.array([used.astype(np.int32)], pa.list_(pa.int32())), pa.array([softmax.w[used, k]], pa.list_(pa.float32()))], names=["lang", "temperature", "cells", "weights"])

    learned = sample.repartition(1).mapInArrow(learn, "lang string, temperature double, cells array<int>, weights array<float>").toArrow().sort_by("lang")
    learned = list(zip(*(learned.column(n) for n in ("lang", "temperature", "cells", "weights")), strict=True))
    softmax = SparseSoftmax([lang.as_py() for lang, *_ in learned])
    softmax.finish()
    for k, (_, temperature, found, w) in enumerate(learned):
        softmax.temperature = temperature.as_py()
        softmax.w[np.asarray(found.values), k] = np.asarray(w.values)
    softmax.z = softmax.n = None
    # With one more text of each kind counted: as long as training texts are few, nothing is known to be rare.
    return Model(idf, softmax, (seen + 1.0) / (rows + 2.0) >= FAMILIAR)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``text``, ``lang_pred``, ``score`` of each row's whole text."""

    def run(ids, texts):
        found = [model(t) for t in texts]
        return ids, texts, [k for k, _ in found], [s for _, s in found]

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, text string, lang_pred string, score double", ["doc_id", "text", "lang_pred", "score"])


def training_part(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``lang`` of rows with a language outside the held-out fifth."""
    return docs.where(F.col("lang").isNotNull() & (F.coalesce(crc_mod("doc_id", 5), F.lit(1)) != 0)).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))


def classify(docs: DataFrame) -> DataFrame:
    """Predicts the language of every document by a model of those outside the held-out fifth."""
    found = identify(docs, fit(training_part(docs)))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
