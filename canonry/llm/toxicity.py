"""Toxic passages by maximum-scoring segments of token log-odds.

A token's score is its log-odds between toxic and other labelled documents under an
informative Dirichlet prior (the token's share of the whole corpus), less some
standard errors, where a likelihood-ratio test finds evidence; a word too rare to be
judged goes by the log-odds of its first letters, and tokens without evidence cost a
little. One linear scan finds all maximal scoring segments of a text. The
Karlin-Altschul law of such maxima turns a segment's score and the text's length into
an expected number of equal segments by chance; segments below ``expected`` are
significant. A document's evidence is the log expectation of its best segments
together, and its score a logistic function of that, fitted on labelled documents.

The scores are fitted on a bounded sample of labelled rows (``sample_rows`` in
expectation, chosen by a hash of the id). The prior counts every token of every
document; one number a word of the sample's vocabulary reaches the driver.

Defined results: null text counts as empty, and an empty text scores like any text
without evidence; null labels are left out, several labels of a document count by
their highest; without labels of both kinds every score is the share of toxic ones
(0 without any labels); repeated rows are scored each; other columns are ignored;
an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, documents_of, map_batches, small_batches
from .quality import one_label

_WORD = re.compile(r"[^\W_]+")
#: Constants of the extreme-value law that are tried; the one of least log loss holds.
CONSTANTS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4)
#: A word of more letters also counts as its first ones, so that endings not seen yet are judged by the stem.
STEM = 4


def tokens_of(text: str | None) -> list[str]:
    """The words of a text in lower case."""
    return _WORD.findall((text or "").lower())


def stems_of(words: list[str]) -> list[str]:
    """``stem*`` of every word that is longer than a stem."""
    return [w[:STEM] + "*" for w in words if len(w) > STEM]


def maximal_segments(at: list[int], scores: list[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (first hit, last hit, score).

    ``at`` are the places of tokens with positive ``scores``; every token between
    costs ``cost``. The scan keeps, for each segment still open, the running total
    before and after it, and joins a new one to the nearest that starts lower.
    """
    total, out = 0.0, []  # out: [first hit, last hit, total before, total after]
    for i, s in enumerate(scores):
        if i:
            total -= cost * (at[i] - at[i - 1] - 1)
        left, total = total, total + s
        first, j = i, len(out) - 1
        before = left
        while True:
            while j >= 0 and out[j][2] >= before:
                j -= 1
            if j < 0 or out[j][3] >= total:
                break
            first, before = out[j][0], out[j][2]
            del out[j:]
            j = len(out) - 1
        out.append([first, i, before, total])
    return [(a, b, after - before) for a, b, before, after in out]


class Model:
    """Token scores, the extreme-value law of chance segments (``rate``, ``constant``), and the calibration."""

    def __init__(self, table: dict[str, float], cost: float, rate: float, constant: float, slope: float, offset: float, share: float, expected: float) -> None:
        self.table, self.cost, self.rate, self.constant = table, cost, rate, constant
        self.slope, self.offset, self.share, self.expected = slope, offset, share, expected
        self.words, self.stems = {w for w in table if w[-1] != "*"}, {w[:-1] for w in table if w[-1] == "*"}

    def segments(self, text: str | None) -> list[dict]:
        """Significant segments: characters ``start`` to ``end``, ``score``, ``log_expected``."""
        text = text or ""
        words = tokens_of(text)
        if self.words.isdisjoint(words) and self.stems.isdisjoint([w[:STEM] for w in words]):
            return []
        at, scores, spans = [], [], []
        n = 0
        for n, m in enumerate(_WORD.finditer(text), 1):  # noqa: B007
            w = m.group().lower()
            s = max(self.table.get(w, 0.0), self.table.get(w[:STEM] + "*", 0.0) if len(w) > STEM else 0.0)
            if s > 0:
                at.append(n)
                scores.append(s)
                spans.append(m.span())
        floor = math.log(self.constant * max(n, 1))
        return [{"start": spans[a][0], "end": spans[b][1], "score": s, "log_expected": floor - self.rate * s} for a, b, s in maximal_segments(at, scores, self.cost)]

    def significant(self, segments: list[dict]) -> list[dict]:
        return [x for x in segments if x["log_expected"] < math.log(self.expected)]

    def evidence(self, segments: list[dict], raised: float = 0.0) -> float:
        """How unlikely the best segments are together: r of them by chance have the product of their expectations over r!.

        ``raised`` is added to the logarithm of each expectation.
        """
        best = total = 0.0
        for r, e in enumerate(sorted(x["log_expected"] for x in segments), 1):
            total += math.log(r) - e - raised
            best = max(best, total)
        return min(60.0, best)

    def probability(self, evidence: float) -> float:
        if not self.table:
            return self.share
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * evidence + self.offset))))


def _sums(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy("word").agg(*(F.sum(c).alias(c) for c in columns))


def _class_counts(labelled: DataFrame) -> DataFrame:
    """Of ``text``, ``label``: tokens and documents by word and class, and the totals (word null)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, holders = (Counter(), Counter()), (Counter(), Counter())
        documents, size = [0, 0], [0, 0]
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = tokens_of(t)
                both = words + stems_of(words)
                tokens[y].update(both)
                holders[y].update(set(both))
                documents[y] += 1
                size[y] += len(words)
        words = [None, *set(tokens[0]) | set(tokens[1])]
        columns = [[size[k], *(tokens[k][w] for w in words[1:])] for k in (0, 1)] + [[documents[k], *(holders[k][w] for w in words[1:])] for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["word", "other", "toxic", "other_docs", "toxic_docs"])

    counted = labelled.select("text", "label").mapInArrow(partial, "word string, other long, toxic long, other_docs long, toxic_docs long")
    return _sums(counted, ["other", "toxic", "other_docs", "toxic_docs"])


def corpus_counts(docs: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """Tokens of the whole corpus, and how many of them are each of ``words``."""
    number = {w: i for i, w in enumerate(words)}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = 0, Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                found = tokens_of(t)
                total += len(found)
                counts.update(filter(number.__contains__, found))
                counts.update(filter(number.__contains__, stems_of(found)))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *map(number.__getitem__, counts)], pa.int32()), pa.array([total, *counts.values()], pa.int64())], names=["word", "n"])

    rows = documents_of(docs).select("text").mapInArrow(partial, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in rows}
    return found.get(-1, 0), {w: found.get(i, 0) for w, i in number.items()}


def _rate(scores: np.ndarray, shares: np.ndarray, cost: float) -> float:
    """The positive root r of sum(share * exp(r * score)) = 1, tokens without evidence included."""
    rest = 1 - shares.sum()
    low, high = 1e-6, 50.0
    for _ in range(200):
        r = (low + high) / 2
        low, high = (r, high) if float((shares * np.exp(np.minimum(r * scores, 700))).sum()) + rest * math.exp(-r * cost) < 1 else (low, r)
    return low


def token_scores(words: list, size: tuple, tokens: int, everywhere: dict[str, int], prior: float, errors: float, cost: float, most: float, least_ratio: float) -> tuple[dict[str, float], list[float]]:
    """Lowered log-odds of the words (``word``, ``toxic``, ``other``) with evidence, and their shares of text that isn't toxic."""
    table, shares = {}, []
    for r in words:
        expected = [(r.toxic + r.other) * n / (size[0] + size[1]) for n in size[:2]]
        ratio = 2 * sum(n * math.log(n / e) for n, e in ((r.toxic, expected[1]), (r.other, expected[0])) if n)
        if ratio < least_ratio:
            continue
        a = max(0.5, prior * everywhere[r.word] / max(1, tokens))
        y1, y0 = r.toxic + a, r.other + a
        odds = math.log(y1 / max(1.0, size[1] + prior - y1)) - math.log(y0 / max(1.0, size[0] + prior - y0))
        s = odds - errors * math.sqrt(1 / y1 + 1 / y0)
        if s > 2 * cost:
            table[r.word] = min(most, s)
            shares.append(y0 / (size[0] + prior))
    return table, shares


def fit(docs: DataFrame, training: DataFrame, sample_rows: int = 12_000, prior: float = 2_000.0, errors: float = 2.5, cost: float = 0.25, most: float = 6.0, least_ratio: float = 30.0, least_docs: int = 3, expected: float = 0.05) -> Model:
    """Fits on ``docs`` and the labels (``doc_id``, ``label``) of the training part.

    ``prior``: tokens that the prior counts as; ``errors``: standard errors a score
    is lowered by; ``cost``: of a token without evidence; ``most``: of a token's
    score; ``least_ratio``: the likelihood-ratio statistic from which a word has
    evidence; ``least_docs``: toxic documents that must hold it.
    """
    small_batches(docs.sparkSession)
    counts = {r.label: r.n for r in training.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    nothing = Model({}, cost, 1.0, 1.0, 0.0, 0.0, share, expected)
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        return nothing
    chosen = training.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, sample_rows / total)))
    #: The sample's ids and labels are at most some sample_rows small rows, so they are sent to every executor.
    labelled = documents_of(docs).join(F.broadcast(chosen), "doc_id")
    rows = _class_counts(labelled).where(F.col("word").isNull() | ((F.col("toxic_docs") >= least_docs) & (F.col("toxic_docs") * counts[0] > 2 * F.col("other_docs") * counts[1]))).collect()
    size = next(((r.other, r.toxic, r.other_docs, r.toxic_docs) for r in rows if r.word is None), None)
    if not size or not size[2] or not size[3]:
        return nothing
    words = sorted((r for r in rows if r.word is not None), key=lambda r: r.word)
    tokens, everywhere = corpus_counts(docs, [r.word for r in words])
    table, shares = token_scores(words, size, tokens, everywhere, prior, errors, cost, most, least_ratio)
    if not table:
        return nothing
    rate = _rate(np.array(list(table.values())), np.array(shares), cost)
    model = Model(table, cost, rate, 1.0, 1.0, 0.0, share, expected)

    def weigh(texts, labels):
        found = [model.segments(t) for t in texts]
        return [[model.evidence(x, math.log(k)) for k in CONSTANTS] for x in found], labels

    weighed = map_batches(labelled.select("text", "label"), weigh, "evidence array<double>, label int", ["evidence", "label"]).groupBy("evidence", "label").agg(F.count("*").alias("n")).collect()
    y, n = (np.array([r[k] for r in weighed], dtype=float) for k in ("label", "n"))
    best = math.inf
    for i, constant in enumerate(CONSTANTS):
        slope, offset, loss = _logistic(np.array([r.evidence[i] for r in weighed]), y, n)
        if loss < best:
            best, model.constant, model.slope, model.offset = loss, constant, slope, offset
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Slope (not negative) and offset of least penalised log loss, by Newton's method, and that loss."""
    w = np.array([0.1, math.log((float((y * n).sum()) + 1) / (float(((1 - y) * n).sum()) + 1))])
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (n * (p - y)) + ridge * w
        h = (design * (n * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -1.0, 1.0)
    slope, offset = max(0.0, float(w[0])), float(w[1])
    margin = np.where(y == 1, -1.0, 1.0) * (slope * x + offset)
    return slope, offset, float((n * np.logaddexp(0, margin)).sum())


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` and every significant passage: its characters, score and log expectation."""

    def run(ids, texts):
        found = [model.segments(t) for t in texts]
        return ids, [model.probability(model.evidence(x)) for x in found], [model.significant(x) for x in found]

    return map_batches(documents_of(docs), run, "doc_id long, score double, passages array<struct<start:int,end:int,score:double,log_expected:double>>", ["doc_id", "score", "passages"])


def fit_from_labels(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of labels outside the held-out third."""
    return fit(docs, one_label(labels, "toxic").where(crc_mod("doc_id", 3) != 1))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Scores every document by a model of the labelled ones outside the held-out third."""
    scored = passages(docs, fit_from_labels(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
