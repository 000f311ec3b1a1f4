"""Approximate nearest neighbours over learned partitions.

A sample's nearest-neighbour graph is cut into parts of equal size with few edges
between them (recursive spectral bisection with swaps). A small classifier learns
to tell the parts that a vector's neighbours lie in. Every row is indexed under its
most probable part; a query goes to its most probable parts and is compared there
with all rows, in blocks, on the original vectors.

The number of parts grows with the table. Where ``most_parts`` parts would hold more
than ``part_rows`` rows each, every part is cut again in the same way by a classifier
of its own, fitted by Spark on a sample of that part; probabilities then multiply.

Only classifiers are fitted on samples: ``sample_rows`` in expectation, of the table
and of each part, chosen by a hash of the id. The number of parts a query goes to is
the least whose recall on sample queries reaches ``recall``, at every size. Of equal
vectors only those with the ``k + 1`` smallest ids are compared, since no other can
be among the nearest of any query; so a vector that many rows share costs nothing.

Defined results: vectors that are null, zero, of another than the most frequent
dimension or hold null or non-finite components take no part, as queries or as
candidates; nor does a null id; ties go to the smaller id; rows with the query's
own id are no candidates, repeated ids are found once, at their nearest; other
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BLOCK = 2048  #: rows a query meets at once


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 1024):
        d = _squares(x[at : at + 1024], x)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + len(d)] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, depth: int, seed: int = 5) -> np.ndarray:
    """Cuts the graph ``depth`` times in halves of equal size; a number from 0 to 2^depth - 1 for each row."""
    n, k = graph.shape
    heads, tails = np.repeat(np.arange(n), k), graph.ravel()
    heads, tails = np.concatenate([heads, tails]), np.concatenate([tails, heads])
    part, rng = np.zeros(n, dtype=np.int64), np.random.default_rng(seed)
    for _ in range(depth):
        own = part[heads] == part[tails]
        h, t = heads[own], tails[own]
        degree = np.maximum(1.0, np.bincount(h, minlength=n))
        sums = np.bincount(part)
        v = rng.standard_normal(n)
        for _ in range(40):
            v = 0.5 * v + 0.5 * np.bincount(h, weights=v[t], minlength=n) / degree
            v -= (np.bincount(part, weights=v) / sums)[part]
            v /= np.sqrt(np.bincount(part, weights=v * v) / sums + 1e-30)[part]
        order = np.lexsort((v, part))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        starts = np.concatenate([[0], np.cumsum(sums)])[:-1]
        side = ((place - starts[part]) * 2 >= sums[part]).astype(np.int64)
        for _ in range(6):  # swap equally many rows of both halves that have more edges over there
            gain = np.bincount(h, weights=np.where(side[h] != side[t], 1.0, -1.0), minlength=n)
            moved = False
            for p in np.flatnonzero(sums > 1):
                a, b = np.flatnonzero((part == p) & (side == 0)), np.flatnonzero((part == p) & (side == 1))
                a, b = a[np.argsort(-gain[a])][: max(1, len(a) // 20)], b[np.argsort(-gain[b])][: max(1, len(b) // 20)]
                m = min(len(a), len(b))
                good = gain[a[:m]] + gain[b[:m]] > 1
                if good.any():
                    side[a[:m][good]], side[b[:m][good]], moved = 1, 0, True
            if not moved:
                break
        part = 2 * part + side
    return part


class Router:
    """One hidden layer; its outputs are the parts' log-odds."""

    def __init__(self, x: np.ndarray, targets: np.ndarray, hidden: int = 128, epochs: int = 30, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), float(x.std()) or 1.0
        x = (x - self.mean) / self.scale
        shapes = [(x.shape[1], hidden), (hidden,), (hidden, targets.shape[1]), (targets.shape[1],)]
        self.w = [rng.standard_normal(s) * (1 / math.sqrt(s[0])) if len(s) == 2 else np.zeros(s) for s in shapes]
        first, second, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                b = order[at : at + 256]
                h = np.maximum(0, x[b] @ self.w[0] + self.w[1])
                s = h @ self.w[2] + self.w[3]
                p = np.exp(s - s.max(axis=1, keepdims=True))
                g = (p / p.sum(axis=1, keepdims=True) - targets[b]) / len(b)
                gh = (g @ self.w[2].T) * (h > 0)
                step += 1
                for i, grad in enumerate((x[b].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                    first[i] = 0.9 * first[i] + 0.1 * grad
                    second[i] = 0.999 * second[i] + 0.001 * grad * grad
                    rate = 3e-3 * (1 - epoch / epochs)
                    self.w[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]


class Partition:
    """A fitted router over 2^depth parts; a sample too small to learn from gives one part."""

    def __init__(self, sample: np.ndarray, depth: int, k: int = 10) -> None:
        sample = np.unique(sample, axis=0) if len(sample) else sample
        depth = min(depth, int(math.log2(max(1, len(sample) // 32))))
        self.router, self.parts = None, 1 << depth
        if depth:
            k = min(k, len(sample) - 1)
            self.sample, self.graph = sample, neighbour_graph(sample, k)
            part = balanced_parts(self.graph, depth)
            targets = np.zeros((len(sample), self.parts))
            np.add.at(targets, (np.repeat(np.arange(len(sample)), k), part[self.graph].ravel()), 1.0)
            targets[np.arange(len(sample)), part] += 1
            self.held = np.arange(len(sample)) % 8 == 0
            self.router = Router(sample[~self.held], targets[~self.held] / (k + 1))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log-probability of each part."""
        if not self.router:
            return np.zeros((len(x), 1))
        s = self.router(x)
        s -= s.max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))


class Index:
    """One or two levels of partitions, numbered through, and how many of the parts a query goes to."""

    def __init__(self, top: Partition) -> None:
        self.top, self.below, self.probes = top, [None] * top.parts, 1
        self.starts = np.arange(top.parts + 1)

    def deepen(self, below: dict[int, Partition]) -> None:
        self.below = [below.get(p) for p in range(self.top.parts)]
        self.starts = np.concatenate([[0], np.cumsum([b.parts if b else 1 for b in self.below])])

    @property
    def parts(self) -> int:
        return int(self.starts[-1])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The most probable part of the first level, and there of the second."""
        first = self.top(x).argmax(axis=1) if len(x) else np.zeros(0, dtype=np.int64)
        out = self.starts[first]
        for p in np.unique(first):
            if self.below[p]:
                own = first == p
                out[own] += self.below[p](x[own]).argmax(axis=1)
        return out

    def order(self, x: np.ndarray) -> np.ndarray:
        """All parts, the most probable first."""
        score = self.top(x)
        score = np.hstack([score[:, p : p + 1] + (b(x) if b else 0.0) for p, b in enumerate(self.below)])
        return np.argsort(-score, axis=1, kind="stable")

    def tune(self, recall: float) -> None:
        """The least number of parts that hold ``recall`` of the sample neighbours of sample queries."""
        if self.parts > 1:
            x, graph, held = self.top.sample, self.top.graph, self.top.held
            at, order = self.assign(x)[graph[held]], self.order(x[held])
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(self.parts)[None, :], axis=1)
            needed = np.take_along_axis(rank, at, axis=1)
            self.probes = 1 + int(np.quantile(needed, recall, method="higher"))

    def forget(self) -> None:
        """Drops the samples, which are not sent to executors."""
        for p in (self.top, *self.below):
            if p is not None and p.router:
                p.sample = p.graph = p.held = None


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``v`` of the rows that take part; components keep single precision if that is what they have."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    size = F.size("embedding")
    most = vectors.where(F.col("embedding").isNotNull()).groupBy(size.alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (size == (most.n if most else 0)) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)).select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("v"))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest(q: np.ndarray, query_ids: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, exact Euclidean distance) of the k nearest candidates of each query, ties to smaller ids.

    Distances by products are taken about the candidates' mean; whatever their rounding
    could have put before the k-th is measured exactly.
    """
    out: list[tuple] = []
    middle, eps, dim = c.mean(axis=0) if len(c) else 0.0, np.finfo(float).eps, c.shape[1]
    moved, largest = c - middle, float(np.abs(c).max(initial=0.0))
    norm = float((moved * moved).sum(axis=1).max(initial=0.0))
    by_id = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(ids[by_id]) != 0])[: len(ids)]
    for at in range(0, len(q), 512):
        near_q = q[at : at + 512] - middle
        d = _squares(near_q, moved)
        for row, qi, query, own in zip(d, query_ids[at : at + 512], q[at : at + 512], (near_q * near_q).sum(axis=1), strict=True):
            row[ids == qi] = np.inf
            least = row if len(starts) == len(row) else np.minimum.reduceat(row[by_id], starts)
            kth = np.partition(least, k - 1)[k - 1] if len(least) > k else np.inf
            off = 8 * eps * math.sqrt(dim) * max(largest, float(np.abs(query).max(initial=0.0)))
            slack = 8 * eps * (dim + 4) * (own + norm) + off * (off + 2 * math.sqrt(max(0.0, min(kth, own + norm))))
            near = np.flatnonzero((row <= kth + 2 * slack) & (row < np.inf)) if np.isfinite(kth) else np.flatnonzero(row < np.inf)
            exact = np.sqrt(((c[near] - query) ** 2).sum(axis=1))
            best = np.lexsort((ids[near], exact))
            best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])][:k]
            out.append((np.full(len(best), qi), ids[near][best], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def build(valid: DataFrame, rows: int, kind: str, sample_rows: int, recall: float, part_rows: int, most_parts: int) -> Index:
    """The index of ``vec_id``, ``v`` (of type ``kind``): a router fitted on the driver's sample and, for large tables, one for each of its parts."""
    chosen = lambda seed, share: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, share))
    sample = valid.where(chosen("index", sample_rows / max(1, rows))).orderBy("vec_id").toArrow()
    depth, most = max(1, round(math.log2(max(2, rows / part_rows)))), int(math.log2(most_parts))
    index = Index(Partition(_matrix(sample.column("v")), min(depth, most)))
    if depth > most and index.top.parts > 1:
        top, further = index.top, min(most, depth - most)

        def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(top(_matrix(b.column(1))).argmax(axis=1).astype(np.int32))], names=["vec_id", "v", "part"])

        def learn(key: tuple, rows: pa.Table) -> pa.Table:
            own = Index(Partition(_matrix(rows.sort_by("vec_id").column("v")), further))
            own.forget()
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "fitted": pa.array([pickle.dumps(own.top)], pa.binary())})

        parts = valid.where(chosen("part", sample_rows * top.parts / rows)).mapInArrow(part_of, f"vec_id long, v {kind}, part int")
        index.deepen({r.part: pickle.loads(r.fitted) for r in parts.groupBy("part").applyInArrow(learn, "part int, fitted binary").collect()})  # noqa: S301
    index.tune(recall)
    index.forget()
    return index


def _once(valid: DataFrame, kind: str) -> DataFrame:
    """Without the rows that repeat in a task, so that a row that many copies share is few rows before it is exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            if b.num_rows:
                x, new = _matrix(b.column(1)) + 0.0, []
                for key in zip(b.column(0).to_pylist(), x, strict=True):
                    key = (key[0], key[1].tobytes())
                    new.append(key not in seen)
                    if len(seen) >= 20_000:
                        seen.clear()
                    seen.add(key)
                yield b.filter(pa.array(new))

    return valid.mapInArrow(run, f"vec_id long, v {kind}")


def search(vectors: DataFrame, is_query: Column, k: int = 10, sample_rows: int = 8192, recall: float = 0.98, part_rows: int = 1500, most_parts: int = 128) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's k nearest found, by Euclidean distance."""
    valid = valid_vectors(vectors)
    kind = dict(valid.dtypes)["v"]
    own = _once(valid, kind).withColumn("__place", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("__place") <= k + 1)
    compared = Scratch(vectors.sparkSession, "neighbours").keep(own.select("vec_id", "v"))
    index = build(compared, compared.count(), kind, sample_rows, recall, part_rows, most_parts)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(index.assign(_matrix(b.column(0))).astype(np.int32))], names=["part"])

    held = {r.part: r.n for r in compared.select("v").mapInArrow(assign, "part int").groupBy("part").agg(F.count("*").alias("n")).collect()}
    counts = np.array([held.get(p, 0) for p in range(index.parts)], dtype=np.int64)
    blocks = np.maximum(1, -(-counts // BLOCK))
    starts = np.concatenate([[0], np.cumsum(blocks)])[:-1]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 4_000_000 // index.parts)
        for whole in batches:
            for b in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                order = index.order(_matrix(b.column(1)))
                enough = np.maximum(index.probes, 1 + (np.cumsum(counts[order], axis=1) < k + 1).sum(axis=1))
                rows = [(i, starts[p] + j) for i, (o, m) in enumerate(zip(order, enough, strict=True)) for p in o[:m] for j in range(blocks[p])]
                at = np.array(rows, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[:, 0])), b.column(1).take(pa.array(at[:, 0])), pa.array(at[:, 1].astype(np.int32))], names=["query_id", "q", "block"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                part = index.assign(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array((starts[part] + b.column(2).to_numpy() % blocks[part]).astype(np.int32))], names=["vec_id", "v", "block"])

    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).alias("spread")
    candidates = compared.select("vec_id", "v", spread).mapInArrow(place, f"vec_id long, v {kind}, block int")
    queries = valid.where(is_query).dropDuplicates(["vec_id"]).mapInArrow(route, f"query_id long, q {kind}, block int")

    def meet(left, right):
        found = nearest(_matrix(right.column("q")), right.column("query_id").to_numpy(), _matrix(left.column("v")), left.column("vec_id").to_numpy(), k) if len(left) and len(right) else nearest(np.zeros((0, 1)), np.zeros(0), np.zeros((0, 1)), np.zeros(0), k)
        return pa.table({n: pa.array(x.astype(t)) for n, x, t in zip(("query_id", "vec_id", "score"), found, (np.int64, np.int64, np.float64), strict=True)})

    met = candidates.groupBy("block").cogroup(queries.groupBy("block")).applyInArrow(meet, "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
