"""Ranked lexical search by inverted treaps: whole top-k lists without scoring every document.

A batch of items is searched over all documents. One pass cuts every text into terms and
writes an index: a document's number of terms and the counts of those that any item asks
for. From it come the number of documents, of terms and of documents that hold a term (each combined
before it is exchanged); a task then takes the index in shards of bounded size. In a shard each term has a treap: a
binary search tree by place (the order of ``doc_id``) and a heap by impact, so that a
subtree is a run of documents and its root has their largest impact. An item walks the treaps of its
terms together. A range of documents, with the root of each term's treap within it, is
dropped if the roots' impacts together can't enter the ``k`` best; else the document of the
largest root is scored, and the range is cut there in two. Ranges of the highest bounds come first,
in blocks of arrays. The ``k`` best of an item pass from shard to shard of a task, so
pruning sharpens; each task returns at most ``k`` rows an item, which Spark ranks (and limits before the
exchange). Documents aren't exchanged at all, so no term, however common, is a hot group.

Bounds, and what they depend on: items are taken in blocks of ``MOST_TERMS`` terms, whose vocabulary and
counts pass through the driver (an item with more is a block of its own); a shard has some ``SHARD`` postings, and the ranges
that wait have some ``CELLS`` cells, the newest going first beyond that. None leaves anything out.

Defined results: a null text has no term and is neither counted nor found; rows with one ``item_id``
are one item, a null one too; an item without terms, or none of them in a document, has no rows. A document is a row: rows
that repeat a ``doc_id`` rank each. A null ``doc_id`` comes before all others at equal score. Empty tables give an empty one. Further columns are ignored.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, documents_of, map_batches, small_batches

K1_PERCENT, B_PERCENT = 100, 90
MOST_TERMS = 200_000
SHARD = 1 << 20
CELLS = 4 << 20
RESULT = "item_id long, doc_id long, score long"
#: Every byte as it is read: letters and digits in lower case, bytes of other characters as they are, all else a blank.
_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str | bytes | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, only A-Z in lower case."""
    if text is None:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).translate(_BYTES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id`` and its distinct ``terms`` in order."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    each = map_batches(rows, lambda i, t: [i, [sorted(set(terms_of(x))) for x in t]], "item_id long, terms array<binary>", ["item_id", "terms"])
    return each.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` (all terms), ``terms`` (numbers of those in the vocabulary) and ``tfs`` of every document with a term."""
    schema = arrow_schema("doc_id long, n long, terms array<int>, tfs array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                terms = terms_of(text.as_py())
                if terms:
                    held = sorted((vocabulary[t], n) for t, n in Counter(terms).items() if t in vocabulary)
                    for c, v in zip(out, (doc, len(terms), [t for t, _ in held], [n for _, n in held]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    small_batches(docs.sparkSession)
    return documents_of(docs).where("text is not null").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def treap(impacts: list[int]) -> tuple[int, list[int], list[int]]:
    """Root, left and right children of the tree that is ordered by place and a heap by impact, ties to the earlier place; -1 is none."""
    left, right, spine = [-1] * len(impacts), [-1] * len(impacts), []
    for i, x in enumerate(impacts):
        below = -1
        while spine and impacts[spine[-1]] < x:
            below = spine.pop()
        left[i] = below
        if spine:
            right[spine[-1]] = i
        spine.append(i)
    return spine[0], left, right


class Shard:
    """Treaps of all terms of some documents in one arena of nodes, and the documents' own rows. The last node stands for none."""

    def __init__(self, ids: np.ndarray, n: list[int], sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, documents: int, total: int) -> None:
        order = np.argsort(ids, kind="stable")
        begin = np.concatenate([[0], np.cumsum(sizes)])
        at = _runs(begin[order], sizes[order])
        self.ids, sizes = ids[order], sizes[order]
        self.begin, self.terms = np.concatenate([[0], np.cumsum(sizes)]), terms[at]
        length = np.array([K1_PERCENT - B_PERCENT + B_PERCENT * int(n[i]) * documents // total for i in order], np.int64)
        place, tfs = np.repeat(np.arange(len(ids)), sizes), tfs[at]
        self.share = (1_000_000_000 * tfs) // (1000 * tfs + 8 * length[place])
        by_term = np.argsort(self.terms, kind="stable")
        self.place = np.append(place[by_term], -1).astype(np.int64)
        self.node_share = np.append(self.share[by_term], 0)
        term, first = np.unique(self.terms[by_term], return_index=True)
        self.root = {}
        self.left, self.right = np.full(len(by_term) + 1, -1, np.int64), np.full(len(by_term) + 1, -1, np.int64)
        for t, a, b in zip(term.tolist(), first.tolist(), [*first[1:].tolist(), len(by_term)], strict=True):
            root, left, right = treap(self.node_share[a:b].tolist())
            self.root[t] = a + root
            for own, side in ((self.left, left), (self.right, right)):
                side = np.array(side, np.int64)
                own[a:b] = np.where(side >= 0, side + a, -1)

    def within(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The root of what each subtree has in ``low`` <= place < ``high`` of its row: the first such node on the way down."""
        nodes = nodes.copy()
        flat, wide = nodes.ravel(), nodes.shape[1]
        at = np.flatnonzero(flat >= 0)
        while len(at):
            node = flat[at]
            place, row = self.place[node], at // wide
            above, below = place >= high[row], place < low[row]
            out = above | below
            at, node = at[out], np.where(above, self.left[node], self.right[node])[out]
            flat[at] = node
            at = at[node >= 0]
        return nodes

    def scores(self, places: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole scores of documents, by the terms of their own rows."""
        begin, size = self.begin[places], self.begin[places + 1] - self.begin[places]
        at = _runs(begin, size)
        parts = np.concatenate([[0], np.cumsum(weight[self.terms[at]] * self.share[at])])
        ends = np.cumsum(size)
        return parts[ends] - parts[ends - size]

    def search(self, terms: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Adds to an item's ``best`` all documents of the shard that belong there."""
        own = [t for t in terms.tolist() if t in self.root]
        if not own:
            return
        w = weight[own]
        wide, most = len(own), max(1, min(2048, (1 << 19) // len(own)))
        nodes, low, high = np.array([[self.root[t] for t in own]]), np.array([0]), np.array([len(self.ids)])
        bound = (self.node_share[nodes] * w).sum(1)
        while len(nodes):
            open_ = best.open(bound, self.ids[np.minimum(low, len(self.ids) - 1)])
            nodes, low, high, bound = nodes[open_], low[open_], high[open_], bound[open_]
            if not len(nodes):
                return
            take = np.arange(len(nodes)) >= len(nodes) - most
            if len(nodes) > most and len(nodes) * wide <= CELLS:
                take = np.zeros(len(nodes), bool)
                take[np.argpartition(bound, -most)[-most:]] = True
            now, a, b = nodes[take], low[take], high[take]
            row = np.arange(len(now))
            pivot = self.place[now[row, np.argmax(self.node_share[now] * w, 1)]]
            best.add(self.scores(pivot, weight), self.ids[pivot])
            more = np.concatenate([self.within(now, a, pivot), self.within(now, pivot + 1, b)])
            low, high = np.concatenate([low[~take], a, pivot + 1]), np.concatenate([high[~take], pivot, b])
            nodes, bound = np.concatenate([nodes[~take], more]), np.concatenate([bound[~take], (self.node_share[more] * w).sum(1)])


class Best:
    """The ``k`` highest scores above 0 so far, equal ones by the smaller id."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []

    def open(self, bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of some documents, by a bound of their scores and the least of their ids, may enter."""
        if len(self.rows) < self.k:
            return bounds > 0
        score, last = -self.rows[-1][0], self.rows[-1][1]
        return (bounds > score) | ((bounds == score) & (ids < last))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        may = self.open(scores, ids)
        for row in zip((-scores[may]).tolist(), ids[may].tolist(), strict=True):
            if len(self.rows) < self.k or row < self.rows[-1]:
                bisect.insort(self.rows, row)
                del self.rows[self.k :]


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of runs, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


#: Stands for a null id: before all others.
_NULL = -(1 << 63)


def _search(batches: Iterable[pa.RecordBatch], wanted: list[tuple], weight: np.ndarray, documents: int, total: int, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    best, held, size = [Best(k) for _ in wanted], [], 0

    def flush() -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        lists, tfs = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
        numbers = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
        shard = Shard(numbers(table.column("doc_id").fill_null(_NULL)), table.column("n").to_pylist(), np.diff(numbers(lists.offsets)), numbers(lists.flatten()), numbers(tfs.flatten()), documents, total)
        for (_, terms), b in zip(wanted, best, strict=True):
            own = np.zeros_like(weight)
            own[terms] = weight[terms]
            shard.search(terms, own, b)

    for batch in batches:
        held.append(batch)
        size += len(batch.column("terms").flatten()) + batch.num_rows
        if size >= SHARD:
            flush()
            held, size = [], 0
    if held:
        flush()
    rows = [(item, None if doc == _NULL else doc, -score) for (item, _), b in zip(wanted, best, strict=True) for score, doc in b.rows]
    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else ([], [], []), schema, strict=True)], schema=schema)


def _block(docs: DataFrame, items: list[tuple], k: int, scratch: Scratch) -> DataFrame | None:
    """The ``k`` best of each task and item of one block of items."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    found = scratch.keep(index(docs, vocabulary))
    documents, total = found.agg(F.count("*"), F.sum("n")).first()
    if not documents or not vocabulary:
        return None
    weight = np.zeros(len(vocabulary), np.int64)
    for term, df in found.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    wanted = [(item, np.array([vocabulary[t] for t in terms], np.int64)) for item, terms in items if terms]
    schema = arrow_schema(RESULT)
    return found.where(F.size("terms") > 0).mapInArrow(lambda batches: _search(batches, wanted, weight, documents, total, k, schema), RESULT)


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of each item's ``k`` best documents."""
    spark = docs.sparkSession
    scratch, parts, block, size = Scratch(spark, "search"), [], [], 0
    for item, terms in item_terms(items).toLocalIterator():
        if block and size + len(terms) > MOST_TERMS:
            parts.append(_block(docs, block, k, scratch))
            block, size = [], 0
        block.append((item, [bytes(t) for t in terms]))
        size += len(terms)
    if block:
        parts.append(_block(docs, block, k, scratch))
    found = None
    for p in parts:
        found = p if found is None else found if p is None else found.unionByName(p)
    if found is None:
        found = spark.createDataFrame([], RESULT)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: The same in DuckDB's SQL.
SQL = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL), d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL), s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM d),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM s) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total)))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d USING (doc_id), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10"""
