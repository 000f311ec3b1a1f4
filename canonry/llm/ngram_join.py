"""N-gram Jaccard self-join by vertical partitioning, and its connected components.

A document's set holds its distinct word n-grams; two link when the Jaccard
similarity of their sets reaches a threshold, tested on whole numbers. One global
order of n-grams (by hash) is cut into fragments:

1. The first fragment of a set is as long as the n-grams that a linked partner may
   lack, and ``extra`` more. So at least about ``extra`` of it are shared with that
   partner; sets with fewer shared n-grams in it link with nothing and are done.
2. Among the rest, n-grams are counted and ordered anew, rarest first. Linked sets
   share one of the first n-grams by that order. Of the sets that share one, the
   first is the hub and the others are its spokes.
3. Hubs and spokes are cut into fragments of the global order, and dealt out by hub
   and fragment: each gives the partial overlaps of its spokes with the hub, which are
   summed per pair and tested. A hub with many spokes meets them in several sides.
4. Spokes of one hub that these links leave in different components meet each other,
   in blocks of some ``BLOCK`` sets of like size; blocks of one component don't meet.
   They are dealt out by pair of blocks and fragment, and partial overlaps summed per
   pair again. Only a spanning forest of the links leaves a task, never the pairs.

Equal sets count once throughout, and near copies of one text mostly link with its
hub, so that they need not meet each other. Every step is exact: sketches and hashes
only choose an order or skip work that cannot yield a link. (N-grams and sets are told
apart by 64-bit hashes.)

Defined results: a document with fewer words than ``width`` has one n-gram, all its
words; without words, or with a null text, it has none and links with nothing; a
null id takes part, but is no component's name unless no other is there; repeated
rows are copies; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents_of, small_batches

MEMO_WORDS = 200_000
BLOCK = 256  #: sets of one block
SIDE = 512  #: about how many spokes of a hub come together
FRAGMENT = 1_000_000  #: about how many n-grams come together in one fragment of a hub or of a pair of blocks
HEAVY_HERE, HEAVY_MOST = 32, 100_000  #: times in one task that make an n-gram a candidate for the heavy ones; how many of those are held
SKETCH_BITS = 22  #: log2 of the most cells of the sketch of frequencies
BITMAP_BITS = 24  #: log2 of the most bits of the filter of documents
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


class Shingler:
    """Sets of hashed n-grams of ``width`` words, sorted by hash."""

    def __init__(self, width: int) -> None:
        self.width, self.memo = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        try:
            hashes = np.array([memo[w] for w in words], dtype=np.uint64)
        except KeyError:
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            hashes = np.array([memo[w] for w in words], dtype=np.uint64)
        n = len(hashes) - self.width + 1
        if n < 1:
            return np.array([xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=1)], dtype=np.uint64)
        gram = hashes[:n] * _ODD[0]
        for k in range(1, self.width):
            gram += hashes[k : k + n] * (_ODD[k % len(_ODD)] * np.uint64(2 * (k // len(_ODD)) + 1))
        gram ^= gram >> np.uint64(29)
        gram *= _ODD[1]
        gram ^= gram >> np.uint64(32)
        return np.unique(gram)


def lacking(n: int, percent: int) -> int:
    """The most n-grams of a set of ``n`` that a linked partner may lack."""
    return n - -(-percent * n // 100)


def _list_column(rows: list[np.ndarray | None]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([0 if r is None else len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate([r for r in rows if r is not None and len(r)] or [np.zeros(0, dtype=np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([r is None for r in rows], pa.bool_()))


def _lists(column) -> Iterator[np.ndarray]:
    """The lists of a column of 64-bit numbers, unsigned."""
    values, offsets = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield values[a:b]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def describe(docs: DataFrame, width: int, percent: int, extra: float) -> DataFrame:
    """``doc_id``, ``n``, ``sig`` (the set's hash; null if empty) and the set's first fragment, once for equal sets of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(width), set()
        for b in batches:
            sizes, sigs, first = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle(t)
                sig = xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else None
                sizes.append(len(s))
                sigs.append(None if sig is None else sig - (sig >> 63 << 64))
                new = sig is not None and sig not in seen
                first.append(s[: lacking(len(s), percent) + max(1, int(extra * len(s)))] if new else None)
                if new:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(sig)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), _list_column(first)], names=["doc_id", "n", "sig", "first"])

    return documents_of(docs).mapInArrow(run, "doc_id long, n long, sig long, first array<long>")


def _heavy(described: DataFrame) -> np.ndarray:
    """The most frequent n-grams of first fragments, at most ``HEAVY_MOST``; all of them are in several sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def frequent():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            own = n >= HEAVY_HERE
            return pa.RecordBatch.from_arrays([_signed(grams[own]), pa.array(n[own])], names=["gram", "n"])

        for b in batches:
            held.append(b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(held[-1])
            if size > 4_000_000:
                yield frequent()
                held, size = [], 0
        if held:
            yield frequent()

    rows = described.where("first is not null").select("first").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(HEAVY_MOST).toArrow()
    return np.sort(rows.column("gram").to_numpy().view(np.uint64))


def _member(grams: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(grams), dtype=bool)
    return of[np.minimum(np.searchsorted(of, grams), len(of) - 1)] == grams


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (gram, sig) sorted: how many n-grams of a set are also in another. Keeps one row between batches, however long a list."""
    last = None  # gram, sig, whether that row is counted already
    for b in batches:
        gram, sig = b.column(0).to_numpy(), b.column(1).to_numpy()
        counted = np.zeros(len(gram), dtype=bool)
        if last is not None and len(gram) and gram[0] == last[0]:
            gram, sig, counted = np.r_[last[0], gram], np.r_[last[1], sig], np.r_[last[2], counted]
        if not len(gram):
            continue
        new = np.r_[True, (gram[1:] != gram[:-1]) | (sig[1:] != sig[:-1])]
        gram, sig, counted = gram[new], sig[new], counted[new]
        start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        length = np.diff(np.r_[start, len(gram)])
        several = np.repeat((length > 1) | counted[start], length)
        nodes, hits = np.unique(sig[several & ~counted], return_counts=True)
        last = (gram[-1], sig[-1], bool(several[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(hits)], names=["sig", "hits"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (gram, place, sig) sorted: each set of a list with the list's first, and whether the list has more than these two."""
    last = None  # gram, the list's first and second
    for b in batches:
        gram, sig = b.column(0).to_numpy(), b.column(2).to_numpy()
        if not len(gram):
            continue
        if last is not None and gram[0] == last[0]:
            gram, sig = np.r_[[last[0]] * len(last[1]), gram], np.r_[last[1], sig]
        start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        length = np.diff(np.r_[start, len(gram)])
        last = (gram[-1], sig[start[-1] : start[-1] + 2])
        spoke = np.ones(len(gram), dtype=bool)
        spoke[start] = False
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sig[start], length)[spoke]), pa.array(sig[spoke]), pa.array(np.repeat(length > 2, length)[spoke])], names=["a", "b", "more"])


def survivors(described: DataFrame, scratch: Scratch, percent: int, extra: float) -> DataFrame:
    """``sig`` of the sets that share enough of their first fragment with other sets."""
    heavy = _heavy(described)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sigs = np.repeat(b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy())
            rest = ~_member(grams, heavy)
            yield pa.RecordBatch.from_arrays([_signed(grams[rest]), pa.array(sigs[rest])], names=["gram", "sig"])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [int(_member(g, heavy).sum()) for g in _lists(b.column(2))]
            #: A partner has at least percent / 100 of this set's n-grams, and so a first fragment that much shorter at most.
            need = [max(1, int(extra * (percent * n // 100)) - 1) for n in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.int64()), pa.array(need, pa.int64())], names=["sig", "hits", "need"])

    own = described.where("first is not null")
    lists = own.select("sig", "first").mapInArrow(split, "gram long, sig long")
    found = lists.repartition("gram").sortWithinPartitions("gram", "sig").mapInArrow(_shared, "sig long, hits long").select("sig", "hits", F.lit(0).cast("long").alias("heavy"), F.lit(0).cast("long").alias("need"))
    start = own.select("sig", "n", "first").mapInArrow(known, "sig long, hits long, need long").select("sig", F.lit(0).cast("long").alias("hits"), F.col("hits").alias("heavy"), "need")
    counted = found.unionByName(start).groupBy("sig").agg(F.sum("hits").alias("hits"), F.max("heavy").alias("heavy"), F.max("need").alias("need"))
    return scratch.keep(counted.where("hits + heavy >= need").select("sig"))


def full_sets(docs: DataFrame, slim: DataFrame, alive: DataFrame, count: int, scratch: Scratch, width: int) -> DataFrame:
    """``sig``, ``grams``: the whole sets of the survivors. Other texts are skipped by a bitmap of hashed ids of fixed size."""
    bits = min(BITMAP_BITS, max(16, math.ceil(math.log2(8 * count + 1))))
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).cast("int")
    ids = slim.where("new").join(alive, "sig").select(cell.alias("cell"))
    words = ids.groupBy(F.shiftright("cell", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cell & 31)")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << bits >> 5, dtype=np.uint32)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for b in batches:
            at = b.column(0).to_numpy()
            rows = np.flatnonzero(bitmap[at >> 5] >> (at & 31).astype(np.uint32) & 1)
            sets = [s for t in b.column(1).take(pa.array(rows)).to_pylist() if len(s := shingle(t))]
            sigs = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([_signed(sigs), _list_column(sets)], names=["sig", "grams"])

    sets = documents_of(docs).select(cell.alias("cell"), "text").mapInArrow(run, "sig long, grams array<long>")
    return scratch.keep(sets.join(alive, "sig", "left_semi").groupBy("sig").agg(F.any_value("grams").alias("grams")))


def _frequency_classes(sets: DataFrame, grams: int) -> np.ndarray:
    """A class of frequency (logarithm, at least the true one) for each cell of hashed n-grams; 0: in one set alone."""
    bits = min(SKETCH_BITS, max(12, math.ceil(math.log2(2 * grams + 1))))
    cells, block = 1 << bits, 1 << 12

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, dtype=np.uint32)
        for b in batches:
            found, n = np.unique(b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits), return_counts=True)
            counts[found.astype(np.int64)] += n.astype(np.uint32)
        rows = counts.reshape(-1, block)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([rows[i].tobytes() for i in used], pa.binary())], names=["block", "counts"])

    def total(key, table):
        sums = np.zeros(block, dtype=np.int64)
        for x in table.column("counts"):
            sums += np.frombuffer(x.as_buffer(), dtype=np.uint32)
        classes = np.minimum(255, np.ceil(8 * np.log2(np.maximum(1, sums)))).astype(np.uint8)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "classes": pa.array([classes.tobytes()], pa.binary())})

    rows = sets.select("grams").mapInArrow(partial, "block int, counts binary").groupBy("block").applyInArrow(total, "block int, classes binary").toArrow()
    out = np.zeros(cells, dtype=np.uint8)
    for i, x in zip(rows.column("block").to_pylist(), rows.column("classes"), strict=True):
        out[i * block : (i + 1) * block] = np.frombuffer(x.as_buffer(), dtype=np.uint8)
    return out


def candidate_stars(sets: DataFrame, grams: int, percent: int) -> DataFrame:
    """``a``, ``b``, ``more``: sets that share one of their rarest n-grams, as stars: all of a list with one of it; ``more`` if a list has further ones."""
    classes = _frequency_classes(sets, grams)
    shift = np.uint64(64 - int(math.log2(len(classes))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, places, sigs = [], [], []
            for sig, s in zip(b.column(0).to_pylist(), _lists(b.column(1)), strict=True):
                c = classes[(s >> shift).astype(np.int64)]
                order = np.argsort(c, kind="stable")[: lacking(len(s), percent) + 1]
                own = c[order] > 0  # others are in no other set
                found.append(s[order[own]])
                places.append(np.flatnonzero(own))
                sigs.append(np.full(int(own.sum()), sig, dtype=np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found)), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(sigs))], names=["gram", "place", "sig"])

    lists = sets.select("sig", "grams").mapInArrow(run, "gram long, place int, sig long")
    return lists.repartition("gram").sortWithinPartitions("gram", "place", "sig").mapInArrow(_stars, "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node``, ``root`` (the smallest) of every node of ``edges`` (``a``, ``b``), by alternating large and small stars."""
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.keep(small)
        state = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(now)
        now = after
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state


def cut(sets: DataFrame, group: str) -> DataFrame:
    """``group``, ``fragment``, ``sig``, ``side``, ``n`` and the grams of that fragment, from whole sets with the ``bits`` of their fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, n = b.column("grams").flatten().to_numpy(zero_copy_only=False), b.column("n").to_numpy()
            if not len(grams):
                continue
            row = np.repeat(np.arange(len(n)), n)
            fragment = (grams.view(np.uint64) >> (64 - b.column("bits").to_numpy().astype(np.uint64))[row]).astype(np.int32)
            start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (fragment[1:] != fragment[:-1])])
            rows = pa.array(row[start])
            parts = pa.ListArray.from_arrays(pa.array(np.r_[start, len(grams)].astype(np.int32)), pa.array(grams))
            yield pa.RecordBatch.from_arrays([b.column(group).take(rows), pa.array(fragment[start]), b.column("sig").take(rows), b.column("side").take(rows), b.column("n").take(rows), parts], names=[group, "fragment", "sig", "side", "n", "grams"])

    return sets.select(group, "sig", "side", F.size("grams").cast("long").alias("n"), "bits", "grams").mapInArrow(run, f"{group} long, fragment int, sig long, side long, n long, grams array<long>")


def _bits(grams) -> F.Column:
    """How many bits of a hash tell the fragments apart, for so many n-grams; at least one."""
    return F.least(F.lit(20), F.greatest(F.lit(1), F.ceil(F.log2(grams / FRAGMENT)))).cast("long")


def _spokes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (a, fragment, sig, side, n, grams) sorted by hub, side and fragment, hub first: partial overlaps with the hub. Keeps one hub's part between batches."""
    held = None  # hub, side and fragment, its part, its n
    for b in batches:
        if not b.num_rows:
            continue
        hub, fragment, sig, side, n = (b.column(i).to_numpy() for i in range(5))
        parts = list(_lists(b.column(5)))
        start = np.r_[np.flatnonzero(np.r_[True, (hub[1:] != hub[:-1]) | (side[1:] != side[:-1]) | (fragment[1:] != fragment[:-1])]), len(hub)]
        rows, overlaps, own = [], [], []
        for i, j in zip(start[:-1], start[1:], strict=True):
            if sig[i] == hub[i]:
                held, i = ((hub[i], side[i], fragment[i]), parts[i], n[i]), i + 1
            elif held is None or held[0] != (hub[i], side[i], fragment[i]):
                continue  # the hub has nothing in this fragment
            if i < j:
                common = _member(np.concatenate(parts[i:j]), held[1])
                found = np.add.reduceat(common.astype(np.int64), np.r_[0, np.cumsum([len(x) for x in parts[i : j - 1]])].astype(np.int64))
                some = np.flatnonzero(found)
                rows.append(some + i)
                overlaps.append(found[some])
                own.append(np.full(len(some), held[2]))
        if rows:
            at = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(hub[at]), pa.array(sig[at]), pa.array(np.concatenate(overlaps)), pa.array(np.concatenate(own)), pa.array(n[at])], names=["a", "b", "overlap", "n_a", "n_b"])


def hub_links(sets: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b``: the links of hubs with their spokes; partial overlaps are counted by fragment and summed per pair."""
    size = sets.select("sig", F.size("grams").alias("n"))
    spokes = stars.select("a", F.col("b").alias("sig")).join(size, "sig")
    sized = spokes.groupBy("a").agg(F.sum("n").alias("all"), F.ceil(F.count("*") / SIDE).alias("sides"))
    placed = spokes.join(sized, "a").select("a", "sig", F.pmod(F.xxhash64("sig", F.lit(8)), F.col("sides")).alias("side"), _bits(F.col("all")).alias("bits"))
    hubs = sized.select("a", F.col("a").alias("sig"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)).alias("side"), _bits(F.col("all")).alias("bits"))
    #: A hub meets each side of its spokes in a task of its own, so that no hub, however many spokes it has, is one task.
    parts = cut(sets.join(placed.unionByName(hubs), "sig"), "a").repartition("a", "side", "fragment").sortWithinPartitions("a", "side", "fragment", F.col("sig") != F.col("a"))
    counted = parts.mapInArrow(_spokes, "a long, b long, overlap long, n_a long, n_b long")
    summed = counted.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    return summed.where(100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b")


def _overlaps(key: tuple, table: pa.Table) -> pa.Table:
    """The sets of one pair of blocks in one fragment, and the partial overlaps that aren't 0 of those that meet."""
    side, comp = table.column("side").to_numpy() & 3, table.column("side").to_numpy() >> 2
    parts = list(_lists(table.column("grams").combine_chunks()))
    grams, where = np.unique(np.concatenate(parts), return_inverse=True)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    common = (np.bincount(where) > 1)[where]
    where, owner = np.unique(where[common], return_inverse=True)[1], owner[common]
    overlap = np.zeros((len(parts), len(parts)), dtype=np.float32)
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    for at in range(0, int(where[-1]) + 1 if len(where) else 0, 4096):  # of products of matrices that fit in a cache
        a, b = np.searchsorted(where, [at, at + 4096])
        x = np.zeros((len(parts), 4096), dtype=np.float32)
        x[owner[a:b], where[a:b] - at] = 1
        overlap += x @ x.T
    meets = (comp[:, None] != comp[None, :]) & ((side[:, None] == 2) | (side[:, None] != side[None, :]))
    i, j = np.nonzero(np.triu(overlap, 1) * meets)
    used, at = np.unique(np.r_[i, j], return_inverse=True)
    as_list = lambda x, kind: pa.array([x], pa.list_(kind))
    return pa.table({"met": pa.array([key[0].as_py()]), "sig": as_list(table.column("sig").to_numpy()[used], pa.int64()), "n": as_list(table.column("n").to_numpy()[used], pa.int64()), "i": as_list(at[: len(i)].astype(np.int32), pa.int32()), "j": as_list(at[len(i) :].astype(np.int32), pa.int32()), "overlap": as_list(overlap[i, j].astype(np.int32), pa.int32())})


def _summed(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Sums the partial overlaps of one pair of blocks over its fragments, per pair of sets; a spanning forest of the links."""
        flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        sig, first, where = np.unique(flat("sig"), return_index=True, return_inverse=True)
        n = flat("n")[first]
        begin = np.repeat(np.r_[0, np.cumsum(table.column("sig").combine_chunks().value_lengths().to_numpy())[:-1]], table.column("i").combine_chunks().value_lengths().to_numpy())
        a, b = where[begin + flat("i")], where[begin + flat("j")]
        pair, at = np.unique(np.minimum(a, b) * len(sig) + np.maximum(a, b), return_inverse=True)
        overlap = np.bincount(at, weights=flat("overlap"), minlength=len(pair)).astype(np.int64)
        a, b = pair // max(1, len(sig)), pair % max(1, len(sig))
        linked = 100 * overlap >= percent * (n[a] + n[b] - overlap)
        parent = list(range(len(sig)))

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for x, y in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
            u, v = find(x), find(y)
            if u != v:
                parent[u] = v
                out.append((x, y))
        found = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": sig[found[:, 0]], "b": sig[found[:, 1]]})

    return run


def rim_links(sets: DataFrame, stars: DataFrame, roots: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """``a``, ``b``: links among spokes of one hub that are in different components (``node``, ``root``) so far; a spanning forest for each pair of blocks."""
    of = lambda column: roots.select(F.col("node").alias(column), F.col("root").alias(f"of_{column}"))
    rims = stars.where("more").join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", F.col("b").alias("sig"), F.coalesce("of_a", "a").alias("hub_comp"), F.coalesce("of_b", "b").alias("comp"))
    #: A hub whose spokes are all of its component has nothing left to link.
    open_hubs = rims.groupBy("a").agg(F.max(F.col("comp") != F.col("hub_comp")).alias("open")).where("open").select("a")
    #: Linked sets are of the same class of size or of neighbouring ones: a class is a hair wider than they can differ.
    kind = F.floor(F.log(F.size("grams").cast("double")) / (math.log(100 / percent) * (1 + 1e-9))).cast("long") if percent < 100 else F.size("grams").cast("long")
    members = scratch.keep(rims.join(open_hubs, "a").join(sets.select("sig", kind.alias("kind")), "sig").select("a", "sig", "comp", "kind"))
    if members.isEmpty():
        return None
    large = members.groupBy("a", "kind", "comp").agg(F.count("*").alias("rows")).where(F.col("rows") >= BLOCK).select("a", "kind", "comp", F.col("comp").alias("of"))
    members = members.join(large, ["a", "kind", "comp"], "left").withColumn("of", F.coalesce("of", F.lit(0)))
    counted = members.groupBy("a", "kind", "of").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    families = scratch.keep(counted.withColumn("family", F.xxhash64("kind", "of")))
    left, right = (families.select("a", *(F.col(c).alias(f"{c}_{k}") for c in ("kind", "of", "blocks", "family"))) for k in (1, 2))
    met = (
        left.join(right, "a")
        .where("kind_2 - kind_1 between 0 and 1 and (kind_1 < kind_2 or family_1 <= family_2) and (of_1 <> of_2 or of_1 = 0)")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks_1") - 1)))
        .withColumn("j", F.explode(F.sequence(F.when(F.col("family_1") == F.col("family_2"), F.col("i")).otherwise(0), F.col("blocks_2") - 1)))
        .withColumn("met", F.xxhash64("a", "family_1", "i", "family_2", "j"))
        #: A block's sets have at most so many n-grams, by their class of size.
        .withColumn("bits", _bits(F.lit(2.0 * BLOCK) * (F.pow(F.lit(100 / percent), F.col("kind_2") + 1) if percent < 100 else F.col("kind_2"))))
    )
    same = (F.col("family_1") == F.col("family_2")) & (F.col("i") == F.col("j"))
    sides = met.select("a", F.col("family_1").alias("family"), F.col("i").alias("block"), "met", "bits", F.when(same, 2).otherwise(0).alias("role")).unionByName(
        met.where(~same).select("a", F.col("family_2").alias("family"), F.col("j").alias("block"), "met", "bits", F.lit(1).alias("role"))
    )
    placed = members.join(counted, ["a", "kind", "of"]).select("a", "sig", "comp", F.xxhash64("kind", "of").alias("family"), F.pmod(F.xxhash64("sig", F.lit(6)), F.col("blocks")).cast("int").alias("block"))
    #: The role and the component travel as one number; 62 bits of the component's hash tell components apart within a pair of blocks.
    dealt = placed.join(sides, ["a", "family", "block"]).select("met", "sig", "bits", (F.shiftleft(F.xxhash64("comp"), 2) + F.col("role")).alias("side"))
    partial = cut(sets.join(dealt, "sig"), "met").groupBy("met", "fragment").applyInArrow(_overlaps, "met long, sig array<long>, n array<long>, i array<int>, j array<int>, overlap array<int>")
    return partial.groupBy("met").applyInArrow(_summed(percent), "a long, b long")


def join(docs: DataFrame, width: int = 4, percent: int = 85, extra: float = 0.1) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``: the smallest id that links lead to. One row for each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "ngram-join")
    described = scratch.keep(describe(docs, width, percent, extra))
    alive = survivors(described, scratch, percent, extra)
    slim = scratch.keep(described.select("doc_id", "n", "sig", F.col("first").isNotNull().alias("new")))
    scratch.drop(described)
    sets = full_sets(docs, slim, alive, alive.count(), scratch, width)
    grams = sets.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    stars = scratch.keep(candidate_stars(sets, grams, percent))
    linked = scratch.keep(components(hub_links(sets, stars, percent), scratch))
    further = rim_links(sets, stars, linked, percent, scratch)
    if further is not None:
        further = scratch.keep(further)
        if not further.isEmpty():
            linked = scratch.keep(components(further.unionByName(linked.select(F.col("node").alias("a"), F.col("root").alias("b"))), scratch))
    #: Copies by their set, sets by their root; a set of which there is no link is its own root.
    copies = slim.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"))
    rooted = copies.join(linked.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "least", F.coalesce("root", "sig").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("sig", "component_id")
    return slim.select("doc_id", "n", "sig").join(named, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
