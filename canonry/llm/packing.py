"""Best-fit packing with certified bin counts.

Pieces of at most ``capacity`` tokens are dealt to parts of bounded size, and each
part is packed by best-fit decreasing. A part's bin count is certified by lower
bounds from dual-feasible functions: a part whose count equals its bound cannot be
packed better. Parts with a gap hand over the pieces of their emptiest bins,
``RELEASED`` bins for each bin of the gap; those pieces are dealt out anew, to fewer
parts, and packed again. The rounds end when no part has a gap, when the bound of all
pieces together certifies the total, when one part holds all that is open, or when a
round saved no bin.

Defined results: null text counts as empty and has the end token alone; a document
longer than ``capacity`` is cut into pieces of ``capacity``, the last may be
shorter; repeated rows are packed each; a null id is kept; other columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import unsure_characters, vocabulary
from .common import Scratch, documents_of, map_batches

RELEASED = 8  #: bins that a part opens for each bin above its bound
PIECE_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of packed ids."""
    n = len(ids) // 4
    return [(k, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * min(n, at + capacity)])) for k, at in enumerate(range(0, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of every document's ids, an ``end_id`` added."""
    unsure, end = unsure_characters(path), end_id.to_bytes(4, "little")

    def run(ids, texts):
        encode = vocabulary(path, unsure, False).encode
        rows = [(i, *p) for i, t in zip(ids, texts, strict=True) for p in cut(encode(t or "") + end, capacity)]
        return list(zip(*rows, strict=True))

    return map_batches(documents_of(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long", PIECE_COLUMNS)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill. An item goes into the fullest bin that takes it.

    Bins are stacked by the space they have left; a bit of ``spaces`` is set where a
    stack isn't empty, so the best fit is the lowest bit from the item's length on.
    """
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    fill: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = spaces >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            b = stacks[left].pop()
            if not stacks[left]:
                spaces &= ~(1 << left)
        else:
            left, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        stacks[left - size].append(b)
        spaces |= 1 << (left - size)
    return bins, offsets, np.array(fill, dtype=np.int64)


def lower_bound(lengths: np.ndarray | None, capacity: int, count: np.ndarray | None = None) -> int:
    """The best bound of two families of dual-feasible functions on the number of bins, of the lengths or their ``count``."""
    if count is None:
        count = np.bincount(lengths, minlength=capacity + 1)
    if not count.any():
        return 0
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    # Items over capacity - e count as a whole bin, items under e as nothing, for each e up to half.
    whole, mass = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    e = np.arange(0, capacity // 2 + 1)
    large = whole[-1] - whole[capacity - e + 1]
    middle = mass[capacity - e + 1] - mass[e]
    best = max(best, int((-(-(large * capacity + middle) // capacity)).max()))
    # Rounding: x with (k + 1) x / capacity no whole number counts as its floor over k.
    for k in range(1, 33):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _pack_part(capacity: int, number: int):
    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("length", "descending"), ("row", "ascending")])
        lengths = part.column("length").to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        gap = len(fill) - lower_bound(lengths, capacity)
        given = np.zeros(len(fill), dtype=bool)
        given[np.argsort(fill, kind="stable")[: RELEASED * gap]] = True
        first = (number << 56) + (key[0].as_py() << 28)
        return pa.table({"row": part.column("row"), "length": lengths, "sequence_id": first + bins, "offset": offsets, "open": given[bins]})

    return run


def bound_of(items: DataFrame, capacity: int) -> int:
    """The lower bound of all items together, from how often each length occurs."""
    found = items.groupBy("length").agg(F.count("*").alias("n")).toArrow()
    return lower_bound(None, capacity, np.bincount(found.column("length").to_numpy(), weights=found.column("n").to_numpy(), minlength=capacity + 1).astype(np.int64))


def pack(items: DataFrame, capacity: int = 2048, part_rows: int = 100_000, scratch: Scratch | None = None) -> DataFrame:
    """Packs ``row`` (unique long), ``length`` (1 to ``capacity``): ``row``, ``sequence_id``, ``offset``.

    ``part_rows`` is about how many pieces a part holds. Each round deals the open
    pieces out by another hash, so parts with gaps exchange them.
    """
    scratch = scratch or Scratch(items.sparkSession, "packing")
    schema = "row long, length long, sequence_id long, offset long, open boolean"
    settled, waiting, number = [], items.select("row", F.col("length").cast("long").alias("length")), 0
    rows, least = waiting.count(), bound_of(waiting, capacity)
    closed, before, came = 0, None, None  # bins settled for good; bins that the waiting pieces came from, and their places there
    while True:
        parts = max(1, -(-rows // part_rows))
        dealt = waiting.withColumn("part", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(parts)))
        packed = scratch.keep(dealt.groupBy("part").applyInArrow(_pack_part(capacity, number), schema))
        #: Offset 0 stands once in each bin.
        bins = {r.open: r for r in packed.groupBy("open").agg(F.sum((F.col("offset") == 0).cast("long")).alias("bins"), F.count("*").alias("rows")).collect()}
        still, shut = bins.get(True), bins[False].bins if False in bins else 0
        made = shut + (still.bins if still else 0)
        if parts == 1 or not still or closed + made <= least or (before is not None and made >= before):
            settled.append(came if before is not None and made > before else packed.select("row", "sequence_id", "offset"))
            break
        settled.append(packed.where("not open").select("row", "sequence_id", "offset"))
        waiting, came = packed.where("open").select("row", "length"), packed.where("open").select("row", "sequence_id", "offset")
        rows, number, closed, before = still.rows, number + 1, closed + shut, still.bins
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Cuts, then packs every document: one row a piece with its place."""
    scratch = Scratch(docs.sparkSession, "packing")
    numbered = scratch.keep(pieces(docs, path, capacity).withColumn("row", F.monotonically_increasing_id()))
    placed = pack(numbered, capacity, scratch=scratch)
    return numbered.join(placed, "row").select(*PIECE_COLUMNS, "sequence_id", "offset")
