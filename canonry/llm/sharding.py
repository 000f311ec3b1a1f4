"""Sharding by histogram sort: splitters from exact counts, one exchange.

Rows are ordered by (hash of the text, doc_id), so equal texts lie next to each
other and yet a text that a third of all rows share can be cut between shards. Each
round counts the exact bytes below a few probe keys between the bounds known so far,
over all partitions, and narrows the bounds to the least and greatest key between two
probes, so that a repeated text leads straight to its ids; it ends when every splitter
is within ``tolerance`` of its target or has one row or key between its bounds. Then
all rows, with all their columns, are exchanged once.

A shard is cut into pieces by further splitters, so that no task sorts a whole
shard, and a row's ``slot`` is the rows of the pieces before its own plus its place.

Defined results: null text has no bytes but counts 16 like any row; a null id sorts
first; rows alike in text and id stay in one piece, in any order; input columns
named like a result are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name

OVERHEAD = 16  #: bytes a row counts besides its text
#: Columns of the table of keys, which holds nothing else.
_HASH, _ID = "__hash", "__id"
_SPAN = 1 << 64
_TOP = 1 << 63


def _keyed(docs: DataFrame, hash_: str = _HASH, id_: str = _ID) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.withColumns(
        {
            "size": (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long"),
            hash_: F.xxhash64(text),
            id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(-_TOP)),
        }
    )


def _as_bytes(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys as 16 bytes that compare like (hash, id)."""
    out = np.empty((len(hashes), 2), dtype=">u8")
    out[:, 0] = hashes.astype(np.uint64) + np.uint64(_TOP)
    out[:, 1] = ids.astype(np.uint64) + np.uint64(_TOP)
    return out.view("S16").ravel()


def _probe_bytes(keys: list[int]) -> np.ndarray:
    """Probes of 128 bits as such bytes. (The padding with zero bytes compares alike.)"""
    return np.array([k.to_bytes(16, "big") for k in keys], dtype="S16")


def _intervals(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Exact bytes and rows of each interval between probes that has any, and bounds of its keys (the upper one is past them)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, n = _probe_bytes(probes), len(probes) + 1
        size, rows = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        least, most = np.full((2, n), _TOP - 1, dtype=np.int64), np.full((2, n), -_TOP, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                both = b.column(0).to_numpy(), b.column(1).to_numpy()
                at = np.searchsorted(edges, _as_bytes(*both), side="right")
                size += np.bincount(at, weights=b.column(2).to_numpy(), minlength=n).astype(np.int64)
                rows += np.bincount(at, minlength=n)
                for i, values in enumerate(both):
                    np.minimum.at(least[i], at, values)
                    np.maximum.at(most[i], at, values)
        found = np.flatnonzero(rows)
        columns = [found.astype(np.int32), *(x[found] for x in (size, rows, *least, *most))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["at", "size", "rows", "h0", "i0", "h1", "i1"])

    parts = keys.select(_HASH, _ID, "size").mapInArrow(partial, "at int, size long, rows long, h0 long, i0 long, h1 long, i1 long")
    out = {}
    for r in parts.groupBy("at").agg(*(F.sum(c).alias(c) for c in ("size", "rows")), *(F.min(c).alias(c) for c in ("h0", "i0")), *(F.max(c).alias(c) for c in ("h1", "i1"))).collect():
        # Ids bound the keys only where all of an interval's rows have one hash.
        one = r["h0"] == r["h1"]
        low, high = ((r["h0"] + _TOP) * _SPAN + (r["i0"] + _TOP) * one, (r["h1"] + _TOP) * _SPAN + (r["i1"] + _TOP if one else _SPAN - 1) + 1)
        out[r["at"]] = (r["size"], r["rows"], low, high)
    return out


def counts_below(keys: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows below each probe, and of all rows."""
    found = _intervals(keys, probes)
    return tuple(list(np.cumsum([found.get(at, (0, 0))[i] for at in range(len(probes) + 1)])) for i in (0, 1))


def find_splitters(keys: DataFrame, total: int, parts: int, tolerance: float, fan: int = 4) -> tuple[list[int], list[int]]:
    """Keys that cut ``total`` bytes into ``parts`` of like size, and the rows below each.

    A splitter is settled when the bytes below it are within ``tolerance`` parts of
    the target, or when its bounds have a single row between: then it lies on the
    nearer side of that row. Bounds come at least twice as near each round, so that
    rounds are 128 at most.
    """
    targets = [total * i // parts for i in range(1, parts)]
    known: dict[int, tuple[int, int]] = {0: (0, 0)}
    end = _SPAN * _SPAN - 1
    order: list[int] = [0]
    # Hashes are spread evenly but for repeated texts, so the first probes are at the targets themselves.
    asked = sorted({min(end, max(1, end * t // max(1, total))) for t in targets} | {end})
    allowed = tolerance * total / parts
    while True:
        if asked:
            found, below_size, below_rows = _intervals(keys, asked), 0, 0
            for at, k in enumerate([*asked, end]):
                size, rows, low, high = found.get(at, (0, 0, k, k))
                known.setdefault(low, (below_size, below_rows))
                below_size, below_rows = below_size + size, below_rows + rows
                known.setdefault(min(end, high), (below_size, below_rows))
                known.setdefault(k, (below_size, below_rows))
            order = sorted(known)
        below = [known[k][0] for k in order]
        asked_now: set[int] = set()
        splitters = []
        for t in targets:
            i = max(1, min(len(order) - 1, bisect.bisect_left(below, t)))
            low, high = order[i - 1], order[i]
            best = min((low, high), key=lambda k: abs(known[k][0] - t))
            splitters.append(best)
            if abs(known[best][0] - t) > allowed and high - low > 1 and known[high][1] - known[low][1] > 1:
                span = max(1, known[high][0] - known[low][0])
                likely = low + (high - low) * (t - known[low][0]) // span
                near = max(1, (high - low) // 64)
                asked_now |= {k for k in (likely, likely - near, likely + near, *(low + (high - low) * j // fan for j in range(1, fan))) if low < k < high}
        if not asked_now:
            break
        asked = sorted(asked_now)
    return splitters, [known[k][1] for k in splitters]


def shard(docs: DataFrame, shards: int = 40, piece_bytes: int = 64 << 20, least_pieces: int = 4, most_pieces: int = 256, tolerance: float = 0.02) -> DataFrame:
    """``docs`` with ``size``, ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    ``tolerance`` is in pieces. The driver holds at most ``shards * most_pieces`` splitters.
    """
    hash_, id_, piece = (free_name(docs, x) for x in ("hash", "id", "piece"))
    keyed = _keyed(docs, hash_, id_)
    keys = Scratch(docs.sparkSession, "sharding").keep(keyed.select(F.col(hash_).alias(_HASH), F.col(id_).alias(_ID), "size"))
    total = keys.agg(F.sum("size")).first()[0] or 0
    each = max(least_pieces, min(most_pieces, -(-total // (shards * piece_bytes))))
    splitters, rows_below = find_splitters(keys, total, shards * each, tolerance) if total else ([0] * (shards * each - 1), [0] * (shards * each - 1))
    starts = [0, *rows_below]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _probe_bytes(splitters)
        for b in batches:
            at = np.searchsorted(edges, _as_bytes(b.column(hash_).to_numpy(), b.column(id_).to_numpy()), side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=[*b.schema.names, piece])

    from pyspark.sql import Window
    from pyspark.sql.types import IntegerType, StructField, StructType

    from .common import small_batches

    small_batches(docs.sparkSession)
    kept = keyed.select(*(c for c in keyed.columns if c.lower() not in ("shard", "slot")))
    placed = kept.mapInArrow(place, StructType([*kept.schema.fields, StructField(piece, IntegerType())]))
    #: The one exchange: by piece.
    place_in_piece = F.row_number().over(Window.partitionBy(piece).orderBy(hash_, id_))
    begins = F.array(*(F.lit(int(starts[p] - starts[p - p % each])).cast("long") for p in range(shards * each)))
    return placed.withColumn("slot", begins[F.col(piece)] + place_in_piece - 1).withColumn("shard", F.floor(F.col(piece) / each).cast("int")).drop(hash_, id_, piece)


def digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Where each document goes, by the law ``bytes``: shards of nearly equal size."""
    return shard(docs.select("doc_id", "text"), shards).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
