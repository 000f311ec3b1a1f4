"""Structured Streaming over event logs: windows, sessions, first occurrences, guarded transitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Event files as a stream; ``ts`` becomes a timestamp that watermarks accept."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, by: list[str], width: str, late: str) -> DataFrame:
    """Events a window and key; those later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n")).select("window.start", "window.end", *by, "n")


def sessions(events: DataFrame, by: list[str], gap: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *by).agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", *by, "n")


def first_occurrences(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def guarded(events: DataFrame, id_: str, steps: dict[str, list[str]], start: str) -> DataFrame:
    """Requested transitions (``id_`` string, ``to_status``, ``seq``) with ``from_status`` and whether each was allowed; the state follows allowed ones only.

    State is one status a key. Requests of a batch are applied in order of ``seq``.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, rows = (state.get[0] if state.exists else None), []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            ok = r.to_status == start if now is None else r.to_status in steps.get(now, ())
            rows.append((key[0], int(r.seq), now, r.to_status, bool(ok)))
            now = r.to_status if ok else now
        if now is not None:
            state.update((now,))
        yield pd.DataFrame(rows, columns=[id_, "seq", "from_status", "to_status", "allowed"])

    return events.groupBy(id_).applyInPandasWithState(run, f"{id_} string, seq long, from_status string, to_status string, allowed boolean", "status string", "append", "NoTimeout")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class _Bands:
    """Images of one key so far, found again by the bands of their hash: one within ``most`` bits agrees on one of more bands wholly."""

    def __init__(self, most: int, bands: int, bits: int) -> None:
        self.most, self.images, self.held = most, {}, {}
        edges = [round(i * bits / bands) for i in range(bands + 1)]
        self.cuts = [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        self.whole = (1 << bits) - 1

    def keys(self, hash_: int) -> list[tuple]:
        return [(i, (hash_ & self.whole) >> a & mask) for i, (a, mask) in enumerate(self.cuts)]

    def nearest(self, hash_: int, inked: bool) -> tuple:
        """The nearest image so far that passes the gate, ties to the smallest id, and its distance; none and none."""
        found = {i for k in self.keys(hash_) for i in self.held.get(k, ())}
        near = []
        for i in found:
            other, ink = self.images[i]
            apart = ((other ^ hash_) & self.whole).bit_count()
            if apart == 0 or apart <= self.most and inked and ink:
                near.append((apart, i))
        apart, i = min(near, default=(None, None))
        return i, apart

    def add(self, id_: int, hash_: int, inked: bool) -> None:
        self.images[id_] = (hash_, inked)
        for k in self.keys(hash_):
            self.held.setdefault(k, []).append(id_)


def copies(images: DataFrame, by: str, most: int = 5, bands: int = 6, least: float = 0.02, bits: int = 64) -> DataFrame:
    """Each image (``by`` string, ``id``, ``hash``, ``ink``) as it arrives, with the earlier image of its key that it copies: ``nearest`` and ``distance``, null for none.

    The stream's form of ``fuzzy.copied_images``: the same answer where images arrive in order of id. Images of a
    batch are taken in order of id. The state of a key is what was new so far: an image whose hash is there already isn't added, unless it is the
    first with ink, so a picture sent a thousand times is two entries.
    """
    if bands <= most:
        raise ValueError("more bands than bits that may differ are needed")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, known, rows = _Bands(most, bands, bits), set(), []
        for i, h, inked in zip(*(state.get if state.exists else ([], [], [])), strict=True):
            seen.add(i, h, inked)
            known |= {(h, inked), (h, False)}
        for r in pd.concat(list(batches)).sort_values("id").itertuples():
            hash_, inked = int(r.hash), bool(r.ink == r.ink and r.ink is not None and r.ink >= least)
            nearest, apart = seen.nearest(hash_, inked)
            rows.append((key[0], int(r.id), nearest, apart))
            if (hash_, inked) not in known:
                seen.add(int(r.id), hash_, inked)
                known |= {(hash_, inked), (hash_, False)}
        ids = sorted(seen.images)
        state.update((ids, [seen.images[i][0] for i in ids], [seen.images[i][1] for i in ids]))
        yield pd.DataFrame(rows, columns=[by, "id", "nearest", "distance"]).astype({"nearest": "Int64", "distance": "Int32"})

    return images.groupBy(by).applyInPandasWithState(run, f"{by} string, id long, nearest long, distance int", "ids array<long>, hashes array<long>, inked array<boolean>", "append", "NoTimeout")
