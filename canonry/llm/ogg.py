"""Ogg media columns: writing, and reading back with every check the container allows.

``store`` puts each text's payload (UTF-8, zero bytes up to a positive multiple of
64) into an Ogg file of two interleaved logical streams: 8-bit PCM samples in
packets, and an index packet for each run of samples. ``read`` verifies the
checksum of every page, reassembles packets from lacing values (over pages too),
demultiplexes the streams by serial number, and derives timestamps from granule
positions.

Defined results: null text counts as empty (64 zero bytes); an id may be null or
repeat; equal texts give equal files; a file that breaks a rule of the container
gives ``error`` and no payload; other columns are ignored; an empty table gives an
empty one. Memory per task is one Arrow batch.
"""

from __future__ import annotations

import hashlib
import zlib
from struct import Struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, map_batches

#: Fixed values of the container: capture pattern, header layout, header flags, segments in a page, the value of a full segment.
CAPTURE, HEADER, CONTINUED, FIRST, LAST, SEGMENTS, FULL = b"OggS", Struct("<4sBBqIIIB"), 1, 2, 4, 255, 255
RATE = 8000  #: samples a second
PACKET = 4000  #: samples in a packet: half a second
INDEXED = 64_000  #: samples in a run that one index packet describes: eight seconds
SOUND_NAME, INDEX_NAME = b"PCM8\0\0\0\0", b"INDEX\0\0\0"
SOUND = Struct("<8sBBI")  #: head of the sample stream: name, channels, bits, rate
INDEX = Struct("<qII")  #: an index packet: first sample, samples, their crc32
MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(data: bytes) -> int:
    """The container's checksum: polynomial 0x04C11DB7, most significant bit first, from 0, not inverted.

    It is the mirror image of zlib's: mirror the bits of the input and of the result.
    """
    c = zlib.crc32(data.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(MIRROR), "big")


class _Stream:
    """Lays the packets of one logical stream into pages."""

    def __init__(self, serial: int) -> None:
        self.serial, self.number = serial, 0

    def pages(self, packets: list[bytes], granules: list[int], flags: int = 0, last: bool = False) -> list[bytes]:
        """Pages that hold the packets; granules[i] is the position after packet i. A page without the end of a packet has position -1."""
        lacing, ends = [], []
        for p, g in zip(packets, granules, strict=True):
            lacing += [FULL] * (len(p) // FULL) + [len(p) % FULL]
            ends += [None] * (len(p) // FULL) + [g]
        body, at, out, carried = b"".join(packets), 0, [], False
        for i in range(0, len(lacing), SEGMENTS):
            laced, own = lacing[i : i + SEGMENTS], ends[i : i + SEGMENTS]
            done = [g for g in own if g is not None]
            size, final = sum(laced), i + SEGMENTS >= len(lacing)
            kind = carried * CONTINUED | (flags & FIRST if not i else 0) | (last and final) * LAST
            head = lambda crc, kind=kind, done=done, laced=laced: HEADER.pack(CAPTURE, 0, kind, done[-1] if done else -1, self.serial, self.number, crc, len(laced)) + bytes(laced)
            data = body[at : at + size]
            out.append(head(page_crc(head(0) + data)) + data)
            at, carried, self.number = at + size, own[-1] is None, self.number + 1
        return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the size before padding."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def mux(payload: bytes, n_bytes: int) -> bytes:
    """An Ogg file of the payload as 8-bit samples, with its index as a second logical stream."""
    serial = zlib.crc32(payload)
    sound, index = _Stream(serial), _Stream(serial ^ 0xFFFFFFFF)
    out = sound.pages([SOUND.pack(SOUND_NAME, 1, 8, RATE)], [0], FIRST) + index.pages([INDEX_NAME + n_bytes.to_bytes(8, "little")], [0], FIRST)
    for at in range(0, len(payload), INDEXED):
        run = payload[at : at + INDEXED]
        final = at + INDEXED >= len(payload)
        packets = [run[i : i + PACKET] for i in range(0, len(run), PACKET)]
        out += sound.pages(packets, [at + min(len(run), i + PACKET) for i in range(0, len(run), PACKET)], last=final)
        out += index.pages([INDEX.pack(at, len(run), zlib.crc32(run))], [at + len(run)], last=final)
    return b"".join(out)


def demux(media: bytes) -> dict[int, dict]:
    """The logical streams of a file by serial number: packets, the granule position after each, pages, whether closed.

    Raises ValueError where a page's capture pattern, version, checksum, sequence
    number, continuation flag or position is wrong, or a stream or packet has no end.
    """
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if len(media) < at + HEADER.size:
            raise ValueError("cut header")
        pattern, version, kind, granule, serial, number, crc, segments = HEADER.unpack_from(media, at)
        if pattern != CAPTURE or version:
            raise ValueError(f"no page at {at}")
        laced = media[at + HEADER.size : at + HEADER.size + segments]
        start = at + HEADER.size + segments
        end = start + sum(laced)
        if len(laced) < segments or len(media) < end:
            raise ValueError("cut page")
        if page_crc(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at {at}")
        if kind & FIRST:
            if serial in streams:
                raise ValueError("a stream begins twice")
            streams[serial] = {"packets": [], "granules": [], "pages": 0, "part": None, "closed": False}
        s = streams.get(serial)
        if s is None or s["closed"]:
            raise ValueError("a page outside its stream")
        if number != s["pages"]:
            raise ValueError(f"page {number} in place of {s['pages']}")
        if bool(kind & CONTINUED) != (s["part"] is not None):
            raise ValueError("continuation")
        part, done, begun = s["part"] or [], 0, start
        for v in laced:
            start += v
            if v < FULL:
                part.append(media[begun:start])
                s["packets"].append(b"".join(part))
                part, begun, done = [], start, done + 1
        if begun < start or (laced and laced[-1] == FULL):
            part.append(media[begun:start])
            s["part"] = part
        else:
            s["part"] = None
        if (granule == -1) != (not done) or (done and granule < max([0, *s["granules"][-1:]])):
            raise ValueError("granule position")
        s["granules"] += [None] * (done - 1) + [granule] * bool(done)
        s["pages"] += 1
        s["closed"] = bool(kind & LAST)
        at = end
    if not streams or any(s["part"] is not None or not s["closed"] for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def unpack(media: bytes) -> dict:
    """Payload and measures of a file as ``mux`` writes it; timestamps come from the granule positions.

    Raises ValueError where ``demux`` does, and where a head or index packet is
    missing or of another size, or says what the samples don't bear out.
    """
    streams = demux(media)
    if len(streams) != 2 or not all(s["packets"] for s in streams.values()):
        raise ValueError("not two streams with packets")
    by_name = {s["packets"][0][:8]: s for s in streams.values()}
    sound, index = by_name.get(SOUND_NAME), by_name.get(INDEX_NAME)
    if sound is None or index is None:
        raise ValueError("a stream is missing")
    if len(sound["packets"][0]) != SOUND.size or len(index["packets"][0]) != 16:
        raise ValueError("size of a head packet")
    _, channels, bits, rate = SOUND.unpack(sound["packets"][0])
    if channels != 1 or bits != 8 or not rate:
        raise ValueError("kind of samples")
    payload, n_bytes = b"".join(sound["packets"][1:]), int.from_bytes(index["packets"][0][8:], "little")
    if n_bytes > len(payload) or len(payload) - n_bytes > 64:
        raise ValueError("size before padding")
    described = 0
    for packet, g in zip(index["packets"][1:], index["granules"][1:], strict=True):
        if len(packet) != INDEX.size:
            raise ValueError("size of an index packet")
        at, size, crc = INDEX.unpack(packet)
        if at != described or g != at + size or zlib.crc32(payload[at : at + size]) != crc:
            raise ValueError("index")
        described += size
    if described != len(payload):
        raise ValueError("index")
    ends, position = [], 0
    known = sound["granules"][1:]
    for p, g in zip(sound["packets"][1:], known, strict=True):
        position += len(p)
        if g is not None and g != position:
            raise ValueError("granule position")
        ends.append(position)
    if not ends or ends[-1] != len(payload):
        raise ValueError("length")
    starts_ms = [e * 1000 // rate for e in [0, *ends[:-1]]]
    return {"payload": payload, "n_bytes": n_bytes, "streams": len(streams), "pages": sum(s["pages"] for s in streams.values()), "packets": len(ends), "duration_ms": ends[-1] * 1000 // rate, "last_start_ms": starts_ms[-1], "rate": rate, "bits": bits}


def feature(found: dict) -> str:
    """Measures of the samples and of the container as one line of text."""
    x = np.frombuffer(found["payload"], dtype=np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    mean, power = float(x.mean()), float((x.astype(np.int64) ** 2).mean())
    return f"streams={found['streams']};pages={found['pages']};packets={found['packets']};ms={found['duration_ms']};last_ms={found['last_start_ms']};mean={mean:.4f};rms={power**0.5:.4f};zero_crossings={crossings};peak={int(np.abs(x).max())}"


def store(docs: DataFrame) -> DataFrame:
    """The media column of each document: ``doc_id``, ``media``."""
    return map_batches(documents_of(docs), lambda ids, texts: (ids, [mux(*payload_of(t)) for t in texts]), "doc_id long, media binary", ["doc_id", "media"])


def read(stored: DataFrame) -> DataFrame:
    """Reads a media column: payload, measures and digests of what the stored bytes hold, or the ``error``."""
    names = ["doc_id", "n_bytes", "payload", "payload_sha256", "media_bytes", "media_sha256", "feature", "error"]

    def run(ids, files):
        rows = []
        for i, media in zip(ids, files, strict=True):
            try:
                found = unpack(media or b"")
            except ValueError as e:
                rows.append((i, None, None, None, len(media or b""), hashlib.sha256(media or b"").hexdigest(), None, str(e)))
                continue
            p = found["payload"]
            rows.append((i, found["n_bytes"], p, hashlib.sha256(p).hexdigest(), len(media), hashlib.sha256(media).hexdigest(), feature(found), None))
        return list(zip(*rows, strict=True))

    return map_batches(stored.select("doc_id", "media"), run, "doc_id long, n_bytes long, payload binary, payload_sha256 string, media_bytes long, media_sha256 string, feature string, error string", names)


def digest(docs: DataFrame) -> DataFrame:
    """``store`` then ``read``, with the payload reduced to its size, digest and tail."""
    return read(store(docs)).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        "payload_sha256",
        F.crc32(F.expr("substring(payload, greatest(length(payload) - 63, 1), 64)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        "error",
    )
