"""BPE encoding by forced-boundary splitting, and decoding.

A merge always yields a vocabulary token, so no merge can join two neighbouring
bytes that are adjacent in no token of the vocabulary. Every such byte pair is a
certain cut: the fragments between cuts are encoded on their own and their ids
concatenated, with the same result as encoding the whole word. Fragments are
short and repeat, so they are memoised.

``encode_documents`` takes any frame with ``doc_id`` and ``text``:

* null text counts as the empty text: no ids, and the empty text decoded;
* special tokens written in a text become their id, as in the tokenizers library;
* very long words are merged with a heap, in n log n steps;
* repeated rows give repeated results, other columns are ignored, an empty table
  gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache
from struct import Struct, pack

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

from .common import documents_of, map_batches

#: Fixed value: the pre-tokenizing pattern of byte-level vocabularies, as published.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries a memo may hold before it starts anew.
MEMO_ENTRIES = 150_000
_PACK = [Struct(f"<{n}I").pack for n in range(64)]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class _Memo(dict):
    """What ``make`` returned for the latest keys, in two generations of bounded size."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        if len(self) >= MEMO_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[key] = value = self.older.get(key) or self.make(key)
        return value


class ForcedSplitBPE:
    """A vocabulary file of the tokenizers library (BPE over byte letters).

    Ids are handled as packed little-endian unsigned 32-bit integers throughout.
    ``unsure`` is a character class: texts with such characters, whose Unicode class
    the library's pattern engine sees otherwise, go to the library itself. Without
    ``forced``, words are encoded whole.
    """

    def __init__(self, path: str, unsure: str = "", forced: bool = True) -> None:
        self.path, self.library, self.forced = path, None, forced
        self.unsure = regex.compile(unsure).search if unsure else None
        self.unsure_latin = [chr(c) for c in range(256) if unsure and self.unsure(chr(c))]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        byte_of = {c: b for b, c in enumerate(letters)}
        steps = _steps(spec.get("normalizer"))
        self.nfc, self.lower = "NFC" in steps, "Lowercase" in steps
        pattern = BYTE_LEVEL
        for p in _steps(spec["pre_tokenizer"]).values():
            if p["type"] == "Split":
                pattern = p["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        self.special = {t["content"]: pack("<I", t["id"]) for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.tokens: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        self.inside = np.zeros(65536, dtype=bool)
        for token, i in vocab.items():
            own = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
            if all(c in byte_of for c in own):
                self.tokens[i] = raw = bytes(byte_of[c] for c in own)
                for a, b in zip(raw, raw[1:], strict=False):
                    self.inside[a << 8 | b] = True
        for t in spec["added_tokens"]:
            self.tokens[t["id"]] = t["content"].encode()
        self.inside = self.inside.tolist()
        self.first = [vocab.get(c) for c in letters]
        self.last = [vocab.get(c + self.suffix) for c in letters]
        merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merged)}
        self.piece = self._ranked(vocab, byte_of)
        self.memo = _Memo(self._word)
        self.chunks = _Memo(self._chunk)
        #: Where a space is not the start of a word, the spaces around it must be seen together.
        self.gap = regex.compile(r"\s (?:\s|\Z)").search

    def _ranked(self, vocab: dict[str, int], byte_of: dict[str, int]):
        """A compiled encoder of single fragments, where ids follow the order of the merges; else None.

        The end of a word is a byte that no UTF-8 text holds; joined to the byte before
        it, it is that byte's token at a word's end, which precedes all other merges.
        """
        made = [new for _, new in self.rank.values()]
        if made != sorted(made) or made[0] < 256 + 256 * bool(self.suffix) or any(not 0 <= (i or 0) < 256 for i in self.first):
            return None
        ranks = {}
        for token, i in vocab.items():
            ends = bool(self.suffix) and token.endswith(self.suffix)
            own = token[: -len(self.suffix)] if ends else token
            if all(c in byte_of for c in own):
                ranks[bytes(byte_of[c] for c in own) + b"\xff" * ends] = i
        encoding = tiktoken.Encoding("fragments", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        return getattr(getattr(encoding, "_core_bpe", None), "encode_single_piece", None)  # private: without it, plain merging

    def _word(self, word: str) -> bytes:
        """Cut the word at forced boundaries, encode the fragments, concatenate."""
        raw, inside, start, out = word.encode(), self.inside, 0, []
        if not self.forced:
            out = self._fragment(raw, bool(self.suffix))
            return _PACK[len(out)](*out) if len(out) < 64 else pack(f"<{len(out)}I", *out)
        for i in range(1, len(raw)):
            if not inside[raw[i - 1] << 8 | raw[i]]:
                out += self._fragment(raw[start:i], False)
                start = i
        out += self._fragment(raw[start:], bool(self.suffix))
        return _PACK[len(out)](*out) if len(out) < 64 else pack(f"<{len(out)}I", *out)

    def _chunk(self, chunk: str) -> bytes:
        if self.suffix:
            if chunk.isalpha():
                return self._word(chunk)
            if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
                return self._word(chunk[:-1]) + self.memo[chunk[-1]]
        return b"".join(map(self.memo.__getitem__, self.words(chunk)))

    def _fragment(self, raw: bytes, ends: bool) -> list[int]:
        if self.piece:
            return self.piece(raw + b"\xff" * ends)
        return self.merged(raw, ends)

    def merged(self, raw: bytes, ends: bool) -> list[int]:
        """Ids of a fragment by plain merging, in the order of the merges."""
        ids = [self.first[b] for b in raw]
        if ends:
            ids[-1] = self.last[raw[-1]]
        ids = [i for i in ids if i is not None]
        return _merge_short(ids, self.rank) if len(ids) <= 48 else _merge_long(ids, self.rank)

    def _ordinary(self, text: str, latin: bool) -> bytes:
        if self.nfc and not latin and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = (text if latin else text.replace("Σ", "σ")).lower()
        if self.suffix:  # white space is dropped, so no word reaches over it
            return b"".join(map(self.chunks.__getitem__, text.split()))
        if self.gap(text):
            return b"".join(map(self.memo.__getitem__, self.words(text)))
        first, *rest = text.split(" ")
        return self.chunks[first] + b"".join(map(self.chunks.__getitem__, map(" ".__add__, rest)))

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        try:
            text.isascii() or text.encode("latin-1")
            latin = True
        except UnicodeEncodeError:
            latin = False
        if self.unsure and (any(c in text for c in self.unsure_latin) if latin else self.unsure(text)):
            self.library = self.library or Tokenizer.from_file(self.path)
            ids = self.library.encode(text, add_special_tokens=False).ids
            return pack(f"<{len(ids)}I", *ids)
        if self.special and any(s in text for s in self.special):
            return b"".join(self.special[x] if x in self.special else self._ordinary(x, latin) for x in self.special_split(text))
        return self._ordinary(text, latin)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist())).decode("utf-8", "replace")


def _steps(step: dict | None) -> dict[str, dict]:
    """The parts of a normalizer or pre-tokenizer by type."""
    if not step:
        return {}
    parts = step.get("normalizers") or step.get("pretokenizers") or [step]
    return {p["type"]: p for p in parts}


def _merge_short(ids: list[int], rank: dict) -> list[int]:
    while len(ids) > 1:
        best, at = None, 0
        for i in range(len(ids) - 1):
            r = rank.get((ids[i], ids[i + 1]))
            if r is not None and (best is None or r[0] < best[0]):
                best, at = r, i
        if best is None:
            break
        ids[at : at + 2] = [best[1]]
    return ids


def _merge_long(ids: list[int], rank: dict) -> list[int]:
    """Merge over a linked list with a heap of (rank, position)."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i] if ids[i] is not None else n
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = new, None
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
            if r := rank.get((new, ids[k])):
                heapq.heappush(heap, (r[0], i, new, ids[k], r[1]))
        if (h := before[i]) >= 0 and (r := rank.get((ids[h], new))):
            heapq.heappush(heap, (r[0], h, ids[h], new, r[1]))
    return [i for i in ids if i is not None]


@lru_cache(maxsize=8)
def unsure_characters(path: str) -> str:
    """A character class of the code points that the vocabulary's own normalizer or pattern treats otherwise than this module; "" if none."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, steps = _steps(spec["pre_tokenizer"]).get("Split"), _steps(spec.get("normalizer"))
    spans: list[list[int]] = []
    for at in range(0, 0x110000, 1 << 14):
        for p in sorted(map(ord, _odd_among([chr(c) for c in range(at, at + (1 << 14)) if not 0xD800 <= c < 0xE000], bool(split), steps))):
            if spans and spans[-1][1] == p - 1:
                spans[-1][1] = p
            else:
                spans.append([p, p])
    return "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in spans) + "]" if spans else ""


def _odd_among(chars: list[str], split: bool, steps: dict) -> set[str]:
    """Those of ``chars`` that the library and this module see otherwise."""
    odd: set[str] = set()
    text = "".join(chars)
    if split:
        for kind in (r"\p{L}", r"\p{N}", r"\s"):
            theirs = {c for x, _ in pre_tokenizers.Split(Regex(kind + "+"), "removed", invert=True).pre_tokenize_str(text) for c in x}
            odd |= theirs ^ set("".join(regex.findall(kind + "+", text)))
            if kind == r"\s":
                odd |= theirs ^ {c for c in chars if c.isspace()}
    for step, make, mine in (("NFC", normalizers.NFC, lambda x: unicodedata.normalize("NFC", x)), ("Lowercase", normalizers.Lowercase, lambda x: x.replace("Σ", "σ").lower())):
        if step in steps:
            between = [c for c in chars if c != "\n"]
            theirs, own = make().normalize_str("\n".join(between)).split("\n"), mine("\n".join(between)).split("\n")
            odd |= {c for c, a, b in zip(between, theirs, own, strict=True) if a != b}
    return odd


_LOADED: dict[tuple, ForcedSplitBPE] = {}


def vocabulary(*args) -> ForcedSplitBPE:
    """``ForcedSplitBPE`` of these arguments, loaded once in each Python worker."""
    if args not in _LOADED:
        _LOADED[args] = ForcedSplitBPE(*args)
    return _LOADED[args]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Packed ids of each document: ``doc_id``, ``ids`` (little-endian unsigned 32-bit)."""

    unsure = unsure_characters(path)

    def run(doc_ids, texts):
        encode = vocabulary(path, unsure).encode
        return doc_ids, [encode(t or "") for t in texts]

    return map_batches(documents_of(docs), run, "doc_id long, ids binary", ["doc_id", "ids"])


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """The text of each row of packed ids: ``doc_id``, ``ids``, ``text``."""

    def run(doc_ids, ids):
        decode = vocabulary(path).decode
        return doc_ids, ids, [decode(x or b"") for x in ids]

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, text string", ["doc_id", "ids", "text"])


def digest(docs: DataFrame, path: str) -> DataFrame:
    """``encode_documents`` then ``decode_documents``, reduced to counts and digests of whole results."""
    from pyspark.sql import functions as F

    both = decode_documents(encode_documents(docs, path), path)
    return both.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
