"""Readings that must be aligned or broken into words: the operators without a native form, vectorised."""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_readings(least: float = 0.5):
    """A pandas UDF (first, second) of comma lists: items of both readings paired in order, the longer of a similar pair kept, what only one has kept with a question mark."""

    @F.pandas_udf("string")
    def merged(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([_merge(a, b, least) for a, b in zip(first, second, strict=True)])

    return merged


def _merge(first: str | None, second: str | None, least: float) -> str | None:
    if first is None or second is None:
        return first if second is None else second
    a, b = ([x.strip() for x in t.split(",") if x.strip()] for t in (first, second))
    out: list[str] = []
    for op, i0, i1, j0, j1 in difflib.SequenceMatcher(None, [x.lower() for x in a], [x.lower() for x in b], autojunk=False).get_opcodes():
        if op == "equal":
            out += a[i0:i1]
            continue
        left, right = a[i0:i1], b[j0:j1]
        for x in left:
            scored = [(difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio(), -k) for k, y in enumerate(right)]
            best = max(scored, default=(0.0, 0))
            if best[0] >= least:
                out.append(max(x, right.pop(-best[1]), key=len))
            else:
                out.append(x + "?")
        out += [y + "?" for y in right]
    return ", ".join(out)


def spaced(text: Column, vocabulary: list[str], longest: int = 60) -> Column:
    """Words that are several of ``vocabulary`` run together, with spaces; others as they are. The fewest parts win."""
    known = frozenset(w.lower() for w in vocabulary)

    def broken(word: str) -> str:
        low, n = word.lower(), len(word)
        if low in known or not word.isalpha() or n > longest:
            return word
        best: list[tuple | None] = [(0, 0)] + [None] * n
        for i in range(1, n + 1):
            ways = [(best[j][0] + 1, j) for j in range(i) if best[j] is not None and low[j:i] in known]
            best[i] = min(ways) if ways else None
        if best[n] is None:
            return word
        parts, i = [], n
        while i:
            j = best[i][1]
            parts.append(word[j:i])
            i = j
        return " ".join(reversed(parts))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        memo = lru_cache(maxsize=100_000)(broken)
        return texts.map(lambda t: None if t is None else " ".join(memo(w) for w in t.split(" ")))

    return run(text)


def nested_items(text: Column) -> Column:
    """Items of a list divided at commas outside brackets of any depth; unbalanced brackets divide everywhere."""

    def split(t: str | None) -> list[str] | None:
        if t is None:
            return None
        if t.count("(") != t.count(")"):
            return [x.strip() for x in t.split(",") if x.strip()]
        out, depth, at = [], 0, 0
        for i, c in enumerate(t):
            depth += (c == "(") - (c == ")")
            if c == "," and depth <= 0:
                out.append(t[at:i].strip())
                at = i + 1
        return [x for x in [*out, t[at:].strip()] if x]

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(split)

    return run(text)
