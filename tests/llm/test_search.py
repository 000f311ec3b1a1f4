"""Ranked search against scoring of every document, its SQL, and on awkward rows."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from canonry.llm import search
from canonry.llm.queries import op13_ranked_search

DOCS, ITEMS = "doc_id long, text string, n long, terms string, rank int", "item_id long, text string, score long"
LOWER = {c: c + 32 for c in range(65, 91)}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall(text.translate(LOWER)) if text is not None else []


def brute(docs, items, k):
    cuts = [(d, Counter(cut(t))) for d, t in docs]
    cuts = [(d, c) for d, c in cuts if c]
    n_docs, total = len(cuts), sum(sum(c.values()) for _, c in cuts)
    df = Counter(t for _, c in cuts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(cut(text))
    out = []
    for item, terms in wanted.items():
        found = []
        for doc, c in cuts:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, doc is not None, doc or 0))
        out += [(item, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(found)[:k], 1)]
    return out


def shown(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize(("k", "shard", "cells"), [(10, 1 << 20, 4 << 20), (3, 40, 4 << 20), (1, 300, 1), (1000, 25, 50)])
def test_against_scores_of_all(spark, monkeypatch, k, shard, cells):
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "CELLS", cells)
    r = random.Random(k)
    words = [f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(4000)] + ["É", "é", "日本", "A1", "a1", "x"]
    texts = [None, "", "  ", "...", "A-b_c'd", "É é 日本", "x " * 500, *(" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(300))]
    texts += texts[-3:] * 30
    docs = [(i - 5 if i % 41 else None, t) for i, t in enumerate(texts)] + [(7, texts[9]), (7, texts[9]), (-(1 << 40), texts[12])]
    items = [(1, texts[20]), (2, texts[-1]), (3, None), (4, ""), (5, "nowhere"), (None, "w1 w2 É"), (6, "w1 " * 5), (7, "W1 w2"), (7, "w3 nowhere"), (8, " ".join(words))]
    df = spark.createDataFrame([(*d, 1, "t", 9) for d in docs], DOCS).repartition(3)
    got = search.rank(df, spark.createDataFrame([(*i, 1) for i in items], ITEMS), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and shown(got.collect()) == shown(brute(docs, items, k))


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i}", 1, "t", 9) for i in range(20)], DOCS)
    items = spark.createDataFrame([(i, f"a c{i} b{i}", 1) for i in range(6)], ITEMS)
    whole = shown(search.rank(docs, items).collect())
    monkeypatch.setattr(search, "MOST_TERMS", 4)
    assert shown(search.rank(docs, items).collect()) == whole
    assert search.rank(docs.limit(0), items).collect() == search.rank(docs, items.limit(0)).collect() == []


def test_treaps_are_ordered_and_heaps_and_ranges_have_their_maxima():
    r = np.random.default_rng(5)
    impacts = r.integers(0, 50, 400).tolist()
    root, left, right = search.treap(impacts)

    def walk(i, low, high):
        if i < 0:
            return []
        for c in (left[i], right[i]):
            assert c < 0 or impacts[c] <= impacts[i]
        return [*walk(left[i], low, i), i, *walk(right[i], i + 1, high)]

    assert walk(root, 0, 400) == list(range(400))
    sizes = np.full(200, 2)
    terms = np.concatenate([np.sort(r.choice(5, 2, replace=False)) for _ in range(200)])
    shard = search.Shard(np.arange(200), [5] * 200, sizes, terms, r.integers(1, 9, 400), 200, 1000)
    for low, high in r.integers(0, 201, (50, 2)):
        nodes = shard.within(np.array([[shard.root[t] for t in range(5)]]), np.array([low]), np.array([high]))
        share = [max([shard.share[2 * d + j] for d in range(low, high) for j in range(2) if terms[2 * d + j] == t], default=0) for t in range(5)]
        assert shard.node_share[nodes][0].tolist() == share


def test_ranges_are_pruned(spark):
    """Of many documents few are scored where some stand out."""
    r = random.Random(2)
    texts = [" ".join(f"w{r.randint(0, 200)}" for _ in range(30)) for _ in range(5000)]
    wanted = [f"w{i}" for i in range(12)]
    texts[1000:1012] = [" ".join(wanted)] * 12
    cuts = [Counter(cut(t)) for t in texts]
    numbers = {w: i for i, w in enumerate(sorted({t for c in cuts for t in c}))}
    rows = [sorted((numbers[t], n) for t, n in c.items()) for c in cuts]
    shard = search.Shard(np.arange(len(texts)), [sum(c.values()) for c in cuts], np.array([len(x) for x in rows]), np.array([t for x in rows for t, _ in x]), np.array([n for x in rows for _, n in x]), len(texts), sum(map(len, rows)))
    scored, best, weight = [], search.Best(10), np.zeros(len(numbers), np.int64)
    own = np.array(sorted(numbers[w] for w in wanted))
    weight[own] = 1000
    plain = shard.scores
    shard.scores = lambda p, w: scored.extend(p.tolist()) or plain(p, w)
    shard.search(own, weight, best)
    assert [d for _, d in best.rows] == list(range(1000, 1010)) and len(scored) == len(set(scored)) < 2500


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, want = op13_ranked_search(spark, sf), con.sql(search.SQL)
    assert df.columns == want.columns and sorted(map(tuple, df.collect())) == sorted(want.fetchall())
