"""Pairs by time and by bits against brute force."""

import datetime
import random

import pytest

from canonry.operators import fuzzy, temporal


def brute_overlaps(rows):
    far = 10**9
    out = set()
    for k, i, s, t in rows:
        for l, j, u, v in rows:
            if k == l and s is not None and u is not None and (s, i) < (u, j) and u < (far if t is None else t) and s < (far if v is None else v):
                out.add((k, i, j))
    return out


def test_every_overlapping_pair_is_found(spark):
    r = random.Random(3)
    rows = [(1, i, 0, 100) for i in range(6)]  # all overlap: 15 pairs
    rows += [(2, 10 + i, s := r.randint(0, 300), r.choice([None, s, s + 1, s + r.randint(2, 20), s + r.randint(50, 400)])) for i in range(80)]
    rows += [(None, 200, 5, 9), (None, 201, 8, None), (3, 300, None, 5), (3, 301, 1, 5), (4, 400, 0, 5), (4, 401, 5, 9)]
    day = lambda n: None if n is None else datetime.date(2020, 1, 1) + datetime.timedelta(n)
    df = spark.createDataFrame([(k, i, day(s), day(t)) for k, i, s, t in rows], "k int, id long, valid_from date, valid_to date")
    got = [tuple(x) for x in temporal.overlap_pairs(df, ["k"], "id", "valid_from", "valid_to").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_overlaps(rows) and sum(k == 1 for k, *_ in got) == 15
    assert temporal.overlap_pairs(df.limit(0), ["k"], "id", "valid_from", "valid_to").count() == 0


@pytest.mark.parametrize("bands", [6, 8])
def test_images_of_five_bits_and_the_nearest_earlier(spark, bands):
    r = random.Random(4)
    base = r.getrandbits(64)
    flip = lambda n: base ^ sum(1 << i for i in r.sample(range(64), n))
    images = [(i, r.getrandbits(64) if i % 3 == 0 else flip(r.randint(0, 5)), r.choice([None, 0.0, 0.01, 0.02, 0.5])) for i in range(60)]
    images += [(100, base, 0.5), (101, base ^ 0b11111, 0.5), (102, base ^ 0b111111, 0.5), (103, base, None), (104, flip(3), 0.0)] + [(200 + i, base, 0.5) for i in range(20)]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    bits = spark.createDataFrame([(i, signed(h), ink) for i, h, ink in images], "id long, hash long, ink double")
    apart = lambda g, h: (g ^ h).bit_count()
    want = {}
    for b, h, ink in images:
        open_ = [(apart(g, h), a) for a, g, i in images if a < b and (g == h or apart(g, h) <= 5 and min(i or 0, ink or 0) >= 0.02)]
        d, a = min(open_, default=(None, None))
        want[b] = (min(i for i, g, _ in images if g == h), sum(apart(g, h) <= 5 for i, g, _ in images if i != b), a, d)
    got = {x["id"]: tuple(x)[1:] for x in fuzzy.copied_images(bits, 5, bands, 0.02).collect()}
    assert got == want and any(d == 5 for *_, d in want.values()) and sum(d is None for *_, d in want.values()) > 5
    # Class pairs and classes are all pairs of images, a row each left out.
    first = {h: min(i for i, g, _ in images if g == h) for _, h, _ in images}
    pairs = {(x["a"], x["b"]): (x["distance"], x["a_images"], x["b_images"]) for x in fuzzy.near_classes(bits, 5, bands).collect()}
    size = lambda i: sum(first[g] == i for _, g, _ in images)
    assert pairs == {(i, j): (apart(g, h), size(i), size(j)) for g, i in first.items() for h, j in first.items() if i < j and apart(g, h) <= 5}


def test_lookup_by_keys_equals_lookup_by_broadcast(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abc ") for _ in range(r.randint(1, 9))).strip() or "a"
    entries = sorted({word() for _ in range(60)})
    long = ["".join(r.choice("abcdefgh") for _ in range(r.randint(6, 11))) for _ in range(40)]
    entries += sorted(set(long) - set(entries))
    slip = lambda w: "".join(r.choice(["", c, c, c, c, c, c, c + "z", "z"]) for c in w)
    names = [slip(r.choice(long)) for _ in range(200)] + [w for _ in range(200) for w in (word(), r.choice(entries)[:-1], "x" + r.choice(entries), r.choice(entries))] + ["", "Emulsifier 7", "e 621", None]
    left, right = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(enumerate(entries)), "ordinal int, entry string")
    found = [sorted(map(tuple, fuzzy.lookup(left, right, most_broadcast=m, additive=fuzzy.ADDITIVE).where("name is not null").collect())) for m in (1000, 0)]
    assert found[0] == found[1] and {h for _, _, h, _ in found[0]} == {"exact", "substring", "typo", "additive", "none"}


def test_versions_as_of_match_brute_force(spark):
    r = random.Random(12)
    day = lambda n: None if n is None else datetime.date(1990, 1, 1) + datetime.timedelta(n)
    versions = [(i, r.randint(0, 2), s := r.randint(0, 9000), r.choice([None, s, s + 1, s + r.randint(1, 4000)])) for i in range(60)] + [(99, 1, None, None), (98, 1, 0, 400_000)]
    events = [(i, r.randint(0, 2), r.choice([r.randint(0, 12_000), 300_000])) for i in range(200)] + [(999, 1, None), (998, None, 5)]
    v = spark.createDataFrame([(i, k, day(a), day(b)) for i, k, a, b in versions], "version int, k int, a date, b date")
    e = spark.createDataFrame([(i, k, day(d)) for i, k, d in events], "id int, k int, day date")
    holds = lambda d, a, b: d is not None and a is not None and a <= d and (b is None or d < b)
    got = sorted((x.id, x.version) for x in temporal.as_of_join(e, v, "day", "a", "b", ["k"]).collect())
    assert got == sorted((i, j) for i, k, d in events for j, l, a, b in versions if k == l and holds(d, a, b)) and len(got) > 500
    loose = sorted((x.id, x.version) for x in temporal.as_of_join(e.drop("k"), v.drop("k"), "day", "a", "b").collect())
    assert loose == sorted((i, j) for i, _, d in events for j, _, a, b in versions if holds(d, a, b))


def test_near_hashes_meet_in_as_many_tasks_as_their_pairs_need(spark):
    widths = [12] * 56
    for n in (10_000, 100_000, 600_000):
        _, tasks = fuzzy.band_tasks(n, widths)
        assert n * n * 56 / 2**12 / tasks <= 4_000_000 and tasks < 2 + n * n * 56 / 2**12 / 4_000_000
    assert fuzzy.band_tasks(0, widths) == (1, 1)
    hashes = spark.range(40_000).selectExpr("id", "xxhash64(id) & 4294967295L AS hash")
    near = fuzzy.near_hashes(hashes, 5, 8, 32)
    told = near._jdf.queryExecution().executedPlan().toString()
    assert told.count("REPARTITION_BY_NUM") >= 4 and f", {fuzzy.band_tasks(40_000, widths)[1]}), REPARTITION_BY_NUM" in told and "BroadcastHashJoin" not in told


def test_links_that_the_gate_lets_through(spark):
    r = random.Random(6)
    base = r.getrandbits(31)
    images = [(i, base ^ sum(1 << b for b in r.sample(range(31), r.randint(0, 4))), r.choice([None, 0.0, 0.02, 0.5])) for i in range(80)] + [(100 + i, base, ink) for i, ink in enumerate([None, 0.5, 0.0])]
    df = spark.createDataFrame(images, "id long, hash long, ink double")
    apart = lambda g, h: (g ^ h).bit_count()
    want = {b: (sum(apart(g, h) <= 5 for i, g, _ in images if i != b), sum(g == h or apart(g, h) <= 5 and min(i or 0, ink or 0) >= 0.02 for a, g, i in images if a != b)) for b, h, ink in images}
    got = {x["id"]: (x["links"], x["open_links"]) for x in fuzzy.copied_images(df, 5, 8, 0.02, 32, opened=True).collect()}
    assert got == want and any(0 < o < n for n, o in want.values())
