"""Static checks of key graphs against brute force."""

import random

import pytest

from canonry.operators import graphs


def brute(names, refs):
    near = {n: {t for a, t in refs if a == n and t != n and t in names} for n in names}

    def reach(n, seen):
        for t in near[n]:
            if t not in seen:
                seen.add(t)
                reach(t, seen)
        return seen

    far = {n: reach(n, set()) for n in names}
    cyclic = {n for n in names if n in far[n]}
    level = lambda n: max((level(t) + 1 for t in near[n]), default=0)
    behind = {n for n in names if far[n] & cyclic}
    return {n: (None, "CYCLE" if any(n in far[c] for c in cyclic) else "BEHIND") if n in behind else (level(n), "OK") for n in names}


@pytest.mark.parametrize(("seed", "edges"), [(1, 14), (2, 22), (3, 0)])
def test_creation_order(spark, seed, edges):
    r = random.Random(seed)
    names = [f"t{i}" for i in range(20)]
    refs = [(r.choice(names), r.choice([*names, "nowhere"])) for _ in range(edges)] * 2 + [("t0", "t0"), ("ghost", "t1")]
    tables, keys = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(refs, "name string, target string")
    assert {x["name"]: (x["level"], x["status"]) for x in graphs.creation_order(tables, keys).collect()} == brute(names, refs)
    assert sorted(map(tuple, graphs.unresolved(tables, keys).collect())) == sorted({(a, b) for a, b in refs if b not in names})
    assert [x[0] for x in graphs.missing(tables, ["t1", "audit"]).collect()] == ["audit"]
