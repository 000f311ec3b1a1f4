"""Conversation repair against an exhaustive search of edits, and on awkward rows."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from canonry.llm import conversations
from canonry.llm.queries import op12_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, kind int, n long"
BLANK = " \t\n\x0b\x0c\r"


def brute(rows):
    """Least (cost, audit) and the repaired turns, trying every edit with up to two inserts at a place."""
    best = None

    def go(i, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            for tail in range(3):
                for roles in ([], *([[x] for x in ("user", "assistant")] if tail else []), *([[x, y] for x in ("user", "assistant") for y in ("user", "assistant")] if tail > 1 else [])):
                    if len(roles) == tail:
                        got = out + [(r, "") for r in roles]
                        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in got)):
                            cand = (cost + 2 * tail, audit + "I" * tail, got)
                            best = min(best or cand, cand, key=lambda x: x[:2])
            return
        role, text, fault = rows[i]
        for k in range(3):
            for roles in [[]] if k == 0 else [[x] for x in ("user", "assistant")] if k == 1 else [[x, y] for x in ("user", "assistant") for y in ("user", "assistant")]:
                base, head, o = cost + 2 * k, audit + "I" * k, out + [(r, "") for r in roles]
                go(i + 1, base + 3, head + "D", o)
                if fault not in "BD" or not fault:
                    go(i + 1, base + (fault == "T"), head + "K", [*o, (role, text)])
                    for r in ("user", "assistant"):
                        go(i + 1, base + 2 + (fault == "T"), head + "R", [*o, (r, text)])

    go(0, 0, "", [])
    return best


def expected(rows, find=brute):
    """Of one conversation's rows after damage, in order: (turn, role, text)."""
    seen, faults = set(), []
    for _, role, text in rows:
        s = text.rstrip(BLANK)
        faults.append("B" if not s else "D" if (role, text) in seen else "T" if s[-1] not in ".!?" else "")
        seen.add((role, text))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, got = find([(r, t, f) for (_, r, t), f in zip(rows, faults, strict=True)])
    return (gaps, faults.count("B"), faults.count("D"), faults.count("T"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in got).encode()).hexdigest())


def hash64(df):
    return {(r["role"], r["text"]): (r["h1"], r["h2"]) for r in conversations._placed(df, None).collect()}


def in_order(df):
    """Rows by conversation in the stated order: turn (nulls first), role, hash of the text."""
    h, out = hash64(df), {}
    for r in df.collect():
        role, text = r["role"] if r["role"] is not None else " ", r["text"] if r["text"] is not None else " "
        out.setdefault(r["conv_id"], []).append((r["turn"], role, text))
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], h[r[1], r[2]])) for c, x in out.items()}


def test_against_exhaustive_search(spark):
    r = random.Random(3)
    texts, roles = ["Yes.", "No", "Why?", " \n", "", None, "Well!", "so it"], ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    rows = [(c if c else None, r.choice([t, t, t, None, 3]), r.choice(roles), r.choice(texts), "x", 7, 1) for c in range(60) for t in range(r.randint(1, 5))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = {c: expected(x) for c, x in in_order(df).items()}
    for pieces in (1, 7):
        got = {x["conv_id"]: (*x[1:8], x["repaired_sha256"]) for x in _pieced(df, pieces)}
        assert got == want


def _pieced(df, pieces):
    before = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    df.sparkSession.conf.set("spark.sql.shuffle.partitions", str(pieces))
    try:
        return conversations.digest(df).collect()
    finally:
        df.sparkSession.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_give_what_one_search_gives(monkeypatch, block):
    r = random.Random(block)
    for _ in range(60):
        rows = "".join(r.choice("suua-x" + "SUA_") for _ in range(r.randint(0, 14)))
        want = {(e, x): v for e in range(4) for x, v in conversations.search(rows, e).items()}
        with monkeypatch.context() as m:
            m.setattr(conversations, "BLOCK", block)
            assert conversations.matrix(rows) == want


def test_a_search_is_the_least_by_cost_and_then_audit():
    r = random.Random(1)
    names = {"s": "system", "u": "user", "a": "assistant", "-": "tool"}
    for _ in range(200):
        rows = "".join(r.choice("suua-xUA_") for _ in range(r.randint(0, 5)))
        plain = [("user", "", "B") if c == "x" else (names["-" if c == "_" else c.lower()], "t", "T" if c.isupper() or c == "_" else "") for c in rows]
        ends = conversations.search(rows, conversations.START)
        assert min(ends[x] for x in (conversations.START, conversations.ASSISTANT) if x in ends) == brute(plain)[:2]


def test_one_long_conversation_is_dealt_out_and_repaired_rows_match_their_hash(spark):
    n = 20_000
    row = F.struct(F.when(F.col("id") % 3 == 0, "user").when(F.col("id") % 7 == 0, "system").otherwise("assistant").alias("role"), F.when(F.col("id") % 11 == 0, "ab").otherwise(F.concat(F.lit("t"), (F.col("id") % 9000).cast("string"), F.lit("."))).alias("text"))
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), row["role"].alias("role"), row["text"].alias("text"))
    pieces = conversations.facts(df).repartitionByRange(8, "conv_id", "known", "turn", "role", "h1", "h2").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(pieces) == 8 and max(x["count"] for x in pieces) < n / 4
    found, whole = _pieced(df, 8)[0], _pieced(df, 1)[0]
    assert found == whole and found["audit"].replace("I", "").__len__() == n and found["gaps"] == 0
    fixed = sorted((x["place"], x["role"], x["text"], x["edit"]) for x in conversations.repair(df).collect())
    assert re.fullmatch("(s?(ua)+)?", "".join(x[1][0] for x in fixed)) and "".join(x[3] for x in fixed) == found["audit"].replace("D", "")
    assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t, _ in fixed).encode()).hexdigest() == found["repaired_sha256"]


def test_damage_and_what_is_left_of_a_conversation(spark):
    kind = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    rows = [(c, t, "assistant", f"A? b{t}!", "x", 7, 1) for c in [*range(20), None] for t in [*range(8), None]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(x["conv_id"], x["turn"]): x for x in conversations.damage(df).collect()}
    for c, t, role, text, *_ in rows:
        x, k = got[c, t], kind(c, t)
        assert x["copies"] == {0: 0, 3: 2}.get(k, 1) and x["text"] == {1: "", 2: f"A b{t}"}.get(k, text) and x["role"] == ("user" if k == 4 else role)
    gone = next((c, t) for c in range(500) for t in range(50) if kind(c, t) == 0)
    one = conversations.digest(conversations.damage(spark.createDataFrame([(*gone, "user", "x.", "x", 7, 1)], SCHEMA))).collect()
    assert [tuple(x) for x in one] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.digest(conversations.damage(df.limit(0))).collect() == []
    far = conversations.digest(spark.createDataFrame([(1, t, "user", f"{t}.", "x", 7, 1) for t in (-(1 << 63), (1 << 63) - 1)], SCHEMA)).first()
    assert far["gaps"] == -2


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.sql(conversations.SQL)
    df = op12_conversation_repair(spark, sf)
    assert df.columns == want.columns and sorted(map(tuple, df.collect())) == sorted(want.fetchall())
