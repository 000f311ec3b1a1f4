"""Line dedup against a brute-force version and its SQL, and on awkward rows."""

import random
from collections import defaultdict

import duckdb
import pytest

from canonry.llm import linededup
from canonry.llm.queries import op11_line_dedup

SCHEMA = "doc_id long, text string, copy string, pos int, h1 long, n_lines int"
UPPER = {ord(a): ord(b) for a, b in zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", strict=True)}


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def brute(rows, least_docs, least_chars):
    held = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(doc)
    gone = {k for k, d in held.items() if len(k) >= least_chars and len(d) >= least_docs}
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shown(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize(("least_docs", "least_chars"), [(2, 1), (3, 4), (10, 1)])
def test_against_brute_force(spark, least_docs, least_chars):
    r = random.Random(least_docs)
    pool = ["Menu", " menu\t", "MENU\r", "", "  ", "É", "é", "Ü x", "ü x", "CafÉ", "cafÉ", "cafÉ ", "İi", "日本", "日 本", "İ", "a\x0b", "\x85a", "a", "Ã©", "é ", "x" * 3000, "ǅ", "ǆ", "\U0001f600", "Ω", "ω", "Ç", "ç"]
    texts = [None, "", "\n", "\n\n\n", "Menu", *("\n".join(r.choice(pool) for _ in range(r.randint(1, 12))) for _ in range(60))]
    rows = [(i % 50 if i % 17 else None, t, "c", 1, 2, 3) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = linededup.dedup(df, least_docs, least_chars)
    assert got.columns == ["doc_id", "text", "copy", "pos", "h1", "n_lines", "n_dropped"]
    assert shown((x["doc_id"], x["n_lines"], x["n_dropped"], x["text"]) for x in got.collect()) == shown(brute(rows, least_docs, least_chars))
    assert {(x["copy"], x["pos"], x["h1"]) for x in got.collect()} == {("c", 1, 2)}


def test_folding_tells_apart_all_but_the_case_of_ascii(spark):
    chars = [chr(c) for c in [*range(1, 0x600), *range(0x1E00, 0x2200), *range(0x24B0, 0x24F0), 0xFF21, 0xFF41, 0x10400, 0x10428, 0x1F600]]
    texts = [*chars, *(a + b for a in "ÂâÃãÉéØøAaĀ" for b in "Aa©°é")]
    got = defaultdict(set)
    for x in spark.createDataFrame([(t,) for t in texts], "text string").select("text", linededup.folded(linededup.F.col("text")).alias("f")).collect():
        got[x["f"]].add(x["text"].translate(UPPER))
    assert all(len(v) == 1 for v in got.values()) and len(got) == len({t.translate(UPPER) for t in texts})


def test_a_line_of_all_documents_and_a_long_text(spark):
    long = "\n".join(f"line {i}" if i % 2 else "Shared" for i in range(40_000))
    rows = [(i, "Shared\nown " + str(i), "c", 1, 2, 3) for i in range(3000)] + [(9999, long, "c", 1, 2, 3)]
    got = {x["doc_id"]: x for x in linededup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[5]["text"] == "own 5" and got[9999]["n_dropped"] == 20_000 and got[9999]["text"] == "\n".join(f"line {i}" for i in range(1, 40_000, 2))


def test_empty_table_and_main_path_without_python(spark):
    df = spark.createDataFrame([(1, "a", "c", 1, 2, 3)], SCHEMA)
    assert linededup.digest(df.limit(0)).collect() == []
    plan = linededup.digest(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "RDDScan"))


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    df = op11_line_dedup(spark, sf)
    want = con.sql(linededup.SQL)
    assert df.columns == want.columns and sorted(map(tuple, df.collect())) == sorted(want.fetchall())
    assert sum(x["n_dropped"] for x in df.collect()) > 0
