import random
import zlib

import corpus_pipeline
from canonry.llm.queries import queries

KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def write(spark, path):
    r = random.Random(1)
    parts = {"en": ["the", "tion", "ing", "er", "and", "with"], "de": ["der", "ung", "sch", "ein", "keit", "mit"]}
    say = lambda lang, n: " ".join(r.choice(parts[lang]) + r.choice(parts[lang]) + r.choice(parts[lang]) for _ in range(n))
    docs, labels = [], []
    for i in range(300):
        lang = ("en", "de")[i % 2]
        text = say(lang, 60)
        if i % 6 == 0:
            words = text.split()
            for _ in range(5):
                words[r.randrange(60)] = "scumbag"
            text = " ".join(words)
        docs.append((i, text, lang, "s", len(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    clean = docs[1][1]
    docs += [(300, clean, "de", "s", 1), (301, clean + " ende", "de", "s", 1), (302, "123 456 !!!", "en", "s", 1), (303, None, "en", "s", None), (304, docs[3][1] + f' token = "{KEY}" x', "de", "s", 7)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def test_stages_take_effect(spark, tmp_path):
    docs = write(spark, tmp_path)
    df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        if name != "packing":
            assert set(out.columns) == set(df.columns)
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"] for r in df.select("doc_id").collect()}
    toxic = {i for i, *_ in docs[:300] if i % 6 == 0}
    everyone = {d[0] for d in docs}
    assert kept["language"] == everyone - {302, 303}
    assert kept["toxicity"] == kept["language"] - toxic
    assert kept["near_duplicates"] == kept["toxicity"] - {300, 301, 304}
    assert kept["packing"] == kept["secrets"] == kept["near_duplicates"]


def test_language_stage_rejects_noise_and_keeps_short_clean_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("doc_id", "text", "lang")
    held = [r["text"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    r = random.Random(5)
    noise = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 10))) for _ in range(r.randint(5, 60))) for _ in range(200)]
    words = [w for t in held for w in t.split()[:40:9] if w.isalpha() and len(w) > 1]
    other = ["Nopea ruskea kettu hyppää laiskan koiran yli", "Rychlá hnědá liška skáče přes líného psa", "Szybki brązowy lis przeskakuje nad leniwym psem", "Быстрая коричневая лиса прыгает через ленивую собаку"]
    rows = [(100_000 + i, t, None) for i, t in enumerate([*noise, *other, *words])]
    out = corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), "")
    kept = {x["doc_id"] for x in out.select("doc_id").collect()}
    share = lambda a, b: sum(100_000 + i in kept for i in range(a, b)) / (b - a)
    n, m = len(noise), len(noise) + len(other)
    assert share(0, n) <= 0.05 and share(n, m) == 0 and share(m, len(rows)) >= 0.97
    assert {x["doc_id"] for x in docs.select("doc_id").collect()} <= kept


def test_secrets_stage_redacts_and_keeps_rows(spark):
    docs = spark.createDataFrame([(1, f'token = "{KEY}" x', "en", "s", 53), (2, None, "en", "s", None), (3, "plain", "en", "s", 99)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.redact_secrets(spark, docs, "").collect()}
    assert KEY not in got[1]["text"] and got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] is None and got[3]["n_chars"] == 99


def test_run_and_registration(spark, tmp_path):
    write(spark, tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert {*(f"op{i}_" for i in range(1, 14)), "pipeline"} == {k.split("_")[0] + "_" * (k != "pipeline") for k in queries()}


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, __n int, __copy string, kept_id long, score double"


def awkward(spark):
    say = "the tion ing and with " * 8
    rows = [(1, say, "en", "s", 5, 1, "c", 9, 0.5)] * 3 + [(2, None, None, None, None, None, None, None, None), (3, "", "en", "s", 0, 2, "c", 1, 0.0), (None, say + "x", "en", None, 1, 3, None, 1, 0.0), (4, f'{say} token = "{KEY}" x', "en", "s", 1, 4, "c", 1, 0.0), (5, "word " * 20_000, "en", "s", 1, 4, "c", 1, 0.0)]
    return spark.createDataFrame(rows, AWKWARD)


def test_stages_on_awkward_rows_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, got = awkward(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns or name == "packing"
        got[name] = out.collect()
    ids = lambda name: sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got[name])
    everyone = sorted((i is not None, i or 0) for i in (1, 1, 1, 2, 3, None, 4, 5))
    assert ids("secrets") == everyone and ids("toxicity") == everyone
    assert ids("language") == [x for x in everyone if x[1] not in (2, 3)]
    assert ids("near_duplicates") == [x for x in sorted(set(everyone)) if x[0]]
    assert sum(r["length"] for r in got["packing"] if r["doc_id"] == 3) == 1 and sum(r["piece"] == 0 for r in got["packing"]) == 8
    clean = {r["doc_id"]: r for r in got["secrets"]}
    assert KEY not in clean[4]["text"] and clean[4]["n_chars"] == len(clean[4]["text"]) and clean[4]["__n"] == 4 and clean[1]["n_chars"] == 5 and clean[2]["text"] is None


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward(spark).limit(0), str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == awkward(spark).columns)
