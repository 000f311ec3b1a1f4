"""Streams with state against their batch forms."""

import random

from pyspark.sql import functions as F

from canonry.operators import fuzzy
from canonry.streaming import events


def test_copies_in_a_stream_are_those_of_the_batch(spark, tmp_path):
    r = random.Random(8)
    bases = [r.getrandbits(64) for _ in range(6)]
    flip = lambda h, n: h ^ sum(1 << i for i in r.sample(range(64), n))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    images = [(f"k{i % 3}", i, signed(flip(r.choice(bases), r.choice([0, 0, 1, 3, 5, 6]))), r.choice([None, 0.0, 0.02, 0.5])) for i in range(150)]
    images += [("hot", 1000 + i, signed(bases[0]), r.choice([None, 0.5])) for i in range(200)]
    schema = "key string, id long, hash long, ink double"
    for n in range(4):  # four batches, in order of id
        spark.createDataFrame(images[n * 100 : (n + 1) * 100], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        events.run_once(events.copies(stream, "key"), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(x["key"], x["id"]): (x["nearest"], x["distance"]) for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for key in ("k0", "k1", "k2", "hot"):
        batch = spark.createDataFrame([x for x in images if x[0] == key], schema).drop("key")
        want |= {(key, x["id"]): (x["nearest"], x["distance"]) for x in fuzzy.copied_images(batch, 5, 6, 0.02).collect()}
    assert got == want and sum(d == 5 for _, d in want.values()) and sum(d is None for _, d in want.values()) > 10


def test_copies_as_a_stream_need_no_order_within_a_batch(spark, tmp_path):
    schema = "key string, id long, hash long, ink double"
    spark.createDataFrame([("a", 2, 7, 0.5), ("a", 1, 7, 0.5), ("a", 3, 6, 0.5), ("b", 4, 7, None)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    events.run_once(events.copies(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "key"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").orderBy(F.col("id")).collect())) == [("a", 1, None, None), ("a", 2, 1, 0), ("a", 3, 1, 1), ("b", 4, None, None)]
