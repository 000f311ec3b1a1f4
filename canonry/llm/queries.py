"""The queries ``opN_<name>`` and ``pipeline``, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, langid, linededup, neighbours, ngram_join, ogg, packing, quality, search, secrets, sharding, toxicity
from .common import load

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document; the secret itself only as its digest."""
    return secrets.scan(load(spark, sf_dir, "documents")).withColumn("secret_sha256", F.sha2(F.col("secret").cast("binary"), 256)).drop("secret")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(load(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.classify(load(spark, sf_dir, "documents"))


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digest(load(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(load(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), WORD_BPE)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(load(spark, sf_dir, "documents"), BYTE_BPE)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(load(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(conversations.damage(load(spark, sf_dir, "conversations")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op11_line_dedup": linededup.SQL, "op12_conversation_repair": conversations.SQL, "op13_ranked_search": search.SQL}
