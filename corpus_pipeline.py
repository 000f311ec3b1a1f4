"""From raw documents to packed training sequences, in five stages.

Every stage works on all that its predecessor kept and returns the columns of
``documents``, but for the last, which returns one row a packed piece. ``run``
writes each stage's result as Parquet to the shared folder and reads it again, so
a lost executor costs at most the stage under way.

Defined results, besides each stage's own: an empty table gives an empty one; further
columns, whatever their names, pass through to the last stage but one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.llm import langid, ngram_join, packing, secrets, toxicity
from canonry.llm.common import Scratch, free_name, keep_rows, load

#: Probability that a document's most likely language must reach; low, since a clean text of one word is no worse for being short.
LEAST_LANGUAGE = 0.35
#: Share of a document's letter trigrams that may be unknown to the languages learned: letter noise and other languages have more.
MOST_STRANGE = 0.45
#: Score from which a document counts as toxic.
TOXIC = 0.7
#: Words of a shingle and percent of similarity of near duplicates.
SHINGLE, SIMILAR = 5, 80
CAPACITY = 2048


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, with no probable language or with mostly unknown trigrams go: null and empty texts among them. Repeated rows go or stay alike; without a language to learn from, all go."""
    model = langid.fit(langid.training_part(docs))

    def keep(text: str | None) -> bool:
        lang, score = model(text)
        return lang != langid.UNDETERMINED and score >= LEAST_LANGUAGE and model.strangeness(text) <= MOST_STRANGE

    return keep_rows(docs, "text", keep)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with enough evidence of toxic passages go. Null and empty texts have none and stay, as does every text where labels of both kinds are wanting; a score at the bar goes; repeated rows go or stay alike."""
    model = toxicity.fit_from_labels(docs, load(spark, sf_dir, "labels"))
    return keep_rows(docs, "text", lambda text: model.probability(model.evidence(model.segments(text))) < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the document with the smallest id stays, once.

    Documents without words link with nothing and stay. Rows alike in id and text are one. (Documents
    without an id are dropped only where their group has one with an id, or as copies.)
    """
    copy, kept_id = free_name(docs, "copy"), free_name(docs, "kept_id")
    kept = ngram_join.join(docs, SHINGLE, SIMILAR).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept_id)).distinct()
    own = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept[kept_id]), "left_semi")
    return own.withColumn(copy, F.xxhash64("text")).dropDuplicates(["doc_id", copy]).drop(copy)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in a text are replaced; ``n_chars`` follows, where there is such a column. Every row stays, repeated ones too; null and empty texts stay as they are."""
    before, n = free_name(docs, "chars"), F.char_length("text")
    clean = secrets.redact(docs.withColumn(before, n))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(n != F.col(before), n.cast("long")).otherwise(F.col("n_chars")))
    return clean.drop(before)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, packed into sequences; a null or empty text is its end token alone, repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: No stage but the columns' plumbing can be said in SQL; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of a folder."""
    docs, scratch = load(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
