"""Scores, statuses and histograms of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_score(findings: DataFrame, by: list[str]) -> DataFrame:
    """Share of passed weight among applicable weight, in percent, and the status.

    Any finding that needs review keeps the whole from being final; without
    applicable weight there is nothing to be compliant with, and review is asked for.
    """
    sums = findings.groupBy(*by).agg(
        F.sum(F.when(F.col("result") == "PASS", F.col("weight")).otherwise(0.0)).alias("passed"),
        F.sum(F.when(F.col("result") != "NOT_APPLICABLE", F.col("weight")).otherwise(0.0)).alias("applicable"),
        F.bool_or(F.col("result") == "NEEDS_REVIEW").alias("review"),
    )
    return _scored(sums)


def score_row(rows: DataFrame, found: str) -> DataFrame:
    """``weighted_score`` where a row holds all its findings in an array: sums within the row, no shuffle."""
    total = lambda keep: F.aggregate(F.filter(found, keep), F.lit(0.0), lambda acc, x: acc + x["weight"])
    sums = rows.withColumns({"passed": total(lambda x: x["result"] == "PASS"), "applicable": total(lambda x: x["result"] != "NOT_APPLICABLE"), "review": F.exists(found, lambda x: x["result"] == "NEEDS_REVIEW")}).drop(found)
    return _scored(sums)


def _scored(sums: DataFrame) -> DataFrame:
    percent = F.when(F.col("applicable") > 0, F.bround(100 * F.col("passed") / F.col("applicable"), 1)).otherwise(0.0)
    return sums.withColumn("score", percent).withColumn("status", status(F.col("review"), F.col("applicable"), F.col("score"))).withColumn("finalizable", ~F.col("review"))


def status(review: Column, applicable: Column, score: Column) -> Column:
    return F.when(review | (applicable == 0), "NEEDS_REVIEW").when(score >= 100, "COMPLIANT").otherwise("NON_COMPLIANT")


def downgrade(result: Column, origin: Column, confidence: Column, least: float = 0.6) -> Column:
    """A verdict on a reading of low confidence becomes a review."""
    return F.when((origin == "OCR") & (confidence < least) & result.isin("PASS", "FAIL"), "NEEDS_REVIEW").otherwise(result)


def histogram(df: DataFrame, by: list[str], column: str, values: list) -> DataFrame:
    """A column for each value, zero where a key has none of it."""
    return df.groupBy(*by).agg(*(F.count_if(F.col(column) == v).alias(str(v)) for v in values))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def verification(results: DataFrame, violations: DataFrame, by: list[str]) -> DataFrame:
    """What a consumer is told of each product: VERIFIED, NEEDS_REVIEW or NOT_VERIFIED."""
    r = results.groupBy(*by).agg(F.bool_or((F.col("result") == "NEEDS_REVIEW") & (F.col("weight") > 0)).alias("__review"))
    v = violations.groupBy(*by).agg(F.bool_or(F.col("inspector_status").isin("PENDING", "REQUIRES_REVIEW")).alias("__open"), F.bool_or(F.col("inspector_status") == "CONFIRMED").alias("__confirmed"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = F.when(F.col("__review").isNull(), "NOT_VERIFIED").when(no("__review") | no("__open"), "NEEDS_REVIEW").when(no("__confirmed"), "NOT_VERIFIED").otherwise("VERIFIED")
    return r.join(v, by, "full").select(*by, state.alias("verification"))
