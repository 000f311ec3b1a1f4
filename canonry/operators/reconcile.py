"""Reconciliation of candidates for a field from several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def comparison_key(field: Column, value: Column) -> Column:
    """A value as it is compared: amounts with two decimals, phones as digits, symbols upper case, the rest folded."""
    return (
        F.when(field == "mrp", F.format_string("%.2f", F.expr("try_cast(regexp_replace(value, '[^0-9.]', '') as double)")))
        .when(field.isin("consumer_care", "fssai_license"), F.regexp_replace(value, "[^0-9]", ""))
        .when(field == "veg_nonveg_symbol", F.upper(F.trim(value)))
        .otherwise(F.lower(F.regexp_replace(F.trim(value), r"\s+", " ")))
    )


def reconcile(candidates: DataFrame, by: list[str]) -> DataFrame:
    """``value``, ``key``, ``confidence``, ``source`` to one row a field.

    One key among all: agreed, with the least confidence of those that agree.
    Several: a conflict that keeps every value, the best first in the final one, at
    the greatest confidence, for review.
    """
    one = F.count_distinct("key") == 1
    best = F.max_by("value", F.struct("confidence", "source"))
    return candidates.where("value is not null").groupBy(*by).agg(
        best.alias("final_value"),
        F.when(one & (F.count("*") > 1), "AGREED").when(one, "SINGLE").otherwise("CONFLICT").alias("agreement"),
        F.when(one, F.min("confidence")).otherwise(F.max("confidence")).alias("confidence"),
        F.count("*").alias("candidates"),
        F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"),
    )


def verdict(ocr: Column, vision: Column) -> Column:
    """What two readings of a field, each perhaps missing, say together."""
    return F.when(ocr.isNotNull() & vision.isNotNull() & (ocr == vision), "AI_VERIFIED").when(ocr.isNotNull() & vision.isNotNull(), "CONFLICT").when(vision.isNotNull(), "AI_EXTRACTED").when(ocr.isNotNull(), "OCR_ONLY").otherwise("NOT_DETECTED")
