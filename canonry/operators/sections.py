"""Verdicts on whole texts, as ordered CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def junk_kind(text: Column) -> Column:
    """What a text is contaminated with; the first kind that applies."""
    return (
        F.when(text.rlike("[#$%&*]{3}( |$)"), "symbols")
        .when(F.contains(text, F.lit("!! ")), "shouting")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(text.rlike("(?i)license|copyright"), "legal")
        .otherwise("none")
    )


def coherence_status(score: Column) -> Column:
    return F.when(score < 0.35, "NOT_DETECTED").when(score < 0.70, "NEEDS_REVIEW").otherwise("DETECTED")
