"""How extraction compares with verified values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import ratio


def summary(truth: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """One row: how many values are ``expected``, ``covered``, ``exact``, and the ratios."""
    j = truth.join(got, key, "left")
    counts = j.agg(F.count("*").alias("expected"), F.count("found").alias("covered"), F.count_if(F.col("found") == F.col("expected")).alias("exact"))
    return counts.withColumns({"coverage": ratio(F.col("covered"), F.col("expected")), "agreement": ratio(F.col("exact"), F.col("covered"))})
