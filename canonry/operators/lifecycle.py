"""Event logs: which transitions are allowed, the current state, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The allowed steps of a complaint and of a suggestion.
COMPLAINT = {
    "SUBMITTED": ["ACKNOWLEDGED", "CLOSED"],
    "ACKNOWLEDGED": ["UNDER_REVIEW", "CLOSED"],
    "UNDER_REVIEW": ["INSPECTION_SCHEDULED", "ACTION_TAKEN", "CLOSED"],
    "INSPECTION_SCHEDULED": ["INSPECTION_COMPLETED", "CLOSED"],
    "INSPECTION_COMPLETED": ["ACTION_TAKEN", "CLOSED"],
    "ACTION_TAKEN": ["RESOLVED", "CLOSED"],
    "RESOLVED": ["CLOSED"],
    "CLOSED": [],
}
SUGGESTION = {"SUBMITTED": ["UNDER_REVIEW", "ACKNOWLEDGED", "CLOSED"], "UNDER_REVIEW": ["ACKNOWLEDGED", "ACTIONED", "CLOSED"], "ACKNOWLEDGED": ["ACTIONED", "CLOSED"], "ACTIONED": ["CLOSED"], "CLOSED": []}


def steps(spark: SparkSession, table: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in table.items() for b in bs], "from_status string, to_status string")


def with_previous(log: DataFrame, id_: str, status: str, order: list[str]) -> DataFrame:
    """Each event with the state before it."""
    return log.withColumn("from_status", F.lag(status).over(Window.partitionBy(id_).orderBy(*order)))


def judged(log: DataFrame, allowed: DataFrame, id_: str, status: str, order: list[str]) -> DataFrame:
    """Each event with ``valid``: the first, or an allowed step from the state before."""
    prev = with_previous(log, id_, status, order)
    ok = allowed.select(F.col("from_status").alias("__f"), F.col("to_status").alias("__t"), F.lit(True).alias("__ok")).distinct()
    return prev.join(ok, (prev["from_status"] == ok["__f"]) & (prev[status] == ok["__t"]), "left").withColumn("valid", F.col("from_status").isNull() | F.coalesce("__ok", F.lit(False))).drop("__f", "__t", "__ok")


def current(log: DataFrame, id_: str, status: str, order: list[str]) -> DataFrame:
    return log.groupBy(id_).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count("*").alias("events"))
