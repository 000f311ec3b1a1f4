"""Corrections, notifications, officers' actions, error patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What an officer's action makes of a violation.
ACTIONS = {"confirm": "CONFIRMED", "reject": "REJECTED", "review": "REQUIRES_REVIEW"}


def verified_overlay(values: DataFrame, corrections: DataFrame, by: list[str]) -> DataFrame:
    """``value`` of each field with the latest verified correction in its place; ``corrected`` tells which."""
    latest = corrections.where("verified").groupBy(*by, "field").agg(F.max_by("corrected_value", F.struct("created_at", "id")).alias("__c"))
    out = values.join(latest, [*by, "field"], "full")
    return out.select(*by, "field", F.coalesce("__c", "value").alias("value"), F.col("__c").isNotNull().alias("corrected"))


def fan_out(messages: DataFrame, audiences: dict[str, list[str]]) -> DataFrame:
    """One unread notification a member of each message's audience."""
    table = F.create_map(*(x for k, members in audiences.items() for x in (F.lit(k), F.array(*map(F.lit, members)))))
    return messages.withColumn("recipient", F.explode(F.element_at(table, F.col("audience")))).withColumn("read", F.lit(False))


def mark_read(notifications: DataFrame, reads: DataFrame) -> DataFrame:
    """``reads``: ids, or a null id for all of a recipient's up to ``at``."""
    one = reads.where("id is not null").select("id", F.lit(True).alias("__one")).distinct()
    every = reads.where("id is null").groupBy("recipient").agg(F.max("at").alias("__until"))
    j = notifications.join(one, "id", "left").join(every, "recipient", "left")
    return j.withColumn("read", F.col("read") | F.coalesce("__one", F.lit(False)) | F.coalesce(F.col("created_at") <= F.col("__until"), F.lit(False))).drop("__one", "__until")


def decided(violations: DataFrame, actions: DataFrame) -> DataFrame:
    """Violations with the status of their latest action."""
    table = F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))
    latest = actions.groupBy("violation_id").agg(F.max_by("action", F.struct("at", "action_id")).alias("__a"), F.max("at").alias("decided_at"))
    return violations.join(latest, "violation_id", "left").withColumn("inspector_status", F.coalesce(F.element_at(table, F.col("__a")), F.col("inspector_status"))).drop("__a")


def failure_kind(original: str = "original_value", corrected: str = "corrected_value", status: str = "original_status"):
    """Why a reading had to be corrected."""
    o, c = F.col(original), F.col(corrected)
    return F.when(o.isNull() | (o == ""), F.when(F.col(status) == "NOT_DETECTED", "missed").otherwise("empty")).when(F.regexp_replace(F.lower(o), "[^a-z0-9]", "") == F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), "format").when(F.levenshtein(o, c, 2) >= 0, "misread").otherwise("wrong_value")


def patterns(corrections: DataFrame, last: int = 3) -> DataFrame:
    """Counts by field and kind of failure, with the ids of the latest."""
    kinds = corrections.withColumn("kind", failure_kind())
    w = Window.partitionBy("field", "kind").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = kinds.withColumn("__r", F.row_number().over(w))
    return ranked.groupBy("field", "kind").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("__r") <= last, F.struct("__r", F.col("id").cast("string").alias("i"))))), lambda x: x["i"]), ",").alias("latest"))
