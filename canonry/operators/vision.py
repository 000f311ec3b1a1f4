"""Candidates of a vision model: irregular answers to rows, validation, overlay, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent_confidence

#: Other names of fields and of statuses, phrases of doubt.
ALIASES = {"price": "mrp", "max_retail_price": "mrp", "net_weight": "quantity", "net_quantity": "quantity", "mfg_date": "manufacturing_date", "expiry": "use_by", "fssai": "fssai_license", "phone": "consumer_care"}
STATUSES = {"found": "DETECTED", "detected": "DETECTED", "visible": "DETECTED", "unclear": "NEEDS_REVIEW", "partial": "NEEDS_REVIEW", "needs_review": "NEEDS_REVIEW", "missing": "NOT_DETECTED", "not_found": "NOT_DETECTED", "not_detected": "NOT_DETECTED"}
DOUBT = r"(?i)\b(?:maybe|probably|appears|seems|possibly|unclear|might be|not sure)\b"
_ENTRY = "value string, status string, confidence double, evidence_text string"


def _named(table: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), default)


def flatten(answers: DataFrame, by: list[str], column: str = "answer") -> DataFrame:
    """One row a field of an answer: a list, a map of fields, or that under ``fields``, perhaps in a code fence. Unreadable answers give none."""
    bare = F.trim(F.regexp_replace(F.trim(column), r"^```[a-z]*\s*|\s*```$", ""))
    read = answers.select(*by, bare.alias("__j"))
    as_list = F.from_json("__j", f"array<struct<field:string, {', '.join(x.replace(' ', ':') for x in _ENTRY.split(', '))}>>")
    entry = f"map<string, struct<{', '.join(x.replace(' ', ':') for x in _ENTRY.split(', '))}>>"
    nested = F.from_json(F.get_json_object("__j", "$.fields"), entry)
    flat = F.from_json("__j", entry)
    listed = read.where("__j like '[%'").select(*by, F.inline(as_list))
    mapped = read.where("__j like '{%'").select(*by, F.explode(F.coalesce(nested, flat)).alias("field", "e")).where("e is not null and field <> 'fields'").select(*by, "field", "e.*")
    rows = listed.unionByName(mapped)
    return rows.select(*by, _named(ALIASES, F.lower(F.trim("field")), F.lower(F.trim("field"))).alias("field"), "value", _named(STATUSES, F.lower("status"), F.lit("NEEDS_REVIEW")).alias("status"), percent_confidence(F.col("confidence")).alias("confidence"), "evidence_text")


def validated(candidates: DataFrame) -> DataFrame:
    """A value in doubt or without evidence of its text is for review; one without a value isn't detected."""
    doubt = F.coalesce(F.col("value").rlike(DOUBT) | F.col("evidence_text").rlike(DOUBT), F.lit(False))
    empty = F.coalesce(F.trim("value") == "", F.lit(True))
    status = F.when(empty, "NOT_DETECTED").when(doubt & (F.col("status") == "DETECTED"), "NEEDS_REVIEW").otherwise(F.col("status"))
    return candidates.withColumn("status", status)


def with_fallback(requested: DataFrame, answered: DataFrame, by: list[str]) -> DataFrame:
    """Requested fields that no answer holds, for review, beside those that one does."""
    missing = requested.join(answered, [*by, "field"], "left_anti").select(*by, "field", F.lit(None).cast("string").alias("value"), F.lit("NEEDS_REVIEW").alias("status"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("evidence_text"))
    return answered.unionByName(missing)


def overlay(ocr: DataFrame, vision: DataFrame, by: list[str], least: float = 0.85) -> DataFrame:
    """Readings are trusted; what only the model saw counts with enough confidence and the text it saw."""
    o = ocr.select(*by, "field", F.col("value").alias("o_value"), F.col("status").alias("o_status"))
    v = vision.select(*by, "field", F.col("value").alias("v_value"), F.col("status").alias("v_status"), "confidence", "evidence_text")
    seen = (F.col("v_status") == "DETECTED") & (F.col("confidence") >= least) & F.coalesce(F.trim("evidence_text") != "", F.lit(False))
    has = F.coalesce(F.col("o_status") == "DETECTED", F.lit(False))
    status = F.when(has, "DETECTED").when(F.col("v_value").isNotNull() & seen, "DETECTED").when(F.col("v_value").isNotNull() | F.col("o_value").isNotNull(), "NEEDS_REVIEW").otherwise("NOT_DETECTED")
    return o.join(v, [*by, "field"], "full").select(*by, "field", F.when(has, F.col("o_value")).otherwise(F.coalesce("v_value", "o_value")).alias("value"), status.alias("status"))


def readiness(required: DataFrame, fields: DataFrame, by: list[str]) -> DataFrame:
    """How many required fields are there, for review or missing, and which hold the case up."""
    j = required.join(fields.select(*by, "field", "status"), [*by, "field"], "left")
    state = F.coalesce("status", F.lit("NOT_DETECTED"))
    return j.groupBy(*by).agg(
        F.count("*").alias("required"),
        F.count_if(state == "DETECTED").alias("detected"),
        F.count_if(state == "NEEDS_REVIEW").alias("review"),
        F.count_if(state == "NOT_DETECTED").alias("missing"),
        F.array_join(F.sort_array(F.collect_list(F.when(state != "DETECTED", F.col("field")))), ",").alias("blocked"),
    )
