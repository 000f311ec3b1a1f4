"""A rule base brought up to an offered one by inserts alone, over tables that depend on each other.

Tables are dictionaries of DataFrames: ``rules`` (``rule_number``, ``rule_id``) and ``sources`` (``title``, ``source_id``) are only read;
``checks``, ``versions``, ``applicability`` and ``weights`` are brought up in that order, each against what the one before it
will hold. History is never changed or deleted: what differs under the same id is a conflict, what isn't offered any more is kept.
A version takes the kind of requirement of its check's latest version; a check without one
waits for a person. Weights alone are replaced. Everything is equi-joins on ids, so a second run finds nothing to add.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import temporal

_KEYS = {"checks": "check_id", "versions": "version_id", "applicability": "applicability_id", "weights": "check_id"}
CONTENT = ["requirement", "text", "start", "end", "status"]


def _told(content: Column) -> tuple[Column, Column]:
    """Action and note of a row whose id is there with ``__old`` content."""
    same = F.col("__old").eqNullSafe(content)
    return F.when(same, "SAME").otherwise("CONFLICT"), F.when(~same, "other content under this id")


def _title(c: str) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def _once(df: DataFrame, key: str) -> DataFrame:
    """One row an id: of several the least by the other columns."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*(c for c in df.columns if c != key)))
    return df.withColumn("__n", place).where("__n = 1").drop("__n")


def plan(have: dict[str, DataFrame], offered: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What to do with each row: by table, the offered columns with ``action`` (INSERT, UPSERT, CONFLICT, BLOCKED, ERROR, KEPT or SAME), ``note`` and what an insert resolves.

    Offered ``checks`` have ``check_id``, ``rule_number``, ``sub_rule``, ``clause``; ``versions`` have ``version_id``, ``check_id``, ``source_title`` and the content;
    ``applicability`` has ``applicability_id``, ``version_id``, ``condition``, ``result``; ``weights`` have ``check_id``, ``weight``, ``severity``.
    """
    offered = {name: _once(df, _KEYS[name]) for name, df in offered.items()}
    rules = have["rules"].groupBy("rule_number").agg(F.min("rule_id").alias("rule_id"))
    sources = have["sources"].groupBy(_title("title").alias("__title")).agg(F.min("source_id").alias("source_id")).where("__title is not null")

    known = have["checks"].select("check_id", F.lit(True).alias("__known"))
    checks = offered["checks"].join(known, "check_id", "left").join(rules, "rule_number", "left")
    checks = checks.withColumn("action", F.when(F.col("__known"), "SAME").when(F.col("rule_id").isNull(), "ERROR").otherwise("INSERT")).withColumn("note", F.when(F.col("action") == "ERROR", "no catalogue entry"))

    # The kind of requirement comes from the latest version that is there; those inserted take it over, so their order decides nothing.
    latest = have["versions"].groupBy("check_id").agg(F.max_by("requirement_type", F.struct("start", "version_id")).alias("requirement_type"))
    places = offered["checks"].select("check_id", "rule_number", "sub_rule", "clause", F.lit(True).alias("__check"))
    old = have["versions"].select("version_id", F.struct(*CONTENT).alias("__old"))
    v = offered["versions"].withColumn("__new", F.lit(True)).join(old, "version_id", "full").withColumn("__title", _title("source_title")).join(sources, "__title", "left")
    # What is there is decided by its content; only the rest is looked up elsewhere, so little of it moves twice.
    action, note = _told(F.struct(*CONTENT))
    kept = F.col("__new").isNull()
    known = v.where("__old is not null").withColumn("action", F.when(kept, "KEPT").otherwise(action)).withColumn("note", F.when(kept, "no longer offered").otherwise(note))
    action = F.when(F.col("__check").isNull() | F.col("rule_id").isNull() | F.col("source_id").isNull(), "ERROR").when(F.col("requirement_type").isNull(), "CONFLICT").otherwise("INSERT")
    note = F.when(F.col("__check").isNull(), "unknown check").when(F.col("rule_id").isNull(), "no catalogue entry").when(F.col("source_id").isNull(), "no such source").when(F.col("requirement_type").isNull(), "no sibling to inherit from")
    fresh = v.where("__old is null").join(places, "check_id", "left").join(rules, "rule_number", "left").join(latest, "check_id", "left").withColumn("action", action).withColumn("note", note)
    versions = known.unionByName(fresh, allowMissingColumns=True)

    there = F.col("__old").isNotNull() | (F.col("action") == "INSERT")
    cited = versions.select("version_id", there.alias("__there"), "source_id").groupBy("version_id").agg(F.max("__there").alias("__there"), F.max("source_id").alias("source_id"))
    old = have["applicability"].select("applicability_id", F.struct("condition", "result").alias("__old"))
    a = offered["applicability"].join(old, "applicability_id", "left")
    action, note = _told(F.struct("condition", "result"))
    known = a.where("__old is not null").withColumn("action", action).withColumn("note", note)
    action = F.when(~F.coalesce("__there", F.lit(False)), "BLOCKED").when(F.col("source_id").isNull(), "ERROR").otherwise("INSERT")
    note = F.when(F.col("action") == "BLOCKED", "its version was not applied").when(F.col("action") == "ERROR", "no such source")
    fresh = a.where("__old is null").join(cited, "version_id", "left").withColumn("action", action).withColumn("note", note)
    applicability = known.unionByName(fresh, allowMissingColumns=True)

    old = have["weights"].select("check_id", F.struct(F.col("weight").cast("double").alias("weight"), F.upper("severity").alias("severity")).alias("__old"))
    same = F.col("__old").eqNullSafe(F.struct(F.col("weight").cast("double").alias("weight"), F.upper("severity").alias("severity")))
    weights = offered["weights"].join(old, "check_id", "left").withColumn("action", F.when(same, "SAME").otherwise("UPSERT")).withColumn("note", F.lit(None).cast("string"))
    return {"checks": checks, "versions": versions, "applicability": applicability, "weights": weights}


def summary(planned: dict[str, DataFrame]) -> DataFrame:
    """How many rows of each table meet with each action and note."""
    out = None
    for name, df in planned.items():
        n = df.where("action <> 'SAME'").groupBy("action", "note").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "action", "note", "n")
        out = n if out is None else out.unionByName(n)
    return out


def applied(have: dict[str, DataFrame], planned: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after the plan: all that was there, and what it inserts or, of weights, replaces."""
    out = dict(have)
    for name in ("checks", "versions", "applicability"):
        out[name] = have[name].unionByName(planned[name].where("action = 'INSERT'").select(*have[name].columns))
    new = planned["weights"].where("action = 'UPSERT'").select(*have["weights"].columns)
    out["weights"] = have["weights"].join(new.select("check_id"), "check_id", "left_anti").select(*have["weights"].columns).unionByName(new)
    return out


def overlapping(have: dict[str, DataFrame], planned: dict[str, DataFrame]) -> DataFrame:
    """Versions to insert that overlap one that is there under the same rule, sub-rule and clause: ``version_id``, ``existing_id``."""
    at = ["rule_number", "sub_rule", "clause"]
    both = have["versions"].select(*at, "version_id", "start", "end", F.lit(False).alias("new")).unionByName(planned["versions"].where("action = 'INSERT'").select(*at, "version_id", "start", "end", F.lit(True).alias("new")))
    ids = both.select("version_id", "new")
    pairs = temporal.overlap_pairs(both, at, "version_id", "start", "end")
    met = pairs.join(ids.toDF("earlier_id", "__a"), "earlier_id").join(ids.toDF("later_id", "__b"), "later_id").where(F.col("__a") != F.col("__b"))
    return met.select(F.when(F.col("__a"), F.col("earlier_id")).otherwise(F.col("later_id")).alias("version_id"), F.when(F.col("__a"), F.col("later_id")).otherwise(F.col("earlier_id")).alias("existing_id"))
