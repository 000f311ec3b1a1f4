"""Validation of a rule manifest: one row a problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def problems(manifest: DataFrame, checks: list[str], kinds: list[str]) -> DataFrame:
    """``rule_id``, ``valid_from``, ``problem``; every test sees each row once, in one pass and one window."""
    w = Window.partitionBy("rule_id", "check_id").orderBy("valid_from").rowsBetween(Window.unboundedPreceding, -1)
    far = F.max(F.coalesce(F.col("valid_to"), F.lit("9999"))).over(w)
    tests = {
        "missing check": F.col("check_id").isNull(),
        "unknown check": ~F.col("check_id").isin(checks),
        "unknown check type": ~F.col("check_type").isin(kinds),
        "empty interval": F.col("valid_to") <= F.col("valid_from"),
        "negative weight": F.col("weight") < 0,
        "overlap": F.col("__far") > F.col("valid_from"),
    }
    found = F.filter(F.array(*(F.when(t, F.lit(name)) for name, t in tests.items())), lambda x: x.isNotNull())
    return manifest.withColumn("__far", far).select("rule_id", "valid_from", F.explode(found).alias("problem"))


#: What a version's status, an applicability's result and a weight's severity may be.
STATUSES = ["IN_FORCE", "SUPERSEDED", "NOT_YET_IN_FORCE", "REPEALED", "DRAFT"]
RESULTS = ["REQUIRED", "NOT_REQUIRED", "NOT_APPLICABLE", "CONDITIONAL", "NEEDS_REVIEW"]
SEVERITIES = ["HIGH", "MEDIUM", "LOW"]


def structure_problems(checks: DataFrame, versions: DataFrame, applicability: DataFrame, weights: DataFrame, kinds: list[str], statuses: list[str] = STATUSES, results: list[str] = RESULTS) -> DataFrame:
    """``table``, ``id``, ``problem`` of a manifest whose parts are tables with all values as text; a table without rows has the problem ``empty``.

    Rows are tested one by one, after equi-joins on the ids that they cite. Columns: ``check_id title field check_type rule_number``; ``version_id check_id
    status start end requirement text supersedes superseded_by``; ``applicability_id version_id result conditions``; ``check_id severity weight``.
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    unknown = lambda c, values: ~F.coalesce(F.col(c).isin(values), F.lit(False))
    # A date is ISO's: nothing that a looser reader might accept.
    bad_date = lambda c: F.col(c).isNotNull() & (~F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$") | F.col(c).try_cast("date").isNull())
    there = lambda df, c, as_: df.where(F.col(c).isNotNull()).select(F.col(c).alias(as_)).distinct().withColumn(f"__{as_}", F.lit(True))

    def told(df: DataFrame, name: str, id_: str, tests: dict) -> DataFrame:
        found = F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(p)) for p, t in tests.items())), lambda x: x.isNotNull())
        rows = df.select(F.lit(name).alias("table"), F.col(id_).alias("id"), F.explode(found).alias("problem"))
        none = df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(name).alias("table"), F.lit(None).cast("string").alias("id"), F.lit("empty").alias("problem"))
        return rows.unionByName(none)

    known = there(checks, "check_id", "check_id")
    ids = versions.groupBy("version_id").agg(F.count("*").alias("__times"))
    v = versions.join(ids, "version_id", "left").join(known, "check_id", "left")
    for c in ("supersedes", "superseded_by"):
        v = v.join(there(versions, "version_id", c), c, "left")
    a = applicability.join(there(versions, "version_id", "version_id"), "version_id", "left")
    w = weights.join(known, "check_id", "left")
    number = F.col("weight").try_cast("double")
    return (
        told(checks, "checks", "check_id", {f"missing {c}": blank(c) for c in ("check_id", "title", "field", "check_type", "rule_number")} | {"unknown check type": unknown("check_type", kinds)})
        .unionByName(told(v, "versions", "version_id", {
            "duplicate id": F.col("__times") > 1, "unknown check": F.col("__check_id").isNull(), "unknown status": unknown("status", statuses), "bad start": bad_date("start"), "bad end": bad_date("end"), "no start": F.col("start").isNull(),
            "missing requirement": blank("requirement"), "missing text": blank("text"), "dangling supersedes": F.col("supersedes").isNotNull() & F.col("__supersedes").isNull(), "dangling superseded_by": F.col("superseded_by").isNotNull() & F.col("__superseded_by").isNull(),
        }))
        .unionByName(told(a, "applicability", "applicability_id", {"unknown version": F.col("__version_id").isNull(), "unknown result": unknown("result", results), "conditions are no object": F.coalesce(F.get_json_object("conditions", "$").substr(1, 1) != "{", F.lit(True))}))
        .unionByName(told(w, "weights", "check_id", {"unknown check": F.col("__check_id").isNull(), "bad severity": unknown("severity", SEVERITIES), "negative": number < 0, "not a number": number.isNull() | F.isnan(number)}))
    )
