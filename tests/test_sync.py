"""A sync of four tables in order of dependency, on rows made by hand."""

from pyspark.sql import functions as F

from canonry.operators import sync

VERSION = "version_id string, check_id string, requirement string, text string, start string, end string, status string"


def bases(spark):
    make = spark.createDataFrame
    have = {
        "rules": make([("R1", 1), ("R2", 2)], "rule_number string, rule_id int"), "sources": make([(" The Act ", 7)], "title string, source_id int"), "checks": make([("c1", "R1", "a", None)], "check_id string, rule_number string, sub_rule string, clause string"),
        "versions": make([("v1", "c1", "old", "t", "2020-01-01", None, "IN_FORCE", "R1", "a", None, "LIMIT"), ("v0", "c1", "older", "t", "2010-01-01", "2020-01-01", "SUPERSEDED", "R1", "a", None, "DECLARATION")], VERSION + ", rule_number string, sub_rule string, clause string, requirement_type string"),
        "applicability": make([("a1", "v1", "{}", "REQUIRED")], "applicability_id string, version_id string, condition string, result string"), "weights": make([("c1", 5.0, "high")], "check_id string, weight double, severity string"),
    }
    offered = {
        "checks": make([("c1", "R1", "a", None), ("c2", "R2", "a", None), ("c3", "R9", "a", None)], "check_id string, rule_number string, sub_rule string, clause string"),
        "versions": make(
            [("v1", "c1", "CHANGED", "t", "2020-01-01", None, "IN_FORCE", "the act"), ("v2", "c1", "new", "t", "2021-01-01", None, "IN_FORCE", "THE ACT"), ("v2", "c1", "new", "t", "2021-01-01", None, "IN_FORCE", "THE ACT"), ("v3", "c2", "first", "t", "2021-01-01", None, "IN_FORCE", "the act"), ("v4", "c1", "x", "t", "2021-01-01", None, "IN_FORCE", "nowhere"), ("v5", "c9", "x", "t", "2021-01-01", None, "IN_FORCE", "the act"), ("v6", "c3", "x", "t", "2021-01-01", None, "IN_FORCE", None)],
            VERSION + ", source_title string",
        ),
        "applicability": make([("a1", "v1", "{}", "EXEMPT"), ("a2", "v2", "{}", "REQUIRED"), ("a3", "v3", "{}", "REQUIRED"), ("a4", "v1", "{}", "REQUIRED")], "applicability_id string, version_id string, condition string, result string"),
        "weights": make([("c1", 5.0, "HIGH"), ("c2", 1.0, "LOW")], "check_id string, weight double, severity string"),
    }
    return have, offered


def told(planned, name, key):
    return {r[key]: (r["action"], r["note"]) for r in planned[name].collect()}


def test_every_table_meets_its_actions_and_a_second_run_adds_nothing(spark):
    have, offered = bases(spark)
    first = sync.plan(have, offered)
    assert told(first, "checks", "check_id") == {"c1": ("SAME", None), "c2": ("INSERT", None), "c3": ("ERROR", "no catalogue entry")}
    other, there = "other content under this id", "no longer offered"
    assert told(first, "versions", "version_id") == {"v1": ("CONFLICT", other), "v2": ("INSERT", None), "v3": ("CONFLICT", "no sibling to inherit from"), "v4": ("ERROR", "no such source"), "v5": ("ERROR", "unknown check"), "v6": ("ERROR", "no catalogue entry"), "v0": ("KEPT", there)}
    assert told(first, "applicability", "applicability_id") == {"a1": ("CONFLICT", other), "a2": ("INSERT", None), "a3": ("BLOCKED", "its version was not applied"), "a4": ("INSERT", None)}
    assert told(first, "weights", "check_id") == {"c1": ("SAME", None), "c2": ("UPSERT", None)}
    now = sync.applied(have, first)
    new = now["versions"].where("version_id = 'v2'").collect()
    assert [(r["requirement_type"], r["rule_number"], r["requirement"]) for r in new] == [("LIMIT", "R1", "new")] and now["versions"].where("version_id = 'v1'").first()["requirement"] == "old"
    again = sync.plan(now, offered)
    assert sync.summary(again).where(F.col("action").isin("INSERT", "UPSERT")).count() == 0
    for name in ("checks", "versions", "applicability", "weights"):
        assert sorted(map(str, sync.applied(now, again)[name].collect())) == sorted(map(str, now[name].collect()))


def test_new_versions_that_overlap(spark):
    have, offered = bases(spark)
    assert [tuple(r) for r in sync.overlapping(have, sync.plan(have, offered)).collect()] == [("v2", "v1")]


def test_what_is_there_is_not_looked_up(spark):
    first = sync.plan(*bases(spark))
    rows = {r["applicability_id"]: r["source_id"] for r in first["applicability"].collect()} | {r["version_id"]: r["rule_id"] for r in first["versions"].collect()}
    assert rows["a1"] is None and rows["v1"] is None and rows["a2"] == 7 and rows["v2"] == 1


def test_a_second_run_moves_little(spark):
    have, offered = bases(spark)
    first = sync.plan(have, offered)
    second = sync.summary(sync.plan(sync.applied(have, first), offered))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        plan = sync.summary(first).unionByName(second)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert plan.count("SortMergeJoin") < 60
