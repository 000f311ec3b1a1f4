"""Readers of rule bases and registries, days, versions in force and migrations."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from canonry.sources import io


def test_a_rule_base_and_a_registry_of_json(spark, tmp_path):
    base = {"rules": [{"rule_id": "C1", "weight": 5.0, "when": {"field": "x"}}, {"rule_id": "C2", "weight": None, "when": None}], "name": "base"}
    (tmp_path / "rules.json").write_text(json.dumps(base, indent=1))
    got = io.read_specs(spark, f"{tmp_path}/rules.json", "rules").orderBy("rule_id").collect()
    assert [(r["rule_id"], r["weight"], r["when"] and r["when"]["field"]) for r in got] == [("C1", 5.0, "x"), ("C2", None, None)]
    assert io.read_specs(spark, f"{tmp_path}/rules.json").first()["name"] == "base"
    (tmp_path / "names.json").write_text(json.dumps({"entries": [{"name": " Palm Oil", "e": 1}, {"name": "salt", "e": 2}]}))
    assert [(r["ordinal"], r["entry"], r["e"]) for r in io.read_registry(spark, f"{tmp_path}/names.json", "entries", "name").orderBy("ordinal").collect()] == [(0, "palm oil", 1), (1, "salt", 2)]


def test_days_and_versions_in_force(spark):
    today = datetime.date.today()
    day = lambda n: today + datetime.timedelta(n)
    v = spark.createDataFrame([(1, day(-9), None), (2, day(-9), day(0)), (3, day(1), None), (4, day(0), day(9)), (5, None, None)], "id int, a date, b date")
    assert sorted(r["id"] for r in io.in_force_now(v, "a", "b").collect()) == [1, 4]
    assert sorted(r["id"] for r in io.in_force_now(v, "a", "b", F.date_add(F.current_date(), 1)).collect()) == [1, 3, 4]
    t = spark.createDataFrame([(1, "2024-01-01 23:59:59"), (2, "2024-01-02 00:00:00"), (3, None)], "id int, t string").withColumn("t", F.col("t").cast("timestamp"))
    ids = lambda *w: [r["id"] for r in t.where(io.within(t.t, *w)).orderBy("id").collect()]
    assert ids("2024-01-01", "2024-01-01") == [1] and ids("2024-01-02", None) == [2] and ids(None, "2024-01-02") == ids(None, None) == [1, 2]
    assert io.one(t, [F.desc("t"), "id"]).first()["id"] == 2 and io.one(t.limit(0), ["id"]).count() == 0


def test_migrations_run_once_and_go_on_after_a_failure(spark, tmp_path):
    steps = [("002", "CREATE TABLE mig_b USING parquet AS SELECT * FROM mig_a"), ("001", f"CREATE TABLE mig_a USING parquet LOCATION '{tmp_path}/a' AS SELECT 1 AS x"), ("003", "SELECT nonsense FROM mig_b")]
    try:
        with pytest.raises(Exception, match="nonsense"):
            io.migrate(spark, "mig_ledger", steps)
        assert io.exists(spark, "mig_b") and not io.exists(spark, "mig_c")
        assert io.migrate(spark, "mig_ledger", [*steps[:2], ("003", "CREATE TABLE mig_c USING parquet AS SELECT * FROM mig_b")]) == ["003"]
        assert io.migrate(spark, "mig_ledger", steps[:2]) == [] and spark.table("mig_c").first()["x"] == 1
    finally:
        for name in ("mig_a", "mig_b", "mig_c", "mig_ledger"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
