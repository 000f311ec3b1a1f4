"""Queries whose sides read whole tables: no id is left out, and unmatched sides come from the rows."""

import pytest

from canonry import catalog

SF = "/root/testdata/sf0.01"


def ran(spark, name):
    return catalog.queries()[name](spark, SF)


def ids(spark, table, column):
    return {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(column).collect()}


def test_every_customer_is_in_the_corrections(spark):
    got = {r["user_id"] for r in ran(spark, "q62b_all_corrections").where("field = 'view'").collect()}
    assert ids(spark, "customer", "c_custkey") <= got


@pytest.mark.parametrize(("name", "values"), [("q42b_verdicts_of_all", {"OCR_ONLY", "AI_EXTRACTED", "AI_VERIFIED", "CONFLICT"}), ("q05b_condition_of_all", {"true", "false", "unknown"})])
def test_all_outcomes_occur(spark, name, values):
    assert values <= {r["verdict"] for r in ran(spark, name).collect()}


def test_ids_decide_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    readable = {r[0] for r in docs.where("n_chars >= 200").select("doc_id").collect()}
    unread = {r["doc_id"] for r in ran(spark, "q42b_verdicts_of_all").where("verdict in ('AI_EXTRACTED', 'NOT_DETECTED')").collect()}
    assert any(i % 3 == 0 for i in readable) and not readable & unread
    orders, customers = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "customer"))
    rich = orders.where("o_orderstatus = 'F'").join(customers.where("c_custkey % 2 = 0 and c_acctbal > 5000"), orders.o_custkey == customers.c_custkey).select("o_orderkey")
    assert rich.count() and {r["verdict"] for r in ran(spark, "q05b_condition_of_all").join(rich, "o_orderkey").collect()} == {"true"}
    shown = spark.read.parquet(f"{SF}/labels.parquet").join(docs.where("not text like '% | %' and not text rlike '(?i)license|copyright'"), "doc_id").count()
    assert ran(spark, "q40b_evaluation_of_all").first()["covered"] >= shown
