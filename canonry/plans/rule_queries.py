"""Queries of the rule engine over orders, parts and line items, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring, temporal
from .applicability import decide
from .checks import check
from .conditions import Facts, compile_condition


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: check: (weight, kind, field, params, condition under which it is not applicable).
ORDER_CHECKS = {
    "PRICE": (20.0, "NUMERIC_COMPARE", "o_totalprice", {"op": "gte", "value": 50000}, None),
    "PRIORITY": (15.0, "REGEX_MATCH", "o_orderpriority", {"pattern": "[1-4]-"}, None),
    "SEGMENT": (10.0, "TEXT_CONTAINS", "c_mktsegment", {"value": "i"}, {"field": "o_orderstatus", "eq": "P"}),
    "LINES": (15.0, "NUMERIC_COMPARE", "n_lines", {"op": "gt", "value": 0}, None),
    "RETURNS": (10.0, "NUMERIC_COMPARE", "n_returned", {"op": "lte", "value": 1}, {"field": "n_lines", "op": "eq", "value": None}),
    "MANUAL": (0.0, "MANUAL_REVIEW", "o_orderstatus", {}, {"field": "o_orderstatus", "neq": "P"}),
}


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority").join(lines, "o_orderkey", "left").join(customers, "o_custkey", "left")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with all its findings in one array, ``found``."""
    df = order_facts(spark, sf_dir)
    facts, rows = Facts(df), []
    for name, (weight, kind, field, params, outside) in ORDER_CHECKS.items():
        appl = decide([{"result": "NOT_APPLICABLE", "condition": outside, "reason": "outside"}, {"result": "REQUIRED", "condition": {}, "reason": ""}] if outside else [], facts)
        result = F.when(appl["applicable"], check(kind, facts, field, params)["result"]).when(~appl["applicable"], "NOT_APPLICABLE").otherwise("NEEDS_REVIEW")
        rows.append(F.struct(F.lit(name).alias("check_id"), F.lit(weight).alias("weight"), result.alias("result")))
    return df.select("o_orderkey", F.array(*rows).alias("found"))


def order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_rows(spark, sf_dir).select("o_orderkey", F.inline("found"))


_FINDINGS = """
WITH l AS (SELECT l_orderkey, count(*) n_lines, count(*) FILTER (WHERE l_returnflag = 'R') n_returned FROM lineitem GROUP BY 1),
f AS (SELECT o.*, c_mktsegment, n_lines, n_returned FROM orders o LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey),
r AS (
  SELECT o_orderkey, 'PRICE' check_id, 20.0::DOUBLE weight, CASE WHEN o_totalprice >= 50000 THEN 'PASS' ELSE 'FAIL' END result FROM f
  UNION ALL SELECT o_orderkey, 'PRIORITY', 15.0, CASE WHEN regexp_matches(trim(o_orderpriority), '^[1-4]-') THEN 'PASS' ELSE 'FAIL' END FROM f
  UNION ALL SELECT o_orderkey, 'SEGMENT', 10.0, CASE WHEN o_orderstatus = 'P' THEN 'NOT_APPLICABLE' WHEN contains(lower(c_mktsegment), 'i') THEN 'PASS' ELSE 'FAIL' END FROM f
  UNION ALL SELECT o_orderkey, 'LINES', 15.0, CASE WHEN n_lines > 0 THEN 'PASS' ELSE 'FAIL' END FROM f
  UNION ALL SELECT o_orderkey, 'RETURNS', 10.0, CASE WHEN n_lines IS NULL THEN 'NOT_APPLICABLE' WHEN n_returned <= 1 THEN 'PASS' ELSE 'FAIL' END FROM f
  UNION ALL SELECT o_orderkey, 'MANUAL', 0.0, CASE WHEN o_orderstatus <> 'P' THEN 'NOT_APPLICABLE' ELSE 'NEEDS_REVIEW' END FROM f)
"""


def q01_order_scores(spark, sf_dir):
    scored = scoring.score_row(order_rows(spark, sf_dir), "found")
    return scored.select("o_orderkey", "passed", "applicable", (100 * F.col("passed") / F.col("applicable")).alias("score"), "status", "finalizable")


Q01 = _FINDINGS + """
SELECT o_orderkey, sum(CASE WHEN result = 'PASS' THEN weight ELSE 0 END) passed, sum(CASE WHEN result <> 'NOT_APPLICABLE' THEN weight ELSE 0 END) applicable,
  100 * sum(CASE WHEN result = 'PASS' THEN weight ELSE 0 END) / sum(CASE WHEN result <> 'NOT_APPLICABLE' THEN weight ELSE 0 END) score,
  CASE WHEN bool_or(result = 'NEEDS_REVIEW') THEN 'NEEDS_REVIEW' WHEN sum(CASE WHEN result = 'PASS' THEN weight ELSE 0 END) = sum(CASE WHEN result <> 'NOT_APPLICABLE' THEN weight ELSE 0 END) THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END status,
  NOT bool_or(result = 'NEEDS_REVIEW') finalizable
FROM r GROUP BY 1"""

_VERSIONS = [("V1", "URGENT", "1995-01-01", "1996-06-01"), ("V2", "URGENT", "1996-06-01", None), ("V3", "ANY", "1995-06-15", "1999-01-01"), ("V4", "ANY", "1999-01-01", "2000-07-01"), ("V5", "ANY", "2000-01-01", None)]
_VALUES = ", ".join(f"('{v}', '{c}', DATE '{a}', {f"DATE '{b}'" if b else 'NULL'})" for v, c, a, b in _VERSIONS)


def versions(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_VALUES} AS v(version, check_id, valid_from, valid_to)")


def _dated(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


def q02_versions_as_of(spark, sf_dir):
    return temporal.as_of_join(_dated(spark, sf_dir), versions(spark), "day", "valid_from", "valid_to").select("o_orderkey", "version", "check_id")


_AS_OF = f"FROM orders JOIN (VALUES {_VALUES}) v(version, check_id, valid_from, valid_to) ON valid_from <= o_orderdate::DATE AND (valid_to IS NULL OR valid_to > o_orderdate::DATE)"
Q02 = f"SELECT o_orderkey, version, check_id {_AS_OF}"


def q03_latest_version(spark, sf_dir):
    return temporal.latest(temporal.as_of_join(_dated(spark, sf_dir), versions(spark), "day", "valid_from", "valid_to"), ["o_orderkey", "check_id"], [F.desc("valid_from"), F.asc("version")]).select("o_orderkey", "check_id", "version")


Q03 = f"SELECT o_orderkey, check_id, version {_AS_OF} QUALIFY row_number() OVER (PARTITION BY o_orderkey, check_id ORDER BY valid_from DESC, version) = 1"


def q04_overlaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("make_dt_interval(0, 0, 0, value * 60)")).alias("stop"))
    return temporal.overlaps(e.withColumn("start", F.col("start").cast("timestamp")), ["user_id"], "event_id", "start", "stop").groupBy("user_id").agg(F.count("*").alias("overlapping"), F.min("later_id").alias("first_later"))


Q04 = """WITH e AS (SELECT user_id, event_id, ts AS s, ts + to_microseconds(round(value * 60 * 1000000)::BIGINT) AS t FROM events)
SELECT user_id, count(*) overlapping, min(event_id) first_later FROM (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) far FROM e) WHERE far > s GROUP BY 1"""


def q04b_overlap_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("start"), (F.col("ts") + F.expr("make_dt_interval(0, 0, 0, value * 60)")).alias("stop"))
    return temporal.overlap_pairs(e, ["user_id"], "event_id", "start", "stop").groupBy("user_id").agg(F.count("*").alias("pairs"), F.min("later_id").alias("first_later"), F.sum(F.abs(F.col("later_id") - F.col("earlier_id"))).alias("apart"))


Q04B = """WITH e AS (SELECT user_id, event_id, ts AS s, ts + to_microseconds(round(value * 60 * 1000000)::BIGINT) AS t FROM events)
SELECT x.user_id, count(*) pairs, min(y.event_id) first_later, sum(abs(y.event_id - x.event_id))::BIGINT apart FROM e x JOIN e y ON x.user_id = y.user_id AND (x.s < y.s OR (x.s = y.s AND x.event_id < y.event_id)) AND y.s < x.t AND x.s < y.t GROUP BY 1"""

_TREE = {"any": [{"all": [{"field": "o_orderstatus", "eq": "F"}, {"field": "c_acctbal", "gt": 5000}]}, {"all": [{"field": "c_mktsegment", "in": ["BUILDING", "FURNITURE"]}, {"field": "o_totalprice", "lt": 100000}]}]}


def q05_condition(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    df = table(spark, sf_dir, "orders").join(c, "o_custkey", "left")
    return df.select("o_orderkey", F.coalesce(compile_condition(_TREE, Facts(df)).cast("string"), F.lit("unknown")).alias("verdict"))


Q05 = """SELECT o_orderkey, coalesce(CASE WHEN (o_orderstatus = 'F' AND c_acctbal > 5000) OR (c_mktsegment IN ('BUILDING', 'FURNITURE') AND o_totalprice < 100000) THEN 'true'
 WHEN NOT ((o_orderstatus = 'F' AND c_acctbal > 5000) OR (c_mktsegment IN ('BUILDING', 'FURNITURE') AND o_totalprice < 100000)) THEN 'false' END, 'unknown') verdict
FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""


def q05b_condition_of_all(spark, sf_dir):
    """All customers; what is known of one in debt is taken as unknown."""
    known = lambda c: F.when(F.col("c_acctbal") >= 0, F.col(c)).alias(c)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), known("c_acctbal"), known("c_mktsegment"))
    df = table(spark, sf_dir, "orders").join(c, "o_custkey", "left")
    return df.select("o_orderkey", F.coalesce(compile_condition(_TREE, Facts(df)).cast("string"), F.lit("unknown")).alias("verdict"))


Q05B = """SELECT o_orderkey, coalesce(CASE WHEN (o_orderstatus = 'F' AND b > 5000) OR (m IN ('BUILDING', 'FURNITURE') AND o_totalprice < 100000) THEN 'true'
 WHEN NOT ((o_orderstatus = 'F' AND b > 5000) OR (m IN ('BUILDING', 'FURNITURE') AND o_totalprice < 100000)) THEN 'false' END, 'unknown') verdict
FROM orders LEFT JOIN (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END b, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END m FROM customer) ON c_custkey = o_custkey"""

_ROWS = [{"result": "NOT_APPLICABLE", "condition": {"field": "p_type", "eq": "ECONOMY"}, "reason": "economy"}, {"result": "NOT_REQUIRED", "condition": {"all": [{"field": "p_size", "lt": 5}, {"field": "sold", "gt": 20}]}, "reason": "small"}, {"result": "CONDITIONAL", "condition": {"field": "sold", "gte": 30}, "reason": "often sold"}, {"result": "REQUIRED", "condition": {}, "reason": "never reached"}]


def q06_applicability(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("sold")).where("sold > 15")
    df = table(spark, sf_dir, "part").join(sold, "p_partkey", "left")
    d = decide(_ROWS, Facts(df))
    return df.select("p_partkey", d["status"].alias("status"), d["reason"].alias("reason"))


Q06 = """WITH s AS (SELECT l_partkey, count(*) sold FROM lineitem GROUP BY 1 HAVING count(*) > 15)
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'NOT_APPLICABLE' WHEN p_size < 5 AND sold > 20 THEN 'NOT_REQUIRED' WHEN sold >= 30 THEN 'CONDITIONAL' WHEN NOT (sold >= 30) THEN 'REQUIRED' ELSE 'REQUIRED' END status,
 CASE WHEN p_type = 'ECONOMY' THEN 'economy' WHEN p_size < 5 AND sold > 20 THEN 'small' WHEN sold >= 30 THEN 'often sold' WHEN NOT (sold >= 30) THEN 'often sold; the proviso is not met, so the base requirement holds' ELSE 'never reached' END reason
FROM part LEFT JOIN s ON l_partkey = p_partkey"""


def _family(source, key, kind, field, params=None, prepare=None):
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        df = prepare(df) if prepare else df
        c = check(kind, Facts(df), field, params)
        return df.select(key, c["result"].alias("result")).groupBy("result").agg(F.count("*").alias("n"), F.sum(key).alias("keys"))

    return run


def _counted(source, key, case, prepare=""):
    return f"SELECT result, count(*) n, sum({key})::BIGINT keys FROM (SELECT {key}, {case} result FROM (SELECT * {prepare} FROM {source})) GROUP BY 1"


_blank = lambda df: df.withColumn("tag", F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 5 == 1, "NOT_DETECTED").when(F.col("p_size") % 5 == 2, F.col("p_type")))
_TAG = ", CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'NOT_DETECTED' WHEN 2 THEN p_type END AS tag"
_units = lambda df: df.withColumn("quantity_unit", F.element_at(F.array(*map(F.lit, ["kg", "ML", "box", "", "pcs"])), (F.col("p_size") % 5 + 1).cast("int")))
_UNIT = ", list_extract(['kg', 'ML', 'box', '', 'pcs'], (p_size % 5 + 1)::BIGINT) AS quantity_unit"
_dates = lambda df: df.withColumn("label_date", F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "d/M/yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "MMM yyyy")).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("31/02/"), F.year("o_orderdate").cast("string"))))
_presence = "tag IS NOT NULL AND trim(tag) NOT IN ('', 'NOT_DETECTED')"
_conditional = lambda df: _blank(df).withColumn("size_known", F.when(F.col("p_size") > 3, F.col("p_size")))
_qr = lambda df: df.withColumns({"maker": F.when(F.col("p_size") % 3 == 0, F.col("p_brand")), "qr_code": F.when(F.col("p_size") % 3 == 1, F.col("p_name")), "package_qr_notice_present": F.col("p_size") % 2 == 0})
_platform = lambda df: df.withColumns({"ecommerce": F.col("o_orderstatus") != "P", "inspection_context": F.when(F.col("o_orderpriority") == "1-URGENT", "package_only").when(F.col("o_orderpriority") == "2-HIGH", "online"), "coo": F.when(F.col("o_orderkey") % 3 == 0, "IN")})

FAMILIES = {
    "q07_field_present": (_family("part", "p_partkey", "FIELD_PRESENT", "tag", prepare=_blank), _counted("part", "p_partkey", f"CASE WHEN {_presence} THEN 'PASS' ELSE 'FAIL' END", _TAG)),
    "q08_field_absent": (_family("part", "p_partkey", "FIELD_ABSENT", "tag", prepare=_blank), _counted("part", "p_partkey", f"CASE WHEN {_presence} THEN 'FAIL' ELSE 'PASS' END", _TAG)),
    "q09_text_match": (_family("part", "p_partkey", "TEXT_MATCH", "p_type", {"value": " PROMO "}), _counted("part", "p_partkey", "CASE WHEN trim(p_type) = 'PROMO' THEN 'PASS' ELSE 'FAIL' END")),
    "q10_text_contains": (_family("part", "p_partkey", "TEXT_CONTAINS", "p_name", {"value": "RING"}), _counted("part", "p_partkey", "CASE WHEN contains(lower(p_name), 'ring') THEN 'PASS' ELSE 'FAIL' END")),
    "q11_regex_match": (_family("supplier", "s_suppkey", "REGEX_MATCH", "s_name", {"pattern": "Supplier#0+[1-4]"}), _counted("supplier", "s_suppkey", "CASE WHEN regexp_matches(trim(s_name), '^(?:Supplier#0+[1-4])') THEN 'PASS' ELSE 'FAIL' END")),
    "q12_numeric_compare": (_family("customer", "c_custkey", "NUMERIC_COMPARE", "c_acctbal", {"op": "lt", "value": 1000}), _counted("customer", "c_custkey", "CASE WHEN c_acctbal < 1000 THEN 'PASS' ELSE 'FAIL' END")),
    "q13_unit": (_family("part", "p_partkey", "UNIT_NORMALIZATION", "p_retailprice", prepare=_units), _counted("part", "p_partkey", "CASE WHEN p_retailprice IS NOT NULL AND lower(quantity_unit) IN ('g','kg','mg','ml','l','litre','liter','cm','m','mm','pcs','pc','nos','number') THEN 'PASS' ELSE 'FAIL' END", _UNIT)),
    "q14_date_valid": (_family("orders", "o_orderkey", "DATE_VALID", "label_date", prepare=_dates), _counted("orders", "o_orderkey", "CASE WHEN o_orderkey % 4 < 2 THEN 'PASS' ELSE 'FAIL' END")),
    "q15_conditional": (_family("part", "p_partkey", "CONDITIONAL_FIELD_PRESENT", "tag", {"when": {"field": "size_known", "gte": 20}}, prepare=_conditional), _counted("part", "p_partkey", f"CASE WHEN size_known IS NULL THEN 'NEEDS_REVIEW' WHEN size_known < 20 THEN 'NOT_APPLICABLE' WHEN {_presence} THEN 'PASS' ELSE 'FAIL' END", _TAG + ", CASE WHEN p_size > 3 THEN p_size END AS size_known")),
    "q16_cross_field": (_family("part", "p_partkey", "CROSS_FIELD_COMPARE", "p_size", {"op": "gt", "other_field": "p_retailprice"}, prepare=lambda df: df.withColumn("p_retailprice", F.when(F.col("p_partkey") % 7 > 0, F.col("p_retailprice") - 900))), _counted("part", "p_partkey", "CASE WHEN p_partkey % 7 = 0 THEN 'NEEDS_REVIEW' WHEN p_size > p_retailprice - 900 THEN 'PASS' ELSE 'FAIL' END")),
    "q16b_code_or_package": (_family("part", "p_partkey", "QR_OR_ON_PACKAGE", "maker", prepare=_qr), _counted("part", "p_partkey", "CASE WHEN p_size % 3 = 0 THEN 'PASS' WHEN p_size % 3 = 1 AND p_size % 2 = 0 THEN 'PASS' WHEN p_size % 3 = 1 THEN 'NEEDS_REVIEW' ELSE 'FAIL' END")),
    "q16c_platform": (_family("orders", "o_orderkey", "PLATFORM_FILTER_PRESENT", "coo", prepare=_platform), _counted("orders", "o_orderkey", "CASE WHEN o_orderstatus = 'P' THEN 'NOT_APPLICABLE' WHEN o_orderpriority = '1-URGENT' THEN 'NEEDS_REVIEW' WHEN o_orderkey % 3 = 0 THEN 'PASS' WHEN o_orderpriority = '2-HIGH' THEN 'FAIL' ELSE 'NEEDS_REVIEW' END")),
}


def q17_downgrade(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    found = F.when(F.col("l_quantity") > 25, "PASS").otherwise("FAIL")
    result = scoring.downgrade(found, F.when(F.col("l_returnflag") == "N", "MANUAL").otherwise("OCR"), F.col("l_discount") * 10)
    return li.select("l_orderkey", result.alias("result")).groupBy("result").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


Q17 = "SELECT result, count(*) n, sum(l_orderkey)::BIGINT keys FROM (SELECT l_orderkey, CASE WHEN l_returnflag <> 'N' AND l_discount * 10 < 0.6 THEN 'NEEDS_REVIEW' WHEN l_quantity > 25 THEN 'PASS' ELSE 'FAIL' END result FROM lineitem) GROUP BY 1"


def q18_status_classes(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "A", "NOT_APPLICABLE").when(F.col("l_linestatus") == "O", "PASS").otherwise("FAIL").alias("result"), F.col("l_quantity").alias("weight"))
    return scoring.weighted_score(f, ["l_orderkey"]).groupBy("status").agg(F.count("*").alias("orders"), F.sum("applicable").alias("weight"))


Q18 = """SELECT status, count(*) orders, sum(a) weight FROM (SELECT a, CASE WHEN a = 0 THEN 'NEEDS_REVIEW' WHEN round_even(100 * p / a, 1) >= 100 THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END status FROM
 (SELECT l_orderkey, sum(CASE WHEN l_returnflag <> 'A' AND l_linestatus = 'O' THEN l_quantity ELSE 0 END) p, sum(CASE WHEN l_returnflag <> 'A' THEN l_quantity ELSE 0 END) a FROM lineitem GROUP BY 1)) GROUP BY 1"""


def q19_violations(spark, sf_dir):
    return order_findings(spark, sf_dir).where("result = 'FAIL'").select("o_orderkey", "check_id", F.lit("PENDING").alias("inspector_status"))


Q19 = _FINDINGS + "SELECT o_orderkey, check_id, 'PENDING' inspector_status FROM r WHERE result = 'FAIL'"


def q20_findings(spark, sf_dir):
    return order_findings(spark, sf_dir)


Q20 = _FINDINGS + "SELECT o_orderkey, check_id, weight, result FROM r"


def q23_verification(spark, sf_dir):
    r = order_findings(spark, sf_dir)
    v = r.where("result = 'FAIL'").withColumn("inspector_status", F.when(F.col("o_orderkey") % 3 == 0, "PENDING").when(F.col("o_orderkey") % 3 == 1, "CONFIRMED").otherwise("REJECTED"))
    return scoring.verification(r, v, ["o_orderkey"])


Q23 = _FINDINGS + """SELECT o_orderkey, CASE WHEN bool_or(result = 'NEEDS_REVIEW' AND weight > 0) OR (bool_or(result = 'FAIL') AND o_orderkey % 3 = 0) THEN 'NEEDS_REVIEW' WHEN bool_or(result = 'FAIL') AND o_orderkey % 3 = 1 THEN 'NOT_VERIFIED' ELSE 'VERIFIED' END verification FROM r GROUP BY 1"""

QUERIES = {
    "q01_order_scores": (q01_order_scores, Q01),
    "q02_versions_as_of": (q02_versions_as_of, Q02),
    "q03_latest_version": (q03_latest_version, Q03),
    "q04_overlaps": (q04_overlaps, Q04),
    "q04b_overlap_pairs": (q04b_overlap_pairs, Q04B),
    "q05_condition": (q05_condition, Q05),
    "q05b_condition_of_all": (q05b_condition_of_all, Q05B),
    "q06_applicability": (q06_applicability, Q06),
    **FAMILIES,
    "q17_downgrade": (q17_downgrade, Q17),
    "q18_status_classes": (q18_status_classes, Q18),
    "q19_violations": (q19_violations, Q19),
    "q20_findings": (q20_findings, Q20),
    "q23_verification": (q23_verification, Q23),
}
