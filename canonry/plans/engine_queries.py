"""Queries of the whole rule engine: facts of products, dated versions, applicability, checks, source gate; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring, tables
from . import engine
from .checks import check, parse_date
from .conditions import Facts
from .rule_queries import table

DAY = "2026-09-15"
#: A product's columns, by part; the same expressions in both dialects.
PRODUCT = {
    "product_id": "p_partkey",
    "product_name": "CASE WHEN p_name LIKE 'small%' THEN '  ' ELSE p_name END",
    "quantity": "CASE WHEN p_size > 45 THEN NULL ELSE p_size END",
    "quantity_unit": "CASE WHEN p_size > 40 THEN 'dozen' WHEN p_size > 35 THEN '' WHEN p_type = 'PROMO' THEN 'kg' WHEN p_type = 'SMALL' THEN 'ml' ELSE 'G' END",
    "manufacturer": "CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN '' ELSE p_brand END",
    "qr_code": "CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#9') THEN concat('QR-', p_brand) END",
    "package_qr_notice_present": "p_brand <> 'Brand#2'",
    "manufacturing_date": "CASE WHEN p_size < 10 THEN concat('2024-0', CAST(p_size AS VARCHAR(9)), '-11') WHEN p_size < 13 THEN concat(CAST(p_size AS VARCHAR(9)), '/2024') WHEN p_size < 20 THEN concat(CAST(p_size AS VARCHAR(9)), ' Mar 24') WHEN p_size < 30 THEN '' ELSE concat(CAST(p_size AS VARCHAR(9)), '/05/2024') END",
    "mrp": "CASE WHEN p_retailprice >= 1800 THEN NULL ELSE p_retailprice END",
    "imported": "CASE WHEN p_brand = 'Brand#5' THEN NULL ELSE p_type = 'ECONOMY' END",
    "country_of_origin": "CASE WHEN p_size > 20 THEN 'Nepal' END",
    "consumer_care": "CASE WHEN p_brand = 'Brand#7' THEN 'NOT_DETECTED' ELSE '1800-100' END",
    "may_become_unfit": "CASE WHEN p_type = 'SMALL' THEN true WHEN p_type = 'PROMO' THEN false END",
    "best_before": "CASE WHEN p_size > 25 THEN 'soon' WHEN p_size > 10 THEN '12/2025' ELSE '' END",
    "ecommerce": "p_type IN ('ECONOMY', 'PROMO')",
    "source_listing_url": "CASE WHEN p_size > 30 THEN 'https://shop/x' END",
    "country_of_origin_filter": "CASE WHEN p_size > 40 THEN 'Nepal' END",
    "electronic_product": "p_brand IN ('Brand#1', 'Brand#4')",
    "dimensions": "CASE WHEN p_size > 15 THEN '10 x 10' END",
    "category": "CASE WHEN p_type = 'PROMO' THEN 'COSMETIC' ELSE 'FOOD' END",
    "subcategory": "CASE WHEN p_size > 25 THEN 'SOAP' ELSE 'OTHER' END",
    "veg_nonveg_dot": "CASE WHEN p_size > 35 THEN 'GREEN' END",
    "genetically_modified": "CASE WHEN p_brand = 'Brand#8' THEN true ELSE false END",
    "gm_label": "CASE WHEN p_size > 30 THEN 'GM' END",
    "quantity_type": "CASE WHEN p_size > 48 THEN 'bundle' ELSE 'weight' END",
    "combination_package": "p_size = 50",
    "group_package": "false",
    "multi_piece_package": "false",
    "unit_sale_price": "CASE WHEN p_size > 22 THEN '2 per g' END",
}
#: Readings of labels, by part; several a field, of which the newest with a value wins.
READINGS = [
    ("mrp", "CASE WHEN p_size % 7 = 0 THEN '99.5' ELSE '' END", "0.35", "rapidocr", 2),
    ("mrp", "'120'", "0.9", "manual-entry", 1),
    ("consumer_care", "CASE WHEN p_size > 30 THEN '1800 200' END", "0.95", "Tesseract", 1),
]
_COLUMNS = ", ".join(f"{e} AS {c}" for c, e in PRODUCT.items())


def products(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {c}".replace("VARCHAR(9)", "STRING") for c, e in PRODUCT.items()))


def readings(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_brand IN ('Brand#4', 'Brand#6', 'Brand#7')")
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.expr(v).alias("value"), F.lit(c).cast("double").alias("confidence"), engine.origin_of(F.lit(e)).alias("origin"), F.lit(n).alias("at")) for f, v, c, e, n in READINGS))
    return p.select(F.col("p_partkey").alias("product_id"), F.inline(rows))


def engine_findings(spark, sf_dir):
    facts = engine.build_facts(products(spark, sf_dir), readings(spark, sf_dir), ["mrp", "consumer_care"])
    return engine.findings(facts, DAY)


def q70_engine_findings(spark, sf_dir):
    return engine_findings(spark, sf_dir).select("product_id", "check_id", "version", "result", "applicability", "detected")


_HAS = "({0} IS NOT NULL AND trim({0}) NOT IN ('', 'NOT_DETECTED'))"
_FACTS = f"""WITH p AS (SELECT {_COLUMNS}, p_brand IN ('Brand#4', 'Brand#6', 'Brand#7') seen, p_size FROM part),
f AS (SELECT p.* REPLACE (CASE WHEN seen THEN CASE WHEN p_size % 7 = 0 THEN '99.5' ELSE '120' END ELSE CASE WHEN mrp IS NULL THEN NULL ELSE CASE WHEN mrp = floor(mrp) THEN printf('%.1f', mrp) ELSE CAST(round(mrp, 6) AS VARCHAR) END END END AS mrp,
  CASE WHEN seen AND p_size > 30 THEN '1800 200' ELSE consumer_care END AS consumer_care),
  seen AND p_size % 7 = 0 AS weak, CASE WHEN quantity IS NULL THEN NULL ELSE printf('%.1f', quantity::DOUBLE) END AS q,
  {_HAS.format("manufacturer")} has_maker, {_HAS.format("qr_code")} has_code, ((seen AND p_size > 30) OR {_HAS.format("p.consumer_care")}) has_care, {_HAS.format("product_name")} has_name,
  electronic_product AND qr_code IS NOT NULL AND package_qr_notice_present AS notice,
  CASE WHEN imported THEN 'REQUIRED' ELSE 'NOT_APPLICABLE' END AS origin_rule,
  quantity_type = 'weight' AS by_weight
  FROM p),
r AS (
  SELECT product_id, 'CHK-MANUFACTURER' check_id, '25' AS version, CASE WHEN has_maker OR (has_code AND package_qr_notice_present) THEN 'PASS' WHEN has_code THEN 'NEEDS_REVIEW' ELSE 'FAIL' END AS result, CASE WHEN notice THEN 'CONDITIONAL' ELSE 'REQUIRED' END applicability, CASE WHEN has_maker THEN manufacturer WHEN has_code THEN qr_code ELSE '' END detected FROM f
  UNION ALL SELECT product_id, 'CHK-COMMON-NAME', '26', CASE WHEN has_name THEN 'PASS' ELSE 'FAIL' END, CASE WHEN notice THEN 'CONDITIONAL' ELSE 'REQUIRED' END, product_name FROM f
  UNION ALL SELECT product_id, 'CHK-NET-QTY', '02', CASE WHEN q IS NULL OR quantity_unit IN ('', 'dozen') THEN 'FAIL' ELSE 'PASS' END, 'REQUIRED', CASE WHEN q IS NULL THEN '' WHEN quantity_unit = '' THEN q ELSE q || ' ' || lower(quantity_unit) END FROM f
  UNION ALL SELECT product_id, 'CHK-MFG-DATE', '29', CASE WHEN p_size < 20 OR (p_size >= 30 AND p_size <= 31) THEN 'PASS' ELSE 'FAIL' END, 'REQUIRED', manufacturing_date FROM f
  UNION ALL SELECT product_id, 'CHK-MRP', '30', CASE WHEN mrp IS NULL THEN 'FAIL' WHEN weak THEN 'NEEDS_REVIEW' ELSE 'PASS' END, 'REQUIRED', coalesce(mrp, '') FROM f
  UNION ALL SELECT product_id, 'CHK-DIMENSIONS', '27', CASE WHEN NOT notice THEN 'NOT_APPLICABLE' WHEN dimensions IS NULL THEN 'FAIL' ELSE 'PASS' END, CASE WHEN notice THEN 'CONDITIONAL' ELSE 'NOT_APPLICABLE' END, CASE WHEN notice THEN coalesce(dimensions, '') ELSE '' END FROM f
  UNION ALL SELECT product_id, 'CHK-OTHER-MATTERS', '11', 'NEEDS_REVIEW', 'NEEDS_REVIEW', '' FROM f
  UNION ALL SELECT product_id, 'CHK-COUNTRY-ORIGIN', '17', CASE origin_rule WHEN 'REQUIRED' THEN CASE WHEN country_of_origin IS NULL THEN 'FAIL' ELSE 'PASS' END ELSE origin_rule END, origin_rule, CASE WHEN imported THEN coalesce(country_of_origin, '') ELSE '' END FROM f
  UNION ALL SELECT product_id, 'CHK-BEST-BEFORE', '18', CASE WHEN coalesce(NOT may_become_unfit, true) THEN 'NOT_APPLICABLE' WHEN best_before = '12/2025' THEN 'PASS' ELSE 'FAIL' END, CASE WHEN may_become_unfit THEN 'CONDITIONAL' ELSE 'NOT_APPLICABLE' END, CASE WHEN may_become_unfit THEN best_before ELSE '' END FROM f
  UNION ALL SELECT product_id, 'CHK-CONSUMER-CARE', '28', CASE WHEN has_care THEN 'PASS' ELSE 'FAIL' END, CASE WHEN electronic_product THEN 'CONDITIONAL' ELSE 'REQUIRED' END, consumer_care FROM f
  UNION ALL SELECT product_id, 'CHK-GM-FOOD', '19', CASE WHEN NOT genetically_modified THEN 'NOT_APPLICABLE' WHEN gm_label IS NULL THEN 'FAIL' ELSE 'PASS' END, CASE WHEN genetically_modified THEN 'REQUIRED' ELSE 'NOT_APPLICABLE' END, CASE WHEN genetically_modified THEN coalesce(gm_label, '') ELSE '' END FROM f
  UNION ALL SELECT product_id, 'CHK-VEG-NONVEG', '20', CASE WHEN NOT (category = 'COSMETIC' AND subcategory = 'SOAP') THEN 'NOT_APPLICABLE' WHEN veg_nonveg_dot IS NULL THEN 'FAIL' ELSE 'PASS' END, CASE WHEN category = 'COSMETIC' AND subcategory = 'SOAP' THEN 'CONDITIONAL' ELSE 'NOT_APPLICABLE' END, CASE WHEN category = 'COSMETIC' AND subcategory = 'SOAP' THEN coalesce(veg_nonveg_dot, '') ELSE '' END FROM f
  UNION ALL SELECT product_id, 'CHK-UNIT-SALE-PRICE', '13', CASE WHEN by_weight THEN CASE WHEN unit_sale_price IS NULL THEN 'FAIL' ELSE 'PASS' END ELSE 'NOT_APPLICABLE' END, CASE WHEN by_weight THEN 'REQUIRED' WHEN combination_package THEN 'NOT_REQUIRED' ELSE 'NOT_APPLICABLE' END, CASE WHEN by_weight THEN coalesce(unit_sale_price, '') ELSE '' END FROM f
  UNION ALL SELECT product_id, 'CHK-ECOMMERCE-DECL', '22', CASE WHEN NOT ecommerce THEN 'NOT_APPLICABLE' WHEN source_listing_url IS NOT NULL THEN 'PASS' ELSE 'NEEDS_REVIEW' END, CASE WHEN ecommerce THEN 'REQUIRED' ELSE 'NOT_APPLICABLE' END, CASE WHEN ecommerce THEN coalesce(source_listing_url, '') ELSE '' END FROM f
  UNION ALL SELECT product_id, 'CHK-ECOMMERCE-COO-FILTER', '07', CASE WHEN ecommerce AND imported THEN CASE WHEN country_of_origin_filter IS NOT NULL THEN 'PASS' WHEN source_listing_url IS NULL THEN 'NEEDS_REVIEW' ELSE 'FAIL' END ELSE 'NOT_APPLICABLE' END,
    CASE WHEN ecommerce AND imported THEN 'REQUIRED'  ELSE 'NOT_APPLICABLE' END, CASE WHEN ecommerce AND imported THEN coalesce(country_of_origin_filter, '') ELSE '' END FROM f)
"""
_WEIGHTS = ", ".join(f"('{k}', {w}, '{s}')" for k, (_, _, _, w, s) in engine.seed.CHECKS.items())
Q70 = _FACTS + "SELECT * FROM r"


def q71_engine_scores(spark, sf_dir):
    s = scoring.weighted_score(engine_findings(spark, sf_dir), ["product_id"])
    return s.select("product_id", "passed", "applicable", (100 * F.try_divide("passed", "applicable")).alias("score"), "status", "finalizable")


Q71 = (
    _FACTS
    + f"""SELECT product_id, sum(CASE WHEN result = 'PASS' THEN weight ELSE 0 END)::DOUBLE passed, sum(CASE WHEN result <> 'NOT_APPLICABLE' THEN weight ELSE 0 END)::DOUBLE applicable, 100 * passed / applicable AS score,
 CASE WHEN bool_or(result = 'NEEDS_REVIEW') OR applicable = 0 THEN 'NEEDS_REVIEW' WHEN passed = applicable THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END status, NOT bool_or(result = 'NEEDS_REVIEW') finalizable
 FROM r JOIN (VALUES {_WEIGHTS}) w(k, weight, severity) ON k = check_id GROUP BY 1"""
)


def q72_engine_violations(spark, sf_dir):
    return engine.violations(engine_findings(spark, sf_dir)).select("product_id", "check_id", "severity", "violation_type", "inspector_status")


Q72 = _FACTS + f"SELECT product_id, check_id, severity, CASE WHEN detected = '' THEN 'MISSING_DECLARATION' ELSE 'INVALID_DECLARATION' END violation_type, 'PENDING' inspector_status FROM r JOIN (VALUES {_WEIGHTS}) w(k, weight, severity) ON k = check_id WHERE result = 'FAIL'"


def q73_facts(spark, sf_dir):
    facts = engine.build_facts(products(spark, sf_dir), readings(spark, sf_dir), ["mrp", "consumer_care"])
    return facts.select("product_id", F.col("mrp").cast("double").alias("mrp"), "mrp__origin", "mrp__confidence", "consumer_care", "consumer_care__origin", "qr_declared", "quantity_kg", "quantity_litre", F.col("common_generic_name").alias("name"))


Q73 = f"""WITH p AS (SELECT {_COLUMNS}, p_brand IN ('Brand#4', 'Brand#6', 'Brand#7') seen, p_size, p_retailprice FROM part)
SELECT product_id, CASE WHEN seen AND p_size % 7 = 0 THEN 99.5 WHEN seen THEN 120 ELSE mrp END mrp, CASE WHEN seen AND p_size % 7 = 0 THEN 'OCR' WHEN seen THEN 'MANUAL' END mrp__origin, CASE WHEN seen AND p_size % 7 = 0 THEN 0.35 WHEN seen THEN 0.9 END mrp__confidence,
 CASE WHEN seen AND p_size > 30 THEN '1800 200' ELSE consumer_care END consumer_care, CASE WHEN seen AND p_size > 30 THEN 'OCR' END consumer_care__origin, qr_code IS NOT NULL qr_declared,
 CASE lower(quantity_unit) WHEN 'kg' THEN quantity::DOUBLE WHEN 'g' THEN quantity * 0.001::DOUBLE END quantity_kg, CASE WHEN quantity_unit = 'ml' THEN quantity * 0.001::DOUBLE END quantity_litre, product_name AS name FROM p"""


def q74_source_gate(spark, sf_dir):
    """Versions whose source isn't verified ask for review wherever they apply."""
    found = engine.findings(engine.build_facts(products(spark, sf_dir)), DAY, sources={"30": "VERIFICATION_REQUIRED", "17": "CUSTOM", "26": "VERIFIED_SECONDARY"})
    return found.where(F.col("check_id").isin("CHK-MRP", "CHK-COUNTRY-ORIGIN", "CHK-COMMON-NAME")).groupBy("check_id", "result").agg(F.count("*").alias("n"), F.sum("product_id").alias("ids"), F.count_if(F.col("detected") != "").alias("detected"))


Q74 = f"""WITH p AS (SELECT {_COLUMNS} FROM part), r AS (
 SELECT product_id, 'CHK-MRP' check_id, 'NEEDS_REVIEW' AS result, mrp IS NOT NULL seen FROM p
 UNION ALL SELECT product_id, 'CHK-COUNTRY-ORIGIN', CASE WHEN imported THEN 'NEEDS_REVIEW' ELSE 'NOT_APPLICABLE' END, coalesce(imported, false) AND country_of_origin IS NOT NULL FROM p
 UNION ALL SELECT product_id, 'CHK-COMMON-NAME', CASE WHEN trim(product_name) <> '' THEN 'PASS' ELSE 'FAIL' END, true FROM p)
SELECT check_id, result, count(*) n, sum(product_id)::BIGINT ids, count(*) FILTER (WHERE seen) detected FROM r GROUP BY 1, 2"""


def q75_further_checks(spark, sf_dir):
    """The check types that no version of the rule base uses."""
    df = products(spark, sf_dir).withColumn("ingredients", F.concat_ws(", ", "product_name", F.lower("category")))
    facts = Facts(df)
    screen = {"decision_map": {"ring": {"status": "PROHIBITED"}, "Widget": {"status": "restricted"}, "food": {"status": "CONDITIONAL"}, "gear": {"status": "PERMITTED"}}}
    runs = {
        "QR_DATA_PRESENT": check("QR_DATA_PRESENT", facts, "qr_data"),
        "DATE_REQUIRED_IF": check("DATE_REQUIRED_IF", facts, "best_before"),
        "DATE_REQUIRED_UNKNOWN": check("DATE_REQUIRED_IF", facts, "manufacturing_date"),
        "INGREDIENT_SCREEN": check("INGREDIENT_SCREEN", facts, "ingredients", screen),
        "NO_SUCH_TYPE": check("NO_SUCH_TYPE", facts, "mrp"),
        "FIELD_ABSENT": check("FIELD_ABSENT", facts, "gm_label"),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), r["result"].alias("result")) for k, r in runs.items()))
    return df.select("product_id", F.inline(rows))


Q75 = f"""WITH p AS (SELECT {_COLUMNS} FROM part)
SELECT product_id, 'QR_DATA_PRESENT' AS kind, CASE WHEN qr_code IS NULL THEN 'NEEDS_REVIEW' ELSE 'PASS' END AS result FROM p
UNION ALL SELECT product_id, 'DATE_REQUIRED_IF', CASE WHEN coalesce(NOT may_become_unfit, true) THEN 'NOT_APPLICABLE' WHEN best_before = '12/2025' THEN 'PASS' ELSE 'FAIL' END FROM p
UNION ALL SELECT product_id, 'DATE_REQUIRED_UNKNOWN', 'NEEDS_REVIEW' FROM p
UNION ALL SELECT product_id, 'INGREDIENT_SCREEN', CASE WHEN contains(product_name, 'ring') THEN 'FAIL' ELSE 'NEEDS_REVIEW' END FROM p
UNION ALL SELECT product_id, 'NO_SUCH_TYPE', 'NEEDS_REVIEW' FROM p
UNION ALL SELECT product_id, 'FIELD_ABSENT', CASE WHEN gm_label IS NULL THEN 'PASS' ELSE 'FAIL' END FROM p"""

#: The accepted date formats as Spark and as DuckDB write them.
FORMATS = [
    ("yyyy-MM-dd", "%Y-%m-%d"), ("dd/MM/yyyy", "%d/%m/%Y"), ("MM/yyyy", "%m/%Y"), ("MM-yyyy", "%m-%Y"), ("yyyy/MM", "%Y/%m"), ("MMM yyyy", "%b %Y"), ("MMMM yyyy", "%B %Y"), ("dd-MM-yyyy", "%d-%m-%Y"), ("dd MMM yyyy", "%d %b %Y"), ("dd MMMM yyyy", "%d %B %Y"),
    ("dd-MMM-yyyy", "%d-%b-%Y"), ("dd-MMMM-yyyy", "%d-%B-%Y"), ("yyyy-MM", "%Y-%m"), ("MM.yyyy", "%m.%Y"), ("dd.MM.yyyy", "%d.%m.%Y"), ("MMM-yyyy", "%b-%Y"), ("MMMM-yyyy", "%B-%Y"), ("dd MMM yy", "%d %b %y"), ("dd MMMM yy", "%d %B %y"),
]


def q76_date_formats(spark, sf_dir):
    """Every order's date written in each format and read again; a format without a day gives the first of the month."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    laid = o.select("o_orderkey", "day", F.posexplode(F.array(*(F.date_format("day", f) for f, _ in FORMATS), F.lit("31/02/2024"), F.lit("May 24"))).alias("format", "written"))
    read = laid.withColumn("read", parse_date(F.col("written")))
    return read.groupBy("format").agg(F.count("read").alias("read"), F.sum(F.datediff("read", F.lit("1990-01-01"))).alias("days"))


Q76 = (
    "WITH o AS (SELECT o_orderdate::DATE AS d FROM orders), r AS ("
    + " UNION ALL ".join(f"SELECT {i} AS format, {'d' if 'd' in f else "date_trunc('month', d)::DATE"} AS t FROM o" for i, (f, _) in enumerate(FORMATS))
    + f" UNION ALL SELECT {len(FORMATS)}, NULL FROM o UNION ALL SELECT {len(FORMATS) + 1}, NULL FROM o) SELECT format, count(t) AS read, sum(t::DATE - DATE '1990-01-01')::BIGINT AS days FROM r GROUP BY 1"
)


def q77_versions_with_rules(spark, sf_dir):
    """Versions with their checks and rules: how many are in force at each order's date, by type of check."""
    v = engine.seed.rule_versions(spark).where(F.col("status").isin(*engine.seed.SELECTABLE))
    days = table(spark, sf_dir, "orders").select(F.add_months(F.to_date("o_orderdate"), 240).alias("day")).groupBy("day").agg(F.count("*").alias("orders"))
    inside = days.join(F.broadcast(v), (F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
    return inside.groupBy("check_type").agg(F.sum("orders").alias("orders"), F.countDistinct("version").alias("versions"), F.sum(F.col("orders") * F.col("weight")).alias("weight"))


_RULES = ", ".join(f"('{v}', '{engine.seed.CHECKS[c][1]}', {engine.seed.CHECKS[c][3]}, DATE '{a}', {f"DATE '{b}'" if b else 'NULL'})" for v, c, a, b, s in engine.seed.VERSIONS if s in engine.seed.SELECTABLE)
Q77 = f"SELECT check_type, count(*) orders, count(DISTINCT version) versions, sum(weight)::DOUBLE weight FROM (SELECT (o_orderdate::DATE + INTERVAL 240 MONTH)::DATE AS d FROM orders) JOIN (VALUES {_RULES}) v(version, check_type, weight, a, b) ON a <= d AND (b IS NULL OR d < b) GROUP BY 1"


def q78_consumer_columns(spark, sf_dir):
    """What a customer may see of their own orders: rows of theirs, an allow-list of columns."""
    o = table(spark, sf_dir, "orders")
    return tables.scoped(o, {"o_custkey": 7}, ["o_orderkey", "o_orderstatus", "o_orderdate", "no_such_column"])


Q78 = "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_custkey = 7"

QUERIES = {k: (f, globals().get(k.split("_")[0].upper())) for k, f in list(globals().items()) if k.startswith("q7") and callable(f)}
