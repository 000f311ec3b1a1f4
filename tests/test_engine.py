"""The rule engine: every node and check with nulls, the demo cases, dates on boundaries, and plans."""

import pytest
from pyspark.sql import functions as F

from canonry.operators import scoring
from canonry.plans import engine
from canonry.plans.applicability import decide
from canonry.plans.checks import DATE_FORMATS, check, parse_date
from canonry.plans.conditions import Facts, compile_condition
from canonry.sources import seed

PRODUCT = "product_id string, product_name string, category string, subcategory string, manufacturer string, quantity double, quantity_unit string, quantity_type string, manufacturing_date string, mrp double, consumer_care string, imported boolean, ecommerce boolean, unit_sale_price string, source_listing_url string, country_of_origin string"
DEFAULTS = ("p", "Atta", "GENERAL", None, "Foods Ltd", 5.0, "kg", "weight", "2024-05-01", 250.0, "1800-000-000", False, False, "Rs.50 per kg", None, None)


def product(spark, **changed):
    names = [c.split()[0] for c in PRODUCT.split(", ")]
    return spark.createDataFrame([tuple(changed.get(n, d) for n, d in zip(names, DEFAULTS, strict=True))], PRODUCT)


def results(spark, declarations=None, fields=None, day="2026-09-15", **changed):
    found = engine.findings(engine.build_facts(product(spark, **changed), declarations, fields), day)
    return {r.check_id: r.result for r in found.collect()}, found


def test_compliant_product(spark):
    got, found = results(spark)
    assert all(got[f"CHK-{c}"] == "PASS" for c in ("MRP", "MANUFACTURER", "COMMON-NAME", "NET-QTY", "MFG-DATE"))
    assert engine.violations(found).count() == 0


def test_missing_price_is_one_open_violation(spark):
    got, found = results(spark, mrp=None)
    assert got["CHK-MRP"] == "FAIL"
    assert [(v.check_id, v.violation_type, v.inspector_status) for v in engine.violations(found).collect()] == [("CHK-MRP", "MISSING_DECLARATION", "PENDING")]


def test_imported_without_origin(spark):
    assert results(spark, imported=True, category="COSMETIC", subcategory="SHAMPOO")[0]["CHK-COUNTRY-ORIGIN"] == "FAIL"
    assert results(spark)[0]["CHK-COUNTRY-ORIGIN"] == "NOT_APPLICABLE"


def test_online_sale_of_imports(spark):
    got, _ = results(spark, imported=True, ecommerce=True, country_of_origin="UAE", source_listing_url="https://example.invalid/1")
    assert (got["CHK-ECOMMERCE-DECL"], got["CHK-ECOMMERCE-COO-FILTER"]) == ("PASS", "FAIL")


def test_reading_of_low_confidence_is_reviewed(spark):
    read = spark.createDataFrame([("p", "mrp", "250", 0.15, "OCR", 2), ("p", "mrp", "200", 0.99, "OCR", 1), ("p", "mrp", "", 0.9, "OCR", 3)], "product_id string, field string, value string, confidence double, origin string, at int")
    got, found = results(spark, read, ["mrp"], mrp=None)
    assert got["CHK-MRP"] == "NEEDS_REVIEW" and not scoring.weighted_score(found, ["product_id"]).first().finalizable


@pytest.mark.parametrize(("day", "check_id", "version"), [("2020-01-01", "CHK-MRP", "03"), ("2022-09-30", "CHK-MRP", "03"), ("2022-10-01", "CHK-MRP", "30"), ("2026-09-15", "CHK-ECOMMERCE-COO-FILTER", "07"), ("2027-06-30", "CHK-ECOMMERCE-COO-FILTER", "07"), ("2027-07-01", "CHK-ECOMMERCE-COO-FILTER", "08")])
def test_versions_on_boundaries(day, check_id, version):
    assert seed.versions_on(day)[check_id] == version


def test_all_checks_are_in_force_and_versions_do_not_overlap():
    assert set(seed.versions_on("2026-09-15")) == set(seed.CHECKS) and len(seed.VERSIONS) == 24 and sum(map(len, seed.APPLICABILITY.values())) == 18
    by = {}
    for v, c, a, b, _ in sorted(seed.VERSIONS, key=lambda x: (x[1], x[2])):
        assert by.get(c, "") is not None and by.get(c, "") <= a
        by[c] = b


def values(spark):
    return spark.createDataFrame([(None, None, None), ("true", True, 5.0), ("x", False, 0.0), ("", None, None), (" 7 ", True, -1.0)], "s string, b boolean, n double")


@pytest.mark.parametrize(
    ("tree", "want"),
    [
        ({}, [True] * 5),
        ([1], [None] * 5),
        ({"all": []}, [True] * 5),
        ({"any": []}, [False] * 5),
        ({"field": "s", "eq": True}, [False, True, False, False, False]),
        ({"field": "b", "eq": "true"}, [False, True, False, False, True]),
        ({"field": "s", "eq": None}, [True, False, False, False, False]),
        ({"field": "s", "neq": "x"}, [True, True, False, True, True]),
        ({"field": "n", "gt": 0}, [None, True, False, None, False]),
        ({"field": "n", "op": "gt", "value": 0}, [False, True, False, False, False]),
        ({"field": "s", "gte": 7}, [None, None, None, None, True]),
        ({"field": "s", "in": ["x", "y"]}, [None, False, True, False, False]),
        ({"field": "s", "op": "not_in", "value": ["x"]}, [True, True, False, True, True]),
        ({"field": "s", "present": True}, [False, True, True, False, True]),
        ({"field": "nowhere", "eq": 1}, [False] * 5),
        ({"field": "nowhere", "lt": 1}, [None] * 5),
        ({"field": "s", "like": "x"}, [None] * 5),
        ({"eq": 1}, [None] * 5),
        ({"all": [{"field": "n", "gte": 0}, {"field": "b", "eq": True}]}, [False, True, False, False, False]),
        ({"any": [{"field": "n", "gte": 0}, {"field": "b", "eq": True}]}, [None, True, True, None, True]),
    ],
)
def test_condition_nodes(spark, tree, want):
    df = values(spark)
    assert [r[0] for r in df.select(compile_condition(tree, Facts(df))).collect()] == want


def test_applicability_rows_in_order(spark):
    df = values(spark)
    row = lambda result, condition=None, reason="r": {"result": result, "condition": condition, "reason": reason}
    status = lambda rows, mandatory=True: [r[0].status for r in df.select(decide(rows, Facts(df), mandatory)).collect()]
    n = {"field": "n", "gt": 0}
    assert status([]) == ["REQUIRED"] * 5 and status([], False) == ["NEEDS_REVIEW"] * 5
    assert status([row("NOT_APPLICABLE", n), row("REQUIRED")]) == ["REQUIRED", "NOT_APPLICABLE", "REQUIRED", "REQUIRED", "REQUIRED"]
    assert status([row("REQUIRED", n)]) == ["NEEDS_REVIEW", "REQUIRED", "NOT_APPLICABLE", "NEEDS_REVIEW", "NOT_APPLICABLE"]
    assert status([row("CONDITIONAL", n)]) == ["NEEDS_REVIEW", "CONDITIONAL", "REQUIRED", "NEEDS_REVIEW", "REQUIRED"]
    assert status([row("CONDITIONAL", n)], False) == ["NEEDS_REVIEW", "CONDITIONAL", "NOT_APPLICABLE", "NEEDS_REVIEW", "NOT_APPLICABLE"]
    assert status([row("SOMETHING")]) == ["NEEDS_REVIEW"] * 5


@pytest.mark.parametrize(
    ("kind", "field", "params", "want"),
    [
        ("FIELD_PRESENT", "s", {}, "FPPFP"),
        ("FIELD_ABSENT", "n", {}, "PFFPF"),
        ("FIELD_PRESENT", "b", {}, "FPFFP"),
        ("TEXT_MATCH", "s", {}, "RRRRR"),
        ("TEXT_MATCH", "s", {"value": "7"}, "FFFFP"),
        ("TEXT_CONTAINS", "s", {"value": "RU"}, "FPFFF"),
        ("REGEX_MATCH", "s", {"pattern": "t|7"}, "FPFFP"),
        ("NUMERIC_COMPARE", "n", {"op": "gte", "value": 0}, "FPPFF"),
        ("NUMERIC_COMPARE", "s", {}, "FFFFP"),
        ("NUMERIC_COMPARE", "n", {"op": "near", "value": 0}, "FRRFR"),
        ("CROSS_FIELD_COMPARE", "n", {"op": "lt", "other_field": "s"}, "RRRRP"),
        ("CONDITIONAL_FIELD_PRESENT", "s", {"when": {"field": "n", "gte": 0}}, "RPPRN"),
        ("DATE_REQUIRED_IF", "s", {"when": {"field": "b", "eq": True}}, "NFNNF"),
        ("DATE_REQUIRED_IF", "s", {}, "RRRRR"),
        ("MANUAL_REVIEW", "s", {}, "RRRRR"),
        ("INGREDIENT_SCREEN", "s", {"decision_map": {"TRUE": {"status": "prohibited"}, "x": {"status": "restricted"}}}, "RFRRR"),
        ("NO_SUCH_CHECK", "s", {}, "RRRRR"),
    ],
)
def test_checks_with_nulls(spark, kind, field, params, want):
    df = values(spark)
    assert "".join({"PASS": "P", "FAIL": "F", "NEEDS_REVIEW": "R", "NOT_APPLICABLE": "N"}[r[0].result] for r in df.select(check(kind, Facts(df), field, params)).collect()) == want


def test_dates(spark):
    good = ["2024-05-01", "01/05/2024", "5/2024", "05-2024", "2024/5", "May 2024", "march 2024", "1-5-2024", "1 MAY 2024", "1-March-2024", "2024-05", "05.2024", "1.5.2024", "May-2024"]
    bad = ["31/02/2024", "13/2024", "soon", "", None, "70.16", "2024"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in good + bad], "d string").select(parse_date(F.col("d"))).collect()]
    assert all(got[: len(good)]) and not any(got[len(good) :]) and len(DATE_FORMATS) == 19


def test_score_edges(spark):
    rows = [("a", "PASS", 20.0), ("a", "FAIL", 15.0), ("b", "PASS", 5.0), ("b", "NOT_APPLICABLE", 9.0), ("c", "PASS", 0.0), ("d", "PASS", 5.0), ("d", "NEEDS_REVIEW", 5.0)]
    got = {r.k: (r.score, r.status) for r in scoring.weighted_score(spark.createDataFrame(rows, "k string, result string, weight double"), ["k"]).collect()}
    assert got == {"a": (57.1, "NON_COMPLIANT"), "b": (100.0, "COMPLIANT"), "c": (0.0, "NEEDS_REVIEW"), "d": (50.0, "NEEDS_REVIEW")}


def test_engine_plan_has_no_shuffle_join_or_python(spark):
    plan = engine.findings(engine.build_facts(product(spark)), "2026-09-15")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Join", "Python", "Arrow"))
