"""Paragraphs, names, prices, quantities, licences and manifests on literal cases."""

import pytest

from canonry.operators import elections, manifest, regions

BOXES = "p int, line_no int, text string, confidence double, x0 double, y0 double, x1 double, y1 double"


def boxed(spark, texts, places=None):
    """Lines of one package; boxes of 60 by 10 at given corners, else none."""
    at = places or {}
    return spark.createDataFrame([(1, i, t, 0.9, *((float(at[i][0]), float(at[i][1]), at[i][0] + 60.0, at[i][1] + 10.0) if i in at else (None,) * 4)) for i, t in enumerate(texts)], BOXES)


@pytest.mark.parametrize(("texts", "places", "want"), [
    (["MRP Rs. 50"], None, ("50", "same line", False)), (["M.R.P.", "Rs. 1,250.50/-"], None, ("1250.50", "next line", False)), (["MRF Rs 45"], None, ("45", "bare", False)), (["retail price MRF Rs 45"], None, ("45", "same line", False)), (["Rs. 05/2024"], None, None), (["Rs. 5 g"], None, None), (["MRP 1010005"], None, None),
    (["Price: 250"], None, None), (["MRP", "x", "y", "Rs. 60"], {0: (0, 0), 3: (0, 20)}, ("60", "near box", False)), (["MRP", "x", "y", "Rs. 60"], {0: (0, 0), 3: (500, 400)}, ("60", "bare", False)), (["MRP Rs. 50", "x", "MRP Rs. 60"], None, ("50", "same line", True)), ([], None, None),
])
def test_prices(spark, texts, places, want):
    got = elections.elected(elections.price_candidates(boxed(spark, texts, places), ["p"]), ["p"], ["value"]).collect()
    assert [(r["value"], r["source"], r["review"]) for r in got] == ([want] if want else [])


@pytest.mark.parametrize(("texts", "places", "want"), [
    (["Net Wt 70 g"], None, ("70", "g", "own line")), (["Net Wt", "70 gms"], None, ("70", "g", "line beside")), (["Net Wt", "x", "1.5 kg"], None, ("1.5", "kg", "line beside")), (["NETWT 100 9"], None, ("100", "g", "digit for a unit")), (["Pack of 4 pcs", "Net"], None, None), (["2 kg"], None, None), (["70 g"], None, ("70", "g", "own line")),
    (["Net Wt", "a", "b", "70 g"], {0: (0, 0), 3: (0, 20)}, ("70", "g", "near box")), (["Net Wt", "70 g"], {0: (0, 0), 1: (0, 900)}, ("70", "g", "anywhere")), (["9999999 g net"], None, None),
])
def test_quantities(spark, texts, places, want):
    got = elections.elected(elections.quantity_candidates(boxed(spark, texts, places), ["p"]), ["p"], ["value", "unit"]).collect()
    assert [(r["value"], r["unit"], r["source"]) for r in got] == ([want] if want else [])


@pytest.mark.parametrize(("texts", "places", "codes", "want"), [
    (["Lic. No. 10012043001234"], None, None, ("10012043001234", "own line")), (["FSSAI", "1001 2043 0012 34"], None, None, ("10012043001234", "two lines")), (["LIC.", "NO.", "10012043001234"], None, None, None), (["FSSAI", "NO.", "10012043 001234"], None, None, ("10012043001234", "three lines")), (["FSSAI", "salt", "10012043001234"], None, None, None),
    (["F5SAI", "a", "b", "10012043001234"], {0: (0, 0), 3: (0, 20)}, None, ("10012043001234", "near box")), (["10012043001234"], None, None, None), (["Lic No 10012043001234"], {0: (0, 0)}, [("99", 0.0)], None), (["Lic No 10012043001234"], {0: (0, 0)}, [("10012043001234", 0.0)], ("10012043001234", "own line")), (["Lic No 10012043001234"], {0: (0, 0)}, [("99", 40.0)], ("10012043001234", "own line")),
])
def test_licences(spark, texts, places, codes, want):
    bars = spark.createDataFrame([(1, d, x, 0.0, x + 60, 10.0) for d, x in codes], "p int, digits string, x0 double, y0 double, x1 double, y1 double") if codes else None
    got = elections.elected_licences(boxed(spark, texts, places), ["p"], bars).collect()
    assert [(r["value"], r["source"]) for r in got] == ([want] if want else [])


@pytest.mark.parametrize(("texts", "places", "want"), [
    (["MFD05/2024 net", "Best before 6 months"], None, {"manufacturing_date": ("05/2024", "own line"), "best_before": ("6 months", "own line")}), (["Mfd", "12/05/2024"], None, {"manufacturing_date": ("12/05/2024", "next line")}), (["MFO 05/2024"], None, {"manufacturing_date": ("05/2024", "own line")}),
    (["Mfd", "x", "y", "May 2024"], {0: (0, 0), 3: (0, 20)}, {"manufacturing_date": ("May 2024", "near box")}), (["He1pline", "l8OO-103-1947"], None, {"consumer_care": ("18001031947", "next line")}), (["Plot 12"], None, {}), (["Batch No: AB12"], None, {"batch_lot": ("AB12", "own line")}), (["Lot", "B7/12"], None, {"batch_lot": ("B7/12", "next line")}), (["Lot", "made 12 of them"], None, {}), (["05/2024", "9876543210"], None, {}),
])
def test_fields_that_a_word_leads_to(spark, texts, places, want):
    got = elections.elected(elections.worded_candidates(boxed(spark, texts, places), ["p"]), ["p", "field"], ["value"]).collect()
    assert {r["field"]: (r["value"], r["source"]) for r in got} == want


def test_names(spark):
    rows = [("front", 0, "TASTY", 0.9, 900.0), ("front", 1, "Golden Wheat Rusk", 0.9, 1000.0), ("front", 2, "Net weight 70 g", 0.9, 2000.0), ("back", 3, "golden wheat rusk", 0.9, 10.0), ("back", 4, "Energy", 0.9, 500.0), ("back", 5, "www.acme.in http://x", 0.9, 900.0), ("back", 6, "FSSAI Lic No", 0.9, 100.0)]
    df = spark.createDataFrame([(1, *r) for r in rows] + [(2, "back", 0, "123", 0.9, None), (3, "back", 0, "plain", 0.5, None), (4, "back", 0, "Some words here", 0.1, 10.0), (4, "back", 1, "Another Declaration: of the longest kind that no name ever has", 0.1, 900.0)], "p int, image string, line_no int, text string, confidence double, area double")
    got = {r["p"]: tuple(r)[1:4] for r in elections.elected_names(df, ["p"], r"best\s*before").collect()}
    assert got == {1: ("Golden Wheat Rusk", "TASTY", "Rusk"), 3: ("plain", None, None)}


def test_paragraphs(spark):
    rows = [("Ingre", 0, 0, 25), ("dients: wheat,", 26, 0, 96), ("pack-", 0, 12, 30), ("aged salt", 60, 12, 100), ("Once opened", 0, 24, 60), ("sugar", 0, 36, 30)]
    df = spark.createDataFrame([(1, i, t, float(a), float(b), float(c), b + 10.0) for i, (t, a, b, c) in enumerate(rows)] + [(2, 0, "no box", None, None, None, None), (2, 1, " ", None, None, None, None), (2, 2, "second", None, None, None, None)], "p int, line_no int, text string, x0 double, y0 double, x1 double, y1 double").repartition(3)
    got = {r["p"]: tuple(r)[1:] for r in elections.paragraphs(df, ["p"]).collect()}
    assert got == {1: ("Ingredients: wheat, packaged salt", 3, "STORAGE"), 2: ("no box second", 2, None)}
    assert elections.paragraphs(df.limit(0), ["p"]).collect() == []


def test_regions_of_fields(spark):
    from pyspark.sql import functions as F

    found = regions.anchored(boxed(spark, ["MRP Rs. 5", "x", "mrp", "Ingredients:", "Mfd by Acme"], {0: (100, 100), 2: (0, 0), 3: (50, 200), 4: (10, 300)}), ["p"], F.lit(400.0), F.lit(400.0))
    got = {r["region"]: (r["line_no"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in found.collect()}
    assert got["MRP"] == (0, 70.0, 84.0, 190.0, 126.0) and got["INGREDIENTS"] == (3, 0.0, 210.0, 400.0, 390.0) and got["MANUFACTURER"] == (4, 0.0, 300.0, 110.0, 350.0)
    assert {r["field"]: r["region"] for r in regions.field_region(found, ["p"]).collect()} == {"mrp": "MRP", "manufacturing_date": "DATE", "manufacturer": "MANUFACTURER", "ingredients": "INGREDIENTS", "allergens": "INGREDIENTS"}


def test_manifest_structure(spark):
    make = spark.createDataFrame
    checks = make([("c1", "T", "f", "PRESENT", "R1"), ("c2", None, " ", "ODD", "R1")], "check_id string, title string, field string, check_type string, rule_number string")
    versions = make(
        [("v1", "c1", "IN_FORCE", "2020-01-01", None, "r", "t", None, "v2"), ("v2", "c9", "X", "2020-1-1", "2020-13-01", "", None, "v7", None), ("v2", "c1", "IN_FORCE", None, None, "r", "t", None, None)],
        "version_id string, check_id string, status string, start string, end string, requirement string, text string, supersedes string, superseded_by string",
    )
    applicability = make([("a1", "v1", "REQUIRED", '{"a": 1}'), ("a2", "v9", "MAYBE", "[1]"), ("a3", "v1", "REQUIRED", "not json")], "applicability_id string, version_id string, result string, conditions string")
    weights = make([("c1", "HIGH", "5"), ("c9", "odd", "-1"), ("c2", "LOW", "x")], "check_id string, severity string, weight string")
    got = sorted((r["table"], r["id"], r["problem"]) for r in manifest.structure_problems(checks, versions, applicability, weights, ["PRESENT"]).collect())
    assert got == sorted([
        ("checks", "c2", "missing title"), ("checks", "c2", "missing field"), ("checks", "c2", "unknown check type"), *(("versions", "v2", p) for p in ("duplicate id", "duplicate id", "unknown check", "unknown status", "bad start", "bad end", "no start", "missing requirement", "missing text", "dangling supersedes")),
        ("applicability", "a2", "unknown version"), ("applicability", "a2", "unknown result"), ("applicability", "a2", "conditions are no object"), ("applicability", "a3", "conditions are no object"), ("weights", "c9", "unknown check"), ("weights", "c9", "bad severity"), ("weights", "c9", "negative"), ("weights", "c2", "not a number"),
    ])
    empty = manifest.structure_problems(checks.limit(0), versions.limit(0), applicability.limit(0), weights.limit(0), ["PRESENT"]).collect()
    assert sorted((r["table"], r["problem"]) for r in empty) == [(t, "empty") for t in ("applicability", "checks", "versions", "weights")]
