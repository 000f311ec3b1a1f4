"""Validators, gates of a second look and labels of reports on literal cases."""

import pytest

from canonry.operators import validators

#: (field, value, unit, evidence, objection).
CASES = [
    ("mrp", "108", None, "MRP 108", None), ("mrp", "108", None, "page 108", "no price context"), ("mrp", "Rs. 108", None, "", "not numeric"), ("mrp", "1,250.50", None, "₹", None), ("mrp", "1010005", None, "MRP", "too many digits"), ("mrp", "0", None, "MRP", "not positive"), ("mrp", " ", None, "MRP", "blank"), ("mrp", None, None, "MRP", "blank"),
    ("quantity", "70", "g", "Net Wt 70 g", None), ("quantity", "70 g", None, "NET WEIGHT", None), ("quantity", "1", "pcs", "box", "a small count"), ("quantity", "4", "pcs", "Pack of 4", "a count of servings or packs"), ("quantity", "270", "g", "text", "no net context"), ("quantity", "70", "furlong", "net", "no unit"), ("quantity", "x", "g", "net", "not numeric"),
    ("manufacturing_date", "05/2024", None, "MFD", None), ("manufacturing_date", "70.16", None, "MFD", "no date"), ("best_before", "12/05/2024", None, "best before", None), ("use_by", "12 May 2024", None, "use by", None), ("use_by", "May 2024", None, "page", "no date context"), ("use_by", "31/02/2024", None, "", "no date"), ("use_by", "05/2055", None, "", "no date"), ("expiry_date", "06/25", None, "", None),
    ("fssai_license", "10012043001234", None, "Lic No", None), ("fssai_license", "1001 2043 0012 34", None, "FSSA", None), ("fssai_license", "100120430012", None, "", "not 14 digits"), ("fssai_license", "10012043001234", None, "phone", "no licence context"), ("fssai_license", "98765432101234", None, "fssai", "like a phone"),
    ("consumer_care", "1800-103-1947", None, "", None), ("consumer_care", "a@b.in", None, "", None), ("consumer_care", "call us", None, "", "no contact"), ("batch_lot", "No.", None, "Batch", "a label's word"), ("batch_lot", "AB-12/7", None, "Batch No", None), ("batch_lot", "AB12", None, "page", "no batch context"), ("batch_lot", "A B", None, "lot", "no batch shape"), ("batch_lot", "9876543210", None, "lot", "as long as a phone"),
    ("manufacturer", "Acme Foods", None, "Marketed by Acme Foods", None), ("manufacturer", "Acme Foods", None, "", "no maker context"), ("manufacturer", "AB", None, "mfd by", "too short"), ("ingredients", "wheat, salt", None, "Ingredients", None), ("ingredients", "wheat, per 100 g", None, "Ingredients", "a nutrition table"), ("ingredients", "wheat, storage", None, "", "another section"),
    ("ingredients", "wheat, salt", None, "page", "no heading"), ("ingredients", "wheat", None, "contains", "no list"), ("protein", "8", "g", "Protein 8 g", None), ("protein", "8", "g", "Energy 450", "another row"), ("protein", "x", "g", "Protein", "not numeric"), ("protein", "8", "g", "per 100 g", None), ("trans_fat", "0", "g", "", None), ("serving_size", "30", "g", "table", None), ("added_sugars", "3", None, "", "unknown nutrient"),
    ("veg_nonveg", "veg", None, "green dot", None), ("veg_nonveg", "Non-Veg", None, "", None), ("veg_nonveg", "unknown", None, "dot", "no symbol"), ("veg_nonveg", "VEG", None, "text", "no symbol evidence"), ("country_of_origin", "India", None, "", None), ("country_of_origin", "", None, "", "blank"),
]


def test_objections(spark):
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CASES)], "i int, field string, value string, unit string, evidence string")
    got = {r.i: r.o for r in df.select("i", validators.objection(df.field, df.value, df.unit, df.evidence).alias("o")).collect()}
    assert {i: (CASES[i][:4], o) for i, o in got.items() if o != CASES[i][4]} == {}


@pytest.mark.parametrize(("function", "cases"), [
    (validators.care_number, {"1800-103 1947": "18001031947", "+91 98765 43210": "+919876543210", "a@b.in": "a@b.in", "x": None, None: None}),
    (validators.maker_name, {"Acme  Foods Pvt.Ltd B": "Acme Foods Pvt. Ltd", " ,Acme:": "Acme", "": None, None: None}),
])
def test_forms(spark, function, cases):
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    assert {r.x: r.y for r in df.select("x", function(df.x).alias("y")).collect()} == cases


def test_second_looks(spark):
    cases = [
        ("wheat flour, salt 62%", 0.9, 5.0, None, ["short"]), ("wheat flour, salt 62%", 0.9, 2.0, None, []), ("wheat, INS 5O1, palm oil and much more of it", 0.5, 9.0, None, ["incoherent", "malformed additives"]), ("a # b & c 1 & 2 50%", 0.8, None, None, ["odd characters"]),
        ("INS 501 ok", 0.8, None, ["INS 501 62%", "ins501 62 %"], []), ("INS 501 ok", 0.8, None, ["INS 501", "INS 502"], ["variants differ"]), ("INS 501", 0.8, None, ["INS 501"], []), (None, None, None, None, ["incoherent"]), ("E12 and E123456", 0.8, None, [], ["malformed additives"]),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, t string, c double, r double, v array<string>")
    assert {r.i: r.y for r in df.select("i", validators.second_look(df.t, df.c, df.r, df.v).alias("y")).collect()} == {i: c[4] for i, c in enumerate(cases)}


def test_labels_of_reports(spark):
    physical, online = "Physical Package Inspection", "Online Listing Inspection"
    cases = [("package_only", None, None, physical), (None, "online_listing", "X", online), (None, "other", "X", physical), ("?", "", "PHYSICAL", physical), (None, None, "MARKET_SURVEY", "Market Survey"), ("PACKAGE_AND_ONLINE_LISTING", None, None, "Physical Package + Online Listing Inspection"), (None, None, None, physical)]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, c string, d string, k string")
    assert {r.i: r.y for r in df.select("i", validators.context_label(df.c, df.d, df.k).alias("y")).collect()} == {i: c[3] for i, c in enumerate(cases)}
