"""Extraction, vision candidates, sources and streams on literal fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from canonry.operators import extraction, fields, fuzzy, headings, lifecycle, reconcile, vision
from canonry.sources import io
from canonry.streaming import events


def lines(spark, texts, confidence=0.9):
    return spark.createDataFrame([("i", n, t, confidence) for n, t in enumerate(texts)], "image string, line_no int, text string, confidence double")


def found(spark, texts):
    return {r.field: r for r in fields.best(fields.candidates(lines(spark, texts), ["image"]), ["image"]).collect()}


@pytest.mark.parametrize(("text", "want"), [("MRP Rs.250", "250"), ("MRP ₹1,999.00", "1999.00"), ("Rs. 99 only", "99"), ("Price: 250", None), ("250", None), ("M.R.P. 45.50 incl. of all taxes", "45.50")])
def test_prices(spark, text, want):
    got = found(spark, [text])
    assert (got["mrp"].value if "mrp" in got else None) == want


def test_panel(spark):
    got = found(spark, ["Tasty Foods", "MRP Rs. 50", "Mfd: 05/2024", "Lic. No. 10012043001234", "Customer care 1800-103-1947", "Net Wt", "250 g", "Marketed by: Tasty Foods Pvt Ltd", "Made in India", "Batch No: AB123", "care@tasty.example.com", "Store in a cool place"])
    want = {"mrp": "50", "manufacturing_date": "05/2024", "fssai_license": "10012043001234", "consumer_care": "1800-103-1947", "quantity": "250 g", "manufacturer": "Tasty Foods Pvt Ltd", "country_of_origin": "India", "batch_lot": "AB123", "email": "care@tasty.example.com"}
    assert {k: got[k].value for k in want} == want
    assert got["mrp"].status == "DETECTED" and got["email"].status == "DETECTED" or got["email"].status == "NEEDS_REVIEW"


def test_close_candidates_ask_for_review(spark):
    got = found(spark, ["MRP Rs.50", "MRP Rs.60"])
    assert got["mrp"].status == "NEEDS_REVIEW" and set(got["mrp"].top) == {"50", "60"}


def test_nutrition_and_ingredients(spark):
    n = {r.nutrient: r.amount for r in fields.nutrition(lines(spark, ["Energy (kcal) 450 kcal", "Protein 8 g", "Total Fat 12.5g", "Sodium 300 mg"]), ["image"]).collect()}
    assert n == {"energy": "450 kcal", "protein": "8 g", "total_fat": "12.5g", "sodium": "300 mg"}
    text = "Ingredients: Wheat flour 62%, edible oil (palm, sesame), emulsifier (INS 32O), salt."
    got = fields.ingredients(spark.createDataFrame([("i", text)], "image string, text string"), ["image"]).orderBy("ordinal").collect()
    assert [(r.name, r.percent, r.ins, r.parts) for r in got] == [("Wheat flour", 62.0, None, []), ("edible oil", None, None, ["palm", "sesame"]), ("emulsifier", None, "320", ["INS 32O"]), ("salt", None, None, [])]


def test_blocks_stop_at_the_next_section(spark):
    rows = [(1, n, t) for n, t in enumerate(["Ingredients:", "wheat, oil", "salt", "Store in a cool place", "sugar"])]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, line string")
    docs = spark.createDataFrame([(1, "\n".join(t for _, _, t in rows)), (2, "no heading"), (3, None)], "doc_id int, text string")
    assert [(r.doc_id, r.line_no, r.line) for r in extraction.blocks(docs, "(?i)^ingredients", "(?i)store").collect()] == [(1, 1, "wheat, oil"), (1, 2, "salt")]
    assert [r.line for r in extraction.blocks(docs, "(?i)^ingredients", "(?i)store", most_lines=1).collect()] == ["wheat, oil"] and extraction.blocks(docs, "(?i)^ingredients", "(?i)store", most_chars=9).count() == 0
    assert [r[0] for r in df.orderBy("line_no").select(headings.boundary(df.line, F.lit(""))).collect()] == ["INGREDIENTS", None, None, "STORAGE", None]


def test_registry_lookup(spark):
    registry = spark.createDataFrame([(0, "palm oil"), (1, "sugar"), (2, "salt"), (3, "malt")], "ordinal int, entry string")
    names = spark.createDataFrame([(x,) for x in ["Sugar ", "refined palm oil", "suger", "xalt", "stone", ""]], "name string")
    assert {r.name: (r.match, r.how) for r in fuzzy.lookup(names, registry).collect()} == {"Sugar ": ("sugar", "exact"), "refined palm oil": ("palm oil", "substring"), "suger": ("sugar", "typo"), "xalt": (None, "none"), "stone": (None, "none"), "": (None, "none")}


def test_irregular_answers(spark):
    answers = [("a", json.dumps([{"field": "Price", "value": "50", "status": "found", "confidence": 95, "evidence_text": "MRP 50"}])), ("b", "```json\n" + json.dumps({"fields": {"mrp": {"value": "maybe 60", "status": "found", "confidence": 0.9}}}) + "\n```"), ("c", json.dumps({"quantity": {"value": "", "status": "found", "confidence": 2}})), ("d", "no json")]
    got = vision.validated(vision.flatten(spark.createDataFrame(answers, "image string, answer string"), ["image"]))
    rows = {r.image: (r.field, r.value, r.status, r.confidence) for r in got.collect()}
    assert rows == {"a": ("mrp", "50", "DETECTED", 0.95), "b": ("mrp", "maybe 60", "NEEDS_REVIEW", 0.9), "c": ("quantity", "", "NOT_DETECTED", 0.02)}
    asked = spark.createDataFrame([("a", "mrp"), ("d", "mrp")], "image string, field string")
    assert vision.with_fallback(asked, got, ["image"]).where("image = 'd'").first().status == "NEEDS_REVIEW"


def test_overlay_and_readiness(spark):
    ocr = spark.createDataFrame([("i", "mrp", "50", "DETECTED"), ("i", "quantity", None, "NOT_DETECTED")], "image string, field string, value string, status string")
    seen = spark.createDataFrame([("i", "mrp", "60", "DETECTED", 0.99, "x"), ("i", "quantity", "5 kg", "DETECTED", 0.9, "5 kg"), ("i", "batch_lot", "A1", "DETECTED", 0.9, "")], "image string, field string, value string, status string, confidence double, evidence_text string")
    got = vision.overlay(ocr, seen, ["image"])
    assert {r.field: (r.value, r.status) for r in got.collect()} == {"mrp": ("50", "DETECTED"), "quantity": ("5 kg", "DETECTED"), "batch_lot": ("A1", "NEEDS_REVIEW")}
    need = spark.createDataFrame([("i", f) for f in ("mrp", "batch_lot", "use_by")], "image string, field string")
    r = vision.readiness(need, got, ["image"]).first()
    assert (r.required, r.detected, r.review, r.missing, r.blocked) == (3, 1, 1, 1, "batch_lot,use_by")


def test_reconciliation(spark):
    c = spark.createDataFrame([("p", "mrp", "Rs 50", 0.9, "ocr"), ("p", "mrp", "50.00", 0.7, "vision"), ("p", "brand", "A", 0.5, "ocr"), ("p", "brand", "B", 0.6, "vision")], "product string, field string, value string, confidence double, source string")
    got = {r.field: r for r in reconcile.reconcile(c.withColumn("key", reconcile.comparison_key(c.field, c.value)), ["product", "field"]).collect()}
    assert (got["mrp"].agreement, got["mrp"].confidence, got["mrp"].final_value) == ("AGREED", 0.7, "Rs 50")
    assert (got["brand"].agreement, got["brand"].confidence, got["brand"].final_value) == ("CONFLICT", 0.6, "B")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"entries": [{"name": " Sugar", "status": "ALLOWED"}, {"name": "Salt", "status": "ALLOWED"}]}))
    assert [(r.ordinal, r.entry) for r in io.read_registry(spark, f"{tmp_path}/r.json", "entries", "name").collect()] == [(0, "sugar"), (1, "salt")]
    t = spark.createDataFrame([(x,) for x in ["true", "0123", "1_000", "nan", "x", None, " 5.5 "]], "v string")
    assert [(r[0].kind, r[0].n) for r in t.select(io.typed(t.v)).collect()] == [("bool", None), ("number", 123.0), ("text", None), ("text", None), ("text", None), ("none", None), ("number", 5.5)]
    io.append(t, f"{tmp_path}/t")
    io.append(t, f"{tmp_path}/t")
    io.audit(t, f"{tmp_path}/audit", "me", "read")
    assert io.read_table(spark, f"{tmp_path}/t").count() == 14 and io.read_table(spark, f"{tmp_path}/audit").count() == 7 and not io.exists(spark, "nowhere")
    f = spark.createDataFrame([("p", "B", "PASS"), ("p", "A", "FAIL")], "product_id string, check_id string, result string")
    assert json.loads(io.reports(f, ["product_id"]).first().report) == [{"check_id": "A", "result": "FAIL"}, {"check_id": "B", "result": "PASS"}]


def test_guarded_transitions_as_a_stream(spark, tmp_path):
    schema = "id string, to_status string, seq long"
    for n, rows in enumerate([[("a", "SUBMITTED", 1), ("a", "ACKNOWLEDGED", 2), ("b", "RESOLVED", 3)], [("a", "RESOLVED", 4), ("a", "UNDER_REVIEW", 5), ("b", "SUBMITTED", 6)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        events.run_once(events.guarded(stream, "id", lifecycle.COMPLAINT, "SUBMITTED"), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {r.seq: r.allowed for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True}


def test_windows_as_a_stream(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(f"{tmp_path}/in")
    schema = ", ".join(f"{c} {t}" for c, t in src.dtypes)
    stream = events.windowed(events.read_events(spark, f"{tmp_path}/in", schema), ["event_type"], "1 day", "1 hour")
    events.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert 0 < got.count() and got.groupBy("start", "event_type").count().where("count > 1").count() == 0
