"""Layout, alignment and feedback on literal fixtures."""

import time

from pyspark.sql import functions as F

from canonry.operators import alignment, extraction, feedback, layout, planning

BOX = "image string, rank int, x0 double, y0 double, x1 double, y1 double"


def test_overlapping_boxes_are_suppressed_in_order(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 0.0, 10.0, 10.0), ("a", 2, 0.0, 0.0, 10.0, 10.5), ("a", 3, 20.0, 0.0, 30.0, 10.0), ("b", 1, 0.0, 0.0, 1.0, 1.0)], BOX)
    assert sorted((r.image, r["rank"]) for r in layout.suppressed(df, BOX).collect()) == [("a", 1), ("a", 3), ("b", 1)]
    a, b = df.where("rank = 1 and image = 'a'").alias("a"), df.where("rank = 2").alias("b")
    assert abs(a.crossJoin(b).select(layout.iou("a", "b")).first()[0] - 100 / 105) < 1e-9


def test_columns_and_reading_order(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 0.0, 10.0, 5.0), ("a", 2, 20.0, 1.0, 30.0, 6.0), ("a", 3, 1.0, 10.0, 9.0, 15.0)], BOX)
    got = {r["rank"]: r.column for r in layout.columns_of(df, BOX).collect()}
    assert got[1] == got[3] != got[2]
    assert [r["rank"] for r in layout.reading_order(df).orderBy("place").collect()] == [1, 2, 3]


def test_panels_end_at_the_next_anchor(spark):
    anchors = spark.createDataFrame([("a", "ingredients", 0.0, 10.0, 0.0), ("a", "nutrition", 0.0, 10.0, 50.0)], "image string, section string, x0 double, x1 double, y0 double")
    lines = spark.createDataFrame([("a", 1.0, 9.0, float(y), y + 5.0) for y in (0, 10, 60)] + [("a", 50.0, 60.0, 10.0, 15.0)], "image string, x0 double, x1 double, y0 double, y1 double")
    assert {r.section: r.lines for r in layout.panels(anchors, lines).collect()} == {"ingredients": 2, "nutrition": 1}


def test_texts_near_symbols(spark):
    symbols = spark.createDataFrame([("a", "dot", 0.1, 0.1, 0.2, 0.2), ("b", "dot", 0.0, 0.0, 0.1, 0.1)], "image string, symbol string, x0 double, y0 double, x1 double, y1 double")
    texts = spark.createDataFrame([("a", "veg", 0.2, 0.1, 0.3, 0.2), ("a", "far", 0.8, 0.8, 0.9, 0.9)], "image string, text string, x0 double, y0 double, x1 double, y1 double")
    assert {r.image: r.nearby for r in layout.symbol_texts(symbols, texts).collect()} == {"a": "veg", "b": ""}


def test_alignment(spark):
    df = spark.createDataFrame([("wheat, oil, salt", "wheat, palm oil, salt, sugar"), (None, "a"), ("sugarsalt and flourx", "x")], "a string, b string")
    assert [r[0] for r in df.select(alignment.merge_readings()("a", "b")).collect()][:2] == ["wheat, palm oil, salt, sugar?", "a"]
    assert [r[0] for r in df.select(alignment.spaced(df.a, ["sugar", "salt", "and"])).collect()] == ["wheat, oil, salt", None, "sugar salt and flourx"]
    nested = spark.createDataFrame([("a (b, (c, d)), e",), ("a (b, c",)], "t string")
    assert [r[0] for r in nested.select(alignment.nested_items(nested.t)).collect()] == [["a (b, (c, d))", "e"], ["a (b", "c"]]


def test_feedback(spark):
    values = spark.createDataFrame([("p", "mrp", "50"), ("p", "brand", "A")], "product string, field string, value string")
    corrections = spark.createDataFrame([(1, "p", "mrp", "50", "55", "DETECTED", 1, True), (2, "p", "mrp", "50", "5 0", "DETECTED", 2, False), (3, "p", "mrp", None, "60", "NOT_DETECTED", 0, True)], "id int, product string, field string, original_value string, corrected_value string, original_status string, created_at int, verified boolean")
    assert {r.field: (r.value, r.corrected) for r in feedback.verified_overlay(values, corrections, ["product"]).collect()} == {"mrp": ("55", True), "brand": ("A", False)}
    assert {(r.kind, r.n, r.latest) for r in feedback.patterns(corrections).collect()} == {("misread", 1, "1"), ("format", 1, "2"), ("missed", 1, "3")}
    notes = feedback.fan_out(spark.createDataFrame([(1, "officers", 5)], "id int, audience string, created_at int"), {"officers": ["x", "y"]})
    assert notes.count() == 2
    reads = spark.createDataFrame([(None, "x", 9)], "id int, recipient string, at int")
    assert {r.recipient: r.read for r in feedback.mark_read(notes, reads).collect()} == {"x": True, "y": False}
    v = spark.createDataFrame([(1, "PENDING"), (2, "PENDING")], "violation_id int, inspector_status string")
    acts = spark.createDataFrame([(1, 1, "reject", 1), (2, 1, "confirm", 2)], "action_id int, violation_id int, action string, at int")
    assert {r.violation_id: r.inspector_status for r in feedback.decided(v, acts).collect()} == {1: "CONFIRMED", 2: "PENDING"}


def test_a_very_long_word_and_a_text_of_many_lines_take_linear_time(spark):
    n = 1_000_000
    words = spark.createDataFrame([("x" * n,), ("#a" * (n // 2),), ("a#" * 10 + "##" + "b" * n,), ("plain words, here.",), ("",), (None,), (" \n ",)], "text string")
    began = time.time()
    got = [r[0] for r in words.select(extraction.coherence(words.text)).collect()]
    assert got == [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0] and time.time() - began < 20
    docs = spark.createDataFrame([(1, "\n".join(f"Packed by {i}\nPlot {i}, India" for i in range(10_000)))], "doc_id int, text string")
    began = time.time()
    lines = extraction.with_neighbours(docs).where("line_no = 9999").first()
    assert (lines["before_1"], lines["line"], lines["after_1"]) == ("Packed by 4999", "Plot 4999, India", "Packed by 5000")
    blocks = planning.business_blocks(docs, "doc_id", "text").agg(F.count("*"), F.max("block")).first()
    assert blocks[0] == 10_000 and blocks[1] == "Packed by 9999 Plot 9999, India" and time.time() - began < 20


def test_roles_of_business_blocks(spark):
    texts = ["Marketed by A, Packed by B", "Imported and packed by C", "Packed by D", "Mkd. by E", "Manufactured & Marketed by F", "mard by G", "Imported by H", "Mfg by I"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["role"] for r in planning.business_blocks(docs, "doc_id", "text").collect()}
    assert got == {0: "MARKETER", 1: "IMPORTER", 2: "PACKER", 3: "MANUFACTURER", 4: "MARKETER", 6: "IMPORTER", 7: "MANUFACTURER"}
