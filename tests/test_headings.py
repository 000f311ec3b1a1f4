"""Headings, roles, gates, scans and boundaries over hard lines whose right answers stand beside them."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from canonry.operators import boundaries, headings, planning

#: (line, lines around it, the section it opens).
LINES = [
    ("INGREDIENTS:", "", "INGREDIENTS"), ("INGRED1ENTS Wheat flour", "", "INGREDIENTS"), ("Compositon", "", "INGREDIENTS"), ("Contents", "", None), ("Contents", "Refined wheat flour, palm oil", "INGREDIENTS"),
    ("Contents: wheat flour, sugar", "", "INGREDIENTS"), ("Contains: Milk, Soy", "", "CONTAINS"), ("Contents: Milk, Soy", "wheat flour, salt", "CONTAINS"), ("Net contents 70 g", "wheat flour", None), ("Made from durum wheat", "", "INGREDIENTS"),
    ("सामग्री", "", "INGREDIENTS"), ("Nutritional Information per 100 g", "", "NUTRITION"), ("Typical values", "", "NUTRITION"), ("Allergen advice", "", "ALLERGEN"), ("Store in a cool dry place", "", "STORAGE"), ("Directions for use", "", "DIRECTIONS"),
    ("How to cook", "", "COOKING"), ("Statutory warning", "", "WARNING"), ("Packed by ABC Foods", "", "PACKER"), ("Imported by XYZ", "", "IMPORTER"), ("Manufactured & Marketed by ABC", "", "MANUFACTURER"), ("Mfd. by ABC", "", "MANUFACTURER"),
    ("Best before 6 months", "", "BEST_BEFORE"), ("Mfg date", "", "MFG_DATE"), ("PKD 05/24", "", "MFG_DATE"), ("Lot no 17", "", "BATCH"), ("M.R.P. Rs 20", "", "MRP"), ("FSSAI Lic 10012043001234", "", "FSSAI"), ("For any queries", "", "FEEDBACK"),
    ("Know your portion", "", "PORTION"), ("Scan to know more", "", "QR"), ("Toll-free 1800 103 1947", "", "CONSUMER_CARE"), ("Bar code", "", "BARCODE"), ("crispy and golden", "", None), ("   ", "", None), ("ingredient list 12345", "", None),
    ("inredients", "", "INGREDIENTS"), ("greatest", "", None), ("contains", "milk", "CONTAINS"), ("contents page", "our story, our values", None),
]
#: (slot, lines, role).
IMAGES = [
    ("front", ["fssai"], "FRONT"), ("Side left", [], "SIDE"), ("listing", ["NEW"], "UNKNOWN"), ("img1", ["NEW CRUNCHY", "Masala"], "FRONT"), ("img2", ["Ingredients: wheat", "Nutrition facts", "FSSAI 1", "Customer care", "Net wt 10 g", "MRP 20", "Batch 7"], "BACK"),
    ("img3", ["MRP Rs 20", "Batch 12"], "SIDE"), ("img4", [], "UNKNOWN"), ("top", ["x"], "TOP"), ("bottom", ["x"], "BOTTOM"), ("img5", ["a word"], "FRONT"), (None, ["Best before 6 months"], "SIDE"),
]
#: (field, value, evidence, whether it may stand).
CLAIMS = [
    ("quantity", "70 g", "Net wt 70 g", True), ("quantity", "70 g", "4 servings", False), ("mrp", "20", "M.R.P. 20", True), ("mrp", "20", "page 20", False), ("batch_lot", "A7", "Batch No A7", True), ("batch", "A7", "A7", False),
    ("best_before", "6 months", "Best before 6 months", True), ("use_by", "2026", "2026", False), ("fssai_license", "10012043001234", "", True), ("fssai_license", "1001204300", "fssai", False), ("consumer_care", "1800-103-1947", "", True),
    ("consumer_care", "care@x.in", "", True), ("consumer_care", "call us", "call us", False), ("manufacturer", "ABC", "Manufactured by ABC", True), ("manufacturer", "ABC", "ABC", False), ("veg_nonveg", "VEGETARIAN", "green dot", True),
    ("veg_nonveg", "VEGETARIAN", "text", False), ("product_name", "Noodles", "", True), ("mrp:second", "20", "Rs. 20", True),
]


#: (text, score, whether it may be used).
SCANS = [("wheat flour, palm oil, salt", "0.2", True), ("FSSAI Lic No 10012043001234 MRP 20", "0.2", False), ("wheat MRP 20 mfd 05/24", "0.3", False), ("wheat MRP 20 mfd 05/24", "0.8", True), ("", "0.9", False), (None, "0.9", False), ("lorem ipsum", "0.9", False), ("sugar 1001 2043 0012 34 1", None, True)]


def test_sections_and_accepted_lines(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(LINES)], "i int, line string, context string")
    got = {r.i: r.s for r in df.select("i", headings.boundary(df.line, df.context).alias("s")).collect()}
    assert got == {i: s for i, (_, _, s) in enumerate(LINES)}
    told = {r.i: (r.section, r.accepted) for r in planning.accepted_lines(df, "line", "context").collect()}
    assert told == {i: (s if s != "INGREDIENTS" else None, bool(a.strip()) and s in (None, "INGREDIENTS")) for i, (a, _, s) in enumerate(LINES)}


def test_roles_of_images(spark):
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(IMAGES)], "i int, slot string, texts array<string>")
    assert {r.i: r.r for r in df.select("i", headings.image_role(df.slot, df.texts).alias("r")).collect()} == {i: r for i, (_, _, r) in enumerate(IMAGES)}


def test_evidence_of_fields(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CLAIMS)], "i int, field string, value string, evidence string")
    assert {r.i: r.s for r in df.select("i", headings.evidence_gate(df.field, df.value, df.evidence).alias("s")).collect()} == {i: c[3] for i, c in enumerate(CLAIMS)}


def test_usable_scans(spark):
    df = spark.createDataFrame([(i, a, float(b) if b else None) for i, (a, b, _) in enumerate(SCANS)], "i int, text string, score double")
    assert {r.i: r.u for r in df.select("i", planning.usable_scan(df.text, df.score).alias("u")).collect()} == {i: u for i, (_, _, u) in enumerate(SCANS)}


#: (line, section it opens, what it contaminates ingredients with).
BOUNDS = [
    ("ONCEOPENEDTRANSFERTOANAIRTIGHTCONTAINER", "STORAGE", "storage"), ("Forfeeback-Contacd", "FEEDBACK", "feedback"), ("CONSUMERCARE", "CONSUMER_CARE", "care"), ("COHTAINSWHEATMILKSOYANDSULPHITE", "ALLERGEN", "allergen"),
    ("Wheat flour, palm oil (sesame), 62%", None, None), ("milk solids, soy lecithin", None, None), ("stored grain, store bought oil, keep", "STORAGE", "storage"), ("malt, starch, salt, sugar, cocoa, milk, store room, oats", None, None), ("Call 9876543210", "CONSUMER_CARE", "contact"), ("9876543210", None, None),
    ("MAXIMUMRETAILPRICE", "MRP", None), ("sugar, MAXIMUMRETAILPRICE", None, None), ("mrp", None, None), ("MRP 20", "MRP", "price"), ("a, b mrp 20", "MRP", "price"), ("manufactured, a", "MFG_DATE", "date"), ("a very long list of things, some of it manufactured", None, None), ("packed 05/2024, a", "MFG_DATE", "date"),
    ("Net wt", "QUANTITY", None), ("Protein 8 g", "NUTRITION", None), ("Protein (milk) 8 g", None, None), ("410001 Pune", None, "address"), ("1234567", None, None), ("", None, None), ("   ", None, None), (None, None, None), ("Contains: Milk", "ALLERGEN", "allergen"), ("executive care cell", "CONSUMER_CARE", "care"), ("PER100G", "NUTRITION", "nutrition"), ("USEBY", "BEST_BEFORE", "date"),
]


def test_boundaries_and_contamination(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(BOUNDS)], "i int, line string")
    got = {r.i: (r.line, r.boundary, r.contamination) for r in boundaries.decided(df, "line").collect()}
    assert got == dict(enumerate(BOUNDS))


@pytest.mark.parametrize("seed", range(3))
def test_the_automaton_finds_what_a_search_for_each_marker_finds(seed):
    r = random.Random(seed)
    markers = ["a", "ab", "bab", "bc", "bca", "c", "caa", "abcabc"] if seed == 0 else boundaries.MARKERS
    texts = ["", *("".join(r.choice([r.choice(markers), r.choice(markers)[:-1], r.choice("abcnt1z")]) for _ in range(r.randint(0, 12))) for _ in range(400)), "".join(markers) * 50]
    assert boundaries.Automaton(markers).search([t.encode() for t in texts]) == [[i for i, m in enumerate(markers) if m in t] for t in texts]
    assert boundaries.Automaton(markers).search([]) == []
    # Pieces shorter than a marker lose none; a text of a million letters is as quick as many short ones.
    assert boundaries.Automaton(markers).search([t.encode() for t in texts], piece=3) == boundaries.Automaton(markers).search([t.encode() for t in texts])
    began = time.time()
    assert boundaries.Automaton(markers).search([b"x" * 1_000_000 + markers[-1].encode()])[0] and time.time() - began < 5


def test_markers_planted_in_lines_are_found(spark):
    r = random.Random(9)
    noise = lambda m: "".join(r.choice([c, c.upper()]) + r.choice(["", "", " ", "-", ". "]) for c in m)
    rows = [(i, "é " + "".join(r.choice("xyz ,") for _ in range(r.randint(0, 9))) + noise(m)) for i, m in enumerate(boundaries.MARKERS * 3)]
    df = spark.createDataFrame(rows, "i int, line string")
    got = {x.i: set(x.m) for x in df.select("i", boundaries.markers_in(df.line).alias("m")).collect()}
    assert got == {i: {k for k, m in enumerate(boundaries.MARKERS) if m in re.sub("[^a-z0-9]", "", t.lower())} for i, t in rows} and all(i % len(boundaries.MARKERS) in got[i] for i in got)


def test_sections_run_on_and_rejected_lines_keep_their_reason(spark):
    lines = ["Tasty", "Ingredients: wheat", "sugar, salt", "", "Plot 7, Pune 411001", "oil", "Store in a dry place", "salt", "Ingredients", "cocoa"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)] + [(2, 0, "oil")], "doc int, n int, text string")
    got = [(x.section, x.accepted, x.reason) for x in boundaries.split_ingredients(df, ["doc"], "n", "text", F.col("text").startswith("Ingredients")).orderBy("doc", "n").collect()]
    yes, no = ("INGREDIENTS", True, None), ("INGREDIENTS", False, None)
    assert got == [(None, False, None), yes, yes, no, ("INGREDIENTS", False, "address"), yes, ("STORAGE", False, None), ("STORAGE", False, None), yes, yes, (None, False, None)]
