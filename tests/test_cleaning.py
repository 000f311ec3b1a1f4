"""Cleaning, additive numbers, classes and status on literal cases."""

import random
import time

from pyspark.sql import functions as F

from canonry.operators import cleaning, validators


def test_cleaned_lists(spark):
    rows = [(1, "wheat flour, salt\n8901234567890\nWheat  Flour, SALT\nsee acme-shop.online now\nsugar 1234 5678 90, oil;"), (2, "\n \n"), (3, None), (4, "12345678"), (5, "INS 500 62%")]
    got = {r["i"]: r["text"] for r in cleaning.cleaned(spark.createDataFrame(rows, "i int, t string"), ["i"], "t").collect()}
    assert got == {1: "wheat flour, salt see now sugar , oil", 5: "INS 500 62%"}


def test_additive_numbers_are_put_right(spark):
    cases = {
        "INS 5O1 and ins 3l2(il)": "INS 501 and INS 312(ii)", "E 4O7, E621": "E407, E621", "( 45l )": "(451)", "INS 500(zz)": "INS 500(zz)", "INS 322(1)": "INS 322(i)", "plain (oil) text": "plain (oil) text", "": "", None: None, "INS501": "INS 501", "INS 322(xx)": "INS 322(xx)", "wINS 5O1": "wINS 5O1",
    }
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    assert {r.x: r.y for r in df.select("x", cleaning.repaired(df.x).alias("y")).collect()} == cases
    began = time.time()
    long = spark.createDataFrame([("INS 5O1, salt, " * 50_000,)], "x string")
    assert long.select(cleaning.repaired(long.x)).first()[0] == "INS 501, salt, " * 50_000 and time.time() - began < 20


def test_classes_of_additives(spark):
    cases = {"Permitted colours (INS 102)": "colour", "Acidity  regulator": "acidity regulator", "INS 330": "additive (INS)", "salt": None, "Stabilizers": "stabilizer", None: None}
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    assert {r.x: r.y for r in df.select("x", cleaning.additive_class(df.x).alias("y")).collect()} == cases


def test_status_of_fields(spark):
    lines = spark.createDataFrame([(1, 0, "MRP Rs 20"), (1, 1, "Lic No 10012043001234 best before"), (1, 2, "Net Wt 70 g FSSAI"), (1, 3, "Customer care"), (2, 0, "20 only"), (2, 1, None)], "p int, line_no long, text string")
    values = spark.createDataFrame([(1, "mrp", "20", 0.9, 0), (1, "fssai_license", "10012043001234", 0.9, 1), (1, "quantity", "70", 0.9, 2), (2, "mrp", "20", 0.8, 0), (2, "batch_lot", "A7", 0.9, None), (2, "quantity", "5", 0.5, 0)], "p int, field string, value string, confidence double, line_no long")
    got = {(r["p"], r["field"]): (r["anchored"], r["fused"], r["status"]) for r in cleaning.field_status(values, lines, ["p"]).collect()}
    want = {(1, "mrp"): (True, 0.9, "DETECTED"), (1, "fssai_license"): (True, 0.45, "NEEDS_REVIEW"), (1, "quantity"): (True, 0.45, "NEEDS_REVIEW"), (1, "consumer_care"): (True, None, "NEEDS_REVIEW"), (1, "batch_lot"): (False, None, "NOT_DETECTED"), (2, "mrp"): (False, 0.56, "NEEDS_REVIEW"), (2, "batch_lot"): (False, 0.63, "DETECTED"), (2, "quantity"): (False, 0.35, "NEEDS_REVIEW")}
    assert {k: got[k] for k in want} == want and len(got) == 2 * len(cleaning.CONTEXTS)
    told = values.join(lines.select("p", "line_no", lines.text.alias("line")), ["p", "line_no"], "left").drop("line_no")
    assert {(r["p"], r["field"]): (r["anchored"], r["fused"], r["status"]) for r in cleaning.field_status(told, lines, ["p"]).collect()} == got


SHOWN = {
    "mrp": "M.R.P.|m . r . p|MRP|mnf|MRF|Max1mum retail price|max  retail price|Retail Price|incl.of all taxes|INCLUSIVE OF ALL TAXES|pr1ce|prlce|PRICE", "quantity": "net|QTY|quantity|Weight|wt|content|Contents|pack  contains|packsize|e-mark|℮|net wt.|we1ght|wei1ght|weilght|quanlity|NETWT",
    "fssai_license": "FSSAI|fsslai|lic. no|LICNO|Licence|license|fss1|essai|f5sai", "manufacturer": "Manufactured by|marketed  for|packed by|mfd by|mkd by|mkt by|mfg by|imported by|pvt|Ltd|limited",
    "manufacturing_date": "mfd|MFG|mfd.|mfg2|manufacture|packed on|pkd|pkg|pkd3|date of packing|dateof packaging|mfo|nfd|mf6|MF9", "best_before": "Best before|usebefore|use by|use-by|Expires|best if used by|consume before|be5t bef0re|3xpiry|u5e by",
    "consumer_care": "care|CALL|customer|toll|Helpline|contact|complaint|phone|tel|service|ca1l|cal1|contaet|he1pline|custorner|feeback|feedback", "batch_lot": "batch|LOT|b.no|B. No|b / n|B/N|batcn|batchNo|1ot n0|lotno", "country_of_origin": "Country of Origin|product of|made in",
}


def test_triggers_hold_every_context(spark):
    r = random.Random(5)
    words = [w for ws in SHOWN.values() for w in ws.split("|")]
    slip = lambda w: "".join(r.choice(["", c, c, c, c, c + " ", c + ".", c.upper(), "\u212a", "\x0b"]) for c in w)
    texts = [None, ""] + words + [f"{r.choice(['x ', 'é', '', '('])}{slip(r.choice(words))} {r.choice(['', '/n', 'ş', '7', r.choice(words)])}" for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for f, p in cleaning.CONTEXTS.items():
        both = df.select("x", cleaning.in_context(df.x, f).alias("a"), validators.has(df.x, p).alias("b")).collect()
        assert [tuple(x) for x in both if x.a != x.b] == [] and sum(x.b for x in both) >= 10, f


def test_contexts_in_prose_take_little_time(spark):
    line = "plain words of an invented text that shows nothing at all, " * 40
    df = spark.range(2000).select("id", F.concat(F.lit(line), F.col("id").cast("string")).alias("x")).cache()
    assert df.count() == 2000
    took = []
    for shown in (lambda f: cleaning.in_context(df.x, f), lambda f: validators.has(df.x, cleaning.CONTEXTS[f])):
        began = time.time()
        df.select(*(shown(f).alias(f) for f in cleaning.CONTEXTS)).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[0] * 2 < took[1]
