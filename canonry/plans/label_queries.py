"""Queries of label extraction, over labels made of part attributes so that SQL knows the right values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fields, vision
from ..sources import io
from .rule_queries import table


def label_lines(spark, sf_dir):
    """Four layouts of labels, by part key."""
    p = table(spark, sf_dir, "part")
    price, size, code, month = F.format_string("%.2f", "p_retailprice"), F.col("p_size").cast("string"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), (F.col("p_size") % 9 + 1).cast("string")
    lay = lambda *x: F.array(*(c if not isinstance(c, str) else F.lit(c) for c in x))
    layouts = (
        F.when(F.col("p_partkey") % 4 == 0, lay(F.concat(F.lit("MRP Rs. "), price), F.concat(F.lit("Net Wt "), size, F.lit(" g")), F.concat(F.lit("Lic. No. 1001204300"), code)))
        .when(F.col("p_partkey") % 4 == 1, lay("M.R.P.", F.concat(F.lit("Rs. "), price, F.lit("/-")), "Net quantity", F.concat(size, F.lit(" kg"))))
        .when(F.col("p_partkey") % 4 == 2, lay(F.concat(F.lit("Price: "), price), "Made in India", F.concat(F.lit("Mfd: 0"), month, F.lit("/2024")), F.concat(F.lit("Protein "), size, F.lit(" g"))))
        .otherwise(lay(F.concat(F.lit("Customer care 1800-103-"), code), "Best before 6 months from packing", F.concat(F.lit("Energy "), size, F.lit(" kcal"))))
    )
    return p.select("p_partkey", F.posexplode(layouts).alias("line_no", "text"), F.lit(0.9).alias("confidence"))


def q51_label_fields(spark, sf_dir):
    return fields.best(fields.candidates(label_lines(spark, sf_dir), ["p_partkey"]), ["p_partkey"]).select("p_partkey", "field", "value", "source")


Q51 = """WITH p AS (SELECT *, p_partkey % 4 v, printf('%.2f', p_retailprice) price, lpad((p_partkey % 10000)::VARCHAR, 4, '0') code FROM part)
SELECT p_partkey, 'mrp' field, price AS value, CASE v WHEN 0 THEN 'same_line' ELSE 'next_line' END AS source FROM p WHERE v < 2
UNION ALL SELECT p_partkey, 'quantity', p_size || ' g', 'anchored' FROM p WHERE v = 0 UNION ALL SELECT p_partkey, 'quantity', p_size || ' kg', 'anchored_next' FROM p WHERE v = 1
UNION ALL SELECT p_partkey, 'fssai_license', '1001204300' || code, 'same_line' FROM p WHERE v = 0
UNION ALL SELECT p_partkey, 'country_of_origin', 'India', 'phrase' FROM p WHERE v = 2 UNION ALL SELECT p_partkey, 'manufacturing_date', '0' || (p_size % 9 + 1) || '/2024', 'same_line' FROM p WHERE v = 2
UNION ALL SELECT p_partkey, 'consumer_care', '1800-103-' || code, 'toll_free' FROM p WHERE v = 3 UNION ALL SELECT p_partkey, 'best_before', '6 months from packing', 'duration' FROM p WHERE v = 3"""


def q52_nutrition(spark, sf_dir):
    return fields.nutrition(label_lines(spark, sf_dir), ["p_partkey"])


Q52 = "SELECT p_partkey, 'protein' nutrient, p_size || ' g' amount FROM part WHERE p_partkey % 4 = 2 UNION ALL SELECT p_partkey, 'energy', p_size || ' kcal' FROM part WHERE p_partkey % 4 = 3"


def q53_readiness(spark, sf_dir):
    got = fields.best(fields.candidates(label_lines(spark, sf_dir), ["p_partkey"]), ["p_partkey"])
    need = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*map(F.lit, ["mrp", "quantity", "consumer_care"]))).alias("field"))
    return vision.readiness(need, got, ["p_partkey"])


Q53 = """SELECT p_partkey, 3 required, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END detected, 0 review, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 2 END missing,
 CASE p_partkey % 4 WHEN 0 THEN 'consumer_care' WHEN 1 THEN 'consumer_care' WHEN 2 THEN 'consumer_care,mrp,quantity' ELSE 'mrp,quantity' END blocked FROM part"""


def q54_ingredients(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("Ingredients: "), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("%, oil (palm, "), F.lower("p_type"), F.lit("), colour (INS 1O2), salt."))
    got = fields.ingredients(p.select("p_partkey", text.alias("text")), ["p_partkey"])
    return got.select("p_partkey", F.col("ordinal").cast("long").alias("ordinal"), "name", "percent", "ins", F.array_join("parts", "+").alias("parts"))


Q54 = """SELECT p_partkey, 0::BIGINT ordinal, p_name AS name, p_size::DOUBLE percent, NULL::VARCHAR ins, '' parts FROM part UNION ALL SELECT p_partkey, 1, 'oil', NULL, NULL, 'palm+' || lower(p_type) FROM part
UNION ALL SELECT p_partkey, 2, 'colour', NULL, '102', 'INS 1O2' FROM part UNION ALL SELECT p_partkey, 3, 'salt', NULL, NULL, '' FROM part"""


def q55_typed_values(spark, sf_dir):
    """Attributes kept as text get their types back."""
    p = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("0"), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.when(F.col("p_size") % 2 == 0, "TRUE").otherwise(" false "))
    t = io.typed(raw)
    return p.select("p_partkey", t["kind"].alias("kind"), t["b"].alias("b"), t["n"].alias("n"), t["s"].alias("s"))


Q55 = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'text' ELSE 'bool' END kind, CASE WHEN p_partkey % 3 = 2 THEN p_size % 2 = 0 END b, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE END n, CASE WHEN p_partkey % 3 = 1 THEN p_name END s FROM part"


def q56_vision_answers(spark, sf_dir):
    """Answers of two shapes, read, named, judged and laid over readings."""
    p = table(spark, sf_dir, "part")
    entry = F.struct(F.col("p_name").alias("value"), F.lit("found").alias("status"), (F.col("p_size") * 2.0).alias("confidence"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).otherwise("").alias("evidence_text"))
    listed = F.to_json(F.array(F.struct(F.lit("Price").alias("field"), entry["value"].alias("value"), entry["status"].alias("status"), entry["confidence"].alias("confidence"), entry["evidence_text"].alias("evidence_text"))))
    mapped = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.struct(entry.alias("mrp")).alias("fields"))), F.lit("\n```"))
    answers = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, listed).otherwise(mapped).alias("answer"))
    seen = vision.validated(vision.flatten(answers, ["p_partkey"]))
    ocr = p.where("p_partkey % 5 = 0").select("p_partkey", F.lit("mrp").alias("field"), F.lit("read").alias("value"), F.lit("DETECTED").alias("status"))
    return vision.overlay(ocr, seen, ["p_partkey"])


Q56 = "SELECT p_partkey, 'mrp' field, CASE WHEN p_partkey % 5 = 0 THEN 'read' ELSE p_name END AS value, CASE WHEN p_partkey % 5 = 0 THEN 'DETECTED' WHEN p_partkey % 3 > 0 AND CASE WHEN p_size * 2.0 > 1 THEN p_size * 2.0 / 100 ELSE p_size * 2.0 END >= 0.85 THEN 'DETECTED' ELSE 'NEEDS_REVIEW' END status FROM part"

_NAMES = "q51_label_fields q52_nutrition q53_readiness q54_ingredients q55_typed_values q56_vision_answers"
QUERIES = {n: (globals()[n], globals()[n.split("_")[0].upper()]) for n in _NAMES.split()}
