"""Queries of headings, roles and gates over the lines of documents, with openers planted among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boundaries, headings
from .rule_queries import table

#: What is put before a document's lines, in turn: openers, glued and damaged ones, food, addresses, or nothing.
PLANTS = [
    "", "Ingredients:", "FORFEEBACK-CONTACD", "wheat flour (62%), palm oil,", "CONSUMERCARE", "", "Transfer to a container ONCEOPENED", "COHTAINSWHEATMILKSOYANDSULPHITE", "Net wt 70 g", "", "PKD 05/24", "M.R.P. Rs 20", "sugar, salt,",
    "", "store in a dry place", "Ingredients: maida, salt", "Plot 7 Pune 411001", "Nutrition facts", "", "Energy 450 kcal", "best before 6 months", "mail care@acme.example", "keep away from light", "", "Scan the QR", "Marketed by Acme", "Lic FSSAI 10012043001234", "contains: milk",
]


def planted(spark, sf_dir):
    """Lines of all documents (``doc_id``, ``line_no``, ``text``), each with a plant before it."""
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    plant = F.get(F.array(*map(F.lit, PLANTS)), ((F.col("doc_id") + F.col("line_no")) % len(PLANTS)).cast("int"))
    return lines.select("doc_id", "line_no", F.trim(F.concat_ws(" ", plant, "line")).alias("text"))


#: The same in SQL, with the letters and digits of each line.
PLANTED = f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) x FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS line_no, unnest(x) AS line FROM d),
p AS (SELECT doc_id, line_no, trim(([{", ".join("'" + x + "'" for x in PLANTS)}])[(doc_id + line_no) % {len(PLANTS)} + 1] || ' ' || line) AS t FROM l), f AS (SELECT *, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS form FROM p)"""


def q110_sections(spark, sf_dir):
    """The section that each line opens, and what it would contaminate a list of ingredients with."""
    return boundaries.decided(planted(spark, sf_dir), "text").select("doc_id", "line_no", "boundary", "contamination")


Q110 = f"{PLANTED} SELECT doc_id, line_no, {boundaries.first_sql(boundaries.RULES, 't', 'form')} AS boundary, {boundaries.first_sql(boundaries.CONTAMINATION, 't', 'form')} AS contamination FROM f"


def _any_sql(text: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({text}, '(?i)(?:{pattern.replace("'", "''")})'), false)"


def q111_image_roles(spark, sf_dir):
    """Documents as images: their role by the scores of their planted lines; some have a slot that names it."""
    texts = planted(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("texts"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "de", "Front").when(F.col("n_chars") < 150, "side b").alias("slot"))
    return texts.join(docs, "doc_id").select("doc_id", headings.image_role(F.col("slot"), F.col("texts")).alias("role"))


Q111 = f"""{PLANTED}, g AS (SELECT doc_id, string_agg(t, ' ' ORDER BY line_no) t, count(*) n FROM p GROUP BY 1),
s AS (SELECT g.*, lang, n_chars, CASE WHEN n <= 12 THEN 1.0 ELSE 0 END + CASE WHEN regexp_matches(t, '[A-Z]{{4,}}') THEN 1.0 ELSE 0 END + CASE WHEN {_any_sql("t", headings.MARKETING)} THEN 1.0 ELSE 0 END - CASE WHEN {_any_sql("t", headings.DECLARATIONS)} THEN 1.5 ELSE 0 END AS front,
 least(3.0, 0.5 * len(regexp_extract_all(t, '(?i)(?:{headings.DECLARATIONS})'))) + CASE WHEN n >= 6 THEN 1.0 ELSE 0 END AS back, CASE WHEN n <= 10 AND NOT {_any_sql("t", headings.BACK_ONLY)} AND {_any_sql("t", headings.SIDE)} THEN 2.0 ELSE 0 END AS side FROM g JOIN documents USING (doc_id))
SELECT doc_id, CASE WHEN lang = 'de' THEN 'FRONT' WHEN n_chars < 150 THEN 'SIDE' WHEN side >= 2 AND side >= back AND side >= front THEN 'SIDE' WHEN back >= front + 1 THEN 'BACK' WHEN front >= back + 1 THEN 'FRONT' WHEN back > 0 AND n >= 6 THEN 'SIDE' ELSE 'UNKNOWN' END AS role FROM s"""

_CLAIMED = ["quantity", "mrp", "batch", "best_before:second", "fssai_license", "consumer_care", "manufacturer", "veg_nonveg", "product_name"]


def q112_evidence_gate(spark, sf_dir):
    """Whether a line, taken as the evidence of a field, shows what the field needs; its first number stands for the value."""
    claim = F.get(F.array(*map(F.lit, _CLAIMED)), (F.col("line_no") % len(_CLAIMED)).cast("int"))
    d = planted(spark, sf_dir).select("doc_id", "line_no", claim.alias("field"), F.regexp_extract("text", "[0-9]+", 0).alias("value"), "text")
    return d.select("doc_id", "line_no", "field", headings.evidence_gate(F.col("field"), F.col("value"), F.col("text")).alias("stands"))


Q112 = f"""{PLANTED}, c AS (SELECT *, ([{", ".join(f"'{x}'" for x in _CLAIMED)}])[line_no % {len(_CLAIMED)} + 1] AS field, regexp_extract(t, '[0-9]+') AS v FROM p)
SELECT doc_id, line_no, field, CASE split_part(field, ':', 1) WHEN 'fssai_license' THEN length(v) = 14 WHEN 'quantity' THEN {_any_sql("t", headings.EVIDENCE["quantity"])} WHEN 'mrp' THEN {_any_sql("t", headings.EVIDENCE["mrp"])} WHEN 'batch' THEN {_any_sql("t", headings.EVIDENCE["batch"])}
 WHEN 'best_before' THEN {_any_sql("t", headings.EVIDENCE["date"])} WHEN 'consumer_care' THEN regexp_matches(v, '[0-9]{{8,}}') WHEN 'manufacturer' THEN {_any_sql("t", headings.EVIDENCE["maker"])} WHEN 'veg_nonveg' THEN {_any_sql("t", headings.EVIDENCE["symbol"])} ELSE true END AS stands FROM c"""


def q113_cross_checks(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    price = lambda v, s: F.struct(v.cast("string").alias("value"), F.lit(s).alias("score"))
    d = p.select(
        "p_partkey", F.concat(F.lit("Rs. "), F.col("p_size").cast("string")).alias("mrp"), F.concat(F.lit("Lic "), (F.col("p_size") + F.when(F.col("p_size") % 7 == 3, 0).otherwise(1000)).cast("string")).alias("fssai_license"),
        F.when(F.col("p_size") > 40, F.col("p_size").cast("string")).alias("consumer_care"), (F.col("p_size") % 5 == 0).alias("joined"),
        F.array(price(F.col("p_size"), 1.0), price(F.lit(20), 0.7), price(F.col("p_size"), 0.2)).alias("prices"),
    )
    return headings.cross_checks(d, ["p_partkey"])


Q113 = """SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 7 = 3 THEN 'mrp=fssai_license' END, CASE WHEN p_size > 40 THEN 'mrp=consumer_care' END, CASE WHEN p_size > 40 AND p_size % 7 = 3 THEN 'fssai_license=consumer_care' END, CASE WHEN p_size % 5 = 0 THEN 'manufacturer joined' END, CASE WHEN p_size <> 20 THEN 'several prices' END) AS reasons FROM part"""


def q114_windows(spark, sf_dir):
    """Sections of documents: from the first line that ends in a stop, holds a bar, or says licence."""
    found = headings.windows(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text", {"stops": (r"\.$", 4), "bars": (r"\|", 3), "legal": ("licen[cs]e", 3)})
    return found.select("doc_id", *(F.md5(F.col(c).cast("binary")).alias(c) for c in ("stops", "bars", "legal")))


def _window_sql(pattern: str, n: int) -> str:
    at = f"list_position(list_transform(x, lambda l: regexp_matches(l, '(?i)(?:{pattern})')), true)"
    return f"CASE WHEN {at} > 0 THEN md5(array_to_string(x[{at}:{at} + {n - 1}], ' ')) END"


Q114 = f"SELECT doc_id, {_window_sql('[.]$', 4)} stops, {_window_sql('[|]', 3)} bars, {_window_sql('licen[cs]e', 3)} legal FROM (SELECT doc_id, string_split(text, chr(10)) x FROM documents WHERE text IS NOT NULL)"


def q115_fields_over_images(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.expr("user_id * 1000 + dayofyear(ts)").alias("item"), F.when(F.col("value") > 1, F.col("event_type")).alias("value"), (F.col("value") > 45).alias("anchored"), F.col("value").alias("confidence"), F.col("event_id").alias("image"))
    return headings.reconcile_images(e, ["item"])


Q115 = """WITH e AS (SELECT user_id * 1000 + dayofyear(ts) AS item, event_type v, value > 45 a, value c, event_id i FROM events WHERE value > 1), k AS (SELECT * FROM e QUALIFY a = bool_or(a) OVER (PARTITION BY item))
SELECT item, CASE WHEN count(DISTINCT v) = 1 THEN arg_max(v, (c, -i)) END AS value, CASE WHEN count(DISTINCT v) = 1 THEN 'DETECTED' ELSE 'NEEDS_REVIEW' END status, string_agg(DISTINCT v, '|' ORDER BY v) candidates, count(*) AS hits FROM k GROUP BY 1"""

QUERIES = {k: (f, globals().get(k.split("_")[0].upper())) for k, f in list(globals().items()) if k[:1] == "q" and k[1:2].isdigit() and callable(f)}
