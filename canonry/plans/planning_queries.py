"""Queries of planning: groups of fields, rectangles, blocks, usable scans, request keys; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as texts
from ..operators import boundaries, extraction, headings, planning, sections, tables
from .heading_queries import PLANTED, planted
from .rule_queries import table

_GROUPS = {"A": ["name", "quantity"], "B": ["mrp", "date"], "C": ["maker"], "D": ["ingredients"]}


def q120_wanted_groups(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    some = lambda *fs: F.filter(F.array(*(F.when(c, F.lit(f)) for f, c in fs)), lambda x: x.isNotNull())
    s = F.col("p_size")
    required, resolved = some(("quantity", s > 10), ("maker", s > 20), ("zinc", s > 30), ("date", s % 2 == 0)), some(("name", s % 3 == 0), ("quantity", s > 40), ("zinc", s % 5 == 0))
    got = planning.wanted_groups(p.withColumns({"required": required, "resolved": resolved}), _GROUPS, F.col("required"), F.col("resolved"), ["name", "mrp"], 3)
    return got.select("p_partkey", F.array_join("wanted", ",").alias("wanted"), F.array_join("groups", ",").alias("groups"))


Q120 = """WITH w AS (SELECT p_partkey, p_size s, p_size % 3 <> 0 n, p_size > 10 AND p_size <= 40 q, p_size % 2 = 0 d, p_size > 20 m, p_size > 30 AND p_size % 5 <> 0 z FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN n THEN 'name' END, CASE WHEN q THEN 'quantity' END, 'mrp', CASE WHEN d THEN 'date' END, CASE WHEN m THEN 'maker' END, CASE WHEN z THEN 'zinc' END) wanted,
 array_to_string(list_filter([CASE WHEN n OR q THEN 'A' END, 'B', CASE WHEN m THEN 'C' END, CASE WHEN z THEN 'other' END], lambda x: x IS NOT NULL)[1:3], ',') AS groups FROM w"""


def q121_rectangles(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 700).cast("double").alias("x"), (F.col("user_id") * 5).cast("double").alias("y"), "value")
    x, y, v = F.col("x"), F.col("y"), F.col("value")
    grown = planning.padded(x, y, x + 3 * v, y + v, 0.5, F.lit(720.0), F.lit(500.0))
    panel = F.struct(F.lit(100.0).alias("x0"), F.lit(50.0).alias("y0"), F.lit(400.0).alias("x1"), F.lit(300.0).alias("y1"))
    cut = planning.tightened(F.col("grown"), panel)
    return e.withColumn("grown", grown).withColumn("cut", cut).select("event_id", *(F.col(f"cut.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")))


Q121 = """WITH e AS (SELECT event_id, (event_id % 700)::DOUBLE x, (user_id * 5)::DOUBLE y, value v FROM events), g AS (SELECT event_id, greatest(0, x - v * 0.5::DOUBLE) a, greatest(0, y - v * 0.5::DOUBLE) b, least(720, x + 3 * v + v * 0.5::DOUBLE) c, least(500, y + v + v * 0.5::DOUBLE) d FROM e),
i AS (SELECT *, (c - a) * (d - b) > 0 AND greatest(0, least(c, 400) - greatest(a, 100)) * greatest(0, least(d, 300) - greatest(b, 50)) >= 0.4::DOUBLE * ((c - a) * (d - b)) k FROM g)
SELECT event_id, CASE WHEN k THEN greatest(a, 100) ELSE a END x0, CASE WHEN k THEN greatest(b, 50) ELSE b END y0, CASE WHEN k THEN least(c, 400) ELSE c END x1, CASE WHEN k THEN least(d, 300) ELSE d END y1 FROM i"""

#: A part's label of five lines: who, two lines of an address or not, and the rest.
_LABEL = "concat_ws('\\n', CASE WHEN p_size < 20 THEN 'Best before 2026' ELSE 'Product' END, CASE WHEN p_type = 'PROMO' THEN 'Imported by Acme' WHEN p_type = 'SMALL' THEN 'Mfd. by Acme' WHEN p_type = 'ECONOMY' THEN 'Packed by Acme' ELSE 'Nothing' END, CASE WHEN p_size % 2 = 0 THEN 'Plot 7, Phase II' ELSE 'crisp' END, CASE WHEN p_size % 3 = 0 THEN 'Pune, India' ELSE 'golden' END, 'Tel 123')"


def q122_business_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select("p_partkey", F.expr(_LABEL).alias("text"))
    return planning.business_blocks(docs, "p_partkey", "text")


Q122 = """WITH b AS (SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'IMPORTER' WHEN 'SMALL' THEN 'MANUFACTURER' WHEN 'ECONOMY' THEN 'PACKER' END r, CASE p_type WHEN 'PROMO' THEN 'Imported by Acme' WHEN 'SMALL' THEN 'Mfd. by Acme' ELSE 'Packed by Acme' END t, p_size s FROM part)
SELECT p_partkey, 1 AS line_no, r AS role, t || CASE WHEN s % 2 = 0 THEN ' Plot 7, Phase II' || CASE WHEN s % 3 = 0 THEN ' Pune, India Tel 123' ELSE '' END ELSE '' END AS block FROM b WHERE r IS NOT NULL"""


def q123_usable_scans(spark, sf_dir):
    """Whether a line may join the evidence of ingredients as a scan without a heading; its length stands for the score."""
    p = planted(spark, sf_dir)
    return p.select("doc_id", "line_no", planning.usable_scan(F.col("text"), F.when(F.col("line_no") % 3 > 0, F.char_length("text") / 100.0)).alias("usable"))


_MARKED = " + ".join(f"CASE WHEN regexp_matches(t, '(?i)(?:{m})') THEN 1 ELSE 0 END" for m in planning.MARKERS)
Q123 = f"""{PLANTED} SELECT doc_id, line_no, t <> '' AND len(list_filter(regexp_extract_all(lower(t), '[a-z]{{3,}}'), lambda w: list_contains([{", ".join(f"'{w}'" for w in headings.FOOD)}], w))) > 0
 AND NOT ({_MARKED} >= 2 AND coalesce(CASE WHEN line_no % 3 > 0 THEN length(t) / 100.0::DOUBLE END, 0) < 0.7::DOUBLE) AS usable FROM p"""


def q124_accepted_lines(spark, sf_dir):
    """Lines by the section that runs, and those among ingredients as accepted or as rejected for a reason."""
    got = boundaries.split_ingredients(planted(spark, sf_dir), ["doc_id"], "line_no", "text", F.col("text").startswith("Ingredients"))
    return got.select("doc_id", "line_no", "section", "accepted", "reason")


Q124 = f"""{PLANTED}, b AS (SELECT *, CASE WHEN starts_with(t, 'Ingredients') THEN 'INGREDIENTS' ELSE {boundaries.first_sql(boundaries.RULES, 't', 'form')} END opens, {boundaries.first_sql(boundaries.CONTAMINATION, 't', 'form')} c FROM f),
s AS (SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS "section" FROM b), i AS (SELECT *, coalesce("section" = 'INGREDIENTS', false) AND t <> '' AS inside FROM s)
SELECT doc_id, line_no, "section", inside AND c IS NULL AS accepted, CASE WHEN inside THEN c END AS reason FROM i"""


def q125_context_windows(spark, sf_dir):
    """Every line with two lines around it as one text."""
    n = extraction.with_neighbours(table(spark, sf_dir, "documents").where("text is not null"))
    around = F.concat_ws(" ", "before_2", "before_1", "line", "after_1", "after_2")
    return n.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.char_length(around)).alias("chars"), F.count_if(headings.words_in(around, ["the", "der", "les", "los"]) > 3).alias("wordy"))


Q125 = """WITH l AS (SELECT doc_id, i, x[i] line, x FROM (SELECT doc_id, string_split(text, chr(10)) x FROM documents WHERE text IS NOT NULL) t, unnest(range(1, len(x) + 1)) u(i)), a AS (SELECT doc_id, array_to_string(x[greatest(1, i - 2):i + 2], ' ') t FROM l)
SELECT doc_id, count(*) AS lines, sum(length(t))::BIGINT chars, count(*) FILTER (WHERE len(list_filter(regexp_extract_all(lower(t), '[a-z]{3,}'), lambda w: w IN ('the', 'der', 'les', 'los'))) > 3) wordy FROM a GROUP BY 1"""


def q126_coherence_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("lang", sections.coherence_status(extraction.coherence(F.col("text"))).alias("status")).groupBy("lang", "status").agg(F.count("*").alias("n"))


Q126 = r"""WITH c AS (SELECT lang, CASE WHEN len(w) = 0 THEN 0.0 ELSE greatest(0.0, (len(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z]{2,15}[.,;:]?$'))) - 0.5::DOUBLE * len(list_filter(w, lambda x: regexp_matches(x, '[#$%&*|]{2,}'))) - len(list_filter(w, lambda x: length(x) > 25))) / len(w)) END c
 FROM (SELECT lang, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') w FROM documents WHERE text IS NOT NULL))
SELECT lang, CASE WHEN c < 0.35 THEN 'NOT_DETECTED' WHEN c < 0.70 THEN 'NEEDS_REVIEW' ELSE 'DETECTED' END AS status, count(*) n FROM c GROUP BY 1, 2"""


def q127_request_keys(spark, sf_dir):
    """Requests by a key of what they ask; equal ones share an answer. Confidences outside 0 to 1 are none."""
    o = table(spark, sf_dir, "orders").select(texts.request_key(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b")).alias("request"), texts.unit_confidence(F.col("o_totalprice") / 200_000).alias("c"))
    return o.groupBy("request").agg(F.count("*").alias("n"), F.count("c").alias("rated"))


Q127 = """SELECT substr(sha256('{"a":"' || o_orderstatus || '","b":"' || o_orderpriority || '"}'), 1, 16) request, count(*) n, count(*) FILTER (WHERE o_totalprice / 200000 BETWEEN 0 AND 1) rated FROM orders GROUP BY 1"""


def q128_open_policies(spark, sf_dir):
    """Policies that leave a column open accept any value: by priority, orders let through and those of them that a status closed."""
    o = table(spark, sf_dir, "orders").where(tables.dont_care(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")), F.lit("F")))
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"))


Q128 = "SELECT o_orderpriority, count(*) n, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed FROM orders WHERE o_orderpriority = '5-LOW' OR o_orderstatus = 'F' GROUP BY 1"


def q129_filtered_lists(spark, sf_dir):
    """Filters by a list of values, by one value, and by an argument that asks for nothing; the subset test of keys."""
    o = tables.filtered(table(spark, sf_dir, "orders"), o_orderstatus=["F", "O"], o_orderpriority="1-URGENT", o_custkey=None)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return o.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).crossJoin(o.join(c, "o_custkey", "left_anti").agg((F.count("*") == 0).alias("known")))


Q129 = "SELECT count(*) n, sum(o_orderkey)::BIGINT AS keys, count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0 AS known FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT'"

QUERIES = {k: (f, globals().get(k.split("_")[0].upper())) for k, f in list(globals().items()) if k[:1] == "q" and k[1:2].isdigit() and callable(f)}
