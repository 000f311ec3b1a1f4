"""Queries of lines, boxes, readings and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panels, temporal
from ..sources.seed import VERSIONS
from .rule_queries import table

#: A user's events as lines of a panel: a heading, values alone, words cut by hyphens.
_TEXT = "CASE event_type WHEN 'error' THEN 'Nutrition facts' WHEN 'purchase' THEN 'Ingredients:' WHEN 'view' THEN concat(CAST(event_id % 90 AS {v}), ' kcal') WHEN 'signup' THEN concat('pro-') ELSE concat('tein row ', CAST(event_id % 7 AS {v})) END"


def event_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("line_no"), F.expr(_TEXT.format(v="STRING")).alias("text"), "event_type", "value", "ts")


_LINES = f"WITH e AS (SELECT user_id, event_id AS line_no, {_TEXT.format(v='VARCHAR')} AS text, event_type, value, ts FROM events)"


def q80_nutrition_block(spark, sf_dir):
    t = F.col("text")
    return panels.attach_values(event_lines(spark, sf_dir), ["user_id"], "line_no", t.startswith("Nutrition"), t.rlike(r"^\d+ kcal$"), t.startswith("Ingredients"), most=400)


Q80 = (
    _LINES
    + """, h AS (SELECT *, min(line_no) FILTER (WHERE text LIKE 'Nutrition%') OVER (PARTITION BY user_id) head FROM e),
b AS (SELECT * FROM h WHERE line_no >= head AND line_no <= head + 400 AND line_no < coalesce((SELECT min(line_no) FROM e s WHERE s.user_id = h.user_id AND s.text LIKE 'Ingredients%' AND s.line_no > h.head), 1e18)),
n AS (SELECT *, sum(CASE WHEN regexp_matches(text, '^[0-9]+ kcal$') AND line_no > head THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY line_no) AS grp FROM b)
SELECT user_id, grp::BIGINT AS "row", string_agg(text, ' ' ORDER BY line_no) AS text FROM n GROUP BY 1, 2"""
)


def q81_rejoined_lines(spark, sf_dir):
    got = panels.rejoin(event_lines(spark, sf_dir), ["user_id"], "line_no")
    return got.groupBy("user_id").agg(F.count("*").alias("lines"), F.count_if(F.col("text").contains("protein")).alias("rejoined"), F.sum(F.char_length("text")).alias("chars"))


Q81 = (
    _LINES
    + """, p AS (SELECT *, lag(text) OVER (PARTITION BY user_id ORDER BY line_no) before FROM e), g AS (SELECT *, sum(CASE WHEN coalesce(before = 'pro-', false) AND (text LIKE 'tein%' OR text = 'pro-') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY line_no) k FROM p),
j AS (SELECT user_id, k, string_agg(text, '' ORDER BY line_no) AS text, count(*) n FROM g GROUP BY 1, 2)
SELECT user_id, count(*) AS lines, count(*) FILTER (WHERE contains(replace(text, '-', ''), 'protein')) rejoined, sum(length(text) - n + 1)::BIGINT chars FROM j GROUP BY 1"""
)


def q82_prominence(spark, sf_dir):
    return panels.prominence(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], F.col("o_totalprice")).where("prominence >= 0.9").select("o_orderkey", "prominence")


Q82 = "SELECT o_orderkey, prominence FROM (SELECT o_orderkey, o_totalprice / max(o_totalprice) OVER (PARTITION BY o_custkey) prominence FROM orders) WHERE prominence >= 0.9"


def q83_bands(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value < 2").select("user_id", (F.col("event_id") * 3).cast("double").alias("a"), (F.col("event_id") * 3 + F.col("value") * 100).alias("b"))
    return panels.bands(e, ["user_id"], "a", "b")


Q83 = """WITH p AS (SELECT user_id, event_id * 3.0::DOUBLE AS a, event_id * 3 + value * 100 AS b FROM events WHERE value < 2), q AS (SELECT user_id, a - 1.5 * greatest(b - a, 1) - 4 AS x, b + 1.5 * greatest(b - a, 1) + 4 AS y FROM p),
f AS (SELECT *, max(y) OVER (PARTITION BY user_id ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) far FROM q), i AS (SELECT *, sum(CASE WHEN x <= far THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY x, y) k FROM f),
m AS (SELECT user_id, k, min(x) AS t, max(y) AS u FROM i GROUP BY 1, 2)
SELECT user_id, t AS top, u AS bottom, row_number() OVER (PARTITION BY user_id ORDER BY u - t DESC, t) AS "rank" FROM m QUALIFY "rank" <= 2"""


def q84_dense_band(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 1").select("user_id", "event_id", (F.col("event_id") % 900 + 300).cast("double").alias("top"), (F.col("event_id") % 900 + 300 + F.col("value")).alias("bottom"))
    return panels.dense_band(e, ["user_id"], F.lit(20.0) / (100 * (F.col("bottom") - F.col("top"))), F.lit(1300.0))


Q84 = """WITH e AS (SELECT user_id, (event_id % 900 + 300)::DOUBLE AS a, event_id % 900 + 300 + value AS b FROM events WHERE value > 1), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY 20.0::DOUBLE / (100 * (b - a)) DESC, a, b) n FROM e),
g AS (SELECT user_id, min(a) t, max(b) u FROM r WHERE n <= 4 GROUP BY 1), p AS (SELECT user_id, greatest(0, t - ((u - t) * 0.4 + 6)) t, least(1300, u + ((u - t) * 0.4 + 6)) u FROM g)
SELECT user_id, t AS top, least(u, t + 650) AS bottom FROM p WHERE least(u, t + 650) - t >= 8"""


def q85_heading(spark, sf_dir):
    e = event_lines(spark, sf_dir)
    around = F.max((F.col("event_type") == "error").cast("int"))
    from pyspark.sql import Window

    near = e.withColumn("near", around.over(Window.partitionBy("user_id").orderBy("line_no").rowsBetween(-3, 3)))
    return panels.pick_heading(near, ["user_id"], "line_no", (F.col("event_type") == "purchase") & (F.col("value") > 90), (F.col("event_type") == "view") & (F.col("near") == 1))


Q85 = (
    _LINES
    + """, n AS (SELECT *, bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) near FROM e),
g AS (SELECT user_id, min(line_no) FILTER (WHERE event_type = 'purchase' AND value > 90) s, min(line_no) FILTER (WHERE event_type = 'view' AND near) w FROM n GROUP BY 1)
SELECT user_id, coalesce(s, w) line_no, CASE WHEN s IS NULL THEN 'weak' ELSE 'strong' END AS kind FROM g WHERE s IS NOT NULL OR w IS NOT NULL"""
)


def q86_grades(spark, sf_dir):
    grade = lambda c: F.when(c < 10, "POOR").when(c < 25, "FAIR").when(c < 48, "GOOD")
    p = table(spark, sf_dir, "part")
    sharp, bright, contrast = grade(F.col("p_size")), grade(F.pmod(F.col("p_size") * 7, F.lit(50))), grade(F.pmod(F.col("p_partkey"), F.lit(50)))
    return p.groupBy(panels.vote([sharp, bright, contrast], sharp).alias("readability")).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


_GRADE = "CASE WHEN {0} < 10 THEN 'POOR' WHEN {0} < 25 THEN 'FAIR' WHEN {0} < 48 THEN 'GOOD' END"
Q86 = f"""WITH g AS (SELECT p_partkey, {_GRADE.format("p_size")} a, {_GRADE.format("(p_size * 7 % 50)")} b, {_GRADE.format("(p_partkey % 50)")} c FROM part)
SELECT CASE WHEN coalesce(a = 'POOR', false)::INT + coalesce(b = 'POOR', false)::INT + coalesce(c = 'POOR', false)::INT >= 2 OR coalesce(a = 'POOR', false) THEN 'POOR' WHEN coalesce(a IN ('POOR', 'FAIR'), false) OR coalesce(b IN ('POOR', 'FAIR'), false) OR coalesce(c IN ('POOR', 'FAIR'), false) THEN 'FAIR' ELSE 'GOOD' END readability,
 count(*) n, sum(p_partkey)::BIGINT AS keys FROM g GROUP BY 1"""

_REGION = "CASE event_type WHEN 'click' THEN 'ingredients-core' WHEN 'view' THEN 'ingredients' ELSE 'mrp' END"
_ENGINE = "CASE WHEN value < 20 THEN 'tesseract' ELSE 'rapidocr' END"


def q87_timings(spark, sf_dir):
    r = table(spark, sf_dir, "events").select("user_id", F.expr(_REGION).alias("kind"), F.expr(_ENGINE).alias("engine"), "value")
    return panels.timings(r, ["user_id"], "kind", "engine", "value")


Q87 = f"SELECT user_id, sum(CASE WHEN {_REGION} LIKE 'ingredients%' THEN value ELSE 0 END) ingredient_ms, sum(CASE WHEN {_REGION} = 'mrp' THEN value ELSE 0 END) declaration_ms, sum(CASE WHEN value < 20 THEN value ELSE 0 END) fallback_ms, sum(value) total_ms FROM events GROUP BY 1"


def q88_calls(spark, sf_dir):
    c = table(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", "ts").alias("image"), F.expr(_ENGINE).alias("provider"))
    return panels.call_accounting(c, ["user_id"], "image", "provider", 3)


Q88 = f"WITH i AS (SELECT user_id, date_trunc('hour', ts) image, count(*) n, count(*) FILTER (WHERE {_ENGINE} = 'tesseract') t FROM events GROUP BY 1, 2) SELECT user_id, sum(n)::BIGINT AS calls, sum(t)::BIGINT tesseract_calls, max(n) AS most, bool_and(n <= 3) budget_respected FROM i GROUP BY 1"


def q89_provenance(spark, sf_dir):
    tags = table(spark, sf_dir, "events").select(F.expr("user_id * 100 + hour(ts)").alias("item"), F.expr("CASE WHEN value < 1 THEN 'hybrid' WHEN value < 9 THEN 'tesseract' WHEN value < 40 THEN 'v1' ELSE 'v2' END").alias("variant"), F.expr("CASE WHEN value < 30 THEN event_type END").alias("reason"), (F.col("value") < 3).alias("uncertain"))
    return panels.provenance(tags, ["item"], "variant", "reason", "uncertain")


Q89 = """SELECT user_id * 100 + hour(ts) AS item, CASE WHEN bool_or(value < 1) OR (bool_or(value >= 1 AND value < 9) AND bool_or(value >= 9)) THEN 'hybrid' WHEN bool_or(value >= 1 AND value < 9) THEN 'tesseract' ELSE 'rapidocr' END AS source,
 bool_or(value < 3) uncertain, coalesce(string_agg(DISTINCT CASE WHEN value < 30 THEN event_type END, ',' ORDER BY CASE WHEN value < 30 THEN event_type END), '') reasons FROM events GROUP BY 1"""

_ROLE = "CASE event_type WHEN 'click' THEN 'FRONT' WHEN 'view' THEN 'BACK' WHEN 'purchase' THEN 'SIDE' ELSE 'UNKNOWN' END"


def q90_image_by_role(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.expr("user_id * 1000 + dayofyear(ts)").alias("item"), "event_id", F.expr(_ROLE).alias("role"), "value")
    return panels.first_by_role(e, ["item"], F.col("role"), ["SIDE", "BACK", "FRONT"], "event_id", F.col("value") > 15)


Q90 = f"""WITH e AS (SELECT user_id * 1000 + dayofyear(ts) AS item, event_id, {_ROLE} AS r FROM events WHERE value > 15)
SELECT item, event_id AS image, r AS role FROM e QUALIFY row_number() OVER (PARTITION BY item ORDER BY CASE r WHEN 'SIDE' THEN 1 WHEN 'BACK' THEN 2 WHEN 'FRONT' THEN 3 ELSE 4 END, event_id) = 1"""


def q91_payloads(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props", "value")
    return panels.distinct_payloads(e, ["user_id"], F.sha2(F.col("props"), 256), [F.asc("event_type"), F.desc("value"), F.asc("event_id")], 3).select("user_id", "event_id", "place")


Q91 = """WITH f AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, props ORDER BY event_type, value DESC, event_id) = 1)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type, value DESC, event_id) place FROM f QUALIFY place <= 3"""


def q92_context(spark, sf_dir):
    got = panels.context_text(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return got.select("doc_id", F.char_length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"), "left_out")


Q92 = """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(array_to_string(x[1:60], chr(10))[1:3000]) AS chars, md5(array_to_string(x[1:60], chr(10))[1:3000]) digest, greatest(0, len(x) - 60) left_out FROM l"""


def q93_table_evidence(spark, sf_dir):
    boxes = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 100).alias("cx"), F.col("value").alias("cy"), "event_type")
    rectangles = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("m")).select("user_id", F.inline(F.array(*(F.struct(F.lit(k).alias("rectangle"), (F.col("m") % 50).alias("x0"), F.lit(a).alias("y0"), (F.col("m") % 50 + 40).alias("x1"), F.lit(b).alias("y1")) for k, a, b in (("upper", 0, 12), ("lower", 12, 60))))))
    return panels.table_evidence(boxes, rectangles, ["user_id"], F.col("event_type").isin("view", "error"))


Q93 = """WITH r AS (SELECT user_id, min(event_id) % 50 m FROM events GROUP BY 1), q AS (SELECT r.*, k, a, b FROM r, (VALUES ('upper', 0, 12), ('lower', 12, 60)) v(k, a, b))
SELECT user_id, k AS rectangle, count(*) boxes, count(*) FILTER (WHERE event_type IN ('view', 'error')) AS "numeric", count(*) >= 3 AND count(*) FILTER (WHERE event_type IN ('view', 'error')) >= 0.25 * count(*) AS "table"
FROM events JOIN q USING (user_id) WHERE event_id % 100 BETWEEN m AND m + 40 AND value BETWEEN a AND b GROUP BY 1, 2"""


def q94_symbols(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    cv = F.when(F.col("p_size") < 15, "VEGETARIAN").when(F.col("p_size") < 25, "NON_VEGETARIAN").when(F.col("p_size") < 35, "UNKNOWN")
    vision = F.when(F.col("p_retailprice") < 1200, "VEGETARIAN").when(F.col("p_retailprice") < 1500, "NON_VEGETARIAN")
    return p.groupBy(panels.symbol_matrix(cv, vision, F.col("p_type") != "PROMO").alias("combined")).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


Q94 = """WITH s AS (SELECT p_partkey, p_type <> 'PROMO' ok, CASE WHEN p_size < 15 THEN 'VEGETARIAN' WHEN p_size < 25 THEN 'NON_VEGETARIAN' END cv, CASE WHEN p_retailprice < 1200 THEN 'VEGETARIAN' WHEN p_retailprice < 1500 THEN 'NON_VEGETARIAN' END v FROM part)
SELECT CASE WHEN NOT ok THEN CASE WHEN cv IS NULL THEN 'NOT_DETECTED' ELSE 'CV_ONLY' END WHEN cv = v THEN 'AI_CV_VERIFIED' WHEN cv <> v THEN 'CONFLICT_REVIEW' WHEN v IS NOT NULL THEN 'AI_EXTRACTED_REVIEW' WHEN cv IS NOT NULL THEN 'CV_ONLY' ELSE 'NOT_DETECTED' END combined, count(*) n, sum(p_partkey)::BIGINT AS keys FROM s GROUP BY 1"""


def q95_label_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_size < 20 THEN '  ' ELSE p_name END AS generic_name", "p_brand AS brand", "CASE WHEN p_size > 30 THEN p_size END AS quantity", "CASE WHEN p_size > 10 THEN p_retailprice END AS mrp", "CAST(NULL AS STRING) AS care")
    return panels.labelled_values(p, ["p_partkey"], [("Name", ["generic_name", "brand"]), ("Quantity", ["quantity"]), ("Care", ["care"]), ("Brand", ["brand"])])


Q95 = "SELECT p_partkey, 0 AS ordinal, 'Name' AS label, CASE WHEN p_size < 20 THEN p_brand ELSE p_name END AS value FROM part UNION ALL SELECT p_partkey, 1, 'Quantity', p_size::VARCHAR FROM part WHERE p_size > 30 UNION ALL SELECT p_partkey, 3, 'Brand', p_brand FROM part"


def q96_decision_summary(spark, sf_dir):
    from .rule_queries import order_findings

    return panels.decision_summary(order_findings(spark, sf_dir), ["o_orderkey"]).groupBy("summary").agg(F.count("*").alias("n"))


def _summary_sql() -> str:
    from .rule_queries import _FINDINGS

    part = lambda v, w: f"CASE WHEN count(*) FILTER (WHERE result = '{v}') > 0 THEN count(*) FILTER (WHERE result = '{v}') || ' {w}' END"
    return _FINDINGS + f", s AS (SELECT o_orderkey, concat_ws(', ', {part('FAIL', 'failed')}, {part('NEEDS_REVIEW', 'to review')}, {part('PASS', 'passed')}) AS summary FROM r GROUP BY 1) SELECT summary, count(*) n FROM s GROUP BY 1"


Q96 = _summary_sql()


def q97_namesakes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    got = panels.namesakes(p, p.withColumn("p_name", F.upper("p_name")), "p_name", "p_retailprice", "p_partkey")
    return got.groupBy("p_partkey").agg(F.count("*").alias("n"), F.max("other").alias("last"))


Q97 = "WITH t AS (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25) SELECT p.p_partkey, count(*) n, max(t.p_partkey) AS last FROM part p JOIN t ON lower(p.p_name) = lower(t.p_name) AND p.p_partkey <> t.p_partkey GROUP BY 1"


def q98_evidence_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lines = e.select("user_id", F.col("event_id").alias("line_no"), F.col("event_type").alias("text"), F.when(F.col("value") > 60, F.col("event_id")).alias("line_box"))
    hits = e.groupBy("user_id").agg(F.max(F.when(F.col("value") > 60, F.col("event_id"))).alias("m")).select("user_id", F.explode(F.array(F.struct(F.lit("click").alias("value"), F.lit(-1).cast("long").alias("box")), F.struct(F.lit("zzz").alias("value"), F.col("m").alias("box")))).alias("h")).select("user_id", "h.value", "h.box")
    return panels.evidence_line(hits.where("box is not null"), lines, ["user_id"], "value")


Q98 = """SELECT user_id, 'click' AS value, 'click' AS evidence, 'text' AS found_by FROM events WHERE event_type = 'click' GROUP BY 1 UNION ALL
SELECT user_id, 'zzz', event_type, 'box' FROM (SELECT * FROM events WHERE value > 60 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)"""


def q99_created(spark, sf_dir):
    return panels.created_events(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate", F.concat(F.lit("S-"), F.col("o_orderstatus")))


Q99 = "SELECT o_orderkey entity_id, 'CREATED' AS event, NULL::VARCHAR old_status, 'S-' || o_orderstatus new_status, o_orderdate AS at FROM orders"


def q100_text_mass(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.expr("cast(substring(source, 4) as int)").alias("column"), "text", "doc_id")
    return panels.text_mass(d, ["lang"], "column", "text", "doc_id")


Q100 = """WITH m AS (SELECT lang, try_cast(substring(source, 4) AS INT) c, sum(length(coalesce(text, '')))::BIGINT mass, min(doc_id) t FROM documents GROUP BY 1, 2), r AS (SELECT *, count(*) OVER (PARTITION BY lang) k FROM m)
SELECT lang, c AS "column", mass, k AS "columns" FROM r QUALIFY row_number() OVER (PARTITION BY lang ORDER BY mass DESC, t, c) = 1"""


def q101_insert_only(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    offered = p.select("p_name", "p_type", "p_size").unionByName(p.select(F.upper("p_name").alias("p_name"), "p_type", "p_size"))
    return panels.new_rows(p.where("p_size > 10").select("p_name", "p_type"), offered, ["p_name", "p_type"])


Q101 = "WITH o AS (SELECT p_name, p_type, p_size FROM part UNION ALL SELECT upper(p_name), p_type, p_size FROM part) SELECT p_name, p_type, min(p_size) p_size FROM o WHERE (p_name, p_type) NOT IN (SELECT (p_name, p_type) FROM part WHERE p_size > 10) GROUP BY 1, 2"


def q102_golden(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_size") != 7, F.col("p_size") < 30).alias("verified"), F.struct(F.col("p_brand").alias("brand"), F.when(F.col("p_size") > 5, F.col("p_size").cast("string")).alias("quantity")).alias("expected"), F.when(F.col("p_size") < 20, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("brand"), (F.col("p_size") + F.when(F.col("p_size") % 3 == 0, 1).otherwise(0)).cast("string").alias("quantity"))
    want = panels.golden(p, ["brand", "quantity"])
    got = p.select("product_id", F.inline(F.array(F.struct(F.lit("brand").alias("field"), F.col("brand").alias("extracted")), F.struct(F.lit("quantity").alias("field"), F.col("quantity").alias("extracted")))))
    scored = want.join(got.where("extracted <> '9'"), ["product_id", "field"], "left").select("field", F.col("value").alias("expected"), "extracted", F.col("extracted").isNull().alias("needs_review"))
    return panels.golden_summary(scored, ["field"])


Q102 = """WITH g AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN p_size + 1 ELSE p_size END q FROM part WHERE p_size < 30 AND p_size <> 7)
SELECT 'brand' AS field, count(*) n_scored, count(*) FILTER (WHERE p_size >= 20) exact_matches, count(*) normalized_matches, count(*) value_matches, 1.0::DOUBLE extraction_coverage, 0.0::DOUBLE needs_review_rate FROM g
UNION ALL SELECT 'quantity', count(*), count(*) FILTER (WHERE p_size = q AND q <> 9), count(*) FILTER (WHERE p_size = q AND q <> 9), count(*) FILTER (WHERE p_size = q AND q <> 9), count(*) FILTER (WHERE q <> 9) / count(*), count(*) FILTER (WHERE q = 9) / count(*) FROM g WHERE p_size > 5"""


def q103_set_tests(spark, sf_dir):
    """Ordered union, symmetric difference, equality as multisets, subset and intersection of the words of a text's halves."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split(F.lower("text"), " ").alias("w"))
    half = F.floor(F.size("w") / 2).cast("int")
    d = d.select("doc_id", F.slice("w", 1, half).alias("a"), F.slice("w", half + 1, F.size("w")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return d.select(
        "doc_id", F.array_join(F.array_distinct(F.concat(a, b)), " ").alias("either"), (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))).alias("apart"), (F.sort_array(a) == F.sort_array(b)).alias("permuted"),
        (F.size(F.array_except(b, a)) == 0).alias("within"), F.size(F.array_intersect(a, b)).alias("shared"),
    )


Q103 = """WITH d AS (SELECT doc_id, string_split(lower(text), ' ') w FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, len(w) // 2 h, unnest(w) v, generate_subscripts(w, 1) i FROM d),
f AS (SELECT doc_id, v, min(i) i, bool_or(i <= h) a, bool_or(i > h) b FROM u GROUP BY 1, 2), p AS (SELECT doc_id, list_sort(w[1:len(w) // 2]) = list_sort(w[len(w) // 2 + 1:]) permuted FROM d)
SELECT doc_id, string_agg(v, ' ' ORDER BY i) either, count(*) FILTER (WHERE a <> b) apart, any_value(permuted) permuted, count(*) FILTER (WHERE b AND NOT a) = 0 AS within, count(*) FILTER (WHERE a AND b) AS shared FROM f JOIN p USING (doc_id) GROUP BY doc_id"""


def q104_overview(spark, sf_dir):
    """Counters over the latest order of each customer and over their open orders."""
    o = table(spark, sf_dir, "orders")
    last = temporal.latest(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    counted = last.agg(F.count("*").alias("products_checked"), F.count_if(F.col("o_orderstatus") == "F").alias("verified_products"), F.max("o_orderdate").alias("newest"))
    return counted.crossJoin(o.agg(F.count("*").alias("complaints_raised"), F.count_if(F.col("o_orderstatus") == "O").alias("open_complaints")))


Q104 = """WITH l AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT count(*) products_checked, count(*) FILTER (WHERE o_orderstatus = 'F') verified_products, max(o_orderdate) newest, (SELECT count(*) FROM orders) complaints_raised, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') open_complaints FROM l"""


def q105_text_order(spark, sf_dir):
    """Keys in the order of text, so that 10 comes before 2; the greatest of each size as text."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("string").alias("s"))
    return p.groupBy("s").agg(F.max("k").alias("greatest"), F.min(F.struct("s", "k")).alias("m")).select("s", "greatest", F.col("m.k").alias("first"))


Q105 = "SELECT p_size::VARCHAR s, max(p_partkey::VARCHAR) AS greatest, min(p_partkey::VARCHAR) AS first FROM part GROUP BY 1"


def q106_active_versions(spark, sf_dir):
    """Versions of the rule base by status, with how many and by how many orders, twenty years on, they were in force for."""
    rows = [(a, c, b, e, s) for a, c, b, e, s in VERSIONS]
    v = spark.createDataFrame(rows, "version string, check_id string, start string, end string, status string").withColumns({c: F.col(c).cast("date") for c in ("start", "end")})
    o = table(spark, sf_dir, "orders").select(F.add_months("o_orderdate", 240).alias("day"))
    days = o.groupBy("day").agg(F.count("*").alias("orders"))
    met = temporal.as_of_join(days, v, "day", "start", "end").groupBy("version", "check_id").agg(F.sum("orders").alias("orders"))
    counted = v.join(met, ["version", "check_id"], "left")
    return counted.groupBy("status").agg(F.count("*").alias("versions"), F.count_if(F.col("orders") > 0).alias("active"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"))


Q106 = f"""WITH v AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{c}', DATE '{b}', {f"DATE '{e}'" if e else 'NULL'}, '{s}')" for a, c, b, e, s in VERSIONS)}) v(version, check_id, a, b, status)),
n AS (SELECT version, check_id, status, count(o_orderkey) n FROM v LEFT JOIN orders ON a <= o_orderdate + INTERVAL 20 YEAR AND (b IS NULL OR b > o_orderdate + INTERVAL 20 YEAR) GROUP BY 1, 2, 3)
SELECT status, count(*) AS versions, count(*) FILTER (WHERE n > 0) AS active, sum(n)::BIGINT AS orders FROM n GROUP BY 1"""


def q146_images_for_groups(spark, sf_dir):
    """Events as images of five: of each group of fields the image to look at."""
    images = table(spark, sf_dir, "events").selectExpr(
        "event_id div 5 AS item", "IF(event_id % 5 = user_id % 5, 'front', IF(event_id % 5 = 3, 'back', concat('img', event_id % 5))) AS image", "event_id AS order", "CASE user_id % 4 WHEN 0 THEN 'FRONT' WHEN 1 THEN 'BACK' WHEN 2 THEN 'SIDE' END AS role",
        "filter(array(IF(event_type = 'view', 'mrp', NULL), IF(value > 20, 'care', NULL), IF(event_type = 'error', 'nutrition', NULL), IF(value < 3, 'heading', NULL)), x -> x IS NOT NULL) AS evidence",
    )
    return panels.image_for_groups(images, ["item"])


def _group_sql() -> str:
    has = {"mrp": "event_type = 'view'", "date": "false", "fssai": "false", "care": "value > 20", "nutrition": "event_type = 'error'", "heading": "value < 3"}
    parts = []
    for name, (roles, kinds, label) in panels.GROUPS.items():
        steps = [" OR ".join(has[k] for k in ks) for ks in kinds] + [f"image = '{label}'", "true"]
        step = "CASE " + " ".join(f"WHEN {w} THEN {i}" for i, w in enumerate(steps)) + " END"
        why = "CASE " + " ".join(f"WHEN {w} THEN '{'evidence' if i < len(kinds) else 'label' if i == len(kinds) else 'upload'}'" for i, w in enumerate(steps)) + " END"
        rank = f"CASE WHEN NOT ({' OR '.join(w for w, _ in zip(steps, kinds, strict=False)) or 'false'}) THEN 0 " + " ".join(f"WHEN role = '{r}' THEN {i + 1}" for i, r in enumerate(roles)) + f" ELSE {len(roles) + 1} END"
        parts.append(f"SELECT item, '{name}' AS \"group\", image, {why} AS why FROM i QUALIFY row_number() OVER (PARTITION BY item ORDER BY {step}, {rank}, event_id) = 1")
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


Q146 = f"""WITH i AS (SELECT *, event_id // 5 AS item, CASE WHEN event_id % 5 = user_id % 5 THEN 'front' WHEN event_id % 5 = 3 THEN 'back' ELSE 'img' || (event_id % 5) END AS image, CASE user_id % 4 WHEN 0 THEN 'FRONT' WHEN 1 THEN 'BACK' WHEN 2 THEN 'SIDE' ELSE 'UNKNOWN' END AS role FROM events)
{_group_sql()}"""

QUERIES = {k: (f, globals().get(k.split("_")[0].upper())) for k, f in list(globals().items()) if k[:1] == "q" and k[1:2].isdigit() and callable(f)}
