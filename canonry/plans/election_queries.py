"""Queries of paragraphs, names, prices and quantities elected from many boxes, of regions, and of verdicts on values; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boundaries, cleaning, elections, headings, regions, validators
from .heading_queries import PLANTED, planted
from .rule_queries import table

#: Events as boxes of images of 16: four rows of four, some without a box, with words that hyphens or narrow gaps cut.
_WORDS = "CASE event_type WHEN 'error' THEN CASE WHEN value > 30 THEN 'Store in a dry place' ELSE 'wheat' END WHEN 'signup' THEN 'pro-' WHEN 'view' THEN 'tein' WHEN 'click' THEN 'palm oil,' ELSE 'salt' END"


def event_boxes(spark, sf_dir):
    boxed = "event_id % 13 <> 0"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id div 16 AS image", "event_id % 16 AS line_no", f"{_WORDS} AS text", f"IF({boxed}, (event_id % 4) * 40 + (user_id % 3) * 0.5D, NULL) AS x0", f"IF({boxed}, (event_id % 16 div 4) * 12.0D, NULL) AS y0",
        f"IF({boxed}, (event_id % 4) * 40 + 38 + (user_id % 5) * 0.5D, NULL) AS x1", f"IF({boxed}, (event_id % 16 div 4) * 12 + 10.0D, NULL) AS y1",
    )


def q130_paragraphs(spark, sf_dir):
    return elections.paragraphs(event_boxes(spark, sf_dir), ["image"])


Q130 = f"""WITH RECURSIVE e AS (SELECT event_id // 16 AS image, event_id % 16 AS line_no, {_WORDS} AS text, event_id % 13 <> 0 AS boxed, (event_id % 4) * 40 + (user_id % 3) * 0.5::DOUBLE AS x0, (event_id % 16 // 4) * 12.0::DOUBLE AS y0, (event_id % 4) * 40 + 38 + (user_id % 5) * 0.5::DOUBLE AS x1 FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY CASE WHEN boxed THEN y0 ELSE line_no END, CASE WHEN boxed THEN x0 ELSE 0 END, line_no) AS k FROM e),
r AS (SELECT image, k, 0 AS fragment, text, boxed, x0, y0, x1 FROM o WHERE k = 1 UNION ALL
 SELECT image, k, fragment + CASE WHEN j THEN 0 ELSE 1 END, CASE WHEN j THEN before || text ELSE text END, CASE WHEN j THEN b ELSE boxed END, CASE WHEN j THEN bx0 ELSE x0 END, CASE WHEN j THEN by0 ELSE y0 END, CASE WHEN j THEN bx1 ELSE x1 END
 FROM (SELECT o.*, r.fragment, r.text AS before, r.boxed AS b, r.x0 AS bx0, r.y0 AS by0, r.x1 AS bx1, r.boxed AND o.boxed AND (least(r.y0, o.y0) + 10 - greatest(r.y0, o.y0)) / 10 >= 0.5 AND o.x0 - r.x1 >= 0 AND o.x0 - r.x1 < 0.35::DOUBLE * ((r.x1 - r.x0) / length(r.text)) AS j FROM r JOIN o ON o.image = r.image AND o.k = r.k + 1)),
f AS (SELECT image, fragment, arg_max(text, k) AS text FROM r GROUP BY 1, 2), s AS (SELECT *, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS form FROM f),
b AS (SELECT *, {boundaries.first_sql(boundaries.RULES, 'text', 'form')} AS opens FROM s), n AS (SELECT *, min(CASE WHEN fragment > 0 AND opens IS NOT NULL THEN fragment END) OVER (PARTITION BY image) AS stop FROM b),
k AS (SELECT *, arg_min(opens, fragment) FILTER (WHERE fragment = stop) OVER (PARTITION BY image) AS stopped FROM n), w AS (SELECT *, coalesce(regexp_matches(lag(text) OVER y, '[-¬]$'), false) AND regexp_matches(split_part(text, ' ', 1), '^[A-Za-z]+$') AS cut FROM k WHERE stop IS NULL OR fragment < stop WINDOW y AS (PARTITION BY image ORDER BY fragment)),
v AS (SELECT *, coalesce(lead(cut) OVER (PARTITION BY image ORDER BY fragment), false) AS goes FROM w)
SELECT image, string_agg(CASE WHEN cut OR fragment = 0 THEN '' ELSE ' ' END || CASE WHEN goes THEN text[1:-2] ELSE text END, '' ORDER BY fragment) AS text, count(*)::INT AS fragments, any_value(stopped) AS stopped FROM v GROUP BY image"""

#: Parts as lines of packages of eight: names, shouts, weights and rows of tables.
_NAMES = "CASE p_partkey % 8 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, ' Biscuits') WHEN 2 THEN upper(p_type) WHEN 3 THEN concat('Net weight ', p_size, ' g') WHEN 4 THEN p_brand WHEN 6 THEN 'Energy' ELSE 'Golden Rusk' END"
_IMAGE = "CASE p_partkey % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'back' ELSE 'side' END"
_SKIP = r"net\s*wt|best\s*before"


def q131_names(spark, sf_dir):
    lines = table(spark, sf_dir, "part").selectExpr("p_partkey div 8 AS package", f"{_IMAGE} AS image", "p_partkey AS line_no", f"{_NAMES} AS text", "p_size / 50.0D AS confidence", "IF(p_size % 7 = 0, NULL, p_size * 10.0D) AS area")
    return elections.elected_names(lines, ["package"], _SKIP)


_VETOED = f"(list_contains([{', '.join(f"'{v}'" for v in elections.VETO)}], bare) OR regexp_matches(bare, '{'|'.join(elections.VETO_PARTS)}'))"
_ASIDE = ", ".join(f"'{v}'" for v in elections.VETO_ASIDE)
_CATEGORIES = sorted(elections.CATEGORIES, key=lambda w: (-len(w), w))
Q131 = f"""WITH l AS (SELECT p_partkey // 8 AS package, {_IMAGE} AS image, p_partkey AS line_no, {_NAMES} AS v, p_size / 50.0::DOUBLE AS confidence, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size * 10.0::DOUBLE END AS area FROM part),
c AS (SELECT *, regexp_replace(array_to_string(list_filter(regexp_extract_all(lower(v), '[a-z0-9%/.]+'), lambda t: NOT list_contains([{_ASIDE}], t) AND NOT regexp_matches(t, '^[0-9]+([.][0-9]+)?(g|kg|mg|ml|l|%)?$')), ''), '[^a-z]', '', 'g') AS bare, regexp_replace(lower(v), '[^a-z0-9]', '', 'g') AS key FROM l),
o AS (SELECT * FROM c WHERE length(v) >= 3 AND NOT {_VETOED} AND NOT regexp_matches(v, '(?i){_SKIP}')), s AS (SELECT package, key, count(DISTINCT image) - 1 AS n FROM o GROUP BY 1, 2),
m AS (SELECT o.*, n, max(area) OVER (PARTITION BY package, image) AS most, len(regexp_extract_all(v, '[^ ]+')) AS words, v = upper(v) AS caps FROM o JOIN s USING (package, key)),
p AS (SELECT *, round(CASE WHEN area > 0 THEN least(1.0, area / most) ELSE 0.5 END + CASE WHEN image = 'front' THEN 0.3 ELSE 0 END + least(0.4::DOUBLE, 0.2::DOUBLE * n) + 0.2::DOUBLE * least(1.0, confidence) + CASE WHEN caps AND words <= 6 THEN 0.1 WHEN regexp_matches(v, '^[A-Z]') THEN 0.1 ELSE 0 END
 - CASE WHEN regexp_matches(v, '[0-9]') THEN 0.3 ELSE 0 END - CASE WHEN words = 1 AND caps THEN 0.5 ELSE 0 END - CASE WHEN regexp_matches(key, '{'|'.join(elections.FOREIGN)}') THEN 0.6 ELSE 0 END, 3) AS score FROM m),
q AS (SELECT *, score >= CASE WHEN area > 0 THEN 1.0 ELSE 0.3 END AS wins, caps AND words BETWEEN 1 AND 4 AND NOT regexp_matches(v, '[0-9]') AS branded FROM p),
g AS (SELECT package, first(v ORDER BY score DESC, line_no) FILTER (WHERE wins) AS product, max(score) FILTER (WHERE wins) AS score, first(v ORDER BY image = 'front' DESC, coalesce(area, 0) DESC, line_no) FILTER (WHERE branded) AS b, string_agg(lower(v), ' ') AS low FROM q GROUP BY 1)
SELECT package, product, CASE WHEN b <> product THEN b END AS brand, CASE {" ".join(rf"WHEN regexp_matches(low, '\b{w}\b') THEN '{w.capitalize()}'" for w in _CATEGORIES)} END AS generic, score FROM g WHERE product IS NOT NULL"""

#: Parts as lines of packages of six, in two columns: prices, amounts and what only looks like them.
_LABEL = """CASE (p_partkey * 7 + p_size) % 13 WHEN 0 THEN concat('MRP Rs. ', p_size) WHEN 1 THEN 'M.R.P.' WHEN 2 THEN concat('Rs. ', p_size, '/-') WHEN 3 THEN concat('MRF Rs ', p_size) WHEN 4 THEN 'Rs. 05/2024' WHEN 5 THEN 'MRP 1010005' WHEN 6 THEN 'incl. of all taxes'
 WHEN 7 THEN concat('₹ 1,', lpad(CAST(p_size AS {s}), 3, '0'), '.50') WHEN 8 THEN 'Net Wt' WHEN 9 THEN concat(p_size, ' g') WHEN 10 THEN concat('Pack of ', p_size, ' pcs') WHEN 11 THEN concat('NETWT ', p_size, ' 9') ELSE concat('Rs. ', p_size, ' kg') END"""


def label_boxes(spark, sf_dir):
    boxed = "p_size % 5 <> 0"
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey div 6 AS package", "p_partkey AS line_no", f"{_LABEL.format(s='STRING')} AS text", "p_size / 50.0D AS confidence", f"IF({boxed}, p_partkey % 2 * 70.0D, NULL) AS x0", f"IF({boxed}, (p_partkey % 6 div 2) * 25.0D, NULL) AS y0",
        f"IF({boxed}, p_partkey % 2 * 70 + 60.0D, NULL) AS x1", f"IF({boxed}, (p_partkey % 6 div 2) * 25 + 10.0D, NULL) AS y1",
    )


_BOXES = f"""WITH l AS (SELECT p_partkey // 6 AS package, p_partkey AS line_no, {_LABEL.format(s='VARCHAR')} AS t, p_size / 50.0::DOUBLE AS c, p_size % 5 <> 0 AS boxed, p_partkey % 2 * 70.0::DOUBLE AS x, (p_partkey % 6 // 2) * 25.0::DOUBLE AS y FROM part),
z AS (SELECT a.package, a.line_no, b.line_no AS o, b.t, a.c AS ac, b.c AS bc, row_number() OVER (PARTITION BY a.line_no ORDER BY abs(a.x - b.x) + abs(a.y - b.y), b.line_no) AS k, a.t AS anchored FROM l a JOIN l b ON a.package = b.package AND a.line_no <> b.line_no AND a.boxed AND b.boxed AND abs(a.x - b.x) + abs(a.y - b.y) <= 60)"""


def q132_prices(spark, sf_dir):
    return elections.elected(elections.price_candidates(label_boxes(spark, sf_dir), ["package"]), ["package"], ["value"])


def _found(text: str, patterns: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN [regexp_extract({text}, '{p}', 1), regexp_extract({text}, '{p}', 2)]" for p in patterns) + " END"


_CONTEXT, _EVERY = f"(?i)(?:{elections.PRICE_CONTEXT})", [elections.WORDED, *elections.BARE]
_MONEY = lambda t: f"CASE WHEN regexp_matches({t}, '(?i)(?:{elections.CURRENCY})') THEN 2.0 ELSE 0 END"
_ELECTED = "o AS (SELECT *, row_number() OVER (PARTITION BY package, {v} ORDER BY score DESC, line_no, source DESC) AS k FROM {t}), e AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY score DESC, line_no, {v}) AS place, lead(score) OVER (PARTITION BY package ORDER BY score DESC, line_no, {v}) AS other, count(*) OVER (PARTITION BY package) - 1 AS rivals FROM o WHERE k = 1)\nSELECT package, {v}, source, round(score, 6) AS score, line_no, rivals::INT AS rivals, coalesce(score - other < 0.5::DOUBLE, false) AS review FROM e WHERE place = 1"
Q132 = f"""{_BOXES}, s AS (SELECT *, t || coalesce(' ' || n, '') AS tn, regexp_matches(t, '{_CONTEXT}') AS lead FROM (SELECT *, lead(t) OVER y AS n, lead(c) OVER y AS nc FROM l WINDOW y AS (PARTITION BY package ORDER BY line_no))),
h AS (SELECT package, 'same line' AS source, line_no, {_found('t', _EVERY)} AS hit, 9.0::DOUBLE + {_MONEY('t')} + c AS score, true AS worded FROM s WHERE lead UNION ALL SELECT package, 'damaged word', line_no, {_found('t', [elections.DAMAGED])}, 8.0::DOUBLE + c, true FROM s WHERE lead AND ({_found('t', _EVERY)}) IS NULL
 UNION ALL SELECT package, 'next line', line_no, {_found('tn', _EVERY)}, 7.0::DOUBLE + {_MONEY('tn')} + (c + nc) / 2, true FROM s WHERE lead AND n IS NOT NULL UNION ALL SELECT package, 'near box', o, {_found('t', elections.BARE)}, 6.0::DOUBLE + (ac + bc) / 2, true FROM z WHERE k <= 6 AND regexp_matches(anchored, '{_CONTEXT}')
 UNION ALL SELECT package, 'bare', line_no, {_found('t', elections.BARE)}, 2.0::DOUBLE + c, false FROM s WHERE NOT lead),
v AS (SELECT package, source, line_no, replace(hit[1], ',', '') AS value, hit[2] AS tail, score, worded FROM h WHERE hit IS NOT NULL),
p AS (SELECT * FROM v WHERE regexp_matches(split_part(value, '.', 1), '^[0-9]{{1,5}}$') AND TRY_CAST(value AS DOUBLE) > 0 AND NOT regexp_matches(tail, '{elections.DATE_TAIL}') AND (worded OR NOT regexp_matches(tail, '{elections.WEIGHT_TAIL}'))), """ + _ELECTED.format(v="value", t="p")


def q133_quantities(spark, sf_dir):
    return elections.elected(elections.quantity_candidates(label_boxes(spark, sf_dir), ["package"]), ["package"], ["value", "unit"])


_AMOUNTS = lambda t, p: f"unnest(list_zip(regexp_extract_all({t}, '{p}', 1), regexp_extract_all({t}, '{p}', 2)))"
Q133 = f"""{_BOXES}, s AS (SELECT *, regexp_matches(t, '{elections.NET}') AS net, row_number() OVER (PARTITION BY package ORDER BY line_no) AS place FROM l),
b AS (SELECT o.package, o.line_no, o.t, (o.c + a.c) / 2 AS c, CASE WHEN abs(o.place - a.place) = 1 THEN 2.0 ELSE 1.0 END + CASE WHEN o.boxed AND a.boxed THEN 1.0 ELSE 0 END AS anchor FROM s a JOIN s o ON a.package = o.package AND a.net AND abs(o.place - a.place) IN (1, 2) AND (NOT (o.boxed AND a.boxed) OR greatest(0, abs(o.y - a.y) - 10) <= 30)),
h AS (SELECT package, 'own line' AS source, line_no, t, c, CASE WHEN net OR regexp_matches(t, '{elections.NET_LOOSE}') THEN 3.0 ELSE 0.0 END AS anchor, {_AMOUNTS('t', elections.AMOUNT)} AS m FROM s UNION ALL SELECT package, 'digit for a unit', line_no, t, c, 2.5, {_AMOUNTS('t', elections.DIGIT_UNIT)} FROM s WHERE net
 UNION ALL SELECT package, 'line beside', line_no, t, c, anchor, {_AMOUNTS('t', elections.AMOUNT)} FROM b UNION ALL SELECT package, 'anywhere', line_no, t, c, 0.5, {_AMOUNTS('t', elections.AMOUNT)} FROM s WHERE package IN (SELECT package FROM s WHERE net)
 UNION ALL SELECT z.package, 'near box', z.o, z.t, (ac + bc) / 2, 1.5, {_AMOUNTS('z.t', elections.AMOUNT)} FROM z JOIN s a ON a.line_no = z.line_no AND a.net JOIN s o ON o.line_no = z.o WHERE k <= 6 AND abs(o.place - a.place) > 2),
u AS (SELECT package, source, line_no, t, c, anchor, replace(m[1], ',', '') AS value, CASE WHEN source = 'digit for a unit' THEN 'g' WHEN lower(m[2]) IN ('kg', 'g') THEN lower(m[2]) ELSE 'pcs' END AS unit FROM h),
p AS (SELECT *, anchor * 2 + c AS score FROM u WHERE value::DOUBLE * CASE WHEN unit = 'kg' THEN 1000.0 ELSE 1.0 END BETWEEN 0.01 AND 100000 AND NOT (value::DOUBLE IN (1, 2) AND anchor < 2) AND NOT (regexp_matches(t, '{elections.COUNTS}') AND anchor < 3)), """ + _ELECTED.format(v="value, unit", t="p")

#: Events as boxes of images of five, some without a box; what an image has resolved goes by its number.
_LOOK = "CASE event_id % 11 WHEN 0 THEN 'Ingredients:' WHEN 1 THEN 'M.R.P.' WHEN 2 THEN 'Mfd by Acme' WHEN 3 THEN 'Lic No 1' WHEN 4 THEN 'Customer care' WHEN 5 THEN '10012043001234' WHEN 6 THEN 'Store in a dry place' WHEN 7 THEN 'Net Wt 7 g, Batch No 2' ELSE 'wheat flour' END"


def look_boxes(spark, sf_dir):
    boxed = "event_id % 7 <> 0"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id div 5 AS image", "event_id % 5 AS line_no", f"{_LOOK} AS text", f"IF({boxed}, value % 100, NULL) AS x0", f"IF({boxed}, (event_id % 5) * 30.0D, NULL) AS y0", f"IF({boxed}, value % 100 + 90, NULL) AS x1", f"IF({boxed}, (event_id % 5) * 30 + 8.0D + user_id % 5, NULL) AS y1",
    )


_LOOKS = f"WITH l AS (SELECT event_id // 5 AS image, event_id % 5 AS line_no, {_LOOK} AS t, value % 100 AS x0, (event_id % 5) * 30.0::DOUBLE AS y0, value % 100 + 90 AS x1, (event_id % 5) * 30 + 8.0::DOUBLE + user_id % 5 AS y1 FROM events WHERE event_id % 7 <> 0)"
_CUT = lambda a, b, c, d: f"greatest(0, least({a}, 200)) AS x0, greatest(0, least({b}, 160)) AS y0, greatest(0, least({c}, 200)) AS x1, greatest(0, least({d}, 160)) AS y1"


def q136_regions(spark, sf_dir):
    return regions.anchored(look_boxes(spark, sf_dir), ["image"], F.lit(200.0), F.lit(160.0)).select("image", "region", "line_no", "x0", "y0", "x1", "y1")


_GROWN = " UNION ALL ".join(
    [f"SELECT image, '{name}' AS region, line_no, x0 - h * {x} AS a, y0 - h * {y}::DOUBLE - {m} AS b, x1 + h * {x} AS c, y1 + h * {y}::DOUBLE + {m} AS d FROM g WHERE regexp_matches(t, '(?i)(?:{p.replace(chr(39), chr(39) * 2)})')" for name, (p, x, y, m) in regions.ANCHORS.items()]
    + [f"SELECT image, 'MANUFACTURER', line_no, x0 - h * 4, y0, x1 + h * 4, y1 + h * 4 FROM g WHERE regexp_matches(t, '(?i)(?:{regions.MAKER})')", f"SELECT image, 'INGREDIENTS', line_no, 0, y1, 200, y1 + 0.45::DOUBLE * 160 FROM g WHERE regexp_matches(t, '(?i)(?:{headings.BARE}|{headings.COLON})')"]
)
Q136 = f"{_LOOKS}, g AS (SELECT *, greatest(y1 - y0, 1) AS h FROM l), r AS ({_GROWN}) SELECT image, region, line_no, {_CUT('a', 'b', 'c', 'd')} FROM r QUALIFY row_number() OVER (PARTITION BY image, region ORDER BY line_no) = 1"


def q137_proposals(spark, sf_dir):
    """At most three looks an image: what stands unresolved, in order; one in three images is a front."""
    resolved = F.filter(F.array(*(F.when(F.col("image") % k == 0, F.lit(f)) for f, k in (("mrp", 2), ("manufacturing_date", 3), ("fssai_license", 5), ("consumer_care", 4)))), lambda x: x.isNotNull())
    return regions.proposals(look_boxes(spark, sf_dir), ["image"], F.col("text").startswith("Ingredients"), F.col("image") % 3 == 0, resolved, F.lit(200.0), F.lit(160.0))


def _around(kind: str, place: int, pattern: str, every: str, k: float, more: float, side: float, below: float, field: int) -> str:
    pad = f"((y1 - y0) * {k}::DOUBLE + {more})"
    return f"SELECT image, '{kind}' AS kind, {place} AS k, {_CUT(f'x0 - {pad} * {side}', f'y0 - {pad}', f'x1 + {pad} * {side}', f'y1 + {pad} * {below}')} FROM l WHERE image % {field} <> 0 AND {every} QUALIFY row_number() OVER (PARTITION BY image ORDER BY {pattern}, line_no) = 1"


_IS = lambda p: f"regexp_matches(t, '(?i)(?:{p})')"
_DIGITS = "length(regexp_replace(t, '[^0-9]', '', 'g')) = 14"
Q137 = f"""{_LOOKS}, f AS (SELECT *, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS form FROM l), hd AS (SELECT image, min(line_no) AS n, arg_min(y1, line_no) AS y FROM l WHERE t LIKE 'Ingredients%' GROUP BY 1),
st AS (SELECT image, arg_min(y0, line_no) AS stop FROM f JOIN hd USING (image) WHERE ({boundaries.first_sql(boundaries.RULES, "t", "form")}) IS NOT NULL AND line_no > n AND line_no <= n + 7 AND y0 > y GROUP BY 1),
dr AS (SELECT image, y0, y1, row_number() OVER (PARTITION BY image ORDER BY length(t) / greatest(1, y1 - y0) DESC, y0, y1) AS r FROM l), d0 AS (SELECT image, min(y0) AS a, max(y1) AS b FROM dr WHERE r <= 4 GROUP BY 1),
d1 AS (SELECT image, greatest(0, a - ((b - a) * 0.4::DOUBLE + 6)) AS top, least(160, b + (b - a) * 0.4::DOUBLE + 6) AS bottom FROM d0), d2 AS (SELECT image, top, least(bottom, top + 80) AS bottom FROM d1 WHERE least(bottom, top + 80) - top >= 8),
m AS ({_around("mrp", 1, "1", _IS(validators.PRICE), 1.2, 4, 3, 1, 2)}),
p AS (SELECT image, 'ingredients' AS kind, 0 AS k, {_CUT("0", "y", "200", "least(coalesce(stop, 160), y + 0.3::DOUBLE * 160)")} FROM hd LEFT JOIN st USING (image) UNION ALL SELECT * FROM m UNION ALL SELECT DISTINCT image, 'mrp', 1, 0, 88, 200, 160 FROM l WHERE image % 2 <> 0 AND image % 3 <> 0 AND image NOT IN (SELECT image FROM m)
 UNION ALL SELECT * FROM ({_around("mfg_date", 2, "1", _IS(boundaries.MADE_ON), 1.2, 4, 3, 1, 3)}) UNION ALL SELECT * FROM ({_around("fssai", 3, f"NOT {_IS(validators.LICENCE)}", f"({_IS(validators.LICENCE)} OR {_DIGITS})", 1.2, 4, 3, 1, 5)}) UNION ALL SELECT * FROM ({_around("care", 4, "1", _IS(boundaries.CARE), 1.5, 6, 4, 2, 4)})
 UNION ALL SELECT image, 'ingredients-scan', 5, {_CUT("0", "top", "200", "bottom")} FROM d2 WHERE image % 3 <> 0 AND image NOT IN (SELECT image FROM hd)),
o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY k) - 1 AS place FROM p) SELECT image, place::INT AS place, kind, x0, y0, x1, y1 FROM o WHERE place < 3"""


def q138_objections(spark, sf_dir):
    """Why amounts read from labels can't stand as prices, quantities or batches beside the line they come from."""
    lines = label_boxes(spark, sf_dir).select("line_no", "text", F.regexp_extract("text", r"[0-9][0-9,.]*", 0).alias("value"), F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(u).alias("unit")) for f, u in (("mrp", ""), ("quantity", "g"), ("batch_lot", ""))))))
    return lines.select("line_no", "field", validators.objection(F.col("field"), F.col("value"), F.col("unit"), F.col("text")).alias("objection"))


_NUM = "TRY_CAST(replace(v, ',', '') AS DOUBLE)"
_Q = lambda p: p.replace("'", "''")
Q138 = f"""WITH l AS (SELECT p_partkey AS line_no, {_LABEL.format(s='VARCHAR')} AS t FROM part), v AS (SELECT *, regexp_extract(t, '[0-9][0-9,.]*') AS v FROM l), n AS (SELECT *, {_NUM} AS x, regexp_replace(v, '[^0-9]', '', 'g') AS d, regexp_matches(t || ' ' || v || ' g', '(?i)(?:{_Q(validators.NET)})') AS net FROM v)
SELECT line_no, 'mrp' AS field, CASE WHEN v = '' THEN 'blank' WHEN x IS NULL THEN 'not numeric' WHEN x <= 0 THEN 'not positive' WHEN length(split_part(replace(v, ',', ''), '.', 1)) > 5 THEN 'too many digits' WHEN length(d) >= 10 THEN 'as long as a phone' WHEN NOT regexp_matches(t, '(?i)(?:{_Q(validators.PRICE)})') THEN 'no price context' END AS objection FROM n
UNION ALL SELECT line_no, 'quantity', CASE WHEN v = '' THEN 'blank' WHEN x IS NULL THEN 'not numeric' WHEN x <= 0 THEN 'not positive' WHEN x IN (1, 2) AND NOT net THEN 'a small count' WHEN regexp_matches(t || ' ' || v || ' g', '(?i)(?:{_Q(validators.COUNTS)})') AND NOT net THEN 'a count of servings or packs' WHEN NOT net THEN 'no net context'
 WHEN regexp_matches(t, '(?i)(?:{_Q(validators.FOREIGN)})') AND NOT regexp_matches(t, '(?i)(?:{_Q(validators.NET)})') THEN 'another section' END FROM n
UNION ALL SELECT line_no, 'batch_lot', CASE WHEN v = '' THEN 'blank' WHEN length(d) = 14 THEN 'as long as a licence' WHEN length(d) >= 10 THEN 'as long as a phone' WHEN NOT regexp_matches(t, '(?i)(?:{_Q(validators.BATCH)})') THEN 'no batch context' WHEN NOT regexp_matches(v, '^[A-Za-z0-9/-]{{2,20}}$') THEN 'no batch shape' END FROM n"""


def q139_second_looks(spark, sf_dir):
    """Documents whose text, taken as a reading of ingredients, asks for another engine, by reason."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    reasons = validators.second_look(F.col("text"), F.when(F.col("lang") == "en", 0.9).when(F.col("lang") == "de", 0.7).otherwise(0.5), F.col("n_chars") / 20.0, F.lit(None).cast("array<string>"))
    return d.select("doc_id", F.array_join(reasons, ",").alias("reasons"))


Q139 = r"""WITH d AS (SELECT *, trim(text) AS t FROM documents WHERE text IS NOT NULL), m AS (SELECT *, regexp_replace(regexp_replace(t, '[0-9]\s*%', '', 'g'), '[0-9]\s*&\s*[0-9]', '', 'g') AS s FROM d)
SELECT doc_id, concat_ws(',', CASE WHEN lang NOT IN ('en', 'de') THEN 'incoherent' END, CASE WHEN n_chars / 20.0 >= 3 AND length(t) < 40 THEN 'short' END, CASE WHEN regexp_matches(s, '[@#$^*_~`|\\&¬]') THEN 'odd characters' END,
 CASE WHEN len(regexp_extract_all(t, '\bINS\b')) > len(regexp_extract_all(t, '\bINS\b\s*[0-9]{1,4}\b')) OR regexp_matches(t, '(^|[^0-9A-Za-z_\p{L}\p{M}\p{N}])(E\s*[A-Za-z]+|E[0-9]{1,2}|E[0-9]{5,})($|[^0-9A-Za-z_\p{L}\p{M}\p{N}])') THEN 'malformed additives' END) AS reasons FROM m"""


def q140_report_labels(spark, sf_dir):
    """Orders as inspections: how the report names each, and its findings of the package and of the listing by result, the critical ones apart."""
    o = table(spark, sf_dir, "orders")
    label = validators.context_label(F.when(F.col("o_orderstatus") == "F", "package_only").when(F.col("o_totalprice") > 300_000, "online_listing"), F.when(F.col("o_orderpriority") == "1-URGENT", "PACKAGE_AND_ONLINE_LISTING"), F.when(F.col("o_orderpriority") == "5-LOW", "MARKET_SURVEY"))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linenumber") > 5, "online").otherwise("package").alias("part"), F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "A", "NEEDS_REVIEW").otherwise("PASS").alias("result"))
    return found.join(o.select("o_orderkey", label.alias("label")), "o_orderkey").groupBy("label", "part", "result").agg(F.count("*").alias("n"), F.count_if((F.col("part") == "package") & F.col("result").isin("FAIL", "NEEDS_REVIEW")).alias("critical"))


Q140 = """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Physical Package Inspection' WHEN o_totalprice > 300000 THEN 'Online Listing Inspection' WHEN o_orderpriority = '1-URGENT' THEN 'Physical Package + Online Listing Inspection' WHEN o_orderpriority = '5-LOW' THEN 'Market Survey' ELSE 'Physical Package Inspection' END AS label FROM orders),
f AS (SELECT l_orderkey, CASE WHEN l_linenumber > 5 THEN 'online' ELSE 'package' END AS part, CASE l_returnflag WHEN 'R' THEN 'FAIL' WHEN 'A' THEN 'NEEDS_REVIEW' ELSE 'PASS' END AS result FROM lineitem)
SELECT label, part, result, count(*) AS n, count(*) FILTER (WHERE part = 'package' AND result <> 'PASS') AS critical FROM f JOIN o ON o_orderkey = l_orderkey GROUP BY 1, 2, 3"""

#: Parts as lines of packages of six: words that lead to dates, contacts and batches, clean or damaged, and values alone.
_WORDED = """CASE (p_partkey * 5 + p_size) % 14 WHEN 0 THEN concat('Mfd: 0', p_size % 9 + 1, '/2024') WHEN 1 THEN 'MFO' WHEN 2 THEN concat('12/0', p_size % 9 + 1, '/2024') WHEN 3 THEN concat('Best before ', p_size, ' months') WHEN 4 THEN 'Use by' WHEN 5 THEN concat('Customer care 98765432', lpad(CAST(p_size AS {s}), 2, '0'))
 WHEN 6 THEN 'He1pline' WHEN 7 THEN concat('l8OO-103-', 1000 + p_size) WHEN 8 THEN concat('Batch No: AB', p_size) WHEN 9 THEN 'Lot' WHEN 10 THEN concat('B', p_size, '/7') WHEN 11 THEN concat(p_size, ' months') WHEN 12 THEN 'Mfd 99' ELSE 'plain words' END"""


def q143_worded_fields(spark, sf_dir):
    """Dates, contacts and batches of packages, the best of each field."""
    lines = label_boxes(spark, sf_dir).drop("text").join(table(spark, sf_dir, "part").selectExpr("p_partkey AS line_no", f"{_WORDED.format(s='STRING')} AS text"), "line_no")
    got = elections.elected(elections.worded_candidates(lines, ["package"]), ["package", "field"], ["value"])
    return got.select("package", "field", "value", "source", "score", "line_no")


def _worded_sql() -> str:
    parts = []
    for field, (clean, damaged, beside, alone) in elections.WORDED_FIELDS.items():
        leads, word = f"regexp_matches(t, '(?i)(?:{clean}|{damaged})')", f"CASE WHEN regexp_matches(t, '(?i)(?:{clean})') THEN 0.0 ELSE 0.5 END"
        own, hit = f"nullif(regexp_extract(t, '(?i){beside}', 1), '')", lambda c: f"nullif(regexp_extract({c}, '(?i){alone}', 1), '')"  # noqa: B023
        parts.append(f"SELECT package, '{field}' AS field, {own} AS value, 'own line' AS source, 3.0::DOUBLE - {word} + c AS score, line_no FROM s WHERE {leads}")
        parts.append(f"SELECT package, '{field}', {hit('n')}, 'next line', 2.0::DOUBLE - {word} + (c + coalesce(nc, 0)) / 2, line_no FROM s WHERE {leads} AND {own} IS NULL")
        parts.append(f"SELECT package, '{field}', {hit('b')}, 'near box', 1.0::DOUBLE - {word} + (ac + bc) / 2, o FROM (SELECT package, at0 AS t, t AS b, ac, bc, o FROM z WHERE k <= 6) WHERE {leads} AND {own} IS NULL")
    return " UNION ALL ".join(parts)


_WORDED_BOXES = _BOXES.replace(_LABEL.format(s="VARCHAR"), _WORDED.format(s="VARCHAR")).replace("a.t AS anchored", "a.t AS at0")
Q143 = f"""{_WORDED_BOXES}, s AS (SELECT *, lead(t) OVER y AS n, lead(c) OVER y AS nc FROM l WINDOW y AS (PARTITION BY package ORDER BY line_no)), h AS ({_worded_sql()}),
p AS (SELECT package, field, CASE WHEN field = 'consumer_care' THEN translate(regexp_replace(value, '[\\s-]', '', 'g'), 'lIBOo', '11800') ELSE trim(value) END AS value, source, score, line_no FROM h WHERE value IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY package, field, value ORDER BY score DESC, line_no, source DESC) AS k FROM p), e AS (SELECT *, row_number() OVER (PARTITION BY package, field ORDER BY score DESC, line_no, value) AS place FROM o WHERE k = 1)
SELECT package, field, value, source, round(score, 6) AS score, line_no FROM e WHERE place = 1"""


def q144_cleaned_lists(spark, sf_dir):
    """Whole documents, as lists of ingredients, without what is none: copies of lines, domains, runs of digits."""
    got = cleaning.cleaned(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return got.select("doc_id", F.char_length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


Q144 = rf"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, generate_subscripts(x, 1) AS n, trim(unnest(x)) AS line FROM d),
f AS (SELECT * FROM l WHERE line <> '' AND NOT regexp_matches(replace(line, ' ', ''), '{cleaning.BARCODE_LINE}') QUALIFY row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(line, '\s+', ' ', 'g')) ORDER BY n) = 1),
c AS (SELECT doc_id, n, trim(regexp_replace(regexp_replace(regexp_replace(line, '{cleaning.DOMAIN}', '', 'g'), '{cleaning.DIGIT_RUN}', '', 'g'), '\s+', ' ', 'g'), ' ,;') AS line FROM f)
SELECT doc_id, length(t)::INT AS chars, md5(t) AS digest FROM (SELECT doc_id, string_agg(line, ' ' ORDER BY n) AS t FROM c WHERE line <> '' GROUP BY 1)"""


def q145_field_status(spark, sf_dir):
    """The status of fields over planted lines of documents: of prices, licences and contacts what was read, of the others their context."""
    lines = planted(spark, sf_dir).withColumn("line_no", F.col("line_no").cast("long"))
    read = lambda f, p: F.when(F.col("text").rlike(p), F.struct(F.lit(f).alias("field"), F.regexp_extract("text", p, 1).alias("value")))
    values = lines.select("doc_id", "line_no", F.col("text").alias("line"), F.inline(F.filter(F.array(read("mrp", r"Rs ([0-9]+)"), read("fssai_license", r"FSSAI ([0-9]{14})"), read("quantity", r"wt ([0-9]+) g")), lambda x: x.isNotNull())))
    first = values.groupBy("doc_id", "field").agg(F.min_by(F.struct("value", "line_no", "line"), "line_no").alias("b")).select("doc_id", "field", "b.*").withColumn("confidence", F.when(F.col("line_no") % 3 == 0, 0.55).otherwise(0.9))
    return cleaning.field_status(first, lines, ["doc_id"]).select("doc_id", "field", "anchored", "fused", "status")


_SHOWN = ", ".join(f"bool_or(regexp_matches(t, '(?i)(?:{p})')) AS {f}" for f, p in cleaning.CONTEXTS.items())
_PAIRS = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {f} AS anchored FROM w" for f in cleaning.CONTEXTS)
_ALIEN = lambda f: "|".join(m for m in cleaning.FOREIGN if m not in cleaning.OWN.get(f, "").split())
Q145 = rf"""{PLANTED}, w AS (SELECT doc_id, {_SHOWN} FROM p GROUP BY 1), a AS ({_PAIRS}),
v AS (SELECT doc_id, 'mrp' AS field, line_no, regexp_extract(t, 'Rs ([0-9]+)', 1) AS v, regexp_matches(form, '{_ALIEN("mrp")}') AS alien FROM f WHERE regexp_matches(t, 'Rs [0-9]+') UNION ALL SELECT doc_id, 'fssai_license', line_no, regexp_extract(t, 'FSSAI ([0-9]{{14}})', 1), regexp_matches(form, '{_ALIEN("fssai_license")}') FROM f WHERE regexp_matches(t, 'FSSAI [0-9]{{14}}')
 UNION ALL SELECT doc_id, 'quantity', line_no, regexp_extract(t, 'wt ([0-9]+) g', 1), regexp_matches(form, '{_ALIEN("quantity")}') FROM f WHERE regexp_matches(t, 'wt [0-9]+ g')),
o AS (SELECT *, CASE WHEN line_no % 3 = 0 THEN 0.55 ELSE 0.9 END::DOUBLE AS c FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY line_no) = 1),
j AS (SELECT a.*, v, c, round(c * CASE WHEN anchored THEN 1.0 ELSE 0.7 END::DOUBLE * CASE WHEN alien THEN 0.5 ELSE 1.0 END::DOUBLE, 3) AS fused FROM a LEFT JOIN o USING (doc_id, field))
SELECT doc_id, field, anchored, fused, CASE WHEN v IS NULL THEN CASE WHEN anchored THEN 'NEEDS_REVIEW' ELSE 'NOT_DETECTED' END WHEN c >= 0.6 AND fused >= 0.6 AND v::BIGINT > 0 THEN 'DETECTED' ELSE 'NEEDS_REVIEW' END AS status FROM j"""

QUERIES = {k: (f, globals().get(k.split("_")[0].upper())) for k, f in list(globals().items()) if k[:1] == "q" and k[1:2].isdigit() and callable(f)}
