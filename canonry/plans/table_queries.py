"""Queries of relational capabilities over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import fuzzy, lifecycle, reconcile, scoring, tables, temporal
from .rule_queries import table


def q20b_queue(spark, sf_dir, status="F", region=None, segment="BUILDING"):
    """Four inner joins, one left join with a literal in its condition, optional filters."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    weights = spark.sql("SELECT * FROM VALUES ('P1', '1-URGENT', 'HIGH'), ('P1', '2-HIGH', 'MEDIUM'), ('P2', '5-LOW', 'LOW') AS w(policy, o_orderpriority, severity)").where("policy = 'P1'")
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"))
    q = o.join(li, "o_orderkey").join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).join(F.broadcast(weights), "o_orderpriority", "left")
    q = tables.filtered(q, o_orderstatus=status, r_name=region, c_mktsegment=segment)
    return q.select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("severity", F.lit("MEDIUM")).alias("severity"), F.col("quantity").cast("double").alias("quantity"))


Q20B = """SELECT o_orderkey, c_name, n_name, r_name, CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' ELSE 'MEDIUM' END severity, quantity FROM orders
JOIN (SELECT l_orderkey, sum(l_quantity::DECIMAL(18,2))::DOUBLE quantity FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'"""


def q21_dashboard(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    days = F.datediff("l_shipdate", "o_orderdate")
    late = F.count_if(days > 30)
    return j.groupBy("o_orderpriority").agg(
        F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"), late.alias("late"),
        F.avg(F.when(F.col("l_returnflag") == "R", days)).alias("mean_days_returned"), scoring.ratio(F.count_if((F.col("l_returnflag") == "R")), F.count_if(F.col("l_linestatus") == "X")).alias("empty_ratio"), scoring.ratio(late, F.count("*")).alias("late_ratio"),
    )


Q21 = """SELECT o_orderpriority, count(*) total, count(*) FILTER (WHERE o_orderstatus = 'P') pending, count(*) FILTER (WHERE d > 30) late, avg(d) FILTER (WHERE l_returnflag = 'R') mean_days_returned, 0.0::DOUBLE empty_ratio, count(*) FILTER (WHERE d > 30) / count(*)::DOUBLE late_ratio
FROM (SELECT *, datediff('day', o_orderdate, l_shipdate) d FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1"""


def q22_latest_by_name(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    newest = temporal.latest(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    named = c.withColumn("name", text.name_key("c_name"))
    return named.join(newest, named.c_custkey == newest.o_custkey, "left").select("name", "o_orderkey", "o_orderstatus")


Q22 = "SELECT lower(trim(c_name)) AS name, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey"


def q24_histogram(spark, sf_dir):
    return scoring.histogram(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P", "X"])


Q24 = "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') F, count(*) FILTER (WHERE o_orderstatus = 'O') O, count(*) FILTER (WHERE o_orderstatus = 'P') P, 0::BIGINT X FROM orders GROUP BY 1"


def q25_patterns(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = temporal.top_k(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], 3)
    ids = last.groupBy("user_id", "event_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("last_three"))
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).join(ids, ["user_id", "event_type"])


Q25 = """SELECT user_id, event_type, count(*) n, string_agg(event_id::VARCHAR, ',' ORDER BY r) FILTER (WHERE r <= 3) last_three
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) r FROM events) GROUP BY 1, 2"""


def q26_requirements(spark, sf_dir):
    """Parts that must be handled; those only optional are the rest of what was asked for."""
    li = table(spark, sf_dir, "lineitem")
    required = li.where("l_quantity >= 49").groupBy("l_partkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), "").alias("reasons")).withColumn("need", F.lit("REQUIRED"))
    optional = li.where("l_discount >= 0.1").select("l_partkey").distinct().join(required, "l_partkey", "left_anti").select("l_partkey", F.lit("").alias("reasons"), F.lit("OPTIONAL").alias("need"))
    return required.unionByName(optional)


Q26 = """WITH r AS (SELECT l_partkey, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) reasons, 'REQUIRED' need FROM lineitem WHERE l_quantity >= 49 GROUP BY 1)
SELECT * FROM r UNION ALL SELECT DISTINCT l_partkey, '', 'OPTIONAL' FROM lineitem WHERE l_discount >= 0.1 AND l_partkey NOT IN (SELECT l_partkey FROM r)"""


def q27_top_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


Q27 = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"


def q27b_top_per_customer(spark, sf_dir):
    return temporal.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5).select("o_custkey", "rank", "o_orderkey")


Q27B = "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey FROM orders QUALIFY rank <= 5"


def q27c_priority_queue(spark, sf_dir):
    rank = F.when(F.col("o_orderpriority").rlike("^[12]-"), 0).when(F.col("o_orderpriority").rlike("^3-"), 1).otherwise(2)
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").withColumn("urgency", rank).orderBy("urgency", "o_orderdate", "o_orderkey").limit(200).select("o_orderkey", "urgency")


Q27C = "SELECT o_orderkey, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 0 WHEN o_orderpriority[1] = '3' THEN 1 ELSE 2 END urgency FROM orders WHERE o_orderstatus = 'P' ORDER BY urgency, o_orderdate, o_orderkey LIMIT 200"


def q28_search(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where(text.contains_any_case("Ring", "p_name", "p_type") | (text.code_key(F.col("p_brand")) == "BRAND7")).select("p_partkey", text.code_key("p_brand").alias("code"), text.masked(F.col("p_name")).alias("shown"), F.concat_ws(" ", F.col("p_size").cast("string"), F.lower("p_type")).alias("pack"))


Q28 = "SELECT p_partkey, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') code, CASE WHEN length(p_name) > 3 THEN p_name[1:3] || '***' ELSE '***' END shown, p_size || ' ' || lower(p_type) pack FROM part WHERE contains(lower(p_name || ' ' || p_type), 'ring') OR regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') = 'BRAND7'"
_ENTRIES = ["ring", "widgit", "plaite", "rodd", "bolt blue", "gear", "smal", "blue", "greeen"]
_LIST = ", ".join(f"({i}, '{e}')" for i, e in enumerate(_ENTRIES))


def q29_fuzzy(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name"))
    return fuzzy.lookup(words, spark.sql(f"SELECT * FROM VALUES {_LIST} AS r(ordinal, entry)"))


Q29 = f"""WITH r(ordinal, entry) AS (VALUES {_LIST}), n AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part),
m AS (SELECT name, entry, ordinal, name = entry e, contains(name, entry) OR contains(entry, name) s, CASE WHEN length(name) >= 4 AND levenshtein(name, entry) <= 2 THEN levenshtein(name, entry) END d FROM (SELECT lower(trim(name)) AS name FROM n), r),
g AS (SELECT name, arg_min(entry, ordinal) FILTER (WHERE e) x, arg_min(entry, ordinal) FILTER (WHERE s) y, min(d) md FROM m GROUP BY 1),
t AS (SELECT g.*, (SELECT CASE WHEN count(*) = 1 THEN min(entry) END FROM m WHERE m.name = g.name AND m.d = g.md) z FROM g)
SELECT name, coalesce(x, y, z) AS match, CASE WHEN x IS NOT NULL THEN 'exact' WHEN y IS NOT NULL THEN 'substring' WHEN z IS NOT NULL THEN 'typo' ELSE 'none' END how, CASE WHEN x IS NOT NULL THEN 1.0 WHEN y IS NOT NULL THEN 0.85 WHEN z IS NOT NULL THEN 0.6 ELSE 0.5 END::DOUBLE confidence FROM t"""


def q30_anti_semi(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    none = tables.attempted_without_value(c, o, ["c_custkey"]).select("c_custkey", F.lit("no order").alias("kind"))
    some = c.join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_semi").select("c_custkey", F.lit("pending order").alias("kind"))
    return none.unionByName(some)


Q30 = "SELECT c_custkey, 'no order' kind FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT c_custkey, 'pending order' FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"


def q31_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderdate < '1999-01-01'").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderdate >= '1996-01-01'").select("o_orderkey", F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice")
    return tables.diff(old, new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


Q31 = "SELECT o_orderkey, CASE WHEN o_orderdate >= '1999-01-01' THEN 'NEW' WHEN o_orderdate < '1996-01-01' THEN 'REMOVED' WHEN o_orderkey % 10 = 0 THEN 'CHANGED' ELSE 'SAME' END change FROM orders"


def q32_sets(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    a, b = o.select(F.col("o_custkey").alias("k")), c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(b.exceptAll(a.distinct()).withColumn("kind", F.lit("customer only"))).unionByName(a.union(b).distinct().withColumn("kind", F.lit("any")))


Q32 = "WITH a AS (SELECT o_custkey k FROM orders), b AS (SELECT c_custkey k FROM customer WHERE c_acctbal > 0) SELECT k, 'both' kind FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'customer only' FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT k, 'any' FROM (SELECT k FROM a UNION SELECT k FROM b)"


def q32b_overlay(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    over = n.where("n_nationkey % 5 = 0").select((F.col("n_nationkey") + 10).alias("n_nationkey"), F.concat(F.lit("corrected "), "n_name").alias("n_name"))
    return tables.overlay(n, over, "n_nationkey", "n_name")


Q32B = "WITH v AS (SELECT n_nationkey + 10 k, 'corrected ' || n_name m FROM nation WHERE n_nationkey % 5 = 0) SELECT coalesce(k, n_nationkey) n_nationkey, coalesce(m, n_name) n_name FROM nation FULL JOIN v ON k = n_nationkey"


def q32c_wide_to_long(spark, sf_dir):
    return tables.wide_to_long(table(spark, sf_dir, "part").withColumn("p_type", F.when(F.col("p_type") != "PROMO", F.col("p_type"))), ["p_partkey"], ["p_name", "p_brand", "p_type"])


Q32C = "SELECT p_partkey, 'p_name' field, p_name AS value FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part WHERE p_type <> 'PROMO'"


def q32d_supersede(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("valid_from")).groupBy("o_custkey", "valid_from").agg(F.max("o_orderkey").alias("o_orderkey"))
    v = tables.supersede(o.withColumns({"valid_to": F.lit(None).cast("date"), "status": F.lit("IN_FORCE")}), "o_custkey", "valid_from", "valid_to", "status")
    return v.select("o_orderkey", F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"), "status")


Q32D = "SELECT o_orderkey, strftime(n, '%Y-%m-%d') valid_to, CASE WHEN n IS NULL THEN 'IN_FORCE' ELSE 'SUPERSEDED' END status FROM (SELECT *, lead(d) OVER (PARTITION BY o_custkey ORDER BY d) n FROM (SELECT o_custkey, o_orderdate::DATE d, max(o_orderkey) o_orderkey FROM orders GROUP BY 1, 2))"


def q32e_upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return tables.upsert(s, s.where("s_suppkey % 4 = 0").select((F.col("s_suppkey") + 2).alias("s_suppkey"), F.upper("s_name").alias("s_name")), "s_suppkey")


Q32E = "WITH c AS (SELECT s_suppkey + 2 k, upper(s_name) m FROM supplier WHERE s_suppkey % 4 = 0) SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM c) UNION ALL SELECT * FROM c"


def q41_agreement(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.lit("amount").alias("field"), F.when(F.col("event_type") != "view", F.floor(F.col("value") / 40).cast("string")).alias("value"), F.col("event_type").alias("source"), (F.col("event_id") % 97 / 97).alias("confidence"), F.to_date("ts").alias("day"))
    got = reconcile.reconcile(e.withColumn("key", reconcile.comparison_key(F.col("field"), F.col("value"))), ["user_id", "day", "field"])
    return got.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "agreement", "confidence", "candidates", "sources")


Q41 = """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN count(DISTINCT v) > 1 THEN 'CONFLICT' WHEN count(*) > 1 THEN 'AGREED' ELSE 'SINGLE' END agreement, CASE WHEN count(DISTINCT v) = 1 THEN min(c) ELSE max(c) END confidence, count(*) candidates, string_agg(DISTINCT event_type, ',' ORDER BY event_type) sources
FROM (SELECT *, floor(value / 40) v, event_id % 97 / 97.0::DOUBLE c FROM events WHERE event_type <> 'view') GROUP BY 1, 2"""


def q42_verdicts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").contains("$$$"), 0).otherwise(1).alias("ocr"))
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("vision"))
    return d.join(lab, "doc_id", "full").select("doc_id", reconcile.verdict(F.col("ocr"), F.col("vision")).alias("verdict"))


Q42 = "SELECT doc_id, CASE WHEN o = v THEN 'AI_VERIFIED' WHEN o IS NOT NULL AND v IS NOT NULL THEN 'CONFLICT' WHEN v IS NOT NULL THEN 'AI_EXTRACTED' WHEN o IS NOT NULL THEN 'OCR_ONLY' ELSE 'NOT_DETECTED' END verdict FROM (SELECT doc_id, CASE WHEN contains(text, '$$$') THEN 0 ELSE 1 END o FROM documents) FULL JOIN (SELECT doc_id, quality v FROM labels) USING (doc_id)"


def q42b_verdicts_of_all(spark, sf_dir):
    """All documents; one of fewer than 200 characters gives no reading."""
    ocr = F.when(F.col("n_chars") < 200, None).when(F.col("text").contains("$$$"), 0).otherwise(1)
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("vision"))
    return table(spark, sf_dir, "documents").select("doc_id", ocr.alias("ocr")).join(lab, "doc_id", "full").select("doc_id", reconcile.verdict(F.col("ocr"), F.col("vision")).alias("verdict"))


Q42B = "SELECT doc_id, CASE WHEN o = v THEN 'AI_VERIFIED' WHEN o IS NOT NULL AND v IS NOT NULL THEN 'CONFLICT' WHEN v IS NOT NULL THEN 'AI_EXTRACTED' WHEN o IS NOT NULL THEN 'OCR_ONLY' ELSE 'NOT_DETECTED' END verdict FROM (SELECT doc_id, CASE WHEN n_chars < 200 THEN NULL WHEN contains(text, '$$$') THEN 0 ELSE 1 END o FROM documents) FULL JOIN (SELECT doc_id, quality v FROM labels) USING (doc_id)"
_STEPS = {"view": ["click", "error", "view"], "click": ["purchase", "signup", "view"], "signup": ["view", "click"], "purchase": ["view"], "error": []}
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, bs in _STEPS.items() for b in bs)


def q43_transitions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    j = lifecycle.judged(e, lifecycle.steps(spark, _STEPS), "user_id", "event_type", ["ts", "event_id"])
    now = lifecycle.current(e, "user_id", "event_type", ["ts", "event_id"])
    return j.groupBy("user_id").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid")).join(now, "user_id")


Q43 = f"""SELECT user_id, count(*) FILTER (WHERE ok) valid, count(*) FILTER (WHERE NOT ok) invalid, arg_max(event_type, (ts, event_id)) status, count(*) events
FROM (SELECT *, p IS NULL OR (p, event_type) IN (VALUES {_PAIRS}) ok FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events)) GROUP BY 1"""


def q44_timeline(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return lifecycle.with_previous(c, "conv_id", "role", ["turn"]).withColumn("next_role", F.lead("role").over(w))


Q44 = "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) from_status, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) next_role FROM conversations"


def _bits(spark, sf_dir):
    bit = F.aggregate(F.transform(F.slice("embedding", 1, 32), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), bit.alias("hash"), F.abs(F.get("embedding", F.lit(0)).cast("double")).alias("ink"))


_HASH = "list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 1)) ELSE 0 END))::BIGINT h"
_APART = "bit_count(xor(x.h, y.h))::INT"


def q45_near_images(spark, sf_dir):
    """Near pairs of classes of equal images, up to five bits."""
    return fuzzy.near_classes(_bits(spark, sf_dir), 5, 8, 32)


Q45 = f"""WITH e AS (SELECT vec_id, {_HASH} FROM embeddings), c AS (SELECT h, min(vec_id) i, count(*) n FROM e GROUP BY 1)
SELECT x.i a, y.i b, {_APART} distance, x.n a_images, y.n b_images FROM c x JOIN c y ON x.i < y.i WHERE {_APART} <= 5"""


def q45b_copied_images(spark, sf_dir):
    """Every image with its class, its near images' number, those that the gate lets through, and the nearest earlier one of these; a component stands for the ink."""
    return fuzzy.copied_images(_bits(spark, sf_dir), 5, 8, 0.02, 32, opened=True)


Q45B = f"""WITH e AS (SELECT vec_id, abs(embedding[1]::DOUBLE) ink, {_HASH} FROM embeddings), p AS (SELECT x.vec_id a, y.vec_id b, {_APART} d, x.ink >= 0.02 AND y.ink >= 0.02 k FROM e x JOIN e y ON x.vec_id <> y.vec_id WHERE {_APART} <= 5),
n AS (SELECT b, min(CASE WHEN d = 0 THEN a END) c, count(*) links, count(*) FILTER (WHERE d = 0 OR k) opened, arg_min(a, (d, a)) FILTER (WHERE a < b AND (d = 0 OR k)) nearest, min(d) FILTER (WHERE a < b AND (d = 0 OR k)) distance FROM p GROUP BY 1)
SELECT vec_id id, least(vec_id, coalesce(c, vec_id)) copy_of, coalesce(links, 0) links, nearest, distance, coalesce(opened, 0) open_links FROM e LEFT JOIN n ON b = vec_id"""


def q46_neighbours(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return fuzzy.nearest_in_grid(p, ["label"], 0.05, 6).select("label", "id", "rank", "other")


Q46 = "WITH p AS (SELECT label, vec_id id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y FROM embeddings) SELECT a.label, a.id, row_number() OVER (PARTITION BY a.label, a.id ORDER BY abs(a.x - b.x) + abs(a.y - b.y), b.id) AS rank, b.id other FROM p a JOIN p b ON a.label = b.label AND a.id <> b.id AND abs(a.x - b.x) + abs(a.y - b.y) <= 0.05 QUALIFY rank <= 6"


def q47_checksum(spark, sf_dir):
    code = F.lpad(F.col("o_orderkey") * 7919 + F.col("o_custkey"), 13, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.check_digit_ok(code).alias("ok"))


Q47 = "SELECT o_orderkey, list_sum(list_transform(range(1, 14), lambda i: (c[14 - i])::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0 ok FROM (SELECT o_orderkey, lpad((o_orderkey * 7919 + o_custkey)::VARCHAR, 13, '0') c FROM orders)"


def q49_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


Q49 = "SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H') AS start, event_type, count(*) n FROM events GROUP BY 1, 2"


def q49b_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).select("user_id", "n", "first_id")


Q49B = "SELECT user_id, count(*) n, min(event_id) first_id FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) g FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '2 hours' THEN 0 ELSE 1 END new FROM events)) GROUP BY user_id, g"
_MANIFEST = [("R1", "C1", "FIELD_PRESENT", "2020-01-01", "2021-01-01", 5), ("R1", "C1", "NOPE", "2020-06-01", None, -1), ("R2", None, "DATE_VALID", "2022-01-01", "2021-01-01", 3), ("R3", "C9", "FIELD_PRESENT", "2020-01-01", None, 2)]
_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in _MANIFEST)


def q50_manifest(spark, sf_dir):
    from ..operators.manifest import problems

    return problems(spark.sql(f"SELECT * FROM VALUES {_ROWS} AS m(rule_id, check_id, check_type, valid_from, valid_to, weight)"), ["C1", "C2"], ["FIELD_PRESENT", "DATE_VALID"])


Q50 = f"""WITH m(rule_id, check_id, check_type, valid_from, valid_to, weight) AS (VALUES {_ROWS})
SELECT rule_id, valid_from, 'unknown check' problem FROM m WHERE check_id NOT IN ('C1', 'C2') UNION ALL SELECT rule_id, valid_from, 'missing check' FROM m WHERE check_id IS NULL
UNION ALL SELECT rule_id, valid_from, 'unknown check type' FROM m WHERE check_type NOT IN ('FIELD_PRESENT', 'DATE_VALID') UNION ALL SELECT rule_id, valid_from, 'empty interval' FROM m WHERE valid_to <= valid_from
UNION ALL SELECT rule_id, valid_from, 'negative weight' FROM m WHERE weight < 0
UNION ALL SELECT rule_id, valid_from, 'overlap' FROM (SELECT *, max(coalesce(valid_to, '9999')) OVER (PARTITION BY rule_id, check_id ORDER BY valid_from ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) far FROM m) WHERE far > valid_from"""

_NAMES = "q20b_queue q21_dashboard q22_latest_by_name q24_histogram q25_patterns q26_requirements q27_top_orders q27b_top_per_customer q27c_priority_queue q28_search q29_fuzzy q30_anti_semi q31_diff q32_sets q32b_overlay q32c_wide_to_long q32d_supersede q32e_upsert q41_agreement q42_verdicts q42b_verdicts_of_all q43_transitions q44_timeline q45_near_images q45b_copied_images q46_neighbours q47_checksum q49_windows q49b_sessions q50_manifest"
QUERIES = {n: (globals()[n], globals()[n.split("_")[0].upper()]) for n in _NAMES.split()}
