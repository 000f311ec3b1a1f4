"""Queries of case work: policies that don't care, pathways, medians, overlays, patterns, views; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback, temporal
from .rule_queries import table

_POLICIES = "('A', 'BUILDING', NULL, 3.0), ('B', NULL, '1-URGENT', 2.0), ('C', 'MACHINERY', '5-LOW', 1.0)"


def q57_dont_care_join(spark, sf_dir):
    p = F.broadcast(spark.sql(f"SELECT * FROM VALUES {_POLICIES} AS p(policy, segment, priority, weight)"))
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    fits = (p.segment.isNull() | (p.segment == o.c_mktsegment)) & (p.priority.isNull() | (p.priority == o.o_orderpriority))
    return o.join(p, fits, "left").groupBy("o_orderkey").agg(F.array_join(F.sort_array(F.collect_list("policy")), "").alias("policies"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))


Q57 = f"""SELECT o_orderkey, coalesce(string_agg(policy, '' ORDER BY policy), '') policies, coalesce(sum(weight), 0)::DOUBLE weight FROM orders JOIN customer ON c_custkey = o_custkey
LEFT JOIN (VALUES {_POLICIES}) p(policy, segment, priority, weight) ON (segment IS NULL OR segment = c_mktsegment) AND (priority IS NULL OR priority = o_orderpriority) GROUP BY 1"""
_PATHS = "('R', 'F', 'notice', 7), ('A', 'F', 'compounding', 30), ('R', 'O', 'court', 90)"


def q58_pathways(spark, sf_dir):
    paths = F.broadcast(spark.sql(f"SELECT * FROM VALUES {_PATHS} AS v(l_returnflag, l_linestatus, pathway, days)"))
    li = table(spark, sf_dir, "lineitem").join(paths, ["l_returnflag", "l_linestatus"], "left")
    return li.groupBy(F.coalesce("pathway", F.lit("none")).alias("pathway")).agg(F.count("*").alias("cases"), F.count_distinct("l_orderkey").alias("orders"), F.max(F.date_format(F.date_add(F.to_date("l_shipdate"), F.coalesce("days", F.lit(0))), "yyyy-MM-dd")).alias("last_due"))


Q58 = f"SELECT coalesce(pathway, 'none') pathway, count(*) cases, count(DISTINCT l_orderkey) orders, max(strftime(l_shipdate::DATE + coalesce(days, 0)::INT, '%Y-%m-%d')) last_due FROM lineitem LEFT JOIN (VALUES {_PATHS}) v(f, s, pathway, days) ON f = l_returnflag AND s = l_linestatus GROUP BY 1"


def q59_above_mean(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    mean = o.where("o_orderstatus = 'F'").agg(F.avg(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("mean"))
    return o.crossJoin(F.broadcast(mean)).where("o_totalprice > mean").select("o_orderkey")


Q59 = "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders WHERE o_orderstatus = 'F')"


def q60_medians(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("c", F.when(F.col("event_id") % 10 > 0, F.col("value")).otherwise(0.0))
    return e.groupBy("user_id").agg(F.median("value").alias("median"), (F.sum(F.when(F.col("c") != 0, F.col("c").cast("decimal(18,4)"))).cast("double") / F.count_if(F.col("c") != 0)).alias("mean_known"), F.count_distinct("event_type").alias("types"), F.bool_and(F.col("value") < 150).alias("within"))


Q60 = '''SELECT user_id, median(value) median, (sum(value::DECIMAL(18,4)) FILTER (WHERE event_id % 10 > 0 AND value <> 0))::DOUBLE / count(*) FILTER (WHERE event_id % 10 > 0 AND value <> 0) mean_known, count(DISTINCT event_type) types, bool_and(value < 150) AS "within" FROM events GROUP BY 1'''


def q61_best_line(spark, sf_dir):
    """The best line of an order by several criteria at once, and the first that matches."""
    li = table(spark, sf_dir, "lineitem")
    rank = F.struct("l_quantity", "l_extendedprice", F.negative("l_partkey").alias("p"), F.negative("l_linenumber").alias("n"), F.negative("l_suppkey").alias("s"))
    return li.groupBy("l_orderkey").agg(F.max_by("l_partkey", rank).alias("best_part"), F.min(F.when(F.col("l_discount") > 0.05, F.struct("l_linenumber", "l_partkey"))).getField("l_partkey").alias("first_discounted"))


Q61 = """SELECT l_orderkey, arg_max(l_partkey, (l_quantity, l_extendedprice, -l_partkey, -l_linenumber, -l_suppkey)) best_part, min((l_linenumber, l_partkey)) FILTER (WHERE l_discount > 0.05) AS f FROM lineitem GROUP BY 1"""
Q61 = f"SELECT l_orderkey, best_part, struct_extract(f, 'p') first_discounted FROM ({Q61.replace('(l_linenumber, l_partkey)', "{'n': l_linenumber, 'p': l_partkey}")})"


def q62_corrections(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("field"), F.col("value").cast("string").alias("corrected_value"), F.col("ts").alias("created_at"), (F.col("event_type") != "error").alias("verified"))
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("view").alias("field"), F.col("c_mktsegment").alias("value"))
    return feedback.verified_overlay(base, e, ["user_id"]).select("user_id", "field", F.coalesce(F.expr("cast(try_cast(value as double) as string)"), "value").alias("value"), "corrected")


Q62 = """WITH c AS (SELECT user_id, event_type field, arg_max(value, (ts, event_id)) v FROM events WHERE event_type <> 'error' GROUP BY 1, 2), b AS (SELECT c_custkey user_id, 'view' field, c_mktsegment s FROM customer)
SELECT user_id, field, coalesce(v::VARCHAR, s) AS value, v IS NOT NULL corrected FROM b FULL JOIN c USING (user_id, field)"""


def q62b_all_corrections(spark, sf_dir):
    """Every customer's view, with the newest correction of at least 50 as the verified one."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("field"), F.col("value").cast("string").alias("corrected_value"), F.col("ts").alias("created_at"), (F.col("value") >= 50).alias("verified"))
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("view").alias("field"), F.col("c_mktsegment").alias("value"))
    return feedback.verified_overlay(base, e, ["user_id"]).select("user_id", "field", F.coalesce(F.expr("cast(try_cast(value as double) as string)"), "value").alias("value"), "corrected")


Q62B = """WITH c AS (SELECT user_id, event_type field, arg_max(value, (ts, event_id)) v FROM events WHERE value >= 50 GROUP BY 1, 2), b AS (SELECT c_custkey user_id, 'view' field, c_mktsegment s FROM customer)
SELECT user_id, field, coalesce(v::VARCHAR, s) AS value, v IS NOT NULL corrected FROM b FULL JOIN c USING (user_id, field)"""


def q63_current_requirements(spark, sf_dir):
    """Views over the tables: the requirements in force on a day, with their sources."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("canonry_rules")
    table(spark, sf_dir, "region").where("r_regionkey % 2 = 0").createOrReplaceTempView("canonry_sources")
    return spark.sql("SELECT n_nationkey AS rule, concat('Rule ', n_regionkey, '(', coalesce(nullif(substring(n_name, 8), ''), ''), ')') AS reference, r_name AS source FROM canonry_rules JOIN canonry_sources ON r_regionkey = n_regionkey WHERE n_nationkey >= 3")


Q63 = "SELECT n_nationkey AS rule, 'Rule ' || n_regionkey || '(' || substr(n_name, 8) || ')' reference, r_name AS source FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey % 2 = 0 AND n_nationkey >= 3"


def q64_patterns(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    c = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("field"), F.when(F.col("p_size") % 5 > 0, F.col("p_name")).alias("original_value"), F.when(F.col("p_size") % 5 == 1, F.upper("p_name")).when(F.col("p_size") % 5 == 2, F.concat(F.substring("p_name", 1, 3), F.lit("x"), F.expr("substring(p_name, 5)"))).otherwise(F.reverse("p_name")).alias("corrected_value"), F.when(F.col("p_size") % 2 == 0, "NOT_DETECTED").otherwise("DETECTED").alias("original_status"), F.col("p_retailprice").alias("created_at"))
    return feedback.patterns(c)


Q64 = """WITH k AS (SELECT p_partkey, p_type field, p_retailprice t, CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'missed' ELSE 'empty' END WHEN p_size % 5 = 1 THEN 'format' WHEN p_size % 5 = 2 THEN CASE WHEN p_name[4] = 'x' THEN 'format' ELSE 'misread' END
 WHEN regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(reverse(p_name)), '[^a-z0-9]', '', 'g') THEN 'format' WHEN levenshtein(p_name, reverse(p_name)) <= 2 THEN 'misread' ELSE 'wrong_value' END kind FROM part)
SELECT field, kind, count(*) n, string_agg(p_partkey::VARCHAR, ',' ORDER BY r) FILTER (WHERE r <= 3) latest FROM (SELECT *, row_number() OVER (PARTITION BY field, kind ORDER BY t DESC, p_partkey DESC) r FROM k) GROUP BY 1, 2"""


def q65_notifications(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 2 == 0, "officers").otherwise("consumers").alias("audience"), F.col("ts").alias("created_at"))
    n = feedback.fan_out(e, {"officers": ["o1", "o2"], "consumers": ["c1"]})
    return temporal.top_k(n, ["recipient"], [F.desc("created_at"), F.desc("id")], 50).select("recipient", "rank", "id")


Q65 = """SELECT recipient, row_number() OVER (PARTITION BY recipient ORDER BY ts DESC, event_id DESC) AS rank, event_id id FROM events JOIN (VALUES (0, 'o1'), (0, 'o2'), (1, 'c1')) m(k, recipient) ON user_id % 2 = k WHERE event_type = 'error' QUALIFY rank <= 50"""


def q66_officer_actions(spark, sf_dir):
    v = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("violation_id"), F.lit("PENDING").alias("inspector_status"))
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("violation_id"), F.col("l_shipdate").alias("at")).agg(F.max("l_linenumber").alias("action_id")).withColumn("action", F.element_at(F.array(F.lit("confirm"), F.lit("reject"), F.lit("review")), (F.col("action_id") % 3 + 1).cast("int")))
    return feedback.decided(v, a).groupBy("inspector_status").agg(F.count("*").alias("n"), F.count("decided_at").alias("decided"))


Q66 = """WITH a AS (SELECT l_orderkey k, arg_max(n, d) n FROM (SELECT l_orderkey, l_shipdate d, max(l_linenumber) n FROM lineitem GROUP BY 1, 2) GROUP BY 1)
SELECT CASE n % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'REQUIRES_REVIEW' ELSE 'PENDING' END inspector_status, count(*) n, count(a.n) decided FROM orders LEFT JOIN a ON k = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1"""

_NAMES = "q57_dont_care_join q58_pathways q59_above_mean q60_medians q61_best_line q62_corrections q62b_all_corrections q63_current_requirements q64_patterns q65_notifications q66_officer_actions"
QUERIES = {n: (globals()[n], globals()[n.split("_")[0].upper()]) for n in _NAMES.split()}
