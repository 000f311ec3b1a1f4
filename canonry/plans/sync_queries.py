"""Queries of the sync of rule bases and of checks of schemas, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, sync
from .rule_queries import table


def rule_bases(spark, sf_dir):
    """A rule base and one offered to it: customers as checks, orders as their versions, line items as applicability, balances as weights."""
    c, o, n, r, l = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation", "region", "lineitem"))  # noqa: E741
    checks = c.selectExpr("c_custkey AS check_id", "concat('R', IF(c_mktsegment = 'MACHINERY' AND c_acctbal < 0, 99, c_nationkey)) AS rule_number", "c_custkey AS sub_rule", "'' AS clause", "c_mktsegment")
    content = ["o_orderkey AS version_id", "o_custkey AS check_id", "'text' AS text", "CAST(o_orderdate AS DATE) AS start", "IF(o_orderstatus = 'O', NULL, date_add(o_orderdate, 200)) AS end", "o_orderstatus AS status", "o_totalprice"]
    versions = o.selectExpr(*content, "o_orderpriority AS requirement").join(checks.select("check_id", "rule_number", "sub_rule", "clause"), "check_id")
    have = {
        "rules": n.selectExpr("concat('R', n_nationkey) AS rule_number", "n_nationkey AS rule_id"), "sources": r.selectExpr("r_name AS title", "r_regionkey AS source_id"),
        "checks": checks.where("c_mktsegment <> 'BUILDING'").select("check_id", "rule_number", "sub_rule", "clause"),
        "versions": versions.where("status <> 'P'").selectExpr("version_id", "check_id", "rule_number", "sub_rule", "clause", "requirement", "text", "start", "end", "status", "IF(status = 'F', 'DECLARATION', 'LIMIT') AS requirement_type"),
        "applicability": l.where("l_linenumber % 2 = 1").selectExpr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS applicability_id", "l_orderkey AS version_id", "l_returnflag AS condition", "l_linestatus AS result"),
        "weights": c.where("c_nationkey < 10").selectExpr("c_custkey AS check_id", "c_acctbal AS weight", "'high' AS severity"),
    }
    offered = {
        "checks": checks.select("check_id", "rule_number", "sub_rule", "clause"),
        "versions": o.where("NOT (o_orderstatus = 'F' AND o_totalprice < 50000)").selectExpr(*content, "IF(o_totalprice > 400000, 'changed', o_orderpriority) AS requirement", "get(array(' africa', 'AMERICA ', 'Asia', 'EUROPE', 'MIDDLE EAST', 'atlantis'), CAST(o_orderkey % 6 AS INT)) AS source_title"),
        "applicability": l.selectExpr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS applicability_id", "l_orderkey AS version_id", "IF(l_quantity > 45, 'changed', l_returnflag) AS condition", "l_linestatus AS result"),
        "weights": c.selectExpr("c_custkey AS check_id", "IF(c_nationkey = 3, c_acctbal + 1, c_acctbal) AS weight", "'HIGH' AS severity"),
    }
    return have, offered


def q134_rule_sync(spark, sf_dir):
    """What a sync does to each table, and what a second one finds left to do: nothing is inserted twice."""
    have, offered = rule_bases(spark, sf_dir)
    first = sync.plan(have, offered)
    second = sync.plan(sync.applied(have, first), offered)
    return sync.summary(first).withColumn("run", F.lit(1)).unionByName(sync.summary(second).withColumn("run", F.lit(2)))


_BASE = """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 0 THEN 99 ELSE c_nationkey END AS rule, c_mktsegment AS m, c_nationkey AS nation FROM customer),
v AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS s, o_totalprice AS p, o_orderdate AS start, rule, s <> 'P' AS old, NOT (s = 'F' AND p < 50000) AS new, o_orderkey % 6 <> 5 AS sourced FROM orders JOIN c ON c.id = o_custkey),
k AS (SELECT *, bool_or(old) OVER (PARTITION BY cust) AS sibling FROM v),
w AS (SELECT *, CASE WHEN NOT new THEN 'KEPT' WHEN old AND p > 400000 THEN 'CONFLICT' WHEN old THEN 'SAME' WHEN rule = 99 OR NOT sourced THEN 'ERROR' WHEN NOT sibling THEN 'CONFLICT' ELSE 'INSERT' END AS action FROM k)"""
Q134 = (
    _BASE
    + """, t AS (SELECT 'checks' AS "table", CASE WHEN m <> 'BUILDING' THEN 'SAME' WHEN rule = 99 THEN 'ERROR' ELSE 'INSERT' END AS action, CASE WHEN m = 'BUILDING' AND rule = 99 THEN 'no catalogue entry' END AS note FROM c
 UNION ALL SELECT 'versions', action, CASE WHEN action = 'KEPT' THEN 'no longer offered' WHEN action = 'CONFLICT' AND old THEN 'other content under this id' WHEN action = 'CONFLICT' THEN 'no sibling to inherit from' WHEN action = 'ERROR' AND rule = 99 THEN 'no catalogue entry' WHEN action = 'ERROR' THEN 'no such source' END FROM w
 UNION ALL SELECT 'applicability', CASE WHEN l_linenumber % 2 = 1 THEN CASE WHEN l_quantity > 45 THEN 'CONFLICT' ELSE 'SAME' END WHEN NOT old AND action <> 'INSERT' THEN 'BLOCKED' WHEN NOT sourced OR NOT new THEN 'ERROR' ELSE 'INSERT' END,
  CASE WHEN l_linenumber % 2 = 1 THEN CASE WHEN l_quantity > 45 THEN 'other content under this id' END WHEN NOT old AND action <> 'INSERT' THEN 'its version was not applied' WHEN NOT sourced OR NOT new THEN 'no such source' END FROM lineitem JOIN w ON w.id = l_orderkey
 UNION ALL SELECT 'weights', CASE WHEN nation < 10 AND nation <> 3 THEN 'SAME' ELSE 'UPSERT' END, NULL FROM c)
SELECT "table", action, note, count(*) AS n, run FROM t, (VALUES (1), (2)) r(run) WHERE action <> 'SAME' AND (run = 1 OR action NOT IN ('INSERT', 'UPSERT')) GROUP BY ALL"""
)


def q135_sync_overlaps(spark, sf_dir):
    """Versions that a sync would insert although they overlap one that is there."""
    have, offered = rule_bases(spark, sf_dir)
    return sync.overlapping(have, sync.plan(have, offered))


Q135 = _BASE + " SELECT a.id AS version_id, b.id AS existing_id FROM w a JOIN w b ON a.cust = b.cust AND a.action = 'INSERT' AND b.old WHERE a.start < CASE WHEN b.s = 'O' THEN TIMESTAMP '9999-12-31' ELSE b.start + INTERVAL 200 DAY END AND b.start < a.start + INTERVAL 200 DAY"


def key_graph(spark, sf_dir):
    """Customers as tables that refer to the one with a quarter of their key; some refer to the next one and back; debtors of one segment to what isn't there."""
    c = table(spark, sf_dir, "customer")
    ring = "c_mktsegment = 'MACHINERY' AND c_nationkey % 5 = 2"
    refs = c.where("c_custkey > 0").selectExpr("c_custkey AS name", "c_custkey div 4 AS target").unionByName(c.where(ring).selectExpr("inline(array(struct(c_custkey AS name, c_custkey + 1 AS target), struct(c_custkey + 1 AS name, c_custkey AS target)))"))
    return c.selectExpr("c_custkey AS name"), refs.unionByName(c.where("c_mktsegment = 'BUILDING' AND c_acctbal < 0").selectExpr("c_custkey AS name", "-c_custkey AS target"))


def q141_creation_order(spark, sf_dir):
    return graphs.creation_order(*key_graph(spark, sf_dir))


_GRAPH = """e AS (SELECT c_custkey AS name, c_custkey // 4 AS target FROM customer WHERE c_custkey > 0 UNION SELECT c_custkey, c_custkey + 1 FROM g UNION SELECT c_custkey + 1, c_custkey FROM g),
k AS (SELECT DISTINCT name, target FROM e WHERE name <> target AND name IN (SELECT c_custkey FROM customer) AND target IN (SELECT c_custkey FROM customer))"""
_RING = "g AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey % 5 = 2)"
Q141 = f"""WITH RECURSIVE {_RING}, {_GRAPH}, r AS (SELECT name, target FROM k UNION SELECT r.name, k.target FROM r JOIN k ON k.name = r.target), c AS (SELECT name FROM r WHERE name = target),
b AS (SELECT DISTINCT name FROM r WHERE target IN (SELECT name FROM c)), a AS (SELECT DISTINCT target AS name FROM r WHERE name IN (SELECT name FROM c)),
d AS (SELECT c_custkey AS name, c_custkey AS at, 0 AS depth FROM customer WHERE c_custkey NOT IN (SELECT name FROM b) UNION SELECT d.name, k.target, depth + 1 FROM d JOIN k ON k.name = d.at)
SELECT c_custkey AS name, CASE WHEN c_custkey NOT IN (SELECT name FROM b) THEN (SELECT max(depth) FROM d WHERE d.name = c_custkey) END::INT AS level, CASE WHEN c_custkey NOT IN (SELECT name FROM b) THEN 'OK' WHEN c_custkey IN (SELECT name FROM a) THEN 'CYCLE' ELSE 'BEHIND' END AS status FROM customer"""


def q142_unresolved_keys(spark, sf_dir):
    return graphs.unresolved(*key_graph(spark, sf_dir))


Q142 = f"""WITH {_RING}, e AS (SELECT c_custkey AS name, -c_custkey AS target FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0 UNION SELECT c_custkey, c_custkey + 1 FROM g)
SELECT name, target FROM e WHERE target NOT IN (SELECT c_custkey FROM customer)"""

QUERIES = {k: (f, globals().get(k.split("_")[0].upper())) for k, f in list(globals().items()) if k[:1] == "q" and k[1:2].isdigit() and callable(f)}
