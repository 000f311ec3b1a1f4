"""Static checks of a schema as a graph of keys: targets that don't exist, an order of creation, cycles.

``tables`` has ``name``; ``refs`` has ``name`` and ``target``, any number of times. Levels are found by rounds: what
refers to nothing that is left comes next. A round is two anti-joins on names; its result is checkpointed, so
plans stay short and a lost executor costs a round. Rounds are as many as the longest chain.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unresolved(tables: DataFrame, refs: DataFrame) -> DataFrame:
    """References to what isn't there: ``name``, ``target``."""
    return refs.select("name", "target").distinct().join(tables.select(F.col("name").alias("target")), "target", "left_anti").select("name", "target")


def missing(tables: DataFrame, required: list[str]) -> DataFrame:
    """Required names that no table bears."""
    return tables.sparkSession.createDataFrame([(n,) for n in required], "name string").join(tables.select("name"), "name", "left_anti")


def _kept(df: DataFrame) -> DataFrame:
    """The frame without its lineage, in the session's checkpoint folder; where none is set (tests on one machine), in a temporary one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="canonry-"))
    return df.checkpoint()


def _peeled(nodes: DataFrame, edges: DataFrame, of: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Nodes by level, those first of which no edge leaves (``of``) to what is left (``at``), and the nodes that never get one."""
    placed, level = None, 0
    while True:
        ready = _kept(nodes.join(edges.select(F.col(of).alias("name")).distinct(), "name", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            return placed if placed is not None else ready, nodes
        placed, level = ready if placed is None else placed.unionByName(ready), level + 1
        nodes = _kept(nodes.join(ready, "name", "left_anti").select("name"))
        edges = _kept(edges.join(ready.select(F.col("name").alias(at)), at, "left_anti").select("name", "target"))


def creation_order(tables: DataFrame, refs: DataFrame) -> DataFrame:
    """``name``, ``level`` (a table refers to lower levels alone; itself aside) and ``status``.

    ``OK`` has a level. ``CYCLE`` refers to itself through others, or lies between two that do; ``BEHIND`` only refers to such. Targets that
    don't exist hold nothing up.
    """
    nodes = tables.select("name").distinct()
    known = refs.where(F.col("name") != F.col("target")).select("name", "target").distinct().join(nodes, "name", "left_semi").join(nodes.select(F.col("name").alias("target")), "target", "left_semi").select("name", "target")
    placed, rest = _peeled(nodes, _kept(known), "name", "target")
    among = known.join(rest, "name", "left_semi").join(rest.select(F.col("name").alias("target")), "target", "left_semi").select("name", "target")
    behind, cyclic = _peeled(rest, _kept(among), "target", "name")
    none = F.lit(None).cast("int")
    return placed.select("name", "level", F.lit("OK").alias("status")).unionByName(behind.select("name", none.alias("level"), F.lit("BEHIND").alias("status"))).unionByName(cyclic.select("name", none.alias("level"), F.lit("CYCLE").alias("status")))
