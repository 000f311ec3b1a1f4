"""Ordered applicability rows folded into one CASE: the first decisive row wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .conditions import Facts, compile_condition


def _outcome(applicable: bool | None, status: str, reason: Column) -> Column:
    return F.struct(F.lit(applicable).cast("boolean").alias("applicable"), F.lit(status).alias("status"), reason.alias("reason"))


def decide(rows: list[dict], facts: Facts, mandatory: bool = True, version: str = "") -> Column:
    """``struct(applicable, status, reason)`` for rows of ``result``, ``condition``, ``reason`` in order.

    A row that cannot be decided is remembered; where no later row decides, the last
    one remembered asks for review.
    """
    if not rows:
        if mandatory:
            return _outcome(True, "REQUIRED", F.lit("no exception is configured; the base requirement holds"))
        return _outcome(None, "NEEDS_REVIEW", F.lit(f"no applicability is configured for {version}"))
    remembered = F.lit(None).cast("string")
    steps: list[tuple[Column, Column]] = []

    for row in rows:
        kind, tree, reason = row["result"], row.get("condition") or {}, row.get("reason") or ""
        met = compile_condition(tree, facts)
        if kind in ("NOT_APPLICABLE", "NOT_REQUIRED"):
            steps.append((met, _outcome(False, kind, F.lit(reason))))
        elif kind in ("REQUIRED", "NOT_REQUIRED_UNCONDITIONAL"):
            steps.append((met, _outcome(True, kind, F.lit(reason))))
        elif kind == "CONDITIONAL":
            steps.append((met, _outcome(True, "CONDITIONAL", F.lit(reason))))
            base = _outcome(True, "REQUIRED", F.lit((reason + "; " if reason else "") + "the proviso is not met, so the base requirement holds"))
            steps.append((~met, base if mandatory else _outcome(False, "NOT_APPLICABLE", F.lit(reason))))
        else:
            remembered = F.lit(reason or f"unknown outcome {kind}")
            continue
        remembered = F.when(met.isNull(), F.lit(reason)).otherwise(remembered)
    end = F.when(remembered.isNotNull(), _outcome(None, "NEEDS_REVIEW", remembered)).otherwise(_outcome(False, "NOT_APPLICABLE", F.lit("no row matched")))
    case = None
    for met, result in steps:
        case = F.when(met, result) if case is None else case.when(met, result)
    return case.otherwise(end) if case is not None else end
