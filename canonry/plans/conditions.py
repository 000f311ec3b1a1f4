"""Compiles condition trees to Spark columns, so that Catalyst folds and codegens them.

``Facts`` gives the typed column of a field. Three-valued logic is SQL's own: true,
false and null (undecided). A field that the frame lacks is a null of no type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ORDER = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def unknown() -> Column:
    return F.lit(None).cast("boolean")


class Facts:
    """Columns of a frame by field name, with what kind of value each holds."""

    def __init__(self, df: DataFrame, columns: dict[str, str] | None = None) -> None:
        kinds = dict(df.dtypes)
        self._at = {field: (column, kinds[column]) for field, column in (columns or {c: c for c in df.columns}).items() if column in kinds}

    def column(self, field: str) -> Column:
        return F.col(f"`{self._at[field][0]}`") if field in self._at else F.lit(None).cast("string")

    def kind(self, field: str) -> str:
        """``bool``, ``number``, ``text`` or ``none``."""
        if field not in self._at:
            return "none"
        t = self._at[field][1]
        return "bool" if t == "boolean" else "number" if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal") else "text"

    def number(self, field: str) -> Column:
        """The value as a number; null where it is none."""
        return self.column(field).cast("double") if self.kind(field) in ("number", "bool") else F.expr(f"try_cast({self._quoted(field)} as double)")

    def text(self, field: str) -> Column:
        return self.column(field).cast("string")

    def _quoted(self, field: str) -> str:
        return f"`{self._at[field][0]}`" if field in self._at else "null"

    def present(self, field: str) -> Column:
        """Declared: not null, not blank, not the mark of a failed detection, not false; zero counts as declared."""
        c, kind = self.column(field), self.kind(field)
        if kind == "bool":
            return F.coalesce(c, F.lit(False))
        if kind == "text":
            return c.isNotNull() & ~F.trim(c).isin("", "NOT_DETECTED")
        return c.isNotNull() if kind == "number" else F.lit(False)


def _as_truth(value):
    return {"true": True, "false": False}.get(value.strip().lower(), value) if isinstance(value, str) else value


def _equals(facts: Facts, field: str, value) -> Column:
    """Never null: a missing field equals null alone. The texts true and false are truth values on both sides."""
    c, kind, value = facts.column(field), facts.kind(field), _as_truth(value)
    if value is None:
        return c.isNull()
    if kind == "none":
        return F.lit(False)
    if isinstance(value, bool):
        if kind == "bool":
            return c.eqNullSafe(F.lit(value))
        if kind == "number":
            return F.coalesce(c == F.lit(int(value)), F.lit(False))
        return F.coalesce(F.lower(F.trim(c)) == F.lit(str(value).lower()), F.lit(False))
    if isinstance(value, (int, float)):
        return F.coalesce(c.cast("double") == F.lit(float(value)), F.lit(False)) if kind in ("number", "bool") else F.lit(False)
    return F.coalesce(c == F.lit(value), F.lit(False)) if kind == "text" else F.lit(False)


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(False)


def _compare(facts: Facts, field: str, op: str, value, missing: Column) -> Column:
    c = facts.column(field)
    if op == "eq":
        return _equals(facts, field, value)
    if op == "neq":
        return ~_equals(facts, field, value)
    if op in ("in", "not_in"):
        found = _any([_equals(facts, field, v) for v in value or []])
        return F.when(c.isNull(), missing).otherwise(found if op == "in" else ~found)
    if op in _ORDER:
        try:
            bound = float(value)
        except (TypeError, ValueError):
            return F.when(c.isNull(), missing)
        return F.when(c.isNull(), missing).otherwise(getattr(facts.number(field), _ORDER[op])(F.lit(bound)))
    return unknown()


def compile_condition(tree, facts: Facts) -> Column:
    """The column that is true, false or null (undecided) where the tree is."""
    if not tree:
        return F.lit(True)
    if not isinstance(tree, dict):
        return unknown()
    if "all" in tree:
        return reduce(lambda a, b: a & b, [compile_condition(t, facts) for t in tree["all"] or []], F.lit(True))
    if "any" in tree:
        return reduce(lambda a, b: a | b, [compile_condition(t, facts) for t in tree["any"] or []], F.lit(False))
    field = tree.get("field")
    if field is None:
        return unknown()
    if "op" in tree:
        op, value = str(tree["op"]), tree.get("value")
        # Written out with "op", a test of a missing field is decided: it is in no list and in no order.
        missing = F.lit({"in": None in (value or []) if op == "in" else False, "not_in": True}.get(op, False))
        return _compare(facts, field, op, value, missing)
    for op in ("eq", "neq", "in", "not_in", *_ORDER):
        if op in tree:
            return _compare(facts, field, op, tree[op], unknown())
    if "present" in tree:
        c = facts.column(field)
        there = (c.isNotNull() & (c != "")) if facts.kind(field) == "text" else c.isNotNull()
        return there == F.lit(bool(tree["present"]))
    return unknown()
