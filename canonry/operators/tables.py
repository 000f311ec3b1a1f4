"""Relational operators on whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filtered(df: DataFrame, **wanted) -> DataFrame:
    """Conjunction of equalities; an argument that is None asks for nothing, a list for one of it."""
    tests = [F.col(k).isin(v) if isinstance(v, (list, tuple)) else F.col(k) == v for k, v in wanted.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def dont_care(column: Column, value) -> Column:
    """A null in the table accepts any value."""
    return column.isNull() | (column == value)


def diff(old: DataFrame, new: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """``key``, ``change``: NEW, REMOVED, CHANGED or SAME, nulls alike."""
    a = old.select(F.col(key), F.struct(*compared).alias("__a"))
    b = new.select(F.col(key), F.struct(*compared).alias("__b"))
    same = reduce(lambda x, y: x & y, [F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")) for c in compared])
    return a.join(b, key, "full").select(key, F.when(F.col("__a").isNull(), "NEW").when(F.col("__b").isNull(), "REMOVED").when(same, "SAME").otherwise("CHANGED").alias("change"))


def overlay(base: DataFrame, over: DataFrame, key: str, column: str) -> DataFrame:
    """``over``'s values where it has any, else ``base``'s; keys of both."""
    return base.select(key, F.col(column).alias("__base")).join(over.select(key, F.col(column).alias("__over")), key, "full").select(key, F.coalesce("__over", "__base").alias(column))


def attempted_without_value(attempts: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    return attempts.join(values, on, "left_anti")


def wide_to_long(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """A row for each id and column that has a value."""
    return df.unpivot(ids, [F.col(c).cast("string").alias(c) for c in columns], "field", "value").where("value is not null")


def supersede(versions: DataFrame, key: str, start: str, end: str, status: str) -> DataFrame:
    """Closes every version at the start of the next of its key."""
    from pyspark.sql import Window

    following = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    return versions.withColumns({end: F.coalesce(following, F.col(end)), status: F.when(following.isNotNull(), "SUPERSEDED").otherwise(F.col(status))})


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``changes`` take the place of rows with their key; both have the same columns."""
    return table.join(changes, key, "left_anti").unionByName(changes)


def scoped(df: DataFrame, principal: dict, visible: list[str]) -> DataFrame:
    """The rows that belong to a principal, and of their columns those on the allow-list."""
    for column, value in principal.items():
        df = df.where(F.col(column).eqNullSafe(F.lit(value)))
    return df.select(*(c for c in visible if c in df.columns))
