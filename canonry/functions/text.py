"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_key(c: Column) -> Column:
    """A code for comparison: upper case, letters and digits only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def contains_any_case(part: str, *columns: Column) -> Column:
    """The part occurs in the joined columns, whatever the case; % and _ mean themselves."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(part.lower()))


def masked(c: Column) -> Column:
    """The first three characters, the rest hidden."""
    return F.when(F.length(c) > 3, F.concat(F.substring(c, 1, 3), F.lit("***"))).otherwise(F.lit("***"))


def name_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def check_digit_ok(c: Column) -> Column:
    """The mod-10 checksum of barcodes: weights 1 and 3 from the right."""
    digits = F.transform(F.split(F.reverse(c.cast("string")), ""), lambda d: d.cast("int"))
    weighted = F.transform(digits, lambda d, i: d * F.when(i % 2 == 0, 1).otherwise(3))
    return F.aggregate(weighted, F.lit(0), lambda a, d: a + d) % 10 == 0


def unit_confidence(c: Column) -> Column:
    """A confidence outside 0 to 1 is none."""
    return F.when(c.between(0, 1), c)


def percent_confidence(c: Column) -> Column:
    """Confidences given in percent become shares; all are held between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(c > 1, c / 100).otherwise(c)))


def request_key(*columns: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16)


def emails(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]"), F.lit(0))


def digit_runs(c: Column, least: int) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[0-9]{{{least},}}"), F.lit(0))
