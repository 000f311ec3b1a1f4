"""Planning of further looks at images: which fields in which groups, which rectangles, and what their text is good for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import headings

#: Signs of an address, and of declarations that a scan for ingredients may have caught instead.
ADDRESS = r"\b\d{6}\b|road|street|nagar|gali|plot|phase|estate|area|district|state|india|tel\b|phone|limited|ltd|pvt|works|factory|plant"
MARKERS = (r"fssai|lic\.?\s*no|licence|license", r"\bm\.?\s*r\.?\s*p\b|maximum\s+retail\s+price", r"\bmfd\b|\bmfg\b|\bpkd\b|manufactured\s+by", r"\d[\d\s]{12,20}\d")
#: What opens a business block, and the words that tell its role, in the order in which they are tried; else it is the manufacturer's.
MAKER = r"manufactured(?:\s*&\s*marketed)?(?:\s*/\s*packed)?\s+by|marketed by|packed by|mfd\.?\s+by|mkd\.?\s+by|mfg\.?\s+by|imported by"
ROLE_WORDS = {"import": "IMPORTER", "market": "MARKETER", "pack": "PACKER"}


def _has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?i)(?:{pattern})"), F.lit(False))


def wanted_groups(df: DataFrame, groups: dict[str, list[str]], required: Column, resolved: Column, valued: list[str], most: int = 6) -> DataFrame:
    """``df`` with ``wanted`` (fields not resolved that are required or of high value, in the groups' order) and ``groups`` (those with any, at most ``most``)."""
    asked = lambda f: ~F.array_contains(resolved, f) & (F.array_contains(required, f) | F.lit(f in valued))
    members = list(dict.fromkeys(f for fs in groups.values() for f in fs))
    known = F.filter(F.array(*(F.when(asked(f), F.lit(f)) for f in members)), lambda x: x.isNotNull())
    rest = F.array_sort(F.array_except(F.array_except(required, F.array(*map(F.lit, members))), resolved))
    with_any = F.filter(F.array(*(F.when(F.arrays_overlap(F.col("wanted"), F.array(*map(F.lit, fs))), F.lit(g)) for g, fs in groups.items()), F.when(F.size(rest) > 0, "other")), lambda x: x.isNotNull())
    return df.withColumn("wanted", F.array_distinct(F.concat(known, rest))).withColumn("groups", F.slice(with_any, 1, most))


def padded(x0: Column, y0: Column, x1: Column, y1: Column, pad: float, width: Column, height: Column) -> Column:
    """A rectangle grown by a share of its own height on each side and clipped to the frame."""
    by = (y1 - y0) * pad
    return F.struct(F.greatest(F.lit(0.0), x0 - by).alias("x0"), F.greatest(F.lit(0.0), y0 - by).alias("y0"), F.least(width, x1 + by).alias("x1"), F.least(height, y1 + by).alias("y1"))


def tightened(a: Column, panel: Column, least: float = 0.4) -> Column:
    """A rectangle cut to the panel where at least ``least`` of it lies inside; else as it was."""
    edge = {"x0": F.greatest(a["x0"], panel["x0"]), "y0": F.greatest(a["y0"], panel["y0"]), "x1": F.least(a["x1"], panel["x1"]), "y1": F.least(a["y1"], panel["y1"])}
    inside = F.greatest(F.lit(0.0), edge["x1"] - edge["x0"]) * F.greatest(F.lit(0.0), edge["y1"] - edge["y0"])
    whole = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.when((whole > 0) & (inside >= least * whole), F.struct(*(v.alias(k) for k, v in edge.items()))).otherwise(a)


def business_blocks(docs: DataFrame, id_: str, text: str, reach: int = 3) -> DataFrame:
    """Each line that names who made, packed, sold or imported, its role, and the lines after it while they read like an address."""
    found = F.filter(F.transform("__lines", lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), F.slice("__lines", i + 2, reach).alias("__after"))), lambda x: _has(x["line"], MAKER))
    lines = docs.select(id_, F.split(text, "\n").alias("__lines")).select(id_, F.inline(found))
    low, role = F.lower("line"), F
    for word, name in ROLE_WORDS.items():
        role = role.when(F.contains(low, F.lit(word)), name)
    after = F.col("__after")
    stop = F.array_position(F.transform(after, lambda x: ~_has(x, ADDRESS)), True).cast("int")
    own = F.when(stop > 0, F.slice(after, 1, stop - 1)).otherwise(after)
    return lines.select(id_, "line_no", role.otherwise("MANUFACTURER").alias("role"), F.array_join(F.concat(F.array("line"), own), " ").alias("block"))


def usable_scan(text: Column, score: Column, least: float = 0.70) -> Column:
    """Whether a scan without a heading may join the evidence: some food in it, and no block of declarations unless it reads well."""
    markers = sum((F.when(_has(text, m), 1).otherwise(0) for m in MARKERS), F.lit(0))
    return F.coalesce((F.trim(text) != "") & (headings.words_in(text, headings.FOOD) > 0) & ~((markers >= 2) & (F.coalesce(score, F.lit(0.0)) < least)), F.lit(False))


def accepted_lines(lines: DataFrame, line: str, context: str) -> DataFrame:
    """Lines of a list of ingredients with ``accepted`` and, for the others, the section that they belong to."""
    opens = headings.boundary(F.col(line), F.col(context))
    return lines.withColumn("section", F.when(opens != "INGREDIENTS", opens)).withColumn("accepted", F.col("section").isNull() & (F.trim(line) != ""))
