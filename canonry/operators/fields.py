"""Field extraction from the recognised lines of labels, as one pass of native expressions.

A field has rules in order of trust. A rule has an anchor (a pattern that the line
must hold, or null), a value pattern whose first group is the value, the line it is
read from (the line itself or one of the next two), and a score. All rules run on
every line at once; candidates are then judged by the field's validator and ranked.
Patterns avoid look-around, so that other engines read them alike.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Rule(NamedTuple):
    field: str
    source: str
    anchor: str | None
    value: str
    offset: int
    score: float


_AMOUNT = r"([0-9][0-9,]{0,7}(?:\.[0-9]{1,2})?)"
_MONEY = r"(?i)(?:rs\.?|inr|₹)\s*" + _AMOUNT
_DAY = r"([0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}|[0-9]{1,2}[/.-][0-9]{4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ .-]*[0-9]{4})"
_MRP, _MFG, _BEST, _USE = r"(?i)m\.?\s?r\.?\s?p", r"(?i)mfg|mfd|manufactur(?:ed on|ing date)|packed on|pkd|date of (?:mfg|packing)", r"(?i)best before|bb\b", r"(?i)use by|expiry|exp\b|exp\.? date"
_CARE, _LICENCE, _MAKER = r"(?i)care|toll ?free|complaint|feedback|contact|helpline", r"(?i)fssai|lic(?:ence|ense)?\.? ?no", r"(?i)(?:manufactured|marketed|packed|mfd\.?|mktd\.?)(?: (?:and|&) \w+)? by"
#: The rules, by field and trust.
RULES = [
    Rule("mrp", "same_line", _MRP, _MONEY, 0, 6.0),
    Rule("mrp", "same_line_bare", _MRP, r"(?i)m\.?\s?r\.?\s?p\.?[^0-9]{0,12}" + _AMOUNT, 0, 5.0),
    Rule("mrp", "next_line", _MRP, _MONEY, 1, 4.0),
    Rule("mrp", "currency", None, r"(?i)(?:^|[^a-z])(?:rs\.?|₹)\s*" + _AMOUNT + r"\s*(?:/-|only|$)", 0, 2.0),
    Rule("quantity", "anchored", r"(?i)net\s*(?:wt|weight|qty|quantity|content|vol)", r"(?i)([0-9]+(?:\.[0-9]+)?\s*(?:kg|gm?|mg|ml|l|litre|pcs|nos))\b", 0, 3.0),
    Rule("quantity", "anchored_next", r"(?i)net\s*(?:wt|weight|qty|quantity|content|vol)", r"(?i)^\s*([0-9]+(?:\.[0-9]+)?\s*(?:kg|gm?|mg|ml|l|litre|pcs|nos))\b", 1, 2.0),
    Rule("manufacturing_date", "same_line", _MFG, r"(?i)" + _DAY, 0, 3.0),
    Rule("manufacturing_date", "next_line", _MFG, r"(?i)^\s*" + _DAY, 1, 2.0),
    Rule("use_by", "same_line", _USE, r"(?i)(?:use by|exp[a-z]*\.?)[^0-9a-z]*(?:date[^0-9a-z]*)?" + _DAY, 0, 3.0),
    Rule("best_before", "date", _BEST, r"(?i)(?:best before|bb)[^0-9a-z]*" + _DAY, 0, 3.0),
    Rule("best_before", "duration", _BEST, r"(?i)best before\s*:?\s*([0-9a-z]+ (?:days|weeks|months|years)[a-z ]*)", 0, 2.0),
    Rule("fssai_license", "same_line", _LICENCE, r"(?:^|[^0-9])([0-9](?: ?[0-9]){13})(?:[^0-9]|$)", 0, 3.0),
    Rule("fssai_license", "next_line", _LICENCE, r"^\D*([0-9](?: ?[0-9]){13})(?:[^0-9]|$)", 1, 2.0),
    Rule("consumer_care", "toll_free", None, r"(?:^|[^0-9])(1800[ -]?[0-9]{2,3}[ -]?[0-9]{3,4})(?:[^0-9]|$)", 0, 4.0),
    Rule("consumer_care", "country_code", None, r"(\+91[ -]?[6-9][0-9]{4}[ -]?[0-9]{5})(?:[^0-9]|$)", 0, 3.0),
    Rule("consumer_care", "mobile", _CARE, r"(?:^|[^0-9])([6-9][0-9]{9})(?:[^0-9]|$)", 0, 2.0),
    Rule("batch_lot", "same_line", r"(?i)batch|lot", r"(?i)(?:batch|lot)\s*(?:no\.?|number)?\s*[:.-]?\s*([A-Z0-9][A-Z0-9/-]{2,15})", 0, 2.0),
    Rule("manufacturer", "same_line", _MAKER, r"(?i)by\s*:?\s*([A-Z][^:]{3,79})$", 0, 3.0),
    Rule("manufacturer", "next_line", _MAKER + r"\s*:?\s*$", r"^\s*([A-Z][^:]{3,79})$", 1, 2.0),
    Rule("country_of_origin", "phrase", None, r"(?i)(?:country of origin|product of|made in)\s*:?\s*([A-Za-z]+)", 0, 3.0),
    Rule("unit_sale_price", "phrase", None, r"(?i)((?:rs\.?|₹)\s*[0-9.]+\s*(?:per|/)\s*(?:g|gm|kg|ml|l|unit|piece))", 0, 3.0),
    Rule("email", "any", None, r"([A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z])", 0, 3.0),
    Rule("website", "any", None, r"(?i)((?:https?://|www\.)[a-z0-9./-]+[a-z0-9])", 0, 3.0),
]
#: Nutrients of a panel and how each is written.
NUTRIENTS = {
    "energy": r"(?i)energy[^0-9]{0,20}([0-9.]+ ?(?:kcal|kj))", "protein": r"(?i)protein[^0-9]{0,12}([0-9.]+ ?g)", "carbohydrate": r"(?i)carbohydrates?[^0-9]{0,12}([0-9.]+ ?g)", "total_sugars": r"(?i)total sugars?[^0-9]{0,12}([0-9.]+ ?g)", "added_sugars": r"(?i)added sugars?[^0-9]{0,12}([0-9.]+ ?g)",
    "total_fat": r"(?i)total fat[^0-9]{0,12}([0-9.]+ ?g)", "saturated_fat": r"(?i)saturated fat[^0-9]{0,12}([0-9.]+ ?g)", "trans_fat": r"(?i)trans fat[^0-9]{0,12}([0-9.]+ ?g)", "cholesterol": r"(?i)cholesterol[^0-9]{0,12}([0-9.]+ ?mg)", "sodium": r"(?i)sodium[^0-9]{0,12}([0-9.]+ ?mg)",
}


def canonical(field: Column, value: Column) -> Column:
    """Amounts without separators, licences and phones as digits, the rest trimmed."""
    return F.when(field == "mrp", F.regexp_replace(value, ",", "")).when(field == "fssai_license", F.regexp_replace(value, "[^0-9]", "")).otherwise(F.trim(value))


def valid(field: Column, value: Column) -> Column:
    """Whether a value can be the field's."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    year = F.regexp_extract(value, "([0-9]{4})$", 1)
    return (
        F.when(field == "mrp", value.rlike(r"^[0-9]{1,5}(\.[0-9]{1,2})?$") & (F.expr("try_cast(value as double)") > 0))
        .when(field == "fssai_license", F.length(digits) == 14)
        .when(field == "consumer_care", F.length(digits).between(9, 12))
        .when(field.isin("manufacturing_date", "use_by"), (year == "") | year.between("1990", "2040"))
        .when(field == "email", value.rlike(r"^[^@]+@[^@]+\.[A-Za-z]{2,}$"))
        .otherwise(F.length(value) > 0)
    )


def candidates(lines: DataFrame, by: list[str]) -> DataFrame:
    """``field``, ``value``, ``source``, ``score``, ``line_no``, ``confidence`` of every rule that matches, from ``line_no``, ``text``, ``confidence``."""
    w = Window.partitionBy(*by).orderBy("line_no")
    at = {0: F.col("text"), 1: F.lead("text", 1).over(w), 2: F.lead("text", 2).over(w)}
    seen = lines.select(*by, "line_no", "confidence", *(c.alias(f"__t{k}") for k, c in at.items()))
    found = F.array(
        *(
            F.when(
                (F.col("__t0").rlike(r.anchor) if r.anchor else F.lit(True)) & F.col(f"__t{r.offset}").rlike(r.value),
                F.struct(F.lit(r.field).alias("field"), F.regexp_extract(f"__t{r.offset}", r.value, 1).alias("value"), F.lit(r.source).alias("source"), F.lit(r.score).alias("rule_score")),
            )
            for r in RULES
        )
    )
    out = seen.select(*by, "line_no", "confidence", F.inline(F.filter(found, lambda x: x.isNotNull())))
    out = out.withColumn("value", canonical(F.col("field"), F.col("value"))).where(valid(F.col("field"), F.col("value")))
    return out.withColumn("score", F.col("rule_score") + F.coalesce("confidence", F.lit(0.0))).drop("rule_score")


def best(cands: DataFrame, by: list[str], least: float = 0.6) -> DataFrame:
    """One row a field: the best value, up to five candidates, the fused confidence and the status.

    A value of two different candidates of nearly equal score, of low confidence or
    without an anchor asks for review.
    """
    once = cands.groupBy(*by, "field", "value").agg(F.max_by(F.struct("score", "source", "confidence", "line_no"), F.struct("score", F.negative("line_no"))).alias("b"))
    w = Window.partitionBy(*by, "field").orderBy(F.desc("b.score"), "b.line_no", "value")
    ranked = once.withColumns({"rank": F.row_number().over(w), "next": F.lead("b.score").over(w), "top": F.collect_list("value").over(w.rowsBetween(0, 4))}).where("rank = 1")
    anchored = ~F.col("b.source").isin("currency", "mobile", "any")
    fused = F.col("b.confidence") * F.when(anchored, 1.0).otherwise(0.7)
    close = F.coalesce(F.col("b.score") - F.col("next") < 0.5, F.lit(False))
    return ranked.select(*by, "field", "value", F.col("b.source").alias("source"), F.col("b.line_no").alias("line_no"), fused.alias("confidence"), "top", F.when(close | F.coalesce(fused < least, F.lit(True)), "NEEDS_REVIEW").otherwise("DETECTED").alias("status"))


def nutrition(lines: DataFrame, by: list[str]) -> DataFrame:
    """``nutrient``, ``amount``: the first line of each label that states it."""
    found = F.array(*(F.when(F.col("text").rlike(p), F.struct(F.lit(n).alias("nutrient"), F.regexp_extract("text", p, 1).alias("amount"))) for n, p in NUTRIENTS.items()))
    out = lines.select(*by, "line_no", F.inline(F.filter(found, lambda x: x.isNotNull())))
    return out.groupBy(*by, "nutrient").agg(F.min_by("amount", "line_no").alias("amount"))


def ingredients(texts: DataFrame, by: list[str], column: str = "text") -> DataFrame:
    """``ordinal``, ``name``, ``percent``, ``ins``, ``parts`` of a list of ingredients; commas within one level of brackets do not divide."""
    item = F.posexplode(F.split(F.regexp_replace(column, r"(?i)^\s*ingredients?\s*:?\s*", ""), r",(?![^(]*\))")).alias("ordinal", "item")
    out = texts.select(*by, item).withColumn("item", F.trim("item")).where("item <> ''")
    repaired = F.translate(F.regexp_extract("item", r"(?i)\b(?:ins|e)[ -]?([0-9OlI]{3,4}[a-f]?)", 1), "OlI", "011")
    name = F.trim(F.regexp_replace(F.regexp_replace("item", r"\(.*\)?", ""), r"[0-9.]+ ?%.*$|\.$", ""))
    parts = F.filter(F.transform(F.split(F.regexp_extract("item", r"\(([^)]*)\)", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    percent = F.expr("try_cast(regexp_extract(item, '([0-9]+(?:[.][0-9]+)?) ?%', 1) as double)")
    return out.select(*by, "ordinal", name.alias("name"), percent.alias("percent"), F.when(repaired != "", repaired).alias("ins"), parts.alias("parts"))
