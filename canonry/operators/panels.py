"""Operators on lines, boxes and readings of many images: blocks, bands, choices, roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_values(lines: DataFrame, by: list[str], line: str, heading: Column, value_only: Column, stop: Column, most: int = 16) -> DataFrame:
    """Rows of the table under the first heading: at most ``most`` lines up to a stop, those of a value alone joined to the row before.

    Returns ``by``, ``row``, ``text``; input: ``by``, ``line`` (a number), ``text``.
    """
    head = lines.groupBy(*by).agg(F.min(F.when(heading, F.col(line))).alias("__head")).where("__head is not null")
    own = lines.join(head, by).where((F.col(line) >= F.col("__head")) & (F.col(line) <= F.col("__head") + most))
    ends = own.groupBy(*by).agg(F.min(F.when(stop & (F.col(line) > F.col("__head")), F.col(line))).alias("__end"))
    block = own.join(ends, by).where(F.col("__end").isNull() | (F.col(line) < F.col("__end")))
    w = Window.partitionBy(*by).orderBy(line)
    numbered = block.withColumn("row", F.sum(F.when(value_only & (F.col(line) > F.col("__head")), 0).otherwise(1)).over(w))
    return numbered.groupBy(*by, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(line), "text"))), lambda x: x["text"]), " ").alias("text"))


def rejoin(lines: DataFrame, by: list[str], line: str) -> DataFrame:
    """Lines with words that a hyphen at the end of a line cuts put together again: ``by``, ``line`` (the first), ``text``."""
    w = Window.partitionBy(*by).orderBy(line)
    before = F.lag("text").over(w)
    grouped = lines.withColumn("__new", F.when(F.coalesce(before.rlike(r"[A-Za-z]-$"), F.lit(False)) & F.col("text").rlike("^[a-z]"), 0).otherwise(1)).withColumn("__group", F.sum("__new").over(w))
    parts = grouped.groupBy(*by, "__group").agg(F.array_sort(F.collect_list(F.struct(F.col(line).alias("n"), "text"))).alias("__parts"))
    joined = F.aggregate("__parts", F.lit(""), lambda acc, x: F.concat(F.regexp_replace(acc, "-$", ""), x["text"]))
    return parts.select(*by, F.col("__parts")[0]["n"].alias(line), joined.alias("text"))


def prominence(boxes: DataFrame, by: list[str], area: Column) -> DataFrame:
    """Each box's area relative to the largest of its image, as ``prominence``; 0 where none has an area."""
    return boxes.withColumn("prominence", F.coalesce(F.try_divide(area, F.max(area).over(Window.partitionBy(*by))), F.lit(0.0)))


def bands(intervals: DataFrame, by: list[str], top: str, bottom: str, keep: int = 2) -> DataFrame:
    """Padded intervals (by 1.5 heights and 4) merged where they touch; the ``keep`` tallest, ties to the topmost."""
    height = F.greatest(F.col(bottom) - F.col(top), F.lit(1.0))
    padded = intervals.select(*by, (F.col(top) - 1.5 * height - 4).alias("__a"), (F.col(bottom) + 1.5 * height + 4).alias("__b"))
    w = Window.partitionBy(*by).orderBy("__a", "__b")
    far = F.max("__b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = padded.withColumn("__far", far).withColumn("__island", F.sum(F.when(F.col("__a") <= F.col("__far"), 0).otherwise(1)).over(w))
    merged = numbered.groupBy(*by, "__island").agg(F.min("__a").alias("top"), F.max("__b").alias("bottom"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.col("bottom") - F.col("top")), "top"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= keep).drop("__island")


def dense_band(lines: DataFrame, by: list[str], density: Column, frame: Column, keep: int = 4) -> DataFrame:
    """The envelope of the densest lines (``top``, ``bottom``), padded, within the frame and at most half of it high."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("__density"), "top", "bottom"))
    best = lines.withColumn("__density", density).withColumn("__frame", frame).withColumn("__rank", rank).where(F.col("__rank") <= keep)
    found = best.groupBy(*by).agg(F.min("top").alias("a"), F.max("bottom").alias("b"), F.max("__frame").alias("h"))
    pad = (F.col("b") - F.col("a")) * 0.4 + 6
    found = found.select(*by, "h", F.greatest(F.lit(0.0), F.col("a") - pad).alias("top"), F.least(F.col("h"), F.col("b") + pad).alias("bottom"))
    return found.select(*by, "top", F.least("bottom", F.col("top") + F.col("h") * 0.5).alias("bottom")).where(F.col("bottom") - F.col("top") >= 8)


def pick_heading(lines: DataFrame, by: list[str], line: str, strong: Column, weak: Column) -> DataFrame:
    """The first strong opener, else the first weak one: ``by``, ``line``, ``kind``."""
    first = lines.groupBy(*by).agg(F.min(F.when(strong, F.col(line))).alias("s"), F.min(F.when(weak, F.col(line))).alias("w"))
    return first.where("s is not null or w is not null").select(*by, F.coalesce("s", "w").alias(line), F.when(F.col("s").isNotNull(), "strong").otherwise("weak").alias("kind"))


def vote(grades: list[Column], deciding: Column) -> Column:
    """POOR if two grades or the deciding one are; FAIR if any is POOR or FAIR; else GOOD."""
    poor = sum((F.when(g == "POOR", 1).otherwise(0) for g in grades), F.lit(0))
    worse = reduce(lambda a, b: a | b, (F.coalesce(g.isin("POOR", "FAIR"), F.lit(False)) for g in grades))
    return F.when((poor >= 2) | F.coalesce(deciding == "POOR", F.lit(False)), "POOR").when(worse, "FAIR").otherwise("GOOD")


def timings(regions: DataFrame, by: list[str], kind: str, engine: str, ms: str) -> DataFrame:
    """Milliseconds by kind of region and engine."""
    own = F.col(kind).startswith("ingredients")
    total = lambda when: F.sum(F.when(when, F.col(ms)).otherwise(0.0))
    return regions.groupBy(*by).agg(total(own).alias("ingredient_ms"), total(~own).alias("declaration_ms"), total(F.col(engine) == "tesseract").alias("fallback_ms"), F.sum(ms).alias("total_ms"))


def call_accounting(calls: DataFrame, by: list[str], image: str, provider: str, budget: int = 5) -> DataFrame:
    """Calls by provider, and whether every image kept within the budget."""
    each = calls.groupBy(*by, image).agg(F.count("*").alias("__n"), F.count_if(F.col(provider) == "tesseract").alias("__t"))
    return each.groupBy(*by).agg(F.sum("__n").alias("calls"), F.sum("__t").alias("tesseract_calls"), F.max("__n").alias("most"), F.bool_and(F.col("__n") <= budget).alias("budget_respected"))


def provenance(tags: DataFrame, by: list[str], variant: str, reason: str, uncertain: str) -> DataFrame:
    """Where a text comes from as a whole, whether any part is uncertain, and the distinct reasons in order."""
    v = F.col(variant)
    got = tags.groupBy(*by).agg(
        F.bool_or(v == "hybrid").alias("h"), F.bool_or(v == "tesseract").alias("t"), F.bool_or(v.startswith("v")).alias("r"),
        F.bool_or(F.col(uncertain)).alias("uncertain"), F.array_join(F.sort_array(F.collect_set(reason)), ",").alias("reasons"),
    )
    return got.select(*by, F.when(F.col("h") | (F.col("t") & F.col("r")), "hybrid").when(F.col("t"), "tesseract").otherwise("rapidocr").alias("source"), "uncertain", "reasons")


def first_by_role(images: DataFrame, by: list[str], role: Column, priority: list[str], order: str, evidence: Column) -> DataFrame:
    """Of images with evidence, the one whose role comes first; roles off the list last, ties by upload order."""
    place = F.array_position(F.array(*map(F.lit, priority)), role)
    rank = F.struct(F.when(place > 0, place).otherwise(len(priority) + 1).alias("rank"), F.col(order).alias("order"))
    own = images.withColumn("__rank", rank).where(evidence)
    best = own.groupBy(*by).agg(F.min_by(F.struct(F.col(order).alias("image"), role.alias("role")), "__rank").alias("best"))
    return best.select(*by, "best.image", "best.role")


def distinct_payloads(payloads: DataFrame, by: list[str], digest: Column, preference: list, keep: int) -> DataFrame:
    """Payloads without repeats, by preference, the first ``keep``."""
    once = payloads.withColumn("__d", digest).withColumn("__first", F.row_number().over(Window.partitionBy(*by, "__d").orderBy(*preference))).where("__first = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*preference))).where(F.col("place") <= keep).drop("__d", "__first")


def context_text(docs: DataFrame, by: list[str], text: str, most_lines: int = 60, most_chars: int = 3000) -> DataFrame:
    """The first lines of each image's text as one of bounded size, with how many were left out: within the row, no shuffle."""
    laid = docs.where(F.col(text).isNotNull()).select(*by, F.split(text, "\n").alias("__lines"))
    kept = F.array_join(F.slice("__lines", 1, most_lines), "\n")
    return laid.select(*by, F.substring(kept, 1, most_chars).alias("text"), F.greatest(F.lit(0), F.size("__lines") - most_lines).cast("long").alias("left_out"))


def table_evidence(boxes: DataFrame, rectangles: DataFrame, by: list[str], numeric: Column, least: int = 3, share: float = 0.25) -> DataFrame:
    """Share of numeric boxes by their middle inside a rectangle (``x0 y0 x1 y1``), and whether it looks like a table."""
    inside = (F.col("cx") >= F.col("x0")) & (F.col("cx") <= F.col("x1")) & (F.col("cy") >= F.col("y0")) & (F.col("cy") <= F.col("y1"))
    found = boxes.withColumn("__numeric", numeric).join(rectangles, by).where(inside).groupBy(*by, "rectangle").agg(F.count("*").alias("boxes"), F.count_if("__numeric").alias("numeric"))
    return found.withColumn("table", (F.col("boxes") >= least) & (F.col("numeric") >= share * F.col("boxes")))


def symbol_matrix(cv: Column, vision: Column, available: Column) -> Column:
    """What two readings of a symbol amount to; a disagreement is never settled here."""
    known = lambda c: F.coalesce(c.isin("VEGETARIAN", "NON_VEGETARIAN"), F.lit(False))
    return (
        F.when(~available, F.when(known(cv), "CV_ONLY").otherwise("NOT_DETECTED"))
        .when(known(cv) & known(vision), F.when(cv == vision, "AI_CV_VERIFIED").otherwise("CONFLICT_REVIEW"))
        .when(known(vision), "AI_EXTRACTED_REVIEW")
        .when(known(cv), "CV_ONLY")
        .otherwise("NOT_DETECTED")
    )


def labelled_values(row: DataFrame, by: list[str], labels: list[tuple[str, list[str]]]) -> DataFrame:
    """One row a label: the first of its columns, in order, that isn't empty; labels without any are left out."""
    filled = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string"))
    laid = row.select(*by, F.posexplode(F.array(*(F.struct(F.lit(name).alias("label"), F.coalesce(*map(filled, columns)).alias("value")) for name, columns in labels))).alias("ordinal", "x"))
    return laid.where("x.value is not null").select(*by, "ordinal", "x.label", "x.value")


def decision_summary(findings: DataFrame, by: list[str]) -> DataFrame:
    """Counts of verdicts put in words: what failed, what needs review, what passed."""
    n = findings.groupBy(*by).agg(*(F.count_if(F.col("result") == r).alias(r) for r in ("FAIL", "NEEDS_REVIEW", "PASS")))
    part = lambda c, word: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {word}")))
    return n.select(*by, F.concat_ws(", ", part("FAIL", "failed"), part("NEEDS_REVIEW", "to review"), part("PASS", "passed")).alias("summary"))


def namesakes(rows: DataFrame, others: DataFrame, name: str, at: str, key: str, newest: int = 25) -> DataFrame:
    """For each row, those of the ``newest`` others that bear the same name, letter case aside."""
    top = others.orderBy(F.desc(at), key).limit(newest).select(F.lower(name).alias("__name"), F.col(key).alias("other"), F.col(at).alias("other_at"))
    return rows.withColumn("__name", F.lower(name)).join(F.broadcast(top), "__name").where(F.col(key) != F.col("other")).drop("__name")


def evidence_line(hits: DataFrame, lines: DataFrame, by: list[str], value: str) -> DataFrame:
    """The line behind a hit: that of the same box, else the first that holds the value."""
    same = hits.join(lines, by).withColumn("__rank", F.when(F.col("box").eqNullSafe(F.col("line_box")), 0).when(F.contains("text", F.col(value)), 1))
    best = same.where("__rank is not null").groupBy(*by, value).agg(F.min_by("text", F.struct("__rank", "line_no")).alias("evidence"), F.min("__rank").alias("__r"))
    return best.select(*by, value, "evidence", F.when(F.col("__r") == 0, "box").otherwise("text").alias("found_by"))


def created_events(rows: DataFrame, key: str, at: str, status: Column) -> DataFrame:
    """The first entry of each row's log: it came into being with a status."""
    return rows.select(F.col(key).alias("entity_id"), F.lit("CREATED").alias("event"), F.lit(None).cast("string").alias("old_status"), status.alias("new_status"), F.col(at).alias("at"))


def text_mass(lines: DataFrame, by: list[str], column: str, text: str, top: str) -> DataFrame:
    """Characters by column, and the column with most of them; ties to the topmost, then the smaller."""
    mass = lines.groupBy(*by, column).agg(F.sum(F.char_length(F.coalesce(F.col(text), F.lit("")))).alias("mass"), F.min(top).alias("top"))
    best = F.max_by(F.struct(column, "mass"), F.struct("mass", (-F.col("top")).alias("up"), (-F.col(column)).alias("small")))
    return mass.groupBy(*by).agg(best.alias("best"), F.count("*").alias("columns")).select(*by, f"best.{column}", "best.mass", "columns")


def new_rows(current: DataFrame, offered: DataFrame, key: list[str]) -> DataFrame:
    """What an insert-only sync adds: offered rows whose key isn't there, once each; what is there stays as it is."""
    once = offered.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*(c for c in offered.columns if c not in key)))).where("__n = 1").drop("__n")
    return once.join(current.select(*key), key, "left_anti")


def golden(path_rows: DataFrame, fields: list[str]) -> DataFrame:
    """Expected values of products that a person verified, one row a field that has one; rows that can't be read are left out."""
    own = path_rows.where(F.coalesce(F.col("verified"), F.lit(False)) & F.col("product_id").isNotNull())
    laid = own.select("product_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"expected.{f}").cast("string").alias("value")) for f in fields))).alias("x"))
    return laid.select("product_id", "x.field", "x.value").where("value is not null")


def golden_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """Counts of matches over scored fields (``expected``, ``extracted``, ``needs_review``), and the shares covered and to review."""
    norm = lambda c: F.lower(F.regexp_replace(F.trim(F.coalesce(F.col(c), F.lit(""))), r"\s+", " "))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '[0-9]+(?:[.][0-9]+)?', 0) as double)")
    share = lambda c: F.coalesce(F.try_divide(F.count_if(c).cast("double"), F.count("*").cast("double")), F.lit(0.0))
    return scored.groupBy(*by).agg(
        F.count("*").alias("n_scored"), F.count_if(F.col("expected") == F.col("extracted")).alias("exact_matches"), F.count_if((norm("expected") == norm("extracted")) & F.col("extracted").isNotNull()).alias("normalized_matches"),
        F.count_if(number("expected") == number("extracted")).alias("value_matches"), share(F.col("extracted").isNotNull()).alias("extraction_coverage"), share(F.col("needs_review")).alias("needs_review_rate"),
    )


#: Groups of fields: the order of roles, the kinds of evidence that decide (a group without any goes by its label), and the label taken where none has evidence.
GROUPS = {
    "A_product": (["FRONT", "BACK", "SIDE", "UNKNOWN"], [], "front"), "B_declarations": (["BACK", "SIDE", "FRONT", "UNKNOWN"], [["mrp", "date"]], "back"), "C_business": (["BACK", "SIDE", "UNKNOWN"], [["fssai", "care"]], "back"),
    "D_ingredients": (["BACK", "SIDE", "UNKNOWN"], [["heading"]], "back"), "E_nutrition": (["BACK", "SIDE", "UNKNOWN"], [["nutrition"], ["heading"]], "back"), "F_symbols": (["FRONT", "BACK", "UNKNOWN"], [], "front"),
}


def image_for_groups(images: DataFrame, by: list[str], groups: dict = GROUPS) -> DataFrame:
    """For each group of fields the image to look at: ``by``, ``group``, ``image``, ``why`` (evidence, label or upload).

    ``images`` have ``image`` (a label), ``order`` (of upload), ``role`` and ``evidence`` (an array of kinds). The first image by role and then upload that has evidence of
    the group's first kind wins, then of its next; else the one with the group's label; else the first upload. One aggregation over all images.
    """
    best = []
    for name, (roles, kinds, label) in groups.items():
        place = F.array_position(F.array(*map(F.lit, roles)), F.coalesce("role", F.lit("UNKNOWN")))
        steps = [(F.arrays_overlap(F.coalesce("evidence", F.array().cast("array<string>")), F.array(*map(F.lit, k))), "evidence") for k in kinds] + [(F.col("image") == label, "label"), (F.lit(True), "upload")]
        case = F
        for i, (when, why) in enumerate(steps):
            case = case.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(i).alias("step"), F.lit(why).alias("why")))
        rank = F.when(case["why"] != "evidence", 0).when(place > 0, place).otherwise(len(roles) + 1)
        best.append(F.struct(F.lit(name).alias("group"), F.min_by(F.struct("image", case["why"].alias("why")), F.struct(case["step"].alias("step"), rank.alias("rank"), F.col("order"))).alias("b")))
    return images.groupBy(*by).agg(F.array(*best).alias("__g")).select(*by, F.inline("__g")).select(*by, "group", "b.image", "b.why")
