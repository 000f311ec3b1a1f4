"""Which parts of an image deserve a closer look: regions around anchors, and a few proposals for what is unresolved.

Lines are rows with a box (``by``, ``line_no``, ``text``, ``x0 y0 x1 y1``, null without one). An image's regions come from one
aggregation: of each kind the first line that anchors it. Proposals have an order; kinds are unique, a find excludes
its fallback, and the first few within the budget are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boundaries, headings, panels, validators

#: Regions, what anchors them, and how far they grow sideways, up and down (in heights of the line) and by how much more.
ANCHORS = {
    "MRP": (validators.PRICE, 3.0, 1.2, 4.0), "DATE": (validators.DATE, 3.0, 1.2, 4.0), "FSSAI": (validators.LICENCE, 3.0, 1.2, 4.0), "CONSUMER_CARE": (boundaries.CARE, 3.0, 1.2, 4.0), "NUTRITION": (boundaries.NUTRITION, 1.5, 1.5, 6.0),
    "BATCH": (validators.BATCH, 3.0, 1.2, 4.0), "QUANTITY": (validators.NET, 4.0, 1.5, 6.0), "STORAGE": ("storage|store in|keep in", 3.0, 1.2, 4.0), "PREPARATION": ("prepar|directions for use|how to", 3.0, 1.2, 4.0), "MARKETING": ("tasty|delicious|new pack|offer", 3.0, 1.2, 4.0),
}
MAKER, MAKER_GROWS = validators.MAKER, 4.0
BAND = 0.45
#: The regions of a field's evidence, in order of preference.
FIELD_REGIONS = {
    "mrp": ["MRP"], "manufacturing_date": ["DATE"], "fssai_license": ["FSSAI"], "consumer_care": ["CONSUMER_CARE"], "batch_lot": ["BATCH"], "manufacturer": ["MANUFACTURER"], "quantity": ["QUANTITY"], "ingredients": ["INGREDIENTS"], "allergens": ["INGREDIENTS"], "protein": ["NUTRITION"], "sodium": ["NUTRITION"],
}


def _rect(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A rectangle clipped to its frame."""
    clip = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most))
    return F.struct(clip(x0, width).alias("x0"), clip(y0, height).alias("y0"), clip(x1, width).alias("x1"), clip(y1, height).alias("y1"))


def _grown(x: float, y: float, more: float, width: Column, height: Column) -> Column:
    h = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    return _rect(F.col("x0") - h * x, F.col("y0") - h * y - more, F.col("x1") + h * x, F.col("y1") + h * y + more, width, height)


def anchored(lines: DataFrame, by: list[str], width: Column, height: Column) -> DataFrame:
    """``by``, ``region``, ``line_no``, ``anchor`` and the rectangle (``x0 y0 x1 y1``) of each kind of region that an image has an anchor of; the first anchor counts."""
    h = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    text = F.col("text")
    one = lambda name, when, rect: F.when(when, F.struct(F.lit(name).alias("region"), rect.alias("rect")))
    kinds = [one(name, validators.has(text, p), _grown(x, y, more, width, height)) for name, (p, x, y, more) in ANCHORS.items()]
    kinds.append(one("MANUFACTURER", validators.has(text, MAKER), _rect(F.col("x0") - h * MAKER_GROWS, F.col("y0"), F.col("x1") + h * MAKER_GROWS, F.col("y1") + h * MAKER_GROWS, width, height)))
    kinds.append(one("INGREDIENTS", validators.has(text, f"{headings.BARE}|{headings.COLON}"), _rect(F.lit(0.0), F.col("y1"), width, F.col("y1") + BAND * height, width, height)))
    found = lines.where(F.col("x0").isNotNull()).select(*by, "line_no", F.substring("text", 1, 60).alias("anchor"), F.inline(F.filter(F.array(*kinds), lambda k: k.isNotNull())))
    first = found.groupBy(*by, "region").agg(F.min_by(F.struct("line_no", "anchor", "rect"), "line_no").alias("b"))
    return first.select(*by, "region", "b.line_no", "b.anchor", "b.rect.*")


def field_region(regions: DataFrame, by: list[str]) -> DataFrame:
    """For each field the region of its evidence that comes first by preference: ``by``, ``field``, ``region`` and its rectangle."""
    wanted = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(r).alias("region"), F.lit(i).alias("place")) for f, rs in FIELD_REGIONS.items() for i, r in enumerate(rs)))
    met = regions.select(*by, F.col("region").alias("__r"), "x0", "y0", "x1", "y1", F.inline(wanted)).where(F.col("__r") == F.col("region"))
    return met.groupBy(*by, "field").agg(F.min_by(F.struct("region", "x0", "y0", "x1", "y1"), "place").alias("b")).select(*by, "field", "b.*")


def proposals(lines: DataFrame, by: list[str], heading: Column, front: Column, resolved: Column, width: Column, height: Column, budget: int = 3, cap: float = 0.30) -> DataFrame:
    """At most ``budget`` looks an image, in order: ``by``, ``place`` (from 0), ``kind`` and the rectangle.

    Ingredients below the first ``heading`` (to the next section, at most ``cap`` of the height); price, date, licence and care around their first
    anchor, if not in ``resolved`` (an array of fields); where there is none, the lower part for a price and a bare run of 14 digits for a licence; without ingredients the
    densest band. A front has neither of the two last bands.
    """
    told = boundaries.decided(lines.where(F.col("x0").isNotNull()), "text").withColumns({"__heading": heading, "__front": front, "__resolved": resolved, "__w": width, "__h": height})
    w, h = F.col("__w"), F.col("__h")
    asks = lambda f: ~F.array_contains("__resolved", f)
    text = F.col("text")

    def around(k: float, more: float, side: float, below: float) -> Column:
        pad = (F.col("y1") - F.col("y0")) * k + more
        return _rect(F.col("x0") - pad * side, F.col("y0") - pad, F.col("x1") + pad * side, F.col("y1") + pad * below, w, h)

    first = lambda when, what: F.min_by(what, F.when(when, F.col("line_no")))
    small = around(1.2, 4.0, 3.0, 1.0)
    price, date, licence = validators.has(text, validators.PRICE), validators.has(text, boundaries.MADE_ON), validators.has(text, validators.LICENCE)
    run = F.char_length(F.regexp_replace(text, r"\D", "")) == 14
    care = validators.has(text, boundaries.CARE)
    got = told.groupBy(*by).agg(
        first(F.col("__heading"), F.struct("line_no", "y1")).alias("head"), first(price & asks("mrp"), small).alias("mrp"), first(date & asks("manufacturing_date"), small).alias("mfg_date"),
        F.coalesce(first(licence & asks("fssai_license"), small), first(run & asks("fssai_license"), small)).alias("fssai"), first(care & asks("consumer_care"), around(1.5, 6.0, 4.0, 2.0)).alias("care"),
        F.bool_or("__front").alias("front"), F.bool_or(asks("mrp")).alias("asks_mrp"), F.max("__w").alias("w"), F.max("__h").alias("h"),
    )
    heads = got.where("head is not null").select(*by, F.col("head.line_no").alias("__n"), F.col("head.y1").alias("__y"))
    stop = told.join(heads, by).where(F.col("boundary").isNotNull() & (F.col("line_no") > F.col("__n")) & (F.col("line_no") <= F.col("__n") + 7) & (F.col("y0") > F.col("__y"))).groupBy(*by).agg(F.min_by("y0", "line_no").alias("stop"))
    dense = panels.dense_band(told.select(*by, F.col("y0").alias("top"), F.col("y1").alias("bottom"), "text", "__h"), by, F.char_length("text") / F.greatest(F.lit(1.0), F.col("bottom") - F.col("top")), F.col("__h")).select(*by, F.col("top").alias("__top"), F.col("bottom").alias("__bottom"))
    whole = got.join(stop, by, "left").join(dense, by, "left")
    wide, high = F.col("w"), F.col("h")
    below = _rect(F.lit(0.0), F.col("head.y1"), wide, F.least(F.coalesce("stop", high), F.col("head.y1") + cap * high), wide, high)
    side = ~F.coalesce("front", F.lit(False))
    kinds = {
        "ingredients": F.when(F.col("head").isNotNull(), below), "mrp": F.coalesce(F.col("mrp"), F.when(side & F.col("asks_mrp"), _rect(F.lit(0.0), high * 0.55, wide, high, wide, high))), "mfg_date": F.col("mfg_date"), "fssai": F.col("fssai"), "care": F.col("care"),
        "ingredients-scan": F.when(F.col("head").isNull() & side & F.col("__top").isNotNull(), _rect(F.lit(0.0), F.col("__top"), wide, F.col("__bottom"), wide, high)),
    }
    chosen = F.slice(F.filter(F.array(*(F.when(r.isNotNull(), F.struct(F.lit(k).alias("kind"), r.alias("rect"))) for k, r in kinds.items())), lambda x: x.isNotNull()), 1, budget)
    return whole.select(*by, F.posexplode(chosen).alias("place", "x")).select(*by, "place", "x.kind", "x.rect.*")
