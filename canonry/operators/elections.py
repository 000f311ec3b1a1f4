"""Readings of many boxes elected to one answer: paragraphs, names, prices and quantities, with the evidence of places.

Boxes are rows (``by`` names a package or image, ``line_no``, ``text``, ``confidence``, ``x0 y0 x1 y1``; a null ``x0`` is no box).
Candidates come from several sources at once: a line, its neighbours in order, and boxes
near an anchor. Each source is a projection or an equi-join on the package; their union is scored and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boundaries

#: What leads to a price, clean or as recognition damages it, currencies, and what follows a number that is no price.
PRICE_WORD = r"(?:m\s*\.?\s*r\s*\.?\s*p\s*\.?|maximum\s+retail\s+price)"
PRICE_CONTEXT = r"m\s*\.?\s*r\s*\.?\s*p\s*\.?|maximum\s+retail\s+price|max\s+retail\s+price|retail\s+price|incl\.?\s*of\s*all\s*taxes|inclusive\s*of\s*all\s*taxes"
DAMAGED_PRICE_WORD = r"(?:m[rn][pf]|max[i1]mum\s+retail\s+price|max\s+retail\s+price|pr[i1l]ce)"
CURRENCY = r"rs\.?|inr|₹"
NUMBER = r"([\d,]+(?:\.\d{1,2})?)(.{0,12})"
WORDED = rf"(?i){PRICE_WORD}[^0-9]{{0,40}}?(?:{CURRENCY})?\s*{NUMBER}"
BARE = [rf"₹\s*{NUMBER}", rf"(?i)\br(?:s|5)\.?\s*{NUMBER}"]
DAMAGED = rf"(?i){DAMAGED_PRICE_WORD}[^0-9]{{0,40}}?(?:{CURRENCY})\s*{NUMBER}"
DATE_TAIL, WEIGHT_TAIL = r"^[/\-.]\d", r"(?i)^\s*(?:kg|kgs|gms?|gm|g|mg|ml|ltr?s?|litres?|pcs?|nos?)\b"
#: Amounts with units, what leads to them, what counts something else, and a digit read for a unit.
AMOUNT = r"(?i)(\d+(?:[.,]\d+)?)\s*(kg|kgs|kilo(?:gram)?s?|gram(?:me)?s?|gms?|gm|g|mg|ml|ltr(?:s)?|ltr|l|litre|liter|pcs?|nos?|numbers?)\b"
NET = r"(?i)\bnet\b|\bqty\b|quantity|weight|\bwt\b|contents?\b|pack\s*contains|pack\s*size|net\s*contents?|e-mark|℮|net\s*wt\.?|wei[i1l]ght|quanlity|netwt"
NET_LOOSE = r"(?i)net|qty|quantity|weight|contents?"
COUNTS = r"(?i)servings?|serves?\b|serve\b|pack\s*of|packets?|per\s*serv|prepar|per\s*100|nutrition|energy|protein|makes\s+\d|yields\s+\d"
DIGIT_UNIT = r"(\d+(?:[.,]\d+)?)\s*([96])(?:[^0-9]|$)"
#: A name is none of these, whole or in part; and words of categories.
VETO = (
    "transfat totalfat saturatedfat energy protein carbohydrate carbohydrates sugars ingredients nutrition fssai mrp manufactured packed weight license licence batch lot mfd servingsize calories "
    "expiry serving servings directions storage"
).split()
VETO_PARTS = (
    "transfat totalfat saturatedfat netweight netwt netquantity bestbefore useby consumercare customercare maximumretailprice ingredients nutrition manufacturedby manufacturedfor packedby mfdby batchno lotno "
    "licenceno fssai helpline servingsize servingper howtouse directionsforuse storageinstructions keepincool storeincool marketingclaim newpack"
).split()
VETO_ASIDE = "logo symbol table information facts declaration label per".split()
FOREIGN = "onceopened airtight consumercare customercare feedback tollfree helpline bestbefore useby fssai nutrition storage storein keepin".split()
CATEGORIES = "biscuits biscuit cookies noodles atta flour oil chips namkeen chocolate tea coffee milk candy toffee mixture bhujia papad rusk cake bread jam sauce ketchup".split()


def tight_joins(boxes: DataFrame, by: list[str], touch: float = 0.35, overlap: float = 0.5) -> DataFrame:
    """Boxes in order of rows and columns, with those that nearly touch the box before them put together as one word: ``by``, ``fragment`` (from 0), ``text``.

    A box joins if it overlaps at least half the lower height of the box that began the fragment, and begins after its end by less than
    ``touch`` of a letter's width there. Each image is read in order as a stream, with one fragment held.
    """
    kinds = boxes.select(*by).schema
    arrow = pa.schema([*_arrow(kinds), pa.field("fragment", pa.int64()), pa.field("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, text, box, out = None, 0, None, None, []
        for b in batches:
            for r in b.to_pylist():
                now, own = tuple(r[c] for c in by), None if r["x0"] is None else (r["x0"], r["y0"], r["x1"], r["y1"])
                if text is not None and now == key and _touches(box, own, len(text.strip()), touch, overlap):
                    text = text.rstrip() + r["text"].lstrip()
                    continue
                if text is not None:
                    out.append((*key, n, text))
                n = n + 1 if text is not None and now == key else 0
                key, text, box = now, r["text"], own
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if text is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip((*key, n, text), arrow, strict=True)], schema=arrow)

    own = boxes.where(F.trim("text") != "").select(*by, F.trim("text").alias("text"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), "line_no")
    placed = own.withColumns({"__y": F.coalesce("y0", F.col("line_no").cast("double")), "__x": F.coalesce("x0", F.lit(0.0))})
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "fragment long", "text string"])
    return placed.repartition(*by).sortWithinPartitions(*by, "__y", "__x", "line_no").mapInArrow(run, ddl)


def _arrow(schema) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(schema))


def _touches(before: tuple | None, now: tuple | None, letters: int, touch: float, overlap: float) -> bool:
    if before is None or now is None:
        return False
    low = min(before[3] - before[1], now[3] - now[1])
    common = min(before[3], now[3]) - max(before[1], now[1])
    letter = max(before[2] - before[0], 1e-6) / max(letters, 1)
    return low > 0 and common / low >= overlap and 0 <= now[0] - before[2] < touch * letter


def paragraphs(boxes: DataFrame, by: list[str]) -> DataFrame:
    """One paragraph an image: its fragments up to the next section, words that a hyphen cuts put together; ``by``, ``text``, ``fragments``, ``stopped`` (that section)."""
    told = boundaries.decided(tight_joins(boxes, by), "text")
    opens = (F.col("fragment") > 0) & F.col("boundary").isNotNull()
    end = told.groupBy(*by).agg(F.min(F.when(opens, F.struct("fragment", "boundary"))).alias("__end"))
    kept = told.join(end, by).where(F.col("__end").isNull() | (F.col("fragment") < F.col("__end.fragment")))
    w = Window.partitionBy(*by).orderBy("fragment")
    cut = F.coalesce(F.lag("text").over(w).rlike("[-¬]$"), F.lit(False)) & F.split_part("text", F.lit(" "), F.lit(1)).rlike("^[A-Za-z]+$")
    goes_on = F.coalesce(F.lead("__cut").over(w), F.lit(False))
    marked = kept.withColumn("__cut", cut).withColumn("__on", goes_on)
    piece = F.concat(F.when(F.col("__cut") | (F.col("fragment") == 0), F.lit("")).otherwise(F.lit(" ")), F.when(F.col("__on"), F.expr("substring(text, 1, char_length(text) - 1)")).otherwise(F.col("text")))
    got = marked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("fragment", piece.alias("piece")))).alias("__pieces"), F.first("__end.boundary").alias("stopped"))
    text = F.array_join(F.transform("__pieces", lambda x: x["piece"]), "")
    return got.select(*by, F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"), F.size("__pieces").alias("fragments"), "stopped")


def _has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def elected_names(lines: DataFrame, by: list[str], skip: str) -> DataFrame:
    """``product``, ``brand``, ``generic`` and ``score`` of each package from the lines of its images; packages without a winner are left out.

    ``lines`` have ``image``, ``line_no``, ``text``, ``confidence`` and ``area`` (null: no box). A line counts unless it is short, a number, a section (``skip``), a
    contact or vetoed. Its score adds prominence in its image, the front, repetition over images, confidence and
    shape; boxed lines need 1.0, others 0.3. The brand is the most prominent short line in capitals.
    """
    text = F.trim("text")
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9%/.]+"), F.lit(0))
    core = F.filter(tokens, lambda t: ~t.isin(*VETO_ASIDE) & ~t.rlike(r"^\d+(\.\d+)?\s*(g|kg|mg|ml|l|%)?$"))
    bare = F.regexp_replace(F.array_join(core, ""), "[^a-z]", "")
    vetoed = bare.isin(*VETO) | bare.rlike("|".join(VETO_PARTS))
    counts = (F.char_length(text) >= 3) & ~_has(text, r"^[\d\s.,:/%-]+$") & ~_has(text, f"(?i)(?:{skip})") & ~vetoed & ~_has(text, "(?i)@|http")
    own = lines.select(*by, "image", "line_no", text.alias("value"), "confidence", "area").where(F.coalesce(counts, F.lit(False)))
    key = F.regexp_replace(F.lower("value"), "[^a-z0-9]", "")
    own = own.withColumn("__key", key)
    seen = own.select(*by, "__key", "image").distinct().groupBy(*by, "__key").agg((F.count("*") - 1).alias("__repeats"))
    largest = F.max("area").over(Window.partitionBy(*by, "image"))
    prominence = F.when((F.col("area") > 0) & (largest > 0), F.least(F.lit(1.0), F.col("area") / largest)).otherwise(0.5)
    words = F.size(F.regexp_extract_all("value", F.lit(r"\S+"), F.lit(0)))
    capitals = F.col("value") == F.upper("value")
    add = lambda when, what: F.when(F.coalesce(when, F.lit(False)), what).otherwise(0.0)
    score = (
        prominence + add(F.col("image") == "front", 0.3) + F.least(F.lit(0.4), 0.2 * F.col("__repeats")) + 0.2 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
        + F.when(capitals & (words <= 6), 0.1).when(F.substring("value", 1, 1).rlike("[A-Z]"), 0.1).otherwise(0.0)
        - add(F.col("value").rlike(r"\d"), 0.3) - add((words == 1) & capitals, 0.5) - add(F.col("value").endswith(":"), 0.3) - add(words > 8, 0.5) - add(F.col("__key").rlike("|".join(FOREIGN)), 0.6)
    )
    scored = own.join(seen, [*by, "__key"]).withColumns({"score": F.round(score, 3), "__boxed": F.coalesce(F.col("area") > 0, F.lit(False)), "__words": words, "__capitals": capitals})
    wins = F.col("score") >= F.when(F.col("__boxed"), 1.0).otherwise(0.3)
    branded = F.col("__capitals") & F.col("__words").between(1, 4) & ~F.col("value").rlike(r"\d")
    first = (-F.col("line_no")).alias("first")
    got = scored.groupBy(*by).agg(
        F.max_by(F.struct("value", "score"), F.when(wins, F.struct("score", first))).alias("best"),
        F.max_by("value", F.when(branded, F.struct((F.col("image") == "front").alias("front"), F.coalesce("area", F.lit(0.0)).alias("area"), first))).alias("brand"),
        *(F.bool_or(F.lower("value").rlike(rf"\b{w}\b")).alias(f"__{w}") for w in CATEGORIES),
        F.bool_or(wins).alias("won"),
    )
    generic = F.coalesce(*(F.when(F.col(f"__{w}"), w.capitalize()) for w in sorted(CATEGORIES, key=lambda w: (-len(w), w))))
    return got.where("won").select(*by, F.col("best.value").alias("product"), F.when(F.col("brand") != F.col("best.value"), F.col("brand")).alias("brand"), generic.alias("generic"), F.col("best.score").alias("score"))


def _near(lines: DataFrame, by: list[str], anchor: Column, reach: float = 6.0, most: int = 6) -> DataFrame:
    """For each anchor with a box the ``most`` nearest other boxes of the package, within ``reach`` of its heights: ``by``, ``line_no`` (the anchor's), ``near_text``, ``near_no``, both confidences."""
    middle = {"__cx": (F.col("x0") + F.col("x1")) / 2, "__cy": (F.col("y0") + F.col("y1")) / 2}
    boxed = lines.where(F.col("x0").isNotNull()).withColumns(middle)
    a = boxed.where(anchor & (F.col("y1") > F.col("y0"))).select(*by, "line_no", F.col("confidence").alias("own"), F.col("__cx").alias("__ax"), F.col("__cy").alias("__ay"), (reach * (F.col("y1") - F.col("y0"))).alias("__reach"))
    b = boxed.select(*by, F.col("line_no").alias("near_no"), F.col("text").alias("near_text"), F.col("confidence").alias("near_own"), "__cx", "__cy")
    apart = F.abs(F.col("__cx") - F.col("__ax")) + F.abs(F.col("__cy") - F.col("__ay"))
    met = a.join(b, by).where((F.col("near_no") != F.col("line_no")) & (apart <= F.col("__reach"))).withColumn("__apart", apart)
    rank = F.row_number().over(Window.partitionBy(*by, "line_no").orderBy("__apart", "near_no"))
    return met.withColumn("__rank", rank).where(F.col("__rank") <= most).select(*by, "line_no", "near_no", "near_text", "own", "near_own")


def price_candidates(lines: DataFrame, by: list[str]) -> DataFrame:
    """``value``, ``source``, ``score``, ``line_no`` of every price that a package's lines may state: beside its word, damaged or not, on the line below, in a box nearby, or a bare amount of money."""
    w = Window.partitionBy(*by).orderBy("line_no")
    seen = lines.select(*by, "line_no", "text", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "x0", "y0", "x1", "y1").withColumns({"__next": F.lead("text").over(w), "__next_c": F.lead("confidence").over(w)})
    context = _has(F.col("text"), f"(?i)(?:{PRICE_CONTEXT})")

    def hit(text: Column, patterns: list[str]) -> Column:
        """Number and what follows it, by the first pattern that matches."""
        found = F.when(F.lit(False), F.struct(F.lit("").alias("n"), F.lit("").alias("tail")))
        for p in patterns:
            found = found.when(_has(text, p), F.struct(F.regexp_extract(text, p, 1).alias("n"), F.regexp_extract(text, p, 2).alias("tail")))
        return found

    def source(df: DataFrame, name: str, found: Column, at: Column, confidence: Column, points: Column | float, worded: bool) -> DataFrame:
        return df.select(*by, F.lit(name).alias("source"), at.alias("line_no"), found.alias("__hit"), (F.lit(points) + confidence if isinstance(points, float) else points + confidence).alias("score"), F.lit(worded).alias("__worded"))

    money = lambda text: F.when(_has(text, f"(?i){CURRENCY}"), 2.0).otherwise(0.0)
    text, both = F.col("text"), F.concat_ws(" ", "text", "__next")
    lead, every = seen.where(context), [WORDED, *BARE]
    plain = hit(text, every)
    mean = (F.col("confidence") + F.coalesce("__next_c", F.lit(0.0))) / 2
    near = _near(seen, by, context).withColumn("__text", F.col("near_text"))
    found = (
        source(lead, "same line", plain, F.col("line_no"), F.col("confidence"), 9.0 + money(text), True)
        .unionByName(source(lead.where(plain.isNull()), "damaged word", hit(text, [DAMAGED]), F.col("line_no"), F.col("confidence"), 8.0, True))
        .unionByName(source(lead.where(F.col("__next").isNotNull()), "next line", hit(both, every), F.col("line_no"), mean, 7.0 + money(both), True))
        .unionByName(source(near, "near box", hit(F.col("__text"), BARE), F.col("near_no"), (F.col("own") + F.col("near_own")) / 2, 6.0, True))
        .unionByName(source(seen.where(~context), "bare", hit(text, BARE), F.col("line_no"), F.col("confidence"), 2.0, False))
    )
    value = F.regexp_replace("__hit.n", ",", "")
    whole = F.split_part(value, F.lit("."), F.lit(1))
    ok = (F.char_length(whole) <= 5) & whole.rlike("^[0-9]+$") & (F.expr("try_cast(regexp_replace(__hit.n, ',', '') as double)") > 0)
    ok = ok & ~F.col("__hit.tail").rlike(DATE_TAIL) & (F.col("__worded") | ~F.col("__hit.tail").rlike(WEIGHT_TAIL))
    return found.where(F.col("__hit").isNotNull() & F.coalesce(ok, F.lit(False))).select(*by, value.alias("value"), "source", "score", "line_no")


def quantity_candidates(lines: DataFrame, by: list[str]) -> DataFrame:
    """``value``, ``unit``, ``source``, ``score``, ``line_no`` of every amount that may be a package's net quantity.

    An amount counts by where a word for net quantity stands: on its line, one or two lines off (unless boxes say too far), in a box nearby, or
    anywhere. Amounts of servings and packs need it on their own line; 1 and 2 need it near.
    """
    w = Window.partitionBy(*by).orderBy("line_no")
    seen = lines.select(*by, "line_no", "text", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "x0", "y0", "x1", "y1").withColumn("__net", _has(F.col("text"), NET))
    amounts = lambda text, p: F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("u"))

    def source(df: DataFrame, name: str, text: Column, pattern: str, at: Column, confidence: Column, anchor: Column | float) -> DataFrame:
        points = anchor if isinstance(anchor, Column) else F.lit(anchor)
        return df.select(*by, F.lit(name).alias("source"), at.alias("line_no"), text.alias("__text"), points.cast("double").alias("anchor"), confidence.alias("__c"), F.explode(amounts(text, pattern)).alias("__m"))

    text = F.col("text")
    anchors = seen.where("__net").select(*by, F.col("line_no").alias("__at"), F.col("confidence").alias("__own"), F.col("y0").alias("__a0"), F.col("y1").alias("__a1"), F.inline(F.array(*(F.struct(F.lit(d).alias("__d")) for d in (-2, -1, 1, 2)))))
    # Places in order: neighbours are one and two lines off in it, whatever the line numbers.
    order = seen.withColumn("__place", F.row_number().over(w))
    around = anchors.join(order.select(*by, F.col("line_no").alias("__at"), F.col("__place").alias("__from")), [*by, "__at"]).withColumn("__place", F.col("__from") + F.col("__d"))
    gap = F.greatest(F.lit(0.0), F.greatest("y0", "__a0") - F.least("y1", "__a1"))
    boxed = F.col("y0").isNotNull() & F.col("__a0").isNotNull()
    beside = around.join(order, [*by, "__place"]).where(~boxed | (gap <= 3 * F.greatest(F.lit(1.0), F.col("__a1") - F.col("__a0"))))
    bonus = F.when(boxed, 1.0).otherwise(0.0)
    near = _near(seen, by, F.col("__net"))
    places = order.select(*by, "line_no", "__place")
    apart = near.join(places, [*by, "line_no"]).join(places.select(*by, F.col("line_no").alias("near_no"), F.col("__place").alias("__other")), [*by, "near_no"]).where(F.abs(F.col("__other") - F.col("__place")) > 2)
    somewhere = seen.where("__net").select(*by).distinct()
    found = (
        source(seen, "own line", text, AMOUNT, F.col("line_no"), F.col("confidence"), F.when(F.col("__net") | _has(text, NET_LOOSE), 3.0).otherwise(0.0))
        .unionByName(source(seen.where("__net"), "digit for a unit", text, DIGIT_UNIT, F.col("line_no"), F.col("confidence"), 2.5))
        .unionByName(source(beside, "line beside", text, AMOUNT, F.col("line_no"), (F.col("confidence") + F.col("__own")) / 2, F.when(F.abs("__d") == 1, 2.0).otherwise(1.0) + bonus))
        .unionByName(source(seen.join(somewhere, by, "left_semi"), "anywhere", text, AMOUNT, F.col("line_no"), F.col("confidence"), 0.5))
        .unionByName(source(apart, "near box", F.col("near_text"), AMOUNT, F.col("near_no"), (F.col("own") + F.col("near_own")) / 2, 1.5))
    )
    unit = F.when(F.col("source") == "digit for a unit", "g").otherwise(_unit(F.lower("__m.u")))
    number = F.expr("try_cast(regexp_replace(__m.n, ',', '') as double)")
    grams = number * F.when(unit.isin("kg", "l"), 1000.0).when(unit == "mg", 0.001).otherwise(1.0)
    ok = grams.between(0.01, 100_000.0) & ~(number.isin(1.0, 2.0) & (F.col("anchor") < 2)) & ~(_has(F.col("__text"), COUNTS) & (F.col("anchor") < 3))
    return found.where(F.coalesce(ok, F.lit(False))).select(*by, F.regexp_replace("__m.n", ",", "").alias("value"), unit.alias("unit"), "source", (F.col("anchor") * 2 + F.col("__c")).alias("score"), "line_no")


def _unit(u: Column) -> Column:
    """The plain name of a unit."""
    return F.when(u.rlike("^(kgs?|kilo.*)$"), "kg").when(u == "mg", "mg").when(u == "ml", "ml").when(u.rlike("^(g|gms?|gram.*)$"), "g").when(u.rlike("^l"), "l").otherwise("pcs")


def elected(cands: DataFrame, by: list[str], value: list[str], close: float = 0.5) -> DataFrame:
    """The best candidate of each package (``value`` columns, ``source``, ``score``, ``line_no``), with how many values ``rivals`` and whether another comes so close that a person must choose."""
    once = cands.groupBy(*by, *value).agg(F.max_by(F.struct("source", "score", "line_no"), F.struct("score", (-F.col("line_no")).alias("first"), "source")).alias("b"))
    w = Window.partitionBy(*by).orderBy(F.desc("b.score"), "b.line_no", *value)
    ranked = once.withColumns({"__rank": F.row_number().over(w), "__next": F.lead("b.score").over(w), "rivals": (F.count("*").over(Window.partitionBy(*by)) - 1).cast("int")}).where("__rank = 1")
    return ranked.select(*by, *value, "b.source", F.round("b.score", 6).alias("score"), "b.line_no", "rivals", F.coalesce(F.col("b.score") - F.col("__next") < close, F.lit(False)).alias("review"))


#: What leads to a licence, damaged forms among them, a number of its length, and fragments that a split one may consist of.
LICENCE = r"(?i)fssai|fsslai|lic\.?\s*no|licence|license|fss[l1i]|essai|f[5s]sai"
LICENCE_NUMBER = r"(\d[\d\s]{12,20}\d)"
LICENCE_WORDS = ["lic", "licno", "no", "n0", "fssai"]


def elected_licences(lines: DataFrame, by: list[str], barcodes: DataFrame | None = None) -> DataFrame:
    """``value`` (14 digits), ``source`` and ``line_no`` of each package's licence, by the first line that leads to one.

    The number stands on that line, or runs on over the next, or over three lines that are nothing but words of licences and digits, or is in a box nearby. A
    box that lies on a barcode (``barcodes``: ``by``, ``digits``, ``x0 y0 x1 y1``) by over half is no licence unless the digits are the same.
    """
    w = Window.partitionBy(*by).orderBy("line_no")
    boxes = ("x0", "y0", "x1", "y1")
    seen = lines.select(*by, "line_no", "text", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), *boxes).withColumns({"__2": F.lead("text", 1).over(w), "__3": F.lead("text", 2).over(w)})
    leads = _has(F.col("text"), LICENCE)

    def fragment(c: str) -> Column:
        bare = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
        return (F.trim(c) == "") | _has(F.col(c), LICENCE) | bare.isin(*LICENCE_WORDS) | (F.col(c).rlike(r"\d") & F.col(c).rlike(r"^[\d\s.,:/\-]*$"))

    def number(text: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(text, LICENCE_NUMBER, 1), r"\D", "")
        return F.when(F.char_length(digits) == 14, digits)

    own = number(F.col("text"))
    bare = ~_has(F.col("text"), LICENCE_NUMBER)
    two = F.when(bare & F.col("__2").isNotNull(), number(F.concat_ws(" ", "text", "__2")))
    three = F.when(bare & F.col("__3").isNotNull() & fragment("text") & fragment("__2") & fragment("__3"), number(F.concat_ws(" ", "text", "__2", "__3")))
    sources = F.array(*(F.when(v.isNotNull(), F.struct(F.lit(i).alias("rank"), F.lit(name).alias("source"), v.alias("value"))) for i, (name, v) in enumerate((("own line", own), ("two lines", two), ("three lines", three)))))
    in_order = seen.where(leads).select(*by, F.col("line_no").alias("lead_no"), "line_no", *boxes, F.inline(F.filter(sources, lambda x: x.isNotNull())))
    places = seen.select(*by, F.col("line_no").alias("near_no"), *boxes)
    anchors = seen.where(leads & bare).select(*by, "line_no")
    near = _near(seen, by, leads & bare).join(anchors, [*by, "line_no"], "left_semi").withColumn("value", number(F.col("near_text"))).where("value is not null").join(places, [*by, "near_no"])
    found = in_order.unionByName(near.select(*by, F.col("line_no").alias("lead_no"), F.col("near_no").alias("line_no"), *boxes, F.lit(3).alias("rank"), F.lit("near box").alias("source"), "value"))
    if barcodes is not None:
        b = barcodes.select(*by, F.col("digits").alias("__digits"), *(F.col(c).alias(f"__{c}") for c in boxes))
        side = lambda a, c: F.greatest(F.lit(0.0), F.least(a, F.col(f"__{a}")) - F.greatest(c, F.col(f"__{c}")))
        common = side("x1", "x0") * side("y1", "y0")
        area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
        covered = found.where(F.col("x0").isNotNull()).join(b, by).where((common > 0.5 * (area("") + area("__") - common)) & (F.col("__digits") != F.col("value")))
        found = found.join(covered.select(*by, "line_no", "value", "source", "lead_no").distinct(), [*by, "line_no", "value", "source", "lead_no"], "left_anti")
    best = found.groupBy(*by).agg(F.min_by(F.struct("value", "source", "line_no"), F.struct("lead_no", "rank", "line_no", "value")).alias("b"))
    return best.select(*by, "b.*")


#: Fields that a word leads to: the word (damaged forms in the second), the value beside it, and the value where it stands alone in a line or box.
_DATE = r"([0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}|[0-9]{1,2}[/.-][0-9]{4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ .-]*[0-9]{4})"
_PHONE = r"((?:\+?91[\s-]?)?[6-9]\d{9}|[1lI][8B][0O]{2}[\s-]?\d{3,4}[\s-]?\d{3,4})"
WORDED_FIELDS = {
    "manufacturing_date": (r"\bmfd\b|\bmfg\b|mfd[\d.]|mfg[\d.]|manufactur|packed(?:\s*on)?|\bpkd\b|\bpkg\b|pkd[\d.]|date\s*of\s*(?:manufacture|packing|packaging)", r"\bmfo\b|\bnfd\b|\bmf[69]\b", _DATE, rf"^\W*{_DATE}\W*$"),
    "best_before": (r"best\s*before|use\s*before|use\s*by|use-by|expir|best\s*if\s*used\s*by|consume\s*before", r"be[s5]t\s*bef[o0]re|[e3]xpiry|u[s5]e\s*by", rf"{_DATE[:-1]}|\d+\s*(?:days?|months?|years?))", rf"^\W*{_DATE[:-1]}|\d+\s*(?:days?|months?|years?))\W*$"),
    "consumer_care": (r"care|call|customer|toll|helpline|contact|complaint|phone|tel|service", r"ca[l1][l1]|conta[ce]t|he[l1]pline|custorner|fee[d]?back", _PHONE, rf"^\W*{_PHONE}\W*$"),
    "batch_lot": (r"\bbatch\b|\blot\b|\bb\.?\s*no\b|\bb\s*/\s*n", r"\bbatcn\b|\b[bB]atch[nN]o|\b[l1]ot\s*n[o0]\b", r"(?:batch|batcn|lot|b\.?\s*no|b\s*/\s*n)[\s.:/-]*(?:n[o0]\.?|number|num\.?)?[\s.:-]*([A-Z0-9][A-Z0-9/-]{1,19})\s*$", r"^\s*([A-Z]{0,4}[0-9][A-Z0-9/-]{1,15})\s*$"),
}


def worded_candidates(lines: DataFrame, by: list[str]) -> DataFrame:
    """``field``, ``value``, ``source``, ``score``, ``line_no`` of dates, contacts and batches that a word leads to: on its line, on the line below, or in a box nearby.

    A damaged word counts less than a clean one. The line below and boxes count only where the word's own line has no value, and must be
    the value alone. Digits of a phone read as letters are put right.
    """
    w = Window.partitionBy(*by).orderBy("line_no")
    seen = lines.select(*by, "line_no", "text", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "x0", "y0", "x1", "y1").withColumns({"__next": F.lead("text").over(w), "__next_c": F.lead("confidence").over(w)})
    out = None
    for field, (clean, damaged, beside, alone) in WORDED_FIELDS.items():
        read = lambda c, p: F.nullif(F.regexp_extract(c, f"(?i){p}", 1), F.lit(""))
        plain = _has(F.col("text"), f"(?i)(?:{clean})")
        leads = seen.where(plain | _has(F.col("text"), f"(?i)(?:{damaged})")).withColumns({"__own": read(F.col("text"), beside), "__word": F.when(plain, 0.0).otherwise(0.5)})
        source = lambda df, name, value, at, points, conf: df.select(*by, F.lit(field).alias("field"), value.alias("value"), F.lit(name).alias("source"), (F.lit(points) - F.col("__word") + conf).alias("score"), at.alias("line_no")).where("value is not null")  # noqa: B023, E731
        empty = leads.where("__own is null")
        near = _near(seen, by, plain | _has(F.col("text"), f"(?i)(?:{damaged})")).join(empty.select(*by, "line_no", "__word"), [*by, "line_no"])
        found = (
            source(leads, "own line", F.col("__own"), F.col("line_no"), 3.0, F.col("confidence"))
            .unionByName(source(empty, "next line", read(F.col("__next"), alone), F.col("line_no"), 2.0, (F.col("confidence") + F.coalesce("__next_c", F.lit(0.0))) / 2))
            .unionByName(source(near, "near box", read(F.col("near_text"), alone), F.col("near_no"), 1.0, (F.col("own") + F.col("near_own")) / 2))
        )
        out = found if out is None else out.unionByName(found)
    phone = F.translate(F.regexp_replace("value", r"[\s-]", ""), "lIBOo", "11800")
    return out.withColumn("value", F.when(F.col("field") == "consumer_care", phone).otherwise(F.trim("value")))
