"""What a line of a label opens, what role an image has, and gates on the evidence of fields: ordered CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sections of a label in the order in which they are tried, with what opens them.
OPENERS = {
    "NUTRITION": r"nutrition(?:al)?(?:\s+information|\s+facts)?|typical\s+values?|approximate\s+values?",
    "ALLERGEN": r"allerge?n",
    "CONTAINS": r"^\s*contains\b\s*(?::|$)|^\s*contains\s+(?:milk|soy|soya|wheat|nut|egg|mustard|sesame|sulphite|sulfite|gluten|peanut|tree\s+nut)",
    "STORAGE": r"stor(?:age|e)|keep\s+in|store\s+in",
    "DIRECTIONS": r"directions?\s+(?:for\s+use|to\s+cook)",
    "COOKING": r"direction|preparation|how\s+to\s+(?:cook|prepare|use)|recipe|cooking",
    "WARNING": r"warn|c caution|note:|statutory| disclaimer",
    "PACKER": r"packed\s+by|packer",
    "IMPORTER": r"import(?:ed)?\s+by|importer",
    "MANUFACTURER": r"manufactured(?:\s*&\s*marketed)?(?:\s*/\s*packed)?\s+by|marketed by|packed by|mfd\.?\s+by|mkd\.?\s+by|mfg\.?\s+by|imported by",
    "BEST_BEFORE": r"best\s*before|use\s*by|expir",
    "MFG_DATE": r"\bmfd\b|\bmfg\b|manufactur|packed(?:\s*on)?|\bpkd\b",
    "BATCH": r"batch|lot\s*no|b\.?\s*no",
    "MRP": r"m\s*\.?\s*r\s*\.?\s*p|maximum\s+retail\s+price",
    "FSSAI": r"fssai?|fsslai|fss[l1i]|essai|f[5s]sai",
    "FEEDBACK": r"for\s+feedback|for\s+(?:any\s+)?quer(?:y|ies)|feedback\b|\bcomplaints?\b.*:|\bwrite\s+to\s+us\b",
    "PORTION": r"know\s+your\s+portion|serving\s+suggestion|serves\s+\d",
    "QR": r"\bqr\s*code\b|scan\s+(?:the\s+)?qr|scan\s+to\s+know",
    "CONSUMER_CARE": r"consumer\s+care|customer\s+care|helpline|toll[\s-]*free|contact\s+us|call\s+us",
    "BARCODE": r"bar\s*-?\s*code",
}
#: Headings of the ingredients, quantities that are no heading, and words of the two openers that need evidence.
BARE, COLON = r"^\s*(?:ingredients?|composition)\s*[.:\-]?\s*$", r"ingredients?\s*[:.\-]|composition\s*[:.\-]|contents\s*:|contains\s*:|ingredients?\s*/|/+\s*contents?"
OTHER_HEADINGS = r"सामग्री|samagr[iy]|^\s*made\s+from\b"
QUANTITY = r"\b\d[\d.,]*\s*(?:kg|kgs|gms?|gm|g|mg|ml|ltr?s?|litres?|pcs?|nos?)\b|\bnet\b.*\b(?:wt|qty|quantity|weight|contents?)\b"
CANONICAL, NEED_EVIDENCE = ("ingredients", "ingredient", "composition"), ("contents", "contains")
ALLERGENS = "wheat milk soy soya nut nuts egg mustard sesame sulphite sulfite gluten peanut".split()
#: Words that food is declared with.
FOOD = (
    "wheat flour maida refined palm oil salt sugar spices mixed herbs tomato onion milk powder water gluten rice corn soya soy starch dextrose maltodextrin cocoa chocolate vanilla flavours flavour colour colours "
    "preservative acidity regulator raising agent emulsifier stabilizer antioxidant thickener humectant sweetener lecithin citric acid tartaric malic sodium potassium calcium carbonate bicarbonate phosphate sulphite "
    "sorbate benzoate tocopherol ascorbic niacin iron zinc noodle noodles pasta atta rava semolina besan dal lentil peanut groundnut mustard cumin coriander turmeric chilli pepper ginger garlic"
).split()
#: Signs of a front, of declarations, of a back and of a side.
MARKETING = r"tasty|delicious|new|offer|crunchy|yummy"
DECLARATIONS = (
    r"ingredients?|nutrition|fssai|lic\.?\s*no|licen[sc]e|manufactured\s+(?:by|for)|marketed\s+by|packed\s+by|consumer\s*care|customer\s*care|helpline|toll|net\s*(?:wt|qty|quantity|weight)|best\s*before|use\s*by|"
    r"\bmfd\b|\bmfg\b|\bpkd\b|batch|lot\s*no|m\.?\s*r\.?\s*p|maximum\s+retail\s+price"
)
SIDE = r"\bmfd\b|\bmfg\b|\bpkd\b|\bpkg\b|batch|lot\s*no|\bb\.?\s*no\b|m\.?\s*r\.?\s*p\b|maximum\s+retail\s+price|best\s*before|use\s*by|expir"
BACK_ONLY = r"ingredients?|nutrition|manufactured\s+(?:by|for)|marketed\s+by|consumer\s*care|customer\s*care|storage|fssai"
#: What a field's evidence must show.
EVIDENCE = {
    "quantity": r"net\b|net\s*wt|qty|quantity|weight|\bwt\b|contents?|pack\s*contains|e-mark|℮",
    "mrp": r"m\s*\.?\s*r\s*\.?\s*p|max(imum)?\s*retail\s*price|retail\s*price|incl.*all\s*taxes|rs\.?|inr|₹",
    "batch": r"\bbatch(?:\s*(?:no\.?|number|num\.?))?|\blot(?:\s*(?:no\.?|number|num\.?))?|\bb\.?\s*(?:no\.?|number)|\bb\s*/\s*n",
    "date": r"\bmfd\b|\bmfg\b|manufactur|packed?\s*(on|by)?|\bpkd\b|\bpkg\b|date\s*of\s*(manufacture|packing|packaging)|best\s*before|use\s*by|use-by|\bexp\b|expir|consume\s*before",
    "maker": r"manufactured\s+(?:by|for)|marketed\s+(?:by|for)|packed\s+(?:by|for)|mfd\s+by|mkd\s+by|mkt\s+by|mfg\s+by|imported\s+by|\bpvt\b|\bltd\b|limited|private limited",
    "symbol": r"symbol|logo|dot|mark",
}
GATES = {"quantity": "quantity", "mrp": "mrp", "batch": "batch", "batch_lot": "batch", "manufacturing_date": "date", "date_of_packing": "date", "expiry_date": "date", "best_before": "date", "use_by": "date"}


def _has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?i)(?:{pattern})"), F.lit(False))


def words_in(text: Column, words: list[str]) -> Column:
    """How many words of three letters and more of a text are among ``words``."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    return F.size(F.filter(found, lambda w: w.isin(*words)))


def core(line: Column) -> Column:
    """The first word of a line in lower case, marks before it aside."""
    return F.regexp_extract(F.lower(F.trim(line)), r"^[^a-z0-9ऀ-ॿ]*([a-z0-9ऀ-ॿ]+)", 1)


def remainder(line: Column) -> Column:
    """What follows the heading word on its line."""
    return F.trim(F.regexp_replace(line, r"(?i)^\s*(ingredients?|composition|contents|contains|made\s+from)\s*[:.\-/]*", ""))


def allergen_declaration(line: Column) -> Column:
    """"Contains" and a list of at most three allergens alone: no percentage, bracket or additive number."""
    rest = remainder(line)
    words = F.regexp_extract_all(F.lower(rest), F.lit("[a-z]{3,}"), F.lit(0))
    return _has(line, r"^\s*(?:contents?|contains?)\b") & ~_has(rest, r"[%(]|\bINS\b|\bE\s*\d{3,4}\b") & (F.size(words) > 0) & (F.size(F.split(rest, ",")) <= 3) & F.forall(words, lambda w: w.isin(*ALLERGENS))


def like_ingredients(text: Column) -> Column:
    """Looks like a declaration of ingredients: a percentage, an additive, a group or a list with food in it, or two words of food."""
    hits = words_in(text, FOOD)
    return F.coalesce(_has(text, r"%|\bINS\b|\bE\s*\d{3,4}\b") | (_has(text, r"\([^()]{0,60}\)|[,;]") & (hits >= 1)) | (hits >= 2), F.lit(False))


def opens_ingredients(line: Column, context: Column) -> Column:
    """Whether a line heads the ingredients, misread letters allowed; "contents" and "contains" need evidence beside them."""
    first, marked = core(line), _has(line, COLON) | _has(line, BARE)
    near = F.array_min(F.array(*(F.when(F.levenshtein(first, F.lit(c)) <= 2, F.lit(0)).otherwise(1) for c in CANONICAL))) == 0
    plain = ~marked & ~_has(line, r"\d{4,}") & (F.length(first) >= 6)
    strong = (marked & _has(line, "ingredients?|composition")) | (plain & (first.isin(*CANONICAL) | (~first.isin(*NEED_EVIDENCE) & (F.length(F.trim(line)) <= 42) & near)))
    weak = (marked & ~_has(line, "ingredients?|composition")) | (plain & first.isin(*NEED_EVIDENCE))
    shown = ~allergen_declaration(F.trim(line)) & (like_ingredients(remainder(line)) | like_ingredients(context))
    return F.coalesce(~_has(line, QUANTITY) & (_has(line, OTHER_HEADINGS) | strong | (weak & shown)), F.lit(False))


def boundary(line: Column, context: Column) -> Column:
    """The section that a line opens, by its canonical name; null for none."""
    case = F.when(F.trim(line) == "", None).when(_has(line, BARE), "INGREDIENTS")
    for name, pattern in OPENERS.items():
        case = case.when(_has(F.trim(line), pattern), name)
    return case.when(allergen_declaration(F.trim(line)), "CONTAINS").when(opens_ingredients(F.trim(line), context), "INGREDIENTS")


def windows(docs: DataFrame, id_: str, text: str, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """For each section (``pattern``, ``lines``) the lines from its first opener on, as one text; null where none opens it."""
    lines = docs.select(id_, F.split(text, "\n").alias("__lines"))
    at = lambda pattern: F.array_position(F.transform("__lines", lambda x: _has(x, pattern)), True).cast("int")
    return lines.select(id_, *(F.when(at(p) > 0, F.array_join(F.slice("__lines", at(p), n), " ")).alias(name) for name, (p, n) in wanted.items()))


def image_role(slot: Column, texts: Column) -> Column:
    """FRONT, BACK, SIDE, TOP, BOTTOM or UNKNOWN: by the slot's name, else by scores of its lines."""
    low, joined, n = F.lower(F.trim(F.coalesce(slot, F.lit("")))), F.array_join(texts, " "), F.size(texts)
    one = lambda c, v: F.when(c, v).otherwise(0.0)
    front = one((n > 0) & (n <= 12), 1.0) + one(F.coalesce(joined.rlike("[A-Z]{4,}"), F.lit(False)), 1.0) + one(_has(joined, MARKETING), 1.0) - one(_has(joined, DECLARATIONS), 1.5)
    back = F.least(F.regexp_count(joined, F.lit(f"(?i)(?:{DECLARATIONS})")) * 0.5, F.lit(3.0)) + one(n >= 6, 1.0)
    side = one((n <= 10) & ~_has(joined, BACK_ONLY) & _has(joined, SIDE), 2.0)
    scored = F.when((side >= 2) & (side >= back) & (side >= front), "SIDE").when(back >= front + 1, "BACK").when(front >= back + 1, "FRONT").when((back > 0) & (n >= 6), "SIDE").otherwise("UNKNOWN")
    return F.when(low == "front", "FRONT").when(low == "back", "BACK").when(low == "top", "TOP").when(low == "bottom", "BOTTOM").when(low.startswith("side"), "SIDE").when(low == "listing", "UNKNOWN").otherwise(scored)


def evidence_gate(field: Column, value: Column, evidence: Column) -> Column:
    """Whether the evidence behind a field that vision had a part in shows what that field needs; other fields pass."""
    both, base = F.concat_ws(" ", evidence, value), F.split_part(field, F.lit(":"), F.lit(1))
    case = F.when(base == "fssai_license", F.length(F.regexp_replace(value, r"\D", "")) == 14)
    for name, kind in GATES.items():
        case = case.when(base == name, _has(both, EVIDENCE[kind]))
    case = case.when(base == "consumer_care", _has(value, r"@|http|www\.|\d[\d\s-]{6,}\d"))
    return F.coalesce(case.when(base == "manufacturer", _has(evidence, EVIDENCE["maker"])).when(base == "veg_nonveg", _has(evidence, EVIDENCE["symbol"])).otherwise(True), F.lit(False))


def cross_checks(fields: DataFrame, by: list[str], close: float = 0.5) -> DataFrame:
    """Fields (``mrp``, ``fssai_license``, ``consumer_care``, ``joined``, ``prices``) that cannot stand beside each other: the reasons for review.

    ``prices`` are structs of ``value`` and ``score``; several distinct values of nearly equal score ask for review.
    """
    digits = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\D", "")
    same = lambda a, b: (digits(a) != "") & (digits(a) == digits(b))
    values = F.array_distinct(F.transform("prices", lambda p: p["value"]))
    best = F.reverse(F.array_sort(F.transform(values, lambda v: F.array_max(F.transform(F.filter("prices", lambda p: p["value"] == v), lambda p: p["score"])))))
    rivals = (F.size(best) >= 2) & (F.get(best, F.lit(0)) - F.get(best, F.lit(1)) < close)
    reasons = [F.when(same("mrp", "fssai_license"), "mrp=fssai_license"), F.when(same("mrp", "consumer_care"), "mrp=consumer_care"), F.when(same("fssai_license", "consumer_care"), "fssai_license=consumer_care"), F.when(F.col("joined"), "manufacturer joined"), F.when(rivals, "several prices")]
    return fields.select(*by, F.concat_ws(",", *reasons).alias("reasons"))


def reconcile_images(hits: DataFrame, by: list[str]) -> DataFrame:
    """One value a field over all images (``value``, ``anchored``, ``confidence``, ``image``).

    Anchored hits outvote the rest. Where all of those agree, the best of them stands;
    else all are kept, and review is asked for.
    """
    strong = F.max("anchored").over(_over(by))
    kept = hits.where(F.col("value").isNotNull()).withColumn("__strong", strong).where(F.col("anchored") == F.col("__strong"))
    got = kept.groupBy(*by).agg(F.sort_array(F.collect_set(F.lower(F.trim("value")))).alias("values"), F.max_by("value", F.struct("confidence", (-F.col("image")).alias("first"))).alias("best"), F.count("*").alias("hits"))
    return got.select(*by, F.when(F.size("values") == 1, F.col("best")).alias("value"), F.when(F.size("values") == 1, "DETECTED").otherwise("NEEDS_REVIEW").alias("status"), F.array_join("values", "|").alias("candidates"), "hits")


def _over(by: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*by)
