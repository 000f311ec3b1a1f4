"""Whether a field's value may stand beside its evidence: one reason a field against it, and gates on readings. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boundaries import PHONE

#: What must show in the evidence of a field, and what a value or its evidence must not be.
PRICE = r"m\s*\.?\s*r\s*\.?\s*p|max(imum)?\s*retail\s*price|retail\s*price|incl.*all\s*taxes|rs\.?|inr|₹"
NET = r"net\b|net\s*wt|qty|quantity|weight|\bwt\b|contents?|pack\s*contains|e-mark|℮"
COUNTS = r"servings?|serves?\b|serve\b|pack\s*of|packets?|per\s*serv|prepar|\d\s*%|%\s*(daily|dv)|makes\s+\d|yields\s+\d"
FOREIGN = r"nutrition|storage|store\s*in|keep\s*in|once\s*opened|airtight|manufactured\s*by|packed\s*by|marketed\s*by|best\s*before|use\s*by|consumer\s*care|customer\s*care|fssai"
UNITS = "kg g mg l ml pcs inr rs nos".split()
DATE = r"\bmfd\b|\bmfg\b|manufactur|packed?\s*(on|by)?|\bpkd\b|\bpkg\b|date\s*of\s*(manufacture|packing|packaging)|best\s*before|use\s*by|use-by|\bexp\b|expir|consume\s*before"
LICENCE = r"fssai|lic\.?\s*no|licen[sc]e|fssai?|fss[l1i]|essai|f[5s]sai|fssa\b|lic\s*n\s*0"
BATCH = r"\bbatch(\s*(no\.?|number|num\.?))?|\blot(\s*(no\.?|number|num\.?))?|\bb\.?\s*(no\.?|number)|\bb\s*/\s*n"
NO_BATCH = "no na n/a nil none - -- null nr net not new pack lot number numbers batch".split()
MAKER = r"manufactured\s+(by|for)|marketed\s+(by|for)|packed\s+(by|for)|mfd\s+by|mkd\s+by|mkt\s+by|mfg\s+by|imported\s+by|\bpvt\b|\bltd\b|limited|private limited"
INGREDIENTS = "ingredients?|composition|contents|contains"
TABLE = r"per\s*100|approximate\s*values?|nutrition(al)?\s*information|serving\s*size|nutritive\s*value"
NO_INGREDIENT = r"nutrition|nutritive|per\s*100|approximate\s*values?|serving|storage|store\s*in|prepar|directions?\s+for\s+use|consumer\s*care|customer\s*care|helpline|toll\s*free|manufactured\s*by|marketed\s*by|packed\s*by|best\s*before|use\s*by|fssai|mfg\b|mrp|max\s*retail\s*price|lot\s*no|batch\s*no|ingredients?\s*not\s*found"
NUTRIENTS = "energy protein carbohydrate carbohydrates totalfat saturatedfat transfat total sugars added sodium serving size per fat fibre fiber cholesterol calcium iron vitamin".split()
SYMBOLS = {"VEG": "VEGETARIAN", "VEGETARIAN": "VEGETARIAN", "VEG_SYMBOL": "VEGETARIAN", "NON_VEG": "NON_VEG", "NONVEG": "NON_VEG", "NON_VEGETARIAN": "NON_VEG", "NON_VEG_SYMBOL": "NON_VEG"}
#: Forms of dates, and where each lies in a text.
DAYS = {
    r"(?:^|[^0-9])([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4})(?:[^0-9]|$)": ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy", "d-M-yy"],
    r"(?i)(?:^|[^0-9])([0-9]{1,2} (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) [0-9]{2,4})(?:[^0-9]|$)": ["d MMM yyyy", "d MMM yy"],
    r"(?:^|[^0-9])([0-9]{1,2}[./-][0-9]{4})(?:[^0-9]|$)": ["M/yyyy", "M-yyyy", "M.yyyy"],
    r"(?i)(?:^|[^a-z])((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) [0-9]{4})(?:[^0-9]|$)": ["MMM yyyy"],
    r"(?:^|[^0-9])([0-9]{1,2}[./-][0-9]{2})(?:[^0-9]|$)": ["M/yy", "M-yy", "M.yy"],
}


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?i)(?:{pattern})"), F.lit(False))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def dated(text: Column) -> Column:
    """Whether a text holds a day or a month of 1990 to 2040 in one of the forms; the first form that its shape fits decides."""
    case = None
    for shape, forms in DAYS.items():
        token = F.initcap(F.regexp_extract(text, shape, 1))
        read = F.coalesce(*(F.try_to_timestamp(token, F.lit(f)) for f in forms))
        fits, good = token != "", F.coalesce(F.year(read).between(1990, 2040), F.lit(False))
        case = F.when(fits, good) if case is None else case.when(fits, good)
    return F.coalesce(case, F.lit(False))


def objection(field: Column, value: Column, unit: Column, evidence: Column) -> Column:
    """Why a value can't stand as its field's; null if it can. Fields without a rule accept what isn't blank."""
    v, ev, u = F.trim(F.coalesce(value, F.lit(""))), F.coalesce(evidence, F.lit("")), F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    shown, digits = ev != "", _digits(v)
    plain = F.regexp_replace(v, ",", "")
    number = plain.try_cast("double")
    first = F.split_part(plain, F.lit(" "), F.lit(1)).try_cast("double")
    every = F.concat_ws(" ", ev, v, u)
    inner = F.lower(F.regexp_extract(v, r"[\d.,]+\s*([a-zA-Z]+)", 1))
    net = has(every, NET)
    price = (
        F.when(number.isNull() | F.isnan(number), "not numeric").when(number <= 0, "not positive").when(F.char_length(F.split_part(plain, F.lit("."), F.lit(1))) > 5, "too many digits")
        .when(F.char_length(_digits(plain)) >= 10, "as long as a phone").when(~has(F.concat_ws(" ", ev, v), PRICE), "no price context")
    )
    quantity = (
        F.when(first.isNull() | F.isnan(first), "not numeric").when(first <= 0, "not positive").when(~u.isin(*UNITS) & ~inner.isin(*UNITS, "gms", "gm", "ltr"), "no unit")
        .when(first.isin(1.0, 2.0) & ~net, "a small count").when(has(every, COUNTS) & ~net, "a count of servings or packs").when(~net, "no net context").when(has(ev, FOREIGN) & ~has(ev, NET), "another section")
    )
    date = F.when(~dated(v), "no date").when(shown & ~has(ev, DATE), "no date context")
    licence = F.when(F.char_length(digits) != 14, "not 14 digits").when(shown & ~has(ev, LICENCE), "no licence context").when(has(F.substring(digits, 1, 10), rf"^(?:{PHONE})$") & digits.rlike("^[6-9]"), "like a phone")
    care = F.when(~has(v, rf"{PHONE}|@|http|www\."), "no contact")
    batch = (
        F.when(F.lower(F.btrim(v, F.lit(" .:"))).isin(*NO_BATCH), "a label's word").when(F.char_length(digits) == 14, "as long as a licence").when(F.char_length(digits) >= 10, "as long as a phone")
        .when(shown & ~has(ev, BATCH), "no batch context").when(~v.rlike(r"^[A-Za-z0-9/\-]{2,20}$"), "no batch shape")
    )
    maker = F.when(F.char_length(v) < 3, "too short").when(~has(ev, MAKER), "no maker context")
    ingredients = (
        F.when(has(v, TABLE), "a nutrition table").when(has(v, NO_INGREDIENT) & ~has(v, INGREDIENTS), "another section").when(shown & ~has(ev, INGREDIENTS), "no heading")
        .when(~F.contains(v, F.lit(",")) & (F.size(F.split(v, r"\s+")) < 2), "no list")
    )
    name = F.regexp_replace(F.lower(field), r"[^a-z]", "")
    row = F.regexp_replace(F.lower(ev), "[^a-z0-9]", "")
    nutrient = F.when(~name.isin(*NUTRIENTS) & ~shown, "unknown nutrient").when(first.isNull() | F.isnan(first), "not numeric").when(shown & ~(F.contains(row, name) | row.rlike("nutrition|nutritive|per100|perserve|table|column")), "another row")
    symbol = F.replace(F.replace(F.upper(v), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    veg = F.when(~symbol.isin(*SYMBOLS), "no symbol").when(shown & ~has(ev, "symbol|logo|dot|mark"), "no symbol evidence")
    rules = {
        "mrp": price, "quantity": quantity, "manufacturing_date": date, "expiry_date": date, "best_before": date, "use_by": date, "fssai_license": licence, "consumer_care": care, "batch_lot": batch, "manufacturer": maker,
        "ingredients": ingredients, "veg_nonveg": veg,
    }
    case = F.when(v == "", "blank")
    for f, rule in rules.items():
        case = case.when(field == f, rule)
    return case.when(has(field, "^(energy|protein|carbohydrate|total_sugars|added_sugars|total_fat|saturated_fat|trans_fat|sodium|serving_size)$"), nutrient)


def care_number(value: Column) -> Column:
    """A contact in one form: addresses as they are, numbers as digits with a leading plus kept; null without either."""
    v = F.trim(value)
    digits = _digits(v)
    return F.when(has(v, r"@|http|www\."), v).when(digits != "", F.concat(F.when(v.startswith("+"), "+").otherwise(""), digits))


def maker_name(value: Column) -> Column:
    """A maker's name with single spaces, a space after a full stop between letters, and without a last letter that a column cut off."""
    trim = lambda c: F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" ,:-"))
    name = F.regexp_replace(trim(value), r"\s+[A-Z]\s*$", "")
    return F.nullif(trim(F.regexp_replace(name, r"([A-Za-z])\.(?=[A-Za-z])", "$1. ")), F.lit(""))


def second_look(text: Column, coherence: Column, rows: Column, variants: Column, least: float = 0.70, least_rows: int = 3, least_chars: int = 40) -> Column:
    """Why a reading of ingredients needs another engine, as an array: incoherent, short for its region's rows, odd characters, malformed additives, variants that differ.

    ``variants`` is an array of other readings (null: none); they differ if not all hold the same percentages and additives.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    scrubbed = F.regexp_replace(F.regexp_replace(t, r"\d\s*%", ""), r"\d\s*&\s*\d", "")
    malformed = t.rlike(r"\bINS\b(?!\s*\d{1,4}\b)|\bE\s*[A-Za-z]+\b|\bE\d{1,2}\b|\bE\d{5,}\b")
    tokens = lambda x: F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?i)\d+(?:\.\d+)?\s*%|\bINS\s*[^\s,;.]+|\bE\s?\d{3,4}\b"), F.lit(0)), lambda y: F.upper(F.regexp_replace(y, r"\s+", "")))))
    found = F.array_distinct(F.transform(variants, tokens))
    return F.filter(
        F.array(
            F.when(F.coalesce(coherence, F.lit(0.0)) < least, "incoherent"), F.when((rows >= least_rows) & (F.char_length(t) < least_chars), "short"), F.when(scrubbed.rlike(r"[@#$^*_~`|\\&¬]"), "odd characters"),
            F.when(malformed, "malformed additives"), F.when((F.size(variants) >= 2) & (F.size(found) > 1), "variants differ"),
        ),
        lambda x: x.isNotNull(),
    )


def context_label(context: Column, declared: Column, kind: Column) -> Column:
    """How a report names its inspection: by the product's context, else by the declared one, else by the kind of inspection."""
    names = {"PACKAGE_ONLY": "Physical Package Inspection", "ONLINE_LISTING": "Online Listing Inspection", "PACKAGE_AND_ONLINE_LISTING": "Physical Package + Online Listing Inspection"}
    named = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    k = F.upper(F.coalesce(kind, F.lit("")))
    by_kind = F.when(k.isin("PHYSICAL", "PACKAGE_ONLY", ""), names["PACKAGE_ONLY"]).otherwise(F.initcap(F.replace(k, F.lit("_"), F.lit(" "))))
    stated = F.nullif(F.upper(declared), F.lit(""))
    return F.coalesce(named[F.upper(F.coalesce(context, F.lit("")))], F.when(stated.isNotNull(), F.coalesce(named[stated], F.lit(names["PACKAGE_ONLY"]))), by_kind)
