"""Lists of ingredients made clean, additive numbers put right, and the status of what was read. Native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boundaries, elections, validators

#: What is no part of a list (lines of barcodes, domains, long runs of digits), additives as they are written, valid suffixes, and classes of additives.
BARCODE_LINE = r"^[\d\s\-/\\|lI]{8,}$"
DOMAIN = r"(?i)\b[\w-]+(?:\.[\w-]+)*\.(?:in|com|net|org|co|info|biz|online|shop|store)\b"
DIGIT_RUN = r"\b\d[\d\s\-]{6,}\d\b"
ADDITIVE = r"\b[Ii][Nn][Ss]\s*[0-9OIlo]{1,4}(?:\s*\([0-9OIlivxX|]{1,6}\))?|\(\s*[0-9OIl]{3,4}\s*\)|\bE\s*[0-9OIl]{3,4}\b"
SUFFIXES = ["i", "ii", "iii", "iv", "v", "a", "b", "c", "d", "e", "f"]
CLASSES = {
    "preservative": "preservative", "colour": "colou?r", "flavour": "flavo?ur", "sweetener": "sweetener", "emulsifier": "emulsifier", "stabilizer": "stabiliz", "antioxidant": "antioxidant",
    "acidity regulator": r"acidity\s+regulator", "raising agent": r"raising\s+agent", "thickener": "thickener", "additive (INS)": r"\bINS\s*\d+",
}
#: Markers of sections that lower the trust in a value read beside them, and those that are a field's own.
FOREIGN = "consumercare customercare feedback tollfree helpline manufacturedby packedby marketedby importedby bestbefore useby fssai airtight onceopened nutrition".split()
OWN = {
    "consumer_care": "consumercare customercare feedback tollfree helpline", "manufacturer": "manufacturedby packedby marketedby importedby", "manufacturing_date": "bestbefore useby", "best_before": "bestbefore useby", "use_by": "bestbefore useby",
    "batch_lot": "bestbefore useby", "fssai_license": "fssai",
}
#: What shows that a field is on a label at all.
CONTEXTS = {
    "mrp": f"{elections.PRICE_CONTEXT}|{elections.DAMAGED_PRICE_WORD}", "quantity": elections.NET.removeprefix("(?i)"), "fssai_license": elections.LICENCE.removeprefix("(?i)"), "manufacturer": validators.MAKER,
    **{f: elections.WORDED_FIELDS[f][0] + "|" + elections.WORDED_FIELDS[f][1] for f in ("manufacturing_date", "best_before", "consumer_care", "batch_lot")}, "country_of_origin": r"country of origin|product of|made in",
}
#: Letters in lower case, one of which is in whatever shows the field (words between commas), and patterns for what has none. The full patterns run on few lines then.
TRIGGERS = {
    "mrp": "price,pr1ce,prlce,taxes", "quantity": "net,qty,quan,wei,wt,content,pack,e-mark,℮", "fssai_license": "fss,essai,f5sai,lic", "manufacturer": "manufactured,marketed,packed,mfd,mkd,mkt,mfg,imported,pvt,ltd,limited",
    "manufacturing_date": "mfd,mfg,manufactur,packed,pkd,pkg,packing,packaging,mfo,nfd,mf6,mf9", "best_before": "bef,use,u5e,expir,xpiry", "consumer_care": "care,call,ca1l,cal1,ca11,custo,toll,pline,conta,complaint,phone,tel,service,feedback,feeback",
    "batch_lot": "batch,batcn,lot,1ot,/", "country_of_origin": "country of origin,product of,made in",
}
LOOSE = {"mrp": r"m[\s.]*[rn][\s.]*[pf]", "batch_lot": r"b\.?\s*no"}


def cleaned(docs: DataFrame, by: list[str], text: str) -> DataFrame:
    """Each text without barcodes, domains, runs of digits and later copies of a line (spaces and case aside), as one line; texts with nothing left are left out."""
    lines = docs.where(F.col(text).isNotNull()).select(*by, F.posexplode(F.split(text, "\n+")).alias("n", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    lines = lines.where(~F.replace("line", F.lit(" "), F.lit("")).rlike(BARCODE_LINE))
    place = F.row_number().over(Window.partitionBy(*by, F.lower(F.regexp_replace("line", r"\s+", " "))).orderBy("n"))
    first = lines.withColumn("__k", place).where("__k = 1")
    bare = F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace("line", DOMAIN, ""), DIGIT_RUN, ""), r"\s+", " "), F.lit(" ,;"))
    kept = first.select(*by, "n", bare.alias("line")).where("line <> ''")
    return kept.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("__l")).select(*by, F.array_join(F.transform("__l", lambda x: x["line"]), " ").alias("text"))


def repaired(text: Column) -> Column:
    """Additive numbers with letters read for digits put right, and digits in their suffixes for letters; a suffix that stays unknown is left as it is."""

    def fixed(token: Column) -> Column:
        number = F.translate(F.regexp_extract(token, r"(?i)^(?:\(|INS|E)?\s*([0-9OIlo|]+)", 1), "OoIl|", "00111")
        raw = F.regexp_extract(token, r"(?i)^INS[^(]*\(([^)]*)\)", 1)
        suffix = F.translate(raw, "Il1|O0", "iiiioo")
        ending = F.when(raw == "", "").when(suffix.isin(*SUFFIXES), F.concat(F.lit("("), suffix, F.lit(")"))).otherwise(F.concat(F.lit("("), raw, F.lit(")")))
        return F.when(~number.rlike("^[0-9]+$"), token).when(token.startswith("("), F.concat(F.lit("("), number, F.lit(")"))).when(token.startswith("E"), F.concat(F.lit("E"), number)).otherwise(F.concat(F.lit("INS "), number, ending))

    between, tokens = F.split(text, ADDITIVE, -1), F.transform(F.regexp_extract_all(text, F.lit(ADDITIVE), F.lit(0)), fixed)
    return F.array_join(F.zip_with(between, tokens, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def additive_class(segment: Column) -> Column:
    """The class of additives that a part of a list names; null for none."""
    case = F
    for name, pattern in CLASSES.items():
        case = case.when(validators.has(segment, pattern), name)
    return case


def in_context(text: Column, field: str) -> Column:
    """Whether a text shows that the field is on the label: its pattern of ``CONTEXTS``, tried only where a trigger is."""
    low = F.lower(text)
    maybe = reduce(Column.__or__, [F.contains(low, F.lit(t)) for t in TRIGGERS[field].split(",")])
    if field in LOOSE:
        maybe = maybe | low.rlike(LOOSE[field])
    return F.coalesce(maybe, F.lit(False)) & validators.has(text, CONTEXTS[field])


def field_status(values: DataFrame, lines: DataFrame, by: list[str], least: float = 0.6) -> DataFrame:
    """Every field of ``CONTEXTS`` of every package of ``lines``: ``value``, ``anchored``, ``fused`` (confidence), ``status``.

    ``values`` has ``field``, ``value``, ``confidence``, ``line_no`` (of ``lines``) or, in its place, ``line``: the text of that line, which saves a join. A value is DETECTED if it is valid, read well, and stays trusted after a missing context (0.7) and a
    foreign section on its line (0.5); else it needs review, as does a context without a value. Neither is NOT_DETECTED.
    """
    text = F.coalesce("text", F.lit(""))
    shown = lines.groupBy(*by).agg(*(F.bool_or(in_context(text, f)).alias(f) for f in CONTEXTS))
    wanted = shown.select(*by, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("anchored")) for f in CONTEXTS))))
    found = values if "line" in values.columns else values.join(lines.select(*by, "line_no", text.alias("line")), [*by, "line_no"], "left")
    found = found.withColumn("__form", boundaries.spaceless(F.col("line")))
    foreign = F.lit(False)
    for f in CONTEXTS:
        own = OWN.get(f, "").split()
        foreign = F.when(F.col("field") == f, F.coalesce(F.col("__form").rlike("|".join(m for m in FOREIGN if m not in own)), F.lit(False))).otherwise(foreign)
    v = wanted.join(found.withColumn("__foreign", foreign), [*by, "field"], "left")
    digits = F.regexp_replace("value", r"\D", "")
    valid = (
        F.when(F.col("field") == "mrp", F.regexp_replace("value", ",", "").try_cast("double") > 0).when(F.col("field").isin("manufacturing_date", "best_before"), validators.dated(F.col("value")))
        .when(F.col("field") == "fssai_license", F.char_length(digits) == 14).when(F.col("field") == "consumer_care", validators.has(F.col("value"), boundaries.PHONE)).otherwise(True)
    )
    fused = F.round(F.col("confidence") * F.when(F.col("anchored"), 1.0).otherwise(0.7) * F.when(F.col("__foreign"), 0.5).otherwise(1.0), 3)
    trusted = F.coalesce(valid, F.lit(False)) & F.coalesce(F.col("confidence") >= least, F.lit(True)) & F.coalesce(fused >= least, F.lit(True))
    status = F.when(F.coalesce(F.col("value"), F.lit("")) == "", F.when(F.col("anchored"), "NEEDS_REVIEW").otherwise("NOT_DETECTED")).when(trusted, "DETECTED").otherwise("NEEDS_REVIEW")
    return v.select(*by, "field", "value", "anchored", fused.alias("fused"), status.alias("status"))
