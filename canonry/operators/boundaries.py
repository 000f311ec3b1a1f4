"""Where a list of ingredients ends, and what of it is contamination: rules over a line and over its blank-free form.

Recognition glues words ("FORFEEBACK"), so literal markers are looked for in the letters and digits of a
line alone. All of them, and the words without which a pattern can't match, are found in one pass by one automaton (a trie with failure
links as a dense table), run over all lines of a batch side by side. What it finds is a column, and the rules are
ordered conditions on that column and on patterns, so they stay native. A rule is data: ``column`` makes
Spark's expression of it and ``sql`` the same as text.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sections and the glued markers that open them, in the order in which they are tried.
GLUED = {
    "STORAGE": "onceopened airtight storein", "CONSUMER_CARE": "consumercare customercare executive tollfree helpline", "FEEDBACK": "feedback feeback forfeed contact contac", "MANUFACTURER": "manufacturedby marketedby",
    "PACKER": "packedby", "IMPORTER": "importedby", "BEST_BEFORE": "bestbefore useby", "MFG_DATE": "manufactured", "FSSAI": "fssai", "MRP": "maximumretailprice", "NUTRITION": "nutrition per100g", "BARCODE": "barcode", "QUANTITY": "netquantity netwt",
}
#: Allergens, and fragments that tell of sections only beside other signs.
ALLERGENS = "wheat milk soy soya nut nuts egg mustard sesame sulphite sulfite gluten peanut".split()
FRAGMENTS = "tain contain contan fsslai contactus".split()
#: Patterns of the parts of a label.
CARE = r"consumer care|customer care|toll free|helpline"
#: (Of the name before an at sign one letter is enough to find an address; a run of them would make long words quadratic.)
EMAIL = r"[\w.%-]@[\w.-]+\.[A-Za-z]{2,}"
EMAIL_OR_SITE = EMAIL + r"|(https?://|www\.)[\w\-./?=%&]"
PHONE = r"1800[\s-]?\d|\+?91[\s-]?\d{10}|\b[6-9]\d{9}\b"
MAKER = r"manufactured(\s*&\s*marketed)?(\s*/\s*packed)?\s+by|marketed\s+by|packed\s+by|mfd\.?\s+by|mkd\.?\s+by|mfg\.?\s+by|imported\s+by|\bmfd\b.*\bby\b|\bpkd\b.*\bby\b"
BEST_BEFORE, BATCH = r"best\s*before|use\s*by|expir", r"batch|lot\s*no|b\.?\s*no"
MADE_ON = r"\bmfd\b|\bmfg\b|manufactur|packed(\s*on)?|\bpkd\b"
DAY = r"[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}|[0-9]{1,2}[/.-][0-9]{4}|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ .-]*[0-9]{4}"
PRICE, MONEY = r"m\s*\.?\s*r\s*\.?\s*p|maximum\s+retail\s+price", r"rs\.?|inr|₹"
NET = r"net\s*(wt|qty|quantity|weight|contents?)"
NUTRITION = r"nutrition(al)?(\s+information|\s+facts)?|typical\s+values?|approximate\s+values?"
NUTRIENT_ROW = (
    r"^\s*(energy|protein|carbohydrates?|total\s+sugars?|added\s+sugars?|sugars?|total\s+fat|saturated\s+fat|trans\s+fat|sodium|dietary\s+fib(re|er)|fib(re|er)|fat|cholesterol|"
    r"calcium|iron|vitamin|potassium|serving\s+size|servings?\s+per|no\.?\s*of\s+servings?)[\s:\-–]*\d"
)
NUTRIENT_UNIT = r"per\s+100|per\s+serving|approximate\s+values?|%\s*(rda|rdi|daily)|\brda\b|\brdi\b|\bkcal\b"
BARCODE, PORTION = r"bar\s*-?\s*code", r"know\s+your\s+portion|serving\s+suggestion|serves\s+\d"
QR = r"\bqr\s*code\b|scan\s+(the\s+)?qr|scan\s+to\s+know"
FSSAI = r"fssai?|fsslai|fss[l1i]|essai|f[5s]sai"
ALLERGEN = r"^\s*contains\b\s*(:|$)|^\s*contains\s+(milk|soy|soya|wheat|nut|egg|mustard|sesame|sulphite|sulfite|gluten|peanut|tree\s+nut)|allerge?n"
#: Signs of a list: its punctuation.
LISTED = r"[,;()%]"


def line(pattern: str) -> tuple:
    """The line holds the pattern, case aside."""
    return "line", pattern


def head(words: str, reach: int = 42) -> tuple:
    """One of the words begins within the first letters of the line."""
    return "head", words, reach


def glued(*markers: str) -> tuple:
    """One of the markers is in the line's letters and digits."""
    return "glued", markers


def either(*tests: tuple) -> tuple:
    return "or", tests


def both(*tests: tuple) -> tuple:
    return "and", tests


def no(test: tuple) -> tuple:
    return "not", test


def gated(triggers: str, test: tuple) -> tuple:
    """``test``, which only a line with one of the triggers among its letters and digits can pass: patterns then run on few lines."""
    return "gated", triggers.split(), test


_PLAIN = no(line(LISTED))
_COLON = line(":")
#: An address of mail or of a site: patterns run where there is an at sign, or where a site's beginning is.
_ADDRESS = either(both(line("@"), line(EMAIL)), gated("http www", line(EMAIL_OR_SITE)))
_ALLERGEN_WORD = glued(*ALLERGENS)
#: What opens another section, in order; the first that holds decides.
RULES: list[tuple[str, tuple]] = [
    ("STORAGE", gated("onceopened airtight", either(line("once opened|airtight"), glued("onceopened")))),
    ("STORAGE", gated("store storage", both(line(r"\bstore\b|\bstorage\b"), either(head("store|storage|keep"), line(":|container|transfer"), _PLAIN)))),
    ("STORAGE", gated("keep", both(line(r"\bkeep\b"), either(head("keep|store"), line("dry|away|cool"), _PLAIN)))),
    ("CONSUMER_CARE", gated("consumercare customercare tollfree helpline executive", either(line(CARE), glued("consumercare", "customercare", "tollfree"), both(line("executive"), line("care"))))),
    ("FEEDBACK", gated("feedback feeback forfeed contac", either(line("feedback"), glued("feeback", "forfeed"), both(glued("contac"), either(line("care|cell|us"), line(PHONE), line(EMAIL)))))),
    ("CONSUMER_CARE", _ADDRESS),
    ("CONSUMER_CARE", gated("care contact feedback toll helpline call", both(line(PHONE), line("care|contact|feedback|toll|helpline|call")))),
    ("MANUFACTURER", gated("manufactured marketedby packedby mfd mkdby mfgby importedby pkd", line(MAKER))),
    ("BEST_BEFORE", gated("bestbefore useby expir", line(BEST_BEFORE))),
    ("BATCH", gated("batch lotno bno", line(BATCH))),
    ("MFG_DATE", gated("mfd mfg manufactur packed pkd", both(line(MADE_ON), either(line(DAY), head("mfd|mfg|pkd|pkg|manufactured|packed"), _COLON, _PLAIN)))),
    ("FSSAI", gated("fssai fsslai", either(line("fssai"), glued("fsslai")))),
    ("MRP", gated("mrp maximumretailprice", both(line(PRICE), either(line(MONEY), both(line(r"\d"), either(head(r"mrp|m\.r|maximum"), _COLON)))))),
    ("QUANTITY", gated("netwt netqty netquantity netweight netcontent", both(line(NET), either(line(r"\d|:"), head("net"))))),
    ("NUTRITION", gated("nutrition typicalvalue approximatevalue energy protein carbohydrate sugar fat sodium fib cholesterol calcium iron vitamin potassium serving noofserving per100 rda rdi daily kcal", either(line(NUTRITION), both(line(NUTRIENT_ROW), no(line(r"\("))), both(line(NUTRIENT_UNIT), line(r"\d"), no(line(r"[(,]")))))),
    ("BARCODE", gated("barcode", line(BARCODE))),
    ("PORTION", gated("knowyourportion servingsuggestion serves", line(PORTION))),
    ("QR", gated("qrcode scan", line(QR))),
    *((s, glued(*m.split()) if s not in ("MFG_DATE", "MRP") else both(glued(*m.split()), _PLAIN)) for s, m in GLUED.items()),
    ("ALLERGEN", gated("contain contan tain allergen allergn", either(line(ALLERGEN), both(glued("tain"), _ALLERGEN_WORD, _PLAIN), both(glued("contain", "contan"), head("contain|contan|cohtain|contai"))))),
]
#: What a line among ingredients is contaminated with, in order.
CONTAMINATION: list[tuple[str, tuple]] = [
    ("storage", gated("onceopened airtight", either(line("once opened|airtight"), glued("onceopened")))),
    ("contact", either(_ADDRESS, gated("care contact feedback toll helpline call consumer customer", both(line(PHONE), line("care|contact|feedback|toll|helpline|call|consumer|customer"))))),
    ("care", gated("consumercare customercare tollfree helpline executive", either(line(CARE), glued("consumercare", "customercare", "tollfree"), both(line("executive"), line("care"))))),
    ("feedback", gated("feedback feeback forfeed", either(line("feedback"), glued("feeback", "forfeed")))),
    ("contact", gated("contac", either(both(glued("contac"), line("care|cell|us|consumer|customer|feedback")), glued("contactus")))),
    ("maker", gated("manufacturedby packedby marketedby importedby mfd pkd", line(r"manufactured\s+by|packed\s+by|marketed\s+by|imported\s+by|\bmfd\b.*\bby\b|\bpkd\b.*\bby\b"))),
    ("address", either(gated("pkg mtrl rotopack pvt ltd", line(r"\bpkg\b|\bmtrl\b|\brotopack\b|\bpvt\b|\bltd\b")), both(line("[0-9]{6}"), line("(^|[^0-9])[0-9]{6}([^0-9]|$)")))),
    ("date", gated("bestbefore useby expir batch lotno bno mfd mfg manufactur packed pkd", either(line(BEST_BEFORE), line(BATCH), both(line(MADE_ON), either(line(DAY), line(r"^\s*(mfd|mfg|pkd|pkg|manufactured|packed)\b")))))),
    ("licence", gated("fss essai f5sai", line(FSSAI))),
    ("nutrition", gated("nutrition typicalvalue approximatevalue per100g", either(line(NUTRITION), glued("per100g")))),
    ("portion", gated("knowyourportion servingsuggestion serves", line(PORTION))),
    ("qr", gated("qrcode scan", line(QR))),
    ("barcode", gated("barcode", line(BARCODE))),
    ("price", gated("mrp maximumretailprice", both(line(PRICE), line(rf"{MONEY}|\d")))),
    ("quantity", gated("netwt netqty netquantity netweight netcontent", both(line(NET), line(r"\d|:")))),
    ("storage", gated("storage store keep", both(either(head("storage", 44), line(r"^.{0,39}\b(store|keep)\b")), either(line(":|container|transfer|dry|cool|away"), no(line("^.{70}")))))),
    ("allergen", gated("tain", both(glued("tain"), _ALLERGEN_WORD, no(line("[,(%]"))))),
]


def _triggers(test: tuple) -> list[str]:
    """The triggers of a test and of those within it."""
    if test[0] == "gated":
        return [*test[1], *_triggers(test[2])]
    inner = test[1] if test[0] in ("or", "and") else test[1:2] if test[0] == "not" else ()
    return [t for x in inner for t in _triggers(x)]


MARKERS = [*dict.fromkeys([m for ms in GLUED.values() for m in ms.split()] + ALLERGENS + FRAGMENTS + [t for _, test in RULES + CONTAMINATION for t in _triggers(test)])]


class Automaton:
    """All markers at once: ``table[state, letter]`` is the next state, ``found[state]`` the markers that end there."""

    def __init__(self, markers: Iterable[str]) -> None:
        steps, ends, markers = [{}], [set()], list(markers)
        self.longest = max(map(len, markers))
        for i, marker in enumerate(markers):
            at = 0
            for c in marker.encode():
                if c not in steps[at]:
                    steps[at][c] = len(steps)
                    steps.append({})
                    ends.append(set())
                at = steps[at][c]
            ends[at].add(i)
        letters = sorted({c for s in steps for c in s})
        self.code = np.zeros(256, np.int64)  # 0: any letter of no marker
        self.code[letters] = np.arange(1, len(letters) + 1)
        self.table = np.zeros((len(steps), len(letters) + 1), np.int64)
        link, waiting = [0] * len(steps), deque([0])
        while waiting:  # breadth first: a state's link is nearer to the root and done before it
            at = waiting.popleft()
            self.table[at] = self.table[link[at]] if at else 0
            ends[at] |= ends[link[at]]
            for c, to in steps[at].items():
                link[to] = self.table[at, self.code[c]] if at else 0
                self.table[at, self.code[c]] = to
                waiting.append(to)
        self.found = [sorted(e) for e in ends]
        self.ends = np.array([bool(e) for e in ends])

    def search(self, texts: list[bytes], piece: int = 512) -> list[list[int]]:
        """The markers in each text, in order of number.

        Texts are cut into pieces that overlap by the longest marker but one letter, so every marker lies in one whole; pieces are read side by side, a
        letter of each at a time, the longest first.
        """
        size = np.array([len(t) for t in texts], np.int64)
        count = np.maximum(1, -(-size // piece))
        owner = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        end = np.cumsum(size)[owner]
        begin = end - size[owner] + nth * piece
        size = np.minimum(piece + self.longest - 1, end - begin)
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order], size[order]
        letters = self.code[np.frombuffer(b"".join(texts), np.uint8)]
        out: list[set[int]] = [set() for _ in texts]
        state = np.zeros(len(order), np.int64)
        live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), side="right")
        for k, n in enumerate(live):
            state[:n] = self.table[state[:n], letters[begin[:n] + k]]
            for i in np.flatnonzero(self.ends[state[:n]]):
                out[owner[i]].update(self.found[state[i]])
        return [sorted(x) for x in out]


def spaceless(text: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def markers_in(text: Column) -> Column:
    """Numbers of the markers in a text's blank-free form, as an array."""
    automaton = Automaton(MARKERS)

    @F.pandas_udf("array<int>")
    def search(forms: pd.Series) -> pd.Series:
        return pd.Series(automaton.search([x.encode() for x in forms]))

    return search(spaceless(text))


def column(test: tuple, text: Column, found: Column) -> Column:
    """A rule's condition on a line and its markers."""
    kind, what, *more = test
    if kind == "line":
        return text.rlike(f"(?i){what}" if "|" not in what else f"(?i)(?:{what})")
    if kind == "head":
        return F.substring(F.lower(text), 1, more[0]).rlike(what)
    if kind == "glued":
        return F.arrays_overlap(found, F.array(*(F.lit(MARKERS.index(m)) for m in what)))
    if kind == "gated":
        return F.arrays_overlap(found, F.array(*(F.lit(MARKERS.index(t)) for t in what))) & column(more[0], text, found)
    if kind == "not":
        return ~column(what, text, found)
    return reduce(lambda a, b: a | b if kind == "or" else a & b, (column(t, text, found) for t in what))


def sql(test: tuple, text: str, form: str) -> str:
    """The same as SQL over a trimmed line and its blank-free form."""
    kind, what, *more = test
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    if kind == "line":
        return f"regexp_matches({text}, {quoted(f'(?i)(?:{what})')})"
    if kind == "head":
        return f"regexp_matches(substr(lower({text}), 1, {more[0]}), {quoted(what)})"
    if kind == "glued":
        return "(" + " OR ".join(f"contains({form}, '{m}')" for m in what) + ")"
    if kind == "gated":  # the gate changes nothing but time
        return sql(more[0], text, form)
    if kind == "not":
        return f"(NOT {sql(what, text, form)})"
    return "(" + (" OR " if kind == "or" else " AND ").join(sql(t, text, form) for t in what) + ")"


def _first(rules: list[tuple[str, tuple]], text: Column, found: Column) -> Column:
    case = F.when(text == "", F.lit(None).cast("string"))
    for name, test in rules:
        case = case.when(column(test, text, found), name)
    return case


def first_sql(rules: list[tuple[str, tuple]], text: str, form: str) -> str:
    return f"CASE WHEN {text} = '' THEN NULL " + " ".join(f"WHEN {sql(test, text, form)} THEN '{name}'" for name, test in rules) + " END"


def decided(lines: DataFrame, text: str) -> DataFrame:
    """``lines`` with ``boundary`` (the section that a line opens, other than the ingredients) and ``contamination``; null for neither."""
    own = lines.withColumn("__line", F.trim(F.coalesce(F.col(text), F.lit("")))).withColumn("__found", markers_in(F.col(text)))
    line_, found = F.col("__line"), F.col("__found")
    return own.withColumn("boundary", _first(RULES, line_, found)).withColumn("contamination", _first(CONTAMINATION, line_, found)).drop("__line", "__found")


def split_ingredients(lines: DataFrame, by: list[str], order: str, text: str, heading: Column) -> DataFrame:
    """``lines`` with ``section`` (the last one opened, null before any), ``accepted`` and ``reason``.

    A heading of ingredients opens them, a boundary any other section. Among ingredients a line is accepted if nothing contaminates
    it, else rejected for ``reason``; lines of other sections are neither.
    """
    told = decided(lines, text)
    opens = F.when(heading, "INGREDIENTS").otherwise(F.col("boundary"))
    section = F.last(opens, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order))
    inside = F.coalesce(F.col("section") == "INGREDIENTS", F.lit(False)) & (F.trim(text) != "")
    return told.withColumn("section", section).withColumn("accepted", inside & F.col("contamination").isNull()).withColumn("reason", F.when(inside, F.col("contamination"))).drop("boundary", "contamination")
