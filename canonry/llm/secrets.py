"""Secret scans: candidates by shape, false positives removed by a random forest.

Candidates are strings that patterns of credentials or of assignments point at, and
long strings with digits and letters, however long they are. A quoted value goes up to
its closing quote (over line ends only where no line of it has a blank inside); an
unquoted one ends at a blank, quote, bracket, comma, semicolon, bar or ``&name=``. Values
have 8 characters at least, long strings 20. The patterns of assignments and long strings
take time linear in the text (that of web tokens does not on a run of many ``eyJ-``).
The forest judges each by its length, its character transitions, how much of it the
words of a dictionary cover, the path (or source) it comes from and the words beside
it. The dictionary holds the ``DICTIONARY`` most frequent words of all documents. The
forest is trained on labelled findings: ``labelled`` makes a set of them from stated
formats, with words of the dictionary, and ``fit`` takes any other.

Defined results: null and empty texts have no findings; a null path counts as ""; a
candidate that occurs twice in a text is found twice; findings don't overlap: secrets
that do are one, and what overlaps a secret, or an earlier candidate, is left out;
repeated rows are scanned each; other columns are ignored; an empty table gives an
empty one.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, small_batches

#: The shapes of credentials whose issuers publish them.
KNOWN = {
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z]+ )*PRIVATE KEY-----",
    "cloud_key_id": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "code_host_token": r"\bgh[pousr]_[0-9A-Za-z]{36,}",
    "chat_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "map_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "web_token": r"\beyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
}
#: Words that name a secret, and words that name a public identifier.
NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "private")
PUBLIC = ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "etag", "uuid", "guid", "revision", "isbn", "order", "invoice", "version", "id")
#: What people write where a secret would stand.
HOLDERS = ("example", "changeme", "your", "xxxx", "placeholder", "dummy", "sample", "redacted", "password", "secret", "none", "null", "test", "123456", "abcdef")
_ANY_NAME = "(?i:" + "|".join(map(re.escape, NAMES)) + ")"
#: A name and its sign, up to where the value starts. Runs start once and are taken whole, so that the scan stays linear.
_NAMED = re.compile(r"(?<![\w.-])(?=[\w.-]*?" + _ANY_NAME + r")[\w.-]++[\"']?\s*+(?::=|=>|=|:)\s*+")
_QUOTED = re.compile(r"(?P<quote>\"\"\"|\'\'\'|[\"'`])(?P<value>(?:\\[\s\S]|(?!(?P=quote))[^\\])*+)(?P=quote)")
_BARE = re.compile(r"[\"'`]*+(?P<value>(?:[^\s\"'`,;<>(){}\[\]|&]|&(?![\w.-]*+=))*+)")
_BLANK_INSIDE = re.compile(r"[^\s][^\S\n]++[^\s]")
_LONG = re.compile(r"(?<![0-9A-Za-z+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[0-9A-Za-z+/_=-]{20,}+")
_KNOWN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KNOWN.items()))
#: What each candidate must be near, so that texts without any of it need no scan.
_HINT = re.compile(r"[0-9]|PRIVATE KEY|AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|eyJ|" + _ANY_NAME)
_WORDS = re.compile(r"[A-Za-zÀ-ÿ]+")
_PARTS, _JOINTS = re.compile(r"[^\w.-]"), re.compile(r"[_.-]")
FEATURES = 25
DICTIONARY = 20_000  #: words of the dictionary at most
WORD_LETTERS = range(4, 17)  #: letters of its words
REDACTED = "[SECRET]"


def _values(text: str) -> tuple[list[tuple[int, int]], set[int]]:
    """Spans of the values of assignments, up to the closing quote and as bare runs, and where the names start."""
    spans, names, end, inner = [], set(), 0, None
    for m in _NAMED.finditer(text):
        at, found = m.end(), []
        quoted = _QUOTED.match(text, at)
        if quoted and ("\n" not in quoted["value"] or not _BLANK_INSIDE.search(quoted["value"])):
            found.append(quoted.span("value"))
        if at < end:  # an assignment within a bare value: of several, the last is a candidate of its own
            inner = (at, end)
        else:
            spans += [inner] if inner else []
            bare, inner = _BARE.match(text, at).span("value"), None
            end = bare[1]
            found.append(bare)
        found = [(a, b) for a, b in found if b - a >= 8]
        spans += found
        if found:
            names.add(m.start())
    spans += [inner] if inner else []
    return [(a, b) for a, b in spans if b - a >= 8], names


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every candidate of a whole text, in order, the longer first. They may overlap."""
    if not text or not _HINT.search(text):
        return []
    values, names = _values(text)
    # A run that an assignment's name begins is no candidate beside the value.
    kinds = {m.span(): "long" for m in _LONG.finditer(text) if m.start() not in names}
    kinds |= {m.span(): m.lastgroup for m in _KNOWN.finditer(text)}
    kinds |= dict.fromkeys(values, "named")
    return sorted(((a, b, kind) for (a, b), kind in kinds.items()), key=lambda c: (c[0], -c[1]))


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def dictionary(docs: DataFrame, most: int = DICTIONARY, least: int = 3) -> frozenset[str]:
    """The words of letters alone that occur most often in all documents, ``least`` times at least.

    Words go in by steps of an eighth of the logarithm of their count, from the most
    frequent on; of the step that would pass ``most``, a share chosen by hash. So about
    ``most`` words reach the driver, whatever the number of tasks.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def found():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(w for w in (t or "").lower().split() if len(w) in WORD_LETTERS and w.isalpha())
            if len(counts) > 500_000:
                yield found()
                counts.clear()
        if counts:
            yield found()

    small_batches(docs.sparkSession)
    counted = docs.select(F.col("text").cast("string")).mapInArrow(partial, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    step = F.floor(8 * F.log2(F.col("n").cast("double")) + 1e-9).cast("int")
    words = Scratch(docs.sparkSession, "dictionary").keep(counted.select("word", step.alias("step"), F.pmod(F.xxhash64("word"), F.lit(1_000_000)).alias("place")))
    first, share, taken = None, 0, 0
    for r in words.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        if taken + r.n > most:
            first, share = r.step, (most - taken) * 1_000_000 // r.n
            break
        taken += r.n
    kept = words if first is None else words.where((F.col("step") > first) | ((F.col("step") == first) & (F.col("place") < share)))
    return frozenset(r.word for r in kept.select("word").collect())


def coverage(candidate: str, words: frozenset[str]) -> float:
    """The largest share of the characters that words of the dictionary cover without overlap."""
    total = 0
    for run in _WORDS.findall(candidate.lower()):
        best = [0] * (len(run) + 1)
        for i in range(1, len(run) + 1):
            best[i] = max([best[i - 1], *(best[i - k] + k for k in WORD_LETTERS if k <= i and run[i - k : i] in words)])
        total += best[-1]
    return total / max(1, len(candidate))


def features(candidate: str, path: str, before: str, after: str, words: frozenset[str] = frozenset()) -> list[float]:
    """What the forest sees of a finding."""
    n = len(candidate)
    lower, kinds = candidate.lower(), [_kind(c) for c in candidate]
    steps = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, len(kinds) - 1)
    share = [kinds.count(k) / len(kinds) for k in range(4)] if kinds else [0.0] * 4
    counts = np.unique(list(candidate), return_counts=True)[1] / max(1, n)
    entropy = float(-(counts * np.log2(counts)).sum())
    pairs = sum(a in "aeiouyAEIOUY" and b.isalpha() and b not in "aeiouyAEIOUY" or b in "aeiouyAEIOUY" and a.isalpha() and a not in "aeiouyAEIOUY" for a, b in zip(candidate, candidate[1:], strict=False)) / max(1, n - 1)
    runs = [len(w) for w in _WORDS.findall(candidate)]
    near = _WORDS.findall(before.lower())[-6:] + _WORDS.findall(after.lower())[:3]
    left = before.rstrip().rstrip("\"'`").rstrip()
    name = (_PARTS.split(left.rstrip("=:> \t\"'`")) or [""])[-1].lower()
    hexes = sum(c in string.hexdigits for c in candidate) / max(1, n)
    alternating = sum((a.isdigit()) != (b.isdigit()) for a, b in zip(candidate, candidate[1:], strict=False)) / max(1, n - 1)
    return [
        min(n, 256), math.log1p(n), float(n in (32, 40, 64, 128)), steps, alternating, *share, entropy, entropy / max(1.0, math.log2(n or 1)), hexes, pairs,
        coverage(candidate, words), max(runs, default=0) / max(1, n), float(any(w in lower for w in HOLDERS)), len(set(lower)) / max(1, min(n, 36)),
        float(any(x in w for w in near for x in NAMES)), float(any(x in name for x in NAMES)), float(any(w in PUBLIC for w in _JOINTS.split(name))), float(left.endswith(("=", ":", "=>"))), float(before[-1:] in "\"'`" and before != ""),
        float(any(x in path.lower() for x in ("test", "example", "doc", "spec", "mock", "lock"))), float(any(x in path.lower() for x in (".env", "config", "secret", "cred", ".pem", ".key"))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", candidate))),
    ]


@dataclass
class Finding:
    candidate: str
    path: str
    before: str
    after: str
    label: int


def labelled(size: int = 4000, seed: int = 11, words: frozenset[str] = frozenset()) -> list[Finding]:
    """Labelled findings: credentials and look-alikes in contexts of prose, settings and code, with ``words`` if there are any."""
    r = random.Random(seed)
    known = sorted(words)
    syllables = ["th", "er", "on", "an", "ing", "tion", "es", "ent", "ar", "el", "que", "der", "ich", "ung", "ado", "mente", "la", "co", "ri", "st"]
    word = lambda: r.choice(known) if known and r.random() < 0.9 else "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    of = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    hexes, both = "0123456789abcdef", string.ascii_letters + string.digits
    paths = ["src/app.py", "src3", "src12", "notes.txt", "", "data.csv"]
    real, unreal = [*paths, "config/.env", "settings.yaml", "deploy/config.json"], [*paths, "tests/test_app.py", "docs/example.md", "package.lock"]

    def credential() -> tuple[str, str]:
        kind = r.randrange(10)
        value = [lambda: of(hexes, r.choice([*range(16, 41, 2), 40, 40, 48, 64])), lambda: of(hexes, r.choice([32, 40])).upper(), lambda: of(both, r.randint(12, 48)), lambda: of(both + "+/", r.choice([40, 44, 64, 88])), lambda: "AKIA" + of(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + of(both, 36), lambda: of(both + "-_", r.randint(16, 40)), lambda: of(both + "@%^!#", r.randint(9, 18)), lambda: of(both, r.randint(40, 400)), lambda: of("0123456789" * 3 + hexes, r.randint(14, 32))][kind]()
        if kind in (4, 5) and r.random() < 0.5:
            return value, prose(r.randint(0, 6)) + " "
        name = r.choice(["", "", "", "db_", "my_", "app.", "PROD_", "client-"]) + r.choice(NAMES)
        name = name.upper() if r.random() < 0.3 else name
        return value, prose(r.randint(0, 6)) + " " + name + r.choice([" = ", "=", "=", ": ", " => "]) + r.choice(['"', '"', "'", ""])

    def lookalike() -> tuple[str, str]:
        kind, joint = r.randrange(9), r.choice([" ", ": ", "=", " = "])
        if kind == 0:  # digests with a public name
            return of(hexes, r.choice([32, 40, 64])), prose(r.randint(0, 4)) + " " + r.choice(PUBLIC) + joint
        if kind == 1:
            return "-".join(of(hexes, n) for n in (8, 4, 4, 4, 12)), prose(r.randint(0, 4)) + " " + r.choice([*PUBLIC, word()]) + joint
        if kind == 2:  # placeholders
            return r.choice(["your_api_key_here", "changeme123", "example-token-value", "xxxxxxxxxxxxxxxxxxxx", "password123456", "test_secret_value", "<placeholder>", "dummy_token_0000", "REDACTED_REDACTED", "${SECRET_TOKEN}"]), prose(r.randint(0, 4)) + " " + r.choice(NAMES) + r.choice([" = ", ": ", "="]) + r.choice(['"', ""])
        if kind == 3:  # identifiers of code, also as the value of a name
            return "_".join(word() for _ in range(r.randint(2, 5))) + r.choice(["", "_2", "_v1", "_10"]), prose(2) + " " + r.choice(["", *NAMES]) + r.choice([" = ", "=", "("])
        if kind == 4:  # long words and numbered words
            return word() + word() + word() + of("0123456789", r.randint(1, 4)), prose(r.randint(1, 6)) + " "
        if kind == 5:
            return "/".join(word() for _ in range(r.randint(3, 6))) + "/" + of("0123456789", 3), prose(2) + " "
        if kind == 6:  # words that follow a secret's name in prose
            return "".join(word() for _ in range(r.randint(1, 4))), prose(r.randint(0, 4)) + " " + r.choice(NAMES) + r.choice([": ", " = ", "="]) + r.choice(['"', ""])
        if kind == 7:  # names that stand for a value
            return r.choice(["config", "settings", "self", "os.environ", "env", "process.env"]) + "." + r.choice(NAMES) + r.choice(["", "_" + word()]), prose(2) + " " + r.choice(NAMES) + r.choice([" = ", "="])
        return of("0123456789", r.randint(10, 24)) + r.choice(["", "a", "px"]), prose(r.randint(0, 4)) + " "

    out = []
    for i in range(size):
        value, before = credential() if i % 2 else lookalike()
        quote = before[-1:] if before[-1:] in ("\"", "'") else ""
        out.append(Finding(value, r.choice(real if i % 2 else unreal), before[-80:], quote + " " + prose(r.randint(0, 4)), i % 2))
    return out


class Forest:
    """A random forest of binary trees over quantile bins."""

    words: frozenset[str] = frozenset()

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, least: int = 4, bins: int = 24, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)])
        tried = max(1, round(math.sqrt(x.shape[1])) + 1)
        self.trees = [self._grow(binned, y, rng.integers(0, len(y), len(y)), depth, least, tried, rng) for _ in range(trees)] if len(y) else []

    def _grow(self, binned, y, rows, depth, least, tried, rng):
        """Nodes as (feature, bin, left, right); a leaf has feature -1 and its share of ones."""
        nodes: list[tuple] = []

        def split(rows, level) -> int:
            at, ones = len(nodes), float(y[rows].mean())
            nodes.append((-1, ones, 0, 0))
            if level == depth or len(rows) < 2 * least or ones in (0.0, 1.0):
                return at
            best = None
            for j in rng.permutation(binned.shape[1])[:tried]:
                values = binned[rows, j]
                n = np.bincount(values, minlength=len(self.cuts[j]) + 1).cumsum()[:-1]
                s = np.bincount(values, weights=y[rows], minlength=len(self.cuts[j]) + 1).cumsum()[:-1]
                m, u = len(rows) - n, y[rows].sum() - s
                ok = (n >= least) & (m >= least)
                if ok.any():
                    gini = np.where(ok, s * (n - s) / np.maximum(n, 1) + u * (m - u) / np.maximum(m, 1), np.inf)
                    k = int(gini.argmin())
                    if best is None or gini[k] < best[0]:
                        best = (gini[k], int(j), k)
            if best is None:
                return at
            _, j, k = best
            left = binned[rows, j] <= k
            a, b = split(rows[left], level + 1), split(rows[~left], level + 1)
            nodes[at] = (j, float(self.cuts[j][k]), a, b)
            return at

        split(rows, 0)
        return nodes

    def score(self, x: list[float]) -> float:
        """The mean share of ones in the leaves a finding comes to."""
        total = 0.0
        for nodes in self.trees:
            j, v, a, b = nodes[0]
            while j >= 0:
                j, v, a, b = nodes[a if x[j] <= v else b]
            total += v
        return total / max(1, len(self.trees))


def fit(findings: list[Finding], words: frozenset[str] = frozenset()) -> Forest:
    """A forest of labelled findings; it keeps the dictionary ``words`` that its features go by."""
    x = np.array([features(f.candidate, f.path, f.before, f.after, words) for f in findings]).reshape(-1, FEATURES)
    forest = Forest(x, np.array([f.label for f in findings], dtype=float))
    forest.words = words
    return forest


def learned(docs: DataFrame) -> Forest:
    """The forest for a corpus: its dictionary, and findings labelled with that."""
    words = dictionary(docs)
    return fit(labelled(words=words), words)


def findings_of(text: str | None, path: str | None, forest: Forest, threshold: float = 0.5) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of every finding of a text. Secrets that overlap are one; no other candidate overlaps anything."""
    scored = [(a, b, kind, forest.score(features(text[a:b], path or "", text[max(0, a - 80) : a], text[b : b + 40], forest.words))) for a, b, kind in candidates(text)]
    found: list[tuple[int, int, str, float]] = []
    for a, b, kind, score in scored:
        if score >= threshold:
            if found and a < found[-1][1]:
                start, end, first, best = found[-1]
                found[-1] = (start, max(end, b), first, max(best, score))
            else:
                found.append((a, b, kind, score))
    spans, others, end, i = found, [], 0, 0
    for c in scored:
        while i < len(spans) and spans[i][1] <= c[0]:
            i += 1
        if c[3] < threshold and c[0] >= end and not (i < len(spans) and spans[i][0] < c[1]):
            others.append(c)
            end = c[1]
    return sorted(spans + others)


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """One row a candidate: ``doc_id``, ``start``, ``end`` (characters), ``kind``, ``secret``, ``score``, ``is_secret``."""
    forest = forest or learned(docs)

    def run(ids, texts, paths):
        rows = [(i, a, b, k, t[a:b], s, s >= threshold) for i, t, p in zip(ids, texts, paths, strict=True) for a, b, k, s in findings_of(t, p, forest, threshold)]
        return list(zip(*rows, strict=True)) if rows else [[]] * 7

    names = ["doc_id", "start", "end", "kind", "secret", "score", "is_secret"]
    path = next((F.col(c) for c in docs.columns if c.lower() in ("path", "source")), F.lit("")).cast("string")
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), path.alias("path")), run, "doc_id long, start int, end int, kind string, secret string, score double, is_secret boolean", names)


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; texts without any are as before."""
    forest = forest or learned(docs)
    small_batches(docs.sparkSession)

    def clean(text: str | None, path: str | None) -> str | None:
        found = [x for x in findings_of(text, path, forest, threshold) if x[3] >= threshold]
        if not found:
            return text
        parts, at = [], 0
        for a, b, *_ in found:
            parts += [text[at:a], REDACTED]
            at = b
        return "".join([*parts, text[at:]])

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([clean(t, p) for t, p in zip(texts.to_pylist(), paths.to_pylist(), strict=True)], pa.string())

    path = next((F.col(c) for c in docs.columns if c.lower() in ("path", "source")), F.lit("")).cast("string")
    return docs.withColumn("text", cleaned(F.col("text").cast("string"), path))
