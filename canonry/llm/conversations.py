"""Conversation structure repair: the cheapest edits that give every conversation the form system? (user assistant)+.

A row is kept (0), given the other role (2) or deleted (3; blank and repeated rows must
be), and empty turns are inserted anywhere (2); a truncated row that stays costs 1. The edit lattice has a
node for (rows read, state of the form). A* searches it with the suffix sums of what can't be avoided, 3 a
row that must go and 1 a truncated row, as the heuristic, and takes nodes by (cost plus heuristic,
audit so far). The heuristic is consistent, and of two edits of the same rows that end in one state at one cost none is
the beginning of the other, so the first time that a node is taken it has its least audit.

Work is spread so that one conversation may hold a third of all rows. Alike rows of a
turn are one row with a count. Rows then travel without their texts: as a turn, a role, a
hash and a fault. They are dealt out in order by ranges, so that a long conversation becomes pieces
in several tasks; rows of a piece become a string of one letter each, and A* finds, from each state
at the beginning to each state at the end, the cheapest edits of blocks of ``BLOCK``
rows. Costs add and audits concatenate, so blocks and pieces are joined as matrices over (min, +), exactly. A
conversation of at most ``BLOCK`` rows in one piece is one search.
What comes together of a conversation is a letter a row: no more than its audit, which is one value of
the result. Texts are exchanged once and read in order as a stream with the audit at its
head, without being gathered. (A hash of a whole conversation is one chain, so that stream is one task for each conversation.)

Defined results: null roles and texts are one space; null turns come first; rows of equal turn go
by role, then by hash of the text. A null ``conv_id`` is a conversation. An empty table gives an empty one. Further columns are ignored. Differences of turns wrap
at 64 bits.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_batches, small_batches

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows that one search covers.
BLOCK = 256
#: States of the form: nothing yet, after the system's turn, after a user's, after an assistant's; and where an initial leads.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FREE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Letters of a row in a string of rows: its initial (``-`` for none of the form), in capitals if truncated; ``x`` if it must go.
MUST_GO = "x"
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of a table with damage chosen by ``crc32`` of ``conv_id:turn``, and ``copies``: 0 where a row is dropped, 2 where it is repeated."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")), F.lit(20))
    role = F.when(kind == 4, "user").otherwise(or_space("role"))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(or_space("text"), ".!?", "")).otherwise(or_space("text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _placed(turns: DataFrame, copies: Column | None) -> DataFrame:
    """Rows with what they are ordered by: ``known`` (the turn isn't null), ``turn``, ``role``, hashes ``h1`` and ``h2`` of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
    return rows.withColumns({"known": F.col("turn").isNotNull(), "turn": F.coalesce("turn", F.lit(0)), "h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("second"), "text")})


def facts(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """Alike rows of a turn as one, with ``n``, ``fault`` (``B``, ``T`` or none) and ``later``: role and text occur in an earlier turn."""
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(end == "", "B").when(~end.isin(".", "!", "?"), "T").otherwise("")
    place = ["conv_id", "known", "turn", "role", "h1", "h2"]
    once = _placed(turns, copies).select(*place, fault.alias("fault"), "copies").groupBy(*place).agg(F.min("fault").alias("fault"), F.sum("copies").alias("n"))
    at = F.struct("known", "turn")
    first = once.where("n > 0").groupBy("conv_id", "role", "h1", "h2").agg(F.min(at).alias("first")).select(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("role") == F.col("__r")) & (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2"))
    return once.join(first, same, "left").select(*place, "fault", "n", F.coalesce(at > F.col("first"), F.lit(False)).alias("later"))


@lru_cache(maxsize=1 << 16)
def search(rows: str, entry: int) -> dict[int, tuple[int, str]]:
    """A*: for each state in which ``rows`` may end, from ``entry``, the least cost and the least audit of that cost."""
    rest = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[i] == MUST_GO else TRUNCATED if rows[i].isupper() or rows[i] == "_" else 0)
    heap, closed, ends = [(rest[0], "", 0, entry)], set(), {}
    while heap:
        f, audit, i, state = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = f - rest[i]
        if i == len(rows):
            ends[state] = (cost, audit)
        heapq.heappush(heap, (f + INSERT, audit + "I", i, FREE[state]))
        if i < len(rows):
            row, base = rows[i], cost + rest[i + 1]
            heapq.heappush(heap, (base + DELETE, audit + "D", i + 1, state))
            if row != MUST_GO:
                base += TRUNCATED * (row.isupper() or row == "_")
                if (to := STEPS[state].get(row.lower())) is not None:
                    heapq.heappush(heap, (base + KEEP, audit + "K", i + 1, to))
                heapq.heappush(heap, (base + REROLE, audit + "R", i + 1, FREE[state]))
    return ends


def joined(a: dict, b: dict) -> dict:
    """Two matrices {(entry, end): (cost, audit)} of neighbouring rows as one."""
    out = {}
    for (entry, middle), (cost, audit) in a.items():
        for (begin, end), (more, rest) in b.items():
            if begin == middle and (known := out.get((entry, end), (cost + more + 1, "")))[0] >= cost + more:
                new = (cost + more, audit + rest)
                out[entry, end] = min(new, known)
    return out


def matrix(rows: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest edits of ``rows`` between all states, joined by halves so that audits are copied as often as a tree is deep."""
    parts = [{(e, x): v for e in STEPS for x, v in search(rows[k : k + BLOCK], e).items()} for k in range(0, len(rows), BLOCK)] or [{(e, x): v for e in STEPS for x, v in search("", e).items()}]
    return _tree(parts)


def _tree(parts: list[dict]) -> dict:
    while len(parts) > 1:
        parts = [joined(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def cheapest(paths: dict) -> tuple[int, str]:
    """Of the edits from the start to an end of the form the cheapest, ties to the least audit."""
    return min(paths[START, x] for x in (START, ASSISTANT) if (START, x) in paths)


def _piece(rows: list[dict]) -> str:
    """What a piece of a conversation contributes, as JSON: turns, counts of faults and illegal neighbours, initials at its ends, its rows as letters or, if many, their matrix."""
    letters, counts, initials, turns, illegal = [], {"B": 0, "D": 0, "T": 0}, [], [], 0
    for r in rows:
        if not r["n"]:
            continue
        if r["known"] and (not turns or turns[-1] != r["turn"]):
            turns.append(r["turn"])
        initial = r["role"][:1]
        for k in range(r["n"]):
            fault = "B" if r["fault"] == "B" else "D" if r["later"] or k else r["fault"]
            counts[fault] = counts.get(fault, 0) + 1
            illegal += bool(initials) and initials[-1] + initial not in LEGAL
            initials[1:] = [initial]
            shown = initial if initial in ("s", "u", "a") else "-"
            letters.append(MUST_GO if fault in ("B", "D") else shown if fault != "T" else "_" if shown == "-" else shown.upper())
    out = {"turns": [turns[0], turns[-1], len(turns)] if turns else None, "counts": [counts["B"], counts["D"], counts["T"], illegal], "ends": [initials[0], initials[-1]] if initials else None}
    # Of a long piece the matrix is made here, where pieces are still apart; of a short one where they meet, if there are several.
    return json.dumps(out | ({"rows": "".join(letters)} if len(letters) <= BLOCK else {"matrix": [[*k, *v] for k, v in matrix("".join(letters)).items()]}))


def _whole(pieces: list[dict]) -> tuple:
    """A conversation's counts and its cheapest edits from its pieces in order."""
    turns, counts, last, found = None, [0, 0, 0, 0], None, []
    for p in pieces:
        if p["turns"]:
            first, end, n = p["turns"]
            turns = [first, end, n] if turns is None else [turns[0], end, turns[2] + n - (turns[1] == first)]
        counts = [a + b for a, b in zip(counts, p["counts"], strict=True)]
        if p["ends"]:
            counts[3] += last is not None and last + p["ends"][0] not in LEGAL
            last = p["ends"][1]
        if "matrix" in p or p["rows"]:
            found.append(p)
    gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
    gaps = (gaps + (1 << 63)) % (1 << 64) - (1 << 63)
    if len(found) == 1 and "matrix" not in found[0]:
        paths = {(START, x): v for x, v in search(found[0]["rows"], START).items()}
    else:
        paths = _tree([p.get("matrix") or matrix(p["rows"]) for p in found]) if found else {(START, START): (0, "")}
    return (gaps, *counts, *cheapest(paths))


def audits(turns: DataFrame, copies: Column | None = None, pieces: int | None = None) -> DataFrame:
    """For each conversation ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit``; rows of 0 ``copies`` only make it known."""
    spark, kind = turns.sparkSession, turns.schema["conv_id"].dataType.simpleString()
    n = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = facts(turns, copies).repartitionByRange(n, "conv_id", "known", "turn", "role", "h1", "h2").withColumn("piece", F.spark_partition_id())
    rows = dealt.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(F.struct("known", "turn", "role", "h1", "h2", "later", "fault", "n"))).alias("rows"))
    parts = map_batches(rows, lambda c, p, r: [c, p, list(map(_piece, r))], f"conv_id {kind}, piece int, part string", ["conv_id", "piece", "part"])
    gathered = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", "part"))).alias("parts"))
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    return map_batches(gathered, lambda c, p: [c, *zip(*(_whole([_read(y["part"]) for y in x]) for x in p), strict=True)], f"conv_id {kind}, {SUMMARY}", ["conv_id", *names])


def _read(part: str) -> dict:
    p = json.loads(part)
    if "matrix" in p:
        p["matrix"] = {(a, b): (cost, audit) for a, b, cost, audit in p["matrix"]}
    return p


def _stream(turns: DataFrame, copies: Column | None) -> DataFrame:
    """Every conversation's audit and then its rows in order, side by side in one partition."""
    found = audits(turns, copies)
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    head = found.select("conv_id", F.lit(0).alias("kind"), F.lit(False).alias("known"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), F.struct(*names).alias("found"))
    body = _placed(turns, copies).where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "known", "turn", "role", "h1", "h2", "text", "copies", F.lit(None).cast(head.schema["found"].dataType).alias("found"))
    small_batches(turns.sparkSession)
    return head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "known", "turn", "role", "h1", "h2")


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(None, conversation, its summary) and then (letter, role, text, turn) of each row that stays or is inserted, in order."""
    audit, at, state = "", 0, START

    def inserts() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, FREE[state]
            yield "I", NAMES[state], "", None

    for b in batches:
        for r in b.to_pylist():
            if r["kind"] == 0:
                yield from inserts()
                audit, at, state = r["found"]["audit"], 0, START
                yield None, r["conv_id"], r["found"], None
                continue
            for _ in range(r["copies"]):
                yield from inserts()
                letter = audit[at]
                at += 1
                if letter != "D":
                    state = STEPS[state][r["role"][:1]] if letter == "K" else FREE[state]
                    yield letter, r["role"] if letter == "K" else NAMES[state], r["text"], r["turn"] if r["known"] else None
    yield from inserts()


def repair(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """The repaired rows: ``conv_id``, ``place`` (from 0), ``role``, ``text``, ``edit`` (K, R or I), ``turn`` (null where inserted)."""
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, place long, role string, text string, edit string, turn long"
    return _stream(turns, copies).mapInArrow(_Rows(schema), schema)


def digest(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """Each conversation's summary and the SHA-256 of its repaired ``role:text``, joined by newlines."""
    copies = F.col("copies") if copies is None and "copies" in turns.columns else copies
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {SUMMARY}, repaired_sha256 string"
    return _stream(turns, copies).mapInArrow(_Hashes(schema), schema)


class _Out:
    """Rows in batches of some megabytes."""

    def __init__(self, schema: str) -> None:
        self.arrow = arrow_schema(schema)

    def batches(self, rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
        arrow, held, size = self.arrow, [], 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
        for row in rows:
            held.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, str))
            if size > 4 << 20:
                yield make()
                held, size = [], 0
        if held:
            yield make()


class _Rows(_Out):
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return self.batches(self.rows(batches))

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, place = None, 0
        for letter, a, b, turn in _edited(batches):
            if letter is None:
                conv, place = a, 0
            else:
                yield conv, place, a, b, letter, turn
                place += 1


class _Hashes(_Out):
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return self.batches(self.rows(batches))

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        head, sha, first = None, None, True
        for letter, a, b, _ in _edited(batches):
            if letter is None:
                if head:
                    yield *head, sha.hexdigest()
                head, sha, first = (a, *b.values()), hashlib.sha256(), True
            else:
                sha.update(("" if first else "\n").encode() + f"{a}:{b}".encode())
                first = False
        if head:
            yield *head, sha.hexdigest()


def _sql() -> str:
    """The same in DuckDB's SQL: rows one after the other, the cheapest (cost, audit) of each state as a string that sorts by both."""
    add = lambda v, cost, letter: f"CASE WHEN {v} = '~' THEN '~' ELSE printf('%010d', {v}[1:10]::BIGINT + {cost}) || {v}[11:] || '{letter}' END"
    free = "least(v0, vs, va)"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    closed = f"SELECT conv_id, i, v0, vs, least(vu, {add(free, 2, 'I')}) AS vu, va FROM p"
    closed = f"SELECT conv_id, i, v0, vs, vu, least(va, {add('vu', 2, 'I')}) AS va FROM ({closed})"
    return f"""WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
k AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, z: {bit})), 4294967295::BIGINT) % 20 AS kind FROM d),
x AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, {blanks}) AS t FROM x),
f AS (SELECT *, CASE WHEN t = '' THEN 'B' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'D' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'T' ELSE '' END AS fault, left(role, 1) AS ini FROM o),
n AS (SELECT conv_id, i, fault, ini, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f),
p AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '0000000000' AS v0, '~' AS vs, '~' AS vu, '~' AS va FROM conversations
 UNION ALL SELECT q.conv_id, n.i, {add('v0', 3, 'D')}, least({add('vs', 3, 'D')}, CASE WHEN stays AND ini = 's' THEN {add('v0', 'trunc', 'K')} ELSE '~' END),
 least({add('vu', 3, 'D')}, CASE WHEN stays AND ini = 'u' THEN {add(free, 'trunc', 'K')} WHEN stays THEN {add(free, '2 + trunc', 'R')} ELSE '~' END),
 least({add('va', 3, 'D')}, CASE WHEN stays AND ini = 'a' THEN {add('vu', 'trunc', 'K')} WHEN stays THEN {add('vu', '2 + trunc', 'R')} ELSE '~' END)
 FROM ({closed}) q JOIN (SELECT *, fault NOT IN ('B', 'D') AS stays, CASE fault WHEN 'T' THEN 1 ELSE 0 END AS trunc FROM n) n ON n.conv_id IS NOT DISTINCT FROM q.conv_id AND n.i = q.i + 1),
e AS (SELECT conv_id, least(v0, va) AS v FROM ({closed}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
a AS (SELECT conv_id, v[1:10]::BIGINT AS cost, v[11:] AS audit FROM e),
l AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS j FROM a WHERE audit <> ''),
w AS (SELECT conv_id, letter, j, count(*) FILTER (WHERE letter <> 'I') OVER y AS i, count(*) FILTER (WHERE letter <> 'D') OVER y AS m FROM l WINDOW y AS (PARTITION BY conv_id ORDER BY j)),
s AS (SELECT w.*, f.role, f.text, max(CASE WHEN m = 1 AND letter = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY w.conv_id) AS sys FROM w LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i AND letter <> 'I'),
h AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (m - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS t FROM s WHERE letter <> 'D' GROUP BY 1),
c AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps FROM f GROUP BY 1),
g AS (SELECT conv_id, count(*) FILTER (WHERE fault = 'B') AS blank, count(*) FILTER (WHERE fault = 'D') AS duplicate, count(*) FILTER (WHERE fault = 'T') AS truncated, count(*) FILTER (WHERE before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM n GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM a.conv_id"""


SQL = _sql()
