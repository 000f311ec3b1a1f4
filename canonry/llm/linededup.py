"""Line dedup: lines that many documents share are dropped, the others put together again by position.

Every text is split at ``\\n``. A line's key is the line without blanks at its ends and
with A-Z in lower case, told apart by a 128-bit hash. Lines are exploded as (document,
position, hash): texts don't travel to be counted. A first shuffle tells the distinct
documents of a key, spread by both; their counts are combined before the second, so a
line that a third of all documents hold is no more than a row a task. Positions to drop
are found by a join on the hash. Keys that hold over 1 / ``HOT`` of all counts, fewer than ``HOT`` of them whatever the data, are
broadcast beforehand, and their lines are dealt out by document; of the others none is more than that share of the
join. Positions are gathered by document, as many as its lines at most. Texts are exchanged
once, with those positions, or not at all where the positions are few enough for a
broadcast.

Everything is built-in functions: no Python code runs on rows.

Defined results: a null or empty text is one empty line and comes back as an empty
text; keys shorter than ``least_chars`` are kept whatever their number. Documents are told apart
by ``doc_id``, all those with a null id being one; rows that repeat an id each come back,
and count as one document. An empty table gives an empty one. Further columns pass through;
``n_lines`` and ``n_dropped`` replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: What is stripped from a line's ends.
BLANKS = " \t\n\x0b\x0c\r"
#: Keys that hold more than one part in so many of all counts are hot: fewer than that many, so that they may be broadcast.
HOT = 1000


def folded(text: Column) -> Column:
    """A form of ``text`` that two texts share exactly if they are alike but for the case of A-Z.

    Plain ASCII is lower-cased. Of other texts each byte becomes a character of ISO 8859-1, which is then lower-cased.
    Beside A-Z that moves leading bytes C2-DE of two-byte characters to E2-FE, and those are told
    apart from the leading bytes of longer characters by what follows: one byte in place of two or three. (``translate`` gives
    the same classes, but looks up every character: some 160 ns each.)
    """
    return F.lower(F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.decode(text.cast("binary"), "ISO-8859-1")))


def _chars(key: Column) -> Column:
    """Code points of a folded key: its bytes but for those that continue a character."""
    return F.char_length(F.regexp_replace(key, "[\u0080-\u00bf]", ""))


def line_keys(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """``doc_id``, ``copy`` (hash of the text), ``pos`` and the key's hash ``h1``, ``h2`` of every line whose key is long enough."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The hash is taken before lines are exploded: else each line would carry its whole text for it.
    whole = docs.select("doc_id", F.xxhash64("text").alias("copy"), F.split(folded(text), "\n").alias("lines"))
    lines = whole.select("doc_id", "copy", F.posexplode("lines").alias("pos", "line"))
    keys = lines.select("doc_id", "copy", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.col("key") != "" if least_chars == 1 else _chars(F.col("key")) >= least_chars)
    return keys.select("doc_id", "copy", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def common_keys(lines: DataFrame, least_docs: int) -> DataFrame:
    """``h1``, ``h2`` of the keys found in at least ``least_docs`` documents, and in how many ``docs``."""
    return lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs)


def common_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """The lines whose key is common."""
    common = common_keys(lines, least_docs)
    hot = common.where(F.col("docs") * HOT > common.agg(F.sum("docs")).scalar()).select("h1", "h2", F.lit(True).alias("hot"))
    told = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    at = F.when(F.col("hot"), F.xxhash64("doc_id", "pos")).otherwise(F.col("h1"))
    met = told.select("doc_id", "copy", "pos", "hot", at.alias("k1"), "h2").join(common.select(F.col("h1").alias("k1"), "h2", F.lit(True).alias("found")), ["k1", "h2"], "left")
    return met.where("hot or found").select("doc_id", "copy", "pos")


def dedup(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """``docs`` with the lines that many documents share dropped from ``text``, and ``n_lines`` (before) and ``n_dropped``."""
    lines = line_keys(docs, least_chars)
    drops = common_lines(lines, least_docs).groupBy("doc_id", "copy").agg(F.collect_set("pos").alias("__dropped"))
    copy, parts, dropped = (free_name(docs, x) for x in ("copy", "lines", "dropped"))
    drops = drops.select(F.col("doc_id").alias("__of"), F.col("copy").alias("__copy"), F.col("__dropped"))
    own = docs.select(*(F.col(c) for c in docs.columns if c != "text"), F.xxhash64("text").alias(copy), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n").alias(parts))
    own = own.alias("own").join(drops.alias("drops"), F.col("own.doc_id").eqNullSafe(F.col("drops.__of")) & (F.col(f"own.{copy}") == F.col("drops.__copy")), "left").select("own.*", F.col("drops.__dropped").alias(dropped))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), dropped)
    text = F.array_join(F.when(F.col(dropped).isNull(), F.col(parts)).otherwise(F.transform(kept, lambda i: F.get(parts, i))), "\n")
    counts = {"n_lines": F.size(parts).cast("long"), "n_dropped": F.coalesce(F.size(dropped), F.lit(0)).cast("long")}
    return own.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in counts), *(v.alias(k) for k, v in counts.items()))


def digest(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and the SHA-256 of what is left of each text."""
    return dedup(docs, least_docs, least_chars).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: The same in DuckDB's SQL.
SQL = r"""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY doc_id"""
