"""Queries of text extraction over documents and pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import extraction, sections
from ..operators.evaluation import summary
from .checks import parse_date
from .rule_queries import table

_LINES = "(SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o)) - 1 AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS o FROM documents))"


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def q33_adjacent_lines(spark, sf_dir):
    n = extraction.with_neighbours(_documents(spark, sf_dir))
    return n.where(F.length("line") < 8).select("doc_id", "line_no", F.length("before_1").alias("before"), F.length("after_1").alias("after"), F.length("after_2").alias("after2"))


Q33 = f"SELECT doc_id, line_no, b AS before, a AS after, a2 AS after2 FROM (SELECT *, lag(length(line)) OVER w b, lead(length(line)) OVER w a, lead(length(line), 2) OVER w a2 FROM {_LINES} WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) WHERE length(line) < 8"


def q34_blocks(spark, sf_dir):
    b = extraction.blocks(_documents(spark, sf_dir), r"^[A-ZÀ-Ý][^ ]*\.$", r"\|", most_lines=4)
    return b.select("doc_id", "line_no", F.length("line").alias("n"))


Q34 = f"""SELECT doc_id, line_no, length(line) n FROM (SELECT *, sum(CASE WHEN contains(line, '|') THEN 1 ELSE 0 END) OVER w stops, sum(length(line)) OVER w chars, row_number() OVER w k FROM
 (SELECT * FROM (SELECT *, min(CASE WHEN regexp_matches(line, '^[A-ZÀ-Ý][^ ]*\\.$') THEN line_no END) OVER (PARTITION BY doc_id) head FROM {_LINES}) WHERE line_no > head) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) WHERE stops = 0 AND k <= 4 AND chars <= 1500"""


def q35_first_copies(spark, sf_dir):
    return extraction.first_copy(extraction.lines_of(_documents(spark, sf_dir))).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.length("line").cast("long")).alias("chars"))


Q35 = f"SELECT doc_id, count(*) kept, sum(length(line))::BIGINT chars FROM (SELECT * FROM {_LINES} QUALIFY row_number() OVER (PARTITION BY doc_id, lower(trim(line, ' ')) ORDER BY line_no) = 1) GROUP BY 1"


def q36_emails(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.explode(text.emails(F.col("text"))).alias("email")).groupBy("doc_id", "email").agg(F.count("*").alias("n"))


Q36 = r"SELECT doc_id, email, count(*) n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]', 0)) email FROM documents) GROUP BY 1, 2"


def q36b_digit_runs(spark, sf_dir):
    runs = _documents(spark, sf_dir).select("doc_id", F.explode(text.digit_runs(F.col("text"), 13)).alias("digits"))
    return runs.select("doc_id", "digits", F.length("digits").cast("long").alias("n"), text.check_digit_ok(F.col("digits")).alias("ok"))


Q36B = "SELECT doc_id, d AS digits, length(d) n, list_sum(list_transform(range(1, length(d) + 1), lambda i: (d[length(d) + 1 - i])::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0 ok FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{13,}', 0)) d FROM documents)"


def _dated():
    """A text with two dates made of its own columns, since the texts have none: one that exists and one that may not."""
    return F.concat("text", F.format_string(" packed %d/%d/2024, best before %02d.%02d.2026", F.col("doc_id") % 28 + 1, F.col("doc_id") % 12 + 1, F.col("n_chars") % 31 + 1, F.col("n_chars") % 12 + 1))


def q37_dates(spark, sf_dir):
    found = _documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all(_dated(), F.lit(r"[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}"), F.lit(0))).alias("token"))
    return found.select("doc_id", "token", F.date_format(parse_date(F.col("token")), "yyyy-MM-dd").alias("day"))


Q37 = r"SELECT doc_id, token, strftime(try_strptime(token, ['%d/%m/%Y', '%d-%m-%Y', '%d.%m.%Y']), '%Y-%m-%d') AS day FROM (SELECT doc_id, unnest(regexp_extract_all(text || printf(' packed %d/%d/2024, best before %02d.%02d.2026', doc_id % 28 + 1, doc_id % 12 + 1, n_chars % 31 + 1, n_chars % 12 + 1), '[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}', 0)) token FROM documents)"


def q38_coherence(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", extraction.coherence(F.col("text")).alias("coherence"))


Q38 = r"""SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE greatest(0.0, (len(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z]{2,15}[.,;:]?$'))) - 0.5::DOUBLE * len(list_filter(w, lambda x: regexp_matches(x, '[#$%&*|]{2,}'))) - len(list_filter(w, lambda x: length(x) > 25))) / len(w)) END::DOUBLE coherence
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') w FROM documents)"""


def q39_contamination(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return d.select("lang", sections.junk_kind(F.col("text")).alias("kind")).groupBy("lang", "kind").agg(F.count("*").alias("n"))


Q39 = r"SELECT lang, CASE WHEN regexp_matches(text, '[#$%&*]{3}( |$)') THEN 'symbols' WHEN contains(text, '!! ') THEN 'shouting' WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '(?i)license|copyright') THEN 'legal' ELSE 'none' END kind, count(*) n FROM documents GROUP BY 1, 2"


def q40_evaluation(spark, sf_dir):
    truth = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("expected"))
    got = _documents(spark, sf_dir).select("doc_id", F.when(sections.junk_kind(F.col("text")).isin("symbols", "shouting"), "0").otherwise("1").alias("found"))
    return summary(truth, got, "doc_id")


Q40 = r"""WITH d AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[#$%&*]{3}( |$)') OR contains(text, '!! ') THEN 0 ELSE 1 END p FROM documents)
SELECT count(*) expected, count(p) covered, count(*) FILTER (WHERE p = quality) AS exact, count(p) / count(*)::DOUBLE coverage, count(*) FILTER (WHERE p = quality) / count(p)::DOUBLE agreement FROM labels LEFT JOIN d USING (doc_id)"""


def q40b_evaluation_of_all(spark, sf_dir):
    """All documents; tables and legal text are kinds that say nothing of quality, so nothing is found of them."""
    truth = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("expected"))
    kind = sections.junk_kind(F.col("text"))
    got = _documents(spark, sf_dir).select("doc_id", F.when(kind.isin("symbols", "shouting"), "0").when(kind == "none", "1").alias("found"))
    return summary(truth, got, "doc_id")


Q40B = r"""WITH d AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[#$%&*]{3}( |$)') OR contains(text, '!! ') THEN 0 WHEN contains(text, ' | ') OR regexp_matches(text, '(?i)license|copyright') THEN NULL ELSE 1 END p FROM documents)
SELECT count(*) expected, count(p) covered, count(*) FILTER (WHERE p = quality) AS exact, count(p) / count(*)::DOUBLE coverage, count(*) FILTER (WHERE p = quality) / count(p)::DOUBLE agreement FROM labels LEFT JOIN d USING (doc_id)"""


def q48_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"))


Q48 = """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) host, regexp_extract(html, '<title>([^<]*)</title>', 1) title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) links FROM pages"""

_NAMES = "q33_adjacent_lines q34_blocks q35_first_copies q36_emails q36b_digit_runs q37_dates q38_coherence q39_contamination q40_evaluation q40b_evaluation_of_all q48_links"
QUERIES = {n: (globals()[n], globals()[n.split("_")[0].upper()]) for n in _NAMES.split()}
