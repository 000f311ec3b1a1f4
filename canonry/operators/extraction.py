"""Set-oriented extraction from documents read as ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_of(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_``, ``line_no`` (from 0), ``line``."""
    return docs.select(id_, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def with_neighbours(docs: DataFrame, id_: str = "doc_id", text: str = "text", reach: int = 2) -> DataFrame:
    """Each line of a text with those up to ``reach`` before and after it, taken from the text's own lines: no shuffle."""
    near = lambda i: [*(F.get("__lines", i - k).alias(f"before_{k}") for k in range(1, reach + 1)), *(F.get("__lines", i + k).alias(f"after_{k}") for k in range(1, reach + 1))]
    # Neighbours are put beside a line before lines become rows: a row that carried all its text's lines would be quadratic in them.
    beside = F.transform("__lines", lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), *near(i)))
    return docs.select(id_, F.split(text, "\n").alias("__lines")).select(id_, F.inline(beside))


def first_copy(lines: DataFrame, id_: str = "doc_id") -> DataFrame:
    """Lines without later repeats of the same line, spaces and case aside."""
    key = F.lower(F.trim("line"))
    w = Window.partitionBy(id_, key).orderBy("line_no")
    return lines.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def blocks(docs: DataFrame, heading: str, boundary: str, id_: str = "doc_id", text: str = "text", most_lines: int = 11, most_chars: int = 1500) -> DataFrame:
    """The lines after a text's first heading until a boundary, bounded in lines and characters: ``id_``, ``line_no``, ``line``; no shuffle."""
    marked = docs.select(id_, F.split(text, "\n").alias("__lines")).withColumn("__head", F.array_position(F.transform("__lines", lambda x: x.rlike(heading)), True).cast("int"))
    after = marked.where("__head > 0").withColumn("__after", F.slice("__lines", F.col("__head") + 1, most_lines))
    stop = F.array_position(F.transform("__after", lambda x: x.rlike(boundary)), True).cast("int")
    own = after.select(id_, "__head", F.when(stop > 0, F.slice("__after", 1, stop - 1)).otherwise(F.col("__after")).alias("__own"))
    laid = own.select(id_, "__head", "__own", F.posexplode("__own").alias("__k", "line"))
    chars = F.aggregate(F.slice("__own", 1, F.col("__k") + 1), F.lit(0), lambda acc, x: acc + F.length(x))
    return laid.where(chars <= most_chars).select(id_, (F.col("__head") + F.col("__k")).alias("line_no"), "line")


def coherence(text: Column) -> Column:
    """How much a text reads like words: share of plain words, less symbols and very long words; 0 to 1.

    One pass over the words within the row; each is read once by patterns that begin at its start or find the first
    two symbols, so time is linear in the text, however long a word is.
    """
    one = lambda c: F.when(c, 1).otherwise(0)
    none = F.struct(*(F.lit(0).alias(k) for k in ("n", "plain", "odd", "long")))
    return F.aggregate(
        F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), none,
        lambda acc, w: F.struct((acc["n"] + 1).alias("n"), (acc["plain"] + one(w.rlike(r"^[A-Za-z]{2,15}[.,;:]?\z"))).alias("plain"), (acc["odd"] + one(w.rlike(r"[#$%&*|]{2}"))).alias("odd"), (acc["long"] + one(F.char_length(w) > 25)).alias("long")),
        lambda acc: F.when(acc["n"] > 0, F.greatest(F.lit(0.0), (acc["plain"] - 0.5 * acc["odd"] - acc["long"]) / acc["n"])).otherwise(0.0),
    )
