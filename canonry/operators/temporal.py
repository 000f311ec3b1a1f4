"""Valid-time operators on half-open intervals; a null end is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_force(day: Column, start: Column, end: Column) -> Column:
    return (start <= day) & (end.isNull() | (end > day))


def as_of_join(events: DataFrame, versions: DataFrame, day: str, start: str, end: str, on: list[str] | None = None) -> DataFrame:
    """Every version in force on an event's day: an equi-join on the year, and on ``on``, with the range test within.

    A version that ends stands under each of its years, one without an end under a key
    of its own that every event has besides its year. Spark chooses between broadcast and exchange.
    """
    keys = on or []
    years = F.when(F.col(end).isNull(), F.array(F.lit(-1))).when(F.col(start) < F.col(end), F.sequence(F.year(start), F.year(F.date_sub(F.col(end).cast("date"), 1))))
    by_year = versions.withColumn("__year", F.explode(years))
    return events.withColumn("__year", F.explode(F.array(F.year(day), F.lit(-1)))).join(by_year, ["__year", *keys]).where(in_force(F.col(day), F.col(start), F.col(end))).drop("__year")


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order`` (which should end in a unique column)."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rn = 1").drop("__rn")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def overlaps(df: DataFrame, by: list[str], id_: str, start: str, end: str) -> DataFrame:
    """Pairs of a key's intervals that overlap next to each other in time: a sweep, not a self-join.

    An interval is paired with the one before it that reaches furthest, so a key has
    a row for each interval that overlaps any earlier one. ``overlap_pairs`` has all pairs.
    """
    w = Window.partitionBy(*by).orderBy(start, id_).rowsBetween(Window.unboundedPreceding, -1)
    far = F.max(F.struct(F.coalesce(F.col(end).cast("timestamp"), F.lit("9999-12-31").cast("timestamp")).alias("until"), F.col(id_).alias("id"))).over(w)
    return df.withColumn("__far", far).where(F.col("__far.until") > F.col(start).cast("timestamp")).select(*by, F.col("__far.id").alias("earlier_id"), F.col(id_).alias("later_id"))


def overlap_pairs(df: DataFrame, by: list[str], id_: str, start: str, end: str) -> DataFrame:
    """Every pair of a key's intervals that overlap: a range join over bins of time as long as the key's mean interval.

    The earlier of a pair starts first, or has the smaller id; the pair is met in the
    bin where the later one starts. Bins number three times the rows at most. Empty
    intervals overlap those they lie inside of; a null start takes no part, null keys are a key.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    one = Window.partitionBy(*by)
    s, e = micros(start), F.coalesce(micros(end), F.lit((1 << 63) - 1))
    timed = df.where(F.col(start).isNotNull()).select(*by, F.col(id_).alias("__id"), s.alias("__s"), e.alias("__e"))
    # No interval has a later one past the last start of its key.
    ends = timed.withColumns({"__s0": F.min("__s").over(one), "__last": F.least(F.greatest("__e", "__s"), F.max("__s").over(one))})
    sized = ends.withColumn("__w", F.greatest(F.lit(1), F.ceil(F.avg(F.col("__last") - F.col("__s")).over(one))))
    cell = lambda c: F.expr(f"({c} - __s0) div __w")
    left = sized.where("__e > __s").select(*(F.col(c).alias(f"__l_{c}") for c in by), F.col("__id").alias("earlier_id"), F.col("__s").alias("__ls"), F.col("__e").alias("__le"), F.explode(F.sequence(cell("__s"), cell("__last"))).alias("__cell"))
    right = sized.select(*by, F.col("__id").alias("later_id"), F.col("__s"), F.col("__e"), cell("__s").alias("__at"))
    same = F.col("__cell") == F.col("__at")
    for c in by:
        same = same & F.col(f"__l_{c}").eqNullSafe(F.col(c))
    first = (F.col("__ls") < F.col("__s")) | ((F.col("__ls") == F.col("__s")) & (F.col("earlier_id") < F.col("later_id")))
    return left.join(right, same & first & (F.col("__s") < F.col("__le")) & (F.col("__ls") < F.col("__e"))).select(*by, "earlier_id", "later_id")
