"""Reading specifications and records, writing reports; all through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_specs(spark: SparkSession, path: str, rows: str | None = None) -> DataFrame:
    """A JSON file of specifications; ``rows`` names the list in it that holds them."""
    df = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return df.select(F.inline(rows)) if rows else df


def read_registry(spark: SparkSession, path: str, rows: str, name: str) -> DataFrame:
    """A registry by lower-case name, in the order of the file."""
    df = spark.read.option("multiLine", True).json(path).select(F.posexplode(rows).alias("ordinal", "r"))
    return df.select("ordinal", F.lower(F.trim(F.col(f"r.{name}"))).alias("entry"), "r.*")


def read_table(spark: SparkSession, path_or_url: str, table: str | None = None, **options: str) -> DataFrame:
    """Parquet at a path, or a table over JDBC where ``table`` is given."""
    if table:
        return spark.read.format("jdbc").options(url=path_or_url, dbtable=table, **options).load()
    return spark.read.parquet(path_or_url)


def typed(value: Column) -> Column:
    """``struct(kind, b, n, s)`` of a text: truth values and finite numbers are told apart from text."""
    low = F.lower(F.trim(value))
    number = F.when(F.trim(value).rlike(r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(value).try_cast("double"))
    truth = F.when(low == "true", True).when(low == "false", False)
    kind = F.when(value.isNull(), "none").when(truth.isNotNull(), "bool").when(number.isNotNull(), "number").otherwise("text")
    return F.struct(kind.alias("kind"), truth.alias("b"), number.alias("n"), F.when(kind == "text", value).alias("s"))


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(by or [])).parquet(path)


def audit(df: DataFrame, path: str, actor: str, action: str) -> None:
    """One audit record a row, with the row as JSON detail."""
    append(df.select(F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.current_timestamp().alias("at"), F.to_json(F.struct("*")).alias("detail")), path)


def reports(findings: DataFrame, by: list[str]) -> DataFrame:
    """One JSON report a key, its findings in order of check."""
    item = F.struct(*(c for c in ("check_id", *sorted(set(findings.columns) - {*by, "check_id"}))))
    return findings.groupBy(*by).agg(F.to_json(F.sort_array(F.collect_list(item))).alias("report"))


def exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def one(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """The first row by an order that ends in a unique column; no row of an empty frame."""
    return df.orderBy(*order).limit(1)


def within(at: Column, first: str | None, last: str | None) -> Column:
    """Whether a time falls on the days from ``first`` to ``last``, both included; a null bound is open."""
    day = F.to_date(at)
    tests = [t for t in (day >= F.lit(first).cast("date") if first else None, day <= F.lit(last).cast("date") if last else None) if t is not None]
    return F.coalesce(tests[0] & tests[-1], F.lit(False)) if tests else day.isNotNull()


def in_force_now(versions: DataFrame, start: str, end: str, today: Column | None = None) -> DataFrame:
    """The versions in force on the day of the query, or on ``today``; an end is not included, a null one open."""
    day = F.current_date() if today is None else today
    return versions.where((F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) > day)))


def migrate(spark: SparkSession, ledger: str, migrations: list[tuple[str, str]]) -> list[str]:
    """Runs, by name, the statements that the table ``ledger`` doesn't list, and lists each as soon as it ran; returns their names.

    A statement that fails ends the run: those before it stay listed, so that a second call goes on with it.
    """
    if not exists(spark, ledger):
        spark.createDataFrame([], "name string, applied_at timestamp").write.saveAsTable(ledger)
    done, ran = {r["name"] for r in spark.table(ledger).select("name").collect()}, []
    for name, statement in sorted(migrations):
        if name not in done:
            spark.sql(statement)
            spark.createDataFrame([(name,)], "name string").withColumn("applied_at", F.current_timestamp()).write.mode("append").saveAsTable(ledger)
            ran.append(name)
    return ran
